"""Language ID with bit-sliced Bloom filters: one probe of an n-gram returns the set of languages that contain it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cosmotab.llm.common import map_texts, mix64, slices, utf8_view, written

#: Bound of the fit: about this many labelled documents of each language are read for it.
FIT_DOCS_PER_LANGUAGE = 4000
GRAM = 4
PROBES = 3
#: A language holds an n-gram that it uses at least 1 / RATIO as often as the language that uses it most.
RATIO = 3.0
MIN_COUNT = 3
#: Languages in one mask of an n-gram.
MASK_BITS = 62
UNDETERMINED = "und"
#: Text whose n-grams a task holds at once: they take some fifty times that.
WORK_BYTES = 1 << 20

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 4-byte n-grams of the lower-cased texts, letters only with single spaces around words; and the n + 1 offsets."""
    padded = pc.binary_join_element_wise(" ", pc.utf8_lower(texts), " ", "")
    data, at = utf8_view(padded)
    folded = _FOLD[data]
    if len(folded) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
    n = len(folded) - GRAM + 1
    wide = folded.astype(np.uint32)
    gram = wide[:n] | wide[1 : n + 1] << 8 | wide[2 : n + 2] << 16 | wide[3 : n + 3] << 24
    gap = folded == 32
    twice = gap[:-1] & gap[1:]  # between words, and where one text meets the next
    good = ~(twice[:n] | twice[1 : n + 1] | twice[2 : n + 2])
    kept = np.concatenate([[0], np.cumsum(good)])
    return gram[good], kept[np.minimum(at, n)]


def probes(gram: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """PROBES slots of a filter of 2 ** bits slots for each n-gram, by double hashing of a well mixed hash: slots that went
    together would be false together more often than the correction takes off."""
    first = mix64(gram.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = mix64(first) | np.uint64(1)
    for k in range(PROBES):
        yield ((first + np.uint64(k) * step) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    """languages in order; slices[s][slot] has bit b set if language 8 * s + b has that slot; rates are the filters'
    false-positive rates; prior is the index of the language with the most documents, prior_share its share."""

    languages: list[str]
    bits: int
    slices: list[np.ndarray]
    rates: np.ndarray
    prior: int
    prior_share: float

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.languages:
            return [UNDETERMINED] * n, np.zeros(n)
        gram, ends = grams(texts)
        slots = list(probes(gram, self.bits))
        counts = np.zeros((n, len(self.languages)))
        for s, table in enumerate(self.slices):
            mask = table[slots[0]]
            for slot in slots[1:]:
                mask &= table[slot]
            for b in range(min(8, len(self.languages) - 8 * s)):
                total = np.concatenate([[0], np.cumsum((mask >> b) & 1, dtype=np.int64)])
                counts[:, 8 * s + b] = total[ends[1:]] - total[ends[:-1]]
        asked = np.diff(ends)[:, None]
        true = np.maximum(0, (counts - asked * self.rates) / (1 - self.rates))
        whole = true.sum(axis=1)
        best = np.where(whole > 0, true.argmax(axis=1), self.prior)
        score = np.where(whole > 0, true.max(axis=1) / np.where(whole > 0, whole, 1), self.prior_share)
        names = [self.languages[i] for i in best]
        plain = pc.match_substring_regex(texts, "[A-Za-z]").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(~plain):
            if not any(map(str.isalpha, texts[i].as_py())):
                names[i], score[i] = UNDETERMINED, 0.0
        return names, score


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = FIT_DOCS_PER_LANGUAGE) -> Model:
    """Filters of the n-grams of each language, from about docs_per_language labelled documents of each.

    Rows with null text or language teach nothing. The sample is the documents whose hashed id falls under a share set
    by the language's document count. Counting and comparing run in Spark; what comes to the driver is a bitmask of languages
    for each n-gram of the bounded sample that tells languages apart (12 bytes), and the filters are as large as these ask for.
    """
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    named = labelled.select(F.col(lang_col).cast("string").alias("lang")).filter("lang is not null")  # counted without reading the texts
    counts = {r[0]: r[1] for r in named.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], 10, [], np.zeros(0), 0, 0.0)
    share = F.lit(0)
    for k, lang in enumerate(languages):
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 20, docs_per_language * (1 << 20) // counts[lang] + 1))).otherwise(share)
    index = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1
    sample = rows.filter(F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1 << 20)) < share).select(index.cast("int").alias("lang"), "text")

    def count(batches):
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for part in slices(batch, sizes, WORK_BYTES):
                of = part.column(0).to_numpy(zero_copy_only=False)
                gram, ends = grams(part.column(1))
                key = np.repeat(of.astype(np.int64), np.diff(ends)) << 32 | gram
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key >> 32, pa.int32()), pa.array(key & 0xFFFFFFFF, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    used = sample.mapInArrow(count, "lang int, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    used = written(used)
    # n-grams that some language has MIN_COUNT times, and each language's share of theirs
    some = used.join(used.filter(F.col("n") >= MIN_COUNT).select("gram").distinct(), "gram", "left_semi")
    totals = some.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = some.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    most = F.max("rate").over(Window.partitionBy("gram"))
    members = shares.withColumn("most", most).filter((F.col("rate") * RATIO >= F.col("most")) & (F.col("n") >= MIN_COUNT))
    word = F.floor(F.col("lang") / MASK_BITS).cast("int")
    masks = members.groupBy("gram", word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, pmod(lang, {MASK_BITS}))")).alias("mask")).toArrow()
    gram, word, mask = (masks[c].to_numpy().astype(kind) for c, kind in (("gram", np.uint32), ("word", np.int64), ("mask", np.int64)))
    own = lambda k: gram[(word == k // MASK_BITS) & ((mask >> k % MASK_BITS & 1) == 1)]
    most_grams = max((len(own(k)) for k in range(len(languages))), default=0)
    bits = max(10, int(np.ceil(np.log2(max(1, most_grams) * PROBES * 3))))
    tables = [np.zeros(1 << bits, np.uint8) for _ in range(-(-len(languages) // 8))]
    rates = np.zeros(len(languages))
    for k in range(len(languages)):
        for slot in probes(own(k), bits):
            tables[k // 8][slot] |= np.uint8(1 << k % 8)
        rates[k] = np.mean((tables[k // 8] >> (k % 8)) & 1) ** PROBES
    prior = max(range(len(languages)), key=lambda k: (counts[languages[k]], -k))
    return Model(languages, bits, tables, rates, prior, counts[languages[prior]] / sum(counts.values()))


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """For each row of docs: struct `row` of the carried columns (all if None), lang_pred and score (0 to 1).

    score is the share of the n-grams, corrected for false positives, that speak for the winner; ties go to the first
    language in order. Null texts and texts without a letter are `und` with score 0; a text with letters but no known
    n-gram gets the most frequent language with its share of the documents. Texts of any length count whole; repeated
    rows get the same answer; an empty table gives an empty result, and a model fitted on one calls everything `und`;
    carried columns of any name stay apart in the struct. A narrow map: no shuffle; the filters (as large as the
    bounded sample's n-grams ask for) are broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(texts: pa.Array) -> list:
            names, score = held.value.predict(texts)
            return [names, score]

        return work

    return map_texts(docs, text_col, make, "lang_pred string, score double", carry, WORK_BYTES)
