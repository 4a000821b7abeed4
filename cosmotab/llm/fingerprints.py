"""Document fingerprints by consistent weighted sampling: two agree in a lane with the probability of their generalised Jaccard similarity.

A text's terms are its words, weighted by their counts. For a term, a lane's two gamma(2, 1) numbers r and c and a uniform
one b are functions of the term alone; with weight w the term's level is t = floor(ln w / r + b), and the lane samples the
term with the least ln c - r (t - b + 1). The lane holds a hash of the sampled term and level. (The public method of
improved consistent weighted sampling.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cosmotab.llm.common import map_texts, mix64, slices

LANES = 128
#: Hex digits of a lane: two different samples share them with probability 1 / 4095.
DIGITS = 3
#: Longer runs without white space are taken apart into overlapping stretches of SHINGLE code points.
LONGEST_WORD, SHINGLE = 32, 6
#: Terms whose lanes are worked out at once (their arrays stay in the processor's cache), most whose lanes are held at a time
#: (1 KB each; a batch with more goes through them in portions, so each is worked out once), and words that a worker
#: remembers with their hashes.
BLOCK, MOST_HELD, CACHE_WORDS = 128, 1 << 15, 400_000
BEFORE_ALL = -(1 << 63)

_seeds = mix64(np.arange(1, 2 * LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def terms(text: str) -> list[str]:
    """Words between Unicode white space; the stretches of very long ones."""
    words = text.split()
    if max(map(len, words), default=0) <= LONGEST_WORD:
        return words
    out = []
    for w in words:
        out += [w] if len(w) <= LONGEST_WORD else [w[i : i + SHINGLE] for i in range(len(w) - SHINGLE + 1)]
    return out


def samples(term: np.ndarray, weight: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """[terms, lanes]: what each term (hash and weight) has in the lane, the least of a text's is sampled, and 32 bits that
    name the term and its level."""
    x = term[:, None]
    one, two = mix64(x ^ _seeds[:lanes]), mix64(x ^ _seeds[LANES : LANES + lanes])
    halves = [one.astype(np.uint32), (one >> np.uint64(32)).astype(np.uint32), two.astype(np.uint32), (two >> np.uint64(32)).astype(np.uint32)]
    u = [((h >> np.uint32(9)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-23) for h in halves]  # exact, inside 0 and 1
    r, c = -np.log(u[0] * u[1]), -np.log(u[2] * u[3])
    low = (halves[0] & np.uint32(511)) << np.uint32(9) | (halves[1] & np.uint32(511))
    b = (low.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-18)
    level = np.floor(np.log(weight.astype(np.float32))[:, None] / r + b)
    name = halves[3] ^ level.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
    name = (name ^ (name >> np.uint32(16))) * np.uint32(0x85EBCA6B) ^ halves[2]
    return np.log(c) - r * (level - b + np.float32(1)), name ^ (name >> np.uint32(15))


def sampled(term: np.ndarray, weight: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """samples() as one unsigned 64-bit number each, in the same order, with the name in the lower half."""
    value, name = samples(term, weight, lanes)
    bits = value.view(np.int32)
    rank = (bits ^ (bits >> 31 | np.int32(-(1 << 31)))).view(np.uint32)  # the order of the floats
    return rank.astype(np.uint64) << np.uint64(32) | name


class Sampler:
    """Lanes of texts; remembers the hashes of words."""

    def __init__(self, lanes: int = LANES):
        if not 0 < lanes <= LANES:
            raise ValueError(f"1 to {LANES} lanes")
        self.lanes = lanes
        self.hashes: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        """[texts, lanes] of numbers from 1 to 16 ^ DIGITS - 1; zeros for a text without terms."""
        if len(self.hashes) > CACHE_WORDS:
            self.hashes.clear()
        lists = [terms(t) for t in texts]
        words = list(chain.from_iterable(lists))
        for w in set(words) - self.hashes.keys():
            self.hashes[w] = xxhash.xxh3_64_intdigest(w) >> 1
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        of = np.fromiter(map(self.hashes.__getitem__, words), np.int64, len(words))
        doc = np.repeat(np.arange(len(lists)), count)
        out = np.zeros((len(lists), self.lanes), np.int64)
        if not len(of):
            return out
        own, of = np.unique(of, return_inverse=True)
        key, weight = np.unique(doc * len(own) + of, return_counts=True)  # a document's distinct terms, in its order
        doc, of = key // len(own), key % len(own)
        held, row = np.unique(of * (int(weight.max()) + 1) + weight, return_inverse=True)  # each term and weight once
        term, times = own[held // (int(weight.max()) + 1)].astype(np.uint64), held % (int(weight.max()) + 1)
        best = np.full((len(lists), self.lanes), np.iinfo(np.uint64).max)
        for low in range(0, len(held), MOST_HELD):
            high = min(low + MOST_HELD, len(held))
            table = np.concatenate([sampled(term[i : min(i + BLOCK, high)], times[i : min(i + BLOCK, high)], self.lanes) for i in range(low, high, BLOCK)])
            here = slice(None) if high - low == len(held) else np.flatnonzero((row >= low) & (row < high))
            docs, rows = doc[here], row[here] - low
            for i in range(0, len(rows), 4 * BLOCK):
                d, r = docs[i : i + 4 * BLOCK], rows[i : i + 4 * BLOCK]
                first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                best[d[first]] = np.minimum(best[d[first]], np.minimum.reduceat(table[r], first, axis=0))
        some = count > 0
        out[some] = (best[some] & np.uint64(0xFFFFFFFF)).astype(np.int64) % (16**DIGITS - 1) + 1
        return out


def as_text(lanes: np.ndarray) -> list[str]:
    return ["".join([f"{x:0{DIGITS}x}" for x in row]) for row in lanes.tolist()]


def likeness(a: Column, b: Column) -> Column:
    """Share of equal lanes of two fingerprints of one length: an estimate of the texts' generalised Jaccard similarity,
    within 2 sqrt(s (1 - s) / lanes) of it in 95 of 100 cases. Texts without terms are alike, and unlike all others."""
    lanes = (F.length(a) / DIGITS).cast("int")
    equal = F.filter(F.sequence(F.lit(0), lanes - 1), lambda i: F.substring(a, i * DIGITS + 1, F.lit(DIGITS)) == F.substring(b, i * DIGITS + 1, F.lit(DIGITS)))
    return F.size(equal) / lanes


def fingerprint(docs: DataFrame, *, text_col: str = "text", carry: list[str] | None = None, lanes: int = LANES, budget: int = 1 << 20) -> DataFrame:
    """For each row of docs: struct `row` of the carried columns and its text's fingerprint, a string of hex lanes.

    Equal texts have equal fingerprints, on any machine and in any batch; a null, empty or blank text has only zeros. Whole
    texts of any length; repeated rows one by one; an empty table gives an empty result; carried columns of any name stay
    apart. A narrow map: no shuffle.
    """

    def make():
        sampler = Sampler(lanes)
        return lambda texts: [as_text(sampler(texts.to_pylist()))]

    return map_texts(docs, text_col, make, "fingerprint string", carry, budget)


def next_in_order(docs: DataFrame, id_col: str, parts: int | None = None) -> tuple[DataFrame, int]:
    """(rows, parts): docs dealt into ranges of their integer id, with `_part`, `_ahead` (false) and `_order`, and behind
    the rows of each range a copy of the first row of the next one (`_ahead` true), after the last range of the first.

    So each row's next one in ascending order of id stands in its own range: one shuffle, no join. Null ids come first.
    The ranges are quantiles of the ids (Spark's sketch); their first ids are a minimum each, so at most `parts` numbers
    (spark.sql.shuffle.partitions) reach the driver. A part is read as a sorted stream, so its size is bounded by disk.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce(F.col(id_col).cast("bigint"), F.lit(BEFORE_ALL))
    ids = docs.select(order.alias("o"))
    cuts = ids.agg(F.percentile_approx("o", [k / parts for k in range(1, parts)] or [0.5], max(10_000, 100 * parts)).alias("q")).first()["q"] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def part_of(o):
        import pandas as pd

        return pd.Series(np.searchsorted(cuts, o.to_numpy(np.int64), side="right").astype(np.int32))

    found = ids.groupBy(part_of("o").alias("p")).agg(F.min("o").alias("first")).collect()
    firsts = sorted((r["p"], r["first"]) for r in found)
    before = {p: firsts[k - 1][0] for k, (p, _) in enumerate(firsts)}
    begins = dict(firsts)

    @F.pandas_udf("array<int>")
    def places(o):
        """A row's part, and for the first rows of a part the one before, too."""
        import pandas as pd

        x = o.to_numpy(np.int64)
        p = np.searchsorted(cuts, x, side="right").tolist()
        return pd.Series([[k, before[k]] if v == begins[k] else [k] for k, v in zip(p, x.tolist(), strict=True)], dtype=object)

    rows = docs.withColumn("_order", order)
    rows = rows.select("*", F.posexplode(places("_order")).alias("_copy", "_part")).withColumn("_ahead", F.col("_copy") == 1).drop("_copy")
    return rows.repartitionById(parts, F.col("_part")), parts


def compare_with_next(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", lanes: int = LANES, budget: int = 1 << 20, parts: int | None = None) -> DataFrame:
    """id, n_chars, edited_text_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document.

    The edited text has the last quarter of the text's code points (rounded down) replaced by as many of the beginning of
    the next document's text, or by all of it; the next one is that in ascending order of id, and after the last the
    first, so a single document is its own next one. Rows of one id follow each other in order of their texts' hashes,
    null ids come first. A null or empty text is empty. near_* are likenesses, see likeness(). Whole texts of any length;
    an empty table gives an empty result; columns of other names don't matter.

    One shuffle of the texts into ranges of the id; a part streams through its task, which holds one batch and one text.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows, _ = next_in_order(source, "id", parts)
    rows = rows.sortWithinPartitions("_part", "_ahead", "_order", F.xxhash64("text")).select("id", "text", "_part", "_ahead")
    out = T.StructType(
        [source.schema["id"], *T._parse_datatype_string("n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").fields]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out)
        sampler = Sampler(lanes)
        held: list[tuple] = []  # the last row, whose next one is still to come: id, part, ahead, text
        lanes_held = np.zeros((0, lanes), np.int64)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for part in slices(batch, sizes, budget):
                ids, texts, parts_, ahead = (part.column(k).to_pylist() for k in range(4))
                rows = held + list(zip(ids, parts_, ahead, texts, strict=True))
                pairs = [k for k in range(len(rows) - 1) if not rows[k][2]]
                edited = []
                for k in pairs:
                    text, following = rows[k][3], rows[k + 1][3]
                    q = len(text) // 4
                    edited.append(text[: len(text) - q] + following[:q])
                both = sampler(texts + edited)  # at once, as they share most terms
                own, after = np.concatenate([lanes_held, both[: len(texts)]]), both[len(texts) :]
                at = np.array(pairs, np.int64)
                made = [
                    [rows[k][0] for k in pairs], [len(rows[k][3]) for k in pairs], [hashlib.sha256(t.encode()).hexdigest() for t in edited], as_text(own[at]), as_text(after),
                    (own[at] == after).mean(axis=1), (own[at] == own[at + 1]).mean(axis=1),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, kinds, strict=True)], names=kinds.names)
                held, lanes_held = rows[-1:], own[-1:]
        if held and not held[0][2]:
            raise ValueError("a part lacks the row that follows it")

    return rows.mapInArrow(run, out)
