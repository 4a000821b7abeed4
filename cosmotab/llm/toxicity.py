"""Toxicity by compression distance: words that a zstandard dictionary of toxic text makes shorter than one of ordinary text does."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cosmotab.llm.common import map_texts, written

#: Bound of the fit: about so many labelled documents of each class are read for it, by hashed id ...
FIT_DOCS = 3000
#: ... and of a text with more distinct words than this about so many, by hash; scoring reads them all.
FIT_WORDS = 20_000
#: Bytes of the dictionaries.
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 2_048
#: Fewest bytes of a word's beginning that may stand in the toxic dictionary, the space before it included.
SHORTEST = 6
#: A string is telling if its share of toxic documents is so many times that of others, and if its counts are so unlikely by
#: chance (signed root of the likelihood ratio statistic, as a number of standard errors).
ODDS, SURE = 5.0, 4.5
#: Of the windows at or under a threshold, so many times more must come from toxic documents than from others.
WINDOW_ODDS = 6.0
#: With the thorough match search of this level a match is found wherever there is one.
LEVEL = 12
#: Words that a worker remembers with what they say.
CACHE_WORDS = 400_000

#: zstandard stores very short inputs as they are and matches nothing in their last bytes: a window is compressed after a
#: lead that both dictionaries end with, and before a tail that neither has, so that lengths show what its own bytes cost.
_LEAD = b"0123456789abcdefghijklmnop"
_TAIL = b"QRSTUVWXYZ"
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def window(word: str) -> bytes:
    """A word between spaces: what is compressed."""
    return f" {word} ".encode()


def strings(word: str) -> list[bytes]:
    """What of a word may stand in a dictionary: its window, and its beginnings of SHORTEST bytes or more."""
    w = window(word)
    return [w, *[w[:k] for k in range(SHORTEST, len(w) - 1)]]


@dataclass
class Model:
    """Both dictionaries' contents; thresholds and evidence of windows; the last calibration.

    thresholds[a] is the largest length with the toxic dictionary at which a window of ordinary length a is a hit;
    evidence[a, b] the log odds of such a window; weights those of a logistic regression on (1, total log odds, strongest
    window's, log of the number of words, thousands of words).
    """

    ordinary: bytes
    toxic: bytes
    thresholds: dict[int, int] = field(default_factory=dict)
    evidence: dict[tuple[int, int], float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0.0, 0.0, 0.0, 0.0]))


class Scorer:
    """Compresses windows with both dictionaries: they differ only in what stands before the ordinary text, toxic strings or filler."""

    def __init__(self, model: Model):
        self.model = model
        shape = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=4, write_content_size=0, write_dict_id=0, write_checksum=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        both = (b"#" * len(model.toxic) + model.ordinary + _LEAD, model.toxic + model.ordinary + _LEAD)
        held = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in both]
        self.ordinary, self.toxic = (zstandard.ZstdCompressor(dict_data=d, compression_params=shape).compress for d in held)
        self.said: dict[str, float] = {}

    def lengths(self, window: bytes) -> tuple[int, int]:
        """Compressed lengths of a window with the ordinary and the toxic dictionary."""
        whole = _LEAD + window + _TAIL
        return len(self.ordinary(whole)), len(self.toxic(whole))

    def evidence(self, word: str) -> float:
        """The log odds of a word's window if it is a hit, else -1."""
        if (found := self.said.get(word)) is None:
            a, b = self.lengths(window(word))
            found = self.model.evidence.get((a, b), 0.0) if b <= self.model.thresholds.get(a, -1) else -1.0
            if len(self.said) > CACHE_WORDS:
                self.said.clear()
            self.said[word] = found
        return found

    def features(self, text: str) -> tuple[float, float, float, float, int]:
        """Total log odds of a whole text's distinct hits, the strongest one's, log and thousands of its words; the number of hits."""
        words = words_of(text)
        hits = sorted(e for e in map(self.evidence, set(words)) if e >= 0)
        return float(sum(hits)), max(hits, default=0.0), float(np.log1p(len(words))), len(words) / 1000, len(hits)

    def score(self, text: str) -> tuple[float, int]:
        *x, hits = self.features(text)
        return float(probability(np.array([1.0, *x]), self.model.weights)), hits


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the first column is the constant and isn't shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = probability(x, w)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + shrink
        w = w + np.linalg.solve(curve, x.T @ (weight * (y - p)) - shrink @ w)
    return w


def calibrated(toxic: Counter, ordinary: Counter) -> tuple[dict[int, int], dict[tuple[int, int], float]]:
    """(thresholds, evidence): for each ordinary length the largest toxic length, below it, whose windows speak WINDOW_ODDS to
    one for toxic text, and the log odds of all lengths up to there, 0 at least."""
    n, m = max(1, sum(toxic.values())), max(1, sum(ordinary.values()))
    cells = [(a, b) for a, b in toxic.keys() | ordinary.keys() if b < a]
    odds = {c: float(np.log((toxic[c] + 0.5) / (n + 1)) - np.log((ordinary[c] + 0.5) / (m + 1))) for c in cells}
    thresholds: dict[int, int] = {}
    for (a, b), e in odds.items():
        if e >= np.log(WINDOW_ODDS) and toxic[a, b] >= 3:
            thresholds[a] = max(thresholds.get(a, 0), b)
    return thresholds, {(a, b): max(0.0, e) for (a, b), e in odds.items() if b <= thresholds.get(a, -1)}


def filled(telling: list[bytes], common: list[bytes]) -> Model:
    """Dictionaries of the telling strings and of the common windows, best ones last, where matches cost least; of strings
    that hold each other the first stands for all, and no common window holds a telling string."""
    toxic: list[bytes] = []
    size = 0
    for s in telling:
        if size + len(s) <= TOXIC_BYTES and not any(s in t or t in s for t in toxic):
            toxic.append(s)
            size += len(s)
    ordinary: list[bytes] = []
    size = 1
    for w in common:
        if size + len(w) - 1 > ORDINARY_BYTES:
            break
        if not any(t in w for t in toxic):
            ordinary.append(w[:-1])
            size += len(w) - 1
    return Model(b"".join(reversed(ordinary)) + b" ", b"".join(reversed(toxic)))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_docs: int) -> tuple[DataFrame, dict[int, float]]:
    """toxic, half and text of the sampled documents, and each class's labelled documents for one in the sample. The
    sampled labels, bounded by fit_docs, are broadcast: documents aren't shuffled."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id is not null and toxic is not null")
    marks = marks.groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}
    cut = {t: int(min(1.0, fit_docs / n) * (1 << 20)) for t, n in sizes.items()}
    marks = marks.filter(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20)) <= F.when(F.col("toxic") == 1, cut.get(1, 0)).otherwise(cut.get(0, 0)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > 0).join(F.broadcast(marks), "id")

    def make():
        def least(text: str) -> int:
            words = words_of(text)
            return min((xxhash.xxh64_intdigest(" ".join(p)) >> 1 for p in zip(words, words[1:], strict=False)), default=0)

        return lambda found: [[xxhash.xxh3_64_intdigest(t) >> 1 for t in found.to_pylist()], [least(t) % 2 for t in found.to_pylist()]]

    marked = map_texts(texts, "text", make, "hash bigint, half int", ["toxic", "text"]).select("row.toxic", "row.text", "hash", "half")
    sample = written(marked.dropDuplicates(["toxic", "hash"]).drop("hash").repartition(24))
    taken = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    return sample, {t: sizes[t] / n for t, n in taken.items()}


def taught(text: str) -> list[str]:
    """The distinct words of a text that the fit reads."""
    words = sorted(set(words_of(text)))
    if len(words) <= FIT_WORDS:
        return words
    most = FIT_WORDS * (1 << 64) // len(words)
    return [w for w in words if xxhash.xxh64_intdigest(w) < most]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_docs: int = FIT_DOCS) -> Model:
    """A model from about fit_docs labelled documents of each class, chosen by hashed id.

    Labels or texts that are null and empty texts teach nothing; a document with several labels is toxic if one says so;
    equal texts of a class count once. No other labelled row is left out; of a text with more than FIT_WORDS distinct words
    a part is read.

    Strings are counted by documents: the windows of words, and beginnings of words. The toxic dictionary is filled with
    those that toxic documents hold ODDS times as often as others, as SURE tells from chance, the ordinary one with the most
    common windows of other documents. Thresholds and the last calibration are cross-fitted: each half of the sample is
    compressed with the dictionaries of the other half; documents that share their least pair of words, as near copies do,
    are in one half. Counting and compressing run in tasks; the driver gets strings that fill the dictionaries, counts of
    lengths, and four numbers for each document of the bounded sample.
    """
    spark = docs.sparkSession
    sample, each = _sample(docs, labels, id_col, text_col, label_col, fit_docs)
    if not each.get(1) or not each.get(0):
        return Model(b" ", b"")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for toxic, half, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found.update((s, half, toxic) for s in {s for w in taught(text) for s in strings(w)})
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.int32()))] + [pa.array(list(found.values()), pa.int64())], names=["s", "half", "toxic", "n"])

    held = sample.select("toxic", "half", "text").mapInArrow(counts, "s binary, half int, toxic int, n bigint")
    in_half = lambda h, toxic: F.sum(F.when((F.col("half") == h) & (F.col("toxic") == toxic), F.col("n")).otherwise(0)).alias(f"{'ot'[toxic]}{h}")
    table = written(held.groupBy("s").agg(*[in_half(h, t) for h in (0, 1) for t in (0, 1)]).filter(F.col("t0") + F.col("t1") + F.col("o0") + F.col("o1") >= 3))
    sizes = Counter()
    for half, toxic, n in sample.groupBy("half", "toxic").count().collect():
        sizes[half, toxic] = n

    def dictionaries(halves: tuple[int, ...]) -> Model:
        t, o = (sum((F.col(f"{k}{h}") for h in halves), F.lit(0)) for k in "to")
        nt, no = (sum(sizes[h, k] for h in halves) for k in (1, 0))
        log_odds = F.log((t + 0.5) / (nt + 1)) - F.log((o + 0.5) / (no + 1))
        part = lambda k, share: F.when(k > 0, k * F.log(k / ((t + o) * share))).otherwise(0.0)
        ratio = 2 * (part(t, nt / (nt + no)) + part(o, no / (nt + no)))
        told = table.filter((t > 0) & (log_odds >= float(np.log(ODDS))) & (ratio >= SURE * SURE))
        telling = told.orderBy(F.desc(t * log_odds), "s").select("s").limit(TOXIC_BYTES).collect()
        common = table.filter((o >= 3) & (F.substring("s", -1, 1) == F.lit(b" "))).orderBy(F.desc(o), "s").select("s").limit(ORDINARY_BYTES // 4).collect()
        return filled([bytes(r[0]) for r in telling], [bytes(r[0]) for r in common])

    halves = [dictionaries((0,)), dictionaries((1,))]
    model = dictionaries((0, 1))

    def lengths(given) -> DataFrame:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorers = [Scorer(m) for m in given.value]
            for batch in batches:
                found: Counter = Counter()
                for toxic, half, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    found.update((toxic, *scorers[1 - half].lengths(window(w))) for w in taught(text))
                yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], pa.int32()) for i in range(3)] + [pa.array(list(found.values()), pa.int64())], names=["toxic", "a", "b", "n"])

        return sample.select("toxic", "half", "text").mapInArrow(rows, "toxic int, a int, b int, n bigint").groupBy("toxic", "a", "b").agg(F.sum("n"))

    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for toxic, a, b, n in lengths(spark.sparkContext.broadcast(halves)).collect():
        seen[toxic][a, b] = n
    model.thresholds, model.evidence = calibrated(seen[1], seen[0])
    for m in halves:
        m.thresholds, m.evidence = model.thresholds, model.evidence
    given = spark.sparkContext.broadcast(halves)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(m) for m in given.value]
        for batch in batches:
            rows = [(toxic, *scorers[1 - half].features(text)[:4]) for toxic, half, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.float64()) for i in range(5)], names=["y", "total", "top", "size", "words"])

    told = sample.select("toxic", "half", "text").mapInArrow(features, "y double, total double, top double, size double, words double").toPandas().to_numpy()
    told = told[np.lexsort(told.T)]  # one order of adding up, whatever the tasks' order
    y = told[:, 0]
    model.weights = regression(np.column_stack([np.ones(len(y)), told[:, 1:]]), y, np.where(y > 0, each[1], each[0]))
    return model


def score(docs: DataFrame, model: Model, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """For each row of docs: struct `row` of the carried columns (all if None), then score (0 to 1) and hits.

    Every distinct word of the whole text, of any length, is compressed with both dictionaries and its lengths held against
    the threshold; the score is a logistic regression on the hits' log odds and the number of words. Null, empty and
    letterless texts have no window and get the score of an empty text; without toxic labels nothing is ever a hit.
    Repeated rows get equal scores, as do texts with the same words (ties); an empty table gives an empty result; the
    struct keeps carried columns of any name apart. A narrow map: no shuffle; the model (some 40 KB) is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(held.value)

        def work(texts: pa.Array) -> list:
            return [list(x) for x in zip(*map(scorer.score, texts.to_pylist()), strict=True)]

        return work

    return map_texts(docs, text_col, make, "score double, hits bigint", carry)
