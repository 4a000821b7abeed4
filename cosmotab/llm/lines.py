"""Line dedup: winnowing over line hashes finds every long repeated run of lines; later copies of a run are deleted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cosmotab.llm.common import map_texts, written

#: A repeated run counts from so many words on.
MIN_WORDS = 50
_POSTING = "struct<fp: bigint, own: int, ord: int, lines: array<struct<h: bigint, n: int, at: int>>>"


def line_arrays(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, word count and hash of each line with words."""
    at, size, digest = [], [], []
    for i, line in enumerate(text.split("\n")):
        words = line.split()
        if words:
            at.append(i)
            size.append(len(words))
            digest.append(xxhash.xxh64_intdigest(" ".join(words)))
    return np.array(at, np.int64), np.array(size, np.int64), np.array(digest, np.uint64)


def spans_of(size: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of all windows: from each line forwards, and from each one backwards, just until the window
    holds min_words words. A run of min_words words or more holds the window forwards from its first line and the one
    backwards from its last."""
    n = len(size)
    ends = np.concatenate([[0], np.cumsum(size)])
    last = np.searchsorted(ends, ends[:-1] + min_words) - 1
    first = np.searchsorted(ends, ends[1:] - min_words, side="right") - 1
    i, j = np.concatenate([np.arange(n), first]), np.concatenate([last, np.arange(n)])
    whole = (i >= 0) & (j < n)
    both = np.unique(i[whole] * n + j[whole])
    return both // max(n, 1), both % max(n, 1)


def fingerprints(size: np.ndarray, digest: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """(line, first, last) for each line that is some window's minimum: all its windows lie within first and last.

    The minimum is the line with the most words, the lowest hash among those, the last one of equal lines: equal windows
    have it in the same place, so a repeated run shows at least one fingerprint in each of its copies.
    """
    i, j = spans_of(size, min_words)
    if not len(i):
        return []
    order = np.empty(len(size), np.int64)
    by = np.lexsort((-np.arange(len(size)), digest, -size))
    order[by] = np.arange(len(size))
    low, width = order[i], int((j - i).max())
    for step in range(1, width + 1):
        low = np.minimum(low, order[np.minimum(i + step, j)])
    at = by[low]
    line, where = np.unique(at, return_inverse=True)
    first, last = np.full(len(line), len(size)), np.zeros(len(line), np.int64)
    np.minimum.at(first, where, i)
    np.maximum.at(last, where, j)
    return list(zip(line.tolist(), first.tolist(), last.tolist(), strict=True))


def extended(digest: np.ndarray, size: np.ndarray, own: int, min_words: int) -> list[tuple[int, int, int]]:
    """(hash, first, last) of the shortest matches around line `own` of a posting's lines.

    The match is extended line by line: for each reach to the left, to the right just until it holds min_words words;
    and for each reach to the right, to the left. Two places share such a match if and only if their lines are equal
    there, so whatever repeated run a place lies in, it shares one with the run's first place.
    """
    out = []
    i, j = spans_of(size, min_words)
    raw = digest.tobytes()
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if a <= own <= b:
            out.append((xxhash.xxh64_intdigest(raw[8 * a : 8 * b + 8], seed=own - a), a, b))
    return out


def _postings(texts: pa.Array, min_words: int) -> pa.Array:
    """A list of postings for each text: fingerprint, its line's place among `lines`, the ordinal of the first of these."""
    counts, fp, own, first, sizes, h, n, at = [], [], [], [], [], [], [], []
    for text in texts.to_pylist():
        places, size, digest = line_arrays(text)
        found = fingerprints(size, digest, min_words) if size.sum() >= min_words else []
        counts.append(len(found))
        for line, i, j in found:
            fp.append(digest[line])
            own.append(line - i)
            first.append(i)
            sizes.append(j - i + 1)
            h.append(digest[i : j + 1])
            n.append(size[i : j + 1])
            at.append(places[i : j + 1])
    flat = lambda parts, kind: np.concatenate(parts).astype(kind, copy=False) if parts else np.zeros(0, kind)
    lines = pa.StructArray.from_arrays([flat(h, np.uint64).view(np.int64), flat(n, np.int32), flat(at, np.int32)], names=["h", "n", "at"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), lines)
    rows = pa.StructArray.from_arrays([pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(own, pa.int32()), pa.array(first, pa.int32()), lists], names=["fp", "own", "ord", "lines"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), rows)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """For each row of docs: struct `row` of all its columns, then new_text, n_lines, n_removed and removed.

    A line goes if it lies in a run of consecutive lines (those without words aside) of min_words words or more in all
    that stands earlier too: in a document of a smaller id, or further up in its own. Lines are equal if their words are.
    Wordless lines between two deleted ones that follow each other go with them.
    removed lists the deleted stretches of lines (from 0, end inclusive). Null ids come before all others; rows with the
    same id and text are one document and get the same result (ties); rows of one id with different texts are told apart.
    A null text stays null; texts with fewer than min_words words, and empty ones, stay as they are; texts of any length
    are searched whole. An empty table gives an empty result; columns of docs keep any name, inside the struct.

    Winnowing: of each text only the minima of its windows of lines are kept, as postings of a fingerprint with the lines
    around it (two windows at most, each of min_words lines at most). Positions of equal fingerprints are joined; those
    whose fingerprint stands in one place only, most of a corpus, end here. A joined position's match is extended line
    by line both ways, and each extension meets the earliest place that shares it: by an aggregation that is partial on
    the map side, never in pairs, so a passage that a third of all documents share makes as many rows as it has places.
    The texts are shuffled once, to meet the list of their deleted stretches.
    """

    def make():
        return lambda texts: [_postings(texts, min_words)]

    keyed = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    made = map_texts(keyed, "text", make, f"postings array<{_POSTING}>", ["doc", "h"], budget=2 << 20)
    lists = written(made.filter(F.size("postings") > 0).select("row.doc", "row.h", "postings"))
    places = lists.select("doc", "h", F.explode("postings").alias("p")).select("p.fp", "doc", "h", (F.col("p.ord") + F.col("p.own")).alias("at"))
    here = F.struct("doc", "h", "at")
    repeated = places.groupBy("fp").agg(F.min(here).alias("first"), F.max(here).alias("final")).filter("first < final").select("fp")
    joined = lists.select("doc", "h", F.explode("postings").alias("p")).select("doc", "h", "p.*").join(repeated, "fp")

    doc_type = keyed.schema["doc"].dataType.simpleString()

    def extend(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, first = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            lines = batch.column(5)
            cuts = lines.offsets.to_numpy()
            h, n, at = (x.to_numpy() for x in lines.values.flatten())
            of, out = [], []
            for r in range(batch.num_rows):
                a, b = cuts[r], cuts[r + 1]
                for match, i, j in extended(h[a:b], n[a:b].astype(np.int64), int(own[r]), min_words):
                    of.append(r)
                    out.append((match - (1 << 63), first[r] + i, first[r] + j, at[a + i], at[a + j]))
            rows = batch.select(["fp", "doc", "h"]).take(pa.array(of, pa.int64()))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            more = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *more], names=["fp", "doc", "h", "match", "a", "b", "i", "j"])

    matches = written(joined.select("fp", "doc", "h", "own", "ord", "lines").mapInArrow(extend, f"fp bigint, doc {doc_type}, h bigint, match bigint, a int, b int, i int, j int"))
    here = F.struct("doc", "h", "a")
    first = matches.groupBy("fp", "match").agg(F.min(here).alias("first"), F.max(here).alias("final")).filter("first < final").select("fp", "match", "first")
    later = matches.join(first, ["fp", "match"]).filter(here > F.col("first")).select("doc", "h", "a", "b", "i", "j")
    cuts = F.array_sort(F.collect_set(F.struct("a", "b", "i", "j")))
    per_doc = later.groupBy("doc", "h").agg(cuts.alias("cuts")).mapInArrow(_runs, f"d {doc_type}, g bigint, cuts array<struct<i: int, j: int>>")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    rows = rows.join(per_doc, F.col("doc").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    lines = F.split("text", "\n")
    # one flag for each line: kept up to each cut, not in it, kept after the last one
    after = F.concat(F.transform("cuts", lambda c: c["i"]), F.array(F.size(lines)))
    gone = F.aggregate("cuts", F.lit(0), lambda n, c: n + c["j"] - c["i"] + 1)
    head = F.array_repeat(F.lit(True), F.try_element_at(after, F.lit(1)))
    each = lambda c, b: F.concat(F.array_repeat(F.lit(False), c["j"] - c["i"] + 1), F.array_repeat(F.lit(True), b - c["j"] - 1))
    mask = F.concat(head, F.flatten(F.zip_with("cuts", F.slice(after, F.lit(2), F.size("cuts")), each)))
    kept = F.array_compact(F.zip_with(lines, mask, lambda line, stays: F.when(stays, line)))
    return rows.select(
        "row",
        F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("new_text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"),
        F.when(F.col("cuts").isNull(), 0).otherwise(gone).cast("bigint").alias("n_removed"),
        F.coalesce("cuts", F.array().cast("array<struct<i: int, j: int>>")).alias("removed"),
    )


def _runs(batches):
    """The deleted stretches of each document: matches that touch or overlap, as ordinals of lines with words, are one."""
    for batch in batches:
        made = []
        for cuts in batch.column(2).to_pylist():
            runs: list[dict] = []
            end = -2
            for c in cuts:
                if c["a"] <= end + 1:
                    runs[-1]["j"] = max(runs[-1]["j"], c["j"])
                    end = max(end, c["b"])
                else:
                    runs.append({"i": c["i"], "j": c["j"]})
                    end = c["b"]
            made.append(runs)
        kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, kind)], names=["d", "g", "cuts"])
