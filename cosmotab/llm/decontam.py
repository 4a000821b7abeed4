"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark items, one scan of each text."""

from __future__ import annotations

import re
from bisect import bisect_right

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cosmotab.llm.common import map_texts, written

WINDOW = 13
#: Benchmark text per automaton; a larger benchmark is scanned for in several blocks, a pass over the documents for each.
BLOCK_BYTES = 2 << 20
RUNS = "array<struct<a: int, b: int, start: int, end: int>>"
SPANS = "array<struct<start: int, end: int>>"

#: A-Z become a-z; ASCII other than letters and digits separates words; all other bytes are parts of words.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: str) -> list[bytes]:
    return text.encode().translate(_NORMAL).split()


class Matcher:
    """Finds the runs of words that a text shares with benchmark items.

    Patterns are the aligned blocks of (window + 1) // 2 words of each item: every window of an item holds one, so the
    trie stays as large as the items' text instead of `window` times that. A match is extended both ways along its item;
    an extended run of `window` words or more is a hit. A shorter item is one pattern as a whole.
    """

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.step = window, (window + 1) // 2
        self.ids: list[str] = []
        self.words: list[list[str]] = []
        self.trie = ahocorasick.Automaton()
        starts: dict[str, list[tuple[int, int, int]]] = {}
        for item_id, text in items:
            words = [w.decode() for w in normal_words(text)]
            if not words:
                continue
            n = len(self.ids)
            self.ids.append(item_id)
            self.words.append(words)
            size = self.step if len(words) >= window else len(words)
            for p in range(0, len(words) - size + 1, size):
                starts.setdefault(f" {' '.join(words[p : p + size])} ", []).append((n, p, size))
        for pattern, found in starts.items():
            self.trie.add_word(pattern, (len(pattern), found))
        if starts:
            self.trie.make_automaton()

    def runs(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges (end exclusive) inside occurrences of windows, and the items that the windows come from."""
        if not words or not self.ids:
            return [], set()
        text = f" {b' '.join(words).decode()} "
        matches = list(self.trie.iter(text))
        if not matches:
            return [], set()
        own = [w.decode() for w in words]  # not text.split(), which also breaks at white space beyond ASCII
        at = [1]  # where each word starts in the normalised text
        for w in own:
            at.append(at[-1] + len(w) + 1)
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        covered: dict[tuple[int, int], int] = {}  # item and diagonal: the words up to here were compared
        for end, (length, starts) in matches:
            j = bisect_right(at, end - length + 2) - 1
            for n, p, size in starts:
                item = self.words[n]
                if covered.get((n, j - p), -1) > j:
                    continue
                a, b = j, j + size
                if len(item) >= self.window:
                    while a > 0 and p - (j - a) > 0 and own[a - 1] == item[p - (j - a) - 1]:
                        a -= 1
                    while b < len(own) and p + (b - j) < len(item) and own[b] == item[p + (b - j)]:
                        b += 1
                    covered[n, j - p] = b
                    if b - a < self.window:
                        continue
                found.append((a, b))
                items.add(self.ids[n])
        return found, items


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def benchmark_items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item and text of the benchmark's rows with a text; a null id is the text `null`."""
    return benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("string").alias("text")).filter("text is not null")


def held(items: DataFrame) -> list[tuple[str, str]]:
    return [(r[0], r[1]) for r in items.select("item", "text").toLocalIterator()]


def block_hits(keyed: DataFrame, block: list[tuple[str, str]], window: int) -> DataFrame:
    """key, runs, items of the rows of keyed (key, text) that share words with the block, written as a table.

    The block is broadcast for this pass alone; one row a key, however many rows have the text.
    """
    sent = keyed.sparkSession.sparkContext.broadcast(block)

    def make():
        matcher = Matcher(sent.value, window)

        def work(texts: pa.Array) -> list:
            runs, items = [], []
            for text in texts.to_pylist():
                found, ids = matcher.runs(normal_words(text))
                found = _merged(found)
                words = [m.span() for m in _WORD.finditer(text)] if found else []
                runs.append([{"a": a, "b": b, "start": words[a][0], "end": words[b - 1][1]} for a, b in found])
                items.append(sorted(ids))
            return [runs, items]

        return work

    try:
        hits = map_texts(keyed, "text", make, f"runs {RUNS}, items array<string>", ["key"]).filter(F.size("runs") > 0)
        return written(hits.groupBy(F.col("row.key").alias("key")).agg(F.first("runs").alias("runs"), F.first("items").alias("items")))
    finally:
        sent.destroy()


def decontaminate_by_blocks(docs: DataFrame, items: DataFrame, text_col: str, window: int, carry: list[str], blocks: int) -> DataFrame:
    """As decontaminate(): one pass over docs a block, one block at a time; the hits of all passes meet the rows by their text's sha-256."""
    items = written(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))).sort("block"))
    keyed = docs.select(F.sha2(F.col(text_col).cast("string"), 256).alias("key"), F.col(text_col).cast("string").alias("text")).filter("text <> ''")
    passes = [block_hits(keyed, held(items.filter(F.col("block") == b)), window) for b in range(blocks)]
    hits = passes[0]
    for one in passes[1:]:
        hits = hits.unionByName(one)
    hits = hits.groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    last = lambda done: F.try_element_at(done, F.lit(-1))
    longer = lambda p, x: F.struct(p["a"].alias("a"), F.greatest(p["b"], x["b"]).alias("b"), p["start"].alias("start"), F.greatest(p["end"], x["end"]).alias("end"))
    merged = F.aggregate(
        F.array_sort("runs"), F.array().cast(RUNS),
        lambda done, x: F.when((F.size(done) > 0) & (x["a"] <= last(done)["b"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer(last(done), x)))).otherwise(F.concat(done, F.array(x))),
    )
    hits = hits.select("key", merged.alias("runs"), "items")
    rows = docs.select(F.struct(*[docs[c] for c in carry]).alias("row"), docs[text_col].cast("string").alias("text"))
    counted = map_texts(rows, "text", lambda: lambda texts: [[len(normal_words(t)) for t in texts.to_pylist()]], "n_words bigint", ["row", "text"])
    counted = counted.select("row.row", "n_words", F.sha2("row.text", 256).alias("key"))
    # rows without words have no hits, and stay out of the join as one key
    joined = counted.filter("n_words > 0").join(hits, "key", "left").unionByName(counted.filter("n_words = 0"), allowMissingColumns=True)
    runs = F.coalesce("runs", F.array().cast(RUNS))
    return joined.select(
        "row", "n_words", F.aggregate(runs, F.lit(0).cast("bigint"), lambda n, x: n + x["b"] - x["a"]).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.transform(runs, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    carry: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For each row of docs: struct `row` of the carried columns (all of them if None), then n_words, n_hit, items, spans.

    n_hit counts the words inside any occurrence of a window of `window` consecutive words of an item (a shorter item is
    one window); items are the ids, as text, of items with such windows; spans are the hit stretches as code points of
    the original text, end exclusive. Null and empty texts have no words and no hits; an item with null or wordless text
    has no window; a null item id counts as the text 'null', and items of one id as one item. Texts of any length are
    scanned whole; repeated rows are judged one by one, overlapping and equal windows (ties) each count for their items;
    an empty table gives an empty result, an empty benchmark no hits; carried columns of any name stay apart in the struct.

    A benchmark of up to block_bytes of text is broadcast, and this is a narrow map over docs: nothing is shuffled. A
    larger one is written as a table in blocks of about block_bytes (an item is never split). Each block in turn is
    read, broadcast, scanned for in a pass over docs and dropped, so driver and workers hold one block at a time; the
    passes run at once, their hits are written, and docs meet them by one join.
    """
    items = benchmark_items(benchmark, item_col, item_text_col)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > block_bytes:
        return decontaminate_by_blocks(docs, items, text_col, window, docs.columns if carry is None else carry, -(-total // block_bytes))
    sent = docs.sparkSession.sparkContext.broadcast(held(items))

    def make():
        matcher = Matcher(sent.value, window)

        def work(texts: pa.Array) -> list:
            texts = texts.to_pylist()
            found = [matcher.runs(normal_words(t)) for t in texts]
            runs = [_merged(r) for r, _ in found]
            spans = []
            for text, merged in zip(texts, runs, strict=True):
                words = [m.span() for m in _WORD.finditer(text)] if merged else []
                spans.append([{"start": words[a][0], "end": words[b - 1][1]} for a, b in merged])
            return [[len(normal_words(t)) for t in texts], [sum(b - a for a, b in r) for r in runs], [sorted(x) for _, x in found], spans]

        return work

    return map_texts(docs, text_col, make, f"n_words bigint, n_hit bigint, items array<string>, spans {SPANS}", carry)


def is_contaminated(share: int = 20) -> Column:
    """A row of decontaminate() is contaminated if one word in `share`, and at least one, is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
