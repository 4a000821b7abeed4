"""Alignment of two tokenizers: which ids cover the same bytes, how many documents link them, and scores from that.

Texts go as shards of documents into an inverted index: for each linked pair of ids a compressed bitmap of the shard's
documents, with bit planes of how often each document links it. Popcounts give a pair's documents and links; the pair's
corpus-wide counts come back to the shard, whose postings hand them on to the documents.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cosmotab.llm.bpe import PATTERN, Vocabulary, byte_letters
from cosmotab.llm.common import slices, written

#: A shard ends at so many bytes of text or so many documents; documents are numbered in it by 16 bits.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 16
#: About so many postings of a shard make a piece of its index, which is one row.
PIECE = 1 << 20
#: Units, and characters of them, that a worker remembers at most; then it forgets them all and goes on.
CACHE_UNITS, CACHE_CHARS = 250_000, 8 << 20
#: Text that the tokenizers get at once.
CHUNK = 1 << 16

#: A unit begins with a space after anything but white space, where tokens of both kinds end: the word patterns keep white
#: space together, and no piece holds a space after another character. So units are tokenized and aligned one by one.
_UNIT = re.compile(r" ((?:[^ ]+|(?<=\s) )*)")
_APART = re.compile(r"\s ")
_MARK = "▁"
INDEX = "shard bigint, piece int, pairs binary, planes binary, lists binary, bitmaps binary"
FACTS = "shard bigint, place int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint"


def units(text: str) -> list[str]:
    """The units of a space and the text, each without its first space."""
    spaced = f" {text}"
    return _UNIT.findall(spaced) if _APART.search(spaced) else text.split(" ")


class Tokenizers:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, a_spec: str, b_model: bytes):
        import sentencepiece

        self.encode_a, self.a_bytes = byte_level(a_spec)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.lead = len(self.b.encode("a"))
        m = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(m)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        if any(_MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError("a piece holds a space after another character: units can't be told apart")
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        #: Written ids with what may follow them: an id of the same side, the other side, another group.
        n = len(self.a_bytes)
        texts = [f"{i}{end}".encode() for end, count in ((",", n), ("|", n), (",", m), (";", m)) for i in range(count)]
        self.text_size = np.array([len(x) for x in texts], np.int64)
        self.text_at = np.cumsum(self.text_size) - self.text_size
        self.texts = np.frombuffer(b"".join(texts), np.uint8)

    def encode(self, whole: str) -> tuple[list[int], list[int]]:
        """Ids of both for text that begins with a space. B's library gives an empty text no space: a letter goes before."""
        return self.encode_a(whole), self.b.encode(f"a{whole}", num_threads=1)[self.lead :]

    def same_bytes(self, a: list[int], b: list[int], raw: bytes) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw


def byte_level(spec: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """(encode, bytes of the ids) of a byte-level BPE file; strings of special tokens are plain text.

    Merging by rank is merging by id where ids rise with the merges and every token is what its own bytes merge to; then
    the faster of the two public libraries does it, else the one whose format the file has.
    """
    vocabulary = Vocabulary(spec)
    data = json.loads(spec)
    letters = byte_letters()
    ids = data["model"]["vocab"]
    raw = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        raw[i] = bytes(letters[c] for c in token)
    own = sorted(set(ids.values()))
    flat, ends = vocabulary.encode_words([raw[i] for i in own])
    merged = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in data["model"]["merges"]]
    if merged == sorted(merged) and np.array_equal(flat, own) and len(set(raw)) == len(raw):
        import tiktoken

        fast = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks={raw[i]: i for i in own}, special_tokens={})
        return fast.encode_ordinary, raw
    import tokenizers

    data["truncation"] = data["padding"] = None
    slow = tokenizers.Tokenizer.from_str(json.dumps(data))
    slow.encode_special_tokens = True
    return lambda text: slow.encode(text, add_special_tokens=False).ids, raw


def taken(flat: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of flat that begin at `at`, one after the other."""
    return flat[np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


class Aligner:
    """Remembers aligned units: facts (tokens of A and B, groups, links, whether it can't be aligned), written groups and
    the pairs of ids that they link, with multiplicities."""

    def __init__(self, tokenizers: Tokenizers):
        self.of = tokenizers
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.written: list[bytes] = []
        self.facts, self.pair_at, self.pair_n = np.zeros((1024, 5), np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.codes, self.times, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0

    def numbers(self, wanted: list[str]) -> np.ndarray:
        """The number of each unit, for facts, written, pair_at and pair_n, until the next call."""
        if len(self.index) > CACHE_UNITS or self.chars > CACHE_CHARS:
            self.forget()
        index = self.index
        self._learn([u for u in dict.fromkeys(wanted) if u not in index])
        return np.fromiter(map(index.__getitem__, wanted), np.int64, len(wanted))

    def pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(how many, pair codes, multiplicities) of the units with these numbers."""
        n, start = self.pair_n[at], self.pair_at[at]
        return n, taken(self.codes, start, n), taken(self.times, start, n)

    def _learn(self, new: list[str]) -> None:
        chunk: list[str] = []
        size = 0
        for u in new:
            if not u or u[-1].isspace() or _MARK in u or len(u) > CHUNK:  # it would not end before the next one, or may be none
                self._add([u])
                continue
            chunk.append(u)
            size += len(u)
            if size > CHUNK:
                self._add(chunk)
                chunk, size = [], 0
        if chunk:
            self._add(chunk)

    def _add(self, new: list[str]) -> None:
        of = self.of
        whole = " " + " ".join(new)
        raw = whole.encode()
        a, b = of.encode(whole)
        if not of.same_bytes(a, b, raw):
            if len(new) > 1:
                for u in new:
                    self._add([u])
            else:
                self._store(new, [b""], np.array([[0, 0, 0, 0, 1]]), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            return
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_end, b_end = np.cumsum(of.a_size[a]), np.cumsum(of.b_size[b])
        shared = np.intersect1d(a_end, b_end)
        unit_end = np.cumsum([len(u.encode()) + 1 for u in new]) if len(raw) != len(whole) else np.cumsum([len(u) + 1 for u in new])
        last = np.searchsorted(shared, unit_end)  # each unit's last group
        if last[-1] >= len(shared) or not np.array_equal(shared[last], unit_end):
            raise ValueError("a token crosses the end of a unit")
        a_group, b_group = np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)
        a_n, b_n = np.bincount(a_group, minlength=len(shared)), np.bincount(b_group, minlength=len(shared))
        # the written groups: A's ids, then B's, group by group
        n, m = len(of.a_size), len(of.b_size)
        a_text = a + n * ~np.append(a_group[1:] == a_group[:-1], False)
        b_text = b + 2 * n + m * ~np.append(b_group[1:] == b_group[:-1], False)
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        text = np.concatenate([a_text, b_text])[order]
        size = of.text_size[text]
        letters = taken(of.texts, of.text_at[text], size).tobytes()
        ends = np.cumsum(size)[np.cumsum(a_n + b_n)[last] - 1].tolist()
        written_as = [letters[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        per_unit = lambda x: np.diff(np.cumsum(x)[last], prepend=0)
        groups = np.diff(last + 1, prepend=0)
        facts = np.stack([per_unit(a_n), per_unit(b_n), groups, per_unit(a_n * b_n), np.zeros_like(groups)], axis=1)
        unit, codes, times = links(a, b, a_n, b_n, np.repeat(np.arange(len(new)), groups))
        self._store(new, written_as, facts, np.bincount(unit, minlength=len(new)), codes, times)

    def _store(self, new: list[str], written_as: list[bytes], facts: np.ndarray, pair_n: np.ndarray, codes: np.ndarray, times: np.ndarray) -> None:
        i, n, k = len(self.index), len(new), len(codes)
        while i + n > len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
            self.pair_at, self.pair_n = (np.concatenate([x, np.zeros_like(x)]) for x in (self.pair_at, self.pair_n))
        while self.used + k > len(self.codes):
            self.codes, self.times = (np.concatenate([x, np.zeros_like(x)]) for x in (self.codes, self.times))
        self.index.update(zip(new, range(i, i + n), strict=True))
        self.chars += sum(map(len, new))
        self.written += written_as
        self.facts[i : i + n], self.pair_n[i : i + n] = facts, pair_n
        self.pair_at[i : i + n] = self.used + np.cumsum(pair_n) - pair_n
        self.codes[self.used : self.used + k], self.times[self.used : self.used + k] = codes, times
        self.used += k


def links(a: np.ndarray, b: np.ndarray, a_n: np.ndarray, b_n: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, pair code, how often) of all links, in order: every A with every B of a group, of a_n and b_n tokens. Groups
    with many are counted id by id, so that no list of occurrence pairs arises."""
    a_at, b_at = np.cumsum(a_n) - a_n, np.cumsum(b_n) - b_n
    many = a_n * b_n > 4096
    parts = []
    for g in np.flatnonzero(many):
        (x, x_n), (y, y_n) = (np.unique(v[s : s + n], return_counts=True) for v, s, n in ((a, a_at[g], a_n[g]), (b, b_at[g], b_n[g])))
        parts.append((np.full(len(x) * len(y), unit[g]), (x[:, None] << 32 | y[None, :]).ravel(), (x_n[:, None] * y_n[None, :]).ravel()))
    few = np.flatnonzero(~many)
    n = (a_n * b_n)[few]
    g = np.repeat(few, n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    parts.append((unit[g], a[a_at[g] + k // b_n[g]] << 32 | b[b_at[g] + k % b_n[g]], np.ones(len(g), np.int64)))
    return summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))


#: A worker's aligners by what their vocabularies hash to: they outlive a task.
_aligners: dict[str, Aligner] = {}


def aligner(a_spec: str, b_model: bytes) -> Aligner:
    key = hashlib.sha256(a_spec.encode() + b_model).hexdigest()
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(Tokenizers(a_spec, b_model))
    return _aligners[key]


def summed(major: np.ndarray, minor: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by (major, minor), with the times of equal ones added up."""
    order = np.lexsort((minor, major))
    major, minor, times = major[order], minor[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (major[1:] != major[:-1]) | (minor[1:] != minor[:-1])])) if len(major) else np.zeros(0, np.int64)
    return major[first], minor[first], np.add.reduceat(times, first) if len(first) else times


# --- compressed bitmaps with planes ----------------------------------------------------------------------------------

#: A plane: the pair it belongs to (its number in the piece), its level, how many documents it holds, and whether they lie
#: in a bitmap. Level 0 holds all documents of the pair, level j those whose multiplicity less one has bit j - 1.
PLANE = np.dtype([("pair", "<u4"), ("level", "u1"), ("dense", "u1"), ("n", "<u4")])


def pack(codes: np.ndarray, docs: np.ndarray, times: np.ndarray, n_docs: int) -> tuple[bytes, bytes, bytes, bytes]:
    """(pairs, planes, lists, bitmaps) of postings sorted by pair and document. A plane is a list of 16-bit document
    numbers, or a bitmap of n_docs bits where that is shorter."""
    pairs, pair = np.unique(codes, return_inverse=True)
    width = (n_docs + 7) // 8
    planes, lists, bitmaps = [], [], []
    for level in range(1 + int(times.max() - 1).bit_length() if len(times) else 0):
        held = np.ones(len(docs), bool) if not level else (times - 1) >> (level - 1) & 1 == 1
        p, d = pair[held], docs[held]
        n = np.bincount(p, minlength=len(pairs))
        dense = 2 * n > width
        own = np.flatnonzero(n)
        table = np.zeros(len(own), PLANE)
        table["pair"], table["level"], table["dense"], table["n"] = own, level, dense[own], n[own]
        planes.append(table)
        lists.append(d[~dense[p]].astype("<u2"))
        row = np.cumsum(dense) - 1
        full = dense[p]
        for lo in range(0, int(dense.sum()), 256):
            some = full & (row[p] >= lo) & (row[p] < lo + 256)
            bits = np.zeros((min(256, int(dense.sum()) - lo), width * 8), np.uint8)
            bits[row[p[some]] - lo, d[some]] = 1
            bitmaps.append(np.packbits(bits, axis=1, bitorder="little").tobytes())
    joined = np.concatenate(planes) if planes else np.zeros(0, PLANE)
    return pairs.astype("<i8").tobytes(), joined.tobytes(), b"".join(x.tobytes() for x in lists), b"".join(bitmaps)


class Piece:
    """A packed piece of a shard's index."""

    def __init__(self, pairs: bytes, planes: bytes, lists: bytes, bitmaps: bytes):
        self.pairs, self.planes = np.frombuffer(pairs, "<i8"), np.frombuffer(planes, PLANE)
        self.lists = np.frombuffer(lists, "<u2")
        self.dense = self.planes["dense"] == 1
        rows = int(self.dense.sum())
        self.bitmaps = np.frombuffer(bitmaps, np.uint8).reshape(rows, -1) if rows else np.zeros((0, 0), np.uint8)

    def popcounts(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents and links of each pair: the set bits of its planes, those of level j > 0 2^(j - 1) times."""
        bits = self.planes["n"].astype(np.int64)
        if len(self.bitmaps):
            bits[self.dense] = np.bitwise_count(self.bitmaps).sum(axis=1)
        pair, level = self.planes["pair"], self.planes["level"].astype(np.int64)
        docs, links = np.zeros(len(self.pairs), np.int64), np.zeros(len(self.pairs), np.int64)
        np.add.at(docs, pair[level == 0], bits[level == 0])
        np.add.at(links, pair, bits << np.maximum(level - 1, 0))
        return docs, links

    def scores(self, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The documents with postings, and for each array of a value a pair, the sum over their links of those values."""
        times = np.int64(1) << np.maximum(self.planes["level"].astype(np.int64) - 1, 0)
        sparse = self.planes[~self.dense]
        top = max(int(self.lists.max()) + 1 if len(self.lists) else 0, 8 * self.bitmaps.shape[1])
        seen, sums = np.zeros(top, bool), [np.zeros(top, np.int64) for _ in values]
        seen[self.lists] = True
        at = np.repeat(np.arange(len(sparse)), sparse["n"])
        for s, v in zip(sums, values, strict=True):
            np.add.at(s, self.lists, (v[sparse["pair"]] * times[~self.dense])[at])
        owner, weight = self.planes["pair"][self.dense], times[self.dense]
        for lo in range(0, len(self.bitmaps), 256):
            row, doc = np.nonzero(np.unpackbits(self.bitmaps[lo : lo + 256], axis=1, bitorder="little"))
            seen[doc] = True
            for s, v in zip(sums, values, strict=True):
                np.add.at(s, doc, (v[owner[lo : lo + 256]] * weight[lo : lo + 256])[row])
        docs = np.flatnonzero(seen)
        return docs, [s[docs] for s in sums]


class Shard:
    """The postings of documents that are numbered in order."""

    def __init__(self, number: int):
        self.number, self.docs, self.bytes = number, 0, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def pieces(self) -> Iterator[tuple[int, tuple[bytes, bytes, bytes, bytes]]]:
        if not self.parts:
            return
        codes, docs, times = summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        i = piece = 0
        while i < len(codes):
            j = len(codes) if i + PIECE >= len(codes) else int(np.searchsorted(codes, codes[i + PIECE], side="right"))
            yield piece, pack(codes[i:j], docs[i:j], times[i:j], self.docs)
            i, piece = j, piece + 1


def _indexed(docs: DataFrame, a_spec: str, b_model: bytes, text_col: str, carry: list[str], digests: bool, budget: int) -> DataFrame:
    """Rows of two kinds: one a document with its facts (piece -1), and one a piece of a shard's index (row null)."""
    spec = docs.sparkSession.sparkContext.broadcast((a_spec, b_model))
    source = docs.select(F.struct(*[docs[c] for c in carry]).alias("row"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    groups = "groups_sha256" if digests else "groups"
    out = T.StructType([T.StructField("row", source.schema["row"].dataType), *T._parse_datatype_string(f"{FACTS}, {groups} string, {INDEX.removeprefix('shard bigint, ')}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out)
        own = aligner(*spec.value)
        first = TaskContext.get().partitionId() << 32
        shard = Shard(first)

        def rows(n: int, given: dict[str, object]) -> pa.RecordBatch:
            made = [x if isinstance(x := given.get(f.name), pa.Array) else pa.nulls(n, f.type) if x is None else pa.array(x, f.type) for f in kinds]
            return pa.RecordBatch.from_arrays(made, names=kinds.names)

        def index(shard: Shard) -> Iterator[pa.RecordBatch]:
            for piece, packed in shard.pieces():
                yield rows(1, {"shard": [shard.number], "piece": [piece], **{k: [v] for k, v in zip(("pairs", "planes", "lists", "bitmaps"), packed, strict=True)}})

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for part in slices(batch, sizes, budget):
                if shard.docs and (shard.docs + part.num_rows > SHARD_DOCS or shard.bytes > SHARD_BYTES):
                    yield from index(shard)
                    shard = Shard(shard.number + 1)
                facts, postings = align_texts(own, part.column(1).to_pylist(), digests)
                if len(postings[0]):
                    shard.parts.append((postings[0], postings[1] + shard.docs, postings[2]))
                n = part.num_rows
                facts[groups] = facts.pop("groups")
                yield rows(n, {"row": part.column(0), "shard": np.full(n, shard.number), "place": np.arange(shard.docs, shard.docs + n, dtype=np.int32), "piece": np.full(n, -1, np.int32), **facts})
                shard.docs += n
                shard.bytes += int(pc.sum(pc.binary_length(part.column(1))).as_py() or 0)
        yield from index(shard)

    return source.mapInArrow(run, out)


def align_texts(own: Aligner, texts: list[str], digests: bool) -> tuple[dict[str, object], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Facts of each text, and the postings (pair code, text number, multiplicity) of all, each pair and text once."""
    n_texts = len(texts)
    lists = [units(t) if t else [] for t in texts]
    count = np.fromiter(map(len, lists), np.int64, n_texts)
    at = own.numbers(list(chain.from_iterable(lists)))
    ends = np.concatenate([[0], np.cumsum(count)])
    facts = np.diff(np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(own.facts[at], axis=0)])[ends], axis=0)
    bad = facts[:, 4] > 0
    facts[bad] = 0
    parts = list(map(own.written.__getitem__, at.tolist()))
    groups = []
    for i, j, wrong in zip(ends[:-1].tolist(), ends[1:].tolist(), bad.tolist(), strict=True):
        text = b"" if wrong else b"".join(parts[i:j])[:-1]
        groups.append(hashlib.sha256(text).hexdigest() if digests and text else text.decode())
    use = np.repeat(~bad, count)
    doc = np.repeat(np.arange(n_texts), count)[use]
    key, times = np.unique(at[use] * n_texts + doc, return_counts=True)
    n, codes, each = own.pairs(key // max(1, n_texts))
    postings = summed(codes, np.repeat(key % max(1, n_texts), n), each * np.repeat(times, n))
    return {"n_a": facts[:, 0], "n_b": facts[:, 1], "n_groups": facts[:, 2], "n_links": facts[:, 3], "groups": groups}, postings


def align(docs: DataFrame, a_file: str, b_file: str, *, text_col: str = "text", carry: list[str] | None = None, digests: bool = False, budget: int = 1 << 20) -> DataFrame:
    """For each row of docs: struct `row` of the carried columns, n_a, n_b (tokens), n_groups, n_links, groups (`a1,a2|b1;...`
    in ids; with digests=True groups_sha256), n_best (links whose pair is linked by the most documents of all pairs of their
    A id, ties included) and count_sum (over links, how many documents link the pair).

    Each row is a document, equal ones too. A null or empty text, and one whose tokens' bytes aren't the text after a
    space, has no tokens: zeros and an empty string. Strings of special tokens are plain text. Texts of any length, and
    groups of any size, are worked out whole; an empty table gives an empty result; carried columns of any name stay apart.

    Texts are tokenized once, and facts and index are written to the shared folder. A task holds one shard (SHARD_BYTES of
    text). What moves after that: a row a pair and shard with its popcounts to the pair, and back with its corpus-wide
    counts; the pieces of the index; and a row of sums a document and piece. Pairs that every document links are one row a
    shard. Nothing is collected or broadcast but the vocabularies.
    """
    with open(a_file, encoding="utf-8") as f, open(b_file, "rb") as g:
        table = written(_indexed(docs, f.read(), g.read(), text_col, docs.columns if carry is None else carry, digests, budget))
    facts = table.filter("piece = -1").drop("piece", "pairs", "planes", "lists", "bitmaps")
    index = table.filter("piece >= 0").select("shard", "piece", "pairs", "planes", "lists", "bitmaps")
    linked = pair_counts(index)
    total = linked.groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    total = written(total.withColumn("code", F.shiftleft("a", 32).bitwiseOR(F.col("b"))))
    most = total.groupBy("a").agg(F.max("docs").alias("most"))
    scored = total.join(most, "a").select("a", "b", F.col("docs").alias("count"), (F.col("docs") == F.col("most")).alias("best"))
    back = linked.select("shard", "piece", "slot", "a", "b").join(scored, ["a", "b"]).select("shard", "piece", "slot", "count", "best")
    sums = index.groupBy("shard", "piece").cogroup(back.groupBy("shard", "piece")).applyInArrow(_returned, "shard bigint, place int, n_best bigint, count_sum bigint")
    sums = sums.groupBy("shard", "place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    whole = facts.join(sums, ["shard", "place"], "left")
    return whole.withColumns({x: F.coalesce(x, F.lit(0).cast("bigint")) for x in ("n_best", "count_sum")}).drop("shard", "place")


def pair_counts(index: DataFrame) -> DataFrame:
    """shard, piece, slot (of the pair in the piece), a, b, docs and links of every pair of every piece, by popcount."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                piece = Piece(r["pairs"], r["planes"], r["lists"], r["bitmaps"])
                docs, links = piece.popcounts()
                n = len(piece.pairs)
                columns = [np.full(n, r["shard"]), np.full(n, r["piece"], np.int32), np.arange(n, dtype=np.int32), piece.pairs >> 32, piece.pairs & 0xFFFFFFFF, docs, links]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["shard", "piece", "slot", "a", "b", "docs", "links"])

    return index.mapInArrow(run, "shard bigint, piece int, slot int, a bigint, b bigint, docs bigint, links bigint")


def _returned(left: pa.Table, right: pa.Table) -> pa.Table:
    """The postings of one piece hand the counts of its pairs on to its documents."""
    r = left.to_pylist()[0]
    piece = Piece(r["pairs"], r["planes"], r["lists"], r["bitmaps"])
    count, best = np.zeros(len(piece.pairs), np.int64), np.zeros(len(piece.pairs), np.int64)
    slot = right["slot"].to_numpy()
    count[slot], best[slot] = right["count"].to_numpy(), right["best"].to_numpy().astype(np.int64)
    docs, (n_best, count_sum) = piece.scores([best, count])
    return pa.table({"shard": np.full(len(docs), r["shard"]), "place": docs.astype(np.int32), "n_best": n_best, "count_sum": count_sum})
