"""Byte-level BPE encoding and decoding: numpy merge rounds over the symbols of many words in one flat array."""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cosmotab.llm.common import map_texts

#: Fixed value: the public word pattern of this byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker remembers at most with their ids; then it forgets them all and goes on.
CACHE_WORDS = 400_000
NONE = np.iinfo(np.int64).max
#: Bytes from which on a word is merged rank by rank: a round then costs its merges, not the word's length.
LONG_WORD = 256


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file, by the public rule: printable Latin-1 bytes
    stand for themselves, the others for the letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges, token bytes and added tokens of a tokenizer file with a byte-level BPE model."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        letters = byte_letters()
        ids = data["model"]["vocab"]
        raw = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        raw |= {i: t.encode() for t, i in self.added.items()}
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = ids[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        n = max(raw) + 1
        self.sizes = np.array([len(raw.get(i, b"")) for i in range(n)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.bytes = np.frombuffer(b"".join(raw.get(i, b"") for i in range(n)), np.uint8)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of symbols, NONE without one, by binary search over the sorted pair keys."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and the n + 1 offsets of the words in it."""
        long = [w for w in words if len(w) >= LONG_WORD]
        flat, ends = self.encode_by_rounds([w for w in words if len(w) < LONG_WORD])
        if not long:
            return flat, ends
        long_flat, long_ends = self.encode_by_ranks(long)
        is_long = np.fromiter((len(w) >= LONG_WORD for w in words), bool, len(words))
        sizes, starts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        sizes[~is_long], sizes[is_long] = np.diff(ends), np.diff(long_ends)
        starts[~is_long], starts[is_long] = ends[:-1], long_ends[:-1] + len(flat)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        return np.concatenate([flat, long_flat])[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])], offsets

    def encode_by_ranks(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As encode_words(), for long words: each round merges all pairs of the lowest rank that any word still holds.

        That is the lowest rank of every word that holds it, so words stay independent. Places wait in one list for each
        rank; a merge looks up the ranks of its two new neighbours only. Symbols are linked to the next and the one
        before, as merged ones drop out.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbol)
        begins = np.cumsum(sizes) - sizes
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[begins + sizes - 1] = n  # no next symbol
        before[begins] = n
        rank = np.full(n + 1, NONE)  # of the pair that begins at each place
        alive = np.ones(n + 1, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look(places: np.ndarray) -> None:
            """Ranks of the pairs that begin at these places, which wait for their turn from now on."""
            rank[places] = NONE
            places = places[after[places] < n]
            found = self.pair_ranks(symbol[places], symbol[after[places]])
            rank[places] = found
            places, found = places[found != NONE], found[found != NONE]
            by = np.argsort(found, kind="stable")
            places, found = places[by], found[by]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for some, r in zip(np.split(places, cuts), found[np.concatenate([[0], cuts])].tolist() if len(found) else [], strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(some)

        look(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            i = np.unique(np.concatenate(waiting.pop(r)))
            i = i[alive[i] & (rank[i] == r)]
            if not len(i):
                continue
            # in a stretch of overlapping equal pairs (aaaa) every second one merges, from the left
            place = np.arange(len(i))
            fresh = np.concatenate([[True], after[i[:-1]] != i[1:]])
            i = i[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
            gone = after[i]
            symbol[i] = self.merged[r]
            alive[gone] = False
            rank[gone] = NONE
            after[i] = after[gone]
            linked = after[i] < n
            before[after[i][linked]] = i[linked]
            left = before[i]
            look(np.unique(np.concatenate([i, left[left < n]])))
        keep = alive[:n]
        kept = np.add.reduceat(keep.astype(np.int64), begins) if n else np.zeros(0, np.int64)
        return symbol[keep], np.concatenate([[0], np.cumsum(kept)])

    def encode_by_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As encode_words(), for short words.

        Each round finds, by binary search over the sorted pair keys, the rank of every neighbouring pair of one word,
        and merges the pairs of the word's lowest rank from left to right; a word without a pair is done.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_words = [], []
        while len(symbols):
            rank = np.full(len(symbols), NONE)
            rank[:-1] = np.where(word[1:] == word[:-1], self.pair_ranks(symbols[:-1], symbols[1:]), NONE)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(word)))
            low_here = np.repeat(low, length)
            live = low_here != NONE
            if not live.all():
                done_symbols.append(symbols[~live])
                done_words.append(word[~live])
                symbols, word, rank, low_here = symbols[live], word[live], rank[live], low_here[live]
                if not len(symbols):
                    break
            take = rank == low_here
            # in a stretch of overlapping equal pairs (aaaa) every second one merges, from the left
            i = np.flatnonzero(take)
            fresh = np.concatenate([[True], np.diff(i) > 1])
            begin = np.maximum.accumulate(np.where(fresh, i, 0))
            i = i[(i - begin) % 2 == 0]
            symbols[i] = self.merged[rank[i]]
            keep = np.ones(len(symbols), bool)
            keep[i + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_words:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in one flat array, and the n + 1 offsets of the ids in it."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        offsets = np.concatenate([[0], ends])
        total = int(offsets[-1])
        return self.bytes[np.repeat(self.starts[ids] - offsets[:-1], sizes) + np.arange(total)], offsets


class Encoder:
    """Splits texts into words, looks the words' ids up and encodes the new ones together."""

    def __init__(self, vocabulary: Vocabulary, cache_words: int = CACHE_WORDS):
        self.vocabulary, self.cache_words = vocabulary, cache_words
        self.pattern = regex.compile(PATTERN)
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(vocabulary.added, key=len, reverse=True)) + ")") if vocabulary.added else None
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int64), 0  # ids of all known words; the arrays grow by doubling
        self.sizes, self.starts = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        for token, i in self.vocabulary.added.items():
            self._learn([token], np.array([i]), np.array([1]))

    def _learn(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        known, n, m = len(self.index), len(words), len(flat)
        while known + n > len(self.sizes):
            self.sizes, self.starts = np.concatenate([self.sizes, self.sizes]), np.concatenate([self.starts, self.starts])
        while self.used + m > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.sizes[known : known + n] = sizes
        self.starts[known : known + n] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + m] = flat
        self.used += m
        self.index.update(zip(words, range(known, known + n), strict=True))

    def words(self, text: str) -> list[str]:
        if self.split_added is not None and any(t in text for t in self.vocabulary.added):
            parts = self.split_added.split(text)
            return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self.pattern.findall(part))]
        return self.pattern.findall(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and the n + 1 offsets of the texts in it."""
        if len(self.index) > self.cache_words:
            self.forget()
        words: list[str] = []
        ends = []
        for text in texts:
            words += self.words(text)
            ends.append(len(words))
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            flat, offsets = self.vocabulary.encode_words([w.encode() for w in new])
            self._learn(new, flat, np.diff(offsets))
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[at]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.starts[at] - offsets[:-1], sizes) + np.arange(offsets[-1])]
        return ids, offsets[np.array([0, *ends])]


def encode_decode(docs: DataFrame, vocabulary_file: str, *, text_col: str = "text", carry: list[str] | None = None, digests: bool = False, budget: int = 2 << 20) -> DataFrame:
    """For each row of docs: struct `row` of the carried columns, then its token ids and the text decoded from them.

    Columns n_tokens, ids (array<int>) and decoded; with digests=True n_tokens, ids_sha256 (of the ids as little-endian
    unsigned 32-bit integers) and decoded_sha256 (of the decoded UTF-8) instead. Whole texts are encoded, of any length;
    a null or empty text has no tokens and decodes to an empty text; the strings of added tokens become those tokens.
    Repeated rows (ties) are encoded one by one; an empty table gives an empty result; carried columns of any name stay
    apart in the struct. A narrow map: no shuffle; the vocabulary (a few MB) is broadcast.
    """
    with open(vocabulary_file, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        encoder = Encoder(Vocabulary(spec.value))

        def work(texts: pa.Array) -> list:
            ids, ends = encoder.encode(texts.to_pylist())
            raw, at = encoder.vocabulary.decode(ids)
            raw = raw.tobytes()
            cuts = at[ends]
            counts = np.diff(ends)
            if digests:
                small = ids.astype("<u4").tobytes()
                return [
                    counts,
                    [hashlib.sha256(small[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)],
                    [hashlib.sha256(raw[a:b].decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
                ]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            return [counts, lists, [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]]

        return work

    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens bigint, ids array<int>, decoded string"
    return map_texts(docs, text_col, make, fields, carry, budget)
