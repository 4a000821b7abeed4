"""Token counts of a unigram tokenizer without its pieces: Aho-Corasick matches and a Viterbi pass that only counts."""

from __future__ import annotations

import math
from collections import Counter as Counts
from collections.abc import Callable
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cosmotab.llm.common import map_texts

SPACE = "▁"
#: Words that a worker counts at most before it tokenizes them, and that each generation of its memory holds.
CACHE_WORDS = 400_000
#: What the public tokenizer takes off the lowest score for a character without a piece.
UNKNOWN_PENALTY = 10.0
_UNITS = regex.compile(r"[^\p{White_Space}▁]+|▁[^\p{White_Space}▁]*")
#: What str.split() takes for white space though it isn't, and the mark.
_APART = regex.compile(r"[\x1c-\x1f▁]")


def units(text: str) -> list[str]:
    """What is segmented by itself, without its leading space mark: words between white space; marks of the text's own
    split it too."""
    if not _APART.search(text):
        return text.split()
    return [u.removeprefix(SPACE) for u in _UNITS.findall(text)]


def read_pieces(model_file: str) -> list[str]:
    """The pieces of a public tokenizer file, all of them, in order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())]


def estimate(docs: DataFrame, model_file: str, *, text_col: str = "text") -> list[tuple[str, float]]:
    """The pieces of a public tokenizer file, each with its log probability in docs.

    A piece's probability is its share, plus one, of all pieces that the public tokenizer makes of all texts of docs:
    the pieces are the file's own, and nothing of them is trained. Null and empty texts add nothing; of an empty table
    all pieces are equally likely. Tasks count words, then tokenize each word once and send one row a piece; the driver
    holds one number a piece.
    """
    import sentencepiece

    with open(model_file, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    pieces = read_pieces(model_file)

    def count(batches):
        sp = sentencepiece.SentencePieceProcessor(model_proto=held.value)
        total = np.zeros(len(pieces), np.int64)
        words: Counts = Counts()

        def spend() -> None:
            made = sp.encode(list(words), num_threads=1)
            times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.fromiter(map(len, made), np.int64, len(made)))
            ids = np.fromiter(chain.from_iterable(made), np.int64, len(times))
            total[:] += np.bincount(ids, times, len(total)).astype(np.int64)
            words.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words.update(text.split())
                if len(words) > CACHE_WORDS:
                    spend()
        spend()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["piece", "n"])

    used = docs.select(F.col(text_col).cast("string").alias("text")).filter("text <> ''").mapInArrow(count, "piece int, n bigint")
    n = np.ones(len(pieces))
    for piece, times in used.groupBy("piece").agg(F.sum("n")).collect():
        n[piece] += times
    return list(zip(pieces, np.log(n / n.sum()).tolist(), strict=True))


class Memory(dict):
    """Results of a function of a word. Of the words beyond `limit` those that came up again since the last `limit` new ones stay."""

    def __init__(self, made: Callable[[str], tuple[int, float]], limit: int):
        self.made, self.limit, self.older = made, limit, {}

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        one = self.older.get(word)
        if one is None:
            one = self.made(word)
        self[word] = one
        return one


class Counter:
    """Best score and piece count of units, by the rules of the public unigram tokenizer with byte fallback.

    A path may use vocabulary pieces, and for a character that is no piece itself an unknown piece of the lowest score
    less UNKNOWN_PENALTY, which falls back to one byte piece for each UTF-8 byte. Among paths of equal score to a
    position the one whose last piece starts first (the longest piece) stays, and a piece wins over an unknown character.
    """

    def __init__(self, vocabulary: list[tuple[str, float]], cache_words: int = CACHE_WORDS):
        self.trie = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.trie.add_word(piece, (len(piece), score))
        if vocabulary:
            self.trie.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.memory = Memory(self.count, cache_words)

    def count(self, unit: str) -> tuple[int, float]:
        """Piece count and score of one unit, given without its space mark. Memory grows with its length, time too: a piece
        ends where its match does, and no more of them end at one place than the longest piece has letters."""
        unit = SPACE + unit
        n = len(unit)
        # Of the path to each letter, that letter included; the last place, of index -1 too, is the path to nothing.
        best, pieces = [-math.inf] * n + [0.0], [0] * (n + 1)
        unknown = [] if self.single.issuperset(unit) else [i for i, c in enumerate(unit) if c not in self.single]
        if len(self.trie):
            found = self.trie.iter(unit)
            if not unknown:  # then a piece ends at each letter
                for at, (length, score) in found:  # at one end the longest comes first
                    total = best[at - length] + score
                    if total > best[at]:
                        best[at], pieces[at] = total, pieces[at - length] + 1
                return pieces[n - 1], best[n - 1]
        else:
            found = iter(())
        end, match = next(found, (n, None))
        gaps = set(unknown)
        for at in range(n):
            while end == at:
                length, score = match
                total = best[at - length] + score
                if total > best[at]:
                    best[at], pieces[at] = total, pieces[at - length] + 1
                end, match = next(found, (n, None))
            if at in gaps:
                total = best[at - 1] + self.unknown
                if total > best[at]:
                    best[at], pieces[at] = total, pieces[at - 1] + len(unit[at].encode())
        return pieces[n - 1], best[n - 1]

    def of_text(self, text: str) -> tuple[int, int, float]:
        """Units, pieces and score of a text."""
        found = units(text)
        each = list(map(self.memory.__getitem__, found))
        return len(found), sum(n for n, _ in each), sum(s for _, s in each)


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """For each row of docs: struct `row` of the carried columns (all if None), then n_words, n_tokens and score.

    The text is split at white space; each word, led by a space mark, is one unit of the tokenizer (no piece crosses a
    space; a space mark inside a text begins a unit too). n_tokens is the piece count of the best segmentation of all
    units, score the sum of its pieces' scores: its log probability, if the scores are. Ties follow the public tokenizer
    (see Counter). Null, empty and blank texts have no tokens; texts of any length are counted whole; repeated rows one
    by one; an empty table gives an empty result; carried columns of any name stay apart in the struct. A narrow map: no
    shuffle; the vocabulary (a file of a few MB) is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        counter = Counter(held.value)

        def work(texts: pa.Array) -> list:
            return [list(x) for x in zip(*map(counter.of_text, texts.to_pylist()), strict=True)]

        return work

    return map_texts(docs, text_col, make, "n_words bigint, n_tokens bigint, score double", carry)
