"""Alignment of two tokenizers against the plain definition: the public libraries on whole texts, lists of links, counters."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cosmotab.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "  ", "\n", "a  b ", "\n x\n\n  y\t z  ", "a▁b", "▁", "<|endoftext|> <s></s> <unk> <0x41>", "é́ 日本語テキスト 😀👨‍👩‍👧", "x\xa0y 　 z \x85 q \x1c r s", "'s 't don't  I'LL",
    "a" * 3000, "日本" * 700, "\x00\x01 � ﻿", " lead", "trail \n", "The same text.", "The same text.", "tab\tthen space \t mixed\r\n", "1234567 12 1,000.50", "ﬁ ﬂ Å Å",
]


@pytest.fixture(scope="module")
def spec():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        return f.read(), g.read()


def plain(texts, spec):
    """(n_a, n_b, n_groups, n_links, groups, n_best, count_sum) of each text."""
    import json

    import sentencepiece
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=B)
    from cosmotab.llm.bpe import byte_letters

    letters = byte_letters()
    a_bytes = {i: bytes(letters[c] for c in t) for t, i in json.loads(spec[0])["model"]["vocab"].items()}
    b_bytes = [bytes([int(p[3:5], 16)]) if piece.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(piece.id_to_piece, range(piece.get_piece_size())))]
    facts, linked = [], []
    for t in texts:
        whole = f" {t}".encode() if t else b""
        a, b = (tok.encode(f" {t}", add_special_tokens=False).ids, piece.encode(t)) if t else ([], [])
        if b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            a, b = [], []
        a_end, b_end = np.cumsum([len(a_bytes[i]) for i in a]).tolist(), np.cumsum([len(b_bytes[i]) for i in b]).tolist()
        groups, pairs, x, y = [], Counter(), 0, 0
        for cut in sorted(set(a_end) & set(b_end)):
            i, j = x, y
            while i < len(a) and a_end[i] <= cut:
                i += 1
            while j < len(b) and b_end[j] <= cut:
                j += 1
            one, two, x, y = a[x:i], b[y:j], i, j
            groups.append(f"{','.join(map(str, one))}|{','.join(map(str, two))}")
            pairs.update((i, j) for i in one for j in two)
        facts.append((len(a), len(b), len(groups), sum(pairs.values()), ";".join(groups)))
        linked.append(pairs)
    docs = Counter(p for pairs in linked for p in pairs)
    most = defaultdict(int)
    for (i, _), n in docs.items():
        most[i] = max(most[i], n)
    return [(*f, sum(k for p, k in c.items() if docs[p] == most[p[0]]), sum(k * docs[p] for p, k in c.items())) for f, c in zip(facts, linked, strict=True)]


def texts(n=120, seed=3):
    rng = random.Random(seed)
    parts = ["the", "of", "token", "alignment", "Größe", "naïve", "foo_bar", "x1y2", "...", "—", "  ", "\n", "\t", "日本", "🙂", "un", "believable", "A", "ÀÉ", "100,000", "don't", "▁", "e" * 40]
    made = ["".join(rng.choice(["", " ", " ", "  ", "\n"]) + rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(n)]
    return made + ODD + made[:5]


def test_equal_to_the_plain_definition_over_shards_and_pieces(spark, spec, monkeypatch):
    given = texts()
    want = plain(given, spec)
    for name, value in (("SHARD_BYTES", 3000), ("SHARD_DOCS", 40), ("PIECE", 50)):
        monkeypatch.setattr(align, name, value)
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id bigint, text string").repartition(3)
    rows = align.align(docs, A, B, carry=["doc_id"], budget=1000).collect()
    got = {r.row.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in rows}
    assert len(rows) == len(given) and [got[i] for i in range(len(given))] == want
    digests = {r.row.doc_id: r.groups_sha256 for r in align.align(docs, A, B, carry=["doc_id"], digests=True).collect()}
    assert digests == {i: hashlib.sha256(w[4].encode()).hexdigest() if w[4] else "" for i, w in enumerate(want)}


def test_a_very_long_text_and_a_group_of_very_many_tokens(spec):
    own = align.Aligner(align.Tokenizers(*spec))
    long = [" ".join(texts(40, 9)[:40]) * 20, "x" * 200_000, "日" * 30_000 + " " + "ab" * 30_000]
    facts, (codes, docs, times) = align.align_texts(own, long, False)
    want = plain(long, spec)
    assert [tuple(int(facts[k][i]) for k in ("n_a", "n_b", "n_groups", "n_links")) + (facts["groups"][i],) for i in range(3)] == [w[:5] for w in want]
    assert np.bincount(docs, times, 3).astype(int).tolist() == [w[3] for w in want]
    # one group of all tokens: the links are counted, not listed
    a, b = np.arange(2000) % 7, np.arange(3000) % 11
    unit, code, times = align.links(a, b, np.array([2000]), np.array([3000]), np.array([0]))
    assert len(code) == 77 and times.sum() == 6_000_000 and (unit == 0).all()


def test_forgetting_changes_nothing(spec, monkeypatch):
    given = [t or "" for t in texts(30, 5)]
    own = align.Aligner(align.Tokenizers(*spec))
    first, _ = align.align_texts(own, given, True)
    monkeypatch.setattr(align, "CACHE_UNITS", 3)
    for i, t in enumerate(given):
        again, _ = align.align_texts(own, [t], True)
        assert again["groups"] == [first["groups"][i]] and again["n_links"][0] == first["n_links"][i]


def test_packed_postings_count_and_hand_back():
    rng = np.random.default_rng(1)
    n_docs = 900
    held = {(p, d): int(rng.integers(1, 40)) if p % 3 else 1 for p in range(30) for d in range(n_docs) if rng.random() < (0.002, 0.1, 0.9)[p % 3]}
    code, doc = (np.array(x) for x in zip(*held, strict=True))
    code, doc, times = align.summed(code * 7, doc, np.array(list(held.values())))
    piece = align.Piece(*align.pack(code, doc, times, n_docs))
    docs, links = piece.popcounts()
    want = defaultdict(list)
    for (p, _), k in held.items():
        want[p * 7].append(k)
    assert {int(p): (int(n), int(k)) for p, n, k in zip(piece.pairs, docs, links, strict=True)} == {p: (len(v), sum(v)) for p, v in want.items()}
    assert 0 < int(piece.planes["dense"].sum()) < len(piece.planes)
    value = rng.integers(1, 1 << 40, len(piece.pairs))
    at = {int(p): int(v) for p, v in zip(piece.pairs, value, strict=True)}
    found, (sums,) = piece.scores([value])
    expected = Counter()
    for (p, d), k in held.items():
        expected[d] += k * at[p * 7]
    assert dict(zip(found.tolist(), sums.tolist(), strict=True)) == dict(expected)


def test_ids_are_those_of_the_public_library(spec):
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    encode, raw = align.byte_level(spec[0])
    rng = random.Random(7)
    alphabet = [*"abcXYZ019 .,'\n\t\r-_", " ", " ", "'s", "'ll", "é", "日", "🙂", "\xa0", "　", " ", "\x85", "\x1c", "\x0b", "​", "́", "٣", "Ⅷ", "²", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40)))
        assert encode(text) == tok.encode(text, add_special_tokens=False).ids, repr(text)
    assert all(tok.decode([i]).encode() == raw[i] for i in range(300, 2000) if b"\xef\xbf\xbd" not in tok.decode([i]).encode())


def test_a_file_that_ranks_otherwise_uses_its_own_library(spec):
    import json

    data = json.loads(spec[0])
    data["model"]["merges"][1000], data["model"]["merges"][3000] = data["model"]["merges"][3000], data["model"]["merges"][1000]
    encode, _ = align.byte_level(json.dumps(data))
    assert "encode_ordinary" not in getattr(encode, "__qualname__", "")
    import tokenizers

    tok = tokenizers.Tokenizer.from_str(json.dumps(data))
    assert encode(" some ordinary text") == tok.encode(" some ordinary text", add_special_tokens=False).ids


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id bigint, text string, groups string, n_a int")
    rows = align.align(docs, A, B).collect()
    assert rows[0].row.groups == "x" and rows[0].row.n_a == 5 and rows[0].n_a == 2 and rows[0].groups
    assert align.align(docs.limit(0), A, B).collect() == []
    nothing = align.align(docs.select("doc_id", F.lit(None).cast("string").alias("text")), A, B).first()
    assert (nothing.n_a, nothing.n_links, nothing.n_best, nothing.count_sum, nothing.groups) == (0, 0, 0, 0, "")
