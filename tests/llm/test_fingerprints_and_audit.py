"""Fingerprints against exact similarities, next documents against a plain sort; the filter audit against plain counting."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cosmotab.llm import audit, fingerprints


def similarity(a, b):
    a, b = Counter(fingerprints.terms(a)), Counter(fingerprints.terms(b))
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def prose(rng, n, words=300):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(n))


def test_lanes_agree_as_often_as_the_weighted_sets_overlap():
    rng = random.Random(4)
    sampler = fingerprints.Sampler()
    errors, scale = [], []
    for trial in range(150):  # each with words of its own, so that errors are independent
        text = prose(rng, rng.randrange(20, 500)).replace("w", f"{trial}w")
        words = text.split()
        other = " ".join(w for w in words if rng.random() < rng.choice([0.2, 0.6, 0.95])) + " " + prose(rng, rng.randrange(0, 100), 40).replace("w", f"{trial}w")
        a, b = sampler([text, other])
        s = similarity(text, other)
        errors.append((a == b).mean() - s)
        scale.append((s * (1 - s) / fingerprints.LANES) ** 0.5)
    assert abs(np.mean(errors)) < 0.012  # unbiased: 3 standard errors
    assert 0.8 < np.sqrt(np.mean(np.square(errors))) / np.sqrt(np.mean(np.square(scale))) < 1.2
    # weights count, not only the sets of words
    a, b = sampler(["x y", "x " * 9 + "y"])
    assert abs((a == b).mean() - 2 / 10) < 0.15


def test_lanes_of_a_very_long_text(monkeypatch):
    text = " ".join(f"w{i * i % 70_001}" for i in range(150_000))
    whole = fingerprints.Sampler()(["a b", text, "c"])
    monkeypatch.setattr(fingerprints, "MOST_HELD", 1)
    assert (fingerprints.Sampler()(["a b", text, "c"]) == whole).all()
    assert (whole[1] == fingerprints.Sampler()([text + " more"])[0]).mean() > 0.98


def test_samples_are_gamma_and_consistent():
    term, weights = np.arange(1, 4001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.full(4000, 3)
    ln_a, name = fingerprints.samples(term, weights)
    assert abs(np.exp(ln_a).mean() * 3 - 1) < 0.02 and abs(np.exp(ln_a).var() * 9 - 1) < 0.05  # exponential, the weight is its rate
    packed = fingerprints.sampled(term, weights)
    assert ((packed & np.uint64(0xFFFFFFFF)) == name).all() and (np.argmin(packed, axis=0) == np.argmin(ln_a, axis=0)).all()
    # a weight between a level and the next samples the same level, so names repeat from weight to weight
    names = [fingerprints.samples(term[:200], np.full(200, w))[1] for w in (100, 101)]
    assert 0.97 < (names[0] == names[1]).mean() < 1


def test_fingerprints_are_equal_for_equal_texts_alone(spark):
    rng = random.Random(5)
    texts = [prose(rng, 60) for _ in range(20)] + ["", None, " \n", "one", "日本語" * 50, "日本語" * 51, "x" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts + texts)), "i int, text string").withColumn("fingerprint", F.lit(7))
    rows = fingerprints.fingerprint(docs.repartition(5)).collect()
    by = {}
    for r in rows:
        assert r.row.fingerprint == 7 and len(r.fingerprint) == fingerprints.LANES * fingerprints.DIGITS
        by.setdefault(texts[r.row.i % len(texts)] if (texts[r.row.i % len(texts)] or "").strip() else "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == len(by)
    assert by[""] == {"0" * fingerprints.LANES * fingerprints.DIGITS}
    assert fingerprints.fingerprint(docs.limit(0)).collect() == []
    pair = spark.createDataFrame([("001002003", "001002004"), ("000", "000"), ("000", "001")], "a string, b string")
    assert [r[0] for r in pair.select(fingerprints.likeness(F.col("a"), F.col("b"))).collect()] == [pytest.approx(2 / 3), 1.0, 0.0]


def expected(rows):
    """(n_chars, hash of the edited text, its similarity and that of the next one) by id and text."""
    out = {}
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        out[i, t] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), similarity(t, edited), similarity(t, after))
    return out


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_next_documents_by_id(spark, parts):
    rng = random.Random(parts)
    ids = rng.sample(range(-(10**12), 10**12), 60) + [2**62 + k for k in range(5)]
    rows = sorted((i, rng.choice([prose(rng, rng.randrange(1, 80)), "", None, "é日🙂" * rng.randrange(1, 9), " \n "])) for i in ids)
    docs = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id bigint, text string").repartition(4)
    got = {(r.id, dict(rows)[r.id] or ""): r for r in fingerprints.compare_with_next(docs, parts=parts, budget=500).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    for k, (n, sha, edited, after) in want.items():
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert abs(r.near_edited - edited) < 0.25 and abs(r.near_next - after) < 0.25
    assert np.mean([got[k].near_edited - w[2] for k, w in want.items()]) == pytest.approx(0, abs=0.03)


def test_next_documents_in_odd_tables(spark):
    kind = "doc_id bigint, text string, n_chars string"
    run = lambda rows, **k: fingerprints.compare_with_next(spark.createDataFrame(rows, kind), **k).collect()
    assert run([]) == []
    (alone,) = run([(5, "one two three four", "x")])
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"one two three one ").hexdigest()  # its own next one
    same = run([(1, "a b c d", None)] * 6, parts=3)
    assert len(same) == 6 and {r.near_next for r in same} == {1.0}
    nulls = run([(None, "first of all", None), (3, "second one", None), (None, None, None)])
    assert sorted((r.id is None, r.n_chars) for r in nulls) == [(False, 10), (True, 0), (True, 12)]
    long = "long words here " * 100_000
    got = {r.id: r for r in run([(1, long, None), (2, "x", None)], parts=2)}
    assert got[1].edited_sha256 == hashlib.sha256((long[: len(long) - len(long) // 4] + "x").encode()).hexdigest() and got[2].n_chars == 1


# --- audit -----------------------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    """Every document through every order."""
    import re

    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    marks = {}
    for i, q, x in labels:
        good, toxic = marks.get(i, (False, False))
        marks[i] = (good or q == 1, toxic or x == 1)
    cells = Counter()
    for i, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(
            f for f, bad in zip("ABCDE", (
                len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t],
            ), strict=True) if bad
        )
        cells[source or "", fails, marks.get(i, (False, False)) if i is not None else (False, False)] += 1
    out = {}
    for part in {p for p, _, _ in cells}:
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                row = [0] * 6
                for (p, fails, (good, toxic)), n in cells.items():
                    if p != part:
                        continue
                    before = any(x in fails for x in order[: step - 1])
                    row[0] += n * (not before and f not in fails)
                    row[1] += n * (not before and f in fails)
                    row[2] += n * (before and f in fails)
                    row[3] += n * (fails == f)
                    row[4] += n * (not before and f in fails and good)
                    row[5] += n * (not before and f in fails and toxic)
                out[part, order, step] = row
    shapley = Counter()
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return {k: (*row, shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def audited(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumns({"mask": F.lit("x"), "n": F.lit(1.5)})
    cells, letters = audit.mask_cells(d.repartition(3), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    rows = audit.interactions(cells, letters).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_of_every_order(spark):
    rng = random.Random(11)
    words = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    pool = ["", None, " \t\n ", "A B C", "a # b", words(60, 1000), words(60, 20), words(49, 1000), words(50, 1000), "UPPER " * 60, words(80, 900) + " 5%", "x\xa0y " * 30, "日本 " * 55, words(20_000, 50)]
    docs = [(i, rng.choice(pool) if rng.random() < 0.6 else words(rng.randrange(30, 90), rng.choice([10, 500])), rng.choice(["a", "b", None, ""])) for i in range(150)]
    docs += [docs[3], docs[3], (None, "A B C", "a"), (None, "A B C", "c"), (None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 200, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    got = audited(spark, docs, labels)
    assert got == plain_audit(docs, labels) and len(got) == 600 * 4


def test_audit_of_odd_tables(spark):
    assert audited(spark, [], []) == {}
    one = audited(spark, [(1, "word " * 3, "s")], [])
    assert len(one) == 600 and one["s", "ABCDE", 1] == (0, 1, 0, 0, 0, 0, 60) and one["s", "BACDE", 1] == (0, 1, 0, 0, 0, 0, 60)


def test_audit_of_a_third_of_copies(spark):
    docs = [(i, "the same text" if i % 3 == 0 else f"text {i}", f"s{i % 2}") for i in range(3000)]
    got = audited(spark, docs, [(i, 1, 0) for i in range(3000)])
    assert got["s0", "EABCD", 1][1] == 499 and got["s1", "EABCD", 1][1] == 500 and got["s0", "EABCD", 1][4] == 499


def test_a_batch_of_many_terms_works_each_out_once(monkeypatch):
    texts = [" ".join(f"w{(i * 7 + j) % 300}" for j in range(100)) for i in range(40)]
    whole, worked = fingerprints.Sampler()(texts), []
    monkeypatch.setattr(fingerprints, "MOST_HELD", 50)
    plain = fingerprints.samples
    monkeypatch.setattr(fingerprints, "samples", lambda term, *more: worked.append(len(term)) or plain(term, *more))
    assert (fingerprints.Sampler()(texts) == whole).all()
    assert sum(worked) == 300
