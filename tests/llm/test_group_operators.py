"""Operators that join or group rows, held against brute force; and the pipeline."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cosmotab.llm import ann, chat, lines, minhash


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_components(docs, k, num, den):
    sets = {}
    for d, t in docs:
        w = words_of(t)
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and den * common >= num * len(sets[a] | sets[b]):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def corpus(seed=1, groups=12, size=12, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, words))]
        for _ in range(rng.randrange(1, size)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n", "\t "]).join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts + ["", "  ", "One", "one", "a b", "A  b", "é ü", None, texts[0], texts[0].upper()]))


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, num):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {r.doc: (r.n_shingles, r.component) for r in minhash.near_duplicates(df, k=k, num=num).collect()}
    assert got == brute_components(docs, k, num, 100)


def test_near_duplicates_in_one_large_group(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(300)}" for _ in range(80)]
    docs = []
    for i in range(700):
        copy = list(base)
        for _ in range(rng.randrange(12)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(50)}"
        docs.append((i, " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)
    got = {r.doc: (r.n_shingles, r.component) for r in minhash.near_duplicates(df, k=3, num=85).collect()}
    want = brute_components(docs, 3, 85, 100)
    assert got == want


def test_near_duplicates_edge_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc, r.n_shingles, r.component) for r in minhash.near_duplicates(df, k=3).collect()), key=str)
    assert got == sorted([(None, 4, None), (1, 4, 1), (1, 4, 1), (2, 0, 2), (3, 0, 3)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_rows_of_one_id_keep_their_own_links(spark):
    rng = random.Random(4)
    x, y = ([f"{c}{rng.randrange(90)}" for _ in range(60)] for c in "xy")
    near = lambda w: " ".join([*w[:-1], "z"])
    rows = [(1, " ".join(x), "s"), (1, " ".join(y), "s"), (2, near(x), "s"), (3, near(y), "s"), (9, "alone here", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n string").withColumn("component", F.lit("own")).withColumn("node", F.lit(1))
    got = sorted((r.doc, r.component) for r in minhash.near_duplicates(df).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (9, 9)]


def test_index_guarantee():
    """Signatures that differ in fewer than two lanes a chunk share a key of the index itself, and others seldom do."""
    rng = np.random.default_rng(3)
    for chunks in (6, minhash.chunks_for(0.85), minhash.chunks_for(0.5)):
        a = rng.integers(0, 1 << 16, (300, chunks * 4)).astype(np.uint16)
        b = a.copy()
        for row in b:
            row[rng.choice(chunks * 4, 2 * chunks - 1, replace=False)] += 1
        x, y = minhash.index_keys(a, chunks), minhash.index_keys(b, chunks)
        assert (x == y).any(axis=1).all() and not (x == np.roll(y, 1, axis=0)).any()
    with pytest.raises(ValueError):
        minhash.chunks_for(0.05)


def test_lanes_agree_as_often_as_sets_are_similar():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    a = [rng.choice(words) for _ in range(2000)]
    b = a[:1700] + [rng.choice(words) for _ in range(300)]
    h, at = minhash.shingle_sets(pa.array([" ".join(a), " ".join(b)]), 1)
    sets = [set(h[i:j]) for i, j in itertools.pairwise(at)]
    want = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    lanes = minhash.lanes_of(h, at[:-1], 512)
    assert abs((lanes[0] == lanes[1]).mean() - want) < 0.06


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(201, 200), (200, 202)]
    got = {r.node: r.label for r in minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {**{i: 0 for i in range(41)}, **{x: 100 for x in range(100, 160)}, 200: 200, 201: 200, 202: 200}
    assert {**{v: v for v in want.values()}, **got} == want


def brute_lines(docs, least):
    """A line goes if it lies in a run of `least` words or more that equals a run further up or in an earlier document."""
    seqs = {d: [(n, tuple(x.split())) for n, x in enumerate(t.split("\n")) if x.split()] for d, t in docs if t is not None}
    gone = {d: set() for d, _ in docs}
    places = {}  # of each line, in order of documents and lines
    for d in sorted(seqs):
        for i, (_, line) in enumerate(seqs[d]):
            for e, j in places.get(line, []):
                a, b, n = seqs[d], seqs[e], 0
                while i + n < len(a) and j + n < len(b) and a[i + n][1] == b[j + n][1]:
                    n += 1
                if sum(len(a[i + x][1]) for x in range(n)) >= least:
                    gone[d] |= {a[i + x][0] for x in range(n)}
            places.setdefault(line, []).append((d, i))
    for d, seq in seqs.items():
        for (p, _), (q, _) in zip(seq, seq[1:], strict=False):
            if p in gone[d] and q in gone[d]:
                gone[d] |= set(range(p, q))
    return {d: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d]) for d, t in docs}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(6)
    pool = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 5))) for _ in range(12)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9)))) for i in range(60)] + [(100, None), (101, ""), (102, "\n\n"), (103, " ".join("ab" * 200))]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, cuts string, row int").repartition(5)
    for least in (3, 7):
        rows = lines.dedup_lines(df, min_words=least).select("row.doc_id", "row.cuts", "new_text", "n_removed").collect()
        assert {r.doc_id: r.new_text for r in rows} == brute_lines(docs, least)
        assert all(r.cuts == "x" for r in rows) and len(rows) == len(docs)


def test_one_text_of_very_many_lines(spark):
    rng = random.Random(2)
    pool = [f"{rng.randrange(10**9)} x" for _ in range(3000)]
    body = [rng.choice(pool) for _ in range(100_000)]
    again = [x for k in range(0, 99_000, 1000) for x in [f"only {k}", *body[k : k + 40]]]  # 99 repeated runs of 80 words
    df = spark.createDataFrame([(1, "\n".join(body)), (2, "\n".join(again))], "doc_id bigint, text string")
    rows = {r.row.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert rows[2].new_text == "\n".join(f"only {k}" for k in range(0, 99_000, 1000)) and rows[2].n_removed == 99 * 40
    assert rows[1].n_removed < 100_000 and rows[1].n_lines == 100_000


def test_fingerprints_are_few_and_equal_runs_share_one():
    rng = np.random.default_rng(4)
    size, digest = rng.integers(1, 20, 3000), rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    size[2000:2100], digest[2000:2100] = size[500:600], digest[500:600]
    found = lines.fingerprints(size, digest, 50)
    at = {line for line, _, _ in found}
    assert len(at) < 0.6 * len(size) and all(i <= line <= j for line, i, j in found)
    for begin in range(500, 590):
        end = begin + int(np.searchsorted(np.cumsum(size[begin:600]), 50))
        if end < 600:  # every window of the run, and its copy, hold a fingerprint in the same place
            assert {x - begin for x in at if begin <= x <= end} & {x - begin - 1500 for x in at if begin + 1500 <= x <= end + 1500}


def test_line_dedup_edge_rows(spark):
    long = "w " * 60
    rows = [(1, long), (1, long), (2, f"head\n{long}\ntail"), (None, "x"), (3, f"{long}\n{long}"), (4, "short\nshort")]
    got = [(r.doc_id, r.new_text) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).select("row.doc_id", "new_text").collect()]
    assert sorted(got, key=str) == sorted([(1, long), (1, long), (2, "head\ntail"), (None, "x"), (3, ""), (4, "short\nshort")], key=str)
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(20, 32))
    x = (centers[rng.integers(0, 20, 3000)] + 0.4 * rng.normal(size=(3000, 32))).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] * 32), (5003, [1.0]), (5004, [None] * 32), (None, [1.0] * 32), (100, [float(v) for v in x[100]])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = ann.nearest(df, df.filter("vec_id % 20 = 0"), cell_rows=500).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = total = 0
    xd = x.astype(float)
    for q in range(0, 3000, 20):
        s = ann.cosine(xd, xd[q])
        best = sorted((-v, i) for i, v in enumerate(s) if i != q)[:5]
        assert len(found[q]) == 5 and all(v == s[i] for i, v in found[q])
        hits += len({i for _, i in best} & {i for i, _ in found[q]})
        total += 5
    assert hits / total >= 0.9
    assert [i for i, _ in found[100]] == [101, 102, 103, 104, 105]
    assert set(found) == set(range(0, 3000, 20))
    assert sum({r.query_id: r.verified for r in got}.values()) < 0.5 * 150 * 3000  # of 20 clusters most are never verified
    tiny = spark.createDataFrame(rows[:3], df.schema)
    assert ann.nearest(tiny, tiny).count() == 6 and ann.nearest(tiny.limit(0), tiny.limit(0)).count() == 0


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 3, None, "x"), (1, None, "ann", "first"), (2, 0, "system", "alone"), (None, 5, "eve", "q"), (1, 1, "ann", "hi <|end|>")]
    rows += [(3, t, "ab"[t % 2], "t" * (t % 7)) for t in range(400)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, segment string")
    got = chat.perspectives(df).collect()
    assert {(r.conv_id, r.perspective) for r in got} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "eve"), (3, "a"), (3, "b")}
    for conv, who in {(r.conv_id, r.perspective) for r in got}:
        own = sorted((r for r in got if (r.conv_id, r.perspective) == (conv, who)), key=lambda r: r.seg_start)
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "unknown", r[3] or ""))
        place, whole = 0, ""
        for r, (_, turn, role, text) in zip(own, turns, strict=True):
            role, text = role or "unknown", (text or "").replace("<|", "< |")
            head = "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == who else f"<|user name={role}|>\n"
            assert (r.turn, r.segment, r.seg_start) == (turn, f"{head}{text}<|end|>\n", place)
            whole += r.segment
            place = r.seg_end
            assert r.trained == (role == who)
            assert (whole[r.mask_start : r.mask_end] if r.trained else None) == (f"{text}<|end|>\n" if role == who else None)
        assert place == len(whole)


def test_perspectives_of_an_empty_table(spark):
    assert chat.perspectives(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, one id with several texts, clashing names, very long texts and empty tables."""
    import corpus_pipeline

    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["th", "er", "an", "on", "tion"]) for _ in range(rng.randrange(1, 4)))
    a, b = " ".join(word() for _ in range(40)), " ".join(word() for _ in range(40))
    long = " ".join(word() for _ in range(60_000))
    rows = [(1, a), (5, f"{a} end"), (5, b), (7, b), (7, b), (None, f"{a} more"), (None, None), (8, None), (8, ""), (9, long)]
    schema = "doc_id bigint, text string, lang string, row string, node string, component string, cuts string, n_words string, _doc string"
    df = spark.createDataFrame([(*r, "en", *"abcdef") for r in rows], schema)
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, df, str(tmp_path))
        found[name] = sorted(((r.doc_id, r.text) if "text" in r else (r.doc_id, r.n_tokens) for r in made.collect()), key=str)
        assert name == "bpe" or made.columns == df.columns
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    texts = [r for r in rows if r[1]]
    assert found["language_id"] == sorted(texts, key=str)
    assert found["line_dedup"] == found["decontamination"] == sorted(rows, key=str)
    assert found["near_dedup"] == sorted([r for r in rows if r not in ((5, f"{a} end"), (7, b))], key=str)
    assert len(found["bpe"]) == len(rows) and all(n == 0 for _, n in found["bpe"] if n is not None and n == 0)


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline
    from cosmotab.llm import stages

    rng = random.Random(12)
    vocabulary = ["".join(rng.choice(["th", "er", "an", "on", "tion"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, item = line(60), line(30)
    texts = [f"{line(40)}\n{line(30)}" for _ in range(30)]
    texts += [f"{line(20)}\n{passage}" for _ in range(4)] + [f"{line(25)} {item}" for _ in range(2)] + [texts[0], texts[1] + " more", "123 456", "", None]
    docs = [(i, t, "en", f"s{i % 3}", len(t or ""), "own") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {d: t for d, t, *_ in docs if t and any(c.isalpha() for c in t)}
    clean = brute_lines(list(left.items()), lines.MIN_WORDS)
    left = {d: t for d, t in clean.items() if t.strip() or t == left[d]}
    same = brute_components(list(left.items()), 5, 80, 100)
    left = {d: t for d, t in left.items() if same[d][1] == d}
    left = {d: t for d, t in left.items() if item not in t}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(left)
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words"]
    assert {r.doc_id: r.text for r in df.collect()} == left
    assert stages.MIN_LANGUAGE_SCORE < 0.5
