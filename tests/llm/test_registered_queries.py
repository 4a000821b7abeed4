"""The registered queries on the smallest tables: their columns and row counts, SQL where there is some, recall, accuracy."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from cosmotab.llm.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
COLUMNS = {
    "op2_minhash": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op5_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op6_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_nearest_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op8_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op11_alignment": {"doc_id": "bigint", **{c: "bigint" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")}, "groups_sha256": "string"},
    "op12_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op13_filter_audit": {"part": "string", "filter_order": "string", "step": "int", **{c: "bigint" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}},
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_columns_and_rows(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    kinds = dict(df.dtypes)
    for column, kind in COLUMNS.get(name, {}).items():
        assert kinds[column] == kind
    rows = df.collect()
    if name in ORACLE_SQL:
        found = duck.execute(ORACLE_SQL[name])
        order = [x[0] for x in found.description]
        key = lambda r: tuple(map(str, r))
        assert sorted((tuple(r[c] for c in order) for r in rows), key=key) == sorted(found.fetchall(), key=key)
    elif name == "op7_nearest_neighbours":
        v = dict(duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall())
        x = {i: np.array(e, np.float64) for i, e in v.items()}
        hits = total = 0
        for q in (i for i in x if i % 50 == 0):
            score = {i: -float(x[i] @ x[q] / np.linalg.norm(x[i]) / np.linalg.norm(x[q])) for i in x if i != q}
            best = sorted(score, key=lambda i: (score[i], i))[:5]
            hits += len(set(best) & {r.vec_id for r in rows if r.query_id == q})
            total += len(best)
        assert hits / total >= 0.9
    else:
        assert len(rows) == duck.execute("SELECT count(*) FROM documents").fetchall()[0][0]
    if name == "op6_language_id":
        truth = dict(duck.execute("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL").fetchall())
        assert np.mean([truth[r.doc_id] == r.lang_pred for r in rows if r.held_out and r.doc_id in truth]) > 0.95


def test_registered_queries_equal_brute_force(spark, duck):
    """op2, op3, op5, op8 and op10 as registered, over the given tables, against the plain definitions."""
    import hashlib

    from test_group_operators import brute_components, brute_lines
    from test_text_operators import brute_windows, plain_rules
    from tokenizers import Tokenizer

    from cosmotab.llm.queries import tokenizer_path

    docs = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    duck.execute(f"CREATE OR REPLACE VIEW benchmark AS SELECT * FROM '{DATA}/benchmark.parquet'")
    items = [(str(i), t) for i, t in duck.execute("SELECT item_id, text FROM benchmark").fetchall()]
    run = lambda name: {r.doc_id: r for r in QUERIES[name](spark, str(DATA)).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = brute_components(docs, 3, 85, 100)
    assert {d: (r.n_shingles, r.component_id) for d, r in run("op2_minhash").items()} == want
    want = brute_lines(docs, 50)
    assert {d: r.text for d, r in run("op3_line_dedup").items()} == want
    spans = {d: ",".join(f"{k}:{a}:{b}" for a, b, k in plain_rules(t or "")) for d, t in docs}
    assert {d: r.base_sha256 for d, r in run("op5_pii").items()} == {d: sha(s.encode()) for d, s in spans.items()}
    public = Tokenizer.from_file(tokenizer_path())
    found = run("op8_bpe")
    for d, t in docs:
        ids = public.encode(t or "", add_special_tokens=False).ids
        assert (found[d].n_tokens, found[d].ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
    found = run("op10_decontamination")
    for d, t in docs:
        n, hit, ids = brute_windows(t, items)
        assert (found[d].n_words, found[d].n_hit, found[d].n_items, found[d].items_sha256) == (n, hit, len(ids), sha(",".join(ids).encode()))


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="needs the test tables")
def test_toxicity_on_held_out_rows(spark, duck):
    """Held-out quality with the 336 toxic documents that sf0.1 gives to learn from; more of them do better (see README)."""
    rows = QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.1").filter("held_out").collect()
    toxic = dict(duck.execute("SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").fetchall())
    bad = np.array([r.score for r in rows if toxic.get(r.doc_id) == 1])
    good = np.array([r.score for r in rows if toxic.get(r.doc_id) == 0])
    area = np.mean([(x > good).mean() + (x == good).mean() / 2 for x in bad])
    assert area > 0.95 and (good >= 0.3).mean() < 0.02 and (bad >= 0.3).mean() > 0.8
