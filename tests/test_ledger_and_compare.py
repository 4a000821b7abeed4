"""Ledger operations, comparison with a baseline, fields, files."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cosmotab.operators import compare, field, ledger, params
from cosmotab.sources import io

DAY = dt.datetime(2024, 1, 1)


def ledger_rows(spark, names):
    return spark.createDataFrame([(i, n, DAY + dt.timedelta(minutes=i)) for i, n in enumerate(names)], "run_id bigint, name string, created_at timestamp")


def test_unique_names(spark):
    rows = ledger_rows(spark, ["Run 001 — Baseline LCDM", " A ", "A", "A  ", "A (2)", "", None, "B"])
    taken = spark.createDataFrame([("Run 001 — Baseline LCDM",), ("Run 001 — Baseline LCDM (2)",), ("B",)], "name string")
    got = [r.unique_name for r in ledger.unique_names(rows, taken).orderBy("run_id").collect()]
    assert got == ["Run 001 — Baseline LCDM (3)", "A", "A (3)", "A (4)", "A (2)", "Untitled run", "Untitled run (2)", "B (2)"]


def test_one_baseline(spark):
    rows = ledger_rows(spark, "abc").withColumn("is_baseline", F.col("run_id") > 0)
    flagged = lambda df: [r.run_id for r in df.filter("is_baseline").collect()]
    assert flagged(ledger.assign_baseline(rows)) == [1]
    assert flagged(ledger.assign_baseline(rows, 2)) == [2]
    assert flagged(ledger.assign_baseline(rows.withColumn("is_baseline", F.lit(False)))) == [0]


def test_edits(spark):
    rows = ledger_rows(spark, ["a", "b", "c"]).withColumns({"is_baseline": F.col("run_id") == 0, "exports": F.create_map(F.lit("k"), F.lit("v"))})
    edits = spark.createDataFrame([(0, "delete", None), (1, "rename", " c "), (2, "duplicate", "9"), (7, "delete", None)], "run_id bigint, action string, argument string")
    got = {r.run_id: r for r in ledger.apply_edits(rows, edits).collect()}
    assert {i: r.name for i, r in got.items()} == {1: "c", 2: "c (2)", 9: "Copy of c"}
    assert [i for i, r in got.items() if r.is_baseline] == [1] and got[9].exports is None


def test_lookups(spark):
    rows = ledger_rows(spark, "abcd").withColumn("cache_key", F.col("run_id") % 2)
    assert ledger.run_duplicates(rows).count() == 2
    assert ledger.cache_misses(rows, rows.filter("run_id = 0")).count() == 2
    ask = spark.createDataFrame([("x", 1), ("y", 77)], "owner string, run_id bigint")
    assert {r.owner: r.resumed for r in ledger.resume_run(ask, rows).collect()} == {"x": 1, "y": 3}
    assert [r.run_id for r in ledger.latest_runs(rows).collect()] == [3, 2, 1]


def curves(spark):
    rows = [("P(k)", r, "", "", z, float(x), float((r + 1) * x)) for r in range(3) for z in (0.0, 1.0) for x in (1, 2, 4)]
    rows += [("HMF", r, w, f, 0.0, float(x), float(x + r)) for r in range(2) for w in ("G", "T") for f in ("PS", "ST") for x in (1, 2) if (r, w, f) != (0, "T", "ST")]
    return spark.createDataFrame(rows, "metric string, run_id bigint, window_type string, fit string, z double, x double, y double")


def test_baseline_with_itself(spark):
    for mode, want in (("ratio", 1.0), ("fractional", 0.0), ("percent", 0.0)):
        rows = compare.compare(curves(spark), 0, mode).filter("run_id = 0").collect()
        assert rows and all(r.value == pytest.approx(want, abs=1e-12) for r in rows)
    ratio = compare.compare(curves(spark), 0, "ratio").filter("metric = 'P(k)' and run_id = 2").collect()
    assert all(r.value == pytest.approx(3) for r in ratio)


def test_baseline_fallback(spark):
    got = {(r.run_id, r.window_type, r.fit): (r.base_window, r.base_fit) for r in compare.baseline_match(curves(spark), 0).filter("metric = 'HMF'").collect()}
    assert got[1, "T", "PS"] == ("T", "PS") and got[1, "T", "ST"] == ("G", "PS")


def test_common_redshifts_and_cap(spark):
    samples = spark.createDataFrame([(1, 0.0), (1, 1.0), (2, 0.0), (2, 0.0)], "run_id bigint, z double")
    assert [r.z for r in compare.common_z(samples).collect()] == [0.0]
    assert compare.curve_cap(curves(spark), 2).select("metric", "run_id", "window_type", "fit").distinct().count() == 4


def test_field_statistics(spark):
    cells = spark.createDataFrame([(r, i // 4, i % 4, float((r + 1) * ((i * 7) % 5 - 2))) for r in range(2) for i in range(16)], "run_id bigint, ix bigint, iy bigint, delta double")
    got = {r.run_id: r for r in field.field_stats(cells, 0).collect()}
    assert got[0].rms_ratio == pytest.approx(1) and got[1].rms_ratio == pytest.approx(2) and got[1].correlation == pytest.approx(1)
    assert got[0].difference_ratio == pytest.approx(0, abs=1e-12)
    assert field.field_cut(cells, 4).count() == 8


def test_read_runs_keeps_the_broken_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"run_id": "1", "run_name": "x",\n "params": {"H0": 70.0}}')
    (tmp_path / "b.json").write_text('{"run_id": "2", "name": "y", "is_baseline": true}')
    (tmp_path / "c.json").write_text("{broken")
    runs, rejects = io.read_runs(spark, str(tmp_path))
    got = {r.run_id: r for r in runs.collect()}
    assert got["1"].name == "x" and got["1"].params.H0 == 70.0 and got["1"].visible and not got["1"].is_baseline and got["2"].is_baseline
    assert rejects.count() == 1


def test_validation(spark):
    bad = spark.createDataFrame([(1, 0.5, 1e-4), (2, 0.04, 0.0), (3, 0.04, 1e-4)], "run_id bigint, Omega_b double, k_min double")
    good, rejected = params.validate_params(params.merge_defaults(bad))
    assert [r.run_id for r in good.collect()] == [3]
    assert {r.run_id: len(r.violations) for r in rejected.collect()} == {1: 1, 2: 1}
    assert {(r.run_id, r.param) for r in params.range_audit(bad).collect()} == {(1, "Omega_b"), (2, "k_min")}


def test_one_name_on_very_many_runs(spark):
    n = 50_000
    rows = spark.range(n).select(F.col("id").alias("run_id"), F.lit(" Baseline  LCDM").alias("name"), F.timestamp_seconds(F.col("id") * 600).alias("created_at"))
    taken = spark.createDataFrame([(f"Baseline LCDM ({k})",) for k in (3, 4, 9, 70_000)] + [("other (2)",)], "name string")
    names = {r.run_id: r.unique_name for r in ledger.unique_names(rows, taken).collect()}
    free = (k for k in range(2, n + 10) if k not in (3, 4, 9))
    assert names == {0: "Baseline LCDM", **{i: f"Baseline LCDM ({next(free)})" for i in range(1, n)}}


def test_names_that_others_want_and_odd_rows(spark):
    rows = [(1, "a", 1), (2, "a", 2), (3, "a (2)", 3), (4, "a", 4), (5, None, None), (6, " ", 5), (7, "a (2)", 6), (8, "a (02)", 7)]
    df = spark.createDataFrame(rows, "run_id bigint, name string, s bigint").select("run_id", "name", F.timestamp_seconds("s").alias("created_at"))
    names = {r.run_id: r.unique_name for r in ledger.unique_names(df).collect()}
    assert names == {1: "a", 2: "a (3)", 3: "a (2)", 4: "a (4)", 5: "Untitled run", 6: "Untitled run (2)", 7: "a (2) (2)", 8: "a (02)"}
    assert ledger.unique_names(df.limit(0)).count() == 0


def test_quantile_equals_percentile(spark):
    rng = random.Random(1)
    rows = [(m, rng.choice([0.0, 1.0, rng.random() * 10 ** rng.randrange(-9, 9)]) if rng.random() > 0.1 else None) for m in "aab" for _ in range(rng.randrange(1, 400))] + [("c", 2.0), ("d", None)]
    df = spark.createDataFrame(rows, "m string, v double")
    for share in (0.5, 0.99):
        want = {r.m: r.p for r in df.groupBy("m").agg(F.percentile("v", F.lit(share)).alias("p")).collect()}
        got = {r.m: r.p for r in compare.quantile(df, ["m"], "v", share, "p").collect()}
        assert got.keys() == {"a", "b", "c"} and all(abs(got[m] - want[m]) <= 1e-12 * abs(want[m]) for m in got)
    assert {r.metric: r.extent for r in compare.residual_extent(df.select(F.col("m").alias("metric"), F.col("v").alias("value"))).collect()}["d"] == 1e-4


@pytest.mark.parametrize("bound", [200_000, 1])
def test_a_thousand_runs_of_one_curve(spark, bound):
    curves = spark.range(1000 * 8).select(
        F.lit("P(k)").alias("metric"), F.expr("id div 8").alias("run_id"), F.lit("").alias("window_type"), F.lit("").alias("fit"), F.lit(0.0).alias("z"),
        (F.col("id") % 8 + 1.0).alias("x"), (F.expr("id div 8") + 1.0).alias("y"),
    )
    rows = compare.compare(curves, 4, "ratio", most=bound).collect()
    assert len(rows) == 8000 and all(abs(r.value - (r.run_id + 1) / 5) < 1e-9 for r in rows)


def test_nearest_z_answers_from_the_samples_alone(spark):
    ask = spark.createDataFrame([(1, 0.4, 99.0)], "run_id bigint, z double, z_used double")
    samples = spark.createDataFrame([(1, 0.0), (1, 0.5)], "run_id bigint, z double")
    assert [r.z_used for r in compare.nearest_z(ask, samples).collect()] == [0.5]


def test_numbers_of_very_many_runs_with_ties(spark):
    n = 200_000
    rows = spark.range(n).select(((F.col("id") * 7919) % n).alias("run_id"), F.timestamp_seconds(((F.col("id") * 7919) % n) % 5).alias("created_at"))  # five instants hold all runs
    numbered = ledger.run_numbering(rows, block_rows=20_000)
    order = sorted(range(n), key=lambda i: (i % 5, i))
    assert sorted((r.number, r.run_id, r.color) for r in numbered.collect()) == [(k + 1, i, k % 5) for k, i in enumerate(order)]
    assert ledger.run_numbering(rows.limit(0)).count() == 0


def test_blocks_are_bounded(spark):
    rows = spark.range(200_000).select(F.col("id").alias("run_id"), F.lit("one name").alias("name"), F.timestamp_seconds(F.col("id") % 60).alias("created_at"))
    sizes = [r["count"] for r in ledger.in_blocks(rows, ["name", "created_at", "run_id"], 20_000).groupBy("_block").count().collect()]
    assert sum(sizes) == 200_000 and len(sizes) >= 9 and max(sizes) < 40_000
    named = ledger.unique_names(rows, block_rows=20_000)
    assert named.filter("unique_name = 'one name'").first().run_id == 0
    by_order = {r.run_id: r.unique_name for r in named.filter("run_id < 121 or run_id > 199990").collect()}
    place = lambda i: i % 60 * 3333 + min(i % 60, 20) + i // 60  # noqa: E731  200,000 = 3333 * 60 + 20
    assert by_order == {i: "one name" if not place(i) else f"one name ({place(i) + 1})" for i in by_order}
    assert named.select("unique_name").distinct().count() == 200_000


def test_no_unpartitioned_window_is_left():
    import re
    from pathlib import Path

    texts = {p.name: p.read_text() for p in (Path(__file__).resolve().parents[1] / "cosmotab").rglob("*.py")}
    assert not [n for n, t in texts.items() if re.search(r"(?<![\w)])(W|Window)\.orderBy", t)]


def test_every_row_with_every_run_in_shares(spark, monkeypatch):
    from cosmotab.operators import pairing

    monkeypatch.setattr(pairing, "SHARE_ROWS", 7)
    monkeypatch.setattr(pairing, "SHARE_RUNS", 5)
    rows, runs = spark.range(50).select((F.col("id") / 2).alias("x")), spark.range(23).select(F.col("id").alias("run_id"))
    for most in (10**6, 3):
        got = [(r.run_id, r.x) for r in pairing.with_each_run(rows, runs, most).collect()]
        assert sorted(got) == [(i, j / 2) for i in range(23) for j in range(50)]
    assert pairing.with_each_run(rows.limit(0), runs, 3).count() == 0


def test_modes_of_a_crowded_shell(spark):
    modes = spark.range(300).select(F.col("id").alias("mode_id"), F.when(F.col("id") % 10 == 0, 0.0).when(F.col("id") % 3 > 0, 0.5).otherwise((F.col("id") % 7) / 10.0).alias("kk"), F.lit(2.0).alias("re"), F.lit(-1.0).alias("im"))
    power = spark.range(40).select(F.expr("id div 4").alias("run_id"), (F.col("id") % 4 + 1.0).alias("i")).select("run_id", (F.col("i") / 5.0).alias("k"), (F.col("run_id") + 1.0).alias("p"))
    plain = {(r.mode_id, r.run_id): (r.re, r.im) for r in field.mode_filter(modes, power, 8, 100.0, 1.0).collect()}
    shared = {(r.mode_id, r.run_id): (r.re, r.im) for r in field.mode_filter(modes, power, 8, 100.0, 1.0, share_rows=9, share_runs=3).collect()}
    assert len(plain) == 3000 and plain == shared
    want = lambda m, r: 0.0 if m % 10 == 0 or (m % 3 == 0 and not 2 <= m % 7 <= 8) else (8 / 100.0) ** 1.5 * (r + 1) ** 0.5
    for (m, r), (re, im) in plain.items():
        kk = 0.0 if m % 10 == 0 else 0.5 if m % 3 else m % 7 / 10
        assert re == pytest.approx(2 * want(m, r) * 2.718281828459045 ** (-kk * kk / 2)) and im == pytest.approx(-re / 2)


def test_fields_of_a_large_baseline_in_shares(spark):
    cells = spark.createDataFrame([(r, i // 4, i % 4, float((r + 1) * ((i * 7) % 5 - 2))) for r in range(5) for i in range(16)], "run_id bigint, ix bigint, iy bigint, delta double")
    for f in (field.field_normalize, field.field_stats):
        one, two = (sorted(tuple(round(x, 9) for x in r) for r in f(cells, 1, most=n).collect()) for n in (100, 3))
        assert one == two
