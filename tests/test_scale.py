"""Tables that fan out from a small file are worked on in as many tasks as their rows ask for."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from cosmotab.plans import queries as plans  # noqa: E402
from cosmotab.plans.fixtures import table  # noqa: E402

DATA = Path("/root/testdata/sf0.1")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_fit_atlas_is_dealt_to_tasks(spark):
    assert most_in_a_task(plans.Q["fit_atlas"](spark, str(DATA))) < 200 * 500 * 13  # of 1,000 runs


def test_rounding_by_scaling(spark):
    rows = spark.range(-3000, 3000).select((F.sin("id") * 1000.0).alias("x")).select(plans.r8("x").alias("a"), (F.round("x", 8) + 0.0).alias("b"))
    assert rows.filter("a <> b or a is null").count() == 0
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-0.0,)], "x double").select(plans.r8("x").alias("a")).collect()
    assert odd[0].a is None and str(odd[1].a) == "nan" and odd[2].a == float("inf") and str(odd[3].a) == "0.0"


def test_power_quality_is_dealt_to_tasks(spark):
    rows = table(spark, str(DATA), "fx_power_dirty").groupBy(F.spark_partition_id()).agg(F.count_distinct("run_id").alias("n"))
    assert rows.agg(F.max("n")).first()[0] < 200  # of 1,000 runs


def test_power_quality_keeps_the_deal_where_the_table_of_k_is_large(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2k")
    try:
        rows = plans.Q["power_quality"](spark, str(DATA))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert rows.agg(F.sum("samples")).first()[0] == table(spark, str(DATA), "fx_power_dirty").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "hashpartitioning(run_id#" in plan
    assert not [line for line in plan.splitlines() if "hashpartitioning" in line and "REPARTITION_BY_NUM" not in line]


def test_hmf_cumulative_shuffles_runs_alone(spark):
    plan = plans.Q["hmf_cumulative"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "hashpartitioning(run_id" in plan
    assert not [line for line in plan.splitlines() if "hashpartitioning" in line and "REPARTITION_BY_NUM" not in line]


def test_tails_of_one_redshift_are_those_of_all(spark):
    small = "/root/testdata/sf0.001"
    rounded = lambda df: sorted(map(tuple, df.select("run_id", "fit", "z", plans.rl("m_h"), plans.rl("hmf"), plans.rl("n_gt_m")).collect()))
    one = rounded(plans.tails(spark, small, where="z = 0"))
    assert one and one == rounded(plans.tails(spark, small).filter("z = 0"))


def test_compare_does_not_shuffle_the_curves(spark):
    from cosmotab.operators import compare

    keys = "'HMF' as metric, {0} as run_id, 'w' as window_type, {1} as fit, 0e0 as z, {2} as x, {3} as y"
    lines = [keys.format(1, "'a'", x, f"{x}*{x}") for x in ("1e0", "2e0", "4e0", "9e0")]  # y = x^2, exact in logarithms
    lines += [keys.format(2, "'a'", x, "1e0") for x in ("0.5e0", "1e0", "3e0", "9e0", "20e0")] + [keys.format(3, "'b'", x, "1e0") for x in ("-1e0", "3e0")]
    curves = spark.sql(" union all ".join(f"select {x}" for x in lines)).localCheckpoint()
    whole = compare.compare(curves, 1, "ratio")
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("BroadcastExchange")[0] and "_s AS" not in plan
    got = {(r.run_id, r.x): round(1 / r.value, 6) for r in whole.filter("run_id > 1").collect()}
    # run 3 has an x below 0, so its curve is linear
    assert got == {(2, 0.5): 1.0, (2, 1.0): 1.0, (2, 3.0): 9.0, (2, 9.0): 81.0, (2, 20.0): 81.0, (3, -1.0): 1.0, (3, 3.0): 10.0}
    shuffled = {(r.run_id, r.x): round(1 / r.value, 6) for r in compare.compare(curves, 1, "ratio", most=1).filter("run_id > 1").collect()}
    assert shuffled == got


def test_mode_filter_packs_what_it_shuffles(spark, tmp_path):
    for n in ("part", "nation"):
        spark.read.parquet(f"{DATA}/{n}.parquet").limit(2000).write.parquet(f"{tmp_path}/{n}.parquet")
    spark.read.parquet(f"{DATA}/supplier.parquet").limit(20).write.parquet(f"{tmp_path}/supplier.parquet")
    rows = plans.Q["mode_filter"](spark, str(tmp_path))
    assert rows.count() == 2000 * 20
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "_runs" in plan and "_modes" in plan and "Generate inline" in plan


def test_mode_filter_fans_out_a_mode_at_a_time_in_the_tasks_it_is_dealt_to(spark, monkeypatch):
    from cosmotab.operators import field

    monkeypatch.setattr(field, "ROWS_A_TASK", 1000)
    modes = spark.range(600).select(F.col("id").alias("mode_id"), (F.col("id") % 50 / 10.0).alias("kk"), (F.col("id") + 1.0).alias("re"), F.lit(-1.0).alias("im"))
    power = spark.range(160).select(F.expr("id div 4").alias("run_id"), (F.pow(F.lit(10.0), F.col("id") % 4 - 2.0)).alias("k"), (F.expr("id div 4") + 1.0).alias("p"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        rows = field.mode_filter(modes, power, 8, 100.0, 0.0, share_rows=5, share_runs=3)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        moving = rows.filter("re <> 0").groupBy(F.spark_partition_id()).count().collect()
        got = {(r.mode_id, r.run_id): (r.re, r.im) for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above, below = plan.split("SortMergeJoin", 1)
    assert above.count("Generate ") == 1 and "Generate inline(_runs" in above  # one mode's rows of one packed row of runs at a time
    assert "ENSURE_REQUIREMENTS" not in below.split("REPARTITION_BY_NUM")[0]  # not shuffled again
    assert len(moving) > 10 and max(r["count"] for r in moving) < 600 * 40 / 5  # 24 tasks, not spark.sql.shuffle.partitions
    factor = 0.08**1.5
    assert len(got) == 600 * 40
    for (m, r), (re, im) in got.items():
        a = factor * (r + 1) ** 0.5 if m % 50 else 0.0
        assert abs(re - (m + 1) * a) < 1e-9 * (m + 1) and abs(im + a) < 1e-9
