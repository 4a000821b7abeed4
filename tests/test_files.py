"""Files in and out: exports of other tools in one folder a run, written layouts, saved and reloaded curves, summaries."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from cosmotab.operators import params
from cosmotab.sources import io

NEW = "M_h_hinv_Msun,M_Msun,R_Mpc,sigma,dlnsigma_dlnM"
OLD = "M_h_inv_Msun,M_Msun,R_Mpc,sigma,dlnsigma_dlnM,window_type"
HMF = "M_h_inv_Msun,hmf_press_schechter_z0,hmf_sheth_tormen_z0,cumulative_press_schechter_z0,cumulative_sheth_tormen_z0"
FIRST, SECOND, THIRD = "0f3b6c1e-55aa-4c0e-9d43-2f1f6a7b8c90", "1a2b3c4d-0000-4000-8000-00000000000b", "run one+two"


def put(folder, name, lines, end="\r\n"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes((end.join(lines) + end).encode())


def test_sigma_of_both_headers_by_name(spark, tmp_path):
    put(tmp_path / "exports" / FIRST, "sigma.csv", [NEW, "100000000.0,147471.5,0.01,4.5,-0.077", "200000000.0,294943.0,0.02,4.25,-0.08"])
    put(tmp_path / "sessions" / "x" / "exports" / SECOND, "sigma.csv", [OLD, "1e8,2e8,0.5,3.5,-0.1,Gaussian", ""])
    put(tmp_path / "exports" / THIRD, "sigma.csv", ["sigma,R_Mpc,dlnsigma_dlnM,M_Msun,M_h_hinv_Msun", "1.5,2.5,-0.5,3.5,4.5"], "\n")  # any order
    rows, rejects = io.import_curves(spark, str(tmp_path))
    got = {(r.run_id, r.m_h): (r.m, r.r, r.sigma, r.dlns, r.window_type, r.header) for r in rows.collect()}
    assert got == {
        (FIRST, 1e8): (147471.5, 0.01, 4.5, -0.077, None, "new"), (FIRST, 2e8): (294943.0, 0.02, 4.25, -0.08, None, "new"),
        (SECOND, 1e8): (2e8, 0.5, 3.5, -0.1, "Gaussian", "old"), (THIRD, 4.5): (3.5, 2.5, 1.5, -0.5, None, "new"),
    }
    assert dict(rows.dtypes)["run_id"] == "string" and rejects.count() == 0


def test_unknown_files_and_broken_lines_are_rejects(spark, tmp_path):
    put(tmp_path / FIRST, "sigma.csv", [NEW, "1.0,2.0,3.0,4.0,5.0", "1.0,2.0,3.0,4.0", "1.0,2.0,x,4.0,5.0"])
    put(tmp_path / FIRST, "hmf.csv", [HMF, "1.0,2.0,3.0,4.0,5.0"])
    put(tmp_path / SECOND, "sigma.csv", [NEW + ",extra", "1,2,3,4,5,6"])
    put(tmp_path / THIRD, "sigma.csv", [NEW.replace("sigma,", "sigma_8,"), "1,2,3,4,5"])
    (tmp_path / THIRD / "empty.csv").write_text("")
    rows, rejects = io.import_curves(spark, str(tmp_path))
    assert [(r.run_id, r.m_h, r.dlns) for r in rows.collect()] == [(FIRST, 1.0, 5.0)]
    found = sorted((os.path.basename(os.path.dirname(r.path)), os.path.basename(r.path), r.line, r.reason.split(":")[0]) for r in rejects.collect())
    assert found == sorted([
        (FIRST, "sigma.csv", 3, "4 cells under 5 names"), (FIRST, "sigma.csv", 4, "a cell is no number"), (FIRST, "hmf.csv", 1, "unknown header"),
        (SECOND, "sigma.csv", 1, "unknown header"), (THIRD, "sigma.csv", 1, "unknown header"),  # an empty file has nothing to read
    ])


def test_mass_functions_and_power_by_name(spark, tmp_path):
    put(tmp_path / FIRST, "hmf.csv", [HMF, "1e8,2e-3,3e-3,4e-2,1e-300"])
    put(tmp_path / FIRST, "power_spectrum.csv", ["k_Mpc^-1,P_Mpc^3,Delta2", "0.1,20000.0,1.5"])
    rows, _ = io.import_hmf(spark, str(tmp_path))
    assert [tuple(r)[:6] for r in rows.collect()] == [(FIRST, 1e8, 2e-3, 3e-3, 4e-2, 1e-300)]
    rows, rejects = io.import_power(spark, [str(tmp_path)])
    assert [tuple(r)[:4] for r in rows.collect()] == [(FIRST, 0.1, 20000.0, 1.5)] and rejects.count() == 1


def test_folders_that_spark_wrote(spark, tmp_path):
    rows = spark.createDataFrame([(7, 1.0, 2.0, 3.0, 4.0, 5.0), (8, 1.0, 2.0, 3.0, 4.0, 6.0)], "run_id bigint, M_h_hinv_Msun double, M_Msun double, R_Mpc double, sigma double, dlnsigma_dlnM double")
    io.write_run_folders(rows, str(tmp_path / "out"))
    back, rejects = io.import_curves(spark, str(tmp_path / "out"))
    assert sorted((r.run_id, r.dlns) for r in back.collect()) == [("7", 5.0), ("8", 6.0)] and rejects.count() == 0


def test_many_run_folders_are_dealt_to_tasks(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("run_id"), *[F.lit(1.0).alias(n) for n in NEW.split(",")])
    io.write_run_folders(rows, str(tmp_path / "out"))
    files = glob.glob(f"{tmp_path}/out/run_id=*/*.csv")
    tasks = [os.path.basename(f).split("-")[1] for f in files]
    assert len(files) == 300 and max(map(tasks.count, set(tasks))) < 200  # small partitions would be joined into one task's
    assert sorted(int(r.run_id) for r in io.import_curves(spark, str(tmp_path / "out"))[0].collect()) == list(range(300))


def test_many_run_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(150):
        put(tmp_path / f"run{i}", "sigma.csv", [NEW, f"{i}.0,2.0,3.0,4.0,5.0"])
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, sc = spark.conf.get(name), spark.sparkContext
    sc.setJobGroup("listing", "listing")
    try:
        rows, rejects = io.import_curves(spark, str(tmp_path))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    stages = [s for j in sc.statusTracker().getJobIdsForGroup("listing") for s in sc.statusTracker().getJobInfo(j).stageIds]
    assert stages and max(sc.statusTracker().getStageInfo(s).numTasks for s in stages) <= io.LISTING_TASKS
    assert spark.conf.get(name) == before
    assert sorted((r.run_id, r.m_h) for r in rows.collect()) == sorted((f"run{i}", float(i)) for i in range(150)) and rejects.count() == 0


def test_odd_bytes_of_exports(spark, tmp_path):
    put(tmp_path / FIRST, "sigma.csv", ["\ufeff" + OLD, "1,2,3,4,5,Dés 日本"], "\n")
    (tmp_path / SECOND).mkdir()
    (tmp_path / SECOND / "sigma.csv").write_bytes(OLD.encode() + b"\r\n1,2,3,4,5,w\xff\r\n")
    rows, rejects = io.import_curves(spark, str(tmp_path))
    got = {r[0]: r[1:] for r in rows.select("run_id", "m_h", F.hex(F.col("window_type").cast("binary"))).collect()}
    assert got == {FIRST: (1.0, "Dés 日本".encode().hex().upper()), SECOND: (1.0, "77EFBFBD")} and rejects.count() == 0


def power(spark, runs, samples):
    n = runs * samples
    return spark.range(n).select(F.expr(f"id div {samples}").alias("run_id"), F.lit(0.0).alias("z"), (F.col("id") % samples + 1.0).alias("k"), F.rand(1).alias("p"))


def test_curves_saved_and_reloaded(spark, tmp_path):
    rows = spark.createDataFrame(power(spark, 50, 40).collect(), "run_id bigint, z double, k double, p double")
    io.write_runs(rows.select("run_id").distinct(), rows, str(tmp_path), rows_per_file=300)
    back = io.read_curves(spark, f"{tmp_path}/curves")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect())) and back.columns == rows.columns
    one = io.read_curves(spark, f"{tmp_path}/curves", 7)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, rows.filter("run_id = 7").collect()))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(run_id,7)" in plan
    assert spark.read.json(f"{tmp_path}/runs").count() == 50


@pytest.mark.parametrize("runs, samples", [(2000, 10), (1, 20_000)])
def test_files_grow_with_the_rows_and_folders_dont(spark, tmp_path, runs, samples):
    rows = power(spark, runs, samples)
    io.write_curves(rows, str(tmp_path / "a"), rows_per_file=2000)
    files = glob.glob(f"{tmp_path}/a/bucket=*/*.parquet")
    assert len(glob.glob(f"{tmp_path}/a/bucket=*")) == min(runs, io.BUCKETS) and 10 <= len(files) <= 10 + 2 * io.BUCKETS
    counts = [r["count"] for r in spark.read.parquet(str(tmp_path / "a")).groupBy(F.input_file_name()).count().collect()]
    assert sum(counts) == runs * samples and max(counts) <= 2000
    io.write_csv(rows, str(tmp_path / "b"), rows_per_file=2000)
    assert io.read_csv(spark, str(tmp_path / "b"), "z double, k double, p double").count() == runs * samples


def test_an_own_dataset_with_other_columns_is_an_error(spark, tmp_path):
    io.write_csv(power(spark, 3, 3), str(tmp_path / "a"))
    with pytest.raises(Exception, match="(?i)header"):
        io.read_csv(spark, str(tmp_path / "a"), "z double, kk double, p double").collect()


def test_stems_of_odd_names(spark):
    names = [" a / b: c?", " :", "x​y", "tab\tand space", "_under_", "a b", "퟿é", "*_*", "  ", "日本 語"]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, x string").select("i", params.safe_stem(F.col("x")).alias("s"))
    got = [r.s for r in rows.orderBy("i").collect()]

    def plain(name):
        import re

        joined = re.sub(r"[\s/\\]+", "_", name.strip())
        return "".join(c for c in joined if c.isprintable() and c not in ':*?"<>|').strip("_") or "run"

    assert got == [plain(n) for n in names]


def test_summary_without_notes_and_bullets(spark):
    row = spark.createDataFrame([("1", "a", "  \n kept \n ", "Top-hat")], "run_id string, name string, notes string, window_type string").withColumn("class_status", F.lit(None).cast("string"))
    text = io.run_summary(params.merge_defaults(row)).first().summary
    assert text.startswith("# a\n\nkept\n\n## Reproducibility\n\n- Backend: UNKNOWN\n- k range: 0.0001 to 200.0 Mpc^-1\n") and text.endswith("\n\n## Notes\n")
    listed = io.run_summary(params.merge_defaults(row).withColumn("bullets", F.array(F.lit("one"), F.lit("two ")))).first().summary
    assert listed.endswith("\n\n## Notes\n\n- one\n- two\n")


def test_stored_tables_are_removed(spark):
    from cosmotab.sources.shared import application_dir, remove_stored, stored

    rows = stored(spark.range(5).toDF("i"))
    folder = application_dir(spark).removeprefix("file://").removeprefix("file:")
    assert rows.count() == 5 and os.listdir(folder)
    remove_stored(spark)
    assert not os.path.exists(folder)
    assert stored(spark.range(3).toDF("i")).count() == 3  # and new ones can be stored again
