"""Input tables derived from the given ones: smooth synthetic spectra of parameter sweeps (no physics claim).

The texts run in Spark and in DuckDB alike; braces name the tables they read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmotab.operators.pairing import shares

#: name -> (text, tables it reads)
TEXTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "fx_run": (
        """SELECT s_suppkey AS run_id, s_name AS name, 55e0+(s_suppkey*7919 % 2501)/100e0 AS H0, 0.2e0+(s_suppkey*104729 % 251)/1000e0 AS Omega_m,
  0.035e0+(s_suppkey*1299709 % 301)/10000e0 AS Omega_b, 0.9e0+(s_suppkey*15485863 % 151)/1000e0 AS n_s, (0.5e0+(s_suppkey*32452843 % 301)/100e0)*1e-9 AS A_s,
  s_nationkey % 2 = 0 AS enable_ede, 1704067200 + s_suppkey*60 AS created_s FROM {supplier}""",
        ("supplier",),
    ),
    "fx_dirty": (
        """SELECT c_custkey AS run_id, CASE WHEN c_custkey % 29 = 0 THEN '   ' WHEN c_custkey % 7 = 0 THEN concat('  ', c_mktsegment, '   x ') WHEN c_custkey % 31 = 0 THEN concat(c_mktsegment, ' (3)') ELSE c_mktsegment END AS name,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (0.3e0+(c_custkey*7919 % 400)/100e0)*1e-9 END AS A_s, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 0.88e0+(c_custkey*104729 % 200)/1000e0 END AS n_s,
  50e0+(c_custkey*15485863 % 3500)/100e0 AS H0, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 0.15e0+(c_custkey*1299709 % 350)/1000e0 END AS Omega_m,
  0.02e0+(c_acctbal+1000e0)/40000e0 AS Omega_b, c_custkey % 2 = 0 AS enable_ede, (c_custkey*31 % 45)/100e0 AS f_EDE, -5e0+(c_custkey*37 % 300)/100e0 AS log10_a_c,
  CASE WHEN c_custkey % 19 = 0 THEN 0e0 ELSE 1e-4 END AS k_min, CASE WHEN c_custkey % 23 = 0 THEN 5e-5 ELSE 200e0 END AS k_max, CAST(20+(c_custkey*41 % 3200) AS INT) AS k_points,
  8e0+(c_custkey % 9) AS mass_min_exp, 12e0+(c_custkey % 5) AS mass_max_exp, CAST(10+(c_custkey*43 % 260) AS INT) AS mass_points, 7e0+(c_custkey % 11) AS selected_mass_exp,
  -1e0+(c_custkey % 7) AS single_z, (c_custkey % 5)-1e0 AS z_extra, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'OK' END AS class_status, 1704067200 + c_custkey*60 AS created_s FROM {customer}""",
        ("customer",),
    ),
    "fx_k": ("SELECT p_partkey AS ki, pow(10e0, -4e0+p_partkey*(log10(200e0)+4e0)/64e0) AS k FROM {part} WHERE p_partkey < 65", ("part",)),
    "fx_mass": ("SELECT pow(10e0, 8e0+n_nationkey*7e0/24e0) AS m_h FROM {nation}", ("nation",)),
    "fx_z": ("SELECT run_id, z FROM {fx_run} CROSS JOIN (VALUES (0, 0e0), (1, 0.5e0), (2, 1e0), (3, 2e0), (4, 5e0), (5, 10e0)) AS t(i, z) WHERE i = 0 OR run_id % 7 <> i", ("fx_run",)),
    "fx_power": (
        "SELECT r.run_id, r.z, ki, k, 25000e0*(A_s/2.1e-9)*pow(k/0.02e0, n_s)/pow(1e0+pow(k/0.02e0, 2e0), 2e0)/pow(1e0+z, 2e0) AS p FROM {fx_z} r JOIN {fx_run} u ON r.run_id = u.run_id CROSS JOIN {fx_k}",
        ("fx_z", "fx_run", "fx_k"),
    ),
    "fx_power_dirty": (
        """SELECT run_id, z, CASE WHEN run_id % 5 = 3 AND ki = 40 THEN (SELECT max(k) FROM {fx_k} WHERE ki = 39) ELSE k END AS k,
  CASE WHEN run_id % 5 = 2 AND ki = 10 THEN -p WHEN run_id % 5 = 4 AND ki = 20 THEN NULL ELSE p END AS p FROM {fx_power} WHERE run_id % 5 <> 1 OR ki < 6""",
        ("fx_power", "fx_k"),
    ),
    "fx_growth": ("SELECT run_id, z, 1e0/(1e0+z) AS growth FROM {fx_z}", ("fx_z",)),
    "fx_sigma": ("SELECT l_orderkey, l_linenumber, pow(10e0, -0.7e0+((l_orderkey*7+l_linenumber) % 512)*1.2e0/511e0) AS sigma, CASE WHEN l_linenumber % 4 = 0 THEN 0e0 WHEN l_linenumber % 4 = 1 THEN 0.5e0 WHEN l_linenumber % 4 = 2 THEN 2e0 ELSE 7e0 END AS z FROM {lineitem}", ("lineitem",)),
    "fx_order_curve": ("SELECT o_custkey AS curve, CAST(o_orderkey+1 AS DOUBLE) AS x, o_totalprice AS y FROM {orders}", ("orders",)),
    "fx_event_point": ("SELECT event_id, user_id AS curve, CAST(event_id*3+1 AS DOUBLE) AS x, value FROM {events}", ("events",)),
    "fx_event_text": ("SELECT event_id, concat(CAST(event_id % 40 AS VARCHAR(9)), '.5, ', event_type, ' ,-', CAST(event_id % 9 + 1 AS VARCHAR(9)), ', ,', CAST(event_id % 13 AS VARCHAR(9))) AS text FROM {events}", ("events",)),
}

#: The redshifts that fx_z deals out.
REDSHIFTS = (0.0, 0.5, 1.0, 2.0, 5.0, 10.0)


#: Fixtures of runs: a small file, one or two tasks when it is read, from which each row fans out to thousands (redshifts,
#: samples, masses, fits). They are dealt by run_id first, so many rows a task; what fans out keeps that partitioning.
DEALT = {"fx_run": 128, "fx_dirty": 4096}
#: Fixtures of a fixed number of rows out of tables that grow. Spark goes by the size of their file, and beyond the threshold
#: for broadcasts would take a Cartesian product, which loses how the runs are dealt; so they are broadcast by name.
FIXED = ("fx_k", "fx_mass")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or the fixture of this name."""
    if name not in TEXTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text, reads = TEXTS[name]
    rows = spark.sql(text, **{t: table(spark, sf_dir, t) for t in reads})
    if name in FIXED:
        return F.broadcast(rows)
    return rows.repartition(shares(rows.count(), DEALT[name]), "run_id") if name in DEALT else rows


def runs(spark: SparkSession, sf_dir: str, name: str = "fx_run") -> DataFrame:
    """fx_run or fx_dirty with created_at, and z_values for the latter."""
    df = table(spark, sf_dir, name).withColumn("created_at", F.timestamp_seconds("created_s"))
    return df.withColumn("z_values", F.array(F.lit(0.0), F.col("z_extra"))) if name == "fx_dirty" else df


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 slice a label: the mean of its vectors' components."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("run_id"), F.posexplode("embedding").alias("pos", "v"))
    slim = e.groupBy("run_id", "pos").agg(F.avg(F.col("v").cast("double")).alias("delta"))
    return slim.select("run_id", F.expr("pos div 8").cast("bigint").alias("ix"), (F.col("pos") % 8).cast("bigint").alias("iy"), "delta")


def cte(name: str) -> str:
    """The fixture as a common table expression for DuckDB."""
    return f"{name} AS ({TEXTS[name][0].format(**{t: t for t in TEXTS[name][1]})})"
