"""Halo mass functions and their tails from sigma curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cosmotab.functions import cosmology as cos
from cosmotab.functions import fits as fit_functions
from cosmotab.operators.curves import TINY, log_gradient, tail_cumulative

CURVE = ["run_id", "window_type", "z"]


def slopes(sigma: DataFrame, edge_order: int = 2) -> DataFrame:
    """Adds dlns = d ln sigma / d ln M."""
    return log_gradient(sigma, CURVE, "m", "sigma", "dlns", edge_order)


def strict_z(requests: DataFrame, samples: DataFrame, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(found, missing): requests (run_id, z) with the sampled z_used at most `tolerance` away; those without one.

    The match is an equi-join on z rounded to the tolerance's grid and its neighbours, then the exact test.
    """
    cell = lambda z: F.round(z / (2 * tolerance)).cast("bigint")
    s = samples.select("run_id", F.col("z").alias("z_used")).distinct().withColumn("_cell", cell(F.col("z_used")))
    r = requests.withColumn("_cell", F.explode(F.array(*[cell(F.col("z")) + F.lit(d) for d in (-1, 0, 1)])))
    near = r.join(s, ["run_id", "_cell"]).filter(F.abs(F.col("z") - F.col("z_used")) <= tolerance)
    found = near.groupBy(*requests.columns).agg(F.min_by("z_used", F.abs(F.col("z") - F.col("z_used"))).alias("z_used"))
    return found, requests.join(found, requests.columns, "left_anti")


def hmf(sigma: DataFrame, runs: DataFrame, fits: list[str], delta_halo: float = 200.0) -> DataFrame:
    """run_id, window_type, z, fit, m_h, m, sigma, hmf from slopes(sigma) and runs (H0, Omega_m, delta_c, Tcmb, N_eff,
    Omega_k where there): dn/dlnM = rho0 / M f(sigma) |dlns| / h^3, 1e-300 at least. The fits fan out at the end, as an
    explosion of expressions; runs join by run_id.
    """
    c = F.col
    have = set(runs.columns)
    get = lambda name, default: F.col(name) if name in have else F.lit(default)
    facts = runs.select(
        "run_id", cos.h(c("H0")).alias("h"), cos.rho0(c("H0"), c("Omega_m")).alias("rho0"), c("Omega_m"), cos.omega_r(c("H0"), get("Tcmb", cos.T_CMB), get("N_eff", 3.046)).alias("Omega_r"),
        get("Omega_k", 0.0).alias("Omega_k"), get("delta_c", fit_functions.DELTA_C).alias("delta_c"),
    )
    rows = sigma.join(facts, "run_id").withColumn("omega_m_z", cos.omega_m_of_z(c("z"), c("Omega_m"), c("Omega_r"), c("Omega_k")))
    f = lambda name: fit_functions.multiplicity(c("sigma"), name, delta_c=c("delta_c"), z=c("z"), delta_halo=delta_halo, omega_m_z=c("omega_m_z"))
    value = lambda name: F.greatest(c("rho0") / c("m") * f(name) * F.abs("dlns") / (c("h") * c("h") * c("h")), F.lit(TINY))
    fan = F.explode(F.array(*[F.struct(F.lit(fit_functions.canonical_name(n)).alias("fit"), value(n).alias("hmf")) for n in fits]))
    return rows.select(*CURVE, "m_h", "m", "sigma", fan.alias("_f")).select(*CURVE, "_f.fit", "m_h", "m", "sigma", "_f.hmf")


def hmf_cumulative(hmf_rows: DataFrame) -> DataFrame:
    """Adds n_gt_m: the integral of hmf over ln M_h from each mass up."""
    return tail_cumulative(hmf_rows, [*CURVE, "fit"], "m_h", "hmf", "n_gt_m")


def fit_catalog(spark) -> DataFrame:
    """fit, range_text, redshift_text and the numbers in them: the variable (`ln_inv_sigma`, `log10_m` or null), lo, hi,
    z_lo, z_hi. Texts without numbers bound nothing."""
    t = spark.createDataFrame(list(fit_functions.CATALOG), "fit string, range_text string, redshift_text string")
    number = r"(-?[0-9]+(?:\.[0-9]+)?)"
    sigma = rf"^{number} < ln sigma\^-1 < {number}$"
    mass = rf"^10\^{number} < M/Msun < 10\^{number}$"
    pick = lambda i: F.coalesce(*[F.when(F.regexp_like("range_text", F.lit(p)), F.regexp_extract("range_text", p, i)).cast("double") for p in (sigma, mass)])
    z = r"^([0-9.]+)(?:-([0-9.]+))?$"
    whole = F.regexp_like("redshift_text", F.lit(z))
    top = F.regexp_extract("redshift_text", z, 2)
    bottom = F.when(whole, F.regexp_extract("redshift_text", z, 1)).cast("double")
    return t.select(
        "*", F.when(F.regexp_like("range_text", F.lit(sigma)), "ln_inv_sigma").when(F.regexp_like("range_text", F.lit(mass)), "log10_m").alias("variable"),
        pick(1).alias("lo"), pick(2).alias("hi"), bottom.alias("z_lo"), F.when(whole & (top != ""), top).otherwise(F.when(whole, F.regexp_extract("redshift_text", z, 1))).cast("double").alias("z_hi"),
    )


def calibration_label(hmf_rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds calibrated: whether the row lies inside its fit's published range of sigma or mass, and of redshift."""
    rows = hmf_rows.join(F.broadcast(catalog.select("fit", "variable", "lo", "hi", "z_lo", "z_hi")), "fit", "left")
    x = F.when(F.col("variable") == "ln_inv_sigma", -F.ln("sigma")).when(F.col("variable") == "log10_m", F.log10("m"))
    in_x = F.col("lo").isNull() | ((x > F.col("lo")) & (x < F.col("hi")))
    in_z = F.col("z_lo").isNull() | F.col("z").between(F.col("z_lo"), F.col("z_hi"))
    return rows.withColumn("calibrated", in_x & in_z).drop("variable", "lo", "hi", "z_lo", "z_hi")
