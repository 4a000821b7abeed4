"""Mass variance sigma(M, z): expansion of grids, the mass-k join, the Simpson sum, and a packed form of the same."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cosmotab.functions import cosmology as cos
from cosmotab.functions.windows import SERIES, SMALL, WINDOWS, window_squared
from cosmotab.operators.curves import simpson_weights
from cosmotab.operators.pairing import BROADCAST_ROWS, with_each_run


def expand_grid(runs: DataFrame, lo: str = "mass_min_exp", hi: str = "mass_max_exp", points: str = "mass_points", out: str = "m_h") -> DataFrame:
    """run_id and the run's logarithmic grid, `points` values from 10^lo to 10^hi: an explosion, no shuffle."""
    i = F.col("_i").cast("double")
    step = F.when(F.col(points) > 1, (F.col(hi) - F.col(lo)) / (F.col(points) - 1)).otherwise(F.lit(0.0))
    return runs.select("*", F.explode(F.sequence(F.lit(0), F.col(points).cast("int") - 1)).alias("_i")).withColumn(out, F.pow(F.lit(10.0), F.col(lo) + i * step)).drop("_i")


def mass_radii(runs: DataFrame, masses: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """run_id, m_h, m, r: masses in h^-1 units with the run's h and density. masses: (m_h) for all runs, broadcast if their
    counted number allows it, or (run_id, m_h)."""
    slim = runs.select("run_id", "H0", "Omega_m")
    rows = slim.join(masses, "run_id") if "run_id" in masses.columns else with_each_run(masses, slim, most)
    m = F.col("m_h") / cos.h(F.col("H0"))
    return rows.select("run_id", "m_h", m.alias("m"), cos.radius_of_mass(m, cos.rho0(F.col("H0"), F.col("Omega_m"))).alias("r"))


def mass_k_join(power: DataFrame, radii: DataFrame) -> DataFrame:
    """Every sample (run_id, z, k, ...) with every mass of its run, and y = k r."""
    return power.join(radii, "run_id").withColumn("y", F.col("k") * F.col("r"))


def sigma_m(power: DataFrame, radii: DataFrame, windows: tuple[str, ...] = ("Top-hat",), dealt: bool = False) -> DataFrame:
    """run_id, window_type, z, m_h, m, r, sigma from power (run_id, z, k, p) and radii (run_id, m_h, m, r).

    Weights, join and first aggregation share the partitioning by run_id: power is dealt by run_id once (dealt: it is so
    already, and isn't shuffled), the rows of the join are summed where they arise and are never shuffled. The redshifts of a run that have the same k go through the
    join as one row with an array, so W(kR) is taken once for all of them.
    """
    weighted = simpson_weights(power if dealt else power.repartition("run_id"), ["run_id", "z"], F.ln("k"), "w").select("run_id", "k", F.struct("z", (F.col("w") * cos.delta2(F.col("k"), F.col("p"))).alias("a")).alias("at"))
    packed = weighted.groupBy("run_id", "k").agg(F.collect_list("at").alias("at"))
    squares = [window_squared(F.col("y"), w).alias(f"_w{i}") for i, w in enumerate(windows)]
    pairs = mass_k_join(packed, radii).select("run_id", "m_h", "m", "r", "at", *squares)
    rows = pairs.select("run_id", "m_h", "m", "r", *[f"_w{i}" for i in range(len(windows))], F.inline("at"))
    sums = rows.groupBy("run_id", "z", "m_h", "m", "r").agg(*[F.sum(F.col("a") * F.col(f"_w{i}")).alias(f"_s{i}") for i in range(len(windows))])
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("window_type"), F.sqrt(F.greatest(F.col(f"_s{i}"), F.lit(0.0))).alias("sigma")) for i, w in enumerate(windows)]))
    return sums.select("run_id", "z", "m_h", "m", "r", each.alias("_s")).select("run_id", "_s.window_type", "z", "m_h", "m", "r", "_s.sigma")


def _window_squared(y: np.ndarray, name: str) -> np.ndarray:
    if name == "Gaussian":
        return np.exp(-y * y)
    if name == "Sharp-k":
        return (y <= 1).astype(float)
    near = np.abs(y) < SMALL
    series = sum((-1.0) ** n / d * y ** (2 * n) for n, d in enumerate(SERIES))
    far = np.where(near, 1.0, y)
    return np.where(near, series, 3 * (np.sin(far) - far * np.cos(far)) / far**3) ** 2


def sigma_m_packed(power: DataFrame, radii: DataFrame, windows: tuple[str, ...] = ("Top-hat",)) -> DataFrame:
    """The same rows as sigma_m by one matrix product a run and window: the window depends on k and R, not on z.

    Redshifts with the run's most common k grid share its window matrix; others get their own. A task holds one run's
    arrays, K x M doubles.
    """
    weighted = simpson_weights(power.repartition("run_id"), ["run_id", "z"], F.ln("k"), "w").select("run_id", "z", "k", (F.col("w") * cos.delta2(F.col("k"), F.col("p"))).alias("a"))

    def run(samples: pd.DataFrame, masses: pd.DataFrame) -> pd.DataFrame:
        masses = masses.sort_values("m_h")
        r, grids, out = masses["r"].to_numpy(), {}, []
        for z, group in samples.sort_values("k").groupby("z"):
            k = group["k"].to_numpy()
            for w in windows:
                key = (k.tobytes(), w)
                if key not in grids:
                    grids[key] = _window_squared(r[:, None] * k[None, :], w)
                s = np.sqrt(np.maximum(grids[key] @ group["a"].to_numpy(), 0))
                out.append(pd.DataFrame({"run_id": masses["run_id"].to_numpy(), "window_type": w, "z": z, "m_h": masses["m_h"].to_numpy(), "m": masses["m"].to_numpy(), "r": r, "sigma": s}))
        return pd.concat(out) if out and len(masses) else pd.DataFrame({c: [] for c in ("run_id", "window_type", "z", "m_h", "m", "r", "sigma")})

    kind = power.schema["run_id"].dataType.simpleString()
    schema = f"run_id {kind}, window_type string, z double, m_h double, m double, r double, sigma double"
    return weighted.groupBy("run_id").cogroup(radii.groupBy("run_id")).applyInPandas(run, schema)


def sigma8(power: DataFrame, runs: DataFrame, dealt: bool = False) -> DataFrame:
    """run_id, z, sigma8: the top-hat variance at R = 8 / h. dealt: see sigma_m()."""
    ball = runs.select("run_id", F.lit(8.0).alias("m_h"), F.lit(8.0).alias("m"), (8.0 / cos.h(F.col("H0"))).alias("r"))
    return sigma_m(power, ball, dealt=dealt).select("run_id", "z", F.col("sigma").alias("sigma8"))


def sigma_integrand(power: DataFrame, radius: DataFrame, windows: tuple[str, ...] = WINDOWS) -> DataFrame:
    """d sigma^2 / d ln k of every sample at one radius a run (run_id, r), for each window, 1e-300 at least."""
    rows = power.join(radius, "run_id").select("*", F.explode(F.array(*map(F.lit, windows))).alias("window_type"))
    value = cos.delta2(F.col("k"), F.col("p")) * window_squared(F.col("k") * F.col("r"), F.col("window_type"))
    return rows.withColumn("integrand", F.greatest(value, F.lit(1e-300)))


def k_coverage(power: DataFrame, radii: DataFrame) -> DataFrame:
    """run_id and kR at the ends of k and of the masses: low_small, low_large, high_small, high_large."""
    k = power.groupBy("run_id").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    r = radii.groupBy("run_id").agg(F.min_by("r", "m").alias("small"), F.max_by("r", "m").alias("large"))
    return k.join(r, "run_id").select("run_id", *[(F.col(a) * F.col(b)).alias(f"{n}_{b}") for n, a in (("low", "lo"), ("high", "hi")) for b in ("small", "large")])


def power_quality(power: DataFrame, least: int = 8) -> DataFrame:
    """run_id, z, samples, verdict: `pass` if there are enough samples, all finite and positive, and no k twice."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf"))
    facts = power.groupBy("run_id", "z").agg(
        F.count(F.lit(1)).alias("samples"), F.coalesce(F.bool_and(good("k") & good("p")), F.lit(False)).alias("positive"), (F.count_distinct("k") == F.count("k")).alias("single")
    )
    ok = (F.col("samples") >= least) & F.col("positive") & F.col("single")
    return facts.select("run_id", "z", "samples", F.when(ok, "pass").otherwise("quarantine").alias("verdict"))


def mass_grid_quality(sigma: DataFrame, least: int = 4) -> DataFrame:
    """run_id, window_type, z, masses, verdict: enough masses, finite and positive, none twice, sigma positive."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf"))
    facts = sigma.groupBy("run_id", "window_type", "z").agg(
        F.count(F.lit(1)).alias("masses"), F.bool_and(good("m") & good("sigma")).alias("positive"), (F.count_distinct("m") == F.count("m")).alias("single")
    )
    ok = (F.col("masses") >= least) & F.col("positive") & F.col("single")
    return facts.select("run_id", "window_type", "z", "masses", F.when(ok, "pass").otherwise("quarantine").alias("verdict"))


def growth_norm(growth: DataFrame) -> DataFrame:
    """Adds d = growth / growth at z = 0 of the run."""
    from pyspark.sql import Window as W

    base = F.max(F.when(F.col("z") == 0, F.col("growth"))).over(W.partitionBy("run_id"))
    return growth.withColumn("d", F.col("growth") / base)


def processing_shape(power: DataFrame, runs: DataFrame) -> DataFrame:
    """P / k^n_s over its median at small k (k up to 5 times the first, or 0.003), or over the first value if none."""
    shaped = power.join(runs.select("run_id", "n_s"), "run_id").withColumn("t", F.col("p") / F.pow("k", "n_s"))
    first = shaped.groupBy("run_id", "z").agg(F.min("k").alias("k0"), F.min_by("t", "k").alias("t0"))
    cut = shaped.join(first, ["run_id", "z"])
    low = cut.groupBy("run_id", "z").agg(
        F.coalesce(F.percentile(F.when(F.col("k") <= F.greatest(5.0 * F.col("k0"), F.lit(0.003)), F.col("t")), F.lit(0.5)), F.min("t0")).alias("norm")
    )
    return shaped.join(low, ["run_id", "z"]).select("run_id", "z", "k", (F.col("t") / F.col("norm")).alias("shape"))


#: 2 pi^2, the volume factor of the variance.
VOLUME = 2.0 * math.pi**2
