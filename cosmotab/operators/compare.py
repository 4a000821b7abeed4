"""Curve-by-curve comparison of runs with a baseline run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cosmotab.functions import cosmology as cos
from cosmotab.operators.curves import interpolate, nearest
from cosmotab.operators.pairing import BROADCAST_ROWS, SHARE_RUNS, every_share, is_small, share, shares
from cosmotab.sources.shared import stored

CURVE = ["metric", "run_id", "window_type", "fit", "z"]
#: The metrics in order.
METRICS = ("P(k)", "Delta2(k)", "Growth", "sigma(M)", "sigma slope", "HMF", "Cumulative HMF")
#: A baseline value of at most this size divides nothing.
NOTHING = 1e-300
#: Bins of a histogram of logarithms, for each factor of e.
BINS = 1024


def metric_curves(power: DataFrame, growth: DataFrame, sigma: DataFrame, hmf: DataFrame) -> DataFrame:
    """metric, run_id, window_type, fit, z, x, y: the union of the seven metrics.

    sigma comes from slopes(), hmf from hmf_cumulative(). Where a metric has no window or fit these are empty texts; the
    growth curve runs over z and has z = 0.
    """
    c, none = F.col, F.lit("")

    def rows(df: DataFrame, x: Column, values: dict[str, Column], window: Column = none, fit: Column = none, z: Column | None = None) -> DataFrame:
        """The metrics of one table side by side, so that it is worked out once."""
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), y.alias("y")) for m, y in values.items()]))
        df = df.select("run_id", window.alias("window_type"), fit.alias("fit"), (c("z") if z is None else z).alias("z"), x.alias("x"), each.alias("_m"))
        return df.select("_m.metric", "run_id", "window_type", "fit", "z", "x", "_m.y")

    w, f = c("window_type"), c("fit")
    parts = [
        rows(power, c("k"), {METRICS[0]: c("p"), METRICS[1]: cos.delta2(c("k"), c("p"))}),
        rows(growth, c("z"), {METRICS[2]: c("growth")}, z=F.lit(0.0)),
        rows(sigma, c("m_h"), {METRICS[3]: c("sigma"), METRICS[4]: F.abs("dlns")}, w),
        rows(hmf, c("m_h"), {METRICS[5]: c("hmf"), METRICS[6]: c("n_gt_m")}, w, f),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def baseline_match(curves: DataFrame, baseline_id: object, small: bool | None = None) -> DataFrame:
    """One row for each curve: the window and fit of the baseline's curve it is compared with (base_window, base_fit).

    That is the baseline's curve of the same metric, z, window and fit; without one, the baseline's first curve of the
    metric and z in order of window and fit. Only the list of curves meets the baseline's list, both without samples; the
    baseline's list, of one run, is broadcast if its samples are few enough (small; counted if not given).
    """
    if small is None:
        small = is_small(curves.filter(F.col("run_id") == baseline_id))
    sent = F.broadcast if small else lambda df: df
    keys = curves.select(*CURVE).distinct()
    base = keys.filter(F.col("run_id") == baseline_id).select("metric", "z", "window_type", "fit")
    same = base.withColumns({"base_window": F.col("window_type"), "base_fit": F.col("fit")})
    first = base.groupBy("metric", "z").agg(F.min(F.struct("window_type", "fit")).alias("first"))
    rows = keys.join(sent(same), ["metric", "z", "window_type", "fit"], "left").join(sent(first), ["metric", "z"], "left")
    return rows.select(*CURVE, F.coalesce("base_window", "first.window_type").alias("base_window"), F.coalesce("base_fit", "first.fit").alias("base_fit"))


def _beside(curves: DataFrame, base: DataFrame) -> DataFrame:
    """curves with _base: the baseline's value at x, from the baseline's samples, few enough to be broadcast.

    A baseline curve is cut into segments between neighbouring samples, and these into about as many blocks as one holds
    segments. A sample finds its curve by the keys, its block and then its segment by their ranges of x: two times the
    root of the curve's samples are looked at. Whether all of a curve's x are positive is asked only where it matters:
    for curves with an x of 0 or less beside a positive baseline curve; a list of them that is long is shuffled.
    """
    c, on = F.col, ["metric", "z", "base_window", "base_fit"]
    whole, order = W.partitionBy("_id"), W.partitionBy("_id").orderBy("bx")
    numbers = base.agg(F.array_sort(F.collect_set(F.struct(*on))).alias("_all")).select(F.posexplode("_all").alias("_id", "_key")).select("_key.*", c("_id").cast("bigint"))
    named = base.join(F.broadcast(numbers), on)
    least = F.min(F.least("bx", "by")).over(whole)
    samples = named.filter("bx is not null and by is not null").withColumn("_least", least).groupBy(*on, "_id", "_least", c("bx").cast("double").alias("bx")).agg(F.max(c("by").cast("double")).alias("by"))
    place, n = F.row_number().over(order), F.count(F.lit(1)).over(whole)
    ends = samples.select("_id", c("bx").alias("_x0"), c("by").alias("_y0"), F.lead("bx").over(order).alias("_x1"), F.lead("by").over(order).alias("_y1"), place.alias("_i"), n.alias("_n"))
    first = ends.filter("_i = 1").select("_id", *[F.lit(None).cast("double").alias(x) for x in ("_x0", "_y0")], c("_x0").alias("_x1"), c("_y0").alias("_y1"), F.lit(0).alias("_i"), "_n")
    segments = ends.unionByName(first).withColumn("_block", c("_id") * (1 << 20) + F.floor(c("_i") / F.ceil(F.sqrt("_n"))))
    lowest = F.lit(float("-inf"))
    blocks = segments.groupBy("_id", "_block").agg(F.min(F.coalesce("_x0", lowest)).alias("_from"), F.max(F.coalesce("_x1", F.lit(float("nan")))).alias("_to"))  # NaN: no end

    keys = samples.groupBy(*on, "_id", "_least").agg(F.lit(1).alias("_one")).drop("_one")
    same = keys.select("metric", "z", c("base_window").alias("window_type"), c("base_fit").alias("fit"), c("_id").alias("_same"), c("_least").alias("_same_least"))
    other = keys.groupBy("metric", "z").agg(F.min(F.struct("base_window", "base_fit", "_id", "_least")).alias("_first"))

    def matched(rows: DataFrame) -> DataFrame:
        rows = rows.join(F.broadcast(same), ["metric", "z", "window_type", "fit"], "left").join(F.broadcast(other), ["metric", "z"], "left")
        return rows.withColumns({"_id": F.coalesce("_same", "_first._id"), "_log": F.coalesce("_same_least", "_first._least") > 0}).drop("_same", "_same_least", "_first")

    odd = matched(curves.filter("x <= 0").select(*CURVE).distinct()).filter("_log").select(*CURVE, F.lit(True).alias("_odd"))
    rows = matched(curves).join(F.broadcast(odd) if is_small(odd) else odd, CURVE, "left")
    rows = rows.join(F.broadcast(blocks.withColumnRenamed("_id", "_of")), (c("_id") == c("_of")) & (c("x") >= c("_from")) & (c("x") < c("_to")), "left").drop("_of", "_from", "_to")
    found = segments.select(c("_block").alias("_in"), F.coalesce("_x0", lowest).alias("_from"), F.coalesce("_x1", F.lit(float("nan"))).alias("_to"), "_x0", "_y0", "_x1", "_y1")
    rows = rows.join(F.broadcast(found), (c("_block") == c("_in")) & (c("x") >= c("_from")) & (c("x") < c("_to")), "left")
    x0, y0, x1, y1, x = (c(n) for n in ("_x0", "_y0", "_x1", "_y1", "x"))
    straight = y0 + (y1 - y0) / (x1 - x0) * (x - x0)
    curved = F.exp(F.ln(y0) + (F.ln(y1) - F.ln(y0)) / (F.ln(x1) - F.ln(x0)) * (F.ln(x) - F.ln(x0)))
    value = F.when(x0.isNull() | x1.isNull(), F.coalesce(y0, y1)).when(x == x0, y0).when(c("_log") & c("_odd").isNull(), curved).otherwise(straight)
    return rows.select(*curves.columns, value.alias("_base"))


def compare(curves: DataFrame, baseline_id: object, mode: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """curves with value: y against the baseline's curve at the same x. Modes: overlay (y), ratio (y / base), fractional
    (y / base - 1), percent (100 times that); null where |base| is at most 1e-300 or there is no baseline curve.

    Each curve is interpolated on its own (log-log if all of its x and the baseline curve's x and y are positive). The
    baseline is one run: where its counted samples allow it (most), they are broadcast, and no curve's sample moves, see
    _beside(). Of a larger baseline the samples are dealt to the curves that use them, in shares of the runs, one for
    SHARE_RUNS of them, and sorted together with the curves' own.
    """
    if mode == "overlay":
        return curves.withColumn("value", F.col("y"))
    base = curves.filter(F.col("run_id") == baseline_id).select("metric", "z", F.col("window_type").alias("base_window"), F.col("fit").alias("base_fit"), F.col("x").alias("bx"), F.col("y").alias("by"))
    if is_small(base, most):
        rows = _beside(curves, base)
    else:
        matched, on = baseline_match(curves, baseline_id, False), ["metric", "z", "base_window", "base_fit"]
        n = shares(matched.select("run_id").distinct().count(), SHARE_RUNS)
        dealt = matched.withColumn("_share", share(n, "run_id")).join(base.withColumn("_share", every_share(n)), [*on, "_share"]).select(*CURVE, "bx", "by")
        rows = interpolate(curves, dealt, CURVE, "x", "bx", "by", "_base")
    ratio = F.when(F.abs("_base") > NOTHING, F.col("y") / F.col("_base"))
    value = {"ratio": ratio, "fractional": ratio - 1.0, "percent": 100.0 * (ratio - 1.0)}[mode]
    return rows.withColumn("value", value).drop("_base")


def quantile(rows: DataFrame, by: list[str], value: str, share: float, out: str) -> DataFrame:
    """by, out: the exact quantile of the non-negative values of each key, interpolated between neighbouring ranks; null
    where a key has no value.

    A histogram of logarithms finds the one or two bins that hold the ranks; only their distinct values, with counts, are
    ordered. No buffer holds a key's values. The rows are read three times: store them first if that is dear.
    """
    v = F.col(value)
    rows = rows.filter(v.isNotNull()).select(*by, v.cast("double").alias("_v"), F.when(v > 0, F.floor(F.ln(v) * BINS)).otherwise(F.lit(-(1 << 40))).alias("_bin"))
    up_to = lambda order: W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    bins = rows.groupBy(*by, "_bin").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(up_to("_bin"))).withColumn("_all", F.sum("_n").over(W.partitionBy(*by)))
    rank = share * (F.col("_all") - 1)
    wanted = bins.filter((F.col("_upto") > F.floor(rank)) & (F.col("_upto") - F.col("_n") <= F.ceil(rank))).select(*by, "_bin", (F.col("_upto") - F.col("_n")).alias("_below"), rank.alias("_rank"))
    wanted = F.broadcast(wanted) if is_small(wanted) else wanted  # a common value, as 0, is one bin
    values = rows.join(wanted, [*by, "_bin"]).groupBy(*by, "_bin", "_v").agg(F.count("*").alias("_n"), F.first("_below").alias("_below"), F.first("_rank").alias("_rank"))
    inside = W.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    values = values.withColumn("_upto", F.col("_below") + F.sum("_n").over(inside))
    holds = lambda r: (F.col("_upto") > r) & (F.col("_upto") - F.col("_n") <= r)
    low, high = F.floor("_rank"), F.ceil("_rank")
    ends = values.groupBy(*by).agg(F.max(F.when(holds(low), F.col("_v"))).alias("_lo"), F.max(F.when(holds(high), F.col("_v"))).alias("_hi"), F.first("_rank").alias("_rank"))
    return ends.select(*by, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_rank") - low)).alias(out))


def residual_extent(compared: DataFrame) -> DataFrame:
    """metric, extent: 99th percentile of |value|, 1e-4 at least."""
    values = stored(compared.select("metric", F.abs("value").alias("value")))
    metrics = values.select("metric").distinct()
    found = quantile(values, ["metric"], "value", 0.99, "extent")
    return metrics.join(found, "metric", "left").select("metric", F.greatest("extent", F.lit(1e-4)).alias("extent"))


def common_z(samples: DataFrame) -> DataFrame:
    """z sampled by every run in samples (run_id, z): counted, not compared pairwise."""
    pairs = samples.select("run_id", "z").distinct()
    runs = pairs.agg(F.count_distinct("run_id").alias("_all"))
    return pairs.groupBy("z").agg(F.count("*").alias("_n")).crossJoin(F.broadcast(runs)).filter(F.col("_n") == F.col("_all")).select("z")


def nearest_z(requests: DataFrame, samples: DataFrame) -> DataFrame:
    """requests (run_id, z) with z_used, the run's nearest sampled redshift; ties go to the lowest."""
    return nearest(requests.drop("z_used"), samples, ["run_id"], "z", "z", "z_used")


def growth_check(sigma8: DataFrame, growth: DataFrame) -> DataFrame:
    """run_id, z, ratio = sigma8(z) / sigma8(0), growth: in order of z within each run."""
    base = F.max(F.when(F.col("z") == 0, F.col("sigma8"))).over(W.partitionBy("run_id"))
    rows = sigma8.withColumn("ratio", F.col("sigma8") / base).join(growth, ["run_id", "z"]).select("run_id", "z", "ratio", "growth")
    return rows.sortWithinPartitions("run_id", "z")


def growth_diagnostics(power: DataFrame, sigma8: DataFrame, growth: DataFrame, at_k: float = 0.01) -> DataFrame:
    """run_id, z, sigma8, growth, from_power = sqrt(P(at_k, z) / P(at_k, 0)) by linear interpolation, difference."""
    ask = power.select("run_id", "z").distinct().withColumn("at", F.lit(at_k))
    p = interpolate(ask, power, ["run_id", "z"], "at", "k", "p", "p_at", log=False).select("run_id", "z", "p_at")
    base = F.max(F.when(F.col("z") == 0, F.col("p_at"))).over(W.partitionBy("run_id"))
    rows = p.withColumn("from_power", F.sqrt(F.col("p_at") / base)).join(sigma8, ["run_id", "z"]).join(growth, ["run_id", "z"])
    return rows.select("run_id", "z", "sigma8", "growth", "from_power", (F.col("from_power") / F.col("growth") - 1.0).alias("difference"))


def curve_cap(curves: DataFrame, most: int = 36) -> DataFrame:
    """The samples of the first `most` curves of each metric in order of run, window and fit (the cap of a panel)."""
    keys = curves.select("metric", "run_id", "window_type", "fit").distinct()
    n = F.row_number().over(W.partitionBy("metric").orderBy("run_id", "window_type", "fit"))
    return curves.join(keys.withColumn("place", n).filter(F.col("place") <= most), ["metric", "run_id", "window_type", "fit"])


def compare_table(runs: DataFrame, sigma8_now: DataFrame, baseline_id: object) -> DataFrame:
    """One row a run: its main parameters, sigma8 at z = 0 and whether it is the baseline."""
    return runs.join(sigma8_now, "run_id", "left").select(
        "run_id", "name", (F.col("run_id") == baseline_id).alias("baseline"), "H0", "Omega_m", "Omega_b", "A_s", "n_s", "enable_ede", "f_EDE", "log10_a_c", "sigma8"
    )
