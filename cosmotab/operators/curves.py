"""Kernels over curves: rows (by..., x, y), in no order. Every kernel is one shuffle by the curve's keys, or none if the
rows are partitioned by some of them already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TINY = 1e-300


def simpson_weights(df: DataFrame, by: list[str], x: str | Column = "x", out: str = "w") -> DataFrame:
    """Adds the weight of each sample in the composite Simpson rule over non-uniform x.

    An even number of samples gets the usual correction of the last interval, two the trapezoid, one the weight 0.
    """
    x = F.col(x) if isinstance(x, str) else x
    df = df.withColumn("_x", x)
    order, whole = W.partitionBy(*by).orderBy("_x"), W.partitionBy(*by)
    x = F.col("_x")
    df = df.select(
        "*", (F.row_number().over(order) - 1).alias("_i"), F.count(F.lit(1)).over(whole).alias("_n"),
        (x - F.lag(x, 1).over(order)).alias("_b1"), (F.lag(x, 1).over(order) - F.lag(x, 2).over(order)).alias("_b2"),
        (F.lead(x, 1).over(order) - x).alias("_a1"), (F.lead(x, 2).over(order) - F.lead(x, 1).over(order)).alias("_a2"),
    )
    i, n, b1, b2, a1, a2 = map(F.col, ("_i", "_n", "_b1", "_b2", "_a1", "_a2"))
    m = n - F.when(n % 2 == 0, 1).otherwise(0)  # samples under the pairwise rule
    zero = F.lit(0.0)
    middle = F.when((i % 2 == 1) & (i < m), F.pow(b1 + a1, F.lit(3.0)) / (6.0 * b1 * a1)).otherwise(zero)
    opening = F.when((i % 2 == 0) & (i + 2 < m), (a1 + a2) / 6.0 * (2.0 - a2 / a1)).otherwise(zero)
    closing = F.when((i % 2 == 0) & (i >= 2) & (i < m), (b1 + b2) / 6.0 * (2.0 - b2 / b1)).otherwise(zero)
    even = (n % 2 == 0) & (n > 2)
    last = (
        F.when(even & (i == n - 1), (2.0 * b1 * b1 + 3.0 * b2 * b1) / (6.0 * (b2 + b1)))
        .when(even & (i == n - 2), (a1 * a1 + 3.0 * b1 * a1) / (6.0 * b1))
        .when(even & (i == n - 3), -F.pow(a2, F.lit(3.0)) / (6.0 * a1 * (a1 + a2)))
        .when(n == 2, F.coalesce(a1, b1) / 2.0)
        .otherwise(zero)
    )
    return df.withColumn(out, middle + opening + closing + last).drop("_x", "_i", "_n", "_b1", "_b2", "_a1", "_a2")


def simpson_integral(df: DataFrame, by: list[str], x: str | Column = "x", y: str | Column = "y", out: str = "integral") -> DataFrame:
    """One row per curve: the integral of y over x."""
    y = F.col(y) if isinstance(y, str) else y
    return simpson_weights(df, by, x, "_w").groupBy(*by).agg(F.sum(F.col("_w") * y).alias(out))


def log_gradient(df: DataFrame, by: list[str], x: str = "x", y: str = "y", out: str = "slope", edge_order: int = 2) -> DataFrame:
    """Adds d ln y / d ln x: three-point rule inside, one-sided of the given order at the ends (first order if there are
    two samples; null for one). y is floored at 1e-300."""
    order = W.partitionBy(*by).orderBy("_u")
    df = df.withColumn("_u", F.ln(F.col(x))).withColumn("_f", F.ln(F.greatest(F.col(y), F.lit(TINY))))
    at = lambda c, k: (F.lag(c, -k) if k < 0 else F.lead(c, k)).over(order)
    df = df.select("*", *[at(c, k).alias(f"{c}{'m' if k < 0 else 'p'}{abs(k)}") for c in ("_u", "_f") for k in (-2, -1, 1, 2)])
    u, f = F.col("_u"), F.col("_f")
    um2, um1, up1, up2, fm2, fm1, fp1, fp2 = (F.col(f"{c}{s}") for c in ("_u", "_f") for s in ("m2", "m1", "p1", "p2"))
    d1, d2 = u - um1, up1 - u
    inner = -d2 / (d1 * (d1 + d2)) * fm1 + (d2 - d1) / (d1 * d2) * f + d1 / (d2 * (d1 + d2)) * fp1
    e1, e2 = up1 - u, up2 - up1
    head = -(2.0 * e1 + e2) / (e1 * (e1 + e2)) * f + (e1 + e2) / (e1 * e2) * fp1 - e1 / (e2 * (e1 + e2)) * fp2
    g1, g2 = um1 - um2, u - um1
    tail = g2 / (g1 * (g1 + g2)) * fm2 - (g1 + g2) / (g1 * g2) * fm1 + (2.0 * g2 + g1) / (g2 * (g1 + g2)) * f
    first_order = F.coalesce((fp1 - f) / (up1 - u), (f - fm1) / (u - um1))
    ends = first_order if edge_order == 1 else F.coalesce(F.when(um1.isNull(), head), F.when(up1.isNull(), tail), first_order)
    made = [f"{c}{s}" for c in ("_u", "_f") for s in ("", "m2", "m1", "p1", "p2")]
    return df.withColumn(out, F.when(um1.isNotNull() & up1.isNotNull(), inner).otherwise(ends)).drop(*made)


def tail_cumulative(df: DataFrame, by: list[str], x: str = "x", y: str = "y", out: str = "tail") -> DataFrame:
    """Adds the integral of y over ln x from each x to the largest (trapezoids), 1e-300 at least.

    The frame runs over descending x, so that it only grows: linear in the samples.
    """
    up, down = W.partitionBy(*by).orderBy(x), W.partitionBy(*by).orderBy(F.desc(x)).rowsBetween(W.unboundedPreceding, 0)
    strip = 0.5 * (F.col(y) + F.lead(y).over(up)) * (F.ln(F.lead(x).over(up)) - F.ln(F.col(x)))
    df = df.withColumn("_strip", F.coalesce(strip, F.lit(0.0)))
    return df.withColumn(out, F.greatest(F.sum("_strip").over(down), F.lit(TINY))).drop("_strip")


def interpolate(points: DataFrame, curve: DataFrame, by: list[str], x: str = "x", cx: str = "x", cy: str = "y", out: str = "value", log: bool | None = None, strict: bool = False, floor: float | None = None, tasks: int | None = None) -> DataFrame:
    """Adds to each point (or puts in the place of its column of that name) the curve's value at its x, between the neighbouring samples of the curve with the same keys.

    log=None decides for each curve: log-log if all of the points' x and the curve's x and y are positive, else linear;
    True and False force it. Outside the samples the end values hold, or with strict null. With floor, y is raised to it
    first. Points of keys without a curve get null. One shuffle by the keys, to `tasks` tasks if given: points and samples are
    sorted together.
    """
    y = F.col(cy) if floor is None else F.greatest(F.col(cy), F.lit(floor))
    nothing = F.lit(None).cast("struct<x: double, y: double>")
    a = points.select(*by, F.col(x).cast("double").alias("_x"), F.struct("*").alias("_row"), nothing.alias("_s"))
    s = curve.filter(F.col(cx).isNotNull() & y.isNotNull()).select(*by, F.col(cx).cast("double").alias("_x"), F.struct(F.col(cx).cast("double").alias("x"), y.cast("double").alias("y")).alias("_s"))
    both = s.withColumn("_row", F.lit(None).cast(a.schema["_row"].dataType)).unionByName(a)
    both = both.repartition(tasks, *by) if tasks else both
    sample_first = F.col("_s").isNull()
    low = W.partitionBy(*by).orderBy("_x", sample_first).rowsBetween(W.unboundedPreceding, 0)
    high = W.partitionBy(*by).orderBy(F.desc("_x"), sample_first).rowsBetween(W.unboundedPreceding, 0)
    both = both.select(
        "*", F.last("_s", ignorenulls=True).over(low).alias("_lo"), F.last("_s", ignorenulls=True).over(high).alias("_hi"),
        F.min(F.least("_x", F.coalesce(F.col("_s.y"), F.col("_x")))).over(W.partitionBy(*by)).alias("_least"),
    )
    x0, y0, x1, y1, at = (F.col(c) for c in ("_lo.x", "_lo.y", "_hi.x", "_hi.y", "_x"))
    straight = y0 + (y1 - y0) / (x1 - x0) * (at - x0)
    curved = F.exp(F.ln(y0) + (F.ln(y1) - F.ln(y0)) / (F.ln(x1) - F.ln(x0)) * (F.ln(at) - F.ln(x0)))
    positive = F.col("_least") > 0 if log is None else F.lit(log)
    inside = F.when(x0 == x1, y0).when(positive, curved).otherwise(straight)
    ends = F.lit(None).cast("double") if strict else F.coalesce(y0, y1)
    value = F.when(x0.isNotNull() & x1.isNotNull(), inside).otherwise(ends)
    kept = [F.col("_row").getField(c).alias(c) for c in points.columns if c != out]
    return both.filter(F.col("_row").isNotNull()).select(*kept, value.alias(out))


def nearest(points: DataFrame, samples: DataFrame, by: list[str], x: str, request: str, out: str) -> DataFrame:
    """For each row of points the sampled x of the same keys that is nearest to its request; ties go to the lowest."""
    keys = [*points.columns]
    joined = points.join(samples.select(*by, F.col(x).alias(out)).distinct(), by)
    return joined.groupBy(*keys).agg(F.min_by(out, F.struct(F.abs(F.col(out) - F.col(request)), F.col(out))).alias(out))
