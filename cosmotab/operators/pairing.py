"""Small tables with every run, and hot keys in shares: broadcasts behind a count, and another way beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that may be broadcast: some 100 bytes each.
BROADCAST_ROWS = 200_000
#: Rows and runs that meet under one key where both sides are dealt into shares.
SHARE_ROWS, SHARE_RUNS = 4096, 1024


def is_small(rows: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether the rows may be broadcast: they are counted, up to the bound."""
    return rows.limit(most + 1).count() <= most


def shares(count: int, each: int) -> int:
    """How many shares of about `each` a count makes."""
    return max(1, -(-count // each))


def share(n: int | Column, *columns: str) -> Column:
    """The share, of n, that a row falls to by hash of its columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(n) if isinstance(n, int) else n).cast("int")


def every_share(n: int | Column) -> Column:
    """All of n shares, exploded."""
    return F.explode(F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n).cast("int") - 1))


def with_each_run(rows: DataFrame, runs: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Every row once with every run: the result is that large by definition. Columns of runs come first.

    A counted, small table of rows is broadcast. A larger one meets the runs under keys of a share of the rows and a share
    of the runs, SHARE_ROWS times SHARE_RUNS results each: as many shares as the counts ask for.
    """
    if is_small(rows, most):
        return runs.crossJoin(F.broadcast(rows))
    s, t = shares(rows.count(), SHARE_ROWS), shares(runs.count(), SHARE_RUNS)
    left = runs.withColumns({"_run_share": share(t, *runs.columns)}).withColumn("_row_share", every_share(s))
    right = rows.withColumns({"_row_share": share(s, *rows.columns)}).withColumn("_run_share", every_share(t))
    return left.join(right, ["_run_share", "_row_share"]).drop("_run_share", "_row_share")
