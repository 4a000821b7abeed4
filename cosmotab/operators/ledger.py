"""The ledger of runs: names, numbers, the baseline, edits, lookups by key. Only slim columns are ever ordered as a whole."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cosmotab.sources.shared import stored

UNTITLED = "Untitled run"
#: About so many rows of an order are numbered by one task.
BLOCK_ROWS = 50_000


def in_blocks(rows: DataFrame, order: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with _block: the number of the stretch of the whole order that a row lies in, so that all rows of a block come
    before those of the next. Blocks are range partitions, as many as the counted rows ask for (about block_rows each), and
    split any value but rows that are equal in the whole order. The table is stored, as its ranges are sampled anew each
    time it is worked out."""
    blocks = max(1, -(-rows.count() // block_rows))
    return stored(rows.repartitionByRange(blocks, *order).withColumn("_block", F.spark_partition_id()))


def numbered(rows: DataFrame, order: list[str], out: str = "number", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with out: 1, 2, 3, ... in the whole order, ties in any. Rows are numbered inside blocks; a block begins at the
    sum of the rows of those before it (a number for each block, some 20,000 for a billion rows, meets on the driver)."""
    dealt = in_blocks(rows, order, block_rows)
    sizes = sorted(dealt.groupBy("_block").count().collect())
    begins = rows.sparkSession.createDataFrame(list(zip([b for b, _ in sizes], accumulate((n for _, n in sizes), initial=0), strict=False)), "_block int, _before bigint")
    inside = F.row_number().over(W.partitionBy("_block").orderBy(*order))
    return dealt.withColumn("_inside", inside).join(F.broadcast(begins), "_block").withColumn(out, F.col("_before") + F.col("_inside")).drop("_block", "_inside", "_before")


def running_sum(rows: DataFrame, by: list[str], block: str, order: list, add: str, out: str) -> DataFrame:
    """rows with out: the sum of `add` over the rows of the same keys up to and with this one, in order.

    `block` numbers stretches of the order. Sums run inside a block, on top of the sums of the blocks before, so a window
    holds one block of a key, or a key's list of blocks; keys of any size split.
    """
    sums = rows.groupBy(*by, block).agg(F.sum(add).alias("_sum"))
    before = W.partitionBy(*by).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*by, block, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*by, block).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.join(sums, [*by, block]).withColumn(out, F.col("_before") + F.sum(add).over(inside)).drop("_before")


def unique_names(wanted: DataFrame, taken: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """wanted (run_id, name, created_at) with unique_name.

    White space collapses, a blank name becomes `Untitled run`. The first of a name (by created_at, run_id) keeps it, the
    others get ` (2)`, ` (3)`, ... in order, passing over names that are in `taken` (name) or wanted by others as they are.

    The k-th free number of a base is 1 + k plus as many as its used numbers u1 < u2 < ... have ui - i <= k. Both counts
    are running sums over blocks, of ranges of (base, created_at, run_id) and of numbers: no row holds a list, and one name
    on all runs, made in one second, splits.
    """
    clean = F.trim(F.regexp_replace(F.coalesce("name", F.lit("")), r"\s+", " "))
    rows = wanted.withColumn("_base", F.when(clean == "", UNTITLED).otherwise(clean))
    fixed = rows.select(F.col("_base").alias("name")).distinct().withColumn("given", F.lit(False))
    if taken is not None:
        fixed = fixed.unionByName(taken.select("name").distinct().withColumn("given", F.lit(True)))
    # numbers of a base that are names already: `base (n)` splits into base and n
    part = lambda i: F.regexp_extract("name", r"^(.*) \(([1-9]\d{0,8})\)$", i)
    used = fixed.select(part(1).alias("_base"), part(2).try_cast("bigint").alias("n")).filter("n >= 2").distinct().withColumn("_one", F.lit(1))
    used = running_sum(used.withColumn("_block", F.expr(f"n div {block_rows}")), ["_base"], "_block", ["n"], "_one", "_i").select("_base", (F.col("n") - F.col("_i")).alias("_k"))
    held = fixed.filter("given").select(F.col("name").alias("_base"), F.lit(1).alias("_held")).distinct()
    rows = in_blocks(rows.withColumn("_one", F.lit(1)), ["_base", "created_at", "run_id"], block_rows)
    rows = running_sum(rows, ["_base"], "_block", ["created_at", "run_id"], "_one", "_place").join(held, "_base", "left")
    rows = rows.withColumn("_k", F.col("_place") - F.when(F.col("_held").isNull(), 1).otherwise(0))  # 0 keeps the name
    nothing = F.lit(None).cast(rows.select(F.struct("*").alias("r")).schema["r"].dataType)
    events = rows.select("_base", F.col("_k").cast("bigint").alias("_k"), F.struct("*").alias("_row"), F.lit(0).alias("_used"))
    events = events.unionByName(used.select("_base", F.col("_k").cast("bigint").alias("_k"), nothing.alias("_row"), F.lit(1).alias("_used")))
    counted = running_sum(events.withColumn("_block", F.expr(f"_k div {block_rows}")), ["_base"], "_block", ["_k", F.desc("_used")], "_used", "_passed").filter("_row is not null")
    number = (F.col("_k") + 1 + F.col("_passed")).cast("string")
    name = F.when(F.col("_k") == 0, F.col("_base")).otherwise(F.concat("_base", F.lit(" ("), number, F.lit(")")))
    return counted.select(*[F.col("_row").getField(x).alias(x) for x in wanted.columns], name.alias("unique_name"))


def run_numbering(runs: DataFrame, colors: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """run_id, number (from 1 by created_at, run_id) and color index: over the slim ledger alone, numbered in blocks."""
    rows = numbered(runs.select("run_id", "created_at"), ["created_at", "run_id"], "number", block_rows)
    return rows.select("run_id", F.col("number").cast("bigint").alias("number"), F.pmod(F.col("number") - 1, F.lit(colors)).cast("bigint").alias("color"))


def assign_baseline(runs: DataFrame, chosen_id: object = None) -> DataFrame:
    """runs (run_id, is_baseline, created_at, ...) with exactly one baseline: the chosen run, else a flagged one, else the
    earliest. The best candidate is one aggregate over the runs; it goes back to them as one broadcast row."""
    is_chosen = F.lit(False) if chosen_id is None else F.col("run_id") == chosen_id
    rank = F.struct((~is_chosen).cast("int"), (~F.coalesce("is_baseline", F.lit(False))).cast("int"), F.col("created_at"), F.col("run_id"))
    best = runs.agg(F.min_by("run_id", rank).alias("_best"))
    return runs.drop("is_baseline").crossJoin(F.broadcast(best)).withColumn("is_baseline", F.col("run_id") == F.col("_best")).drop("_best")


def apply_edits(runs: DataFrame, edits: DataFrame) -> DataFrame:
    """The ledger (run_id, name, created_at, is_baseline, exports) after a batch of edits (run_id, action, argument).

    delete drops a run; rename gives it the argument as name; duplicate adds `Copy of NAME` under the id of the argument,
    no baseline, no exports; baseline makes it the baseline (the last argument wins). Names are then made unique and one
    baseline is set. Edits of unknown runs do nothing.
    """
    one = lambda action: edits.filter(F.col("action") == action)
    kept = runs.join(one("delete").select("run_id"), "run_id", "left_anti")
    new_names = one("rename").groupBy("run_id").agg(F.max("argument").alias("_new"))
    kept = kept.join(new_names, "run_id", "left").withColumn("name", F.coalesce("_new", "name")).drop("_new")
    chosen = one("baseline").join(kept.select("run_id"), "run_id", "left_semi").agg(F.max_by("run_id", F.struct("argument", "run_id")).alias("_chosen"))
    copies = kept.join(one("duplicate").select("run_id", "argument"), "run_id").select(
        F.col("argument").cast(runs.schema["run_id"].dataType).alias("run_id"), F.concat(F.lit("Copy of "), "name").alias("name"), F.expr("created_at + interval 1 day").alias("created_at"),
        F.lit(False).alias("is_baseline"), F.lit(None).cast(runs.schema["exports"].dataType).alias("exports"),
    )
    rows = kept.select("run_id", "name", "created_at", "is_baseline", "exports").unionByName(copies)
    named = unique_names(rows).drop("name").withColumnRenamed("unique_name", "name")
    flagged = named.crossJoin(F.broadcast(chosen))
    rank = F.struct(F.when(F.col("run_id") == F.col("_chosen"), 0).otherwise(1), (~F.coalesce("is_baseline", F.lit(False))).cast("int"), F.col("created_at"), F.col("run_id"))
    best = flagged.agg(F.min_by("run_id", rank).alias("_best"))
    return flagged.crossJoin(F.broadcast(best)).withColumn("is_baseline", F.col("run_id") == F.col("_best")).drop("_best", "_chosen")


def cache_hits(requests: DataFrame, computed: DataFrame, key: str = "cache_key") -> DataFrame:
    """Requested runs whose key is computed already."""
    return requests.join(computed.select(key), key, "left_semi")


def cache_misses(requests: DataFrame, computed: DataFrame, key: str = "cache_key") -> DataFrame:
    """Requested runs still to compute."""
    return requests.join(computed.select(key), key, "left_anti")


def run_duplicates(runs: DataFrame, key: str = "cache_key") -> DataFrame:
    """Keys shared by several runs: cache_key, runs, first_run (the earliest)."""
    return runs.groupBy(key).agg(F.count("*").alias("runs"), F.min_by("run_id", F.struct("created_at", "run_id")).alias("first_run")).filter("runs > 1")


def resume_run(pointers: DataFrame, runs: DataFrame) -> DataFrame:
    """pointers (owner, run_id) with resumed: that run if it still exists, else the latest by created_at."""
    latest = runs.agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("_latest"))
    known = runs.select("run_id").distinct().withColumn("_known", F.col("run_id"))
    return pointers.join(known, "run_id", "left").crossJoin(F.broadcast(latest)).select(*pointers.columns, F.coalesce("_known", "_latest").alias("resumed"))


def latest_runs(runs: DataFrame, n: int = 3) -> DataFrame:
    """The last n runs by created_at (a top-n report)."""
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(n)
