"""How filters interact: what each removes in every order of applying them, from counts of failure masks and a recursive query."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cosmotab.llm.common import written

WORD_BREAK = r"[\x20\x09-\x0D]+"
_BLANK = " \t\n\x0b\f\r"
#: The letter of the filter of repeated texts.
REPEATED = "E"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of a text (not null) by filter letter: A under 50 words, B under 65 % distinct words, C over 5 %
    capitals, D any of #$%&*|. Words are runs without ASCII white space. Built-in functions only."""
    bare = F.btrim(text, F.lit(_BLANK))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_BREAK))
    capitals = F.length(F.regexp_replace(text, F.lit("[^A-Z]+"), F.lit("")))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_cells(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", part_col: str = "source") -> tuple[DataFrame, str]:
    """(cells, letters): part, mask, n, good, toxic, the documents of each part by the filters that they fail (bit i of the
    mask: letter i), with those labelled quality 1 and toxic 1; a row only where there are documents.

    Filter E fails a text that a smaller id has too, anywhere in the table. Texts are compared by SHA-256: the first id of
    a text is a minimum over digests, so copies, a third of the table or more, are summed before they are shuffled, and
    only rows of about 70 bytes a document ever move. A null or empty text is the empty text; a null part the empty
    string; a null id has no labels, fails no E and makes none fail; rows of one id and text don't make each other fail;
    several label rows of an id count as one that holds what any of them says. Columns of other names don't matter.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    failures = text_failures(F.col("text"))
    letters = "".join(failures) + REPEATED
    bits = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(failures.values())), F.lit(0))
    slim = own.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("mask")).groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    spread = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("bigint"))  # null ids have no labels: they don't meet in one task
    slim = slim.withColumn("spread", spread).join(marked.withColumn("spread", F.lit(0).cast("bigint")), ["id", "spread"], "left")
    slim = slim.withColumns({"good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})
    copies = slim.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(F.lit(0))).alias("unnumbered"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first")
    )
    firsts = copies.groupBy("digest").agg(F.min("first.id").alias("least"))
    stays = F.col("unnumbered") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    halves = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("stays").alias("n")), F.struct((F.col("mask") + (1 << len(failures))).alias("mask"), (F.col("n") - F.col("stays")).alias("n"))))
    rows = copies.join(firsts, "digest").withColumn("stays", stays).select("part", "good", "toxic", halves.alias("h")).filter("h.n > 0")
    some = lambda c: F.sum(F.when(F.col(c), F.col("h.n")).otherwise(F.lit(0)))
    return rows.groupBy("part", F.col("h.mask").alias("mask")).agg(F.sum("h.n").alias("n"), some("good").alias("good"), some("toxic").alias("toxic")), letters


def interactions(cells: DataFrame, letters: str) -> DataFrame:
    """For each part of the cells (part, mask, n, good, toxic), each order of the letters and each step: part, filter_order,
    step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (removed by the step's filter, summed over
    all orders).

    A recursive query starts with the masks that occur and no filter, and extends each prefix by every letter that it
    hasn't yet, carrying the bits applied so far; a row of a level says what its step does to documents of its mask. That
    table has at most 2^k masks and sum k!/(k-s)! prefixes for k letters (10,400 rows for 5), whatever the input; it is stored
    once and broadcast to the cells. A prefix is worked out once for all orders that begin with it. Zeros are rows, as every cell of
    a part meets every prefix; no cells give no rows. A part of any number of documents has 2^k cells at most.
    """
    k = len(letters)
    spark = cells.sparkSession
    named = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(letters))
    weights = " ".join(f"WHEN {s} THEN {math.factorial(k - s)}" for s in range(1, k + 1))
    walk = spark.sql(
        f"""
WITH RECURSIVE letters (letter, bit) AS (VALUES {named}),
walk (mask, prefix, letter, applied, step, kept, removed, redundant, unique_fails) AS (
  SELECT DISTINCT mask, '', '', 0, 0, true, false, false, false FROM {{cells}}
  UNION ALL
  SELECT w.mask, concat(w.prefix, l.letter), l.letter, w.applied | l.bit, w.step + 1, w.kept AND (w.mask & l.bit) = 0, w.kept AND (w.mask & l.bit) <> 0,
    NOT w.kept AND (w.mask & l.bit) <> 0, w.mask = l.bit
  FROM walk w JOIN letters l ON (w.applied & l.bit) = 0
)
SELECT * FROM walk WHERE step > 0
""",
        cells=cells,
    )
    return spark.sql(
        f"""
WITH steps AS (
  SELECT /*+ BROADCAST(w) */ c.part, w.prefix, w.letter, w.step, sum(if(w.kept, c.n, 0)) AS kept, sum(if(w.removed, c.n, 0)) AS removed, sum(if(w.redundant, c.n, 0)) AS redundant,
    sum(if(w.unique_fails, c.n, 0)) AS unique_fails, sum(if(w.removed, c.good, 0)) AS good_lost, sum(if(w.removed, c.toxic, 0)) AS toxic_lost
  FROM {{cells}} c JOIN {{walk}} w ON c.mask = w.mask GROUP BY c.part, w.prefix, w.letter, w.step
),
valued AS (SELECT *, sum(removed * CASE step {weights} END) OVER (PARTITION BY part, letter) AS shapley FROM steps),
orders AS (SELECT prefix AS filter_order, explode(sequence(1, {k})) AS step FROM (SELECT DISTINCT prefix FROM {{walk}} WHERE step = {k}))
SELECT /*+ BROADCAST(o) */ v.part, o.filter_order, o.step, v.kept, v.removed, v.redundant, v.unique_fails, v.good_lost, v.toxic_lost, v.shapley
FROM valued v JOIN orders o ON v.prefix = substring(o.filter_order, 1, o.step)
""",
        cells=cells,
        walk=written(walk),
    )


#: The same for DuckDB, from the plain definitions: every document's mask, and a recursive walk over its cells.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ \t\n\x0b\f\r]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT doc_id, part, (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
o AS (SELECT '' AS filter_order, 0 AS applied UNION ALL SELECT filter_order || letter, applied + bit FROM o JOIN f ON (applied & bit) = 0),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS INTEGER), 1) AS letter FROM o, range(1, 6) AS r(step) WHERE length(filter_order) = 5),
b AS (SELECT s.filter_order, s.step, s.letter, f.bit, (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE position(g.letter IN s.filter_order) < s.step) AS earlier FROM s JOIN f USING (letter)),
x AS (SELECT part, filter_order, step, letter, sum(CASE WHEN mask & earlier = 0 AND mask & bit = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, (SELECT filter_order, step, letter, CAST(bit AS BIGINT) AS bit, CAST(earlier AS BIGINT) AS earlier FROM b) GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM x
"""
