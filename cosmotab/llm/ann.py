"""Nearest neighbours by cosine: 2-stable projections to a few dimensions, a kd-tree over them, a chi-square stop.

A Gaussian projection of a difference of two vectors has, divided by their distance, a chi-square distribution with as
many degrees of freedom as dimensions. Candidates are verified in the order of their projected distance; once a nearer
neighbour than the k-th best so far would have come up already with probability STOP, the search ends.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 16
LEAF = 64
STOP = 0.9
#: More than what matrix products and the exact measure may differ by.
ROUNDING = 1e-9
#: Vectors of one cell of the top of the tree; each cell is one kd-tree, the memory of one task.
CELL_ROWS = 8192
#: Queries that one task holds against one cell.
QUERY_ROWS = 4096
#: Bound of the fit: bytes of the sample of vectors that gives the top of the tree and the first radius of each query.
SAMPLE_BYTES = 4 << 20
#: ... and so large a part of the table at most.
SAMPLE_SHARE = 1 / 16
#: Candidates that are verified between two looks at the stop.
STEP = 32


def chi_square_cdf(x: np.ndarray | float, dimensions: int) -> np.ndarray | float:
    """The closed form for an even number of degrees of freedom."""
    half = np.minimum(np.asarray(x) / 2, 700.0)
    return 1 - np.exp(-half) * sum(half**i / factorial(i) for i in range(dimensions // 2))


def chi_square_quantile(share: float, dimensions: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, dimensions) < share else (low, middle)
    return high


class Tree:
    """A kd-tree over projected points, split at medians of the widest axis until a leaf holds `leaf` points.

    `order` holds the points leaf by leaf; lo and hi are the leaves' boxes: of their points, or of their part of space.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF, whole_space: bool = False):
        wide = np.full(points.shape[1], np.inf)
        stack, leaves, boxes = [(np.arange(len(points)), -wide, wide, -1)], [], []
        axes: list[int] = []  # of each inner node; with its cut and its two children (a leaf as -1 - its number)
        cuts: list[float] = []
        children: list[list[int]] = []
        while stack:
            idx, low, high, parent = stack.pop()
            spread = np.ptp(points[idx], axis=0) if len(idx) > leaf else np.zeros(1)
            axis = int(np.argmax(spread))
            inner = spread[axis] > 0  # more than a leaf's points, and not all equal
            if parent >= 0:
                children[parent].append(len(axes) if inner else -1 - len(leaves))
            if not inner:
                leaves.append(idx)
                boxes.append((low, high))
                continue
            half = len(idx) // 2
            idx = idx[np.argpartition(points[idx, axis], half)]
            middle, below = low.copy(), high.copy()
            middle[axis] = below[axis] = points[idx[half], axis]
            axes.append(axis)
            cuts.append(middle[axis])
            children.append([])
            stack += [(idx[half:], middle, high, len(axes) - 1), (idx[:half], low, below, len(axes) - 1)]
        self.axes, self.cuts, self.children = np.array(axes, np.int64), np.array(cuts), np.array(children, np.int64)
        self.order = np.concatenate(leaves)
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in leaves])])
        if whole_space:
            self.lo, self.hi = (np.stack(x) for x in zip(*boxes, strict=True))
        else:
            self.lo = np.stack([points[x].min(axis=0) for x in leaves])
            self.hi = np.stack([points[x].max(axis=0) for x in leaves])

    def box_distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distances from a point to all leaves' boxes."""
        return (np.maximum(0, np.maximum(self.lo - q, q - self.hi)) ** 2).sum(axis=1)

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf whose part of space holds each point: all points go down the tree together, a level a step."""
        node = np.full(len(points), 0 if len(self.axes) else -1)
        while len(inner := np.flatnonzero(node >= 0)):
            at = node[inner]
            node[inner] = self.children[at, (points[inner, self.axes[at]] >= self.cuts[at]).astype(int)]
        return -1 - node


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with q in double precision, the same for equal rows wherever they stand."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def radius(least: float, enough: float) -> float:
    """The squared projected distance beyond which a vector of a larger cosine than `least` lies with probability 1 - STOP."""
    return np.inf if least < -1.5 else enough * max(2 - 2 * least, 1e-12)  # 2 - 2 c is the squared distance of unit vectors at cosine c


class Index:
    """The projection, and the top of the kd-tree from a bounded sample: its leaves are the cells of the whole table."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, total: int, cell_rows: int, seed: int, stop: float, k: int):
        distinct, self.inverse = np.unique(sample, axis=0, return_inverse=True)
        self.ids, self.sample = ids, sample
        self.units = unit(distinct)
        self.projection = np.random.default_rng(seed).standard_normal((sample.shape[1], DIMENSIONS))
        cells = max(1, -(-total // cell_rows))
        self.top = Tree(self.units @ self.projection, max(8, len(distinct) // cells), whole_space=True)
        self.enough, self.k = chi_square_quantile(stop, DIMENSIONS), k

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return unit(vectors) @ self.projection

    def floor(self, score: np.ndarray) -> float:
        """The cosine that a query's k-th neighbour has at least, by its cosines with the sample's distinct vectors, one of
        which may be its own; -2 if the sample is too small."""
        return float(np.partition(score, len(score) - self.k - 1)[-self.k - 1]) - ROUNDING if len(score) > self.k else -2.0

    def near(self, query_ids: np.ndarray, vectors: np.ndarray) -> list[tuple[int, int | None, float | None, int]]:
        """(query, id, cosine, verified) of each query's k best in the sample, so that a query never ends with fewer."""
        out = []
        for qid, q, u in zip(query_ids, vectors, unit(vectors), strict=True):
            score = self.units @ u
            rows = np.flatnonzero((score >= self.floor(score) - ROUNDING)[self.inverse.ravel()])
            best = {(-s, int(i)) for s, i in zip(cosine(self.sample[rows], q), self.ids[rows], strict=True) if i != qid}
            found = [(int(qid), i, -s, 0) for s, i in sorted(best)[: self.k]] or [(int(qid), None, None, 0)]
            out += [(*found[0][:3], len(score)), *found[1:]]
        return out

    def wanted(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell) pairs of the cells within each query's radius, and the queries' first bounds of their k-th cosine."""
        rows, cells, least = [], [], np.zeros(len(vectors))
        for r, (u, p) in enumerate(zip(unit(vectors), self.project(vectors), strict=True)):
            least[r] = self.floor(self.units @ u)
            near = np.flatnonzero(self.top.box_distances(p) <= radius(least[r], self.enough))
            rows.append(np.full(len(near), r))
            cells.append(near)
        return np.concatenate(rows), np.concatenate(cells), least


def search_cell(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, index: Index) -> pd.DataFrame:
    """The k nearest found in one cell for each query (query_id, vec_id, score), with the count of verified vectors in each
    query's first row (a row without vec_id where none is near)."""
    k, enough = index.k, index.enough
    _, once = np.unique(np.column_stack([ids.astype(np.float64), vectors]), axis=0, return_index=True)
    once.sort()
    ids, vectors = ids[once], vectors[once]
    distinct, inverse = np.unique(vectors, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    by_id = np.lexsort((ids, inverse))
    first = np.searchsorted(inverse[by_id], np.arange(len(distinct) + 1))
    units = unit(distinct)
    points = units @ index.projection
    tree = Tree(points)
    units, points = units[tree.order], points[tree.order]  # leaf by leaf, so that a leaf is one stretch of memory
    out: list[tuple[int, int | None, float | None, int]] = []
    asked = unit(queries)
    for qid, q, u, p, floor in zip(query_ids, queries, asked, asked @ index.projection, least, strict=True):
        reach = tree.box_distances(p) <= radius(floor, enough)
        rows = np.concatenate([np.arange(a, b) for a, b in zip(tree.starts[:-1][reach], tree.starts[1:][reach], strict=True)]) if reach.any() else np.zeros(0, np.int64)
        far = ((points[rows] - p) ** 2).sum(axis=1)
        inside = np.flatnonzero(far <= radius(floor, enough))
        inside = inside[np.argsort(far[inside], kind="stable")]
        rows, far = rows[inside], far[inside]
        top, near, scores, done, step = np.zeros(0), [], [], 0, STEP
        bound = floor
        while done < len(rows) and far[done] <= radius(bound, enough):
            part = rows[done : done + step]
            score = units[part] @ u
            done += len(part)
            step *= 2
            hits = score >= bound - ROUNDING
            near.append(part[hits])
            scores.append(score[hits])
            top = np.concatenate([top, score[hits]])
            if len(top) > k:  # the query's own vector may be among the best k + 1
                top = np.partition(top, len(top) - k - 1)[-k - 1 :]
                bound = max(bound, float(top[0]))
        best: list[tuple[float, int]] = []
        if near:
            found, score = np.concatenate(near), np.concatenate(scores)
            found = tree.order[found[score >= bound - ROUNDING]]
            exact = cosine(distinct[found], q)
            best = [(-s, int(i)) for r, s in zip(found, exact, strict=True) for i in ids[by_id[first[r] : min(first[r + 1], first[r] + k + 1)]] if i != qid]  # of equal vectors the smallest ids win
        made = [(qid, i, -s, 0) for s, i in sorted(best)[:k]] or [(qid, None, None, 0)]
        made[0] = (*made[0][:3], done)
        out += made
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "verified"]).astype({"query_id": "int64", "vec_id": "Int64", "score": "float64", "verified": "int64"})


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array of equally long lists of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(
    vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", cell_rows: int = CELL_ROWS, seed: int = 7, stop: float = STOP, sample_bytes: int = SAMPLE_BYTES
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score, verified: for each query its k nearest vectors found by cosine, itself left
    out, and how many vectors were compared with it in full, those of the sample included.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, as
    candidates or queries; null ids neither. Repeated rows of one id and vector count once. Fewer candidates than k: all
    of them. Score ties go to the smaller id; equal vectors share one point of the index. An empty table gives an empty
    result; columns beside id and vector, of any name, aren't read. There is no text.

    A sample of at most about sample_bytes of vectors (documented bound of the fit) gives the top of the tree, whose
    leaves are cells of about cell_rows vectors (more where the sample is too small for so many), and for each query a first bound of its k-th cosine. A vector is dealt
    to its one cell, a query to those cells alone whose box lies within the radius of that bound; a cell with more than
    twice that, whatever its size, is split by hashed vector into parts of their own trees. A task holds one part
    and QUERY_ROWS queries. The table of vectors is shuffled once. In a batch of equal vectors the k + 1 smallest ids go
    on, so copies of one vector don't pile up in a cell.
    """

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("v")
        ok = F.size(v) > 0
        ok &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & ok)

    spark = vectors.sparkSession
    base, asked = usable(vectors), usable(queries)
    width, total = base.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first() or (1, 0)
    base, asked = base.filter(F.size("v") == width), asked.filter(F.size("v") == width).dropDuplicates(["id", "v"])
    share = min(SAMPLE_SHARE, sample_bytes / (8 * width * max(total, 1)))
    drawn = base.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= int(share * (1 << 20))).limit(max(1, sample_bytes // (8 * width))).toArrow()
    if not drawn.num_rows:  # of a small table
        drawn = base.limit(1).toArrow()
    if not drawn.num_rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, verified bigint")
    held = spark.sparkContext.broadcast(Index(drawn["id"].to_numpy(), _matrix(drawn["v"].combine_chunks()), total, cell_rows, seed, stop, k))

    def dealt(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column(0).to_numpy(), _matrix(batch.column(1))
            _, inverse = np.unique(v, axis=0, return_inverse=True)
            by = np.lexsort((ids, inverse.ravel()))
            group = inverse.ravel()[by]
            fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (ids[by][1:] != ids[by][:-1])])
            by, group = by[fresh], group[fresh]
            start = np.searchsorted(group, group)
            keep = by[np.arange(len(by)) - start <= k]
            cell = held.value.top.place(held.value.project(v[keep]))
            rows = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(cell, pa.int32())], names=["id", "v", "cell"])

    def sent(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, cells, least = held.value.wanted(_matrix(batch.column(1)))
            whole = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([whole.column(0), whole.column(1), pa.array(cells, pa.int32()), pa.array(least[rows])], names=["id", "v", "cell", "least"])

    def sampled(batches):
        for batch in batches:
            rows = held.value.near(batch.column(0).to_numpy(), _matrix(batch.column(1))) if batch.num_rows else []
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, names=["query_id", "vec_id", "score", "verified"])

    cells = base.mapInArrow(dealt, "id bigint, v array<double>, cell int")
    asks = asked.mapInArrow(sent, "id bigint, v array<double>, cell int, least double")
    # parts of large cells, and shares of their queries: small tables, one row a cell
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / (2 * cell_rows)).cast("int").alias("parts"))
    shares = asks.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("shares"))
    plan = {r["cell"]: (r["parts"], r["shares"]) for r in parts.join(shares, "cell", "left").select("cell", "parts", F.coalesce("shares", F.lit(0)).alias("shares")).collect()}
    split = lambda: F.broadcast(spark.createDataFrame([(c, p, s) for c, (p, s) in plan.items() if s], "cell int, parts int, shares int"))
    pick = lambda what, n: F.pmod(F.xxhash64(what), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = cells.join(split(), "cell").withColumn("part", pick("v", "parts")).withColumn("share", every("shares"))
    asks = asks.join(split(), "cell").withColumn("share", pick("id", "shares")).withColumn("part", every("parts"))
    places = max(1, sum(p * s for p, s in plan.values()))

    def search(b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(b) or not len(q):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": pd.array([], "Int64"), "score": np.zeros(0), "verified": np.zeros(0, np.int64)})
        return search_cell(b["id"].to_numpy(), np.stack(b["v"].to_numpy()), q["id"].to_numpy(), np.stack(q["v"].to_numpy()), q["least"].to_numpy(), held.value)

    keys = ["cell", "part", "share"]
    found = cells.repartition(places, *keys).groupBy(*keys).cogroup(asks.repartition(places, *keys).groupBy(*keys)).applyInPandas(search, "query_id bigint, vec_id bigint, score double, verified bigint")
    found = found.unionByName(asked.mapInArrow(sampled, found.schema))
    best = F.slice(F.array_sort(F.collect_set(F.when(F.col("vec_id").isNotNull(), F.struct((-F.col("score")).alias("s"), "vec_id")))), 1, k)
    out = found.groupBy("query_id").agg(best.alias("best"), F.sum("verified").alias("verified"))
    out = out.select("query_id", "verified", F.posexplode("best").alias("p", "b"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"), "verified")
