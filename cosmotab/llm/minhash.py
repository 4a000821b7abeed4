"""Near-duplicate documents: MinHash signatures and a multi-index Hamming join, confirmed on the full shingle sets.

A signature has lanes of 16 bits. The index lanes are split into chunks of 4; for every chunk and every choice of one
lane that may differ, the other three lanes make a key. Two signatures that differ in fewer than 2 lanes for each chunk
are bound to agree in some chunk up to one lane (pigeonhole), so every pair under that distance shares a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cosmotab.llm.common import map_texts, utf8_view, written
from cosmotab.llm.common import mix64 as _mix

LANES = 64
CHUNK = 4
#: The chunks are so many that a pair right at the similarity threshold is missed with at most this probability.
MISS = 2e-6
#: Members of one group that a block compares with those of another block: by signature, and by full sets.
SIGNATURE_BLOCK, BLOCK = 2048, 256
#: Bucket entries of a hub for each share of its group: what a hub's members need of it is sent to every share.
SHARE = 16_384
#: Most lanes that an index can have.
MOST_LANES = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240229)
_OF_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_MULTIPLY = _rng.integers(0, 1 << 63, MOST_LANES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 64, MOST_LANES, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name][:n]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lowered, ASCII white space between words), and the n + 1 offsets of the texts."""
    data, at = utf8_view(texts)
    n = len(data)
    data = _LOWER[data]
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)  # a text begins or ends here
    edge[at] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]]))) if n else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))) + 1 if n else starts
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[data] * _power("up", _BASE, n), dtype=np.uint64)])
    inverse = pow(_BASE, -1, 1 << 64)
    return _mix((total[ends] - total[starts]) * _power("down", inverse, n + 1)[starts]), np.searchsorted(starts, at)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of the k-word shingles of each text, in one flat array with n + 1 offsets.

    A text of fewer than k words, but not none, has one shingle of all its words.
    """
    word, at = word_hashes(texts)
    count = np.diff(at)
    doc = np.repeat(np.arange(len(count)), count)
    factor = np.uint64(0xD6E8FEB86659FD93)
    m = len(word) - k + 1
    if m > 0:
        h = np.zeros(m, np.uint64)
        for j in range(k):
            h = _mix(h * factor + word[j : j + m])
        whole = doc[:m] == doc[k - 1 :]
        h, of = h[whole], doc[:m][whole]
    else:
        h, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        g = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            on = count[short] > j
            g[on] = _mix(g[on] * factor + word[at[short[on]] + j])
        h, of = np.concatenate([h, g]), np.concatenate([of, short])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    if len(h):
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
        h, of = h[fresh], of[fresh]
    return h, np.searchsorted(of, np.arange(len(count) + 1))


def chunks_for(similarity: float) -> int:
    """So many chunks that a pair at this similarity misses all of them with probability MISS at most."""
    missed = 1 - sum(comb(CHUNK, i) * (1 - similarity) ** i * similarity ** (CHUNK - i) for i in range(2))
    chunks = 1 if missed <= 0 else max(1, int(np.ceil(np.log(MISS) / np.log(missed))))
    if chunks * CHUNK > MOST_LANES:
        raise ValueError(f"an index for similarity {similarity} would need {chunks * CHUNK} lanes")
    return chunks


def lanes_apart(similarity: float) -> int:
    """Of all LANES lanes so many may differ that a pair at this similarity differs in more with probability 1e-7 at most."""
    d = 1 - similarity
    tail = 1.0
    for k in range(LANES + 1):
        tail -= comb(LANES, k) * d**k * similarity ** (LANES - k)
        if tail < 1e-7:
            return k
    return LANES


def set_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sixteen bytes for each set of shingle hashes, equal for equal sets (two independent sums of its hashes)."""
    keys = np.zeros((len(at) - 1, 2), np.uint64)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        keys[some, 0] = np.add.reduceat(_mix(h + np.uint64(1)), at[some])
        keys[some, 1] = np.add.reduceat(_mix(h + np.uint64(2)), at[some])
    return keys


def lanes_of(h: np.ndarray, begin: np.ndarray, lanes: int) -> np.ndarray:
    """The MinHash lanes, 16 bits each, of the sets that begin at these places of h."""
    sig = np.zeros((len(begin), lanes), np.uint16)
    for lane in range(lanes):
        sig[:, lane] = np.minimum.reduceat((h * _MULTIPLY[lane] + _ADD[lane]) >> np.uint64(24), begin) & np.uint64(0xFFFF)
    return sig


def index_keys(sig: np.ndarray, chunks: int) -> np.ndarray:
    """For each signature chunks * CHUNK keys: of each chunk without one of its lanes."""
    keys, wide = np.zeros((len(sig), chunks * CHUNK), np.int64), sig.astype(np.uint64)
    for c in range(chunks):
        for wild in range(CHUNK):
            key = np.full(len(sig), c * CHUNK + wild + 1, np.uint64)
            for lane in range(CHUNK):
                if lane != wild:
                    key = _mix((key << np.uint64(16)) ^ wide[:, c * CHUNK + lane] ^ (key >> np.uint64(48)))
            keys[:, c * CHUNK + wild] = key.view(np.int64)
    return keys


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary array of the rows' bytes."""
    width = rows.dtype.itemsize * rows.shape[1]
    offsets = pa.array(np.arange(len(rows) + 1) * width, pa.int32())
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def signatures(docs: DataFrame, *, id_col: str, text_col: str, k: int, chunks: int) -> DataFrame:
    """doc, text_hash, n (set size), node (key of the whole set), sig (LANES lanes) and keys (of the index) of each row."""

    def make():
        def work(texts: pa.Array) -> list:
            h, at = shingle_sets(texts, k)
            n = np.diff(at)
            some = np.flatnonzero(n)
            lanes = lanes_of(h, at[some], max(LANES, chunks * CHUNK)) if len(some) else np.zeros((0, LANES), np.uint16)
            sig = np.zeros((len(n), LANES), np.uint16)
            sig[some] = lanes[:, :LANES]
            rows = np.concatenate([[0], np.cumsum(n > 0)])
            lists = pa.ListArray.from_arrays(pa.array(rows * chunks * CHUNK, pa.int32()), pa.array(index_keys(lanes, chunks).ravel()))
            return [n, _binary(set_keys(h, at)), _binary(sig), lists]

        return work

    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    made = map_texts(rows, "text", make, "n bigint, node binary, sig binary, keys array<bigint>", ["doc", "text_hash"], budget=1 << 20)
    return made.select("row.doc", "row.text_hash", "n", "node", "sig", "keys")


def _sets(docs: DataFrame, nodes: DataFrame, *, id_col: str, text_col: str, k: int) -> DataFrame:
    """node and its full shingle set (array of hashes) for the rows of nodes (node, doc): of doc's texts the one with that set."""

    def make():
        def work(texts: pa.Array) -> list:
            h, at = shingle_sets(texts, k)
            return [_binary(set_keys(h, at)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.view(np.int64)))]

        return work

    wanted = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(nodes, "doc")
    made = map_texts(wanted, "text", make, "found binary, shingles array<bigint>", ["node"], budget=1 << 20)
    return made.filter("found = row.node").select("row.node", "shingles").dropDuplicates(["node"])


def _shares(weight: str = "weight") -> Column:
    """Into how many shares the group of a hub of this weight is split: its weight bounds its number of members."""
    return F.ceil((F.col(weight) + 1) / SHARE).cast("int")


def _share(node: str) -> Column:
    """The share of a member, from its hub's weight alone: no count has to be looked up."""
    return F.pmod(F.xxhash64(node), _shares()).cast("int").alias("share")


def _every_share(hubs: DataFrame) -> DataFrame:
    """A row of hubs for each share of its group."""
    return hubs.withColumn("share", F.explode(F.sequence(F.lit(0), _shares() - 1)))


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, weight) of members a and their hubs b whose full sets have den * intersection >= num * union. A hub's
    set goes once to each share of its group."""
    hubs = _every_share(pairs.select("b", "weight").distinct().join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").withColumn("share", _share("a"))
    both = both.join(hubs.drop("weight"), ["b", "share"])
    common = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    union = F.size("sa") + F.size("sb") - common
    return both.filter(common * den >= union * num).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node reachable from it (label) for all nodes of the edges (a, b): large-star and small-star
    steps until nothing changes. A step is two aggregations and joins by node; nothing of a group meets in one row."""
    edges = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = None
    while True:
        seen = Observation()
        edges = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")))
        if seen.get == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        state = seen.get
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        pair = lambda x: F.struct(F.col(x).alias("a"), F.col("low").alias("b"))
        edges = large.join(low, "a").select(F.explode(F.array(pair("a"), pair("b"))).alias("e")).select("e.a", "e.b").filter("a != b").distinct()


def roots(parents: DataFrame) -> DataFrame:
    """node and the root of its tree (label) for a forest of parents (a, b), b above a: pointers double in each step."""
    state = written(parents.select(F.col("a").alias("node"), F.col("b").alias("label")))
    while True:
        above = state.select(F.col("node").alias("label"), F.col("label").alias("above"))
        seen = Observation()
        moved = state.join(above, "label", "left").observe(seen, F.count("above").alias("moved"))
        state = written(moved.select("node", F.coalesce("above", "label").alias("label")))
        if not seen.get["moved"]:
            return state


def _deal(members: DataFrame, block: int) -> DataFrame:
    """members (hub, weight, node, label, major, ...) dealt to block pairs (i, j) of their hub's group, so that every pair of
    members with different labels meets in one of them. i is a block of the group's other members; j a block of its
    majority (the hub's component; from 0 up) or of its other members (below 0). Groups of the majority alone go."""
    facts = members.groupBy("hub", "weight").agg(F.count_if("major").alias("majors"), F.count_if(~F.col("major")).alias("others")).filter("others > 0")
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("major"), blocks("majors")).otherwise(blocks("others"))).cast("int")
    facts = _every_share(facts).drop("weight")
    rows = members.withColumn("share", _share("node")).join(facts, ["hub", "share"]).withColumn("own", own)
    every = F.sequence(F.lit(0), blocks("others") - 1)
    as_major = F.transform(every, lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))
    with_major = F.transform(F.sequence(F.lit(0), blocks("majors") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j")))
    with_others = F.transform(every, lambda i: F.struct(F.least(i, F.col("own")).alias("i"), (-1 - F.greatest(i, F.col("own"))).alias("j")))
    places = F.when(F.col("major"), as_major).otherwise(F.concat(with_major, with_others))
    return rows.select(*members.columns, F.explode(places).alias("at")).select(*members.columns, F.col("at.i").alias("i"), F.col("at.j").alias("j"))


def _alive(rows: Iterator[pa.RecordBatch], apart: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """(hub, node) of the members that have, in a block pair of a sorted stream, a partner of another label whose size and
    signature allow a link."""
    keys = ("hub", "i", "j")
    rest: pa.Table | None = None

    def partners(t: pa.Table) -> pa.RecordBatch:
        group = np.stack([t[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in keys])
        g = np.cumsum(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(axis=0)]))
        label = t["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        n, major = t["n"].to_numpy(), t["major"].to_numpy()
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(-1, LANES)
        found = np.zeros(len(g), bool)
        for d in range(1, len(g)):
            x = np.flatnonzero(g[d:] == g[:-d])
            if not len(x):
                break
            x = x[(label[x] != label[x + d]) & ~(major[x] & major[x + d]) & (np.minimum(n[x], n[x + d]) * den >= np.maximum(n[x], n[x + d]) * num)]
            x = x[(sig[x] != sig[x + d]).sum(axis=1) <= apart]
            found[x] = found[x + d] = True
        return t.select(["hub", "node"]).filter(pa.array(found)).combine_chunks()

    for batch in rows:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        same = np.ones(t.num_rows, bool)
        for c in keys:
            codes = t[c].combine_chunks().dictionary_encode().indices.to_numpy()
            same &= codes == codes[-1]
        cut = int(np.flatnonzero(~same).max(initial=-1)) + 1
        rest = t.slice(cut)
        if cut:
            yield from partners(t.slice(0, cut)).to_batches()
    if rest is not None and rest.num_rows:
        yield from partners(rest).to_batches()


def _links(t: pa.Table, num: int, den: int) -> pa.Table:
    """Pairs of labels (a, b) that links join in one block pair: all members' pairs are compared on their full sets, by products
    of 0/1 matrices over the shingles that occur twice; a spanning forest of the labels goes out."""
    rows = t.num_rows
    sizes = np.diff(t["shingles"].combine_chunks().offsets.to_numpy())
    shingle = t["shingles"].combine_chunks().flatten().to_numpy()
    of = np.repeat(np.arange(rows), sizes)
    _, code, times = np.unique(shingle, return_inverse=True, return_counts=True)
    fresh = np.cumsum(times > 1) - 1
    again = times[code] > 1
    code, of = fresh[code[again]], of[again]
    common = np.zeros((rows, rows), np.float32)
    order = np.argsort(code, kind="stable")
    code, of = code[order], of[order]
    width = 4096
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        lo, hi = np.searchsorted(code, [first, first + width])
        held = np.zeros((rows, width), np.float32)
        held[of[lo:hi], code[lo:hi] - first] = 1
        common += held @ held.T
    inter = common.astype(np.int64)
    label = t["label"].combine_chunks().dictionary_encode().indices.to_numpy()
    linked = (inter * den >= (sizes[:, None] + sizes[None, :] - inter) * num) & (label[:, None] != label[None, :])
    root = list(range(int(label.max()) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    left, right = [], []
    for x, y in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        p, q = find(label[x]), find(label[y])
        if p != q:
            root[p] = q
            left.append(x)
            right.append(y)
    name = t["label"].combine_chunks()
    return pa.table({"a": name.take(pa.array(left, pa.int64())), "b": name.take(pa.array(right, pa.int64()))})


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc, text_hash (xxhash64 of the text), n_shingles and component (smallest id reachable over links, itself included),
    one row per row of docs.

    Documents are linked if den * |intersection| >= num * |union| of their sets of distinct k-word shingles (a text with
    fewer words is one shingle). Null, empty and blank texts have empty sets and are linked with nothing; a null id takes
    part in no link. Every row is a document: rows of one id with different texts are linked each by its own text, and
    repeated rows are copies of each other. Texts of any length are taken whole; an empty table gives an empty result;
    columns of docs beside id and text, of any name, aren't read. Ties can't arise: a component has one smallest id.
    Copies collapse first: of each distinct set one row goes on.

    Candidates come from the Hamming index in two rounds. First each set meets the most popular member (hub) of the
    buckets it shares most with, which joins groups of near copies at the cost of one comparison a member. Buckets of one
    hub then count as one group. Groups that still hold several components are compared in pairs of blocks, split over
    the tasks: first by sizes and LANES lanes in blocks of about SIGNATURE_BLOCK, to find the members with a possible
    partner, then those by their full sets in blocks of BLOCK. A group of n members makes n * n / SIGNATURE_BLOCK rows
    with signatures only where it holds about n sets that no hub joins. Of the links a block pair gives only those that
    join components, so no step makes the pairs of a group as rows. No bucket is capped, no task or row holds a bucket as
    a whole, and what members need of their hub is sent to shares of its group of bounded size.
    """
    similarity = num / den
    chunks = chunks_for(similarity)
    sigs = written(signatures(docs, id_col=id_col, text_col=text_col, k=k, chunks=chunks))
    reps = written(
        sigs.filter("n > 0 and doc is not null").groupBy("node").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    )
    postings = reps.select("node", F.explode("keys").alias("key"))
    full = postings.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    shared = written(postings.join(full, "key"))

    popular = shared.groupBy("node").agg(F.sum("c").alias("popularity"))
    hubs = shared.join(popular, "node").groupBy("key").agg(F.max(F.struct("popularity", "node")).alias("top"))
    hubs = hubs.select("key", F.col("top.node").alias("hub"), F.col("top.popularity").alias("weight"))  # a group's members are in its hub's buckets
    met = shared.join(hubs, "key").filter("node != hub").groupBy("node", "hub", "weight").agg(F.count("*").alias("times"))
    first = met.groupBy("node").agg(F.max(F.struct("times", "hub", "weight")).alias("b")).select(F.col("node").alias("a"), F.col("b.hub").alias("b"), "b.weight")
    nodes = reps.select("node", "doc").join(shared.select("node").distinct(), "node")
    sets = written(_sets(docs, nodes, id_col=id_col, text_col=text_col, k=k))
    labels = roots(_confirmed(first, sets, num, den))  # a hub stands above its members in (popularity, key): no cycles

    members = shared.join(hubs, "key").select("hub", "weight", "node").distinct()
    label_of = shared.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    hub_label = members.select("hub", "weight").distinct().join(label_of.select(F.col("node").alias("hub"), F.col("label").alias("hub_label")), "hub")
    members = members.join(label_of, "node").withColumn("share", _share("node")).join(_every_share(hub_label).drop("weight"), ["hub", "share"])
    members = written(members.select("hub", "weight", "node", "label", (F.col("label") == F.col("hub_label")).alias("major")))
    apart = lanes_apart(similarity)
    dealt = _deal(members.join(reps.select("node", "n", "sig"), "node"), SIGNATURE_BLOCK)
    alive = (
        dealt.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j").select("hub", "i", "j", "node", "n", "sig", "label", "major")
        .mapInArrow(lambda rows: _alive(rows, apart, num, den), "hub binary, node binary").distinct()
    )
    open_members = _deal(members.join(written(alive), ["hub", "node"], "left_semi"), BLOCK)
    second = written(open_members.join(sets, "node").groupBy("hub", "i", "j").applyInArrow(lambda t: _links(t, num, den), "a binary, b binary").distinct())
    of_set = reps.select("node", "doc").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    if second.take(1):
        merged = components(second).select(F.col("node").alias("label"), F.col("label").alias("merged"))
        of_set = of_set.join(merged, "label", "left").withColumn("label", F.coalesce("merged", "label"))
    least = of_set.groupBy("label").agg(F.min("doc").alias("component"))
    by_set = of_set.join(least, "label").select("node", "component")
    slim = ["doc", "text_hash", "n", "node"]
    out = sigs.filter("n > 0").select(*slim).join(by_set, "node", "left").unionByName(sigs.filter("n = 0").select(*slim), allowMissingColumns=True)
    return out.select("doc", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component"))
