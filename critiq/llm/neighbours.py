"""Approximate nearest neighbours: NN-descent builds a neighbour graph by Spark joins, queries search it greedily.

Vectors are ranked by inner product on codes of one signed byte per component with a scale per vector, whose dot
products are exact whole numbers, so a pair scores alike wherever it is met. The graph starts from exact neighbours
within random-hyperplane leaves. In each round every node introduces its neighbours and some of the nodes that list
it to one another, pairs of which one is new to the node's list; a node keeps its best DEGREE. A node sits in one of
many buckets of nodes, and a task joins a bucket's lists, so hubs cost no more than others.

Rounds end when hardly any list changes. A query keeps the BEAM best nodes met so far; in each step those not expanded yet
are joined with their adjacency, neighbours and listing nodes, whose scores come from the codes, until nearly all are. The best of the last beam are scored anew on the
original vectors in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from critiq.llm.shared import saved

LEAF, TREES, FIRST = 256, 3, 12
DEGREE, LISTED, OFFERS = 32, 24, 8
BEAM = 192
#: Rounds go on until at most this share of the lists' entries is new, search steps until this share of the beams' nodes is not
#: expanded; larger tables take more of both. More than so many are never needed by a graph that gets closer in each.
SETTLED, ROUNDS, STEPS = 0.01, 15, 15
#: Nodes of one bucket, and rows of a bucket's frontier that one group holds.
BUCKET, FRONTIER = 1000, 20_000


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Equally long binary values as a matrix of signed bytes."""
    array = column.combine_chunks()
    array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(array.buffers()[2], np.int8)[offsets[0] : offsets[-1]].reshape(len(array), -1)


def _encode(vectors: DataFrame, planes: np.ndarray) -> DataFrame:
    """(vec_id, code, scale, leaves): leaves has the number of the vector's leaf in each tree."""
    bits = planes.shape[1]

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64)
            scale = np.maximum(np.abs(x).max(1) / 127, np.finfo(float).tiny)  # the smallest components become 0
            code = np.rint(x / scale[:, None]).astype(np.int8)
            leaves = np.stack([((x @ p.T) > 0) @ (1 << np.arange(bits)) for p in planes], 1) if bits else np.zeros((len(x), len(planes)), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(list(leaves.astype(np.int64)), pa.list_(pa.int64()))],
                names=["vec_id", "code", "scale", "leaves"],
            )

    return vectors.mapInArrow(run, "vec_id long, code binary, scale double, leaves array<long>")


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of one row per id whose vector is neither null nor zero and has finite components only.

    Of vectors of several lengths those of the most frequent length stay; of rows that repeat an id, the least vector.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.filter("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(embedding, x -> x != 0)")
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.filter(F.size("embedding") == (common[0].n if common else 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


_PAIRS = "v long, w long, s double"


def _leaf_pairs(table: pa.Table) -> pa.Table:
    ids, code, scale = table["vec_id"].to_numpy(), _matrix(table["code"]).astype(np.float32), table["scale"].to_numpy()
    score = (code @ code.T).astype(np.float64) * (scale[:, None] * scale[None])
    np.fill_diagonal(score, -np.inf)
    k = min(FIRST, len(ids) - 1)
    best = np.argpartition(-score, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(ids), 0), np.int64)
    return pa.table({"v": np.repeat(ids, k), "w": ids[best].ravel(), "s": np.take_along_axis(score, best, 1).ravel()})


def _introduce(table: pa.Table) -> pa.Table:
    """From rows (u, m, code, scale, fresh, least): for each list u, offers (v, w, s) between its members."""
    u, m, fresh, least = (table[c].to_numpy(zero_copy_only=False) for c in ("u", "m", "fresh", "least"))
    code, scale = _matrix(table["code"]), table["scale"].to_numpy()
    order = np.lexsort((m, u))
    begin = np.flatnonzero(np.concatenate(([True], np.diff(u[order]) != 0, [True])))
    size = np.diff(begin)
    out = [[], [], []]
    for width in np.unique(size[size > 1]):  # lists of one length are one batched product
        rows = order[begin[:-1][size == width][:, None] + np.arange(width)]
        for part in np.array_split(rows, -(-len(rows) // 200)):
            c = code[part].astype(np.float32)
            sc = scale[part]
            score = np.matmul(c, c.transpose(0, 2, 1)).astype(np.float64) * (sc[:, :, None] * sc[:, None])
            f = fresh[part].astype(bool)
            use = (f[:, :, None] | f[:, None]) & (score > least[part][:, :, None]) & (m[part][:, :, None] != m[part][:, None])
            score[~use] = -np.inf
            k = min(OFFERS, width - 1)
            best = np.argpartition(-score, k - 1, axis=2)[:, :, :k]
            s = np.take_along_axis(score, best, 2)
            keep = np.isfinite(s)
            w = m[part][np.arange(len(part))[:, None, None], best]
            for to, x in zip(out, (np.broadcast_to(m[part][:, :, None], s.shape)[keep], w[keep], s[keep]), strict=True):
                to.append(x)
    v, w, s = (np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.float64), strict=True))
    return pa.table({"v": v.astype(np.int64), "w": w.astype(np.int64), "s": s})


def _best(pairs: DataFrame, key: str, other: str, n: int, flag: str, merge) -> DataFrame:
    """The n best (key, other, s) of each key; a pair that comes more than once is one, its flags merged."""
    rank = F.dense_rank().over(W.partitionBy(key).orderBy(F.desc("s"), other))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= n).groupBy(key, other, "s").agg(merge(flag).alias(flag))


def _members(edges: DataFrame, round_: int) -> DataFrame:
    """(u, m, fresh): u's neighbours and at most LISTED of the nodes that list u."""
    forward = edges.select(F.col("v").alias("u"), F.col("w").alias("m"), "fresh")
    place = F.row_number().over(W.partitionBy("w").orderBy(F.desc("fresh"), F.xxhash64("v", "w", F.lit(round_))))
    back = edges.withColumn("place", place).filter(F.col("place") <= LISTED).select(F.col("w").alias("u"), F.col("v").alias("m"), "fresh")
    return forward.unionByName(back).groupBy("u", "m").agg(F.max("fresh").alias("fresh"))


def _bucket(column: str, buckets: int):
    return F.pmod(F.xxhash64(column), F.lit(buckets)).alias("bucket")


def build_graph(codes: DataFrame, n: int, rounds: int = ROUNDS) -> DataFrame:
    """(v, w, s, fresh) from codes (vec_id, code, scale, leaves): each node's DEGREE best neighbours found."""
    leaves = codes.select("vec_id", "code", "scale", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = leaves.groupBy("tree", "leaf").agg(F.count("*").alias("held"))
    # a leaf of equal vectors does not fall apart by planes: it is dealt into blocks
    blocks = leaves.join(sizes, ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "tree"), F.ceil(F.col("held") / (2 * LEAF)).cast("long")))
    found = blocks.select("tree", "leaf", "block", "vec_id", "code", "scale").groupBy("tree", "leaf", "block").applyInArrow(_leaf_pairs, _PAIRS)
    edges = saved(_best(found.withColumn("fresh", F.lit(True)), "v", "w", DEGREE, "fresh", F.min), "graph")
    buckets = max(1, n // BUCKET)
    for round_ in range(rounds):
        least = edges.groupBy("v").agg(F.min("s").alias("least"), F.count("*").alias("held"))
        least = least.select(F.col("v").alias("m"), F.when(F.col("held") < DEGREE, -math.inf).otherwise(F.col("least")).alias("least"))
        known = codes.select(F.col("vec_id").alias("m"), "code", "scale").join(least, "m", "left").fillna(-math.inf, ["least"])
        lists = _members(edges, round_).join(known, "m").withColumn("bucket", _bucket("u", buckets))
        offers = lists.groupBy("bucket").applyInArrow(_introduce, _PAIRS).withColumn("fresh", F.lit(True))
        edges = saved(_best(edges.withColumn("fresh", F.lit(False)).unionByName(offers), "v", "w", DEGREE, "fresh", F.min), "graph")
        if _settled(edges, "fresh"):
            break
    return edges


def _settled(rows: DataFrame, open_: str) -> bool:
    """Whether the condition holds for a share of SETTLED of the rows at most."""
    counts = rows.agg(F.count("*").alias("all"), F.count_if(F.expr(open_)).alias("open")).first()
    return counts.open <= SETTLED * counts.all


def _expand(frontier: pa.Table, graph: pa.Table) -> pa.Table:
    """Scores of every frontier query with the adjacency of the node it expands, above the query's `least`."""
    empty = pa.table({"q": pa.array([], pa.int64()), "w": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
    if not len(frontier) or not len(graph):
        return empty
    u, m, scale, code = graph["u"].to_numpy(), graph["m"].to_numpy(), graph["scale"].to_numpy(), _matrix(graph["code"])
    order = np.argsort(u, kind="stable")
    nodes, begin, count = np.unique(u[order], return_index=True, return_counts=True)
    q, node, least, q_scale, q_code = (*(frontier[c].to_numpy() for c in ("q", "w", "least", "q_scale")), _matrix(frontier["q_code"]))
    at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
    out = [[], [], []]
    by_node = np.argsort(at, kind="stable")
    by_node = by_node[nodes[at[by_node]] == node[by_node]]
    edges = np.flatnonzero(np.concatenate(([True], np.diff(at[by_node]) != 0, [True]))) if len(by_node) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        rows = by_node[a:b]
        i = at[rows[0]]
        near = order[begin[i] : begin[i] + count[i]]
        s = (q_code[rows].astype(np.float32) @ code[near].T.astype(np.float32)).astype(np.float64) * (q_scale[rows][:, None] * scale[near][None])
        keep = (s > least[rows][:, None]) & (q[rows][:, None] != m[near][None])
        x, y = np.nonzero(keep)
        for to, z in zip(out, (q[rows][x], m[near][y], s[x, y]), strict=True):
            to.append(z)
    if not out[0]:
        return empty
    return pa.table({"q": np.concatenate(out[0]), "w": np.concatenate(out[1]), "s": np.concatenate(out[2])})


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM, steps: int = STEPS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id in queries (vec_id) its k nearest found among all other vectors.

    vectors has vec_id and embedding; see usable() for the rows that take no part. Nearest first by inner product in
    double precision on the original vectors, ties to the smaller id; fewer than k candidates: all that are found.
    Equal vectors are searched once, as a class, and its rows all take part. Repeated ids count once; an empty table or no query gives no rows; other columns are left out.
    """
    every = saved(usable(vectors), "vectors")
    classes = every.groupBy("embedding").agg(F.min("vec_id").alias("rep"))
    members = saved(every.join(classes, "embedding").select("vec_id", "rep"), "classes")
    rows = saved(every.join(members.select(F.col("rep").alias("vec_id")).distinct(), "vec_id", "left_semi"), "distinct_vectors")
    n = rows.count()
    width = rows.select(F.size("embedding").alias("n")).first()
    bits = max(0, math.ceil(math.log2(max(1, n / LEAF))))
    planes = np.random.default_rng(11).normal(size=(TREES, bits, width.n if width else 1))
    codes = saved(_encode(rows, planes), "codes")
    edges = build_graph(codes, n)
    buckets = max(1, n // BUCKET)
    listed = _members(edges.withColumn("fresh", F.lit(False)), -1).select("u", "m")
    graph = saved(listed.join(codes.select(F.col("vec_id").alias("m"), "code", "scale"), "m").withColumn("bucket", _bucket("u", buckets)), "adjacency")
    asking = saved(members.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi"), "asking")
    asked = codes.join(asking.select(F.col("rep").alias("vec_id")).distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("q"), F.col("code").alias("q_code"), F.col("scale").alias("q_scale"))
    asked = saved(asked, "asked")
    pool = asked.select("q", F.col("q").alias("w"), F.lit(math.inf).alias("s"), F.lit(False).alias("done"))
    for _ in range(steps):
        ends = pool.groupBy("q").agg(F.min("s").alias("least"), F.count("*").alias("held"))
        ends = ends.select("q", F.when(F.col("held") < beam, -math.inf).otherwise(F.col("least")).alias("least"))
        frontier = pool.filter("NOT done").select("q", "w").withColumn("bucket", _bucket("w", buckets))
        # a bucket that many queries ask for is cut into blocks of queries, each with the bucket's lists
        blocks = frontier.groupBy("bucket").agg(F.ceil(F.count("*") / FRONTIER).cast("int").alias("blocks"))
        frontier = frontier.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int")).drop("blocks").join(ends, "q").join(asked, "q")
        lists = graph.join(blocks, "bucket").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        met = frontier.groupBy("bucket", "block").cogroup(lists.groupBy("bucket", "block")).applyInArrow(_expand, "q long, w long, s double")
        both = pool.select("q", "w", "s", F.lit(True).alias("done")).unionByName(met.withColumn("done", F.lit(False)))
        pool = saved(_best(both.filter("q != w"), "q", "w", beam, "done", F.max), "pool")
        if _settled(pool, "NOT done"):
            break
    last = pool.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "w"))).filter(F.col("place") <= 2 * k + 20).select("q", "w")
    own = rows.select(F.col("vec_id").alias("q"), F.col("embedding").alias("x"))
    other = rows.select(F.col("vec_id").alias("w"), F.col("embedding").alias("y"))
    score = F.expr("aggregate(zip_with(x, y, (a, b) -> a * b), double(0), (t, p) -> t + p)")
    # a query's own vector may stand for other rows
    pairs = last.unionByName(asked.select("q", F.col("q").alias("w")))
    exact = pairs.join(other, "w").join(own, "q").select(F.col("q").alias("rep"), "w", score.alias("score"))
    # rows of equal vectors score alike, so of a class only the first k + 1 ids can be among the nearest of a query, itself counted
    place = F.row_number().over(W.partitionBy("rep").orderBy("vec_id"))
    first = members.withColumn("place", place).filter(F.col("place") <= k + 1).select(F.col("rep").alias("w"), "vec_id")
    order = [F.desc("score"), F.asc("vec_id")]
    near = exact.join(first, "w").withColumn("place", F.row_number().over(W.partitionBy("rep").orderBy(*order))).filter(F.col("place") <= k + 1)
    found = asking.withColumnRenamed("vec_id", "query_id").join(near.drop("place"), "rep").filter("query_id != vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
