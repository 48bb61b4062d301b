"""MinHash near-duplicates by fast similarity sketching.

A document's set is its distinct hashed word shingles. The sketch has as many coordinates as bands times rows. In
round i every shingle is thrown into a bin by hash i, carrying i plus a fraction as its value; a bin keeps its least
value, so later rounds only fill bins that are still empty. After as many rounds as there are bins, round j throws
all shingles into bin j, which leaves no bin empty. Bins behave as in MinHash, with better concentration, at about
n + t log t throws for n shingles and t bins.

Documents with equal sets stand for one another. Sets that agree on all rows of a band share a bucket. A bucket's
members are checked against its smallest member first, on full sets; confirmed links give components. In buckets
that still hold several components, sets that provably link with nothing (too large a share of their shingles
occurs in no other candidate) leave, and of what is left, the pairs across components that could still reach the
threshold beside such shingles are checked, each in the first band that it shares. So a bucket of thousands of copies
costs its size, and no candidate pair stays unchecked. A bucket of sets that resemble each other below the threshold costs
its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critiq.llm.shared import SPACE, Hasher, chunks, mix, saved, utf8, words_of

#: A linked pair at the threshold itself shares no bucket with this probability at most.
MISS = 3e-7


def bands_for(threshold: float, rows: int) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-(threshold**rows)))


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' distinct shingle hashes, by text, and the n + 1 offsets; fewer than k words: all as one shingle."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    starts, ends, doc = words_of(data, offsets, SPACE)
    hashed = Hasher(data)(starts, ends)
    count = np.bincount(doc, minlength=n)
    last = np.repeat(np.cumsum(count), count)  # one past the text's last word, for each word
    at = np.arange(len(hashed))
    begins = np.flatnonzero((at + k <= last) | ((at == last - count[doc]) & (count[doc] < k)))
    value = np.zeros(len(begins), np.uint64)
    for i in range(k):
        here = begins + i
        inside = here < last[begins]
        value = mix(value + np.where(inside, hashed[np.minimum(here, len(hashed) - 1)], np.uint64(0)) + np.uint64(i + 1))
    of = doc[begins]
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[new], of[new]
    return value, np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n))))


def sketches(value: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """A row of `bins` coordinates per set; empty sets keep the largest value everywhere."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * bins, top)
    of = np.repeat(np.arange(n), size)
    open_sets = size > 0
    for i in range(2 * bins):
        if i:
            full = (out.reshape(n, bins)[open_sets] != top).all(1)
            open_sets[np.flatnonzero(open_sets)[full]] = False
            keep = open_sets[of]
            if not keep.all():
                value, of = value[keep], of[keep]
        if not len(value):
            break
        h = mix(value ^ mix(np.uint64(0x51ED27 + i) * np.ones(1, np.uint64)))
        bin_ = (h >> np.uint64(32)) % np.uint64(bins) if i < bins else np.full(len(h), i - bins, np.uint64)
        slot = of * bins + bin_.astype(np.int64)
        free = out[slot] == top
        np.minimum.at(out, slot[free], np.uint64(i << 32) | (h[free] & np.uint64(0xFFFFFFFF)))
    return out.reshape(n, bins)


def _sketch_table(docs: DataFrame, k: int, rows: int, bands: int) -> DataFrame:
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("print1", T.LongType()),
        T.StructField("print2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType(), False)),
    ])
    weights = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(20))

    def run(batches):
        for batch in chunks(batches):
            value, offsets = shingle_sets(batch.column("text"), k)
            n = len(batch)
            grid = sketches(value, offsets, rows * bands).reshape(n, bands, rows)
            keys = mix((mix(grid) * weights).sum(2, dtype=np.uint64) + salt)
            sums = [np.concatenate(([0], np.cumsum(mix(value ^ np.uint64(s)).view(np.int64)))) for s in (0xA5A5, 0x5A5A5)]
            prints = [s[offsets[1:]] - s[offsets[:-1]] for s in sums]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), *map(pa.array, prints),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))],
                names=schema.names,
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _set_table(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, shingles) of the documents named in ids."""

    def run(batches):
        for batch in chunks(batches):
            value, offsets = shingle_sets(batch.column("text"), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(value.view(np.int64)))],
                names=["doc_id", "n", "shingles"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, n long, shingles array<long>")


def counted(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, united) for the pairs (a, b): the sizes of their full sets' intersection and union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return both.select("a", "b", "shared", (F.size("sa") + F.size("sb") - F.col("shared")).alias("united"))


def linked(percent: int) -> Column:
    return 100 * F.col("shared") >= percent * F.col("united")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node reachable.

    Large-star and small-star steps in turn: every node's larger neighbours, then its smaller ones, move to the
    smallest node it knows, until nothing moves. Each step costs the links. A hub's links are dealt out by the hub and stream
    through a sort-merge join, which Spark splits where one key holds very many; no group of them is collected.
    """
    edges = saved(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v")))
        edges = saved(small.filter("u != v").distinct(), "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, rows: int = 8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text) with a doc_id.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. Texts without words, null included, have the empty set,
    link with nothing and stand for themselves. Rows without doc_id are left out; rows that repeat a doc_id give a
    row each and count as linked. Other columns are left out; an empty table gives no rows. kept marks the smallest
    doc_id of each component.
    """
    bands = bands_for(percent / 100, rows)
    docs = docs.filter(F.col("doc_id").isNotNull())
    drawn = saved(_sketch_table(docs, k, rows, bands), "sketches")
    same = ["print1", "print2", "n"]
    classes = drawn.filter("n > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"))
    reps = drawn.filter("n > 0").select("doc_id", *same, "bands").join(classes.select(F.col("rep").alias("doc_id"), *same), ["doc_id", *same]).dropDuplicates(["doc_id"])
    placed = reps.select("doc_id", "n", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("hub"), F.count("*").alias("held")).filter("held > 1").select("key", "hub")
    placed = saved(placed.join(shared, "key"), "buckets")
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    stars = placed.filter((F.col("doc_id") != F.col("hub.doc_id")) & fits(F.col("n"), F.col("hub.n"))).select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    sets = saved(_set_table(docs, placed.select("doc_id").distinct(), k).dropDuplicates(["doc_id"]), "sets")
    stars = saved(counted(stars, sets), "stars")
    roots = components(stars.filter(linked(percent)))

    def several(rows: DataFrame) -> DataFrame:
        """The rows of buckets that still hold more than one component."""
        open_keys = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("key")
        return rows.join(open_keys, "key", "left_semi")

    rooted = placed.select("key", "doc_id", "n", F.col("hub.doc_id").alias("hub")).join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    rest = saved(several(rooted), "rest")
    found = sets.join(rest.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.explode("shingles").alias("shingle"))
    alone = found.groupBy("shingle").agg(F.count("*").alias("c"), F.min("doc_id").alias("doc_id")).filter("c = 1").groupBy("doc_id").agg(F.count("*").alias("own"))
    rest = rest.join(alone, "doc_id", "left").fillna(0, ["own"]).filter(100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))
    with_hub = stars.select(F.col("a").alias("hub"), F.col("b").alias("doc_id"), "shared")
    rest = several(rest).join(with_hub, ["hub", "doc_id"], "left").withColumn("shared", F.when(F.col("hub") == F.col("doc_id"), F.col("n")).otherwise(F.col("shared")))
    rest = saved(rest.join(reps.select("doc_id", "bands"), "doc_id"), "rest")
    left, right = (rest.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "n", "own", "shared", "root", "bands")]) for side in "ab")
    # Two sets share nothing of either's own shingles. In the hub of their bucket they share what the smaller
    # part there holds at most, and outside of it (where all own shingles are) what the smaller rest holds.
    beside = F.least(F.col("n_a") - F.col("own_a"), F.col("n_b") - F.col("own_b"))
    outside = F.least(*[F.col(f"n_{x}") - F.col(f"own_{x}") - F.col(f"shared_{x}") for x in "ab"])
    most = F.least(beside, F.when(F.col("shared_a").isNotNull() & F.col("shared_b").isNotNull(), F.least("shared_a", "shared_b") + outside))
    possible = 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)
    first = F.element_at(F.filter(F.arrays_zip("bands_a", "bands_b"), lambda z: z["bands_a"] == z["bands_b"]), 1)["bands_a"]
    across = left.join(right, "key").filter((F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("root_a") != F.col("root_b")) & possible & (first == F.col("key")))
    more = saved(counted(across.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")), sets).filter(linked(percent)).select("a", "b"), "across")
    # the new links join whole components, so only roots are linked
    root_a, root_b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    ends = more.join(root_a, "a", "left").join(root_b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = components(ends).select(F.col("node").alias("first"), F.col("root").alias("last"))
    ranked = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("first", F.coalesce("root", "rep")).join(joined, "first", "left")
    ranked = ranked.select(*same, F.coalesce("last", "first").alias("component_id"))
    whole = drawn.select("doc_id", *same).join(ranked, same, "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = 6) -> DataFrame:
    """docs with one row of each component, the one with the smallest doc_id; rows without doc_id all stay."""
    out = near_duplicates(docs, k, percent, rows).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(out, "doc_id", "left_anti").select(*docs.columns)
