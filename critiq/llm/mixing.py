"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the keys are range-sorted in buckets of equal key width,
token counts are summed per bucket, and running sums over the bucket totals and inside each bucket place every
document on its source's line of tokens. A source is repeated for whole epochs as its budget asks, and the last
epoch is cut where the budget ends. A hot source is spread over many buckets, so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from critiq.llm.shared import saved

#: Documents that one bucket of keys should hold, over all sources.
BUCKET_ROWS = 2_000


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """From (source, source_size), a row per source, the words each source should give.

    Sources in code-point order, null last, take the weights in turn; all targets together are `share` of all
    sizes; none passes `epochs` times its source's size, and what is over goes to the others by weight until none
    is above. That is target = min(cap, level * weight), with the level at which the targets reach the total:
    sources that are capped are those with the lowest cap to weight. The windows here see one row per source.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    row = sizes.withColumn("place", F.row_number().over(order) - 1)
    row = row.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    row = row.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    line = W.orderBy(F.col("cap") / F.col("weight"), "place")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    row = (
        row.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(line.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_from"))
    )
    # the first source on the line whose cap is above its level sets the level of all the rest
    free = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))
    row = row.withColumn("common", F.first(free, ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return row.select("source", "source_size", F.coalesce(F.col("common") * F.col("weight"), F.col("cap")).alias("target"))


def _bucketed(docs: DataFrame, n_buckets: int, size: Column | None, *columns) -> DataFrame:
    """columns, and the size, key, bucket and source (as a text that is never null, to join and partition by) of each row."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(*columns, (word_count(F.col("text")) if size is None else size).alias("__size"), key.alias("__key"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("__source"))
    return rows.withColumn("__bucket", F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * n_buckets / F.lit(1 << 32)).cast("int"))


def _placed(rows: DataFrame, sizes: DataFrame, weights, share, epochs) -> DataFrame:
    """rows with __copies, __source_size and __target. sizes has source, __source, __bucket and __size of the same rows."""
    sources = sizes.groupBy("source", "__source").agg(F.sum("__size").alias("source_size"))
    held = sizes.groupBy("__source", "__bucket").agg(F.sum("__size").alias("__held"))
    ahead = W.partitionBy("__source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    held = held.select("__source", "__bucket", F.coalesce(F.sum("__held").over(ahead), F.lit(0)).alias("__ahead"))
    targets = source_targets(sources.drop("__source"), weights, share, epochs)
    targets = targets.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    plan = held.join(targets, "__source")
    # the window and the join deal the rows out by the same columns, so they move once
    inside = W.partitionBy("__source", "__bucket").orderBy("__key", "doc_id", "__size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("__within", F.coalesce(F.sum("__size").over(inside), F.lit(0))).join(plan, ["__source", "__bucket"])
    whole = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(0)
    rest = F.col("__target") - whole * F.col("__source_size")
    last = (F.col("__ahead") + F.col("__within") + F.col("__size") / 2 < rest).cast("long")
    return placed.withColumn("__copies", whole + last)


def _buckets(docs: DataFrame) -> int:
    return max(1, -(-docs.count() // BUCKET_ROWS))


def mix_sources(docs: DataFrame, size: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken): how often the mix takes each document of (doc_id, text, source).

    A document is in the last, cut epoch if the middle of its span on the line is before the cut, so a source's
    words are off its target by half a document at most. Ties of the key (equal ids) go by size. Null source: a
    source of its own. Null or empty text: size 0, copies counted all the same, nothing taken. An empty table gives
    no rows. Other columns are left out; rows with equal or null doc_id stay rows of their own.

    The running sum of a source over its buckets sees one row for each BUCKET_ROWS documents.
    """
    rows = saved(_bucketed(docs, _buckets(docs), size, "doc_id", "source"), "sizes")  # the texts are read once
    placed = _placed(rows, rows, weights, share, epochs)
    named = {"size": "__size", "source_size": "__source_size", "target": "__target", "copies": "__copies"}
    return placed.select("doc_id", *[F.col(v).alias(k) for k, v in named.items()], (F.col("__size") * F.col("__copies")).alias("taken"))


def repeat_documents(docs: DataFrame, size: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """docs as mix_sources takes them: each row as many times as its own copies, with the columns of docs.

    Rows that share a doc_id are placed one by one, so a source's words stay near its target whatever ids repeat.
    """
    n = _buckets(docs)
    sizes = saved(_bucketed(docs, n, size, "doc_id", "source").select("source", "__source", "__bucket", "__size"), "sizes")
    placed = _placed(_bucketed(docs, n, size, *docs.columns), sizes, weights, share, epochs).filter("__copies > 0")
    return placed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)
