"""Incremental ingest: pages that arrive as files, each review once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critiq.operators.reviews import flatten_pages, not_in


def stream_reviews(spark: SparkSession, pages: str, delay: str | None = None) -> DataFrame:
    """A stream of review rows from JSON lines (appid, page, json), without ids seen before.

    State holds every id. With a delay (such as "7 days") it holds the ids of that span of creation time only, and a review is
    left out as late whose creation lies that far or farther behind the newest one of the calls before.
    """
    rows = flatten_pages(spark.readStream.schema("appid string, page int, json string").json(pages))
    if delay is None:
        return rows.dropDuplicates(["appid", "reviewId"])
    return rows.withColumn("created", F.timestamp_seconds("timestamp_created")).withWatermark("created", delay).dropDuplicatesWithinWatermark(["appid", "reviewId"])


def ingest(spark: SparkSession, pages: str, target: str, checkpoint: str, delay: str | None = None) -> None:
    """Append what is new under `pages` to `target` and stop; the checkpoint lets the next call resume, also after a call that was broken off.

    Files that a call has read are not read again; ids and the newest creation time are kept in the checkpoint's state.
    """
    query = stream_reviews(spark, pages, delay).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def new_reviews(arrived: DataFrame, known: DataFrame) -> DataFrame:
    """The batch form: rows whose (appid, reviewId) is not known yet."""
    return not_in(arrived, known, ["appid", "reviewId"])
