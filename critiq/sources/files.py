"""Readers and writers of the tables' file forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from critiq.functions.numeric import to_long
from critiq.operators.reviews import PAGE, upserted
from critiq.sources.scratch import saved

#: Keys of touched apps are broadcast up to so many bytes.
TOUCHED_BYTES = 16 << 20


def catalog_rows(pages: DataFrame) -> DataFrame:
    """From (json): one object per page, keyed by app. Rows without a whole appid go; bad counts are 0, names trimmed."""
    entry = "map<string,struct<appid:string,name:string,positive:string,negative:string>>"
    rows = pages.select(F.explode(F.from_json("json", entry)).alias("key", "v"))
    appid = F.coalesce(F.col("v.appid"), F.col("key")).try_cast("long")
    counts = [to_long(F.col(f"v.{c}")).alias(c) for c in ("positive", "negative")]
    return rows.select(appid.alias("appid"), F.trim(F.coalesce("v.name", F.lit(""))).alias("name"), *counts).filter("appid IS NOT NULL")


def read_catalog_pages(spark: SparkSession, path: str) -> DataFrame:
    return catalog_rows(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


def named_pages(rows: DataFrame) -> DataFrame:
    """(appid, page, json) from (file, json), file ending in <appid>/page_<n>.json."""
    return rows.select(F.regexp_extract("file", r"([^/]+)/page_\d+\.json$", 1).alias("appid"), F.regexp_extract("file", r"page_(\d+)\.json$", 1).cast("int").alias("page"), "json")


def read_review_pages(spark: SparkSession, path: str) -> DataFrame:
    """(appid, page, json) from files <appid>/page_<n>.json."""
    return named_pages(spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("json"), F.input_file_name().alias("file")))


def read_csv(spark: SparkSession, path: str, schema: str, fallback: str | None = None) -> DataFrame:
    """CSV with quoted line breaks; the master file if it has rows, else the per-app files under `fallback`.

    An empty field is null, `""` an empty text.
    """
    # Spark takes a field for null by its value after parsing, so what stands for an empty field must be no text of any file
    none = uuid.uuid4().hex

    def read(at: str) -> DataFrame:
        # where nothing escapes the doubled quote, the parser loses characters 0 of quoted texts
        return spark.read.csv(at, schema=schema, header=True, multiLine=True, escape='"', charToEscapeQuoteEscaping='"', recursiveFileLookup=True, nullValue=none, emptyValue="", lineSep="\n")

    if fallback is None:
        return read(path)
    try:
        rows = read(path)
        return read(fallback) if rows.isEmpty() else rows
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return read(fallback)


def json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """From (line): the parsed fields with `bad`, null for sound lines; blank lines are left out."""
    rows = lines.filter(F.trim("line") != "").withColumn("j", F.from_json("line", schema + ", __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    return rows.select("j.*", "line").withColumnRenamed("__bad", "bad")


def read_embeddings(spark: SparkSession, path: str, needed: tuple[str, ...] = ("appid", "reviewId", "text", "emb")) -> DataFrame:
    """Parquet, or JSON lines by the ending of the path."""
    rows = spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    if lacking := [c for c in needed if c not in rows.columns]:
        raise ValueError(f"embeddings lack {lacking}")
    return rows


def resolved(rows: DataFrame) -> DataFrame:
    """appid, reviewId and text from whichever of their usual names are there; a missing id is made from the text."""
    def one(*names: str):
        return F.coalesce(*[F.col(n).cast("string") for n in names if n in rows.columns], F.lit(None).cast("string"))

    from critiq.functions.text import stable_id

    text = one("review", "text", "content", "body")
    made = stable_id(F.coalesce(text, F.lit(""))).cast("string")
    named = {"appid": one("appid", "app_id", "app"), "reviewId": F.coalesce(one("reviewId", "recommendationid", "review_id", "id"), made), "text": text}
    return rows.select(*[v.alias(k) for k, v in named.items()], *[c for c in rows.columns if c not in named])


def upsert_per_app(spark: SparkSession, path: str, new: DataFrame, keys: list[str], key: str = "appid") -> None:
    """Put the rows of `new` into the table that write_per_app made at `path`, in place of those with the same keys (null equals null).

    Only the folders of apps in `new` are read and written. The merged rows are written out whole before the first folder is replaced, and
    doing it again gives the same table, so after a crash the call is repeated. `new` without rows changes nothing.
    """
    old = spark.read.schema(new.schema).parquet(path)
    touched = saved(new.select(key).distinct(), "touched")
    few = touched.count() * 64 <= TOUCHED_BYTES  # then the scan itself leaves the other folders out
    known = touched.filter(F.col(key).cast("string") >= "")  # no null; a comparison, since Spark prunes folders by filtered tables only
    mine = old.join(F.broadcast(known) if few else known, key, "left_semi").select(*new.columns)
    if not touched.filter(F.col(key).isNull()).isEmpty():
        mine = mine.unionByName(old.filter(F.col(key).isNull()))
    merged = saved(upserted(mine, new, keys), "merged")
    merged.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def lexicon_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, token, category, score) from the CSV files below `path`, whatever columns they have and in whatever order.

    A file counts if its header, trimmed and in lower case, has `token` and one of category, score and weight; other files are left out, as
    are other columns. Values are those of the columns named exactly so; where a name stands twice, the last; score comes before weight.
    A row that ends early lacks the rest. `row` grows along a file, and files go by path, so the last score is the one to take.
    """
    found = spark.read.option("pathGlobFilter", "*.[cC][sS][vV]").option("recursiveFileLookup", True)
    width = found.text(path).agg(F.max(F.size(F.split("value", ",")))).first()[0] or 1  # no row has more fields
    cells = [f"c{i}" for i in range(width)]
    rows = found.csv(path, schema=", ".join(f"{c} string" for c in cells), multiLine=True, escape='"').withColumn("file", F.col("_metadata.file_path"))
    rows = rows.select("file", F.monotonically_increasing_id().alias("row"), F.array(*cells).alias("v"))
    heads = rows.groupBy("file").agg(F.min(F.struct("row", "v")).alias("first")).select("file", F.col("first.row").alias("top"), F.transform("first.v", lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "^\ufeff", "")).alias("head"))
    plain = F.transform("head", lambda c: F.lower(F.trim(c)))

    def has(name: str):
        return F.array_contains(plain, name)

    def value(name: str):
        at = F.size("head") - F.array_position(F.reverse(F.col("head")), name) + 1
        return F.when(F.array_contains("head", name), F.get("v", (at - 1).cast("int")))

    heads = heads.filter(has("token") & (has("category") | has("score") | has("weight")))
    score = F.when(F.array_contains("head", "score"), value("score")).otherwise(value("weight"))
    return rows.join(heads, "file").filter("row > top").select("file", "row", value("token").alias("token"), value("category").alias("category"), score.alias("score"))


def in_order(df: DataFrame, order: list[str] | None) -> DataFrame:
    """Rows range-sorted by `order` (a leading "-" for descending), nulls last: files and rows of a writer come in this order."""
    if not order:
        return df
    return df.orderBy(*[F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in order])


def is_ordered(rows: DataFrame, file: str, line: str, order: list[str]) -> bool:
    """Whether rows (file, line, columns of `order`, the last one a number) stand in the order that in_order gives: within each
    file from line to line, and from file to file."""
    key = F.struct(*[-F.col(c[1:]) if c.startswith("-") else F.col(c) for c in order])
    inside = rows.select(F.col(file).alias("f"), key.alias("k"), F.lag(key).over(W.partitionBy(file).orderBy(line)).alias("before")).filter("before > k")
    ends = rows.groupBy(F.col(file).alias("f")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    across = ends.withColumn("before", F.lag("hi").over(W.orderBy("f"))).filter("before > lo")  # one row per file
    return inside.isEmpty() and across.isEmpty()


def write_csv(df: DataFrame, path: str, columns: list[str], decimals: int = 6, order: list[str] | None = None) -> None:
    """Columns in the given order, doubles rounded, rows in the stated order if any. Null is an empty field, an empty text "\"\"".

    Reads back by read_csv: white space at the ends of texts, quotes and line breaks stay.
    """
    kinds = dict(df.dtypes)
    rows = in_order(df, order).select(*[F.round(c, decimals).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns])
    rows.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json_lines(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    in_order(df, order).write.json(path, ignoreNullFields=False)


def write_per_app(df: DataFrame, path: str, key: str = "appid", form: str = "parquet") -> None:
    """One folder per app, each app's rows from few tasks."""
    df.repartition(key).write.partitionBy(key).format(form).save(path)


def write_embeddings(df: DataFrame, path: str) -> None:
    df.write.parquet(path)
