"""Model-scored JSON lines: validation, repair, joins with the sample, aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.functions.numeric import DIMENSIONS, renormalised
from critiq.functions.objects import first_json
from critiq.operators.ranking import first_per_key, percentiles
from critiq.operators.reviews import not_in
from critiq.sources.scratch import saved

# The keys that a line must have, and the labels that `dominant` may take.
KEYS = ("appid", "reviewId", *DIMENSIONS, "confidence", "dominant", "rationale_brief")
LABELS = (*DIMENSIONS, "tie")
SUM_EXACT, SUM_NEAR, TIE_BAND = 1e-12, 0.01, 0.05


def _field(key: str, kind: str = "variant") -> Column:
    return F.try_variant_get("v", f"$.{key}", kind)


def _kind(key: str) -> Column:
    """BIGINT, DECIMAL(..), DOUBLE, STRING, BOOLEAN, VOID, OBJECT<..> or ARRAY<..>; null where the key is absent."""
    return F.schema_of_variant(_field(key))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _number(key: str) -> Column:
    """A number, a number written as text, or a truth value as 1 or 0; else null."""
    text = _stripped(_field(key, "string"))
    said = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.when(_kind(key) == "BOOLEAN", _field(key, "boolean").cast("double")).when(_kind(key) == "STRING", said).when(_kind(key).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), _field(key, "double"))


def _whole_id(key: str) -> Column:
    """A whole number of any length as text: a number cut at its point, or digits written as text; else null."""
    text, kind = _stripped(_field(key, "string")), _kind(key)
    return (
        F.when(kind == "BOOLEAN", _field(key, "boolean").cast("int").cast("string")).when(kind.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))"), text)
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.regexp_extract(_field(key, "double").try_cast("decimal(38,9)").cast("string"), r"^-?\d+", 0))
        .when((kind == "STRING") & text.rlike(r"^[+-]?\d+$"), text.try_cast("decimal(38,0)").cast("string"))
    )


def parsed(lines: DataFrame) -> DataFrame:
    """From (line_no, line): the typed fields, extras, and `reason`, the first rule that a line breaks (null: none).

    Rules in order: invalid_json, not_object, missing_keys, reviewId_not_int_or_null, out_of_range:<key>,
    invalid_dominant, rationale_not_string, rationale_has_quote, rationale_too_long, sum. Null and blank lines are left
    out; a line with one key twice is no valid JSON. Fields are read by their JSON kind: shares and confidence may be
    numbers, numbers as text or truth values; an id keeps all its digits; white space around `dominant` is cut, and null
    there says None. Shares whose sum is off by at most SUM_NEAR are divided by it (`renormalised`); dominant is set by
    the shares (`dominance_fixed`).
    """
    rows = lines.filter(F.trim("line") != "").withColumn("v", F.try_parse_json("line"))
    kind = F.schema_of_variant("v")
    read = F.struct(
        F.col("v").isNotNull().alias("sound"), kind.startswith("OBJECT").alias("object"), reduce(lambda a, b: a & b, [_field(k).isNotNull() for k in KEYS]).alias("complete"),
        _field("appid", "string").alias("appid"), _whole_id("reviewId").alias("reviewId"), (_kind("reviewId") == "VOID").alias("no_id"), *[_number(k).alias(k) for k in (*DIMENSIONS, "confidence")],
        F.when(_kind("dominant") == "VOID", "None").when(_kind("dominant") == "STRING", _stripped(_field("dominant", "string"))).alias("said"),
        F.when(_kind("rationale_brief") == "STRING", _field("rationale_brief", "string")).alias("rationale_brief"),
        F.map_filter(F.when(kind.startswith("OBJECT"), F.col("v").try_cast("map<string,string>")), lambda k, v: ~k.isin(*KEYS)).alias("extras"),
    )
    # by inline, so that no filter above is moved below and reads the fields a second time
    fields = rows.select("line_no", "line", F.inline(F.array(read)))
    outside = {k: F.col(k).isNull() | F.isnan(k) | (F.col(k) < 0) | (F.col(k) > 1) for k in (*DIMENSIONS, "confidence")}
    total = reduce(lambda a, b: a + b, [F.col(k) for k in DIMENSIONS])
    words = F.size(F.split(_stripped(F.col("rationale_brief")), r"\s+"))
    reason = F.coalesce(
        F.when(~F.col("sound"), "invalid_json"), F.when(~F.col("object"), "not_object"), F.when(~F.col("complete"), "missing_keys"),
        F.when(F.col("reviewId").isNull() & ~F.col("no_id"), "reviewId_not_int_or_null"), *[F.when(outside[k], f"out_of_range:{k}") for k in outside],
        F.when(~F.coalesce(F.col("said").isin(*LABELS), F.lit(False)), "invalid_dominant"), F.when(F.col("rationale_brief").isNull(), "rationale_not_string"),
        F.when(F.contains("rationale_brief", F.lit('"')), "rationale_has_quote"), F.when(words > 30, "rationale_too_long"), F.when(F.abs(total - 1) > SUM_NEAR, "sum"),
    )
    repaired = F.coalesce(F.abs(total - 1) > SUM_EXACT, F.lit(False))
    shares = {k: F.when(repaired, F.col(k) / total).otherwise(F.col(k)) for k in DIMENSIONS}
    out = fields.select("line_no", "line", reason.alias("reason"), "appid", "reviewId", *[v.alias(k) for k, v in shares.items()], "confidence", "said", "rationale_brief", "extras", repaired.alias("renormalised"))
    return out.withColumn("dominant", dominant()).withColumn("dominance_fixed", F.coalesce(F.col("said") != F.col("dominant"), F.lit(False)))


def dominant(band: float = TIE_BAND) -> Column:
    """The greatest dimension; tie if the second is within the band."""
    values = F.array(*[F.col(k) for k in DIMENSIONS])
    order = F.sort_array(values, asc=False)
    name = F.element_at(F.array(*[F.lit(k) for k in DIMENSIONS]), F.array_position(values, order[0]).cast("int"))
    return F.when(order[0].isNotNull() & (F.array_position(values, order[0]) > 0), F.when(order[0] - order[1] <= band, "tie").otherwise(name))


def valid_responses(lines: DataFrame) -> DataFrame:
    """The sound lines, the first of each (appid, reviewId)."""
    return first_per_key(parsed(lines).filter("reason IS NULL"), ["appid", "reviewId"], F.col("line_no")).drop("reason", "line")


def joined(sample: DataFrame, responses: DataFrame) -> DataFrame:
    """sample with its response, if any; null ids match null ids."""
    right = responses.select(F.col("appid").alias("__a"), F.col("reviewId").alias("__r"), *DIMENSIONS, "confidence", "dominant", "rationale_brief", "extras")
    return sample.join(right, F.col("appid").eqNullSafe(F.col("__a")) & F.col("reviewId").eqNullSafe(F.col("__r")), "left").drop("__a", "__r")


def reply_line(reply: Column, appid: Column, review_id: Column) -> Column:
    """A model's reply as a response line: its first balanced JSON object, the request's ids put in where it lacks them.

    Without an object the line says so in `_error`. review_id is text and may be null; null replies have no object.
    """
    found = first_json(reply)
    value = F.try_parse_json(found)
    lacks = {k: F.try_variant_get(value, f"$.{k}", "variant").isNull() for k in ("appid", "reviewId")}
    ids = {"appid": F.to_json(F.array(appid)), "reviewId": F.to_json(F.array(review_id))}
    ids = {k: F.concat(F.lit(f'"{k}": '), F.regexp_extract(v, r"(?s)^\[(.*)\]$", 1)) for k, v in ids.items()}
    added = F.concat_ws(", ", *[F.when(lacks[k], ids[k]) for k in ids])
    bare = F.regexp_replace(found, r"\s*\}$", "")
    filled = F.when(added == "", found).otherwise(F.concat(bare, F.when(F.length(F.trim(bare)) > 1, ", ").otherwise(""), added, F.lit("}")))
    return F.when(value.isNull(), F.concat(F.lit("{"), ids["appid"], F.lit(", "), ids["reviewId"], F.lit(', "_error": "non-JSON output"}'))).otherwise(filled)


def ingest_counters(lines: DataFrame, sample: DataFrame) -> DataFrame:
    """One row: lines, valid, invalid, renormalised, dominance_fixed, missing, unmatched."""
    rows = parsed(lines)
    good = F.col("reason").isNull()
    counts = rows.agg(
        F.count("*").alias("lines"), F.count(F.when(good, 1)).alias("valid"), F.count(F.when(~good, 1)).alias("invalid"),
        F.count(F.when(good & F.col("renormalised"), 1)).alias("renormalised"), F.count(F.when(good & F.col("dominance_fixed"), 1)).alias("dominance_fixed"),
    )
    valid, keys = valid_responses(lines), ["appid", "reviewId"]
    missing = not_in(sample, valid, keys).agg(F.count("*").alias("missing"))
    unmatched = not_in(valid, sample, keys).agg(F.count("*").alias("unmatched"))
    return counts.crossJoin(F.broadcast(missing)).crossJoin(F.broadcast(unmatched))  # three tables of one row


def app_aggregate(answered: DataFrame) -> DataFrame:
    """From joined(): means per app, rates of each dominant label among answers, and pct_fun_any over all of the sample."""
    rate = [F.when(F.count("dominant") > 0, F.count(F.when(F.col("dominant") == k, 1)) / F.count("dominant")).alias(f"{k}_rate") for k in LABELS]
    fun = F.coalesce(F.col("None") < 0.5, F.lit(False)).cast("double")
    return answered.groupBy("appid").agg(F.count("*").alias("n"), F.count("dominant").alias("answered"), *[F.avg(k).alias(f"{k}_mean") for k in DIMENSIONS], F.avg("confidence").alias("confidence_mean"), *rate, F.avg(fun).alias("pct_fun_any"))


def unit_aggregate(scores: DataFrame, scale: float = 1.0) -> DataFrame:
    """Units' shares made to sum to 1, their means per app (times scale), number, mean and sample variance of confidence."""
    shares = renormalised({k: F.col(k) for k in DIMENSIONS})
    rows = scores.select("appid", "confidence", *[v.alias(f"__{k}") for k, v in shares.items()])
    return rows.groupBy("appid").agg(*[(F.avg(f"__{k}") * scale).alias(f"{k}_share_mean") for k in DIMENSIONS], F.count("*").alias("n_units"), F.avg("confidence").alias("confidence_mean"), F.var_samp("confidence").alias("confidence_var"))


def confidence_diagnostics(scores: DataFrame) -> DataFrame:
    """One row over the confidences from 0 to 1; percentiles are exact (ranking.percentiles)."""
    rows = saved(scores.select(F.col("confidence").try_cast("double").alias("c")).filter("c BETWEEN 0 AND 1"), "confidences")
    one = rows.agg(F.count("*").alias("n"), F.avg("c").alias("mean"), F.when(F.count("*") > 1, F.stddev_samp("c")).otherwise(0.0).alias("std"), F.min("c").alias("min"), F.max("c").alias("max"))
    places = percentiles(rows, [], ["c"], {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return one.crossJoin(F.broadcast(places)).select("n", "mean", "std", "min", *[F.col(f"c_{p}").alias(p) for p in ("p10", "p50", "p90")], "max")  # one row each


def error_types(errors: DataFrame) -> DataFrame:
    return errors.groupBy(F.substring_index("error", ":", 1).alias("error_type")).agg(F.count("*").alias("n"))


def sum_anomalies(scores: DataFrame, slack: float = 1e-6) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(k) for k in DIMENSIONS])
    return scores.agg(F.count("*").alias("records"), F.count(F.when(F.abs(total - 1) > slack, 1)).alias("anomalies"))


def failed_keys(log: DataFrame, errors: DataFrame) -> DataFrame:
    """Distinct (appid, unit_id, level) of log lines marked [error] or [retry], and of the lines of the errors file."""
    def found(name):
        return F.regexp_extract("line", rf"{name}[=:]\s*([^\s,;]+)", 1).alias(name)

    said = log.filter(F.col("line").rlike(r"\[(error|retry)\]")).select(found("appid"), found("unit_id"), found("level"))
    noted = errors.select(F.from_json("line", "appid string, unit_id string, level string").alias("e")).select("e.*")
    return said.unionByName(noted).filter("appid != '' AND unit_id != ''").distinct()
