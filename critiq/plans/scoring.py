"""Queries over texts, lexicon scores, responses, clusters and method comparison, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from critiq.functions import objects
from critiq.functions import text as X
from critiq.functions.numeric import DIMENSIONS
from critiq.operators import clusters as K
from critiq.operators import lexicon as L
from critiq.operators import responses as R
from critiq.operators import reviews as V
from critiq.operators import stats as S
from critiq.plans.views import LEXICON, REVIEWS_SQL, TEXT_SCORES, review_texts, reviews, table

CATEGORIES = list(LEXICON)


def _lexicon(spark):
    return spark.createDataFrame([("inline", i, t, c) for i, (t, c) in enumerate((t, c) for c, terms in LEXICON.items() for t in terms)], "file string, row int, token string, category string")


def _scores(spark):
    return spark.createDataFrame([("inline", i, t, s) for i, (t, s) in enumerate([("the", 9.0), *TEXT_SCORES.items()])], "file string, row int, token string, score double")


def _counts(spark, sf_dir):
    return L.token_counts(review_texts(spark, sf_dir))


def tokens_per_app(spark, sf_dir):
    return _counts(spark, sf_dir).withColumn("freq_per_1000", F.round("freq_per_1000", 6))


def tokens_overall(spark, sf_dir):
    return L.corpus_counts(review_texts(spark, sf_dir))


def stemmed_tokens(spark, sf_dir):
    return L.corpus_counts(review_texts(spark, sf_dir).filter("lang = 'en'"), digits=False, stem=True)


def token_totals(spark, sf_dir):
    return L.token_totals(_counts(spark, sf_dir))


def category_rates(spark, sf_dir):
    rows = L.category_rates(_counts(spark, sf_dir), L.read_lexicon(_lexicon(spark))[0], CATEGORIES)
    return rows.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def lexicon_scores(spark, sf_dir):
    rows = L.lexicon_scores(_counts(spark, sf_dir), L.read_lexicon(_scores(spark))[1])
    return rows.select("appid", F.round("score_sum", 6).alias("score_sum"), F.round("score_per_1000", 6).alias("score_per_1000"), "hits")


def lexicon_coverage(spark, sf_dir):
    return L.lexicon_coverage(_counts(spark, sf_dir), L.read_lexicon(_lexicon(spark))[0])


def _review_scores(spark, sf_dir):
    return L.review_scores(reviews(spark, sf_dir), LEXICON)


def _rounded(rows, places=8):
    return rows.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def review_scores(spark, sf_dir):
    return _rounded(L.ordered_columns(_review_scores(spark, sf_dir)))


def app_review_agg(spark, sf_dir):
    return _rounded(L.app_aggregate(_review_scores(spark, sf_dir)), 6)


def app_normalized_mix(spark, sf_dir):
    return _rounded(L.app_mix(_review_scores(spark, sf_dir)))


def run_headlines(spark, sf_dir):
    return _rounded(L.run_headlines(_review_scores(spark, sf_dir)), 6)


def mask_pii(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.mask_personal(F.col("text"))).alias("masked_md5"))


def normalised_texts(spark, sf_dir):
    text = X.normalise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(text).alias("n"), X.length_bucket(F.length(text)).alias("bucket"), F.md5(text).alias("text_md5"), X.long_enough(F.col("text")).alias("kept"))


def readable_reviews(spark, sf_dir):
    return reviews(spark, sf_dir).filter(X.is_readable(F.col("review"))).select("appid", "reviewId")


def unreadable_reviews(spark, sf_dir):
    return reviews(spark, sf_dir).filter(~X.is_readable(F.col("review"))).select("appid", "reviewId", "charLen", X.preview(F.col("review")).alias("preview"))


TEMPLATE = "Score app {{APPID}}, review {{REVIEW_ID_OR_NULL}}:\n{{REVIEW_TEXT}}"


def prompt_rows(spark, sf_dir):
    rows = reviews(spark, sf_dir).filter(X.is_readable(F.col("review")))
    filled = X.fill_prompt(TEMPLATE, F.col("appid"), F.when(F.col("doc_id") % 10 != 0, F.col("reviewId")), F.col("review"))
    return rows.select("appid", "reviewId", F.length(filled).alias("n"), F.md5(filled).alias("prompt_md5"))


def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.stable_id(F.col("url")).alias("stable_id"))


def ascii_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.ascii_fold(F.col("text")).alias("folded"))


def _replies(spark, sf_dir):
    """Whole turns with a JSON object behind the prose; every seventh one has a broken brace first, every ninth no object at all."""
    rows = table(spark, sf_dir, "conversations")
    made = F.to_json(F.struct("conv_id", F.struct(F.lit("a } b").alias("s")).alias("x")))
    reply = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("conv_id") % 7 == 0, " {oops ").otherwise(" "), F.when(F.col("conv_id") % 9 != 0, made).otherwise("none"), F.lit(" }"))
    return rows.select("conv_id", "turn", reply.alias("reply"))


def first_json(spark, sf_dir):
    return _replies(spark, sf_dir).select("conv_id", "turn", objects.first_json(F.col("reply")).alias("object"))


def reply_lines(spark, sf_dir):
    """Replies as response lines: ids filled in from the request, an error line where there is no object."""
    asked = _replies(spark, sf_dir).withColumns({"appid": F.concat(F.lit("c"), "conv_id"), "reviewId": F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string"))})
    rows = asked.select("conv_id", "turn", R.reply_line(F.col("reply"), F.col("appid"), F.col("reviewId")).alias("line")).withColumn("v", F.parse_json("line"))
    field = {"appid": "$.appid", "reviewId": "$.reviewId", "error": "$._error", "s": "$.x.s"}
    return rows.select("conv_id", "turn", *[F.try_variant_get("v", at, "string").alias(k) for k, at in field.items()])


def _lines(spark, sf_dir):
    """Response lines made from documents, one of each; ids that divide by small primes are odd or broken in stated ways."""
    d = F.col("doc_id")

    def number(c):
        return F.round(c, 6).cast("string")

    def quoted(c):
        return F.concat(F.lit('"'), c, F.lit('"'))

    a, b = (d % 11).cast("double") / 20, (d % 7).cast("double") / 20
    review_id = (
        F.when(d % 43 == 0, '"x"').when(d % 47 == 0, "null").when(d % 79 == 0, quoted(d.cast("string"))).when(d % 83 == 0, '"3.5"').when(d % 89 == 0, (d + 9_007_199_254_740_993).cast("string"))
        .when(d % 97 == 0, F.concat(d.cast("string"), F.lit(".75"))).otherwise(d.cast("string"))
    )
    flow = F.when(d % 101 == 0, "1.2").when(d % 37 == 0, number(a - 0.005)).when(d % 41 == 0, number(a - 0.1)).when(d % 103 == 0, quoted(number(a))).when(d % 107 == 0, "true").otherwise(number(a))
    confidence = F.when(d % 109 == 0, "1.5").when(d % 113 == 0, '"high"').when(d % 29 == 0, '"0.25"').otherwise("0.5")
    label = F.when(d % 53 == 0, '"Fun"').when(d % 127 == 0, '" Flow "').when(d % 131 == 0, "null").otherwise('"None"')
    reason = F.when(d % 59 == 0, quoted(F.repeat(F.lit("w "), 31))).when(d % 137 == 0, "5").when(d % 139 == 0, '"[ok] nice"').when(d % 149 == 0, r'"says \"so\""').otherwise('"short words"')
    fields = {"appid": quoted(F.col("source")), "reviewId": review_id, "Flow": flow, "Utility": number(b), "Nostalgia": F.lit("0.1"), "None": number(F.lit(1.0) - a - b - F.lit(0.1)), "confidence": confidence, "dominant": label, "rationale_brief": reason, "model": F.lit('"m1"')}
    line = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v) for k, v in fields.items()]), F.lit("}"))
    line = F.when(d % 61 == 0, "{broken").when(d % 67 == 0, "[1, 2]").when(d % 71 == 0, '{"appid": "a"}').when(d % 73 == 0, "  ").otherwise(line)
    return table(spark, sf_dir, "documents").filter("source IS NOT NULL").select(d.alias("line_no"), line.alias("line"))


def _partly_answered(spark, sf_dir):
    """Without the answers to every third document: absent ones are what the queries on them look for."""
    return _lines(spark, sf_dir).filter("line_no % 3 != 0")


def response_reasons(spark, sf_dir):
    return R.parsed(_lines(spark, sf_dir)).select("line_no", "reason")


def response_valid(spark, sf_dir):
    rows = R.valid_responses(_lines(spark, sf_dir))
    return rows.select("line_no", "appid", "reviewId", *[F.round(k, 8).alias(k) for k in DIMENSIONS], "dominant", "renormalised", "dominance_fixed", F.col("extras")["model"].alias("model"))


def response_counters(spark, sf_dir):
    return R.ingest_counters(_lines(spark, sf_dir), _sampled(spark, sf_dir))


def _sampled(spark, sf_dir):
    return reviews(spark, sf_dir).filter("doc_id % 2 = 0").select("appid", "reviewId", "doc_id")


def missing_responses(spark, sf_dir):
    return V.not_in(_sampled(spark, sf_dir), R.valid_responses(_partly_answered(spark, sf_dir)), ["appid", "reviewId"])


def unmatched_responses(spark, sf_dir):
    return V.not_in(R.valid_responses(_partly_answered(spark, sf_dir)), _sampled(spark, sf_dir), ["appid", "reviewId"]).select("appid", "reviewId", "line_no")


def pending_prompts(spark, sf_dir):
    """Every tenth prompt has no id; one answer without id settles all of its app."""
    prompts = reviews(spark, sf_dir).select("appid", F.when(F.col("doc_id") % 10 != 0, F.col("reviewId")).alias("reviewId"), "doc_id")
    return V.not_in(prompts, prompts.filter("doc_id % 4 = 0"), ["appid", "reviewId"])


def retry_units(spark, sf_dir):
    """Prompts whose key failed before."""
    rows = reviews(spark, sf_dir).select("appid", F.concat(F.lit("review:"), "reviewId").alias("unit_id"), F.lit("review").alias("level"), "doc_id")
    log = rows.select(F.concat(F.when(F.col("doc_id") % 9 == 0, "[error] appid=").when(F.col("doc_id") % 10 == 0, "[retry] appid=").otherwise("[ok] appid="), "appid", F.lit(" unit_id="), "unit_id", F.lit(" level="), "level").alias("line"))
    errors = rows.filter("doc_id % 13 = 0").select(F.to_json(F.struct("appid", "unit_id", "level")).alias("line"))
    return V.only_in(rows, R.failed_keys(log, errors), ["appid", "unit_id", "level"]).select("appid", "unit_id", "doc_id")


def upsert_responses(spark, sf_dir):
    rows = reviews(spark, sf_dir).select("appid", "reviewId", F.lit("old").alias("run"))
    return V.upserted(rows, reviews(spark, sf_dir).filter("doc_id % 6 = 0").select("appid", "reviewId", F.lit("new").alias("run")), ["appid", "reviewId"])


def response_app_agg(spark, sf_dir):
    return _rounded(R.app_aggregate(R.joined(_sampled(spark, sf_dir), R.valid_responses(_lines(spark, sf_dir)))), 6)


def _units(spark, sf_dir):
    d = F.col("doc_id")
    values = {"Flow": (d % 5) / 4 - 0.1, "Utility": (d % 3) / 2, "Nostalgia": F.when(d % 6 == 0, 1.5).otherwise(0.0), "None": (d % 4) / 8}
    zero = d % 15 == 0
    return reviews(spark, sf_dir).select("appid", "doc_id", *[F.when(zero, 0.0).otherwise(v).cast("double").alias(k) for k, v in values.items()], F.when(d % 20 != 0, (d % 10) / 10).cast("double").alias("confidence"))


def unit_app_agg(spark, sf_dir):
    return _rounded(R.unit_aggregate(_units(spark, sf_dir)), 6)


def unit_app_percent(spark, sf_dir):
    return _rounded(R.unit_aggregate(_units(spark, sf_dir), 100.0), 6)


def unit_prompts(spark, sf_dir):
    """A prompt for each document as a unit of its source, the whole text cut at the prompt's own length."""
    rows = reviews(spark, sf_dir).select("appid", "reviewId", "review", X.unit_id(F.lit("review"), F.col("appid"), F.col("doc_id")).alias("unit"))
    prompt = X.unit_prompt(F.col("appid"), F.col("unit"), F.lit("review"), F.col("review"))
    return rows.select("unit", F.length(prompt).alias("n"), F.md5(prompt).alias("prompt_md5"))


def representative_units(spark, sf_dir):
    """Without summaries the representatives' texts are the units; here each group's longest text stands for it, and every fifth has none."""
    assigned, rows = _assigned_reviews(spark, sf_dir)
    reps = assigned.join(rows.select("reviewId", "charLen"), "reviewId").groupBy("appid", "cluster_id").agg(F.min_by("reviewId", F.struct(-F.col("charLen"), "reviewId")).alias("rep_reviewId"))
    return K.scoring_units(None, reps, rows).select("appid", "unit_id", "level", F.length("text").alias("n"))


def confidence_diag(spark, sf_dir):
    return _rounded(R.confidence_diagnostics(_units(spark, sf_dir)), 6)


def sum_anomalies(spark, sf_dir):
    return R.sum_anomalies(_units(spark, sf_dir))


def error_types(spark, sf_dir):
    return R.error_types(table(spark, sf_dir, "events").select(F.concat("event_type", F.lit(": user "), F.col("user_id").cast("string")).alias("error")))


def _embedded(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select((F.col("label") % 4).cast("string").alias("appid"), F.col("vec_id").cast("string").alias("reviewId"), F.col("label").cast("int").alias("cluster_id"), F.col("embedding").alias("emb"))


def cluster_k(spark, sf_dir):
    return K.cluster_count(reviews(spark, sf_dir))


def cluster_assign(spark, sf_dir):
    return K.assign_clusters(_embedded(spark, sf_dir))


def cluster_medoids(spark, sf_dir):
    rows = _embedded(spark, sf_dir)
    return K.medoids(rows.select("appid", "reviewId", "cluster_id"), rows)


def _assigned_reviews(spark, sf_dir):
    rows = reviews(spark, sf_dir).withColumn("text", F.col("review"))
    return rows.select("appid", "reviewId", (F.col("doc_id") % 5).cast("int").alias("cluster_id")), rows


def cluster_summaries(spark, sf_dir):
    return K.summaries(*_assigned_reviews(spark, sf_dir))


def scoring_units(spark, sf_dir):
    assigned, rows = _assigned_reviews(spark, sf_dir)
    return K.scoring_units(K.summaries(assigned, rows), None, rows).select("appid", "unit_id", "level", F.length("text").alias("n"))


def embed_texts(spark, sf_dir):
    """The vectors' components in millionths, as text."""
    rows = K.embed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.array_join(F.transform("emb", lambda v: F.round(v.cast("double") * 1e6).cast("long").cast("string")), ",").alias("emb"))


_DICTIONARY_COUNTS = ("n_reviews", "n_tokens_mean", "pct_with_fun")


def _both(spark, sf_dir):
    named = {k: F.col(f"{k}_share_mean").alias(k) for k in DIMENSIONS}
    dictionary = L.app_aggregate(_review_scores(spark, sf_dir)).select("appid", *_DICTIONARY_COUNTS, *named.values())
    return S.compared(dictionary, R.unit_aggregate(_units(spark, sf_dir)).select("appid", *named.values(), "confidence_mean"), _DICTIONARY_COUNTS, ("confidence_mean",))


def method_compare(spark, sf_dir):
    return _rounded(_both(spark, sf_dir), 6)


def method_pearson(spark, sf_dir):
    return _rounded(S.pearson(_both(spark, sf_dir)), 6)


def method_spearman(spark, sf_dir):
    """On means rounded to 9 places, so that equal ones tie whatever order they were summed in."""
    return _rounded(S.spearman(_rounded(_both(spark, sf_dir), 9)), 6)


def method_kl(spark, sf_dir):
    return _rounded(S.kl_divergence(_both(spark, sf_dir)), 6)


def mann_whitney(spark, sf_dir):
    rows = reviews(spark, sf_dir).select("charLen", (F.col("isPositive") == 1).alias("high"))
    return _rounded(S.mann_whitney(rows, "charLen", "high"), 6)


QUERIES = {f.__name__: f for f in (
    tokens_per_app, tokens_overall, stemmed_tokens, token_totals, category_rates, lexicon_scores, lexicon_coverage, review_scores, app_review_agg, app_normalized_mix, run_headlines,
    mask_pii, normalised_texts, readable_reviews, unreadable_reviews, prompt_rows, unit_prompts, stable_ids, ascii_fold, first_json, reply_lines, response_reasons, response_valid, response_counters,
    missing_responses, unmatched_responses, pending_prompts, retry_units, upsert_responses, response_app_agg, unit_app_agg, unit_app_percent, confidence_diag, sum_anomalies, error_types,
    cluster_k, cluster_assign, cluster_medoids, cluster_summaries, scoring_units, representative_units, embed_texts, method_compare, method_pearson, method_spearman, method_kl, mann_whitney,
)}

_VALUES = ", ".join(f"('{t}', '{c}')" for c, terms in LEXICON.items() for t in terms)
_SCORE_VALUES = ", ".join(f"('{t}', {s}::DOUBLE)" for t, s in TEXT_SCORES.items())
_TOKENS = REVIEWS_SQL + """,
split AS (SELECT appid, "reviewId", "charLen", "isPositive", lang, list_filter(string_split(regexp_replace(lower(coalesce(review, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) >= 2) AS tokens FROM reviews),
counts AS (SELECT appid, token, count(*) AS count FROM (SELECT appid, unnest(tokens) AS token FROM split) GROUP BY ALL),
totals AS (SELECT appid, CAST(sum(count) AS BIGINT) AS total_tokens, count(*) AS distinct_tokens FROM counts GROUP BY appid),
lexicon(token, category) AS (VALUES """ + _VALUES + "), scores(token, score) AS (VALUES " + _SCORE_VALUES + ")"
_IN = {c: "len(list_filter(tokens, lambda t: t IN (" + ", ".join(f"'{t}'" for t in terms) + ")))" for c, terms in LEXICON.items()}
_REVIEW_SCORES = _TOKENS + f""",
hit AS (SELECT appid, "reviewId", "charLen", "isPositive", len(tokens) AS n_tokens, {_IN['Flow']} AS f, {_IN['Utility']} AS u, {_IN['Nostalgia']} AS n FROM split),
raw AS (SELECT *, f + u + n AS hits, greatest(1, n_tokens) AS m FROM hit),
cut AS (SELECT *, greatest(0, least(1, CAST(f AS DOUBLE) / m)) AS a, greatest(0, least(1, CAST(u AS DOUBLE) / m)) AS b, greatest(0, least(1, CAST(n AS DOUBLE) / m)) AS c,
  greatest(0, least(1, 1 - CAST(f AS DOUBLE) / m - CAST(u AS DOUBLE) / m - CAST(n AS DOUBLE) / m)) AS d FROM raw),
scored AS (SELECT appid, "reviewId", "charLen", "isPositive", n_tokens, hits, hits = 0 AS zero_hit, f AS "Flow_count", u AS "Utility_count", n AS "Nostalgia_count",
  CASE WHEN hits > 0 THEN f / hits END AS "Flow_prop", CASE WHEN hits > 0 THEN u / hits END AS "Utility_prop", CASE WHEN hits > 0 THEN n / hits END AS "Nostalgia_prop",
  f * 100.0::DOUBLE / m AS "Flow_per_100", u * 100.0::DOUBLE / m AS "Utility_per_100", n * 100.0::DOUBLE / m AS "Nostalgia_per_100",
  CASE WHEN a + b + c + d > 0 THEN a / (a + b + c + d) ELSE 0 END AS "Flow_share", CASE WHEN a + b + c + d > 0 THEN b / (a + b + c + d) ELSE 0 END AS "Utility_share",
  CASE WHEN a + b + c + d > 0 THEN c / (a + b + c + d) ELSE 0 END AS "Nostalgia_share", CASE WHEN a + b + c + d > 0 THEN d / (a + b + c + d) ELSE 1 END AS "None_share" FROM cut)"""
_ROUND8 = ["Flow_prop", "Utility_prop", "Nostalgia_prop", "Flow_per_100", "Utility_per_100", "Nostalgia_per_100", "Flow_share", "Utility_share", "Nostalgia_share", "None_share"]
_MEANS = ["n_tokens", "charLen", "Flow_per_100", "Utility_per_100", "Nostalgia_per_100", "Flow_share", "Utility_share", "Nostalgia_share", "None_share"]
_ODD = r"""[\p{L}\p{N}\s.,!?;:''"()\-]"""
_READABLE = rf"""(len(list_filter(regexp_split_to_array(coalesce(review, ''), '\s+'), lambda w: regexp_matches(w, '\p{{L}}'))) >= 3 AND length(regexp_replace(coalesce(review, ''), '[^\p{{L}}]', '', 'g')) >= 20
  AND length(regexp_replace(coalesce(review, ''), '{_ODD}', '', 'g')) <= length(coalesce(review, '')) * 0.3)"""
def _sql_number(key):
    kind, said = f"json_type(j, '$.{key}')", f"trim(j->>'$.{key}')"
    return f"CASE WHEN {kind} = 'BOOLEAN' THEN CASE WHEN {said} = 'true' THEN 1 ELSE 0 END WHEN {kind} IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN TRY_CAST({said} AS DOUBLE) END"


# the lines are made by the same rules, and their text is parsed as JSON
_MADE = REVIEWS_SQL + """,
parts AS (SELECT doc_id, appid, (doc_id % 11) / 20 AS a, (doc_id % 7) / 20 AS b FROM reviews),
made AS (SELECT doc_id, CASE WHEN doc_id % 61 = 0 THEN '{broken' WHEN doc_id % 67 = 0 THEN '[1, 2]' WHEN doc_id % 71 = 0 THEN '{"appid": "a"}' WHEN doc_id % 73 = 0 THEN '  ' ELSE
  '{"appid": "' || appid || '", "reviewId": ' || CASE WHEN doc_id % 43 = 0 THEN '"x"' WHEN doc_id % 47 = 0 THEN 'null' WHEN doc_id % 79 = 0 THEN '"' || doc_id || '"' WHEN doc_id % 83 = 0 THEN '"3.5"'
    WHEN doc_id % 89 = 0 THEN CAST(doc_id + 9007199254740993 AS VARCHAR) WHEN doc_id % 97 = 0 THEN doc_id || '.75' ELSE CAST(doc_id AS VARCHAR) END
  || ', "Flow": ' || CASE WHEN doc_id % 101 = 0 THEN '1.2' WHEN doc_id % 37 = 0 THEN CAST(round(a - 0.005::DOUBLE, 6) AS VARCHAR) WHEN doc_id % 41 = 0 THEN CAST(round(a - 0.1::DOUBLE, 6) AS VARCHAR)
    WHEN doc_id % 103 = 0 THEN '"' || round(a, 6) || '"' WHEN doc_id % 107 = 0 THEN 'true' ELSE CAST(round(a, 6) AS VARCHAR) END
  || ', "Utility": ' || round(b, 6) || ', "Nostalgia": 0.1, "None": ' || round(1 - a - b - 0.1::DOUBLE, 6)
  || ', "confidence": ' || CASE WHEN doc_id % 109 = 0 THEN '1.5' WHEN doc_id % 113 = 0 THEN '"high"' WHEN doc_id % 29 = 0 THEN '"0.25"' ELSE '0.5' END
  || ', "dominant": ' || CASE WHEN doc_id % 53 = 0 THEN '"Fun"' WHEN doc_id % 127 = 0 THEN '" Flow "' WHEN doc_id % 131 = 0 THEN 'null' ELSE '"None"' END
  || ', "rationale_brief": ' || CASE WHEN doc_id % 59 = 0 THEN '"' || repeat('w ', 31) || '"' WHEN doc_id % 137 = 0 THEN '5' WHEN doc_id % 139 = 0 THEN '"[ok] nice"' WHEN doc_id % 149 = 0 THEN '"says ' || chr(92) || '"so' || chr(92) || '""' ELSE '"short words"' END
  || ', "model": "m1"}' END AS line FROM parts),
read AS (SELECT doc_id, CASE WHEN json_valid(line) THEN CAST(line AS JSON) END AS j FROM made WHERE trim(line) <> ''),
typed AS (SELECT doc_id, j, j->>'$.appid' AS appid, json_type(j, '$.reviewId') AS id_kind,
  CASE WHEN json_type(j, '$.reviewId') IN ('BIGINT', 'UBIGINT') THEN j->>'$.reviewId' WHEN json_type(j, '$.reviewId') = 'DOUBLE' THEN regexp_extract(j->>'$.reviewId', '^-?[0-9]+')
    WHEN json_type(j, '$.reviewId') = 'VARCHAR' AND regexp_full_match(trim(j->>'$.reviewId'), '[+-]?[0-9]+') THEN CAST(CAST(trim(j->>'$.reviewId') AS HUGEINT) AS VARCHAR) END AS "reviewId",
  """ + ", ".join(f'{_sql_number(k)} AS "{k}"' for k in (*DIMENSIONS, "confidence")) + """,
  CASE WHEN json_type(j, '$.dominant') = 'NULL' THEN 'None' WHEN json_type(j, '$.dominant') = 'VARCHAR' THEN trim(j->>'$.dominant') END AS said,
  CASE WHEN json_type(j, '$.rationale_brief') = 'VARCHAR' THEN j->>'$.rationale_brief' END AS rationale, j->>'$.model' AS model FROM read),
reasons AS (SELECT *, "Flow" + "Utility" + "Nostalgia" + "None" AS total, CASE WHEN j IS NULL THEN 'invalid_json' WHEN json_type(j) <> 'OBJECT' THEN 'not_object'
  WHEN NOT list_has_all(json_keys(j), ['appid', 'reviewId', 'Flow', 'Utility', 'Nostalgia', 'None', 'confidence', 'dominant', 'rationale_brief']) THEN 'missing_keys'
  WHEN "reviewId" IS NULL AND id_kind <> 'NULL' THEN 'reviewId_not_int_or_null' """ + " ".join(f"WHEN coalesce(\"{k}\", -1) NOT BETWEEN 0 AND 1 THEN 'out_of_range:{k}'" for k in (*DIMENSIONS, "confidence")) + """
  WHEN coalesce(said, '') NOT IN ('Flow', 'Utility', 'Nostalgia', 'None', 'tie') THEN 'invalid_dominant' WHEN rationale IS NULL THEN 'rationale_not_string' WHEN contains(rationale, '"') THEN 'rationale_has_quote'
  WHEN len(regexp_split_to_array(trim(rationale), '\\s+')) > 30 THEN 'rationale_too_long' WHEN abs("Flow" + "Utility" + "Nostalgia" + "None" - 1) > 0.01 THEN 'sum' END AS reason FROM typed),
fixed AS (SELECT doc_id, appid, "reviewId", said, model, confidence, abs(total - 1) > 1e-12::DOUBLE AS renormalised, """ + ", ".join(f'CASE WHEN abs(total - 1) > 1e-12::DOUBLE THEN "{k}" / total ELSE "{k}" END AS "{k}"' for k in DIMENSIONS) + """ FROM reasons WHERE reason IS NULL),
judged0 AS (SELECT *, list_reverse_sort(["Flow", "Utility", "Nostalgia", "None"]) AS o FROM fixed),
judged AS (SELECT * EXCLUDE (o), CASE WHEN o[1] - o[2] <= 0.05::DOUBLE THEN 'tie' WHEN o[1] = "Flow" THEN 'Flow' WHEN o[1] = "Utility" THEN 'Utility' WHEN o[1] = "Nostalgia" THEN 'Nostalgia' ELSE 'None' END AS dominant FROM judged0),
valid AS (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY appid, "reviewId" ORDER BY doc_id) AS place FROM judged) WHERE place = 1),
partly AS (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY appid, "reviewId" ORDER BY doc_id) AS place FROM judged WHERE doc_id % 3 <> 0) WHERE place = 1),
sampled AS (SELECT appid, "reviewId", doc_id FROM reviews WHERE doc_id % 2 = 0),
answered AS (SELECT s.appid, v."Flow", v."Utility", v."Nostalgia", v."None", v.dominant, v.confidence FROM sampled s LEFT JOIN valid v ON s.appid = v.appid AND s."reviewId" IS NOT DISTINCT FROM v."reviewId")"""
_UNITS = """units AS (SELECT appid, doc_id, CASE WHEN doc_id % 15 = 0 THEN 0 ELSE (doc_id % 5) / 4 - 0.1::DOUBLE END AS f, CASE WHEN doc_id % 15 = 0 THEN 0 ELSE (doc_id % 3) / 2 END AS u,
  CASE WHEN doc_id % 15 = 0 THEN 0::DOUBLE WHEN doc_id % 6 = 0 THEN 1.5::DOUBLE ELSE 0::DOUBLE END AS n, CASE WHEN doc_id % 15 = 0 THEN 0 ELSE (doc_id % 4) / 8 END AS z, CASE WHEN doc_id % 20 <> 0 THEN (doc_id % 10) / 10 END AS confidence FROM reviews),
unit_cut AS (SELECT appid, confidence, greatest(0, least(1, f)) AS f, greatest(0, least(1, u)) AS u, greatest(0, least(1, n)) AS n, greatest(0, least(1, z)) AS z FROM units),
unit_apps AS (SELECT appid, avg(CASE WHEN f + u + n + z > 0 THEN f / (f + u + n + z) ELSE 0 END) AS "Flow", avg(CASE WHEN f + u + n + z > 0 THEN u / (f + u + n + z) ELSE 0 END) AS "Utility",
  avg(CASE WHEN f + u + n + z > 0 THEN n / (f + u + n + z) ELSE 0 END) AS "Nostalgia", avg(CASE WHEN f + u + n + z > 0 THEN z / (f + u + n + z) ELSE 1 END) AS "None", count(*) AS n_units, avg(confidence) AS confidence_mean, var_samp(confidence) AS confidence_var FROM unit_cut GROUP BY appid)"""
_LONG = _REVIEW_SCORES + ", " + _UNITS + """,
dict_apps AS (SELECT appid, avg("Flow_share") AS "Flow", avg("Utility_share") AS "Utility", avg("Nostalgia_share") AS "Nostalgia", avg("None_share") AS "None" FROM scored GROUP BY appid),
long AS (SELECT d.appid, unnest(['Flow', 'Utility', 'Nostalgia', 'None']) AS dimension, unnest([d."Flow", d."Utility", d."Nostalgia", d."None"]) AS x, unnest([l."Flow", l."Utility", l."Nostalgia", l."None"]) AS y FROM dict_apps d JOIN unit_apps l USING (appid))"""
_CLUSTER_TEXT = REVIEWS_SQL + """,
placed AS (SELECT appid, doc_id % 5 AS cluster_id, "reviewId", coalesce(review, '') AS text, row_number() OVER (PARTITION BY appid, doc_id % 5 ORDER BY length(coalesce(review, '')) DESC, "reviewId") AS place FROM reviews),
sums AS (SELECT appid, CAST(cluster_id AS INTEGER) AS cluster_id, string_agg(text, ' ' ORDER BY place) AS whole, CAST(count(*) AS INTEGER) AS summary_n_reviews, string_agg("reviewId", ',' ORDER BY place) AS "source_reviewIds" FROM placed WHERE place <= 3 GROUP BY ALL),
summaries AS (SELECT *, CASE WHEN length(whole) > 400 THEN substr(whole, 1, 400) || '...' ELSE whole END AS summary_text FROM sums)"""

_REPLIES = """replies AS (SELECT conv_id, turn, coalesce(text, '') || CASE WHEN conv_id % 7 = 0 THEN ' {oops ' ELSE ' ' END
  || CASE WHEN conv_id % 9 <> 0 THEN '{"conv_id":' || conv_id || ',"x":{"s":"a } b"}}' ELSE 'none' END || ' }' AS reply FROM conversations)"""
# One character a step: depth, where the outermost object began, whether in a string and behind a backslash there, the object found.
_SCANNED = r"""marks AS (
  SELECT conv_id, turn, string_split(reply, '') AS c, reply, 1 AS i, 0 AS depth, 0 AS start, false AS quoted, false AS behind, CAST(NULL AS VARCHAR) AS object FROM replies
  UNION ALL
  SELECT conv_id, turn, c, reply, i + 1, CASE WHEN quoted THEN depth WHEN c[i] = '{' THEN depth + 1 WHEN c[i] = '}' THEN greatest(depth - 1, 0) ELSE depth END,
    CASE WHEN NOT quoted AND c[i] = '{' AND depth = 0 THEN i ELSE start END, CASE WHEN quoted AND behind THEN true WHEN c[i] = '"' THEN NOT quoted ELSE quoted END,
    quoted AND NOT behind AND c[i] = chr(92),
    CASE WHEN NOT quoted AND c[i] = '}' AND depth = 1 AND json_valid(array_to_string(c[start : i], '')) THEN array_to_string(c[start : i], '') END
  FROM marks WHERE i <= len(c) AND object IS NULL),
o AS (SELECT r.conv_id, r.turn, m.object FROM replies r LEFT JOIN marks m ON m.conv_id = r.conv_id AND m.turn = r.turn AND m.object IS NOT NULL)"""

# k-means in SQL: starts by three weighted draws, then rounds until all have run (centres that stay do not move again).
_HASHED = "(CAST('0x' || substr(md5(\"reviewId\" || ':{}'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE"
_SQUARE = "round(list_distance(x.emb, c.centre) ** 2, 9)"


def _k_means() -> str:
    size = "CAST(ceil((k - 1) / 3) AS BIGINT)"
    steps = [f"""v AS MATERIALIZED (SELECT CAST(label % 4 AS VARCHAR) AS appid, CAST(vec_id AS VARCHAR) AS "reviewId", CAST(embedding AS DOUBLE[]) AS emb FROM embeddings),
k AS (SELECT appid, greatest(1, least(count(*), greatest(8, least(24, round_even(sqrt(count(*)), 0)))))::BIGINT AS k FROM v GROUP BY 1),
s0 AS MATERIALIZED (SELECT appid, 0::BIGINT AS cid, emb AS centre FROM (SELECT *, row_number() OVER (PARTITION BY appid ORDER BY {_HASHED.format(0)}, "reviewId") AS p FROM v) WHERE p = 1)"""]
    for i in range(1, K.PASSES + 1):
        steps.append(f"""d{i} AS (SELECT x.appid, x."reviewId", any_value(x.emb) AS emb, min({_SQUARE}) AS far FROM v x JOIN s{i - 1} c ON c.appid = x.appid GROUP BY 1, 2),
e{i} AS (SELECT *, row_number() OVER (PARTITION BY appid ORDER BY -ln({_HASHED.format(i)}) / far, "reviewId") AS p FROM d{i} WHERE far > 0),
h{i} AS (SELECT appid, count(*) AS have FROM s{i - 1} GROUP BY 1),
s{i} AS MATERIALIZED (SELECT * FROM s{i - 1} UNION ALL SELECT e.appid, have + p - 1, emb FROM e{i} e JOIN h{i} h ON h.appid = e.appid JOIN k ON k.appid = e.appid WHERE p <= least({size}, k - have))""")
    last = f"s{K.PASSES}"
    for i in range(1, K.ROUNDS + 2):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT appid, "reviewId", emb, cid FROM (SELECT x.appid, x."reviewId", x.emb, cid, row_number() OVER (PARTITION BY x.appid, x."reviewId" ORDER BY {_SQUARE}, cid) AS p
  FROM v x JOIN {last} c ON c.appid = x.appid) WHERE p = 1),
m{i} AS (SELECT appid, cid, list(v ORDER BY j) AS centre FROM (SELECT appid, cid, j, avg(v) AS v FROM (SELECT appid, cid, unnest(emb) AS v, generate_subscripts(emb, 1) AS j FROM a{i}) GROUP BY ALL) GROUP BY 1, 2),
c{i} AS MATERIALIZED (SELECT c.appid, c.cid, coalesce(m.centre, c.centre) AS centre FROM {last} c LEFT JOIN m{i} m ON m.appid = c.appid AND m.cid = c.cid)""")
        last = f"c{i}"
    return "WITH " + ",\n".join(steps) + f""" SELECT appid, "reviewId", cid::INTEGER AS cluster_id, count(*) OVER (PARTITION BY appid, cid) AS cluster_size FROM a{K.ROUNDS + 1}"""


ORACLES = {
    "tokens_per_app": f"WITH {_TOKENS} SELECT appid, token, count, round(count * 1000.0::DOUBLE / total_tokens, 6) AS freq_per_1000 FROM counts JOIN totals USING (appid)",
    "tokens_overall": f"WITH {_TOKENS} SELECT token, CAST(sum(count) AS BIGINT) AS count FROM counts GROUP BY token",
    "stemmed_tokens": f"""WITH {_TOKENS}, one AS (SELECT unnest(tokens) AS t FROM split WHERE lang = 'en'),
stem AS (SELECT CASE WHEN ends_with(t, 'ing') AND length(t) > 5 THEN substr(t, 1, length(t) - 3) WHEN ends_with(t, 'ed') AND length(t) > 4 THEN substr(t, 1, length(t) - 2) WHEN ends_with(t, 'ly') AND length(t) > 4 THEN substr(t, 1, length(t) - 2)
  WHEN ends_with(t, 'ies') AND length(t) > 5 THEN substr(t, 1, length(t) - 3) WHEN ends_with(t, 's') AND length(t) > 3 THEN substr(t, 1, length(t) - 1) ELSE t END AS token FROM one WHERE NOT regexp_full_match(t, '[0-9]+'))
SELECT token, count(*) AS count FROM stem GROUP BY token""",
    "token_totals": f"WITH {_TOKENS} SELECT * FROM totals",
    "category_rates": f"""WITH {_TOKENS}, c AS (SELECT appid, category, sum(count) AS n FROM counts JOIN lexicon USING (token) GROUP BY ALL),
p AS (SELECT t.appid, total_tokens, distinct_tokens, CAST(coalesce(sum(n) FILTER (category = 'Flow'), 0) AS BIGINT) AS f, CAST(coalesce(sum(n) FILTER (category = 'Utility'), 0) AS BIGINT) AS u, CAST(coalesce(sum(n) FILTER (category = 'Nostalgia'), 0) AS BIGINT) AS o FROM totals t LEFT JOIN c ON t.appid = c.appid GROUP BY ALL)
SELECT appid, total_tokens, distinct_tokens, f AS "Flow_count", u AS "Utility_count", o AS "Nostalgia_count", round(f * 1000.0::DOUBLE / total_tokens, 6) AS "Flow_per_1000", round(u * 1000.0::DOUBLE / total_tokens, 6) AS "Utility_per_1000", round(o * 1000.0::DOUBLE / total_tokens, 6) AS "Nostalgia_per_1000" FROM p""",
    "lexicon_scores": f"""WITH {_TOKENS}, c AS (SELECT appid, sum(score * count) AS s, CAST(sum(count) AS BIGINT) AS hits FROM counts JOIN scores USING (token) GROUP BY appid)
SELECT appid, round(coalesce(s, 0), 6) AS score_sum, round(coalesce(s, 0) * 1000 / total_tokens, 6) AS score_per_1000, coalesce(hits, 0) AS hits FROM totals LEFT JOIN c USING (appid)""",
    "lexicon_coverage": f"""WITH {_TOKENS}, seen AS (SELECT DISTINCT token AS t FROM counts)
SELECT category, count(DISTINCT token) AS tokens, count(t) AS seen, count(*) FILTER (regexp_matches(token, '[^a-z0-9]')) AS unreachable FROM lexicon LEFT JOIN seen ON token = t GROUP BY category""",
    "review_scores": f"WITH {_REVIEW_SCORES} SELECT * REPLACE (" + ", ".join(f'round("{c}", 8) AS "{c}"' for c in _ROUND8) + ") FROM scored",
    "app_review_agg": f"WITH {_REVIEW_SCORES} SELECT appid, count(*) AS n_reviews, count(*) FILTER (NOT zero_hit) AS n_with_fun, round(count(*) FILTER (NOT zero_hit) * 100.0::DOUBLE / count(*), 6) AS pct_with_fun, round(count(*) FILTER (zero_hit) * 100.0::DOUBLE / count(*), 6) AS zero_hit_pct, "
    + ", ".join(f'round(avg("{c}_prop"), 6) AS "{c}_prop_mean", round(median("{c}_prop"), 6) AS "{c}_prop_median"' for c in CATEGORIES)
    + ", " + ", ".join(f'round(avg("{c}"), 6) AS "{c}_mean"' for c in _MEANS) + " FROM scored GROUP BY appid",
    "app_normalized_mix": f"WITH {_REVIEW_SCORES} SELECT appid, " + ", ".join(f'round(CASE WHEN sum(hits) > 0 THEN CAST(sum("{c}_count") AS DOUBLE) / CAST(sum(hits) AS DOUBLE) ELSE 0 END, 8) AS "{c}"' for c in CATEGORIES) + ", round(count(*) FILTER (zero_hit) / count(*), 8) AS z FROM scored GROUP BY appid",
    "run_headlines": f"WITH {_REVIEW_SCORES}, a AS (SELECT appid, count(*) AS n, count(*) FILTER (zero_hit) AS z, avg(n_tokens) AS t FROM scored GROUP BY appid) SELECT count(*) AS apps, CAST(sum(n) AS BIGINT) AS reviews, CAST(sum(z) AS BIGINT) AS zero_hit_reviews, round(avg(t), 6) AS mean_of_mean_tokens FROM a",
    "mask_pii": r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[\w.\-]+@[\w.\-]+', '[EMAIL]', 'g'), '\b\d{17}\b', '[STEAMID]', 'g')) AS masked_md5 FROM documents",
    "normalised_texts": r"""WITH t AS (SELECT conv_id, turn, regexp_replace(replace(regexp_replace(coalesce(text, ''), chr(13) || chr(10) || '?', chr(10), 'g'), chr(9), ' '), '^\s+|\s+$', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, CAST(length(t) AS INTEGER) AS n, CASE WHEN length(t) < 80 THEN 'short' WHEN length(t) < 300 THEN 'medium' ELSE 'long' END AS bucket, md5(t) AS text_md5, length(t) >= 3 AS kept FROM t""",
    "readable_reviews": f'WITH {REVIEWS_SQL} SELECT appid, "reviewId" FROM reviews WHERE {_READABLE}',
    "unreadable_reviews": rf"""WITH {REVIEWS_SQL} SELECT appid, "reviewId", "charLen", substr(trim(regexp_replace(coalesce(review, ''), '\s+', ' ', 'g')), 1, 240) AS preview FROM reviews WHERE NOT {_READABLE}""",
    "prompt_rows": f"""WITH {REVIEWS_SQL}, p AS (SELECT appid, "reviewId", substr('Score app ' || appid || ', review ' || CASE WHEN doc_id % 10 <> 0 THEN "reviewId" ELSE 'null' END || ':' || chr(10) || substr(coalesce(review, ''), 1, 4000), 1, 8000) AS p FROM reviews WHERE {_READABLE})
SELECT appid, "reviewId", CAST(length(p) AS INTEGER) AS n, md5(p) AS prompt_md5 FROM p""",
    "unit_prompts": f"""WITH {REVIEWS_SQL}, p AS (SELECT 'review:' || "reviewId" AS unit, substr('APPID: ' || appid || chr(10) || 'UNIT: review:' || "reviewId" || chr(10) || 'LEVEL: review' || chr(10) || chr(10) || coalesce(review, ''), 1, 8000) AS p FROM reviews)
SELECT unit, CAST(length(p) AS INTEGER) AS n, md5(p) AS prompt_md5 FROM p""",
    "ascii_fold": r"SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS folded FROM documents",
    "first_json": f"WITH RECURSIVE {_REPLIES}, {_SCANNED} SELECT conv_id, turn, object FROM o",
    "reply_lines": f"""WITH RECURSIVE {_REPLIES}, {_SCANNED}
SELECT conv_id, turn, 'c' || conv_id AS appid, CASE WHEN turn % 2 = 0 THEN CAST(turn AS VARCHAR) END AS "reviewId", CASE WHEN object IS NULL THEN 'non-JSON output' END AS error, object->>'$.x.s' AS s FROM o""",
    "cluster_assign": _k_means(),
    "embed_texts": r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda t: t <> '')) AS w FROM documents),
n AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS j, sum(1 - 2 * (CAST('0x' || substr(md5(w), 9, 1) AS BIGINT) & 1)) AS n FROM w GROUP BY ALL),
a AS (SELECT doc_id, j, coalesce(n, 0)::DOUBLE AS n FROM (SELECT doc_id, j FROM documents, range(64) r(j)) q LEFT JOIN n USING (doc_id, j)),
s AS (SELECT doc_id, j, CAST(n / greatest(sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 1e-12) AS FLOAT) AS v FROM a)
SELECT doc_id, string_agg(CAST(CAST(round(v::DOUBLE * 1e6::DOUBLE) AS BIGINT) AS VARCHAR), ',' ORDER BY j) AS emb FROM s GROUP BY 1""",
    "stable_ids": "SELECT page_id, CAST(('0x' || substr(md5(url), 1, 12)) AS BIGINT) AS stable_id FROM pages",
    "response_reasons": f"WITH {_MADE} SELECT doc_id AS line_no, reason FROM reasons",
    "response_valid": f"""WITH {_MADE} SELECT doc_id AS line_no, appid, "reviewId", round("Flow", 8) AS "Flow", round("Utility", 8) AS "Utility", round("Nostalgia", 8) AS "Nostalgia", round("None", 8) AS "None", dominant, renormalised, dominant <> said AS dominance_fixed, model FROM valid""",
    "response_counters": f"""WITH {_MADE}
SELECT (SELECT count(*) FROM reasons) AS lines, (SELECT count(*) FROM fixed) AS valid, (SELECT count(reason) FROM reasons) AS invalid, (SELECT count(*) FILTER (renormalised) FROM fixed) AS renormalised,
  (SELECT count(*) FILTER (dominant <> said) FROM judged) AS dominance_fixed,
  (SELECT count(*) FROM sampled s WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE s.appid = v.appid AND s."reviewId" IS NOT DISTINCT FROM v."reviewId")) AS missing,
  (SELECT count(*) FROM valid v WHERE NOT EXISTS (SELECT 1 FROM sampled s WHERE s.appid = v.appid AND s."reviewId" IS NOT DISTINCT FROM v."reviewId")) AS unmatched""",
    "missing_responses": f'WITH {_MADE} SELECT appid, "reviewId", doc_id FROM sampled s WHERE NOT EXISTS (SELECT 1 FROM partly v WHERE s.appid = v.appid AND s."reviewId" IS NOT DISTINCT FROM v."reviewId")',
    "unmatched_responses": f'WITH {_MADE} SELECT appid, "reviewId", doc_id AS line_no FROM partly v WHERE NOT EXISTS (SELECT 1 FROM sampled s WHERE s.appid = v.appid AND s."reviewId" IS NOT DISTINCT FROM v."reviewId")',
    "pending_prompts": f"""WITH {REVIEWS_SQL}, p AS (SELECT appid, CASE WHEN doc_id % 10 <> 0 THEN "reviewId" END AS "reviewId", doc_id FROM reviews)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.doc_id % 4 = 0 AND q.appid = p.appid AND q."reviewId" IS NOT DISTINCT FROM p."reviewId")""",
    "retry_units": f"""WITH {REVIEWS_SQL} SELECT appid, 'review:' || "reviewId" AS unit_id, doc_id FROM reviews WHERE doc_id % 9 = 0 OR doc_id % 10 = 0 OR doc_id % 13 = 0""",
    "upsert_responses": f"""WITH {REVIEWS_SQL} SELECT appid, "reviewId", CASE WHEN doc_id % 6 = 0 THEN 'new' ELSE 'old' END AS run FROM reviews""",
    "response_app_agg": f"WITH {_MADE} SELECT appid, count(*) AS n, count(dominant) AS answered, " + ", ".join(f'round(avg("{k}"), 6) AS "{k}_mean"' for k in DIMENSIONS) + ", round(avg(confidence), 6) AS confidence_mean, "
    + ", ".join(f"round(CASE WHEN count(dominant) > 0 THEN count(*) FILTER (dominant = '{k}') / count(dominant) END, 6) AS \"{k}_rate\"" for k in (*DIMENSIONS, "tie")) + """, round(avg(CASE WHEN coalesce("None" < 0.5, false) THEN 1 ELSE 0 END), 6) AS pct_fun_any FROM answered GROUP BY appid""",
    "unit_app_agg": f"WITH {REVIEWS_SQL}, {_UNITS} SELECT appid, " + ", ".join(f'round("{k}", 6) AS "{k}_share_mean"' for k in DIMENSIONS) + ", n_units, round(confidence_mean, 6) AS confidence_mean, round(confidence_var, 6) AS confidence_var FROM unit_apps",
    "unit_app_percent": f"WITH {REVIEWS_SQL}, {_UNITS} SELECT appid, " + ", ".join(f'round("{k}" * 100, 6) AS "{k}_share_mean"' for k in DIMENSIONS) + ", n_units, round(confidence_mean, 6) AS confidence_mean, round(confidence_var, 6) AS confidence_var FROM unit_apps",
    "confidence_diag": f"WITH {REVIEWS_SQL}, {_UNITS} SELECT count(*) AS n, round(avg(confidence), 6) AS mean, round(stddev_samp(confidence), 6) AS std, min(confidence) AS min, round(quantile_cont(confidence, 0.1), 6) AS p10, round(quantile_cont(confidence, 0.5), 6) AS p50, round(quantile_cont(confidence, 0.9), 6) AS p90, max(confidence) AS max FROM units WHERE confidence BETWEEN 0 AND 1",
    "sum_anomalies": f"WITH {REVIEWS_SQL}, {_UNITS} SELECT count(*) AS records, count(*) FILTER (abs(f + u + n + z - 1) > 1e-6) AS anomalies FROM units",
    "error_types": "SELECT event_type AS error_type, count(*) AS n FROM events GROUP BY 1",
    "cluster_k": f"WITH {REVIEWS_SQL}, c AS (SELECT appid, count(*) AS n FROM reviews GROUP BY appid) SELECT appid, n, CAST(greatest(1, least(n, greatest(8, least(24, round_even(sqrt(n), 0))))) AS INTEGER) AS k FROM c",
    "cluster_medoids": """WITH e AS (SELECT CAST(label % 4 AS VARCHAR) AS appid, CAST(label AS INTEGER) AS cluster_id, CAST(vec_id AS VARCHAR) AS rid, embedding FROM embeddings),
x AS (SELECT appid, cluster_id, rid, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM e), m AS (SELECT appid, cluster_id, i, avg(v) AS c FROM x GROUP BY ALL),
d AS (SELECT appid, cluster_id, rid, round(sum((v - c) * (v - c)), 12) AS d FROM x JOIN m USING (appid, cluster_id, i) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY appid, cluster_id ORDER BY d, rid) AS place, count(*) OVER (PARTITION BY appid, cluster_id) AS cluster_size FROM d) SELECT appid, cluster_id, rid AS "rep_reviewId", cluster_size FROM r WHERE place = 1""",
    "cluster_summaries": f'WITH {_CLUSTER_TEXT} SELECT appid, cluster_id, summary_text, summary_n_reviews, "source_reviewIds" FROM summaries',
    "scoring_units": f"WITH {_CLUSTER_TEXT} SELECT appid, 'app:' || appid || '-cluster:' || CAST(cluster_id AS VARCHAR) AS unit_id, 'cluster' AS level, CAST(length(summary_text) AS INTEGER) AS n FROM summaries WHERE length(trim(summary_text)) >= 3",
    "representative_units": f"""WITH {REVIEWS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY appid, doc_id % 5 ORDER BY "charLen" DESC, "reviewId") AS place FROM reviews)
SELECT appid, 'review:' || "reviewId" AS unit_id, 'review' AS level, CAST(length(coalesce(review, '')) AS INTEGER) AS n FROM r WHERE place = 1 AND length(trim(coalesce(review, ''))) >= 3""",
    "method_compare": f"WITH {_LONG}, d AS (SELECT appid, count(*) AS n_reviews, round(avg(n_tokens), 6) AS n_tokens_mean, round(count(*) FILTER (NOT zero_hit) * 100.0::DOUBLE / count(*), 6) AS pct_with_fun FROM scored GROUP BY appid) "
    + "SELECT long.appid, any_value(n_reviews) AS n_reviews, any_value(n_tokens_mean) AS n_tokens_mean, any_value(pct_with_fun) AS pct_with_fun, round(any_value(u.confidence_mean), 6) AS confidence_mean, " + ", ".join(f"round(max(x) FILTER (dimension = '{k}'), 6) AS \"{k}_dict\", round(max(y) FILTER (dimension = '{k}'), 6) AS \"{k}_llm\"" for k in DIMENSIONS) + " FROM long JOIN d ON long.appid = d.appid JOIN unit_apps u ON long.appid = u.appid GROUP BY long.appid",
    "method_pearson": f"WITH {_LONG} SELECT round(corr(y, x), 6) AS r, count(*) AS n, dimension FROM long GROUP BY dimension",
    "method_spearman": f"""WITH {_LONG}, nine AS (SELECT dimension, round(x, 9) AS x, round(y, 9) AS y FROM long),
ranks AS (SELECT dimension, rank() OVER (PARTITION BY dimension ORDER BY x) + (count(*) OVER (PARTITION BY dimension, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY dimension ORDER BY y) + (count(*) OVER (PARTITION BY dimension, y) - 1) / 2 AS ry FROM nine)
SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n, dimension FROM ranks GROUP BY dimension""",
    "method_kl": f"""WITH {_LONG}, c AS (SELECT dimension, greatest(1e-9, least(1, x)) AS p, greatest(1e-9, least(1, y)) AS q FROM long), s AS (SELECT dimension, sum(p) AS sp, sum(q) AS sq FROM c GROUP BY dimension)
SELECT round(sum(p / sp * ln((p / sp) / (q / sq))), 6) AS kl, dimension FROM c JOIN s USING (dimension) GROUP BY dimension""",
    "mann_whitney": f"""WITH {REVIEWS_SQL}, r AS (SELECT "isPositive" = 1 AS g, rank() OVER (ORDER BY "charLen") + (count(*) OVER (PARTITION BY "charLen") - 1) / 2 AS r FROM reviews),
t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM reviews GROUP BY "charLen")),
s AS (SELECT count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, sum(r) FILTER (g) AS r1 FROM r),
u AS (SELECT n1, n2, r1 - CAST(n1 AS DOUBLE) * (n1 + 1) / 2 AS u, sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * ((n1 + n2 + 1) - ties / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))) AS sd FROM s, t),
z AS (SELECT n1, n2, u, (u - CAST(n1 AS DOUBLE) * n2 / 2) / sd AS z FROM u), a AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS k FROM z)
SELECT n1, n2, u, round(z, 6) AS z, round(least(1, 2 * exp(-z * z / 2) / sqrt(2 * pi()) * k * (0.319381530::DOUBLE + k * (-0.356563782::DOUBLE + k * (1.781477937::DOUBLE + k * (-1.821255978::DOUBLE + k * 1.330274429::DOUBLE))))), 6) AS p FROM a""",
}
