"""Queries over the catalogue, pairs and bibliometrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from critiq.functions.text import check_label
from critiq.operators import bibliometrics as B
from critiq.operators import catalog as C
from critiq.operators import pairing as P
from critiq.operators import quality_control as Q
from critiq.operators.ranking import global_rank
from critiq.plans.views import CATALOG_SQL, ELIGIBLE_SQL, MIN_REVIEWS, catalog, details, table
from critiq.sources.scratch import saved

SCORED = ["appid", "name", "posReview", "negReview", "totReview", "posRate", "popularity", "acceptanceScore"]
JUMP, NON_GAME = ("promo",), ("standard", "brand 7", "small")


def _eligible(spark, sf_dir):
    """Kept, since it is counted before it is ranked."""
    return saved(C.eligible(C.acceptance(catalog(spark, sf_dir)), MIN_REVIEWS), "eligible")


def acceptance_metrics(spark, sf_dir):
    return C.acceptance(catalog(spark, sf_dir)).select(SCORED)


def acceptance_rank(spark, sf_dir):
    return C.ranked(_eligible(spark, sf_dir)).select("appid", "acceptanceScore", "rankAcceptance")


def acceptance_rank_ranges(spark, sf_dir):
    """The same ranks by counted ranges of the score, as tables beyond one task's reach are ranked."""
    rows = _eligible(spark, sf_dir).withColumn("number", F.col("appid").cast("long"))
    ranked = global_rank(rows, "acceptanceScore", "number", "rankAcceptance", rows_per_range=200)
    return ranked.select("appid", "acceptanceScore", "rankAcceptance")


def quartile_mid(spark, sf_dir):
    return C.quartile_slice(_eligible(spark, sf_dir), "keep_mid").select("appid", "acceptanceScore", "rankAcceptance", "rankFiltered")


def quartile_extremes(spark, sf_dir):
    return C.quartile_slice(_eligible(spark, sf_dir), "keep_extremes").select("appid", "acceptanceScore", "rankAcceptance", "rankFiltered")


def quartile_borders(spark, sf_dir):
    return C.quartile_borders(_eligible(spark, sf_dir))


def top_catalog(spark, sf_dir):
    rows = C.acceptance(catalog(spark, sf_dir))
    return C.top(rows, 5, F.desc("acceptanceScore"), F.col("appid").cast("long")).select("appid", "name", "acceptanceScore")


def first_genre(spark, sf_dir):
    return P.with_first_genre(details(spark, sf_dir), JUMP, NON_GAME).select("appid", "firstGenre", "genreKey", "allGenres")


def _candidates(spark, sf_dir):
    ranked = C.quartile_slice(_eligible(spark, sf_dir), "keep_extremes")
    english = ranked.select("appid", F.lit(None).cast("long").alias("total_reviews"), F.col("posReview").alias("total_positive"), F.col("negReview").alias("total_negative"))
    return P.pair_candidates(ranked, P.with_first_genre(details(spark, sf_dir), JUMP, NON_GAME), english, 30)


def pair_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("appid", "rankFiltered", "firstGenre", "englishReviews")


def select_pairs(spark, sf_dir):
    return P.select_pairs(saved(_candidates(spark, sf_dir), "candidates")).select("pairIndex", "type", "appid", "firstGenre", "rankFiltered")


def _given_pairs(scored):
    """Ranks 2i - 1 and 2i as pair i, so that SQL can say which pairs there are."""
    rows = C.ranked(scored)
    return rows.select(F.ceil(F.col("rankAcceptance") / 2).cast("int").alias("pairIndex"), F.when(F.col("rankAcceptance") % 2 == 1, "top").otherwise("bottom").alias("type"), "appid")


def pair_deltas(spark, sf_dir):
    scored = _eligible(spark, sf_dir)
    return P.pair_deltas(scored, _given_pairs(scored), ["acceptanceScore", "totReview"]).withColumns({c: F.round(c, 6) for c in ("acceptanceScore_diff",)})


def qc_catalog(spark, sf_dir):
    ranked = C.ranked(_eligible(spark, sf_dir))
    spoilt = ranked.withColumn("acceptanceScore", F.when(F.col("appid").cast("long") % 97 == 0, F.col("acceptanceScore") + 0.5).otherwise(F.col("acceptanceScore")))
    return Q.catalog_issues(spoilt)


def qc_filtered(spark, sf_dir):
    kept = C.quartile_slice(_eligible(spark, sf_dir), "keep_mid")
    spoilt = kept.filter(F.col("appid").cast("long") % 89 != 0).unionByName(kept.filter(F.col("appid").cast("long") % 83 == 0))
    return Q.filtered_issues(spoilt, kept)


def qc_pairs(spark, sf_dir):
    """All parts as if they were pairs; every fortieth has lost its genre."""
    rows = P.with_first_genre(details(spark, sf_dir), JUMP, ())
    number = F.col("appid").cast("int")
    rows = rows.withColumns({"firstGenre": F.when(number % 40 != 0, F.col("firstGenre")), "pairIndex": number, "type": F.lit("top")})
    return Q.pair_issues(rows, NON_GAME)


def check_labels(spark, sf_dir):
    """Quality control's form of labels with separators."""
    label = F.concat_ws("&", F.initcap("p_type"), F.lit(" /"), F.replace("p_name", F.lit(" "), F.lit("_-")), F.lit("|;x"))
    return table(spark, sf_dir, "part").select("p_partkey", check_label(label).alias("label"))


def pubs_per_year(spark, sf_dir):
    return B.per_year(_papers(spark, sf_dir))


def _papers(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ID"), F.year("o_orderdate").alias("Year"), F.col("o_orderpriority").alias("Source"), F.col("o_custkey").alias("Title"))


def pub_density(spark, sf_dir):
    return B.density(pubs_per_year(spark, sf_dir))


def pub_growth(spark, sf_dir):
    rows = B.growth(pubs_per_year(spark, sf_dir))
    return rows.select(*[F.round(c, 9).alias(c) for c in ("slope", "growth")])


def _elements(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ID"), F.concat_ws("; ", F.replace(F.col("p_name"), F.lit(" "), F.lit(", ")), F.lower("p_type")).alias("Design Element"))
    return B.elements(parts)


CATEGORIES = ["Technology", "Design", "Aesthetic", "Experience", "Narrative"]
_MEMBER_RULE = {"Technology": "a", "Design": "e", "Aesthetic": "i", "Experience": "o", "Narrative": "u"}


def _of_papers(spark, sf_dir):
    """An element belongs to a category if it holds the category's vowel."""
    found = _elements(spark, sf_dir)
    membership = found.select("element").distinct().select("element", *[F.when(F.contains("element", F.lit(v)), "X").otherwise("").alias(c) for c, v in _MEMBER_RULE.items()])
    return B.paper_categories(found, membership, CATEGORIES)


def element_counts(spark, sf_dir):
    return B.element_counts(_elements(spark, sf_dir))


def category_totals(spark, sf_dir):
    return B.category_totals(_of_papers(spark, sf_dir)).withColumn("radius", F.round("radius", 6))


def category_cooccurrence(spark, sf_dir):
    return B.cooccurrence(_of_papers(spark, sf_dir), CATEGORIES)


FACETS = ["Conceptual", "Scientific", "Projectual", "Outcome"]


def facet_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "x").otherwise(" ").alias("Conceptual"), F.when(F.col("l_linestatus") == "F", "x").alias("Scientific"),
        F.when(F.col("l_discount") > 0.05, "x").alias("Projectual"), F.when(F.col("l_tax") > 0.03, "x").otherwise("").alias("Outcome"),
    )
    return B.facet_counts(rows, FACETS)


def source_totals(spark, sf_dir):
    return B.source_totals(_papers(spark, sf_dir), "Title", "Source", F.col("Source"), F.col("ID"))


def venue_counts(spark, sf_dir):
    return B.venue_counts(_papers(spark, sf_dir), "Source")


QUERIES = {f.__name__: f for f in (
    acceptance_metrics, acceptance_rank, acceptance_rank_ranges, quartile_mid, quartile_extremes, quartile_borders, top_catalog, first_genre, pair_candidates, select_pairs, pair_deltas,
    qc_catalog, qc_filtered, qc_pairs, check_labels, pubs_per_year, pub_density, pub_growth, element_counts, category_totals, category_cooccurrence, facet_counts, source_totals, venue_counts,
)}

_GENRES = """labels AS (
  SELECT CAST(p_partkey AS VARCHAR) AS appid, p_size, unnest([p_type, p_brand, split_part(p_name, ' ', 1)]) AS genre, unnest([1, 2, 3]) AS place,
         p_type || ', ' || p_brand || ', ' || split_part(p_name, ' ', 1) AS "allGenres" FROM part),
plain AS (SELECT *, trim(regexp_replace(lower(genre), '[^a-z0-9 ]', '', 'g')) AS label FROM labels),
genres AS (
  SELECT appid, any_value(p_size) AS p_size, any_value("allGenres") AS "allGenres",
         arg_min(genre, place) FILTER (label NOT IN ('promo', 'standard', 'brand 7', 'small') AND label <> '') AS "firstGenre",
         arg_min(label, place) FILTER (label NOT IN ('promo', 'standard', 'brand 7', 'small') AND label <> '') AS "genreKey"
  FROM plain GROUP BY appid)"""
_YEARS = """counts AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1),
yearly AS (SELECT CAST(y AS INTEGER) AS year, coalesce(n, 0) AS n FROM (SELECT unnest(range((SELECT min(year) FROM counts), (SELECT max(year) FROM counts) + 1)) AS y) LEFT JOIN counts ON y = year)"""
_ELEMENTS = """elements AS (SELECT DISTINCT p_partkey AS id, trim(unnest(regexp_split_to_array(replace(p_name, ' ', ', ') || '; ' || lower(p_type), '[;,]'))) AS element FROM part),
members AS (SELECT DISTINCT id, category FROM elements JOIN (VALUES ('Technology', 'a'), ('Design', 'e'), ('Aesthetic', 'i'), ('Experience', 'o'), ('Narrative', 'u')) v(category, vowel) ON contains(element, vowel))"""

ORACLES = {
    "acceptance_metrics": f"WITH {CATALOG_SQL} SELECT * FROM scored",
    "acceptance_rank_ranges": f'WITH {ELIGIBLE_SQL} SELECT appid, "acceptanceScore", "rankAcceptance" FROM ranked',
    "acceptance_rank": f'WITH {ELIGIBLE_SQL} SELECT appid, "acceptanceScore", "rankAcceptance" FROM ranked',
    "quartile_mid": f'WITH {ELIGIBLE_SQL} SELECT appid, "acceptanceScore", "rankAcceptance", "rankFiltered" FROM mid',
    "quartile_extremes": f'WITH {ELIGIBLE_SQL} SELECT appid, "acceptanceScore", "rankAcceptance", "rankAcceptance" - CASE WHEN "rankAcceptance" - 1 >= q3 THEN q3 - q1 ELSE 0 END AS "rankFiltered" FROM cut WHERE NOT ("rankAcceptance" - 1 >= q1 AND "rankAcceptance" - 1 < q3)',
    "quartile_borders": f'WITH {ELIGIBLE_SQL} SELECT "rankAcceptance" - 1 AS position, appid, "acceptanceScore" FROM cut WHERE "rankAcceptance" - 1 IN (0, q1 - 1, q1, q3 - 1, q3, n - 1)',
    "top_catalog": f'WITH {CATALOG_SQL} SELECT appid, name, "acceptanceScore" FROM scored ORDER BY "acceptanceScore" DESC, CAST(appid AS BIGINT) LIMIT 5',
    "first_genre": f'WITH {_GENRES} SELECT appid, "firstGenre", "genreKey", "allGenres" FROM genres',
    "pair_candidates": f"""WITH {ELIGIBLE_SQL}, {_GENRES},
kept AS (SELECT *, "rankAcceptance" - CASE WHEN "rankAcceptance" - 1 >= q3 THEN q3 - q1 ELSE 0 END AS "rankFiltered" FROM cut WHERE NOT ("rankAcceptance" - 1 >= q1 AND "rankAcceptance" - 1 < q3))
SELECT k.appid, "rankFiltered", "firstGenre", "totReview" AS "englishReviews" FROM kept k JOIN genres g ON k.appid = g.appid WHERE p_size > 5 AND "firstGenre" IS NOT NULL AND "totReview" >= 30""",
    "pair_deltas": f"""WITH {ELIGIBLE_SQL},
sides AS (SELECT CAST(ceil("rankAcceptance" / 2) AS INTEGER) AS "pairIndex", "rankAcceptance" % 2 = 1 AS is_top, "acceptanceScore" AS s, "totReview" AS t FROM ranked)
SELECT a."pairIndex", a.s AS "acceptanceScore_top", b.s AS "acceptanceScore_bottom", a.t AS "totReview_top", b.t AS "totReview_bottom", round(a.s - b.s, 6) AS "acceptanceScore_diff", a.t - b.t AS "totReview_diff"
FROM sides a JOIN sides b ON a."pairIndex" = b."pairIndex" AND a.is_top AND NOT b.is_top""",
    "qc_catalog": f"""WITH {ELIGIBLE_SQL},
spoilt AS (SELECT *, CASE WHEN CAST(appid AS BIGINT) % 97 = 0 THEN "acceptanceScore" + 0.5::DOUBLE ELSE "acceptanceScore" END AS s FROM ranked),
lagged AS (SELECT *, lag(s) OVER (ORDER BY "rankAcceptance") AS before FROM spoilt)
SELECT 'ERROR' AS level, 'catalog_order' AS "where", appid, CAST("rankAcceptance" AS VARCHAR) AS detail FROM lagged WHERE s > before + 0.000001::DOUBLE
UNION ALL SELECT 'INFO', 'catalog_score', appid, CAST("acceptanceScore" AS VARCHAR) FROM spoilt WHERE s <> "acceptanceScore" """,
    "qc_filtered": f"""WITH {ELIGIBLE_SQL}
SELECT 'ERROR' AS level, 'filtered_missing' AS "where", appid, 'expected' AS detail FROM mid WHERE CAST(appid AS BIGINT) % 89 = 0 AND CAST(appid AS BIGINT) % 83 <> 0
UNION ALL SELECT 'ERROR', 'filtered_duplicate', appid, '2' FROM mid WHERE CAST(appid AS BIGINT) % 83 = 0 AND CAST(appid AS BIGINT) % 89 <> 0
UNION ALL SELECT 'ERROR', 'filtered_extra', appid, 'not expected' FROM mid WHERE CAST(appid AS BIGINT) % 83 = 0 AND CAST(appid AS BIGINT) % 89 <> 0""",
    "select_pairs": f"""WITH RECURSIVE {ELIGIBLE_SQL}, {_GENRES},
kept AS (SELECT *, "rankAcceptance" - CASE WHEN "rankAcceptance" - 1 >= q3 THEN q3 - q1 ELSE 0 END AS "rankFiltered" FROM cut WHERE NOT ("rankAcceptance" - 1 >= q1 AND "rankAcceptance" - 1 < q3)),
c AS MATERIALIZED (SELECT k.appid, "rankFiltered" AS r, "firstGenre", "genreKey" AS g FROM kept k JOIN genres x ON k.appid = x.appid WHERE p_size > 5 AND "firstGenre" IS NOT NULL AND "totReview" >= 30),
ends AS MATERIALIZED (SELECT g, min(r) AS a, max(r) AS b FROM c GROUP BY g),
walk AS (
  SELECT 0 AS i, CAST(-1 AS BIGINT) AS low, CAST(1e18 AS BIGINT) AS high, CAST([] AS VARCHAR[]) AS used
  UNION ALL
  SELECT i + 1, t.a, d.b, list_concat(used, [t.g, d.g]) FROM walk w,
    LATERAL (SELECT g, a FROM ends WHERE a > w.low AND a < w.high AND NOT list_contains(w.used, g) ORDER BY a LIMIT 1) t,
    LATERAL (SELECT g, b FROM ends WHERE b > t.a AND b < w.high AND NOT list_contains(w.used, g) AND g <> t.g ORDER BY b DESC LIMIT 1) d
  WHERE i < 5)
SELECT CAST(i AS INTEGER) AS "pairIndex", side AS type, appid, "firstGenre", r AS "rankFiltered" FROM (SELECT i, unnest(['top', 'bottom']) AS side, unnest([low, high]) AS stands FROM walk WHERE i > 0) JOIN c ON r = stands""",
    "qc_pairs": """WITH labels AS (SELECT p_partkey AS id, unnest([p_type, p_brand, split_part(p_name, ' ', 1)]) AS genre, unnest([1, 2, 3]) AS place FROM part),
plain AS (SELECT *, trim(regexp_replace(lower(genre), '[^a-z0-9 ]', '', 'g')) AS label FROM labels),
first AS (SELECT id, CASE WHEN id % 40 <> 0 THEN arg_min(genre, place) FILTER (label <> 'promo' AND label <> '') END AS genre FROM plain GROUP BY id),
checked AS (SELECT id, regexp_replace(translate(lower(trim(coalesce(genre, ''))), '&/\\+-_,;|', '         '), ' +', ' ', 'g') AS label FROM first),
seen AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS seen FROM checked)
SELECT 'ERROR' AS level, 'pair_genre_forbidden' AS "where", CAST(id AS VARCHAR) AS appid, label AS detail FROM seen WHERE label IN ('standard', 'brand 7', 'small')
UNION ALL SELECT 'ERROR', 'pair_genre_repeated', CAST(id AS VARCHAR), label FROM seen WHERE seen > 1 AND label <> ''
UNION ALL SELECT 'WARN', 'pair_genre_missing', CAST(id AS VARCHAR), CAST(id AS VARCHAR) FROM seen WHERE label = ''""",
    "check_labels": r"""SELECT p_partkey, regexp_replace(translate(lower(p_type || '& /&' || replace(p_name, ' ', '_-') || '&|;x'), '&/\+-_,;|', '         '), ' +', ' ', 'g') AS label FROM part""",
    "pubs_per_year": f"WITH {_YEARS} SELECT year, n FROM yearly",
    "pub_density": f"WITH {_YEARS} SELECT year, n, CAST(sum(n) OVER (ORDER BY year RANGE BETWEEN CURRENT ROW AND 4 FOLLOWING) AS BIGINT) AS density FROM yearly",
    "pub_growth": f"WITH {_YEARS} SELECT round(regr_slope(ln(CAST(n AS DOUBLE)), CAST(year AS DOUBLE)), 9) AS slope, round(exp(regr_slope(ln(CAST(n AS DOUBLE)), CAST(year AS DOUBLE))) - 1, 9) AS growth FROM yearly WHERE n > 0",
    "element_counts": f"WITH {_ELEMENTS} SELECT element, count(*) AS n FROM elements WHERE element <> '' GROUP BY 1",
    "category_totals": f"WITH {_ELEMENTS} SELECT category, count(*) AS n, round(sqrt(count(*) / pi()), 6) AS radius FROM members GROUP BY 1",
    "category_cooccurrence": f"""WITH {_ELEMENTS}, single AS (SELECT id, any_value(category) AS category FROM members GROUP BY id HAVING count(*) = 1)
SELECT a.category AS a, b.category AS b, count(*) AS n FROM members a JOIN members b ON a.id = b.id AND a.category < b.category GROUP BY 1, 2
UNION ALL SELECT category, category, count(*) FROM single GROUP BY 1""",
    "facet_counts": """WITH f AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS a, CAST(l_linestatus = 'F' AS INTEGER) AS b, CAST(l_discount > 0.05 AS INTEGER) AS c, CAST(l_tax > 0.03 AS INTEGER) AS d FROM lineitem)
SELECT a + b + c + d AS n_facets, count(*) AS papers, CAST(sum(a) AS BIGINT) AS "Conceptual", CAST(sum(b) AS BIGINT) AS "Scientific", CAST(sum(c) AS BIGINT) AS "Projectual", CAST(sum(d) AS BIGINT) AS "Outcome" FROM f GROUP BY 1""",
    "source_totals": """WITH p AS (SELECT o_orderpriority AS "Source", row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS place FROM orders)
SELECT "Source", count(*) AS found, count(*) FILTER (place = 1) AS kept FROM p GROUP BY 1""",
    "venue_counts": "SELECT o_orderpriority AS \"Source\", count(*) AS n FROM orders GROUP BY 1",
}
