"""Text columns: labels, tokens, readability, masking, prompts, ids."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@cache
def _ascii_forms() -> tuple[dict[str, str], dict[str, str]]:
    """Characters beyond ASCII whose compatibility decomposition has one ASCII character, and those where it has more: character -> what is left of it."""
    one, more = {}, {}
    for c in map(chr, range(128, sys.maxunicode + 1)):
        left = "".join(x for x in unicodedata.normalize("NFKD", c) if x < "\x80")
        if left:
            (one if len(left) == 1 else more)[c] = left
    return one, more


def ascii_fold(c: Column) -> Column:
    """Compatibility decomposition without combining marks and without what is not ASCII.

    Characters that become one are translated, those that become several replaced one by one, in the texts alone that hold them.
    These are looked for among a text's distinct characters beyond ASCII, since the class of them all is slow on a character.
    """
    one, more = _ascii_forms()
    forms = F.map_from_arrays(F.lit(list(more)), F.lit(list(more.values())))
    beyond = F.array_join(F.array_distinct(F.split(F.regexp_replace(c, r"[\x00-\x7F]+", ""), "")), "")
    found = F.regexp_extract_all(beyond, F.lit("[" + "".join(more) + "]"), F.lit(0))
    opened = F.aggregate(found, c, lambda t, x: F.replace(t, x, F.element_at(forms, x)))
    plain = F.regexp_replace(F.translate(opened, "".join(one), "".join(one.values())), r"[^\x00-\x7F]", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), plain).otherwise(c)


def genre_label(c: Column, fold: bool = True) -> Column:
    """A genre in its plain form: no accents, lower case, `&` as and, separators as single spaces, a-z and 0-9 only."""
    plain = F.lower(ascii_fold(c) if fold else c)
    spaced = F.regexp_replace(F.regexp_replace(plain, "&", " and "), r"[\\/_+,\-]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, "[^a-z0-9 ]", ""), " +", " "))


def check_label(c: Column) -> Column:
    """The form that quality control uses: lower case, no white space at the ends, separators as single spaces; null as empty."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^\s+|\s+$", "")
    return F.regexp_replace(F.translate(plain, "&/\\+-_,;|", " " * 9), " +", " ")


def mask_personal(c: Column) -> Column:
    """E-mail addresses as [EMAIL], numbers of 17 digits as [STEAMID].

    An address begins where a run of its characters begins, and the run is not given back, so time is linear in the text.
    """
    return F.regexp_replace(F.regexp_replace(c, r"(?<![\w.\-])[\w.\-]++@[\w.\-]+", "[EMAIL]"), r"\b\d{17}\b", "[STEAMID]")


def normalise(c: Column) -> Column:
    """Line ends as line feeds, tabs as spaces, no white space at the ends; null as empty."""
    lines = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    return F.regexp_replace(F.translate(lines, "\t", " "), r"^\s+|\s+$", "")


def length_bucket(n: Column) -> Column:
    return F.when(n < 80, "short").when(n < 300, "medium").otherwise("long")


def long_enough(c: Column, least: int = 3) -> Column:
    return F.length(normalise(c)) >= least


def is_readable(c: Column) -> Column:
    """Three words with a letter, twenty letters, and at most 30 % of characters that are no letter, digit, white space or usual mark."""
    text = F.coalesce(c, F.lit(""))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"\p{L}")))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    odd = F.length(F.regexp_replace(text, r"""[\p{L}\p{N}\s.,!?;:'"()\-]""", ""))
    return (words >= 3) & (letters >= 20) & (odd <= F.length(text) * 0.3)


def preview(c: Column, most: int = 240) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), 1, most)


def fill_prompt(template: str, app: Column, review_id: Column, review: Column, most: int = 4000, whole: int = 8000) -> Column:
    """The template with its three places filled; review and whole prompt are cut."""
    filled = F.lit(template)
    for place, value in (("{{APPID}}", app), ("{{REVIEW_ID_OR_NULL}}", F.coalesce(review_id, F.lit("null"))), ("{{REVIEW_TEXT}}", F.substring(F.coalesce(review, F.lit("")), 1, most))):
        filled = F.replace(filled, F.lit(place), value)
    return F.substring(filled, 1, whole)


def unit_prompt(app: Column, unit: Column, level: Column, text: Column, whole: int = 8000) -> Column:
    return F.substring(F.concat(F.lit("APPID: "), app, F.lit("\nUNIT: "), unit, F.lit("\nLEVEL: "), level, F.lit("\n\n"), F.coalesce(text, F.lit(""))), 1, whole)


def stable_id(c: Column) -> Column:
    """A number from the first twelve hex digits of the md5."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 12), 16, 10).cast("long")


def unit_id(level: Column, app: Column, number: Column) -> Column:
    return F.when(level == "cluster", F.concat(F.lit("app:"), app, F.lit("-cluster:"), number.cast("string"))).otherwise(F.concat(F.lit("review:"), number.cast("string")))


def _runs(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9, and empty ones at the ends; null: one empty run."""
    return F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "), " ")


def _is_token(t: Column, shortest: int, digits: bool) -> Column:
    return F.length(t) >= shortest if digits else (F.length(t) >= shortest) & ~t.rlike("^[0-9]+$")


def tokens(c: Column, shortest: int = 2, digits: bool = True, stem: bool = False) -> Column:
    """Lower case, runs of a-z and 0-9, short ones left out, all-digit ones too if asked; null: none."""
    found = F.filter(_runs(c), lambda t: _is_token(t, shortest, digits))
    return F.transform(found, light_stem) if stem else found


def token_rows(df: DataFrame, text: str, *keys: str, shortest: int = 2, digits: bool = True, stem: bool = False) -> DataFrame:
    """(keys, token): a row per token of `tokens`, tested and stemmed after the rows are made, within generated code."""
    rows = df.select(*keys, F.explode(_runs(F.col(text))).alias("token")).filter(_is_token(F.col("token"), shortest, digits))
    return rows.withColumn("token", light_stem(F.col("token"))) if stem else rows


def light_stem(t: Column) -> Column:
    """Without the first of ing, ed, ly, ies, s that ends it and leaves more than two characters."""
    out = t
    for suffix in reversed(("ing", "ed", "ly", "ies", "s")):  # each `when` stands before those built so far
        ends = F.endswith(t, F.lit(suffix)) & (F.length(t) > len(suffix) + 2)
        out = F.when(ends, F.substring(t, F.lit(1), F.length(t) - len(suffix))).otherwise(out)
    return out
