"""Folding to ASCII: the rule character by character, and its time on long texts."""

import time
import unicodedata

from pyspark.sql import functions as F

from critiq.functions import text as X


def rule(t):
    return "".join(x for x in unicodedata.normalize("NFKD", t) if x < "\x80")


def folded(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.ascii_fold(F.col("t")).alias("t")).collect()
    return [r.t for r in sorted(rows)]


def test_equals_decomposition(spark):
    texts = ["", "plain", "é", "ﬁn ½ … ﷺ", "ä" * 50 + "ﬀ" * 50, "𝐀𝟘🄐 😀x", "жж日本 é", "№1 ™ ㎏", "½¼¾" * 20 + "ſ"]
    assert folded(spark, [*texts, None]) == [*map(rule, texts), None]


def test_long_texts_take_no_class_a_character(spark):
    folded(spark, ["é ﬁ"])
    begun = time.monotonic()
    assert folded(spark, ["ж日e" * 700_000] * 4) == ["e" * 700_000] * 4
    assert time.monotonic() - begun < 9
