"""The network for secrets learns from every finding, however many a document has and however many there are."""

import numpy as np
from pyspark.sql import functions as F

from critiq.llm import secrets


def _numbers(rng, n):
    return ["".join(rng.choice(list("0123456789"), 12)) for _ in range(n)]


def _hexes(rng, n):
    return ["".join(rng.choice(list("abcdef"), 20)) + "".join(rng.choice(list("0123456789"), 20)) for _ in range(n)]


def test_learns_from_late_candidates(spark):
    """What the patterns find stands behind a document's first twenty candidates."""
    rng = np.random.default_rng(3)
    rows = [(i, " and ".join(_numbers(rng, 25) + _hexes(rng, 6))) for i in range(12)]
    net = secrets.train_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    assert net.threshold <= 1
    codes, own, _ = secrets.encode_findings([(f"as {w} is", 3, 3 + len(w), 0) for w in _hexes(rng, 20) + _numbers(rng, 20)])
    found = net.probability(codes, own) >= net.threshold
    assert found[:20].mean() >= 0.9 and not found[20:].any()


def test_shares_learn_as_one(spark, monkeypatch):
    """Many shares: the same network on every partitioning, and one that tells the labels apart."""
    monkeypatch.setattr(secrets, "SHARE", 400)
    rng = np.random.default_rng(4)
    rows = [(f"it says {w} here", 8, 8 + len(w), label) for label, words in ((1, _hexes(rng, 800)), (0, _numbers(rng, 800))) for w in words]
    frame = spark.createDataFrame(rows, "text string, start int, end int, label int")
    a, b = (secrets.train_secrets(None, frame.repartition(n)) for n in (1, 5))
    assert a.threshold == b.threshold and all((a.params[k] == b.params[k]).all() for k in a.params)
    codes, own, _ = secrets.encode_findings([(f"as {w} is", 3, 3 + len(w), 0) for w in _hexes(rng, 50) + _numbers(rng, 50)])
    found = a.probability(codes, own) >= a.threshold
    assert found[:50].mean() >= 0.95 and found[50:].mean() <= 0.05


def test_every_finding_is_taken(spark):
    frame = spark.range(70_000).select(F.concat(F.lit("it says "), F.lpad(F.col("id").cast("string"), 12, "0")).alias("text"), F.lit(8).alias("start"), F.lit(20).alias("end"), (F.col("id") % 2).cast("int").alias("label"))
    seen = []
    real, secrets.fit_shares = secrets.fit_shares, lambda shares: seen.append(shares.select(F.sum(F.size("findings")).alias("n"), F.count("*").alias("k"), F.max(F.size("findings")).alias("most")).first())
    try:
        secrets.train_secrets(None, frame)
    finally:
        secrets.fit_shares = real
    assert seen[0].n == 70_000 and seen[0].k == 18 and seen[0].most < 2 * secrets.SHARE
