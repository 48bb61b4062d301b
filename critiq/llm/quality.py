"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a text: its distinct words hashed to BUCKETS columns (tf-weighted, scaled to length 1), structure statistics
(shares, repetitions, lengths) cut into bins, one column each, and the metadata that come with it: n_chars, in bins too,
and how it compares to the text's own length (absent, too small, equal, too large). A pair of features interacts through
the inner product of their RANK-vectors. By the sum-of-squares identity all pairs together cost one pass:
sum over f of ((sum v_if x_i)^2 - sum (v_if x_i)^2) / 2.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critiq.llm.shared import SPACE, Hasher, chunks, code_points, lowest, utf8, words_of

BUCKETS = 1 << 15
RANK = 8
#: Labelled documents to learn from, per label; the rest of the labels stay unused.
TRAIN_PER_LABEL = 1500
STATISTICS = ("log_chars", "log_words", "distinct_share", "repeat_share", "symbol_share", "digit_share", "upper_share", "line_share",
              "mean_word", "attached_share", "single_share", "top_word_share", "wide_share")
BINS = 24
_EDGES = {"log_chars": 12.0, "log_words": 11.0, "mean_word": 16.0}
#: Metadata columns: bins of n_chars, one for an absent n_chars, and three for the comparison.
METADATA = BINS + 1 + 3
WIDTH = BUCKETS + len(STATISTICS) * BINS + METADATA
_CLASS = np.zeros(256, np.uint8)  # 1 letter, 2 digit, 3 symbol, 4 space, 5 wide
_CLASS[:] = 3
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[SPACE] = 4
_CLASS[0x80:] = 5


def features(column: pa.Array, n_chars: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column numbers, values and row starts (n + 1) of the texts' sparse features, whole texts, null as empty.

    n_chars is the metadata of the texts; null where a text has none, and for all texts if it is not given.
    """
    raw, offsets = utf8(column, lower=False)
    data, _ = utf8(column)
    n = len(offsets) - 1
    starts, ends, doc = words_of(data, offsets, SPACE)
    hashed = Hasher(data)(starts, ends)
    count = np.bincount(doc, minlength=n)
    words, chars = np.maximum(count, 1), np.maximum(np.diff(offsets), 1)

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(table)))
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / chars

    # distinct (document, bucket) pairs and how often each occurs
    pair = doc.astype(np.uint64) * np.uint64(BUCKETS) + hashed % np.uint64(BUCKETS)
    pair, times = np.unique(pair, return_counts=True)
    row, bucket = (pair // np.uint64(BUCKETS)).astype(np.int64), (pair % np.uint64(BUCKETS)).astype(np.int64)
    value = np.log1p(times)
    value /= np.sqrt(np.maximum(np.bincount(row, value**2, minlength=n), 1e-12))[row]

    kind = _CLASS[raw]
    # a symbol within or at the end of a word
    edge = (kind[ends - 1] == 3) & (ends - starts > 1)
    twice = (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])
    top = np.zeros(n)
    np.maximum.at(top, row, times)
    stats = np.stack([
        np.log(chars), np.log(words), np.bincount(row, minlength=n) / words, np.bincount(doc[1:][twice], minlength=n) / words,
        share(kind == 3), share(kind == 2), share((raw >= 0x41) & (raw < 0x5B)), share(raw == 0x0A) * 10,
        chars / words, np.bincount(doc[edge], minlength=n) / words, np.bincount(doc[ends - starts == 1], minlength=n) / words, top / words, share(kind == 5),
    ], axis=1)
    scale = np.array([_EDGES.get(name, 1.0) for name in STATISTICS])
    binned = np.clip((np.sqrt(np.clip(stats / scale, 0, 1)) * BINS).astype(np.int64), 0, BINS - 1)
    binned += BUCKETS + np.arange(len(STATISTICS)) * BINS
    first = BUCKETS + len(STATISTICS) * BINS
    told = np.full(n, -1.0) if n_chars is None else pc.fill_null(n_chars.cast(pa.float64()), -1.0).to_numpy(zero_copy_only=False)
    size = np.clip(np.log(np.maximum(told, 1)) / _EDGES["log_chars"], 0, 1)
    own = code_points(raw)[offsets]
    against = BINS + 2 + np.sign(told - np.diff(own)).astype(np.int64)  # less, equal, more
    about = np.stack((np.where(told < 0, BINS, np.clip((np.sqrt(size) * BINS).astype(np.int64), 0, BINS - 1)), np.where(told < 0, BINS, against)), 1) + first
    binned = np.concatenate((binned, about), 1)
    row = np.concatenate((row, np.repeat(np.arange(n), binned.shape[1])))
    order = np.argsort(row, kind="stable")
    columns = np.concatenate((bucket, binned.ravel()))[order]
    values = np.concatenate((value, np.full(binned.size, 1 / np.sqrt(binned.shape[1]))))[order]
    return columns, values, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n))))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, columns: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The machine's sum for each row; every row has features."""
        vx = self.factors[columns] * values[:, None]
        at = starts[:-1]
        sums = np.add.reduceat(vx, at)
        squares = np.add.reduceat(vx**2, at)
        return self.bias + np.add.reduceat(self.linear[columns] * values, at) + ((sums**2 - squares).sum(1)) / 2

    def score(self, column: pa.Array, n_chars: pa.Array | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*features(column, n_chars)), -30, 30))) if len(column) else np.zeros(0)


def fit(texts: list[str | None], labels: list[int], **options) -> Machine:
    """The machine of texts without metadata and their labels; see fit_features."""
    return fit_features([features(pa.array(texts[i : i + 100], pa.string())) for i in range(0, len(texts), 100)], labels, **options)


def fit_features(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: list[int], epochs: int = 10, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Logistic loss, adaptive gradient steps over small batches. Without both labels the score is their share."""
    y = np.asarray(labels, float)
    rng = np.random.default_rng(seed)
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(WIDTH), rng.normal(0, 0.02, (WIDTH, RANK)))
    if len(set(labels)) < 2:
        machine.factors[:] = 0
        return machine
    columns, values = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    starts = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))))
    g_linear, g_factors, g_bias = np.full(WIDTH, 1e-6), np.full((WIDTH, RANK), 1e-6), 1e-6
    # batches are runs of a shuffled order; both labels weigh as they occur
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            size = (starts[rows + 1] - starts[rows]).astype(np.int64)
            ends = np.cumsum(size)
            at = np.repeat(starts[rows] - (ends - size), size) + np.arange(ends[-1])
            c, v, s = columns[at], values[at], np.concatenate(([0], ends))
            vx = machine.factors[c] * v[:, None]
            sums = np.add.reduceat(vx, s[:-1])
            margin = machine.bias + np.add.reduceat(machine.linear[c] * v, s[:-1]) + (sums**2 - np.add.reduceat(vx**2, s[:-1])).sum(1) / 2
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]) / len(rows)
            each = np.repeat(error, size)
            step = (each * v)[:, None] * (np.repeat(sums, size, axis=0) - vx)
            used, place = np.unique(c, return_inverse=True)
            d_linear = np.bincount(place, each * v) + decay * machine.linear[used]
            d_factors = np.stack([np.bincount(place, step[:, f]) for f in range(RANK)], 1) + decay * machine.factors[used]
            g_linear[used] += d_linear**2
            g_factors[used] += d_factors**2
            g_bias += error.sum() ** 2
            machine.linear[used] -= rate * d_linear / np.sqrt(g_linear[used])
            machine.factors[used] -= rate * d_factors / np.sqrt(g_factors[used])
            machine.bias -= rate * error.sum() / np.sqrt(g_bias)
    machine.linear, machine.factors = machine.linear.astype(np.float32), machine.factors.astype(np.float32)
    return machine


def labelled_ids(labels: DataFrame, label: str, keep: Column | None) -> DataFrame:
    """(doc_id, y) of all documents with a label 0 or 1 for which `keep`, if given, holds."""
    return labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (F.lit(True) if keep is None else keep)).groupBy("doc_id").agg(F.max(label).alias("y"))


def sample_shift(labels: DataFrame, label: str, keep: Column | None, per_label: int) -> float:
    """What log odds learnt from labelled_sample lack: it takes per_label of each label, whatever their shares are.

    Both labels are counted over all rows, so that scores mean the same at every size of the input.
    """
    n = {r.y: r.n for r in labelled_ids(labels, label, keep).groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return 0.0
    return float(np.log(n[1] / min(n[1], per_label)) - np.log(n[0] / min(n[0], per_label)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column | None, per_label: int, seed: str) -> DataFrame:
    """(doc_id, y, text): at most per_label documents of each label 0 and 1 for which `keep`, if given, holds, by lowest hash."""
    rows = labelled_ids(labels, label, keep)
    ids = None
    for y in (0, 1):
        some = lowest(rows.filter(F.col("y") == y), "doc_id", per_label, seed)
        ids = some if ids is None else ids.unionByName(some)
    # at most 2 * per_label ids of 8 bytes are broadcast
    return docs.select("doc_id", "text", *[c for c in docs.columns if c == "n_chars"]).join(F.broadcast(ids), "doc_id")


def _with_metadata(docs: DataFrame, *columns) -> DataFrame:
    """columns, text and n_chars (null where docs has none)."""
    n_chars = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.select(*columns, "text", n_chars.try_cast("double").alias("n_chars"))


def train_quality(docs: DataFrame, labels: DataFrame, keep: Column | None = None, per_label: int = TRAIN_PER_LABEL) -> Machine:
    """Fit on a bounded sample of the rows of labels (doc_id, quality) for which the condition `keep`, if any, holds.

    docs: doc_id, text and, where there is one, n_chars. Features are made in tasks and only they come to the driver,
    BUCKETS numbers at most for a text of any length. The bias is moved from the sample's shares of the labels to those
    of all these rows.
    """

    def draw(batches):
        for batch in chunks(batches):
            columns, values, starts = features(batch.column("text"), batch.column("n_chars"))
            packed = [[x[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)] for x in (columns.astype(np.int32), values.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *[pa.array(x, pa.binary()) for x in packed]], names=["doc_id", "y", "columns", "values"])

    sample = labelled_sample(docs, labels, "quality", keep, per_label, "quality")
    drawn = _with_metadata(sample, F.col("doc_id").cast("long"), F.col("y").cast("int")).mapInArrow(draw, "doc_id long, y int, columns binary, values binary")
    rows = sorted(drawn.collect(), key=lambda r: (r.doc_id, bytes(r.columns), bytes(r.values)))
    parts = [(c := np.frombuffer(r.columns, np.int32).astype(np.int64), np.frombuffer(r.values, np.float32).astype(np.float64), np.array([0, len(c)])) for r in rows]
    machine = fit_features(parts, [r.y for r in rows])
    machine.bias += sample_shift(labels, "quality", keep, per_label)
    return machine


def score_quality(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """docs' doc_id with score (0 to 1, higher is better) and predicted (1 if score >= threshold), a row for each row.

    Null and empty texts have structure statistics too and get a score. n_chars is used where docs has it. An empty table
    gives no rows; columns other than doc_id, text and n_chars are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(batch.column("text"), batch.column("n_chars")))], names=["doc_id", "score"])

    scored = _with_metadata(docs, F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text (and n_chars, where docs has it) reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    known = [f.name for f in docs.schema.fields if f.name == "n_chars" and isinstance(f.dataType, T.NumericType)]

    def run(batches):
        for batch in chunks(batches):
            yield batch.filter(pa.array(shared.value.score(batch.column("text"), *[batch.column(c) for c in known]) >= threshold))

    return docs.mapInArrow(run, docs.schema)
