"""Language ID: blended-spectrum string kernels, Nystrom landmarks, one-versus-rest kernel ridge regression.

A text's profile is the set of its distinct byte n-grams of lengths 1 to LONGEST (A-Z in lower case, runs of white
space, digits and ASCII symbols left out), hashed to BUCKETS. The kernel of two texts is the size of the shared set over the
geometric mean of the sizes. Landmarks are labelled texts; a text is its kernel values with them, whitened by the
landmarks' own kernel matrix, and one ridge regression per language (+1 against -1) is solved in closed form. A
block of texts is scored by two matrix products: profiles with landmarks, then kernels with weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from critiq.llm.shared import chunks, mix, saved, single_threaded, utf8

BUCKETS = 1 << 14
LONGEST = 4
#: Landmarks and training texts per language.
LANDMARKS, TRAIN_PER_LANGUAGE = 24, 250
#: Up to this many bytes of training ids are broadcast; more go through a join as Spark plans it.
BROADCAST_BYTES = 32 << 20
RIDGE = 1e-3
#: Texts whose profiles stand side by side as one dense matrix.
BLOCK = 64
_KEEP = np.zeros(256, bool)
_KEEP[0x61:0x7B] = True
_KEEP[0x80:] = True


def profiles(column: pa.Array) -> np.ndarray:
    """A row of zeros and ones per text; null texts and texts without a letter have only zeros."""
    data, offsets = utf8(column)
    kept = _KEEP[data]
    # one gap stands for a run of left-out bytes, and one before each text
    gap = ~kept
    gap[1:] &= kept[:-1]
    use = kept | gap
    value = np.where(kept, data, 0).astype(np.uint64)[use]
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[use]
    out = np.zeros((len(offsets) - 1, BUCKETS), np.float32)
    code = np.zeros(len(value), np.uint64)
    for n in range(1, LONGEST + 1):
        if len(value) < n:
            break
        last = slice(n - 1, None)
        code = (code[: len(value) - n + 1] if n > 1 else value * np.uint64(0)) * np.uint64(257) + value[last] + np.uint64(1)
        same = of[last] == of[: len(of) - n + 1]
        any_letter = code[same]
        out[of[last][same], (mix(any_letter + (np.uint64(n) << np.uint64(56))) % np.uint64(BUCKETS)).astype(np.int64)] = 1
    ascii_letters = np.bincount(of, (value >= 0x61) & (value < 0x7B), minlength=len(out)) > 0
    for i in np.flatnonzero(~ascii_letters):
        text = column[int(i)].as_py()
        if not text or not any(c.isalpha() for c in text):
            out[i] = 0
    return out


@dataclass
class Classifier:
    languages: list[str]
    landmarks: np.ndarray  # scaled profiles, one column per landmark
    weights: np.ndarray

    def margins(self, profile: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(profile.sum(1, keepdims=True), 1))
        kernel = (profile @ self.landmarks) / size
        return np.hstack((kernel, np.ones((len(kernel), 1), np.float32))) @ self.weights

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; without a letter (or anything learned): und, 0."""
        names, scores = [], []
        for at in range(0, len(column), BLOCK):
            profile = profiles(column.slice(at, BLOCK))
            known = profile.any(1) & bool(self.languages)
            if not self.languages:
                names += ["und"] * len(profile)
                scores.append(np.zeros(len(profile)))
                continue
            margin = self.margins(profile).astype(np.float64)
            best = margin.argmax(1)
            names += [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
            # margins are near +1 for the right language and near -1 for the others
            scores.append(np.where(known, np.clip((margin[np.arange(len(best)), best] + 1) / 2, 0, 1), 0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def packed(column: pa.Array) -> list[bytes]:
    """The texts' profiles, a bit for each bucket."""
    return [row.tobytes() for at in range(0, len(column), BLOCK) for row in np.packbits(profiles(column.slice(at, BLOCK)).astype(bool), axis=1)]


def _unpacked(rows: list[bytes]) -> np.ndarray:
    """Profiles scaled to length 1."""
    profile = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
    return profile / np.sqrt(profile.sum(1, keepdims=True))


def fit(texts: list[str], languages: list[str]) -> Classifier:
    """texts and their languages; the first LANDMARKS texts of each language are the landmarks."""
    return fit_profiles(packed(pa.array(texts, pa.string())), languages)


def fit_profiles(rows: list[bytes], languages: list[str]) -> Classifier:
    """The same from packed profiles. Texts without a letter teach nothing. Only the landmarks and BLOCK texts are unpacked at once."""
    single_threaded()
    some = [(r, x) for r, x in zip(rows, languages, strict=True) if any(r)]
    names = sorted({x for _, x in some})
    if not names:
        return Classifier([], np.zeros((BUCKETS, 0), np.float32), np.zeros((1, 0)))
    number = {x: i for i, x in enumerate(names)}
    of = np.array([number[x] for _, x in some])
    marks = _unpacked([some[j][0] for i in range(len(names)) for j in np.flatnonzero(of == i)[:LANDMARKS]])
    # Nystrom: with K_mm = U S U', features are k_m(x) U / sqrt(S); the ridge solution is folded back onto k_m
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    share = np.bincount(of) / len(of)
    square, right = np.zeros((whiten.shape[1] + 1,) * 2), np.zeros((whiten.shape[1] + 1, len(names)))
    for at in range(0, len(some), BLOCK):
        here = of[at : at + BLOCK]
        z = np.hstack(((_unpacked([r for r, _ in some[at : at + BLOCK]]) @ marks.T) @ whiten, np.ones((len(here), 1))))
        weight = (1 / share[here] / len(names))[:, None]  # languages weigh alike
        square += z.T @ (z * weight)
        right += z.T @ (np.where(here[:, None] == np.arange(len(names)), 1.0, -1.0) * weight)
    ridge = RIDGE * len(some) * np.eye(len(square)) * (np.arange(len(square)) < len(square) - 1)
    solved = np.linalg.solve(square + ridge, right)
    return Classifier(names, np.ascontiguousarray(marks.T, np.float32), np.vstack((whiten @ solved[:-1], solved[-1:])).astype(np.float32))


def train_language(docs: DataFrame, keep: Column | None = None) -> Classifier:
    """Fit on documents (doc_id, text, lang) with text and lang for which the condition `keep`, if any, holds.

    Of every language the TRAIN_PER_LANGUAGE rows with the lowest hash of doc_id are taken, by one window that Spark cuts on
    each task; their profiles, BUCKETS bits each, come to the driver. Rows without doc_id teach nothing.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if keep is None else keep))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64(F.lit("language"), "doc_id"), "doc_id"))
    ids = saved(rows.select("doc_id", "lang").withColumn("place", place).filter(F.col("place") <= TRAIN_PER_LANGUAGE).select("doc_id", "lang").distinct(), "language")
    small = ids.agg(F.sum(F.length("lang") + 24).alias("n")).first().n or 0

    def draw(batches):
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(packed(batch.column("text")), pa.binary())], names=["doc_id", "lang", "profile"])

    chosen = rows.join(F.broadcast(ids) if small <= BROADCAST_BYTES else ids, ["doc_id", "lang"]).select("doc_id", "lang", "text").mapInArrow(draw, "doc_id long, lang string, profile binary")
    found = sorted(chosen.collect(), key=lambda r: (r.doc_id, bytes(r.profile)))
    return fit_profiles([bytes(r.profile) for r in found], [r.lang for r in found])


def identify_language(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) for each row of docs (doc_id, text), whole texts.

    `und` with score 0 for null texts and texts without a letter. An empty table gives no rows; other columns are
    left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches):
        single_threaded()
        for batch in chunks(batches):
            names, scores = shared.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
