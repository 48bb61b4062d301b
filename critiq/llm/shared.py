"""Helpers the operators share: saved tables, bounded samples, Arrow batches of text."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from critiq.sources.scratch import drop_saved, run_dir, saved, shared_dir  # noqa: F401

#: Documents read by one numpy step hold about this many bytes of text, whatever the Arrow batch holds.
CHUNK_BYTES = 1 << 20
#: Bytes of `[\x20\x09-\x0D]`, the white space of the word definitions.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, of: int) -> Column:
    """crc32 of the id written as text, modulo `of`."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % of


def lowest(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The n rows with the lowest hash of `key`: the same rows on every run and partitioning.

    df should hold little more than the key, since each task sends its n lowest rows.
    """
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(n)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that `column` holds about `limit` bytes in each; one longer text stands alone."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(size):
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def utf8(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end (null: empty), A-Z in lower case if asked, and the n + 1 offsets."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return (_LOWER[data] if lower else data), offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and text number of every run of bytes outside the table `gap`."""
    inside = ~gap[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first[-1] = True
    before = np.concatenate(([False], inside[:-1]))[: len(inside)]
    after = np.concatenate((inside[1:], [False]))[: len(inside)]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """64-bit hashes of any spans of a byte array, from one running sum: span hashes cost the same at any length."""

    base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    up = down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        if len(Hasher.up) < len(data) + 1:
            n = max(len(data) + 1, CHUNK_BYTES + (CHUNK_BYTES >> 2))
            for name, step in (("up", self.base), ("down", self.inverse)):
                powers = np.full(n, step)
                powers[0] = 1
                setattr(Hasher, name, np.multiply.accumulate(powers))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Hasher.up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * Hasher.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def hash_text(text: str) -> int:
    """Hasher's value of a whole text."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(Hasher(data)(np.zeros(1, np.int64), np.array([len(data)]))[0])


def code_points(data: np.ndarray) -> np.ndarray:
    """At each byte (and past the last), the code points that began before it."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


def single_threaded() -> None:
    """Native libraries stay on the task's own core."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
