"""Token-ID / binary output: documents as Parquet list columns of token ids, for selective reads.

One file per id range, files and rows in ascending doc_id order. Each row holds doc_id, its file's number `part`,
`part_start` (ids of the earlier rows of the same file), n_tokens and the list `ids`. Ids are delta-packed (or
dictionary-coded), row groups and pages have set sizes, and Parquet's page indexes let a reader of a few documents
skip the other pages; a reader of the metadata columns never touches `ids`.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critiq.llm.shared import CHUNK_BYTES, chunks, run_dir, single_threaded, utf8

#: Units whose ids a Python worker remembers; when there are more, the half not used for longest goes.
REMEMBERED = 400_000
#: Units that the library encodes as one text, a line feed behind each.
TOGETHER = 200
#: A space between other white space, or at the end behind it: there the library joins what a cut before it parts.
_WHITE = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_UNEVEN = rf"[{_WHITE}] (?:[{_WHITE}]|$)"
_BARE = rf"^ ?[^{_WHITE}\x{{1C}}-\x{{1F}}]+$"
#: Kinds of bytes: Latin letters (U+00C0 to U+02BF but for two signs, as pairs of bytes), other visible ASCII but the
#: apostrophe (it may begin a piece of letters), line feed, space, rest. A sum of two kinds tells which two they are.
_LETTER, _SYMBOL, _FEED, _SPACE, _REST = 1, 2, 16, 128, 64
_KIND = np.full(256, _REST, np.uint8)
_KIND[0x21:0x7F] = _SYMBOL
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0xC3:0xCA] = _LETTER
_KIND[[0x27, 0x0A, 0x20]] = _REST, _FEED, _SPACE
FILE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("part_start", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
])


def units_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the units of texts begin that hold no space between other white space: no piece reaches over these places.

    Before each space, between Latin letters and symbols, and on both sides of a line feed that stands alone.
    """
    kind = _KIND[data]
    lead = np.flatnonzero((data >= 0xC3) & (data < 0xCA))
    kind[lead + 1] = _LETTER
    signs = lead[(data[lead] == 0xC3) & ((data[lead + 1] & 0xDF) == 0x97)]
    kind[signs] = kind[signs + 1] = _REST
    begins = kind == _SPACE
    both = kind[:-1] + kind[1:]
    begins[1:] |= both == _LETTER + _SYMBOL
    by_feed = np.flatnonzero((both == _LETTER + _FEED) | (both == _SYMBOL + _FEED)) + 1
    ahead = kind[np.maximum(by_feed - 2, 0)]
    begins[by_feed[(kind[by_feed] == _FEED) | (ahead == _LETTER) | (ahead == _SYMBOL)]] = True
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begins)


class Memory:
    """The ids of units: `rows` numbers the units, `ids[begin:begin + size]` are a row's."""

    def __init__(self, encode, most: int = REMEMBERED):
        self.encode, self.most, self.now = encode, most, 0
        self.rows: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.begin, self.size, self.used = (np.zeros(0, np.int64) for _ in range(3))

    def __call__(self, units: pa.Array) -> np.ndarray:
        """The rows of distinct units, new ones encoded."""
        self.now += 1
        if len(self.rows) > self.most:
            keep = np.sort(np.argsort(-self.used, kind="stable")[: self.most // 2])
            names = np.array(list(self.rows), object)[keep]
            at = np.repeat(self.begin[keep] - np.cumsum(self.size[keep]) + self.size[keep], self.size[keep]) + np.arange(self.size[keep].sum())
            self.ids, self.size, self.used = self.ids[at], self.size[keep], self.used[keep]
            self.begin = np.cumsum(self.size) - self.size
            self.rows = dict(zip(names.tolist(), range(len(names)), strict=True))
        names = units.to_numpy(zero_copy_only=False)
        row = np.fromiter(map(self.rows.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(row < 0)
        if len(new):
            bare = pc.match_substring_regex(units, _BARE).to_numpy(zero_copy_only=False)[new]
            new = np.concatenate((new[bare], new[~bare]))
            ids, size = self.encode(names[new].tolist(), int(bare.sum()))
            row[new] = len(self.rows) + np.arange(len(new))
            self.rows.update(zip(names[new].tolist(), row[new].tolist(), strict=True))
            self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(size) - size))
            self.ids, self.size = np.concatenate((self.ids, ids)), np.concatenate((self.size, size))
            self.used = np.concatenate((self.used, np.zeros(len(new), np.int64)))
        self.used[row] = self.now
        return row


class Encoder:
    """Ids of whole texts by the tokenizers library, add_special_tokens=False; what was encoded before comes from memory.

    Where pieces are of bytes, by the library's own rule and without a normalizer, texts are cut into units (units_of) and the
    library encodes each distinct unit once. Texts that hold one of the tokenizer's added tokens, or a space between other
    white space, and all texts where the tokenizer file is of another make, go to the library whole.
    """

    def __init__(self, path: str):
        single_threaded()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        made = json.loads(self.library.to_str())
        pieces = made["pre_tokenizer"] or {}
        self.cuts = (
            made["normalizer"] is None and made["truncation"] is None and made["padding"] is None and made["model"]["type"] == "BPE" and made["model"].get("dropout") is None
            and pieces.get("type") == "ByteLevel" and pieces.get("use_regex") is True and not pieces.get("add_prefix_space")
        )
        self.added = "|".join(re.escape(t["content"]) for t in made["added_tokens"])
        self.feed = self.library.encode("\n", add_special_tokens=False).ids
        self.memory = Memory(self.encode_units)

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, end to end, and how many each has."""
        found = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size

    def encode_units(self, units: list[str], bare: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for units; the first `bare` hold no white space but a space in front, so a line feed parts them."""
        ids, size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i in range(0, bare, TOGETHER * 50):
            some = units[i : min(i + TOGETHER * 50, bare)]
            joined, _ = self.encode_texts(["\n".join(some[j : j + TOGETHER]) + "\n" for j in range(0, len(some), TOGETHER)])
            feeds = np.flatnonzero(joined == self.feed[0]) if len(self.feed) == 1 else []
            if len(feeds) == len(some):
                ids.append(np.delete(joined, feeds))
                size.append(np.diff(feeds, prepend=-1) - 1)
            else:  # a line feed is no id of its own here
                for to, x in zip((ids, size), self.encode_texts(some), strict=True):
                    to.append(x)
        for to, x in zip((ids, size), self.encode_texts(units[bare:]), strict=True):
            to.append(x)
        return np.concatenate(ids), np.concatenate(size)

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), each text's followed by end_id, and the n + 1 offsets."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        whole = np.full(n, not self.cuts)
        if self.cuts:
            for pattern in filter(None, (_UNEVEN, self.added)):
                whole |= pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
        data, offsets = utf8(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts, lower=False)
        begins = units_of(data, offsets) if len(data) else np.zeros(0, np.int64)
        units = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data)).astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        row = self.memory(units.dictionary)
        # entries: the block's distinct units, the end, the whole texts
        more, more_size = self.encode_texts([texts[int(i)].as_py() for i in np.flatnonzero(whole)])
        all_ids = np.concatenate((self.memory.ids, [end_id], more)).astype(np.int32)
        length = np.concatenate((self.memory.size[row], [1], more_size))
        begin = np.concatenate((self.memory.begin[row], len(self.memory.ids) + np.cumsum(np.append(1, more_size)) - np.append(1, more_size)))
        codes = units.indices.to_numpy().astype(np.int64)
        last = np.searchsorted(begins, offsets[1:])
        closing = 1 + whole  # a whole text's own code, then the end
        behind = np.full(closing.sum(), len(row))
        behind[(np.cumsum(closing) - closing)[whole]] = len(row) + 1 + np.arange(whole.sum())
        codes = np.insert(codes, np.repeat(last, closing), behind)
        size = length[codes]
        ends = np.cumsum(size)
        ids = all_ids[np.repeat(begin[codes] - (ends - size), size) + np.arange(ends[-1] if n else 0)]
        return ids, np.concatenate(([0], ends))[np.concatenate(([0], last + np.cumsum(closing)))]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, tokenizer: str, path: str, *, end_id: int = 2, files: int | None = None, coding: str = "delta",
                 row_group_bytes: int = 32 << 20, page_bytes: int = 64 << 10, page_rows: int = 1000) -> None:
    """Write the documents' ids (null text: only the end id) in the format above.

    docs needs doc_id and text; other columns are left out. Rows of equal doc_id all stay, ordered by text; null
    ids come first. An empty table writes no rows. `coding` is "delta" or "dictionary".
    """
    if coding not in ("delta", "dictionary"):
        raise ValueError(f"unknown coding: {coding}")
    files = files or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def encode(batches):
        from pyspark import TaskContext

        encoder, part, total = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in chunks(batches, limit=4 * CHUNK_BYTES):
            values, offsets = encoder(batch.column("text"), end_id)
            n = np.diff(offsets)
            before = total + offsets[:-1]
            total += int(offsets[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(before), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))],
                names=FILE_SCHEMA.names,
            )

    (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange(files, "doc_id")  # by the id alone: what Spark samples for the ranges goes to the driver
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, FILE_SCHEMA)
        .write.option("parquet.enable.dictionary", str(coding == "dictionary").lower())
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark, path: str, columns: list[str] | None = None) -> DataFrame:
    """The written rows with `start`, the ids of all documents before each. Only the named columns are read."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    # one row per file: the table of files, not of documents, gets the running sum
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = rows.groupBy("part").agg(F.sum("n_tokens").alias("held")).select("part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    full = rows.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("part_start"))
    return full.select(*(columns or ["doc_id", "start", "n_tokens", "ids"]))


@F.arrow_udf(T.LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """Unsigned crc32 of each list of ids as little-endian unsigned 32-bit integers."""
    flat = np.ascontiguousarray(ids.values.to_numpy(), "<i4").view(np.uint8)
    at = (ids.offsets.to_numpy().astype(np.int64) * 4).tolist()
    return pa.array([zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())


def token_digest(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write docs' ids under `path` (by default a new folder in run_dir) and return what the files say of each document."""
    path = path or f"{run_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, path, end_id=end_id)
    rows = read_tokens(docs.sparkSession, path)
    return rows.select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), ids_crc32("ids").alias("ids_crc32"))
