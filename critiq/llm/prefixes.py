"""Prefix trie of conversations from padded matrices of turn ids.

A conversation becomes one binary path, 20 bytes a turn: the first 16 bytes of the turn's SHA-256 and the length of its text.
Equal paths are counted first, so the distinct ones can be cut into sorted ranges (shards) without hot keys. In a shard
the paths are a matrix of turn ids, padded where they end and taken PADDED columns at a time; numpy's lexsort orders it,
and column by column the mask of changes against the row above is OR-accumulated: a node of depth d starts where column d
of that mask is set. Over these starts reduceat sums every depth, deepest first, so subtrees are there when their top is due.

Nodes on the path of a shard's first or last row may go on in the next shard. The shard gives their parts, which
are summed by node; what boundary nodes themselves add to their subtrees runs up the two border paths of each shard, where each
node is counted by one shard, its owner. All other nodes are final in their shard.

The conversations that end at a node are written out, sorted, in chunks per range, and hashed chunk after chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from critiq.llm.shared import saved

#: Columns of a matrix at a time; longer paths go on in further matrices of the rows that still hold turns.
PADDED = 32
#: Turns of distinct paths that a shard should hold, and conversations per range of the ends.
SHARD_TURNS, RANGE_ENDS = 400_000, 400_000
#: Conversation ids per chunk of text to be hashed.
CHUNK_IDS = 50_000
TURN = np.dtype([("high", ">u8"), ("low", ">u8"), ("size", ">u4")])
NO_ENDS = hashlib.sha256(b"").hexdigest()
FINAL = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
SHARD_SCHEMA = ", ".join(f"{c} long" for c in FINAL) + ", ends_sha256 string, shard int, side int, node binary, bytes long, more boolean"


def conversation_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path): each conversation's own turns, from (conv_id, turn, role, text).

    Turns go by number, null first; turns of one number go by the hash of role and text. Null role or text is empty.
    Rows without conv_id are left out.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    said = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    code = F.unhex(F.concat(F.substring(said, 1, 32), F.lpad(F.hex(F.octet_length(text)), 8, "0")))
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", code.alias("code"))
    turn = F.sort_array(F.collect_list(F.struct("turn", "code")))
    return rows.groupBy("conv_id").agg(turn.alias("turns")).select("conv_id", F.transform("turns", lambda t: t["code"]).alias("path"))


def rebuilt(own: DataFrame, group: int = 5, shared: int = 9) -> DataFrame:
    """(conv_id, path binary) of every conversation c after its first h turns were set to those of c - c % group, with
    h = crc32(c as text) % shared: all of them if there are fewer, none without that conversation; own turns after h follow.
    % of a negative number is negative, as in SQL."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % group
    # the conversations of a base meet in one window of `group` short prefixes
    first = F.when(F.col("conv_id") == F.col("base"), F.slice("path", 1, shared - 1))
    rows = own.withColumn("base", base)
    firsts = rows.select("base", first.alias("first")).filter("first IS NOT NULL")
    both = rows.join(firsts, "base", "left").withColumn("h", h)
    path = F.concat(F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.array().cast("array<binary>")), F.slice("path", F.col("h") + 1, F.greatest(F.size("path"), F.lit(1))))
    return both.select("conv_id", F.unhex(F.array_join(F.transform(path, F.hex), "")).alias("path"))


def end_hashes(paths: DataFrame, ranges: int) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the ids of (key, conv_id), ascending and comma-joined, for every key.

    The rows are cut into ranges of (key, conv_id), so a key with very many ids lies in several; of each only chunks of text go on.
    The hash itself is one sequence, so the chunks of one key are read by one task, one after the other.
    """
    schema = "key binary, at long, chunk string"

    def joined(batches):
        for batch in batches:
            keys, ids = batch.column("key"), batch.column("conv_id").to_numpy()
            data = np.array(keys.to_pylist(), "S16")
            starts = np.flatnonzero(np.concatenate(([True], data[1:] != data[:-1])))
            cuts = np.unique(np.concatenate((starts, np.arange(0, len(ids), CHUNK_IDS)))) if len(ids) else starts[:0]
            ends = [*cuts[1:], len(ids)]
            chunks = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, ends, strict=True)] if len(ids) else []
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(cuts)), pa.array(ids[cuts]), pa.array(chunks, pa.string())], ["key", "at", "chunk"])

    def hashed(batches):
        key = digest = None
        for batch in batches:
            keys, found = [], []
            for k, chunk in zip(batch.column("key").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
                if k == key:
                    digest.update(b"," + chunk.encode())
                    continue
                if key is not None:
                    keys.append(key)
                    found.append(digest.hexdigest())
                key, digest = k, hashlib.sha256(chunk.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    chunks = paths.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(joined, schema)
    return chunks.repartition(ranges, "key").sortWithinPartitions("key", "at").mapInArrow(hashed, "key binary, ends_sha256 string")


class Shard:
    """The sorted distinct paths of a shard, as flat turn ids: row i holds ids[at[i]:at[i + 1]]."""

    def __init__(self, paths: pa.Array):
        data = paths.cast(pa.large_binary())
        offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        turns = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(TURN) if offsets[-1] > offsets[0] else np.zeros(0, TURN)
        self.bytes, self.turns = turns["size"].astype(np.int64), turns
        self.at = (offsets - offsets[0]) // TURN.itemsize
        self.length = np.diff(self.at)
        high, low = turns["high"].astype(np.uint64), turns["low"].astype(np.uint64)
        order = np.lexsort((low, high))
        new = np.zeros(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        self.ids = np.empty(len(order), np.int64)
        self.ids[order] = np.cumsum(new)
        self.order = self._sorted()
        self.same = self._shared_depth()

    def _matrix(self, rows: np.ndarray, first: int) -> np.ndarray:
        """Columns first .. first + PADDED of rows, -1 where a path has ended."""
        width = min(PADDED, int(self.length[rows].max(initial=0)) - first)
        column = first + np.arange(max(width, 0))
        there = column < self.length[rows][:, None]
        place = np.where(there, self.at[rows][:, None] + column, 0)
        return np.where(there, self.ids[place] if len(self.ids) else 0, -1)

    def _sorted(self) -> np.ndarray:
        """The rows in order: by lexsort of one matrix after the other, each over the rows that have got so far."""
        rank = np.zeros(len(self.length), np.int64)
        for first in range(0, int(self.length.max(initial=0)), PADDED):
            rows = np.flatnonzero(self.length > first)
            matrix = self._matrix(rows, first)
            order = np.lexsort((*matrix.T[::-1], rank[rows]))
            change = np.zeros(len(rows), bool)
            change[1:] = (matrix[order][1:] != matrix[order][:-1]).any(1) | (rank[rows][order][1:] != rank[rows][order][:-1])
            place = np.zeros(len(rank), np.int64)  # 0: ended before, so first among those of its rank
            place[rows[order]] = np.cumsum(change) + 1
            rank = np.unique(rank * (len(rows) + 1) + place, return_inverse=True)[1].reshape(-1)
        return np.argsort(rank, kind="stable")

    def _shared_depth(self) -> np.ndarray:
        """Of each row in order, the number of leading turns it shares with the row above."""
        same = np.zeros(len(self.order), np.int64)
        open_rows = np.arange(1, len(self.order))
        for first in range(0, int(self.length.max(initial=0)), PADDED):
            above, here = self.order[open_rows - 1], self.order[open_rows]
            open_rows = open_rows[(self.length[above] > first) & (self.length[here] > first)]
            above, here = self.order[open_rows - 1], self.order[open_rows]
            width = np.minimum(np.minimum(self.length[above], self.length[here]) - first, PADDED)
            a, b = self._matrix(above, first), self._matrix(here, first)
            least = min(a.shape[1], b.shape[1])
            change = np.logical_or.accumulate(a[:, :least] != b[:, :least], axis=1)
            equal = np.minimum((~change).sum(1), width)
            same[open_rows] += equal
            open_rows = open_rows[equal == PADDED]
        return same


def shard_nodes(batch: pa.Table, shard: int) -> Iterator[pa.RecordBatch]:
    """SHARD_SCHEMA's rows of a shard of (path, n, first, ends_sha256): final nodes (node null), boundary nodes, and in
    final nodes below a boundary node, shard and side of that parent instead of parent_conv_id."""
    paths = Shard(batch.column("path").combine_chunks())
    order, same = paths.order, paths.same
    n_rows = len(order)
    length, start = paths.length[order], paths.at[:-1][order]
    n, first = batch.column("n").to_numpy()[order], batch.column("first").to_numpy()[order]
    ends = np.array(batch.column("ends_sha256").to_pylist(), object)[order]
    # a row whose path does not go on below it is a leaf; the shard's first and last row are left to the boundary
    leaf = np.zeros(n_rows, np.int64)
    leaf[1:-1] = same[2:] < length[1:-1]
    own = np.zeros(n_rows, np.int64)  # what nodes of this depth and below, which start at the row, save
    first_path, last_path = _prefix_codes(paths, order[0]), _prefix_codes(paths, order[-1])
    depths: dict[int, dict] = {}
    sorted_by_length = np.argsort(length, kind="stable")
    for depth in range(int(length.max()), -1, -1):
        at = np.sort(sorted_by_length[np.searchsorted(length[sorted_by_length], depth) :])  # rows that reach this depth
        opens = same[at] < depth
        opens[0] = True if depth == 0 else opens[0]
        if depth == 0:
            opens[1:] = False
        starts = np.flatnonzero(opens)
        top, last = at[starts], at[np.append(starts[1:], len(at)) - 1]
        count = np.add.reduceat(n[at], starts)
        size = paths.bytes[start[top] + depth - 1] if depth else np.zeros(1, np.int64)
        on_first, on_last = top == 0, last == n_rows - 1
        inside = ~(on_first | on_last)
        child = (same[at] < depth + 1) & (length[at] > depth)
        child_inside = child.copy()
        below = depths.get(depth + 1)
        if below is not None:  # children on the border paths are counted there
            child_inside &= ~np.isin(at, below["top"][~below["inside"]])
        own[top[inside]] += (count[inside] - 1) * size[inside]
        depths[depth] = {
            "top": top, "inside": inside, "on_first": on_first, "on_last": on_last, "n": count, "conv": np.minimum.reduceat(first[at], starts), "size": size,
            "children": np.add.reduceat(child_inside.astype(np.int64), starts), "leaves": np.add.reduceat(leaf[at], starts), "saved": np.add.reduceat(own[at], starts),
            "ends": np.where(length[top] == depth, ends[top], None),
        }
    for depth, d in depths.items():
        inside = np.flatnonzero(d["inside"])
        if depth and len(inside):
            up = depths[depth - 1]
            parent = np.searchsorted(up["top"], d["top"][inside], "right") - 1
            final = up["inside"][parent]
            side = np.where(up["on_first"][parent], 0, 1)
            yield _rows(d, inside, depth, shard, np.where(final, up["conv"][parent], 0), ~final, side)
        for side, kind in enumerate(("on_first", "on_last")):
            for i in np.flatnonzero(d[kind]):
                code = (first_path if side == 0 else last_path)[depth]
                counted = side == 0 or not d["on_first"][i]  # a node of both paths is counted on the first
                more = depth + 1 < len(first_path if side == 0 else last_path)
                yield _boundary(d, i, depth, shard, side, code, counted, more)


def _prefix_codes(paths: Shard, row: int) -> list[bytes]:
    """A code of every prefix of the row's path, from the empty one on."""
    data, digest = paths.turns[paths.at[row] : paths.at[row + 1]].tobytes(), hashlib.sha256()
    codes = [digest.digest()[:16]]
    for i in range(0, len(data), TURN.itemsize):
        digest.update(data[i : i + TURN.itemsize])
        codes.append(digest.copy().digest()[:16])
    return codes


def _batch(columns: list) -> pa.RecordBatch:
    names = [*FINAL, "ends_sha256", "shard", "side", "node", "bytes", "more"]
    kinds = [*[pa.int64()] * len(FINAL), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip(columns, kinds, strict=True)], names)


def _rows(d: dict, at: np.ndarray, depth: int, shard: int, parent: np.ndarray, apart: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
    k = len(at)
    ends = [NO_ENDS if x is None else x for x in d["ends"][at]]
    where = pa.array(np.where(apart, shard, 0).astype(np.int32), mask=~apart), pa.array(side.astype(np.int32), mask=~apart)
    return _batch([d["conv"][at], np.full(k, depth), pa.array(parent, mask=apart), d["n"][at], d["children"][at], d["leaves"][at], d["saved"][at], ends, *where, pa.nulls(k, pa.binary()), d["size"][at], pa.nulls(k, pa.bool_())])


def _boundary(d: dict, i: int, depth: int, shard: int, side: int, code: bytes, counted: bool, more: bool) -> pa.RecordBatch:
    counts = [int(d[c][i]) if counted else 0 for c in ("n", "children", "leaves", "saved")]
    conv = int(d["conv"][i]) if counted else None
    return _batch([[conv], [depth], [None], *[[c] for c in counts], [d["ends"][i] if counted else None], [shard], [side], [code], [int(d["size"][i])], [more]])


def conversation_trie(paths: DataFrame) -> DataFrame:
    """A row per node of the trie of (conv_id, path): FINAL and ends_sha256.

    Every conversation is a member of the root (depth 0), one without turns of no other node. Copies of a conversation are
    members of the same nodes. Without conversations there is no node. A task holds a shard, not a node's members.
    """
    spark = paths.sparkSession
    keyed = saved(paths.select("conv_id", "path", F.substring(F.unhex(F.sha2("path", 256)), 1, 16).alias("key")), "paths")
    total = keyed.agg(F.count("*").alias("n"), F.sum(F.octet_length("path")).alias("bytes")).first()
    ranges = 1 + total.n // RANGE_ENDS
    shards = 1 + (total.bytes or 0) // (SHARD_TURNS * TURN.itemsize)
    ends = end_hashes(keyed.select("key", "conv_id"), ranges)
    distinct = keyed.groupBy("path", "key").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))
    distinct = saved(distinct.join(ends, "key").select("path", "n", "first", "ends_sha256"), "distinct_paths")

    def run(batches):
        batches = list(batches)
        if any(len(b) for b in batches):
            yield from shard_nodes(pa.Table.from_batches(batches), TaskContext.get().partitionId())

    found = saved(distinct.repartitionByRange(shards, "path").mapInArrow(run, SHARD_SCHEMA), "nodes")
    border = found.filter("node IS NOT NULL")
    added = border.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in FINAL[3:]], F.max("ends_sha256").alias("ends_sha256"), F.max("bytes").alias("bytes"),
        F.max(F.col("more") | (F.col("n_children") > 0)).alias("inner"), F.min(F.struct("shard", "side")).alias("owner"),
    )
    chain = border.select("node", "depth", "shard", "side").join(added, "node")
    owned = F.col("owner") == F.struct("shard", "side")
    chain = chain.withColumn("owned", owned.cast("long"))
    up = W.partitionBy("shard", "side").orderBy(F.desc("depth"))
    chain = saved(chain.select(
        "node", "depth", "shard", "side", *FINAL[3:], "conv_id", "ends_sha256", F.lead("conv_id").over(up).alias("parent_conv_id"), F.lag("owned", 1, 0).over(up).alias("child"),
        F.sum(F.col("owned") * (F.col("n_convs") - 1) * F.col("bytes")).over(up).alias("saved"), F.sum(F.col("owned") * (~F.col("inner")).cast("long")).over(up).alias("ends"),
    ), "border")
    same = [F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")]
    sums = [(F.max(a) + F.sum(b)).alias(a) for a, b in (("n_children", "child"), ("n_leaves", "ends"), ("saved_tokens", "saved"))]
    top = chain.groupBy("node").agg(*same, *sums, F.coalesce(F.max("ends_sha256"), F.lit(NO_ENDS)).alias("ends_sha256")).drop("node")
    final = found.filter("node IS NULL")
    local = final.filter("shard IS NULL")
    parents = chain.select("shard", "side", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"))
    below = final.filter("shard IS NOT NULL").join(parents, ["shard", "side", "depth"]).withColumn("parent_conv_id", F.col("parent"))
    columns = [*FINAL, "ends_sha256"]
    return top.select(*columns).unionByName(local.select(*columns)).unionByName(below.select(*columns))
