"""Language-model scores from Elias-Fano tries of word pairs.

Texts are cut into chunks of about CHUNK_TEXT bytes. A chunk tells its words and its pairs of neighbouring tokens (context,
word) once each, with their counts in training texts, in the order of 64-bit word hashes, and sends slices of that order to shards:
words by hash range, pairs by sampled ranges of (context, word), so that a frequent context lies in several shards. A shard sums
what all chunks sent, builds its part of the model and answers the chunks: for words (compared as texts) their training counts, for
pairs the code of a probability. Answers come back in the same order, so a chunk needs no keys to use them.

A pair shard is a trie of two levels in one memory map. Contexts, words and the pointers from a context to its successors are
Elias-Fano sequences; successors are word ranks made monotone by adding the last value before their context, so a word is found by
a successor search relative to its context. Beside each successor stands an 8-bit code of its joint probability: counts up to 64
are exact, larger ones fall into 191 steps of equal ratio, all within 4 %. Nothing is pruned; the model grows with the training texts.

The probability of a word is that of its pair, smoothed by MU pseudo-counts of the word's own (base) probability:
(count(context, word) + MU * base(word)) / (count(context) + MU). The context of a text's first token is the end token.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.llm.shared import SPACE, Hasher, chunks, hash_text, saved, utf8, words_of

CHUNK_TEXT = 4 << 20
#: Words, counted once a chunk, that a shard should get.
#: A shard gets at most about so many tokens' pairs, since pairs are counted once a chunk.
SHARD_WORDS, SHARD_TOKENS = 1_000_000, 1_000_000
#: A chunk samples each of so many tokens' pairs for the ranges; the ranges are made of so many samples at most.
SAMPLE_STEP, MOST_SAMPLES = 1 << 15, 200_000
#: Pseudo-counts of the base distribution in every context.
MU = 500.0
#: The end token; no word holds a space.
END = " "
#: A word beside its context is known by the upper 48 bits of its hash.
CUT = np.uint64(0xFFFF_FFFF_FFFF_0000)
_ONE = np.uint64(1)


# Elias-Fano sequences


def _select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit number `rank` (from 0) in each 64-bit word."""
    place, rank = np.zeros(len(words), np.uint64), rank.astype(np.uint64)
    for width in (32, 16, 8, 4, 2, 1):
        low = (words >> place) & np.uint64((1 << width) - 1)
        count = np.bitwise_count(low).astype(np.uint64)
        over = rank >= count
        rank = np.where(over, rank - count, rank)
        place += np.where(over, np.uint64(width), np.uint64(0))
    return place.astype(np.int64)


class EliasFano:
    """A monotone sequence of n values: `width` low bits of each, packed, and the high parts in unary with counts of ones per word.

    The three arrays are views of whatever buffer they were laid into.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """From non-decreasing uint64 values."""
        n = len(values)
        width = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        high = (values >> np.uint64(width)).astype(np.int64)
        bits = np.zeros((int(high[-1]) + n + 64) // 64 * 64 if n else 64, np.uint8)
        bits[high + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high).astype(np.int64))))
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width:
            part, at = values & np.uint64((1 << width) - 1), np.arange(n, dtype=np.uint64) * np.uint64(width)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            spill = np.where(shift > 0, (part >> _ONE) >> (np.uint64(63) - shift), np.uint64(0))
            np.bitwise_or.at(low, word + 1, spill)
        return cls(n, width, low, high, ones)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.low[word] >> shift | np.where(shift > 0, (self.low[word + 1] << _ONE) << (np.uint64(63) - shift), np.uint64(0))
        return value & np.uint64((1 << self.width) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at the places i."""
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _select(self.high[word], i - self.ones[word])
        return (place - i).astype(np.uint64) << np.uint64(self.width) | self._low(i)

    def _bucket(self, high: np.ndarray) -> np.ndarray:
        """How many values have a high part below `high`."""
        zeros = np.arange(len(self.ones)) * 64 - self.ones
        k = high - 1
        inside = (k >= 0) & (k < zeros[-1])
        k = np.where(inside, k, 0)
        word = np.searchsorted(zeros, k, "right") - 1
        place = word * 64 + _select(~self.high[word], k - zeros[word])
        return np.where(inside, place - k, np.where(high <= 0, 0, self.n))

    def successor(self, x: np.ndarray, first: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """For each x the first place at or after `first` whose value is x or more, n if there is none; and whether it is x."""
        high, rest = (x >> np.uint64(self.width)).astype(np.int64), x & np.uint64((1 << self.width) - 1)
        at, stop = np.maximum(self._bucket(high), first), self._bucket(high + 1)
        open_places = np.flatnonzero(at < stop)
        while len(open_places):
            open_places = open_places[self._low(at[open_places]) < rest[open_places]]
            at[open_places] += 1
            open_places = open_places[at[open_places] < stop[open_places]]
        same = at < stop  # else the next value has another high part
        same[same] = self._low(at[same]) == rest[same]
        return at, same

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x, or -1."""
        at, same = self.successor(x)
        return np.where(same, at, -1)


class PairTrie:
    """context -> successors with coded probabilities, from distinct sorted (context, word, count) of hashes."""

    def __init__(self, context: np.ndarray, word: np.ndarray, count: np.ndarray):
        contexts, first = np.unique(context, return_index=True)
        words, rank = np.unique(word, return_inverse=True)
        pointers = np.append(first, len(context)).astype(np.uint64)
        # each context's ranks go on from the last value before it
        sizes = np.diff(pointers.astype(np.int64))
        last = rank[pointers[1:].astype(np.int64) - 1].astype(np.uint64) if len(contexts) else np.zeros(0, np.uint64)
        base = np.concatenate(([0], np.cumsum(last)[:-1])).astype(np.uint64) if len(contexts) else last
        successors = rank.astype(np.uint64) + np.repeat(base, sizes)
        self.contexts, self.words, self.pointers, self.successors = map(EliasFano.of, (contexts, words, pointers, successors))
        self.codes = code_of(count)
        self._map()

    def _map(self) -> None:
        """Lay all arrays out in one memory map and use them from there."""
        levels = (self.contexts, self.words, self.pointers, self.successors)
        arrays = [a for level in levels for a in level.arrays()] + [self.codes]
        room = mmap.mmap(-1, max(1, sum(-(-a.nbytes // 8) * 8 for a in arrays)))
        at, views = 0, []
        for a in arrays:
            view = np.frombuffer(room, a.dtype, len(a), at)
            view[:] = a
            views.append(view)
            at += -(-a.nbytes // 8) * 8
        for level, low, high, ones in zip(levels, views[:-1:3], views[1:-1:3], views[2:-1:3], strict=True):
            level.low, level.high, level.ones = low, high, ones
        self.codes, self.bytes = views[-1], at

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of each (context, word), 0 where the trie has none. Contexts and words are looked up once each."""
        out = np.zeros(len(context), np.uint8)
        contexts, which = np.unique(context, return_inverse=True)
        words, word = np.unique(word, return_inverse=True)
        c, w = self.contexts.find(contexts), self.words.find(words)
        first, end, base = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64), np.zeros(len(c), np.uint64)
        known = np.flatnonzero(c >= 0)
        first[known], end[known] = self.pointers[c[known]].astype(np.int64), self.pointers[c[known] + 1].astype(np.int64)
        later = np.flatnonzero(first > 0)
        base[later] = self.successors[first[later] - 1]
        asked = np.flatnonzero((c[which] >= 0) & (w[word] >= 0))
        which = which[asked]
        at, same = self.successors.successor(base[which] + w[word[asked]].astype(np.uint64), first[which])
        there = np.flatnonzero(same & (at < end[which]))
        out[asked[there]] = self.codes[at[there]]
        return out


#: Fixed values of the code: counts up to EXACT are their own codes, the other codes are steps of one ratio up to LARGEST.
EXACT, LARGEST = 64, 1e9
_STEP = (np.log(LARGEST) - np.log(EXACT)) / (255 - EXACT)


def code_of(count: np.ndarray) -> np.ndarray:
    """An 8-bit code of a count of one or more."""
    steps = np.rint((np.log(np.maximum(count, 1)) - np.log(EXACT)) / _STEP)
    return np.where(count <= EXACT, count, np.clip(EXACT + steps, EXACT, 255)).astype(np.uint8)


def codebook() -> np.ndarray:
    """The count that each code stands for; 0 is no pair. Divided by all tokens, it is the pair's joint probability."""
    codes = np.arange(256)
    return np.where(codes <= EXACT, codes, EXACT * np.exp(_STEP * (codes - EXACT)))


# Chunks


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays end to end, each as its length, its item size and its bytes by place of value, compressed."""
    parts = []
    for a in arrays:
        parts += [np.array([len(a), a.itemsize], np.int64).tobytes(), np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()]
    data = b"".join(parts)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def _unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    data = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    out, at = [], 0
    for kind in kinds:
        n, size = np.frombuffer(data, np.int64, 2, at)
        planes = np.frombuffer(data, np.uint8, n * size, at + 16).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"u{size}").reshape(-1).astype(kind, copy=False))
        at += 16 + n * size
    return out


def _least(a: np.ndarray) -> np.ndarray:
    """Unsigned integers in as few bytes as they need."""
    most = int(a.max(initial=0))
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


class Tokens:
    """A chunk's tokens as word numbers in the order of hashes, and its distinct pairs (context, word) in that order."""

    def __init__(self, number: np.ndarray, n_tokens: np.ndarray, end: int, n_words: int):
        first = np.cumsum(n_tokens) - n_tokens
        context = np.empty(len(number), np.int64)
        context[1:] = number[:-1]
        context[first] = end
        self.number, self.context = number, context
        self.code, self.pair = np.unique(context * n_words + number, return_inverse=True)
        self.a, self.b = self.code // max(n_words, 1), self.code % max(n_words, 1)


CHUNK_SCHEMA = "chunk long, doc_ids array<long>, tokens binary, words binary, n_words long, n_tokens long, n_train long, sample array<struct<a:long,b:long>>"


def _read_chunk(batch: pa.RecordBatch, chunk: int) -> pa.RecordBatch:
    data, offsets = utf8(batch.column("text"))
    train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
    starts, ends, doc = words_of(data, offsets, SPACE)
    n_tokens = np.bincount(doc, minlength=len(train)).astype(np.int64) + 1
    hashes = np.empty(len(starts) + len(train), np.uint64)
    is_end = np.zeros(len(hashes), bool)
    is_end[np.cumsum(n_tokens) - 1] = True
    hashes[is_end], hashes[~is_end] = hash_text(END), Hasher(data)(starts, ends)
    distinct, where, number = np.unique(hashes, return_index=True, return_inverse=True)
    learnt = np.repeat(train, n_tokens)
    place = np.cumsum(~is_end) - 1
    raw = data.tobytes()
    words = [END.encode() if is_end[i] else raw[starts[place[i]] : ends[place[i]]] for i in where]
    text = np.frombuffer(b"".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    counts = np.bincount(number[learnt], minlength=len(distinct))
    end = int(np.searchsorted(distinct, np.uint64(hash_text(END))))
    # frequent words get small numbers, which pack well
    rank = np.empty(len(distinct), np.int64)
    rank[np.argsort(-np.bincount(number, minlength=len(distinct)), kind="stable")] = np.arange(len(distinct))
    picks = np.arange(chunk * 7919 % SAMPLE_STEP, len(number), SAMPLE_STEP)
    pairs = distinct[np.where(is_end[picks - 1], end, number[picks - 1])], distinct[number[picks]] & CUT
    sample = [{"a": a, "b": b} for a, b in zip(pairs[0].view(np.int64).tolist(), pairs[1].view(np.int64).tolist(), strict=True)]
    tokens = _packed(_least(rank[number]), _least(n_tokens), train.astype(np.uint8), _least(rank), np.array([end]))
    columns = {
        "chunk": [chunk], "doc_ids": [batch.column("doc_id").to_pylist()], "tokens": [tokens], "words": [_packed(_least(size), text, _least(counts))],
        "n_words": [len(distinct)], "n_tokens": [len(number)], "n_train": [int(learnt.sum())], "sample": [sample],
    }
    kinds = {"doc_ids": pa.list_(pa.int64()), "tokens": pa.binary(), "words": pa.binary(), "sample": pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()], list(columns))


def _restored(blob: bytes) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """The chunk's tokens, and for each text their number and whether it is learnt from."""
    ranked, n_tokens, train, rank, end = _unpacked(blob, np.int64, np.int64, np.uint8, np.int64, np.int64)
    order = np.empty(len(rank), np.int64)
    order[rank] = np.arange(len(rank))
    return Tokens(order[ranked], n_tokens, int(end[0]), len(rank)), n_tokens, train.astype(bool)


def _cuts(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Where in the pairs (a, b), sorted, each of the bounds would stand."""
    out = np.empty(len(bounds), np.int64)
    for i, (x, y) in enumerate(bounds):
        first, last = np.searchsorted(a, np.uint64(x), "left"), np.searchsorted(a, np.uint64(x), "right")
        out[i] = first + np.searchsorted(b[first:last], np.uint64(y), "left")
    return out


# Shards


def _ask(batch: pa.RecordBatch, bounds: list[tuple[int, int]], word_shards: int) -> Iterator[tuple]:
    """(kind, shard, chunk, blob): the slices of each chunk's words (kind 0) and pairs (kind 1)."""
    for row in batch.to_pylist():
        size, text, counts = _unpacked(row["words"], np.int64, np.uint8, np.int64)
        at = np.concatenate(([0], np.cumsum(size)))
        hashes = Hasher(text)(at[:-1], at[1:])
        edges = np.array([(s << 64) // word_shards for s in range(1, word_shards)], np.uint64)
        cuts = np.concatenate(([0], np.searchsorted(hashes, edges), [len(hashes)]))
        for shard in np.flatnonzero(np.diff(cuts)):
            i, j = cuts[shard], cuts[shard + 1]
            yield 0, int(shard), row["chunk"], _packed(_least(size[i:j]), text[at[i] : at[j]], _least(counts[i:j]))
        tokens, n_tokens, train = _restored(row["tokens"])
        learnt = np.bincount(tokens.pair[np.repeat(train, n_tokens)], minlength=len(tokens.a))
        a, b = hashes[tokens.a], hashes[tokens.b] & CUT
        cuts = np.concatenate(([0], _cuts(a, b, bounds), [len(a)]))
        for shard in np.flatnonzero(np.diff(cuts)):
            i, j = cuts[shard], cuts[shard + 1]
            first = np.flatnonzero(np.concatenate(([True], a[i + 1 : j] != a[i : j - 1])))
            yield 1, int(shard), row["chunk"], _packed(a[i:j][first], _least(np.diff(np.append(first, j - i))), b[i:j], _least(learnt[i:j]))


def _answer_words(blobs: list[bytes]) -> tuple[list[bytes], int]:
    """For each blob the training count of every word; and how many words have one."""
    parts = [_unpacked(b, np.int64, np.uint8, np.int64) for b in blobs]
    lengths = np.concatenate([p[0] for p in parts])
    text = np.concatenate([p[1] for p in parts])
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text)])
    number = pc.dictionary_encode(words).indices.to_numpy()
    total = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
    np.add.at(total, number, np.concatenate([p[2] for p in parts]))
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    return [_packed(_least(x)) for x in np.split(total[number], cuts)], int((total > 0).sum())


def _answer_pairs(blobs: list[bytes]) -> tuple[list[bytes], int]:
    """For each blob the code of every pair, from a trie of all pairs with a training count; and the trie's bytes."""
    parts = [_unpacked(b, np.uint64, np.int64, np.uint64, np.int64) for b in blobs]
    a = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
    b, count = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    first = np.flatnonzero(new)
    x, y, total = a[order[first]], b[order[first]], np.add.reduceat(count[order], first)
    seen = total > 0
    trie = PairTrie(x[seen], y[seen], total[seen])
    codes = np.empty(len(order), np.uint8)
    codes[order] = trie.find(x, y)[np.cumsum(new) - 1]  # asked in order, and once for all chunks
    cuts = np.cumsum([len(p[2]) for p in parts])[:-1]
    return [_packed(c) for c in np.split(codes, cuts)], trie.bytes


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, list[int], list[bytes]]]:
    """The sorted rows of (kind, shard, chunk, blob), gathered by kind and shard."""
    key, ids, blobs = None, [], []
    for batch in batches:
        for kind, shard, chunk, blob in zip(*[batch.column(c).to_pylist() for c in ("kind", "shard", "chunk", "blob")], strict=True):
            if (kind, shard) != key:
                if blobs:
                    yield *key, ids, blobs
                key, ids, blobs = (kind, shard), [], []
            ids.append(chunk)
            blobs.append(blob)
    if blobs:
        yield *key, ids, blobs


ASKED = "kind int, shard int, chunk long, blob binary"


def _batch_of(rows: list[tuple], size: bool = False) -> pa.RecordBatch:
    names = ["kind", "shard", "chunk", "blob", *["size"] * size]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)


def score_texts(docs: DataFrame, train: Column, mu: float = MU) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) of every row of (doc_id, text), learnt from those where `train` is true.

    A-Z in lower case; tokens are the words and one end. base_score sums log10((c + 0.5) / (N + 0.5 * (V + 1))) over the tokens,
    score the log10 probabilities of the pairs' model. Null and empty texts are one end token. Rows that repeat a doc_id are
    texts of their own, and count each; a null `train` is false. Other columns are left out. Without training texts N and V are
    0 and all tokens alike. An empty table gives no rows. Words are told apart by 64-bit hashes in a chunk and in pairs, as texts in counts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))

    def read(batches):
        n = 0
        for batch in chunks(batches, limit=CHUNK_TEXT):
            if len(batch):
                yield _read_chunk(batch, (TaskContext.get().partitionId() << 32) + n)
                n += 1

    kept = saved(rows.mapInArrow(read, CHUNK_SCHEMA), "chunks")
    total = kept.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_tokens", "n_train")], F.coalesce(F.sum(F.size("sample")), F.lit(0)).alias("samples")).first()
    word_shards, pair_shards = (1 + total.n_words // SHARD_WORDS, 1 + total.n_tokens // SHARD_TOKENS)
    some = kept.select(F.inline("sample")).filter(F.pmod(F.xxhash64("a", "b"), F.lit(1 + total.samples // MOST_SAMPLES)) == 0).collect()  # MOST_SAMPLES or so
    some = sorted((a % (1 << 64), b % (1 << 64)) for a, b in some)
    bounds = sorted({some[len(some) * i // pair_shards] for i in range(1, pair_shards)} if some else [])

    def ask(batches):
        for batch in batches:
            for i in range(len(batch)):
                if asked := list(_ask(batch.slice(i, 1), bounds, word_shards)):
                    yield _batch_of(asked)

    def answer(batches):
        for kind, shard, ids, blobs in _groups(batches):
            found, size = (_answer_pairs if kind else _answer_words)(blobs)
            sizes = [size] + [0] * (len(ids) - 1)
            yield _batch_of([(kind, shard, i, x, s) for i, x, s in zip(ids, found, sizes, strict=True)], size=True)

    parts = word_shards + len(bounds) + 1
    asked = kept.select("tokens", "words", "chunk").mapInArrow(ask, ASKED)
    answers = saved(asked.repartition(parts, "kind", "shard").sortWithinPartitions("kind", "shard", "chunk").mapInArrow(answer, ASKED + ", size long"), "answers")
    distinct = answers.agg(F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("size"))), F.lit(0)).alias("v")).first().v
    n_train, space = total.n_train, total.n_train + 0.5 * (distinct + 1)

    def score(batches):
        for chunk in _chunks_with_answers(batches):
            yield _score_chunk(*chunk, n_train, space, mu)

    whole = kept.select("chunk", F.lit(-1).alias("kind"), F.lit(0).alias("shard"), F.col("tokens").alias("blob"), "doc_ids")
    back = answers.select("chunk", "kind", "shard", "blob", F.array().cast("array<long>").alias("doc_ids"))
    n_parts = 1 + total.n_tokens // SHARD_TOKENS
    both = whole.unionByName(back).repartition(n_parts, "chunk").sortWithinPartitions("chunk", "kind", "shard")
    return both.mapInArrow(score, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _chunks_with_answers(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_ids, tokens, word answers, pair answers) of each chunk from the sorted rows."""
    now = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == -1:
                if now:
                    yield now
                now = (row["doc_ids"], row["blob"], [], [])
            else:
                now[2 + row["kind"]].append(row["blob"])
    if now:
        yield now


def _score_chunk(doc_ids: list, tokens: bytes, counts: list[bytes], codes: list[bytes], n_train: int, space: float, mu: float) -> pa.RecordBatch:
    chunk, n_tokens, train = _restored(tokens)
    count = np.concatenate([_unpacked(b, np.int64)[0] for b in counts])
    code = np.concatenate([_unpacked(b, np.uint8)[0] for b in codes])
    base = (count + 0.5) / space
    pair = np.log10((codebook()[code] + mu * base[chunk.b]) / (count[chunk.a] + mu))
    first = np.cumsum(n_tokens) - n_tokens
    sums = [np.add.reduceat(x[i], first) for x, i in (((count > 0).astype(np.int64), chunk.number), (np.log10(base), chunk.number), (pair, chunk.pair))]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    columns = [doc_ids, train, n_tokens, sums[0], np.full(len(train), n_train), sums[1], sums[2]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
