"""Secret scans: fixed patterns, and a character convolutional network over every candidate in its surroundings.

Candidates are whole runs of 8 and more token characters that hold a digit, one of + / _ = or a capital behind a small
letter. The network sees a window of at most ROOM characters of a candidate, with CONTEXT characters on either side; a
longer candidate has overlapping windows over all of it, of which the best counts. Two embeddings per character (what it
is, and whether it belongs to the window), one convolution, max and mean pooling over the window and over the
surroundings, one hidden layer. It learns from all labelled findings, once more with the surroundings blanked so that it
knows secrets by their own shape too; tasks learn from shares of them and their parameters are averaged after each pass. Its outputs are calibrated on one held-out part of the findings. The threshold
recalls RECALL of the secrets of another held-out part: it lies midway between the quantile that does and the next
lower score of any other finding there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.shared import chunks, code_points, saved, single_threaded, utf8, words_of
from critiq.operators.ranking import value_ranks

# The base patterns, in the order in which kinds are listed, and the least lengths.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "model")
_ASSIGN, _ACCESS = re.compile(ASSIGN), re.compile(ACCESS)
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # a run of hex digits of the least length, from where it begins
_ASSIGN_HINT = re.compile(r"[:=]")
#: Where a text can hold an assignment at all; letters that fold to others make it wider only.
_ASSIGN_HEAD = r"""(?i:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]"""

CONTEXT, ROOM = 24, 48
WIDTH = ROOM + 2 * CONTEXT
#: Windows of a long candidate begin so far apart.
STRIDE = 24
LEAST_CANDIDATE = 8
EMBED, FILTERS, KERNEL, HIDDEN = 12, 32, 5, 24
#: Passes over all findings, and findings that a task learns from at a time.
EPOCHS, SHARE = 10, 4096
#: Findings of a document, where a caller bounds them by documents.
TRAIN_WINDOWS = 20
RECALL = 0.99
#: Windows that the network sees at once.
BATCH = 256
_OTHER, _SIZE = 0x60, 0x61
_CODE = np.full(256, _OTHER, np.int64)
_CODE[0x20:0x7F] = np.arange(1, 0x60)
_NO_TOKEN = np.ones(256, bool)
_NO_TOKEN[np.frombuffer(b"+/_=-", np.uint8)] = _NO_TOKEN[0x30:0x3A] = _NO_TOKEN[0x41:0x5B] = _NO_TOKEN[0x61:0x7B] = False
_MARK = np.zeros(256, bool)
_MARK[np.frombuffer(b"0123456789+/_=", np.uint8)] = True
_NO_HEX = np.ones(256, bool)
_NO_HEX[0x30:0x3A] = _NO_HEX[0x61:0x67] = False


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns' matches, leftmost and non-overlapping within each kind."""
    found = []
    if _ASSIGN_HINT.search(text):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(found)


@dataclass
class Block:
    """Some texts as characters end to end (all but ASCII alike), their base spans and their candidates."""

    chars: np.ndarray
    offsets: np.ndarray
    base: list[list[tuple[int, int, int]]]
    doc: np.ndarray  # of each candidate, with its places in `chars`
    starts: np.ndarray
    ends: np.ndarray

    def overlapped(self) -> np.ndarray:
        """For each candidate whether a base span of its text overlaps it."""
        spans = np.array([(self.offsets[i] + a, self.offsets[i] + b) for i, found in enumerate(self.base) for a, b, _ in found], np.int64).reshape(-1, 2)
        if not len(spans):
            return np.zeros(len(self.doc), bool)
        reach = np.maximum.accumulate(spans[:, 1])  # spans come by start
        before = np.searchsorted(spans[:, 0], self.ends) - 1
        return (before >= 0) & (reach[np.maximum(before, 0)] > self.starts)


def block_of(column: pa.Array) -> Block:
    """The texts of a column, null as empty."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    data, offsets = utf8(texts, lower=False)
    offsets = code_points(data)[offsets]
    chars = data[(data & 0xC0) != 0x80]
    n = len(texts)
    starts, ends, doc = words_of(chars, offsets, _NO_HEX)
    some = np.bincount(doc[ends - starts >= 32], minlength=n) > 0
    some |= pc.match_substring(texts, "AKIA").to_numpy(zero_copy_only=False) | pc.match_substring_regex(texts, _ASSIGN_HEAD).to_numpy(zero_copy_only=False)
    base: list[list] = [[] for _ in range(n)]
    for i in np.flatnonzero(some):
        base[i] = base_spans(texts[int(i)].as_py())
    starts, ends, doc = words_of(chars, offsets, _NO_TOKEN)
    long = ends - starts >= LEAST_CANDIDATE
    starts, ends, doc = starts[long], ends[long], doc[long]
    told = _MARK[chars]
    told[1:] |= (chars[1:] >= 0x41) & (chars[1:] < 0x5B) & (chars[:-1] >= 0x61) & (chars[:-1] < 0x7B)
    upto = np.concatenate(([0], np.cumsum(told)))
    use = (upto[ends] - upto[np.minimum(starts + 1, ends)] > 0) | _MARK[chars[starts]] if len(starts) else np.zeros(0, bool)
    return Block(chars, offsets, base, doc[use], starts[use], ends[use])


def windows(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate number, start and end of each window: ROOM characters at most, over all of a candidate."""
    size = ends - starts
    count = 1 + np.maximum(0, -(-(size - ROOM) // STRIDE))
    of = np.repeat(np.arange(len(starts)), count)
    step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.minimum(starts[of] + step * STRIDE, np.maximum(ends[of] - ROOM, starts[of]))
    return of, begin, np.minimum(begin + ROOM, ends[of])


def encode(chars: np.ndarray, low: np.ndarray, high: np.ndarray, starts: np.ndarray, ends: np.ndarray, blank: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A row of WIDTH character codes around and in each window, and 1 where they belong to it; its text is chars[low:high]."""
    at = starts[:, None] - CONTEXT + np.arange(WIDTH)
    own = (at >= starts[:, None]) & (at < ends[:, None])
    seen = own if blank else (at >= low[:, None]) & (at < np.minimum(high, ends + CONTEXT)[:, None])
    codes = np.where(seen, _CODE[chars[np.clip(at, 0, len(chars) - 1)]], 0) if len(chars) else np.zeros(at.shape, np.int64)
    return codes, own.astype(np.float32)


@dataclass
class Network:
    params: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    def forward(self, codes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.params
        x = np.concatenate((p["embed"][codes], own[..., None] * p["mark"]), 2)
        padded = np.pad(x, ((0, 0), (KERNEL // 2, KERNEL // 2), (0, 0)))
        view = np.lib.stride_tricks.sliding_window_view(padded, KERNEL, axis=1)  # batch, place, channel, tap
        view = view.reshape(*view.shape[:2], -1)
        h = np.maximum(view @ p["filters"] + p["bias"], 0)
        inside, outside = own[..., None], (1 - own)[..., None] * (codes > 0)[..., None]
        top = (h * inside).argmax(1)
        most = np.take_along_axis(h * inside, top[:, None], 1)[:, 0]
        mean = (h * inside).sum(1) / np.maximum(inside.sum(1), 1)
        around_top = (h * outside).argmax(1)
        around = np.take_along_axis(h * outside, around_top[:, None], 1)[:, 0]
        pooled = np.hstack((most, mean, around))
        hidden = np.maximum(pooled @ p["dense"] + p["dense_bias"], 0)
        return hidden @ p["out"] + p["out_bias"][0], (x, view, h, inside, outside, top, around_top, pooled, hidden)

    def step(self, codes: np.ndarray, own: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss."""
        p = self.params
        z, (x, view, h, inside, outside, top, around_top, pooled, hidden) = self.forward(codes, own)
        dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = {"out": hidden.T @ dz, "out_bias": np.array([dz.sum()])}
        dh = np.outer(dz, p["out"]) * (hidden > 0)
        g["dense"], g["dense_bias"] = pooled.T @ dh, dh.sum(0)
        most, mean, around = np.split(dh @ p["dense"].T, 3, axis=1)
        dconv = mean[:, None] * inside / np.maximum(inside.sum(1, keepdims=True), 1)
        rows, channels = np.arange(len(y))[:, None], np.arange(FILTERS)[None]
        np.add.at(dconv, (rows, top, channels), most * np.take_along_axis(inside, top[:, :1, None], 1)[:, 0])
        np.add.at(dconv, (rows, around_top, channels), around * np.take_along_axis(outside, around_top[:, :1, None], 1)[:, 0])
        dconv *= h > 0
        g["filters"] = np.einsum("bpv,bpf->vf", view, dconv, optimize=True)
        g["bias"] = dconv.sum((0, 1))
        dview = (dconv @ p["filters"].T).reshape(*dconv.shape[:2], EMBED + 1, KERNEL)
        dx = np.zeros((len(y), WIDTH + KERNEL - 1, EMBED + 1))
        for k in range(KERNEL):
            dx[:, k : k + WIDTH] += dview[..., k]
        dx = dx[:, KERNEL // 2 : KERNEL // 2 + WIDTH]
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], codes, dx[..., :EMBED])
        g["mark"] = (dx[..., EMBED:] * own[..., None]).sum((0, 1))
        return g

    def probability(self, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        z = np.concatenate([self.forward(codes[i : i + BATCH], own[i : i + BATCH])[0] for i in range(0, len(codes), BATCH)])
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))

    def scores(self, block: Block) -> np.ndarray:
        """Each candidate's best probability over its windows, a bounded number of windows at a time."""
        of, starts, ends = windows(block.starts, block.ends)
        best = np.zeros(len(block.doc))
        for i in range(0, len(of), 16 * BATCH):
            part = slice(i, i + 16 * BATCH)
            doc = block.doc[of[part]]
            np.maximum.at(best, of[part], self.probability(*encode(block.chars, block.offsets[doc], block.offsets[doc + 1], starts[part], ends[part])))
        return best


def encode_findings(findings: list[tuple[str, int, int, int]], blank: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, marks and finding number of the windows of findings (text, start, end, label)."""
    data, offsets = utf8(pa.array([f[0] for f in findings], pa.string()), lower=False)
    low = code_points(data)[offsets]
    of, starts, ends = windows(low[:-1] + np.array([f[1] for f in findings], np.int64), low[:-1] + np.array([f[2] for f in findings], np.int64))
    return *encode(data[(data & 0xC0) != 0x80], low[of], low[of + 1], starts, ends, blank), of


@dataclass
class State:
    """Parameters in training, with the moving means of their gradients and of the squares, and the number of steps."""

    params: dict[str, np.ndarray]
    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]
    t: float = 0.0

    @staticmethod
    def start(rng: np.random.Generator) -> State:
        inputs = EMBED + 1
        shapes = {"embed": (_SIZE, EMBED), "mark": (1,), "filters": (inputs * KERNEL, FILTERS), "bias": (FILTERS,), "dense": (3 * FILTERS, HIDDEN), "dense_bias": (HIDDEN,), "out": (HIDDEN,), "out_bias": (1,)}
        params = {k: rng.normal(0, 0.5 if k == "embed" else 1 / np.sqrt(max(1, s[0])), s) if "bias" not in k else np.zeros(s) for k, s in shapes.items()}
        return State(params, *({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2)))

    def copy(self) -> State:
        return self.filled(self.flat())

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for part in (self.params, self.first, self.second) for v in part.values()] + [[self.t]])

    def filled(self, values: np.ndarray) -> State:
        """A state of the same shapes with the values of flat()."""
        parts, at = [], 0
        for part in (self.params, self.first, self.second):
            parts.append({})
            for k, v in part.items():
                parts[-1][k] = values[at : at + v.size].reshape(v.shape).copy()
                at += v.size
        return State(*parts, float(values[-1]))

    def learn(self, codes: np.ndarray, own: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over the windows in random order."""
        network = Network(self.params)
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            self.t += 1
            for k, g in network.step(codes[rows], own[rows], y[rows]).items():
                m, v = self.first[k], self.second[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                self.params[k] -= 0.003 * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


@dataclass
class Share:
    """Findings (text, start, end, label) as windows. Of each five, by place, one is held out for calibration and one for the threshold."""

    codes: np.ndarray
    own: np.ndarray
    of: np.ndarray
    label: np.ndarray
    train: tuple[np.ndarray, np.ndarray, np.ndarray]

    @staticmethod
    def read(findings: list[tuple[str, int, int, int]]) -> Share:
        codes, own, of = encode_findings(findings)
        bare, bare_own, _ = encode_findings(findings, blank=True)
        label = np.array([f[3] for f in findings], float)
        learn = of % 5 > 1
        y = label[of][learn]
        return Share(codes, own, of, label, (np.concatenate((codes[learn], bare[learn])), np.concatenate((own[learn], bare_own[learn])), np.concatenate((y, y))))

    def outputs(self, network: Network) -> tuple[np.ndarray, np.ndarray]:
        """The network's bare output and the label of each window held out for calibration."""
        held = np.flatnonzero(self.of % 5 == 0)
        z = [network.forward(self.codes[held[i : i + BATCH]], self.own[held[i : i + BATCH]])[0] for i in range(0, len(held), BATCH)]
        return np.concatenate([np.zeros(0), *z]), self.label[self.of[held]]

    def judged(self, network: Network) -> tuple[np.ndarray, np.ndarray]:
        """The probability, by its best window, and the label of each finding held out for the threshold."""
        judge = self.of % 5 == 1
        best = np.zeros(len(self.label))
        if judge.any():
            np.maximum.at(best, self.of[judge], network.probability(self.codes[judge], self.own[judge]))
        return best[1::5], self.label[1::5]


def _bend(at: np.ndarray, z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second and first derivatives of the logistic loss of slope and offset `at`, as sums over the outputs."""
    inputs = np.stack((z, np.ones_like(z)), 1)
    s = 1 / (1 + np.exp(-np.clip(inputs @ at, -30, 30)))
    return np.concatenate(((inputs.T * (s * (1 - s))) @ inputs, (inputs.T @ (s - y))[None])).ravel()


def _calibrated(sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Slope and offset by Newton steps on what sums(at) gives, until they stand still."""
    at = np.zeros(2)
    for _ in range(30):
        found = sums(at)
        move = np.clip(np.linalg.solve(found[:4].reshape(2, 2) + 0.01 * np.eye(2), found[4:] + 0.01 * at), -1, 1)
        at = at - move
        if np.abs(move).max() < 1e-9:
            break
    return at


def fit(findings: list[tuple[str, int, int, int]], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """A network that learns from a list of findings in memory, all of them, as one share; tables are learnt from by train_secrets.

    Without both labels nothing reaches the threshold.
    """
    single_threaded()
    rng = np.random.default_rng(seed)
    state = State.start(rng)
    if len({f[3] for f in findings}) < 2:
        return Network(state.params, threshold=2.0)
    share = Share.read(findings)
    for _ in range(epochs):
        state.learn(*share.train, rng)
    z, y = share.outputs(Network(state.params))
    slope, offset = map(float, _calibrated(lambda at: _bend(at, z, y)))
    network = Network({k: v.astype(np.float32) for k, v in state.params.items()}, slope, offset)
    best, label = share.judged(network)
    good, bad = np.sort(best[label == 1]), best[label == 0]
    if len(good):
        least = good[int((1 - RECALL) * len(good))]  # all thresholds up to here keep the recall
        network.threshold = float(least + bad[bad < least].max(initial=0)) / 2
    return network


def _shares(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Share]]:
    single_threaded()
    for batch in batches:
        for number, findings in zip(batch.column("share").to_pylist(), batch.column("findings"), strict=True):
            yield number, Share.read([(f["text"], f["start"], f["end"], f["label"]) for f in findings.as_py()])


def _summed(rows: DataFrame, run: Callable) -> np.ndarray:
    """The sum of the vectors that `run` gives for batches of rows: exact decimals, so that the order in which tasks end says nothing."""

    def places(batches):
        for vector in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vector), dtype=np.int32)), pa.array(vector, pa.float64())], names=["at", "value"])

    sums = rows.mapInArrow(places, "at int, value double").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,18)")).cast("double").alias("value"))
    return np.array([r.value for r in sorted(sums.collect())])  # as many as the network has parameters, whatever the rows


def fit_shares(shares: DataFrame, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """As `fit`, from findings of both labels in any number, in shares (share, findings array<struct<text, start, end, label>>).

    In each pass every share is learnt from by itself, beginning with the common state, and the new state is the mean of theirs,
    weighted by their windows. Calibration sums derivatives over all shares; the threshold is the exact quantile over all.
    """
    state = State.start(np.random.default_rng(seed))
    for epoch in range(epochs):

        def learnt(batches, state=state, epoch=epoch):
            for number, share in _shares(batches):
                own = state.copy()
                own.learn(*share.train, np.random.default_rng((seed, epoch, number)))
                n = len(share.train[2])
                yield np.append(own.flat() * n, n)

        sums = _summed(shares, learnt)
        if sums[-1]:
            state = state.filled(sums[:-1] / sums[-1])

    def outputs(batches):
        network = Network(state.params)
        for _, share in _shares(batches):
            z, y = share.outputs(network)
            yield pa.RecordBatch.from_arrays([pa.array([z.tolist()], pa.list_(pa.float64())), pa.array([y.tolist()], pa.list_(pa.float64()))], names=["z", "y"])

    held = saved(shares.mapInArrow(outputs, "z array<double>, y array<double>"), "secrets")

    def sums_at(at):
        def bends(batches):
            for batch in batches:
                for z, y in zip(batch.column("z"), batch.column("y"), strict=True):
                    yield _bend(at, *(np.array(c.as_py(), float) for c in (z, y)))

        return _summed(held, bends)

    slope, offset = map(float, _calibrated(sums_at))
    network = Network({k: v.astype(np.float32) for k, v in state.params.items()}, slope, offset)

    def judged(batches):
        for _, share in _shares(batches):
            best, label = share.judged(network)
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.float64()), pa.array(label == 1)], names=["p", "good"])

    found = saved(shares.mapInArrow(judged, "p double, good boolean").groupBy("good", "p").agg(F.count("*").alias("__n")), "secrets")
    good = found.filter("good")
    n = good.agg(F.sum("__n").alias("n")).first().n
    if n:
        ranks = value_ranks(good.select("p", "__n"), "p", "rank")
        # the last place that equal values take is their mean place and half of the others
        least = ranks.filter(F.col("rank") + (F.col("__n") - 1) / 2 > int((1 - RECALL) * n)).agg(F.min("p").alias("p")).first().p
        below = found.filter(~F.col("good") & (F.col("p") < least)).agg(F.max("p").alias("p")).first().p
        network.threshold = (least + max(below or 0.0, 0.0)) / 2
    return network


def train_secrets(docs: DataFrame | None, findings: DataFrame | None = None, documents: int | None = None) -> Network:
    """Fit on all labelled findings (text, start, end, label), or on those of the documents (doc_id, text) by the fixed
    patterns: every window of every candidate. A candidate's label is 1 if a fixed pattern's match overlaps it, else 0. Rows with
    null doc_id teach nothing; without documents, or without both labels, the network finds nothing. Given findings without text,
    beyond its ends or without a label teach nothing. Findings are dealt to shares of about SHARE by their hash; a caller who wants
    to learn from fewer says of how many `documents`: TRAIN_WINDOWS findings for each, in the order of their hash.
    """
    if findings is None:
        text = docs.filter("text IS NOT NULL AND doc_id IS NOT NULL").select("text")
        rows = text.mapInArrow(_findings, "text string, start int, end int, label int")
    else:
        rows = findings.select("text", "start", "end", "label").filter("text IS NOT NULL AND start >= 0 AND start < end AND end <= length(text) AND label IN (0, 1)")
    # copies teach nothing new
    rows = rows.distinct().withColumn("hash", F.xxhash64(F.lit("secrets"), "text", "start", "end"))
    if documents is not None:
        rows = rows.orderBy("hash", "text", "start", "end", "label").limit(TRAIN_WINDOWS * documents)
    rows = saved(rows, "secrets")
    held = rows.agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")).first()
    if held.labels < 2:
        return fit([])
    number = -(-held.n // SHARE)
    dealt = rows.groupBy(F.pmod("hash", F.lit(number)).cast("int").alias("share")).agg(F.array_sort(F.collect_list(F.struct("hash", "text", "start", "end", "label"))).alias("findings"))
    return fit_shares(saved(dealt.repartition(number, "share"), "secrets"))


def _findings(batches):
    """All windows of each text's candidates, each with its surroundings."""
    for batch in chunks(batches):
        block = block_of(batch.column("text"))
        label = block.overlapped()
        of, starts, ends = windows(block.starts, block.ends)
        doc = block.doc[of]
        texts = {i: batch.column("text")[i].as_py() for i in np.unique(doc).tolist()}
        low = block.offsets[doc]
        a, b = starts - low, ends - low
        begin = np.maximum(0, a - CONTEXT)
        pieces = [texts[i][x : y + CONTEXT] for i, x, y in zip(doc.tolist(), begin.tolist(), b.tolist(), strict=True)]
        columns = [pa.array(pieces, pa.string()), *(pa.array(c, pa.int32()) for c in (a - begin, b - begin, label[of].astype(np.int32)))]
        yield pa.RecordBatch.from_arrays(columns, names=["text", "start", "end", "label"])


def scan_secrets(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, score), for each row of docs (doc_id, text), whole texts.

    Base kinds come from the fixed patterns, with score 1; kind `model` are the candidates that the network finds and
    that overlap no base span. Spans are in code points, end exclusive, ordered by start, then kind as in KINDS.
    Null and empty texts have none. Rows of equal doc_id are scanned one by one; an empty table gives no rows; other
    columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        single_threaded()
        net = shared.value
        for batch in chunks(batches):
            block = block_of(batch.column("text"))
            score = net.scores(block)
            spans = [[(s, e, k, 1.0) for s, e, k in found] for found in block.base]
            for i in np.flatnonzero((score >= net.threshold) & ~block.overlapped()):
                low = int(block.offsets[block.doc[i]])
                spans[block.doc[i]].append((int(block.starts[i]) - low, int(block.ends[i]) - low, 3, float(score[i])))
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "score": v} for s, e, k, v in sorted(x, key=lambda y: (y[0], y[2], y[1]))] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")
