"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give spans and document scores.

Chains are whole sentences. A token's emission is a sum of weights of its hashed word, affixes and
length; two states and one transition matrix. With two states the forward and the backward pass are each one
recursion of an odds ratio, run for all chains of a block of texts at once.

The labels are of documents, so token labels are derived first. A frequent word or prefix that occurs in next to no
clean document marks its tokens as toxic if its neighbours change from place to place, as they do not in copies of a
document. Then, greedily, the word or prefix that occurs in the most toxic documents not explained yet, and in next
to no clean one, is a mark too; a mark explains all copies at once, so it hides their other words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.llm.licenses import GAP
from critiq.llm.quality import labelled_sample
from critiq.llm.shared import Hasher, chunks, code_points, mix, utf8, words_of

#: Labelled documents to learn from, per label, and the longest text that is learnt from, in characters: together they bound
#: what comes to the driver.
TRAIN_PER_LABEL, TRAIN_CHARS = 800, 50_000
#: A mark explains at least this share of the toxic documents (and FEWEST), and so large a share of the documents that
#: hold it is toxic.
LEAST_SHARE, LEAST_PRECISION = 0.025, 0.995
#: A frequent mark is in this share of the toxic documents, with so many different pairs of neighbours per occurrence.
FREQUENT_SHARE, LEAST_CONTEXTS = 0.05, 0.8
FEWEST = 4
#: Scores are those of a table with this share of toxic documents, whatever the shares in the sample, so they mean the same at every size.
PRIOR = 0.3
TABLE = 1 << 20
PREFIXES, SUFFIXES = (3, 4, 5, 6), (3, 4)
_END = np.zeros(256, bool)
_END[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = True


@dataclass
class Tokens:
    """The tokens of some texts: byte spans, text numbers, chain numbers, place in the chain, hashed features."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    chain: np.ndarray
    place: np.ndarray
    columns: np.ndarray


def tokens_of(column: pa.Array) -> Tokens:
    data, offsets = utf8(column)
    starts, ends, doc = words_of(data, offsets, GAP)
    stops = np.concatenate(([0], np.cumsum(_END[data])))
    sentence = stops[starts] + doc  # both only grow, so equal sums are one sentence
    new = np.ones(len(starts), bool)
    new[1:] = sentence[1:] != sentence[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(starts)), 0))
    place = np.arange(len(starts)) - first
    hashed, size = Hasher(data), ends - starts
    found = [hashed(starts, ends), mix(np.minimum(size, 20).astype(np.uint64) + np.uint64(1 << 40))]
    for k, length in enumerate(PREFIXES):
        found.append(np.where(size >= length, hashed(starts, np.minimum(starts + length, ends)) ^ np.uint64(k + 1 << 50), np.uint64(0)))
    for k, length in enumerate(SUFFIXES):
        found.append(np.where(size >= length, hashed(np.maximum(ends - length, starts), ends) ^ np.uint64(k + 11 << 50), np.uint64(0)))
    columns = np.stack([np.where(f == 0, 0, f % np.uint64(TABLE - 1) + np.uint64(1)) for f in found], 1).astype(np.int32)
    return Tokens(data, offsets, starts, ends, doc, np.cumsum(new) - 1, place, columns)


def _steps(chain: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each token stands if all first tokens come first, longest chains ahead, then all second ones, and so
    on; and where each step begins. A chain's row is the same in every step it reaches."""
    length = np.bincount(chain)
    order = np.argsort(-length, kind="stable")
    row = np.empty(len(order), np.int64)
    row[order] = np.arange(len(order))
    reach = np.searchsorted(-length[order], -np.arange(length.max()), "left")
    begin = np.concatenate(([0], np.cumsum(reach)))
    return begin[place] + row[chain], begin


@dataclass
class Tagger:
    """weights: emission log-odds of state 1 per feature; moves[a, b]: log-weight of going from a to b; start: of state 1."""

    weights: np.ndarray
    moves: np.ndarray
    start: float
    calibration: np.ndarray | None = None

    def marginals(self, tokens: Tokens) -> np.ndarray:
        """Each token's probability of state 1, by forward-backward."""
        return self._passes(tokens)[0] if len(tokens.doc) else np.zeros(0)

    def _passes(self, tokens: Tokens):
        at, begin = _steps(tokens.chain, tokens.place)
        emit = np.empty(len(at))
        emit[at] = np.exp(np.clip(self.weights[tokens.columns].sum(1), -40, 40))
        (a00, a01), (a10, a11) = np.exp(self.moves)
        ahead, back = emit.copy(), np.ones(len(at))
        steps = [slice(*x) for x in zip(begin[:-1], begin[1:], strict=True)]
        ahead[steps[0]] *= np.exp(self.start)
        for before, now in zip(steps, steps[1:], strict=False):
            r = ahead[before][: now.stop - now.start]
            ahead[now] *= (a01 + r * a11) / (a00 + r * a10)
        for now, after in zip(steps[-2::-1], steps[:0:-1], strict=True):
            q = emit[after] * back[after]
            back[now][: len(q)] = (a10 + a11 * q) / (a00 + a01 * q)
        odds = np.clip(ahead * back, 0, 1e30)
        return (odds / (1 + odds))[at], at, emit, ahead, back

    def summary(self, tokens: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Per token the marginal; per document the two inputs of the calibration."""
        p = self.marginals(tokens)
        most, total = np.zeros(n), np.bincount(tokens.doc, p, minlength=n)
        np.maximum.at(most, tokens.doc, p)
        most = np.clip(most, 1e-9, 1 - 1e-9)
        return p, np.stack([np.ones(n), np.log(most / (1 - most)), np.log1p(total)], 1)

    def score(self, inputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs @ self.calibration, -30, 30)))


def derive_token_labels(tokens: Tokens, toxic: np.ndarray) -> np.ndarray:
    """1 for the tokens that hold a mark (see the module's docstring), for the documents' labels `toxic`."""
    kinds = [0, *range(2 + PREFIXES.index(4), 2 + len(PREFIXES))]  # whole word, prefixes of 4 bytes and more
    held = tokens.columns[:, kinds].astype(np.int64)
    longest = np.array([99, 4, 5, 6])
    pairs = np.unique((held * len(toxic) + tokens.doc[:, None])[held > 0])
    column, doc = pairs // len(toxic), pairs % len(toxic)
    weight = np.where(toxic == 1, 1.0, 0.0)
    clean = np.bincount(column, 1 - weight[doc], minlength=TABLE) * max(1.0, weight.sum()) / max(1.0, (1 - weight).sum())
    rank = np.zeros(TABLE)
    np.maximum.at(rank, held.ravel(), np.tile(longest, len(held)))
    all_toxic = np.bincount(column, weight[doc], minlength=TABLE)
    allowed = all_toxic / np.maximum(all_toxic + clean, 1e-9) >= LEAST_PRECISION
    marks = np.zeros(TABLE, bool)
    least, frequent = (max(FEWEST, share * weight.sum()) for share in (LEAST_SHARE, FREQUENT_SHARE))
    around = np.zeros(len(held), np.int64)
    around[1:-1] = held[:-2, 0] * TABLE + held[2:, 0]
    for k in range(held.shape[1]):
        at = np.flatnonzero(allowed[held[:, k]] & (all_toxic[held[:, k]] >= frequent) & (toxic[tokens.doc] == 1) & (held[:, k] > 0))
        both = np.unique(np.stack([held[at, k], around[at]]), axis=1)
        contexts, times = np.bincount(both[0], minlength=TABLE), np.bincount(held[at, k], minlength=TABLE)
        marks |= (times > 0) & (contexts >= LEAST_CONTEXTS * times)
    explained = np.zeros(len(toxic), bool)
    explained[tokens.doc[marks[held].any(1)]] = True
    keep = allowed[column] & (toxic[doc] == 1)
    column, doc = column[keep], doc[keep]
    open_docs = (toxic == 1) & ~explained
    while True:
        live = open_docs[doc]
        column, doc = column[live], doc[live]
        count = np.bincount(column, minlength=TABLE)
        most = count.max() if len(count) else 0
        if most < least:
            break
        best = np.flatnonzero(count == most)
        best = best[np.argmax(rank[best])]
        marks[best] = True
        open_docs[doc[column == best]] = False
    return (marks[held].any(1) & (toxic[tokens.doc] == 1)).astype(np.int64)


def fit(texts: list[str | None], labels: list[int], rounds: int = 60, rate: float = 0.3, decay: float = 1e-6) -> Tagger:
    """Derive token labels, then raise the chains' conditional likelihood by adaptive gradient steps; then calibrate.

    Without both labels, or without any mark, the score is the share of label 1 for every text.
    """
    toxic = np.asarray(labels, np.int64)
    tokens = tokens_of(pa.array(texts, pa.string()))
    tagger = Tagger(np.zeros(TABLE), np.zeros((2, 2)), -3.0)
    tagger.weights[0] = 0
    share = float(np.clip(toxic.mean() if len(toxic) else 0.5, 0.001, 0.999))
    tagger.calibration = np.array([np.log(share / (1 - share)), 0.0, 0.0])
    if not 0 < toxic.sum() < len(toxic):
        return tagger
    y = derive_token_labels(tokens, toxic)
    if not y.any():
        return tagger
    # chains with a toxic token, and four times as many of clean documents
    n_chains = int(tokens.chain[-1]) + 1
    has = np.bincount(tokens.chain, y, minlength=n_chains) > 0
    of = np.zeros(n_chains, np.int64)
    of[tokens.chain] = tokens.doc
    clean = np.flatnonzero(~has & (toxic[of] == 0))
    chosen = has.copy()
    chosen[np.random.default_rng(7).permutation(clean)[: 4 * int(has.sum())]] = True
    keep = chosen[tokens.chain]
    number = np.cumsum(chosen) - 1
    part = Tokens(tokens.data, tokens.offsets, tokens.starts[keep], tokens.ends[keep], tokens.doc[keep], number[tokens.chain[keep]], tokens.place[keep], tokens.columns[keep])
    y = y[keep]
    del tokens
    follows = np.flatnonzero(part.place > 0)
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (y[follows - 1], y[follows]), 1)
    first = part.place == 0
    g_w, g_m, g_s = np.full(TABLE, 1e-8), np.full((2, 2), 1e-8), 1e-8
    flat, width = part.columns.ravel(), part.columns.shape[1]
    for _ in range(rounds):
        p, at, emit, ahead, back = tagger._passes(part)
        # expected moves: weights of the four pairs of states at each step
        moves = np.exp(tagger.moves)
        expected = np.zeros((2, 2))
        r, q = ahead[at[follows - 1]], (emit * back)[at[follows]]
        four = np.stack([np.full_like(r, moves[0, 0]), moves[0, 1] * q, moves[1, 0] * r, moves[1, 1] * r * q])
        expected = (four / four.sum(0)).sum(1).reshape(2, 2)
        d_w = np.bincount(flat, np.repeat(p - y, width), minlength=TABLE) + decay * tagger.weights
        d_w[0] = 0
        d_m, d_s = expected - seen_moves, float((p - y)[first].sum())
        g_w += d_w**2
        g_m += d_m**2
        g_s += d_s**2
        tagger.weights -= rate * d_w / np.sqrt(g_w)
        tagger.moves -= 0.1 * d_m / np.sqrt(g_m)
        tagger.start -= 0.1 * d_s / np.sqrt(g_s)
    inputs = np.concatenate([tagger.summary(tokens_of(pa.array(texts[i : i + 100], pa.string())), len(texts[i : i + 100]))[1] for i in range(0, len(texts), 100)])
    at = np.zeros(3)
    for _ in range(40):  # Newton steps with a small ridge
        s = 1 / (1 + np.exp(-np.clip(inputs @ at, -30, 30)))
        slope = inputs.T @ (s - toxic) + 0.1 * at
        bend = (inputs * (s * (1 - s))[:, None]).T @ inputs + 0.1 * np.eye(3)
        at -= np.clip(np.linalg.solve(bend, slope), -2, 2)
    at[0] += np.log(PRIOR / (1 - PRIOR)) - np.log(share / (1 - share))
    tagger.calibration = at
    tagger.weights = tagger.weights.astype(np.float32)
    return tagger


def train_toxicity(docs: DataFrame, labels: DataFrame, keep: Column | None = None, per_label: int = TRAIN_PER_LABEL) -> Tagger:
    """Fit on a bounded sample of the rows of labels (doc_id, toxic) for which the condition `keep`, if any, holds.

    Texts of more than TRAIN_CHARS characters are scored like all others but not learnt from; null texts count as empty.
    """
    sample = labelled_sample(docs, labels, "toxic", keep, per_label, "toxic").filter(F.length(F.coalesce("text", F.lit(""))) <= TRAIN_CHARS)
    rows = sorted(sample.select("doc_id", "y", "text").collect(), key=lambda r: (r.doc_id, r.text or ""))
    return fit([r.text for r in rows], [r.y for r in rows])


def score_toxicity(docs: DataFrame, tagger: Tagger, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= threshold) and spans, a row for each row of docs.

    spans: start and end (code points, end exclusive) of the tokens with a marginal of one half and more, touching
    tokens of one chain as one span. A text without words, null included, has no span and the score of a text whose
    marginals are all 0. An empty table gives no rows; columns other than doc_id and text are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches):
        for batch in chunks(batches):
            tokens, n = tokens_of(batch.column("text")), len(batch)
            p, inputs = shared.value.summary(tokens, n)
            hit = np.flatnonzero(p >= 0.5)
            spans: list[list] = [[] for _ in range(n)]
            if len(hit):
                points = code_points(tokens.data)
                before = points[tokens.offsets[tokens.doc[hit]]]
                last = -2
                for i, d, start, end in zip(hit, tokens.doc[hit], points[tokens.starts[hit]] - before, points[tokens.ends[hit]] - before, strict=True):
                    if last == i - 1 and tokens.chain[last] == tokens.chain[i]:
                        spans[d][-1]["end"] = int(end)
                    else:
                        spans[d].append({"start": int(start), "end": int(end)})
                    last = i
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(shared.value.score(inputs)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "score", "spans"],
            )

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start:long,end:long>>")
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
