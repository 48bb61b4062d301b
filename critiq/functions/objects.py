"""The first balanced JSON object of each text, from masks and running sums over the bytes of a whole batch.

The rule: a double quote opens a string wherever it stands, also in prose, and inside one a backslash takes the next character
with it. Braces outside strings count: an object runs from a brace at depth 0 to the one that closes it; closing braces at depth
0 say nothing. The first such object that is valid JSON is the one; what is inside one that is not valid is not looked at again.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Objects and lists that lie deeper than this are not read as JSON, as with the usual limit of JSON readers.
MOST_NESTED = 900
#: Texts scanned at a time hold about this many bytes.
SCAN_BYTES = 8 << 20


def _in_string(at: np.ndarray, text: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """For each quote, in order, with its text and whether an odd run of backslashes stands before it: is what follows in a string?

    A plain quote turns the state over. After an escaped one it is always true: inside a string the quote is part of it, outside
    it opens one. So the state is the number of plain quotes since the last escaped one, or since the text began, by parity.
    """
    i = np.arange(len(at))
    plain = np.cumsum(~escaped)
    opens_text = np.concatenate(([True], text[1:] != text[:-1]))
    reset = np.maximum.accumulate(np.where(escaped | opens_text, i, 0))
    since = plain - plain[reset] + np.where(escaped[reset], 1, (~escaped[reset]).astype(np.int64))
    return since % 2 == 1


def balanced_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, depth) of every outermost balanced object, in order; depth counts braces and brackets inside it."""
    quotes = np.flatnonzero(data == ord('"'))
    quote_text = np.searchsorted(offsets, quotes, "right") - 1
    slashes = np.flatnonzero(data == ord("\\"))
    escaped = np.zeros(len(quotes), bool)
    behind = np.flatnonzero((quotes > 0) & (data[quotes - 1] == ord("\\"))) if len(quotes) else quotes
    if len(behind):  # the run of backslashes before the quote, within its text
        first = np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(slashes) > 1)), slashes, 0))
        start = np.maximum(first[np.searchsorted(slashes, quotes[behind] - 1)], offsets[quote_text[behind]])
        escaped[behind] = (quotes[behind] - start) % 2 == 1
    inside = _in_string(quotes, quote_text, escaped) if len(quotes) else escaped
    marks = np.flatnonzero(np.isin(data, np.frombuffer(b"{}[]", np.uint8)))
    text = np.searchsorted(offsets, marks, "right") - 1
    last = np.searchsorted(quotes, marks) - 1
    quoted = (last >= 0) & (quote_text[last] == text) & inside[last] if len(quotes) else np.zeros(len(marks), bool)
    marks, text = marks[~quoted], text[~quoted]
    kind = data[marks]
    brace = (kind == ord("{")) | (kind == ord("}"))
    at, owner = marks[brace], text[brace]
    step = np.where(data[at] == ord("{"), 1, -1)
    # depth that never falls below 0: the running sum less its least value so far; each text starts far below the last one
    far = 2 * (len(at) + 1)
    total = np.cumsum(step)
    before = np.concatenate(([0], total))
    base = before[np.searchsorted(owner, owner)] if len(owner) else total
    total = total - base - far * owner
    depth = total - np.minimum.accumulate(np.minimum(total, -far * owner)) if len(at) else total
    earlier = np.concatenate(([0], depth[:-1]))
    opens = at[(step == 1) & (depth == 1)]
    closes = np.flatnonzero((step == -1) & (depth == 0) & (earlier == 1) & (np.concatenate(([-1], owner[:-1])) == owner))
    start = opens[np.searchsorted(opens, at[closes]) - 1] if len(closes) else opens[:0]
    level = np.concatenate(([0], np.cumsum(np.where((kind == ord("{")) | (kind == ord("[")), 1, -1))))
    deepest = np.zeros(len(closes), np.int64)
    if len(closes):
        edges = np.stack((np.searchsorted(marks, start), np.searchsorted(marks, at[closes]) + 1), 1).reshape(-1)
        deepest = np.maximum.reduceat(np.append(level[1:], 0), edges)[::2] - level[edges[::2]]
    return owner[closes], start, at[closes] + 1, deepest


def _scan(texts: pa.Array) -> pa.Array:
    column = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    found: list[str | None] = [None] * len(texts)
    for text, start, end, depth in zip(*[x.tolist() for x in balanced_spans(data, offsets - offsets[0])], strict=True):
        if found[text] is None and depth <= MOST_NESTED:
            piece = data[start:end].tobytes().decode()
            try:
                json.loads(piece)
            except ValueError:
                continue
            found[text] = piece
    return pa.array(found, pa.string())


@F.arrow_udf(T.StringType())
def first_json(text: pa.Array) -> pa.Array:
    """The first balanced object of each text that is valid JSON; null where there is none and for null texts."""
    size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.unique(np.searchsorted(size, np.arange(SCAN_BYTES, int(size[-1]) if len(size) else 0, SCAN_BYTES), "right"))
    cuts = [0, *cuts.tolist(), len(text)]
    parts = [_scan(text.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())
