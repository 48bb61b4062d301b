"""Filter interaction audit by decision diagrams.

Every document gets a mask of the filters that it fails. Spark counts the masks of each part; a part's counts (2 to the
number of filters at most) become a decision diagram with a level per filter, whose edges carry counts: the low edge leads
to the documents that pass, the high edge to those that fail, and equal nodes are one. Swaps of adjacent levels, done in
place, lead from order to order until every order of the filters has stood once. In each order the path of low edges from
the root gives the steps: what passes stays on it, what leaves it by a high edge is removed there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.llm.shared import saved

WORD = r"[^\x20\x09-\x0D]+"
#: What is counted of each mask, in the order of a node's counts.
COUNTED = ("n", "good", "toxic")
FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in FIELDS)


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by letter: A under 200 words, B under half of the words distinct, C over 2 % capitals, D an odd mark."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_counts(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, str]:
    """(part, mask, n, good, toxic), and the filters' letters from the lowest bit on: those of text_filters, then E.

    E fails a document whose text is that of any row with a smaller doc_id, found by the SHA-256 of whole texts over all
    parts. Null text is empty; null source is the part of the empty string; a row without doc_id is no copy and has no
    label, and none is a copy of it. Rows that repeat a doc_id count each. Repeated labels: 1 if any row says 1.
    Other columns are left out. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    found = text_filters(text)
    mask = sum((c.cast("int") * (1 << i) for i, c in enumerate(found.values())), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("text_id"))
    rows = saved(rows, "masks")
    firsts = rows.groupBy("text_id").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * (1 << len(found))
    all_rows = rows.join(firsts, "text_id", "left").join(marks, "doc_id", "left").select("part", (F.col("mask") + copy).alias("mask"), "good", "toxic")
    counts = all_rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTED[1:]])
    return counts, "".join(found) + "E"


class Diagram:
    """A count-weighted decision diagram: node -> (low, high), node -> counts. Node 0 is empty; no other node is without documents.

    Every path has a node per level until it ends at 0 or behind the last level. `levels` holds the nodes of each level.
    """

    def __init__(self, letters: str, cells: dict[int, tuple[int, ...]]):
        self.order = list(letters)
        self.edges: list[tuple[int, int] | None] = [None]
        self.counts: list[tuple[int, ...]] = [(0,) * len(COUNTED)]
        self.known: dict = {}
        self.levels: list[set[int]] = [set() for _ in letters]
        rows = [self._leaf(cells.get(m)) for m in range(1 << len(letters))]
        for level in reversed(range(len(letters))):  # of two masks that differ in the last bit left, one node
            half = len(rows) // 2
            rows = [self._node(level, rows[m], rows[m + half]) for m in range(half)]
        self.root = rows[0]

    def _add(self, key, edges, counts) -> int:
        if key not in self.known:
            self.known[key] = len(self.edges)
            self.edges.append(edges)
            self.counts.append(counts)
        return self.known[key]

    def _leaf(self, counts: tuple[int, ...] | None) -> int:
        return self._add(("leaf", counts), None, counts) if counts and any(counts) else 0

    def _node(self, level: int, low: int, high: int) -> int:
        if not low and not high:
            return 0
        total = tuple(a + b for a, b in zip(self.counts[low], self.counts[high], strict=True))
        node = self._add((self.order[level], low, high), (low, high), total)
        self.levels[level].add(node)
        return node

    def swap(self, level: int) -> None:
        """Swap a level with the next one. Nodes of `level` keep their numbers and counts, so nothing above changes."""
        upper, lower = self.order[level], self.order[level + 1]
        nodes = [(node, [self.edges[e] or (0, 0) if e else (0, 0) for e in self.edges[node]]) for node in self.levels[level]]
        for node in self.levels[level]:
            del self.known[upper, *self.edges[node]]
        for node in self.levels[level + 1]:
            del self.known[lower, *self.edges[node]]
        self.order[level : level + 2] = lower, upper
        self.levels[level + 1] = set()
        for node, ((ll, lh), (hl, hh)) in nodes:
            self.edges[node] = self._node(level + 1, ll, hl), self._node(level + 1, lh, hh)
            self.known[lower, *self.edges[node]] = node

    def steps(self) -> Iterator[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """(filter, counts of what it removes, counts of what is left) along the path of low edges."""
        node = self.root
        for letter in self.order:
            low, high = self.edges[node] or (0, 0)
            yield letter, self.counts[high], self.counts[low]
            node = low


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places whose swaps with the next one lead through all orders of n things, each once."""
    if n < 2:
        return
    inner = adjacent_swaps(n - 1)
    down = True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)  # the last thing walks through
        try:
            step = next(inner)
        except StopIteration:
            return
        yield step + 1 if down else step  # the others lie behind it while it stands first
        down = not down


def audit_part(letters: str, cells: dict[int, tuple[int, ...]]) -> Iterator[tuple]:
    """(filter_order, step, *FIELDS) for every order of the filters and every step."""
    diagram = Diagram(letters, cells)
    fails = {c: sum(v[0] for m, v in cells.items() if m >> i & 1) for i, c in enumerate(letters)}
    alone = {c: cells.get(1 << i, (0,))[0] for i, c in enumerate(letters)}
    found, shapley = [], dict.fromkeys(letters, 0)
    swaps = adjacent_swaps(len(letters))
    while True:
        order = "".join(diagram.order)
        for step, (letter, gone, left) in enumerate(diagram.steps(), 1):
            shapley[letter] += gone[0]
            found.append((order, step, letter, left[0], gone))
        at = next(swaps, None)
        if at is None:
            break
        diagram.swap(at)
    for order, step, letter, left, gone in found:
        yield order, step, left, gone[0], fails[letter] - gone[0], alone[letter], gone[1], gone[2], shapley[letter]


def audit_filters(counts: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, *FIELDS) from (part, mask, n, good, toxic): the first letter is the mask's lowest bit.

    A part's row holds 2 ** len(letters) counts at most, whatever its size.
    """
    cell = F.struct("mask", *COUNTED)
    parts = counts.groupBy("part").agg(F.collect_list(cell).alias("cells"))

    def run(batches):
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                rows = list(audit_part(letters, {c["mask"]: tuple(c[k] for k in COUNTED) for c in cells}))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * len(FIELDS)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows)), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["part", "filter_order", "step", *FIELDS])

    return parts.mapInArrow(run, SCHEMA)
