"""License scans: base phrases by place, and an exact set-similarity join of text blocks with license templates.

The join keeps every (block, template) pair in which the block holds at least `threshold` of the template's distinct
words. Words are put in one global order, rarest in the corpus first. By the prefix principle a block that reaches
the threshold holds one of the template's first |T| - ceil(threshold * |T|) + 1 words, so only blocks with such a
word are kept, and they meet templates by an equi-join on it. The length filter (the block has enough distinct
words) and the positional filter (words left in the template behind the first shared one) cut pairs before the
exact count of shared words. No pair that reaches the threshold is lost.

License bodies are wrapped and span sentences, so each template also meets every run of as many words as it has
itself, across line and sentence ends; comment leaders are no words. The prefix principle holds for runs too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critiq.llm.shared import Hasher, chunks, hash_text, saved, utf8, words_of

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices as they stand in documents and file heads, grants, and the bodies and headers as they are wrapped.
#: The whole Apache, GPL, AGPL and MPL texts hold their header in the part on how to apply them.
TEMPLATES = {
    "mit-notice": "Released under the MIT License",
    "apache-2.0-notice": "Licensed under the Apache License Version 2.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License version 3",
    "gpl-2.0-notice": "This program is licensed under the GNU General Public License version 2",
    "lgpl-notice": "This library is licensed under the GNU Lesser General Public License",
    "agpl-notice": "This software is licensed under the GNU Affero General Public License",
    "cc-by-nc-4.0-notice": "Licensed under CC BY NC 4.0",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0-notice": "Licensed under CC BY SA 4.0",
    "cc0-notice": "Dedicated to the public domain under CC0 1.0 Universal",
    "bsd-notice": "Licensed under the BSD 3 Clause License",
    "mpl-2.0-notice": "Subject to the terms of the Mozilla Public License version 2.0",
    "mit-grant": "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd-terms": "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "apache-2.0-terms": "You may not use this file except in compliance with the License You may obtain a copy of the License at",
    "isc-grant": "Permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted",
    "mit-text": (
        "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the Software to deal in the "
        "Software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the Software "
        "and to permit persons to whom the Software is furnished to do so subject to the following conditions The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software THE SOFTWARE IS PROVIDED AS IS WITHOUT WARRANTY OF ANY KIND EXPRESS OR IMPLIED "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM DAMAGES OR OTHER LIABILITY WHETHER IN AN ACTION OF CONTRACT TORT OR OTHERWISE ARISING FROM OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met Redistributions of "
        "source code must retain the above copyright notice this list of conditions and the following disclaimer Redistributions in binary form must reproduce the above "
        "copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution THIS SOFTWARE "
        "IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES INCLUDING BUT NOT LIMITED TO THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"
    ),
    "isc-text": (
        "Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and "
        "this permission notice appear in all copies THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL DIRECT INDIRECT OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE DATA OR PROFITS WHETHER IN AN ACTION OF CONTRACT NEGLIGENCE OR OTHER TORTIOUS ACTION ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE"
    ),
    "apache-2.0-header": (
        "Licensed under the Apache License Version 2.0 the License you may not use this file except in compliance with the License You may obtain a copy of the License at "
        "http www apache org licenses LICENSE 2.0 Unless required by applicable law or agreed to in writing software distributed under the License is distributed on an "
        "AS IS BASIS WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND either express or implied See the License for the specific language governing permissions and "
        "limitations under the License"
    ),
    "gpl-header": (
        "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation either version 3 of the License or at your option any later version This program is distributed in the hope that it will be useful but WITHOUT ANY "
        "WARRANTY without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE See the GNU General Public License for more details"
    ),
    "lgpl-header": (
        "This library is free software you can redistribute it and or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation either version 2.1 of the License or at your option any later version This library is distributed in the hope that it will be useful but WITHOUT ANY "
        "WARRANTY without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE See the GNU Lesser General Public License for more details"
    ),
    "agpl-header": (
        "This program is free software you can redistribute it and or modify it under the terms of the GNU Affero General Public License as published by the Free Software "
        "Foundation either version 3 of the License or at your option any later version This program is distributed in the hope that it will be useful but WITHOUT ANY "
        "WARRANTY without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE See the GNU Affero General Public License for more details"
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License v 2.0 If a copy of the MPL was not distributed with this file You can obtain one at "
        "http mozilla org MPL 2.0"
    ),
}
#: Bytes that are no part of a word: all ASCII but digits and lower-case letters.
GAP = np.zeros(256, bool)
GAP[:0x80] = True
GAP[0x30:0x3A] = False
GAP[0x61:0x7B] = False
#: Sentence ends and line breaks end a block; a full stop inside "4.0" does not.
_LINE = np.zeros(256, bool)
_LINE[[0x0A, 0x0D]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3F]] = True

_BASE = T.StructType([
    T.StructField("doc_id", T.LongType()),
    *[T.StructField(name, T.LongType()) for name in ("n_words", "n_base", "first_word", "last_word")],
    T.StructField("base_labels", T.ArrayType(T.StringType())),
    T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("ranks", T.ArrayType(T.IntegerType()))]))),
    T.StructField("runs", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("held", T.DoubleType())]))),
])


def _hash_words(data: np.ndarray, offsets: np.ndarray):
    starts, ends, doc = words_of(data, offsets, GAP)
    return starts, ends, doc, Hasher(data)(starts, ends)


def _template_text(text: str) -> list[str]:
    """The template's words, by the same rule as those of the documents."""
    data, offsets = utf8(pa.array([text], pa.string()))
    starts, ends, _ = words_of(data, offsets, GAP)
    return [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]


def template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    return {label: sorted(set(_template_text(text))) for label, text in templates.items()}


def _best_runs(at: np.ndarray, words: np.ndarray, doc: np.ndarray, first_of: np.ndarray, starters: np.ndarray, size: int):
    """(documents, most distinct words in any run of `size` words of each), for the template's words at the places `at`.

    Places are ascending and count through all documents; only runs that hold one of `starters` matter.
    """
    after = np.searchsorted(starters, at)
    near = (after < len(starters)) & (starters[np.minimum(after, len(starters) - 1)] - at < size)
    near |= (after > 0) & (at - starters[np.maximum(after - 1, 0)] < size)
    at, words, doc = at[near], words[near], doc[near]
    order = np.argsort(words, kind="stable")
    last = np.full(len(at), -1)
    same = words[order[1:]] == words[order[:-1]]
    last[order[1:][same]] = at[order[:-1][same]]
    # a place counts for the runs that begin from here to the place itself: behind the word's last place, in its document
    begin = np.maximum(np.maximum(last + 1, at - size + 1), first_of[doc])
    event = np.concatenate((begin, at + 1))
    # where one place ends and another begins, the end comes first
    step = np.concatenate((np.ones(len(at), np.int64), np.full(len(at), -1)))
    order = np.lexsort((step, event))
    held = np.cumsum(step[order])[step[order] > 0]
    of = np.concatenate((doc, doc))[order][step[order] > 0]
    edges = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    return of[edges], np.maximum.reduceat(held, edges)


def word_frequency(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """How many documents hold each of the given words, over all documents. The result is as long as `words`."""
    if not words:
        return {}
    hashes = np.array([hash_text(w) for w in words], np.uint64)
    order = np.argsort(hashes)
    known = hashes[order]

    def count(batches):
        total = np.zeros(len(words), np.int64)
        for batch in chunks(batches):
            _, _, doc, got = _hash_words(*utf8(batch.column("text")))
            at = np.minimum(np.searchsorted(known, got), len(known) - 1)
            hit = known[at] == got
            pairs = np.unique(doc[hit] * len(words) + order[at[hit]])
            total += np.bincount(pairs % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words))), pa.array(total)], names=["w", "n"])

    sums = docs.select("text").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(words, 0) | {words[r.w]: r.n for r in sums}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """A row per document of (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of PHRASES; first_word and last_word are their smallest and largest start (null
    without any). base_labels and labels are arrays, distinct and sorted; labels adds the templates met by any
    block, or by any run of as many words as the template has. score is the largest share of a template's words that
    a block or run that met it holds, 1 with a base phrase, else 0. Null or empty text: no words, no labels, score 0. Rows of equal doc_id are scanned one by one and
    joined row by row. An empty table gives no rows; without templates only the phrases count; other columns are left out.
    """
    templates = TEMPLATES if templates is None else templates
    sets = template_words(templates)
    vocabulary = sorted({w for words in sets.values() for w in words})
    seen = word_frequency(docs, vocabulary)
    ordered = sorted(vocabulary, key=lambda w: (seen[w], w))
    rank = {w: i for i, w in enumerate(ordered)}
    hashes = np.array([hash_text(w) for w in ordered], np.uint64)
    by_hash = np.argsort(hashes)
    known = hashes[by_hash]
    if not ordered:  # no templates, no words to look for: rank -1 for all
        known, by_hash = np.zeros(1, np.uint64), np.full(1, -1)
    rows, prefixes, lookups = [], set(), []
    for label, words in sets.items():
        if not words:
            continue  # a template without words is met by nothing
        ranks = sorted(rank[w] for w in words)
        need = math.ceil(threshold * len(ranks) - 1e-9)
        for place, r in enumerate(ranks[: len(ranks) - need + 1]):
            rows.append((label, r, place, need, ranks))
            prefixes.add(r)
        own, starter = np.zeros(len(ordered), bool), np.zeros(len(ordered), bool)
        own[ranks], starter[ranks[: len(ranks) - need + 1]] = True, True
        lookups.append((label, own, starter, len(_template_text(templates[label])), max(need, 1), len(ranks)))
    prefix = np.zeros(len(ordered) + 1, bool)  # the last one, which rank -1 meets, stays False
    prefix[list(prefixes)] = True
    phrases = [([hash_text(w) for w in phrase.split()], label) for phrase, label in PHRASES.items()]

    def scan(batches):
        for batch in chunks(batches):
            data, offsets = utf8(batch.column("text"))
            starts, ends, doc, got = _hash_words(data, offsets)
            n = len(batch)
            n_words = np.bincount(doc, minlength=n)
            first_of = np.cumsum(n_words) - n_words
            n_base = np.zeros(n, np.int64)
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            labels: list[set] = [set() for _ in range(n)]
            for phrase, label in phrases:
                k = len(phrase)
                hit = np.ones(max(0, len(got) - k + 1), bool)
                for i, h in enumerate(phrase):
                    hit &= (got[i : len(hit) + i] == np.uint64(h)) & (doc[i : len(hit) + i] == doc[: len(hit)])
                at = np.flatnonzero(hit)
                d = doc[at]
                n_base += np.bincount(d, minlength=n)
                np.minimum.at(first, d, at - first_of[d])
                np.maximum.at(last, d, at - first_of[d])
                for i in np.unique(d):
                    labels[i].add(label)
            found: list[list] = [[] for _ in range(n)]
            at = np.minimum(np.searchsorted(known, got), len(known) - 1)
            word_rank = np.where(known[at] == got, by_hash[at], -1)
            if (prefix[word_rank] & (word_rank >= 0)).any():
                # a block ends at a line break, or at a sentence end followed by white space
                after = np.concatenate((data[1:], [0x20]))
                stop = _LINE[data] | (_STOP[data] & (after <= 0x20))
                stops = np.concatenate(([0], np.cumsum(stop)))
                block = stops[starts] + doc
                edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
                hits = np.flatnonzero(prefix[word_rank] & (word_rank >= 0))
                for b in np.unique(np.searchsorted(edges, hits, "right") - 1):
                    inside = slice(edges[b], edges[b + 1])
                    ranks = np.unique(word_rank[inside])
                    found[doc[edges[b]]].append({"n": int(len(np.unique(got[inside]))), "ranks": [int(x) for x in ranks if x >= 0]})
            runs: list[list] = [[] for _ in range(n)]
            told = np.flatnonzero(word_rank >= 0)
            told_rank = word_rank[told]
            for label, own, starter, size, need, of in lookups:
                starters = told[starter[told_rank]]
                if len(starters):
                    mine = own[told_rank]
                    for d, most in zip(*_best_runs(told[mine], told_rank[mine], doc[told[mine]], first_of, starters, size), strict=True):
                        if most >= need:
                            runs[d].append({"label": label, "held": most / of})
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none),
                 pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
                 pa.array(found, pa.list_(pa.struct([("n", pa.int32()), ("ranks", pa.list_(pa.int32()))]))),
                 pa.array(runs, pa.list_(pa.struct([("label", pa.string()), ("held", pa.float64())])))],
                names=_BASE.names,
            )

    base = saved(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, _BASE).withColumn("row", F.monotonically_increasing_id()), "licenses")
    spark = docs.sparkSession
    index = spark.createDataFrame(rows, "label string, word int, place int, need int, words array<int>")
    blocks = base.filter(F.size("blocks") > 0).select("row", F.posexplode("blocks").alias("block", "b")).select("row", "block", "b.n", "b.ranks")
    met = (
        blocks.withColumn("word", F.explode("ranks"))
        .join(F.broadcast(index), "word")  # as many rows as the templates have prefix words
        .filter((F.col("n") >= F.col("need")) & (F.size("words") - F.col("place") >= F.col("need")))
        # the pair counts at its first shared word only, so no pair comes twice
        .withColumn("shared", F.array_intersect("ranks", "words"))
        .filter((F.array_min("shared") == F.col("word")) & (F.size("shared") >= F.col("need")))
        .groupBy("row")
        .agg(F.collect_set("label").alias("more"), F.max(F.size("shared") / F.size("words")).alias("held"))
    )
    labels = F.array_sort(F.array_union(F.array_union("base_labels", F.col("runs.label")), F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.greatest("held", F.array_max("runs.held")), F.lit(0.0)))
    return base.join(met, "row", "left").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))
