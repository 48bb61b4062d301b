"""Filter audit, conversation trie and language-model scores against brute force, and their odd cases."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from critiq.llm import audit, lm, prefixes, queries, shared

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name, key):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}{'/*.parquet' if os.path.isdir(f'{SF}/{file}') else ''}'")
    theirs = con.execute(queries.ORACLES[name]).df()
    ours = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours) == len(theirs) > 0
    ours, theirs = (f[sorted(f.columns)].sort_values(key).astype(str).replace("<NA>", "nan").values.tolist() for f in (ours, theirs))
    assert [[x.removesuffix(".0") for x in r] for r in ours] == [[x.removesuffix(".0") for x in r] for r in theirs]


# 11 filter audit

def brute_audit(docs, labels):
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    rows = []
    for doc_id, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        if doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs):
            fails.add("E")
        rows.append((source or "", fails, doc_id in good, doc_id in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone, before = [r for r in left if letter in r[1]], left
                left = [r for r in left if letter not in r[1]]
                failing = [r for r in own if letter in r[1]]
                shapley[letter] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {letter} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                assert len(before) == len(left) + len(gone)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def audited(spark, docs, labels):
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("part", "mask", "first", "copies", "text_id", "good", "n")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(5))
    found = audit.audit_filters(*audit.failure_counts(frame.repartition(3), marks)).collect()
    assert len(found) == len({(r.part, r.filter_order, r.step) for r in found})
    return {(r.part, r.filter_order, r.step): [r[f] for f in audit.FIELDS] for r in found}


def test_filter_audit_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", "word " * 250, " ".join(f"w{i}" for i in range(300)), "SHOUT IT", "a # b", " ".join(f"x{i}" for i in range(220)) + " 100 %", "É" * 10, "one line"]
    docs = [(i, rng.choice(texts) if rng.random() < 0.7 else f"text {i}", rng.choice(["web", "news", None, ""])) for i in range(120)]
    docs += [(None, "one line", "web"), (None, None, "only null"), (5, "one line", "web"), (-3, "SHOUT IT", "web")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    assert audited(spark, docs, labels) == brute_audit(docs, labels)
    assert audited(spark, [], labels) == {}
    assert audited(spark, docs[:5], []) == brute_audit(docs[:5], [])


def test_filter_audit_equals_sql(spark):
    same_as_sql(spark, "op11_filter_audit", ["part", "filter_order", "step"])


def test_adjacent_swaps_lead_through_all_orders():
    for n in range(6):
        order = list(range(n))
        seen = {tuple(order)}
        for at in audit.adjacent_swaps(n):
            order[at : at + 2] = order[at + 1], order[at]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n)


def test_diagram_shares_equal_nodes_and_keeps_counts():
    cells = {m: (1, 0, 0) for m in range(32)}
    diagram = audit.Diagram("ABCDE", cells)
    assert [len(level) for level in diagram.levels] == [1] * 5 and diagram.counts[diagram.root] == (32, 0, 0)
    for at in audit.adjacent_swaps(5):
        diagram.swap(at)
        assert [len(level) for level in diagram.levels] == [1] * 5 and diagram.counts[diagram.root] == (32, 0, 0)


# 12 conversation trie

def brute_trie(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + mine[h:])
    members, kids, leaves, saved = collections.defaultdict(list), collections.Counter(), collections.Counter(), collections.Counter()
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids.update(p[:-1] for p in members if p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = {p: ",".join(map(str, sorted(c for c in m if paths[c] == p))) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


def trie(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("path", "code", "n", "key", "base", "node", "first")})
    found = prefixes.conversation_trie(prefixes.rebuilt(prefixes.conversation_paths(frame.repartition(3)))).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *[r[c] for c in (*prefixes.FINAL[3:], "ends_sha256")]) for r in found)


@pytest.mark.parametrize("shard_turns", [25, 400_000])
def test_trie_equals_brute_force(spark, monkeypatch, shard_turns):
    for name, value in (("PADDED", 3), ("SHARD_TURNS", shard_turns), ("RANGE_ENDS", 60), ("CHUNK_IDS", 3)):
        monkeypatch.setattr(prefixes, name, value)
    rng = random.Random(3)
    rows = [(c, t, rng.choice("ua"), rng.choice(["x", "yé", "z"])) for c in range(80) for t in range(rng.choice([1, 1, 2, 3, 5, 12]))]
    rows += [(1000 + i, t, "u", "same") for i in range(100) for t in range(10)]  # copies, and a first turn that many share
    rows += [(None, 1, "u", "q"), (7000, None, None, None), (7000, 1, "u", None), (7001, 3, "a", "b"), (7001, 3, "a", "b"), (7001, 3, "b", "a"), (-4, 0, "u", "negative"), (7003, 0, "ab", "c"), (7004, 0, "a", "bc")]
    rows += [(8005, t, "u", str(t)) for t in range(70)] + [(8006, t, "u", str(t % 69)) for t in range(70)]  # longer than a matrix is wide
    rng.shuffle(rows)
    assert trie(spark, rows) == brute_trie(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "u", "x")], [(1, 0, "u", "only")], [(c, 0, "u", "all the same") for c in range(40)]])
def test_small_tries(spark, rows):
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_equals_sql(spark):
    same_as_sql(spark, "op12_conversation_trie", ["depth", "conv_id"])


# 13 language model

def brute_scores(docs, mu):
    def tokens(text):
        return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({65 + i: 97 + i for i in range(26)})) + [" "]

    def learnt(doc_id):
        return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 != 1

    one, two = collections.Counter(), collections.Counter()
    for doc_id, text in docs:
        if learnt(doc_id):
            own = tokens(text)
            one.update(own)
            two.update(zip([" ", *own], own, strict=False))
    space = sum(one.values()) + 0.5 * (len(one) + 1)
    rows = []
    for doc_id, text in docs:
        own = tokens(text)
        base = [(one[w] + 0.5) / space for w in own]
        pair = [(two[v, w] + mu * b) / (one[v] + mu) for v, w, b in zip([" ", *own], own, base, strict=False)]
        rows.append((str(doc_id), learnt(doc_id), len(own), sum(one[w] > 0 for w in own), sum(one.values()), round(sum(map(math.log10, base)), 7), round(sum(map(math.log10, pair)), 7)))
    return sorted(rows)


def lm_scores(spark, docs, mu):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("train", "chunk", "words", "tokens", "kind", "score")})
    found = lm.score_texts(frame.repartition(5), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, mu).collect()
    return sorted((str(r.doc_id), r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 7), round(r.score, 7)) for r in found)


@pytest.mark.parametrize("chunk, shard, step", [(2_000, 150, 4), (4 << 20, 1_000_000, 1 << 15)])
def test_lm_scores_equal_brute_force(spark, monkeypatch, chunk, shard, step):
    for name, value in (("CHUNK_TEXT", chunk), ("SHARD_WORDS", shard), ("SHARD_TOKENS", shard), ("SAMPLE_STEP", step)):
        monkeypatch.setattr(lm, name, value)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "the", "The"]
    docs = [(i, " ".join(rng.choices(words[: rng.randint(3, 63)], k=rng.randint(0, 60)))) for i in range(150)]
    docs += [(None, "x the"), (None, None), (500, None), (501, ""), (502, " the\tthe\n"), (3, "the the"), (3, "the the"), (600, "long " * 60), (601, "y" * 30_000)]
    assert lm_scores(spark, docs, 3.0) == brute_scores(docs, 3.0)  # no pair is counted more than 64 times, so all codes are exact
    for some in ([], docs[-3:-2], [(None, "nothing to learn from")]):
        assert lm_scores(spark, some, 3.0) == brute_scores(some, 3.0)


def test_lm_query_is_whole_and_learns(spark):
    scored = {r.doc_id: r for r in queries.op13_lm_scoring(spark, SF).collect()}
    docs = [(r.doc_id, r.text) for r in shared.table(spark, SF, "documents").select("doc_id", "text").collect()]
    wanted = brute_scores(docs, lm.MU)
    assert len(scored) == len(docs)
    for doc_id, learnt, n_tokens, n_known, n, base, score in wanted:
        r = scored[int(doc_id)]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learnt, n_tokens, n_known, n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and abs(r.score - score) < 0.018 * n_tokens  # codes of frequent pairs are off by 4 % at most
    held = [r for r in scored.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 1), (1, 1 << 62), (10, 3), (1000, 50), (1000, 10**6), (5000, 1 << 62)):
        values = np.sort(rng.integers(0, top, n).astype(np.uint64))
        found = lm.EliasFano.of(values)
        assert (found[np.arange(n)] == values).all()
        asked = np.concatenate((values, rng.integers(0, top + 3, 500).astype(np.uint64), np.zeros(1, np.uint64)))
        at, same = found.successor(asked)
        assert (at == np.searchsorted(values, asked)).all() and (same == np.isin(asked, values)).all()
        assert n < 1000 or sum(a.nbytes for a in found.arrays()) < n * (math.log2(max(2, top / n)) + 5) / 8 + 100


def test_pair_trie_and_codes():
    rng = np.random.default_rng(2)
    contexts, words = rng.integers(0, 1 << 63, 200, dtype=np.uint64), rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    pairs = np.unique(np.stack([rng.choice(contexts, 5000), rng.choice(words, 5000)], 1), axis=0)
    counts = rng.integers(1, 300, len(pairs))
    built = lm.PairTrie(pairs[:, 0], pairs[:, 1], counts)
    known = {tuple(p): int(c) for p, c in zip(pairs.tolist(), lm.code_of(counts), strict=True)}
    asked = np.stack([rng.choice(np.append(contexts, np.uint64(7)), 5000), rng.choice(np.append(words, np.uint64(9)), 5000)], 1)
    assert built.find(asked[:, 0], asked[:, 1]).tolist() == [known.get(tuple(p), 0) for p in asked.tolist()]
    assert built.bytes < 5 * len(pairs)
    every = np.concatenate((np.arange(1, 3000), [10**6, 10**8]))
    assert (np.abs(lm.codebook()[lm.code_of(every)] / every - 1) < 0.045).all() and (lm.codebook()[lm.code_of(np.arange(1, 65))] == np.arange(1, 65)).all()
