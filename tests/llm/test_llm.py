"""The training-data operators against brute force, exact round trips and held-out accuracy, and their odd cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critiq.llm import decontam, language, licenses, mixing, neardup, neighbours, quality, queries, secrets, shared, tokens, toxicity

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "en", None, 0), (2, "", None, "b", 0), (3, "  \n\t", "en", "b", 0), (4, "same words here again and again", "en", "a", 1), (5, "same words here again and again", "en", "a", 1), (6, "x" * 30000 + " end", "de", "a", 1), (7, "ok", "fr", None, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated texts, and columns whose names the operators use inside."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return rows.withColumns({c: F.lit("clash") for c in ("key", "score", "n", "spans", "row", "label", "size", "copies", "bands", "part")})


@pytest.fixture(scope="module")
def docs(spark):
    return shared.table(spark, SF, "documents")


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({65 + i: 97 + i for i in range(26)}))


def test_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"ab cd ab", np.uint8)
    h = shared.Hasher(data)(np.array([0, 3, 6]), np.array([2, 5, 8]))
    assert h[0] == h[2] != h[1] and int(h[0]) == shared.hash_text("ab")


# 1 secrets

def brute_secrets(text):
    text = text or ""
    word = r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(word, text) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secrets_equal_brute_force(spark, docs):
    got = {r.doc_id: r for r in queries.op1_secrets(spark, SF).collect()}
    for i, text in texts(docs).items():
        want = brute_secrets(text)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))


def test_base_patterns():
    assert [brute_secrets(t) == ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, e, k in secrets.base_spans(t)) for t in ('Token= "abcdefgh1" é PASSWD:short', "AKIA" + "B" * 12 + "c", "é" * 3 + "f" * 40 + "g" + "0" * 31, "apikey=aaaaaaaaaa secret : 'bbbbbbbb'", "ſecret=abcdefghij")] == [True] * 5


def test_network_learns_held_out_findings():
    rng = np.random.default_rng(0)
    findings = []
    for i in range(400):
        good = "".join(rng.choice(list("0123456789abcdef"), 24)) if i % 2 else "".join(rng.choice(list("0123456789"), 16))
        text = f"some words before {good} and after"
        findings.append((text, 18, 18 + len(good), i % 2))
    net = secrets.fit(findings[:300], epochs=12)
    codes, own, _ = secrets.encode_findings(findings[300:])
    assert ((net.probability(codes, own) >= net.threshold) == (np.array([f[3] for f in findings[300:]]) == 1)).mean() > 0.95
    assert secrets.fit([]).threshold > 1


def test_threshold_recalls_held_out_secrets():
    """Labels that overlap: the threshold is the held-out quantile itself, below one half if need be, and keeps the recall on new findings."""
    rng = np.random.default_rng(1)

    def draw(n):
        # a fifth of the secrets look just as other findings do
        rows = []
        for i in range(n):
            odd = i % 2 and rng.random() < 0.8
            rows.append((f"we saw {''.join(rng.choice(list('abcdefABCDEF0123456789' if odd else '0123456789'), 20))} there", 7, 27, i % 2))
        return rows

    net = secrets.fit(draw(1500))
    fresh = draw(1000)
    codes, own, _ = secrets.encode_findings(fresh)
    p, y = net.probability(codes, own), np.array([f[3] for f in fresh])
    assert net.threshold < 0.5 and (p[y == 1] >= net.threshold).mean() >= secrets.RECALL - 0.02


def test_every_window_of_a_long_candidate_is_seen():
    of, starts, ends = secrets.windows(np.array([0, 100]), np.array([40, 290]))
    assert (of == 0).sum() == 1 and starts[0] == 0 and ends[0] == 40 and (ends - starts <= secrets.ROOM).all()
    seen = set().union(*[range(a, b) for i, a, b in zip(of, starts, ends, strict=True) if i == 1])
    assert seen == set(range(100, 290))
    # the telling part stands in the middle of a long run
    rng = np.random.default_rng(2)
    digits = lambda n: "".join(rng.choice(list("0123456789"), n))
    letters = lambda n: "".join(rng.choice(list("abcdefABCDEF"), n))
    net = secrets.fit([(f"see {digits(24) if i % 2 else letters(23) + '1'} now", 4, 28, 1 - i % 2) for i in range(600)])
    block = secrets.block_of(pa.array([f"see {digits(80)}{letters(60)}{digits(80)} now", f"see {digits(220)} now"]))
    score = net.scores(block)
    assert block.doc.tolist() == [0, 1] and score[0] >= net.threshold > score[1]


def test_candidates():
    def found(text):
        block = secrets.block_of(pa.array([text]))
        return [text[a:b] for a, b in zip(block.starts, block.ends, strict=True)]

    assert found("é plainwords Capitalised well-known-words") == [] and found("ab1cd 1234567") == []
    assert found("éé abcdefg1, camelCaseWord; dGhpc/9pcyBh a_long_name=xyz") == ["abcdefg1", "camelCaseWord", "dGhpc/9pcyBh", "a_long_name=xyz"]


def test_secrets_odd(spark, odd):
    secret = "password=abcdefgh1 then " + "f" * 40
    more = spark.createDataFrame([(8, "x " * 100_000 + secret), (8, secret), (9, secret)], "doc_id long, text string")
    rows = odd.unionByName(more, allowMissingColumns=True)
    got = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in secrets.scan_secrets(rows, secrets.train_secrets(rows)).collect()]
    want = [("assign", 0, 18), ("hex", 24, 64)]
    assert len(got) == 10 and all(not spans for i, spans in got if i < 4 or i == 7)
    assert [[s for s in spans if s[0] != "model"] for i, spans in got if i == 9] == [want]
    assert sorted([s for s in spans if s[0] != "model"] for i, spans in got if i == 8) == sorted([want, [(k, a + 200_000, b + 200_000) for k, a, b in want]])
    assert secrets.scan_secrets(odd.limit(0), secrets.train_secrets(odd.limit(0))).count() == 0


def test_model_spans_on_documents(spark):
    """Recall and precision of the network on candidates of documents that it has not seen, the patterns' findings being the labels."""
    docs = shared.table(spark, "/root/testdata/sf0.1", "documents")
    net = secrets.train_secrets(docs.filter("doc_id % 2 != 0"))
    block = secrets.block_of(pa.array([r.text for r in docs.filter("doc_id % 2 = 0").collect()]))
    hit, found = block.overlapped(), net.scores(block) >= net.threshold
    assert hit.sum() > 50 and found[hit].mean() >= secrets.RECALL - 0.02 and hit[found].mean() >= 0.95


def test_secrets_learn_from_given_findings(spark):
    """The same ones on every run and partitioning; what is no finding is left out."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        word = "".join(rng.choice(list("abcdef0123456789" if i % 2 else "aeiostrn"), 12))
        rows.append((f"it says {word} here", 8, 20, i % 2))
    bad = [(None, 0, 9, 1), ("short", 0, 50, 1), ("backwards text", 9, 3, 1), ("no label here", 0, 8, None)]
    schema = "text string, start int, end int, label int"
    frame = spark.createDataFrame(rows + bad, schema).withColumn("doc_id", F.lit(1))
    a, b = (secrets.train_secrets(None, frame.repartition(n), documents=10) for n in (1, 5))
    assert a.threshold == b.threshold and all((a.params[k] == b.params[k]).all() for k in a.params)
    docs = spark.createDataFrame([(1, "it says 0a1b2c3d4e5f here and 77aa99bb11cc too"), (2, "it says nothing")], "doc_id long, text string")
    assert {r.doc_id: len(r.spans) for r in secrets.scan_secrets(docs, a).collect()} == {1: 2, 2: 0}


# 2 language

def test_language_of_held_out_documents(spark):
    got = queries.op2_language(spark, "/root/testdata/sf0.01").join(shared.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_odd(spark, odd):
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify_language(odd, language.train_language(odd)).collect()}
    assert len(found) == 7 and all(found[i] == ("und", 0) for i in (1, 2, 3)) and found[7][0] != "und"
    assert language.fit([], []).predict(pa.array(["a"]))[0] == ["und"]
    profile = language.profiles(pa.array(["123 … !", "", "ab"]))
    assert not profile[:2].any() and profile[2].any()


def test_every_language_can_be_predicted(spark):
    """Many languages, also ones with a single text, each an alphabet of its own."""
    rows = [(i, " ".join(chr(0x4E00 + 40 * (i % 230) + j) * 3 for j in range(30)), f"l{i % 230:03}") for i in range(461)]
    rows = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    classifier = language.train_language(rows)
    got = language.identify_language(rows, classifier).join(rows, "doc_id").collect()
    assert len(classifier.languages) == 230 and all(r.lang == r.lang_pred for r in got)


def test_language_score_equals_brute_force():
    """Profiles as sets of n-grams, kernels, Nystrom features and the ridge solution, all spelled out."""
    texts = ["the cat and the dog", "a dog on the hill", "der hund und die katze", "ein hund auf dem berg", "le chat et le chien"]
    langs = ["en", "en", "de", "de", "fr"]
    fitted = language.fit(texts, langs)

    # a gap, then the letters of each word, A-Z in lower case, with one gap between words: all runs of 1 to 4 bytes
    sets = []
    for text in texts:
        data = b"\0" + re.sub(r"[^a-z]+", "\0", text.lower()).encode() if not text[:1].isalpha() else re.sub(r"[^a-z]+", "\0", text.lower()).encode()
        grams = {data[i : i + n] for n in range(1, 5) for i in range(len(data) - n + 1)}
        sets.append(grams)
        assert language.profiles(pa.array([text])).sum() == len(grams), "no two n-grams of these texts share a bucket"
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    values, vectors = np.linalg.eigh(kernel)
    z = np.hstack((kernel @ vectors / np.sqrt(values), np.ones((5, 1))))
    names = sorted(set(langs))
    y = np.array([[1.0 if x == n else -1.0 for n in names] for x in langs])
    weight = np.diag([5 / langs.count(x) / 3 for x in langs])
    ridge = language.RIDGE * 5 * np.diag([1, 1, 1, 1, 1, 0])
    want = z @ np.linalg.solve(z.T @ weight @ z + ridge, z.T @ weight @ y)
    assert fitted.languages == names and np.allclose(fitted.margins(language.profiles(pa.array(texts))), want, atol=1e-3)


# 3 near duplicates

def brute_components(rows, k, percent):
    sets = {}
    for i, text in rows.items():
        w = words(text)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(rows)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= percent * large:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k, percent, rows", [(3, 85, 8), (5, 80, 6)])
def test_components_equal_brute_force(spark, docs, k, percent, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, k, percent, rows).collect()}
    assert got == brute_components(texts(docs), k, percent)


def test_hot_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    rows = {}
    for i in range(150):
        w = list(base)
        for j in rng.choice(60, rng.integers(0, 6), replace=False):
            w[j] = f"new{rng.integers(10**6)}"
        rows[i] = " ".join(w)
    got = neardup.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, 3, 85)


def test_sketch_fills_and_agrees():
    value, offsets = neardup.shingle_sets(pa.array(["a", "a b c d", None, "a b c d"]), 3)
    grid = neardup.sketches(value, offsets, 64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    assert (grid[[0, 1, 3]] != top).all() and (grid[2] == top).all() and (grid[1] == grid[3]).all()


def test_near_duplicates_odd(spark, odd):
    got = {r.doc_id: r for r in neardup.near_duplicates(odd).collect()}
    assert [got[i].n_shingles for i in (1, 2, 3, 7)] == [0, 0, 0, 1] and got[5].component_id == 4 and not got[5].kept and got[3].kept
    assert neardup.near_duplicates(odd.limit(0)).count() == 0
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in neardup.components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# 4 toxicity, 7 quality

def accuracy(rows, labels, label):
    want = {r.doc_id: r[label] for r in labels.collect()}
    return [(r, want[r.doc_id]) for r in rows.filter("held_out").collect() if want.get(r.doc_id) is not None]


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    pairs = accuracy(queries.op4_toxicity(spark, sf), shared.table(spark, sf, "labels"), "toxic")
    assert np.mean([r.predicted for r, y in pairs if y == 1]) > 0.75 and np.mean([r.predicted for r, y in pairs if y == 0]) < 0.03


def test_marginals_equal_brute_force():
    tokens_ = toxicity.tokens_of(pa.array(["a b c. d e", "f"]))
    rng = np.random.default_rng(1)
    tagger = toxicity.Tagger(rng.normal(size=toxicity.TABLE), rng.normal(size=(2, 2)), 0.3)
    emit = tagger.weights[tokens_.columns].sum(1)
    want = np.zeros(len(emit))
    for chain in np.unique(tokens_.chain):
        at = np.flatnonzero(tokens_.chain == chain)
        weight = {}
        for path in np.ndindex(*[2] * len(at)):
            w = emit[at] @ np.array(path) + 0.3 * path[0] + sum(tagger.moves[a, b] for a, b in zip(path, path[1:], strict=False))
            weight[path] = np.exp(w)
        want[at] = [sum(w for p, w in weight.items() if p[i]) / sum(weight.values()) for i in range(len(at))]
    assert np.allclose(tagger.marginals(tokens_), want)


def test_toxicity_odd(spark, odd):
    tagger = toxicity.fit([f"you are a vile thing {i}" for i in range(80)] + [f"you are a nice thing {i}" for i in range(80)], [1] * 80 + [0] * 80)
    got = {r.doc_id: r for r in toxicity.score_toxicity(odd, tagger).collect()}
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got.values()) and got[1].spans == []
    one = toxicity.score_toxicity(spark.createDataFrame([(1, "Ünd: so vile it is.")], "doc_id long, text string"), tagger).first()
    assert one.predicted == 1 and [(s.start, s.end) for s in one.spans] == [(8, 12)]
    assert toxicity.score_toxicity(odd, toxicity.fit([], [])).count() == 7


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    pairs = accuracy(queries.op7_quality(spark, sf), shared.table(spark, sf, "labels"), "quality")
    assert np.mean([r.predicted for r, y in pairs if y == 1]) > 0.98 and np.mean([r.predicted for r, y in pairs if y == 0]) < 0.1


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(2)
    machine = quality.Machine(0.1, rng.normal(size=quality.WIDTH), rng.normal(size=(quality.WIDTH, quality.RANK)))
    columns, values, starts = quality.features(pa.array(["one two two", None, "Three!"]))
    got = machine.margin(columns, values, starts)
    for i in range(3):
        c, v = columns[starts[i] : starts[i + 1]], values[starts[i] : starts[i + 1]]
        pairs = sum(machine.factors[c[a]] @ machine.factors[c[b]] * v[a] * v[b] for a in range(len(c)) for b in range(a + 1, len(c)))
        assert np.isclose(got[i], 0.1 + machine.linear[c] @ v + pairs)


def test_quality_odd(spark, odd):
    machine = quality.fit(["good text here", "bad bad bad"] * 20, [1, 0] * 20)
    assert quality.score_quality(odd, machine).count() == 7 and quality.keep_good(odd, machine, 0.0).collect() == odd.collect()
    assert quality.score_quality(odd, quality.fit([], [])).count() == 7 and quality.score_quality(odd.limit(0), machine).count() == 0


def test_marginals_cross_long_sentences():
    """A sentence of 400 tokens is one chain: a strong token at its start moves the marginals behind token 128 by its moves alone."""
    text = pa.array(["start " + "word " * 400])
    found = toxicity.tokens_of(text)
    assert found.chain.max() == 0 and found.place.max() == 400
    weights = np.zeros(toxicity.TABLE)
    weights[found.columns[0, 0]] = 9.0
    tagger = toxicity.Tagger(weights, np.array([[5.0, -5.0], [-5.0, 5.0]]), 0.0)
    assert tagger.marginals(found)[200] > 0.9


@pytest.mark.parametrize("per_label", [100, 400])
def test_toxicity_means_the_same_at_every_cap(spark, per_label):
    """Texts that tell nothing score the stated share, whatever the shares in the sample are."""
    texts = [(i, ("you vile thing" if i % 10 == 0 else "you nice thing") + f" {i}" if i % 5 == 0 else "plain words", int(i % 10 == 0)) for i in range(4000)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    tagger = toxicity.train_toxicity(rows, rows, per_label=per_label)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(rows.filter("doc_id < 11"), tagger).collect()}
    assert got[0] > 0.9 and got[1] < 0.05 and got[5] < 0.05


def test_quality_uses_metadata(spark):
    """n_chars is a feature of its own: equal texts whose n_chars tells good from bad."""
    rows = spark.createDataFrame([(i, "the same words", 14 if i % 2 else 5000, i % 2) for i in range(200)], "doc_id long, text string, n_chars long, quality int")
    machine = quality.train_quality(rows, rows.select("doc_id", "quality"))
    got = {r.doc_id: r.predicted for r in quality.score_quality(rows, machine, 0.5).collect()}
    assert all(p == i % 2 for i, p in got.items())
    assert {r.doc_id % 2 for r in quality.keep_good(rows, machine, 0.5).collect()} == {1}
    assert quality.score_quality(rows.drop("n_chars"), machine).count() == 200


def test_quality_query_equals_brute_force(spark):
    """Each document's score of the query is the machine's margin with every pair of features spelled out."""
    docs, labels = shared.table(spark, SF, "documents"), shared.table(spark, SF, "labels")
    machine = quality.train_quality(docs, labels, shared.fold("doc_id", 5) != 0)
    got = {r.doc_id: r.score for r in queries.op7_quality(spark, SF).collect()}
    for r in docs.filter("length(text) < 400").limit(40).collect():
        c, v, _ = quality.features(pa.array([r.text]), pa.array([r.n_chars]))
        f = machine.factors[c].astype(float) * v[:, None]
        pairs = (f @ f.T)[np.triu_indices(len(c), 1)].sum()
        z = machine.bias + machine.linear[c] @ v + pairs
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-5


@pytest.mark.parametrize("per_label", [30, 1000])
def test_quality_means_the_same_at_every_cap(spark, per_label):
    """Texts that tell nothing score the share of the labels over all rows, also where the sample takes as many of each."""
    rows = spark.createDataFrame([(i, "plain words that tell nothing", int(i % 10 != 0)) for i in range(600)], "doc_id long, text string, quality int")
    got = quality.score_quality(rows.limit(1), quality.train_quality(rows, rows, per_label=per_label)).first().score
    assert abs(got - 0.9) < 0.03


# 5 neighbours

def test_recall_and_exact_scores(spark):
    rows = shared.table(spark, "/root/testdata/sf0.01", "embeddings")
    x = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    got = collections.defaultdict(list)
    for r in queries.op5_neighbours(spark, "/root/testdata/sf0.01").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = []
    assert set(got) == {i for i in x if i % 20 == 0}
    for q, found in got.items():
        found.sort()
        best = sorted(((-(x[q] @ x[i]), i) for i in x if i != q))[:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(s - x[q] @ x[i]) < 1e-12 for _, i, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits.append(len({i for _, i in best} & {i for _, i, _ in found}) / 20)
    assert np.mean(hits) >= 0.9


def test_neighbours_odd(spark):
    rows = [(i, [float(i), 1.0]) for i in range(6)] + [(6, None), (7, [0.0, 0.0]), (8, [float("nan"), 1.0]), (9, [None, 1.0]), (10, [float("inf"), 0.0]), (11, [1.0, 1.0]), (0, [0.0, 1.0]), (None, [1.0, 2.0]), (12, [1.0])]
    frame = spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]))
    got = neighbours.search(frame, frame.filter("vec_id IN (0, 6, 7, 11)"), k=20).collect()
    assert {r.query_id for r in got} == {0, 11}
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 11] == [(5, 6.0), (4, 5.0), (3, 4.0), (2, 3.0), (1, 2.0), (0, 1.0)]
    assert neighbours.search(frame.limit(0), frame, k=3).count() == 0


def test_recall_where_the_graph_matters(spark):
    """Twenty thousand vectors in 64 dimensions, far more than a beam or a leaf holds; queries in blocks against all rows."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20_000, 64)).astype(np.float32) * np.exp(0.3 * rng.normal(size=(20_000, 1))).astype(np.float32)
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    got = neighbours.search(frame, frame.filter("vec_id % 200 = 0")).toPandas()
    found = got.groupby("query_id")["vec_id"].apply(set)
    recall = []
    for q in range(0, len(x), 200):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        recall.append(len(found[q] & set(np.argsort(-s)[:20])) / 20)
    assert len(found) == 100 and (got.groupby("query_id").size() == 20).all() and np.mean(recall) >= 0.9


def test_neighbours_of_a_hub(spark, monkeypatch):
    """A frontier that all queries send to one bucket gives the same neighbours in blocks as in one piece."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(150)] + [(150, [50.0, 50.0, 50.0, 50.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("code", "q", "s", "bucket")})
    whole = {tuple(r) for r in neighbours.search(frame, frame, k=5).collect()}
    monkeypatch.setattr(neighbours, "FRONTIER", 8_000)
    assert {tuple(r) for r in neighbours.search(frame, frame, k=5).collect()} == whole and len(whole) == 5 * 151


def test_equal_vectors_go_by_id(spark):
    """Four vectors of many copies among others: the answers are those of brute force, ties included, and all copies ask alike."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 8)).astype(np.float32)
    for c in range(4):
        x[c::7] = rng.normal(size=8).astype(np.float32) * (2 if c < 2 else 0.5)
    ids = rng.permutation(len(x)) * 3
    frame = spark.createDataFrame(pa.table({"vec_id": ids, "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    got = neighbours.search(frame, frame.filter("vec_id % 40 = 0"))
    found = {q: g.sort_values("rank") for q, g in got.toPandas().groupby("query_id")}
    y, by_id, right = x.astype(float), {int(i): at for at, i in enumerate(ids)}, []
    assert set(found) == {i for i in by_id if i % 40 == 0}
    for q, g in found.items():
        s = np.array([sum(a * b for a, b in zip(v, y[by_id[q]], strict=True)) for v in y])
        want = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        assert list(g["rank"]) == list(range(1, 21)) and list(g["score"]) == [s[by_id[i]] for i in g["vec_id"]]
        right.append(len(set(want) & set(g["vec_id"])) / 20)
    assert np.mean(right) > 0.99 and min(right) >= 0.9


def test_all_vectors_equal_or_tiny(spark):
    same = spark.createDataFrame([(i, [0.5, -1.0]) for i in range(100)], "vec_id long, embedding array<double>")
    got = neighbours.search(same, same.filter("vec_id IN (0, 3, 50)"), k=3).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {(0, 1, 1), (0, 2, 2), (0, 3, 3), (3, 1, 0), (3, 2, 1), (3, 3, 2), (50, 1, 0), (50, 2, 1), (50, 3, 2)}
    tiny = spark.createDataFrame([(1, [5e-324, 0.0]), (2, [1e-320, 5e-324]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.vec_id) for r in neighbours.search(tiny, tiny, k=2).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}


# 6 decontamination

ITEM = "A train leaves Paris at 9 and runs 120 km to Lyon while another leaves Lyon at 9 and meets it after 60 km."


def test_decontamination(spark):
    cases = {
        1: "Noise. " + ITEM + " More noise.", 2: "Noise. " + ITEM.replace("Paris", "Rome").replace("Lyon", "Pisa").replace("120", "250").replace(" 9 ", " 7 ").replace("60", "125"),
        3: ITEM.replace("to Lyon", "to Milan"), 4: "A train leaves the yard and nothing else happens here at all today my friends.", 5: None, 6: "", 7: " ".join(ITEM.split()[:9]),
    }
    docs = spark.createDataFrame([(i, t, "clash") for i, t in cases.items()] + [(None, ITEM, "clash")], "doc_id long, text string, code string")
    bench = spark.createDataFrame([(10, ITEM), (11, None), (12, "two words"), (13, "five small words stand here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.share for r in decontam.contaminated(docs, bench).collect()}
    assert {k for k in got if k[1] == 10} == {(1, 10), (2, 10)}, "the third uses one slot for two values"
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), bench).count() == 0
    assert sorted(r.doc_id or 0 for r in decontam.drop_contaminated(docs, bench).collect()) == [0, 3, 4, 5, 6, 7]


def test_decontamination_of_verbatim_passages(spark):
    """Items of slots alone, short items, and copies in other case, each between other words."""
    items = {1: "What is 3 + 4 * 12 - 7 / 5 + 6?", 2: "Anna Berta Carla Dora Emil Fritz Georg Hans Ida", 3: "two words", 4: "Ask Maria about Oslo and Bergen before noon today", 5: "Paris hosts many large fairs", 6: "東京の首都"}
    copies = {1: items[1], 2: items[2], 3: items[3], 4: items[4].upper(), 14: items[4].lower(), 5: items[5], 6: items[6]}
    docs = spark.createDataFrame([(i, f"here stands {t} and no more") for i, t in copies.items()] + [(20, "What is 3 + 3 * 11 - 2 / 4 + 1? two other words, Anna Fritz")], "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.share for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(i, i % 10): 1.0 for i in copies}


def held(spark, items, docs):
    bench, texts = (spark.createDataFrame(list(x.items()), f"{k}_id long, text string") for x, k in ((items, "item"), (docs, "doc")))
    return {(r.doc_id, r.item_id): r.n_items for r in decontam.contaminated(texts, bench).collect()}


def test_decontamination_of_items_of_numbers_and_of_few_words(spark):
    """Re-parameterised arithmetic, short questions, and names that open a sentence; numbers alone are no template."""
    items = {1: "What is 12 + 45 * 3 - 7 / 2 ?", 2: "Compute 3 * 4 + 5 .", 3: "Capital of France?", 4: "Tom has 3 apples and gives 2 away", 5: "Sam has 4 apples and gives 1 away", 6: "12 45 7"}
    docs = {
        1: f"So: {items[1]} he said", 2: "one asks, capital of france and goes", 3: "What is 99 + 1 * 8 - 6 / 4 ? Capital of Spain?", 4: "Compute 7 * 9 + 2 .", 5: "we compute 7 * 9 + 2 here",
        6: "So it goes. Bob has 7 apples and gives 5 away. Nice", 7: "yes, Bob has 7 apples and gives 5 away", 8: "Bob has 7 apples and gives 7 away", 9: "SAM HAS 4 APPLES AND GIVES 1 AWAY", 10: "8 9 10", 11: "see 12 45 7",
        12: "What is 99 - 1 * 8 - 6 / 4 ?", 13: "Compute 7 * 9 - 2 .",
    }
    assert held(spark, items, docs) == {(1, 1): 1, (2, 3): 1, (3, 1): 1, (3, 3): 1, (4, 2): 1, (5, 2): 1, (6, 4): 2, (7, 4): 2, (9, 5): 1, (11, 6): 1}


def test_items_of_one_template_are_one_class(spark, monkeypatch):
    """Sixty items and sixty documents of a template, and what differs in which slots are equal, give a row per document and class."""
    sentence = "{} walks to the market with {} coins and comes home with {} apples for {}"
    names = [chr(65 + i // 8) + chr(97 + i % 8) for i in range(60)]
    items = {i: sentence.format(f"{n}anna", i, i + 100, f"{n}anna") for i, n in enumerate(names)} | {100 + i: sentence.format(f"{n}bert", i, i + 100, f"{n}carl") for i, n in enumerate(names)}
    docs = {i: "well, " + sentence.format(f"{n}eve", i + 500, i + 700, f"{n}eve") for i, n in enumerate(names)}
    sizes, write = {}, decontam.saved
    monkeypatch.setattr(decontam, "saved", lambda df, name: sizes.setdefault(name, []).append(out := write(df, name)) or out)
    # in the other class the two names differ, which voids the two windows that hold one
    assert held(spark, items, docs) == {(i, item): 60 for i in range(60) for item in (0, 100)}
    windows = max(len(t.split()) for t in docs.values())
    assert all(t.count() <= 60 * 2 * windows for name in ("hits", "lines") for t in sizes[name])


def test_decontamination_of_a_long_item_of_numbers(spark):
    """Ten thousand slots of a line are compared by grouping, not with each other."""
    numbers = [str(i * 7) for i in range(10_000)]
    text = "list the numbers " + " ".join(numbers)
    docs = {1: text, 2: text.replace(" 7 ", " 8 "), 3: "list the numbers " + " ".join(str(i * 3 + 1) for i in range(10_000))}
    assert held(spark, {1: text}, docs) == {(i, 1): 1 for i in docs}


def test_decontamination_voids_only_windows_with_a_torn_slot(spark):
    """One name of a long item is replaced in one of two places: what stands far from it still counts."""
    item = "Then Maria walks to the harbour where she meets Peter who sells nets and ropes to the sailors of the town while the old ferry takes seven guests to the other shore and brings them home before Maria sleeps"
    docs = spark.createDataFrame([(1, item.replace("Then Maria", "Then Paula"))], "doc_id long, text string")
    got = decontam.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    n = len(item.split()) - 7
    assert got.n_windows == n - 2 - 2 and abs(got.share - got.n_windows / n) < 1e-9


def test_decontamination_odd(spark):
    """Repeated ids with different texts, a very long text, nulls, and columns named as inside."""
    docs = [(1, "nothing here at all"), (1, "Noise. " + ITEM), (2, "word " * 200_000 + ". " + ITEM), (3, None), (None, ITEM), (2, "short")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("doc", "item", "w", "at", "raw", "form", "code", "told")})
    bench = spark.createDataFrame([(5, ITEM), (5, "an altogether other question about nothing much at all"), (5, None), (None, ITEM)], "item_id long, text string").withColumn("item", F.lit("clash"))
    assert sorted((r.doc_id, r.item_id, r.share) for r in decontam.contaminated(docs, bench).collect()) == [(1, 5, 1.0), (2, 5, 1.0)]


def test_decontamination_finds_what_substring_search_finds(spark):
    sf = "/root/testdata/sf0.01"
    items = {r.item_id: " ".join(words(r.text)) for r in shared.table(spark, sf, "benchmark").collect()}
    want = {(i, j) for i, t in texts(shared.table(spark, sf, "documents")).items() for j, item in items.items() if f" {item} " in f" {' '.join(words(t))} "}
    got = {(r.doc_id, r.item_id) for r in queries.op6_decontamination(spark, sf).collect()}
    assert want and want <= got and len(got - want) <= 0.1 * len(want)


def test_decontamination_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = {(d, i): (n, round(s, 9)) for d, i, n, s in con.execute(queries.ORACLES["op6_decontamination"]).fetchall()}
    assert {(r.doc_id, r.item_id): (r.n_windows, round(r.share, 9)) for r in queries.op6_decontamination(spark, sf).collect()} == want


def test_decontamination_runs_no_python(spark, docs):
    plan = decontam.contaminated(docs, shared.table(spark, SF, "benchmark"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 8 licenses

def brute_license(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({65 + i: 97 + i for i in range(26)}))
    at = {i: label for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()}
    return len(w), len(at), min(at, default=None), max(at, default=None), sorted(set(at.values()))


def blocks(text):
    return [b for b in re.split(r"[\n\r]|[.!?](?=[\x00-\x20]|$)", text or "") if b]


def test_licenses_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = shared.table(spark, sf, "documents")
    sets = licenses.template_words(licenses.TEMPLATES)
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for i, text in texts(docs).items():
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(text)
        held = [set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", b.lower())) for b in blocks(text)]
        met = {label for label, t in sets.items() for b in held if len(b & set(t)) >= 0.8 * len(t)}
        assert set(r.labels) == met | set(r.base_labels)


def test_licenses_odd(spark, odd):
    got = {r.doc_id: r for r in licenses.scan_licenses(odd).collect()}
    assert len(got) == 7 and (got[1].n_words, got[1].score, got[1].labels) == (0, 0.0, [])
    assert licenses.scan_licenses(odd.limit(0)).count() == 0
    text = "é MIT  License.\nmit-license, General\nPublic LICENSE"
    one = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (one.n_words, one.n_base, one.first_word, one.last_word, one.base_labels) == brute_license(text) == (8, 3, 1, 5, ["gpl", "mit"])


WRAPPED = {
    "mit-text": """ * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 *
 * The above copyright notice and this permission notice shall be included in all
 * copies or substantial portions of the Software.
 *
 * THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
 * IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
 * FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
 * AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
 * LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
 * OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
 * SOFTWARE.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "apache-2.0-header": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.""",
    "gpl-header": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.""",
    "mpl-2.0-header": """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}
WRAPPED["lgpl-header"] = WRAPPED["gpl-header"].replace("program", "library").replace("General", "Lesser General").replace("version 3", "version 2.1")
WRAPPED["agpl-header"] = WRAPPED["gpl-header"].replace("General", "Affero General")


def test_wrapped_license_texts(spark):
    """Each body and header as it is wrapped in files, between other lines, and the grants inside them."""
    also = {"mit-text": "mit-grant", "bsd-text": "bsd-terms", "isc-text": "isc-grant", "apache-2.0-header": "apache-2.0-terms"}
    assert set(WRAPPED) == {label for label in licenses.TEMPLATES if label.endswith(("-text", "-header"))}
    rows = [(i, f"some other words\nstand before it\n{text}\nand code follows\nhere") for i, text in enumerate(WRAPPED.values())]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in enumerate(WRAPPED):
        assert {label, also.get(label, label)} <= set(got[i].labels) and got[i].score >= 0.8, label


def test_templates_of_other_kinds(spark):
    """No templates, a template without words, and one with punctuation beyond ASCII, which belongs to words on both sides."""
    docs = spark.createDataFrame([(1, "Under the MIT license"), (2, "Alle „Rechte“ sind hier — vorbehalten für immer")], "doc_id long, text string")
    assert [(r.doc_id, r.labels, r.score) for r in licenses.scan_licenses(docs, {}).orderBy("doc_id").collect()] == [(1, ["mit"], 1.0), (2, [], 0.0)]
    found = licenses.scan_licenses(docs, {"none": "...", "own": "alle „Rechte“ sind — vorbehalten"}).orderBy("doc_id").collect()
    assert found[0].labels == ["mit"] and found[1].labels == ["own"]


def test_runs_equal_brute_force():
    rng = np.random.default_rng(3)
    doc = np.sort(rng.integers(0, 6, 300))
    first = np.searchsorted(doc, np.arange(6))
    word = rng.integers(-8, 7, 300)
    at = np.flatnonzero(word >= 0)
    starters = np.flatnonzero((word >= 0) & (word < 4))
    got = dict(zip(*licenses._best_runs(at, word[at], doc[at], first, starters, 9), strict=True))
    for d in range(6):
        own = word[doc == d]
        runs = [own[i : i + 9] for i in range(len(own))]
        assert got[d] == max(len(set(r[r >= 0])) for r in runs if ((r >= 0) & (r < 4)).any())


# 9 tokens

def test_token_files_round_trip(spark, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in queries.op9_token_output(spark, SF).collect()}
    start = 0
    for i, text in sorted(texts(docs).items()):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_encoder_on_white_space():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    cases = ["a  b", "\n\nx", " x", "x ", "it's 'sa <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>\n\n x", "", "'s.\n't", "×a÷b¿cɏdɐe", "a\tb\r\nc", "a\x1cb c", "  \n q", "", "a \nb", "a \n b", "123 abc!? ..x, y.", "日本 語。x", "x\u0085y a", "   ", "a　 b", "\n"]
    ids, offsets = tokens.Encoder(path)(pa.array(cases), 2)
    for i, (text, want) in enumerate(zip(cases, plain.encode_batch(cases, add_special_tokens=False), strict=True)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == [*want.ids, 2], text


def test_encoder_on_every_code_point():
    """64 code points a text, each between letters, digits, marks and spaces."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    encoder, want = tokens.Encoder(path), 0
    for at in range(0, len(points), 1 << 16):
        cases = ["".join(f"a{c}1{c}!{c} {c}" for c in points[i : i + 64]) for i in range(at, min(at + (1 << 16), len(points)), 64)]
        ids, offsets = encoder(pa.array(cases), 2)
        for i, found in enumerate(plain.encode_batch(cases, add_special_tokens=False)):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == [*found.ids, 2], hex(ord(cases[i][1]))


def test_encoder_on_random_texts_with_a_small_memory():
    """Letters, white space of all kinds, symbols and an added token in any order, against the library's default settings."""
    import public_tokenizers

    rng = np.random.default_rng(4)
    marks = np.array(["a", "b", " ", " ", "\n", "\t", "1", ".", "'", "s", "é", "日", "\u0085", "<|endoftext|>", "Z", "\u3000", "\u0558", "\x1f", "\r\n"])
    cases = ["".join(rng.choice(marks, rng.integers(0, 15))) for _ in range(4000)]
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.memory.most = 50
    want = encoder.library.encode_batch(cases, add_special_tokens=False)
    for at in range(0, len(cases), 100):
        ids, offsets = encoder(pa.array([None, *cases[at : at + 100]]), 2)
        assert ids[: offsets[1]].tolist() == [2]
        assert [ids[a:b].tolist() for a, b in zip(offsets[1:-1], offsets[2:], strict=True)] == [[*w.ids, 2] for w in want[at : at + 100]]
    assert len(encoder.memory.rows) < 1000


def test_encoder_of_another_make(tmp_path):
    """A tokenizer that lower-cases first is never cut: texts go to the library whole."""
    import public_tokenizers
    from tokenizers import Tokenizer, normalizers

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.normalizer = normalizers.Lowercase()
    other.save(f"{tmp_path}/lower.json")
    encoder = tokens.Encoder(f"{tmp_path}/lower.json")
    ids, offsets = encoder(pa.array(["One TWO", "", None]), 2)
    assert not encoder.cuts and ids.tolist() == [*other.encode("one two").ids, 2, 2, 2] and offsets.tolist() == [0, len(ids) - 2, len(ids) - 1, len(ids)]


def test_selective_reads(spark, docs, tmp_path):
    """Metadata are read without `ids`; small pages with an index and small row groups let a reader of few documents skip the rest."""
    import public_tokenizers
    import pyarrow.parquet as pq

    tokens.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), f"{tmp_path}/t", files=1, row_group_bytes=1 << 16, page_bytes=1 << 12, page_rows=20)
    meta = [pq.ParquetFile(p).metadata for p in tmp_path.glob("t/*.parquet")]
    groups = [m.row_group(i) for m in meta for i in range(m.num_row_groups)]
    assert len(groups) > 1 and all(g.column(c).has_offset_index and g.column(c).has_column_index for g in groups for c in (0, 4))
    spans = [(s.min, s.max) for s in (g.column(0).statistics for g in groups)]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)), "each group has an id range of its own"
    assert "ids" not in str(tokens.read_tokens(spark, f"{tmp_path}/t", ["doc_id", "n_tokens"])._jdf.queryExecution().executedPlan()).split("ReadSchema")[1]
    one = tokens.read_tokens(spark, f"{tmp_path}/t").filter("doc_id = 150")
    assert "EqualTo(doc_id,150)" in str(one._jdf.queryExecution().executedPlan()) and one.count() == 1


def test_equal_ids_stay_together(spark):
    """A third of all rows with one doc_id: all are written, ordered by text."""
    import public_tokenizers
    import tempfile

    rows = spark.createDataFrame([(i if i % 3 else 7, f"text {i:03}") for i in range(300)], "doc_id long, text string")
    path = tempfile.mkdtemp(prefix="spark-") + "/t"
    tokens.write_tokens(rows, public_tokenizers.path("byte_bpe_50k.json"), path)
    got = tokens.read_tokens(spark, path).orderBy("start").collect()
    assert len(got) == 300 and [r.doc_id for r in got] == sorted(r.doc_id for r in got)


@pytest.mark.parametrize("coding", ["delta", "dictionary"])
def test_token_files_odd(spark, odd, tmp_path, coding):
    import public_tokenizers
    import pyarrow.parquet as pq

    tokens.write_tokens(odd.unionByName(odd.filter("doc_id = 4")), public_tokenizers.path("byte_bpe_50k.json"), f"{tmp_path}/t", coding=coding)
    rows = tokens.read_tokens(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [1, 2, 3, 4, 4, 5, 6, 7] and rows[0].ids == [2] and rows[-1].start == sum(r.n_tokens for r in rows[:-1])
    meta = [pq.ParquetFile(p).metadata for p in tmp_path.glob("t/*.parquet")]
    codings = {e for m in meta if m.num_row_groups for e in m.row_group(0).column(4).encodings}
    assert ("RLE_DICTIONARY" in codings) == (coding == "dictionary") and (coding == "dictionary" or "DELTA_BINARY_PACKED" in codings)
    tokens.write_tokens(odd.limit(0), public_tokenizers.path("byte_bpe_50k.json"), f"{tmp_path}/e")
    assert tokens.read_tokens(spark, f"{tmp_path}/e").count() == 0


# 10 mixing

def test_mixing_odd(spark, odd):
    got = {r.doc_id: r for r in mixing.mix_sources(odd).collect()}
    assert len(got) == 7 and (got[1].size, got[1].taken) == (0, 0) and all(r.taken <= 2 * r.size for r in got.values())
    assert got[7].source_size == 1 and mixing.mix_sources(odd.limit(0)).count() == 0
    rows = mixing.repeat_documents(odd)
    assert rows.columns == odd.columns and collections.Counter(r.doc_id for r in rows.collect())[4] == got[4].copies


def test_repeated_ids_do_not_overshoot(spark):
    """A hundred rows of one id are placed one by one: the source gives its target within a row, and every other column stays with its row."""
    rows = spark.createDataFrame([(7 if i < 100 else i, " ".join(["w"] * (1 + i % 5)), "a" if i % 2 else "b", i) for i in range(400)], "doc_id long, text string, source string, number long")
    out = mixing.repeat_documents(rows)
    taken = {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    sizes = rows.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("source_size"))
    assert all(abs(taken[r.source] - r.target) <= 5 for r in mixing.source_targets(sizes).collect())
    assert out.columns == rows.columns and max(collections.Counter(r.number for r in out.collect()).values()) <= 2


def test_targets_fill_up(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 50)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 20 and abs(sum(got.values()) - 1.5 * 2060) < 1e-6 and got[None] == 100 and abs(got["b"] - 2 * got["c"]) < 1e-6 or got["b"] == 2000


def test_mix_reaches_targets_and_matches_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in duckdb.sql("SELECT doc_id, size, source_size, target, taken FROM (" + queries.ORACLES["op10_source_mixing"] + ")").fetchall()}
    rows = queries.op10_source_mixing(spark, sf).collect()
    assert {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in rows} == want
    sums = collections.defaultdict(lambda: [0, 0, 0])
    for r in rows:
        s = sums[(r.source_size, r.target)]
        s[0] += r.taken
        s[1] = max(s[1], r.size)
    assert all(abs(taken - target) <= largest for (_, target), (taken, largest, _) in sums.items())


# the pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = shared.table(spark, sf, "documents")
    kept = [texts(docs)]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            kept.append(texts(docs))
    want = brute_components(kept[1], 5, 80)
    assert set(kept[2]) == {i for i, (_, root) in want.items() if i == root}
    leaks = {r.doc_id for r in decontam.contaminated(spark.createDataFrame(list(kept[2].items()), "doc_id long, text string"), shared.table(spark, sf, "benchmark")).collect()}
    assert set(kept[3]) == set(kept[2]) - leaks
    assert docs.count() == spark.read.parquet(f"{tmp_path}/3").count() and set(docs.columns) == {"doc_id", "start", "n_tokens", "ids"}


def write_tables(spark, path, documents, labels, benchmark):
    documents.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_odd(spark, odd, tmp_path):
    """Nulls, empty, very long and repeated texts, a repeated id, a benchmark passage and further columns through all stages."""
    import corpus_pipeline

    more = spark.createDataFrame([(4, "same words here again and again"), (8, "Noise. " + ITEM), (None, "no id but words")], "doc_id long, text string")
    rows = odd.unionByName(more, allowMissingColumns=True)
    sf = write_tables(spark, tmp_path, rows, [(1, None, None), (4, 1, 0), (99, 0, 1)], [(1, ITEM), (2, None)])
    docs, kept = shared.table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.saved(stage(spark, docs, sf), name)
        assert docs.columns == rows.columns
        kept.append(collections.Counter(r.doc_id for r in docs.select("doc_id").collect()))
    assert kept[0] == {1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1, 7: 1, 8: 1, None: 1}, "one label teaches nothing, so nothing goes"
    assert kept[1] == kept[0] - collections.Counter([5]) and kept[2] == kept[1] - collections.Counter([8])
    assert all(n <= 2 * kept[2][i] for i, n in kept[3].items())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids"] and out.count() == sum(kept[3].values())


def test_pipeline_of_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline

    sf = write_tables(spark, tmp_path, odd.limit(0), [], [])
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_saved_tables_can_be_dropped(spark):
    import os

    shared.saved(spark.range(3), "three")
    assert os.path.isdir(shared.run_dir(spark))
    shared.drop_saved(spark)
    assert not os.path.isdir(shared.run_dir(spark))
