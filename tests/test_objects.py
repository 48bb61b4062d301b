"""The first balanced JSON object of a text, against a scanner of one character after the other."""

import json
import random

import pyarrow as pa
from pyspark.sql import functions as F

from critiq.functions import objects
from critiq.functions.text import mask_personal


def one_by_one(text):
    depth, start, quoted, behind = 0, -1, False, False
    for i, c in enumerate(text or ""):
        if quoted:
            quoted, behind = behind or c != '"', not behind and c == "\\"
        elif c == '"':
            quoted = True
        elif c == "{":
            start, depth = (start if depth else i), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                try:
                    json.loads(text[start : i + 1])
                    return text[start : i + 1]
                except ValueError:
                    pass
    return None


def test_random_braces():
    rng, found = random.Random(2), 0
    pieces = ["{", "}", '{"a":1}', '"', "\\", "\\\\", '\\"', "[", "]", "é", " ", '"a":', "1", '{"b":"}"}', "{}"]
    for _ in range(1500):
        texts = [None if rng.random() < 0.05 else "".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(rng.randint(1, 9))]
        expected = [one_by_one(t) for t in texts]
        found += sum(x is not None for x in expected)
        assert objects._scan(pa.array(texts, pa.string())).to_pylist() == expected, texts
    assert found > 1000


def test_rule_and_long_texts(spark):
    cases = {
        'x {oops {"a": 1} } y': None, '{bad} then {"a": 1}': '{"a": 1}', 'say " {"a": 1}': None, "} }{}": "{}", '{"a": NaN}': '{"a": NaN}', "": None, None: None, '{"s": "\\"}"}': '{"s": "\\"}"}',
        '{"a":' * 100_000 + "1" + "}" * 100_000: None, "{" * 1_000_000: None, '{"x":"' + "y" * 1_000_000 + '"}': '{"x":"' + "y" * 1_000_000 + '"}', '{"a":' * 800 + "1" + "}" * 800: '{"a":' * 800 + "1" + "}" * 800,
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").select("i", objects.first_json(F.col("t")).alias("x")).collect()
    assert [r.x for r in sorted(rows)] == list(cases.values())
    assert spark.createDataFrame([], "t string").select(objects.first_json(F.col("t"))).count() == 0


def test_slices_of_a_batch(monkeypatch):
    monkeypatch.setattr(objects, "SCAN_BYTES", 16)
    texts = ["a {} b" * 5, None, "", '{"k": [1, 2]}', "no", "{" * 40, '"', "{}"]
    whole = pa.array(["{}", *texts, "{}"])
    assert objects.first_json.func(whole.slice(1, len(texts))).to_pylist() == [one_by_one(t) for t in texts]


def test_masking_takes_linear_time(spark):
    text = "a" * 2_000_000 + " me.you@x-y.org,b@c@d " + ".-" * 1_000_000
    out = spark.createDataFrame([(text,)], "t string").select(mask_personal(F.col("t")).alias("t")).first().t
    assert out == "a" * 2_000_000 + " [EMAIL],[EMAIL]@d " + ".-" * 1_000_000
