"""Reviews of odd texts and labels, written as CSV and read back."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from critiq.plans import ORACLES, QUERIES
from critiq.sources import files

TEXTS = ["", None, 'a "\0b"\n', "\0", '"', '""', "\r", "x\r\n\r", " y, ", "\\", '\\"', "null", "é😀 ", "plain"]


def test_every_text_comes_back(spark, tmp_path):
    rows = [(i, t, t) for i, t in enumerate(TEXTS)]
    files.write_csv(spark.createDataFrame(rows, "i int, middle string, last string"), f"{tmp_path}/c", ["i", "middle", "last"])
    back = files.read_csv(spark, f"{tmp_path}/c", "i int, middle string, last string")
    assert sorted((tuple(r) for r in back.collect()), key=lambda r: r[0]) == rows


@pytest.mark.parametrize("quality", [[0, 1, 2, -1, None], [0, None]], ids=["beyond 0 and 1", "none positive"])
def test_csv_files_of_odd_reviews(spark, tmp_path, quality):
    n = len(TEXTS) * 6
    texts, sources, langs = [TEXTS[i % len(TEXTS)] for i in range(n)], [("s", "", None, ' "t", ')[i // len(TEXTS) % 4] for i in range(n)], pa.array([None] * n, pa.string())
    documents = pa.table({"doc_id": range(n), "text": texts, "lang": langs, "source": sources, "n_chars": [len(t or "") for t in texts]})
    pq.write_table(documents, f"{tmp_path}/documents.parquet")
    pq.write_table(pa.table({"doc_id": range(0, n - 9), "quality": pa.array([quality[i % len(quality)] for i in range(n - 9)], pa.int64())}), f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    theirs = con.execute(ORACLES["csv_files"])
    columns = [c[0] for c in theirs.description]
    ours = QUERIES["csv_files"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, (tuple(r) for r in ours))) == sorted(map(repr, theirs.fetchall()))
