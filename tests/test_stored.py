"""Queries on files of odd documents, against their SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from tests.test_queries import table

ODD = ["", " ", "\n", "\0", "\ufeff", "\ufeffmarked", "\ufeff\ufeff twice", "\ufffe", "\u00ff\u00fe", "\U0001d11e clef", "\u00e9", None, "plain"]


@pytest.mark.parametrize("name", ["src7_usable_files", "src8_encodings"])
def test_odd_documents(spark, tmp_path, name):
    """Each of these texts by each way to write it, under ids on both sides of 0 and under none, and one of more than 50 MB."""
    rows = [(sign * (12 * k + way), text) for k, text in enumerate(ODD) for way in range(12) for sign in (1, -1)] + [(None, "without an id"), (12_005, "long " * 5_300_000)]
    ids, texts = zip(*rows, strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    df = __spark_entry__.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in want.description], want.fetchall())
