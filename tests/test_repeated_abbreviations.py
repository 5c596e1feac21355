"""Abbreviations that stand several times in a row end sentences as in the queries' SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry_module

TEXTS = [
    "asdo esas de queez la. No. No. Ñllí ñja la adoci de ciónqueado", "Ñrrñ para. para. para. para. para. Esra Esra\nand No. No. No. 5 of it", "seen v. p. v. v. p. and et al. et al. et al. then",
    "no abbreviation here. Only two sentences.\nMr. Mr. Mrs. Dr. Dr. Dr. Who was it, and e.g. e.g. nobody", "No. No. at its beginning and Co. Co.\nat the end of a line",
]


@pytest.mark.parametrize("name", ["corpus_build", "paragraph_stats", "sentence_index"])
def test_query_matches_its_oracle(spark, tmp_path, name):
    rows = pa.table({"doc_id": list(range(len(TEXTS))), "source": ["a", "b", "a", "b", "a"], "text": TEXTS})
    pq.write_table(rows, tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    cursor = con.execute(entry_module.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    found = entry_module.queries()[name](spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(cursor.fetchall(), key=repr)
