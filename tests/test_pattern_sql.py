"""The SQL of find_patterns_dna where runs are longer than any fixed length."""

import duckdb

from strandline.jobs import searches


def test_long_runs(spark, tmp_path):
    texts = [(1, "ACGGT" + "A" * 300 + "CAGG" + "A" * 3), (2, "AGGA" * 40), (3, "acgtta" + "n" * 5), (4, None), (5, "CCCC"), (6, "AGT" + "A" * 61 + "GTGA")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    query, sql = searches.JOBS["find_patterns_dna"]
    got = sorted(tuple(r) for r in query(spark, f"file://{tmp_path}").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(sql).fetchall())
    assert got[0] == (1, 303, 311)
