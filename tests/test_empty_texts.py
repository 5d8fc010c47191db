"""Queries over documents without text."""

import duckdb
import oracle

import __spark_entry__ as entry


def test_sequence_shards_of_empty_texts(spark, tmp_path):
    rows = [(1, ""), (2, " "), (3, "a"), (4, "a b c"), (5, "w " * 900), (None, ""), (1, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    problem, *_, n = oracle.compare(spark, con, entry.queries()["sequence_shards"], entry.oracle_sql()["sequence_shards"], str(tmp_path))
    assert problem is None and n == 4 * len(rows), problem


def test_sequence_shards_of_a_null_text(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["sequence_shards"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.shard) for r in got) == [(d, s) for d in (1, 2) for s in range(4)]
    assert {(r.chunk, r.ids, r.first_position, r.last_position) for r in got if r.doc_id == 1} == {(None, None, None, None)}
