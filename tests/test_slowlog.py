"""Durations of the slow log's query are rounded as its SQL rounds them."""

import __spark_entry__ as entry
import pytest

duckdb = pytest.importorskip("duckdb")


def test_halves_go_to_the_even_number(spark, tmp_path):
    rows = [(i, v) for i, v in enumerate([49.4, 49.5, 49.6, 50.5, 51.5, 60.5, 61.5, 0.5, 1.5, -60.5, 4503599627370497.5])]
    spark.createDataFrame([*rows, (99, None)], "event_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()["slowlog"]).fetchall()
    got = entry.queries()["slowlog"](spark, str(tmp_path)).select("id", "duration_us").collect()
    assert [tuple(r) for r in got] == want and (5, 60) in want and (6, 62) in want
