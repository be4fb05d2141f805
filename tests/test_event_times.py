"""event times as the SQL takes them: rounded to milliseconds, cut towards 1970, null times kept."""

import datetime as dt

import pytest

from sessionloom.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["t08_sliding", "t09_tumbling", "w16_rolling_rate"])
def test_odd_times(spark, tmp_path, name):
    import duckdb

    texts = ("2024-01-01 00:59:59.9994", "2024-01-01 00:59:59.9995", "2024-01-01 00:29:59.9999", "2024-01-01 01:00:00", "1969-12-31 23:59:59.9995", "1969-12-31 22:10:00.000499", "1969-12-31 23:00:00", "2024-01-02 00:59:59.9996", "2024-01-02 01:00:00", "2300-02-28 12:30:00")
    times = [dt.datetime.fromisoformat(t) for t in texts] + ([None, None] if name != "w16_rolling_rate" else [])
    rows = [(i, t, i % 2, ("a", "b", None)[i % 3], 1.0, "") for i, t in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.fetchall()))
