"""Windows and sessions of events give DuckDB's rows: in the last half millisecond of an hour, in every zone of the session, before 1970, without a time."""

from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entry

#: Hours that New York's clocks leave out or repeat.
TIMES = ["2024-03-10 01:30:00", "2024-03-10 02:30:00.000999", "2024-03-10 02:45:00", "2024-03-10 04:00:00", "2024-11-03 01:30:00", "2024-11-03 23:00:00"]
#: DuckDB counts the nearest millisecond, so these are half of them in the next hour and an hour apart by less or more than their microseconds say.
LAST = ["2024-01-01 00:59:59.999499", "2024-01-01 00:59:59.999500", "2024-01-01 01:59:59.999499", "2024-01-01 02:59:59.999999", "2024-01-01 04:00:00", "2024-01-01 04:59:59.999501", "2024-01-03 00:00:00"]
EARLY = ["1815-12-10 12:00:00.000001", "1969-12-31 22:00:00", "1969-12-31 22:59:59.999", "1969-12-31 23:00:00", "1969-12-31 23:00:00.0005", "1969-12-31 23:00:00.001", "1970-01-01 00:59:59.999999", "1970-01-01 01:00:00"]


def written(tmp_path, times):
    rows = [(i, None if t is None else datetime.fromisoformat(t), i % 3, kind, value) for i, (t, kind, value) in enumerate((t, kind, value) for t in times for kind, value in (("view", 1.25), ("view", None), (None, 2.5)))]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?)", rows)
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    return con


@pytest.fixture
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"], indirect=True)
@pytest.mark.parametrize("name, times", [*((n, t) for n in ("hourly_windows", "debounce") for t in (TIMES, LAST, EARLY)), ("hourly_windows", [*LAST, None, None]), ("debounced_stream", TIMES)])
def test_events(spark, tmp_path, zone, name, times):
    con = written(tmp_path, times)
    found = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, con.execute(entry.oracle_sql()[name]).fetchall()))
