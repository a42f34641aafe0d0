"""Times between two milliseconds: a row is in the step of its time's nearest millisecond, in tables and streams, as in SQL."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import QUERIES, SQL, rows

from quaymark.functions import columns as C

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_milliseconds_are_rounded(spark):
    us = [499, 500, 1499, 1500, 59_999_499, 59_999_500, 3_599_999_999, 1_704_063_599_999_500, -499, -500, -1499, -1500]
    got = spark.createDataFrame([(u,) for u in us], "u long").select("u", C.epoch_ms(F.timestamp_micros("u")).alias("ms")).collect()
    for u, ms in got:
        assert duckdb.sql(f"SELECT epoch_ms(make_timestamp({u}))").fetchall() == [(ms,)]


@pytest.mark.parametrize("name", ["s01_hour_bars", "f01_candles", "f14_names", "j11_forward_by_time", "jx_as_of", "l01_single_horizon", "r03_stream_bars", "r04_last_open_bars", "r06_sliding_windows"])
def test_rows_just_before_a_step_equal_sql(spark, tmp_path, name):
    """The last event of every hour is 0 to 0.9 milliseconds before its end, and the greatest or least of its hour; half a millisecond and less is the next hour's."""
    start, made = datetime(2024, 1, 1), []
    for h in range(40):
        for m in range(0, 60, 4):
            made.append((start + timedelta(hours=h, minutes=m, seconds=7), float(100 + (7 * h + m) % 50)))
        made.append((start + timedelta(hours=h + 1, microseconds=-100 * (h % 10)), 3.0 if h % 2 else 400.0))
    events = [(i, t, i % 7, "view" if i % 2 else "click", v, "{}") for i, (t, v) in enumerate(sorted(made))]
    spark.createDataFrame(events, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(c.sql(SQL[name]).df())
