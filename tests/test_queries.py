"""Every registered query of the bar engine against its DuckDB SQL on the smallest tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quaymark import catalog  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if value is None or isinstance(value, float) and math.isnan(value) or type(value).__name__ in ("NaTType", "NAType"):
        return None
    return float(f"{value:.9g}") if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF_DIR).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_queries_without_sql_are_the_models():
    """They are tested on their own rows, in test_operators.py and test_boosting.py."""
    assert set(QUERIES) - set(SQL) == {"m01_boosted_regression", "m02_forest", "m02_boosted_classes", "m03_boosted_binary", "m04_logistic", "g07_nested_models"}
