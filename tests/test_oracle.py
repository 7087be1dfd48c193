"""Every query of the engine against its SQL in DuckDB, over whole tables."""

import pandas as pd
import pytest

from keystrata.plans import catalogue
from tests.conftest import SF_DIR


def rows(frame: pd.DataFrame) -> list:
    def plain(v):
        if v is None or (not isinstance(v, (str, bytes)) and pd.isna(v)):
            return "null"
        return str(v) if isinstance(v, (str, bool)) else f"{float(v):.9g}"

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, SF_DIR).toPandas()
    theirs = duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
    assert len(ours)


def test_filter_order_matters(spark):
    """Filters on liveness before the resolution would bring deleted rows back."""
    from keystrata.operators.resolve import live, newest
    from keystrata.sources.tables import event_log

    log = event_log(spark, SF_DIR)
    right = live(newest(log, 5000), catalogue.NOW_NS).count()
    wrong = newest(live(log, catalogue.NOW_NS), 5000).count()
    assert (right, wrong) == (123, 150)


def test_plans_push_filters_and_prune_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    from keystrata.operators.keys import excluded, included
    from keystrata.operators.resolve import resolve
    from keystrata.operators.scan import get, ranged
    from keystrata.sources.tables import event_log

    event_log(spark, SF_DIR).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = get(log, b"12", 5000, 0)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in plan and "LessThanOrEqual(seq" in plan
    plan = resolve(ranged(log, included(b"1"), excluded(b"2")), None, 0).select("key")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
    assert "event_id" not in plan.split("ReadSchema")[1] and "WindowGroupLimit" in plan
    del F
