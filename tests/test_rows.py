"""Queries without an oracle: they run over the whole tables and keep their invariants."""

import pytest

from riskframe.operators import split
from riskframe.plans.oracles import ORACLES
from riskframe.plans.queries import QUERIES
from riskframe.sources.visits import VITALS, visits


def test_every_query_is_checked():
    """A query without SQL for its rows has SQL for what must hold of them, which runs the query itself."""
    assert all(name in ORACLES or f"{name}_checked" in ORACLES for name in QUERIES)


def test_chained_leaves_no_gap(spark, sf_dir):
    out = QUERIES["impute_chained_rounds"](spark, sf_dir)
    assert out.na.drop(subset=list(VITALS)).count() == visits(spark, sf_dir, ["visit_id"]).count()


def test_importance_sums_to_one(spark, sf_dir):
    out = QUERIES["feature_importance"](spark, sf_dir).groupBy("source").sum("importance").collect()
    assert len(out) == 4 and all(abs(r[1] - 1) < 1e-9 for r in out)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_temporal_split_of_no_rows(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts").where("event_id < 0")
    out = split.temporal(events, "ts")
    assert out.columns == ["event_id", "ts", "split"] and out.count() == 0
