"""Profiles whose counts add up: exact distinct values without one plan branch per column."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskframe.operators import profile

SCHEMA = ("i int, l long, s string, d double, b boolean, t timestamp, day date, m decimal(10,2), a array<int>, x binary, "
          "st struct<p:int>, kv map<string,int>, `odd name` short")
BIG = 2**63 - 1


def rows(spark):
    nan = float("nan")
    return spark.createDataFrame([
        (1, BIG, "", 0.0, True, datetime(2020, 1, 1), date(1900, 1, 1), Decimal("1.10"), [1, None], b"\x00", (None,), {"a": 1}, 3),
        (1, -BIG - 1, "a", -0.0, False, datetime(1950, 1, 1, 1, 1, 1, 5), date(2020, 1, 1), Decimal("1.1"), [1], b"", (1,), {}, 3),
        (-1, 64, "a", nan, True, None, None, None, [], None, None, None, None),
        (63, 63, None, nan, None, datetime(2020, 1, 1), date(1900, 1, 1), Decimal("2"), None, b"\x00", (1,), {"a": 1}, -4),
        (64, None, "NULL", 1.5, None, None, date(2020, 1, 1), None, [1, None], None, (None,), {"b": 1}, None),
    ], SCHEMA)


EXPECTED = {"i": 4, "l": 4, "s": 3, "d": 3, "b": 2, "t": 2, "day": 2, "m": 2, "a": 3, "x": 2, "st": 2, "kv": 3, "odd name": 2}


def test_kinds_of_values(spark):
    out = {r["column"]: r for r in profile.missing(rows(spark)).collect()}
    assert {c: r["distinct_values"] for c, r in out.items()} == EXPECTED
    assert out["l"]["missing_count"] == 1 and out["b"]["missing_pct"] == pytest.approx(40.0)
    assert out["odd name"]["dtype"] == "smallint"


def test_two_halves_add_up(spark, tmp_path):
    df = spark.range(20_000).select(
        "id", (F.col("id") * 7919 % 5003 - 2000).alias("dense"), F.xxhash64("id").alias("sparse"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), F.col("id") % 100)).alias("word"), F.lit(None).cast("int").alias("none"))
    halves = [df.where("id < 9000"), df.where("id >= 9000")]
    for i, half in enumerate(halves):
        profile.cells(half).write.parquet(f"{tmp_path}/{i}")
    stored = profile.merged(*[spark.read.parquet(f"{tmp_path}/{i}") for i in (0, 1)])
    added = profile.missing_from(stored, df.schema).collect()
    assert added == profile.missing(df).collect()
    want = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in df.columns]).first().asDict()
    assert {r["column"]: r["distinct_values"] for r in added} == want
    assert added[0]["column"] == "none" and added[0]["critical"]


def test_dense_columns_shrink(spark):
    assert profile.cells(spark.range(64 * 500)).count() == 500


def test_plan_has_no_expand(spark):
    plan = profile.missing(rows(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_empty_table(spark):
    out = profile.missing(rows(spark).limit(0)).collect()
    assert len(out) == len(EXPECTED) and all((r["missing_count"], r["distinct_values"], r["critical"]) == (0, 0, False) for r in out)
