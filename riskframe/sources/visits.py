"""The visit table and the scored-visit table, derived by Spark from the given parquet tables.

``columns`` lets a caller name what it needs: a join that serves none of those columns is left out,
which is safe because both joined sides are unique on their keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Source column names and their names here.
SOURCE_NAMES = {
    "YAŞ": "age",
    "Ağrı skoru": "pain",
    "SPO2": "spo2",
    "Nabız": "hr",
    "KB-S": "sbp",
    "KB-D": "dbp",
    "metin_ates": "temp",
    "metin_gks": "gcs",
    "Vital Bulgu Eksik Sayısı": "n_vitals_missing",
    "Yogunluk_Skoru": "crowding",
    "Triaj": "triage",
    "ambulans_ile_geldi": "by_ambulance",
}
# Source class names and their names here.
SOURCE_CLASSES = {"Kırmızı": "RED", "Sarı": "YELLOW", "Yeşil": "GREEN"}

VITALS = ("hr", "spo2", "sbp", "dbp", "temp", "gcs")
CLASSES = ("GREEN", "RED", "YELLOW")
COLUMNS = ("visit_id", "patient_id", "arrival_ts", "arrival_mode", "complaint", "age", "hr", "sbp", "dbp", "spo2",
           "temp", "gcs", "pain_raw", "triage")


def rename_source(df: DataFrame) -> DataFrame:
    """English column names and class names for a table that uses the source names."""
    df = df.withColumnsRenamed({k: v for k, v in SOURCE_NAMES.items() if k in df.columns})
    if "triage" in df.columns:
        name = F.col("triage")
        for source, ours in SOURCE_CLASSES.items():
            name = F.when(F.col("triage") == source, ours).otherwise(name)
        df = df.withColumn("triage", name)
    return df


@cache
def _schema(spark: SparkSession, path: str) -> StructType:
    return spark.read.parquet(path).schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; its schema is read from the file footer once per session."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_schema(spark, path)).parquet(path)


def visits(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per visit. Only the listed columns are built (all of them by default)."""
    want = list(columns or COLUMNS)
    base = table(spark, sf_dir, "orders")
    if "complaint" in want:
        people = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
        base = base.join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
    if "hr" in want:
        pulse = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("q"))
        base = base.join(pulse, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return base.selectExpr(*[f"{VISIT_SQL[c]} AS {c}" for c in want])


_SBP = "CAST(60 + FLOOR(o_totalprice / 1000) % 150 AS DOUBLE)"
_SPO2 = "CAST(75 + (o_orderkey * 11) % 26 AS DOUBLE)"
VISIT_SQL = {
    "visit_id": "o_orderkey",
    "patient_id": "o_custkey",
    "arrival_ts": "o_orderdate",
    "arrival_mode": "o_orderstatus",
    "complaint": "CASE WHEN o_orderkey % 11 != 3 THEN c_mktsegment END",
    "age": "CAST(o_custkey % 101 AS DOUBLE)",
    "hr": "CAST(30 + 3 * q AS DOUBLE)",
    "sbp": _SBP,
    "dbp": f"CASE WHEN o_orderkey % 8 != 5 THEN CAST(40 + FLOOR({_SBP} / 3) + o_orderkey % 17 AS DOUBLE) END",
    "spo2": f"CASE WHEN o_orderkey % 23 != 7 THEN {_SPO2} END",
    "temp": "CASE WHEN o_orderkey % 6 != 1 THEN CAST(340 + (o_orderkey * 17) % 61 AS DOUBLE) / 10 END",
    "gcs": "CASE WHEN o_orderkey % 50 != 9 THEN CAST(3 + (o_orderkey * 5) % 13 AS DOUBLE) END",
    "pain_raw": "CASE WHEN o_orderkey % 40 = 11 THEN 'n/a' ELSE CAST(o_orderkey % 11 AS STRING) END",
    "triage": f"""CASE WHEN o_orderkey % 10 = 0 THEN
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'RED' WHEN o_orderpriority = '2-HIGH' THEN 'YELLOW' ELSE 'GREEN' END
        WHEN {_SPO2} < 79 OR {_SBP} < 66 THEN 'RED' WHEN {_SPO2} < 82 THEN 'YELLOW' ELSE 'GREEN' END""",
}

PREDS_COLUMNS = ("visit_id", "patient_id", "arrival_ts", "arrival_mode", "age", "y_true", "y_pred", "y_pred_b",
                 "p_red", "p_yellow", "p_green")


def preds(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Visits scored by two simple rules, with class probabilities: input of the metric operators."""
    want = list(columns or PREDS_COLUMNS)
    v = visits(spark, sf_dir, ["visit_id", "patient_id", "arrival_ts", "arrival_mode", "age", "sbp", "spo2", "temp",
                               "triage"])
    v = v.selectExpr(
        "*",
        "CAST(1 + CASE WHEN spo2 < 82 THEN 6 ELSE 0 END + visit_id % 3 AS DOUBLE) AS wr",
        "CAST(1 + CASE WHEN spo2 BETWEEN 79 AND 84 THEN 5 ELSE 0 END + visit_id % 2 AS DOUBLE) AS wy",
        "CAST(2 + CASE WHEN spo2 >= 82 THEN 8 ELSE 0 END + visit_id % 5 AS DOUBLE) AS wg",
    )
    built = {
        "y_true": "triage",
        "y_pred": "CASE WHEN spo2 < 80 OR sbp < 66 THEN 'RED' WHEN spo2 < 83 THEN 'YELLOW' ELSE 'GREEN' END",
        "y_pred_b": "CASE WHEN sbp < 70 OR temp > 39.5D THEN 'RED' WHEN temp > 39 THEN 'YELLOW' ELSE 'GREEN' END",
        "p_red": "wr / (wr + wy + wg)",
        "p_yellow": "wy / (wr + wy + wg)",
        "p_green": "wg / (wr + wy + wg)",
    }
    return v.selectExpr(*[f"{built.get(c, c)} AS {c}" for c in want])
