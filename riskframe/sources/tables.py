"""Reading and writing stage tables, reports and fitted state."""

from __future__ import annotations

import json

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import exists

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json"}


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Scan a file by its extension. CSV and JSON need a schema: nothing is inferred from the rows."""
    suffix = path[path.rfind("."):].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix not in FORMATS:
        raise ValueError(f"unsupported file type {suffix or '(none)'}: expected one of {sorted(FORMATS)}")
    if not exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    elif suffix != ".parquet":
        raise ValueError(f"a schema is required for {suffix}")
    if suffix == ".csv":
        reader = reader.option("header", True)
    return reader.format(FORMATS[suffix]).load(path)


def write_stage(df: DataFrame, root: str, stage: str, fmt: str = "parquet",
                partition_by: list[str] | None = None) -> str:
    """Hand a table to the next stage; parquet unless CSV is asked for."""
    path = f"{root}/{stage}.{fmt}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def read_stage(spark: SparkSession, root: str, stage: str, fmt: str = "parquet",
               schema: StructType | str | None = None) -> DataFrame:
    return read_table(spark, f"{root}/{stage}.{fmt}", schema)


def write_report(df: DataFrame, root: str, name: str, fmt: str = "csv") -> str:
    """A report table as CSV or JSON. JSON has no NaN or infinity, so both are written as null."""
    path = f"{root}/reports/{name}.{fmt}"
    if fmt == "json":
        floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
        df = df.select(*[
            F.when(~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf"))), F.col(c)).alias(c) if c in floats
            else F.col(c)
            for c in df.columns
        ])
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    else:
        df.write.mode("overwrite").option("header", True).format(fmt).save(path)
    return path


def save_state(spark: SparkSession, state: dict, root: str, name: str) -> str:
    """Fitted statistics (bounded by the number of columns) as one JSON text row."""
    path = f"{root}/models/{name}.state"
    spark.createDataFrame([(json.dumps(state),)], "state string").write.mode("overwrite").parquet(path)
    return path


def load_state(spark: SparkSession, root: str, name: str) -> dict:
    return json.loads(spark.read.parquet(f"{root}/models/{name}.state").first()["state"])


def save_model(model, root: str, name: str) -> str:
    """An MLlib model through its own writer."""
    path = f"{root}/models/{name}.model"
    model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, root: str, name: str):
    return DefaultParamsReader.loadParamsInstance(f"{root}/models/{name}.model", spark)
