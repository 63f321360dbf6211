"""Table profiles: shape, missing cells, patterns, nullity correlation, five-number summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import ratio
from . import quantiles

CRITICAL_PCT = 50.0


def dataset_info(df: DataFrame) -> DataFrame:
    """One row per column with its type, next to the table's row and column counts."""
    fields = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                       F.lit(f.dataType.simpleString()).alias("dtype")) for i, f in enumerate(df.schema.fields)]
    return (df.agg(F.count(F.lit(1)).alias("n_rows"))
            .select("n_rows", F.lit(len(fields)).alias("n_columns"), F.explode(F.array(*fields)).alias("f"))
            .select("n_rows", "n_columns", "f.*"))


def cells(df: DataFrame) -> DataFrame:
    """What a profile needs of a table, to be stored and added to: ``(column, word, value, bits, n)``.

    Whole numbers, booleans, dates and timestamps are bits of 64-bit words (``word`` is the number divided by 64), anything else is
    its text (``value``); ``n`` counts rows, and a null has neither word nor value. Rows are combined in each task before the shuffle,
    so dense columns shrink to a 64th of their values and short lists to themselves. NaN is a value, as is each distinct time;
    0.0 and -0.0 are one.
    """
    kinds = {"byte", "short", "integer", "long", "boolean", "date", "timestamp", "timestamp_ntz"}
    facts = []
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        number = text = None
        if kind == "date":
            number = F.unix_date(c)
        elif kind.startswith("timestamp"):
            number = F.unix_micros(c.cast("timestamp"))
        elif kind in kinds:
            number = c
        elif kind in ("double", "float"):
            text = (c + F.lit(0.0)).cast("string")
        elif kind == "binary":
            text = F.hex(c)
        elif kind in ("array", "map", "struct", "variant"):
            text = F.when(c.isNotNull(), F.to_json(F.struct(c), {"ignoreNullFields": "false"}))
        else:
            text = c.cast("string")
        number = F.lit(None).cast("long") if number is None else number.cast("long")
        facts.append(F.struct(F.lit(f.name).alias("column"), number.alias("number"),
                              (F.lit(None).cast("string") if text is None else text).alias("value")))
    bit = F.expr("shiftleft(1L, cast(number & 63 AS int))")
    return (df.select(F.explode(F.array(*facts)).alias("f")).select("f.*")
            .groupBy("column", F.shiftright("number", 6).alias("word"), "value")
            .agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n")))


def merged(*parts: DataFrame) -> DataFrame:
    """The ``cells`` of tables with the same columns as those of all their rows."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("column", "word", "value").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))


def _profile(counts: DataFrame) -> DataFrame:
    """Shares and marks from (column, dtype, n, present, distinct_values)."""
    pct = ratio((F.col("n") - F.col("present")) * F.lit(100.0), F.col("n"))
    return counts.select("column", "dtype", (F.col("n") - F.col("present")).alias("missing_count"), pct.alias("missing_pct"),
                         "distinct_values", F.coalesce(pct > CRITICAL_PCT, F.lit(False)).alias("critical")
                         ).orderBy(F.desc("missing_pct"), "column")


def missing_from(found: DataFrame, schema: StructType) -> DataFrame:
    """The profile of ``missing`` from the stored ``cells`` of a table with this schema."""
    there = F.col("value").isNotNull() | F.col("word").isNotNull()
    counts = found.groupBy("column").agg(
        F.sum("n").alias("n"), F.sum(F.when(there, F.col("n")).otherwise(0)).alias("present"),
        F.sum(F.when(F.col("value").isNotNull(), 1).otherwise(F.coalesce(F.bit_count("bits"), F.lit(0)))).alias("distinct_values"))
    zero = F.lit(0).cast("long")
    columns = found.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema.fields], "column string, dtype string")
    return _profile(columns.join(F.broadcast(counts), "column", "left").select(  # a row per column
        "column", "dtype", *[F.coalesce(F.col(c), zero).alias(c) for c in ("n", "present", "distinct_values")]))


def missing(df: DataFrame, approx: bool = False) -> DataFrame:
    """Missing count and share, distinct values and a critical mark per column, worst first.

    One scan. Distinct counts are exact (see ``cells``); ``approx`` swaps them for sketches on wide tables.
    """
    if not approx:
        return missing_from(cells(df), df.schema)
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(f"{c}_n") for c in df.columns],
                  *[F.approx_count_distinct(F.col(c)).alias(f"{c}_u") for c in df.columns])
    rows = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                     F.col(f"{f.name}_n").alias("present"), F.col(f"{f.name}_u").alias("distinct_values"))
            for f in df.schema.fields]
    return _profile(wide.select(F.col("_n").alias("n"), F.explode(F.array(*rows)).alias("r")).select("n", "r.*"))


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[int, dict[str, int]]:
    """Rows and missing cells per column as numbers: what the imputation router decides from."""
    columns = list(columns or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(c) for c in columns]).first()
    return row["_n"], {c: row["_n"] - row[c] for c in columns}


def missing_totals(df: DataFrame) -> DataFrame:
    """Whole-table totals of missing cells."""
    n = F.col("_n")
    gone = [n - F.col(c) for c in df.columns]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    cells = n * len(df.columns)
    total = sum(gone[1:], gone[0])
    return row.select(
        cells.alias("total_cells"), total.alias("missing_cells"),
        ratio(total * F.lit(100.0), cells).alias("missing_pct"),
        sum(((g > 0).cast("int") for g in gone[1:]), (gone[0] > 0).cast("int")).alias("columns_with_missing"),
        sum(((g * 100.0 > n * CRITICAL_PCT).cast("int") for g in gone[1:]),
            (gone[0] * 100.0 > n * CRITICAL_PCT).cast("int")).alias("columns_critical"),
    )


def missing_patterns(df: DataFrame) -> DataFrame:
    """How often each combination of missing columns occurs ('1' marks a missing column, in table order)."""
    flags = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in df.columns])
    return df.groupBy(flags.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def nullity_corr(df: DataFrame) -> DataFrame:
    """Correlation of missingness between column pairs; columns never or always missing have none.

    Flags are 0/1, so pair counts decide everything: one scan, one row.
    """
    cols, n = df.columns, F.col("_n")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_m") for c in cols],
        *[F.count_if(F.col(a).isNull() & F.col(b).isNull()).alias(f"{a}_{b}_m") for a, b in pairs])
    cells = []
    for a, b in pairs:
        ma, mb = F.col(f"{a}_m").cast("double"), F.col(f"{b}_m").cast("double")
        spread = F.sqrt(ma * (n - ma)) * F.sqrt(mb * (n - mb))
        cells.append(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                              ratio(F.col(f"{a}_{b}_m") * n.cast("double") - ma * mb, spread).alias("corr")))
    return row.select(F.explode(F.array(*cells)).alias("p")).select("p.*").where(F.col("corr").isNotNull())


def five_number(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """Minimum, quartiles and maximum per column: the data behind a box plot."""
    q = quantiles.quantiles(df, columns, [0.0, 0.25, 0.5, 0.75, 1.0], accuracy)
    return df.sparkSession.createDataFrame(
        [(c, *q[c]) for c in columns],
        "feature string, min double, q1 double, median double, q3 double, max double")
