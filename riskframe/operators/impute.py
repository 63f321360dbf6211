"""Simple fills: indicators, median, mode, correlated predictors. Fit reads statistics, apply is a projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quantiles
from .profile import missing_counts
from .schema import rows

INDICATOR_SHARE = 0.05
UNKNOWN = "Unknown"


def indicator_columns(df: DataFrame, threshold: float = INDICATOR_SHARE,
                      columns: Sequence[str] | None = None) -> list[str]:
    """Columns missing in more than ``threshold`` of the rows that have no indicator yet."""
    n, gone = missing_counts(df, columns)
    return [c for c, m in gone.items() if n and m / n > threshold and f"{c}_was_missing" not in df.columns]


def indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<column>_was_missing`` marks; call on the table as it was before any fill."""
    return df.withColumns({f"{c}_was_missing": F.col(c).isNull().cast("int") for c in columns})


@dataclass(frozen=True)
class Fill:
    """Fitted constants per column."""

    values: Mapping[str, float | str]
    methods: Mapping[str, str] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.values.items()
                               if v is not None})


def fit_median(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> Fill:
    found = quantiles.medians(df, columns, accuracy)
    return Fill(found, {c: "median" for c in columns})


def fit_mode(df: DataFrame, columns: Sequence[str]) -> Fill:
    """Most frequent value, smallest on a tie, 'Unknown' when all are missing.

    Counts by (column, value) with map-side combining; then the best per column from those counts, so
    no task ever holds the value map of a whole column.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]))
    counts = (df.select(cells.alias("c")).select("c.*").where(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    found = {r["column"]: r["value"] for r in best.collect()}
    return Fill({c: found.get(c, UNKNOWN) for c in columns}, {c: "mode" for c in columns})


def correlations(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation of each column with ``target``: one scan, long form."""
    row = df.where(F.col(target).isNotNull()).agg(*[
        F.lit(1.0).alias(c) if c == target else F.corr(c, target).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in columns])
    return row.select(F.explode(cells).alias("f")).select("f.*")


def correlated(df: DataFrame, target: str, columns: Sequence[str], k: int = 6) -> DataFrame:
    """The k columns most correlated with ``target`` by absolute value; the target itself is one of them."""
    return (correlations(df, target, columns).where(F.col("corr").isNotNull() & ~F.isnan("corr"))
            .orderBy(F.desc(F.round(F.abs("corr"), 12)), "feature").limit(k))


def improvement(before: DataFrame, after: DataFrame) -> DataFrame:
    """Missing cells, columns with missing, complete rows: before, after, change and change in percent."""
    def facts(df: DataFrame, name: str) -> DataFrame:
        cols = df.columns
        row = df.agg(
            F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(c) for c in cols],
            F.count_if(_complete(cols)).alias("_ok"))
        gone = [F.col("_n") - F.col(c) for c in cols]
        marks = [(g > 0).cast("bigint") for g in gone]
        return row.select(rows(
            {"metric": "complete_cases", name: F.col("_ok")},
            {"metric": "columns_with_missing", name: sum(marks[1:], marks[0])},
            {"metric": "missing_values", name: sum(gone[1:], gone[0])}).alias("m")).select("m.*")

    change = F.col("after") - F.col("before")
    return (facts(before, "before").join(F.broadcast(facts(after, "after")), "metric")
            .select("metric", "before", "after", change.alias("difference"),
                    F.try_divide(change * F.lit(100.0), F.col("before")).alias("change_pct")))


def _complete(columns: Sequence[str]):
    ok = F.col(columns[0]).isNotNull()
    for c in columns[1:]:
        ok = ok & F.col(c).isNotNull()
    return ok


def success_rate(before: DataFrame, after: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of the missing cells that were filled, in percent; 100 when none was missing."""
    columns = list(columns or before.columns)

    def gone(df: DataFrame, name: str) -> DataFrame:
        row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(c) for c in columns])
        parts = [F.col("_n") - F.col(c) for c in columns]
        return row.select(F.lit(1).alias("one"), sum(parts[1:], parts[0]).alias(name))

    b, a = F.col("missing_before"), F.col("missing_after")
    return (gone(before, "missing_before").join(F.broadcast(gone(after, "missing_after")), "one")
            .select("missing_before", "missing_after",
                    F.when(b == 0, 100.0).otherwise(F.try_divide((b - a) * F.lit(100.0), b)).alias("success_pct")))


def quality(before: DataFrame, after: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """What filling did to each column that had missing cells, one row per column.

    Numeric columns compare mean and deviation (n-1) and count as preserved when the mean moved by less
    than 5% of the deviation; text columns compare mode and number of values.
    """
    columns = [*numeric, *text]

    def facts(df: DataFrame, suffix: str) -> DataFrame:
        plain = df.agg(
            F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(f"{c}_n") for c in columns],
            *[F.avg(c).alias(f"{c}_mean") for c in numeric], *[F.stddev_samp(c).alias(f"{c}_std") for c in numeric])
        none = F.lit(None).cast("double")
        cells = F.array(*[F.struct(
            F.lit(c).alias("column"), (F.col("_n") - F.col(f"{c}_n")).alias("missing"),
            F.try_divide((F.col("_n") - F.col(f"{c}_n")) * F.lit(100.0), F.col("_n")).alias("pct"),
            (F.col(f"{c}_mean") if c in numeric else none).alias("mean"),
            (F.col(f"{c}_std") if c in numeric else none).alias("std")) for c in columns])
        out = plain.select(F.explode(cells).alias("r")).select("r.*")
        if text:
            cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in text])
            tally = (df.select(F.explode(cells).alias("c")).select("c.*").where(F.col("value").isNotNull())
                     .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("column")
                     .agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"),
                          F.count(F.lit(1)).alias("unique")))
            out = out.join(F.broadcast(tally), "column", "left")
        else:
            out = out.withColumns({"mode": F.lit(None).cast("string"), "unique": F.lit(None).cast("bigint")})
        return out.select("column", *[F.col(c).alias(f"{c}_{suffix}") for c in out.columns if c != "column"])

    moved = F.abs(F.col("mean_after") - F.col("mean_before"))
    kept = F.when(F.col("column").isin(list(numeric)), F.coalesce(moved < F.col("std_before") * 0.05, F.lit(False))
                  ).otherwise(F.coalesce(F.col("mode_before") == F.col("mode_after"), F.lit(False)))
    return (facts(before, "before").join(F.broadcast(facts(after, "after")), "column")
            .where(F.col("missing_before") > 0)
            .withColumns({"mean_change": moved, "std_change": F.abs(F.col("std_after") - F.col("std_before")),
                          "preserved": kept}))


LOG_SCHEMA = "column string, method string, params string, missing_before bigint"


def log_frame(df: DataFrame, entries: Sequence[tuple[str, str, str, int]]) -> DataFrame:
    """Imputation log: one row per treated column with the number of cells it really lacked."""
    return df.sparkSession.createDataFrame(list(entries), LOG_SCHEMA)


