"""From raw documents to token files: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import hamming_join, quality_rules, schedule, tiling, token_files
from riskframe.llm.queries import tokenizer_file
from riskframe.llm.shared import small_side, stored

#: The token files' rows hold the answer of a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id, null included, is not in ``gone``."""
    ids = small_side(stored(gone.select(F.col("doc_id").alias("_gone")).distinct(), "gone"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_gone"]), "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Rows with one id and different verdicts are told apart by their text."""
    judged = quality_rules.quality_rules(docs)
    bad = judged.where("not kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    bad = small_side(stored(bad, "rejected"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # whole, so that no name of theirs is met
    rows = rows.withColumn("row_hash", F.xxhash64("row.text"))
    kept = rows.join(bad, rows["row.doc_id"].eqNullSafe(bad["id"]) & (rows["row_hash"] == bad["hash"]), "left_anti")
    return kept.select([F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Rows of one id stay or go together, but equal texts of one id are one document, of which one row stays.
    """
    ids = stored(hamming_join.near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")), "kept")
    kept = _without(docs, ids.where("not kept"))
    again = ids.where("rows > 1").select(F.col("doc_id").alias("_again"))
    if again.isEmpty():
        return kept
    again = small_side(stored(again, "again"))
    met = kept["doc_id"].eqNullSafe(again["_again"])
    once = kept.join(again, met, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, met, "left_anti").unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, tiling.contaminated(docs, benchmark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights: a row for each time that it takes a document, in the schedule's order."""
    return schedule.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files: each row's place, read back from them. Rows read from files keep these files' order, the schedule's."""
    try:
        placed = docs.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))
    except AnalysisException:  # rows that come from no file have no such order
        return token_files.read(*token_files.write(docs, tokenizer_file()))
    placed = placed.select("doc_id", "text", *[placed[c].alias(f"at_{c}") for c in ("file_name", "row_index")])
    return token_files.read(*token_files.write(placed, tokenizer_file(), order=["at_file_name", "at_row_index"]))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources),
          ("token_output", token_output)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
