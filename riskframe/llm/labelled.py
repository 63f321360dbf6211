"""Labelled rows for training, and how scores are returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.shared import small_side, stored

#: Rows whose crc32(doc_id as text) leaves this remainder by FOLDS are never trained on.
FOLDS, HELD = 5, 0
#: Labelled rows that a classifier is fitted on, at most: those whose hashed id is smallest.
SAMPLE_ROWS = 20_000


def held_out(folds: int = FOLDS, held: int = HELD) -> Column:
    """Whether a row is held out; a null doc_id is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(True))


def _known(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) outside the held-out fold; a document with several labels counts as 1 if any is 1."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    return known.where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))


def _texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, text, label): an id that several rows have stands for one of them, that with the smallest hash of its text."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, "doc_id")
    order = F.struct(F.xxhash64("text"), "text")
    return found.groupBy("doc_id").agg(F.min_by(F.struct("text", "label"), order).alias("r")).select("doc_id", "r.*")


def whole(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, label) of every labelled document outside the held-out fold, by the rules of ``sample``."""
    return _texts(docs, small_side(stored(_known(labels, label), "labelled")))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents outside the held-out fold.

    A document with several labels counts as 1 if any is 1; null labels and ids are left out. An id that several rows have stands
    for one of them, that with the smallest hash of its text, so that ``rows`` bounds the rows, too.
    """
    known = _known(labels, label)
    known = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labelled")
    return stored(_texts(docs, F.broadcast(known)), "sample")  # bounded by ``rows``, so it may be broadcast
