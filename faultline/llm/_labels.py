"""Labelled rows to learn from, and those held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of the rows that may be learned from: not held out, no null; the larger label of an id labelled twice."""
    known = labels.filter(f"doc_id is not null and {column} is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    return known.filter(~held_out(F.col("doc_id")))


def training_sample(labels: DataFrame, column: str, per_class: int) -> list[tuple[int, int]]:
    """(doc_id, label) of at most ``per_class`` of the rows of :func:`labelled` of either class, chosen by hash."""
    known, rows = labelled(labels, column), []
    for value in (0, 1):
        rows += known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
    return [(r.doc_id, r.label) for r in rows]


def sampled(docs: DataFrame, sample: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, text, label) of the sampled documents; the sample is bounded, so it is broadcast."""
    ids = docs.sparkSession.createDataFrame(sample, "doc_id long, label int")
    return docs.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")
