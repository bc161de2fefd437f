"""Bounded labelled samples for fitting, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def training_labels(labels: DataFrame, target: str, in_fold: Column, most: int, seed: int = 17) -> DataFrame:
    """doc_id and y of about most label rows at most, all of them where there are fewer.

    Rows are kept by a hash of their id, so that the choice is the same on every run.
    Null ids and null labels are left out; of rows that repeat an id, the larger label counts.
    """
    rows = labels.filter(in_fold & F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    n = rows.count()
    if n > most:
        parts = 1_000_000
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(parts)) < int(parts * most / n))
    return rows
