"""Reconciliation checks: every check yields rows (check_name, severity, subject, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.intervals import overlap_audit


def check(df: DataFrame, name: str, severity: str, failed: Column, subject: Column, detail: Column) -> DataFrame:
    return df.filter(failed).select(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def all_checks(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def unused_material(items: DataFrame, keys: list[str], used: Column, usable: Column) -> DataFrame:
    """keys where nothing was used although something could have been."""
    per = items.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(used).alias("used"), F.count_if(usable).alias("usable"))
    return check(per, "unused_material", "error", (F.col("used") == 0) & (F.col("usable") > 0), F.concat_ws("/", *keys), F.format_string("0 of %d used, %d usable", "n", "usable"))


def duration_off(df: DataFrame, subject: Column, final: Column, planned: Column, most: float = 0.25) -> DataFrame:
    return check(df, "duration_off", "warning", F.abs(final - planned) > most * planned, subject, F.round(final / planned, 3))


def repeated_captions(df: DataFrame, keys: list[str], text: str, start: str, within: float = 2.5) -> DataFrame:
    """Captions whose text stood less than ``within`` seconds before in the same group."""
    prev = F.lag(start).over(Window.partitionBy(*keys, text).orderBy(start))
    x = df.withColumn("_gap", F.col(start) - prev)
    return check(x, "repeated_caption", "warning", F.col("_gap") < within, F.concat_ws("/", *keys), F.round("_gap", 3))


def implication(df: DataFrame, name: str, subject: Column, given: Column, then: Column) -> DataFrame:
    """Rows where a fact holds and what must follow does not; unknown facts accuse nobody."""
    return check(df, name, "error", F.coalesce(given & ~then, F.lit(False)), subject, F.lit("given holds, consequence fails"))


# The checks' limits.
QUIET_DB, CAPTION_SLACK, TAIL_SLACK, COMPREHENSION = -45.0, 0.05, 0.15, 60.0


def quiet_pieces(df: DataFrame, subject: Column, has_lines: Column, db: Column) -> DataFrame:
    """Pieces that have lines to speak but next to no sound."""
    return check(df, "quiet_piece", "error", F.coalesce(has_lines & (db < QUIET_DB), F.lit(False)), subject, F.round(db, 1))


def listed(df: DataFrame, name: str, subject: Column, marked: Column, value: Column) -> DataFrame:
    """What was truncated, stretched or downgraded, with the value that says how far."""
    return check(df, name, "warning", F.coalesce(marked, F.lit(False)), subject, value)


def overlapping_captions(df: DataFrame, keys: list[str], order: list[str], subject: Column) -> DataFrame:
    over = overlap_audit(df, keys, order, CAPTION_SLACK)
    return check(over, "overlapping_caption", "error", F.lit(True), subject, F.round("overlap", 3))


def past_the_end(df: DataFrame, subject: Column, end: Column, duration: Column) -> DataFrame:
    return check(df, "past_the_end", "error", end > duration + TAIL_SLACK, subject, F.round(end - duration, 3))


def burned_unreadable(df: DataFrame, subject: Column, burned: Column, cues: Column) -> DataFrame:
    """Captions that are said to be in the picture, of which none can be read."""
    return check(df, "burned_unreadable", "error", F.coalesce(burned & (cues == 0), F.lit(False)), subject, F.lit("no cue"))


def unresolved_audits(df: DataFrame, subject: Column, open_: Column) -> DataFrame:
    return check(df, "audit_unresolved", "error", F.coalesce(open_ > 0, F.lit(False)), subject, open_)


def low_comprehension(df: DataFrame, subject: Column, score: Column) -> DataFrame:
    return check(df, "low_comprehension", "error", F.coalesce(score < COMPREHENSION, F.lit(False)), subject, F.round(score, 1))
