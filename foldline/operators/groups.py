"""Flags over siblings, levels that say nothing, capture groups and their leaders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import CAPTURE_SECONDS


def parent_flag(df: DataFrame, *, parent: str | list[str], when: Column, out: str) -> DataFrame:
    """Whether any row of the same parent meets the condition.

    The flags are aggregated (partially, before the shuffle) and joined back, so a parent that holds a third of all rows
    isn't one task's window.
    """
    keys = [parent] if isinstance(parent, str) else parent
    flags = df.filter(when).select(*keys).distinct().withColumn(out, F.lit(True))
    return df.join(flags, keys, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def uninformative(df: DataFrame, levels: dict[str, Column]) -> set[str]:
    """Levels with at most one distinct non-empty value over all rows: one pass, one row back."""
    if not levels:
        return set()
    value = {n: F.nullif(c, F.lit("")) for n, c in levels.items()}
    row = df.agg(*(F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(n) for n, c in value.items())).first()
    return {n for n in levels if not row[n]}


def agreeing_groups(df: DataFrame, *, keys: list[str], ts: str, voter: Column, device: str, window_seconds: float = CAPTURE_SECONDS) -> DataFrame:
    """Keys of groups of two rows or more whose voters lie within the window and name one device at most."""
    at = F.when(voter, F.col(ts))
    named = F.when(voter, F.nullif(F.col(device), F.lit("")))
    agg = df.groupBy(*keys).agg(F.count("*").alias("members"), F.min(at).alias("lo"), F.max(at).alias("hi"), F.min(named).alias("d0"), F.max(named).alias("d1"))
    span = (F.unix_micros(F.col("hi").cast("timestamp")) - F.unix_micros(F.col("lo").cast("timestamp"))) / F.lit(1_000_000.0)
    return agg.filter((F.col("members") >= 2) & (span <= window_seconds) & (F.coalesce(F.col("d0"), F.lit("")) == F.coalesce(F.col("d1"), F.lit("")))).select(*keys, "members")


def leaders(df: DataFrame, *, keys: list[str], score: Column, order: str, take: list[str]) -> DataFrame:
    """``take`` of the row of highest score, the first in order among equals, for each key; merged from partial maxima."""
    best = F.max_by(F.struct(*take), F.struct(score, -F.col(order)))
    return df.groupBy(*keys).agg(best.alias("_l")).select(*keys, *(F.col(f"_l.{t}").alias(f"leader_{t}") for t in take))


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], limit: int = 1) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= limit).drop("_r")
