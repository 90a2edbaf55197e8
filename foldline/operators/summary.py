"""Figures of whole tables and of groups: extents, sizes, distinct values, set digests, prefixes within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def volume_groups(df: DataFrame, *, volume: str, first: str, out: str = "first") -> DataFrame:
    """Of each volume (unknown ones are the empty one): its least ``first`` and its rows."""
    return df.groupBy(F.coalesce(volume, F.lit("")).alias("volume")).agg(F.min(first).alias(out), F.count("*").alias("n"))


def library_size(df: DataFrame, *, size: str) -> DataFrame:
    """One row: bytes and files; an empty table has none of either."""
    return df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("library_bytes"), F.count("*").alias("files"))


def extent(df: DataFrame, *, ts: str) -> DataFrame:
    """One row: first and last time, and rows."""
    return df.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))


def distinct_values(df: DataFrame, *, column: str, out: str) -> DataFrame:
    """Each value once, in order, nulls and empty ones left out."""
    return df.filter(F.col(column) != "").select(F.col(column).alias(out)).distinct().orderBy(out)


def set_fingerprint(df: DataFrame, *, keys: list[str], member: str) -> DataFrame:
    """A digest of each group's members that no order changes: their number, and sum and xor of their hashes (60 bits of MD5).

    Partial sums meet, members don't: a group of any size costs one row a task.  Repeated members count as often as they occur.
    """
    h = F.conv(F.substring(F.md5(F.col(member).cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    g = df.select(*keys, h.alias("_h")).groupBy(*keys)
    g = g.agg(F.count("*").alias("members"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("_s"), F.bit_xor("_h").alias("_x"))
    text = F.concat_ws(":", F.col("members").cast("string"), F.col("_s").cast("string"), F.col("_x").cast("string"))
    return g.withColumn("fingerprint", F.sha2(text.cast("binary"), 256)).drop("_s", "_x")


def within_budget(df: DataFrame, *, keys: list[str], order: str, size: str, budget: int, chunk: Column | None = None, out: str = "running") -> DataFrame:
    """The rows of each group, in ``order`` (a number), up to which their sizes sum to the budget at most.

    Sums of chunks of neighbours come first; only rows of chunks that begin within the budget are ordered one by one.
    """
    rows = df.withColumn("_c", chunk if chunk is not None else F.floor(F.col(order) / 64))
    sums = rows.groupBy(*keys, "_c").agg(F.sum(size).alias("_s"))
    along = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(along), F.lit(0))).filter(F.col("_before") <= budget).drop("_s")
    sums = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_c").alias("_kc"), "_before")
    on = F.col("_c").eqNullSafe(F.col("_kc"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    both = rows.join(sums, on).select(*df.columns, "_c", "_before")
    w = Window.partitionBy(*keys, "_c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.col("_before") + F.sum(size).over(w)).filter(F.col(out) <= budget).drop("_c", "_before")
