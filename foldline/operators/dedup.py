"""Identical content: sizes that occur once, identities, groups, and the election of one master a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_score, path_bytes


def unique_keys(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n = 1").select(key)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def content_identity(df: DataFrame, *, id: str, size: str, content: Column, out: str = "file_hash") -> DataFrame:
    """A row's identity: its id where its size occurs once (its content is then never read), else the hash of its content."""
    alone = unique_keys(df, size).withColumn("_alone", F.lit(True))
    joined = df.join(alone, size, "left")
    return joined.withColumn("hash_kind", F.when(F.col("_alone"), "size").otherwise("content")).withColumn(
        out, F.when(F.col("_alone"), F.concat(F.lit("size:"), F.col(id).cast("string"))).otherwise(F.sha2(content.cast("binary"), 256))
    ).drop("_alone")


def _best(dir: str = "file_dir", name: str = "file_name") -> list[Column]:
    """Highest score, then shortest path in bytes, then folder and name, as ascending columns."""
    return [-file_score(F.col(dir), F.col(name)), path_bytes(F.col(dir), F.col(name)), F.col(dir), F.col(name)]


def elect_by(df: DataFrame, key: str, order: list[Column], id: str, out: str = "is_master") -> DataFrame:
    """Flags the first row of each group under ``order`` (ascending), then ``id``.

    Partial minima are merged, and the winners' ids, not the groups, meet the rows again, so no group comes together in a task.
    """
    won = df.groupBy(key).agg(F.min(F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order)), F.col(id).alias("_id"))).alias("_w"))
    won = won.select(F.col("_w._id").alias(id), F.lit(True).alias("_won"))
    return df.join(won, id, "left").withColumn(out, F.coalesce("_won", F.lit(False))).drop("_won")


def elect_masters(df: DataFrame, *, key: str = "file_hash", dir: str = "file_dir", name: str = "file_name", id: str = "file_id") -> DataFrame:
    """The best-named file of each group."""
    return elect_by(df, key, _best(dir, name), id)


def winners(df: DataFrame, key: str, score: Column, ties: list[str]) -> DataFrame:
    """One row a group, by aggregation alone: partial maxima are merged, so a hot group never comes together in one task."""
    best = F.max_by(F.struct(*df.columns), F.struct(score, *(F.col(t) for t in ties)))
    return df.groupBy(key).agg(best.alias("_w")).select("_w.*")


def settle_masters(members: DataFrame, *, key: str = "file_hash", live: str = "is_live", id: str = "file_id") -> DataFrame:
    """After an election: a lone live survivor of a group is its master again; deleted members of a group that has
    several live ones are demoted with the rest, and otherwise stay as they were.

    Live rows meet the winners by id; only deleted ones meet their groups.
    """
    alive = members.filter(F.col(live))
    won = elect_by(alive, key, _best(), id)
    gone = members.filter(~F.coalesce(F.col(live), F.lit(False)))
    crowded = repeated_keys(alive, key).select(key, F.lit(True).alias("_c"))
    gone = gone.join(crowded, key, "left").withColumn("is_master", F.when(F.col("_c"), F.lit(False)).otherwise(F.col("is_master")))
    return won.select(*members.columns).unionByName(gone.select(*members.columns))
