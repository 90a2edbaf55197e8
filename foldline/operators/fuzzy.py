"""Names found despite typing errors: shared trigrams choose, edit distance decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import trigrams


def trigram_index(names: DataFrame, *, id: str, name: str) -> DataFrame:
    """(trigram, id) pairs."""
    return names.select(F.col(id), F.explode(F.array_distinct(trigrams(F.col(name)))).alias("trigram"))


def search(names: DataFrame, wanted: str, *, id: str, name: str, index: DataFrame | None = None, pool: int = 500, most: int = 2, limit: int = 8) -> DataFrame:
    """The names within ``most`` edits of one typed, nearest first, out of the ``pool`` that share most trigrams with it."""
    spark = names.sparkSession
    index = index or trigram_index(names, id=id, name=name)
    asked = spark.createDataFrame([(wanted,)], "w string").select(F.explode(F.array_distinct(trigrams(F.col("w")))).alias("trigram"))
    shared = index.join(F.broadcast(asked), "trigram").groupBy(id).agg(F.count("*").alias("overlap"))
    best = shared.orderBy(F.desc("overlap"), id).limit(pool)
    far = F.levenshtein(F.lower(F.col(name)), F.lit(wanted.lower()))
    return names.join(best, id).withColumn("edits", far).filter(F.col("edits") <= most).orderBy("edits", F.desc("overlap"), name, id).limit(limit)


def match_all(names: DataFrame, queries: DataFrame, *, id: str, name: str, query_id: str, query: str, most: int = 2) -> DataFrame:
    """Every (query, name) within ``most`` edits that shares a trigram, nearest first: for a stated query set.

    An edit touches three trigrams at most, so of any ``3 * most + 1`` of a query's trigrams a match has one: only that many,
    the rarest, are joined by.  Pairs whose lengths are farther apart than the edits go before distances are worked out.
    """
    grams = lambda c: F.array_distinct(trigrams(F.col(c)))
    a = names.select(F.col(id), F.col(name), grams(name).alias("_a"))
    ga = a.select(F.col(id), F.col(name), "_a", F.explode("_a").alias("_g"))
    b = queries.select(F.col(query_id), F.col(query), grams(query).alias("_b"))
    gb = b.select(F.col(query_id), F.col(query), "_b", F.explode("_b").alias("_g"))
    common = ga.groupBy("_g").agg(F.count("*").alias("_n"))
    rare = Window.partitionBy(query_id).orderBy(F.coalesce("_n", F.lit(0)), "_g")
    gb = gb.join(common, "_g", "left").withColumn("_r", F.row_number().over(rare)).filter(F.col("_r") <= 3 * most + 1).drop("_n", "_r")
    met = gb.join(ga, "_g").filter(F.abs(F.length(name) - F.length(query)) <= most).drop("_g")
    d = F.levenshtein(F.lower(F.col(name)), F.lower(F.col(query)))
    met = met.withColumn("edits", d).filter(F.col("edits") <= most).dropDuplicates([query_id, id])
    met = met.withColumn("overlap", F.size(F.array_intersect("_a", "_b")).cast("long")).drop("_a", "_b")
    return met.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy("edits", F.desc("overlap"), name, id)))
