"""Folder trees as tables: roll-ups over all ancestors, prefix rewriting, time slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import prefixes
from ..functions.times import auto_months, bucket_start, segment_label
from ..schema import APPROVED, PROPOSED


def roll_up(df: DataFrame, *, path: str, id: str, sample: str, lat: str | None = None, lon: str | None = None, samples: int = 3) -> DataFrame:
    """A row for every folder above any path: files below, the samples of the smallest ids, and the first coordinates.

    Counts are summed per leaf folder before ancestors are exploded; samples are folded three at a time by ``min`` over
    ranked leaves, so no folder's files are gathered.
    """
    from pyspark.sql.window import Window

    point = F.struct(F.col(id).alias("id"), F.col(lat).alias("lat"), F.col(lon).alias("lon")) if lat else F.lit(None).cast("struct<id:bigint,lat:double,lon:double>")
    leaf = df.withColumn("_dir", F.regexp_replace(path, r"/?[^/]*\z", "")).filter("_dir != ''")
    has = F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), point) if lat else point
    ranked = leaf.select("_dir", F.col(id).alias("_id"), F.col(sample).alias("_s"), has.alias("_p"))
    counts = ranked.groupBy("_dir").agg(F.count("*").alias("n"), F.min("_p").alias("p"))
    counts = counts.withColumn("node_id", F.explode(prefixes(F.col("_dir")))).groupBy("node_id").agg(F.sum("n").alias("file_count"), F.min("p").alias("p"))
    few = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("_dir").orderBy("_id"))).filter(F.col("_r") <= samples)
    few = few.withColumn("node_id", F.explode(prefixes(F.col("_dir"))))
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("node_id").orderBy("_id"))).filter(F.col("_r") <= samples)
    few = few.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_id", "_s"))), lambda x: x["_s"]).alias("samples"))
    node = F.col("node_id")
    return counts.join(few, "node_id").select(
        "node_id",
        F.regexp_replace(node, r"/?[^/]*\z", "").alias("parent_id"),
        F.regexp_extract(node, r"([^/]*)\z", 1).alias("name"),
        F.size(F.split(node, "/")).alias("depth"),
        "file_count",
        "samples",
        F.col("p.lat").alias("lat"),
        F.col("p.lon").alias("lon"),
    )


def rewrite_prefix(df: DataFrame, remap: DataFrame, *, path: str, old: str = "old", new: str = "new", out: str = "new_path") -> DataFrame:
    """Paths with their longest remapped ancestor replaced; null where none is.

    Only distinct folders meet the remap table, by equality with their exploded ancestors.
    """
    dirs = df.select(F.regexp_replace(path, r"/?[^/]*\z", "").alias("_dir")).distinct()
    above = dirs.withColumn("_p", F.explode(prefixes(F.col("_dir"))))
    hit = above.join(remap.select(F.col(old).alias("_p"), F.col(new).alias("_new")), "_p")
    best = hit.groupBy("_dir").agg(F.max_by(F.struct("_p", "_new"), F.length("_p")).alias("_b"))
    joined = df.withColumn("_dir", F.regexp_replace(path, r"/?[^/]*\z", "")).join(best, "_dir", "left")
    tail = F.substring(F.col(path), F.length("_b._p") + 1, F.length(path))
    return joined.withColumn(out, F.when(F.col("_b").isNotNull(), F.concat("_b._new", tail))).drop("_dir", "_b")


def segments(entries: DataFrame, *, ts: str = "taken_at", status: str = "status", path: str = "target_path", months: int = 0) -> DataFrame:
    """Calendar slices of what can be reviewed: label, start, stop, proposed, approved, folders; undated last.

    No rows when there are fewer than two slices or nothing is dated.  ``months`` of 0 chooses half years, or years beyond
    a span of three.
    """
    rows = entries.filter(F.col(status).isin(PROPOSED, APPROVED))
    lo, hi = rows.agg(F.min(ts), F.max(ts)).first()
    if lo is not None and months <= 0:
        months = auto_months(lo, hi)
    months = months or 6
    b = rows.withColumn("start", bucket_start(F.col(ts), months)).withColumn("_dir", F.regexp_replace(path, r"/?[^/]*\z", ""))
    key = F.coalesce(F.col("start").cast("string"), F.lit("undated"))
    b = b.withColumn("_k", key)
    counted = b.groupBy("_k", "start").agg(F.count_if(F.col(status) == PROPOSED).alias("proposed"), F.count_if(F.col(status) == APPROVED).alias("approved"))
    folders = b.select("_k", "_dir").distinct().filter("_dir != ''").withColumn("_p", F.explode(prefixes(F.col("_dir")))).select("_k", "_p").distinct().groupBy("_k").agg(F.count("*").alias("folders"))
    out = counted.join(folders, "_k", "left").select(
        F.when(F.col("start").isNull(), "Undated").otherwise(segment_label(F.col("start"), months)).alias("label"),
        "start",
        F.add_months("start", months).alias("stop"),
        "proposed",
        "approved",
        F.coalesce("folders", F.lit(0)).alias("folders"),
    )
    if lo is None:
        return out.filter(F.lit(False))
    from pyspark.sql.window import Window

    return out.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1)))).filter("_n > 1").drop("_n").orderBy(F.col("start").asc_nulls_last())


def in_segment(ts: str, start, stop):
    """Condition of one slice: all rows without limits, the undated for ("undated", None), else the half-open range."""
    if start == "undated":
        return F.col(ts).isNull()
    if start is None:
        return F.lit(True)
    return (F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(stop))
