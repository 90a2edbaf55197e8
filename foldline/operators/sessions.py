"""Sessions by time gaps, and what is said of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import span_label
from ..schema import SPAN_SECONDS


def _seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000.0)


def gap_sessions(df: DataFrame, *, ts: str, gap_seconds: float, keys: list[str] | None = None, order: list[str] | None = None, out: str = "session") -> DataFrame:
    """Numbers the sessions of each key from 1; a row begins one iff it comes more than the gap after the row before.

    Rows without a time are one session, the first.  With ``keys`` each key is a window of its own; without, see ``global_sessions``.
    """
    if not keys:
        return global_sessions(df, ts=ts, gap_seconds=gap_seconds, out=out)
    w = Window.partitionBy(*keys).orderBy(F.col(ts).asc_nulls_first(), *(order or []))
    before = F.lag(ts).over(w)
    new = F.when(F.row_number().over(w) == 1, 1).when(before.isNull() & F.col(ts).isNotNull(), 1).when(_seconds(F.col(ts)) - _seconds(before) > gap_seconds, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def global_sessions(df: DataFrame, *, ts: str, gap_seconds: float, out: str = "session") -> DataFrame:
    """Sessions over all rows without ordering them in one task.

    Rows fall into buckets at least a gap wide.  Only each bucket's first and last time can meet another bucket's, so the
    buckets' summaries are ordered (few rows, whatever the table's size), sessions begun before each bucket counted, and
    the rest numbered within buckets.  A bucket is a quarter of an hour or a gap, so a busy day is many; rows without a time
    take no part.
    """
    width = max(float(gap_seconds), 900.0)
    dated = df.filter(F.col(ts).isNotNull()).withColumn("_b", F.floor(_seconds(F.col(ts)) / width).cast("long"))
    inner = Window.partitionBy("_b").orderBy(ts)
    begins = F.coalesce(_seconds(F.col(ts)) - _seconds(F.lag(ts).over(inner)) > gap_seconds, F.lit(False))
    inside = dated.withColumn("_new", begins.cast("int")).withColumn("_at", F.sum("_new").over(inner.rangeBetween(Window.unboundedPreceding, 0)))
    sums = inside.groupBy("_b").agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.sum("_new").alias("_n"))
    along = Window.orderBy("_b")
    starts = F.coalesce(_seconds(F.col("_lo")) - _seconds(F.lag("_hi").over(along)) > gap_seconds, F.lit(True)).cast("int")
    sums = sums.withColumn("_s", starts)
    sums = sums.withColumn("_base", F.sum(F.col("_s") + F.coalesce(F.lag("_n").over(along), F.lit(0))).over(along)).select("_b", "_base")
    undated = df.filter(F.col(ts).isNull())
    first = undated.limit(1).agg(F.count("*").alias("_u"))  # one row: whether session 1 is that of rows without a time
    joined = inside.join(sums, "_b").crossJoin(F.broadcast(first))
    numbered = joined.withColumn(out, (F.col("_base") + F.col("_at") + F.col("_u")).cast("long")).drop("_b", "_new", "_at", "_base", "_u")
    return numbered.unionByName(undated.withColumn(out, F.lit(1).cast("long")))


def session_starts(df: DataFrame, *, ts: str, session: str, keys: list[str] | None = None, span_seconds: float = SPAN_SECONDS, out: str = "folder_date") -> DataFrame:
    """The session's start for every row of a session no longer than the span; else nothing."""
    w = Window.partitionBy(*(keys or []), session)
    lo, hi = F.min(ts).over(w), F.max(ts).over(w)
    return df.withColumn(out, F.when(_seconds(hi) - _seconds(lo) <= span_seconds, lo))


def name_unlocated(df: DataFrame, *, ts: str, session: str, located: Column, keys: list[str] | None = None, wall: str | None = None) -> DataFrame:
    """Sessions without any located row get ids c1, c2, … in time order, and a label of their days."""
    keys = keys or []
    per = df.groupBy(*keys, session).agg(F.max(located.cast("int")).alias("_located"), F.min(wall or ts).alias("_lo"), F.max(wall or ts).alias("_hi"))
    per = per.filter("_located = 0").drop("_located")
    along = Window.partitionBy(*keys).orderBy(session) if keys else Window.orderBy(session)
    named = per.withColumn("cluster_id", F.concat(F.lit("c"), F.row_number().over(along).cast("string"))).withColumn("event_segment", span_label(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    return df.join(named, [*keys, session], "left")
