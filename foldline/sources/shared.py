"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or on a local master, where unset, a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="foldline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: What this process has cut and not deleted.
_MADE: set[str] = set()


def clean_up(spark: SparkSession) -> int:
    """Delete what was cut, once no plan that reads it is needed any more; how many tables there were."""
    n = len(_MADE)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _MADE:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        p.getFileSystem(conf).delete(p, True)
    return n


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """The same rows from a written table: later steps that read them twice don't work them out twice, and a lost executor loses none."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.add(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
