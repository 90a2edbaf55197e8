"""Unique target names: the first free of name, name_2, name_3, … in a given order, letter case aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _split(name: str) -> tuple[str, str]:
    at = name.rfind(".")
    return (name, "") if at < 0 else (name[:at], name[at:])


def claim(directory: str, name: str, taken: set[str], hints: dict[str, int] | None = None) -> str:
    """The first free path; ``hints`` remembers where counting stopped for a name, as taken paths never come free."""
    stem, ext = _split(name)
    key = f"{directory}/{name}".lower()
    n = (hints or {}).get(key, 1)
    while True:
        path = f"{directory}/{stem}{'' if n == 1 else f'_{n}'}{ext}"
        if path.lower() not in taken:
            taken.add(path.lower())
            if hints is not None:
                hints[key] = n + 1
            return path
        n += 1


def unique_targets(df: DataFrame, *, directory: str, name: str, order: list[str], out: str = "target_path") -> DataFrame:
    """Claims paths folder by folder (letter case aside) in ``order``.

    Only names whose stem, less trailing _digits, is the same can meet: a family.  A family in which no name occurs twice keeps
    all its names, and one of a single name is numbered by a window; neither leaves the JVM.  The others go to a task each,
    streamed in order with just the set of taken paths held.
    """
    import pandas as pd
    from pyspark.sql.types import StringType, StructField, StructType

    low, base = F.lower(F.col(directory)), F.lower(F.col(name))
    stem = F.regexp_replace(base, r"\.[^.]*\z", "")
    ext = F.regexp_extract(base, r"(\.[^.]*)\z", 1)
    family = F.concat_ws("\0", low, F.regexp_replace(stem, r"(_\d+)+\z", ""), ext)
    keyed = df.withColumn("_family", family)
    sizes = keyed.groupBy("_family", base.alias("_base")).agg(F.count("*").alias("_n"))
    sizes = sizes.groupBy("_family").agg(F.max("_n").alias("_most"), F.count("*").alias("_names"))
    keyed = keyed.join(sizes, "_family")
    whole = F.concat_ws("/", F.col(directory), F.col(name))
    lone = keyed.filter("_most = 1").withColumn(out, whole).drop("_family", "_most", "_names")
    n = F.row_number().over(Window.partitionBy("_family").orderBy(*order))
    first = F.regexp_replace(F.col(name), r"\.[^.]*\z", "")
    last = F.regexp_extract(F.col(name), r"(\.[^.]*)\z", 1)
    counted = F.concat(F.col(directory), F.lit("/"), first, F.when(n > 1, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), last)
    alike = keyed.filter("_most > 1 AND _names = 1").withColumn(out, counted).drop("_family", "_most", "_names")
    many = keyed.filter("_most > 1 AND _names > 1").drop("_most", "_names")
    schema = StructType([*lone.drop(out).schema.fields, StructField(out, StringType())])
    columns = [f.name for f in schema.fields[:-1]]

    def run(batches):
        now, taken, hints = None, set(), {}
        for pdf in batches:
            got = []
            for fam, d, n in zip(pdf["_family"], pdf[directory], pdf[name], strict=True):
                if fam != now:
                    now, taken, hints = fam, set(), {}
                got.append(claim(d, n, taken, hints))
            new = pdf[columns].copy()
            new[out] = pd.Series(got, index=pdf.index, dtype=object)
            yield new

    claimed = many.select("_family", *columns).repartition("_family").sortWithinPartitions("_family", *order).mapInPandas(run, schema)
    return lone.unionByName(alike).unionByName(claimed)


def reclaim(df: DataFrame, *, path: str, moved: str, order: list[str], out: str = "target_path") -> DataFrame:
    """After edits: rows that stay claim their paths first, moved ones take what is free next, in order."""
    split = df.withColumn("_dir", F.regexp_replace(path, r"/?[^/]*\z", "")).withColumn("_name", F.regexp_extract(path, r"([^/]*)\z", 1))
    return unique_targets(split, directory="_dir", name="_name", order=[moved, *order], out="_target").drop("_dir", "_name").withColumn(out, F.col("_target")).drop("_target")
