"""Runs of consecutive days of one place, on whose labels all rows of a day agree."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def day_runs(df: DataFrame, *, keys: list[str], day: str) -> DataFrame:
    """One pass: first and last day of the run of consecutive days that each (key, day) lies in."""
    days = df.select(*keys, day).distinct()
    anchor = F.col(day) - F.row_number().over(Window.partitionBy(*keys).orderBy(day))
    w = Window.partitionBy(*keys, "_a")
    return days.withColumn("_a", anchor).withColumn("first_day", F.min(day).over(w)).withColumn("last_day", F.max(day).over(w)).drop("_a")


def settle(presence: Iterable[tuple[int, str]]) -> dict[tuple[int, str], str]:
    """Labels of (day, place) of one month.  Every place of a day, the empty one too, must bear one label, else the day
    breaks all runs; repeated until no further day breaks."""
    pairs = sorted({(int(d), p or "") for d, p in presence})
    broken: set[int] = set()
    while True:
        label: dict[tuple[int, str], str] = {}
        by_place: dict[str, list[int]] = {}
        for d, p in pairs:
            if p and d not in broken:
                by_place.setdefault(p, []).append(d)
        for p, days in by_place.items():
            run: list[int] = []
            for d in [*days, None]:
                if run and d != run[-1] + 1:
                    if len(run) > 1:
                        label |= {(x, p): f"{run[0]:02d}_{run[-1]:02d}" for x in run}
                    run = []
                if d is not None:
                    run.append(d)
        said: dict[int, set[str]] = {}
        for d, p in pairs:
            if d not in broken:
                said.setdefault(d, set()).add(label.get((d, p), ""))
        new = {d for d, labels in said.items() if len(labels) > 1}
        if not new:
            return label
        broken |= new


def merged_days(df: DataFrame, *, month: str, place: str, day: str, out: str = "day_range") -> DataFrame:
    """(month, place, day, label) of all that settle into a run.  At most 31 days times its places go to a task for a month:
    the rows are distinct, as all that matters is what occurs."""
    votes = df.select(F.col(month).alias("m"), F.coalesce(F.col(place), F.lit("")).alias("p"), F.col(day).cast("int").alias("d")).distinct()

    def one(pdf):
        import pandas as pd

        label = settle(zip(pdf["d"], pdf["p"], strict=True))
        return pd.DataFrame([(pdf["m"].iloc[0], p, d, x) for (d, p), x in label.items()], columns=["m", "p", "d", "x"])

    kind = votes.schema["m"].dataType.simpleString()
    got = votes.groupBy("m").applyInPandas(one, f"m {kind}, p string, d int, x string")
    return got.select(F.col("m").alias(month), F.col("p").alias(place), F.col("d").alias(day), F.col("x").alias(out))
