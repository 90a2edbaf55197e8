import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foldline.functions import times
from foldline.functions.text import device_name
from foldline.plans.planner import plan, preview_paths
from foldline.schema import PlanConfig

CASES = json.loads((Path(__file__).parent / "data/plans.json").read_text())
SCHEMA = "file_id long, file_dir string, file_name string, media_type string, dto string, mtime string, location string, at_saved_place boolean, is_screenshot boolean, make string, model string"


def config(c: dict) -> PlanConfig:
    names = {"collapse": "collapse_levels", "merge": "merge_days", "gap_s": "gap_seconds", "rules": "rules"}
    return PlanConfig(**{names[k]: tuple(v) if k == "rules" else v for k, v in c.items()})


def rows(spark, data):
    df = spark.createDataFrame([(i, *r[:6], bool(r[6]), bool(r[7]), *r[8:]) for i, r in enumerate(data)], SCHEMA)
    df = df.withColumn("taken_at", times.first_time(F.col("dto"), F.col("mtime"))).withColumn("taken_wall", F.col("taken_at"))
    df = df.withColumn("has_exif_time", F.col("dto") != "").withColumn("device", device_name(F.col("make"), F.col("model")))
    return df.withColumn("width", F.lit(0)).withColumn("height", F.lit(0))


@pytest.mark.parametrize("case", CASES, ids=[c["name"] for c in CASES])
def test_golden(spark, case):
    got = {r["file_name"]: r["target_path"] for r in plan(rows(spark, case["rows"]), config(case["cfg"])).collect()}
    for name, want in case["expect"].items():
        assert got[name] == want


def test_clashing_names(spark):
    t = "2024:06:03 10:00:00"
    data = [[f"/d{i}", n, "IMAGE", t, "", "", 0, 0, "", ""] for i, n in enumerate(["IMG_1.JPG", "img_1.jpg", "IMG_1_2.JPG"])]
    got = [r["target_path"] for r in plan(rows(spark, data)).orderBy("file_id").collect()]
    assert len({g.lower() for g in got}) == 3 and got[0] == "2024/06_June/03/IMG_1.JPG"


def test_order_and_partitions_dont_matter(spark):
    data = [[f"/s{i % 7}", f"IMG_{i % 30}.JPG", "IMAGE", f"2024:0{1 + i % 3}:{1 + i % 25:02d} {i % 24:02d}:00:00", "", ["", "Goa", "Pune"][i % 3], 0, i % 11 == 0, "", ""] for i in range(300)]
    a = {r["file_id"]: r["target_path"] for r in plan(rows(spark, data)).collect()}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        b = {r["file_id"]: r["target_path"] for r in plan(rows(spark, data).repartition(11)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b and len(set(a.values())) == 300


def test_preview_and_no_levels(spark):
    s = [{"name": "a.jpg", "taken": "2024:08:02 10:00:00", "location": "goa beach"}, {"name": "b.mp4", "taken": None}]
    assert preview_paths(spark, PlanConfig(), s) == ["2024/08_August/02/Goa-Beach/a.jpg", "Unsorted/b.mp4"]
    assert preview_paths(spark, PlanConfig(rules=("none",)), s)[0] == "2024/08_August/a.jpg"
