import os

import pytest
from pyspark.sql import functions as F

from foldline.plans import places as P
from foldline.plans import review as R
from foldline.plans.planner import propose
from foldline.schema import ENTRIES, PlanConfig
from foldline.sources import files, store

PLACES = [
    (1, "Shimla", 31.10442, 77.16662, "Himachal Pradesh", "India", "IN"), (2, "Hyderabad", 17.38405, 78.45636, "Telangana", "India", "IN"), (3, "Hyderabad", 25.39689, 68.37718, "Sindh", "Pakistan", "PK"),
    (4, "Banjār", 31.639, 77.34055, "Himāchal Pradesh", "India", "IN"), (5, "Springfield", 39.80172, -89.64371, "Illinois", "United States", "US"), (6, "Springfield", 37.21533, -93.29824, "Missouri", "United States", "US"),
    (7, "Panauti", 27.58466, 85.52122, None, "Nepal", "NP"), (8, "Panautī", 27.58447, 85.51487, None, "Nepal", "NP"),
]


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame(PLACES, "rowid long, city string, latitude double, longitude double, state string, country string, country_code string")


def test_places(spark, places):
    rich = P.enrich(places).cache()
    pts = spark.createDataFrame([(1, 17.4, 78.45), (2, 31.37442, 77.16662), (3, 27.5845, 85.515), (4, 0.0, 0.0), (5, None, None)], "k long, lat double, lon double")
    got = {r["k"]: r["place"] for r in P.lookup(pts, rich, key="k", lat="lat", lon="lon", order=["k"]).collect()}
    assert got == {1: "Hyderabad, India", 2: "Shimla", 3: "Panauti"}
    assert P.resolve(rich, "hyderabad, Sindh") == (25.39689, 68.37718) and P.resolve(rich, "banjar") == (31.639, 77.34055) and P.resolve(rich, "Atlantis") is None
    assert [r["full_name"] for r in P.search(rich, "spring").collect()] == ["Springfield, Illinois, United States", "Springfield, Missouri, United States"]
    assert P.canonical(rich, "shimla") == "Shimla, Himachal Pradesh, India" and P.canonical(rich, "Qqqqq") == "Qqqqq"
    with pytest.raises(ValueError):
        P.canonical(rich, "Hyderbad")
    assert [a.folder for a in P.build_anchors(rich, ["Hyderabad, Telangana, India", "Nope", "Hyderabad, Sindh, Pakistan"])] == ["Hyderabad - India", "Hyderabad - Pakistan"]
    prior = spark.createDataFrame([("Spring Fair",), ("Other",)], "label string")
    assert [r["value"] for r in P.suggest(rich, "spr", prior)] == ["Spring-Fair", "Springfield-Illinois", "Springfield-Missouri"]


def test_scan_and_store(spark, tmp_path):
    root = tmp_path / "photos"
    for name, size in (("IMG_001.jpg", 1024), ("IMG_002.heic", 2048), ("IMG_002.aae", 128), ("raw/_MG_100.cr2", 4096), ("videos/clip.mp4", 8192), ("junk/readme.txt", 64), ("junk/.DS_Store", 32), (".git/HEAD.jpg", 23), ("a/b/c/d/deep.png", 5)):
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * size)
    assert files.reduce_roots([str(root), str(root / "raw"), str(root)]) == [str(root)]
    seen = files.walk(spark, [str(root)]).withColumn("volume_uuid", F.lit(None).cast("string"))
    assert sorted(r["file_name"] for r in seen.collect()) == ["IMG_001.jpg", "IMG_002.aae", "IMG_002.heic", "_MG_100.cr2", "clip.mp4", "deep.png"]
    assert files.hash_files(seen.select("file_dir", "file_name")).filter("content_hash IS NULL").count() == 0
    s = store.Store(spark, f"file://{tmp_path}/store")
    assert s.commit(file_registry=store.upsert(s.read("file_registry"), seen, "2024-01-01"))["file_registry"] == 6
    done = s.read("file_registry").select(F.col("id").alias("file_id"))
    s.commit(file_registry=store.mark_read(s.read("file_registry"), done, done.limit(0)))
    (root / "IMG_001.jpg").write_bytes(b"changed")
    os.remove(root / "videos/clip.mp4")
    again = files.walk(spark, [str(root)]).withColumn("volume_uuid", F.lit("v"))
    s.commit(file_registry=store.sweep(store.upsert(s.read("file_registry"), again, "2024-01-02"), [str(root)], "2024-01-02"))
    got = {r["file_name"]: (r["scan_status"], r["deleted_at"]) for r in s.read("file_registry").collect()}
    assert got["IMG_001.jpg"] == ("DISCOVERED", None) and got["IMG_002.heic"] == ("ANALYZED", None) and got["clip.mp4"] == ("ANALYZED", "2024-01-02")
    reg, meta, entries = store.purge(s.read("file_registry"), s.read("file_metadata"), s.read("entries"), "2024-02-01")
    assert reg.count() == 5 and meta.count() == 0 and entries.count() == 0
    assert s.reset()["file_registry"] == 6 and s.read("file_registry").count() == 0


def entries(spark, rows):
    return spark.createDataFrame([(i, f"/s/{i}", t, None, st, None, None, None) for i, t, st in rows], ENTRIES)


def test_proposals(spark):
    e = entries(spark, [(1, "a", "PROPOSED"), (2, "b", "APPROVED"), (3, "c", "APPROVED")])
    new = entries(spark, [(1, "a2", "PROPOSED"), (2, "b2", "PROPOSED"), (4, "d", "PROPOSED")])
    masters = spark.createDataFrame([(1,), (2,), (4,)], "file_id long")
    assert {(r["file_id"], r["target_path"]) for r in store.replace_proposals(e, new, masters).collect()} == {(1, "a2"), (2, "b"), (4, "d")}


def test_review_edits(spark):
    e = entries(spark, [(1, "2024/01/01_02/Goa/x.jpg", "PROPOSED"), (2, "2024/01/09/Goa/x.jpg", "PROPOSED"), (3, "2024/01/09/y.jpg", "APPROVED"), (4, "2024/02/z.jpg", "DONE")])
    tree = R.build_tree(R.folder_table(e))
    assert R.find(tree, "2024/01").files == 3 and R.find(tree, "2024/02") is None
    h = R.History(tree)
    h.apply(R.merge, ["2024/01/01_02", "2024/01/09"])
    assert [c.name for c in R.find(h.tree, "2024/01").children] == ["01_09"]
    out = {r["file_id"]: (r["target_path"], r["status"]) for r in R.confirm(e, h.tree).collect()}
    assert out[1][0] == "2024/01/01_09/Goa/x.jpg" and out[2][0] == "2024/01/01_09/Goa/x_2.jpg" and out[3] == ("2024/01/01_09/y.jpg", "APPROVED") and out[4] == ("2024/02/z.jpg", "DONE") and out[1][1] == "APPROVED"
    assert h.undo() and R.find(h.tree, "2024/01/09")
    flat, n = R.flatten(h.tree, ["2024/01"])
    assert n == 4 and R.remap(flat)["2024/01/09/Goa"] == "2024/01"
    assert R.remap(R.drop(h.tree, ["2024/01/09"]))["2024/01/09"] == "2024/01"
    for bad in (lambda: R.drop(h.tree, ["2024"]), lambda: R.merge(h.tree, ["2024/01"]), lambda: R.flatten(h.tree, ["2024/01/09/Goa"]), lambda: R.rename(h.tree, "2024", "a/b")):
        with pytest.raises(R.EditError):
            bad()


def test_settings(tmp_path):
    p = str(tmp_path / "c.json")
    files.save_config(PlanConfig(rules=("location",), gap_seconds=5), p)
    cfg, warn = files.load_config(p, {"fallback": "Misc"}, {"FOLDLINE_GAP_SECONDS": "7", "FOLDLINE_MERGE_DAYS": "no", "FOLDLINE_COLLAPSE_LEVELS": "perhaps"})
    assert (cfg.rules, cfg.gap_seconds, cfg.fallback, cfg.merge_days) == (("location",), 7, "Misc", False) and len(warn) == 1
    assert files.config_stamp(cfg) == files.config_stamp(PlanConfig(rules=("location",), merge_days=False)) != files.config_stamp(PlanConfig())


def test_propose_end_to_end(spark, places):
    rows = [(1, "/p", "a.jpg", "IMAGE", "2024:08:02 10:00:00", 17.4, 78.45), (2, "/p", "b.jpg", "IMAGE", "2024:08:02 11:00:00", 31.1, 77.1), (3, "/p", "c.jpg", "IMAGE", None, None, None)]
    m = spark.createDataFrame(rows, "file_id long, file_dir string, file_name string, media_type string, exif_date_time_original string, exif_gps_latitude double, exif_gps_longitude double")
    for c, k in (("exif_creation_date", "string"), ("exif_create_date", "string"), ("exif_media_create_date", "string"), ("exif_image_width", "int"), ("exif_image_height", "int"), ("exif_image_orientation", "int"), ("exif_make", "string"), ("exif_model", "string")):
        m = m.withColumn(c, F.lit(None).cast(k))
    m = m.withColumn("file_modified_at", F.lit("2024-08-02T12:00:00.000000000Z")).withColumn("is_screenshot", F.lit(False))
    got = {r["file_id"]: r["target_path"] for r in propose(m, PlanConfig(saved_places=("Shimla",)), places).collect()}
    assert got == {1: "2024/08_August/02/Hyderabad-India/a.jpg", 2: "2024/08_August/02/Shimla/b.jpg", 3: "2024/08_August/02/Unknown/c.jpg"}


def test_whole_run(spark, tmp_path):
    import datetime as dt

    from foldline.plans import catalogue

    for name, body in (("dcim/IMG_1.jpg", "same"), ("Goa Trip/sunset.jpg", "same"), ("b.jpg", "other!")):
        p = tmp_path / "p" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    s = store.Store(spark, f"file://{tmp_path}/s")
    docs = spark.createDataFrame([(str(tmp_path / "p"), "b.jpg", '{"DateTimeOriginal":"2024:08:02 10:00:00","Make":"Canon"}')], "file_dir string, file_name string, document string")
    now = dt.datetime(2024, 9, 1)
    assert catalogue.run(s, [str(tmp_path / "p")], docs, PlanConfig(merge_days=False), now=now) == {"files": 3, "groups": 1, "entries": 2}
    masters = {r["file_name"] for r in catalogue.live_masters(s).collect()}
    assert masters == {"sunset.jpg", "b.jpg"}
    targets = {r["target_path"] for r in s.read("entries").collect()}
    assert "2024/08_August/02/b.jpg" in targets
    catalogue.approve(s, catalogue.review(s))
    assert {r["status"] for r in s.read("entries").collect()} == {"APPROVED"}
