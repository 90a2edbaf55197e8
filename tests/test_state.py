"""The store's commits and migrations, review by slices, learned names, checked places, and hot keys."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from foldline.operators import dedup, fuzzy, naming, sessions, summary
from foldline.plans import catalogue
from foldline.plans import review as R
from foldline.schema import ENTRIES, FILE_METADATA, PlanConfig
from foldline.sources import files, store

NOW = dt.datetime(2024, 9, 1)


def entries(spark, rows):
    return spark.createDataFrame([(i, f"/s/{i}", t, None, st, None, at, None) for i, t, st, at in rows], ENTRIES)


def targets(df):
    return {r["file_id"]: (r["target_path"], r["status"]) for r in df.collect()}


def test_a_commit_that_breaks_off_leaves_the_old_version(spark, tmp_path, monkeypatch):
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.commit(entries=entries(spark, [(1, "a/x", "PROPOSED", None)]))
    for step in ("_publish",):
        with monkeypatch.context() as m:
            m.setattr(store.Store, step, lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                s.commit(entries=entries(spark, [(2, "b/y", "PROPOSED", None)]))
        assert targets(store.Store(spark, s.uri).read("entries")) == {1: ("a/x", "PROPOSED")}
    old = s.read("entries")
    s.commit(entries=entries(spark, [(3, "c/z", "PROPOSED", None)]))
    assert targets(old) == {1: ("a/x", "PROPOSED")} and targets(s.read("entries")) == {3: ("c/z", "PROPOSED")}
    late = s._number()
    with monkeypatch.context() as m:  # another writer took the number meanwhile
        m.setattr(store.Store, "_number", lambda self: late - 1)
        m.setattr(store.Store, "manifest", lambda self: {"schema": store.VERSION, "tables": {}, "stamp": None})
        with pytest.raises(store.Conflict):
            s.commit(entries=entries(spark, [(4, "d", "PROPOSED", None)]))
    assert targets(s.read("entries")) == {3: ("c/z", "PROPOSED")}
    assert s.vacuum() >= 2 and targets(s.read("entries")) == {3: ("c/z", "PROPOSED")}


def test_older_schemas_are_migrated_once(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    meta = spark.createDataFrame([(1, "h", None)], "file_id long, file_hash string, hash_kind string")
    s._commit({"file_metadata": meta, "entries": entries(spark, [(1, "2024/x.jpg", "PROPOSED", None)])}, 1)
    again = store.Store(spark, s.uri)
    assert again.manifest()["schema"] == store.VERSION
    assert again.read("file_metadata").first()["hash_kind"] == "content" and again.read("entries").first()["location_dir"] == "2024"
    n = again._number()
    assert store.Store(spark, s.uri)._number() == n
    s._commit({}, store.VERSION + 1)
    with pytest.raises(ValueError):
        store.Store(spark, s.uri)


def test_ids_that_collide_are_set_apart(spark):
    rows = spark.createDataFrame([(5, "a", "x", True), (5, "b", "y", False), (6, "c", "z", False)], "id long, file_dir string, file_name string, had boolean")
    got = {r["file_name"]: r["id"] for r in store.settle_ids(rows, F.col("had")).collect()}
    assert got["x"] == 5 and got["z"] == 6 and got["y"] not in (5, 6)


def test_slices_are_approved_and_opened_again(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.commit(entries=entries(spark, [(1, "2023/a", "PROPOSED", "2023-02-01 00:00:00"), (2, "2024/b", "PROPOSED", "2024-02-01 00:00:00"), (3, "c", "DONE", None)]))
    inside = F.col("taken_at") < "2024"
    assert catalogue.set_slice(s, inside, True) == 1 and targets(s.read("entries"))[1][1] == "APPROVED"
    assert catalogue.set_slice(s, inside, True) == 0
    assert catalogue.set_slice(s, F.lit(True), False) == 1 and {r[1] for r in targets(s.read("entries")).values()} == {"PROPOSED", "DONE"}


def test_confirm_learns_names_and_refuses_foreign_folders(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(R.EditError, match="no proposal"):
        catalogue.approve(s, [])
    s.commit(entries=entries(spark, [(1, "2024/08/02/x.jpg", "PROPOSED", None), (2, "2024/08/03/y.jpg", "PROPOSED", None)]))
    tree = R.rename(catalogue.review(s), "2024/08/02", "  Goa Trip ")
    tree = R.rename(tree, "2024/08/03", "04")
    assert R.find(tree, "2024/08/02").name == "Goa-Trip"
    assert [r["file_id"] for r in R.files_under(s.read("entries"), "2024/08").collect()] == [1, 2] and R.files_under(s.read("entries"), "2024/0").count() == 0
    foreign = [R.Node("1999", "1999")]
    with pytest.raises(R.EditError, match="1999"):
        catalogue.approve(s, foreign)
    assert catalogue.approve(s, tree, now=NOW) == ["Goa-Trip"] and catalogue.labels(s) == ["Goa-Trip"]
    assert targets(s.read("entries")) == {1: ("2024/08/Goa-Trip/x.jpg", "APPROVED"), 2: ("2024/08/04/y.jpg", "APPROVED")}
    catalogue.approve(s, R.rename(catalogue.review(s), "2024/08/Goa-Trip", "Goa Trip"), now=NOW)
    assert catalogue.labels(s) == ["Goa-Trip"]


def test_merges_of_a_folder_with_its_own_are_refused(spark):
    tree = R.build_tree(R.folder_table(entries(spark, [(1, "2024/08/02/Goa/x.jpg", "PROPOSED", None), (2, "2024/08/03/y.jpg", "PROPOSED", None)])))
    for ids in (["2024/08", "2024/08/02"], ["2024/08/02", "2024/08/02"], ["2024/08/02/Goa", "2024/08"], ["2024/08/02", "2024/08/09"]):
        with pytest.raises(R.EditError):
            R.merge(tree, ids)
    for name in ("", "  ", "a/b", ".", ".."):
        with pytest.raises(R.EditError):
            R.rename(tree, "2024", name)


def test_a_proposal_of_other_settings_is_stale(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    assert not catalogue.is_stale(s, PlanConfig())
    catalogue.plan(s, PlanConfig(), None, NOW)
    assert not catalogue.is_stale(s, PlanConfig()) and catalogue.is_stale(s, PlanConfig(rules=("location",)))
    s.commit(file_metadata=spark.createDataFrame([], FILE_METADATA))
    assert not catalogue.is_stale(store.Store(spark, s.uri), PlanConfig())


def test_a_root_that_fails_does_not_stop_the_others(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.jpg").write_bytes(b"x")
    s = store.Store(spark, f"file://{tmp_path}/s")
    assert catalogue.scan(s, [str(tmp_path / "gone"), str(tmp_path / "p")], NOW) == 1
    row = s.read("file_registry").first()
    assert row["volume_uuid"] == files.volume_id(str(tmp_path / "p"))
    assert summary.volume_groups(s.read("file_registry"), volume="volume_uuid", first="file_dir").collect()[0]["n"] == 1
    with pytest.raises(NotADirectoryError):
        catalogue.scan(s, [str(tmp_path / "gone")], NOW)
    assert files.relative_to_home("/home/u/p", "/home/u") == "~/p" and files.relative_to_home("/home/u2", "/home/u") == "/home/u2" and files.relative_to_home("/home/u", "/home/u") == "~"


def test_places_are_checked(spark, tmp_path):
    at = tmp_path / "places.csv"
    at.write_text("rowid,city,latitude,longitude,state,country,country_code\n1,Shimla,31.1,77.2,HP,India,IN\n2,Panauti,27.6,85.5,,Nepal,NP\n")
    sha = hashlib.sha256(at.read_bytes()).hexdigest()
    assert files.read_places(spark, str(at), sha256=sha, counts={"rows": 2, "IN": 1}).count() == 2
    for bad in ({"sha256": "0" * 64}, {"counts": {"rows": 3}}, {"counts": {"PK": 1}}):
        with pytest.raises(ValueError):
            files.read_places(spark, str(at), **bad)


def test_manifests_are_numbered(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.commit("stamp", entries=entries(spark, []))
    s.commit(entries=entries(spark, []))
    names = sorted(p.name for p in (tmp_path / "s").iterdir() if p.suffix == ".json")
    assert names == ["manifest-000000000001.json", "manifest-000000000002.json"]
    assert json.loads((tmp_path / "s" / names[1]).read_text())["stamp"] == "stamp" == s.stamp


# -- a third of all rows on one key; the session of the tests re-plans nothing --------------------------------------------


def test_election_with_a_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("file_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("file_hash"), F.lit("/p").alias("file_dir"), F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(".jpg")).alias("file_name"))
    won = {r["file_id"] for r in dedup.elect_masters(df).filter("is_master").collect()}
    assert len(won) == 2001 and 0 in won
    plan = dedup.elect_masters(df)._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_names_with_a_hot_family(spark):
    n = F.col("id")
    name = F.when(n % 3 == 0, "same.jpg").when(n % 3 == 1, F.concat(F.lit("IMG_"), n.cast("string"), F.lit(".jpg"))).otherwise(F.when(n % 2 == 0, "b_2.jpg").otherwise("b.jpg"))
    df = spark.range(600).select(n.alias("k"), F.lit("D").alias("dir"), name.alias("name"))
    got = {r["k"]: r["target_path"] for r in naming.unique_targets(df, directory="dir", name="name", order=["k"]).collect()}
    taken, want = set(), {}
    for r in df.orderBy("k").collect():
        want[r["k"]] = naming.claim(r["dir"], r["name"], taken)
    assert got == want and len(set(got.values())) == 600


def test_sessions_without_times_or_in_one_busy_day(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=7 * i + (3600 if i > 500 else 0))) for i in range(900)] + [(1000 + i, None) for i in range(450)]
    df = spark.createDataFrame(rows, "i long, t timestamp")
    got = {r["i"]: r["session"] for r in sessions.gap_sessions(df, ts="t", gap_seconds=60).collect()}
    assert all(got[i] == (1 if i >= 1000 else 3 if i > 500 else 2) for i in got) and len(got) == 1350
    assert sessions.gap_sessions(df.limit(0), ts="t", gap_seconds=60).count() == 0


def test_set_fingerprint_and_budget(spark):
    df = spark.createDataFrame([("a", i, i % 5 + 1) for i in range(300)] + [("b", i, 10) for i in range(5)] + [(None, 1, 500)], "g string, m long, s long")
    f = {r["g"]: r["fingerprint"] for r in summary.set_fingerprint(df, keys=["g"], member="m").collect()}
    back = {r["g"]: r["fingerprint"] for r in summary.set_fingerprint(df.orderBy(F.desc("m")), keys=["g"], member="m").collect()}
    assert f == back and len(set(f.values())) == 3
    less = summary.set_fingerprint(df.filter("m <> 7"), keys=["g"], member="m").filter("g = 'a'").first()["fingerprint"]
    assert less != f["a"]
    want, run = set(), {}
    for g, m, s in sorted(((r["g"] or "", r["m"], r["s"]) for r in df.collect())):
        run[g] = run.get(g, 0) + s
        if run[g] <= 400:
            want.add((g, m, run[g]))
    got = {(r["g"] or "", r["m"], r["running"]) for r in summary.within_budget(df, keys=["g"], order="m", size="s", budget=400).collect()}
    assert got == want


def test_typing_errors_against_all_pairs(spark):
    names = ["springfield", "springfeld", "sprngfild", "shimla", "simla", "a", "ab", "panauti", "panautii", "hyderabad", "hyderbad", "abcabcabcabc", "abcabcabc"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    q = spark.createDataFrame([(i, n[1:] or n) for i, n in enumerate(names)], "qid long, w string")
    got = {(r["qid"], r["id"]) for r in fuzzy.match_all(df, q, id="id", name="name", query_id="qid", query="w").collect()}

    def grams(x):
        return {f" {x} "[i : i + 3] for i in range(len(x))}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {(k, i) for k, n in enumerate(names) for i, m in enumerate(names) if edits(n[1:] or n, m) <= 2 and grams(n[1:] or n) & grams(m)}
    assert got == want


def test_a_dense_town_beside_open_country(spark):
    import random

    from foldline.operators import nearest

    rng = random.Random(3)
    places = [(i, "x", 10 + rng.gauss(0, 0.03), 20 + rng.gauss(0, 0.03), i % 2 == 0) for i in range(120)] + [(500 + i, "y", 10 + rng.uniform(-1, 1), 20 + rng.uniform(-1, 1), False) for i in range(60)]
    points = [(i, 10 + rng.gauss(0, 0.3), 20 + rng.gauss(0, 0.3)) for i in range(60)] + [(900, None, 1.0)]
    c = spark.createDataFrame(places, "place_id long, name string, latitude double, longitude double, marks boolean")
    p = spark.createDataFrame(points, "k long, lat double, lon double")
    pick = lambda pairs: {(r["k"], r["place_id"], r["rank"]) for r in nearest.candidates(pairs, key="k", limit=3, marks="marks", ties=["place_id"]).collect()}
    few, all_ = nearest.near_pairs(p, c, key="k", lat="lat", lon="lon"), nearest.box_pairs(p, c, lat="lat", lon="lon")
    assert pick(few) == pick(all_) and few.count() < all_.count()


def test_pairs_of_near_places_follow_the_points_not_their_density(spark):
    """Many places within the fine box, many at one spot: a point meets few of them, and the nearest stay the same."""
    import random

    from foldline.operators import nearest

    rng = random.Random(4)
    spots = [(10 + rng.gauss(0, 0.02), 20 + rng.gauss(0, 0.02)) for _ in range(700)] + [(10.4, 20.1), (-0.0, 0.0), (0.0, 0.0)]
    at = spots + [(10.01, 20.01)] * 300 + [(10 + rng.uniform(-0.5, 0.5), 20 + rng.uniform(-0.5, 0.5)) for _ in range(100)]
    c = spark.createDataFrame([(i, "x", y, x, i % 3 == 0) for i, (y, x) in enumerate(at)], "place_id long, name string, latitude double, longitude double, marks boolean")
    p = spark.createDataFrame([(i, y, x) for i, (y, x) in enumerate(at[::4] + [(10.45, 20.45), (50.0, 50.0)])], "k long, lat double, lon double")
    pick = lambda pairs: {(r["k"], r["place_id"], r["rank"]) for r in nearest.candidates(pairs, key="k", limit=3, marks="marks", ties=["place_id"]).collect()}
    few, all_ = nearest.near_pairs(p, c, key="k", lat="lat", lon="lon", ties=["place_id"]), nearest.box_pairs(p, c, lat="lat", lon="lon")
    assert pick(few) == pick(all_) and few.count() * 3 < all_.count()


def test_what_was_cut_can_be_deleted(spark):
    from foldline.sources import shared

    shared.clean_up(spark)
    kept = shared.cut(spark.range(5), "t")
    assert kept.count() == 5 and shared.clean_up(spark) == 1 and shared.clean_up(spark) == 0


def test_a_metadata_tool_is_asked_for_many_files_at_once(spark, tmp_path):
    import sys

    tool = tmp_path / "tool.py"
    tool.write_text("import json,sys\nprint(json.dumps([{'SourceFile': p, 'Make': 'Canon', 'n': len(sys.argv) - 1} for p in sys.argv[1:] if 'bad' not in p]))")
    df = spark.createDataFrame([("/p", f"{n}.jpg") for n in ("a", "b; echo x", "bad")], "file_dir string, file_name string").coalesce(1)
    got = {r["file_name"]: r["document"] for r in files.tool_documents(df, [sys.executable, str(tool)]).collect()}
    assert got["bad.jpg"] is None and json.loads(got["b; echo x.jpg"]) == {"SourceFile": "/p/b; echo x.jpg", "Make": "Canon", "n": 3}
    read = files.read_metadata(files.tool_documents(df, [sys.executable, str(tool)], batch=1)).filter("exif_make = 'Canon'")
    assert read.count() == 2
    assert files.tool_documents(df, ["/no/such/tool"]).filter("document IS NOT NULL").count() == 0
