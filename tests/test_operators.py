import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldline.operators import dedup, fuzzy, naming, sessions, tree
from foldline.operators.islands import merged_days, settle


def test_election(spark):
    rows = [(1, "abc", "/photos/trips/goa", "sunset.jpg"), (2, "abc", "/backup/dcim", "IMG_3162.jpg"), (3, "solo", "/photos/trips/goa", "beach.jpg"), (4, "t", "/p", "beach_b.jpg"), (5, "t", "/p", "beach_a.jpg"), (6, "u", "/Users/x/Photos/dcim", "IMG_1.jpg"), (7, "u", "/Users/x/Photos/Goa Trip 2024", "IMG_1.jpg")]
    df = spark.createDataFrame(rows, "id long, file_hash string, file_dir string, file_name string")
    assert {r["id"] for r in dedup.elect_masters(df, id="id").filter("is_master").collect()} == {1, 3, 5, 7}
    state = df.withColumn("is_live", F.col("id") != 1).withColumn("is_master", F.col("id").isin(1, 3, 5, 7))
    assert {r["id"] for r in dedup.settle_masters(state, id="id").filter("is_master AND is_live").collect()} == {2, 3, 5, 7}
    got = dedup.winners(df, "file_hash", F.col("id"), ["id"]).collect()
    assert {r["id"] for r in got} == {2, 3, 5, 7}


def test_sessions_alike_with_and_without_keys(spark):
    base = dt.datetime(2024, 1, 1)
    hours = [0, 1, 13, 13.5, 30, 100, 112, 124.5, 125, 300, 300]
    df = spark.createDataFrame([(i, base + dt.timedelta(hours=h)) for i, h in enumerate(hours)] + [(99, None)], "i long, t timestamp")
    want, n = {99: 1}, 1
    for i, h in enumerate(hours):
        n += i == 0 or h - hours[i - 1] > 12
        want[i] = n
    both = sessions.gap_sessions(df, ts="t", gap_seconds=12 * 3600)
    assert {r["i"]: r["session"] for r in both.collect()} == want
    keyed = sessions.gap_sessions(df.withColumn("k", F.lit(1)), ts="t", gap_seconds=12 * 3600, keys=["k"])
    assert {r["i"]: r["session"] for r in keyed.collect()} == want


def model(pairs):
    """Days as sets, worked out again from the rule: labels by runs, disagreeing days leave, repeat."""
    out = set()
    while True:
        label = {}
        for p in {p for _, p in pairs if p}:
            days = sorted(d for d, q in set(pairs) if q == p and d not in out)
            for d in days:
                lo = hi = d
                while lo - 1 in days:
                    lo -= 1
                while hi + 1 in days:
                    hi += 1
                if hi > lo:
                    label[d, p] = f"{lo:02d}_{hi:02d}"
        bad = {d for d, _ in pairs if d not in out and len({label.get((d, q), "") for e, q in pairs if e == d}) > 1}
        if not bad:
            return label
        out |= bad


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.sampled_from(["", "a", "b"])), max_size=20))
def test_day_runs_settle(pairs):
    assert settle(pairs) == model(pairs)


def test_merged_days(spark):
    df = spark.createDataFrame([("m", "goa", 2), ("m", "goa", 3), ("m", "pune", 5), ("n", "goa", 3), ("m", None, 9)], "m string, p string, d int")
    assert [tuple(r) for r in merged_days(df, month="m", place="p", day="d").orderBy("d").collect()] == [("m", "goa", 2, "02_03"), ("m", "goa", 3, "02_03")]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["a.jpg", "A.jpg", "a_2.jpg", "a_2_2.jpg", "b", "a.png", "a_3.jpg"]), max_size=12))
def test_claims(names):
    taken, hints = set(), {}
    got = [naming.claim("d", n, taken, hints) for n in names]
    plain, again = set(), []
    for n in names:
        stem, dot, ext = n.partition(".")
        k = 1
        while (p := f"d/{stem}{'' if k == 1 else f'_{k}'}{dot}{ext}").lower() in plain:
            k += 1
        plain.add(p.lower())
        again.append(p)
    assert got == again


def test_unique_targets_and_reclaim(spark):
    rows = [(1, "d", "IMG_1.JPG"), (2, "D", "img_1.jpg"), (3, "d", "IMG_1_2.JPG"), (4, "e", "x.jpg")]
    df = spark.createDataFrame(rows, "id long, dir string, name string")
    got = {r["id"]: r["target_path"] for r in naming.unique_targets(df, directory="dir", name="name", order=["id"]).collect()}
    assert got == {1: "d/IMG_1.JPG", 2: "D/img_1_2.jpg", 3: "d/IMG_1_2_2.JPG", 4: "e/x.jpg"}
    df = spark.createDataFrame([(1, "d/a.jpg", 1), (2, "d/a.jpg", 0)], "id long, path string, moved int")
    assert {r["id"]: r["t"] for r in naming.reclaim(df, path="path", moved="moved", order=["id"], out="t").collect()} == {2: "d/a.jpg", 1: "d/a_2.jpg"}


def test_trees(spark):
    rows = [(1, "2024/01/a/x.jpg", None, None), (2, "2024/01/y.jpg", 1.0, 2.0), (3, "top.jpg", None, None), (4, "2024/01/a/z.jpg", 3.0, 4.0)]
    df = spark.createDataFrame(rows, "id long, p string, lat double, lon double")
    got = {r["node_id"]: (r["parent_id"], r["file_count"], r["samples"], r["lat"]) for r in tree.roll_up(df, path="p", id="id", sample="p", lat="lat", lon="lon").collect()}
    assert got["2024"] == ("", 3, ["2024/01/a/x.jpg", "2024/01/y.jpg", "2024/01/a/z.jpg"], 1.0) and got["2024/01/a"][1:] == (2, ["2024/01/a/x.jpg", "2024/01/a/z.jpg"], 3.0)
    remap = spark.createDataFrame([("2024", "X"), ("2024/01/a", "Y/Z")], "old string, new string")
    assert {r["id"]: r["new_path"] for r in tree.rewrite_prefix(df, remap, path="p").collect()} == {1: "Y/Z/x.jpg", 2: "X/01/y.jpg", 3: None, 4: "Y/Z/z.jpg"}


def test_segments(spark):
    def of(days, months=0):
        rows = [(None if d is None else dt.datetime.fromisoformat(d), s, "2023/x/a.jpg") for d, s in days]
        df = spark.createDataFrame(rows, "taken_at timestamp, status string, target_path string")
        return [(r["label"], r["proposed"], r["approved"], r["folders"]) for r in tree.segments(df, months=months).collect()]

    p, a = "PROPOSED", "APPROVED"
    assert [x[0] for x in of([("2023-02-01", p), ("2023-09-01", p), ("2024-03-01", p)])] == ["2023 Jan–Jun", "2023 Jul–Dec", "2024 Jan–Jun"]
    assert [x[0] for x in of([("2020-02-01", p), ("2022-09-01", p), ("2024-03-01", p)])] == ["2020", "2022", "2024"]
    assert [x[0] for x in of([("2024-02-01", p), ("2024-05-01", p)], 3)] == ["2024 Jan–Mar", "2024 Apr–Jun"]
    assert of([("2024-02-01", p)]) == [] and of([(None, p)]) == []
    assert of([("2023-02-01", a), ("2024-02-01", p), (None, p), ("2020-01-01", "DONE")], 12) == [("2023", 0, 1, 2), ("2024", 1, 0, 2), ("Undated", 1, 0, 2)]


def test_fuzzy(spark):
    df = spark.createDataFrame([(1, "Kathmandu"), (2, "Kathua"), (3, "Hyderabad")], "id long, name string")
    assert [r["id"] for r in fuzzy.search(df, "katmandu", id="id", name="name").collect()] == [1]
    assert [r["id"] for r in fuzzy.search(df, "hyderbad", id="id", name="name").collect()] == [3]
