import duckdb
import pytest

from foldline import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return "null"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    if name not in queries.ORACLE:
        assert name == "day_merge_fixpoint"  # see below
        return
    rel = duck.sql(queries.ORACLE[name])
    assert sorted(rel.columns) == cols
    want = sorted(tuple(plain(v) for v in r) for r in rel.select(*(duckdb.ColumnExpression(c) for c in cols)).fetchall())
    assert got == want


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(queries.ORACLE) <= set(e.oracle_sql())


def slow_labels(days):
    """Of {day: places}: (day, place) to label.  A run of a place is days next to each other; a day on which places differ in
    their run, or have none beside one that has, belongs to no run; begin again without it until that is so of no day."""
    out = set()
    while True:
        label = {}
        for d, ps in days.items():
            for p in ps - {""} if d not in out else ():
                lo = hi = d
                while lo - 1 not in out and p in days.get(lo - 1, ()):
                    lo -= 1
                while hi + 1 not in out and p in days.get(hi + 1, ()):
                    hi += 1
                if lo < hi:
                    label[d, p] = f"{lo:02d}_{hi:02d}"
        bad = {d for d, ps in days.items() if d not in out and len({label.get((d, p), "") for p in ps}) > 1}
        if not bad:
            return label
        out |= bad


def test_day_merge_fixpoint(spark):
    df = queries.QUERIES["day_merge_fixpoint"](spark, SF)
    months = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("ts", "user_id", "event_type").collect():
        place = "" if r["event_type"] == "click" else str(r["ts"].day // 10)
        months.setdefault(f"{r['ts']:%Y-%m}/{r['user_id']}", {}).setdefault(r["ts"].day, set()).add(place)
    want = {(m, p, d, x) for m, days in months.items() for (d, p), x in slow_labels(days).items()}
    got = [(r["month"], r["place"], r["day"], r["day_range"]) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
