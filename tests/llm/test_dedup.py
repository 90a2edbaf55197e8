import numpy as np
import pytest

from foldline.llm import dedup


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset()


def brute(rows):
    """Components and set sizes over all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            near = sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both)
            if near or (same_id and sets[i] and sets[j]):
                root[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        ids = [r[0] for k, r in enumerate(rows) if find(k) == find(i)]
        out[i] = (d, len(sets[i]), None if d is None else min(x for x in ids if x is not None))
    return sorted(map(repr, out.values()))


def near_family(n=60):
    """A hot group: copies with a few edits each, some beyond the threshold from each other."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    out = []
    for k in range(n):
        w = list(base)
        for p in rng.integers(0, 120, k % 7):
            w[p] = f"x{k}_{p}"
        out.append((5000 + k, " ".join(w)))
    return out


@pytest.mark.parametrize("small", [64, 3])
def test_against_all_pairs(spark, edge, docs, small):
    rows = [(r[0], r[1]) for r in edge.select("doc_id", "text").collect()] + [(r[0] + 100, r[1]) for r in docs.select("doc_id", "text").limit(40).collect()] + near_family()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup.near_duplicates(df, small=small).collect()
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"] or r["doc_id"] is None) for r in got)


def test_keep_one_and_empty(spark, edge):
    kept = dedup.keep_one(edge)
    ids = sorted(r["doc_id"] or -1 for r in kept.collect())
    assert ids == [-1, 1, 3, 4, 5, 6, 8, 10] and kept.columns == edge.columns
    assert dedup.near_duplicates(edge.limit(0)).count() == 0


def test_estimate_is_corrected():
    rng = np.random.default_rng(5)
    for share in (0.5, 0.85):
        found = []
        for _ in range(30):
            x = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
            n = int(2000 * 2 * share / (1 + share))
            y = np.concatenate((x[:n], rng.integers(0, 1 << 63, 2000 - n, dtype=np.uint64)))
            found.append(dedup.estimate(dedup.matches(dedup.pack_low(dedup.minima(x)), dedup.pack_low(dedup.minima(y)))))
        assert abs(np.mean(found) - share) < 0.03


def crowd(n=150):
    """Documents that share most of a long passage, many of them nearly at the threshold from each other, and a few copies."""
    rng = np.random.default_rng(7)
    base = [f"p{i}" for i in range(100)]
    out = []
    for k in range(n):
        w = list(base)
        for p in rng.choice(100, 3 + k % 4, replace=False):
            w[p] = f"own{k if k % 10 else k // 20}_{p}"
        out.append((9000 + k, " ".join(w)))
    return out


@pytest.mark.parametrize("small", [4])
def test_crowded_buckets_lose_no_link(spark, small):
    rows = crowd() + near_family(30)
    found = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=small).collect()
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in found) == brute(rows)


def test_large_buckets_are_split_over_tasks(spark):
    members = spark.range(50).selectExpr("1L AS key", "cast(cast(id AS string) AS binary) AS node", "50L AS size")
    ones = spark.createDataFrame([(1, 50, "p"), (2, 50, "q")], "key long, size long, what string")
    met = dedup.Linker.spread(members, ones, each=4)
    assert met.count() == 50 and {r["what"] for r in met.collect()} == {"p"}


def test_samples_find_what_agrees(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    y = np.concatenate((x[:370], rng.integers(0, 1 << 63, 30, dtype=np.uint64)))  # 0.86 alike
    sigs = [dedup.pack_low(dedup.minima(v)).tolist() for v in (x, y, rng.integers(0, 1 << 63, 400, dtype=np.uint64))]
    df = spark.createDataFrame([(bytes([k]), s) for k, s in enumerate(sigs)], "node binary, sig array<long>")
    keys = {k: {r["key"] for r in dedup.sampled_keys(df).collect() if bytes(r["node"]) == bytes([k])} for k in range(3)}
    assert all(len(v) == dedup.SUBSETS for v in keys.values()) and keys[0] & keys[1] and not keys[0] & keys[2]


def test_documents_that_share_a_passage_are_not_compared_all_with_all(spark, monkeypatch):
    """None of them alike but two; with samples of low bits alone nearly all of the 4,950 pairs were confirmed on their texts."""
    rng = np.random.default_rng(11)
    base = [f"p{i}" for i in range(120)]
    rows = [(k, " ".join([*base, *(f"own{x}" for x in rng.integers(0, 10**9, 18 + k % 5))])) for k in range(99)]
    rows.append((99, rows[40][1] + " more"))
    asked, confirm = [], dedup.confirm

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return confirm(pairs, *rest)

    monkeypatch.setattr(dedup, "confirm", counted)
    found = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=4).collect()
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in found) == brute(rows)
    assert sum(asked) < 2000


def test_a_large_group_of_noisy_copies_takes_no_more_rounds(spark, monkeypatch):
    """Many copies are too far from the others to join them; by pivots, each ``small`` of those took a round of its own."""
    rng = np.random.default_rng(5)
    base, rows = [f"p{i}" for i in range(120)], []
    for k in range(240):
        w = list(base)
        for p in rng.choice(120, k % 8, replace=False):
            w[p] = f"edit{rng.integers(0, 60)}"
        rows.append((k, " ".join(w)))
    rounds, confirm = [], dedup.confirm
    monkeypatch.setattr(dedup, "confirm", lambda *args: rounds.append(1) or confirm(*args))
    found = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=2).collect()
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in found) == brute(rows)
    assert len(rounds) <= 4


def test_blocks_meet_each_pair_once_and_give_few_links(spark):
    """Two that both ask, one of another label that all are like, and one alike to nothing."""
    import zstandard

    words = [f"w{i}" for i in range(60)]
    bodies = [" ".join([*words, f"end{k}"]) for k in range(4)] + [" ".join(f"z{i}" for i in range(60))]
    nodes = [dedup.set_key(x) for x in dedup.shingle_sets([b.encode() for b in bodies])]
    sig = [dedup.pack_low(dedup.minima(x)).tolist() for x in dedup.shingle_sets([b.encode() for b in bodies])]
    press = zstandard.ZstdCompressor()
    one = lambda k, asks: (1, asks, nodes[k], nodes[k] if k not in (2, 3) else nodes[3], sig[k], press.compress(bodies[k].encode()), k not in (2, 3))
    df = spark.createDataFrame([one(k, True) for k in (0, 1, 4)] + [one(k, False) for k in range(5)], "g long, asks boolean, node binary, label binary, sig array<long>, body binary, out boolean")
    got = {frozenset(nodes.index(bytes(x)) for x in r) for r in dedup.met_blocks(df, 85, 3, dedup.least_matches(85)).collect()}
    assert len(got) == 2 and all(len(x) == 2 and 4 not in x and x != {2, 3} for x in got)
    assert {0, 1} <= set().union(*got) and set().union(*got) & {2, 3}


def test_alike_texts_share_a_key_that_the_smaller_owns(spark):
    import zstandard

    texts = dict(enumerate([*(t for _, t in near_family(40)), *(t for _, t in crowd(20)), "one two", "one two three"]))
    press = zstandard.ZstdCompressor().compress
    df = spark.createDataFrame([(bytes([k]), press(t.encode())) for k, t in texts.items()], "node binary, body binary")
    sets = {k: shingle_set(t) for k, t in texts.items()}
    counts = dedup.shingle_counts(df, 3)
    assert int(counts.sum()) == sum(map(len, sets.values()))
    for order in (counts, np.random.default_rng(2).integers(0, 9, dedup.CELLS, dtype=np.uint32)):
        keys, owned = {}, {}
        for r in dedup.prefix_keys(df, order, 85, 3, most=500).collect():
            keys.setdefault(r["node"][0], set()).add(r["key"])
            if r["own"]:
                owned.setdefault(r["node"][0], set()).add(r["key"])
        alike = [(x, y) for x in sets for y in sets if x != y and len(sets[y]) <= len(sets[x]) and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y])]
        assert len(alike) > 50 and all(owned[y] & keys[x] for x, y in alike)


def test_a_pair_without_its_text_is_not_confirmed(spark):
    pairs = spark.createDataFrame([(b"a", b"b", 1), (b"a", b"c", 1)], "a binary, b binary, g long")
    import zstandard

    body = zstandard.ZstdCompressor().compress(b"one two three four")
    bodies = spark.createDataFrame([(b"a", body), (b"b", body)], "node binary, body binary")
    assert [(bytes(r["a"]), bytes(r["b"])) for r in dedup.confirm(pairs, bodies, 85, 3).collect()] == [(b"a", b"b")]


def test_of_rows_with_one_id_the_least_stays(spark):
    rows = [(1, "b c d e f", 2), (1, "a b c d e", 3), (1, "a b c d e", 1), (2, None, 0), (2, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _n long")
    assert sorted((r["doc_id"], r["text"] or "", r["_n"]) for r in dedup.keep_one(df).collect()) == [(1, "a b c d e", 1), (2, "", 0)]


def shuffled(spark) -> int:
    """Bytes of shuffle that the stages so far have written."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jvm, gateway = sc._jvm, sc._gateway
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_texts_that_meet_nothing_are_not_shuffled(spark):
    """Of 300 texts of 6 kB two are alike and one has a repeated id; joins once shuffled all texts, and twice again to keep one."""
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"{x:x}" for x in rng.integers(0, 1 << 60, 400))) for k in range(300)]
    rows += [(300, rows[40][1] + " more"), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        ids = sorted(r["doc_id"] for r in dedup.keep_one(df).collect())
        after = shuffled(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert ids == list(range(300))
    assert after - before < sum(len(t) for _, t in rows) / 4


def test_hashing_texts_holds_little():
    import tracemalloc

    texts = [b" ".join(b"w%d" % (x * k % 99991) for x in range(700)) for k in range(1, 1000)]
    tracemalloc.start()
    try:
        assert sum(1 for _ in dedup.shingle_sets(texts)) == 999
        assert tracemalloc.get_traced_memory()[1] < 24 << 20
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("most", ["-1", "10m"])
def test_of_rows_with_one_id_in_a_union_the_least_stays(spark, tmp_path, most):
    rows = [(k, f"a{k} b{k} c{k} d{k} e{k}") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    longer = docs.filter("doc_id % 4 = 0").selectExpr("doc_id", "text || ' and more' AS text")
    no_text = docs.filter("doc_id % 6 = 0").selectExpr("doc_id", "cast(null AS string) AS text")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    try:
        got = dedup.keep_one(docs.filter("doc_id % 2 = 0").unionByName(longer).unionByName(no_text)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sorted(map(tuple, got)) == rows[::2]
