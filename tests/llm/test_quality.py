import re
import zlib
from collections import defaultdict

import numpy as np

from foldline.llm import quality, trees
from foldline.llm.textstats import FEATURES, labelled, statistics

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    w, places, covered, seen, dup = WORD.findall(t), defaultdict(list), set(), set(), 0
    for k in range(len(w) - 4):
        places[tuple(w[k : k + 5])].append(k)
    for v in places.values():
        if len(v) > 1:
            for k in v:
                covered.update(range(k, k + 5))
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_statistics(texts, edge):
    some = [*texts.values(), *((r["text"] or "") for r in edge.collect()), "a\na\n\n \na b\na b", "x y z w v x y z w v"]
    counts, rows = statistics([t.encode() for t in some])
    assert list(zip(*(counts[k].tolist() for k in counts), strict=True)) == [brute(t) for t in some]
    assert np.isfinite(rows).all()
    for t, r in zip(some, rows, strict=True):
        w = WORD.findall(t)
        assert abs(r[FEATURES.index("distinct_share")] - (len(set(w)) / len(w) if w else 0)) < 1e-9


def test_rules_and_trees_on_held_out_labels(spark, edge):
    d = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.learn_rules(docs, labels)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    pairs = [(got[r["doc_id"]], r["quality"]) for r in labels.collect()]
    assert all(g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 5 == 0) for g, _ in pairs)
    held = [(g, q) for g, q in pairs if g["held_out"]]
    assert np.mean([g["predicted"] == q for g, q in held]) > 0.93
    x = np.array([[g[f] for f in FEATURES] for g, _ in pairs])
    assert np.allclose(model.score(x), [g["score"] for g, _ in pairs])
    grown = quality.learn_trees(docs, labels)
    v = {r["doc_id"]: r for r in quality.verdicts(docs, grown).collect()}
    assert np.mean([v[g["doc_id"]]["kept"] == q for g, q in held if not v[g["doc_id"]]["base_failed"]]) > 0.93
    scored = quality.score(edge, model).collect()
    assert len(scored) == edge.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.keep_good(edge, model).columns == edge.columns == quality.keep_passing(edge, grown).columns
    assert {r["doc_id"] for r in quality.keep_passing(edge, grown).collect()} <= {1, 2, 6, 7}
    for f in (quality.keep_good, quality.keep_passing):
        assert f(edge.limit(0), model if f is quality.keep_good else grown).count() == 0
    assert quality.verdicts(edge.limit(0), grown).count() == 0


def test_labels_of_one_class_or_none(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit_rules(*labelled(docs, none)).rules == []
    one = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    m = quality.fit_rules(*labelled(docs, one))
    assert m.rules == [] and m.intercept > 0


def test_monotone_and_flat_arrays():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] + 0.3 * rng.random(600)) < 0.6).astype(float)
    m = trees.fit(x, y, trees=20, monotone={0: -1})
    line = np.full((50, 3), 0.5)
    line[:, 0] = np.linspace(0, 1, 50)
    assert (np.diff(m.margins(line)) <= 1e-12).all()
    assert ((m.probability(x) > 0.5) == y).mean() > 0.9
    assert (m.left[m.feature < 0] == -1).all() and len(m.paths()) == len(m.feature) - len(m.roots)


def test_models_against_walking_each_row():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, len(FEATURES)))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.3, 500) > 0).astype(float)
    falling = {FEATURES.index(f): -1 for f in quality.FALLING}
    model = trees.fit(x, y, monotone=falling)

    def walk(row):
        total = model.base
        for node in model.roots.tolist():
            while model.feature[node] >= 0:
                node = int((model.left if row[model.feature[node]] <= model.threshold[node] else model.right)[node])
            total += model.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.probability(x), [walk(r) for r in x])
    for f in falling:  # raising a constrained statistic never raises the probability
        more = x.copy()
        more[:, f] += rng.uniform(0, 2, 500)
        assert (model.probability(more) <= model.probability(x) + 1e-12).all()
    rules = quality.fit_rules(x, y)
    slow = []
    for row in x:
        total = rules.intercept
        for rule, weight in zip(rules.rules, rules.weights, strict=True):
            if all(row[f] <= t if at_most else row[f] > t for f, t, at_most in rule):
                total += weight
        slow.append(1 / (1 + np.exp(-total)))
    assert rules.rules and np.allclose(rules.score(x), slow)
