import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from foldline.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        n = min(len(b), window)
        for i in range(len(b) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(item)
    return len(w), len(hit), sorted(x for x in found if x is not None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), max_size=6), st.lists(st.lists(st.sampled_from("abcd"), max_size=6), max_size=5))
def test_index_against_brute_force(texts, items):
    named = [(i, " ".join(x)) for i, x in enumerate(items)]
    p = decontam.Phrases([(i, b.encode()) for i, b in named], window=3)
    n, hits, found = p.scan([" ".join(t).encode() for t in texts])
    for t, k, h, f in zip(texts, n, hits, found, strict=True):
        assert (k, int(h.sum()), f) == brute(" ".join(t), named, 3)


def test_find(spark, edge, docs):
    bench = [(1, "the cat sat on the mat and then the cat ran"), (2, "One"), (3, ""), (None, "big red barn"), (4, None), (5, "never seen anywhere at all here or there or elsewhere")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    for limits in ({}, {"block_bytes": 20, "shard_bytes": 100}):
        got = decontam.find(edge, b, **limits).collect()
        for r in got:
            assert (r["n_words"], r["n_hit"], r["items"]) == brute(r["text"], bench)
            assert sum(s["words"] for s in r["spans"]) == r["n_hit"]
    assert decontam.digest(decontam.find(edge.limit(0), b)).count() == 0
    assert decontam.digest(decontam.find(edge, b.limit(0))).filter("contaminated").count() == 0


def test_clean_leaves_nothing_and_keeps_the_rest(spark, edge):
    bench = [(1, "the cat sat on the mat and then the cat ran"), (2, "one")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    before = {(r["doc_id"], r["text"]) for r in edge.collect()}
    after = decontam.clean(edge, b)
    assert after.columns == edge.columns
    rows = after.collect()
    assert all(brute(r["text"], bench)[1] == 0 for r in rows)
    for r in rows:
        if (r["doc_id"], r["text"]) not in before:
            assert r["n_chars"] == len(r["text"]) and r["doc_id"] in (1, 2)
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, 7, 10, None}


def test_clean_does_not_depend_on_blocks(spark):
    bench = [(1, "red green blue"), (2, "cat dog cow"), (3, "blue cat one")]
    docs = spark.createDataFrame([(1, "start red green cat dog cow blue end"), (2, "x red green blue cat dog cow one y"), (3, "as it is")], "doc_id long, text string")
    for items in (bench, bench[::-1]):
        for most in (1, 20, 8 << 20):
            got = {r["doc_id"]: r["text"].split() for r in decontam.clean(docs, spark.createDataFrame(items, "item_id long, text string").coalesce(1), block_bytes=most).collect()}
            assert got == {1: ["start", "end"], 2: ["x", "one", "y"], 3: ["as", "it", "is"]}


def test_wavelet_ranks():
    seq = np.random.default_rng(0).integers(0, 11, 300)
    w = decontam.WaveletMatrix(seq, 4)
    at = np.arange(301)
    for c in range(11):
        assert (w.rank(np.full(301, c), at) == np.concatenate(([0], np.cumsum(seq == c)))).all()
    assert (w.access(np.arange(300)) == seq).all()
