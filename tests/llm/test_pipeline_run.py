"""``corpus_pipeline.run`` against a slow version of every stage, over tables with nulls, repeats and clashing columns."""

import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline
from foldline.llm import quality, textstats
from tests.llm.test_decontam import brute as passages
from tests.llm.test_decontam import words

from .conftest import SF
from .test_dedup import brute as components
from .test_quality import brute as counts


@pytest.fixture(scope="module")
def folder(spark, edge, tmp_path_factory):
    """Some of the documents beside odd ones, with columns that stages use inside."""
    at = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = edge.selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars")
    both = docs.unionByName(odd).selectExpr("*", "'x' AS node", "1 AS _n", "2 AS key", "3 AS _log_words", "4 AS kept", "5 AS label")
    both.write.parquet(f"{at}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{at}/{t}.parquet")
    return str(at)


def cut(text, bench):
    """Without what any window of the benchmark hits, again and again, by way of words."""
    import re

    while True:
        w, found = words(text), [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        hit = set()
        for _, body in bench:
            b = words(body)
            n = min(len(b), 10)
            for i in range(len(b) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == b[i : i + n]:
                        hit.update(range(j, j + n))
        if not hit:
            return text
        out, at = "", 0
        for k in sorted(hit):
            if k - 1 not in hit:
                out += text[at : found[k][0]]
            if k + 1 not in hit:
                at = found[k][1]
        text = out + text[at:]


def test_run_against_slow_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rules, trees = quality.learn_rules(docs, labels), quality.learn_trees(docs, labels)
    rows = [r.asDict() for r in docs.collect()]

    def stats(text):
        return textstats.statistics([(text or "").encode()])[1]

    rows = [r for r in rows if rules.score(stats(r["text"]))[0] >= 0.3]

    def passes(text):
        n, _, _, _, repeated = counts(text or "")
        return n >= 10 and 100 * repeated <= 20 * n and trees.probability(stats(text))[0] >= 0.5

    rows = [r for r in rows if passes(r["text"])]
    found = {}
    for text in components([(r["doc_id"], r["text"]) for r in rows]):
        doc, _, component = eval(text)  # noqa: S307 - a tuple of numbers that the helper printed
        found[doc] = component
    best = {}
    for r in rows:
        if r["doc_id"] is None or found[r["doc_id"]] == r["doc_id"]:
            key = r["doc_id"] if r["doc_id"] is not None else object()
            if key not in best or (r["text"] or "") < (best[key]["text"] or ""):
                best[key] = r
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = {}
    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    for r in best.values():
        text = cut(r["text"], bench) if r["text"] and passages(r["text"], bench)[1] else r["text"]
        if words(text or "") or text == r["text"]:
            want[r["doc_id"]] = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
    got, windows = {}, {}
    for p in sorted(corpus_pipeline.run(spark, folder).collect(), key=lambda p: (str(p["doc_id"]), p["start"])):
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] and zlib.crc32(bytes(p["ids"])) == p["ids_crc32"] and got.setdefault(p["doc_id"], []) == want[p["doc_id"]][: p["start"]]
        got[p["doc_id"]] += ids
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert got == want
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_over_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
