import corpus_pipeline
from foldline.llm import dedup, quality
from tests.llm.test_decontam import brute

from .conftest import SF


def test_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "MinHash near-dedup", "benchmark decontamination", "packing"]
    at, kept = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, SF)
        if k < 4:
            assert out.columns == docs.columns
        at = spark.createDataFrame(out.collect(), out.schema)
        kept.append(at)
    ids = [{r["doc_id"] for r in x.collect()} for x in kept]
    labels, d = spark.read.parquet(f"{SF}/labels.parquet"), docs
    want = {r["doc_id"] for r in quality.score(d, quality.learn_rules(d, labels)).filter("predicted = 1").collect()}
    assert ids[0] == want
    want &= {r["doc_id"] for r in quality.verdicts(d, quality.learn_trees(d, labels)).filter("kept").collect()}
    assert ids[1] == want
    assert ids[2] == {r["doc_id"] for r in dedup.near_duplicates(kept[1]).filter("kept").collect()}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    for r in kept[3].collect():
        if brute(before[r["doc_id"]], bench)[1]:
            assert brute(r["text"], bench)[1] == 0
        else:
            assert r["text"] == before[r["doc_id"]]
    assert ids[4] == ids[3]
