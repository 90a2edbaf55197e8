"""From raw documents to packed training sequences, in five stages over the operators of ``foldline.llm``.

Each stage works on all that the one before kept; its result is written as Parquet and read again.  Columns pass as they are,
whatever their names; an empty table passes through all stages as one; very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldline.llm import decontam, dedup, packing, quality
from foldline.llm.common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the rule ensemble scores under 0.3, null and empty texts by the score of zero statistics.

    The rules learn from at most 12,000 labelled documents outside the held-out fold.
    """
    model = quality.learn_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that fail the base rules or the boosted trees.

    These learn from at most 12,000 labelled documents outside the held-out fold, whether or not the stage before left them.
    Null and empty texts have no words and fail; repeated rows and null ids pass like others.
    """
    model = quality.learn_trees(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality.keep_passing(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group; of rows of one id, the least; all rows of no id or no words."""
    return dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of texts, setting ``n_chars`` anew; a document that is nothing else goes; null texts stay."""
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, a row a piece, with the ids; a null or empty text is its end token alone.

    Workers hold little, as their executors' heaps have grown by now.
    """
    return packing.pack(docs, _tokenizer(), keep=400_000, slice_bytes=1 << 20)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: SQL can express neither the learned models nor the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages make of ``documents``: nulls, ties, repeats and empty tables as each stage says.

    What a stage wrote is deleted once the next has read it, but for what the last one reads.
    """
    scratch = Scratch(spark)
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, f"stage-{k}")
            if k:
                scratch.drop(f"stage-{k - 1}")
    return docs
