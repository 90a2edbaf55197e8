import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, blank, very long and repeated texts, and columns whose names operators use inside."""
    long = " ".join(f"word{i % 977} tail{i}" for i in range(30000))
    rows = [
        (1, "The cat sat on the mat and then the cat ran off to the big red barn", "en", "a", 10),
        (2, "THE cat sat on the mat and then the cat ran off to the big red barn", "en", "a", 10),
        (2, "THE cat sat on the mat and then the cat ran off to the big red barn", "en", "a", 10),
        (3, "", None, None, None),
        (4, None, None, None, None),
        (5, " \n\t ", "en", "b", 4),
        (6, long, "en", "a", len(long)),
        (7, long + " more", "en", "a", 1),
        (None, "a row without an id has words too", "en", "a", 1),
        (8, "one", "en", "a", 3),
        (9, "one", "en", "a", 3),
        (10, "été 日本語 <|endoftext|> \U0001f600 x y", "fr", "a", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("node", "key", "word", "row", "score", "kept", "ids", "part", "_log_words", "n_words"):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("x"))
    return df.cache()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}
