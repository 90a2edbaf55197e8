from foldline.llm import common


def test_what_results_read_can_be_deleted(spark):
    common.clean_up(spark)
    scratch = common.Scratch(spark)
    a, b = scratch.keep(spark.range(3), "a"), scratch.keep(spark.range(4), "b")
    scratch.drop("a")
    assert b.count() == 4 and common.clean_up(spark) == 1 and common.clean_up(spark) == 0


def test_pieces_hold_whole_texts():
    import pyarrow as pa

    some = ["a", None, "b" * 50, "", "cd", "e" * 9]
    for limit in (1, 10, 1000):
        got = list(common.pieces(pa.array(some), limit))
        assert [x.decode() for _, part in got for x in part] == [t or "" for t in some]
        assert [at for at, _ in got] == [sum(len(p) for _, p in got[:k]) for k in range(len(got))]
    assert list(common.pieces(pa.array([], pa.string()))) == []


def test_sieve_leaves_out_no_row_of_an_id(spark):
    rows = spark.range(2000).selectExpr("if(id % 500 = 7, null, id - 900) AS x", "id AS word")
    asked = spark.range(40).selectExpr("id * 31 - 600 AS doc_id")
    wanted = {k * 31 - 600 for k in range(40)}
    for words in (1, 3, 1 << 16):
        may, others = (sorted(r["word"] for r in part.collect()) for part in common.sieve(rows, "x", asked, words))
        assert sorted(may + others) == list(range(2000))
        assert not wanted & {k - 900 for k in others if k % 500 != 7}
    assert len(may) < 60  # the most words: hardly any others
    may, others = common.sieve(rows, "x", asked.limit(0))
    assert may.count() == 0 and others.count() == 2000


def test_batches_are_small_where_asked(spark):
    spark.range(400, numPartitions=1).selectExpr("id", "repeat('x', 20000) AS text").createOrReplaceTempView("long_texts")
    sizes = common.arrow_map(spark.table("long_texts"), lambda _, b: {"n": [b.nbytes], "rows": [b.num_rows]}, "n long, rows long")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = common.Scratch(spark, 1 << 20).keep(sizes, "sizes").collect()
    assert max(r["n"] for r in got) < 2 << 20 and sum(r["rows"] for r in got) == 400
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
