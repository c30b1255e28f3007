"""Runs of names and joined words that are longer than Java's stack allows a recursive match."""

from pyspark.sql import functions as F

from tissueflow.llm import decontaminate


def test_long_runs_of_names_and_joined_words(spark):
    n = 30_000
    text = "at " + " ".join(["Ab"] * n) + " " + ",".join(["1"] * n) + " " + "'".join(["ab"] * n)
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(decontaminate._template(F.col("t")).alias("a"), decontaminate._words(F.col("t")).alias("b")).first()
    assert list(got.a)[:3] == ["at", "<name>", "<num>"] and len(got.a) == len(got.b) == 4


def test_texts_go_to_python_in_bounded_batches(spark):
    from tissueflow.llm import common, simhash

    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" word"), 8000)).alias("text"))

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    largest = lambda: docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
    try:
        spark.conf.unset(common.BATCH_BYTES)
        assert largest() > 2 * common.BATCH
        simhash.near_groups(docs.limit(3))
        assert largest() < 2 * common.BATCH
        spark.conf.set(common.BATCH_BYTES, "1000000")  # a session's own smaller limit
        common.bounded_batches(spark)
        assert spark.conf.get(common.BATCH_BYTES) == "1000000"
    finally:
        spark.conf.unset(common.BATCH_BYTES)
