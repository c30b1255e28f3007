"""Texts that no pair needs aren't shuffled."""

import random

import numpy as np

from tissueflow.llm import parity_join, resemblance
from tissueflow.llm.common import marked, saved
from tissueflow.llm.simhash import shingle_hashes


def shuffled(spark, run):
    """Bytes shuffled by ``run()``."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def random_texts(spark, n):
    rng = random.Random(3)
    return spark.createDataFrame([(i, " ".join(f"{rng.getrandbits(64):x}" for _ in range(60))) for i in range(n)], "doc_id long, text string").repartition(4)


def test_marked_keeps_all_wanted(spark):
    for kind in ("long", "string"):
        df = spark.range(20000).selectExpr(f"CAST(IF(id = 7, NULL, id) AS {kind}) AS k", "id AS v")
        wanted = saved(df.filter("v % 500 = 0").select("k"))
        got = marked(df, wanted, "k")
        assert got.columns == df.columns
        kept = {r.v for r in got.collect()}
        assert {v for v in range(0, 20000, 500)} <= kept and len(kept) < 2500
    assert marked(df, saved(df.filter("false").select("k")), "k").count() == 0


def test_texts_of_no_pair_stay(spark):
    docs = saved(random_texts(spark, 3000))
    wanted = saved(spark.createDataFrame([(10 * i, 10 * i) for i in range(5)], "sid long, least long"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the wanted are many
    try:
        assert shuffled(spark, lambda: saved(resemblance._texts(docs, wanted, "doc_id", "text"))) < 400_000  # all texts have 3 MB
        s = {i: parity_join._digest(np.unique(shingle_hashes(t.encode(), 5))) for i, t in docs.filter("doc_id < 2").collect()}
        known = saved(spark.createDataFrame([(i, i, *s[i]) for i in s], "sid long, least long, d1 long, d2 long"))
        pairs = saved(spark.createDataFrame([(0, 1)], "a long, b long"))
        assert shuffled(spark, lambda: parity_join._checked(pairs, docs, known, "doc_id", "text")) < 400_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
