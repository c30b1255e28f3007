"""What near duplicates send to the driver is bounded, and sets are compared without being broadcast."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tissueflow.llm import resemblance
from tissueflow.llm.common import mixed, saved
from tissueflow.llm.simhash import shingle_hashes


def test_marks_come_as_bytes(spark, monkeypatch):
    """200,000 crowded shingles: a row object each took tens of MB of the driver."""
    monkeypatch.setattr(resemblance, "BUCKET", 1)
    monkeypatch.setattr(resemblance, "ORDERS", 1)
    keys = np.unique(mixed(np.arange(10**6, dtype=np.uint64)))
    first = keys[:200_000].view(np.int64)
    known = saved(spark.range(2).select(F.col("id").alias("sid"), F.col("id").alias("least"), F.lit(10**6).alias("size")).crossJoin(spark.createDataFrame([(first.tolist(),)], "prefix array<long>")))
    docs = saved(spark.range(2).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))
    tracemalloc.start()
    try:
        posts = resemblance._prefixes(docs, known, lambda _: mixed(np.arange(10**6, dtype=np.uint64)), "doc_id", "text")
        assert tracemalloc.get_traced_memory()[1] < 20e6
    finally:
        tracemalloc.stop()
    marked = np.zeros(resemblance.SLOTS, np.uint8)
    marked[keys[:200_000] & np.uint64(resemblance.SLOTS - 1)] = 1
    expected = set(resemblance.prefix(keys, marked).view(np.int64).tolist())
    assert {r.key for r in posts.filter("sid = 1").collect()} == expected


def test_sets_are_not_broadcast(spark, monkeypatch):
    plans, kept = [], resemblance.saved
    monkeypatch.setattr(resemblance, "saved", lambda df: plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or kept(df))
    monkeypatch.setattr(resemblance, "BLOCK", 64)  # many cells
    words = [f"w{i}" for i in range(60)]
    texts = {i: " ".join([*words[:50], *(f"x{i}.{j}" for j in range(i))]) for i in range(12)} | {50: "", 51: "one two"}
    docs = saved(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    sets = {i: np.unique(shingle_hashes(t.encode(), 5)) for i, t in texts.items()}
    known = saved(spark.createDataFrame([(100 + i, i, len(s)) for i, s in sets.items()], "sid long, least long, size int"))
    pairs = [(i, j) for i in texts for j in texts if i < j]
    expected = {(100 + i, 100 + j) for i, j in pairs if len(s := np.intersect1d(sets[i], sets[j])) and 5 * len(s) >= 4 * len(np.union1d(sets[i], sets[j]))}
    given = spark.createDataFrame([(100 + i, 100 + j) for i, j in pairs], "a long, b long")
    got = resemblance._checked(given, docs, known, lambda x: shingle_hashes(x, 5), "doc_id", "text")
    assert {tuple(r) for r in got.collect()} == expected and 20 < len(expected) < len(pairs)
    assert not any("Broadcast" in plan and "array<bigint>" in plan for _, plan in plans)
    last = plans[-1]
    assert last[0] == ["a", "b"] and "CoGroup" in last[1]
