"""Weights of marker sets as a plan against their SQL, and no window over all genes."""

import re

from pyspark.sql import functions as F

from tissueflow.operators.scores import weights
from tissueflow.operators.statements import SCORES, WEIGHTS
from tissueflow.plans.registry import QUERIES
from tissueflow.sources.section import from_driver_tables


def test_weights_equal_their_sql(spark, small):
    s = from_driver_tables(spark, small)
    rows = lambda df: sorted((r.marker_set, r.gene, round(r.w, 12)) for r in df.select("marker_set", "gene", "w").collect())
    want = spark.sql(WEIGHTS, counts=s["counts"], genes=s["genes"])
    assert rows(weights(s)) == rows(want)


def test_no_task_ranks_all_genes(spark, small):
    for name in ("dominant_states", "top_two_margin", "soft_label_entropy", "positive_marker_purity"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"\bntile\(", plan)
    assert re.search(r"\bntile\(", SCORES)


def test_stability_draws_transcripts_in_one_row_a_count(spark, small):
    from tissueflow.operators import thinning

    s = from_driver_tables(spark, small)
    t = thinning.thinned_lists(s["counts"], F.lit(0.8), 5)
    assert t.count() == s["counts"].count() and t.filter("size(left) <> 5").isEmpty()


def test_parts_of_shuffles_follow_the_tables(spark, small, monkeypatch):
    from tissueflow.plans import registry

    monkeypatch.setattr(registry, "PART", 1024)
    try:
        assert QUERIES["top_two_margin"](spark, small).count() > 0
        assert int(spark.conf.get(registry.PARTS)) > 100
        spark.conf.set(registry.PARTS, "17")  # a session's own number
        QUERIES["low_signal"](spark, small)
        assert spark.conf.get(registry.PARTS) == "17"
    finally:
        for key in (registry.PARTS, registry.ADVISORY, registry.SPLIT):
            spark.conf.unset(key)
            spark.conf.unset(f"tissueflow.{key}")


def test_medians_of_layers_are_not_held_in_one_task(spark):
    from tissueflow.operators import layers

    df = spark.createDataFrame([(c, g, float(c + g), float(c)) for c in range(9) for g in range(3)] + [(None, 1, 5.0, 5.0)], "cell long, gene long, before double, after double")
    got = layers.layer_change(df)
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(got.first()) == (15.0, 12.0, 3.0, 3.0)


def test_a_type_s_scores_are_not_summed_in_one_task(spark):
    from tissueflow.operators import trust

    scores = [("t", float(i % 7), i % 3 == 0) for i in range(60)] + [("u", float(i), i > 4) for i in range(8)] + [(None, 1.0, True), ("v", 2.0, True)]
    df = spark.createDataFrame(scores, "type string, score double, positive boolean")
    got = trust.one_against_rest(df)
    assert "__range" in got._jdf.queryExecution().optimizedPlan().toString()
    pairs = lambda t: [(a, b) for k, a, p in scores if k == t and p for l, b, q in scores if l == t and not q]  # noqa: E731,E741
    want = {t: sum((a > b) + (a == b) / 2 for a, b in pairs(t)) / len(pairs(t)) if pairs(t) else None for t in ("t", "u", "v")}
    assert {r["type"]: r.auc and round(r.auc, 12) for r in got.collect()} == {t: x and round(x, 12) for t, x in want.items()}


def test_a_statement_s_parts_are_made_once(spark, small):
    from tissueflow.operators.statements import METRICS, NORMALISED, STATEMENTS

    s = from_driver_tables(spark, small)
    text = STATEMENTS["posterior_confidence"]
    want = {(r.cell, r.posterior) for r in spark.sql(text.replace(f"({WEIGHTS})", "{w}"), counts=s["counts"], cells=s["cells"], genes=s["genes"], w=weights(from_driver_tables(spark, small))).collect()}
    assert {(r.cell, r.posterior) for r in s.sql(text).collect()} == want
    assert SCORES in s.kept and NORMALISED in s.kept
    s.once(STATEMENTS["section_qc_summary"])
    assert METRICS in s.kept
