"""Self-verification with compartments, and the self-heal loop on planted faults."""

import pytest
from pyspark.sql import functions as F

from tissueflow.operators import healing, trust
from tissueflow.operators.labels import ABSTAIN


def section(spark, wrong=0):
    """Three types that score highest on their own program, but ``wrong`` cells of A, which are B by their scores."""
    cells = [(i, "ABC"[i // 60]) for i in range(180)]
    of = {i: "B" if i < wrong else t for i, t in cells}
    scores = [(i, s, (3.0 if s == of[i] else 0.0) + (i * 7 % 10) / 100) for i, _ in cells for s in "ABC"]
    frame = spark.createDataFrame
    counts = [(i, "ABC".index(of[i]) * 10 + g, 4.0 + (i + g) % 3) for i, _ in cells for g in range(10)] + [(i, 30 + g, 1.0) for i, _ in cells for g in range(5)]
    programs = frame([(t, t) for t in "ABC"], "label string, marker_set string")
    lights = frame([(t, "green") for t in "ABC"], "label string, light string")
    genes = frame([(g, "x", False) for g in range(35)], "gene long, marker_set string, control boolean")
    return frame(counts, "cell long, gene long, value double"), frame(cells, "cell long, label string"), genes, frame(scores, "cell long, marker_set string, score double"), programs, lights


def test_a_healthy_section_is_left_alone(spark):
    parts = section(spark)
    got = healing.self_heal(*parts)
    assert got.failed_first == got.failed_last == [] and got.rounds.count() == 0 and got.advice.count() == 0
    assert sorted(map(tuple, got.cells.collect())) == sorted(map(tuple, parts[1].collect()))


def test_a_planted_mislabel_is_healed_in_one_round(spark):
    got = healing.self_heal(*section(spark, 45))
    assert got.failed_first == ["A"] and got.failed_last == []
    assert [tuple(r) for r in got.rounds.collect()] == [(1, "A", "abstain", True, 45, None)]
    label = {r.cell: r.label for r in got.cells.collect()}
    assert all(label[i] == ABSTAIN["uncertain_lowconf"] for i in range(45)) and all(label[i] == "A" for i in range(45, 60)) and label[100] == "B"


def test_each_action_is_tried_once_and_advice_remains(spark):
    counts, cells, genes, scores, programs, lights = section(spark, 60)
    got = healing.self_heal(counts, cells, genes, scores, programs, lights, rounds=5)
    assert got.rounds.filter("action = 'abstain'").count() == 1 and got.rounds.agg(F.max("round")).first()[0] == 1
    assert got.cells.filter("label = 'A'").count() == 0 and got.failed_last == []
    pairs = spark.createDataFrame([("A", "B")], "a string, b string")
    kept = healing.self_heal(counts, cells, genes, scores, programs, lights, pairs)
    assert kept.failed_last == ["A"] and [(r.label, r.action, r.partner) for r in kept.advice.collect()] == [("A", "merge", "B")]
    joined = healing.self_heal(counts, cells, genes, scores, programs, lights, pairs, merge=True)
    assert {r.label for r in joined.cells.select("label").distinct().collect()} >= {"A + B", "C"} and sorted(map(tuple, joined.merged.collect())) == [("A", "A + B"), ("B", "A + B")]


@pytest.mark.parametrize("compartments, cause, target", [((["x"], ["x"]), "panel_gap", "B"), ((["x"], ["y"]), "low_signal", None), ((["x"], []), "panel_gap", "B")])
def test_merge_targets_are_of_the_same_compartment(spark, compartments, cause, target):
    _, cells, _, scores, programs, lights = section(spark, 45)
    placed = spark.createDataFrame(list(zip("AB", compartments, strict=True)), "label string, compartments array<string>")
    pairs = spark.createDataFrame([("B", "A")], "a string, b string")
    r = trust.self_verify(cells, scores, programs, lights, pairs, placed=placed).filter("label = 'A'").first()
    assert (r.status, r.cause, r.merge_target) == ("fail", cause, target)


def test_reasons_fall_back_on_the_verdict(spark):
    rows = [(1, "FAIL", "unresolvable_panel"), (2, "FAIL", "ambiguous_mixed"), (3, "WARN", ""), (4, "PASS", "")]
    judged = spark.createDataFrame([(i, "A", 50.0, 20, v, r) for i, v, r in rows], "cell long, label string, total double, n_genes long, verdict string, reason string")
    lights = spark.createDataFrame([("A", "green")], "label string, light string")
    assert {r.cell: r.rejection for r in trust.rejection_reasons(judged, lights).collect()} == {1: "panel_cannot_resolve", 2: "mixed_lineages", 3: "low_margin", 4: ""}
