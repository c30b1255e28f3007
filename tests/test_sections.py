"""Many sections in one job, selection by words, projections and report tables, on hand-worked tables."""

import pytest
from pyspark.sql import functions as F

from tissueflow.operators import report, sections, selection

COUNTS = "section string, cell string, gene string, value long"
GENES = [(f"a{i}", "A", False) for i in range(6)] + [(f"b{i}", "B", False) for i in range(6)] + [("neg", None, True)]


def tables(spark, parts):
    counts, cells = [], []
    for p in parts:
        for c in range(4):
            cells.append((p, f"c{c}"))
            side = "ab"[c % 2]
            counts += [(p, f"c{c}", f"{side}{i}", 3 + len(p) + i + c) for i in range(6)] + [(p, f"c{c}", "b0" if side == "a" else "a0", 1)]
    counts += [(p, "low", "a0", 2) for p in parts] + [(p, "dirty", f"a{i}", 5) for p in parts for i in range(6)] + [(p, "dirty", "neg", 30) for p in parts]
    cells += [(p, c) for p in parts for c in ("low", "dirty", "bare")]
    return spark.createDataFrame(counts, COUNTS), spark.createDataFrame(cells, "section string, cell string"), spark.createDataFrame(GENES, "gene string, marker_set string, control boolean")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_three_sections_equal_three_single_jobs(spark):
    counts, cells, genes = tables(spark, ["s", "tt", "uuu"])
    whole = sections.run(counts, cells, genes)
    one_by_one = [sections.run(counts.filter(F.col("section") == p), cells.filter(F.col("section") == p), genes) for p in ("s", "tt", "uuu")]
    assert rows(whole.cells) == sorted((r for o in one_by_one for r in rows(o.cells)), key=str)
    assert rows(whole.stages) == sorted((r for o in one_by_one for r in rows(o.stages)), key=str)
    assert rows(whole.composition()) == sorted((r for o in one_by_one for r in rows(o.composition())), key=str)
    found = {(r.section, r.cell): r for r in whole.cells.collect()}
    assert [found["s", f"c{c}"].label for c in range(4)] == ["A", "B", "A", "B"]
    assert {found["s", c].final_label for c in ("low", "dirty", "bare")} == {"Unassigned: low quality"}
    assert {r.stage: (r.status, r.n_in, r.n_out) for r in whole.stages.filter("section = 'tt'").collect()} == {"load": ("ok", 7, 7), "quality": ("ok", 7, 4), "annotate": ("ok", 4, 4), "trust": ("ok", 4, 4)}


def test_section_that_quality_control_empties_stops_there(spark):
    counts, cells, genes = tables(spark, ["s"])
    poor = spark.createDataFrame([("poor", "c0", "a0", 1), ("poor", "c1", "a1", 2)], COUNTS)
    more = spark.createDataFrame([("poor", "c0"), ("poor", "c1")], cells.schema)
    out = sections.run(counts.union(poor), cells.union(more), genes).stages.filter("section = 'poor'")
    assert {r.stage: (r.status, r.n_out) for r in out.collect()} == {"load": ("ok", 2), "quality": ("empty", 0), "annotate": ("skipped", 0), "trust": ("skipped", 0)}


def test_sections_with_nulls_repeats_and_clashing_columns(spark):
    counts, cells, genes = tables(spark, ["s"])
    clean = rows(sections.run(counts, cells, genes).cells)
    odd = counts.union(spark.createDataFrame([(None, "c0", "a0", 9), ("s", None, "a0", 9), ("s", "c0", None, 9), ("s", "c0", "a0", None), ("s", "nobody", "a0", 9), ("s", "c0", "unknown", 9)], COUNTS))
    twice = cells.union(cells.limit(3)).union(spark.createDataFrame([(None, "c0"), ("s", None)], cells.schema))
    clash = (odd.withColumn("total", F.lit("x")).withColumn("control", F.lit(1)), twice.withColumn("label", F.lit("y")).withColumn("value", F.lit(0)), genes.union(genes.limit(2)).withColumn("section", F.lit("z")))
    assert rows(sections.run(*clash).cells) == clean
    none = sections.run(counts.limit(0), cells.limit(0), genes.limit(0))
    assert rows(none.cells) == [] == rows(none.stages) and rows(none.composition()) == []
    bare = sections.run(counts.limit(0), cells, genes)
    assert {r.status for r in bare.stages.filter("stage = 'quality'").collect()} == {"empty"}


@pytest.fixture(scope="module")
def judged(spark):
    made = [("1", "T cell", 50, 0.9, 0.9, "PASS", ""), ("2", "T cell", 40, 0.1, 0.4, "WARN", ""), ("3", "Tumor", 30, None, 0.1, "FAIL", "uncertain_lowconf"), ("4", "B cell", 20, 0.7, 0.8, "PASS", ""), ("5", None, 60, None, None, None, None)]
    return spark.createDataFrame(made, "cell string, label string, total long, malignant_score double, confidence double, verdict string, reason string")


def picked(df):
    return {(r.cell, r.rule) for r in df.collect()}


def test_criteria_in_order_of_precedence(judged):
    pick = lambda c, t=judged, **kw: picked(selection.select_cells(t, c, **kw))
    assert pick(" TUMOR ") == {("3", "Tumor")}  # a label of that name comes before the malignant score
    assert pick("tumour") == {("1", "malignant"), ("4", "malignant")}
    assert pick("abstained") == {("3", "abstained")}
    assert pick("low confidence") == {("2", "low confidence"), ("3", "low confidence")}
    assert pick("uncertain", judged.drop("verdict")) == {("2", "low confidence"), ("3", "low confidence"), ("5", "low confidence")}
    assert pick("poor", floor=25) == {("4", "low quality")}
    assert pick("bad") == {("4", "lowest decile")}  # nothing is flagged
    assert pick("b") == {("4", "B cell")}
    assert pick("cell") == {("4", "B cell")}  # of several labels the least
    assert pick("nothing like it") == set() == pick(" ")
    assert pick("malignant", judged.drop("malignant_score")) == set()
    assert pick("bad", judged.limit(0)) == set()


def test_projection_of_fields_and_genes(spark, judged):
    counts = spark.createDataFrame([("1", "CD3E", 4), ("1", "CD3E", 1), ("2", "MS4A1", 2)], "cell string, gene string, value long")
    panel = spark.createDataFrame([("CD3E",), ("MS4A1",), (None,)], "gene string")
    told = lambda n: {r.cell: (r.field, r.value) for r in selection.project(judged, counts, panel, n).collect()}
    assert told("Total Counts")["4"] == ("total", 20.0)
    assert told("cell type")["5"] == ("label", None) and told("label")["3"] == ("label", "Tumor")
    assert told("cd3e") == {"1": ("CD3E", 5.0)} | {c: ("CD3E", 0.0) for c in "2345"}
    assert told("niche") == {c: (None, None) for c in "12345"}


def test_report_blocks(spark, judged):
    coverage = spark.createDataFrame([("A", "green", 1.0), ("B", "red", 0.0)], "marker_set string, light string, fraction double")
    auc = spark.createDataFrame([("A", 0.9), ("B", None)], "type string, auc double")
    typable = spark.createDataFrame([("A", True, False), ("B", True, True), ("C", None, None)], "label string, typable boolean, weak boolean")
    panel = report.panel_report(coverage, auc, typable)
    assert tuple(panel.first()) == (2, 1, 0, 1, 0.5, 0.9, 1, 1, 1)
    ballot = spark.createDataFrame([("1", "m", "x"), ("2", "m", None), ("2", "n", "x"), ("9", "n", "x")], "cell string, method string, label string")
    assert rows(report.method_coverage(ballot, judged)) == [("m", 1, 0.2), ("n", 1, 0.2)]
    votes = spark.createDataFrame([("1", 1.0, 3), ("2", 0.5, 2)], "cell string, agreement double, n_methods int")
    long = report.report(report.block("panel", panel), report.block("composition", report.composition_head(judged, 2), "label"), report.block("consensus", report.consensus_summary(votes)))
    got = {(r.block, r.item, r.metric): r.value for r in long.collect()}
    assert got["composition", "T cell", "n"] == 2 and ("composition", "Tumor", "n") not in got and got["consensus", "", "share_trusted"] == 0.5 and got["panel", "", "n_red"] == 1
    assert tuple(report.panel_report(coverage.limit(0), auc.limit(0), typable.limit(0)).first()) == (0, 0, 0, 0, None, None, 0, 0, 0)
