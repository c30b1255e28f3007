"""Hand-worked cases of the section operators: nulls, empty tables, ties, repeated rows, and each rule's edges."""

import gzip
import json
import math

import pytest
from pyspark.sql import functions as F

from tissueflow.operators import calibrate, embedding, labels, spatial, trust
from tissueflow.sources import readers


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


def one(spark, expression, **values):
    kinds = {str: "string", bool: "boolean", int: "long", float: "double", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(expression.alias("x")).first()["x"]


def test_control_masks(spark):
    names = [("Gene Expression", "NegControlProbe1"), (None, "BLANK_3"), (None, "ACTB"), ("Deprecated Codeword", "DeprecatedCodeword_1"), ("Negative Control Probe", "x"), (None, None)]
    df = spark.createDataFrame(names, "feature_type string, gene string")
    got = [(r.c, r.n) for r in df.select(labels.is_control(F.col("feature_type"), F.col("gene")).alias("c"), labels.is_negative_control(F.col("feature_type"), F.col("gene")).alias("n")).collect()]
    assert got == [(False, False), (True, True), (False, False), (True, False), (True, True), (False, False)]
    assert rows(labels.panel_genes(df)) == [("ACTB",), ("NegControlProbe1",)]


def test_markers_resolve_by_name_then_by_unambiguous_case(spark):
    panel = spark.createDataFrame([("CD3D",), ("Cd8a",), ("cd8A",), ("MS4A1",), ("MS4A1",), (None,)], "gene string")
    markers = spark.createDataFrame([("T", "CD3D"), ("T", "cd3d"), ("T", "CD8A"), ("T", "Cd8a"), ("B", "ms4a1"), ("B", "CD19"), ("X", None)], "marker_set string, gene string")
    assert rows(labels.resolve_markers(markers, panel)) == sorted([("T", "CD3D", "CD3D"), ("T", "cd3d", "CD3D"), ("T", "CD8A", None), ("T", "Cd8a", "Cd8a"), ("B", "ms4a1", "MS4A1"), ("B", "CD19", None), ("X", None, None)], key=str)
    lists = {r.marker_set: (r.n_markers, r.present, r.missing, r.light) for r in labels.marker_lists(markers, panel).collect()}
    assert lists == {"T": (4, ["CD3D", "Cd8a"], ["CD8A"], "amber"), "B": (2, ["MS4A1"], ["CD19"], "amber"), "X": (0, [], [], "red")}


def test_organism(spark):
    f = lambda *g: labels.infer_organism(spark.createDataFrame([(x,) for x in g], "gene string")).first()["organism"]
    assert f("ACTB", "CD3D", "Cd4") == "human" and f("Actb", "Cd3d", "CD4") == "mouse" and f("ENSG00000001", None) is None


def test_abstentions_match_whole_labels(spark):
    assert one(spark, labels.is_abstention(F.col("l")), l="Unknown") and one(spark, labels.is_abstention(F.col("l")), l=None)
    assert not one(spark, labels.is_abstention(F.col("l")), l="Novel epithelial subtype X")
    assert one(spark, labels.collapsed(F.col("l")), l="Ambiguous: mixed") == "Not assigned"
    assert [one(spark, labels.is_missing_vote(F.col("l")), l=v) for v in ("NaN", " none ", "", None, "T")] == [True] * 4 + [False]


def test_label_match_levels(spark):
    categories = spark.createDataFrame([("T cell",), ("B cell",), ("Mast cell",), ("NK/T cell",)], "label string")
    asked = spark.createDataFrame([("T cell",), ("b CELL",), ("mast-cells",), ("mast",), ("cell",), ("xyz",), (None,), ("T cell",)], "label string")
    assert rows(labels.match_labels(asked, categories)) == sorted([("T cell", "T cell"), ("b CELL", "B cell"), ("mast-cells", "Mast cell"), ("mast", "Mast cell"), ("cell", None), ("xyz", None), (None, None)], key=str)
    assert rows(labels.canonical(asked.filter("label LIKE '%CELL'"), categories)) == [("b CELL", "B cell")]


def test_words(spark):
    cat = lambda x: one(spark, labels.category_of(F.col("l")), l=x)
    assert [cat(x) for x in ("CD8 T cell", "Plasma", "unknown thing", "Endothelial", "Unassigned", "DC dendritic")] == ["T/NK lymphoid", "B/plasma", "Other", "Vascular", "Other", "Myeloid"]
    assert one(spark, labels.organs(F.col("l")), l="Human Breast (ductal), LUNG") == ["breast", "lung"]
    assert one(spark, labels.same_tissue(F.col("a"), F.col("b")), a="renal cortex", b="Kidney") is True
    assert one(spark, labels.same_tissue(F.col("a"), F.col("b")), a="liver", b="Kidney") is False and one(spark, labels.same_tissue(F.col("a"), F.col("b")), a="liver", b="x") is None
    assert [one(spark, labels.assay_rank(F.col("a")), a=x) for x in ("10x 3' v3", "10x 3' v1", "Smart-seq2", "GEM-X", "new", None)] == [8, 5, 2, 9, 3, 3]
    assert one(spark, labels.in_tumour(F.col("a"), F.lit(False)), a="melanoma") is False and one(spark, labels.in_tumour(F.col("a")), a="Skin Melanoma") is True
    assert [round(one(spark, labels.log_odds(F.col("p")), p=p), 4) for p in (0.5, 0.999, 0.1, 0.8)] == [0.0, round(math.log(49), 4), 0.0, round(math.log(4), 4)]


def test_region_refuses_nothing_and_all(spark):
    cells = spark.range(4).withColumnRenamed("id", "cell")
    assert labels.region(cells, F.col("cell") < 1).count() == 1 and labels.region(cells, F.col("cell") < 1, exclude=True).count() == 3
    for p in ("cell < 0", "cell >= 0"):
        with pytest.raises(ValueError):
            labels.region(cells, F.expr(p))


CELLS = "cell long, label string, total double, n_genes long, pct_control double"


def judged(spark, cells, scores, lights=(("a", "green"), ("b", "green")), n_panel=100, schema=CELLS):
    s = spark.createDataFrame(scores, "cell long, marker_set string, score double")
    return {r.cell: r for r in trust.confidence(spark.createDataFrame(cells, schema), s, spark.createDataFrame(list(lights), "marker_set string, light string"), n_panel).collect()}


def test_confidence_by_hand(spark):
    cells = [(1, "A", 100.0, 50, 0.0), (2, "B", 100.0, 50, 5.0), (3, "A", 3.0, 50, 0.0), (4, "A", 100.0, 50, None), (5, "A", 100.0, 50, 0.0)]
    scores = [(i, m, v) for i, a, b in ((1, 2.0, 0.0), (2, 0.0, 1.0), (3, 1.0, 0.0), (4, 1.0, 1.0)) for m, v in (("a", a), ("b", b))]
    got = judged(spark, cells, scores)
    sd = (sum((m - 1.0) ** 2 for m in (2, 1, 1, 0)) / 4) ** 0.5
    assert got[1].confidence == pytest.approx(1 / (1 + math.exp(-2 / sd)), abs=1e-6) and got[1].verdict == "PASS" and got[1].final_label == "A"
    assert got[2].confidence == 0 and (got[2].verdict, got[2].reason, got[2].final_label) == ("FAIL", "ambiguous_mixed", "Ambiguous: mixed")
    assert (got[3].verdict, got[3].reason) == ("FAIL", "low_quality")
    assert got[4].best == "a" and got[4].confidence == pytest.approx(0.5, abs=1e-6) and got[4].verdict == "PASS"
    assert got[5].confidence == 0 and got[5].verdict == "FAIL"
    dim = judged(spark, cells, scores, (("a", "red"), ("b", "amber")))
    assert (dim[1].verdict, dim[1].reason) == ("FAIL", "unresolvable_panel")
    assert judged(spark, cells, scores, n_panel=5000)[1].verdict == "PASS" and judged(spark, [(1, "A", 100.0, 14, 0.0)], scores[:2], n_panel=5000)[1].reason == "low_quality"
    more = judged(spark, [(1, "A", 100.0, 50, 0.0, 0.5, 3, True), (2, "A", 100.0, 50, 0.0, 0.5, 2, False)], [*scores[:2], (2, "a", 2.0), (2, "b", 0.0)], schema=CELLS + ", agreement double, n_methods int, conflict boolean")
    assert more[1].confidence == pytest.approx(0.75 * more[2].confidence) and (more[1].verdict, more[1].reason) == ("WARN", "label_conflict")


def test_rejection_reasons_in_order(spark):
    cells = [(1, "A", 5.0, 2, 9.0, True, "FAIL", "low_quality"), (2, "A", 50.0, 2, 9.0, True, "FAIL", "x"), (3, "A", 50.0, 20, 9.0, True, "WARN", ""), (4, "A", 50.0, 20, 9.0, False, "FAIL", "x"), (5, "B", 50.0, 20, 0.0, False, "FAIL", "x"), (6, "C", 50.0, 20, None, None, "FAIL", "x"), (7, "D", 50.0, 20, 0.0, False, "FAIL", "novel"), (8, "D", 50.0, 20, 0.0, False, "FAIL", "x"), (9, "A", 1.0, 0, 9.0, True, "PASS", "")]
    j = spark.createDataFrame(cells, CELLS + ", impure boolean, verdict string, reason string")
    lights, pairs = spark.createDataFrame([("C", "amber")], "label string, light string"), spark.createDataFrame([("B", "E")], "a string, b string")
    got = trust.rejection_reasons(j, lights, pairs)
    assert rows(got, "cell", "rejection") == [(1, "too_few_counts"), (2, "too_few_genes"), (3, "mixed_lineages"), (4, "high_background"), (5, "panel_cannot_separate"), (6, "panel_cannot_resolve"), (7, "novel_unknown"), (8, "low_margin"), (9, "")]
    detail = {r.cell: r.detail for r in got.collect()}
    assert detail[9] is None and detail[5] == "B and E have no marker of their own" and detail[1].startswith("5 counts")
    b = trust.rejection_breakdown(got).collect()
    assert sum(r.n for r in b) == 8 and sum(r.share for r in b) == pytest.approx(1)
    assert trust.rejection_reasons(j.limit(0), lights).count() == 0


def test_votes(spark):
    v = spark.createDataFrame([(1, "x", "A"), (1, "y", "B"), (1, "z", "B"), (2, "x", "B"), (2, "y", "A"), (3, "x", "nan"), (4, "x", None), (4, "y", "C"), (4, "y", "C")], "cell long, method string, label string")
    assert rows(trust.vote(v), "cell", "label", "n_votes", "n_methods") == [(1, "B", 2, 3), (2, "A", 1, 2), (4, "C", 1, 1)]
    own = spark.createDataFrame([(2, "B")], "cell long, label string")
    assert rows(trust.vote(v, prefer=own).filter("cell = 2"), "label") == [("B",)]
    w = spark.createDataFrame([("x", 3.0), ("y", 1.0), ("z", 1.0)], "method string, weight double")
    assert rows(trust.vote(v, w).filter("cell = 1"), "label", "weight", "agreement") == [("A", 3.0, 1 / 3)]
    truth = spark.createDataFrame([(1, "B"), (2, "B")], "cell long, label string")
    assert rows(trust.reliability(v, truth), "method", "n", "reliability") == [("x", 2, 0.5), ("y", 2, 0.5), ("z", 1, 1.0)]
    bins = spark.createDataFrame([(1.0, 1), (0.9, 3), (0.7, 3), (0.5, 4), (0.4, 5)], "a double, n int").select(trust.reliability_bin(F.col("a"), F.col("n")).alias("b"))
    assert [r.b for r in bins.collect()] == ["single", "very_high", "high", "moderate", "low"]


def test_verify_and_remedies(spark):
    """Type A scores on its own program, B on A's, C is small, D has no program."""
    cells, scores = [], []
    for i in range(100):
        t = "A" if i < 40 else "B" if i < 80 else "C" if i < 90 else "D"
        cells.append((i, t))
        high = "a" if t in "AB" else "c"
        scores += [(i, m, (1.0 if m == high else 0.0) + 0.001 * (i % 7)) for m in "abc"]
    c, s = spark.createDataFrame(cells, "cell long, label string"), spark.createDataFrame(scores, "cell long, marker_set string, score double")
    p = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c")], "label string, marker_set string")
    lights = spark.createDataFrame([("A", "green"), ("B", "green")], "label string, light string")
    v = trust.self_verify(c, s, p, lights)
    got = {r.label: (r.status, r.cause, r.confused_with) for r in v.collect()}
    assert got == {"A": ("ok", None, None), "B": ("fail", "mislabel", "A"), "C": ("skipped_small", None, None), "D": ("unscoreable", None, None)}
    assert [(r.label, r.action, r.partner) for r in trust.remediation_plan(v).collect()] == [("B", "abstain", None), ("B", "relabel", "A")]
    gap = trust.self_verify(c, s, p, lights, spark.createDataFrame([("A", "B")], "a string, b string"))
    assert [(r.cause, r.action, r.partner) for r in trust.remediation_plan(gap).collect()] == [("panel_gap", "merge", "A")]
    assert trust.abstain_mislabelled(c, s, p, "B").filter("label = 'B'").count() == 0
    coverage = spark.createDataFrame([("A", 5, 4), ("B", 5, 0), ("E", 3, 3)], "label string, n_markers long, n_present long")
    typable = trust.typability(coverage, trust.identifiability(c, s, p), sizes=c.groupBy("label").count().withColumnRenamed("count", "n"), least=30)
    assert {r.label: (r.typable, r.basis) for r in typable.collect()} == {"A": (False, "identifiability_auc"), "B": (False, "identifiability_auc"), "C": (False, "identifiability_auc"), "E": (False, "coverage_only")}
    agreed = spark.createDataFrame([("A", 0.2)], "label string, agreed double")
    assert {r.label: r.flags for r in trust.trust_ledger(v, typable, agreed, least=30).collect()} == {"A": ["unresolvable", "methods_dispute", "coherent_but_disputed"], "B": ["unresolvable", "markers_dispute"]}


def test_auc_counts_ties_as_half(spark):
    v = spark.createDataFrame([("t", 1.0, True), ("t", 1.0, False), ("t", 0.0, False), ("u", 1.0, True)], "type string, score double, positive boolean")
    assert rows(trust.one_against_rest(v), "type", "auc") == [("t", 0.75), ("u", None)]


def test_states(spark):
    s = spark.createDataFrame([(c, m, v) for m, vs in (("p", (0.0, 0.0, 3.0)), ("q", (1.0, 1.0, 1.0))) for c, v in enumerate(vs)], "cell long, marker_set string, score double")
    assert rows(trust.dominant_state(s), "cell", "state") == [(0, None), (1, None), (2, "p")]
    m = trust.malignant_scores(s.filter("marker_set = 'p'"))
    assert rows(m, "cell", "malignant") == [(0, False), (1, False), (2, True)]


def test_calibration(spark):
    items = spark.createDataFrame([(i, 0.9 if i % 2 else 0.2, int(i % 2 and i % 10 != 1)) for i in range(400)], "item long, confidence double, correct int")
    r = calibrate.calibration_report(items).first()
    assert r.brier_after < r.brier_before and r.ece_after < r.ece_before and r.brier_skill > 0.4 and r.gate == 0.9 and r.gate_gain > 0
    model = calibrate.fit_isotonic(items)
    with pytest.raises(ValueError):
        calibrate.apply_isotonic(model, items, "confidence")
    c = [x.calibrated for x in calibrate.apply_isotonic(model, spark.createDataFrame([(x / 10,) for x in range(11)], "confidence double")).collect()]
    assert c == sorted(c) and 0 <= c[0] and c[-1] <= 1
    gate = calibrate.abstention_gate(items).orderBy("threshold").collect()
    assert [(g.kept, g.useful) for g in gate] == [(400, True), (200, True)] and gate[0].gain == 0


def test_agreement_of_labelings(spark):
    t = spark.createDataFrame([("a", "a")] * 3 + [("a", "b"), ("b", "b"), ("c", "b"), (None, "a")], "p string, t string")
    s = calibrate.classification_scores(t, "p", "t").first()
    assert (s.n, round(s.accuracy, 6), round(s.balanced_accuracy, 6)) == (6, 0.666667, round((1 + 1 / 3) / 2, 6))
    assert s.macro_f1 == pytest.approx((6 / 7 + 0.5 + 0) / 3) and s.kappa == pytest.approx((4 / 6 - 15 / 36) / (1 - 15 / 36))
    up = spark.createDataFrame([("b", "root"), ("c", "root")], "label string, parent string")
    assert calibrate.hierarchical_accuracy(t, up, "p", "t").first().hierarchical == pytest.approx((4 + 0.5) / 6)
    same = calibrate.composition_accuracy(t.select("t", F.col("t").alias("u")), "t", "u").first()
    assert same.l1 == 0 and same.jsd == pytest.approx(0) and same.pearson == pytest.approx(1)
    x = spark.createDataFrame([("s", "a", 1.0), ("r", "b", 1.0)], "spot string, type string, share double")
    perfect = calibrate.deconvolution_scores(x, x).first()
    assert (perfect.rmse, perfect.jsd_by_spot, perfect.r2) == (0, 0, 1)
    assert calibrate.deconvolution_scores(x.withColumn("type", F.lit("z")), x).first().jsd_by_spot == pytest.approx(1)


def test_conformal_sets(spark):
    cal = spark.createDataFrame([(1 - x / 20,) for x in range(1, 20)], "p_true double")
    p = spark.createDataFrame([("i", "a", 0.5), ("i", "b", 0.05), ("j", "a", 0.01)], "item string, label string, p double")
    assert rows(calibrate.conformal_sets(cal, p), "item", "labels") == [("i", ["a"]), ("j", [])]
    assert rows(calibrate.conformal_sets(cal.limit(2), p), "item", "size") == [("i", 2), ("j", 1)]


def test_quality_index(spark):
    q = calibrate.quality_index(spark.createDataFrame([("s", 1.0, 0.5, 0.5, None), ("t", 0.0, 1.0, 1.0, 0.4)], "section string, coherence double, programs double, purity double, ceiling double"))
    assert [(round(r.aqi, 6), r.limiting) for r in q.orderBy("section").collect()] == [(0.5, "programs"), (0.34, "ceiling")]


def test_neighbours_widen_until_found(spark):
    pts = [(i, float(i), 0.0) for i in range(20)] + [(20, 1e6, 1e6), (21, None, 1.0), (22, 3.0, 0.0)]
    df = spark.createDataFrame(pts, "cell long, x double, y double")
    got = rows(spatial.neighbours(df, 3), "src", "dst")
    ok = [p for p in pts if p[1] is not None]
    brute = sorted(((a[0], b[0]) for a in ok for b in sorted((b for b in ok if b[0] != a[0]), key=lambda b, a=a: (round(math.hypot(a[1] - b[1], a[2] - b[2]), 6), b[0]))[:3]), key=str)
    assert got == brute
    assert spatial.neighbours(df.limit(1), 3).count() == 0 and spatial.neighbours(df.filter("cell < 3"), 6).count() == 6


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i % 3 * 10) + 0.1 * (i % 5), 1.0 * (i % 7)], i % 3) for i in range(90)], "item long, embedding array<double>, label long")
    pairs = embedding.adjacent_clusters(v, 1)
    assert rows(pairs, "a", "b") == [(0, 1), (1, 2)]
    assert all(r.balanced_accuracy == 1 and r.n == 60 for r in embedding.separation(v, pairs).collect())
    mixed = embedding.separation(v.withColumn("label", F.pmod(F.xxhash64("item"), F.lit(2))), spark.createDataFrame([(0, 1)], "a long, b long")).first()
    assert mixed.balanced_accuracy < 0.7
    assert len(embedding.principal_axes(v, 5).first()["pca"]) == 2


@pytest.fixture
def triplets(tmp_path):
    def write(folder):
        folder.mkdir(parents=True)
        for name, text in (("barcodes.tsv", "c1\nc2\nc3\n"), ("features.tsv", "i1\tACTB\tGene Expression\ni2\tCD3D\tGene Expression\ni3\tBLANK1\tBlank Codeword\n"), ("matrix.mtx", "%%MatrixMarket matrix coordinate integer general\n%\n3 3 4\n1 1 5\n2 1 1\n3 2 2\n2 3 7\n")):
            with gzip.open(folder / f"{name}.gz", "wt") as f:
                f.write(text)
        return folder

    return write


def test_readers_give_one_form(spark, tmp_path, triplets):
    x = tmp_path / "x"
    triplets(x / "cell_feature_matrix")
    spark.createDataFrame([("c1", 1.0, 2.0, 9.0), ("c2", 3.0, 4.0, 8.0)], "cell_id string, x_centroid double, y_centroid double, cell_area double").write.parquet(str(x / "cells.parquet"))
    c = tmp_path / "c"
    c.mkdir()
    (c / "s_exprMat_file.csv").write_text("fov,cell_ID,ACTB,Negative1\n1,1,3,0\n1,2,0,1\n")
    (c / "s_metadata_file.csv").write_text("fov,cell_ID,CenterX_global_px,CenterY_global_px\n1,1,10,20\n1,2,30,40\n")
    m = tmp_path / "m"
    m.mkdir()
    (m / "cell_by_gene.csv").write_text("cell,ACTB,Blank-1\n7,2,1\n8,0,0\n")
    (m / "cell_metadata.csv").write_text("EntityID,center_x,center_y\n7,1.5,2.5\n8,3,4\n")
    f = triplets(tmp_path / "f")
    h = tmp_path / "h" / "binned_outputs" / "square_008um"
    triplets(h / "filtered_feature_bc_matrix")
    spark.createDataFrame([("c1", 5, 6), ("c9", 7, 8)], "barcode string, pxl_row_in_fullres int, pxl_col_in_fullres int").write.parquet(str(h / "spatial" / "tissue_positions.parquet"))
    tables, meta = readers.assembled(spark, [("x", "xenium", str(x)), ("c", "cosmx", str(c)), ("m", "merscope", str(m)), ("f", "flex", str(f)), ("h", "visiumhd", str(tmp_path / "h"))])
    ten_x = [("c1", "ACTB", 5.0), ("c1", "CD3D", 1.0), ("c2", "BLANK1", 2.0), ("c3", "CD3D", 7.0)]
    assert rows(tables.counts) == sorted([(s, *r) for s in "xfh" for r in ten_x] + [("c", "1_1", "ACTB", 3.0), ("c", "1_2", "Negative1", 1.0), ("m", "7", "ACTB", 2.0)], key=str)
    places = {(r.section, r.cell): (r.x, r.y) for r in tables.cells.collect()}
    assert places["x", "c1"] == (1.0, 2.0) and places["c", "1_2"] == (30.0, 40.0) and places["m", "8"] == (3.0, 4.0) and places["f", "c1"] == (None, None) and places["h", "c1"] == (6.0, 5.0) and ("h", "c9") not in places
    assert {r.section: (r.platform, r.n_panel_genes, r.has_places) for r in meta.collect()} == {"x": ("xenium", 2, True), "c": ("cosmx", 1, True), "m": ("merscope", 1, True), "f": ("flex", 2, False), "h": ("visiumhd", 2, True)}
    assert rows(readers.read_merscope(spark, str(m), "m").controls, "gene", "value") == [("Blank-1", 1.0)]
    readers.write_section({"cells": tables.cells, "counts": tables.counts.withColumnRenamed("value", "a/b value")}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "counts")).filter("section = 'c'").count() == 2


def test_platforms(spark):
    files = {"x": ["experiment.xenium"], "c": ["a_exprMat_file.csv", "a_metadata_file.csv"], "m": ["cell_by_gene.csv", "cell_metadata.csv"], "h": ["binned_outputs"], "f": ["filtered_feature_bc_matrix.h5"], "v": ["filtered_feature_bc_matrix.h5", "spatial"], "t": ["transcripts.parquet"], "z": ["a.txt", None]}
    got = {r.dir: (r.platform, r.reason is None) for r in readers.platforms(spark.createDataFrame([(d, n) for d, ns in files.items() for n in ns], "dir string, file_name string")).collect()}
    assert got == {"x": ("xenium", True), "c": ("cosmx", True), "m": ("merscope", True), "h": ("visiumhd", True), "f": ("flex", True), "v": (None, False), "t": (None, False), "z": (None, False)}


def test_side_tables(spark, tmp_path):
    cells = spark.createDataFrame([("a",), ("b",), ("c",)], "cell string")
    side = spark.createDataFrame([("a", 0.9), ("a", 0.9), ("b", 0.1), ("z", 1.0), (None, 1.0)], "cell string, vsi double")
    out, coverage = readers.joined_side(cells, side, ["none", "vsi"], "p_")
    assert rows(out) == [("a", None, 0.9), ("b", None, 0.1), ("c", None, None)] and coverage.first()["coverage"] == pytest.approx(2 / 3)
    assert rows(readers.with_signal(cells, side)) == [("a", 0.9, True), ("b", 0.1, False), ("c", None, None)]
    assert rows(readers.with_malignancy(cells, side.withColumnRenamed("vsi", "probability")), "cell", "is_malignant") == [("a", True), ("b", False), ("c", False)]
    pixels = spark.createDataFrame([("a", 2.0, 0.5), ("a", 3.0, 0.9), ("a", 1.0, 0.0), ("UNASSIGNED", 9.0, 0.1)], "cell string, signal double, vsi double")
    assert rows(readers.pixel_integrity(pixels)) == [("a", 0.7, 0.5, 2)]
    counts = spark.createDataFrame([("a", "g", 3.0), ("b", "h", 1.0)], "cell string, gene string, value double")
    assert rows(readers.purified(counts, spark.createDataFrame([("a", "g", 1.0), ("a", "x", 1.0), ("y", "g", 1.0), ("b", "h", 0.0)], "cell string, gene string, value double"))) == [("a", "g", 1.0)]
    (tmp_path / "o.obo").write_text("format-version: 1\n\n[Term]\nid: CL:1\nname: a\n\n[Term]\nid: CL:2\nis_a: CL:1 ! a\nis_a: CL:3\n\n[Term]\nid: CL:4\nis_a: CL:1\nis_obsolete: true\n")
    assert rows(readers.ontology_edges(spark, str(tmp_path / "o.obo"))) == [("CL:2", "CL:1"), ("CL:2", "CL:3")]
    (tmp_path / "g.gtf").write_text('#x\nchr1\th\tgene\t5\t9\t.\t+\t.\tgene_id "i"; gene_name "A";\nchr1\th\tgene\t1\t3\t.\t+\t.\tgene_name "A";\nchrM\th\tgene\t1\t3\t.\t+\t.\tgene_name "B";\nchrX\th\texon\t1\t3\t.\t+\t.\tgene_name "C";\n')
    assert rows(readers.gene_positions(spark, str(tmp_path / "g.gtf"), spark.createDataFrame([("A",), ("B",), ("C",)], "gene string"))) == [("A", "1", 1, 3)]
    (tmp_path / "e.json").write_text(json.dumps({"panel_name": "P", "panel_organism": "Human", "panel_tissue_type": "Breast", "panel_num_targets_predesigned": 300, "panel_num_targets_custom": 20}))
    assert readers.panel_facts(spark, str(tmp_path / "e.json")).first()["label"] == "P, human, breast, 320 targets"
    ref = spark.createDataFrame([(f"CL:{i}", "T" if i % 2 else "B", "lung" if i else " ") for i in range(9)], "cell_type string, annotation string, tissue string")
    assert readers.label_column(ref) == "annotation" and readers.declared_tissue(ref).first()["tissue"] == "lung" and readers.label_column(ref.select("tissue")) is None
    rings = readers.boundaries(spark.createDataFrame([("a", 1.0, 2.0, 1), ("a", 0.0, 0.0, 0), ("q", 1.0, 1.0, 0)], "cell_id string, vertex_x double, vertex_y double, ord int"), cells)
    assert [(r.cell_id, [tuple(p) for p in r.ring]) for r in rings.collect()] == [("a", [(0.0, 0.0), (1.0, 2.0)])]
