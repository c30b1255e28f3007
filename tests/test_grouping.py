"""Hand-worked cases and brute force of the operators on groups of labels and on references."""

import numpy as np
from pyspark.sql import functions as F

from tissueflow.operators import grouping, references, spillover


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


def test_gene_sharing(spark):
    m = spark.createDataFrame([("T", "A"), ("T", "A"), ("T", "B"), ("B", "B"), (None, "C"), ("B", None)], "marker_set string, gene string")
    assert rows(grouping.gene_sharing(m)) == [("B", "B", 2, False), ("T", "A", 1, True), ("T", "B", 2, False)]


def test_label_groups_of_chains_and_unknown_labels(spark):
    n = 40
    labels = spark.createDataFrame([(f"{i:02}",) for i in range(n)] + [("z",), (None,), ("z",)], "label string")
    pairs = spark.createDataFrame([(f"{i:02}", f"{i + 1:02}") for i in range(n - 1) if i != 19] + [("z", "nowhere"), ("z", "z"), (None, "z")], "a string, b string")
    assert rows(grouping.label_groups(labels, pairs)) == sorted([(f"{i:02}", "00" if i < 20 else "20") for i in range(n)] + [("z", "z")])
    assert rows(grouping.label_groups(labels.limit(0), pairs)) == []


def test_merge_map(spark):
    c = spark.createDataFrame([("a", "b", 0.3), ("b", None, None), ("c", "a", 0.25), ("d", "a", 0.24), ("e", "gone", 0.9)], "label string, confused_with string, share double")
    assert rows(grouping.merge_map(c)) == [("a", "a + b + c"), ("b", "a + b + c"), ("c", "a + b + c"), ("d", "d"), ("e", "e")]


def test_compartments_and_merging(spark):
    isa = spark.createDataFrame([("t4", "t"), ("t8", "t"), ("t", "leuko"), ("mast", "leuko"), ("leuko", "cell"), ("fib", "cell"), ("x", "y"), ("y", "x")], "child string, parent string")
    got = rows(grouping.ancestors(isa).filter("term IN ('t4', 'x')"))
    assert got == [("t4", "cell"), ("t4", "leuko"), ("t4", "t"), ("t4", "t4"), ("x", "x"), ("x", "y")]
    anchors = spark.createDataFrame([("leuko", "immune"), ("fib", "stromal")], "term string, compartment string")
    labels = spark.createDataFrame([("CD4", "t4"), ("CD8", "t8"), ("Fib", "fib"), ("LYVE1_macrophage", None), ("Capillary_EC", None), ("strange", None)], "label string, term string")
    placed = grouping.compartments(labels, isa, anchors)
    assert rows(placed) == [("CD4", ["immune"]), ("CD8", ["immune"]), ("Capillary_EC", ["endothelial"]), ("Fib", ["stromal"]), ("LYVE1_macrophage", ["immune"]), ("strange", [])]
    pairs = spark.createDataFrame([("CD4", "CD8"), ("CD8", "Fib"), ("CD4", "strange")], "a string, b string")
    assert rows(grouping.mergeable(pairs, placed)) == [("CD4", "CD8", True), ("CD4", "strange", None), ("CD8", "Fib", False)]
    cells = spark.createDataFrame([(1, "CD4"), (2, "CD8"), (3, "Fib"), (4, None)], "cell long, label string")
    out, names = grouping.merged_types(cells, pairs.filter("b <> 'strange'"), placed)
    assert rows(out, "cell", "label") == [(1, "CD4 + CD8"), (2, "CD4 + CD8"), (3, "Fib"), (4, None)]
    assert rows(names) == [("CD4", "CD4 + CD8"), ("CD8", "CD4 + CD8")]


def test_marker_overview_equals_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    total = {(c, g): int(rng.integers(0, 30)) for c in "abcd" for g in range(12)}
    sizes = {"a": 10, "b": 7, "c": 20, "d": 5}
    expected, used = [], set()
    for c in sorted(sizes):
        gap = {g: round(total[c, g] / sizes[c] - sum(total[o, g] for o in sizes if o != c) / sum(n for o, n in sizes.items() if o != c), 9) for g in range(12)}
        for g in [g for g in sorted(gap, key=lambda g: (-gap[g], g)) if g not in used and gap[g] > 0][:2]:
            expected.append((len(expected), c, g))
            used.add(g)
    means = spark.createDataFrame([(c, g, float(v)) for (c, g), v in total.items()], "label string, gene long, total double")
    assert rows(grouping.marker_overview(means, spark.createDataFrame(list(sizes.items()), "label string, n long"))) == expected


def test_split_test_equals_numpy(spark):
    rng = np.random.default_rng(4)
    two = np.concatenate([rng.normal(-4, 1, (40, 3)), rng.normal(4, 1, (40, 3))])
    sets = {"two": two, "one": rng.normal(0, [3, 1, 1], (80, 3)), "few": rng.normal(0, 1, (6, 3)), "same": np.ones((30, 3))}
    items = [(i, x.tolist(), c) for c, m in sets.items() for i, x in enumerate(m)] + [(99, None, "one"), (98, [1.0, 2.0, 3.0], None)]
    df = spark.createDataFrame(items, "item long, embedding array<double>, label string").repartition(5)
    got = {r["label"]: r for r in grouping.split_test(df).collect()}
    for c, m in sets.items():
        x, n = m - m.mean(0), len(m)
        t = x @ np.linalg.eigh(x.T @ x)[1][:, -1]
        s = t.std()
        if n < 20 or s < 1e-9:
            expected = 0.0
        else:
            g = (t**3).mean() / s**3 * np.sqrt(n * (n - 1)) / (n - 2)
            k = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * ((t**4).mean() / s**4 - 3) + 6)
            expected = (g**2 + 1) / (k + 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)))
        assert got[c]["n"] == n and abs(got[c]["bimodality"] - expected) < 1e-6
    assert {c: r["verdict"] for c, r in got.items()} == {"two": "split", "one": "ok", "few": "ok", "same": "ok"}
    programs = df.select(F.col("item"), F.lit("p").alias("program")).distinct()
    assert {r["verdict"] for r in grouping.split_test(df, programs=programs).collect()} == {"ok"}
    merges = spark.createDataFrame([("one", "few", 0.6), ("one", "two", 0.9)], "a string, b string, balanced_accuracy double")
    types = spark.createDataFrame([("one", "T"), ("one", "T"), ("one", "B"), ("few", "T"), ("two", "B")], "label string, type string")
    panel = {r["label"]: (r["type"], r["merge_with"], r["same_type"], r["verdict"]) for r in grouping.cluster_panel(merges, grouping.split_test(df), types).collect()}
    assert panel == {"one": ("T", ["few"], True, "merge"), "few": ("T", ["one"], True, "merge"), "two": ("B", None, False, "split"), "same": (None, None, False, "ok")}


def test_references(spark):
    refs = spark.createDataFrame([("skin", ["melanoma", "dermal", "uveal"], True, 0.5), ("liver", ["liver", "hepatic"], True, None), ("pan", None, True, 0.9), ("eye", ["uveal", "melanoma", "liver"], False, None)], "key string, keywords array<string>, available boolean, gene_overlap double")
    ranked = references.rank_references("Uveal melanoma, liver", refs)
    assert [(r["key"], r["keyword_score"], r["match_coverage"]) for r in ranked.collect()] == [("eye", 1.0, 3), ("skin", 1.0, 2), ("liver", 1.0, 1)]
    assert rows(references.auto_reference(ranked), "key") == [("skin",)]
    assert rows(references.auto_reference(references.rank_references("", refs)), "key") == []
    asked = spark.createDataFrame([("Breast",), ("mouse embryo",), ("left lung lobe",), ("bone tissue",), ("",), (None,), ("zzz",)], "tissue string")
    names = spark.createDataFrame([("breast",), ("embryo",), ("lung",), ("bone marrow",), ("bone marrow tissue",)], "label string")
    assert rows(references.tissue_label(asked, names)) == sorted([("Breast", "breast"), ("mouse embryo", "embryo"), ("left lung lobe", "lung"), ("bone tissue", "bone marrow tissue"), ("", None), (None, None), ("zzz", None)], key=str)


def test_reference_cells(spark):
    cells = [(i, "T", "10x 3' v3" if i % 2 else "10x 3' v2") for i in range(20)] + [(100 + i, "B", "Smart-seq2") for i in range(3)] + [(200, "B", "Visium")]
    df = spark.createDataFrame(cells, "cell long, label string, assay string")
    pick = lambda d, **k: sorted(r["cell"] for r in references.reference_cells(d, tie=F.col("cell"), **k).collect())
    assert pick(df, target=8, least=1) == [1, 3, 5, 7, 9, 100, 101, 102]
    assert pick(df, target=4, least=3) == [1, 3, 5, 100, 101, 102]
    assert pick(df.filter("assay = 'Visium'"), target=4) == [200]
    assert pick(df.limit(0), target=4) == []


def test_ontology_and_corpus_markers(spark):
    terms = spark.createDataFrame([("1", "T cell", "name"), ("2", "B cell", "name"), ("3", "T-cell", "synonym"), ("4", "lymph", "alias")], "term string, name string, kind string")
    labels = spark.createDataFrame([("t CELL",), ("B",), ("lymph",), ("lymp",), (None,)], "label string")
    assert rows(references.ontology_ids(labels, terms)) == sorted([("t CELL", "1"), ("B", "2"), ("lymph", "4"), ("lymp", None), (None, None)], key=str)
    h = "Homo sapiens"
    records = [("1", h, None, "CD3D", 0.5, 0.9, 2.0), ("1", h, None, "CD3D", 0.5, 0.9, 3.0), ("1", h, None, "CD8A", 0.5, 0.9, 1.0), ("1", h, "lung", "X", 0.9, 0.9, 9.0), ("1", h, None, "LOW", 0.05, 0.9, 9.0), ("2", h, None, "MS4A1", 0.5, 0.9, 1.0), ("2", None, None, "Q", 0.5, 0.9, 1.0)]
    computed = references.computed_markers(spark.createDataFrame(records, "term string, organism string, tissue string, symbol string, pc double, specificity double, score double"))
    assert rows(computed) == [("1", h, "CD3D", 3.0, 1), ("1", h, "CD8A", 1.0, 2), ("2", "?", "Q", 1.0, 1), ("2", h, "MS4A1", 1.0, 1)]
    canonical = spark.createDataFrame([("1", "CD8A", 1), ("1", "CD2", 9), ("1", "CD5", 10), ("2", "CD19", 5)], "term string, symbol string, citations long")
    assert rows(references.corpus_markers(canonical, computed, h)) == [("1", "CD2", 3, "canonical"), ("1", "CD5", 2, "canonical"), ("1", "CD8A", 1, "canonical"), ("2", "MS4A1", 1, "computed")]
    assert rows(references.corpus_markers(canonical, computed, "Mus musculus")) == []


def test_spillover(spark):
    cells = spark.createDataFrame([(1, "T"), (2, "B"), (3, "B"), (4, None), (5, "X")], "cell long, lineage string")
    markers = spark.createDataFrame([("T", "CD3"), ("B", "MS4A1"), ("T", "PTPRC"), ("B", "PTPRC"), ("Y", "GONE")], "marker_set string, gene string")
    edges = spark.createDataFrame([(2, 1), (1, 2), (4, 1), (3, 5), (5, 3)], "cell long, neighbour long")
    counts = spark.createDataFrame([(1, "CD3", 5), (1, "MS4A1", 2), (2, "CD3", 3), (2, "CD3", 3), (2, "PTPRC", 4), (3, "CD3", 1), (4, "CD3", 7), (5, "MS4A1", 6), (5, "GONE", 1), (9, "CD3", 1)], "cell long, gene string, value long")
    out = spillover.spillover_removed(counts, cells, markers, edges)
    assert rows(out) == sorted([(1, "CD3", 5, 5), (1, "MS4A1", 2, 0), (2, "CD3", 3, 0), (2, "CD3", 3, 0), (2, "PTPRC", 4, 4), (3, "CD3", 1, 1), (4, "CD3", 7, 0), (5, "MS4A1", 6, 0), (5, "GONE", 1, 1), (9, "CD3", 1, 1)], key=str)
    assert rows(spillover.coexpression(out, cells, markers)) == [("B", "T", 1.0, 0.5), ("T", "B", 1.0, 0.0), ("X", "B", 1.0, 0.0), ("X", "Y", 1.0, 1.0)]
    assert rows(spillover.spillover_removed(counts.limit(0), cells, markers, edges)) == []


def test_panel_warnings(spark):
    coverage = spark.createDataFrame([("T", "green", 5, 5), ("B", "amber", 2, 5), ("N", "red", 0, 4), ("M", "amber", 1, 2)], "label string, light string, n_present long, n_markers long")
    pairs = spark.createDataFrame([("T", "B"), ("B", "T"), (None, "T")], "a string, b string")
    cells = spark.createDataFrame([("T",), ("T",), ("B",), ("M",)], "label string")
    out = spillover.panel_warnings(coverage, pairs, cells, spark.createDataFrame([("M",)], "label string")).collect()
    assert [(r["kind"], r["label"], r["other"], r["n_present"], r["n_cells"]) for r in out] == [("confusable", "B", "T", None, 3), ("coverage", "B", None, 2, 1), ("coverage", "N", None, 0, 0)]
    assert out[1]["message"] == "B: the panel has 2 of its 5 markers, which makes the type uncertain"
