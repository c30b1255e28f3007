"""Two layers of counts, malignant callers and merged markers, on hand-worked tables."""

import math

import pytest

from tissueflow.operators import layers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def tables(spark):
    k = spark.createDataFrame([("1", "a", 6, 6), ("1", "b", 4, 0), ("2", "b", 5, 5), ("2", "a", 5, 2), ("3", "x", 1, 1)], "cell string, gene string, before long, after long")
    cells = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", None), ("4", "B")], "cell string, label string")
    markers = spark.createDataFrame([("A", "a"), ("B", "b"), ("B", "absent"), ("C", "x"), (None, "a")], "label string, gene string")
    return k, cells, markers


def test_layer_quality_by_hand(spark):
    k, cells, markers = tables(spark)
    got = {r.label: r for r in layers.layer_quality(k, cells, markers).collect()}
    assert set(got) == {"A", "B"}
    a, b = got["A"], got["B"]
    log = lambda share: math.log1p(1e4 * share)
    assert a.specificity_before == pytest.approx(log(0.6) / (log(0.6) + log(0.5) / 3))
    assert a.specificity_after == pytest.approx(log(1.0) / (log(1.0) + log(2 / 7) / 3))
    assert b.specificity_after == pytest.approx(1.0)  # cell 1 has no b left
    assert (a.purity_before, a.purity_after, a.retention) == (0.6, 1.0, 1.0)
    assert (b.n, b.purity_before, b.purity_after, b.retention) == (2, 0.25, pytest.approx(5 / 14), 1.0)


def test_layers_odd_rows(spark):
    k, cells, markers = tables(spark)
    clean = rows(layers.layer_quality(k, cells, markers))
    odd = k.union(spark.createDataFrame([(None, "a", 9, 9), ("1", None, 9, 9), ("1", "a", None, None)], k.schema))
    assert rows(layers.layer_quality(odd, cells.union(cells), markers.union(markers))) == clean
    assert layers.layer_quality(k.limit(0), cells.limit(0), markers).isEmpty()
    one = layers.layer_quality(k, cells.filter("cell = '1'"), markers).first()
    assert one.specificity_before is None and one.purity_before == 0.6
    assert tuple(layers.layer_change(k).first()) == (10.0, 6.0, 2.0, 1.0)
    assert tuple(layers.layer_change(k.limit(0)).first()) == (None,) * 4


def test_callers_and_gate(spark):
    calls = spark.createDataFrame([("1", "m", True), ("2", "m", False), ("3", "m", True), ("1", "n", True), ("2", "n", True), ("3", "n", None), (None, "n", True)], "cell string, caller string, malignant boolean")
    assert rows(layers.caller_concordance(calls)) == [("m", "n", 2, 0.5)]
    assert rows(layers.caller_shares(calls, 4)) == [("m", 3, pytest.approx(2 / 3), 0.75), ("n", 2, 1.0, 0.5)]
    assert layers.caller_concordance(calls.limit(0)).isEmpty()
    told = spark.createDataFrame([("s", "melanoma", None), ("t", "melanoma", False), ("u", "healthy lung", True), ("v", None, None)], "section string, tissue string, told boolean")
    assert {(r.section, r.run, r.gate) for r in layers.malignant_gate(told).collect()} == {("s", True, "tissue"), ("t", False, "explicit"), ("u", True, "explicit"), ("v", False, "tissue")}


def test_merged_markers_keep_order_and_first_spelling(spark):
    kind = "type string, gene string, place int"
    curated = spark.createDataFrame([("T cell", "CD3E", 1), ("T cell", "CD3D", 2), ("Other", "X", 1)], kind)
    corpus = spark.createDataFrame([("t cell", "TRAC", 1), ("T CELL", "cd3e", 2), ("B", "MS4A1", 1), ("B", None, 2), (None, "Y", 1)], kind)
    wanted = spark.createDataFrame([("T cell",), ("B",), ("Bare",), (None,)], "type string")
    assert rows(layers.merged_markers(curated, corpus, wanted)) == [("B", "MS4A1", 1, "corpus"), ("T cell", "CD3D", 2, "curated"), ("T cell", "CD3E", 1, "curated"), ("T cell", "TRAC", 3, "corpus")]
