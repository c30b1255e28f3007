"""Signal quality on hand-worked tables."""

import math

import pytest

from tissueflow.operators import signal


def tables(spark):
    genes = spark.createDataFrame([(f"g{i}", False) for i in range(4)] + [("n0", True), ("n1", True)], "gene string, control boolean")
    counts = spark.createDataFrame([("1", "g0", 8), ("2", "g0", 2), ("2", "g1", 2), ("2", "n0", 4), ("3", "n1", 2), ("1", "other", 50), (None, "g0", 9), ("1", "g1", None)], "cell string, gene string, value long")
    cells = spark.createDataFrame([("1", 4.0), ("2", 0.0), ("3", None), ("4", 2.0), (None, 1.0), ("1", 5.0)], "cell string, area double")
    return counts, cells, genes


def test_cell_signal_by_hand(spark):
    counts, cells, genes = tables(spark)
    got = {r.cell: r for r in signal.cell_signal(counts, cells, genes).collect()}
    assert set(got) == {"1", "2", "3", "4"}
    assert got["1"].mean_ratio == pytest.approx(math.log2(2.01 / 0.01)) and got["1"].max_ratio == pytest.approx(math.log2(8.01 / 0.01))
    assert (got["1"].entropy, got["2"].entropy, got["3"].entropy) == (0.0, pytest.approx(1.0), None)
    assert got["2"].mean_ratio == pytest.approx(math.log2(1.01 / 2.01)) and got["2"].sparsity == 0.5
    assert (got["1"].density, got["2"].density, got["3"].density, got["4"].density) == (2.0, None, None, 0.0)
    assert got["4"].mean_ratio == 0 and got["4"].sparsity == 1
    row = signal.signal_summary(signal.cell_signal(counts, cells, genes)).first()
    assert row.n_cells == 4 and row.zero_fraction == pytest.approx((0.75 + 0.5 + 1 + 1) / 4)


def test_signal_without_controls_or_rows(spark):
    counts, cells, genes = tables(spark)
    assert {r.mean_ratio for r in signal.cell_signal(counts, cells, genes.filter("NOT control")).collect()} == {None}
    assert signal.cell_signal(counts.limit(0), cells.limit(0), genes.limit(0)).isEmpty()
    assert {r.density for r in signal.cell_signal(counts, cells.drop("area"), genes.limit(0)).collect()} == {None}


def test_spatial_signal(spark):
    genes = tables(spark)[2]
    moran = spark.createDataFrame([("g0", 0.5), ("g1", 0.3), ("g2", 0.0), ("g3", None), ("n0", 0.0), ("n1", 0.1), ("other", 9.0)], "gene string, moran double")
    r = signal.spatial_signal(moran, genes).first()
    assert (r.n_genes, r.n_controls, r.median_gene, r.median_control) == (3, 2, 0.3, 0.05)
    assert r.share_above == pytest.approx(2 / 3) and r.separation == pytest.approx(0.25)
    bare = signal.spatial_signal(moran, genes.filter("NOT control")).first()
    assert bare.n_controls == 0 and bare.median_control is None and bare.share_above is None and bare.median_gene == 0.3
