"""Label transfer and deconvolution against NumPy on planted sections."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissueflow.operators import transfer

TYPES, GENES = "ABC", 18


def section(spark, cells=60, seed=2, mixed=0):
    """Cells of three types with six genes each; every ``mixed``-th cell is a mixture of its type and the next one."""
    rng = np.random.default_rng(seed)
    rate = np.full((cells, GENES), 0.5)
    for c in range(cells):
        rate[c, 6 * (c % 3) : 6 * (c % 3) + 6] = 8
        if mixed and c % mixed == 0:
            k = (c + 1) % 3
            rate[c, 6 * k : 6 * k + 6] = 8
    m = rng.poisson(rate).astype(float)
    counts = spark.createDataFrame([(c, g, v) for c, row in enumerate(m.tolist()) for g, v in enumerate(row) if v], "cell long, gene long, value double")
    return counts, spark.createDataFrame([(c, TYPES[c % 3]) for c in range(cells)], "cell long, label string"), m


def shares(m):
    return m / np.maximum(m.sum(axis=1, keepdims=True), 1)


def mean_profiles(m):
    p = np.array([shares(m)[np.arange(len(m)) % 3 == t].mean(axis=0) for t in range(3)])
    return p / p.sum(axis=1, keepdims=True)


@pytest.fixture(scope="module")
def reference(spark):
    counts, cells, m = section(spark, 90, seed=9)
    return counts, cells, transfer.profiles(counts, cells).cache(), mean_profiles(m)


def test_profiles(reference):
    p = np.zeros((3, GENES))
    for r in reference[2].collect():
        p[TYPES.index(r.type), r.gene] = r.share
    assert np.allclose(p, reference[3]) and np.allclose(p.sum(axis=1), 1)


@pytest.mark.parametrize("prior", [None, {"A": 0.6, "B": 0.3, "C": 0.1}])
def test_transport_equals_a_plain_loop(spark, reference, prior):
    counts, _, m = section(spark)
    told = spark.createDataFrame(list(prior.items()), "type string, prior double") if prior else None
    got = {r.cell: r for r in transfer.transport(transfer.similarity(counts, reference[2]), told, 8.0).collect()}
    k = np.exp(8.0 * (np.sqrt(shares(m)) @ np.sqrt(reference[3]).T - 1))
    want, v = np.array(list(prior.values()) if prior else [1 / 3] * 3), np.ones(3)
    for _ in range(3000):
        u = 1 / (len(m) * (k @ v))
        v = want / (k.T @ u)
    plan = k * v * (1 / (len(m) * (k @ v)))[:, None]
    mine = np.array([[got[c].weights[t] for t in TYPES] for c in range(len(m))])
    assert np.allclose(mine, plan / plan.sum(axis=1, keepdims=True), atol=1e-6)
    assert np.allclose(mine.mean(axis=0), want, atol=1e-6) and np.allclose(mine.sum(axis=1), 1)
    p = mine[0]
    assert abs(got[0].entropy + (p * np.log(p)).sum() / np.log(3)) < 1e-9 and got[0].confidence == p.max()
    sharp = {r.cell: r for r in transfer.transport(transfer.similarity(counts, reference[2]), told).collect()}
    assert np.allclose(np.mean([[r.weights[t] for t in TYPES] for r in sharp.values()], axis=0), want, atol=1e-8)
    if not prior:
        assert [got[c].label for c in range(len(m))] == [TYPES[c % 3] for c in range(len(m))]


def test_transport_of_odd_rows(spark, reference):
    odd = spark.createDataFrame([(1, 99, 5.0), (2, 0, 0.0), (3, 0, 4.0), (3, 0, 4.0)], "cell long, gene long, value double")
    assert [r.cell for r in transfer.transport(transfer.similarity(odd, reference[2])).collect()] == [3]
    assert transfer.transport(transfer.similarity(odd.limit(0), reference[2])).count() == 0


def test_doublets_equal_brute_force(spark, reference):
    counts, _, m = section(spark, mixed=4)
    got = {r.cell: r for r in transfer.doublets(counts, reference[2]).collect()}
    y, p = shares(m), reference[3]
    for c in range(len(m)):
        solo = [(round(float(y[c] @ y[c] - (y[c] @ p[t]) ** 2 / (p[t] @ p[t])), 12), t) for t in range(3)]
        pairs = []
        for a, b in itertools.combinations(range(3), 2):
            w = np.linalg.lstsq(p[[a, b]].T, y[c], rcond=None)[0]
            if (w > 0).all():
                pairs.append((float(((y[c] - w @ p[[a, b]]) ** 2).sum()), a, b, w))
        single, t = min(solo)
        r, a, b, w = min(pairs, key=lambda x: x[:3], default=(np.inf, 0, 0, np.array([1.0, 0.0])))
        first, other = (a, b) if w[0] >= w[1] else (b, a)
        share = w.max() / w.sum()
        pair = 1 - share >= transfer.SECOND_SHARE and single - r >= transfer.GAIN * single
        assert got[c]["class"] == ("doublet" if pair else "singlet") and abs(got[c].single_residual - single) < 1e-9
        assert (got[c].first_type, got[c].second_type) == ((TYPES[first], TYPES[other]) if pair else (TYPES[t], None))
        assert abs(got[c].first_share - (share if pair else 1)) < 1e-6
    assert np.mean([(got[c]["class"] == "doublet") == (c % 4 == 0) for c in got]) > 0.9


def test_doublets_of_odd_rows(spark, reference):
    rows = [(1, 0, 3.0), (1, 0, 3.0), (2, 50, 9.0), (3, 2, 0.0), (4, 7, 1.0)]
    odd = spark.createDataFrame(rows, "cell long, gene long, value double")
    extra = reference[2].union(spark.createDataFrame([("D", 50, 1.0)], "type string, gene long, share double")).filter("NOT (type = 'D') OR gene = 50")
    got = {r.cell: (r["class"], r.first_type) for r in transfer.doublets(odd, extra).collect()}
    assert got == {1: ("singlet", "A"), 2: ("singlet", "D"), 4: ("singlet", "B")}
    assert transfer.doublets(odd.limit(0), extra).count() == 0


def test_purified(spark, reference):
    counts, _, m = section(spark, mixed=4)
    weights = transfer.doublet_weights(transfer.doublets(counts, reference[2])).cache()
    w = np.zeros((len(m), 3))
    for r in weights.collect():
        w[r.cell, TYPES.index(r.type)] = r.weight
    part = w[:, :, None] * reference[3]
    expected = m * part[np.arange(len(m)), w.argmax(axis=1)] / part.sum(axis=1)
    pure = transfer.purified(counts, weights, reference[2]).cache()
    mine = np.zeros_like(m)
    for r in pure.collect():
        mine[r.cell, r.gene] = r.purified
    assert np.allclose(mine, expected)
    s = transfer.purity_change(pure).first()
    assert (s.n_cells, s.median_before) == (60, np.median(m.sum(axis=1))) and abs(s.median_after - np.median(expected.sum(axis=1))) < 1e-9 and abs(s.removed - (1 - expected.sum() / m.sum())) < 1e-9
    none = transfer.purified(counts, weights.limit(0), reference[2])
    assert none.filter("purified <> value").isEmpty()


def test_rank_correlation_equals_full_ranks(spark, reference):
    counts, _, m = section(spark)
    got = {r.cell: r for r in transfer.rank_correlation(counts, reference[2]).collect()}
    ranks = lambda x: np.array([((x < v).sum() + (x <= v).sum() + 1) / 2 for v in x])
    p = [ranks(np.round(x, 12)) for x in reference[3]]
    for c in range(len(m)):
        rho = np.array([np.corrcoef(ranks(m[c]), q)[0, 1] for q in p])
        top = np.sort(rho)[::-1]
        assert got[c].label == TYPES[rho.argmax()] and abs(got[c].correlation - top[0]) < 1e-8 and abs(got[c].delta - (top[0] - top[1])) < 1e-8
    flat = spark.createDataFrame([(1, g, 2.0) for g in range(GENES)] + [(2, 99, 1.0)], "cell long, gene long, value double")
    assert transfer.rank_correlation(flat, reference[2]).count() == 0


def test_classifier_transfer(spark, reference):
    counts, _, m = section(spark)
    blank = spark.createDataFrame([(500, 3, 0.0)], "cell long, gene long, value double")
    lone = reference[1].union(spark.createDataFrame([(7000, "lonely"), (7001, None)], "cell long, label string"))
    got = {r.cell: r for r in transfer.classifier_transfer(counts.union(blank), reference[0], lone).collect()}
    assert len(got) == 61 and np.mean([got[c].label == TYPES[c % 3] for c in range(60)]) == 1
    assert all(0 < r.probability <= 1 for r in got.values()) and got[500].probability < 0.7
    with pytest.raises(ValueError, match="shared genes"):
        transfer.classifier_transfer(counts.filter("gene < 4"), reference[0], reference[1])
    with pytest.raises(ValueError, match="two labels"):
        transfer.classifier_transfer(counts, reference[0], reference[1].filter(F.col("label") == "A"))


def test_fit_keeps_no_table_of_genes_on_the_driver(spark, reference):
    counts, _, _ = section(spark)
    wide = counts.union(counts.select("cell", (F.col("gene") + 1000).alias("gene"), "value"))
    ref = reference[0].union(reference[0].select("cell", (F.col("gene") + 1000).alias("gene"), "value"))
    many = spark.range(200_000).select(F.lit(99_999).cast("long").alias("cell"), (F.col("id") + 10_000).alias("gene"), F.lit(1.0).alias("value"))
    got = {r.cell: r.label for r in transfer.classifier_transfer(wide.union(many), ref.union(many), reference[1]).collect()}
    assert np.mean([got[c] == TYPES[c % 3] for c in range(60)]) == 1


def test_logistic_fit_is_the_optimum():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 6)), rng.integers(0, 3, 40)
    x = x - x.mean(axis=0)
    fit = transfer._logistic(lambda a: x @ (x.T @ (a - a.mean(axis=0))), y, 3, 200, 0.05, tolerance=1e-12)
    w, m = x.T @ fit.a, fit.ga + fit.b
    p = np.exp(m) / np.exp(m).sum(axis=1, keepdims=True)
    assert np.allclose(x @ w, fit.ga, atol=1e-9) and np.abs(x.T @ (p - np.eye(3)[y]) / 40 + 0.05 * w).max() < 1e-4
