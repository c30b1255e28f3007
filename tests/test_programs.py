"""Gene programs and copy-number burden against NumPy."""

import numpy as np
import pytest

from tissueflow.operators import copynumber, programs


def planted(spark, cells=120, genes=40):
    """Two programs, of genes 0-9 and 10-19, in the even and the odd cells; the last cell has no counts."""
    rng = np.random.default_rng(6)
    rate = np.full((cells, genes), 0.5)
    for c in range(cells):
        rate[c, 10 * (c % 2) : 10 * (c % 2) + 10] = 7
    m = rng.poisson(rate).astype(float)
    m[-1] = 0
    counts = spark.createDataFrame([(c, g, v) for c, row in enumerate(m.tolist()) for g, v in enumerate(row) if v], "cell long, gene long, value double")
    return counts, spark.createDataFrame([(c,) for c in range(cells)], "cell long"), spark.createDataFrame([(g,) for g in range(genes)], "gene long"), m


def scaled(m):
    total = m.sum(axis=1)
    return np.log1p(m * np.median(total[total > 0]) / np.maximum(total, 1)[:, None])


@pytest.fixture(scope="module")
def found(spark):
    counts, cells, genes, m = planted(spark)
    return programs.discover(counts, cells, genes, k=3, rounds=12, tolerance=0), counts, cells, genes, m


def test_programs_fit_as_well_as_a_plain_loop(found):
    p, _, _, _, m = found
    x = scaled(m)
    x = x[:, x.var(axis=0) > 0]
    order = np.lexsort((np.arange(x.shape[1]), -np.round(np.log(x.var(axis=0, ddof=1) / x.mean(axis=0)), 9)))
    x = x[:, order]
    h = programs.first_loadings(x.mean(axis=0), 3, 0)
    for _ in range(12):
        w = programs.usages(x, h)
        h = programs.loadings_of(w.T @ x, w.T @ w, h)
    loss = ((x - w @ h) ** 2).sum()
    assert all(b <= a * (1 + 1e-9) for a, b in zip(p.losses, p.losses[1:], strict=False)) and abs(p.losses[-1] / loss - 1) < 0.01


def test_programs_find_what_is_planted(found):
    p = found[0]
    rows = {r.cell: r for r in p.usage.collect()}
    assert len(rows) == 120 and list(rows[119].usage) == [0.0] * 3 and rows[119].program == 0
    of = [{rows[c].program for c in range(s, 119, 2)} for s in (0, 1)]
    assert not of[0] & of[1]
    table = {r.program: r for r in p.table.collect()}
    assert sum(r.n_cells for r in table.values()) == 120
    for s in (0, 1):
        best = max(of[s], key=lambda k: sum(rows[c].program == k for c in range(s, 119, 2)))
        assert len(set(table[best].top_genes[:8]) & set(range(10 * s, 10 * s + 10))) >= 7


def test_smoothing_over_a_graph(spark, found):
    counts, cells, genes = found[1:4]
    edges = spark.createDataFrame([(0, 1), (0, 3), (2, 4)], "src long, dst long")
    plain = {r.cell: np.array(r.usage) for r in programs.discover(counts, cells, genes, k=3, rounds=2).usage.collect()}
    got = {r.cell: np.array(r.usage) for r in programs.discover(counts, cells, genes, k=3, rounds=2, edges=edges).usage.collect()}
    assert np.allclose(got[0], (plain[1] + plain[3]) / 2) and np.allclose(got[2], plain[4]) and not got[5].any()


def test_program_scores(spark, found):
    _, counts, cells, _, m = found
    sig = spark.createDataFrame([(0, g) for g in range(10)] + [(1, g) for g in range(10, 20)] + [(1, 99)], "program int, gene long")
    x = scaled(m)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    got = {(r.cell, r.program): r.score for r in programs.program_scores(counts, cells, sig).collect()}
    assert len(got) == 240
    assert all(abs(got[c, 0] - z[c, :10].mean()) < 1e-9 and abs(got[c, 1] - z[c, 10:20].sum() / 11) < 1e-9 for c in range(120))
    usage = spark.createDataFrame([(c, c % 2) for c in range(120)], "cell long, program int")
    r = {r.program: r for r in programs.program_specificity(programs.program_scores(counts, cells, sig), usage).collect()}
    assert abs(r[0].mean_in - z[::2, :10].mean()) < 1e-9 and r[0].specificity > 0.98 and r[1].specificity > 0.98


def test_signatures_and_names(spark):
    load = spark.createDataFrame([(0, "a", 2.0), (0, "b", 1.0), (0, "c", 0.0), (1, "a", 0.0), (1, "b", 0.0)], "program int, gene string, weight double")
    assert sorted(map(tuple, programs.signatures(load, 2).collect())) == [(0, "a"), (0, "b"), (1, "a"), (1, "b")]
    usage = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "cell long, program int")
    names = spark.createDataFrame([(0, " Cycle "), (1, " "), (2, None)], "program int, name string")
    assert sorted((r.cell, r.label) for r in programs.named_programs(usage, names).collect()) == [(1, "Cycle"), (2, "Program 1"), (3, "Program 2")]


def test_normal_cells(spark):
    rows = [(i, "T cell", 0.9 if i < 25 else 0.1) for i in range(40)] + [(i, "Malignant x", 0.9) for i in range(40, 80)] + [(i, "Rare", 1.0) for i in range(80, 85)] + [(99, None, None)]
    cells = spark.createDataFrame(rows, "cell long, label string, pmp double")
    ok = lambda df: sorted(r.cell for r in df.filter("normal").collect())
    assert ok(copynumber.normal_cells(cells)) == list(range(40))
    assert ok(copynumber.normal_cells(cells, purity=0.5, enough=25)) == list(range(25)) and ok(copynumber.normal_cells(cells, purity=0.5, enough=26)) == list(range(40))
    assert ok(copynumber.normal_cells(cells, ["Rare"])) == [] and copynumber.normal_cells(cells).count() == 86


def test_burden_equals_a_plain_loop(spark):
    rng = np.random.default_rng(8)
    n, g = 60, 130
    rate = np.full((n, g), 2.0)
    rate[40:, 10:60] = 6  # a gain of the last twenty cells
    m = rng.poisson(rate).astype(float)
    m[59] = 0
    chrom = ["1" if j < 100 else "2" for j in range(g)]
    start = rng.permutation(g)
    edges = [(c, int(o)) for c in range(59) for o in rng.choice([x for x in range(59) if (x >= 40) == (c >= 40)], 5, False)]
    got = {r.cell: r for r in copynumber.burden(
        spark.createDataFrame([(c, j, float(m[c, j])) for c in range(n) for j in range(g) if m[c, j]] + [(1, 999, 5.0)], "cell long, gene long, value double"),
        spark.createDataFrame([(c, c < 40) for c in range(n)], "cell long, normal boolean"),
        spark.createDataFrame([(j, chrom[j], int(start[j])) for j in range(g)] + [(5, "X", 3), (7, None, 1)], "gene long, chromosome string, start long"),
        spark.createDataFrame(edges, "src long, dst long"), window=40, step=10).collect()}
    scale = lambda x: x * np.median(x.sum(axis=1)[x.sum(axis=1) > 0]) / np.where(x.sum(axis=1) > 0, x.sum(axis=1), 1)[:, None]
    x = scale(m)
    s = x.copy()
    for c in range(59):
        s[c] = np.mean([x[o] for a, o in edges if a == c], axis=0)
    x = np.log1p(scale(s))
    x = x - x[:40].mean(axis=0)
    w = []
    for k in "12":
        at = sorted((j for j in range(g) if chrom[j] == k), key=lambda j: start[j])
        width = min(40, len(at))
        w += [x[:59][:, at[b : b + width]].mean(axis=1) for b in range(0, max(len(at) - 40, 0) + 1, 10)]
    w = np.array(w).T
    w = np.where(np.abs(w) < 1.5 * w.std(), 0, w)
    expected = np.sqrt((w * w).mean(axis=1))
    assert all(abs(got[c].burden - expected[c]) < 1e-9 for c in range(59)) and (got[59].burden, got[59].malignant) == (None, False)
    bar = np.quantile(expected[:40], 0.95)
    assert [got[c].malignant for c in range(59)] == (expected > bar).tolist() and sum(got[c].malignant for c in range(40, 59)) == 19
    with pytest.raises(ValueError, match="position"):
        copynumber.burden(spark.createDataFrame([(1, 1, 1.0)], "cell long, gene long, value double"), spark.createDataFrame([(1, True)], "cell long, normal boolean"), spark.createDataFrame([(1, "1", 1)], "gene long, chromosome string, start long"), spark.createDataFrame([], "src long, dst long"))


def test_windows_are_numbered_without_making_empty_ones(spark):
    w = copynumber.Windows(np.array([3, 45, 20]), 20, 10)
    assert w.number.tolist() == [1, 3, 1] and w.widths.tolist() == [3, 20, 20, 20, 20]
    for c, size, begin in ((0, 3, [1]), (1, 45, [1, 11, 21]), (2, 20, [1])):
        for p in range(1, size + 1):
            at, window = w.of(np.array([(c << 32) + p]))
            first = [0, 1, 4][c]
            assert window.tolist() == [first + i for i, b in enumerate(begin) if b <= p < b + 20] and not at.any()
