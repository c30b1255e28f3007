"""Whitening, hard negatives and the parity join against brute force, on the smallest tables and on odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissueflow.llm import hard_negatives, parity_join, whitening
from tissueflow.llm.simhash import shingle_hashes

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, component int, score long, slot string, root long"


def odd_vectors(spark, seed=1):
    """Nulls, odd lengths, not finite and huge entries, ties, repeated rows and ids, and clashing names."""
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.integers(-8, 9, 6) / 8], int(rng.integers(3)), 7, 7, "x", 7) for i in range(60)]
    good = [0.5] * 6
    rows += [(100, None, 1), (101, [0.5] * 5 + [None], 1), (102, [0.5] * 5 + [math.nan], 0), (103, [0.5] * 5 + [math.inf], 0), (104, good[:5], 1), (105, [], 1), (106, [1e30] * 6, 1), (None, good, 1), (107, good, None), (None, None, None), (20, good, 2), rows[7][:3], rows[7][:3], (108, good, 0), (109, good, 0)]
    return spark.createDataFrame([(*r, 7, 7, "x", 7)[:7] for r in rows], VECTORS).repartition(3)


def plain(rows, scale):
    return [(r.vec_id, r.label, [math.floor(scale * x) for x in r.embedding]) for r in rows if r.embedding is not None and len(r.embedding) == 6 and all(x is not None and abs(x) < 1 << 18 for x in r.embedding)]


def check_whitening(rows, got, top):
    x = np.array([v for _, _, v in rows], np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    e, v = np.linalg.eigh(np.cov(x.T, bias=True))
    e, v = e[::-1], v[:, ::-1]
    top = min(top, int((e > 1e-13 * e[0]).sum()))
    assert len(got) == n * top
    by = {}
    for r in got:
        assert r.n == n and abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9 and r.identity_error < 1e-9
        by.setdefault(r.component, []).append((r.vec_id, r.deviation, r.whitened))
    for k, items in by.items():
        w = (x - s / n) @ v[:, k - 1] / np.sqrt(e[k - 1])
        expected = [(i, sum((n * int(y) - int(t)) ** 2 for y, t in zip(row, s, strict=True)), z) for (i, _, _), row, z in zip(rows, x.tolist(), w, strict=True)]
        assert any(np.allclose(*(np.array(sorted((str(i), d, round(g * z, 6)) for i, d, z in part))[:, 2].astype(float) for part, g in ((items, 1), (expected, sign))), atol=1e-5) for sign in (1, -1))
        assert sorted((str(i), d) for i, d, _ in items) == sorted((str(i), d) for i, d, _ in expected)


def test_whitening(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.label, [math.floor(64 * x) for x in r.embedding]) for r in df.collect()]
    check_whitening(rows, whitening.whitening_query(spark, SMALL).collect(), 32)


def test_whitening_on_odd_rows(spark):
    df = odd_vectors(spark)
    check_whitening(plain(df.collect(), 64), whitening.whitened(df).collect(), 32)
    assert whitening.whitened(df.filter("false")).count() == 0
    assert whitening.whitened(df.filter("vec_id = 108")).count() == 0
    assert whitening.whitened(df).columns[:2] == ["vec_id", "component"]


def test_whitening_of_flat_and_ill_conditioned_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-9, 10, (80, 3))
    x = np.concatenate([base * 4000, base[:, :1] * 4000 + rng.integers(-1, 2, (80, 1)), np.ones((80, 1)), base[:, 1:2] - base[:, :1]], axis=1) / 64.0
    df = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    check_whitening(plain(df.collect(), 64), whitening.whitened(df).collect(), 32)


def test_whitening_of_large_deviations(spark):
    df = spark.createDataFrame([(i, [float((i % 5) * 50_000), float(i)], 0) for i in range(3000)], "vec_id long, embedding array<double>, label int")
    x = np.array([[(i % 5) * 50_000 * 64, i * 64] for i in range(3000)], object)
    s = x.sum(axis=0)
    got = {r.vec_id: r.deviation for r in whitening.whitened(df, top=1).collect()}
    assert got == {i: d if d < 1 << 63 else None for i, d in enumerate((3000 * a - s[0]) ** 2 + (3000 * b - s[1]) ** 2 for a, b in x.tolist())}


@pytest.mark.parametrize("shape", [(1, 1, 1), (64, 64, 64), (33, 65, 70), (100, 7, 3), (130, 200, 129)])
def test_strassen(shape):
    rng = np.random.default_rng(3)
    m, k, n = shape
    for size in (9, 1 << 28):
        a, b = rng.integers(-size, size, (m, k)), rng.integers(-size, size, (k, n))
        assert (hard_negatives.strassen(a, b, 8) == a @ b).all()


def brute_negatives(rows, is_anchor):
    out = []
    for i, label, v in sorted({r[0]: r for r in sorted(((i, k, tuple(v)) for i, k, v in rows if is_anchor(i)), reverse=True)}.values()):
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, k) for j, k, w in rows if j != i)
        for p, j, _ in [x for x in scored if x[2] == label][:5]:
            fit = [x for x in scored if x[2] != label and 80 * -p <= 100 * -x[0] <= 100 * -p][:5]
            out += [(i, j, at + 1, x[1], -p, -x[0]) for at, x in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 3])
def test_hard_negatives_on_odd_rows(spark, block):
    df = odd_vectors(spark)
    rows = [(i, k, v) for i, k, v in plain(df.collect(), 256) if i is not None and k is not None]
    expected = brute_negatives(rows, lambda i: i % 4 == 0)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 4 == 0, block=block)
    assert len(expected) > 50 and sorted(map(tuple, got.collect())) == expected
    assert hard_negatives.hard_negatives(df.filter("false"), F.col("vec_id") % 4 == 0).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


def test_hard_negatives_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    df = hard_negatives.hard_negatives_query(spark, SMALL)
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({hard_negatives.HARD_NEGATIVES_SQL}) t").fetchall()
    assert len(expected) > 20 and sorted(expected) == sorted(map(tuple, df.collect()))


def brute_components(rows):
    """``(id, size, component)`` by comparing all pairs of sets; rows without an id link nothing."""
    sets = [set(shingle_hashes((t or "").encode(), 5).tolist()) for _, t in rows]
    linked = [[j for j, b in enumerate(sets) if i == j or (a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b))] for i, a in enumerate(sets)]
    root = list(range(len(rows)))
    while (new := [min(root[j] for j in n) for n in linked]) != root:
        root = new
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min((x for x in (d, least.get(r)) if x is not None), default=None)
    return sorted(((d, len(s), least[r]) for (d, _), s, r in zip(rows, sets, root, strict=True)), key=str)


@pytest.fixture(params=["docs", "odd", "none"])
def documents(request):
    return request.getfixturevalue(request.param)


def test_parity_join(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = parity_join.similar_components(documents)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows)


@pytest.mark.parametrize("groups, copies, words, changed", [(60, 12, 300, (3, 9)), (2, 170, 300, (4, 10)), (60, 6, 9, (0, 2))])
def test_parity_join_near_the_limit(spark, groups, copies, words, changed):
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 5000, words)]
        for _ in range(copies):
            copy = list(base)
            for at in rng.integers(0, words, rng.integers(*changed)):
                copy[at] = f"new{rng.integers(1 << 30)}"
            rows.append(" ".join(copy[: len(copy) - int(rng.integers(0, 1 + words // 9))]))
    rows = list(enumerate(rows))
    got = parity_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows)


def test_parity_bounds():
    """Equal segments and differing bits keep the bounds that the join rests on, for pairs of all sizes at the limit."""
    rng = np.random.default_rng(5)
    for n in [4, 5, 6, 9, 10, 15, 16, 31, 40, 63, 64, 100, 127, 128, 300, 1000]:
        for _ in range(30):
            both = rng.integers(1 << 63, size=-(-n * 4 // 5)).astype(np.uint64)
            rest = rng.integers(1 << 63, size=n).astype(np.uint64)
            cut = rng.integers(0, n - len(both) + 1)
            a, b = np.unique(np.concatenate([both, rest[:cut]])), np.unique(np.concatenate([both, rest[cut : n - len(both)]]))
            if len(np.intersect1d(a, b)) * 5 < 4 * len(np.union1d(a, b)) or (a.tolist() == b.tolist()):
                continue
            band = parity_join.band_of(max(len(a), len(b)))
            dealt = [{i >> 6: (d, set(ks.tolist())) for i, d, ks in parity_join.postings(s) if i & 63 == band} for s in (a, b)]
            differ = parity_join.budget(len(a), len(b))
            common = [deal for deal in dealt[0].keys() & dealt[1].keys() if max(len(x[deal][1]) for x in dealt) > differ]
            assert common and all(x[deal][0] >= differ for x in dealt for deal in common)
            assert all(len(dealt[0][deal][1] & dealt[1][deal][1]) >= max(len(x[deal][1]) for x in dealt) - differ for deal in common)
            x, y = (parity_join.bit_sketch(s).view(np.uint32) for s in (a, b))
            sparse = max(len(a), len(b)) <= parity_join.SPARSE
            if not sparse:
                x, y = (v if len(s) > parity_join.SPARSE else parity_join._folded(v) for v, s in ((x, a), (y, b)))
            assert parity_join.distances([x], [y], sparse)[0, 0] <= len(np.setxor1d(a, b)) <= differ
