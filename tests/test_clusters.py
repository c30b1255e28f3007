"""Neighbours of vectors, communities, clusters of cells, and thinning: against brute force, plain loops and planted groups."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissueflow.operators import clusters, embedding, graph, thinning

EMBEDDINGS = "/root/testdata/sf0.01/embeddings.parquet"


def brute_neighbours(rows, k):
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    out = {}
    for i, v in zip(ids.tolist(), x, strict=True):
        d = np.round(np.sqrt(((x - v) ** 2).sum(axis=1)), 9)
        out[i] = [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def neighbours_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.src, []).append((round(r.d, 9), r.dst))
    return {i: [j for _, j in sorted(v)] for i, v in out.items()}


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(EMBEDDINGS).select(F.col("vec_id").alias("item"), "embedding", "label")


def test_nearest_vectors(vectors):
    expected = brute_neighbours([(r.item, r.embedding) for r in vectors.collect()], 15)
    assert neighbours_of(graph.nearest_vectors(vectors)) == expected
    some = neighbours_of(graph.nearest_vectors(vectors, lists=16))
    assert np.mean([len(set(some[i]) & set(expected[i])) / 15 for i in expected]) >= 0.95


def test_vectors_without_clusters_lose_no_neighbour(spark, monkeypatch):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(3).normal(size=(1500, 24)))]
    df = spark.createDataFrame(rows, "item long, embedding array<float>")
    expected = brute_neighbours([(i, np.float32(v)) for i, v in rows], 15)
    assert neighbours_of(graph.nearest_vectors(df)) == expected
    assert neighbours_of(graph.nearest_vectors(df, lists=1)) == expected
    monkeypatch.setattr(graph, "BLOCK", 400)  # lists are tried, but need more than all by blocks
    monkeypatch.setattr(graph, "LIST", 30)
    assert neighbours_of(graph.nearest_vectors(df)) == expected


def test_neighbours_are_exact_beyond_a_block(spark, monkeypatch):
    """Clustered vectors, more than a block: looking through some lists only would lose neighbours at the clusters' edges."""
    monkeypatch.setattr(graph, "BLOCK", 100)
    monkeypatch.setattr(graph, "LIST", 60)
    rng = np.random.default_rng(5)
    rows = [(i, (10 * np.eye(8)[i % 8] * (i % 16 < 8) + rng.normal(0, 1.8, 8)).tolist()) for i in range(1600)]
    df = spark.createDataFrame(rows, "item long, embedding array<float>")
    expected = brute_neighbours([(i, np.float32(v)) for i, v in rows], 15)
    some = neighbours_of(graph.nearest_vectors(df, lists=0))
    assert 0.9 <= np.mean([len(set(some[i]) & set(expected[i])) / 15 for i in expected]) < 1
    assert neighbours_of(graph.nearest_vectors(df)) == expected


def test_nearest_vectors_of_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELL", 7)  # many cells to a list
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(0, 3, 3)]) for i in range(120)] + [(i, [9.0, 9.0, 9.0]) for i in range(200, 240)]
    odd = [(300, None), (301, [1.0, None, 2.0]), (None, [0.0, 0.0, 0.0]), (302, []), (303, [math.nan, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "item long, embedding array<double>, node string").repartition(3)
    assert neighbours_of(graph.nearest_vectors(df, 4)) == brute_neighbours(rows, 4)
    assert graph.nearest_vectors(df.limit(0)).count() == 0 and graph.nearest_vectors(df.filter("item = 200")).count() == 0
    assert neighbours_of(graph.nearest_vectors(df.filter("item IN (1, 2, 200)"), 4)) == brute_neighbours([r for r in rows if r[0] in (1, 2, 200)], 4)


def plain_modularity(w, c, resolution):
    k, total = w.sum(axis=1), w.sum()
    same = c[:, None] == c
    return (w[same].sum() - resolution * (np.outer(k, k)[same].sum()) / total) / total


def plain_communities(w, resolution):
    """One node after another, level by level."""
    member = np.arange(len(w))
    while True:
        k, total, c = w.sum(axis=1), w.sum(), np.arange(len(w))
        moved = True
        while moved:
            moved = False
            for i in range(len(w)):
                sums = np.bincount(c, k, len(w)) - np.where(np.arange(len(w)) == c[i], k[i], 0)
                ties = np.bincount(c, np.where(np.arange(len(w)) == i, 0, w[i]), len(w))
                gain = np.round(ties - resolution * k[i] * sums / total, 9)
                if gain.max() > gain[c[i]]:
                    c[i], moved = int(gain.argmax()), True
        names, c = np.unique(c, return_inverse=True)
        member = c[member]
        if len(names) == len(w):
            return member
        one = np.eye(len(names))[c]
        w = one.T @ w @ one


@pytest.mark.parametrize("resolution", [0.5, 1.0])
def test_communities_gain_what_a_plain_loop_gains(spark, vectors, resolution):
    items = vectors.filter("item < 250")
    edges = graph.symmetric(graph.nearest_vectors(items)).cache()
    member = graph.communities(edges, resolution).cache()
    q = graph.modularity(edges, member, resolution).first()
    w = np.zeros((250, 250))
    for r in edges.collect():
        w[r.a, r.b] = r.w
    c = np.array([m for _, m in sorted((r.node, r.community) for r in member.collect())])
    assert len(c) == 250 and abs(plain_modularity(w, c, resolution) - q.modularity) < 1e-9 and q.n_communities == len(set(c.tolist()))
    assert q.modularity >= 0.98 * plain_modularity(w, plain_communities(w, resolution), resolution)
    sizes = [r["count"] for r in graph.relabelled(member).groupBy("cluster").count().orderBy("cluster").collect()]
    assert sizes == sorted(sizes, reverse=True) and sum(sizes) == 250


def test_communities_of_cliques(spark):
    rows = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "abc" for i in range(6) for j in range(6) if i != j] + [("a0", "b0", 1.0), ("b0", "a0", 1.0), (None, "a1", 1.0), ("a1", "a2", None)]
    got = graph.communities(spark.createDataFrame(rows, "a string, b string, w double")).collect()
    assert {frozenset(r.node for r in got if r.community == c) for c in {r.community for r in got}} == {frozenset(f"{g}{i}" for i in range(6)) for g in "abc"}
    assert graph.communities(spark.createDataFrame([], "a string, b string, w double")).count() == 0


def planted(spark, cells=90, genes=60):
    """Three types, each with ten genes of its own; the last cell has no counts."""
    rng = np.random.default_rng(4)
    rate = np.full((cells, genes), 0.4)
    for c in range(cells):
        rate[c, 10 * (c % 3) : 10 * (c % 3) + 10] = 6
    m = rng.poisson(rate)
    counts = [(c, g, float(m[c, g])) for c in range(cells - 1) for g in range(genes) if m[c, g]]
    c = spark.createDataFrame([(i, "ABC"[i % 3], None) for i in range(cells)], "cell long, label string, subtype string")
    g = spark.createDataFrame([(i, "ABC"[i // 10] if i < 30 else "rest", i >= 55) for i in range(genes)], "gene long, marker_set string, control boolean")
    return spark.createDataFrame(counts, "cell long, gene long, value double"), c, g, m


def test_cell_vectors_equal_principal_components(spark):
    counts, cells, genes, m = planted(spark)
    got = {r.item: r.embedding for r in embedding.cell_vectors(counts, cells, genes, k=4).collect()}
    m = m.astype(float)
    m[-1] = 0
    total = m.sum(axis=1)
    x = np.log1p(m * np.median(total[:-1]) / np.maximum(total, 1)[:, None])
    x -= x.mean(axis=0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    mine = np.array([got[i] for i in range(len(m))])
    for a in range(2):  # the two axes that the types span are well apart from the rest
        assert abs(mine[:, a] @ (u[:, a] * s[a])) / s[a] ** 2 > 0.999
    assert embedding.cell_vectors(counts.limit(0), cells, genes).count() == 90


def test_cell_clusters_find_planted_types(spark):
    counts, cells, genes, _ = planted(spark)
    got = clusters.cell_clusters(counts, cells, genes, axes=5)
    rows = got.cells.collect()
    assert len(rows) == 90 and [(r.cell, r.cluster) for r in rows if r.low_signal] == [(89, None)]
    assert {r.cell: set(r.embedding) for r in rows}[89] == {0.0}
    by = {}
    for r in rows:
        if r.cluster is not None:
            by.setdefault(r.cluster, set()).add(r.cell % 3)
    assert sorted(map(sorted, by.values())) == [[0], [1], [2]]
    of = {c: next(iter(t)) for c, t in by.items()}
    for r in got.markers.collect():
        if r.place <= 10:
            assert r.gene // 10 == of[r.cluster]
    held = clusters.cell_clusters(counts.limit(0), cells.limit(3), genes)
    assert [r.low_signal for r in held.cells.collect()] == [False] * 3


def test_subclusters_accumulate(spark):
    counts, cells, genes, _ = planted(spark)
    cells = cells.withColumn("label", F.when(F.col("label") == "C", "C").otherwise("AB"))
    out, table = clusters.subclusters(counts, cells, genes, "AB", resolution=0.5, axes=5)
    found = {(r.label, r.subtype, r.cell % 3) for r in out.collect() if r.cell != 89}
    assert len(found) == 3 and {s for x, s, _ in found if x == "C"} == {None} and {s for x, s, _ in found if x == "AB"} == {"AB subcluster 0", "AB subcluster 1"}
    assert sorted((r.subcluster, r.n_cells, len(r.top_markers)) for r in table.collect()) == [(0, 30, 12), (1, 30, 12)]
    again, _ = clusters.subclusters(counts, out, genes, "C", resolution=0.5, axes=5)
    assert again.filter("subtype IS NULL").count() == 0 and again.filter("cell = 89").first().subtype == "C"
    with pytest.raises(ValueError, match="0 cells"):
        clusters.subclusters(counts, cells, genes, "Z")


def test_thinned(spark):
    rows = [(c, g, float(v)) for c in range(40) for g, v in enumerate((1, 7, 100, 2000))] + [(1, 9, 0.0), (None, 1, 5.0), (2, 8, None)]
    df = spark.createDataFrame(rows, "cell long, gene long, value double")
    got = thinned_table = thinning.thinned(df, F.lit(0.8), 10)
    n = {(r.rep, r.gene): r.n for r in got.groupBy("rep", "gene").agg(F.sum("value").alias("n")).collect()}
    for rep in range(1, 11):
        for g, v in enumerate((1, 7, 100, 2000)):
            assert abs(n[rep, g] - 32 * v) < 5 * math.sqrt(40 * v * 0.16)
    assert len({n[r, 3] for r in range(1, 11)}) > 5  # repetitions differ
    assert thinned_table.repartition(3).exceptAll(thinning.thinned(df, F.lit(0.8), 10)).count() == 0
    assert thinning.thinned(df, F.lit(1.0)).count() == 160 and thinning.thinned(df, F.lit(0.0)).count() == 0


def test_label_stability(spark):
    counts, cells, genes, _ = planted(spark)
    got = {r.cell: r for r in thinning.label_stability(counts, cells, genes).collect()}
    assert len(got) == 90 and all(r.label == "ABC"[c % 3] and r.flip_rate == 0 for c, r in got.items() if c < 89)
    assert got[89].label == "A" and got[89].flip_rate == 0


def test_resolvability(spark):
    """C and D differ in a gene that isn't on the panel."""
    rng = np.random.default_rng(0)
    rows, cells = [], []
    for t, high in (("A", 0), ("B", 1), ("C", 2), ("D", 2)):
        m = rng.poisson(1.0, (60, 40))
        m[:, high] += rng.poisson(20.0, 60)
        m[:, 39] += rng.poisson(20.0, 60) * (t == "D")
        rows += [(f"{t}{i}", f"g{g}", int(v)) for i, r in enumerate(m) for g, v in enumerate(r) if v]
        cells += [(f"{t}{i}", t) for i in range(60)]
    counts, cells = spark.createDataFrame(rows, "cell string, gene string, value long"), spark.createDataFrame([*cells, ("x", None)], "cell string, label string")
    panel = spark.createDataFrame([(f"g{i}",) for i in range(39)], "gene string")
    got = {r.label: r for r in thinning.resolvability(counts, cells, panel, 40).collect()}
    assert set(got) == set("ABCD") and all(r.status == "ok" and r.n == 60 and r.n_shared == 39 for r in got.values())
    assert got["A"].tier == got["B"].tier == "resolvable" and "not_resolvable" in {got["C"].tier, got["D"].tier} | {"not_resolvable" if min(got["C"].f1, got["D"].f1) < 0.7 else ""}
    assert "D" == got["C"].confused_with or got["D"].confused_with == "C"
    few = thinning.resolvability(counts, cells, panel.limit(3), 40).collect()
    assert [(r.status, r.n_shared, r.label) for r in few] == [("insufficient_overlap", 3, None)]
    assert [r.status for r in thinning.resolvability(counts, cells.filter("label = 'A'"), panel, 40).collect()] == ["too_few_types"]
