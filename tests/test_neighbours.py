"""Neighbours of cells against brute force where the density differs: far cells, clusters, lines, ties."""

import numpy as np
import pytest

from tissueflow.operators import spatial


def brute(points, k):
    xy = np.array([p for p in points.values()], float)
    ids = np.array(list(points))
    out = {}
    for i, p in zip(ids.tolist(), xy, strict=True):
        d = np.round(np.hypot(*(xy - p).T), 6)
        out[i] = [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def found(spark, points, k):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in points.items()] + [(10**6, None, 1.0), (10**6 + 1, 1.0, None)], "cell long, x double, y double")
    out = {}
    for r in spatial.neighbours(df, k).collect():
        out.setdefault(r.src, []).append((round(r.d, 6), r.dst))
    return {i: [j for _, j in sorted(v)] for i, v in out.items()}


@pytest.mark.parametrize("kind", ["far", "clusters", "line", "lattice", "one place", "few"])
def test_neighbours_by_density(spark, monkeypatch, kind):
    monkeypatch.setattr(spatial, "FEW", 15)  # so that several rounds are needed
    rng = np.random.default_rng(2)
    xy = {
        "far": [*rng.random((400, 2)) * 100, (1e6, 1e6), (-3e5, 2.0)],
        "clusters": [*rng.normal(0, 0.01, (200, 2)), *rng.normal(50, 5, (200, 2)), *rng.random((60, 2)) * 1000],
        "line": [(x, 3.0) for x in rng.random(300) * 1e4],
        "lattice": [(x, y) for x in range(18) for y in range(18)],
        "one place": [*[(5.0, 5.0)] * 60, *rng.random((60, 2))],
        "few": [(0, 0), (1, 0), (5, 5)],
    }[kind]
    points = {7 * i % 1009: tuple(map(float, p)) for i, p in enumerate(xy)}
    assert found(spark, points, 6) == brute(points, 6)


def test_cells_on_each_other_make_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "FEW", 15)
    met = []
    kept = spatial.saved
    monkeypatch.setattr(spatial, "saved", lambda df: met.append(kept(df)) or met[-1])
    rng = np.random.default_rng(4)
    spots = rng.random((40, 2)) * 100
    points = {3 * i % 2003: tuple(map(float, spots[i % 40])) for i in range(1600)}
    assert found(spark, points, 6) == brute(points, 6)
    assert max(df.count() for df in met) <= len(points)  # tables of pairs are those of places
