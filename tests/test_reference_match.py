"""Reference purity, internal validity and the match of references: brute force and hand-worked cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissueflow.operators import matching, reference_purity, validity
from tissueflow.operators.matching import Reference


def test_foreign_genes_and_negative_share(spark):
    ref = [(c, "a", 1.0) for c in range(10)] + [(c, "b", 2.0) for c in range(10, 20)] + [(0, "b", 1.0)] + [(c, "c", 1.0) for c in range(20)] + [(c, "rare", 1.0) for c in (1, 2)]
    cells = spark.createDataFrame([(c, "A" if c < 10 else "B") for c in range(20)] + [(20, None)], "cell long, label string")
    foreign = reference_purity.foreign_genes(spark.createDataFrame(ref, "cell long, gene string, value double"), cells)
    assert sorted(map(tuple, foreign.collect())) == [("B", "a")]  # b is in a tenth of A
    foreign = reference_purity.foreign_genes(spark.createDataFrame(ref, "cell long, gene string, value double"), cells, absent=0.1)
    assert sorted(map(tuple, foreign.collect())) == [("A", "b"), ("B", "a")]
    counts = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0), (1, "x", 50.0), (2, "a", 4.0), (3, "a", 0.0), (4, "a", 1.0)], "cell long, gene string, value double")
    own = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A"), (4, "unknown"), (5, "A")], "cell long, label string")
    shared = spark.createDataFrame([("a",), ("b",), ("a",)], "gene string")
    assert sorted(map(tuple, reference_purity.negative_share(counts, own, foreign, shared).collect())) == [(1, 0.25), (2, 1.0), (3, None), (4, None), (5, None)]


def test_kept_apart_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    ref, own = ((rng.random((60, 12)) < p) for p in (0.25, 0.35))
    rows = lambda m: [(c, f"g{g:02}", 2.0) for c, r in enumerate(m) for g, x in enumerate(r) if x]
    extra = [(0, "g00", 1.0), (0, "zz", 1.0), (1, "g01", 0.0)]
    frame = lambda r: spark.createDataFrame(r, "cell long, gene string, value double")
    got = reference_purity.kept_apart(frame(rows(own) + ([(0, "g00", 1.0)] if own[0, 0] else [])), frame(rows(ref) + extra[1:]), together=0.15, genes=10, pairs=20)
    top = sorted(range(12), key=lambda g: (-ref[:, g].sum(), g))[:10]
    rate = lambda m, a, b: (m[:, a] & m[:, b]).sum() / (m[:, a] | m[:, b]).sum()
    pairs = sorted((round(rate(ref, a, b), 12), a, b) for a, b in itertools.combinations(sorted(top), 2) if rate(ref, a, b) <= 0.15)[:20]
    expected = {(f"g{a:02}", f"g{b:02}", round(r, 9), round(rate(own, a, b), 9), bool(rate(own, a, b) <= 0.15)) for r, a, b in pairs}
    assert len(expected) > 5 and {(r.a, r.b, round(r.reference_rate, 9), round(r.rate, 9), r.apart) for r in got.collect()} == expected
    s = reference_purity.apart_share(got).first()
    assert s.n_pairs == len(expected) and abs(s.ncp - np.mean([x[4] for x in expected])) < 1e-9
    assert reference_purity.kept_apart(frame([(1, "q", 1.0)]), frame(rows(ref))).count() == 0


def reference(spark, split=True, cells=60, genes=40, seed=0, name="ref", tissue=None):
    """A and B have genes of their own, C and D have theirs in common unless ``split``."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i, t in enumerate("ABCD"):
        m = rng.poisson(1.0, (cells, genes))
        m[:, min(i, 2)] += rng.poisson(25.0, cells)
        if split and t == "D":
            m[:, 3] += rng.poisson(25.0, cells)
            m[:, 2] -= np.minimum(m[:, 2], 20)
        rows += [(f"{t}{c}", f"g{g:02}", int(v)) for c, r in enumerate(m) for g, v in enumerate(r) if v]
        labels += [(f"{t}{c}", t) for c in range(cells)]
    return Reference(name, spark.createDataFrame(rows, "cell string, gene string, value long"), spark.createDataFrame(labels, "cell string, label string"), tissue)


def test_reference_markers(spark):
    ref = reference(spark)
    panel = spark.createDataFrame([(f"g{i:02}",) for i in range(1, 40)], "gene string")
    few = ref.cells.union(spark.createDataFrame([("x1", "rare"), (None, None)], "cell string, label string"))
    got = {}
    for r in reference_purity.reference_markers(ref.counts, few, panel, top=3).collect():
        got.setdefault(r.label, {})[r.place] = r.gene
    assert set(got) == set("ABCD") and got["B"][1] == "g01" and got["D"][1] == "g03" and got["C"][1] == "g02" and all(len(g) == 3 and "g00" not in g.values() for g in got.values())
    assert reference_purity.reference_markers(ref.counts, ref.cells, panel.limit(0)).count() == 0


def test_reference_match_verdicts(spark):
    rows = [("good", "ok", 60, t, f, "resolvable") for t, f in (("a", 0.9), ("b", 0.7))] + [("fair", "ok", 40, "a", 0.8, "resolvable"), ("fair", "ok", 40, "b", 0.1, "not_resolvable"), ("fair", "ok", 40, "c", 0.3, "not_resolvable")]
    rows += [("poor", "ok", 90, "a", 0.2, "not_resolvable"), ("none", "insufficient_overlap", 10, None, None, None), ("kidney", "ok", 80, "a", 0.9, "resolvable")]
    resolved = spark.createDataFrame(rows, "reference string, status string, n_shared long, label string, f1 double, tier string")
    declared = spark.createDataFrame([("kidney", "kidney cortex"), ("good", "skin"), ("fair", None)], "reference string, tissue string")
    got = {r.reference: r for r in matching.reference_match(resolved, 100, "skin melanoma", declared).collect()}
    assert {k: (r.verdict, r.match_score, r.action, r.poor_fit, r.tissue_mismatch) for k, r in got.items()} == {
        "good": ("good", round(0.5 * 0.8 + 0.3 + 0.2 * 0.6, 3), "supervised_transfer", False, False),
        "fair": ("fair", round(0.5 * 0.4 + 0.3 / 3 + 0.2 * 0.4, 3), "coarsen_then_transfer", False, False),
        "poor": ("poor", round(0.5 * 0.2 + 0.2 * 0.9, 3), "unsupervised_clustering", True, False),
        "none": ("poor", 0.02, "unsupervised_clustering", True, False),
        "kidney": ("good", round(0.45 + 0.3 + 0.16, 3), "unsupervised_clustering", False, True),
    }
    assert got["none"].mean_f1 is None and got["none"].n_types == 0


def test_strategy_ladder(spark):
    panel = spark.createDataFrame([(f"g{i:02}",) for i in range(40)], "gene string")
    s = matching.plan_strategy(reference(spark), panel, 60)
    assert (s.mode, s.verdict, s.coarse) == ("reference_transfer", "good", None) and [r.kind for r in s.ladder.collect()] == ["initial"]
    wide = spark.createDataFrame([(f"g{i:02}",) for i in range(100)], "gene string")  # an overlap of 0.4: fair at best
    s = matching.plan_strategy(reference(spark, False), wide, 60)
    assert s.mode == "reference_transfer" and s.verdict == "fair" and {r.label: r.merged for r in s.coarse.collect()} == {"C": "C + D", "D": "C + D"}
    steps = s.ladder.orderBy("step").collect()
    assert [r.kind for r in steps] == ["initial", "coarsen"] and steps[1].mean_f1 > steps[0].mean_f1 and steps[1].n_types == 3
    few = spark.createDataFrame([("g00",), ("zz",)], "gene string")
    s = matching.plan_strategy(reference(spark), few, 60)
    assert (s.mode, s.verdict) == ("cluster", "poor") and s.ladder.first().status == "insufficient_overlap"


def test_strategy_swaps_references(spark):
    panel = spark.createDataFrame([(f"g{i:02}",) for i in range(40)], "gene string")
    poor = Reference("poor", *(f(reference(spark)) for f in (lambda r: r.counts.filter("gene >= 'g30'"), lambda r: r.cells)), "skin")
    others = (Reference("kidney", reference(spark).counts, reference(spark).cells, "kidney"), reference(spark, name="skin", tissue="skin"))
    s = matching.plan_strategy(poor, panel, 60, "skin", others)
    assert (s.reference, s.mode) == ("kidney", "cluster")  # good in itself, but of another organ
    s = matching.plan_strategy(poor, panel, 60, "skin", others[1:])
    assert (s.reference, s.mode, s.verdict) == ("skin", "reference_transfer", "good") and [r.kind for r in s.ladder.orderBy("step").collect()] == ["initial", "swap_reference"]
    assert matching.plan_strategy(poor, panel, 60, None, others).mode == "cluster"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("item"), "embedding", "label")


def test_silhouettes_equal_brute_force(vectors):
    rows = vectors.collect()
    x, label = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])
    d = ((x[:, None] - x) ** 2).sum(axis=2)
    got = {r.item: r for r in validity.silhouettes(vectors.select("item", "label", F.col("embedding").cast("array<double>").alias("v"))).collect()}
    for i, r in enumerate(rows):
        own = label == r.label
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, label == k].mean() for k in set(label.tolist()) - {r.label})
        rest = d[i, ~own].mean()
        assert abs(got[r.item].silhouette - (b - a) / max(a, b)) < 1e-9 and abs(got[r.item].silhouette_2label - (rest - a) / max(a, rest)) < 1e-9


def test_internal_validity(spark, vectors):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(6 * k, 1, (40, 5)) for k in range(4)])
    rows = [(i, v.tolist(), "abcd"[i // 40]) for i, v in enumerate(x)] + [(500, None, "a"), (501, [1.0] * 5, None)]
    df = spark.createDataFrame(rows, "item long, embedding array<double>, label string")
    clean = validity.internal_validity(df).first()
    shuffled = validity.internal_validity(df.withColumn("label", F.when(F.col("label").isNotNull(), F.element_at(F.array(*map(F.lit, "abcd")), (F.col("item") % 4 + 1).cast("int"))))).first()
    assert clean.n == 160 and clean.n_labels == 4 and clean.neighbourhood_purity > 0.99 and clean.ward_match == 1 and 0 <= clean.integrated <= 1
    for c in ("silhouette", "silhouette_2label", "neighbourhood_purity", "orbital_medoid", "ward_match", "integrated"):
        assert clean[c] > shuffled[c], c
    none = validity.internal_validity(df.filter("item > 499")).first()
    assert none.n == 0 and none.integrated is None


def test_ward_groups_merge_the_cheapest_pairs():
    mean = np.array([[0.0], [1.0], [10.0], [10.5], [30.0]])
    assert validity.ward_groups(mean, np.ones(5), 3) == [0, 0, 2, 2, 4]
    assert validity.ward_groups(mean, np.array([1, 1, 100, 100, 1]), 4) == [0, 0, 2, 3, 4]
