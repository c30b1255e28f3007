"""Spatial neighbours by a grid-bucketed join, and the statistics on their graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissueflow.durable import saved
from tissueflow.sources.section import Section

K, K_LABELS, RADIUS = 6, 15, 400.0
#: Sizes of squares, as powers of two of a typical distance; cells that it is taken from; cells that are held against all.
LEVELS, SAMPLE, FEW = tuple(range(-6, 3)), 2000, 1000


def within(cells: DataFrame, radius: float, of: DataFrame | None = None) -> DataFrame:
    """``(src, dst, d)``: for each cell (of ``of``, if given) all others at most ``radius`` away.

    Cells are bucketed by squares of the radius; each is met with the nine squares around it, an equi-join.
    """
    square = lambda df: df.filter("x IS NOT NULL AND y IS NOT NULL").select("cell", "x", "y", F.floor(F.col("x") / radius).alias("gx"), F.floor(F.col("y") / radius).alias("gy"))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = square(cells if of is None else of).select(F.col("cell").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), "gx", "gy", F.explode(steps).alias("s")).select("src", "ax", "ay", (F.col("gx") + F.col("s.i")).alias("gx"), (F.col("gy") + F.col("s.j")).alias("gy"))
    b = square(cells).withColumnRenamed("cell", "dst")
    return a.join(b, ["gx", "gy"]).filter("src <> dst").withColumn("d", F.sqrt((F.col("ax") - F.col("x")) ** 2 + (F.col("ay") - F.col("y")) ** 2)).filter(F.col("d") <= radius).select("src", "dst", "d")


def _scale(cells: DataFrame, n: int, k: int) -> float:
    """The distance within which a typical cell has some 2 k others, from the k-th neighbours among SAMPLE cells drawn by hash:
    the median, so that neither a few far cells nor empty space count."""
    xy = np.array([(r["x"], r["y"]) for r in cells.select("x", "y", F.xxhash64("cell").alias("o")).orderBy("o").limit(SAMPLE).collect()])
    at = min(k, len(xy) - 1)
    far = np.concatenate([np.partition(np.hypot(*(part[:, None, :] - xy).transpose(2, 0, 1)), at, axis=1)[:, at] for part in np.array_split(xy, -(-len(xy) // 256))])
    far = far[far > 0]
    return float(np.median(far)) * (2 * len(xy) / n) ** 0.5 if len(far) else 1.0


def _nearest_of_few(cells: DataFrame, few: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of all cells to each of up to FEW ones: every task keeps its own best."""
    asked = few.toPandas()
    held = cells.sparkSession.sparkContext.broadcast(asked)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = held.value
        for p in parts:
            for lo in range(0, len(p), 1024):
                part = p.iloc[lo : lo + 1024]
                d = np.hypot(q["x"].to_numpy()[:, None] - part["x"].to_numpy(), q["y"].to_numpy()[:, None] - part["y"].to_numpy())
                d[q["cell"].to_numpy()[:, None] == part["cell"].to_numpy()] = np.inf
                at = min(k, len(part)) - 1
                i, j = np.nonzero((np.round(d, 6) <= np.round(np.partition(d, at, axis=1)[:, at, None], 6)) & np.isfinite(d))
                yield pd.DataFrame({"src": q["cell"].to_numpy()[i], "dst": part["cell"].to_numpy()[j], "d": d[i, j]})

    kind = dict(cells.dtypes)["cell"]
    return cells.mapInPandas(run, f"src {kind}, dst {kind}, d double")


def _near_places(places: DataFrame, k: int) -> DataFrame:
    """``(src, dst, d)`` of ``places(place, x, y, least, m)``: the nearest of each, itself among them, until they hold ``k + 1`` cells; of
    places at one distance (six digits) those of the least cell come first."""
    n = places.count()
    base = _scale(places.withColumnRenamed("place", "cell"), n, k)
    size = base * F.pow(F.lit(2.0), F.col("level"))
    # each place holds a cell, so the first k + 1 cells are in the first k + 1 places
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.round("d", 6), "least"))
    square = lambda df: df.withColumn("gx", F.floor(F.col("x") / size)).withColumn("gy", F.floor(F.col("y") / size))
    at_levels = lambda df, levels: square(df.withColumn("level", F.explode(F.array(*map(F.lit, levels)))))
    every = at_levels(places.select("place", "x", "y", "m"), list(LEVELS))
    full = every.groupBy("level", "gx", "gy").agg(F.sum("m").alias("held")).filter(F.col("held") > 2 * k)
    own = every.join(full, ["level", "gx", "gy"]).groupBy("place").agg(F.min("level").alias("level"))
    of = saved(places.select("place", "x", "y").join(own, "place", "left").withColumn("level", F.coalesce("level", F.lit(LEVELS[-1]))))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    found = None
    while (left := of.groupBy("level").agg(F.count(F.lit(1)).alias("m")).collect()) and sum(r["m"] for r in left) > FEW:
        a = square(of).select(F.col("place").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), "level", "gx", "gy", F.explode(steps).alias("s")).select("src", "ax", "ay", "level", (F.col("gx") + F.col("s.i")).alias("gx"), (F.col("gy") + F.col("s.j")).alias("gy"))
        b = at_levels(places, sorted(r["level"] for r in left)).withColumnRenamed("place", "dst")
        d = F.sqrt((F.col("ax") - F.col("x")) ** 2 + (F.col("ay") - F.col("y")) ** 2)
        met = a.join(b, ["level", "gx", "gy"]).withColumn("d", d).filter(F.col("d") <= size).select("src", "dst", "d", "least", "m")
        near = saved(met.withColumn("rank", rank).filter(F.col("rank") <= k + 1).drop("rank", "least"))
        done = near.groupBy("src").agg(F.sum("m").alias("held")).filter(F.col("held") > k).select("src")
        near = near.join(done, "src", "left_semi").select("src", "dst", "d")
        found = near if found is None else found.union(near)
        of = saved(of.join(done, of["place"] == done["src"], "left_anti").withColumn("level", F.col("level") + 1))
    if left:
        few = of.select(F.col("place").alias("cell"), "x", "y")
        rest = _nearest_of_few(places.select(F.col("place").alias("cell"), "x", "y"), few, k).union(few.select("cell", "cell", F.lit(0.0)))
        rest = rest.join(places.select(F.col("place").alias("dst"), "least"), "dst").withColumn("rank", rank).filter(F.col("rank") <= k + 1).select("src", "dst", "d")
        found = rest if found is None else found.union(rest)
    return found


def neighbours(cells: DataFrame, k: int = K) -> DataFrame:
    """``(src, dst, d)``: the ``k`` nearest other cells of each, or all others where there are fewer. Ties in distance go to
    the smaller id; cells without coordinates have none and are nobody's.

    Cells at one place have the same nearest cells, so each place is looked at once, with its ``k + 1`` smallest ids: cells that
    lie on each other cost no more. Squares follow the local density: of the LEVELS sizes around a typical distance, a place
    takes the smallest whose square holds over 2 k cells, and meets the nine squares around it. Places that have too few
    within that size look again at twice the size; when up to FEW are left, these are held against all. ``cells`` are read once.
    """
    cells = saved(cells.select("cell", "x", "y").filter("x IS NOT NULL AND y IS NOT NULL"))
    n = cells.count()
    if n < 2:
        return cells.limit(0).select(F.col("cell").alias("src"), F.col("cell").alias("dst"), F.lit(0.0).alias("d"))
    k = min(k, n - 1)
    first = F.row_number().over(Window.partitionBy("x", "y").orderBy("cell"))
    ids = cells.withColumn("at", first).filter(F.col("at") <= k + 1).groupBy("x", "y").agg(F.sort_array(F.collect_list("cell")).alias("ids"))
    places = saved(ids.select(F.monotonically_increasing_id().alias("place"), "x", "y", "ids", F.col("ids")[0].alias("least"), F.size("ids").alias("m")))
    near = _near_places(places.drop("ids"), k)
    named = near.join(places.select(F.col("place").alias("dst"), "ids"), "dst").select("src", "d", F.explode("ids").alias("id"))
    order = F.row_number().over(Window.partitionBy("src").orderBy(F.round("d", 6), "id"))
    best = named.withColumn("rank", order).filter(F.col("rank") <= k + 1).groupBy(F.col("src").alias("place")).agg(F.sort_array(F.collect_list(F.struct("rank", "id", "d"))).alias("near"))
    reached = saved(best.join(places.select("place", "x", "y"), "place").select("x", "y", "near"))
    own = cells.join(reached, ["x", "y"]).select(F.col("cell").alias("src"), F.slice(F.filter("near", lambda e: e["id"] != F.col("cell")), 1, k).alias("near"))
    return own.select("src", F.explode("near").alias("e")).select("src", F.col("e.id").alias("dst"), F.col("e.d").alias("d"))


def neighbour_graph(section: Section) -> DataFrame:
    return neighbours(section["cells"]).select("src", "dst", F.round("d", 4).alias("d"))


def _labelled(section: Section, edges: DataFrame) -> DataFrame:
    label = section["cells"].select("cell", "label")
    a, b = label.toDF("src", "a"), label.toDF("dst", "b")
    return edges.select("src", "dst").join(a, "src").join(b, "dst")


def coherence(section: Section) -> DataFrame:
    """Share of each cell's neighbours of its own label, and whether it lies apart from its kind."""
    out = _labelled(section, neighbours(section["cells"], K_LABELS)).groupBy("src").agg(F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("coherence"))
    return out.select(F.col("src").alias("cell"), "coherence", (F.col("coherence") < 0.2).alias("apart"))


def neighbourhood_composition(section: Section) -> DataFrame:
    n = _labelled(section, neighbours(section["cells"], K_LABELS)).groupBy("src", "b").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("src"))
    return n.select(F.col("src").alias("cell"), F.col("b").alias("label"), "n", F.round(F.col("n") / total, 6).alias("share"))


def enrichment(section: Section) -> DataFrame:
    """z of each ordered pair of labels on the symmetric graph, by the closed-form moments of join counts under
    random labels: no permutations, two aggregations of edges."""
    edges = neighbours(section["cells"]).select("src", "dst")
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    degree = both.groupBy("src").agg(F.count(F.lit(1)).alias("w"))
    s = degree.agg(F.sum("w").cast("double").alias("s0"), F.sum(F.col("w") * F.col("w")).cast("double").alias("dd"))
    c = _labelled(section, both).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("c"))
    size = section["cells"].groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = size.toDF("a", "na").crossJoin(size.toDF("b", "nb")).crossJoin(section["cells"].agg(F.count(F.lit(1)).cast("double").alias("n"))).crossJoin(s)  # labels x labels
    t = pairs.join(c, ["a", "b"], "left").select("a", "b", F.coalesce("c", F.lit(0.0)).alias("c"), "na", "nb", "n", "s0", "dd")
    n, na, nb, s0, dd = (F.col(x) for x in ("n", "na", "nb", "s0", "dd"))
    n2, n3, n4, q = n * (n - 1), n * (n - 1) * (n - 2), n * (n - 1) * (n - 2) * (n - 3), s0
    rest = s0 * s0 + 2 * q - 4 * dd
    same = F.col("a") == F.col("b")
    mean = F.when(same, s0 * na * (na - 1) / n2).otherwise(s0 * na * nb / n2)
    square = F.when(same, 2 * q * na * (na - 1) / n2 + 4 * (dd - q) * na * (na - 1) * (na - 2) / n3 + rest * na * (na - 1) * (na - 2) * (na - 3) / n4).otherwise(q * na * nb / n2 + (dd - q) * na * nb * (na + nb - 2) / n3 + rest * na * (na - 1) * nb * (nb - 1) / n4)
    return t.select("a", "b", F.col("c").cast("long").alias("n_edges"), F.round(mean, 4).alias("expected"), F.round((F.col("c") - mean) / F.sqrt(square - mean * mean), 4).alias("z"))


def co_occurrence(section: Section) -> DataFrame:
    """Pairs of labels by distance bin, and how much likelier a label is given the other at that distance."""
    near = within(section["cells"], RADIUS).select("src", "dst", F.least(F.floor(F.col("d") / (RADIUS / 4)), F.lit(3)).alias("bin"))
    label = section["cells"].select("cell", "label")
    n = near.join(label.toDF("src", "a"), "src").join(label.toDF("dst", "b"), "dst").groupBy("bin", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    by = lambda *c: F.sum("n").over(Window.partitionBy(*c))
    return n.select("bin", "a", "b", "n", F.round((F.col("n") / by("bin", "a")) / (by("bin", "b") / by("bin")), 6).alias("ratio"))


def spatial_genes(section: Section) -> DataFrame:
    """Moran's I of each gene on the symmetric neighbour graph; every sum touches non-zero counts only."""
    one = neighbours(section["cells"]).select("src", "dst")
    edges = saved(one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    counts = section["counts"].withColumn("value", F.col("value").cast("double"))
    n, s0 = section["cells"].agg(F.count(F.lit(1)).cast("double").alias("n")), edges.agg(F.count(F.lit(1)).cast("double").alias("s0"))
    weight = edges.select(F.col("src").alias("cell")).union(edges.select(F.col("dst").alias("cell"))).groupBy("cell").agg(F.count(F.lit(1)).alias("w"))
    cross = counts.select(F.col("cell").alias("src"), "gene", F.col("value").alias("u")).join(edges, "src").join(counts.select(F.col("cell").alias("dst"), "gene", F.col("value").alias("v")), ["dst", "gene"]).groupBy("gene").agg(F.sum(F.col("u") * F.col("v")).alias("uv"))
    sums = counts.join(weight, "cell", "left").groupBy("gene").agg(F.sum("value").alias("s1"), F.sum(F.col("value") ** 2).alias("s2"), F.sum(F.col("value") * F.coalesce("w", F.lit(0))).alias("xw"))
    t = sums.join(cross, "gene", "left").crossJoin(n).crossJoin(s0).withColumn("m", F.col("s1") / F.col("n"))
    i = F.col("n") / F.col("s0") * (F.coalesce("uv", F.lit(0.0)) - F.col("m") * F.col("xw") + F.col("m") ** 2 * F.col("s0")) / (F.col("s2") - F.col("n") * F.col("m") ** 2)
    return t.select("gene", F.round(i, 6).alias("moran"))


def exclusion(section: Section, limit: float = 2.0) -> DataFrame:
    """How each label stands to each other one: excluded, infiltrated, or neither, by the z of their common edges."""
    z = F.col("z")
    return enrichment(section).filter("a < b").select("a", "b", "z", F.when(z < -limit, "excluded").when(z > limit, "infiltrated").otherwise("neutral").alias("verdict"))


def neighbourhood_sanity(section: Section) -> DataFrame:
    """Each label's strongest partner by z, and whether that is another label."""
    best = enrichment(section).filter("z IS NOT NULL").groupBy("a").agg(F.min(F.struct((-F.col("z")).alias("order"), "b")).alias("m"))
    return best.select(F.col("a").alias("label"), F.col("m.b").alias("partner"), (-F.col("m.order")).alias("z"), (F.col("m.b") != F.col("a")).alias("suspect"))


def niches(section: Section, k: int = 8, seed: int = 0) -> DataFrame:
    """``(cell, niche)``: k-means over the shares of labels among each cell's neighbours."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    labels = [r["label"] for r in section["cells"].select("label").distinct().orderBy("label").collect()]  # types
    wide = neighbourhood_composition(section).groupBy("cell").pivot("label", labels).agg(F.first("share")).fillna(0.0)
    rows = saved(wide.select("cell", array_to_vector(F.array(*(F.col(f"`{x}`").cast("double") for x in labels))).alias("features")))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select("cell", F.col("prediction").alias("niche"))


OPERATORS = {"neighbour_graph": neighbour_graph, "spatial_coherence": coherence, "neighbourhood_composition": neighbourhood_composition, "neighbourhood_enrichment": enrichment, "co_occurrence": co_occurrence, "spatial_genes": spatial_genes, "exclusion_readout": exclusion, "neighbourhood_sanity": neighbourhood_sanity}
#: Operators that SQL can't express.
ITERATIVE = {"spatial_niches": niches}

_NEAR = f"SELECT a.cell AS src, b.cell AS dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM {{cells}} a JOIN {{cells}} b ON a.cell <> b.cell AND abs(a.x - b.x) <= {RADIUS} AND abs(a.y - b.y) <= {RADIUS} WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= {RADIUS}"
_ALL = "SELECT a.cell AS src, b.cell AS dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM {cells} a JOIN {cells} b ON a.cell <> b.cell"
_KNN, _KNN_LABELS = (f"SELECT src, dst, d FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(d, 6), dst) AS place FROM ({_ALL}) t) u WHERE place <= {k}" for k in (K, K_LABELS))
_LABELLED = "SELECT e.src, e.dst, a.label AS a, b.label AS b FROM edges e JOIN {cells} a ON a.cell = e.src JOIN {cells} b ON b.cell = e.dst"
#: The same by brute force over all pairs, for DuckDB.
SQL = {
    "neighbour_graph": f"SELECT src, dst, round(d, 4) AS d FROM ({_KNN}) t",
    "spatial_coherence": f"WITH edges AS ({_KNN_LABELS}) SELECT src AS cell, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS coherence, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) < 0.2 AS apart FROM ({_LABELLED}) t GROUP BY src",
    "neighbourhood_composition": f"WITH edges AS ({_KNN_LABELS}) SELECT src AS cell, b AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY src), 6) AS share FROM ({_LABELLED}) t GROUP BY src, b",
    "neighbourhood_enrichment": f"""WITH knn AS ({_KNN}), edges AS (SELECT src, dst FROM knn UNION SELECT dst, src FROM knn), dg AS (SELECT src, count(*) AS w FROM edges GROUP BY src), s AS (SELECT sum(w)::DOUBLE AS s0, sum(w * w)::DOUBLE AS dd FROM dg),
      sz AS (SELECT label, count(*)::DOUBLE AS n FROM {{cells}} GROUP BY label), tot AS (SELECT count(*)::DOUBLE AS n FROM {{cells}}), c AS (SELECT a, b, count(*)::DOUBLE AS c FROM ({_LABELLED}) t GROUP BY a, b),
      m AS (SELECT x.label AS a, y.label AS b, coalesce(c.c, 0) AS c, x.n AS na, y.n AS nb, tot.n AS n, s0, dd, s0 * s0 + 2 * s0 - 4 * dd AS rest FROM sz x CROSS JOIN sz y CROSS JOIN tot CROSS JOIN s LEFT JOIN c ON c.a = x.label AND c.b = y.label),
      e AS (SELECT *, CASE WHEN a = b THEN s0 * na * (na - 1) / (n * (n - 1)) ELSE s0 * na * nb / (n * (n - 1)) END AS mean,
        CASE WHEN a = b THEN 2 * s0 * na * (na - 1) / (n * (n - 1)) + 4 * (dd - s0) * na * (na - 1) * (na - 2) / (n * (n - 1) * (n - 2)) + rest * na * (na - 1) * (na - 2) * (na - 3) / (n * (n - 1) * (n - 2) * (n - 3))
        ELSE s0 * na * nb / (n * (n - 1)) + (dd - s0) * na * nb * (na + nb - 2) / (n * (n - 1) * (n - 2)) + rest * na * (na - 1) * nb * (nb - 1) / (n * (n - 1) * (n - 2) * (n - 3)) END AS sq FROM m)
      SELECT a, b, c::BIGINT AS n_edges, round(mean, 4) AS expected, round((c - mean) / sqrt(sq - mean * mean), 4) AS z FROM e""",
    "co_occurrence": f"""WITH edges AS ({_NEAR}), n AS (SELECT least(floor(e.d / {RADIUS / 4}), 3)::BIGINT AS bin, a.label AS a, b.label AS b, count(*) AS n FROM edges e JOIN {{cells}} a ON a.cell = e.src JOIN {{cells}} b ON b.cell = e.dst GROUP BY 1, 2, 3)
      SELECT bin, a, b, n, round((n / sum(n) OVER (PARTITION BY bin, a)) / (sum(n) OVER (PARTITION BY bin, b) / sum(n) OVER (PARTITION BY bin)), 6) AS ratio FROM n""",
    "spatial_genes": f"""WITH knn AS ({_KNN}), edges AS (SELECT src, dst FROM knn UNION SELECT dst, src FROM knn), tot AS (SELECT count(*)::DOUBLE AS n FROM {{cells}}), s AS (SELECT count(*)::DOUBLE AS s0 FROM edges), wt AS (SELECT cell, count(*) AS w FROM (SELECT src AS cell FROM edges UNION ALL SELECT dst FROM edges) t GROUP BY cell),
      cr AS (SELECT u.gene, sum(u.value * v.value)::DOUBLE AS uv FROM edges e JOIN {{counts}} u ON u.cell = e.src JOIN {{counts}} v ON v.cell = e.dst AND v.gene = u.gene GROUP BY u.gene),
      sm AS (SELECT k.gene, sum(k.value)::DOUBLE AS s1, sum(k.value * k.value)::DOUBLE AS s2, sum(k.value * coalesce(wt.w, 0))::DOUBLE AS xw FROM {{counts}} k LEFT JOIN wt ON wt.cell = k.cell GROUP BY k.gene)
      SELECT sm.gene, round(n / s0 * (coalesce(uv, 0) - s1 / n * xw + s1 / n * s1 / n * s0) / (s2 - n * (s1 / n) * (s1 / n)), 6) AS moran FROM sm LEFT JOIN cr ON cr.gene = sm.gene CROSS JOIN tot CROSS JOIN s""",
}
SQL["exclusion_readout"] = f"SELECT a, b, z, CASE WHEN z < -2 THEN 'excluded' WHEN z > 2 THEN 'infiltrated' ELSE 'neutral' END AS verdict FROM ({SQL['neighbourhood_enrichment']}) q WHERE a < b"
SQL["neighbourhood_sanity"] = f"SELECT a AS label, b AS partner, z, a <> b AS suspect FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY z DESC, b) AS place FROM ({SQL['neighbourhood_enrichment']}) q WHERE z IS NOT NULL) r WHERE place = 1"
