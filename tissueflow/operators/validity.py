"""How well labels fit the vectors they are given to, without truth: no pairs of items are made."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissueflow.durable import saved
from tissueflow.operators.graph import K, nearest_vectors

#: Groups that Ward's merging begins with.
MICRO = 64


def _sums(items: DataFrame, by: str) -> DataFrame:
    """Per group: number, mean vector, and mean square length."""
    d = F.posexplode("v").alias("dim", "x")
    mean = items.select(by, d).groupBy(by, "dim").agg(F.avg("x").alias("m"))
    lists = mean.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda y: y["m"]).alias("mean"))
    square = items.groupBy(by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(_dot("v", "v")).alias("square"))
    return lists.join(square, by)


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def silhouettes(items: DataFrame) -> DataFrame:
    """``(item, label, silhouette, silhouette_2label)`` of ``items(item, v, label)``, on squared distances.

    The mean squared distance to a label's items is the item's square less twice its product with their mean plus their
    mean square, so sums per label are enough. The first is against the nearest other label, the second against all
    other items together; 0 for the only item of a label, null where there is one label alone.
    """
    by = saved(_sums(items, "label"))
    whole = by.agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("square")).alias("squares"))
    t = items.withColumn("s", _dot("v", "v")).crossJoin(F.broadcast(by.select(F.col("label").alias("other"), "mean", "n", "square")))  # labels are few
    t = t.withColumn("sum", F.col("n") * (F.col("s") - 2 * _dot("v", "mean") + F.col("square"))).withColumn("own", F.col("label") == F.col("other"))
    best = t.groupBy("item", "label").agg(F.max(F.when(F.col("own"), F.col("n"))).alias("n"), F.max(F.when(F.col("own"), F.col("sum"))).alias("a"), F.min(F.when(~F.col("own"), F.col("sum") / F.col("n"))).alias("b"), F.sum(F.when(~F.col("own"), F.col("sum"))).alias("r")).crossJoin(F.broadcast(whole))
    a, rest = F.greatest(F.col("a"), F.lit(0.0)) / F.nullif(F.col("n") - 1, F.lit(0.0)), F.col("r") / (F.col("all") - F.col("n"))
    score = lambda b: F.when(b.isNull(), None).when(F.col("n") == 1, 0.0).otherwise(F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)), F.lit(0.0)))
    return best.select("item", "label", score(F.col("b")).alias("silhouette"), score(rest).alias("silhouette_2label"))


def ward_groups(mean: np.ndarray, n: np.ndarray, groups: int) -> list[int]:
    """The group of each of some centres with ``n`` items after merging, again and again, the two whose merging adds least to the
    sum of squares; ties to the first."""
    at, mean, n = list(range(len(mean))), mean.astype(float).copy(), n.astype(float).copy()
    live = list(range(len(mean)))
    while len(live) > max(groups, 1):
        m, k = mean[live], n[live]
        cost = (k[:, None] * k / (k[:, None] + k)) * ((m[:, None] - m) ** 2).sum(axis=2)
        cost[np.tril_indices(len(live))] = np.inf
        i, j = divmod(int(np.argmin(np.round(cost, 12))), len(live))
        a, b = live[i], live[j]
        mean[a] = (n[a] * mean[a] + n[b] * mean[b]) / (n[a] + n[b])
        n[a] += n[b]
        at = [a if x == b else x for x in at]
        live.remove(b)
    return at


def _ward_match(items: DataFrame, labels: int, micro: int, seed: int) -> DataFrame:
    """Share of items whose label is the commonest of their group: k-means into ``micro`` groups, merged by Ward's rule to as many
    as there are labels."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = items.select("item", "label", array_to_vector("v").alias("features"))
    model = KMeans(k=max(micro, labels), seed=seed, maxIter=10).fit(rows)
    near = saved(model.transform(rows).select("label", F.col("prediction").alias("at")).groupBy("at", "label").agg(F.count(F.lit(1)).alias("n")))
    size = {r["at"]: r["n"] for r in near.groupBy("at").agg(F.sum("n").alias("n")).collect()}  # micro rows
    at = sorted(size)
    groups = ward_groups(np.stack([model.clusterCenters()[i] for i in at]), np.array([size[i] for i in at]), labels)
    merged = near.sparkSession.createDataFrame(list(zip(at, groups, strict=True)), "at int, grp int")
    return near.join(F.broadcast(merged), "at").groupBy("grp", "label").agg(F.sum("n").alias("n")).groupBy("grp").agg(F.max("n").alias("top"), F.sum("n").alias("n")).agg((F.sum("top") / F.sum("n")).alias("ward_match"))


def internal_validity(items: DataFrame, k: int = K, micro: int = MICRO, seed: int = 0) -> DataFrame:
    """One row of ``items(item, embedding, label)``: mean silhouettes, the share of the ``k`` nearest items of the same label, of
    items nearer to their label's medoid (its item next to the mean) than to another's, of items that Ward groups agree
    with, the mean cosine to the label's mean, and ``integrated``: the geometric mean of all, scaled to 0 to 1.

    Rows with a null item, label or vector go; an empty table gives nulls. Needs two labels for the silhouettes.
    """
    t = saved(items.filter("item IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select("item", "label", F.col("embedding").cast("array<double>").alias("v")))
    names = ("silhouette", "silhouette_2label", "neighbourhood_purity", "orbital_medoid", "ward_match", "similarity")
    n, labels = t.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    if not n:
        return items.sparkSession.createDataFrame([(0, 0, *[None] * 7)], ", ".join(["n long", "n_labels long", *(f"{c} double" for c in (*names, "integrated"))]))
    parts = [silhouettes(t).agg(F.avg("silhouette").alias("silhouette"), F.avg("silhouette_2label").alias("silhouette_2label"))]
    side = t.select(F.col("item"), "label")
    edges = nearest_vectors(t.select("item", F.col("v").alias("embedding")), k, seed=seed).join(side.toDF("src", "a"), "src").join(side.toDF("dst", "b"), "dst")
    parts.append(edges.agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("neighbourhood_purity")))
    by = saved(_sums(t, "label").select("label", "mean"))
    to_mean = t.join(F.broadcast(by), "label")
    gap = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    medoid = saved(to_mean.groupBy("label").agg(F.min_by("v", F.struct(F.round(gap("v", "mean"), 12), "item")).alias("medoid")))
    orbit = t.crossJoin(F.broadcast(medoid.select(F.col("label").alias("near"), "medoid"))).groupBy("item", "label").agg(F.min(F.struct(F.round(gap("v", "medoid"), 12), F.col("near") != F.col("label"), "near"))["near"].alias("near"))
    parts.append(orbit.agg(F.avg((F.col("near") == F.col("label")).cast("double")).alias("orbital_medoid")))
    parts.append(_ward_match(t, labels, min(micro, n), seed))
    length = F.sqrt(_dot("v", "v") * _dot("mean", "mean"))
    parts.append(to_mean.agg(F.avg(F.coalesce(_dot("v", "mean") / F.nullif(length, F.lit(0.0)), F.lit(0.0))).alias("similarity")))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    signed = lambda c: F.greatest((F.coalesce(F.col(c), F.lit(0.0)) + (1 if c in ("silhouette", "silhouette_2label", "similarity") else 0)) / (2 if c in ("silhouette", "silhouette_2label", "similarity") else 1), F.lit(1e-12))
    whole = F.exp(sum((F.log(signed(c)) for c in names), F.lit(0.0)) / len(names))
    return out.select(F.lit(n).cast("long").alias("n"), F.lit(labels).cast("long").alias("n_labels"), *names, whole.alias("integrated"))
