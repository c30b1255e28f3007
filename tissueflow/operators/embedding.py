"""Operators on dense vectors, ``items(item, embedding array, label)``: centroids, adjacent clusters, neighbours, principal axes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissueflow.durable import forget, saved


def centroids(items: DataFrame) -> DataFrame:
    """``(label, dim, mean, n)`` of each label's vectors; rows without a label or vector go."""
    at = items.filter("label IS NOT NULL").select("label", F.posexplode("embedding").alias("dim", "v"))
    return at.groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))


def adjacent_clusters(items: DataFrame, k: int = 3) -> DataFrame:
    """``(a, b, d)``, a before b: each label with its ``k`` nearest centroids, ties to the smaller label. Labels by labels."""
    c = centroids(items).select("label", "dim", "mean")
    d = c.join(c.toDF("other", "dim", "mean2"), "dim").filter("label <> other").groupBy("label", "other").agg(F.sqrt(F.sum((F.col("mean") - F.col("mean2")) ** 2)).alias("d"))
    near = d.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.round("d", 9), "other"))).filter(F.col("place") <= k)
    return near.select(F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b"), "d").groupBy("a", "b").agg(F.min("d").alias("d"))


def separation(items: DataFrame, pairs: DataFrame, folds: int = 3, seed: int = 0) -> DataFrame:
    """``(a, b, n, balanced_accuracy)`` of each pair of labels: every item is judged by means and spreads of the other folds,
    by the diagonal discriminant; folds by hash of the item. Two labels under some 0.65 can't be told apart."""
    fold = F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(folds)).alias("fold")
    x = items.filter("label IS NOT NULL").select("item", "label", fold, F.posexplode("embedding").alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    own = x.groupBy("label", "fold", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") ** 2).alias("s2"))
    w = Window.partitionBy("label", "dim")
    rest = own.select("label", "fold", "dim", (F.sum("n").over(w) - F.col("n")).alias("n"), (F.sum("s").over(w) - F.col("s")).alias("s"), (F.sum("s2").over(w) - F.col("s2")).alias("s2")).filter("n > 0")
    model = rest.select("label", "fold", "dim", (F.col("s") / F.col("n")).alias("m"), (F.col("s2") - F.col("s") ** 2 / F.col("n")).alias("ss"), "n")
    side = lambda c: model.select(F.col("label").alias(c), "fold", "dim", *(F.col(v).alias(f"{v}_{c}") for v in ("m", "ss", "n")))
    two = pairs.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "fold", "dim"])
    two = two.withColumn("var", (F.col("ss_a") + F.col("ss_b")) / F.greatest(F.col("n_a") + F.col("n_b") - 2, F.lit(1)) + 1e-9)
    asked = two.select("a", "b", "fold", "dim", "m_a", "m_b", "var", F.explode(F.array("a", "b")).alias("label"))
    gap = (F.col("v") - F.col("m_b")) ** 2 - (F.col("v") - F.col("m_a")) ** 2
    score = x.join(F.broadcast(asked), ["label", "fold", "dim"]).groupBy("a", "b", "label", "item").agg(F.sum(gap / F.col("var")).alias("z"))
    right = F.when(F.col("label") == F.col("a"), F.col("z") > 0).otherwise(F.col("z") <= 0).cast("double")
    return score.groupBy("a", "b", "label").agg(F.avg(right).alias("r"), F.count(F.lit(1)).alias("n")).groupBy("a", "b").agg(F.sum("n").alias("n"), F.avg("r").alias("balanced_accuracy"))


def principal_axes(items: DataFrame, k: int = 50) -> DataFrame:
    """``(item, pca array)``: coordinates on the first ``k`` axes (fewer where vectors are shorter), by MLlib."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = items.filter("embedding IS NOT NULL").select("item", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    head = rows.first()
    if head is None:
        return rows.select("item", F.array().cast("array<double>").alias("pca"))
    return PCA(k=min(k, len(head["v"])), inputCol="v", outputCol="p").fit(rows).transform(rows).select("item", vector_to_array("p").alias("pca"))


@dataclass
class SparseRows:
    """``rows(cell, at, v)``, each cell's places among ``genes`` and its values there; cells without any have no row."""

    rows: DataFrame
    genes: list
    mean: np.ndarray
    n: int

    def dense(self):
        """A function for tasks that gives a few rows with their zeros."""
        width = len(self.genes)

        def run(at: list, v: list) -> np.ndarray:
            x = np.zeros((len(at), width))
            x[np.repeat(np.arange(len(at)), list(map(len, at))), np.concatenate(at).astype(np.int64)] = np.concatenate(v)
            return x

        return run

    def summed(self, shape: tuple[int, ...], add: Callable[[np.ndarray, np.ndarray], None], size: int = 512) -> np.ndarray:
        """The sum over all rows of what ``add(out, x)`` adds to a matrix for a few dense rows: one matrix a task, summed by
        place, so that the driver sees that matrix alone."""
        dense = self.dense()

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(shape)
            for p in parts:
                for lo in range(0, len(p), size):
                    add(out, dense(*(p[c].iloc[lo : lo + size].tolist() for c in ("at", "v"))))
            yield pd.DataFrame({"i": np.arange(out.size), "s": out.ravel()})

        total = np.zeros(int(np.prod(shape)))
        for r in self.rows.select("at", "v").mapInPandas(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
            total[r["i"]] = r["s"]
        return total.reshape(shape)


def normalised(counts: DataFrame) -> DataFrame:
    """``(cell, gene, v)``: counts scaled to the median of the cells' totals, log1p. Counts that aren't positive go."""
    own = counts.filter("value > 0").groupBy("cell", "gene").agg(F.sum(F.col("value").cast("double")).alias("value"))
    totals = own.groupBy("cell").agg(F.sum("value").alias("total"))
    target = totals.agg(F.percentile("total", F.lit(0.5)).alias("target"))
    return own.join(totals, "cell").crossJoin(F.broadcast(target)).select("cell", "gene", F.log1p(F.col("value") * F.col("target") / F.col("total")).alias("v"))


def variable_rows(counts: DataFrame, cells: DataFrame, genes: DataFrame, top: int = 2000) -> SparseRows:
    """The normalised values of ``cells(cell)`` on the ``top`` of ``genes(gene)`` whose variance is largest for their mean."""
    cells = cells.select("cell").distinct()
    values = saved(normalised(counts.join(cells, "cell").join(genes.select("gene").distinct(), "gene")))
    n = cells.count()
    square = F.sum(F.col("v") * F.col("v"))
    stats = values.groupBy("gene").agg((F.sum("v") / n).alias("mean"), ((square - F.sum("v") ** 2 / n) / max(n - 1, 1)).alias("var"))
    spread = F.log(F.col("var") / F.col("mean"))
    picked = stats.filter("var > 0").orderBy(F.desc(F.round(spread, 9)), "gene").limit(top).select("gene", "mean").collect()  # at most top rows
    place = values.sparkSession.createDataFrame([(r["gene"], i) for i, r in enumerate(picked)], f"gene {dict(genes.dtypes)['gene']}, at int")
    rows = saved(values.join(F.broadcast(place), "gene").groupBy("cell").agg(F.collect_list("at").alias("at"), F.collect_list("v").alias("v")))
    forget(values)
    return SparseRows(rows, [r["gene"] for r in picked], np.array([r["mean"] for r in picked]), n)


def cell_vectors(counts: DataFrame, cells: DataFrame, genes: DataFrame, k: int = 50, top: int = 2000, passes: int = 4, seed: int = 0) -> DataFrame:
    """``(item, embedding)``: each of ``cells(cell)`` on the ``k`` main axes of its normalised, log-scaled counts over the ``top``
    most variable of ``genes(gene)``.

    The axes come from passes of subspace iteration over the sparse rows: a task adds up one matrix of genes by axes, and
    the driver sees that matrix alone. Cells without counts lie where all their values are zero.
    """
    spark, cells = counts.sparkSession, cells.select("cell").distinct()
    x = variable_rows(counts, cells, genes, top)
    mean, n, kind = x.mean, x.n, dict(cells.dtypes)["cell"]
    if not x.genes:
        return cells.select(F.col("cell").alias("item"), F.array(F.lit(0.0)).alias("embedding"))

    def spread_along(axes: np.ndarray) -> np.ndarray:
        """The covariance times ``axes``."""
        held = spark.sparkContext.broadcast(axes)

        def add(out: np.ndarray, x: np.ndarray) -> None:
            out += x.T @ (x @ held.value)

        return x.summed(axes.shape, add) / n - np.outer(mean, mean @ axes)

    width = min(len(mean), k + 10)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(mean), width)))[0]
    for _ in range(passes):
        q = np.linalg.qr(spread_along(q))[0]
    small = q.T @ spread_along(q)
    e, u = np.linalg.eigh((small + small.T) / 2)
    axes = q @ u[:, np.argsort(-e)[: min(k, n - 1, len(mean))]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    held, origin = spark.sparkContext.broadcast(axes), (-(mean @ axes)).tolist()

    dense = x.dense()

    def project(at: pd.Series, v: pd.Series) -> pd.Series:
        rows = (dense(at.iloc[lo : lo + 512].tolist(), v.iloc[lo : lo + 512].tolist()) @ held.value for lo in range(0, len(at), 512))
        return pd.Series([y for part in rows for y in part + np.array(origin)])

    placed = x.rows.select("cell", F.pandas_udf(project, "array<double>")("at", "v").alias("embedding"))
    return cells.join(placed, "cell", "left").select(F.col("cell").cast(kind).alias("item"), F.coalesce("embedding", F.array(*map(F.lit, origin))).alias("embedding"))
