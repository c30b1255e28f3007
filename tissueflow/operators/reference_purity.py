"""Purity of a section against a labelled reference: marker sets of its types, counts on genes a type doesn't have, and gene pairs
that shouldn't meet in a cell."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissueflow.durable import saved
from tissueflow.operators.clusters import ranked_genes
from tissueflow.operators.embedding import SparseRows

#: A gene is foreign to a type if at most so many of its reference cells have it, and at least so many of another type's.
ABSENT, PRESENT = 0.05, 0.25
GENES, PAIRS, TOGETHER = 400, 2000, 0.1


def reference_markers(counts: DataFrame, cells: DataFrame, panel: DataFrame, top: int = 8, least: int = 20, markers: int = 2) -> DataFrame:
    """``(label, place, gene)``: the ``top`` genes of the panel that mark each type of the reference best, for types of ``least`` cells
    and at least ``markers`` genes. The reference is cut to the panel first; under two types or genes there are none."""
    size = cells.filter("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    groups = cells.join(F.broadcast(size), "label").select("cell", F.col("label").alias("cluster"))
    found = ranked_genes(counts, groups, panel, top).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("cluster")))
    return found.filter(F.col("m") >= markers).select(F.col("cluster").alias("label"), "place", "gene")


def foreign_genes(counts: DataFrame, cells: DataFrame, absent: float = ABSENT, present: float = PRESENT) -> DataFrame:
    """``(label, gene)``: genes that at most a share of ``absent`` of a type's reference cells have, and at least ``present`` of some
    other type's."""
    typed = cells.filter("label IS NOT NULL").select("cell", "label")
    size = typed.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rate = counts.filter("value > 0").select("cell", "gene").distinct().join(typed, "cell").groupBy("label", "gene").agg(F.count(F.lit(1)).alias("m")).join(F.broadcast(size), "label").select("label", "gene", (F.col("m") / F.col("n")).alias("rate"))
    known = rate.groupBy("gene").agg(F.max("rate").alias("top")).filter(F.col("top") >= present)
    every = known.crossJoin(F.broadcast(size.select("label"))).join(rate, ["label", "gene"], "left")  # types are few
    return every.filter(F.coalesce("rate", F.lit(0.0)) <= absent).select("label", "gene")


def negative_share(counts: DataFrame, cells: DataFrame, foreign: DataFrame, shared: DataFrame) -> DataFrame:
    """``(cell, nmp)`` of ``cells(cell, label)``: the share of a cell's counts on the ``shared(gene)`` genes that fall on those
    ``foreign(label, gene)`` to its type; null without such counts or for a type that has no foreign genes."""
    known = foreign.select("label").distinct().withColumn("known", F.lit(True))
    c = counts.filter("value > 0").join(shared.select("gene").distinct(), "gene").join(cells.select("cell", "label"), "cell")
    t = c.join(foreign.withColumn("bad", F.lit(True)), ["label", "gene"], "left").groupBy("cell").agg((F.sum(F.when(F.col("bad"), F.col("value")).otherwise(0)) / F.sum("value")).alias("share"))
    out = cells.select("cell", "label").join(F.broadcast(known), "label", "left").join(t, "cell", "left")
    return out.select("cell", F.when(F.col("known"), F.col("share")).alias("nmp"))


def _meetings(counts: DataFrame, names: list) -> np.ndarray:
    """How many cells have both of each two of the genes, by a product of genes by genes; the diagonal has one gene's cells."""
    spark = counts.sparkSession
    place = F.broadcast(spark.createDataFrame([(g, i) for i, g in enumerate(names)], f"gene {dict(counts.dtypes)['gene']}, at int"))
    rows = counts.filter("value > 0").select("cell", "gene").distinct().join(place, "gene").groupBy("cell").agg(F.collect_list("at").alias("at"), F.collect_list(F.lit(1.0)).alias("v"))

    def add(out: np.ndarray, x: np.ndarray) -> None:
        out += x.T @ x

    return SparseRows(saved(rows), names, np.zeros(len(names)), 0).summed((len(names),) * 2, add)


def kept_apart(counts: DataFrame, reference_counts: DataFrame, together: float = TOGETHER, genes: int = GENES, pairs: int = PAIRS) -> DataFrame:
    """``(a, b, reference_rate, rate, apart)``: pairs of genes that meet in at most a share of ``together`` of the reference's cells
    that have either, and whether that holds in the section too. A rate is null where no cell of the section has either.

    The search is bounded by definition: the ``genes`` shared genes that most reference cells have, and the ``pairs`` of
    least rate among them, ties by name. Both halves are products of genes by genes over sparse rows.
    """
    spark, kind = counts.sparkSession, dict(counts.dtypes)["gene"]
    shared = counts.filter("value > 0").select("gene").distinct()
    common = reference_counts.filter("value > 0").select("cell", "gene").distinct().join(shared, "gene").groupBy("gene").agg(F.count(F.lit(1)).alias("n"))
    names = sorted(r["gene"] for r in common.orderBy(F.desc("n"), "gene").limit(genes).collect())
    schema = f"a {kind}, b {kind}, reference_rate double, rate double, apart boolean"
    if len(names) < 2:
        return spark.createDataFrame([], schema)
    rates = []
    for c in (reference_counts, counts):
        both = _meetings(c, names)
        either = np.diag(both)[:, None] + np.diag(both) - both
        rates.append(np.where(either > 0, both / np.maximum(either, 1), np.nan))
    i, j = np.triu_indices(len(names), 1)
    ref, own = rates[0][i, j], rates[1][i, j]
    order = [k for k in np.lexsort((j, i, np.round(ref, 12))) if ref[k] <= together][:pairs]
    return spark.createDataFrame([(names[i[k]], names[j[k]], float(ref[k]), None if np.isnan(own[k]) else float(own[k]), None if np.isnan(own[k]) else bool(own[k] <= together)) for k in order], schema)


def apart_share(pairs: DataFrame) -> DataFrame:
    """One row, ``(n_pairs, ncp)``: of the pairs of :func:`kept_apart` that the section can judge, the share that stays apart."""
    return pairs.filter("apart IS NOT NULL").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(F.col("apart").cast("double")).alias("ncp"))
