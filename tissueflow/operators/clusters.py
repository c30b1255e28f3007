"""Clusters of a section's cells from their counts, and subclusters of one type."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissueflow.durable import saved
from tissueflow.operators.embedding import cell_vectors
from tissueflow.operators.graph import K, communities, nearest_vectors, relabelled, symmetric
from tissueflow.operators.trust import GENES_RICH, RICH_PANEL

#: A type of fewer cells isn't divided.
LEAST = 20


@dataclass
class Clusters:
    """``cells(cell, cluster, low_signal, embedding)`` and the ranking of each cluster's genes, ``markers(cluster, place, gene, t)``."""

    cells: DataFrame
    markers: DataFrame


def ranked_genes(counts: DataFrame, groups: DataFrame, genes: DataFrame, top: int = 12) -> DataFrame:
    """``(cluster, place, gene, t)``: the ``top`` genes of greatest Welch t of each of ``groups(cell, cluster)`` against all others,
    over counts normalised to the groups' own median total. Zeros count through the numbers of cells."""
    own = counts.join(groups.select("cell", "cluster").filter("cluster IS NOT NULL"), "cell").join(genes.select("gene").distinct(), "gene").filter("value > 0")
    totals = own.groupBy("cell").agg(F.sum(F.col("value").cast("double")).alias("total"))
    target = totals.agg(F.percentile("total", F.lit(0.5)).alias("target"))
    v = own.join(totals, "cell").crossJoin(F.broadcast(target)).select("cluster", "gene", F.log1p(F.col("value") * F.col("target") / F.col("total")).alias("v"))
    s = v.groupBy("cluster", "gene").agg(F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2"))
    n = groups.filter("cluster IS NOT NULL").groupBy("cluster").agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy()))
    by = Window.partitionBy("gene")
    t = s.withColumn("r1", F.sum("s1").over(by) - F.col("s1")).withColumn("r2", F.sum("s2").over(by) - F.col("s2")).join(F.broadcast(n), "cluster").withColumn("m", F.col("all") - F.col("n"))
    var = lambda a, b, k: (F.col(b) - F.col(a) * F.col(a) / F.col(k)) / (F.col(k) - 1) / F.col(k)
    gap = (F.col("s1") / F.col("n") - F.col("r1") / F.col("m")) / F.nullif(F.sqrt(var("s1", "s2", "n") + var("r1", "r2", "m")), F.lit(0.0))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round("t", 9)), "gene"))
    return t.filter("n > 1 AND m > 1").withColumn("t", gap).filter("t IS NOT NULL").withColumn("place", place).filter(F.col("place") <= top).select("cluster", "place", "gene", "t")


def cell_clusters(counts: DataFrame, cells: DataFrame, genes: DataFrame, resolution: float = 0.5, axes: int = 50, k: int = K, top: int = 12, seed: int = 0) -> Clusters:
    """Communities of the neighbour graph of the cells' main axes, numbered from 0 by size, and their marker genes.

    Cells of low signal (fewer than 15 genes on a panel of 1000 and more, else without any) take no part: they have a null
    cluster and a vector of zeros. Where all cells are of low signal, all take part. A cell whose id repeats counts once.
    """
    cells = cells.filter("cell IS NOT NULL").select("cell").distinct()
    panel = genes.filter("NOT control")
    floor = GENES_RICH if panel.select("gene").distinct().count() >= RICH_PANEL else 1
    seen = counts.filter("value > 0").join(panel.select("gene").distinct(), "gene").groupBy("cell").agg(F.count_distinct("gene").alias("seen"))
    flagged = saved(cells.join(seen, "cell", "left").select("cell", (F.coalesce("seen", F.lit(0)) < floor).alias("low_signal")))
    if flagged.filter("NOT low_signal").isEmpty():
        flagged = flagged.withColumn("low_signal", F.lit(False))
    good = flagged.filter("NOT low_signal").select("cell")
    vectors = saved(cell_vectors(counts, good, panel, axes, seed=seed))
    edges = saved(symmetric(nearest_vectors(vectors, k, seed=seed)))
    found = saved(relabelled(communities(edges, resolution)))
    zeros = F.transform(F.sequence(F.lit(1), F.lit(vectors.agg(F.max(F.size("embedding"))).first()[0] or 1)), lambda _: F.lit(0.0))
    out = flagged.join(found.withColumnRenamed("node", "cell"), "cell", "left").join(vectors.withColumnRenamed("item", "cell"), "cell", "left")
    return Clusters(out.select("cell", "cluster", "low_signal", F.coalesce("embedding", zeros).alias("embedding")), ranked_genes(counts, found.withColumnRenamed("node", "cell"), panel, top))


def subclusters(counts: DataFrame, cells: DataFrame, genes: DataFrame, label: str, resolution: float = 0.1, **options) -> tuple[DataFrame, DataFrame]:
    """``(cells with subtype, (subcluster, n_cells, label, top_markers))``: the cells of one label are divided anew from their own
    counts. Others keep the ``subtype`` that they have, or null, so that results for several labels add up; cells of low
    signal keep the label itself. Raises where there are fewer than LEAST cells of the label."""
    own = cells.filter(F.col("label") == label)
    n = own.select("cell").distinct().count()
    if n < LEAST:
        raise ValueError(f"{n} cells of {label!r}, {LEAST} are needed")
    found = cell_clusters(counts, own, genes, resolution, **options)
    name = F.when(F.col("cluster").isNull(), label).otherwise(F.concat(F.lit(f"{label} subcluster "), F.col("cluster").cast("string")))
    new = found.cells.select("cell", name.alias("__new"))
    before = F.col("subtype") if "subtype" in cells.columns else F.lit(None).cast("string")
    out = cells.join(new, "cell", "left").withColumn("subtype", F.coalesce("__new", before)).drop("__new")
    genes_of = found.markers.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "gene"))), lambda x: x["gene"]).alias("top_markers"))
    table = found.cells.filter("cluster IS NOT NULL").groupBy("cluster").agg(F.count(F.lit(1)).alias("n_cells")).join(genes_of, "cluster", "left")
    return out, table.select(F.col("cluster").alias("subcluster"), "n_cells", F.concat(F.lit(f"{label} subcluster "), F.col("cluster").cast("string")).alias("label"), "top_markers")
