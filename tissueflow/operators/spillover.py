"""Counts that spilled over from neighbours, and warnings on what a panel can't tell apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissueflow.operators.grouping import gene_sharing


def spillover_removed(counts: DataFrame, cells: DataFrame, markers: DataFrame, edges: DataFrame) -> DataFrame:
    """``counts(cell, gene, value)`` with ``corrected``: 0 for a gene that only one lineage of ``markers(marker_set, gene)``
    has, in a cell of another lineage, or of none, with a neighbour of that one; else the value.

    ``cells(cell, lineage)``, ``edges(cell, neighbour)``; a lineage without cells takes nothing away. Rows stay as they
    are, repeated ones too; the lineages near each cell are gathered once, a small set a cell.
    """
    lineages = F.broadcast(cells.select(F.col("lineage").alias("own")).filter("own IS NOT NULL").distinct())
    private = gene_sharing(markers).filter("private").select("gene", F.col("marker_set").alias("own")).join(lineages, "own", "left_semi")
    of = cells.select(F.col("cell").alias("neighbour"), F.col("lineage").alias("near"))
    near = edges.join(of, "neighbour").filter("near IS NOT NULL").groupBy("cell").agg(F.collect_set("near").alias("near"))
    at = cells.select("cell", "lineage").dropDuplicates(["cell"]).join(near, "cell", "left").withColumnsRenamed({"lineage": "__lineage", "near": "__near"})
    out = counts.join(at, "cell", "left").join(private.withColumnRenamed("own", "__own"), "gene", "left")
    spilled = F.col("__own").isNotNull() & ~F.col("__own").eqNullSafe(F.col("__lineage")) & F.coalesce(F.array_contains("__near", F.col("__own")), F.lit(False))
    return out.select(*counts.columns, F.when(spilled, F.lit(0).cast(dict(counts.dtypes)["value"])).otherwise(F.col("value")).alias("corrected"))


def coexpression(corrected: DataFrame, cells: DataFrame, markers: DataFrame) -> DataFrame:
    """``(lineage, other, before, after)``: of a lineage's cells the share that hold a private marker of another one, by
    the counts as they were and as they are corrected. A pair without such a cell has no row."""
    private = gene_sharing(markers).filter("private").select("gene", F.col("marker_set").alias("other"))
    at = cells.filter("lineage IS NOT NULL").select("cell", "lineage")
    held = corrected.join(private, "gene").join(at, "cell").filter("other <> lineage").groupBy("lineage", "other", "cell").agg(F.sum("value").alias("v"), F.sum("corrected").alias("c"))
    n = at.groupBy("lineage").agg(F.count_distinct("cell").alias("n"))
    shares = held.groupBy("lineage", "other").agg(F.count_if(F.col("v") > 0).alias("b"), F.count_if(F.col("c") > 0).alias("a")).join(n, "lineage")
    return shares.filter("b > 0").select("lineage", "other", (F.col("b") / F.col("n")).alias("before"), (F.col("a") / F.col("n")).alias("after"))


def panel_warnings(coverage: DataFrame, pairs: DataFrame, cells: DataFrame, typable: DataFrame | None = None) -> DataFrame:
    """``(kind, label, other, n_present, n_markers, n_cells, message)``, most cells first: types of ``coverage(label, light,
    n_present, n_markers)`` that aren't green, unless ``typable(label)`` has them, and the confusable ``pairs(a, b)``, once each."""
    n = cells.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    weak = coverage.filter(F.col("light").isin("red", "amber"))
    weak = weak if typable is None else weak.join(typable.select("label").distinct(), "label", "left_anti")
    how = F.when(F.col("light") == "red", "too few to name the type").otherwise("which makes the type uncertain")
    text = F.format_string("%s: the panel has %d of its %d markers, %s", F.col("label"), F.col("n_present").cast("long"), F.col("n_markers").cast("long"), how)
    none = F.lit(None).cast("long")
    one = weak.join(n, "label", "left").select(F.lit("coverage").alias("kind"), "label", F.lit(None).cast("string").alias("other"), F.col("n_present").cast("long").alias("n_present"), F.col("n_markers").cast("long").alias("n_markers"), F.coalesce("n", F.lit(0)).cast("long").alias("n_cells"), text.alias("message"))
    p = pairs.select(F.least("a", "b").alias("label"), F.greatest("a", "b").alias("other")).filter("label <> other").distinct()
    both = p.join(n, "label", "left").join(n.toDF("other", "m"), "other", "left")
    said = F.format_string("%s and %s: no gene of the panel marks one of them alone, so take them as one type", F.col("label"), F.col("other"))
    two = both.select(F.lit("confusable"), "label", "other", none, none, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).cast("long"), said)
    return one.union(two).orderBy(F.desc("n_cells"), "kind", "label", "other")
