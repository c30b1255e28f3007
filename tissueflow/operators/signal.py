"""Quality of a section's signal, without labels: genes against controls in space and in counts, sparsity, entropy, density."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Added to both means of a signal ratio, so that cells without control counts have one; this library's own choice.
FLOOR = 0.01


def cell_signal(counts: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """``(cell, mean_ratio, max_ratio, sparsity, entropy, density)`` of every cell.

    ``counts(cell, gene, value)``, ``cells(cell, area)`` (the area may be missing or null: no density), ``genes(gene, control)``, the panel.
    Ratios are log2 of the mean (of the largest) gene count over the mean control count, zeros included; null without
    controls on the panel. Sparsity is the share of panel genes without counts. Entropy is Shannon's over the detected genes,
    over its largest; 0 for one gene, null for none. Density is gene counts by area, null where that isn't positive.
    Counts of unlisted genes and cells don't count; repeated rows add up, repeated cells keep their least area.
    """
    panel = genes.filter("gene IS NOT NULL").groupBy("gene").agg(F.max(F.coalesce("control", F.lit(False))).alias("control"))
    size = panel.agg(F.count_if(~F.col("control")).alias("n_panel"), F.count_if(F.col("control")).alias("n_controls"))
    area = F.min("area").cast("double") if "area" in cells.columns else F.lit(None).cast("double")
    each = cells.filter("cell IS NOT NULL").groupBy("cell").agg(area.alias("area"))
    k = counts.filter("cell IS NOT NULL AND value > 0").groupBy("cell", "gene").agg(F.sum("value").cast("double").alias("value")).join(panel, "gene")
    gene = F.when(~F.col("control"), F.col("value"))
    sums = k.groupBy("cell").agg(F.sum(gene).alias("total"), F.max(gene).alias("top"), F.count(gene).alias("n"), F.sum(F.when(F.col("control"), F.col("value"))).alias("noise"), F.sum(gene * F.log(gene)).alias("xlogx"))
    t = each.join(sums, "cell", "left").crossJoin(F.broadcast(size))
    total, n = F.coalesce("total", F.lit(0.0)), F.coalesce("n", F.lit(0))
    noise = F.coalesce("noise", F.lit(0.0)) / F.nullif(F.col("n_controls"), F.lit(0)) + FLOOR
    mean = total / F.nullif(F.col("n_panel"), F.lit(0))
    entropy = F.when(n == 1, 0.0).when(n > 1, (F.log("total") - F.col("xlogx") / F.col("total")) / F.log("n"))
    return t.select("cell", F.log2((mean + FLOOR) / noise).alias("mean_ratio"), F.log2((F.coalesce("top", F.lit(0.0)) + FLOOR) / noise).alias("max_ratio"), (1 - n / F.nullif(F.col("n_panel"), F.lit(0))).alias("sparsity"), entropy.alias("entropy"), F.when(F.col("area") > 0, total / F.col("area")).alias("density"))


def spatial_signal(moran: DataFrame, genes: DataFrame) -> DataFrame:
    """One row of ``moran(gene, moran)`` and ``genes(gene, control)``: how many genes and controls have a value, their medians, the
    difference of these, and the share of genes over the controls' 95th percentile; the last two, and the controls'
    median, are null without controls. Null and NaN values don't count."""
    t = moran.filter("moran IS NOT NULL AND NOT isnan(moran)").join(genes.select("gene", F.coalesce("control", F.lit(False)).alias("control")).distinct(), "gene")
    gene, control = F.when(~F.col("control"), F.col("moran")), F.when(F.col("control"), F.col("moran"))
    limit = t.agg(F.percentile(control, F.lit(0.95)).alias("limit"))
    found = t.crossJoin(F.broadcast(limit)).agg(F.count(gene).alias("n_genes"), F.count(control).alias("n_controls"), F.percentile(gene, F.lit(0.5)).alias("median_gene"), F.percentile(control, F.lit(0.5)).alias("median_control"), F.avg((gene > F.col("limit")).cast("double")).alias("share_above"))
    return found.withColumn("separation", F.col("median_gene") - F.col("median_control"))


def signal_summary(signal: DataFrame) -> DataFrame:
    """One row: the number of cells and the medians of :func:`cell_signal`, and the mean sparsity; null medians of an empty table."""
    columns = ("mean_ratio", "max_ratio", "entropy", "density")
    return signal.agg(F.count(F.lit(1)).alias("n_cells"), F.avg("sparsity").alias("zero_fraction"), *(F.percentile(c, F.lit(0.5)).alias(f"median_{c}") for c in columns))
