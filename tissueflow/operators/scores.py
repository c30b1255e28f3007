"""Weights of genes in marker sets and their control genes as a Spark plan; ``statements.WEIGHTS`` is the same in SQL, in which one
task ranks all genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissueflow.operators.ranks import positions, tile
from tissueflow.operators.statements import METRICS, NORMALISED, SCORES, WEIGHTS
from tissueflow.sources.section import Section

BINS, CONTROLS = 25, 50


def control_weights(binned: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(*keys, marker_set, gene, w)`` of ``binned(*keys, gene, marker_set, bin)``: 1 / n for a set's genes, -1 / n for its controls, of
    each bin that holds a gene of the set the CONTROLS genes of other sets with the least hash.

    Those of a bin are among the first CONTROLS of each set, so no more are met with the other sets.
    """
    size = lambda by: F.count(F.lit(1)).over(Window.partitionBy(*by))
    hashed = F.row_number().over(Window.partitionBy(*keys, "bin", "marker_set").orderBy(F.md5(F.col("gene").cast("string")), "gene"))
    first = binned.withColumn("place", hashed).filter(F.col("place") <= CONTROLS).select(*keys, "bin", "gene", F.col("marker_set").alias("__own"))
    other = binned.select(*keys, "marker_set", "bin").distinct().join(first, [*keys, "bin"]).filter("marker_set <> __own")
    place = F.row_number().over(Window.partitionBy(*keys, "marker_set", "bin").orderBy(F.md5(F.col("gene").cast("string")), "gene"))
    control = other.withColumn("place", place).filter(F.col("place") <= CONTROLS)
    own_n = binned.groupBy(*keys, "marker_set").agg(F.count(F.lit(1)).alias("n"))
    own = binned.join(F.broadcast(own_n), [*keys, "marker_set"]).select(*keys, "marker_set", "gene", (F.lit(1.0) / F.col("n")).alias("w"))
    return own.union(control.select(*keys, "marker_set", "gene", (F.lit(-1.0) / size((*keys, "marker_set"))).alias("w")))


def weights(section: Section) -> DataFrame:
    section.keep("counts", "genes")
    mean = section.once(NORMALISED).groupBy("gene").agg(F.sum("v").alias("v"))
    t = section["genes"].filter("NOT control").join(mean, "gene", "left").select("gene", "marker_set", F.round(F.coalesce("v", F.lit(0.0)), 6).alias("v"))
    ranked, n = positions(t, "v", "gene")
    return control_weights(ranked.select("gene", "marker_set", tile(F.col("position"), n, BINS).alias("bin")))


#: Parts of statements that Spark makes by a plan of its own: SQL, name of the frame, maker.
PARTS = ((WEIGHTS, "weights", weights),)
#: Parts that many statements share, those first that hold others: SQL, name of the frame.
SHARED = ((METRICS, "metrics"), (SCORES, "scores"), (NORMALISED, "normalised"))
