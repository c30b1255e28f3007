"""Labels of clusters from two sources, the markers and somebody's proposals, and the cells' labels that follow from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissueflow.operators.trust import vote

# What a proposal may say beside the vocabulary, and the label of cells without a cluster.
NOVEL, UNKNOWN, UNASSIGNED = "Novel / unknown", "Unknown", "Unassigned"


@dataclass
class Reconciled:
    """``clusters(cluster, marker_label, proposed, agreement, conflict, off_vocabulary, final)`` and ``cells`` with ``label``, ``conflict``
    and, where methods voted, ``agreement``."""

    clusters: DataFrame
    cells: DataFrame


def reconcile(cells: DataFrame, markers: DataFrame, vocabulary: DataFrame, proposals: DataFrame | None = None, votes: DataFrame | None = None, weights: DataFrame | None = None) -> Reconciled:
    """The label of each cluster of ``cells(cell, cluster)``.

    ``markers(cluster, label)`` is what the markers say; a proposal of ``proposals(cluster, label)`` names the cluster only where it is
    the same (in any case and spacing) or NOVEL: one that names another label of ``vocabulary(label)`` is a conflict, one
    that isn't in it is off the vocabulary, and in both the markers' label stays. A cluster that the markers don't know is
    UNKNOWN to them, and takes any proposal of the vocabulary. Of several proposals or labels for one cluster the first by
    name counts. Cells without a cluster are UNASSIGNED. With ``votes(cell, method, label)`` the cluster's label is one more
    vote of each cell, wins ties, and methods count by ``weights(method, weight)`` if given.
    """
    plain = lambda c: F.lower(F.trim(c))
    known = vocabulary.filter("label IS NOT NULL").select("label").union(vocabulary.sparkSession.createDataFrame([(NOVEL,)], "label string"))
    known = known.groupBy(plain(F.col("label")).alias("__key")).agg(F.min("label").alias("__named"))
    said = markers.filter("label IS NOT NULL").groupBy("cluster").agg(F.min("label").alias("marker_label"))
    t = cells.filter("cluster IS NOT NULL").select("cluster").distinct().join(said, "cluster", "left").withColumn("marker_label", F.coalesce("marker_label", F.lit(UNKNOWN)))
    if proposals is None:
        t = t.withColumn("proposed", F.lit(None).cast("string")).withColumn("__named", F.lit(None).cast("string"))
    else:
        one = proposals.filter("label IS NOT NULL").groupBy("cluster").agg(F.min("label").alias("proposed"))
        t = t.join(one, "cluster", "left").withColumn("__key", plain(F.col("proposed"))).join(F.broadcast(known), "__key", "left").drop("__key")  # clusters and labels are few
    named, marker = F.col("__named"), F.col("marker_label")
    conflict = named.isNotNull() & (marker != UNKNOWN) & (named != marker) & (named != NOVEL)
    off = F.col("proposed").isNotNull() & named.isNull()
    final = F.when(conflict | named.isNull(), marker).otherwise(named)
    table = t.select("cluster", "marker_label", "proposed", F.coalesce(named == marker, F.lit(False)).alias("agreement"), conflict.alias("conflict"), off.alias("off_vocabulary"), final.alias("final"))
    found = cells.drop("label", "conflict", "agreement").join(F.broadcast(table.select("cluster", F.col("final").alias("label"), "conflict")), "cluster", "left")
    found = found.withColumn("label", F.coalesce("label", F.lit(UNASSIGNED))).withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    if votes is not None:
        own = found.select("cell", "label")
        all_votes = votes.select("cell", "method", "label").union(own.select("cell", F.lit("cluster"), "label"))
        won = vote(all_votes, weights, own).select("cell", F.col("label").alias("__won"), "agreement")
        found = found.join(won, "cell", "left").withColumn("label", F.coalesce("__won", F.lit(UNASSIGNED))).drop("__won")
    return Reconciled(table, found)
