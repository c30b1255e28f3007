"""Whether a reference fits a panel, and what to do when it doesn't: one row a reference, then a ladder of remedies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissueflow.durable import saved
from tissueflow.operators.grouping import merge_map
from tissueflow.operators.labels import same_tissue
from tissueflow.operators.thinning import DEPTH, resolvability

# Limits of the verdicts, weights of the score, and what overlap a transfer needs.
GOOD, FAIR, NUDGE, FLOOR = (0.5, 0.5, 0.5), (0.3, 0.35), (0.3, 0.35, 0.3), 0.2
WEIGHTS = (0.5, 0.3, 0.2)
ACTIONS = {"good": "supervised_transfer", "fair": "coarsen_then_transfer", "poor": "unsupervised_clustering"}
RANK = {"poor": 0, "fair": 1, "good": 2}


def reference_match(resolved: DataFrame, n_panel: int, tissue: str | None = None, declared: DataFrame | None = None) -> DataFrame:
    """One row a reference of ``resolved`` (:func:`thinning.resolvability` with a column ``reference``): ``(reference, status, overlap,
    mean_f1, n_resolvable, n_types, share_resolvable, verdict, match_score, tissue_mismatch, action, poor_fit)``.

    ``declared(reference, tissue)`` says what a reference is made of: another organ than ``tissue`` overrides the action, whatever the
    verdict. A status that isn't ``ok`` is a poor match whose score is its overlap's part alone.
    """
    ok = F.col("status") == "ok"
    t = resolved.groupBy("reference").agg(F.min("status").alias("status"), F.max("n_shared").alias("n_shared"), F.avg("f1").alias("mean_f1"), F.count_if(F.col("tier") == "resolvable").alias("n_resolvable"), F.count("label").alias("n_types"))
    t = t.withColumn("overlap", F.col("n_shared") / F.lit(float(max(n_panel, 1)))).withColumn("share_resolvable", F.when(ok & (F.col("n_types") > 0), F.col("n_resolvable") / F.col("n_types")).otherwise(0.0)).withColumn("mean_f1", F.when(ok, F.coalesce("mean_f1", F.lit(0.0))))
    good = (F.col("overlap") >= GOOD[0]) & (F.col("mean_f1") >= GOOD[1]) & (F.col("share_resolvable") >= GOOD[2])
    fair = (F.col("overlap") >= FAIR[0]) & (F.col("mean_f1") >= FAIR[1])
    verdict = F.when(~ok, "poor").when(good, "good").when(fair, "fair").otherwise("poor")
    score = F.when(ok, WEIGHTS[0] * F.col("mean_f1") + WEIGHTS[1] * F.col("share_resolvable")).otherwise(0.0) + WEIGHTS[2] * F.col("overlap")
    poor = ~ok | (F.col("overlap") < NUDGE[0]) | (F.col("mean_f1") < NUDGE[1]) | (F.col("share_resolvable") < NUDGE[2])
    if tissue and declared is not None:
        t = t.join(F.broadcast(declared.select("reference", F.col("tissue").alias("__tissue"))), "reference", "left")
        other = F.coalesce(~same_tissue(F.lit(tissue), F.col("__tissue")), F.lit(False))
    else:
        other = F.lit(False)
    action = F.when(other, ACTIONS["poor"])
    for k, v in ACTIONS.items():
        action = action.when(verdict == k, v)
    return t.select("reference", "status", F.round("overlap", 3).alias("overlap"), F.round("mean_f1", 3).alias("mean_f1"), "n_resolvable", "n_types", F.round("share_resolvable", 3).alias("share_resolvable"), verdict.alias("verdict"), F.round(score, 3).alias("match_score"), other.alias("tissue_mismatch"), action.alias("action"), F.coalesce(poor, F.lit(True)).alias("poor_fit"))


@dataclass
class Reference:
    """A candidate: ``counts(cell, gene, value)`` and ``cells(cell, label)``, with the tissue that it declares."""

    name: str
    counts: DataFrame
    cells: DataFrame
    tissue: str | None = None


@dataclass
class Strategy:
    """``mode`` is reference_transfer or cluster; ``coarse`` maps labels where coarser ones helped; ``ladder`` has a row for each step."""

    mode: str
    reference: str
    verdict: str
    coarse: DataFrame | None
    ladder: DataFrame


def plan_strategy(first: Reference, panel: DataFrame, depth: float | None = None, tissue: str | None = None, others: tuple[Reference, ...] = (), rounds: int = 3, confused: float = 0.25) -> Strategy:
    """Score the reference; where it is fair or poor, with the labels joined that are confused at least so often; where it stays
    poor and the tissue is known, other candidates in their order, at most ``rounds``, until one isn't poor.

    A step counts only if its verdict, then its mean F1, is better. The plan branches on one row a step, which is all that
    the driver reads. Transfer is advised unless the best match is poor, has a status that isn't ok, shares under FLOOR of
    the panel, or comes from another organ.
    """
    spark, depth = panel.sparkSession, depth if depth and depth > 0 else DEPTH
    n_panel = panel.select("gene").distinct().count()
    steps = []

    def score(step: str, ref: Reference, cells: DataFrame):
        resolved = saved(resolvability(ref.counts, cells, panel, depth).withColumn("reference", F.lit(ref.name)))
        declared = spark.createDataFrame([(ref.name, ref.tissue)], "reference string, tissue string")
        row = reference_match(resolved, n_panel, tissue, declared).first()
        steps.append((len(steps), step, *row))
        return row, resolved

    better = lambda a, b: (RANK[a["verdict"]], a["mean_f1"] or -1.0) > (RANK[b["verdict"]], b["mean_f1"] or -1.0)
    best, resolved = score("initial", first, first.cells)
    coarse = None
    if best["status"] == "ok" and best["verdict"] != "good":
        names = saved(merge_map(resolved.select("label", "confused_with", F.col("confused_share").alias("share")), confused))
        if not names.filter("label <> merged").isEmpty():
            joined = first.cells.join(F.broadcast(names), "label").select("cell", F.col("merged").alias("label"))
            row, _ = score("coarsen", first, joined)
            if better(row, best):
                best, coarse = row, names.filter("label <> merged")
    if best["verdict"] == "poor" and tissue:
        for ref in others[:rounds]:
            row, _ = score("swap_reference", ref, ref.cells)
            if better(row, best):
                best, coarse = row, None
            if best["verdict"] != "poor":
                break
    cluster = best["tissue_mismatch"] or best["status"] != "ok" or best["overlap"] < FLOOR or best["verdict"] == "poor"
    kinds = "step int, kind string, reference string, status string, overlap double, mean_f1 double, n_resolvable long, n_types long, share_resolvable double, verdict string, match_score double, tissue_mismatch boolean, action string, poor_fit boolean"
    return Strategy("cluster" if cluster else "reference_transfer", best["reference"], best["verdict"], coarse, spark.createDataFrame(steps, kinds))
