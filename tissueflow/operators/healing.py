"""A section that checks its own labels, applies what is safe, and checks again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissueflow.durable import forget, saved
from tissueflow.operators.clusters import LEAST, subclusters
from tissueflow.operators.grouping import merged_types
from tissueflow.operators.trust import abstain_mislabelled, remediation_plan, self_verify


@dataclass
class Healed:
    """``cells`` with their labels (and subtypes) afterwards; ``rounds(round, label, action, ok, n, error)``; ``advice``, what is left
    to a person; the labels that failed at first and in the end; and ``merged(label, merged)``, if labels were joined."""

    cells: DataFrame
    rounds: DataFrame
    advice: DataFrame
    failed_first: list
    failed_last: list
    merged: DataFrame | None


def self_heal(counts: DataFrame, cells: DataFrame, genes: DataFrame, scores: DataFrame, programs: DataFrame, lights: DataFrame, confusable: DataFrame | None = None, placed: DataFrame | None = None, rounds: int = 2, merge: bool = False, **options) -> Healed:
    """Verify the labels (:func:`trust.self_verify`), apply to each failing type the safe action of its cause, once a type and
    action, and verify again, in up to ``rounds`` rounds or until there is nothing to do.

    Safe are ``abstain`` (cells that score highest on another program lose the label) and ``subcluster`` (a heterogeneous type is
    divided, labels stay). Merging and relabelling are advice, but with ``merge`` confusable types of one compartment are
    joined first, and a joint label scores as the best of its members' programs. Cells lie in a saved table after each
    round; types and actions, which are few, are what the driver reads. ``options`` go to :func:`clusters.subclusters`.
    """
    spark, merged = cells.sparkSession, None
    if merge and confusable is not None:
        cells, merged = merged_types(cells, confusable.select("a", "b"), placed)
        merged = saved(merged)
        joint = programs.join(F.broadcast(merged), "label", "left").select("marker_set", F.coalesce("merged", "label").alias("label"), F.when(F.col("merged").isNull(), F.col("marker_set")).otherwise(F.col("merged")).alias("joint"))
        scores = scores.join(F.broadcast(joint.groupBy("marker_set").agg(F.min("joint").alias("joint"))), "marker_set", "left").groupBy("cell", F.coalesce("joint", "marker_set").alias("marker_set")).agg(F.max("score").alias("score"))
        programs = joint.groupBy("label").agg(F.min("joint").alias("marker_set"))
        lights = lights.join(F.broadcast(merged), "label", "left").groupBy(F.coalesce("merged", "label").alias("label")).agg(F.min("light").alias("light"))
        confusable = None
    cells, scores = saved(cells), saved(scores)
    verify = lambda: saved(self_verify(cells, scores, programs, lights, confusable, placed=placed))
    failing = lambda v: sorted(r["label"] for r in v.filter("status = 'fail'").select("label").collect())
    v, done, log = verify(), set(), []
    first = failing(v)
    for turn in range(1, rounds + 1):
        todo = [(r["label"], r["action"]) for r in remediation_plan(v).filter("NOT advisory").collect() if (r["label"], r["action"]) not in done]
        if not todo:
            break
        for label, action in todo:
            done.add((label, action))
            before, size = cells, cells.filter(F.col("label") == label).count()
            if action == "abstain":
                cells = saved(abstain_mislabelled(cells, scores, programs, label))
                gone = size - cells.filter(F.col("label") == label).count()
                log.append((turn, label, action, gone > 0, gone, None))
                forget(before)
            elif size < LEAST:
                log.append((turn, label, action, False, 0, f"{size} cells, {LEAST} are needed"))
            else:
                out, table = subclusters(counts, cells, genes, label, **options)
                cells = saved(out)
                log.append((turn, label, action, True, table.count(), None))
        forget(v)
        v = verify()
    advice = remediation_plan(v).filter("advisory")
    kind = dict(cells.dtypes)["label"]
    return Healed(cells, spark.createDataFrame(log, f"round int, label {kind}, action string, ok boolean, n long, error string"), advice, first, failing(v), merged)
