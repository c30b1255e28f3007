"""How far a cell's label can be trusted: confidence and verdict, reasons of rejection, self-verification, ledger.

Frames are keyed by ``cell``; scores are long, ``scores(cell, marker_set, score)``. What is joined to every row is a table
of marker sets or types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissueflow.operators.labels import ABSTAIN
from tissueflow.operators.ranks import percentiles, sums_before

#: Limits of the verdicts, and of the quality of a cell.
FAIL_BELOW, WARN_BELOW, CONTROL_MAX, GENES_RICH, RICH_PANEL, GENES_POOR = 0.25, 0.5, 5.0, 15, 1000, 5
#: Reasons in order of precedence, with their texts.
REASONS = {
    "poor_segmentation": "The cell's area is implausible for one cell.",
    "too_few_counts": "Too few transcripts were counted in the cell.",
    "too_few_genes": "Too few genes were seen in the cell.",
    "spatial_doublet": "Signals of two cells overlap here.",
    "mixed_lineages": "Markers of two or more lineages are present.",
    "high_background": "Too large a share of counts falls on control probes.",
    "panel_cannot_separate": "The panel can't tell the type from another.",
    "panel_cannot_resolve": "The panel has few markers of the type.",
    "novel_unknown": "No known type fits.",
    "method_disagreement": "The annotation methods disagree.",
    "spatially_incoherent": "Few neighbours are of the same type.",
    "low_margin": "The best two types score alike.",
}
COUNT_FLOOR, GENE_FLOOR, SIGNAL_FLOOR, COHERENCE_FLOOR, AGREEMENT_FLOOR, TRUSTED_METHODS = 10, 5, 0.7, 0.2, 0.5, 3
LIGHT_CEILING = {"green": 1.0, "amber": 0.6, "red": 0.0}


def best_two(scores: DataFrame, z_limit: float = 1.0) -> DataFrame:
    """``(cell, best, top1, top2, margin, n_high)``: the best set and score (ties by name), the runner-up's score (0 if
    none), and the number of sets whose score is over ``z_limit`` population spreads above its mean over cells."""
    stats = scores.groupBy("marker_set").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    high = F.coalesce((F.col("score") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0)) > z_limit, F.lit(False))
    rows = scores.join(F.broadcast(stats), "marker_set").groupBy("cell").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "marker_set"))).alias("all"), F.count_if(high).alias("n_high"))
    top2 = F.coalesce(-F.get("all", F.lit(1))["order"], F.lit(0.0))
    return rows.select("cell", F.col("all")[0]["marker_set"].alias("best"), (-F.col("all")[0]["order"]).alias("top1"), top2.alias("top2"), (-F.col("all")[0]["order"] - top2).alias("margin"), "n_high")


def _factor(name: str, low: float, columns: list[str]) -> list[Column]:
    return [low + (1 - low) * F.coalesce(F.col(name), F.lit(1.0))] if name in columns else []


def confidence(cells: DataFrame, scores: DataFrame, lights: DataFrame, n_panel: int, floor: float = COUNT_FLOOR, use_calibrated: bool = False) -> DataFrame:
    """``cells`` with ``best, margin, impure, confidence, verdict, reason, final_label``.

    ``cells(cell, label, total, n_genes, pct_control, ...)``; columns that count if present: pmp, coherence, vsi,
    stability (a flip rate), scanvi_weight, rctd_weight, agreement with n_methods, conflict, calibrated.
    ``lights(marker_set, light)`` is the panel's coverage. The margin's logistic over its spread is lessened by
    contamination, by what the panel can resolve, by the mean of the soft factors, and by disagreement of three or more
    methods. Nulls are neutral. Cells without any score fail with confidence 0. Low-signal cells fail.
    """
    have = cells.columns
    top = best_two(scores)
    spread = top.agg(F.stddev_pop("margin").alias("__sd"))
    ceiling = F.create_map(*(F.lit(x) for kv in LIGHT_CEILING.items() for x in kv))
    known = lights.select(F.col("marker_set").alias("best"), F.element_at(ceiling, F.col("light")).alias("__ceiling"))
    t = cells.join(top.select("cell", "best", "margin", (F.col("n_high") >= 2).alias("impure")), "cell", "left").join(F.broadcast(known), "best", "left").crossJoin(F.broadcast(spread))
    posterior = 1 / (1 + F.exp(-F.col("margin") / (F.coalesce(F.col("__sd"), F.lit(0.0)) + 1e-9)))
    control = F.greatest(F.least(F.coalesce(F.col("pct_control"), F.lit(0.0)) / CONTROL_MAX, F.lit(1.0)), F.lit(0.0))
    contam = F.greatest(control, 0.5 * F.coalesce(F.col("impure"), F.lit(False)).cast("double"))
    cap = F.coalesce(F.col("__ceiling"), F.lit(1.0))
    soft = _factor("pmp", 0.7, have)
    if "coherence" in have:
        doubtful = F.coalesce(F.col("impure"), F.lit(False)) | (F.coalesce(F.col("vsi"), F.lit(1.0)) < SIGNAL_FLOOR if "vsi" in have else F.lit(False))
        soft += [F.when(doubtful, 0.7 + 0.3 * F.coalesce(F.col("coherence"), F.lit(1.0))).otherwise(1.0)]
    if "stability" in have:
        soft += [1 - 0.35 * F.coalesce(F.col("stability"), F.lit(0.0))]
    soft += _factor("scanvi_weight", 0.7, have) + _factor("rctd_weight", 0.7, have)
    mean_soft = sum(soft, F.lit(0.0)) / len(soft) if soft else F.lit(1.0)
    score = F.when(posterior.isNotNull(), F.greatest(F.least(posterior * (1 - contam) * cap, F.lit(1.0)), F.lit(0.0))) * mean_soft
    if {"agreement", "n_methods"} <= set(have):
        score = score * F.when(F.coalesce(F.col("n_methods"), F.lit(0)) >= TRUSTED_METHODS, 0.5 + 0.5 * F.coalesce(F.col("agreement"), F.lit(1.0))).otherwise(1.0)
    t = t.withColumn("confidence", F.coalesce(score, F.lit(0.0)))
    low = (F.coalesce(F.col("total"), F.lit(0)) < floor) | (F.coalesce(F.col("n_genes"), F.lit(0)) < (GENES_RICH if n_panel >= RICH_PANEL else GENES_POOR))
    gate = F.coalesce(F.col("calibrated"), F.col("confidence")) if use_calibrated and "calibrated" in have else F.col("confidence")
    conflict = F.coalesce(F.col("conflict"), F.lit(False)) if "conflict" in have else F.lit(False)
    verdict = F.when(low | (gate < FAIL_BELOW), "FAIL").when((gate < WARN_BELOW) | conflict, "WARN").otherwise("PASS")
    failed = F.when(cap == 0, "unresolvable_panel").when(contam >= 0.5, "ambiguous_mixed").otherwise("uncertain_lowconf")
    reason = F.when(low, "low_quality").when(conflict, "label_conflict").when(verdict == "FAIL", failed).otherwise("")
    names = F.create_map(*(F.lit(x) for kv in ABSTAIN.items() for x in kv))
    out = t.withColumn("verdict", verdict).withColumn("reason", reason)
    final = F.when(F.col("verdict") == "FAIL", F.element_at(names, F.col("reason"))).otherwise(F.col("label"))
    return out.withColumn("final_label", final).drop("__ceiling", "__sd")


def rejection_reasons(judged: DataFrame, lights: DataFrame, confusable: DataFrame | None = None, floor: float = COUNT_FLOOR) -> DataFrame:
    """``judged`` (see :func:`confidence`) with ``rejection`` and ``detail`` for cells whose verdict isn't PASS, else
    empty and null.

    The first reason that holds, in the order of REASONS, else what the verdict's own reason says; columns that aren't there (area_flag, vsi, coherence,
    agreement) give no reason. ``lights(label, light)`` and ``confusable(a, b)`` are over the labels.
    """
    have = judged.columns
    has = lambda c, test, default: F.coalesce(test, F.lit(default)) if c in have else F.lit(False)
    t = judged.join(F.broadcast(lights.select(F.col("label").alias("__l"), F.col("light").alias("__light"))), F.col("label") == F.col("__l"), "left")
    if confusable is not None:
        both = confusable.select("a", "b").union(confusable.select("b", "a")).groupBy(F.col("a").alias("__a")).agg(F.min("b").alias("__partner"))
        t = t.join(F.broadcast(both), F.col("label") == F.col("__a"), "left").drop("__a")
    else:
        t = t.withColumn("__partner", F.lit(None).cast("string"))
    tests = {
        "poor_segmentation": has("area_flag", F.col("area_flag").isin("small", "large") if "area_flag" in have else None, False),
        "too_few_counts": F.coalesce(F.col("total"), F.lit(0)) < max(floor, COUNT_FLOOR),
        "too_few_genes": F.coalesce(F.col("n_genes"), F.lit(0)) < GENE_FLOOR,
        "spatial_doublet": has("vsi", F.col("vsi") < SIGNAL_FLOOR if "vsi" in have else None, False),
        "mixed_lineages": has("impure", F.col("impure") if "impure" in have else None, False),
        "high_background": has("pct_control", F.col("pct_control") > CONTROL_MAX if "pct_control" in have else None, False),
        "panel_cannot_separate": F.col("__partner").isNotNull(),
        "panel_cannot_resolve": F.coalesce(F.col("__light"), F.lit("green")).isin("red", "amber"),
        "novel_unknown": F.col("reason") == "novel",
        "method_disagreement": has("agreement", (F.col("agreement") < AGREEMENT_FLOOR) & (F.col("n_methods") >= TRUSTED_METHODS) if {"agreement", "n_methods"} <= set(have) else None, False),
        "spatially_incoherent": has("coherence", F.col("coherence") < COHERENCE_FLOOR if "coherence" in have else None, False),
    }
    coarse = F.when(F.col("reason") == "unresolvable_panel", "panel_cannot_resolve").when(F.col("reason") == "ambiguous_mixed", "mixed_lineages")
    code = F.coalesce(*(F.when(test, name) for name, test in tests.items()), coarse, F.lit("low_margin"))
    t = t.withColumn("rejection", F.when(F.col("verdict") == "PASS", "").otherwise(code))
    say = lambda form, *c: F.format_string(form, *c)
    detail = (
        F.when(F.col("rejection") == "too_few_counts", say(f"%.0f counts, at least {max(floor, COUNT_FLOOR):g} are needed", F.coalesce(F.col("total"), F.lit(0)).cast("double")))
        .when(F.col("rejection") == "too_few_genes", say(f"%d genes, at least {GENE_FLOOR} are needed", F.coalesce(F.col("n_genes"), F.lit(0)).cast("long")))
        .when(F.col("rejection") == "high_background", say(f"%.1f %% of counts on controls, over {CONTROL_MAX:g} %%", (F.coalesce(F.col("pct_control"), F.lit(0.0)) if "pct_control" in have else F.lit(0.0)).cast("double")))
        .when(F.col("rejection") == "panel_cannot_separate", say("%s and %s have no marker of their own", F.col("label"), F.col("__partner")))
        .when(F.col("rejection") == "panel_cannot_resolve", say("the panel's coverage of %s is %s", F.col("label"), F.col("__light")))
    )
    texts = F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))
    detail = F.when(F.col("rejection") != "", F.coalesce(detail, F.element_at(texts, F.col("rejection"))))
    return t.withColumn("detail", detail).drop("__l", "__light", "__partner")


def rejection_breakdown(reasoned: DataFrame) -> DataFrame:
    """``(rejection, n, share, description)`` of the cells without a verdict PASS, the commonest first."""
    n = reasoned.filter("rejection <> ''").groupBy("rejection").agg(F.count(F.lit(1)).alias("n"))
    texts = F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))
    total = n.agg(F.sum("n").alias("__t"))
    return n.crossJoin(F.broadcast(total)).select("rejection", "n", (F.col("n") / F.col("__t")).alias("share"), F.element_at(texts, F.col("rejection")).alias("description")).orderBy(F.desc("n"), "rejection")


def verdict_summary(judged: DataFrame, warn: float = 0.25, fail: float = 0.5) -> DataFrame:
    """One row: shares of the verdicts, mean confidence, share of label conflicts, and whether the output is usable."""
    share = lambda v: F.avg((F.col("verdict") == v).cast("double"))
    out = judged.agg(F.count(F.lit(1)).alias("n"), share("PASS").alias("share_pass"), share("WARN").alias("share_warn"), share("FAIL").alias("share_fail"), F.avg("confidence").alias("mean_confidence"), F.avg((F.col("reason") == "label_conflict").cast("double")).alias("share_conflict"))
    return out.withColumn("usability", F.when(F.col("share_fail") > fail, "fail").when(F.col("share_fail") > warn, "warn").otherwise("ok"))


def confidence_by_type(judged: DataFrame, least: int = 10, top: int = 12) -> DataFrame:
    """Quartiles of the confidence of the ``top`` commonest types of ``least`` cells and more."""
    q = judged.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *(F.percentile("confidence", F.lit(p)).alias(f"q{int(100 * p)}") for p in (0.25, 0.5, 0.75))).filter(F.col("n") >= least)
    return q.orderBy(F.desc("n"), "label").limit(top)


def missing_types(lights: DataFrame, cells: DataFrame) -> DataFrame:
    """Types of green coverage that no cell has: ``lights(label, light)`` against ``cells(label)``."""
    return lights.filter("light = 'green'").select("label").join(cells.select("label").distinct(), "label", "left_anti")


def one_against_rest(values: DataFrame, digits: int = 6) -> DataFrame:
    """``(type, n_pos, n_neg, auc, cohen_d)`` of ``values(type, score, positive)``: the chance that a positive scores above
    a negative, ties as half, scores rounded to ``digits``. Null without both kinds."""
    p = F.col("positive").cast("double")
    by = values.groupBy("type", F.round("score", digits).alias("s")).agg(F.sum(p).alias("pos"), F.sum(1 - p).alias("neg"))
    won = sums_before(by, "type", "s", "neg", "below").withColumn("won", F.col("pos") * (F.col("below") + F.col("neg") / 2)).groupBy("type").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("won").alias("won"))
    at = lambda k: F.when(F.col("positive") == k, F.col("score"))
    moments = values.groupBy("type").agg(*(f(at(k)).alias(f"{n}{int(k)}") for k in (True, False) for n, f in (("m", F.avg), ("v", F.var_samp))))
    pooled = F.sqrt(((F.col("n_pos") - 1) * F.col("v1") + (F.col("n_neg") - 1) * F.col("v0")) / (F.col("n_pos") + F.col("n_neg") - 2))
    return won.join(moments, "type").select("type", F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"), (F.col("won") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0.0))).alias("auc"), ((F.col("m1") - F.col("m0")) / F.nullif(pooled, F.lit(0.0))).alias("cohen_d"))


def identifiability(cells: DataFrame, scores: DataFrame, programs: DataFrame) -> DataFrame:
    """:func:`one_against_rest` of each type's own program: ``programs(label, marker_set)``, ``cells(cell, label)``."""
    own = scores.select("cell", "marker_set", "score").join(F.broadcast(programs.select(F.col("label").alias("type"), "marker_set")), "marker_set").join(cells.select("cell", "label"), "cell")
    return one_against_rest(own.select("type", "score", F.coalesce(F.col("label") == F.col("type"), F.lit(False)).alias("positive")))


def self_verify(cells: DataFrame, scores: DataFrame, programs: DataFrame, lights: DataFrame, confusable: DataFrame | None = None, least: int = 20, placed: DataFrame | None = None) -> DataFrame:
    """``(label, n, agreement, own_is_top, auc, confused_with, confused_share, status, cause, merge_target)`` a type.

    A type without a program is unscoreable, one of fewer than ``least`` cells is skipped. It fails where under half of
    its cells score highest on its own program and that program isn't the highest on average or separates at under 0.6.
    Causes in order: a confusable partner (panel_gap; with ``placed``, of :func:`grouping.compartments`, one of no other
    compartment, and low_signal where all are of others), one other program that takes half of the misses (mislabel), weak
    coverage or separation near chance (low_signal), else heterogeneous.
    """
    top = best_two(scores).select("cell", "best")
    t = cells.select("cell", "label").join(F.broadcast(programs.select("label", F.col("marker_set").alias("own"))), "label", "left").join(top, "cell", "left")
    size = t.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own"), F.avg(F.coalesce(F.col("best") == F.col("own"), F.lit(False)).cast("double")).alias("agreement"))
    misses = t.filter(F.col("best") != F.col("own")).groupBy("label", "best").agg(F.count(F.lit(1)).alias("m"))
    worst = misses.groupBy("label").agg(F.max_by("best", F.struct("m", F.hash("best"))).alias("confused_set"), (F.max("m") / F.sum("m")).alias("confused_share"))
    means = scores.select("cell", "marker_set", "score").join(cells.select("cell", "label"), "cell").groupBy("label", "marker_set").agg(F.round(F.avg("score"), 9).alias("mean"))
    ahead = means.groupBy("label").agg(F.max_by("marker_set", F.struct("mean", F.hash("marker_set"))).alias("mean_top"))
    names = programs.groupBy(F.col("marker_set").alias("confused_set")).agg(F.min("label").alias("confused_with"))
    pairs = None
    if confusable is not None:
        from tissueflow.operators.grouping import mergeable

        known = confusable.select("a", "b") if placed is None else mergeable(confusable.select("a", "b"), placed)
        known = known.withColumn("ok", F.lit(True) if placed is None else F.coalesce("mergeable", F.lit(True))).select("a", "b", "ok")
        pairs = known.union(known.select("b", "a", "ok")).groupBy(F.col("a").alias("label")).agg(F.min(F.when(F.col("ok"), F.col("b"))).alias("merge_target"), F.lit(True).alias("__paired"))
    out = size.join(worst, "label", "left").join(ahead, "label", "left").join(F.broadcast(names), "confused_set", "left").join(identifiability(cells, scores, programs).select(F.col("type").alias("label"), "auc"), "label", "left").join(F.broadcast(lights.select("label", "light")), "label", "left")
    out = out.join(F.broadcast(pairs), "label", "left") if pairs is not None else out.withColumn("merge_target", F.lit(None).cast("string")).withColumn("__paired", F.lit(None).cast("boolean"))
    own_top = F.coalesce(F.col("mean_top") == F.col("own"), F.lit(False))
    failed = (F.col("agreement") < 0.5) & (~own_top | (F.coalesce("auc", F.lit(0.0)) < 0.6))
    status = F.when(F.col("own").isNull(), "unscoreable").when(F.col("n") < least, "skipped_small").when(failed, "fail").otherwise("ok")
    cause = F.when(F.col("merge_target").isNotNull(), "panel_gap").when(F.coalesce("__paired", F.lit(False)), "low_signal").when(~own_top & (F.col("confused_share") >= 0.5), "mislabel").when(F.coalesce("light", F.lit("green")).isin("red", "amber") | (F.coalesce("auc", F.lit(0.0)) <= 0.55), "low_signal").otherwise("heterogeneous")
    return out.select("label", "n", "agreement", own_top.alias("own_is_top"), "auc", "confused_with", "confused_share", status.alias("status"), F.when(status == "fail", cause).alias("cause"), "merge_target")


#: What to do about a cause: order, action, and whether it only is advice.
ACTIONS = (("panel_gap", 0, "merge", True), ("heterogeneous", 1, "subcluster", False), ("low_signal", 2, "abstain", False), ("mislabel", 3, "abstain", False), ("mislabel", 3, "relabel", True))


def remediation_plan(verified: DataFrame) -> DataFrame:
    """``(place, label, cause, action, advisory, partner)`` for the types that failed, in the order of ACTIONS."""
    actions = F.array(*(F.struct(F.lit(c).alias("cause"), F.lit(p).alias("place"), F.lit(a).alias("action"), F.lit(v).alias("advisory")) for c, p, a, v in ACTIONS))
    t = verified.filter("status = 'fail'").withColumn("x", F.explode(F.filter(actions, lambda x: x["cause"] == F.col("cause"))))
    partner = F.when(F.col("x.action") == "merge", F.col("merge_target")).when(F.col("x.action") == "relabel", F.col("confused_with"))
    return t.select(F.col("x.place").alias("place"), "label", "cause", F.col("x.action").alias("action"), F.col("x.advisory").alias("advisory"), partner.alias("partner")).orderBy("place", "label", "action")


def abstain_mislabelled(cells: DataFrame, scores: DataFrame, programs: DataFrame, label: str, instead: str = ABSTAIN["uncertain_lowconf"]) -> DataFrame:
    """``cells`` where those of one type that score highest on another program have no type."""
    t = cells.join(best_two(scores).select("cell", "best"), "cell", "left").join(F.broadcast(programs.select("label", F.col("marker_set").alias("__own"))), "label", "left")
    gone = (F.col("label") == label) & (F.col("best") != F.col("__own"))
    return t.withColumn("label", F.when(gone, instead).otherwise(F.col("label"))).select(*cells.columns)


def typability(coverage: DataFrame, separation: DataFrame | None = None, matched: DataFrame | None = None, sizes: DataFrame | None = None, auc_min: float = 0.7, least: int = 50) -> DataFrame:
    """``(label, typable, basis, score, weak, n_present, n)``, those that can't be typed first.

    The strongest evidence counts: ``matched(label, f1, tier)`` of a reference; else ``separation(type, auc)`` of at least
    ``auc_min`` with ``least`` cells; else ``coverage(label, n_markers, n_present)``, which is weak. A type of which the
    panel has no marker never is typable.
    """
    t = coverage.select("label", "n_markers", "n_present")
    none = lambda c, k: F.lit(None).cast(k).alias(c)
    t = t.join(separation.select(F.col("type").alias("label"), "auc"), "label", "full") if separation is not None else t.select("*", none("auc", "double"))
    t = t.join(matched.select("label", "f1", "tier"), "label", "full") if matched is not None else t.select("*", none("f1", "double"), none("tier", "string"))
    t = t.join(sizes.select("label", "n"), "label", "left") if sizes is not None else t.select("*", none("n", "long"))
    enough = (F.coalesce("n", F.lit(0)) >= least) if sizes is not None else F.lit(True)
    basis = F.when(F.col("f1").isNotNull(), "depth_matched_f1").when(F.col("auc").isNotNull(), "identifiability_auc").otherwise("coverage_only")
    ok = F.when(basis == "depth_matched_f1", F.col("tier") == "resolvable").when(basis == "identifiability_auc", (F.col("auc") >= auc_min) & enough).otherwise((F.coalesce("n_present", F.lit(0)) >= 3) & enough)
    ok = F.coalesce(ok, F.lit(False)) & (F.coalesce("n_present", F.lit(-1)) != 0)
    score = F.round(F.coalesce("f1", "auc", F.col("n_present") / F.nullif(F.col("n_markers"), F.lit(0))), 3)
    weak = F.when(basis == "depth_matched_f1", False).when(basis == "identifiability_auc", ~enough).otherwise(True)
    return t.select("label", ok.alias("typable"), basis.alias("basis"), score.alias("score"), weak.alias("weak"), "n_present", "n").orderBy("typable", "score", "label")


def trust_ledger(verified: DataFrame, typable: DataFrame, agreement: DataFrame | None = None, argmax_min: float = 0.5, agree_min: float = 0.5, least: int = 50) -> DataFrame:
    """``(label, n, resolvable, coherent, agreed, cause, flags)`` of types of ``least`` cells and more, most flags first.

    ``agreement(label, agreed)`` is the mean agreement of methods; a type that is coherent but disputed by them may be
    a whole cluster of a wrong label.
    """
    t = verified.filter(F.col("n") >= least).join(typable.select("label", F.col("typable").alias("resolvable")), "label", "left")
    t = t.join(agreement.select("label", "agreed"), "label", "left") if agreement is not None else t.withColumn("agreed", F.lit(None).cast("double"))
    own, disputed = F.col("agreement"), F.col("agreed") < agree_min
    flags = F.array_compact(F.array(F.when(~F.col("resolvable"), "unresolvable"), F.when(own < argmax_min, "markers_dispute"), F.when(disputed, "methods_dispute"), F.when((own >= argmax_min) & disputed, "coherent_but_disputed")))
    return t.select("label", "n", "resolvable", F.round(own, 2).alias("coherent"), F.round("agreed", 2).alias("agreed"), "cause", flags.alias("flags")).orderBy(F.desc(F.size("flags")), F.desc("n"), "label")


def vote(votes: DataFrame, weights: DataFrame | None = None, prefer: DataFrame | None = None) -> DataFrame:
    """``(cell, label, weight, n_votes, n_methods, agreement)``: the winner of ``votes(cell, method, label)``.

    Each method counts once, or by ``weights(method, weight)`` (0 where it has none). Ties within 1e-12 go to the cell's
    label in ``prefer(cell, label)`` if it is among them, else to the first name. The agreement is the winner's share of
    methods, always unweighted. Missing votes don't count; a cell without any has no row.
    """
    from tissueflow.operators.labels import is_missing_vote

    v = votes.filter(~is_missing_vote(F.col("label"))).dropDuplicates(["cell", "method"])
    v = v.join(F.broadcast(weights.select("method", "weight")), "method", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))) if weights is not None else v.withColumn("weight", F.lit(1.0))
    tally = v.groupBy("cell", "label").agg(F.round(F.sum("weight"), 12).alias("weight"), F.count(F.lit(1)).alias("n_votes"))
    tally = tally.join(prefer.select("cell", F.col("label").alias("__own")), "cell", "left") if prefer is not None else tally.withColumn("__own", F.lit(None).cast("string"))
    first = F.struct((-F.col("weight")).alias("order"), (~F.coalesce(F.col("label") == F.col("__own"), F.lit(False))).alias("other"), "label", "n_votes")
    won = tally.groupBy("cell").agg(F.min(first).alias("w"), F.sum("n_votes").alias("n_methods"))
    return won.select("cell", F.col("w.label").alias("label"), (-F.col("w.order")).alias("weight"), F.col("w.n_votes").alias("n_votes"), "n_methods", (F.col("w.n_votes") / F.col("n_methods")).alias("agreement"))


def reliability_bin(agreement: Column, n_methods: Column) -> Column:
    return F.when(n_methods < 2, "single").when(agreement >= 0.9, "very_high").when(agreement >= 0.7, "high").when(agreement >= 0.5, "moderate").otherwise("low")


def reliability(votes: DataFrame, truth: DataFrame) -> DataFrame:
    """``(method, n, reliability)``: how often each method's vote is the cell's true label, where both are known."""
    t = votes.join(truth.select("cell", F.col("label").alias("__true")), "cell").filter("label IS NOT NULL AND __true IS NOT NULL")
    return t.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("__true")).cast("double")).alias("reliability"))


def dominant_state(scores: DataFrame, min_z: float = 1.0) -> DataFrame:
    """``(cell, state, z)``: the state whose score is most population spreads above its mean, if at least ``min_z``."""
    stats = scores.groupBy("marker_set").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    z = F.coalesce((F.col("score") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0)), F.lit(0.0))
    best = scores.join(F.broadcast(stats), "marker_set").withColumn("z", F.round(z, 9)).groupBy("cell").agg(F.min(F.struct((-F.col("z")).alias("order"), "marker_set")).alias("b"))
    return best.select("cell", F.when(-F.col("b.order") >= min_z, F.col("b.marker_set")).alias("state"), (-F.col("b.order")).alias("z"))


def malignant_scores(lineage: DataFrame, limit: float = 0.6) -> DataFrame:
    """``(cell, malignant_score, malignant)`` of ``lineage(cell, score)``: scaled between the 1st and 99th percentiles and clipped."""
    q = percentiles(lineage, "score", lo=0.01, hi=0.99)
    s = F.greatest(F.least((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9), F.lit(1.0)), F.lit(0.0))
    return lineage.crossJoin(F.broadcast(q)).select("cell", s.alias("malignant_score"), (s > limit).alias("malignant"))


def state_by_type(cells: DataFrame, scores: DataFrame) -> DataFrame:
    """``(label, marker_set, mean, n)``: mean score of each state in each type; abstentions are left out."""
    from tissueflow.operators.labels import is_abstention

    typed = cells.filter(~is_abstention(F.col("label"))).select("cell", "label")
    return scores.select("cell", "marker_set", "score").join(typed, "cell").groupBy("label", "marker_set").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))
