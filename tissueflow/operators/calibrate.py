"""Calibration of confidences and agreement of labelings. Frames hold one row an item: ``confidence`` and ``correct``
(0/1), or a predicted and a true label. Everything but the isotonic fit is one or two grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def halves(items: DataFrame, key: str = "item", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two halves by the hash of a key, the same at each run: one to fit on, one to measure on."""
    low = F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), 1, 1) < "8"
    return items.filter(low), items.filter(~low)


def fit_isotonic(items: DataFrame):
    """A monotone curve from confidence to the share of correct items, by MLlib; rows of equal confidence are one point."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    points = items.groupBy("confidence").agg(F.avg("correct").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    return IsotonicRegression(weightCol="weight").fit(points.withColumn("features", array_to_vector(F.array(F.col("confidence").cast("double")))))


def apply_isotonic(model, items: DataFrame, column: str = "calibrated") -> DataFrame:
    """``items`` with the curve's value, clipped to 0..1; a column that is there already isn't overwritten."""
    from pyspark.ml.functions import array_to_vector

    if column in items.columns:
        raise ValueError(f"{column} is there already")
    out = model.transform(items.withColumn("features", array_to_vector(F.array(F.col("confidence").cast("double")))))
    return out.withColumn(column, F.greatest(F.least("prediction", F.lit(1.0)), F.lit(0.0))).drop("features", "prediction")


def calibration(items: DataFrame, bins: int = 10, confidence: str = "confidence") -> DataFrame:
    """One row ``(n, accuracy, brier, ece)``; equal-width bins, 1 in the last."""
    c = F.col(confidence)
    by = items.groupBy(F.least(F.floor(c * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("conf"), F.avg("correct").alias("acc"), F.sum("correct").alias("hits"), F.sum((c - F.col("correct")) ** 2).alias("sq"))
    return by.agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("accuracy"), (F.sum("sq") / F.sum("n")).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def abstention_gate(items: DataFrame, steps: int = 20, least: float = 0.1) -> DataFrame:
    """``(threshold, kept, share, accuracy, gain, useful)``: what stays at each threshold; one histogram and a running sum
    from above over its bins."""
    h = items.groupBy((F.floor(F.col("confidence") * steps) / steps).alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("hits"))
    above = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)  # one row a step
    total = h.agg(F.sum("n").alias("all"), F.sum("hits").alias("all_hits"))
    t = h.select("threshold", F.sum("n").over(above).alias("kept"), F.sum("hits").over(above).alias("hits")).crossJoin(F.broadcast(total))
    share, accuracy = F.col("kept") / F.col("all"), F.col("hits") / F.col("kept")
    return t.select("threshold", "kept", share.alias("share"), accuracy.alias("accuracy"), (accuracy - F.col("all_hits") / F.col("all")).alias("gain"), (share >= least).alias("useful"))


def calibration_report(items: DataFrame, key: str = "item", bins: int = 10, seed: int = 0) -> DataFrame:
    """One row of the held-out half before and after an isotonic fit on the other: Brier scores, ECE, the score of always
    saying the fit half's share (``brier_null``), the skill over it, and the gate of the highest useful gain on the fit
    half with what it keeps and gains on the held-out one. Empty halves give nulls."""
    fit, held = halves(items, key, seed)
    base = fit.agg(F.avg("correct").alias("base"))
    raw = calibration(held, bins).select("n", "accuracy", F.col("brier").alias("brier_before"), F.col("ece").alias("ece_before"))
    null = held.crossJoin(F.broadcast(base)).agg(F.avg((F.col("base") - F.col("correct")) ** 2).alias("brier_null"))
    after = calibration(apply_isotonic(fit_isotonic(fit), held), bins, "calibrated").select(F.col("brier").alias("brier_after"), F.col("ece").alias("ece_after"))
    gate = abstention_gate(fit).filter("useful").agg(F.max_by("threshold", F.struct(F.round("gain", 12), -F.col("threshold"))).alias("gate"))
    kept = held.crossJoin(F.broadcast(gate)).agg(F.avg((F.col("confidence") >= F.col("gate")).cast("double")).alias("gate_share"), (F.avg(F.when(F.col("confidence") >= F.col("gate"), F.col("correct"))) - F.avg("correct")).alias("gate_gain"), F.max("gate").alias("gate"))
    out = raw.crossJoin(null).crossJoin(after).crossJoin(kept)
    return out.withColumn("brier_skill", 1 - F.col("brier_after") / F.nullif(F.col("brier_null"), F.lit(0.0)))


def contingency(items: DataFrame, predicted: str, truth: str) -> DataFrame:
    return items.filter(F.col(predicted).isNotNull() & F.col(truth).isNotNull()).groupBy(F.col(predicted).cast("string").alias("a"), F.col(truth).cast("string").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))


def classification_scores(items: DataFrame, predicted: str, truth: str) -> DataFrame:
    """One row ``(n, accuracy, balanced_accuracy, macro_f1, weighted_f1, kappa)`` from one contingency table.

    Classes are those of either column; a class that is never predicted nor true doesn't count; rows with a null go.
    """
    c = contingency(items, predicted, truth)
    hit = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0.0)
    sides = c.select(F.col("a").alias("k"), F.col("n").alias("p"), F.lit(0.0).alias("t"), hit.alias("h")).union(c.select("b", F.lit(0.0), "n", F.lit(0.0)))
    k = sides.groupBy("k").agg(F.sum("p").alias("p"), F.sum("t").alias("t"), F.sum("h").alias("h"))
    f1, total = 2 * F.col("h") / (F.col("p") + F.col("t")), F.sum("t")
    accuracy, chance = F.sum("h") / total, F.sum(F.col("p") * F.col("t")) / (total * total)
    recall = F.avg(F.when(F.col("t") > 0, F.col("h") / F.nullif(F.col("t"), F.lit(0.0))))
    return k.agg(total.cast("long").alias("n"), accuracy.alias("accuracy"), recall.alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"), (F.sum(f1 * F.col("t")) / total).alias("weighted_f1"), ((accuracy - chance) / F.nullif(1 - chance, F.lit(0.0))).alias("kappa"))


def hierarchical_accuracy(items: DataFrame, parents: DataFrame, predicted: str, truth: str, partial: float = 0.5) -> DataFrame:
    """One row ``(n, accuracy, hierarchical)``: a label whose parent is right counts ``partial``. ``parents(label, parent)``;
    a label without a parent is its own."""
    up = lambda c: parents.select(F.col("label").alias(f"__{c}"), F.col("parent").alias(f"__{c}_up"))
    t = items.filter(F.col(predicted).isNotNull() & F.col(truth).isNotNull()).select(F.col(predicted).alias("__a"), F.col(truth).alias("__b"))
    t = t.join(F.broadcast(up("a")), "__a", "left").join(F.broadcast(up("b")), "__b", "left")
    same, kin = F.col("__a") == F.col("__b"), F.coalesce("__a_up", "__a") == F.coalesce("__b_up", "__b")
    return t.agg(F.count(F.lit(1)).alias("n"), F.avg(same.cast("double")).alias("accuracy"), F.avg(F.when(same, 1.0).when(kin, partial).otherwise(0.0)).alias("hierarchical"))


def _pearson(x: str, y: str) -> Column:
    """Correlation, null where one of the columns is constant."""
    a, b = (F.col(c) for c in (x, y))
    n = F.count(F.lit(1))
    spread = F.sqrt(F.greatest((n * F.sum(a * a) - F.sum(a) ** 2) * (n * F.sum(b * b) - F.sum(b) ** 2), F.lit(0.0)))
    return (n * F.sum(a * b) - F.sum(a) * F.sum(b)) / F.when(spread > 1e-12, spread)


def _entropy(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (part(p) + part(q)) / 2


def composition_accuracy(items: DataFrame, predicted: str, truth: str) -> DataFrame:
    """One row ``(l1, pearson, jsd)`` of the shares of labels in two columns; a label that one lacks has share 0 there."""
    side = lambda c, n: items.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("label")).agg(F.count(F.lit(1)).cast("double").alias(n))
    both = side(predicted, "p").join(side(truth, "q"), "label", "full").fillna(0.0, ["p", "q"])
    total = both.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    s = both.crossJoin(F.broadcast(total)).select((F.col("p") / F.col("tp")).alias("p"), (F.col("q") / F.col("tq")).alias("q"))
    return s.agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("l1"), _pearson("p", "q").alias("pearson"), F.sum(_entropy(F.col("p"), F.col("q"))).alias("jsd"))


def deconvolution_scores(estimated: DataFrame, true: DataFrame) -> DataFrame:
    """One row ``(rmse, pearson, jsd_by_spot, r2)`` of long shares ``(spot, type, share)``; absent shares are 0. R2 is the plain
    mean over types, of those whose true shares differ."""
    p = estimated.select("spot", "type", F.col("share").alias("p")).join(true.select("spot", "type", F.col("share").alias("q")), ["spot", "type"], "full").fillna(0.0, ["p", "q"])
    n = true.select("spot").distinct().agg(F.count(F.lit(1)).alias("n"))
    err = (F.col("p") - F.col("q")) ** 2
    types = p.groupBy("type").agg(F.sum(err).alias("e"), F.sum("q").alias("s"), F.sum(F.col("q") ** 2).alias("s2")).crossJoin(F.broadcast(n))
    spread = F.col("s2") - F.col("s") ** 2 / F.col("n")
    r2 = types.agg(F.avg(F.when(spread > 1e-12, 1 - F.col("e") / spread)).alias("r2"))
    spots = p.groupBy("spot").agg(F.sum(_entropy(F.col("p"), F.col("q"))).alias("j")).agg(F.avg("j").alias("jsd_by_spot"))
    return p.agg(F.sqrt(F.avg(err)).alias("rmse"), _pearson("p", "q").alias("pearson")).crossJoin(spots).crossJoin(r2)


def conformal_sets(calibration_rows: DataFrame, probabilities: DataFrame, alpha: float = 0.1) -> DataFrame:
    """``(item, labels, size)``: all labels whose probability is at least one minus the rank quantile of the misses
    ``1 - p(true)``, in order; the quantile's rank is ceil((n + 1)(1 - alpha)), beyond n every label is in the set.

    ``calibration_rows(p_true)``, ``probabilities(item, label, p)``.
    """
    ranked = calibration_rows.select((1 - F.col("p_true")).alias("miss")).filter("miss IS NOT NULL").groupBy("miss").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("miss").rowsBetween(Window.unboundedPreceding, 0)  # one row a distinct miss
    total = ranked.agg(F.sum("n").alias("all"))
    cut = ranked.withColumn("upto", F.sum("n").over(upto)).crossJoin(F.broadcast(total)).filter(F.col("upto") >= F.ceil((F.col("all") + 1) * F.lit(1 - alpha))).agg(F.min("miss").alias("cut"))
    t = probabilities.crossJoin(F.broadcast(cut))
    kept = F.array_sort(F.collect_list(F.when(1 - F.col("p") <= F.coalesce(F.col("cut"), F.lit(2.0)), F.col("label"))))
    return t.groupBy("item").agg(kept.alias("labels")).withColumn("size", F.size("labels"))


def sample_consistency(profiles: DataFrame) -> DataFrame:
    """One row ``(within, across)``: mean cosine of pseudobulks ``(sample, type, gene, value)`` of the same type and of
    different types, between samples. Pairs of (sample, type) meet on the genes that they share."""
    norm = profiles.groupBy("sample", "type").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("norm"))
    a, b = (profiles.join(norm, ["sample", "type"]).select("gene", *(F.col(c).alias(f"{c}_{k}") for c in ("sample", "type", "value", "norm"))) for k in "ab")
    dot = a.join(b, "gene").filter("sample_a < sample_b").groupBy("sample_a", "type_a", "sample_b", "type_b").agg((F.sum(F.col("value_a") * F.col("value_b")) / F.nullif(F.max("norm_a") * F.max("norm_b"), F.lit(0.0))).alias("cosine"))
    return dot.agg(F.avg(F.when(F.col("type_a") == F.col("type_b"), F.col("cosine"))).alias("within"), F.avg(F.when(F.col("type_a") != F.col("type_b"), F.col("cosine"))).alias("across"))


def quality_index(parts: DataFrame) -> DataFrame:
    """``parts(section, coherence, programs, purity, ceiling)`` with ``aqi`` and ``limiting``: the soft minimum (power -4) of
    programs and purity, at most the ceiling if there is one, weighted to .85..1 by spatial coherence."""
    m, c = (F.greatest(F.col(x), F.lit(1e-6)) for x in ("programs", "purity"))
    soft = F.pow((F.pow(m, -4) + F.pow(c, -4)) / 2, F.lit(-0.25))
    weight = 0.85 + 0.15 * F.greatest(F.least(F.coalesce("coherence", F.lit(1.0)), F.lit(1.0)), F.lit(0.0))
    least = F.array_min(F.array(*(F.struct(F.coalesce(F.col(x), F.lit(2.0)).alias("v"), F.lit(x).alias("k")) for x in ("ceiling", "programs", "purity"))))
    return parts.withColumn("aqi", weight * F.least(F.coalesce("ceiling", F.lit(1.0)), soft)).withColumn("limiting", least["k"])
