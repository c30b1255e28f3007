"""Groups of labels: gene sets, merge groups, ontology compartments, marker overview, splits of clusters.

Tables of labels, pairs of labels and ontology terms are small; those of items and vectors are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissueflow.durable import saved

# Compartments, in order, and the words of a label that put it there; two words match anywhere, one as a word.
COMPARTMENT_WORDS = {
    "immune": ("macrophage", "monocyte", "dendritic", "myeloid", "microglia", "neutrophil", "granulocyte", "mast", "kupffer", "lymphocyte", "leukocyte", "treg", "lymphoid", "t cell", "b cell", "nk cell", "plasma", "natural killer", "megakaryocyte", "basophil", "eosinophil", "langerhans"),
    "endothelial": ("endothel", "ec", "capillary", "arterial", "venous", "lymphatic"),
    "stromal": ("fibroblast", "myofibroblast", "caf", "stromal", "mesenchym", "pericyte", "adipocyte", "mural", "stellate"),
    "epithelial": ("epithel", "luminal", "basal", "keratinocyt", "carcinoma", "melanocyt", "hepatocyt", "enterocyte", "goblet", "secretory", "tumor", "tumour", "club", "ciliated", "alveolar", "acinar", "ductal", "podocyte", "tubule", "tubular", "nephron"),
    "neural": ("neuron", "astrocyt", "oligodendrocyt", "opc", "ependymal", "glia", "schwann", "neural", "neuronal"),
    "muscle": ("myocyte", "cardiomyocyte", "smooth muscle", "myotube"),
}


def gene_sharing(markers: DataFrame) -> DataFrame:
    """``(marker_set, gene, n_sets, private)`` of ``markers(marker_set, gene)``: a private gene is in one set only.

    Repeated rows count once; null sets and genes go.
    """
    m = markers.filter("marker_set IS NOT NULL AND gene IS NOT NULL").select("marker_set", "gene").distinct()
    n = m.groupBy("gene").agg(F.count(F.lit(1)).alias("n_sets"))
    return m.join(n, "gene").select("marker_set", "gene", "n_sets", (F.col("n_sets") == 1).alias("private"))


def label_groups(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(label, root)``: the connected components of ``pairs(a, b)`` over ``labels(label)``; root is the least member.

    Pairs with a null or unknown label go; a label without a pair is its own group. Every round takes the least root
    among a label's neighbours and then that root's own, so a long chain needs few rounds.
    """
    nodes = labels.filter("label IS NOT NULL").select("label").distinct()
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    edges = saved(both.join(nodes.select(F.col("label").alias("a")), "a").join(nodes.select(F.col("label").alias("b")), "b"))
    at = saved(nodes.withColumn("root", F.col("label")))
    while True:
        near = edges.join(at.select(F.col("label").alias("b"), "root"), "b").groupBy(F.col("a").alias("label")).agg(F.min("root").alias("near"))
        step = at.join(near, "label", "left").select("label", F.least("root", "near").alias("root"), F.col("root").alias("before"))
        jump = at.select(F.col("label").alias("root"), F.col("root").alias("further"))
        after = saved(step.join(jump, "root").select("label", F.least("root", "further").alias("root"), "before"))
        if after.filter("root <> before").isEmpty():
            return after.select("label", "root")
        at = after.select("label", "root")


def merge_map(confusion: DataFrame, least: float = 0.25) -> DataFrame:
    """``(label, merged)`` of ``confusion(label, confused_with, share)``: labels that are taken for one another at least
    that often get one name, the members' names in order joined by " + ". Others keep theirs."""
    strong = confusion.filter(F.col("share") >= least).select(F.col("label").alias("a"), F.col("confused_with").alias("b"))
    return _joined(label_groups(confusion, strong))


def _joined(groups: DataFrame) -> DataFrame:
    names = groups.groupBy("root").agg(F.array_join(F.sort_array(F.collect_set("label")), " + ").alias("merged"))
    return groups.join(names, "root").select("label", "merged")


def ancestors(isa: DataFrame) -> DataFrame:
    """``(term, ancestor)``: what each term of ``isa(child, parent)`` is, itself included; circles do no harm."""
    edges = saved(isa.filter("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent").distinct())
    terms = edges.select("child").union(edges.select("parent")).distinct()
    known = saved(terms.select(F.col("child").alias("term"), F.col("child").alias("ancestor")))
    new = known
    while not new.isEmpty():
        up = new.join(edges, F.col("ancestor") == F.col("child")).select("term", F.col("parent").alias("ancestor")).distinct()
        new = saved(up.join(known, ["term", "ancestor"], "left_anti"))
        known = saved(known.union(new))
    return known


def keyword_compartment(label: Column) -> Column:
    """The first compartment of which a label holds a word, or null."""
    plain = F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", " "))
    words = F.split(plain, " ")
    out = F.lit(None).cast("string")
    for name, keys in COMPARTMENT_WORDS.items():
        hit = F.arrays_overlap(words, F.array(*(F.lit(k) for k in keys if " " not in k)))
        for k in (k for k in keys if " " in k):
            hit = hit | plain.contains(k)
        out = F.coalesce(out, F.when(hit, name))
    return out


def compartments(labels: DataFrame, isa: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(label, compartments)`` of ``labels(label, term)``: those of ``anchors(term, compartment)`` among the ancestors of
    the label's term; without one, that of its keywords; else none. ``term`` may be null."""
    held = ancestors(isa).join(F.broadcast(anchors.select(F.col("term").alias("ancestor"), "compartment")), "ancestor")
    held = held.union(anchors.select("term", "term", "compartment")).groupBy("term").agg(F.sort_array(F.collect_set("compartment")).alias("own"))
    word = keyword_compartment(F.col("label"))
    plain = F.when(word.isNotNull(), F.array(word)).otherwise(F.array().cast("array<string>"))
    return labels.select("label", "term").distinct().join(held, "term", "left").select("label", F.coalesce("own", plain).alias("compartments"))


def mergeable(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with ``mergeable``: whether both are of a common compartment; null where one has none."""
    side = lambda c: placed.select(F.col("label").alias(c), F.col("compartments").alias(f"__{c}"))
    found = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    known = (F.size("__a") > 0) & (F.size("__b") > 0)
    return found.select(*pairs.columns, F.when(known, F.arrays_overlap("__a", "__b")).alias("mergeable"))


def merged_types(cells: DataFrame, pairs: DataFrame, placed: DataFrame | None = None, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """``(cells with the joint labels, (label, merged))``: confusable ``pairs(a, b)`` become one label, unless ``placed``
    (of :func:`compartments`) says that the two are of different compartments. Take the second alone for a dry run."""
    allowed = pairs if placed is None else mergeable(pairs, placed).filter("mergeable IS NULL OR mergeable").select("a", "b")
    names = _joined(label_groups(cells.select(F.col(label).alias("label")), allowed))
    out = cells.join(F.broadcast(names.withColumnRenamed("label", "__old")), F.col(label) == F.col("__old"), "left")
    return out.withColumn(label, F.coalesce("merged", label)).drop("__old", "merged"), names.filter("label <> merged")


def marker_overview(means: DataFrame, sizes: DataFrame, top: int = 2) -> DataFrame:
    """``(place, label, gene)``: for each label, in order, its ``top`` genes of greatest mean difference to all other
    cells that no earlier label took. ``means(label, gene, total)`` has sums, ``sizes(label, n)`` the cells.

    Earlier labels take at most ``top`` genes each, so ``top`` times the number of labels are enough to choose from.
    """
    s = sizes.filter("label IS NOT NULL").withColumn("all", F.sum("n").over(Window.partitionBy()))
    m = means.filter("label IS NOT NULL").withColumn("whole", F.sum("total").over(Window.partitionBy("gene"))).join(F.broadcast(s), "label")
    gap = F.col("total") / F.col("n") - (F.col("whole") - F.col("total")) / F.greatest(F.col("all") - F.col("n"), F.lit(1))
    ordered = m.select("label", "gene", F.round(gap, 9).alias("gap")).filter("gap > 0")
    labels = s.agg(F.count(F.lit(1)).alias("labels"))
    near = ordered.withColumn("at", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("gap"), "gene"))).crossJoin(F.broadcast(labels)).filter(F.col("at") <= top * F.col("labels"))
    lists = near.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "gene"))), lambda x: x["gene"]).alias("genes"))
    kind = f"array<struct<label:{dict(lists.dtypes)['label']},gene:{dict(means.dtypes)['gene']}>>"
    whole = lists.agg(F.sort_array(F.collect_list(F.struct("label", "genes"))).alias("x"))

    def step(taken, x):
        free = F.filter(x["genes"], lambda g: ~F.exists(taken, lambda t: t["gene"] == g))
        return F.concat(taken, F.transform(F.slice(free, 1, top), lambda g: F.struct(x["label"].alias("label"), g.alias("gene"))))

    chosen = whole.select(F.aggregate("x", F.array().cast(kind), step).alias("c"))
    return chosen.select(F.posexplode("c").alias("place", "r")).select("place", "r.label", "r.gene")


def main_axes(items: DataFrame) -> DataFrame:
    """``(label, mean, axis)``: the main axis of each label's vectors, from sums over all of them.

    The sums of products are of the vectors' dimensions squared, whatever the rows.
    """
    x = items.filter("label IS NOT NULL AND embedding IS NOT NULL").select("label", F.col("embedding").cast("array<double>").alias("v"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for label, part in b.groupby("label"):
                m = np.stack(part["v"].to_numpy())
                out.append((label, len(m), m.sum(0).tolist(), (m.T @ m).ravel().tolist()))
            yield pd.DataFrame(out, columns=["label", "n", "s", "p"])

    kind = dict(x.dtypes)["label"]
    sums = x.mapInPandas(partial, f"label {kind}, n long, s array<double>, p array<double>")
    # One more combination for each label and task before the last one, as vectors of sums can't be combined by ``sum``.
    long = sums.select("label", "n", F.posexplode(F.concat("s", "p")).alias("i", "v")).groupBy("label", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))

    def axis(part: pd.DataFrame) -> pd.DataFrame:
        v, n = part.sort_values("i")["v"].to_numpy(), int(part["n"].iloc[0])
        d = int((np.sqrt(1 + 4 * len(v)) - 1) / 2 + 0.5)
        mean = v[:d] / n
        w, vectors = np.linalg.eigh(v[d:].reshape(d, d) / n - np.outer(mean, mean))
        a = vectors[:, -1]
        return pd.DataFrame([(part["label"].iloc[0], mean.tolist(), (a * np.sign(a[np.abs(a).argmax()])).tolist())], columns=["label", "mean", "axis"])

    return long.groupBy("label").applyInPandas(axis, f"label {kind}, mean array<double>, axis array<double>")


def bimodality(values: DataFrame, by: str = "label", value: str = "t") -> DataFrame:
    """``(by, n, bimodality)``: (skewness squared + 1) / (excess kurtosis + 3 (n-1)^2 / ((n-2)(n-3))), both corrected
    for the sample; 0 for under four or equal values. A normal sample has about a third."""
    n, x = F.col("n").cast("double"), F.col(value)
    s = values.groupBy(by).agg(F.count(x).alias("n"), F.skewness(x).alias("g"), F.kurtosis(x).alias("k"), (F.max(x) - F.min(x)).alias("span"))
    g = F.col("g") * F.sqrt(n * (n - 1)) / (n - 2)
    k = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("k") + 6)
    below = k + 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))
    return s.select(by, "n", F.when((n >= 4) & (F.col("span") > 1e-12) & (below > 0), (g**2 + 1) / below).otherwise(0.0).alias("bimodality"))


def split_test(items: DataFrame, limit: float = 0.555, least: int = 20, programs: DataFrame | None = None, least_share: float = 0.15) -> DataFrame:
    """``(label, n, bimodality, n_programs, verdict)``: a cluster whose main axis is bimodal should be split; with
    ``programs(item, program)`` only if at least two of them hold a share of it. Smaller ones than ``least`` are ok."""
    at = items.filter("label IS NOT NULL AND embedding IS NOT NULL").join(F.broadcast(main_axes(items)), "label")
    t = F.aggregate(F.zip_with(F.zip_with(F.col("embedding").cast("array<double>"), "mean", lambda a, b: a - b), "axis", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    out = bimodality(at.select("label", t.alias("t")))
    if programs is None:
        out = out.withColumn("n_programs", F.lit(0).cast("long"))
        enough = F.lit(True)
    else:
        held = items.select("item", "label").join(programs, "item").groupBy("label", "program").agg(F.count(F.lit(1)).alias("k")).join(out.select("label", "n"), "label")
        many = held.groupBy("label").agg(F.count(F.when(F.col("k") >= least_share * F.col("n"), 1)).alias("n_programs"))
        out = out.join(many, "label", "left").withColumn("n_programs", F.coalesce("n_programs", F.lit(0).cast("long")))
        enough = F.col("n_programs") >= 2
    large = F.col("n") >= least
    out = out.withColumn("bimodality", F.when(large, F.col("bimodality")).otherwise(0.0))
    return out.withColumn("verdict", F.when(large & (F.col("bimodality") > limit) & enough, "split").otherwise("ok"))


def cluster_panel(merges: DataFrame, splits: DataFrame, types: DataFrame, limit: float = 0.65) -> DataFrame:
    """``(label, type, merge_with, same_type, verdict)`` a cluster: merge where a pair of ``merges(a, b,
    balanced_accuracy)`` is below the limit, else the verdict of ``splits``. ``types(label, type)`` has a row an item; the
    commonest one names a cluster, ties to the smaller."""
    n = types.filter("type IS NOT NULL").groupBy("label", "type").agg(F.count(F.lit(1)).alias("k"))
    named = n.groupBy("label").agg(F.min(F.struct((-F.col("k")).alias("k"), "type")).alias("m")).select("label", F.col("m.type").alias("type"))
    bad = merges.filter(F.col("balanced_accuracy") < limit)
    both = bad.select(F.col("a").alias("label"), F.col("b").alias("other")).union(bad.select("b", "a"))
    other = named.select(F.col("label").alias("other"), F.col("type").alias("other_type"))
    told = both.join(named, "label", "left").join(other, "other", "left").groupBy("label").agg(F.sort_array(F.collect_set("other")).alias("merge_with"), F.coalesce(F.bool_or(F.col("type") == F.col("other_type")), F.lit(False)).alias("same_type"))
    out = splits.select("label", F.col("verdict").alias("alone")).join(named, "label", "left").join(told, "label", "left")
    return out.select("label", "type", "merge_with", F.coalesce("same_type", F.lit(False)).alias("same_type"), F.when(F.col("merge_with").isNotNull(), "merge").otherwise(F.col("alone")).alias("verdict"))
