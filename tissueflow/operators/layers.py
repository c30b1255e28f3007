"""Two layers of counts of the same cells compared (as before and after purification), callers of malignant cells compared, and
marker lists merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissueflow.durable import saved
from tissueflow.operators.labels import in_tumour
from tissueflow.operators.ranks import percentiles

#: Counts that a cell is scaled to before logarithms are taken.
SCALE = 1e4


def _both(layers: DataFrame) -> DataFrame:
    return layers.filter("cell IS NOT NULL AND gene IS NOT NULL").groupBy("cell", "gene").agg(*(F.sum(F.coalesce(c, F.lit(0))).cast("double").alias(c) for c in ("before", "after")))


def layer_quality(layers: DataFrame, cells: DataFrame, markers: DataFrame) -> DataFrame:
    """``(label, n, specificity_before, specificity_after, purity_before, purity_after, retention)`` of each label that has cells.

    ``layers(cell, gene, before, after)``, ``cells(cell, label)``, ``markers(label, gene)``; markers that no cell has don't
    count. Specificity: of the label's markers, the mean log-normalised value in its cells over that plus the mean in all
    others, zeros included; null without markers, or where there are no others. Purity: mean share of a cell's counts on its own
    label's markers. Retention: mean over the label's cells with such counts before, of those after in them, 1 at most.
    Null labels belong to no label but to the others. Repeated rows add up; repeated cells and markers are one.
    """
    k = _both(layers)
    cells = cells.filter("cell IS NOT NULL").groupBy("cell").agg(F.min("label").alias("label"))
    own = markers.filter("label IS NOT NULL AND gene IS NOT NULL").select(F.col("label").alias("of"), "gene").distinct().join(k.select("gene").distinct(), "gene", "left_semi")
    totals = k.groupBy("cell").agg(F.sum("before").alias("tb"), F.sum("after").alias("ta"))
    log = lambda x, t: F.coalesce(F.log1p(SCALE * F.col(x) / F.nullif(F.col(t), F.lit(0.0))), F.lit(0.0))
    seen = k.join(totals, "cell").join(cells, "cell").join(own, "gene").withColumn("on", F.coalesce(F.col("label") == F.col("of"), F.lit(False)))
    part = lambda on, v: F.sum(F.when(F.col("on") if on else ~F.col("on"), v).otherwise(0.0))
    sums = seen.groupBy(F.col("of").alias("label")).agg(*(part(on, log(x, t)).alias(f"{x}_{'on' if on else 'off'}") for on in (True, False) for x, t in (("before", "tb"), ("after", "ta"))))
    mine = seen.filter("on").groupBy("cell", "label").agg(F.sum("before").alias("rb"), F.sum("after").alias("ra"), F.first("tb").alias("tb"), F.first("ta").alias("ta"))
    share = lambda r, t: F.sum(F.coalesce(F.col(r) / F.nullif(F.col(t), F.lit(0.0)), F.lit(0.0)))
    kept = mine.groupBy("label").agg(share("rb", "tb").alias("pb"), share("ra", "ta").alias("pa"), F.avg(F.when(F.col("rb") > 0, F.greatest(F.least(F.col("ra") / F.col("rb"), F.lit(1.0)), F.lit(0.0)))).alias("retention"))
    every = cells.agg(F.count(F.lit(1)).alias("every"))
    sizes = cells.filter("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(every))

    def specific(x: str):
        on, off = F.col(f"{x}_on") / F.col("n"), F.col(f"{x}_off") / F.nullif(F.col("every") - F.col("n"), F.lit(0))
        return (on / (on + off + 1e-12)).alias(f"specificity_{x}")

    pure = lambda p: F.coalesce(F.col(p), F.lit(0.0)) / F.col("n")
    return sizes.join(sums, "label", "left").join(kept, "label", "left").select("label", "n", specific("before"), specific("after"), pure("pb").alias("purity_before"), pure("pa").alias("purity_after"), "retention")


def layer_change(layers: DataFrame) -> DataFrame:
    """One row: the median total and median number of genes of a cell in either layer, over cells with any row."""
    per = saved(_both(layers).groupBy("cell").agg(*(F.sum(c).alias(f"total_{c}") for c in ("before", "after")), *(F.count_if(F.col(c) > 0).alias(f"genes_{c}") for c in ("before", "after"))))
    return reduce(DataFrame.crossJoin, (percentiles(per, c, **{f"median_{c}": 0.5}) for c in ("total_before", "total_after", "genes_before", "genes_after")))  # one row each


def caller_shares(calls: DataFrame, n_cells: int) -> DataFrame:
    """``(caller, n_scored, share_malignant, coverage)`` of ``calls(cell, caller, malignant)``; null calls aren't scored."""
    scored = calls.filter("cell IS NOT NULL AND malignant IS NOT NULL")
    return scored.groupBy("caller").agg(F.count(F.lit(1)).alias("n_scored"), F.avg(F.col("malignant").cast("double")).alias("share_malignant"), (F.count(F.lit(1)) / F.lit(max(n_cells, 1))).alias("coverage"))


def caller_concordance(calls: DataFrame) -> DataFrame:
    """``(a, b, n_joint, concordance)``: of two callers of ``calls(cell, caller, malignant)``, one call a cell each, the cells that both scored
    and the share on which they agree. A cell has a row for each caller, so pairs are callers by callers within it."""
    scored = calls.filter("cell IS NOT NULL AND malignant IS NOT NULL")
    x, y = (scored.select("cell", F.col("caller").alias(c), F.col("malignant").alias(m)) for c, m in (("a", "x"), ("b", "y")))
    return x.join(y, "cell").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_joint"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("concordance"))


def malignant_gate(sections: DataFrame) -> DataFrame:
    """``sections(section, tissue, told)`` with ``run`` and ``gate``: whether malignant cells are to be called, by what was told
    (``explicit``) or, where that is null, by the tissue's name (``tissue``)."""
    return sections.select("section", F.coalesce(in_tumour(F.col("tissue"), F.col("told")), F.lit(False)).alias("run"), F.when(F.col("told").isNull(), "tissue").otherwise("explicit").alias("gate"))


def merged_markers(curated: DataFrame, corpus: DataFrame, categories: DataFrame) -> DataFrame:
    """``(type, gene, place, source)``: for each of ``categories(type)``, the genes of ``curated(type, gene, place)`` in order, then
    those of ``corpus`` not among them; letter case is ignored in types and genes, the first spelling stays. Types without
    either have no rows; null types and genes take no part."""
    kinds = categories.filter("type IS NOT NULL").select("type", F.lower("type").alias("k")).distinct()
    parts = [df.select(F.lower("type").alias("k"), F.col("gene").cast("string").alias("gene"), F.col("place").cast("long").alias("p"), F.lit(i).alias("i")) for i, df in enumerate((curated, corpus))]
    every = parts[0].union(parts[1]).filter("gene IS NOT NULL").join(kinds, "k")
    first = every.groupBy("type", F.lower("gene").alias("g")).agg(F.min(F.struct("i", "p", "gene")).alias("m")).select("type", "m.*")
    place = F.row_number().over(Window.partitionBy("type").orderBy("i", "p", "gene"))
    return first.select("type", "gene", place.alias("place"), F.when(F.col("i") == 0, "curated").otherwise("corpus").alias("source"))
