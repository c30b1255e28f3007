"""Cells by a criterion in words, and any field or gene as one value a cell. Plans stay lazy: what a criterion means for a
table (is there such a label, is any cell flagged) is one aggregated row that is joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the criteria, in order of precedence, and the limits that they stand for.
MALIGNANT_WORDS = ("malignant", "tumor", "tumour")
ABSTAINED_WORDS = ("abstain", "unassigned", "reject", "ambiguous")
UNSURE_WORDS = ("confiden", "uncertain", "tentative")
QUALITY_WORDS = ("quality", "low_qual", "lowqual", "poor", "bad", "junk")
MALIGNANT_OVER, CONFIDENT_FROM, LOWEST = 0.6, 0.5, 0.1
#: Names by which fields are asked for, with the columns of a judged cell.
FIELDS = {
    "qc": "total", "counts": "total", "depth": "total", "total counts": "total", "genes": "n_genes", "n genes": "n_genes",
    "malignant": "malignant_score", "tumor": "malignant_score", "tumour": "malignant_score", "malignant score": "malignant_score",
    "cell type": "label", "celltype": "label", "type": "label", "annotation": "label", "niche": "niche", "cluster": "cluster", "leiden": "cluster", "confidence": "confidence",
}


def _holds(text: str, words: tuple[str, ...]) -> bool:
    return any(w in text for w in words)


def _rule(text: str, have: list[str], floor: float) -> tuple[str, Column] | None:
    """The rule that the criterion's words name, if the table has its columns, and which cells it takes."""
    if _holds(text, MALIGNANT_WORDS) and "malignant_score" in have:
        return "malignant", F.col("malignant_score") > MALIGNANT_OVER
    if _holds(text, ABSTAINED_WORDS) and "verdict" in have:
        return "abstained", F.col("verdict") == "FAIL"
    if _holds(text, UNSURE_WORDS + ABSTAINED_WORDS) and ("verdict" in have or "confidence" in have):
        return "low confidence", F.col("verdict").isin("WARN", "FAIL") if "verdict" in have else F.coalesce("confidence", F.lit(0.0)) < CONFIDENT_FROM
    if _holds(text, QUALITY_WORDS) and "total" in have:
        bad = [F.coalesce("total", F.lit(0)) < floor]
        bad += [F.col("area_outlier")] if "area_outlier" in have else []
        bad += [F.lower("reason").contains("low_quality")] if "reason" in have else []
        return "low quality", F.greatest(*(F.coalesce(b, F.lit(False)) for b in bad), F.lit(False))
    return None


def select_cells(cells: DataFrame, criterion: str, floor: float = 10.0) -> DataFrame:
    """``(cell, rule)``: the cells of ``cells(cell, label, ...)`` that the criterion means, and the rule that took them.

    In this order: a label of that name, letter case aside; malignant (``malignant_score`` over 0.6); abstained (``verdict``
    FAIL); low confidence (WARN or FAIL, or ``confidence`` under 0.5); low quality (``total`` under the floor,
    ``area_outlier``, or a ``reason`` of low quality; where no cell is so, the lowest tenth by ``total``, as rule
    ``lowest decile``); the first label that holds the criterion or is held by it. Rules whose columns are missing don't
    apply; a criterion of no rule, an empty one and an empty table give no rows. Nulls are not selected, but a null total
    counts as 0. Labels are any number; one row of facts is joined to the cells.
    """
    text = criterion.strip().lower()
    if not text:
        return cells.select("cell", F.lit(None).cast("string").alias("rule")).limit(0)
    named = F.lower("label") == text
    close = F.lower("label").contains(text) | F.lit(text).contains(F.lower("label"))
    facts = [F.coalesce(F.max(named), F.lit(False)).alias("is_label"), F.min(F.when(close & (F.col("label") != ""), F.col("label"))).alias("closest")]
    rule = _rule(text, cells.columns, floor)
    name, taken = rule or ("", F.lit(False))
    if name == "low quality":
        total = F.coalesce("total", F.lit(0)).cast("double")
        facts += [F.count_if(taken).alias("n_taken"), F.percentile(total, F.lit(LOWEST)).alias("lowest")]
        lowest = F.col("f.n_taken") == 0
        taken, name = F.when(lowest, total <= F.col("f.lowest")).otherwise(taken), F.when(lowest, "lowest decile").otherwise(name)
    told = cells.crossJoin(F.broadcast(cells.agg(F.struct(*facts).alias("f"))))
    other = taken if rule else F.col("label") == F.col("f.closest")
    said = name if rule else F.col("f.closest")
    out = told.filter(F.when(F.col("f.is_label"), named).otherwise(other))
    return out.select("cell", F.when(F.col("f.is_label"), F.col("label")).otherwise(F.lit(said) if isinstance(said, str) else said).alias("rule"))


def project(cells: DataFrame, counts: DataFrame, panel: DataFrame, name: str) -> DataFrame:
    """``(cell, field, value)``: the field of ``cells`` that the name stands for, else the counts of the gene of that name in
    ``panel(gene)``, letter case aside (of several the least), 0 where a cell has none; else null fields and values.

    Values of text fields are text, all others double. One gene's rows of ``counts(cell, gene, value)`` are read.
    """
    field = FIELDS.get(name.strip().lower(), name.strip())
    if field in cells.columns:
        kind = dict(cells.dtypes)[field]
        return cells.select("cell", F.lit(field).alias("field"), F.col(field).cast("string" if kind == "string" else "double").alias("value"))
    gene = panel.filter(F.lower(F.col("gene").cast("string")) == name.strip().lower()).agg(F.min("gene").alias("gene"))
    held = counts.join(F.broadcast(gene), "gene").groupBy("cell").agg(F.sum("value").cast("double").alias("value"))
    found = cells.select("cell").crossJoin(F.broadcast(gene)).join(held, "cell", "left")
    return found.select("cell", F.col("gene").cast("string").alias("field"), F.when(F.col("gene").isNotNull(), F.coalesce("value", F.lit(0.0))).alias("value"))
