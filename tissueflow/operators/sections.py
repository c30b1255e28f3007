"""The pipeline over many sections at once: every table carries ``section``, so one job serves one section or thousands, and a
section's rows are the same in either. Shared tables are made once; a table of stages says how far each section came."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissueflow.durable import saved
from tissueflow.operators.labels import ABSTAIN
from tissueflow.operators.trust import COUNT_FLOOR, FAIL_BELOW, GENE_FLOOR, WARN_BELOW, CONTROL_MAX

STAGES = ("load", "quality", "annotate", "trust")
KEYS = ["section", "cell"]


@dataclass
class Run:
    """``cells``: each cell of each section with its metrics, label, confidence and verdict; ``stages``: the status table."""

    cells: DataFrame
    stages: DataFrame

    def composition(self) -> DataFrame:
        """``(section, label, n, share, mean_confidence)`` of the cells that passed quality control."""
        by = Window.partitionBy("section")
        t = self.cells.filter("kept").groupBy("section", "final_label").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))
        return t.select("section", F.col("final_label").alias("label"), "n", (F.col("n") / F.sum("n").over(by)).alias("share"), "mean_confidence")


def metrics(counts: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """``(section, cell, total, n_genes, pct_control)`` of every cell; those without counts have zeros and no share."""
    k = counts.join(genes.select("gene", "control"), "gene")
    sums = k.groupBy(KEYS).agg(F.sum(F.when(~F.col("control"), F.col("value")).otherwise(0)).alias("total"), F.count_if(~F.col("control") & (F.col("value") > 0)).alias("n_genes"), (100 * F.sum(F.when(F.col("control"), F.col("value")).otherwise(0)) / F.nullif(F.sum("value"), F.lit(0))).alias("pct_control"))
    return cells.select(KEYS).distinct().join(sums, KEYS, "left").select(*KEYS, F.coalesce("total", F.lit(0)).cast("double").alias("total"), F.coalesce("n_genes", F.lit(0)).alias("n_genes"), F.col("pct_control").cast("double").alias("pct_control"))


def run(counts: DataFrame, cells: DataFrame, genes: DataFrame, floor: float = COUNT_FLOOR, least_genes: int = GENE_FLOOR, control_max: float = CONTROL_MAX) -> Run:
    """Quality control, normalisation, labels by marker sets and their trust, over all sections of ``cells(section, cell)``.

    ``counts(section, cell, gene, value)``; ``genes(gene, marker_set, control)`` is the panel of all. A cell is kept with
    ``floor`` counts, ``least_genes`` genes and no more than ``control_max`` per cent on controls. Values are log-normalised to the
    median total of the section's kept cells; a cell's score for a set is the mean over the set's genes, zeros included. The
    label is the best set (ties by name), none where no marker is seen. Confidence is the margin's logistic over the
    section's spread of margins, times one less the control share over its limit; verdicts and abstentions are those of
    :mod:`trust`. Sections without cells have no rows, those whose cells are all dropped stop after quality. Null
    sections, cells and genes take no part; repeated cells are one; repeated counts of one gene add up.

    Keys are (section, cell), so one large section is spread as many small ones are; only medians and spreads are by section, as
    sums and percentiles of counts, and are joined back as one row a section.
    """
    genes = genes.filter("gene IS NOT NULL").select("gene", "marker_set", F.coalesce("control", F.lit(False)).alias("control")).dropDuplicates(["gene"])
    cells = cells.filter("section IS NOT NULL AND cell IS NOT NULL").select(KEYS)
    counts = saved(counts.filter("section IS NOT NULL AND cell IS NOT NULL AND gene IS NOT NULL AND value IS NOT NULL").groupBy(*KEYS, "gene").agg(F.sum("value").alias("value")))
    good = (F.col("total") >= floor) & (F.col("n_genes") >= least_genes) & (F.coalesce("pct_control", F.lit(0.0)) <= control_max)
    m = saved(metrics(counts, cells, genes).withColumn("kept", good))
    target = m.filter("kept").groupBy("section").agg(F.percentile("total", F.lit(0.5)).alias("target"))
    panel = genes.filter("NOT control AND marker_set IS NOT NULL")
    sizes = panel.groupBy("marker_set").agg(F.count(F.lit(1)).alias("size"))
    values = counts.join(m.filter("kept").select(*KEYS, "total"), KEYS).join(target, "section").join(panel.select("gene", "marker_set"), "gene")
    scores = values.groupBy(*KEYS, "marker_set").agg(F.sum(F.log1p(F.col("value") * F.col("target") / F.col("total"))).alias("v")).join(sizes, "marker_set").select(*KEYS, "marker_set", F.round(F.col("v") / F.col("size"), 9).alias("score")).filter("score > 0")
    place = Window.partitionBy(KEYS).orderBy(F.desc("score"), "marker_set")
    two = scores.withColumn("place", F.row_number().over(place)).filter("place <= 2")
    at = lambda i, c: F.max(F.when(F.col("place") == i, F.col(c)))
    best = saved(two.groupBy(KEYS).agg(at(1, "marker_set").alias("label"), (at(1, "score") - F.coalesce(at(2, "score"), F.lit(0.0))).alias("margin")))
    spread = best.groupBy("section").agg(F.stddev_pop("margin").alias("sd"))
    known = m.join(best, KEYS, "left").join(spread, "section", "left")
    sure = (1 / (1 + F.exp(-F.col("margin") / (F.col("sd") + 1e-9)))) * (1 - F.least(F.coalesce("pct_control", F.lit(0.0)) / control_max, F.lit(1.0)))
    judged = known.withColumn("confidence", F.when(F.col("kept"), F.coalesce(sure, F.lit(0.0))))
    verdict = F.when(~F.col("kept") | (F.col("confidence") < FAIL_BELOW), "FAIL").when(F.col("confidence") < WARN_BELOW, "WARN").otherwise("PASS")
    judged = judged.withColumn("verdict", verdict)
    final = F.when(F.col("verdict") != "FAIL", F.col("label")).when(F.col("kept"), ABSTAIN["uncertain_lowconf"]).otherwise(ABSTAIN["low_quality"])
    out = saved(judged.select(*KEYS, "total", "n_genes", "pct_control", "kept", "label", "confidence", "verdict", final.alias("final_label")))
    return Run(out, stages(out))


def stages(cells: DataFrame) -> DataFrame:
    """``(section, stage, status, n_in, n_out)``: a row for each section and stage of a run. Status is ok, ``empty`` where a stage
    leaves nothing, and ``skipped`` after such a stage."""
    n = cells.groupBy("section").agg(F.count(F.lit(1)).alias("load"), F.count_if(F.col("kept")).alias("quality"), F.count_if(F.col("kept") & F.col("label").isNotNull()).alias("annotate"), F.count_if(F.col("verdict") == "PASS").alias("trust"))
    rows = [F.struct(F.lit(s).alias("stage"), F.col(STAGES[max(i - 1, 0)]).alias("n_in"), F.col(s).alias("n_out")) for i, s in enumerate(STAGES)]
    long = n.select("section", F.explode(F.array(*rows)).alias("r")).select("section", "r.*")
    status = F.when(F.col("n_in") == 0, "skipped").when(F.col("n_out") == 0, "empty").otherwise("ok")
    return long.select("section", "stage", status.alias("status"), "n_in", "n_out")
