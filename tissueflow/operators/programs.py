"""Gene programs of a section: non-negative factors of its values, their scores in cells, and their names."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissueflow.operators.embedding import normalised, variable_rows
from tissueflow.operators.trust import one_against_rest

PROGRAMS, TOP_GENES, SIGNATURE = 10, 12, 25
#: Coordinate sweeps in which a cell's usages, and then the programs' genes, are solved for.
SWEEPS = 40


@dataclass
class Programs:
    """``usage(cell, usage array, program)``, ``loadings(program, gene, weight)``, ``table(program, n_cells, top_genes)`` and the squared
    error after each round. Programs are numbered from 0."""

    usage: DataFrame
    loadings: DataFrame
    table: DataFrame
    losses: list[float]


def usages(x: np.ndarray, h: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """The non-negative ``w`` for which ``w @ h`` comes nearest to ``x``, by coordinates."""
    cross, gram = x @ h.T, h @ h.T
    w = np.zeros((len(x), len(h)))
    for _ in range(sweeps):
        for k in range(len(h)):
            if gram[k, k] > 0:
                w[:, k] = np.maximum(w[:, k] + (cross[:, k] - w @ gram[:, k]) / gram[k, k], 0)
    return w


def loadings_of(cross: np.ndarray, gram: np.ndarray, h: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """As :func:`usages` for the programs' genes, from the sums ``w'x`` and ``w'w`` alone."""
    h = h.copy()
    for _ in range(sweeps):
        for k in range(len(h)):
            if gram[k, k] > 0:
                h[k] = np.maximum(h[k] + (cross[k] - gram[k] @ h) / gram[k, k], 0)
    return h


def first_loadings(mean: np.ndarray, k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).random((k, len(mean))) * mean


def discover(counts: DataFrame, cells: DataFrame, genes: DataFrame, k: int = PROGRAMS, top: int = 2000, rounds: int = 60, tolerance: float = 1e-4, edges: DataFrame | None = None, seed: int = 0) -> Programs:
    """``k`` programs of the normalised values on the ``top`` most variable genes: values are nearly usages times loadings, none
    negative. Each round solves every cell's usages for the current loadings where its row lies, adds up one matrix of
    programs by genes and one of programs by programs, and solves the loadings for these; the squared error can't grow. Rounds
    end when it falls by less than a share of ``tolerance``. With ``edges(src, dst)`` a cell's usages become the mean of its
    neighbours' (zeros without any). The dominant program is the one of greatest usage, ties to the first; cells without
    counts have usages of zero and program 0.
    """
    spark = counts.sparkSession
    x = variable_rows(counts, cells, genes, top)
    k, g = min(k, len(x.genes)), len(x.genes)
    kinds, losses = {"cell": dict(cells.dtypes)["cell"], "gene": dict(genes.dtypes)["gene"]}, []
    h = first_loadings(x.mean, k, seed)
    for _ in range(rounds if g else 0):
        held = spark.sparkContext.broadcast(h)

        def add(out: np.ndarray, x: np.ndarray, held=held) -> None:
            w = usages(x, held.value)
            k = w.shape[1]
            out[:k, : x.shape[1]] += w.T @ x
            out[:k, x.shape[1] : x.shape[1] + k] += w.T @ w
            out[k, 0] += (x * x).sum()

        s = x.summed((k + 1, g + k), add)
        cross, gram = s[:k, :g], s[:k, g:]
        h = loadings_of(cross, gram, h)
        losses.append(float(s[k, 0] - 2 * (cross * h).sum() + (gram * (h @ h.T)).sum()))
        if len(losses) > 1 and losses[-2] - losses[-1] <= tolerance * losses[-2]:
            break
    held, dense = spark.sparkContext.broadcast(h), x.dense()

    def use(at: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([w for lo in range(0, len(at), 512) for w in usages(dense(at.iloc[lo : lo + 512].tolist(), v.iloc[lo : lo + 512].tolist()), held.value)])

    zeros = F.transform(F.sequence(F.lit(1), F.lit(max(k, 1))), lambda _: F.lit(0.0))
    own = cells.select("cell").distinct().join(x.rows.select("cell", F.pandas_udf(use, "array<double>")("at", "v").alias("usage")), "cell", "left").withColumn("usage", F.coalesce("usage", zeros))
    if edges is not None:
        near = edges.select(F.col("src"), F.col("dst").alias("cell")).join(own, "cell").select(F.col("src").alias("cell"), F.posexplode("usage").alias("at", "u"))
        mean = near.groupBy("cell", "at").agg(F.avg("u").alias("u")).groupBy("cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "u"))), lambda y: y["u"]).alias("smooth"))
        own = own.join(mean, "cell", "left").select("cell", F.coalesce("smooth", zeros).alias("usage"))
    own = own.withColumn("program", (F.array_position("usage", F.array_max("usage")) - 1).cast("int"))
    load = spark.createDataFrame([(i, gene, float(h[i, j])) for i in range(k) for j, gene in enumerate(x.genes)], f"program int, gene {kinds['gene']}, weight double")  # programs by genes
    place = F.row_number().over(Window.partitionBy("program").orderBy(F.desc(F.round("weight", 9)), "gene"))
    best = load.withColumn("place", place).filter(F.col("place") <= TOP_GENES).groupBy("program").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "gene"))), lambda y: y["gene"]).alias("top_genes"))
    table = best.join(own.groupBy("program").agg(F.count(F.lit(1)).alias("n_cells")), "program", "left").select("program", F.coalesce("n_cells", F.lit(0)).alias("n_cells"), "top_genes")
    return Programs(own, load, table, losses)


def signatures(loadings: DataFrame, top: int = SIGNATURE) -> DataFrame:
    """``(program, gene)``: each program's ``top`` genes of positive weight, or its first ``top`` where none is positive."""
    t = loadings.withColumn("positive", F.max((F.col("weight") > 0).cast("int")).over(Window.partitionBy("program")) == 1)
    place = F.row_number().over(Window.partitionBy("program").orderBy(F.desc(F.round("weight", 9)), "gene"))
    return t.withColumn("place", place).filter((F.col("place") <= top) & ((F.col("weight") > 0) | ~F.col("positive"))).select("program", "gene")


def program_scores(counts: DataFrame, cells: DataFrame, signature: DataFrame) -> DataFrame:
    """``(cell, program, score)``: the mean, over a program's genes, of the gene's value in population spreads from its mean over
    all cells. Zeros count through the numbers of cells; a gene of no spread counts as at its mean."""
    names = cells.select("cell").distinct()
    values = normalised(counts.join(names, "cell"))
    n = names.agg(F.count(F.lit(1)).cast("double").alias("n"))
    s = values.join(signature.select("gene").distinct(), "gene").groupBy("gene").agg(F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2")).crossJoin(F.broadcast(n))
    sd = F.sqrt(F.greatest(F.col("s2") / F.col("n") - (F.col("s1") / F.col("n")) ** 2, F.lit(0.0)))
    stats = s.select("gene", (F.col("s1") / F.col("n")).alias("mean"), F.when(sd < 1e-9, 1.0).otherwise(sd).alias("sd"))
    size = signature.groupBy("program").agg(F.count(F.lit(1)).alias("size"))
    known = signature.join(stats, "gene", "left").join(F.broadcast(size), "program")
    base = known.groupBy("program").agg(F.sum(-F.coalesce(F.col("mean") / F.col("sd"), F.lit(0.0)) / F.col("size")).alias("base"))
    part = values.join(known.filter("mean IS NOT NULL"), "gene").groupBy("cell", "program").agg(F.sum(F.col("v") / F.col("sd") / F.col("size")).alias("part"))
    return names.crossJoin(F.broadcast(base)).join(part, ["cell", "program"], "left").select("cell", "program", (F.coalesce("part", F.lit(0.0)) + F.col("base")).alias("score"))


def program_specificity(scores: DataFrame, usage: DataFrame) -> DataFrame:
    """``(program, mean_in, mean_out, specificity)``: scores of the cells that a program is dominant in, of the others, and the
    chance that one of the first is higher; null where there are none."""
    t = scores.join(usage.select("cell", F.col("program").alias("__own")), "cell").withColumn("positive", F.col("program") == F.col("__own"))
    means = t.groupBy("program").agg(F.avg(F.when(F.col("positive"), F.col("score"))).alias("mean_in"), F.avg(F.when(~F.col("positive"), F.col("score"))).alias("mean_out"))
    auc = one_against_rest(t.select(F.col("program").alias("type"), "score", "positive")).select(F.col("type").alias("program"), F.col("auc").alias("specificity"))
    return means.join(auc, "program", "left")


def named_programs(usage: DataFrame, names: DataFrame) -> DataFrame:
    """``usage`` with ``label``: what ``names(program, name)`` calls the dominant program, else "Program" and its number. The number stays the key."""
    one = names.filter("name IS NOT NULL AND trim(name) <> ''").groupBy("program").agg(F.min(F.trim("name")).alias("label"))
    return usage.join(F.broadcast(one), "program", "left").withColumn("label", F.coalesce("label", F.concat(F.lit("Program "), F.col("program").cast("string"))))
