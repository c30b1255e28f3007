"""Copy-number burden of cells from smoothed expression along the genome, against cells that are held to be normal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissueflow.durable import saved
from tissueflow.operators.ranks import percentiles

#: Words of a label that no normal type has.
TUMOUR_WORDS = ("Malignant", "Tumor", "Epithelial")
LEAST_CELLS, LEAST_GENES, NEAR, WINDOW, STEP, NOISE = 20, 100, 100, 100, 10, 1.5
#: Cells that a task takes at a time.
CELLS = 256


def normal_cells(cells: DataFrame, normal: list | None = None, purity: float | None = None, enough: int = 200, least: int = LEAST_CELLS) -> DataFrame:
    """``(cell, normal)``: which of ``cells(cell, label[, pmp])`` serve as reference: those of the ``normal`` labels, by default all
    without a word of TUMOUR_WORDS, that have ``least`` cells. With ``purity`` only cells whose pmp is as high (null: 0), if
    ``enough`` are. None is where fewer than ``least`` remain."""
    label = F.col("label")
    told = label.isin(normal) if normal else ~F.coalesce(label.rlike("|".join(TUMOUR_WORDS)), F.lit(True))
    size = F.count(F.lit(1)).over(Window.partitionBy("label"))
    t = cells.withColumn("ok", F.coalesce(told, F.lit(False))).withColumn("ok", F.col("ok") & (size >= least))
    if purity is not None:
        pure = F.col("ok") & (F.coalesce(F.col("pmp"), F.lit(0.0)) >= purity)
        n = t.agg(F.count_if(pure).alias("__pure"))
        t = t.withColumn("pure", pure).crossJoin(F.broadcast(n)).withColumn("ok", F.when(F.col("__pure") >= enough, F.col("pure")).otherwise(F.col("ok")))
    whole = t.agg(F.count_if("ok").alias("__n"))
    return t.crossJoin(F.broadcast(whole)).select("cell", (F.col("ok") & (F.col("__n") >= least)).alias("normal"))


def smoothed(values: DataFrame, edges: DataFrame) -> DataFrame:
    """``(cell, gene, v)``: the mean of ``values(cell, gene, v)`` over the cells that ``edges(src, dst)`` lead to, weighted by ``w`` if
    it is there. Only genes that some neighbour has get a row; a cell without neighbours keeps its own values.

    A cell's values go to those it is a neighbour of as one row; rows of a cell lie in one partition afterwards."""
    w = edges.select("src", F.col("dst").alias("cell"), (F.col("w") if "w" in edges.columns else F.lit(1.0)).alias("w")).withColumn("t", F.sum("w").over(Window.partitionBy("src")))
    lists = values.groupBy("cell").agg(F.collect_list(F.struct("gene", "v")).alias("x"))
    alone = lists.select("cell").join(edges.select(F.col("src").alias("cell")), "cell", "left_anti").select(F.col("cell").alias("src"), "cell", F.lit(1.0).alias("w"), F.lit(1.0).alias("t"))
    met = w.union(alone).join(lists, "cell").select("src", "w", "t", "x").repartition("src")
    near = met.select("src", "w", "t", F.explode("x").alias("x")).groupBy("src", "x.gene").agg(F.sum(F.col("w") * F.col("x.v")).alias("s"), F.first("t").alias("t"))
    return near.select(F.col("src").alias("cell"), "gene", (F.col("s") / F.col("t")).alias("v"))


def _to_median(values: DataFrame) -> DataFrame:
    t = values.groupBy("cell").agg(F.sum("v").alias("t")).filter("t > 0")
    return values.join(t, "cell").crossJoin(F.broadcast(percentiles(t, "t", m=0.5))).select("cell", "gene", (F.col("v") * F.col("m") / F.col("t")).alias("v"))


@dataclass(frozen=True)
class Windows:
    """Windows along the genome, numbered over all chromosomes, whose numbers of genes are ``sizes``. A gene is the long
    ``chromosome * 2**32 + place``, chromosomes from 0 and places from 1."""

    sizes: np.ndarray
    width: int
    step: int

    @property
    def number(self) -> np.ndarray:
        """Windows of each chromosome: whole ones, one where it is shorter."""
        return np.maximum((self.sizes - self.width) // self.step, 0) + 1

    def of(self, gene: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(at, window)``: a row for each window that each gene lies in, ``at`` being the gene's place in the input."""
        chromosome, place = gene >> 32, gene & 0xFFFFFFFF
        first = np.maximum(-((self.width - place) // self.step), 0)
        last = np.minimum((place - 1) // self.step, self.number[chromosome] - 1)
        n = np.maximum(last - first + 1, 0)
        at = np.repeat(np.arange(len(gene)), n)
        start = (np.cumsum(self.number) - self.number)[chromosome] + first
        return at, start[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)

    @property
    def widths(self) -> np.ndarray:
        return np.repeat(np.minimum(self.sizes, self.width), self.number).astype(float)


def _bases(means: DataFrame, windows: Windows) -> np.ndarray:
    """The reference's mean of every window, of ``means(gene, mean)``: one number for ``step`` genes is all that the driver sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, window = windows.of(b["gene"].to_numpy())
            yield pa.record_batch({"window": window, "s": b["mean"].to_numpy()[at]})

    found = means.select("gene", "mean").mapInArrow(run, "window long, s double").groupBy("window").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(int(windows.number.sum()))
    out[found["window"].to_numpy()] = found["s"].to_numpy()
    return out / windows.widths


def _window_means(b: pa.RecordBatch, windows: Windows, target: float) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Some cells at a time, ``(rows, row, window, mean)`` of the windows in which a cell has counts."""
    widths, w = windows.widths, int(windows.number.sum())
    total, genes, values = b["t"].to_numpy(), b["genes"], b["values"]
    ends = genes.offsets.to_numpy()
    gene, value = genes.values.to_numpy(), values.values.to_numpy()
    for lo in range(0, b.num_rows, CELLS):
        hi = min(lo + CELLS, b.num_rows)
        part = slice(ends[lo], ends[hi])
        row = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
        at, window = windows.of(gene[part])
        key, inverse = np.unique(row[at] * w + window, return_inverse=True)
        v = np.log1p(value[part] * target / total[lo:hi][row])
        yield slice(lo, hi), key // w, key % w, np.bincount(inverse, v[at], len(key)) / widths[key % w]


def burden(counts: DataFrame, cells: DataFrame, positions: DataFrame, edges: DataFrame, window: int = WINDOW, step: int = STEP, noise: float = NOISE, least: int = LEAST_GENES) -> DataFrame:
    """``(cell, burden, malignant)`` of ``cells(cell, normal)``.

    Counts of the genes with ``positions(gene, chromosome, start)`` are scaled to their median total, smoothed over ``edges``,
    scaled again and log-scaled. A cell's values less the reference's mean of the gene are averaged over ``window`` genes, every
    ``step``-th along a chromosome (the whole chromosome where it is shorter); window means within ``noise`` spreads of all of
    them count as zero. The burden is their root mean square, and malignant is above the reference's 95th percentile.

    A gene's zeros count as less its mean: windows are sums over the genes a cell has, by the number of genes, less the
    windows of the means. Raises with fewer than ``least`` positioned genes or without a reference; a gene of two positions takes
    the first. Cells without counts on these genes have a null burden and aren't malignant.
    """
    place = positions.filter("chromosome IS NOT NULL AND start IS NOT NULL").groupBy("gene").agg(F.min(F.struct("chromosome", "start")).alias("p")).join(counts.filter("value > 0").select("gene").distinct(), "gene")
    by = Window.partitionBy("chromosome")
    at = saved(place.select("gene", "p.chromosome", F.row_number().over(Window.partitionBy("p.chromosome").orderBy("p.start", "gene")).alias("pos")).withColumn("size", F.count(F.lit(1)).over(by)))
    if at.count() < least:
        raise ValueError(f"fewer than {least} genes have a position")
    if cells.filter("normal").isEmpty():
        raise ValueError("no cells serve as reference")
    lengths = sorted((r["chromosome"], r["size"]) for r in at.select("chromosome", "size").distinct().collect())  # chromosomes
    code = F.element_at(F.create_map(*(F.lit(x) for i, (c, _) in enumerate(lengths) for x in (c, i))), F.col("chromosome"))
    coded = at.select("gene", (F.shiftleft(code.cast("long"), 32) + F.col("pos")).alias("at"))
    windows = Windows(np.array([n for _, n in lengths], np.int64), window, step)
    own = counts.filter("value > 0").join(coded, "gene").join(cells.select("cell").distinct(), "cell").groupBy("cell", F.col("at").alias("gene")).agg(F.sum(F.col("value").cast("double")).alias("v"))
    scaled = saved(_to_median(saved(own)))
    lists = smoothed(scaled, edges).groupBy("cell").agg(F.collect_list("gene").alias("genes"), F.collect_list("v").alias("values"), F.sum("v").alias("t")).filter("t > 0")
    is_normal = cells.groupBy("cell").agg(F.max("normal").alias("normal"))
    near = saved(lists.join(is_normal, "cell").select("cell", "normal", "t", "genes", "values"))
    target = percentiles(near, "t", m=0.5).first()["m"]
    target = float(target if target is not None else 1.0)
    n, n_normal = near.agg(F.count(F.lit(1)), F.count_if("normal")).first()
    value = F.explode(F.arrays_zip("genes", "values")).alias("x")
    mean = near.filter("normal").select("t", value).groupBy("x.genes").agg(F.sum(F.log1p(F.col("x.values") * target / F.col("t"))).alias("s")).select(F.col("genes").alias("gene"), (F.col("s") / F.lit(float(n_normal or 1))).alias("mean"))
    base = _bases(mean, windows)
    held = near.sparkSession.sparkContext.broadcast(base)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2)
        for b in batches:
            for _, _, at, x in _window_means(b, windows, target):
                out += x.sum(), (x * (x - 2 * held.value[at])).sum()
        yield pa.record_batch({"a": out[:1], "b": out[1:]})

    # Windows in which a cell has nothing are the base alone, so they are counted, not made.
    a, b = near.mapInArrow(moments, "a double, b double").agg(F.sum("a"), F.sum("b")).first()
    every = max(n * len(base), 1)
    limit = noise * max(((b or 0.0) + n * (base**2).sum()) / every - (((a or 0.0) - n * base.sum()) / every) ** 2, 0.0) ** 0.5

    def loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = np.where(np.abs(held.value) < limit, 0.0, held.value) ** 2
        for b in batches:
            out = np.zeros(b.num_rows)
            for rows, row, at, x in _window_means(b, windows, target):
                size, own = rows.stop - rows.start, x - held.value[at]
                left = np.count_nonzero(far) - np.bincount(row, far[at] > 0, size)
                rest = np.where(left > 0, far.sum() - np.bincount(row, far[at], size), 0.0)
                out[rows] = np.sqrt((rest + np.bincount(row, np.where(np.abs(own) < limit, 0.0, own) ** 2, size)) / len(far))
            yield pa.record_batch({"cell": b["cell"], "normal": b["normal"], "burden": out})

    load = saved(near.mapInArrow(loads, f"cell {dict(near.dtypes)['cell']}, normal boolean, burden double"))
    bar = percentiles(load.filter("normal"), "burden", bar=0.95)
    found = load.crossJoin(F.broadcast(bar)).select("cell", "burden", (F.col("burden") > F.col("bar")).alias("malignant"))
    return cells.select("cell").distinct().join(found, "cell", "left").select("cell", "burden", F.coalesce("malignant", F.lit(False)).alias("malignant"))
