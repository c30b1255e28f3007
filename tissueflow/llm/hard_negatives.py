"""Hard negatives: exact integer scores of anchors against all rows by Strassen's multiplication, kept in small heaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table
from .vectors import common_length, slices, whole

#: Tiles are halved in all three directions until one is no longer than this.
LEAF = 32
#: Anchors and rows of a tile of scores.
ANCHORS, ROWS = 256, 1024
#: Anchors that a pass over the rows takes, on average: what a task is sent is bounded by it.
BLOCK = 8192
LEAST, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def leaf_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of whole numbers: by doubles where no sum can pass 2**53, else by 64-bit integers."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices: seven products of halves instead of eight, odd sides padded by zeros.

    Sums of halves may wrap around; as only additions and products follow, what fits 64 bits comes out exact.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return leaf_product(a, b)
    if m % 2 or k % 2 or n % 2:
        return strassen(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2))), leaf)[:m, :n]
    a11, a12, a21, a22 = a[: m // 2, : k // 2], a[: m // 2, k // 2 :], a[m // 2 :, : k // 2], a[m // 2 :, k // 2 :]
    b11, b12, b21, b22 = b[: k // 2, : n // 2], b[: k // 2, n // 2 :], b[k // 2 :, : n // 2], b[k // 2 :, n // 2 :]
    p1, p2, p3 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf), strassen(a11, b12 - b22, leaf)
    p4, p5 = strassen(a22, b21 - b11, leaf), strassen(a11 + a12, b22, leaf)
    p6, p7 = strassen(a21 - a11, b11 + b12, leaf), strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((m, n), np.int64)
    out[: m // 2, : n // 2], out[: m // 2, n // 2 :] = p1 + p4 - p5 + p7, p3 + p5
    out[m // 2 :, : n // 2], out[m // 2 :, n // 2 :] = p2 + p4, p1 - p2 + p3 + p6
    return out


class Heaps:
    """The ``keep`` best (score, id) of each slot, higher scores first, ties by smaller id; any two can be merged by
    offering one's entries to the other."""

    def __init__(self, slots: int, keep: int):
        self.score, self.id, self.keep = np.full((slots, keep), LEAST), np.full((slots, keep), LAST), keep

    def better(self, slots: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which scores (a row for each slot) would get in."""
        worst, last = self.score[slots, -1, None], self.id[slots, -1, None]
        return (score > worst) | ((score == worst) & (ids < last))

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        own = np.unique(slot)
        slot = np.concatenate([np.repeat(own, self.keep), slot])
        score, ids = np.concatenate([self.score[own].ravel(), score]), np.concatenate([self.id[own].ravel(), ids])
        order = np.lexsort((ids, ~score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.searchsorted(slot, own)
        take = first[:, None] + np.arange(self.keep)
        self.score[own], self.id[own] = score[take], ids[take]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.score != LEAST)
        return slot, place, self.score[slot, place], self.id[slot, place]


def _tiles(batches: Iterator[pa.RecordBatch], d: int, scale: int, anchors: np.ndarray):
    """``(anchor slots, row ids, row labels, scores)`` of each tile of anchors and rows."""
    for b in slices(batches, ROWS):
        at, x = whole(b.column(2), d, scale)
        ids, labels = (b.column(i).to_numpy(zero_copy_only=False)[at] for i in (0, 1))
        for lo in range(0, len(anchors) * bool(len(at)), ANCHORS):
            yield np.arange(lo, min(lo + ANCHORS, len(anchors))), ids, labels, strassen(anchors[lo : lo + ANCHORS], np.ascontiguousarray(x.T))


def _merged(partial: DataFrame, slot: list[str], keep: int) -> DataFrame:
    """The heaps of all tasks as one, a row for each entry, with its ``rank``."""
    place = F.row_number().over(Window.partitionBy(*slot).orderBy(F.desc("score"), "id"))
    return partial.withColumn("rank", place).filter(F.col("rank") <= keep)


def _mined(rows: DataFrame, block: pa.Table, d: int, scale: int, keep: int, low: tuple[int, int]) -> DataFrame:
    """One block of anchors ``(id, label, vec)`` against all rows: first its positives, then what lies in their windows."""
    sc, (part, whole_) = rows.sparkSession.sparkContext, low
    at, x = whole(block.column("vec"), d, scale)
    ids, labels = (block.column(c).to_numpy()[at] for c in ("id", "label"))
    held = sc.broadcast((ids, labels, x))

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_id, own_label, x = held.value
        best = Heaps(len(own_id), keep)
        for slots, ids, labels, score in _tiles(batches, d, scale, x):
            ok = (own_label[slots, None] == labels) & (own_id[slots, None] != ids) & best.better(slots, score, ids)
            i, j = np.nonzero(ok)
            best.offer(slots[i], score[i, j], ids[j])
        slot, _, score, ids = best.entries()
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (slot, score, ids)], names=["slot", "score", "id"])

    found = _merged(rows.mapInArrow(positives, "slot long, score long, id long"), ["slot"], keep).collect()  # keep rows an anchor of the block
    pos = [(r["slot"], r["rank"], r["id"], r["score"], -(-part * r["score"] // whole_)) for r in found]
    windows = sc.broadcast(np.array(sorted(pos), np.int64).reshape(-1, 5))

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own_id, own_label, x), w = held.value, windows.value
        best = Heaps(len(w), keep)
        first, last = np.searchsorted(w[:, 0], np.arange(len(own_id))), np.searchsorted(w[:, 0], np.arange(len(own_id)), "right")
        for slots, ids, labels, score in _tiles(batches, d, scale, x):
            other = own_label[slots, None] != labels
            for k in range(keep):  # the k-th positive of each anchor
                has = np.flatnonzero(first[slots] + k < last[slots])
                which = first[slots[has]] + k
                s = score[has]
                i, j = np.nonzero(other[has] & (s >= w[which, 4, None]) & (s <= w[which, 3, None]) & best.better(which, s, ids))
                best.offer(which[i], s[i, j], ids[j])
        slot, _, score, ids = best.entries()
        yield pa.RecordBatch.from_arrays([pa.array(own_id[w[slot, 0]]), pa.array(w[slot, 2]), pa.array(w[slot, 3]), pa.array(slot), pa.array(score), pa.array(ids)], names=["anchor_id", "positive_id", "positive_score", "slot", "score", "id"])

    partial = rows.mapInArrow(negatives, "anchor_id long, positive_id long, positive_score long, slot long, score long, id long")
    return _merged(partial, ["slot"], keep).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", scale: int = 256, keep: int = 5, low: tuple[int, int] = (4, 5), block: int = BLOCK) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: for each row where ``anchor`` holds and
    each of its ``keep`` best rows of the same label, the best ``keep`` of another label that score at most as high and at
    least ``low`` (a fraction) of it.

    Scores are inner products of ``floor(scale * entry)``. Rows take no part if id, label or vector is null, the vector
    isn't of the commonest length, or an entry is null, not finite or of magnitude 2**18 and more. Rows with an anchor's
    id are that anchor itself; of several anchors of one id the least (by label, then vector) counts, other repeated rows
    count as often as they are there. Empty tables and anchors without partners give no rows. Other columns aren't read.

    The anchors go over the rows in blocks of some ``block``, two passes each; a task keeps ``keep`` rows a positive.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    d = common_length(rows, "vec")
    asked = rows.filter(F.col("anchor") & (F.size("vec") == d) & F.forall("vec", lambda x: F.coalesce(F.abs(x) < (1 << 18), F.lit(False)))).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r")).select("id", "r.label", "r.vec")
    n = asked.count() if d else 0
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows, blocks = rows.select("id", "label", "vec"), -(-n // block)
    asked = saved(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))))
    parts = (_mined(rows, asked.filter(F.col("block") == i).drop("block").toArrow(), d, scale, keep, low) for i in range(blocks))
    out = next(parts)
    if blocks > 1:
        out = saved(out)
        for p in parts:
            out = out.union(saved(p))
    return out


def hard_negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    shifted = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(shifted, F.col("vec_id") % 100 == 0)


HARD_NEGATIVES_SQL = """WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
  s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
  p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same) t WHERE place <= 5),
  n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
  SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
