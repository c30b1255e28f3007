"""Whitening of embeddings by shifted CholeskyQR: the rows stay where they are, only d x d matrices travel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectors import common_length, slices, whole

SCALE, OFFSET, TOP = 64, 1_000_000, 32
#: Rows that a task holds as doubles at a time.
ROWS = 4096
#: Factorisations at most. Two or three are enough unless the rows have directions without variance.
PASSES = 6
#: A Gram matrix so near to the identity needs one more factor and no further pass.
NEAR = 1e-6
#: Components of less than this share of the first one's variance have none.
FLAT = 1e-18
SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _solved(c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``c`` times the inverse of the upper triangle ``r``, column by column."""
    q = np.empty_like(c)
    for j in range(len(r)):
        q[:, j] = (c[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


class Whitener:
    """The passes over ``rows(id_col, vec_col)``; what the tasks get and give has the size of the dimension alone."""

    def __init__(self, rows: DataFrame, id_col: str, vec_col: str, scale: int = SCALE, offset: int = OFFSET):
        self.rows, self.scale, self.offset = rows.select(id_col, vec_col), scale, offset
        self.sc = rows.sparkSession.sparkContext
        self.d = common_length(rows, vec_col)
        self.n, self.sums = self._sums() if self.d else (0, [])

    def _integers(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        at, x = whole(b.column(1), self.d, self.scale)
        return at, x + self.offset

    def _sums(self) -> tuple[int, list[int]]:
        """How many rows count, and the exact sum of each dimension."""
        integers = self.plain()._integers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s = 0, 0
            for b in slices(batches, ROWS):
                _, x = integers(b)
                n, s = n + len(x), s + x.sum(axis=0)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(s)), pa.int32()), pa.array([n, *s.tolist()], pa.int64())], names=["dim", "s"])

        found = {r["dim"]: int(r["s"]) for r in self.rows.mapInArrow(run, "dim int, s long").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
        return found.pop(-1, 0), [found[i] for i in sorted(found)]

    def plain(self) -> Whitener:
        """Without Spark's own objects, for tasks."""
        out = object.__new__(Whitener)
        out.__dict__ |= {k: v for k, v in self.__dict__.items() if k not in ("rows", "sc")}
        return out

    def deviations(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows that count, and n times each less the sums: exact whole numbers."""
        at, x = self._integers(b)
        return at, x * self.n - np.array(self.sums, np.int64)

    def gram(self, basis: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
        """Q'Q of the centred rows in ``basis``, solved by each of the factors in turn."""
        me, held = self.plain(), self.sc.broadcast((basis, factors))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            basis, factors = held.value
            g = np.zeros((basis.shape[1],) * 2)
            for b in slices(batches, ROWS):
                q = (me.deviations(b)[1] / me.n) @ basis
                for r in factors:
                    q = _solved(q, r)
                g += q.T @ q
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(g.size), pa.int64()), pa.array(g.ravel())], names=["at", "g"])

        k = basis.shape[1]
        out = np.zeros(k * k)
        for r in self.rows.mapInArrow(run, "at long, g double").groupBy("at").agg(F.sum("g").alias("g")).collect():  # k x k rows
            out[r["at"]] = r["g"]
        return out.reshape(k, k)

    def factor(self, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Right singular vectors and values of the centred rows in ``basis``, and their total square.

        The first Gram matrix is shifted so that it has a Cholesky factor whatever its condition; rows solved by it are
        factored again until they are orthonormal. The product of the factors, last first, is R of the rows' QR.
        """
        factors, total, r = [], 0.0, np.eye(basis.shape[1])
        for turn in range(PASSES):
            g = self.gram(basis, factors)
            d, size = len(g), float(np.linalg.norm(g, 2)) if len(g) else 0.0
            if not turn:
                total = float(np.trace(g))
            if not size:
                return basis[:, :0], np.zeros(0), total
            shift = 11 * (self.n * d + d * (d + 1)) * np.finfo(float).eps * size
            near = np.abs(g - np.eye(d)).max() <= NEAR
            try:
                new = np.linalg.cholesky(g + (0 if turn else shift) * np.eye(d)).T
            except np.linalg.LinAlgError:
                new = np.linalg.cholesky(g + shift * np.eye(d)).T
            factors, r = [*factors, new], new @ r
            if near:
                break
        _, s, vt = np.linalg.svd(r)
        return basis @ vt.T, s, total

    def components(self, top: int) -> tuple[np.ndarray, np.ndarray, float, float]:
        """``(vectors, variances, total variance, identity error)`` of the first components."""
        v, s, total = self.factor(np.eye(self.d))
        own = np.diag(self.gram(v, []))
        flat = own <= FLAT * max(own, default=0.0)
        if flat.any() and not flat.all():  # directions without variance hold up the orthogonalisation: leave them out
            v, s, _ = self.factor(v[:, ~flat])
        elif flat.all():
            v, s = v[:, :0], s[:0]
        v, e = v[:, :top], s[:top] ** 2 / self.n
        cov = self.gram(v / np.sqrt(e), []) / self.n
        return v, e, total / self.n, float(np.abs(cov - np.eye(len(e))).max(initial=0.0))


def whitened(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``(id_col, component, n, deviation, whitened, explained, identity_error)`` of each row and component up to ``top``.

    Entries become ``floor(scale * entry) + offset``. A row doesn't count, and has no result, if its vector is null, holds
    a null, an entry that isn't finite or of magnitude 2**18 and more, or isn't of the commonest length. Rows with a null or
    repeated id count each. Components without variance aren't returned: one row, or equal rows only, give no result, as
    an empty table does. ``deviation`` is null where it passes 63 bits. Other columns are not read.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {SCHEMA}"
    w = Whitener(rows, id_col, vec_col, scale, offset)
    if not w.n:
        return rows.sparkSession.createDataFrame([], schema)
    v, e, total, error = w.components(top)
    me, held = w.plain(), w.sc.broadcast((v / np.sqrt(e), e / total if total else e))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, explained = held.value
        k = len(explained)
        for b in slices(batches, ROWS):
            at, c = me.deviations(b)
            if not k or not len(at):
                continue
            large = np.abs(c).max(initial=0) >= 1 << 28 or len(me.sums) > 1 << 7
            square = [None if x >> 63 else x for x in (sum(y * y for y in row) for row in c.tolist())] if large else (c * c).sum(axis=1).tolist()
            each = np.repeat(np.arange(len(at)), k)
            columns = [b.column(0).take(pa.array(at[each])), np.tile(np.arange(1, k + 1, dtype=np.int32), len(at)), np.full(len(each), me.n), pa.array(square, pa.int64()).take(pa.array(each)), ((c / me.n) @ axes).ravel(), np.tile(explained, len(at)), np.full(len(each), error)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return w.rows.mapInArrow(run, schema)


def whitening_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
