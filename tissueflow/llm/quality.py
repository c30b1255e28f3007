"""Quality classifier: a linear support vector machine on n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, bounded_batches, mixed, run_hashes, table, text_bytes
from .labelled import SAMPLE, logistic_fit, prior_shift, remainder, sigmoid, training_rows

#: Features are hashed to 2**BITS columns.
BITS = 18
MODULUS, HELD_OUT, THRESHOLD = 4, 2, 0.7
#: Documents that the pipeline rejects have a score below this: it is likelier that they are bad than good.
REJECT = 0.5
#: Shape class of each byte: 0 white space, 1 upper case, 2 lower case, 3 digit, 4 part of a longer character,
#: 5 and more one of the punctuation bytes, each its own class.
CLASSES = np.array([0 if c in b" \t\n\v\f\r" else 1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 else 3 if 48 <= c <= 57 else 4 if c >= 128 else 5 + c for c in range(256)], np.uint8)


def _pairs(h: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hashes of n consecutive values."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, salt, np.uint64)
    for k in range(n):
        out = (out * BASE) ^ h[k : len(h) - n + 1 + k]
    return mixed(out)


def features(data: bytes) -> np.ndarray:
    """Sorted distinct feature columns of a text.

    N-grams of words (one and two) and of word shapes (one to three). A shape is a word's sequence of character
    classes without repeats, marked where the word equals the one before it.
    """
    codes = np.frombuffer(data, np.uint8)
    kinds = CLASSES[codes]
    inside = np.concatenate([[False], kinds != 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.int32)
    words = run_hashes(codes, starts, ends - starts)
    change = np.empty(len(kinds), bool)
    change[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:])
    change &= kinds != 0
    at = np.flatnonzero(change)
    first = np.searchsorted(at, starts)
    shapes = run_hashes(kinds[at], first, np.diff(np.append(first, len(at))))
    shapes[1:] ^= np.where(words[1:] == words[:-1], BASE, np.uint64(0))
    grams = [words, _pairs(words, 2, 2), *(_pairs(shapes, n, 10 + n) for n in (1, 2, 3))]
    columns = np.sort((np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int32))
    return columns[np.concatenate([[True], columns[1:] != columns[:-1]])]


def coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Hinge-loss weights by dual coordinate descent: one multiplier a row, kept in 0..cost, updated in turn."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    norms = np.array([max(float(v @ v), 1e-12) for v in values])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        largest = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * float(w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                largest = max(largest, abs(new - alpha[i]))
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                alpha[i] = new
        if largest < 1e-4:
            break
    return w


def fit(samples: list[tuple[int, np.ndarray]], shift: float) -> tuple[np.ndarray, float, float]:
    """(column weights, slope, offset) from (label, features) rows.

    Ratios are those of add-one counts, with the classes' shares apart. One row in five only serves to calibrate:
    its margins give slope and offset of the logistic curve; ``shift`` brings in the classes' shares.
    """
    y = np.array([s[0] for s in samples])
    held = np.arange(len(y)) % 5 == 4
    size = 1 << BITS
    if len(set(y.tolist())) < 2 or len(set(y[held].tolist())) < 2:
        return np.zeros(size, np.float32), 0.0, shift
    count = np.ones((2, size))
    for (label, columns), out in zip(samples, held, strict=True):
        if not out:
            count[label][columns] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    train = [i for i in range(len(y)) if not held[i]]
    scaled = [ratio[samples[i][1]] / np.sqrt(max(1, len(samples[i][1]))) for i in train]
    share = np.array([len(train) / (2 * max(1, (y[train] == y[i]).sum())) for i in train])
    w = coordinate_descent([samples[i][1] for i in train], scaled, np.where(y[train] == 1, 1.0, -1.0), size, share)
    weights = (w * ratio).astype(np.float32)
    margins = np.array([margin(samples[i][1], weights) for i in np.flatnonzero(held)])
    slope, offset = logistic_fit(margins[:, None], y[held], ridge=1e-1)
    return weights, float(slope), float(offset) + shift


def margin(columns: np.ndarray, weights: np.ndarray) -> float:
    return float(weights[columns].sum(dtype=np.float64)) / max(1.0, float(np.sqrt(len(columns))))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[np.ndarray, float, float]:
    """Fit on a sample of at most ``per_class`` labelled rows a class whose id remainder isn't the held-out one.

    The rows' features are made where the texts are; the bounded sample is fitted in one task.
    """
    rows, counts = training_rows(docs, labels, "quality", remainder(MODULUS) != HELD_OUT, per_class)
    shift = prior_shift(counts)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(x).astype("<i4").tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array(f, pa.binary())], names=["id", "y", "f"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [x for b in batches for x in zip(b.column(1).to_pylist(), (np.frombuffer(f, "<i4") for f in b.column(2).to_pylist()), strict=True)]
        w, slope, offset = fit(samples, shift)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([slope]), pa.array([offset])], names=["w", "slope", "offset"])

    made = rows.mapInArrow(extract, "id string, y int, f binary")
    model = made.repartition(1).sortWithinPartitions(F.xxhash64("id"), "y").mapInArrow(solve, "w binary, slope double, offset double").first()
    if model is None:
        return np.zeros(1 << BITS, np.float32), 0.0, shift
    return np.frombuffer(model["w"], np.float32), model["slope"], model["offset"]


def scored(docs: DataFrame, model: tuple[np.ndarray, float, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)`` for every row; a null or empty text has no features and gets the curve's value at 0."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, slope, offset = held.value
        for b in batches:
            m = np.fromiter((margin(features(x), weights) for x in b.column(1).to_pylist()), np.float64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigmoid(slope * m + offset))], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_bytes(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    ``labels(doc_id, quality)`` are learnt from where crc32(doc_id as text) mod 4 is not 2; the score is the
    calibrated probability of label 1. Nulls: a null text counts as empty, a null id as an empty text in the
    remainder, null labels are left out. Without labels of both classes every score is the share of label 1, or 0.5.
    Repeated rows are scored alike; other columns aren't read; an empty table gives an empty result.
    """
    out = scored(docs, train(docs, labels, per_class))
    return out.select("doc_id", (remainder(MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns as they were, whose score is REJECT or more; the score is made beside the
    row in one pass, so rows need no key and nothing is shuffled."""
    bounded_batches(docs.sparkSession)
    model = train(docs, labels, per_class)
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, slope, offset = held.value
        for b in batches:
            m = np.fromiter((margin(features((x or "").encode()), weights) for x in b.column(place).to_pylist()), np.float64, b.num_rows)
            yield b.filter(pa.array(sigmoid(slope * m + offset) >= REJECT))

    return docs.mapInArrow(run, docs.schema)


def quality_query(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
