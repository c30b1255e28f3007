"""Toxicity by compression distance: two zstandard dictionaries, window lengths compared, thresholds calibrated."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_bytes
from .labelled import SAMPLE, logistic_fit, prior_shift, remainder, sigmoid, training_rows

MODULUS, HELD_OUT, THRESHOLD = 3, 1, 0.7
#: Bytes of a window (it ends at white space where there is some) and of the ordinary dictionary's trained content.
WINDOW, ORDINARY_BYTES = 128, 112 << 10
#: Bytes of the toxic dictionary's own content that are tried; the training rows' own folds choose one.
TOXIC_BYTES = (256, 384)
#: Training rows are split into so many folds to choose and calibrate by; held-out rows have no part in it.
FOLDS = 3
#: A word is telling where at least so many of a hundred toxic documents hold it, and its share of them is so many
#: times that of the ordinary ones; the toxic dictionary's own content is trained on toxic texts' telling words.
SUPPORT, RATIO = 2, 10
#: The start offsets of matches, 1, 4 and 8, which end a trained dictionary's tables.
OFFSETS = b"".join(n.to_bytes(4, "little") for n in (1, 4, 8))
#: Least bytes of a match.
MATCH = 4
#: Bytes of a word's beginnings that may be telling for all words that begin so.
STEMS = (4, 5, 6, 7, 8)
#: A window is telling where the toxic dictionary saves at least so many bytes over the ordinary one.
GAINS = (2, 4, 6, 9)


def windows(data: bytes) -> list[bytes]:
    """The text in windows of at most WINDOW bytes, cut after the last space where one is in the later half."""
    out, at, n, size = [], 0, len(data), WINDOW
    while at < n:
        end = at + size
        if end < n:
            cut = data.rfind(b" ", at + size // 2, end)
            end = cut + 1 if cut >= 0 else end
        out.append(data[at:end])
        at = end
    return out


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(window_log=18, hash_log=16, chain_log=16, search_log=4, min_match=MATCH, target_length=32, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


def lengths(c: zstandard.ZstdCompressor, parts: list[bytes]) -> np.ndarray:
    compress = c.compress
    return np.fromiter((len(compress(p)) for p in parts), np.float64, len(parts))


def gains(pair: tuple, data: bytes) -> np.ndarray:
    """For each window, the bytes by which the toxic dictionary compresses it better."""
    parts = windows(data)
    return lengths(pair[0], parts) - lengths(pair[1], parts) if parts else np.zeros(0)


WIDTH = 3 + len(GAINS)


def summary(g: np.ndarray) -> np.ndarray:
    """What the calibration sees of a document's gains: the greatest, the mean, the number of windows, and how many
    windows are telling."""
    if not len(g):
        return np.zeros(WIDTH)
    return np.array([g.max() / 4, g.mean(), np.log1p(len(g)) / 4, *(np.log1p((g >= t).sum()) for t in GAINS)])


def content(parts: list[bytes], size: int, segment: int = 32, unit: int = 6) -> bytes:
    """The frequent content of the parts, as zstandard's dictionary training finds it; few parts are used raw.

    More is trained than kept: the commonest content stands last, where a match costs least. The tables of codes that
    stand before the content are left out.
    """
    try:
        trained = zstandard.train_dictionary(max(size, 16 << 10), parts, k=segment, d=unit).as_bytes()
        return trained.rpartition(OFFSETS)[2][-size:]
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


def telling_passages(ordinary: list[bytes], toxic: list[bytes]) -> list[bytes]:
    """Of each toxic text what its telling words hold: the longest telling beginning of each, else the whole word."""
    df = [Counter(w for t in texts for w in _stems(t)) for texts in (ordinary, toxic)]
    least = max(3, SUPPORT * len(toxic) / 100)
    told = {w for w, n in df[1].items() if n >= least and n / len(toxic) >= RATIO * (df[0][w] + 1) / (len(ordinary) + 1)}
    out = []
    for t in toxic:
        kept = []
        for w in t.lower().split():
            begins = [n for n in STEMS if w[:n] in told]
            if begins or w in told:
                kept.append(w[: max(begins)] if begins else w)
        if kept:
            out.append(b" " + b" ".join(kept) + b" ")
    return out


def _stems(text: bytes) -> set[bytes]:
    words = set(text.lower().split())
    return words.union(*({w[:n] for w in words if len(w) > n} for n in STEMS))


def dictionaries(ordinary: list[bytes], toxic: list[bytes], sizes: tuple[int, ...] = TOXIC_BYTES) -> list[tuple[bytes, bytes]]:
    """An (ordinary, toxic) pair of dictionaries for each size.

    Toxic documents are mostly ordinary text, so the toxic dictionary's own content is trained on their telling
    passages. Before it stands the ordinary dictionary's content, at the same distance in both, so that ordinary
    text costs the same by either.
    """
    common, passages = content([w for t in ordinary for w in windows(t)], ORDINARY_BYTES), telling_passages(ordinary, toxic)
    told = [content(passages, size, 12) for size in sizes]
    return [(common + common[: len(x)], common + x) for x in told]


def fit(samples: list[tuple[int, bytes]], shift: float) -> tuple[bytes, bytes, np.ndarray]:
    """(ordinary dictionary, toxic dictionary, calibration weights).

    Each fold is scored by dictionaries of the others; the calibration is fitted on those scores, and the size whose
    calibrated scores lose least is taken. The dictionaries returned are trained on all rows.
    """
    y = np.array([s[0] for s in samples], int)
    fold = np.arange(len(y)) % FOLDS
    if any(len(set(y[fold != f].tolist())) < 2 for f in range(FOLDS)):
        return b"", b"", np.append(np.zeros(WIDTH), shift)
    texts = lambda c, f=-1: [t for (label, t), g in zip(samples, fold, strict=True) if label == c and g != f]
    x = np.zeros((len(TOXIC_BYTES), len(y), WIDTH))
    for f in range(FOLDS):
        for i, (ordinary, toxic) in enumerate(dictionaries(texts(0, f), texts(1, f))):
            pair = compressor(ordinary), compressor(toxic)
            for j in np.flatnonzero(fold == f):
                x[i, j] = summary(gains(pair, samples[j][1]))
    weights = [logistic_fit(x_, y, ridge=1e-1) for x_ in x]
    losses = [_loss(x_, y, w) for x_, w in zip(x, weights, strict=True)]
    best = int(np.argmin(losses))
    weights[best][-1] += shift
    return *dictionaries(texts(0), texts(1), TOXIC_BYTES[best : best + 1])[0], weights[best]


def _loss(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    """The mean log-loss of the two classes, which weigh alike."""
    p = sigmoid(np.hstack([x, np.ones((len(x), 1))]) @ weights)
    cost = -np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-9, 1))
    return float(cost[y == 1].mean() + cost[y == 0].mean())


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[bytes, bytes, np.ndarray]:
    """Fit on at most ``per_class`` labelled rows a class whose id remainder isn't the held-out one, in one task."""
    rows, counts = training_rows(docs, labels, "toxic", remainder(MODULUS) != HELD_OUT, per_class)
    shift = prior_shift(counts)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        ordinary, toxic, weights = fit(samples, shift)
        yield pa.RecordBatch.from_arrays([pa.array([ordinary], pa.binary()), pa.array([toxic], pa.binary()), pa.array([weights.tolist()])], names=["ordinary", "toxic", "weights"])

    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "y").select("y", "text")
    model = ordered.mapInArrow(solve, "ordinary binary, toxic binary, weights array<double>").first()
    if model is None:
        return b"", b"", np.append(np.zeros(WIDTH), shift)
    return bytes(model["ordinary"]), bytes(model["toxic"]), np.array(model["weights"])


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``; whole texts are compressed, by windows.

    ``labels(doc_id, toxic)`` are learnt from where crc32(doc_id as text) mod 3 is not 1. Null texts count as
    empty and get the calibration's value for no window; a null id counts as an empty text in the remainder; null
    labels are left out. Without labels of both classes every score is the share of label 1, or 0.5. Repeated rows
    are scored alike; other columns aren't read; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, toxic, weights = held.value
        pair = (compressor(ordinary), compressor(toxic)) if ordinary else None
        none = np.zeros(0)
        for b in batches:
            x = [summary(gains(pair, t) if pair else none) for t in b.column(1).to_pylist()]
            z = np.hstack([np.array(x).reshape(len(x), WIDTH), np.ones((len(x), 1))]) @ weights
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigmoid(z))], names=["doc_id", "score"])

    out = docs.select("doc_id", text_bytes().alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (remainder(MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_query(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
