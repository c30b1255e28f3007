"""Lempel-Ziv phrase fingerprints: the set of dictionary phrases of a text as a minimum-hash signature."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, shuffle_partitions, table

#: Components of a signature; each keeps its minimum's lowest byte.
SIZE = 64
#: Words longer than this are parsed in parts of it, so that texts without spaces have phrases too.
LONGEST = 32
MULTIPLIERS = mixed(np.arange(1, SIZE + 1, dtype=np.uint64)) | np.uint64(1)
OFFSETS = mixed(np.arange(1001, 1001 + SIZE, dtype=np.uint64))


def phrases(text: str) -> set[str]:
    """LZ78 over words: each phrase is the longest one seen before plus one word."""
    words = text.split()
    if words and max(map(len, words)) > LONGEST:
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    seen: set[str] = set()
    add, now = seen.add, ""
    for w in words:
        now += " " + w
        if now not in seen:
            add(now)
            now = ""
    return seen


def signature(text: str) -> bytes:
    """For each of SIZE hash functions the lowest byte of the least value over the phrases; 255s for no phrase."""
    found = phrases(text)
    if not found:
        return b"\xff" * SIZE
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(p) for p in found), np.uint64, len(found))
    least = np.full(SIZE, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(h), 4096):
        np.minimum(least, (h[lo : lo + 4096, None] * MULTIPLIERS + OFFSETS).min(axis=0), out=least)
    return mixed(least).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated share of common phrases: agreeing components, less what bytes agree by chance."""
    same = sum(x == y for x, y in zip(a, b, strict=True)) / SIZE
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _dealt(docs: DataFrame) -> DataFrame:
    """Rows (bucket, ahead, doc_id, text): documents in buckets of falling id, and in each bucket, marked ``ahead``,
    the document that follows its last one.

    Bucket borders are quantiles of the id; of the borders' documents only ids reach the driver, one a bucket, and
    buckets are a small multiple of the shuffle partitions. A null id comes last, like the smallest id.
    """
    spark = docs.sparkSession
    n = 8 * shuffle_partitions(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    edges = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"] or []
    edges = sorted(set(edges), reverse=True)
    if edges:
        bucket = F.when(F.col("doc_id").isNull(), F.lit(len(edges))).otherwise(F.aggregate(F.lit(edges), F.lit(0), lambda a, e: a + (F.col("doc_id") < e).cast("int")))
    else:
        bucket = F.lit(0)
    placed = rows.withColumn("bucket", bucket)
    heads = placed.groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy("bucket").collect()
    after = {h["bucket"]: heads[(i + 1) % len(heads)] for i, h in enumerate(heads)}
    # the head of each bucket also goes, marked, to the bucket before it
    before = {nxt["bucket"]: b for b, nxt in after.items()}
    if not before:
        return placed.select("bucket", F.lit(0).alias("ahead"), "doc_id", "text")
    to = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("bucket"))
    first = F.element_at(F.create_map(*(F.lit(x) for h in heads for x in (h["bucket"], h["head"]))), F.col("bucket"))
    copies = F.when(F.col("doc_id").eqNullSafe(first), F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ahead")), F.struct(to.alias("bucket"), F.lit(1).alias("ahead")))).otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ahead"))))
    return placed.select(F.explode(copies).alias("c"), "doc_id", "text").select("c.bucket", "c.ahead", "doc_id", "text")


def lz_fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` of every row.

    The next document is that of the next smaller doc_id (of equal ids, by text; null ids last), and the first one
    after the last. Null texts count as empty; texts without words have the signature of no phrase, which is like
    itself only. A single row is its own next document. Repeated rows are documents of their own; other columns
    aren't read; an empty table gives an empty result. Texts are shuffled once, in buckets by id; a task holds two
    texts at a time.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None  # bucket, doc_id, text, signature: waits for the text after it

        def row(following: str, sign: bytes) -> tuple:
            _, doc, text, own = before
            changed = edited(text, following)
            other = own if changed == text else signature(changed)
            return doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.hex(), other.hex(), likeness(own, other), likeness(own, sign)

        for b in batches:
            out = []
            for bucket, ahead, doc, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                sign = before[3] if before and before[2] == text else signature(text) if not ahead or before and before[0] == bucket else b""
                if before and before[0] == bucket:
                    out.append(row(text, sign))
                before = None if ahead else (bucket, doc, text, sign)
            if out:
                columns = zip(zip(*out, strict=True), (b.schema.field(2).type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    n = shuffle_partitions(docs.sparkSession)
    ordered = _dealt(docs).repartition(n, "bucket").sortWithinPartitions("bucket", "ahead", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def lzprint_query(spark, sf_dir: str) -> DataFrame:
    return lz_fingerprints(table(spark, sf_dir, "documents"))
