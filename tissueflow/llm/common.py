"""What the corpus operators share: table access, durable tables (of ``tissueflow.durable``), hashing of byte arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissueflow.durable import CLEANUP, forget, saved, shared_dir

__all__ = ["BASE", "CLEANUP", "MIX1", "MIX2", "bounded_batches", "forget", "marked", "mixed", "powers", "run_hashes", "saved", "shared_dir", "shuffle_partitions", "table", "text_bytes"]

#: Odd multiplier of the polynomial hash modulo 2**64, and the finaliser's multipliers.
BASE, MIX1, MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))

#: Bytes of texts that a batch for Python holds at most (and one row), and the setting of it.
BATCH, BATCH_BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of at most BATCH bytes from now on: by Spark's own limit, rows, a batch of long texts takes tens of
    MB, several times over, in executor and worker. A smaller limit of the session stays."""
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now <= 0 or now > BATCH:
        spark.conf.set(BATCH_BYTES, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits at most of the table of marks that rows are looked up in before they are joined, and bits a wanted row where that is enough.
MARKS, SPARSITY = 1 << 26, 16


def marked(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be one of those of ``wanted``, a saved table: all that are and some of a sixteenth of the others, so
    that a join of long rows with few wanted ones doesn't move them all. Each wanted key marks a bit by its hash; the table
    of bits is at most MARKS / 8 bytes, and marks less well where more than MARKS / SPARSITY are wanted."""
    bits = min(max(1 << (SPARSITY * wanted.count()).bit_length(), 1 << 15), MARKS)
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    row, at = F.shiftright(slot, 15), slot.bitwiseAND(F.lit((1 << 15) - 1).cast("long"))  # bitmaps of Spark have 2**15 bits
    marks = saved(wanted.groupBy(row.alias("__row")).agg(F.bitmap_construct_agg(at).alias("__marks")))
    byte = F.conv(F.hex(F.substring("__marks", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(at, F.lit(8)))), F.lit(2))
    return df.withColumn("__row", row).join(F.broadcast(marks), "__row").filter(bit == 1).select(*df.columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(name: str = "text"):
    """The UTF-8 bytes of a text column, empty for null."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (xor-shift and multiply)."""
    h = (h ^ (h >> np.uint64(33))) * MIX1
    h = (h ^ (h >> np.uint64(29))) * MIX2
    return h ^ (h >> np.uint64(32))


def run_hashes(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each run ``codes[start:start+length]``; the runs are disjoint, in order and not empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    at = within + np.repeat(starts, lengths)
    terms = (codes[at].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[within]
    return mixed(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * MIX2)
