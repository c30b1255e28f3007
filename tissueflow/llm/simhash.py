"""SimHash fingerprints of word shingles, linked at a small Hamming distance after pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, saved, text_bytes
from .components import components
from .resemblance import prefix, similar_links
from .tokens import drop_encoders

SEED = 42
#: A 64-bit fingerprint as a ring of five segments (offset, width), lowest bits first.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
DISTANCE = 2
#: Up to so many fingerprints are compared inside one bucket; larger buckets go the one-flip way, which is exact too.
BUCKET = 64


def shingle_hashes(data: bytes, words: int = 3) -> np.ndarray:
    """XXH64 of each shingle, in order, repeats included; the whole sequence where words are fewer, none without words.

    ASCII letters are lower-cased, words are runs of bytes other than ASCII white space.
    """
    parts = data.lower().split()
    if not parts:
        return np.zeros(0, "<u8")
    text = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n, digest = max(1, len(parts) - words + 1), xxhash.xxh64_intdigest
    ends = ends[len(parts) - n :]
    return np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)), "<u8", n)


def majority(h: np.ndarray) -> int:
    """Bit j is 1 if over half of the hashes have bit j; no hashes give 0."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(data: bytes, words: int = 3) -> int:
    """The SimHash fingerprint of a text: the majority of its shingles' hashes."""
    return majority(shingle_hashes(data, words))


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", sets: bool = False) -> DataFrame:
    """``(id_col, fp long)`` for every row, null and empty texts with fingerprint 0; if asked, of the set of shingles
    also ``sid`` (64-bit hash), ``size`` and ``prefix``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sets:
            drop_encoders()  # workers keep those of an earlier packing
        for b in batches:
            fp, own = np.zeros(b.num_rows, np.uint64), []
            for i, x in enumerate(b.column(1).to_pylist()):
                h = shingle_hashes(x, words)
                fp[i] = majority(h)
                if sets:
                    s = np.unique(h)
                    own.append((xxhash.xxh64_intdigest(s.tobytes(), SEED), len(s), prefix(s).view(np.int64)))
            columns = [b.column(0), pa.array(fp.view(np.int64))]
            if sets:
                sid, size, first = zip(*own, strict=True) if own else ((), (), ())
                columns += [pa.array(np.array(sid, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "fp", "sid", "size", "prefix"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_bytes(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, fp long" + ", sid long, size int, prefix array<long>" * sets)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(i: int, length: int) -> int:
    """Bits of the chain of ``length`` consecutive ring segments that starts with segment i."""
    return sum(((1 << w) - 1) << o for o, w in (SEGMENTS[(i + k) % len(SEGMENTS)] for k in range(length)))


def zero_chain() -> int:
    """Longest chain whose budget, length * distance / segments, is under one bit: its segments must be equal."""
    return max(n for n in range(1, len(SEGMENTS)) if n * DISTANCE < len(SEGMENTS))


def chain_links(values: np.ndarray, ring: int) -> list[tuple[int, int]]:
    """Links in one bucket (chain from segment ``ring`` equal): pairs pass the longer chains' budgets, then the full
    distance; each linked value is returned with the first of its group inside the bucket."""
    diff = values[:, None] ^ values[None, :]
    ok = np.ones(diff.shape, bool)
    for length in range(zero_chain() + 1, len(SEGMENTS) + 1):
        ok &= np.bitwise_count(diff & np.uint64(_mask(ring, length))) <= length * DISTANCE // len(SEGMENTS)
    ok &= np.bitwise_count(diff) <= DISTANCE
    root = np.arange(len(values))
    while True:
        new = np.where(ok, root[None, :], len(values)).min(axis=1)
        if (new == root).all():
            break
        root = new
    return [(int(values[i]), int(values[r])) for i, r in enumerate(root.tolist()) if r != i]


def near_links(fps: DataFrame) -> DataFrame:
    """``fps(fp)``, distinct, to links ``(a, b)`` that connect all fingerprints within the distance.

    Pigeonring: with five segments and distance two, some chain of two consecutive ring segments is equal and the
    chains that extend it stay within length * 2 / 5 differing bits. Fingerprints are bucketed by each chain of two;
    a bucket's survivors of the longer chains get the full check. A bucket of over BUCKET fingerprints is not
    compared pair by pair: two values are within distance two just if they share a value at most one flip away, so
    its members are linked through those (39 rows a member), which loses no link and grows in proportion.
    """
    chain = zero_chain()
    keys = F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(i, chain)))).alias("k")) for i in range(len(SEGMENTS))))
    keyed = fps.select("fp", F.explode(keys).alias("x")).select("fp", "x.i", "x.k")
    counts = saved(keyed.groupBy("i", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = keyed.join(counts, ["i", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            links = [x for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in chain_links(np.unique(np.array(v, np.int64).view(np.uint64)), i)]
            two = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1])], names=["a", "b"])

    small = members.filter(F.col("n") <= BUCKET).groupBy("i", "k").agg(F.collect_list("fp").alias("v")).select("i", "v").mapInArrow(run, "a long, b long")
    flips = [F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << j)) for j in range(64) if not _mask(i, chain) >> j & 1)) for i in range(len(SEGMENTS))]
    free = F.coalesce(*(F.when(F.col("i") == i, x) for i, x in enumerate(flips)))
    spread = members.filter(F.col("n") > BUCKET).select("fp", F.explode(free).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("via")).distinct()
    spread = saved(spread)
    met = saved(spread.groupBy("via").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("via", "b"))
    hot = spread.join(met, "via").select(F.col("fp").alias("a"), "b").filter("a <> b")
    return small.union(hot).distinct()


def _named(fps: DataFrame, distinct: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """Each row of ``fps`` with the smallest id that its fingerprint reaches over the links."""
    roots = saved(components(links))
    classes = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = saved(classes.groupBy("root").agg(F.min("least").alias("component_id")))
    named = saved(classes.join(least, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select(id_col, "fp", "component_id")


def near_components(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fp, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of fingerprints at two or fewer differing bits, the
    row's own included. Null texts count as empty, which all link to each other (fingerprint 0). Rows that repeat an
    id are rows of that id; a null id never is a smallest id, so a component of null ids only has a null
    component_id. Other columns are not read. An empty table gives an empty result.
    """
    fps = saved(fingerprints(docs, words, id_col, text_col))
    distinct = saved(fps.groupBy("fp").agg(F.min(id_col).alias("least")))
    return _named(fps, distinct, near_links(distinct.select("fp")), id_col)


def near_groups(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`near_components`, for unique ids, with one more kind of link: shingle sets that are at least 0.8 alike.

    Each distinct set is compared, also where texts of different sets have one fingerprint.
    """
    bounded_batches(docs.sparkSession)
    fps = saved(fingerprints(docs, words, id_col, text_col, sets=True))
    distinct = saved(fps.groupBy("fp").agg(F.min(id_col).alias("least")))
    least = saved(fps.groupBy("sid").agg(F.min(id_col).alias("least")))
    known = saved(fps.join(least.select(F.col("least").alias(id_col)), id_col, "left_semi").select(F.col(id_col).alias("least"), "sid", "size", "prefix"))
    linked = saved(near_links(distinct.select("fp")).union(fps.select(F.col("sid").alias("a"), F.col("fp").alias("b")).distinct()))
    alike = similar_links(docs, known, lambda x: shingle_hashes(x, words), linked, id_col, text_col)
    return _named(fps.select(id_col, "fp"), distinct, linked.union(alike), id_col)


def one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """Keep one row of each group of :func:`near_groups`, that of the smallest doc_id, all columns as they were.

    Where ids are null or repeated, rows are numbered first and count as documents of their own; a null id comes
    after all others, and of rows of one id any one may stay.
    """
    seen = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if seen[0] == seen[1] == seen[2]:
        keep = near_groups(docs, words).filter("doc_id = component_id").select("doc_id")
        return docs.join(keep, "doc_id", "left_semi").select(*docs.columns)
    numbered = saved(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own"), F.col("text").alias("text")))
    groups = near_groups(numbered, words, "uid").join(numbered.select("uid", "own"), "uid")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "uid")).alias("first"))
    return numbered.join(first.select("first.uid"), "uid", "left_semi").select("row.*")


def simhash_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = near_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
