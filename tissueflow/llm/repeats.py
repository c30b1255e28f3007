"""Removal of long repeated byte strings by refining intervals of equal context over all shards.

A suffix-array dedup marks the intervals of suffixes whose common prefix has at least LENGTH bytes. Here each shard
(a task's documents) is parsed, by its own content, at anchors that every occurrence of a string shares; the shards'
suffixes at anchors are merged into intervals of equal context, which are refined only where they still mix: first by
the anchor's core, then by the whole context of the anchor's windows, then by ever smaller cells of windows, last
window by window. An interval is named by a hash of its context, so that a merge needs no order between shards and no
suffix is sorted again; each level is one count of rows by name, for groups of any size alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, mixed, powers, saved, table, text_bytes

LENGTH = 200
#: Bytes of an anchor's core: the window's bytes hold LENGTH - CORE + 1 cores, of which the least hash is the anchor.
CORE = 40
#: Widths of the cells of windows that still mixed intervals are cut into, level by level; the last level is single windows.
WIDTHS = (80, 16)
#: Rows of contexts that a task works on at a time.
CHUNK = 4096
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in BASES)
CODES = mixed(np.arange(1, 257, dtype=np.uint64))

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, kept and grown by doubling."""
    if which not in _tables or len(_tables[which][0]) < n:
        size = 1 << max(16, n.bit_length())
        _tables[which] = powers(size, BASES[which]), powers(size, INVERSES[which])
    return _tables[which]


class Hashes:
    """Hashes of any range of a byte string, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums, self.back = [], []
        for w in (0, 1):
            up, down = _powers(w, n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(CODES[data] * up[:n], out=sums[1:])
            self.sums.append(sums)
            self.back.append(down)

    def of(self, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        return mixed((self.sums[which][ends] - self.sums[which][starts]) * self.back[which][starts])


def anchors(data: np.ndarray, hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor place) of each class of windows; every window start is in one class.

    The anchor of a window is its core of least hash, the leftmost of equals, so it depends on the window's bytes alone.
    """
    n, width = len(data), LENGTH - CORE + 1
    at = np.arange(n - CORE + 1)
    core = hashes.of(at, at + CORE, 0) >> np.uint64(1)
    best, place, span = core, at, 1
    while span < width:  # least of [s, s + span) from two halves that overlap
        step = min(span, width - span)
        a, b = slice(0, len(best) - step), slice(step, None)
        take = best[b] < best[a]
        best, place, span = np.where(take, best[b], best[a]), np.where(take, place[b], place[a]), span + step
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return first, np.append(first[1:], len(place)) - 1, place[first]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _classes(texts: DataFrame) -> DataFrame:
    """``(uid, first, last, place, core, c1, c2)``: the classes of windows with the hash of the core and the
    two hashes of the whole context, from the first window's first byte to the last window's last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for uid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(t) < LENGTH:
                    continue
                data = np.frombuffer(t, np.uint8)
                h = Hashes(data)
                first, last, place = anchors(data, h)
                core = h.of(place, place + CORE, 0)
                shift = (place - first).astype(np.uint64)
                c1, c2 = (mixed(h.of(first, last + LENGTH, w) ^ (shift + np.uint64(w + 1)) * BASES[w]) for w in (0, 1))
                out.append((np.full(len(first), uid, np.int64), first, last, place, core.view(np.int64), c1.view(np.int64), c2.view(np.int64)))
            if out:
                u, f, l, p, *hs = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(u), *(pa.array(x.astype(np.int32)) for x in (f, l, p)), *map(pa.array, hs)], names=["uid", "first", "last", "place", "core", "c1", "c2"])

    return texts.mapInArrow(run, "uid long, first int, last int, place int, core long, c1 long, c2 long")


ROW = "uid long, first int, shift int, n long, context binary"


def _columns(b: pa.RecordBatch) -> tuple:
    """uid, first window's place, its distance to the anchor, number of equal contexts, all context bytes, lengths."""
    uid, first, shift, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    texts = b.column(4).to_pylist()
    return uid, first.astype(np.int64), shift.astype(np.int64), n, np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))


def _cells(width: int):
    """Cuts contexts into cells of windows whose distance to the anchor has one quotient by ``width``. The key names
    the bytes that all windows of the cell share, c1 and c2 all bytes of those windows that the context has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, CHUNK):
                uid, first, shift, n, context, lengths = _columns(b.slice(lo, CHUNK))
                h, begins = Hashes(context), np.cumsum(lengths) - lengths
                top, low = shift // width, (shift - lengths + LENGTH) // width
                count = top - low + 1
                row = np.repeat(np.arange(len(uid)), count)
                cell = top[row] - (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
                far = np.minimum(shift[row], (cell + 1) * width - 1)
                near = np.maximum(shift[row] - lengths[row] + LENGTH, cell * width)
                anchor = begins[row] + shift[row]
                name = cell.astype(np.uint64) * BASES[1] + np.uint64(width)
                key = mixed(h.of(anchor - cell * width, anchor - (cell + 1) * width + 1 + LENGTH, 0) ^ name)
                start, stop = anchor - far, anchor - near + LENGTH
                c1, c2 = (mixed(h.of(start, stop, w) ^ (far.astype(np.uint64) + np.uint64(w + 1)) * BASES[w]) for w in (0, 1))
                data = context.tobytes()
                parts = [data[x:y] for x, y in zip(start.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(uid[row]), pa.array((first[row] + shift[row] - far).astype(np.int32)), pa.array(far.astype(np.int32)), pa.array(n[row]), pa.array(parts, pa.binary()), *map(_signed, (key, c1, c2))], names=["uid", "first", "shift", "n", "context", "key", "c1", "c2"])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the contexts by itself, named by its bytes and its distance to the anchor."""
    for b in batches:
        for lo in range(0, b.num_rows, CHUNK):
            uid, first, shift, n, context, lengths = _columns(b.slice(lo, CHUNK))
            h, begins, count = Hashes(context), np.cumsum(lengths) - lengths, lengths - LENGTH + 1
            row = np.repeat(np.arange(len(lengths)), count)
            window = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            s, salt = begins[row] + window, (shift[row] - window).astype(np.uint64) * BASES[1]
            k1, k2 = (mixed(h.of(s, s + LENGTH, w) ^ salt) for w in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(uid[row]), pa.array((first[row] + window).astype(np.int32)), pa.array(n[row]), _signed(k1), _signed(k2)], names=["uid", "start", "n", "k1", "k2"])


def _mixed_groups(groups: DataFrame, key: str) -> DataFrame:
    """Groups of equal contexts whose interval holds other contexts too, where one of them has no equal yet."""
    mixes = groups.groupBy(key).agg(F.count(F.lit(1)).alias("variants"), F.min("n").alias("least")).filter("variants > 1 AND least = 1").select(key)
    return groups.join(saved(mixes), key)


def _refined(told: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(ranges found, rows that stay open) of one level; ``told`` isn't needed after it."""
    name = ["key", "c1", "c2"]
    rows = saved(told.mapInArrow(_cells(width), f"{ROW}, key long, c1 long, c2 long"))
    forget(told)
    groups = saved(rows.groupBy(*name).agg(F.sum("n").alias("n"), F.min(F.struct("uid", "first", "shift")).alias("rep"), F.first("context").alias("context")))
    equal = rows.filter("n = 1").select("uid", "first", F.length("context").alias("bytes"), *name).join(groups.filter("n > 1").select(*name), name)
    found = saved(equal.select("uid", F.col("first").alias("start"), (F.col("first") + F.col("bytes")).alias("stop")))
    forget(rows)
    rest = saved(_mixed_groups(groups, "key").select("rep.*", "n", "context"))
    forget(groups)
    return found, rest


def _texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(uid, text)`` and ``(uid, doc_id)``-bearing rows; the id itself is the key where it is whole and unique."""
    whole = docs.schema["doc_id"].dataType.typeName() in ("long", "integer", "short", "byte")
    seen = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if whole and seen[0] == seen[1] == seen[2]:
        rows = docs.select(F.col("doc_id").cast("long").alias("uid"), "doc_id", text_bytes().alias("text"))
    else:
        rows = saved(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", text_bytes().alias("text")))
    return rows.select("uid", "text"), rows


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """``(uid, start, stop)``: byte ranges whose every LENGTH-byte string also starts elsewhere; they may overlap."""
    classes = saved(_classes(texts))
    cores = saved(classes.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core"))
    shared = saved(classes.join(cores, "core"))
    forget(classes, cores)
    name = ["core", "c1", "c2"]
    contexts = saved(shared.groupBy(*name).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "first", "last", "place")).alias("rep")))
    equal = saved(shared.join(contexts.filter("n > 1").select(*name), name).select("uid", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("stop")))
    forget(shared)
    asked = _mixed_groups(contexts, "core").select("rep.*", "n")
    lists = asked.groupBy("uid").agg(F.collect_list(F.struct("first", "last", "place", "n")).alias("ask"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for uid, t, ask in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                out += [(uid, a["first"], a["place"] - a["first"], a["n"], t[a["first"] : a["last"] + LENGTH]) for a in ask]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["uid", "first", "shift", "n", "context"])

    told, found = saved(texts.join(lists, "uid").mapInArrow(cut, ROW)), equal
    forget(contexts)
    for width in WIDTHS:
        more, told = _refined(told, width)
        found = found.union(more)
    windows = saved(told.mapInArrow(_windows, "uid long, start int, n long, k1 long, k2 long"))
    forget(told)
    many = saved(windows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("times"), F.min("n").alias("least")).filter("times > 1 AND least = 1").select("k1", "k2"))
    single = saved(windows.filter("n = 1").join(many, ["k1", "k2"]).select("uid", "start", (F.col("start") + LENGTH).alias("stop")))
    forget(windows, many)
    return found.union(single)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` of every row of ``docs``.

    Each byte covered by a LENGTH-byte string that also starts anywhere else, in the same document or another, is
    removed, all judged on the input; ``kept`` are the remaining bytes. Strings never cross documents; texts shorter
    than LENGTH and null texts (empty) have none. Exact copies lose all their bytes if long enough, the first one
    too. Repeated rows and rows of null ids are documents of their own. Other columns aren't read; an empty table
    gives an empty result.
    """
    texts, rows = _texts(docs)
    ranges = repeated_ranges(texts).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("ranges"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, t, found in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                parts, at, stop, spans = [], 0, -1, 0
                for r in found or ():
                    if r["start"] > stop:
                        parts.append(t[max(stop, 0) : r["start"]])
                        spans += 1
                    stop = max(stop, r["stop"])
                parts.append(t[max(stop, 0) :])
                kept = b"".join(parts)
                out.append((doc, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, (b.schema.field(0).type, *[pa.int64()] * 3, pa.string(), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = rows.join(ranges, "uid", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(keep, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def repeats_query(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")
