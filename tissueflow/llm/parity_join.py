"""Similarity join of shingle sets by parity sketches.

A set's tokens are dealt by hash to the segments of its size band, and each segment keeps the parity of its tokens: their
hashes XORed. A token of the symmetric difference of two sets changes one segment at most, so of two sets that differ in no
more than ``d`` tokens, any ``d + 1`` segments of one hold one that is equal in the other; each set keeps its rarest.
Pairs that meet are compared by bit sketches (the parity of the tokens of each bit), whose Hamming distance can't pass the
symmetric difference, and those that pass by their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MIX1, forget, marked, mixed, saved, table, text_bytes
from .components import components
from .simhash import shingle_hashes
from .vectors import slices

#: The similarity, 0.8, as a fraction; sets at it differ in at most (WHOLE - PART) / (WHOLE + PART) of their sizes' sum.
PART, WHOLE = 4, 5
WORDS = 5
#: Ways of dealing tokens to segments. A set goes on to the next where it has no more full segments than it may differ in.
DEALS = 8
#: Members of a segment that are compared at a time.
CELL = 64
#: Segments of a set, the least by hash, in which it first meets others.
FIRST = 8
#: Sets of up to so many tokens have a bit sketch of 2**32 bits, as the places of its ones; larger ones fold it to BITS bits.
SPARSE, BITS = 128, 2048
#: Distinct sets and their segments are shuffled in so many turns, so that a turn's shuffle files go before the next.
SLICES = 2


def band_of(n: int) -> int:
    """The size band of a set: sizes from 2**band up to twice that."""
    return n.bit_length() - 1


def segments(band: int) -> int:
    top = (2 << band) - 1
    return -(-top // 4) + int(top**0.5 / 2) + 2


def budget(n, t):
    """The most tokens in which sets of these sizes can differ and still be similar."""
    return (n + t) * (WHOLE - PART) // (WHOLE + PART)


def most(n: int, band: int) -> int:
    """The largest budget of a set of size n in pairs whose larger set is of the band."""
    return budget(n, min(n * WHOLE // PART, (2 << band) - 1))


def postings(s: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """``(info, most, keys)`` for each way in which a set (sorted distinct hashes) is dealt: its full segments by their parities, and
    in how many tokens it may differ from a similar set in pairs that meet there.

    A pair meets in the band of its larger set, so a set near its band's end is dealt in the next one too; ``info`` is 64
    times the deal, plus the band. If either of two similar sets has more full segments than they may differ in, one of
    these is equal in both; else both go on to the next deal. After the last, sets meet in a key of the band alone, which
    doesn't happen in practice. Sets that may not differ at all have no keys.
    """
    n, out = len(s), []
    for band in (band_of(n), band_of(n) + 1):
        differ = most(n, band)
        if n * WHOLE // PART < 1 << band or not differ:
            continue
        k = np.uint64(segments(band))
        for deal in range(DEALS):
            token = mixed(s + np.uint64((deal + 1) * int(MIX1) & (1 << 64) - 1))
            segment = (((token >> np.uint64(32)) * k) >> np.uint64(32)).astype(np.uint16 if k < 1 << 16 else np.uint32)
            order = np.argsort(segment, kind="stable")
            dealt = segment[order]
            first = np.flatnonzero(np.concatenate([[True], dealt[1:] != dealt[:-1]]))
            full = dealt[first].astype(np.uint64)
            parity = np.bitwise_xor.reduceat(mixed(token)[order], first)
            out.append((deal << 6 | band, differ, mixed(parity ^ mixed(full + np.uint64(1 + (band << 40) + (deal << 48)))).view(np.int64)))
            if len(full) > differ:
                break
        else:
            out.append((DEALS << 6 | band, differ, np.array([band], np.int64)))
    return out


def bit_sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the tokens of each of 2**32 bits: the places of the odd ones, or, of over SPARSE tokens, 32-bit words of the
    sketch folded to BITS bits."""
    place, n = np.unique((mixed(s ^ MIX1) & np.uint64((1 << 32) - 1)).astype(np.uint32), return_counts=True)
    place = place[n % 2 == 1]
    return (place if len(s) <= SPARSE else _folded(place)).view(np.int32)


def _folded(place: np.ndarray) -> np.ndarray:
    ones = np.bincount(place & np.uint32(BITS - 1), minlength=BITS) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").view("<u4")


def distances(x: list[np.ndarray], y: list[np.ndarray], sparse: bool) -> np.ndarray:
    """Hamming distance of each sketch of ``x`` to each of ``y``, over 2**32 bits or, where any is of a larger set, BITS."""
    if not sparse:
        a, b = np.stack(x), np.stack(y)
        return np.bitwise_count(a[:, None, :] ^ b).sum(axis=2, dtype=np.int64)
    both = [*x, *y]
    size = np.array([len(v) for v in both])
    _, at = np.unique(np.concatenate(both), return_inverse=True)
    ones = np.zeros((len(both), int(at.max(initial=-1)) + 1), np.float32)
    ones[np.repeat(np.arange(len(both)), size), at] = 1
    return size[: len(x), None] + size[len(x) :] - 2 * np.rint(ones[: len(x)] @ ones[len(x) :].T).astype(np.int64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(s.tobytes())
    return tuple(np.array([x >> 64, x & (1 << 64) - 1], np.uint64).view(np.int64).tolist())


def _described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, d1, d2, size, deals, sketch)`` of each text: its set's digest, size, postings and bit sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part, out = b.slice(lo, 256), []
                for x in part.column(1).to_pylist():
                    s = np.unique(shingle_hashes(x, WORDS))
                    deals = [{"info": i, "spare": len(k) - d, "keys": k} for i, d, k in postings(s)] if len(s) else []
                    out.append((*_digest(s), len(s), deals, bit_sketch(s) if deals else np.zeros(0, np.int32)))
                d1, d2, size, deals, sketch = zip(*out, strict=True) if out else ((),) * 5
                kind = pa.list_(pa.struct([("info", pa.int32()), ("spare", pa.int32()), ("keys", pa.list_(pa.int64()))]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(size, pa.int32()), pa.array(deals, kind), pa.array(sketch, pa.list_(pa.int32()))], names=["id", "d1", "d2", "size", "deals", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")).mapInArrow(run, f"id {kind}, d1 long, d2 long, size int, deals array<struct<info:int,spare:int,keys:array<long>>>, sketch array<int>")


def _union(parts: Iterator[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _kinds(whole: DataFrame) -> DataFrame:
    """One row for each distinct set that isn't empty, with its least id."""
    return whole.filter("id IS NOT NULL AND size > 0").groupBy("d1", "d2").agg(F.min("id").alias("least"), F.first("size").alias("size"), F.first("deals").alias("deals"), F.first("sketch").alias("sketch"))


def _shared_segments(dealt: DataFrame, turn: int) -> DataFrame:
    """``(key, sid, info, n)`` of one turn's segments that several sets have, ``n`` of them. Saved.

    The join moves the same rows at every size: shared keys are distinct and spread evenly, so each task holds its own.
    """
    posts = dealt.select("sid", F.explode("deals").alias("deal")).select("sid", "deal.info", F.explode("deal.keys").alias("key")).filter(F.pmod("key", F.lit(SLICES)) == turn)
    shared = saved(posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    out = saved(posts.join(shared.hint("shuffle_hash"), "key"))
    forget(shared)
    return out


def _possible(n, t, info):
    """Whether the sizes allow the similarity, and the pair belongs into the band that it meets in."""
    return (WHOLE * F.least(n, t) >= PART * F.greatest(n, t)) & (F.pow(F.lit(2.0), F.col(info).bitwiseAND(63)) <= F.greatest(n, t))


def _hub_pairs(met: DataFrame, known: DataFrame) -> DataFrame:
    """At most one pair for each set: with the hub, a segment's first set, that it has most segments in common with."""
    n = met.filter("sid <> hub").groupBy("sid", "size", "info", "hub").agg(F.count(F.lit(1)).alias("n"))
    t = n.join(known.select(F.col("sid").alias("hub"), F.col("size").alias("hub_size")), "hub").filter(_possible("size", "hub_size", "info"))
    return t.groupBy("sid").agg(F.max(F.struct("n", "hub")).alias("m")).select(F.col("sid").alias("a"), F.col("m.hub").alias("b"))


class Members:
    """A column of lists of members as arrays, without a Python object for each member."""

    def __init__(self, lists: pa.ListArray):
        flat = lists.flatten()
        self.columns = {c: flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("sid", "size", "info", "root")}
        sketch = flat.field("sketch")
        self.ends = np.concatenate([[0], np.cumsum(sketch.value_lengths().to_numpy(zero_copy_only=False))])
        self.words = sketch.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
        self.first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])

    def cell(self, i: int) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
        at = slice(self.first[i], self.first[i + 1])
        return {c: v[at] for c, v in self.columns.items()}, [self.words[self.ends[k] : self.ends[k + 1]] for k in range(at.start, at.stop)]


def _cell_pairs(outer: tuple, inner: tuple, spanning: bool) -> np.ndarray:
    """``(a, b)`` of the pairs of two cells' members that are of different components, may be similar by their sizes, and
    whose bit sketches differ in no more bits than such sets can; if asked, the likeliest of two components only."""
    (x, xs), (y, ys) = outer, inner
    n, t = x["size"][:, None], y["size"][None, :]
    ok = (x["root"][:, None] != y["root"]) & (WHOLE * np.minimum(n, t) >= PART * np.maximum(n, t)) & ((1 << (x["info"][:, None] & 63)) <= np.maximum(n, t))
    if not ok.any():
        return np.zeros((0, 2), np.int64)
    sparse = max(x["size"].max(), y["size"].max()) <= SPARSE
    if not sparse:
        xs, ys = ([v if k > SPARSE else _folded(v) for v, k in zip(vs, side["size"], strict=True)] for vs, side in ((xs, x), (ys, y)))
    apart = distances(xs, ys, sparse)
    i, j = np.nonzero(ok & (apart <= budget(n, t)))
    if spanning and len(i):
        p, q = np.minimum(x["root"][i], y["root"][j]), np.maximum(x["root"][i], y["root"][j])
        order = np.lexsort((apart[i, j] / budget(x["size"][i], y["size"][j]), q, p))
        p, q = p[order], q[order]
        order = order[np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])])]
        i, j = i[order], j[order]
    a, b = x["sid"][i], y["sid"][j]
    return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)


def _open(members: DataFrame) -> DataFrame:
    """``members(key, sid, size, info, root)`` of segments that hold several components, with the segment's largest one, ``main``,
    and how many sets are outside it and in all. Saved."""
    groups = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    main = groups.groupBy("key").agg(F.max(F.struct("m", "root")).alias("g"), F.sum("m").alias("inner_n"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    main = saved(main.select("key", F.col("g.root").alias("main"), (F.col("inner_n") - F.col("g.m")).alias("outer_n"), "inner_n"))
    out = saved(members.join(main, "key"))
    forget(main)
    return out


def _cells(open_: DataFrame, sketches: DataFrame, spanning: bool) -> DataFrame:
    """``(a, b)``, a row for each segment that both are in: pairs of sets of different components that can be similar
    by their sizes and bits. The members outside the largest component meet all, in cells of about CELL by CELL."""
    dealt = open_.join(sketches, "sid").select("key", F.struct("sid", "size", "info", "root", "sketch").alias("member"), (F.col("root") != F.col("main")).alias("out"), *(F.ceil(F.col(c) / CELL).cast("int").alias(k) for c, k in (("outer_n", "rows"), ("inner_n", "columns"))))
    turn = F.xxhash64("key", "member.sid")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    outer = dealt.filter("out").select("key", "member", F.lit(True).alias("outer"), F.pmod(turn, F.col("rows")).cast("int").alias("i"), every("columns").alias("j"))
    inner = dealt.select("key", "member", F.lit(False).alias("outer"), F.pmod(turn, F.col("columns")).cast("int").alias("j"), every("rows").alias("i")).select("key", "member", "outer", "i", "j")
    cells = outer.union(inner).groupBy("key", "i", "j").agg(F.collect_list(F.when(F.col("outer"), F.col("member"))).alias("x"), F.collect_list(F.when(~F.col("outer"), F.col("member"))).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            x, y = Members(b.column(0)), Members(b.column(1))
            found = [_cell_pairs(x.cell(i), y.cell(i), spanning) for i in range(b.num_rows)]
            p = np.concatenate([np.zeros((0, 2), np.int64), *found])
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    return cells.filter(F.size("x") * F.size("y") > 0).select("x", "y").mapInArrow(run, "a long, b long")


def _rooted(met: DataFrame, roots: DataFrame) -> DataFrame:
    return met.select("key", "sid", "size", "info").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def _likely_pairs(met: DataFrame, roots: DataFrame, sketches: DataFrame) -> DataFrame:
    """``(a, b)``: for each two components that meet in the first segments of their sets, a pair that is likely similar. Saved."""
    first = met.groupBy("sid", "size", "info").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRST).alias("keys")).select("sid", "size", "info", F.explode("keys").alias("key"))
    open_ = _open(_rooted(first, roots))
    out = saved(_cells(open_, sketches, True).distinct())
    forget(open_)
    return out


def _all_pairs(met: DataFrame, roots: DataFrame, sketches: DataFrame) -> DataFrame:
    """``(a, b)``: all pairs of sets of different components that meet in a segment and can be similar by their bits. Saved."""
    open_ = _open(_rooted(met, roots))
    out = saved(_cells(open_, sketches, False).distinct())
    forget(open_)
    return out


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose bit sketches differ in no more bits than those of similar sets can. Saved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            a, c, n, t, x, y = (col.to_pylist() for col in b.columns)
            keep = []
            for i in range(b.num_rows):
                sparse = max(n[i], t[i]) <= SPARSE
                v = [np.array(s, np.int32).view(np.uint32) for s in (x[i], y[i])]
                if not sparse:
                    v = [s if k > SPARSE else _folded(s) for s, k in zip(v, (n[i], t[i]), strict=True)]
                keep.append(distances(v[:1], v[1:], sparse)[0, 0] <= budget(n[i], t[i]))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = (sketches.select(F.col("sid").alias(i), F.col("size").alias(n), F.col("sketch").alias(s)) for i, n, s in (("a", "n", "x"), ("b", "t", "y")))
    return saved(pairs.join(x, "a").join(y, "b").select("a", "b", "n", "t", "x", "y").mapInArrow(run, "a long, b long"))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``(sid, root)`` after links between the components of ``roots``; sets of no link have no row."""
    side = lambda c: roots.select(F.col("sid").alias(c), F.col("root").alias(f"root_{c}"))
    edges = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    up = saved(components(edges)).select("node", F.col("root").alias("up"))
    moved = roots.join(up, F.col("root") == F.col("node"), "left").select("sid", F.coalesce("up", "root").alias("root"))
    new = up.join(roots.select(F.col("sid").alias("node")), "node", "left_anti").select(F.col("node").alias("sid"), F.col("up").alias("root"))
    return saved(moved.union(new))


def _checked(pairs: DataFrame, docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The ``pairs``, saved ones and then forgotten, whose whole sets are similar. Sets are made from the texts of these pairs
    alone, and only texts of the right digest count, should several have one id. No other texts are moved, and no sets are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            out = []
            for sid, d1, d2, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = np.unique(shingle_hashes(x, WORDS))
                if _digest(s) == (d1, d2):
                    out.append((sid, s.view(np.int64)))
            sid, s = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(s, pa.list_(pa.int64()))], names=["sid", "s"])

    sides = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    wanted = saved(sides.join(known.select("sid", "least", "d1", "d2"), "sid"))
    texts = marked(docs.select(F.col(id_col).alias("least"), text_bytes(text_col).alias("text")), wanted, "least").join(wanted, "least").select("sid", "d1", "d2", "text")
    held = saved(texts.mapInArrow(run, "sid long, s array<long>"))
    x, y = (held.select(F.col("sid").alias(i), F.col("s").alias(s)) for i, s in (("a", "x"), ("b", "y")))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    out = saved(both.filter((PART + WHOLE) * F.col("both") >= PART * F.col("sum")).select("a", "b").distinct())
    forget(held, wanted, pairs)
    return out


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_shingles, component_id)`` for every row of ``docs``: the size of its set of five-word shingles and the
    smallest id that it reaches by links, sets being linked where they are at least 0.8 alike (Jaccard).

    Null and empty texts, and those without words, have no shingles and are linked with nothing. Rows with equal sets are
    linked. Rows without an id have no component and link nothing; several texts of one id are rows of their own. An empty
    table gives an empty result. Other columns are not read. Each distinct set is first compared with one likely other, so that
    copies join at few comparisons, then likely pairs of components, one for each two that meet; then every pair of sets
    still apart that meets often enough is checked, so that no link is lost.
    """
    whole = saved(_described(docs, id_col, text_col))
    each = saved(whole.select("id", "d1", "d2", "size"))
    dealt = _union(saved(_kinds(whole.filter(F.pmod("d1", F.lit(SLICES)) == i)).withColumn("sid", F.monotonically_increasing_id() * SLICES + i)) for i in range(SLICES))
    forget(whole)
    own = _union(_shared_segments(dealt, i) for i in range(SLICES))
    known, spare = saved(dealt.drop("deals")), saved(dealt.select("sid", "size", F.explode("deals").alias("deal")).select("sid", "size", "deal.info", "deal.spare"))
    forget(dealt)
    # Of its full segments a set keeps most + 1, the rarest (those that no other set has come first): spare - 1 go.
    by = Window.partitionBy("sid", "info")
    rare = own.join(spare, ["sid", "info"]).withColumn("after", F.count(F.lit(1)).over(by) - F.row_number().over(by.orderBy("n", "key"))).filter((F.col("after") >= F.col("spare") - 1) | (F.col("spare") < 1)).select("key", "sid", "size", "info")
    rare = saved(rare)
    forget(own, spare)
    again = saved(rare.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("hub")).filter("n > 1").select("key", "hub"))
    met = saved(rare.join(again, "key"))
    forget(rare, again)
    sketches, roots = known.select("sid", "size", "sketch"), docs.sparkSession.createDataFrame([], "sid long, root long")
    for pairs in (lambda: _likely(_hub_pairs(met, known), sketches), lambda: _likely_pairs(met, roots, sketches.drop("size")), lambda: _all_pairs(met, roots, sketches.drop("size"))):
        links = _checked(pairs(), docs, known, id_col, text_col)
        if not links.isEmpty():
            roots = _joined(roots, links)
    forget(met)
    kind = saved(known.select("sid", "d1", "d2", "least").join(roots, "sid", "left").select("d1", "d2", "least", F.coalesce("root", "sid").alias("root")))
    least = saved(kind.groupBy("root").agg(F.min("least").alias("component_id")))
    named = saved(kind.join(least, "root").select("d1", "d2", "component_id"))
    own = F.when(F.col("id").isNull() | (F.col("size") == 0), F.col("id")).otherwise(F.col("component_id"))
    return each.select("id", "d1", "d2", "size").join(named, ["d1", "d2"], "left").select(F.col("id").alias(id_col), F.col("size").cast("long").alias("n_shingles"), own.alias("component_id"))


def parity_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))
