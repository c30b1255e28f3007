"""Links between texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

Texts that alike differ in some ten bits of a 64-bit SimHash fingerprint, which no segment filter can search: this
finds the candidates by prefixes of the shingle sets and decides each by its whole sets. No likely pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, marked, saved, text_bytes
from .components import components

#: The similarity, 0.8, as a fraction: comparisons are of whole numbers.
PART, WHOLE = 4, 5
#: Shingles in more than so many prefixes are crowded: the more prefixes hold one, the later it comes in the order.
BUCKET = 64
#: Crowded shingles are marked by so many low bits of their hash, so the marks have a bounded size.
SLOTS = 1 << 20
#: Rounds that put crowded shingles last, as new ones get into prefixes in place of those that were put last.
ORDERS = 4
#: Rounds that compare the sets of crowded buckets with up to so many sets of the bucket's largest component, before
#: all pairs that are still apart are looked at.
ROUNDS, HUBS = 2, 8
#: Pairs are checked in cells of two blocks of sets: bytes of a block, and blocks at least, so that a few large groups are shared out.
BLOCK, BLOCKS = 4 << 20, 4


def prefix(s: np.ndarray, level: np.ndarray | None = None) -> np.ndarray:
    """The first hashes of a sorted set, by their slots' levels and then by value: as many as two similar sets can't
    both miss.

    Sets at the similarity share PART / WHOLE of the larger one, so each has one of the shared shingles among its first
    n - ceil(n * PART / WHOLE) + 1, in any order that is the same for all sets.
    """
    n = len(s)
    k = n - -(-n * PART // WHOLE) + 1 if n else 0
    if level is not None and n:
        s = s[np.argsort(level[s & np.uint64(SLOTS - 1)], kind="stable")]
    return s[:k]


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(sid, text)`` of the ``wanted(sid, least)``, a saved table, and its other columns; few other texts are moved."""
    texts = docs.select(F.col(id_col).alias("least"), text_bytes(text_col).alias("text"))
    return marked(texts, wanted, "least").join(wanted, "least").select(*(c for c in wanted.columns if c != "least"), "text")


def _sets(texts: DataFrame, hashes, cut) -> DataFrame:
    """``(sid, s)``: of each text the set of its shingles' hashes, passed through ``cut``; other columns before the text stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                found = [cut(np.unique(hashes(x))).view(np.int64) for x in part.columns[-1].to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.list_(pa.int64()))], names=[*part.schema.names[:-1], "s"])

    return texts.mapInArrow(run, T.StructType([*texts.schema.fields[:-1], T.StructField("s", T.ArrayType(T.LongType()))]))


def _prefixes(docs: DataFrame, known: DataFrame, hashes, id_col: str, text_col: str) -> DataFrame:
    """``(sid, size, key)``: a row for each shingle of a set's prefix, crowded shingles last in the order.

    A prefix only changes where a shingle in it is marked anew, as marks move shingles to the end alone.
    """
    posts = saved(known.select("sid", "least", "size", F.explode("prefix").alias("key")))
    slot, level = F.col("key").bitwiseAND(F.lit(SLOTS - 1).cast("long")), np.zeros(SLOTS, np.uint8)
    for _ in range(ORDERS):
        many = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET)
        marks = many.groupBy(slot.cast("int").alias("slot")).agg(F.floor(F.log2(F.max("n"))).cast("tinyint").alias("level")).toArrow()  # at most SLOTS rows of five bytes
        now, at = level.copy(), marks["slot"].to_numpy()
        now[at] = np.maximum(now[at], marks["level"].to_numpy())
        changed = now != level
        if not changed.any():
            break
        level, held = now, docs.sparkSession.sparkContext.broadcast((now, changed))

        def moved(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(held.value[1][b.column("key").to_numpy() & (SLOTS - 1)]))

        touched = saved(posts.mapInArrow(moved, posts.schema).select("sid", "least", "size").distinct())
        anew = saved(_sets(_texts(docs, touched.select("sid", "least"), id_col, text_col), hashes, lambda s, held=held: prefix(s, held.value[0])))
        rest = posts.join(touched.select("sid"), "sid", "left_anti").select("sid", "least", "size", "key")
        before, posts = posts, saved(rest.union(anew.join(touched, "sid").select("sid", "least", "size", F.explode("s").alias("key"))))
        forget(before, anew, touched)
    return posts.select("sid", "size", "key")


def _near_in_size(a, b):
    return (WHOLE * F.col(a) >= PART * F.col(b)) & (WHOLE * F.col(b) >= PART * F.col(a))


def _needed(a, b):
    """Prefix shingles that two sets of these sizes must share to be similar, at least one.

    All their common shingles up to the earlier prefix's end are in both prefixes, and after it that set has
    ceil(size * PART / WHOLE) - 1 shingles; in all they need ceil((a + b) * PART / (PART + WHOLE)) common ones.
    """
    alike = F.ceil((F.col(a) + F.col(b)) * PART / (PART + WHOLE))
    return F.greatest(alike - F.ceil(F.greatest(a, b) * PART / WHOLE) + 1, F.lit(1))


def _pairs(members: DataFrame) -> DataFrame:
    """``(a, b, size_a, size_b)``, one row for each bucket of up to BUCKET sets that holds both, of the pairs whose
    roots differ and whose sizes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.zeros((0, 4), np.int64)]
            for v in b.column(0).to_pylist():
                sid, size, root = (np.array([m[c] for m in v], np.int64) for c in ("sid", "size", "root"))
                i, j = np.nonzero((sid[:, None] < sid) & (root[:, None] != root) & (WHOLE * size[:, None] >= PART * size) & (WHOLE * size >= PART * size[:, None]))
                found.append(np.stack([sid[i], sid[j], size[i], size[j]], axis=1))
            out = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, i]) for i in range(4)], names=["a", "b", "size_a", "size_b"])

    lists = members.groupBy("key").agg(F.collect_list(F.struct("sid", "size", "root")).alias("v"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    return lists.select("v").mapInArrow(run, "a long, b long, size_a long, size_b long")


def _alike(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """The pairs ``(a, b)`` whose sets ``(sid, s)`` are similar; sets come in ascending order of their unsigned hashes."""
    at = {k: i for i, k in enumerate(sets["sid"].to_pylist())}
    s, s_none = [x.values.to_numpy().view(np.uint64) for x in sets["s"]], np.zeros(0, np.uint64)
    keep = []
    for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
        x, y = sorted((s[at[c]] if c in at else s_none for c in (a, b)), key=len)
        both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
        keep.append(both > 0 and (PART + WHOLE) * both >= PART * (len(x) + len(y)))
    return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _checked(pairs: DataFrame, docs: DataFrame, known: DataFrame, hashes, id_col: str, text_col: str) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets are similar. Sets are made from the texts of these pairs alone.

    Sets are dealt to blocks, and pairs to the cells of their two blocks. A set goes once to each cell that has a pair of it,
    and none goes to the driver.
    """
    pairs = saved(pairs)
    sides = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = saved(sides.join(known.select("sid", "least", "size"), "sid"))
    side = max(BLOCKS, -(-8 * (wanted.agg(F.sum("size")).first()[0] or 0) // BLOCK))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    cells = pairs.select("a", "b", at("a").alias("i"), at("b").alias("j"))
    needed = cells.select(F.explode(F.array("a", "b")).alias("sid"), "i", "j").groupBy("sid").agg(F.collect_set(F.struct("i", "j")).alias("cells"))
    placed = saved(wanted.select("sid", "least").join(needed, "sid"))
    sets = _sets(_texts(docs, placed, id_col, text_col), hashes, lambda s: s).select("sid", F.explode("cells").alias("cell"), "s").select("cell.i", "cell.j", "sid", "s")
    out = saved(cells.groupBy("i", "j").cogroup(sets.groupBy("i", "j")).applyInArrow(_alike, "a long, b long"))
    forget(pairs, wanted, placed)
    return out


def _rooted(met: DataFrame, links: DataFrame) -> DataFrame:
    """``met`` with the component that each set is in."""
    roots = saved(components(links)).withColumnRenamed("node", "sid")
    return saved(met.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")))


def _hub_pairs(members: DataFrame) -> DataFrame:
    """For each set at most one pair with the hub that it shares most buckets with, of those of another component.

    The hub of a bucket is its first set in an order by hash, so sets that share most shingles mostly meet one hub.
    """
    first = F.min(F.struct(F.xxhash64("sid").alias("order"), "sid", "root", "size")).alias("hub")
    hubs = saved(members.groupBy("key").agg(first).select("key", F.col("hub.sid").alias("hub"), F.col("hub.root").alias("hub_root"), F.col("hub.size").alias("hub_size")))
    apart = members.join(hubs, "key").filter(F.col("root") != F.col("hub_root"))
    return _best(apart).groupBy("sid").agg(F.max(F.struct("n", "hub")).alias("m")).select(F.col("sid").alias("a"), F.col("m.hub").alias("b"))


def _best(apart: DataFrame) -> DataFrame:
    """``(sid, hub, n)``: the pairs of ``apart(sid, size, hub, hub_size)``, a row for each bucket, that are likely alike."""
    near = apart.filter(_near_in_size("size", "hub_size"))
    return near.groupBy("sid", "hub", "size", "hub_size").agg(F.count(F.lit(1)).alias("n")).filter(2 * F.col("n") >= _needed("size", "hub_size"))


def _main(crowded: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, with the root of the bucket's largest one, ``main``."""
    groups = saved(crowded.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")))
    main = saved(groups.groupBy("key").agg(F.max(F.struct("n", "root")).alias("g"), F.count(F.lit(1)).alias("groups")).filter("groups > 1").select("key", F.col("g.root").alias("main")))
    return saved(crowded.join(main, "key"))


def _main_pairs(crowded: DataFrame, turn: int) -> DataFrame:
    """For each set of a crowded bucket outside its largest component, pairs with up to HUBS sets of that one."""
    open_ = _main(crowded)
    kin = open_.filter("root = main").groupBy("key", F.pmod(F.xxhash64("sid", F.lit(turn)), F.lit(HUBS)).alias("class")).agg(F.min(F.struct(F.xxhash64("sid", F.lit(-1 - turn)).alias("order"), "sid", "size")).alias("hub"))
    hubs = saved(kin.select("key", F.col("hub.sid").alias("hub"), F.col("hub.size").alias("hub_size")))
    found = _best(open_.filter("root <> main").join(hubs, "key"))
    place = F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("n"), "hub"))
    pairs = found.withColumn("place", place).filter(F.col("place") <= HUBS)
    return pairs.select(F.least("sid", "hub").alias("a"), F.greatest("sid", "hub").alias("b")).distinct()


def _crowded_pairs(crowded: DataFrame, own: DataFrame) -> DataFrame:
    """``(a, b, size_a, size_b, n)``: the pairs of sets of different components that share ``n`` shingles of over BUCKET
    prefixes, and with all other shared ones of theirs may have as many in common as similar sets must.

    In each bucket the members outside its largest component meet all members of other components, in shares of about
    BUCKET members. ``own(sid, keys, met)`` has a set's crowded shingles in order and the number of its other prefix
    shingles that any set shares, so that a pair is decided, and told once, in its first common bucket.
    """
    open_, shares = saved(_main(crowded).join(own, "sid")), F.ceil(F.col("n") / BUCKET)
    parts = ("sid", "size", "root", "keys", "met")
    a = open_.filter("root <> main").select("key", *(F.col(c).alias(f"{c}_x") for c in parts), F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"))
    b = open_.select("key", *(F.col(c).alias(f"{c}_y") for c in parts), (F.col("root") == F.col("main")).alias("inside"), F.pmod(F.xxhash64("sid"), shares).alias("share"))
    common = F.array_intersect("keys_x", "keys_y")
    once = F.col("inside") | (F.col("sid_x") < F.col("sid_y"))
    able = F.size(common) + F.least("met_x", "met_y") >= _needed("size_x", "size_y")
    met = a.join(b, ["key", "share"]).filter((F.col("root_x") != F.col("root_y")) & once & _near_in_size("size_x", "size_y") & (common[0] == F.col("key")) & able)
    swap = F.col("sid_x") > F.col("sid_y")
    pick = lambda c, x, y: F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).cast("long")
    return met.select(pick("sid", "x", "y").alias("a"), pick("sid", "y", "x").alias("b"), pick("size", "x", "y").alias("size_a"), pick("size", "y", "x").alias("size_b"), F.size(common).cast("long").alias("n"))


def similar_links(docs: DataFrame, known: DataFrame, hashes, linked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links ``(a, b)`` of shingle sets that, with ``linked``, connect all sets at least PART / WHOLE alike.

    ``known(sid, least, size, prefix)`` has one row a distinct set; ``least`` is the id (unique in ``docs``) of a text that
    has it. ``hashes`` gives the shingle hashes of a text's bytes. Similar sets meet in a bucket, a shingle of both
    prefixes. First each set is compared with the hub it meets most often, and those of crowded buckets with HUBS sets
    of the bucket's largest component, ROUNDS times, so that copies of one template join one component at few
    comparisons each. Then every pair of sets that meet, are of different components and share as many prefix shingles
    as similar sets must is checked by its whole sets: no similar pair is left apart. Rows grow more than in
    proportion only where many texts crowd a bucket without being alike. Sets without words have no links here. An
    empty table gives an empty result.
    """
    known = known.filter("size > 0")
    posts = _prefixes(docs, known, hashes, id_col, text_col)
    counts = saved(posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = saved(posts.join(counts, "key"))
    forget(posts, counts)
    members = _rooted(met, linked)
    found = _checked(_hub_pairs(members), docs, known, hashes, id_col, text_col)
    for turn in range(ROUNDS):
        crowded = _rooted(met.filter(F.col("n") > BUCKET), linked.union(found))
        found = found.union(_checked(_main_pairs(crowded, turn), docs, known, hashes, id_col, text_col))
        forget(crowded)
    forget(members)
    members = _rooted(met, linked.union(found))
    forget(met)
    large = F.col("n") > BUCKET
    own = members.groupBy("sid").agg(F.sort_array(F.collect_list(F.when(large, F.col("key")))).alias("keys"), F.count(F.when(~large, 1)).alias("met")).filter(F.size("keys") > 0)
    crowded = _crowded_pairs(members.filter(large), saved(own))
    met = crowded.union(_pairs(members.filter(~large)).withColumn("n", F.lit(1).cast("long")))
    enough = met.groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("n")).filter(F.col("n") >= _needed("size_a", "size_b"))
    found = found.union(_checked(enough.select("a", "b"), docs, known, hashes, id_col, text_col))
    forget(members)
    return found
