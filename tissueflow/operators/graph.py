"""Nearest neighbours of vectors, all compared by blocks, and communities of a weighted graph by modularity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissueflow.durable import forget, saved

K = 15
#: Where lists are asked for: distinct vectors a list on average, lists at most, and vectors a list that the lists are fitted on.
LIST, LISTS, FITTED = 256, 256, 64
#: Vectors of a block at most; blocks are compared with blocks.
BLOCK = 32768
#: Vectors whose neighbours are looked for among all, to see how many lists are needed.
JUDGES = 64
#: Queries by members of a list that one task compares at a time.
CELL = 8192
#: Moves are looked for in so many rounds a level at most, over so many levels.
ROUNDS, LEVELS = 16, 6


def _nearest_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argsort((centres * centres).sum(axis=1) - 2 * x @ centres.T, axis=1, kind="stable")


def _probes(dealt: DataFrame, centres: np.ndarray, k: int, recall: float, seed: int) -> int:
    """How many lists JUDGES vectors, drawn by hash, must look through to find that share of their true neighbours."""
    if len(centres) == 1:
        return 1
    asked = np.stack([np.array(r["v"], float) for r in dealt.select("v", F.xxhash64("node", F.lit(~seed)).alias("o")).orderBy("o").limit(JUDGES).collect()])
    held = dealt.sparkSession.sparkContext.broadcast(asked)

    def run(parts):
        q, best = held.value, None
        for p in parts:
            x = np.stack(p["v"]).astype(float)
            d = (x * x).sum(axis=1) - 2 * q @ x.T
            keep = np.argsort(d, axis=1, kind="stable")[:, : k + 1]
            new = pd.DataFrame({"q": np.repeat(np.arange(len(q)), keep.shape[1]), "d": np.take_along_axis(d, keep, 1).ravel(), "list": p["list"].to_numpy()[keep].ravel()})
            best = pd.concat([best, new]).sort_values(["q", "d"], kind="stable").groupby("q").head(k + 1)
        if best is not None:
            yield best

    place = F.row_number().over(Window.partitionBy("q").orderBy("d"))
    true = dealt.select("v", "list").mapInPandas(run, "q long, d double, list int").withColumn("place", place).filter(F.col("place").between(2, k + 1)).select("q", "list").collect()
    rank = np.argsort(_nearest_centres(asked, centres), axis=1)
    needed = np.sort([rank[r["q"], r["list"]] for r in true])
    return int(needed[min(int(np.ceil(recall * len(needed))), len(needed) - 1)]) + 1 if len(needed) else len(centres)


def _close(q: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, column, distance)`` of the ``k + 1`` nearest of ``y`` to each of ``q``, with all at the last distance to nine digits.

    Products in single precision say which pairs can be among them, with a bound of their error; distances are then those of the
    pairs themselves. Values too large for that are compared without it.
    """
    if not len(q) or not len(y):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    with np.errstate(all="ignore"):
        origin = y.mean(axis=0)
        a, b = q - origin, y - origin
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        rows = np.hstack([-2 * a, np.ones((len(a), 1))]).astype(np.float32)
        columns = np.hstack([b, bb[:, None]]).astype(np.float32).T.copy()
        fast = len(y) > k + 1 and bool(np.isfinite(rows).all() and np.isfinite(columns).all()) and max(aa.max(), bb.max()) < 1e30
    wrong = 5e-7 * (q.shape[1] + 4) * (aa + bb.max())
    out, step, size = [], max(len(y) // 2048, 1), max(1, 2**22 // len(y))
    last = lambda row, v: v[np.minimum(np.searchsorted(row, np.arange(n)) + k, np.searchsorted(row, np.arange(n), "right") - 1)][row]
    for lo in range(0, len(q), size):
        n = len(q[lo : lo + size])
        if fast:
            d = rows[lo : lo + size] @ columns
            more = 2 * wrong[lo : lo + size]
            slack = lambda far: more + 4e-9 * np.sqrt(np.maximum(far + aa[lo : lo + size] + more, 0.0)) + 1e-17  # noqa: E731,B023
            some = d[:, ::step] if d[:, ::step].shape[1] > k else d
            bound = np.partition(some, k, axis=1)[:, k].astype(float)
            row, col = np.nonzero(d <= (bound + slack(bound))[:, None])
            v = d[row, col].astype(float)
            order = np.lexsort((v, row))
            row, col, v = row[order], col[order], v[order]
            at = last(row, v)
            keep = v <= at + slack(at[np.searchsorted(row, np.arange(n))])[row]
            row, col = row[keep], col[keep]
        else:
            row, col = (x.ravel() for x in np.indices((n, len(y))))
        with np.errstate(all="ignore"):
            far = np.concatenate([np.sqrt(((q[lo + row[i : i + 65536]] - y[col[i : i + 65536]]) ** 2).sum(axis=1)) for i in range(0, len(row), 65536)])
        rounded = np.round(far, 9)
        order = np.lexsort((rounded, row))
        row, col, far, rounded = row[order], col[order], far[order], rounded[order]
        keep = ~(rounded > last(row, rounded))
        out.append((lo + row[keep], col[keep], far[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _met(q: pd.DataFrame, m: pd.DataFrame, k: int) -> pd.DataFrame:
    """``(node, other, d)`` of :func:`_close` for ``q(node, v)`` and ``m(other, y)``."""
    x, y = (np.stack(df[c]).astype(float) if len(df) else np.zeros((0, 1)) for df, c in ((q, "v"), (m, "y")))
    row, col, d = _close(x, y, k)
    return pd.DataFrame({"node": q["node"].to_numpy(np.int64)[row], "other": m["other"].to_numpy(np.int64)[col], "d": d})


def _by_blocks(distinct: DataFrame, n: int, k: int) -> DataFrame:
    """``(node, other, d)``, the nearest of each block to each vector of each block: what moves is the square of the number of
    vectors over BLOCK, and a task holds two blocks."""
    side = _side(n)
    at = lambda seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(side)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    q = distinct.select("node", "v", at(1).alias("i"), every.alias("j")).repartition(2 * side * side, "i", "j")
    m = distinct.select(F.col("node").alias("other"), F.col("v").alias("y"), every.alias("i_"), at(2).alias("j_")).repartition(2 * side * side, "i_", "j_")
    return q.groupBy("i", "j").cogroup(m.groupBy("i_", "j_")).applyInPandas(lambda q, m: _met(q, m, k), "node long, other long, d double")


def _by_lists(distinct: DataFrame, n: int, k: int, lists: int, recall: float, seed: int) -> tuple[DataFrame, list[DataFrame]]:
    """``(node, other, d)`` of the nearest in the lists that each vector looks through, and tables to forget after it."""
    spark = distinct.sparkSession
    lists = min(lists or -(-n // LIST), max(LISTS, lists), n)
    if lists > 1:
        order = F.xxhash64("node", F.lit(seed))
        sample = distinct.select(array_to_vector(F.col("v").cast("array<double>")).alias("features"), order.alias("o")).orderBy("o").limit(lists * FITTED).drop("o")
        centres = np.stack(KMeans(k=lists, seed=seed, maxIter=8).fit(sample).clusterCenters())
    else:
        centres = np.zeros((1, len(distinct.select("v").first()["v"])))
    held = spark.sparkContext.broadcast(centres)

    def near_lists(probes: int):
        def run(rows: pd.Series) -> pd.Series:
            return pd.Series(list(_nearest_centres(np.stack(rows).astype(float), held.value)[:, :probes].astype(np.int32)))

        return F.pandas_udf(run, "array<int>")("v")

    dealt = saved(distinct.select("node", "v", F.get(near_lists(1), F.lit(0)).alias("list")))
    probes = _probes(dealt, centres, k, recall, seed)
    members = dealt.select("node", "v", "list")
    queries = dealt.select("node", "v", F.explode(near_lists(probes)).alias("list"))
    parts = lambda df, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias(name))
    grid = F.broadcast(parts(members, "columns").join(parts(queries, "rows"), "list"))  # one row a list
    at = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    m = members.join(grid, "list").select(F.col("list").alias("list_"), F.col("node").alias("other"), F.col("v").alias("y"), at("columns").alias("j_"), every("rows").alias("i_"))
    q = queries.join(grid, "list").select("list", "node", "v", at("rows").alias("i"), every("columns").alias("j"))
    met = q.groupBy("list", "i", "j").cogroup(m.groupBy("list_", "i_", "j_")).applyInPandas(lambda q, m: _met(q, m, k), "node long, other long, d double")
    return met, [dealt]


def _side(n: int) -> int:
    """Blocks that ``n`` vectors make; some eight where that keeps more cores busy."""
    return max(-(-n // BLOCK), min(8, -(-n // 512)), 1)


def nearest_vectors(items: DataFrame, k: int = K, lists: int | None = None, recall: float = 0.97, seed: int = 0) -> DataFrame:
    """``(src, dst, d)``: the ``k`` nearest other items of each of ``items(item, embedding)``, by Euclidean distance, ties to
    the smaller id; fewer where there are fewer.

    All distinct vectors are compared, block by block, so the result is exact at every size; time is quadratic in them, and a task
    holds two blocks. Equal vectors are one entry with its ``k + 1`` smallest ids, so that copies cost nothing more.
    Rows with a null vector, id or entry go.

    Only where a caller asks for ``lists`` (0: some LIST vectors each) neighbours may be missed: vectors are dealt to inverted lists
    around k-means centres (fitted on a bounded sample), each looks through the lists nearest to it, and distances in
    them are exact. How many lists, is measured: as many as give the neighbours of JUDGES vectors, found among all, with the
    ``recall``.
    """
    spark = items.sparkSession
    v = items.select("item", F.col("embedding").alias("v")).filter("item IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x))")
    first = F.row_number().over(Window.partitionBy("v").orderBy("item"))
    ids = v.withColumn("at", first).filter(F.col("at") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("item")).alias("ids"))
    distinct = saved(ids.withColumn("node", F.monotonically_increasing_id()))
    n = distinct.count()
    kind = dict(items.dtypes)["item"]
    if not n:
        return spark.createDataFrame([], f"src {kind}, dst {kind}, d double")
    met, dealt = (_by_blocks(distinct, n, k), []) if lists is None else _by_lists(distinct, n, k, lists, recall, seed)
    close = saved(met.withColumn("place", F.rank().over(Window.partitionBy("node").orderBy(F.round("d", 9)))).filter(F.col("place") <= k + 1).select("node", "other", "d"))
    named = close.join(distinct.select(F.col("node").alias("other"), "ids"), "other").select("node", "d", F.explode("ids").alias("dst"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.round("d", 9), "dst"))
    best = named.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("place", "dst", "d"))).alias("near"))
    reached = saved(best.join(distinct.select("node", "v"), "node").select("v", "near"))
    own = v.join(reached, "v").select(F.col("item").alias("src"), F.slice(F.filter("near", lambda x: x["dst"] != F.col("item")), 1, k).alias("near"))
    forget(close, *dealt)
    return own.select("src", F.explode("near").alias("x")).select("src", "x.dst", "x.d")


def symmetric(edges: DataFrame) -> DataFrame:
    """``(a, b, w)`` with weight 1 for each pair that ``edges(src, dst)`` names in either direction, both ways."""
    one = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return one.union(one.select("b", "a")).distinct().withColumn("w", F.lit(1.0))


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row, ``(modularity, n_communities)``, of ``membership(node, community)`` on symmetric ``edges(a, b, w)``: the share of
    weight inside communities less ``resolution`` times what their degrees would give by chance."""
    side = lambda c, k: membership.select(F.col("node").alias(c), F.col("community").alias(k))
    e = edges.join(side("a", "ca"), "a").join(side("b", "cb"), "b")
    by = e.groupBy("ca").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("own"))
    total = F.sum("k")
    return by.agg((F.sum("own") / total - resolution * F.sum(F.col("k") * F.col("k")) / (total * total)).alias("modularity"), F.count(F.lit(1)).alias("n_communities"))


def _round(edges: DataFrame, state: DataFrame, total: float, resolution: float, turn: int) -> DataFrame:
    """``state(node, community, k)`` after half of the nodes, another half each turn, went where modularity gains most."""
    own = state.select(F.col("node").alias("a"), "community", F.lit(0.0).alias("w"))
    at = state.select(F.col("node").alias("b"), "community")
    ties = edges.filter("a <> b").join(at, "b").select("a", "community", "w").union(own).groupBy("a", "community").agg(F.sum("w").alias("w"))
    sums = state.groupBy("community").agg(F.sum("k").alias("s"))
    t = ties.join(sums, "community").join(state.select(F.col("node").alias("a"), F.col("community").alias("old"), "k"), "a")
    here = F.col("community") == F.col("old")
    gain = F.col("w") - resolution * F.col("k") * (F.col("s") - F.when(here, F.col("k")).otherwise(0.0)) / total
    best = t.groupBy("a", "old", "k").agg(F.min(F.struct((-F.round(gain, 9)).alias("order"), (~here).alias("other"), "community")).alias("m"))
    turned = F.pmod(F.xxhash64(F.col("a"), F.lit(turn // 2)), F.lit(2)) == turn % 2
    new = F.when(turned, F.col("m.community")).otherwise(F.col("old"))
    return best.select(F.col("a").alias("node"), new.alias("community"), "k", (new != F.col("old")).alias("moved"))


def _moved(edges: DataFrame, state: DataFrame, total: float, resolution: float, rounds: int) -> tuple[DataFrame, bool]:
    """``state(node, community, k)``, forgotten, after rounds of moves, and whether any node moved."""
    ever, still = False, 0
    for turn in range(rounds):
        new = saved(_round(edges, state, total, resolution, turn))
        moved, n = new.agg(F.count_if("moved"), F.count(F.lit(1))).first()
        forget(state)
        state, ever = new.select("node", "community", "k"), ever or moved > 0
        still = still + 1 if moved <= n // 500 else 0
        if still == 2:
            break
    return state, ever


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = ROUNDS, levels: int = LEVELS, passes: int = 2) -> DataFrame:
    """``(node, community)`` of the nodes of symmetric ``edges(a, b, w)``: nodes go to the neighbouring community of greatest gain in
    modularity, ties to where they are and then to the least name, until none moves; communities then become the nodes of
    the next level. A further pass lets single nodes move again from where the last one put them. Half of the nodes may
    move in a round, so that neighbours don't swap. Each round is a table in the shared folder; nothing but sums reaches
    the driver. Null ends and weights go; no edges give no rows."""
    base = saved(edges.filter("a IS NOT NULL AND b IS NOT NULL AND w IS NOT NULL").groupBy("a", "b").agg(F.sum("w").alias("w")))
    total = base.agg(F.sum("w")).first()[0] or 0.0
    member = saved(base.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")))
    for turn in range(passes if total else 0):
        level = base
        for depth in range(levels):
            start = member.withColumnRenamed("node", "a") if turn and not depth else level.select("a").distinct().withColumn("community", F.col("a"))
            state = saved(level.groupBy("a").agg(F.sum("w").alias("k")).join(start, "a").select(F.col("a").alias("node"), "community", "k"))
            state, ever = _moved(level, state, total, resolution, rounds)
            if not ever and (depth or not turn):
                break
            up = state.select(F.col("node").alias("community"), F.col("community").alias("up"))
            new = state.select("node", "community") if not depth else member.join(up, "community").select("node", F.col("up").alias("community"))
            side = lambda c: state.select(F.col("node").alias(c), F.col("community").alias(f"c{c}"))  # noqa: E731,B023
            joined = saved(level.join(side("a"), "a").join(side("b"), "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
            member = saved(new)
            forget(state, *([level] if depth else []))
            level = joined
    return member


def relabelled(member: DataFrame) -> DataFrame:
    """``(node, cluster)``: communities numbered from 0 by falling size, ties by their least node. Communities are few."""
    size = member.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"))
    place = size.select("community", (F.row_number().over(Window.orderBy(F.desc("n"), "least")) - 1).alias("cluster"))
    return member.join(F.broadcast(place), "community").select("node", "cluster")
