"""Labels and proportions of types carried over from a reference: optimal transport, pairs of types a cell, purified counts,
rank correlation, and a fitted classifier.

Profiles are small, types by genes; cells by types are long tables or one array a cell, types in the order of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissueflow.durable import saved

#: A cell whose normalised entropy is higher has no clear type.
AMBIGUOUS = 0.7
#: A cell is of two types only if the second's share, and what it explains, aren't less.
SECOND_SHARE, GAIN = 0.25, 0.1
SHARED_GENES, CLASS_SIZE, REFERENCE_CELLS = 5, 2, 20_000


def profiles(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """``(type, gene, share)``: the mean share of each gene in the counts of a type's cells; shares of a type add up to 1."""
    own = counts.join(cells.filter("label IS NOT NULL").select("cell", F.col("label").alias("type")), "cell").filter("value > 0")
    each = own.withColumn("part", F.col("value") / F.sum("value").over(Window.partitionBy("cell")))
    s = each.groupBy("type", "gene").agg(F.sum("part").alias("s"))
    return s.select("type", "gene", (F.col("s") / F.sum("s").over(Window.partitionBy("type"))).alias("share"))


def similarity(counts: DataFrame, profile: DataFrame) -> DataFrame:
    """``(cell, type, similarity)``: the sum over genes of the roots of the cell's share times the type's (1: equal shares).

    Shares are over the genes of ``profile``; a cell without counts on them has no row. Every other cell has a row for each type.
    """
    shared = profile.select("gene").distinct()
    own = counts.filter("value > 0").join(shared, "gene").groupBy("cell", "gene").agg(F.sum(F.col("value").cast("double")).alias("value"))
    part = own.withColumn("part", F.col("value") / F.sum("value").over(Window.partitionBy("cell")))
    met = part.join(profile, "gene").groupBy("cell", "type").agg(F.sum(F.sqrt(F.col("part") * F.col("share"))).alias("s"))
    every = part.select("cell").distinct().crossJoin(F.broadcast(profile.select("type").distinct()))  # types are few
    return every.join(met, ["cell", "type"], "left").select("cell", "type", F.coalesce("s", F.lit(0.0)).alias("similarity"))


def _type_sums(kernel: DataFrame, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the cells of their shares of types, and of the products of two shares, under the scales ``v``."""
    t = len(v)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((t + 1, t))
        for p in parts:
            k = np.stack(p["kernel"]) * v
            w = k / k.sum(axis=1, keepdims=True)
            out[0] += w.sum(axis=0)
            out[1:] += w.T @ w
        yield pd.DataFrame({"i": np.arange(out.size), "s": out.ravel()})

    out = np.zeros((t + 1) * t)
    for r in kernel.select("kernel").mapInPandas(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # types by types
        out[r["i"]] = r["s"]
    return out[:t], out[t:].reshape(t, t)


def transport(near: DataFrame, prior: DataFrame | None = None, sharpness: float = 20.0, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """``(cell, weights map<type, double>, label, confidence, entropy, ambiguous)`` by entropic optimal transport of cells to types.

    ``near(cell, type, similarity)`` has a row for each of both. Each cell carries the same mass; ``prior(type, prior)`` says how much each type takes, all the same
    without it. In the plan ``u * exp(sharpness * similarity) * v`` the cells' sums are exact; ``v`` is scaled until the types'
    sums are right within ``tolerance``, the first rounds by their quotients and then by Newton steps, as quotients alone
    hardly move where types are well apart. A cell keeps its kernel as one array; a round adds up one vector and one
    matrix of types, all that the driver sees. Ties go to the first type by name.
    """
    types = [r["type"] for r in near.select("type").distinct().orderBy("type").collect()]
    if not types:
        kind = dict(near.dtypes)
        return near.sparkSession.createDataFrame([], f"cell {kind['cell']}, weights map<{kind['type']},double>, label {kind['type']}, confidence double, entropy double, ambiguous boolean")
    lists = near.groupBy("cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("type", "similarity"))), lambda x: F.exp(sharpness * (x["similarity"] - 1))).alias("kernel"))
    kernel = saved(lists)
    n = kernel.count()
    told = {r["type"]: r["prior"] for r in prior.collect()} if prior is not None else {}
    want = np.array([max(float(told.get(t) or 0.0), 1e-12) for t in types]) if prior is not None else np.ones(len(types))
    want, v = want / want.sum(), np.ones(len(types))
    best = (np.inf, v, None)
    for turn in range(rounds):
        sums, square = _type_sums(kernel, v)
        error = float(np.abs(sums / n - want).max())
        if error < best[0]:
            best = (error, v, sums)
        if error < tolerance:
            break
        if turn < 3 or error > best[0]:
            v = best[1] * want * n / best[2]
        else:
            v = v * np.exp(np.clip(np.linalg.pinv(np.diag(sums) - square, rcond=1e-12, hermitian=True) @ (n * want - sums), -2, 2))
        v = v / v.max()
    v = best[1]
    dot = lambda v: F.aggregate(F.zip_with("kernel", F.array(*map(F.lit, v.tolist())), lambda k, x: k * x), F.lit(0.0), lambda a, x: a + x)
    w = F.transform(F.zip_with("kernel", F.array(*map(F.lit, v.tolist())), lambda k, x: k * x), lambda x: x / dot(v))
    named = kernel.select("cell", F.map_from_arrays(F.array(*map(F.lit, types)), w).alias("weights"))
    return soft_labels(named)


def soft_labels(weights: DataFrame) -> DataFrame:
    """``weights(cell, weights map<type, double>)`` with ``label``, ``confidence`` (its weight), the entropy over that of equal
    weights, and whether that is too high for a clear type. Ties go to the first type by name; a single type has entropy 0."""
    pairs = F.transform(F.map_entries("weights"), lambda x: F.struct((-F.round(x["value"], 12)).alias("order"), x["key"].alias("type"), x["value"].alias("w")))
    best = F.array_min(pairs)
    log = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    entropy = -F.aggregate(F.map_values("weights"), F.lit(0.0), lambda a, x: a + log(x)) / F.log(F.size("weights").cast("double"))
    entropy = F.when(F.size("weights") > 1, F.greatest(entropy, F.lit(0.0))).otherwise(0.0)
    return weights.select("cell", "weights", best["type"].alias("label"), best["w"].alias("confidence"), entropy.alias("entropy"), (entropy > AMBIGUOUS).alias("ambiguous"))


def profile_products(profile: DataFrame) -> DataFrame:
    """``(a, b, product)``: the sums over genes of the products of two types' shares, a row for each two; types are few."""
    p = profile.select("gene", F.col("type").alias("a"), F.col("share").alias("x")).join(profile.select("gene", F.col("type").alias("b"), F.col("share").alias("y")), "gene")
    found = p.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("product"))
    names = profile.select("type").distinct()
    every = names.select(F.col("type").alias("a")).crossJoin(names.select(F.col("type").alias("b")))
    return every.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("product", F.lit(0.0)).alias("product"))


def doublets(counts: DataFrame, profile: DataFrame, second: float = SECOND_SHARE, gain: float = GAIN) -> DataFrame:
    """``(cell, first_type, second_type, class, first_share, residual, single_residual)``: the one or two types whose
    profiles, with weights that aren't negative, come nearest to a cell's shares by least squares.

    A cell's sums with each profile, its own square and the products of profiles are all that a fit needs, so counts are read
    once, and each pair of types has a closed form. ``class``: ``doublet`` where the second type holds at least ``second`` and
    takes at least ``gain`` off the residual of the best single type, else ``singlet``; ``reject`` where no profile shares a
    gene with the cell. Ties go to the first names. Cells without counts on the profiles' genes have no row.
    """
    shared = profile.select("gene").distinct()
    own = counts.filter("value > 0").join(shared, "gene").groupBy("cell", "gene").agg(F.sum(F.col("value").cast("double")).alias("value"))
    part = own.withColumn("y", F.col("value") / F.sum("value").over(Window.partitionBy("cell")))
    square = part.groupBy("cell").agg(F.sum(F.col("y") * F.col("y")).alias("yy"))
    dots = part.join(profile, "gene").groupBy("cell", "type").agg(F.sum(F.col("y") * F.col("share")).alias("d"))
    g = profile_products(profile)
    diagonal = g.filter("a = b").select(F.col("a").alias("type"), F.col("product").alias("gg"))
    # A type without a gene in common would get no weight, alone or beside another.
    solo = dots.join(square, "cell").join(F.broadcast(diagonal), "type")
    fits = solo.select("cell", "yy", "type", "d", "gg", F.round(F.col("yy") - F.col("d") * F.col("d") / F.col("gg"), 12).alias("single"))
    lists = fits.groupBy("cell", "yy").agg(F.sort_array(F.collect_list(F.struct("type", "d", "gg", "single"))).alias("t"))  # types are few
    best = lists.select("cell", "yy", "t", F.array_min(F.transform("t", lambda x: F.struct(x["single"], x["type"]))).alias("one"))
    pairs = best.select("cell", "yy", "one", F.explode("t").alias("p"), "t").select("cell", "yy", "one", "p", F.explode(F.filter("t", lambda x: x["type"] > F.col("p.type"))).alias("q"))
    met = pairs.join(F.broadcast(g.select(F.col("a").alias("pa"), F.col("b").alias("qb"), F.col("product").alias("pq"))), (F.col("p.type") == F.col("pa")) & (F.col("q.type") == F.col("qb")))
    det = F.col("p.gg") * F.col("q.gg") - F.col("pq") * F.col("pq")
    wp, wq = (F.col("p.d") * F.col("q.gg") - F.col("q.d") * F.col("pq")) / det, (F.col("q.d") * F.col("p.gg") - F.col("p.d") * F.col("pq")) / det
    two = met.filter(det > 1e-15).withColumn("wp", wp).withColumn("wq", wq).filter("wp > 0 AND wq > 0")
    two = two.withColumn("r", F.round(F.col("yy") - F.col("wp") * F.col("p.d") - F.col("wq") * F.col("q.d"), 12))
    top = two.groupBy("cell").agg(F.min(F.struct("r", "p.type", F.col("q.type").alias("other"), "wp", "wq")).alias("two"))
    t = best.join(top, "cell", "left")
    share = F.greatest("two.wp", "two.wq") / (F.col("two.wp") + F.col("two.wq"))
    pair = F.coalesce((1 - share >= second) & (F.col("one.single") - F.col("two.r") >= gain * F.col("one.single")), F.lit(False))
    first = F.when(F.col("two.wp") >= F.col("two.wq"), F.col("two.type")).otherwise(F.col("two.other"))
    other = F.when(F.col("two.wp") >= F.col("two.wq"), F.col("two.other")).otherwise(F.col("two.type"))
    found = t.select("cell", F.when(pair, first).otherwise(F.col("one.type")).alias("first_type"), F.when(pair, other).alias("second_type"), F.when(pair, "doublet").otherwise("singlet").alias("class"), F.when(pair, share).otherwise(1.0).alias("first_share"), F.when(pair, F.col("two.r")).otherwise(F.col("one.single")).alias("residual"), F.col("one.single").alias("single_residual"))
    kinds = dict(found.dtypes)
    lost = square.join(found.select("cell"), "cell", "left_anti").select("cell", *(F.lit({"class": "reject"}.get(c)).cast(kinds[c]).alias(c) for c in found.columns[1:]))
    return found.unionByName(lost)


def doublet_weights(found: DataFrame) -> DataFrame:
    """``(cell, type, weight)`` of :func:`doublets`: one or two rows a cell; rejected cells have none."""
    one = found.filter("first_type IS NOT NULL").select("cell", F.col("first_type").alias("type"), F.col("first_share").alias("weight"))
    return one.union(found.filter("second_type IS NOT NULL").select("cell", "second_type", 1 - F.col("first_share")))


def purified(counts: DataFrame, weights: DataFrame, profile: DataFrame) -> DataFrame:
    """``(cell, gene, value, purified)``: of each count the share that a cell's primary type, the one of greatest weight (ties:
    first name), explains among the cell's types: its weight times its profile over the sum of those of all.

    ``weights(cell, type, weight)`` has few rows a cell. Genes that none of the cell's types has, and cells without
    weights, keep their counts.
    """
    w = weights.filter("weight > 0").groupBy("cell", "type").agg(F.sum("weight").alias("weight"))
    main = w.groupBy("cell").agg(F.min(F.struct((-F.round("weight", 12)).alias("order"), "type"))["type"].alias("main"))
    c = counts.filter("value > 0").groupBy("cell", "gene").agg(F.sum(F.col("value").cast("double")).alias("value"))
    t = c.join(w.join(main, "cell"), "cell", "left").join(profile, ["type", "gene"], "left")
    part = F.coalesce(F.col("weight") * F.col("share"), F.lit(0.0))
    sums = t.groupBy("cell", "gene", "value").agg(F.sum(part).alias("all"), F.sum(F.when(F.col("type") == F.col("main"), part).otherwise(0.0)).alias("own"))
    return sums.select("cell", "gene", "value", F.when(F.col("all") > 0, F.col("value") * F.col("own") / F.col("all")).otherwise(F.col("value")).alias("purified"))


def purity_change(pure: DataFrame) -> DataFrame:
    """One row: ``(n_cells, median_before, median_after, removed)``, the cells' totals before and after, and the share of all counts
    that is gone."""
    t = pure.groupBy("cell").agg(F.sum("value").alias("before"), F.sum("purified").alias("after"))
    return t.agg(F.count(F.lit(1)).alias("n_cells"), F.percentile("before", F.lit(0.5)).alias("median_before"), F.percentile("after", F.lit(0.5)).alias("median_after"), (1 - F.sum("after") / F.sum("before")).alias("removed"))


def rank_correlation(counts: DataFrame, profile: DataFrame) -> DataFrame:
    """``(cell, label, correlation, delta)``: the type whose profile a cell's counts rank most like (Spearman, over the genes of
    ``profile``), and how far it is ahead of the runner-up (null with one type). Ties go to the first name.

    Zeros aren't made: all genes that a cell, or a type, lacks share one average rank below its others, so sums over
    the genes that both have, and over those that either has, are enough. Cells of constant counts have no row.
    """
    genes = profile.select("gene").distinct()
    n = genes.agg(F.count(F.lit(1)).cast("double").alias("n"))

    def ranked(df: DataFrame, key: str, value: str) -> DataFrame:
        """Ranks above the zeros' own rank, which is taken as the origin."""
        some = df.filter(F.col(value) > 0).groupBy(key, "gene").agg(F.sum(F.round(F.col(value).cast("double"), 12)).alias("x"))
        by, zeros = Window.partitionBy(key), F.col("n") - F.col("m")
        t = some.withColumn("m", F.count(F.lit(1)).over(by)).crossJoin(F.broadcast(n))
        low = F.rank().over(by.orderBy("x"))
        ties = F.count(F.lit(1)).over(Window.partitionBy(key, "x"))
        return t.withColumn("r", zeros + low + (ties - 1) / 2.0 - (zeros + 1) / 2.0).select(key, "gene", "r")

    a, b = ranked(counts.join(genes, "gene"), "cell", "value"), ranked(profile, "type", "share")
    sums = lambda df, key, s, ss: df.groupBy(key).agg(F.sum("r").alias(s), F.sum(F.col("r") * F.col("r")).alias(ss))
    both = a.join(b.withColumnRenamed("r", "q"), "gene").groupBy("cell", "type").agg(F.sum(F.col("r") * F.col("q")).alias("ab"))
    pairs = sums(a, "cell", "sa", "aa").crossJoin(F.broadcast(sums(b, "type", "sb", "bb"))).join(both, ["cell", "type"], "left").crossJoin(F.broadcast(n))  # types are few
    spread = lambda s, ss: F.col(ss) - F.col(s) * F.col(s) / F.col("n")
    rho = (F.coalesce("ab", F.lit(0.0)) - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(F.nullif(spread("sa", "aa") * spread("sb", "bb"), F.lit(0.0)))
    lists = pairs.withColumn("rho", F.round(rho, 9)).filter("rho IS NOT NULL").groupBy("cell").agg(F.sort_array(F.collect_list(F.struct((-F.col("rho")).alias("order"), "type"))).alias("t"))
    return lists.select("cell", F.col("t")[0]["type"].alias("label"), (-F.col("t")[0]["order"]).alias("correlation"), (F.get("t", F.lit(1))["order"] - F.col("t")[0]["order"]).alias("delta"))


@dataclass
class _Fit:
    """A direction or point of the fit: a number for each drawn cell and label, its product with the cells' Gram matrix, and intercepts."""

    a: np.ndarray
    ga: np.ndarray
    b: np.ndarray

    def dot(self, other: _Fit) -> float:
        return float((self.a * other.ga).sum() + self.b @ other.b)

    def plus(self, other: _Fit, t: float) -> _Fit:
        return _Fit(self.a + t * other.a, self.ga + t * other.ga, self.b + t * other.b)


def _gram(lists: DataFrame, n: int, a: np.ndarray) -> np.ndarray:
    """The product of the drawn cells' Gram matrix with ``a``, of ``lists(at array<int>, x array<double>)``, a row for each gene; genes are
    centred. Each task adds up its genes."""
    held = lists.sparkSession.sparkContext.broadcast(a - a.mean(axis=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, r = np.zeros((n, a.shape[1])), held.value
        for b in batches:
            at, x = b["at"].values.to_numpy(), b["x"].values.to_numpy()
            gene = np.repeat(np.arange(b.num_rows), np.diff(b["at"].offsets.to_numpy()))
            for k in range(a.shape[1]):
                out[:, k] += np.bincount(at, x * np.bincount(gene, x * r[at, k], b.num_rows)[gene], n)
        yield pa.record_batch({"at": np.arange(n), **{f"s{k}": out[:, k] for k in range(a.shape[1])}})

    names = [f"s{k}" for k in range(a.shape[1])]
    found = lists.mapInArrow(run, "at long, " + ", ".join(f"{c} double" for c in names)).groupBy("at").agg(*(F.sum(c).alias(c) for c in names)).toArrow()  # drawn cells by labels
    out = np.zeros((n, a.shape[1]))
    out[found["at"].to_numpy()] = np.column_stack([found[c].to_numpy() for c in names])
    return out - out.mean(axis=0)


def _wolfe(value, start: float) -> float:
    """A step that lessens ``value(t) -> (value, slope)`` enough and leaves a much flatter slope; the best one found, if none does."""
    f0, d0 = value(0.0)
    low, high, t, best = (0.0, f0, d0), None, start, (f0, 0.0)
    for _ in range(40):
        f, d = value(t)
        best = min(best, (f, t)) if np.isfinite(f) else best
        if not np.isfinite(f) or f > f0 + 1e-4 * t * d0 or f >= low[1] and low[0] > 0:
            high = (t, f, d)
        elif abs(d) <= 0.9 * abs(d0):
            return t
        elif d >= 0:
            high = (t, f, d)
        else:
            low = (t, f, d)
        t = 1.5 * t if high is None else (low[0] + high[0]) / 2
    return best[1]


def _logistic(product, y: np.ndarray, labels: int, rounds: int, penalty: float, memory: int = 10, tolerance: float = 1e-6) -> _Fit:
    """Multinomial logistic weights by L-BFGS, kept as sums of the drawn cells' rows: the gradient is one, so a round needs a single
    ``product`` with the Gram matrix, and steps along a direction none."""
    n = len(y)
    hot = np.eye(labels)[y]

    def state(p: _Fit) -> tuple[float, np.ndarray]:
        m = p.ga + p.b
        m = m - m.max(axis=1, keepdims=True)
        z = np.exp(m).sum(axis=1)
        return float((np.log(z) - m[np.arange(n), y]).mean() + penalty / 2 * (p.a * p.ga).sum()), np.exp(m) / z[:, None]

    start = np.log(hot.sum(axis=0))
    p = _Fit(np.zeros((n, labels)), np.zeros((n, labels)), start - start.mean())
    (f, q), past, values = state(p), [], []
    residual = (q - hot) / n
    g = _Fit(residual, product(residual), residual.sum(axis=0))
    for turn in range(rounds):
        d, used = g, []
        for s, e in reversed(past):
            used.append(s.dot(d) / s.dot(e))
            d = d.plus(e, -used[-1])
        if past:
            s, e = past[-1]
            c = s.dot(e) / e.dot(e)
            d = _Fit(d.a * c, d.ga * c, d.b * c)
        for (s, e), u in zip(past, reversed(used), strict=True):
            d = d.plus(s, u - e.dot(d) / s.dot(e))
        d = _Fit(-d.a, -d.ga, -d.b)

        def value(t: float, d: _Fit = d, p: _Fit = p) -> tuple[float, float]:
            x = p.plus(d, t)
            f, q = state(x)
            return f, float((d.ga * ((q - hot) / n + penalty * x.a)).sum() + d.b @ ((q - hot) / n).sum(axis=0))

        t = _wolfe(value, 1.0 if past else 1 / max(g.dot(g) ** 0.5, 1e-12))
        new = p.plus(d, t)
        f, q = state(new)
        residual = (q - hot) / n
        after = _Fit(residual + penalty * new.a, product(residual) + penalty * new.ga, residual.sum(axis=0))
        step, change = _Fit(t * d.a, t * d.ga, t * d.b), after.plus(g, -1)
        p, g = new, after
        if step.dot(change) > 0:
            past = [*past, (step, change)][-memory:]
        values = [*values, f][-20:]
        if t == 0 or g.dot(g) ** 0.5 <= max(tolerance * f, 1e-8) or len(values) > 1 and abs(values[0] - f) <= tolerance * abs(values[0]):
            break
    return p


def classifier_transfer(counts: DataFrame, reference_counts: DataFrame, reference_cells: DataFrame, most: int = REFERENCE_CELLS, rounds: int = 60, penalty: float = 1e-3) -> DataFrame:
    """``(cell, label, probability)``: a multinomial logistic model of the reference's labels, over counts scaled to 10,000
    a cell and log-scaled on the genes that both have, applied to the other cells.

    The fit takes at most about ``most`` reference cells, drawn by hash in equal shares of each label, so that the bound doesn't follow
    the data; labels of fewer than two cells are left out. Genes are scaled to a spread of 1 in it. Raises with fewer than five shared genes or two labels. Cells
    without counts on the shared genes get what the intercepts say.

    Genes stay in tables: the driver holds a few numbers for each drawn cell and label, and weights of genes are made from them.
    """
    names = saved(counts.select("gene").distinct().join(reference_counts.select("gene").distinct(), "gene"))
    shared = names.count()
    if shared < SHARED_GENES:
        raise ValueError(f"{shared} shared genes, {SHARED_GENES} are needed")
    size = reference_cells.filter("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CLASS_SIZE)
    labels = [r["label"] for r in size.orderBy("label").collect()]
    if len(labels) < 2:
        raise ValueError("two labels of two cells and more are needed")

    def scaled(df: DataFrame) -> DataFrame:
        own = df.filter("value > 0").join(names, "gene").groupBy("cell", "gene").agg(F.sum(F.col("value").cast("double")).alias("value"))
        return own.select("cell", "gene", F.log1p(F.col("value") * 1e4 / F.sum("value").over(Window.partitionBy("cell"))).alias("v"))

    share = F.least(F.lit(1.0), F.lit(most / len(labels)) / F.col("n"))
    drawn = F.pmod(F.xxhash64("cell"), F.lit(1 << 30)) < share * (1 << 30)
    known = reference_cells.join(F.broadcast(size), "label").filter(drawn | (F.col("n") <= CLASS_SIZE)).select("cell", (F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1).cast("int").alias("y"))
    rows = saved(scaled(reference_counts.join(F.broadcast(known.select("cell")), "cell")).join(F.broadcast(known), "cell"))
    order = Window.orderBy("cell", "y")  # the drawn cells alone
    cells = saved(rows.select("cell", "y").distinct().withColumn("at", F.row_number().over(order) - 1))
    y = np.array([r["y"] for r in cells.select("y", "at").orderBy("at").collect()], np.int64)
    if not len(y):
        raise ValueError("no drawn cell has counts on shared genes")
    n = float(len(y))
    placed = rows.join(F.broadcast(cells), ["cell", "y"])
    spread = F.sqrt((F.sum(F.col("v") * F.col("v")) - F.sum("v") * F.sum("v") / n) / max(n - 1, 1.0))
    lists = placed.groupBy("gene").agg(F.collect_list("at").alias("at"), F.collect_list("v").alias("v"), F.sum("v").alias("sum"), spread.alias("spread")).filter("spread > 1e-12")
    lists = saved(lists.select("gene", "at", F.transform("v", lambda v: v / F.col("spread")).alias("x"), (F.col("sum") / n).alias("mean"), "spread"))
    slim = lists.select("at", "x")
    fit = _logistic(lambda a: _gram(slim, len(y), a), y, len(labels), rounds, penalty)
    held = lists.sparkSession.sparkContext.broadcast(fit.a - fit.a.mean(axis=0))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = b["at"].values.to_numpy(), b["x"].values.to_numpy()
            gene = np.repeat(np.arange(b.num_rows), np.diff(b["at"].offsets.to_numpy()))
            w = {f"w{k}": np.bincount(gene, x * held.value[at, k], b.num_rows) / b["spread"].to_numpy() for k in range(held.value.shape[1])}
            yield pa.record_batch({"gene": b["gene"], "mean": b["mean"], **w})

    every = range(len(labels))
    weights = saved(lists.mapInArrow(weigh, f"gene {dict(lists.dtypes)['gene']}, mean double, " + ", ".join(f"w{k} double" for k in every)))
    shift = weights.agg(*(F.sum(F.col("mean") * F.col(f"w{k}")) for k in every)).first()
    base = [float(b) - float(m or 0.0) for b, m in zip(fit.b, shift, strict=True)]
    sums = scaled(counts).join(weights, "gene").groupBy("cell").agg(*(F.sum(F.col("v") * F.col(f"w{k}")).alias(f"s{k}") for k in every))
    each = counts.select("cell").distinct().join(sums, "cell", "left").select("cell", F.array(*(F.coalesce(f"s{k}", F.lit(0.0)) + base[k] for k in every)).alias("all"))
    named = F.array(*(F.struct((-F.round(F.col("all")[k], 9)).alias("order"), F.lit(t).alias("label")) for k, t in enumerate(labels)))
    total = F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("all")))
    return each.select("cell", F.array_min(named)["label"].alias("label"), (1 / total).alias("probability"))
