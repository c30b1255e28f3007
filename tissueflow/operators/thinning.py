"""What labels are worth at a lower depth: counts thinned by a hash of each transcript, labels stable under it, and types that a
panel can resolve. Thinning is the same in every engine and every run, and rows stay one a (cell, gene)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tissueflow.durable import forget, saved
from tissueflow.operators.draws import drawn
from tissueflow.operators.ranks import positions, tile
from tissueflow.operators.scores import BINS, CONTROLS, control_weights

#: Draws of four hexadecimal digits in one hash of a transcript.
DRAWS = 8
#: Types of at least so high an F1 are resolvable, of the second partly.
RESOLVABLE, PARTLY = 0.7, 0.4
#: Fewer shared genes say nothing about a panel.
SHARED, DEPTH = 25, 50.0


def thinned_lists(counts: DataFrame, keep: Column, reps: int = 1, seed: int = 0) -> DataFrame:
    """``counts`` with ``left``: for each of ``reps`` repetitions, how many transcripts draw below ``keep``; counts of 1 and more."""
    limit = F.when(F.coalesce(keep, F.lit(1.0)) >= 1, 1 << 16).otherwise(F.floor(F.greatest(keep, F.lit(0.0)) * 65536).cast("int"))
    key = F.concat_ws("|", F.col("cell").cast("string"), F.col("gene").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, limit = (b.column(c).to_numpy(zero_copy_only=False) for c in ("__n", "__limit"))
            left = np.concatenate([drawn(b.column("__key"), n, limit, f"{seed}.{at // DRAWS}", min(DRAWS, reps - at)) for at in range(0, reps, DRAWS)], axis=1)
            at = pa.array(np.arange(len(left) + 1, dtype=np.int32) * reps)
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.ListArray.from_arrays(at, pa.array(left.ravel()))], names=[*b.schema.names[:-3], "left"])

    t = counts.select("*", key.alias("__key"), F.col("value").cast("int").cast("long").alias("__n"), limit.alias("__limit"))
    return t.mapInArrow(run, T.StructType([*counts.schema.fields, T.StructField("left", T.ArrayType(T.LongType()))]))


def thinned(counts: DataFrame, keep: Column, reps: int = 1, seed: int = 0) -> DataFrame:
    """``(cell, gene, rep, value)``: of each count, the transcripts that draw below ``keep``, a share by cell or for all, in
    each of ``reps`` repetitions; what loses all of its transcripts has no row. Fractions of counts go; null keeps all."""
    t = thinned_lists(counts.filter("cell IS NOT NULL AND gene IS NOT NULL AND value >= 1"), keep, reps, seed)
    each = t.select("cell", "gene", F.posexplode("left").alias("rep", "value"))
    return each.select("cell", "gene", (F.col("rep") + 1).alias("rep"), "value").filter("value > 0")


def label_stability(counts: DataFrame, cells: DataFrame, genes: DataFrame, drop: float = 0.2, reps: int = 5, seed: int = 0) -> DataFrame:
    """``(cell, label, flip_rate)``: the marker set that scores highest in each cell, and in what share of ``reps`` thinnings,
    each dropping that share of transcripts, another one does. Cells without counts score 0 everywhere: ties go to the
    first set. With under two sets of genes nothing can flip.

    Transcripts are drawn once; all repetitions of a count stay in one row, and so do the scores of a cell and set.
    """
    every = range(reps + 1)
    drawn = thinned_lists(counts.filter("cell IS NOT NULL AND gene IS NOT NULL AND value >= 1"), F.lit(1.0 - drop), reps, seed)
    values = saved(drawn.select("cell", "gene", F.floor(F.col("value").cast("double")).cast("long").alias("v0"), *(F.col("left")[i].alias(f"v{i + 1}") for i in range(reps))).groupBy("cell", "gene").agg(*(F.sum(f"v{r}").alias(f"v{r}") for r in every)))
    totals = saved(values.groupBy("cell").agg(*(F.nullif(F.sum(f"v{r}"), F.lit(0)).alias(f"t{r}") for r in every)))
    target = totals.agg(*(F.percentile(f"t{r}", F.lit(0.5)).alias(f"m{r}") for r in every)).first()  # totals are whole numbers, and few
    sets = genes.filter("NOT control").select("marker_set").distinct()
    log = lambda r: F.coalesce(F.log1p(F.col(f"v{r}") * F.lit(float(target[r] or 0.0)) / F.col(f"t{r}")), F.lit(0.0))
    v = values.join(totals, "cell").select("cell", "gene", *(log(r).alias(f"v{r}") for r in every))
    means = saved(genes.filter("NOT control").select("gene", "marker_set").join(v.groupBy("gene").agg(*(F.sum(f"v{r}").alias(f"v{r}") for r in every)), "gene", "left"))
    weights = None
    for r in every:
        if target[r] is None:
            continue
        ranked, n = positions(means.select("gene", "marker_set", F.round(F.coalesce(f"v{r}", F.lit(0.0)), 6).alias("v")), "v", "gene")
        w = control_weights(ranked.select("gene", "marker_set", tile(F.col("position"), n, BINS).alias("bin"))).withColumn("rep", F.lit(r))
        weights = w if weights is None else weights.union(w)
    if weights is None:
        scores = cells.select("cell").limit(0).crossJoin(sets).select("cell", "marker_set", *(F.lit(0.0).alias(f"s{r}") for r in every))
    else:
        wide = saved(weights.groupBy("marker_set", "gene").agg(*(F.coalesce(F.sum(F.when(F.col("rep") == r, F.col("w"))), F.lit(0.0)).alias(f"w{r}") for r in every)))
        scores = v.join(wide, "gene").groupBy("cell", "marker_set").agg(*(F.sum(F.col(f"v{r}") * F.col(f"w{r}")).alias(f"s{r}") for r in every))
    full = cells.select("cell").distinct().crossJoin(F.broadcast(sets)).join(scores, ["cell", "marker_set"], "left")  # sets are few
    best = full.groupBy("cell").agg(*(F.min(F.struct((-F.round(F.coalesce(f"s{r}", F.lit(0.0)), 9)).alias("order"), "marker_set"))["marker_set"].alias(f"b{r}") for r in every))
    flips = sum(((F.col(f"b{r}") != F.col("b0")).cast("int") for r in every[1:]), F.lit(0))
    return best.select("cell", F.col("b0").alias("label"), (flips / F.lit(float(reps))).alias("flip_rate"))


def resolvability(counts: DataFrame, cells: DataFrame, panel: DataFrame, depth: float = DEPTH, least: int = SHARED, seed: int = 0) -> DataFrame:
    """``(status, n_shared, label, n, precision, recall, f1, tier, confused_with, confused_share)`` of a reference at a panel's
    depth, a row for each type of ``cells(cell, label)``; one row with null label where the status isn't ``ok``.

    The counts of the panel's genes are thinned to ``depth`` transcripts a cell on average over that cell's own counts.
    Each half of the cells (by hash) is then named by the type whose smoothed mean profile, made from the other half's
    whole counts, makes it likeliest. ``insufficient_overlap``: fewer than ``least`` shared genes; ``too_few_types``: under two.

    Counts are thinned once, to a table. What the types have of a gene is one row with a sum a type (types are few), so that a
    thinned count meets one row, and not one a type.
    """
    known = panel.select("gene").distinct()
    shared = counts.select("gene").distinct().join(known, "gene")
    typed = cells.filter("label IS NOT NULL").select("cell", "label", (F.substring(F.md5(F.concat_ws("|", F.col("cell").cast("string"), F.lit(f"half{seed}"))), 1, 1) < "8").alias("half"))
    kinds = saved(typed.select("label").distinct().withColumn("type", F.row_number().over(Window.orderBy("label")) - 1))  # one row a type
    n_types = kinds.count()
    facts = saved(shared.agg(F.count(F.lit(1)).alias("n_shared")).withColumn("n_types", F.lit(n_types)))
    named = typed.join(F.broadcast(kinds), "label").select("cell", "half", F.col("type").alias("own"))
    c = counts.join(known, "gene").join(named, "cell").select("cell", "half", "own", "gene", F.floor(F.col("value").cast("double")).cast("long").alias("value")).filter("value > 0")
    c = c.withColumn("total", F.sum("value").over(Window.partitionBy("cell")))
    thin = saved(thinned_lists(c, F.lit(depth) / F.col("total"), 1, seed).select("cell", "half", "own", "gene", "value", F.col("left")[0].alias("c")))
    profile = saved(thin.groupBy("half", "gene", "own").agg(F.sum("value").alias("s")))
    size = profile.groupBy("half", F.col("own").alias("type")).agg(F.sum("s").alias("whole"))
    sums = profile.groupBy((~F.col("half")).alias("half"), "gene").agg(F.map_from_entries(F.collect_list(F.struct("own", "s"))).alias("by"))
    sums = sums.select("half", "gene", F.transform(F.sequence(F.lit(0), F.lit(max(n_types - 1, 0))), lambda t: F.coalesce(F.try_element_at("by", t), F.lit(0).cast("long"))).alias("sums"))
    met = thin.filter("c > 0").select("cell", "half", "gene", "c").join(sums, ["half", "gene"], "left")
    met = met.select("cell", (~F.col("half")).alias("half"), "c", F.coalesce("sums", F.array_repeat(F.lit(0).cast("long"), n_types)).alias("sums")).repartition("cell")
    each = met.select("cell", "half", "c", F.posexplode("sums").alias("type", "s")).groupBy("cell", "half", "type").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log1p("s")).alias("hit"))
    each = each.join(F.broadcast(size), ["half", "type"]).crossJoin(F.broadcast(facts))
    score = F.round(F.col("hit") - F.col("n") * F.log(F.col("whole") + F.col("n_shared")), 6)
    called = each.groupBy("cell").agg(F.min(F.struct((-score).alias("order"), F.col("type").alias("type"))).alias("b")).join(named, "cell").groupBy("own", "b.type").agg(F.count(F.lit(1)).alias("m"))
    name = lambda c, as_: F.broadcast(kinds.select(F.col("type").alias(c), F.col("label").alias(as_)))
    pairs = saved(called.join(name("own", "label"), "own").join(name("type", "called"), "type").select("label", "called", "m"))
    forget(profile, thin)
    n, own, named = (F.col(x).cast("double") for x in ("n", "own", "named"))
    by = pairs.groupBy("label").agg(F.sum("m").alias("n"), F.sum(F.when(F.col("label") == F.col("called"), F.col("m")).otherwise(0)).alias("own"), F.min(F.when(F.col("label") != F.col("called"), F.struct((-F.col("m")).alias("order"), F.col("called").alias("to")))).alias("miss"))
    t = kinds.select("label").join(by, "label", "left").join(pairs.groupBy(F.col("called").alias("label")).agg(F.sum("m").alias("named")), "label", "left").crossJoin(F.broadcast(facts))
    precision, recall = F.coalesce(own / F.nullif(named, F.lit(0.0)), F.lit(0.0)), F.coalesce(own / F.nullif(n, F.lit(0.0)), F.lit(0.0))
    f1 = F.coalesce(2 * own / (n + F.coalesce(named, F.lit(0.0))), F.lit(0.0))
    tier = F.when(f1 >= RESOLVABLE, "resolvable").when(f1 >= PARTLY, "partly").otherwise("not_resolvable")
    ok = t.filter((F.col("n_shared") >= least) & (F.col("n_types") >= 2)).select(F.lit("ok").alias("status"), "n_shared", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), tier.alias("tier"), F.col("miss.to").alias("confused_with"), (-F.col("miss.order") / n).alias("confused_share"))
    status = F.when(F.col("n_shared") < least, "insufficient_overlap").when(F.col("n_types") < 2, "too_few_types")
    none = facts.select(status.alias("status"), "n_shared", *(F.lit(None).cast(k).alias(c) for c, k in ok.dtypes[2:])).filter("status IS NOT NULL")
    return ok.unionByName(none)


#: DuckDB's form over the section's frames.
STABILITY_SQL = f"""WITH u AS (SELECT cell, gene, md5(concat_ws('|', cell, gene, u, '0.0')) AS h FROM (SELECT cell, gene, unnest(range(1, floor(value)::INT + 1)) AS u FROM {{counts}} WHERE value >= 1) a),
  vals AS (SELECT 0 AS rep, cell, gene, count(*) AS value FROM u GROUP BY cell, gene UNION ALL SELECT r.rep, cell, gene, count(*) FROM u, (SELECT unnest(range(1, 6)) AS rep) r WHERE substr(h, 4 * (r.rep - 1) + 1, 4) < 'cccc' GROUP BY r.rep, cell, gene),
  tot AS (SELECT rep, cell, sum(value) AS total FROM vals GROUP BY rep, cell), tgt AS (SELECT rep, quantile_cont(total, 0.5) AS target FROM tot GROUP BY rep),
  v AS (SELECT vals.rep, vals.cell, gene, ln(1 + value * target / total) AS v FROM vals JOIN tot ON tot.rep = vals.rep AND tot.cell = vals.cell JOIN tgt ON tgt.rep = vals.rep),
  m AS (SELECT t.rep, g.gene, g.marker_set, ntile({BINS}) OVER (PARTITION BY t.rep ORDER BY round(coalesce(s.v, 0), 6), g.gene) AS bin FROM {{genes}} g CROSS JOIN tgt t LEFT JOIN (SELECT rep, gene, sum(v) AS v FROM v GROUP BY rep, gene) s ON s.rep = t.rep AND s.gene = g.gene WHERE NOT g.control),
  k AS (SELECT rep, marker_set, gene FROM (SELECT b.rep, b.marker_set, m.gene, row_number() OVER (PARTITION BY b.rep, b.marker_set, b.bin ORDER BY md5(m.gene::VARCHAR), m.gene) AS place FROM (SELECT DISTINCT rep, marker_set, bin FROM m) b JOIN m ON m.rep = b.rep AND m.bin = b.bin AND m.marker_set <> b.marker_set) q WHERE place <= {CONTROLS}),
  w AS (SELECT rep, marker_set, gene, 1.0 / count(*) OVER (PARTITION BY rep, marker_set) AS w FROM m UNION ALL SELECT rep, marker_set, gene, -1.0 / count(*) OVER (PARTITION BY rep, marker_set) FROM k),
  s AS (SELECT v.rep, v.cell, w.marker_set, sum(v.v * w.w) AS score FROM v JOIN w ON w.rep = v.rep AND w.gene = v.gene GROUP BY v.rep, v.cell, w.marker_set),
  p AS (SELECT c.cell, t.rep, g.marker_set, row_number() OVER (PARTITION BY c.cell, t.rep ORDER BY round(coalesce(s.score, 0), 9) DESC, g.marker_set) AS place FROM {{cells}} c CROSS JOIN tgt t CROSS JOIN (SELECT DISTINCT marker_set FROM {{genes}} WHERE NOT control) g LEFT JOIN s ON s.rep = t.rep AND s.cell = c.cell AND s.marker_set = g.marker_set)
  SELECT a.cell, a.marker_set AS label, count(*) FILTER (b.marker_set <> a.marker_set) / 5.0 AS flip_rate FROM p a JOIN p b ON b.cell = a.cell AND b.place = 1 AND b.rep > 0 WHERE a.place = 1 AND a.rep = 0 GROUP BY a.cell, a.marker_set"""
RESOLVABILITY_SQL = f"""WITH sh AS (SELECT DISTINCT g.gene FROM {{genes}} g JOIN {{counts}} k ON k.gene = g.gene WHERE NOT g.control), ns AS (SELECT count(*) AS n FROM sh),
  ty AS (SELECT cell, label, substr(md5(cell || '|half0'), 1, 1) < '8' AS half FROM {{cells}} WHERE label IS NOT NULL), c AS (SELECT k.cell, ty.label, ty.half, k.gene, k.value::BIGINT AS value FROM {{counts}} k JOIN sh ON sh.gene = k.gene JOIN ty ON ty.cell = k.cell),
  pr AS (SELECT half, label AS type, gene, sum(value) AS s FROM c GROUP BY half, label, gene), sz AS (SELECT half, type, sum(s) AS whole FROM pr GROUP BY half, type), tot AS (SELECT cell, sum(value) AS total FROM c GROUP BY cell),
  th AS (SELECT cell, NOT half AS half, gene, count(*) AS n FROM (SELECT c.cell, c.half, c.gene, CASE WHEN {DEPTH} >= t.total THEN 'g' ELSE printf('%04x', floor({DEPTH} / t.total * 65536)::INT) END AS lim, unnest(range(1, value::INT + 1)) AS u FROM c JOIN tot t ON t.cell = c.cell) q WHERE substr(md5(concat_ws('|', cell, gene, u, '0.0')), 1, 4) < lim GROUP BY ALL),
  h AS (SELECT th.cell, p.type, sum(th.n * ln(1 + p.s)) AS hit FROM th JOIN pr p ON p.half = th.half AND p.gene = th.gene GROUP BY th.cell, p.type), d AS (SELECT cell, half, sum(n) AS n FROM th GROUP BY cell, half),
  b AS (SELECT cell, type FROM (SELECT d.cell, sz.type, row_number() OVER (PARTITION BY d.cell ORDER BY round(coalesce(h.hit, 0) - d.n * ln(sz.whole + ns.n), 6) DESC, sz.type) AS place FROM d JOIN sz ON sz.half = d.half CROSS JOIN ns LEFT JOIN h ON h.cell = d.cell AND h.type = sz.type) q WHERE place = 1),
  x AS (SELECT ty.label, b.type AS called, count(*) AS m FROM b JOIN ty ON ty.cell = b.cell GROUP BY ty.label, b.type), l AS (SELECT label, sum(m)::DOUBLE AS n, coalesce(sum(m) FILTER (label = called), 0)::DOUBLE AS own FROM x GROUP BY label), r AS (SELECT called, sum(m)::DOUBLE AS named FROM x GROUP BY called),
  f AS (SELECT l.label, n, own, coalesce(named, 0) AS named, 2 * own / (n + coalesce(named, 0)) AS f1 FROM l LEFT JOIN r ON r.called = l.label), z AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY m DESC, called) AS place FROM x WHERE label <> called)
  SELECT 'ok' AS status, (SELECT n FROM ns) AS n_shared, f.label, f.n::BIGINT AS n, round(coalesce(own / nullif(named, 0), 0), 6) AS precision, round(own / f.n, 6) AS recall, round(f1, 6) AS f1, CASE WHEN f1 >= {RESOLVABLE} THEN 'resolvable' WHEN f1 >= {PARTLY} THEN 'partly' ELSE 'not_resolvable' END AS tier, z.called AS confused_with, round(z.m / f.n, 6) AS confused_share FROM f LEFT JOIN z ON z.label = f.label AND z.place = 1"""
