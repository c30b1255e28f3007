"""Registered queries of the operators on clusters, depth, references, programs and copy numbers, with SQL written for themselves.

The driver's section serves as its own reference: customers of even nations are the reference, those of odd ones the
section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissueflow.operators import clusters, copynumber, graph, matching, programs, reference_purity, spatial, thinning, transfer, validity
from tissueflow.sources.section import Section


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns))


def _halves(s: Section) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Counts and cells of the reference, then of the section."""
    s.keep("counts", "cells")
    out = []
    for even in (True, False):
        cells = s["cells"].filter((F.col("batch") % 2 == 0) == even)
        out += [s["counts"].join(cells.select("cell"), "cell"), cells]
    return tuple(out)


def _profile(s: Section) -> tuple[DataFrame, DataFrame]:
    """Profiles of the reference's types, and the section's counts."""
    ref, cells, own, _ = _halves(s)
    return transfer.profiles(ref, cells), own


def _panel(s: Section) -> DataFrame:
    return s["genes"].filter("NOT control")


def embedding_neighbours(s: Section) -> DataFrame:
    return _rounded(graph.nearest_vectors(s["vectors"].select("item", "embedding")), d=5).drop("d")


def vector_communities(s: Section) -> DataFrame:
    return graph.relabelled(graph.communities(graph.symmetric(graph.nearest_vectors(s["vectors"].select("item", "embedding")))))


def cell_clusters(s: Section) -> DataFrame:
    s.keep("counts", "cells")
    return clusters.cell_clusters(s["counts"], s["cells"], s["genes"], axes=20).cells.select("cell", "cluster", "low_signal")


def subcluster_markers(s: Section) -> DataFrame:
    s.keep("counts", "cells")
    label = s["cells"].agg(F.min("label")).first()[0]
    return clusters.subclusters(s["counts"], s["cells"], _panel(s), label, resolution=0.5, axes=20)[1].withColumn("top_markers", F.array_join("top_markers", ","))


def label_stability(s: Section) -> DataFrame:
    s.keep("counts", "cells", "genes")
    return _rounded(thinning.label_stability(s["counts"], s["cells"], s["genes"]), flip_rate=6)


def _resolved(s: Section) -> DataFrame:
    s.keep("counts", "cells")
    return thinning.resolvability(s["counts"], s["cells"], _panel(s))


def reference_match(s: Section) -> DataFrame:
    return matching.reference_match(_resolved(s).withColumn("reference", F.lit("own")), _panel(s).count())


def transport_labels(s: Section) -> DataFrame:
    profile, own = _profile(s)
    t = transfer.transport(transfer.similarity(own, profile))
    return _rounded(t.select("cell", "label", "confidence", "entropy", "ambiguous"), confidence=4, entropy=4)


def doublet_types(s: Section) -> DataFrame:
    profile, own = _profile(s)
    return _rounded(transfer.doublets(own, profile), first_share=5, residual=6, single_residual=6)


def purified_counts(s: Section) -> DataFrame:
    profile, own = _profile(s)
    weights = transfer.doublet_weights(transfer.doublets(own, profile))
    return _rounded(transfer.purified(own, weights, profile), purified=5)


def gene_programs(s: Section) -> DataFrame:
    s.keep("counts", "cells")
    p = programs.discover(s["counts"], s["cells"], _panel(s), k=5, rounds=8)
    return p.table.withColumn("top_genes", F.array_join("top_genes", ","))


def program_scores(s: Section) -> DataFrame:
    """The marker sets of the first five brands taken as programs."""
    s.keep("counts", "cells")
    brands = s["genes"].select("marker_set").distinct().orderBy("marker_set").limit(5)
    sets = _panel(s).join(F.broadcast(brands), "marker_set").select(F.col("marker_set").alias("program"), "gene")
    return _rounded(programs.program_scores(s["counts"], s["cells"], sets), score=6)


def _edges(s: Section) -> DataFrame:
    s.keep("counts", "cells", "genes")
    return spatial.neighbours(s["cells"]).select("src", "dst")


def copy_number(s: Section) -> DataFrame:
    edges = _edges(s)
    cells = s["cells"].select("cell", (F.col("label") == "BUILDING").alias("normal"))
    places = s["genes"].select("gene", F.col("marker_set").alias("chromosome"), F.col("position").alias("start"))
    return _rounded(copynumber.burden(s["counts"], cells, places, edges, window=20, step=10), burden=6)


def negative_share(s: Section) -> DataFrame:
    ref, cells, own, own_cells = _halves(s)
    foreign = reference_purity.foreign_genes(ref, cells, absent=0.01, present=0.02)
    shared = ref.select("gene").distinct().join(own.select("gene").distinct(), "gene")
    return _rounded(reference_purity.negative_share(own, own_cells.select("cell", "label"), foreign, shared), nmp=6)


def pairs_apart(s: Section) -> DataFrame:
    ref, _, own, _ = _halves(s)
    return _rounded(reference_purity.kept_apart(own, ref), reference_rate=6, rate=6)


def reference_markers(s: Section) -> DataFrame:
    s.keep("counts", "cells")
    return reference_purity.reference_markers(s["counts"], s["cells"].select("cell", "label"), _panel(s))


QUERIES = {
    "embedding_neighbours": embedding_neighbours,
    "vector_communities": vector_communities,
    "cell_clusters": cell_clusters,
    "subcluster_markers": subcluster_markers,
    "label_stability": label_stability,
    "resolvability": lambda s: _rounded(_resolved(s), precision=6, recall=6, f1=6, confused_share=6),
    "reference_match": reference_match,
    "transport_labels": transport_labels,
    "doublet_types": doublet_types,
    "purified_counts": purified_counts,
    "rank_correlation": lambda s: (lambda p: _rounded(transfer.rank_correlation(p[1], p[0]), correlation=6, delta=6))(_profile(s)),
    "classifier_transfer": lambda s: (lambda h: _rounded(transfer.classifier_transfer(h[2], h[0], h[1], rounds=20), probability=3))(_halves(s)),
    "gene_programs": gene_programs,
    "program_scores": program_scores,
    "copy_number": copy_number,
    "internal_validity": lambda s: validity.internal_validity(s["vectors"]),
    "silhouettes": lambda s: _rounded(validity.silhouettes(s["vectors"].filter("label IS NOT NULL").select("item", "label", F.col("embedding").cast("array<double>").alias("v"))), silhouette=6, silhouette_2label=6),
    "negative_share": negative_share,
    "pairs_apart": pairs_apart,
    "reference_markers": reference_markers,
}

_REF = "rc AS (SELECT cell, label FROM {cells} WHERE batch % 2 = 0), rk AS (SELECT k.* FROM {counts} k JOIN rc ON rc.cell = k.cell), oc AS (SELECT cell, label FROM {cells} WHERE batch % 2 = 1), ok AS (SELECT k.* FROM {counts} k JOIN oc ON oc.cell = k.cell)"
_PROFILE = f"""{_REF}, ps AS (SELECT rc.label AS type, gene, sum(part) AS s FROM (SELECT cell, gene, value / sum(value) OVER (PARTITION BY cell) AS part FROM rk) q JOIN rc ON rc.cell = q.cell GROUP BY rc.label, gene),
  pr AS (SELECT type, gene, s / sum(s) OVER (PARTITION BY type) AS share FROM ps), og AS (SELECT ok.cell, ok.gene, ok.value FROM ok JOIN (SELECT DISTINCT gene FROM pr) g ON g.gene = ok.gene), pt AS (SELECT cell, gene, value / sum(value) OVER (PARTITION BY cell) AS y FROM og)"""
_NORM = "ln(1 + value * (SELECT quantile_cont(t, 0.5) FROM (SELECT sum(value) AS t FROM {src} GROUP BY cell)) / sum(value) OVER (PARTITION BY cell))"
_DOUBLETS = f"""WITH {_PROFILE}, yy AS (SELECT cell, sum(y * y) AS yy FROM pt GROUP BY cell), dd AS (SELECT pt.cell, pr.type, sum(y * share) AS d FROM pt JOIN pr ON pr.gene = pt.gene GROUP BY pt.cell, pr.type),
  gg AS (SELECT a.type AS a, b.type AS b, sum(a.share * b.share) AS g FROM pr a JOIN pr b ON a.gene = b.gene GROUP BY a.type, b.type), one AS (SELECT dd.*, yy.yy, gg.g, round(yy.yy - d * d / gg.g, 12) AS single FROM dd JOIN yy ON yy.cell = dd.cell JOIN gg ON gg.a = dd.type AND gg.b = dd.type),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY single, type) AS place FROM one) q WHERE place = 1),
  two AS (SELECT *, round(yy - wp * dp - wq * dq, 12) AS r FROM (SELECT p.cell, p.type AS p, q.type AS q, p.yy, p.d AS dp, q.d AS dq, (p.d * q.g - q.d * x.g) / (p.g * q.g - x.g * x.g) AS wp, (q.d * p.g - p.d * x.g) / (p.g * q.g - x.g * x.g) AS wq FROM one p JOIN one q ON q.cell = p.cell AND p.type < q.type JOIN gg x ON x.a = p.type AND x.b = q.type WHERE p.g * q.g - x.g * x.g > 1e-15) w WHERE wp > 0 AND wq > 0),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY r, p, q) AS place FROM two) z WHERE place = 1),
  f AS (SELECT t.cell, t.type, t.single, b.r, CASE WHEN wp >= wq THEN p ELSE q END AS f1, CASE WHEN wp >= wq THEN q ELSE p END AS f2, greatest(wp, wq) / (wp + wq) AS share FROM top t LEFT JOIN best b ON b.cell = t.cell),
  h AS (SELECT *, coalesce(1 - share >= 0.25 AND single - r >= 0.1 * single, false) AS pair FROM f),
  dl AS (SELECT cell, CASE WHEN pair THEN f1 ELSE type END AS first_type, CASE WHEN pair THEN f2 END AS second_type, CASE WHEN pair THEN 'doublet' ELSE 'singlet' END AS class, CASE WHEN pair THEN share ELSE 1 END AS first_share, CASE WHEN pair THEN r ELSE single END AS residual, single AS single_residual FROM h
    UNION ALL SELECT cell, NULL, NULL, 'reject', NULL, NULL, NULL FROM yy WHERE cell NOT IN (SELECT cell FROM h))"""
#: DuckDB's form; fitted and iterated operators have none.
SQL = {
    "embedding_neighbours": """WITH x AS (SELECT item, embedding::DOUBLE[] AS v FROM {vectors}), d AS (SELECT a.item AS src, b.item AS dst, row_number() OVER (PARTITION BY a.item ORDER BY round(list_distance(a.v, b.v), 9), b.item) AS place FROM x a JOIN x b ON a.item <> b.item) SELECT src, dst FROM d WHERE place <= 15""",
    "label_stability": thinning.STABILITY_SQL.replace("AS flip_rate", "AS flip_rate"),
    "resolvability": thinning.RESOLVABILITY_SQL,
    "reference_match": f"""WITH r AS ({thinning.RESOLVABILITY_SQL}), t AS (SELECT max(n_shared) / (SELECT count(*) FROM {{genes}} WHERE NOT control) AS o, avg(f1) AS f, count(*) FILTER (tier = 'resolvable') AS k, count(*) AS n FROM r),
      v AS (SELECT *, k / n AS s, CASE WHEN o >= 0.5 AND f >= 0.5 AND k / n >= 0.5 THEN 'good' WHEN o >= 0.3 AND f >= 0.35 THEN 'fair' ELSE 'poor' END AS verdict FROM t)
      SELECT 'own' AS reference, 'ok' AS status, round(o, 3) AS overlap, round(f, 3) AS mean_f1, k AS n_resolvable, n AS n_types, round(s, 3) AS share_resolvable, verdict, round(0.5 * f + 0.3 * s + 0.2 * o, 3) AS match_score, false AS tissue_mismatch,
      CASE verdict WHEN 'good' THEN 'supervised_transfer' WHEN 'fair' THEN 'coarsen_then_transfer' ELSE 'unsupervised_clustering' END AS action, o < 0.3 OR f < 0.35 OR s < 0.3 AS poor_fit FROM v""",
    "doublet_types": f"{_DOUBLETS} SELECT cell, first_type, second_type, class, round(first_share, 5) AS first_share, round(residual, 6) AS residual, round(single_residual, 6) AS single_residual FROM dl",
    "purified_counts": f"""{_DOUBLETS}, w AS (SELECT cell, first_type AS type, first_share AS w FROM dl WHERE first_type IS NOT NULL UNION ALL SELECT cell, second_type, 1 - first_share FROM dl WHERE second_type IS NOT NULL), mn AS (SELECT cell, first_type AS main FROM dl WHERE first_type IS NOT NULL),
      s AS (SELECT ok.cell, ok.gene, ok.value, sum(coalesce(w.w * pr.share, 0)) AS al, sum(CASE WHEN w.type = mn.main THEN coalesce(w.w * pr.share, 0) ELSE 0 END) AS own FROM ok LEFT JOIN w ON w.cell = ok.cell LEFT JOIN mn ON mn.cell = ok.cell LEFT JOIN pr ON pr.type = w.type AND pr.gene = ok.gene GROUP BY ok.cell, ok.gene, ok.value)
      SELECT cell, gene, value::DOUBLE AS value, round(CASE WHEN al > 0 THEN value * own / al ELSE value END, 5) AS purified FROM s""",
    "rank_correlation": f"""WITH {_PROFILE}, g AS (SELECT DISTINCT gene FROM pr), cs AS (SELECT DISTINCT cell FROM og), ca AS (SELECT cs.cell, g.gene, coalesce(og.value, 0)::DOUBLE AS x FROM cs CROSS JOIN g LEFT JOIN og ON og.cell = cs.cell AND og.gene = g.gene), ta AS (SELECT t.type, g.gene, coalesce(round(pr.share, 12), 0) AS x FROM (SELECT DISTINCT type FROM pr) t CROSS JOIN g LEFT JOIN pr ON pr.type = t.type AND pr.gene = g.gene),
      cr AS (SELECT cell, gene, rank() OVER (PARTITION BY cell ORDER BY x) + (count(*) OVER (PARTITION BY cell, x) - 1) / 2.0 AS r FROM ca), tr AS (SELECT type, gene, rank() OVER (PARTITION BY type ORDER BY x) + (count(*) OVER (PARTITION BY type, x) - 1) / 2.0 AS r FROM ta),
      z AS (SELECT cr.cell, tr.type, round(corr(cr.r, tr.r), 9) AS rho FROM cr JOIN tr ON tr.gene = cr.gene GROUP BY cr.cell, tr.type), p AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY rho DESC, type) AS place FROM z WHERE rho IS NOT NULL AND NOT isnan(rho))
      SELECT a.cell, a.type AS label, round(a.rho, 6) AS correlation, round(a.rho - b.rho, 6) AS delta FROM p a LEFT JOIN p b ON b.cell = a.cell AND b.place = 2 WHERE a.place = 1""",
    "program_scores": f"""WITH g AS (SELECT gene, marker_set AS program FROM {{genes}} WHERE NOT control AND marker_set IN (SELECT DISTINCT marker_set FROM {{genes}} ORDER BY marker_set LIMIT 5)), v AS (SELECT cell, gene, {_NORM.format(src="{counts}")} AS v FROM {{counts}}), n AS (SELECT count(*) AS n FROM {{cells}}),
      st AS (SELECT gene, sum(v) / max(n.n) AS m, sqrt(greatest(sum(v * v) / max(n.n) - (sum(v) / max(n.n)) * (sum(v) / max(n.n)), 0)) AS sd FROM v CROSS JOIN n GROUP BY gene), k AS (SELECT g.program, g.gene, st.m, CASE WHEN st.sd < 1e-9 THEN 1 ELSE st.sd END AS sd, count(*) OVER (PARTITION BY g.program) AS size FROM g LEFT JOIN st ON st.gene = g.gene),
      b AS (SELECT program, sum(-coalesce(m / sd, 0) / size) AS base FROM k GROUP BY program), x AS (SELECT v.cell, k.program, sum(v.v / k.sd / k.size) AS part FROM v JOIN k ON k.gene = v.gene WHERE k.m IS NOT NULL GROUP BY v.cell, k.program)
      SELECT c.cell, b.program, round(coalesce(x.part, 0) + b.base, 6) AS score FROM {{cells}} c CROSS JOIN b LEFT JOIN x ON x.cell = c.cell AND x.program = b.program""",
    "copy_number": f"""WITH e AS ({spatial.SQL["neighbour_graph"]}), v0 AS (SELECT cell, gene, value * (SELECT quantile_cont(t, 0.5) FROM (SELECT sum(value) AS t FROM {{counts}} GROUP BY cell)) / sum(value) OVER (PARTITION BY cell) AS v FROM {{counts}}),
      sm AS (SELECT e.src AS cell, v0.gene, sum(v0.v) / max(d.n) AS v FROM e JOIN v0 ON v0.cell = e.dst JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) d ON d.src = e.src GROUP BY e.src, v0.gene),
      v1 AS (SELECT cell, gene, ln(1 + v * (SELECT quantile_cont(t, 0.5) FROM (SELECT sum(v) AS t FROM sm GROUP BY cell)) / sum(v) OVER (PARTITION BY cell)) AS v FROM sm),
      ap AS (SELECT g.gene, g.marker_set AS chromosome, row_number() OVER (PARTITION BY g.marker_set ORDER BY g.position, g.gene) AS pos, count(*) OVER (PARTITION BY g.marker_set) AS size FROM {{genes}} g WHERE g.gene IN (SELECT gene FROM {{counts}})),
      nm AS (SELECT c.cell, c.label = 'BUILDING' AS normal FROM {{cells}} c WHERE c.cell IN (SELECT cell FROM v1)), mn AS (SELECT gene, sum(v) / (SELECT count(*) FROM nm WHERE normal) AS m FROM v1 JOIN nm ON nm.cell = v1.cell WHERE nm.normal GROUP BY gene),
      wd AS (SELECT chromosome, min(size) AS size, unnest(range(1, greatest(min(size) - 20, 0)::INT + 2, 10)) AS b FROM ap GROUP BY chromosome), wg AS (SELECT ap.gene, wd.chromosome, wd.b, least(wd.size, 20) AS width FROM wd JOIN ap ON ap.chromosome = wd.chromosome AND ap.pos >= wd.b AND ap.pos < wd.b + 20),
      bs AS (SELECT wg.chromosome, wg.b, sum(coalesce(mn.m, 0)) / max(width) AS base FROM wg LEFT JOIN mn ON mn.gene = wg.gene GROUP BY wg.chromosome, wg.b), su AS (SELECT v1.cell, wg.chromosome, wg.b, sum(v1.v) / max(width) AS x FROM v1 JOIN wg ON wg.gene = v1.gene GROUP BY ALL),
      x AS (SELECT nm.cell, nm.normal, coalesce(su.x, 0) - bs.base AS x FROM nm CROSS JOIN bs LEFT JOIN su ON su.cell = nm.cell AND su.chromosome = bs.chromosome AND su.b = bs.b), l AS (SELECT 1.5 * stddev_pop(x) AS l FROM x),
      bu AS (SELECT cell, any_value(normal) AS normal, sqrt(avg(CASE WHEN abs(x) < l.l THEN 0 ELSE x * x END)) AS burden FROM x CROSS JOIN l GROUP BY cell), q AS (SELECT quantile_cont(burden, 0.95) AS bar FROM bu WHERE normal)
      SELECT c.cell, round(bu.burden, 6) AS burden, coalesce(bu.burden > q.bar, false) AS malignant FROM {{cells}} c CROSS JOIN q LEFT JOIN bu ON bu.cell = c.cell""",
    "silhouettes": """WITH x AS (SELECT item, label, embedding::DOUBLE[] AS v FROM {vectors}), d AS (SELECT a.item, a.label, b.label AS other, sum(list_distance(a.v, b.v) * list_distance(a.v, b.v)) AS s, count(*) AS n FROM x a JOIN x b ON true GROUP BY ALL),
      r AS (SELECT item, label, max(n) FILTER (label = other) AS n, sum(s) FILTER (label = other) AS a, min(s / n) FILTER (label <> other) AS b, sum(s) FILTER (label <> other) / sum(n) FILTER (label <> other) AS r FROM d GROUP BY item, label)
      SELECT item, label, round(CASE WHEN n = 1 THEN 0 ELSE (b - a / (n - 1)) / greatest(b, a / (n - 1)) END, 6) AS silhouette, round(CASE WHEN n = 1 THEN 0 ELSE (r - a / (n - 1)) / greatest(r, a / (n - 1)) END, 6) AS silhouette_2label FROM r""",
    "negative_share": f"""WITH {_REF}, z AS (SELECT label, count(*) AS n FROM rc GROUP BY label), rt AS (SELECT rc.label, rk.gene, count(*) * 1.0 / max(z.n) AS rate FROM rk JOIN rc ON rc.cell = rk.cell JOIN z ON z.label = rc.label GROUP BY rc.label, rk.gene), kn AS (SELECT gene FROM rt GROUP BY gene HAVING max(rate) >= 0.02),
      fg AS (SELECT z.label, kn.gene FROM kn CROSS JOIN z LEFT JOIN rt ON rt.gene = kn.gene AND rt.label = z.label WHERE coalesce(rt.rate, 0) <= 0.01), sh AS (SELECT DISTINCT rk.gene FROM rk JOIN ok ON ok.gene = rk.gene),
      t AS (SELECT ok.cell, sum(CASE WHEN fg.gene IS NOT NULL THEN ok.value ELSE 0 END) / sum(ok.value) AS s FROM ok JOIN sh ON sh.gene = ok.gene JOIN oc ON oc.cell = ok.cell LEFT JOIN fg ON fg.gene = ok.gene AND fg.label = oc.label GROUP BY ok.cell)
      SELECT oc.cell, round(CASE WHEN oc.label IN (SELECT label FROM fg) THEN t.s END, 6) AS nmp FROM oc LEFT JOIN t ON t.cell = oc.cell""",
    "pairs_apart": f"""WITH {_REF}, top AS (SELECT gene FROM rk WHERE gene IN (SELECT gene FROM ok) GROUP BY gene ORDER BY count(*) DESC, gene LIMIT 400),
      a AS (SELECT k.cell, k.gene, 'r' AS side FROM rk k JOIN top ON top.gene = k.gene UNION ALL SELECT k.cell, k.gene, 'o' FROM ok k JOIN top ON top.gene = k.gene), n AS (SELECT side, gene, count(*) AS n FROM a GROUP BY side, gene), m AS (SELECT x.side, x.gene AS a, y.gene AS b, count(*) AS m FROM a x JOIN a y ON x.cell = y.cell AND x.side = y.side AND x.gene < y.gene GROUP BY ALL),
      p AS (SELECT x.gene AS a, y.gene AS b FROM top x JOIN top y ON x.gene < y.gene), r AS (SELECT p.a, p.b, s.side, coalesce(m.m, 0) / (u.n + v.n - coalesce(m.m, 0)) AS rate FROM p CROSS JOIN (SELECT 'r' AS side UNION ALL SELECT 'o') s JOIN n u ON u.side = s.side AND u.gene = p.a JOIN n v ON v.side = s.side AND v.gene = p.b LEFT JOIN m ON m.side = s.side AND m.a = p.a AND m.b = p.b),
      z AS (SELECT a, b, rate FROM r WHERE side = 'r' AND rate <= 0.1 ORDER BY round(rate, 12), a, b LIMIT 2000) SELECT z.a, z.b, round(z.rate, 6) AS reference_rate, round(o.rate, 6) AS rate, o.rate <= 0.1 AS apart FROM z JOIN r o ON o.a = z.a AND o.b = z.b AND o.side = 'o'""",
    "reference_markers": f"""WITH rc AS (SELECT cell, label FROM {{cells}}), c AS (SELECT rk.cell, rc.label, rk.gene, rk.value FROM {{counts}} rk JOIN rc ON rc.cell = rk.cell JOIN {{genes}} g ON g.gene = rk.gene WHERE NOT g.control AND rc.label IN (SELECT label FROM rc GROUP BY label HAVING count(*) >= 20)), v AS (SELECT label, gene, {_NORM.format(src="c")} AS v FROM c),
      s AS (SELECT label, gene, sum(v) AS s1, sum(v * v) AS s2 FROM v GROUP BY label, gene), n AS (SELECT label, count(*)::DOUBLE AS n, sum(count(*)) OVER ()::DOUBLE AS al FROM rc GROUP BY label HAVING count(*) >= 20), w AS (SELECT s.label, gene, s1, s2, sum(s1) OVER (PARTITION BY gene) - s1 AS r1, sum(s2) OVER (PARTITION BY gene) - s2 AS r2, n, al - n AS m FROM s JOIN n ON n.label = s.label),
      t AS (SELECT label, gene, (s1 / n - r1 / m) / nullif(sqrt((s2 - s1 * s1 / n) / (n - 1) / n + (r2 - r1 * r1 / m) / (m - 1) / m), 0) AS t FROM w WHERE n > 1 AND m > 1), p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(t, 9) DESC, gene) AS place FROM t WHERE t IS NOT NULL) SELECT label, place, gene FROM p WHERE place <= 8""",
}
