"""Operators as SQL over a section's frames; ``{counts}``, ``{cells}``, ``{genes}``, ``{votes}``, ``{judged}`` and
``{molecules}`` stand for them. Group sizes always come from ``cells``, as zeros are implicit in ``counts``.

Nothing here collects a matrix: rows are aggregated by cell, gene, label or pair, and what is joined to every row is
bounded by the number of labels or marker sets.
"""

from __future__ import annotations

#: Quality thresholds (metric: warn, error) of a section.
GENES_WARN, GENES_ERROR, COUNTS_WARN, COUNTS_ERROR, EMPTY_WARN, EMPTY_ERROR, CONTROL_WARN, CONTROL_ERROR = 20, 10, 50, 25, 0.15, 0.25, 2, 5

METRICS = """SELECT c.cell, c.label, coalesce(sum(CASE WHEN NOT g.control THEN k.value END), 0) AS total,
  count(CASE WHEN NOT g.control THEN 1 END) AS n_genes,
  100 * sum(CASE WHEN g.control THEN k.value ELSE 0 END) / nullif(sum(k.value), 0) AS pct_control
  FROM {cells} c LEFT JOIN {counts} k ON k.cell = c.cell LEFT JOIN {genes} g ON g.gene = k.gene GROUP BY c.cell, c.label"""

#: Log-normalised values: count * median total / total.
NORMALISED = """SELECT k.cell, k.gene, ln(1 + k.value * m.target / t.total) AS v FROM {counts} k
  JOIN (SELECT cell, sum(value) AS total FROM {counts} GROUP BY cell) t ON t.cell = k.cell
  CROSS JOIN (SELECT percentile(total, 0.5e0) AS target FROM (SELECT sum(value) AS total FROM {counts} GROUP BY cell) a) m"""

#: Genes of each marker set with weight 1 / n, and its control genes with weight -1 / n: of each of 25 bins of mean
#: expression that holds a gene of the set, the 50 other genes of least hash.
WEIGHTS = f"""WITH m AS (SELECT g.gene, g.marker_set, ntile(25) OVER (ORDER BY round(coalesce(t.v, 0), 6), g.gene) AS bin FROM {{genes}} g
    LEFT JOIN (SELECT gene, sum(v) AS v FROM ({NORMALISED}) x GROUP BY gene) t ON t.gene = g.gene WHERE NOT g.control),
  b AS (SELECT DISTINCT marker_set, bin FROM m),
  k AS (SELECT marker_set, gene FROM (SELECT b.marker_set, m.gene, row_number() OVER (PARTITION BY b.marker_set, b.bin ORDER BY md5(CAST(m.gene AS STRING)), m.gene) AS place FROM b JOIN m ON m.bin = b.bin AND m.marker_set <> b.marker_set) c WHERE place <= 50)
  SELECT m.marker_set, m.gene, 1.0e0 / n.n AS w FROM m JOIN (SELECT marker_set, count(*) AS n FROM m GROUP BY marker_set) n ON n.marker_set = m.marker_set
  UNION ALL SELECT k.marker_set, k.gene, -1.0e0 / n.n FROM k JOIN (SELECT marker_set, count(*) AS n FROM k GROUP BY marker_set) n ON n.marker_set = k.marker_set"""

#: Signature score of each marker set in each cell: mean of its genes less mean of its control genes, zeros included.
SCORES = f"""SELECT c.cell, c.label, s.marker_set, coalesce(v.v, 0) AS score FROM {{cells}} c
  CROSS JOIN (SELECT DISTINCT marker_set FROM {{genes}} WHERE NOT control) s
  LEFT JOIN (SELECT n.cell, w.marker_set, sum(n.v * w.w) AS v FROM ({NORMALISED}) n JOIN ({WEIGHTS}) w ON w.gene = n.gene GROUP BY n.cell, w.marker_set) v
  ON v.cell = c.cell AND v.marker_set = s.marker_set"""

VOTES = "SELECT cell, method, label, count(*) AS n, row_number() OVER (PARTITION BY cell, method ORDER BY count(*) DESC, label) AS place FROM {votes} GROUP BY cell, method, label"
BALLOT = f"SELECT cell, method, label FROM ({VOTES}) b WHERE place = 1"
WINNERS = f"""SELECT cell, label, n, voters, row_number() OVER (PARTITION BY cell ORDER BY n DESC, label) AS place FROM
  (SELECT cell, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY cell) AS voters FROM ({BALLOT}) b GROUP BY cell, label) t"""

#: Average rank of each confidence (ties share), for rank statistics.
RANKED = """SELECT grp, confidence, pos, neg, sum(pos + neg) OVER (PARTITION BY grp ORDER BY confidence) - (pos + neg) + (pos + neg + 1) / 2.0e0 AS r FROM
  (SELECT grp, confidence, sum(correct) AS pos, sum(1 - correct) AS neg FROM {judged} GROUP BY grp, confidence) t"""

CONTINGENCY = "SELECT predicted AS a, grp AS b, count(*) AS n FROM {judged} GROUP BY predicted, grp"

#: The 15 genes that mark each label best, by Welch's t against all other cells.
RANKING = f"""WITH s AS (SELECT c.label, x.gene, sum(x.v) AS s1, sum(x.v * x.v) AS s2 FROM ({NORMALISED}) x JOIN {{cells}} c ON c.cell = x.cell GROUP BY c.label, x.gene),
      n AS (SELECT label, count(*) AS n FROM {{cells}} GROUP BY label), t AS (SELECT sum(n) AS n FROM n), g AS (SELECT gene, sum(s1) AS s1, sum(s2) AS s2 FROM s GROUP BY gene),
      w AS (SELECT s.label, s.gene, (s.s1 / n.n - (g.s1 - s.s1) / (t.n - n.n)) / nullif(sqrt((s.s2 - s.s1 * s.s1 / n.n) / (n.n - 1) / n.n + ((g.s2 - s.s2) - (g.s1 - s.s1) * (g.s1 - s.s1) / (t.n - n.n)) / (t.n - n.n - 1) / (t.n - n.n)), 0) AS t
        FROM s JOIN n ON n.label = s.label CROSS JOIN t JOIN g ON g.gene = s.gene)
      SELECT label, gene, round(t, 5) AS t, place FROM (SELECT label, gene, t, row_number() OVER (PARTITION BY label ORDER BY round(t, 9) DESC, gene) AS place FROM w WHERE t IS NOT NULL) r WHERE place <= 15"""

STATEMENTS: dict[str, str] = {
    # quality control
    "qc_metrics": f"SELECT cell, CAST(total AS DOUBLE) AS total, n_genes, round(pct_control, 6) AS pct_control FROM ({METRICS}) m",
    "section_qc_summary": f"""SELECT count(*) AS n_cells, percentile(CAST(total AS DOUBLE), 0.5e0) AS median_total, percentile(CAST(n_genes AS DOUBLE), 0.5e0) AS median_genes,
      round(percentile(pct_control, 0.5e0), 6) AS median_control, round(avg(CASE WHEN total = 0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS share_empty FROM ({METRICS}) m""",
    "qc_flags": f"""WITH m AS (SELECT percentile(CAST(n_genes AS DOUBLE), 0.5e0) AS genes, percentile(CAST(total AS DOUBLE), 0.5e0) AS counts, avg(CASE WHEN total = 0 THEN 1.0e0 ELSE 0.0e0 END) AS empty, percentile(pct_control, 0.5e0) AS control FROM ({METRICS}) q)
      SELECT metric, round(v, 6) AS value, CASE WHEN bad >= err THEN 'error' WHEN bad >= warn THEN 'warn' ELSE 'ok' END AS flag FROM (
      SELECT 'genes' AS metric, genes AS v, -genes AS bad, {-GENES_WARN} AS warn, {-GENES_ERROR} AS err FROM m UNION ALL SELECT 'counts', counts, -counts, {-COUNTS_WARN}, {-COUNTS_ERROR} FROM m
      UNION ALL SELECT 'empty', empty, empty, {EMPTY_WARN}, {EMPTY_ERROR} FROM m UNION ALL SELECT 'control', control, control, {CONTROL_WARN}, {CONTROL_ERROR} FROM m) t""",
    "count_floor": f"""SELECT n_panel, CASE WHEN n_panel < 1000 THEN 10.0e0 ELSE greatest(q, 1.0e0) END AS floor, CAST(sum(CASE WHEN total < CASE WHEN n_panel < 1000 THEN 10.0e0 ELSE greatest(q, 1.0e0) END THEN 1 ELSE 0 END) AS BIGINT) AS n_removed
      FROM ({METRICS}) m CROSS JOIN (SELECT count(*) AS n_panel FROM {{genes}} WHERE NOT control) p CROSS JOIN (SELECT percentile(CAST(total AS DOUBLE), 0.02e0) AS q FROM ({METRICS}) m) f GROUP BY n_panel, q""",
    "cell_filter": f"SELECT cell, label FROM ({METRICS}) m WHERE total >= 10 AND n_genes >= 5 AND coalesce(pct_control, 0) <= 5",
    "gene_filter": "SELECT g.gene, g.marker_set, count(k.cell) AS n_cells FROM {genes} g JOIN {counts} k ON k.gene = g.gene GROUP BY g.gene, g.marker_set HAVING count(k.cell) >= 3",
    "low_signal": f"SELECT cell, n_genes < CASE WHEN n_panel >= 1000 THEN 15 ELSE 1 END AS low_signal FROM ({METRICS}) m CROSS JOIN (SELECT count(*) AS n_panel FROM {{genes}} WHERE NOT control) p",
    "segmentation_outliers": """SELECT cell, CASE WHEN y <= 0 THEN true WHEN hi > lo THEN y < lo OR y > hi ELSE false END AS area_outlier FROM {cells} c
      CROSS JOIN (SELECT percentile(y, 0.005e0) AS lo, percentile(y, 0.995e0) AS hi FROM {cells}) q""",
    "qc_survival": f"""SELECT CAST(count(*) AS BIGINT) AS loaded, CAST(sum(CASE WHEN total > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_counts, CAST(sum(CASE WHEN total >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS above_floor,
      CAST(sum(CASE WHEN total >= 10 AND n_genes >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS with_genes, CAST(sum(CASE WHEN total >= 10 AND n_genes >= 5 AND coalesce(pct_control, 0) <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS clean FROM ({METRICS}) m""",
    "qc_histogram": f"""SELECT CAST(least(floor((ln(total) - lo) / nullif((hi - lo) / 44, 0)), 43) AS BIGINT) AS bin, count(*) AS n FROM ({METRICS}) m
      CROSS JOIN (SELECT ln(min(total)) AS lo, ln(max(total)) AS hi FROM ({METRICS}) m WHERE total > 0) r WHERE total > 0 GROUP BY 1""",
    # composition and expression tables
    "composition": "SELECT label, count(*) AS n, round(count(*) * 1.0e0 / sum(count(*)) OVER (), 9) AS share, row_number() OVER (ORDER BY count(*) DESC, label) AS place FROM {cells} GROUP BY label",
    "dotplot": f"""SELECT label, gene, round(mean, 6) AS mean, round(pct, 6) AS pct, round(mean / nullif(max(mean) OVER (PARTITION BY gene), 0), 6) AS scaled FROM (
      SELECT c.label, n.gene, sum(n.v) / s.n AS mean, 100.0e0 * count(*) / s.n AS pct FROM ({NORMALISED}) n JOIN {{cells}} c ON c.cell = n.cell
      JOIN (SELECT label, count(*) AS n FROM {{cells}} GROUP BY label HAVING count(*) >= 5) s ON s.label = c.label GROUP BY c.label, n.gene, s.n) t""",
    "expression_by_label": """SELECT c.label, g.marker_set, count(*) AS n, round(avg(coalesce(v, 0)), 6) AS mean, percentile(CAST(coalesce(v, 0) AS DOUBLE), 0.25e0) AS q25, percentile(CAST(coalesce(v, 0) AS DOUBLE), 0.5e0) AS q50, percentile(CAST(coalesce(v, 0) AS DOUBLE), 0.75e0) AS q75
      FROM {cells} c CROSS JOIN (SELECT DISTINCT marker_set FROM {genes}) g
      LEFT JOIN (SELECT k.cell, g.marker_set, sum(k.value) AS v FROM {counts} k JOIN {genes} g ON g.gene = k.gene GROUP BY k.cell, g.marker_set) t ON t.cell = c.cell AND t.marker_set = g.marker_set GROUP BY c.label, g.marker_set""",
    # panel
    "panel_coverage": """SELECT g.marker_set, count(*) AS n_markers, CAST(sum(CASE WHEN k.gene IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_present, round(avg(CASE WHEN k.gene IS NOT NULL THEN 1.0e0 ELSE 0.0e0 END), 6) AS fraction,
      CASE WHEN sum(CASE WHEN k.gene IS NOT NULL THEN 1 ELSE 0 END) >= 3 THEN 'green' WHEN sum(CASE WHEN k.gene IS NOT NULL THEN 1 ELSE 0 END) >= 1 THEN 'amber' ELSE 'red' END AS light
      FROM {genes} g LEFT JOIN (SELECT DISTINCT gene FROM {counts}) k ON k.gene = g.gene GROUP BY g.marker_set""",
    "confusable_pairs": f"""WITH r AS ({RANKING}), held AS (SELECT label, gene FROM r), sizes AS (SELECT label, count(*) AS n FROM held GROUP BY label),
      met AS (SELECT a.label AS a, b.label AS b, count(*) AS shared FROM held a JOIN held b ON a.gene = b.gene AND a.label < b.label GROUP BY a.label, b.label)
      SELECT x.label AS a, y.label AS b, coalesce(met.shared, 0) AS shared, x.n - coalesce(met.shared, 0) AS private_a, y.n - coalesce(met.shared, 0) AS private_b, x.n = coalesce(met.shared, 0) OR y.n = coalesce(met.shared, 0) AS confusable
      FROM sizes x JOIN sizes y ON x.label < y.label LEFT JOIN met ON met.a = x.label AND met.b = y.label""",
    "panel_overlap": """SELECT c.label, count(DISTINCT k.gene) AS shared, round(count(DISTINCT k.gene) * 1.0e0 / max(p.n), 6) AS overlap FROM {cells} c JOIN {counts} k ON k.cell = c.cell CROSS JOIN (SELECT count(*) AS n FROM {genes}) p GROUP BY c.label""",
    # normalisation and scoring
    "normalize_log": f"SELECT cell, gene, round(v, 6) AS v FROM ({NORMALISED}) n",
    "variable_genes": f"""WITH d AS (SELECT gene, mean, ln(var / mean) AS dispersion FROM (SELECT gene, sum(v) / n AS mean, (sum(v * v) - sum(v) * sum(v) / n) / (n - 1) AS var FROM ({NORMALISED}) x CROSS JOIN (SELECT count(*) AS n FROM {{cells}}) c GROUP BY gene, n) t WHERE var > 0),
      e AS (SELECT gene, mean, dispersion, least(floor((mean - lo) / nullif((hi - lo) / 20, 0)), 19) AS bin FROM d CROSS JOIN (SELECT min(mean) AS lo, max(mean) AS hi FROM d) r),
      z AS (SELECT e.gene, mean, dispersion, coalesce((dispersion - b.m) / nullif(b.s, 0), 1) AS norm FROM e JOIN (SELECT bin, avg(dispersion) AS m, stddev_samp(dispersion) AS s FROM e GROUP BY bin) b ON b.bin = e.bin)
      SELECT gene, round(mean, 6) AS mean, round(dispersion, 6) AS dispersion, round(norm, 5) AS norm_dispersion FROM (SELECT *, row_number() OVER (ORDER BY round(norm, 9) DESC, gene) AS place FROM z) p WHERE place <= 2000""",
    "zscores": f"""SELECT x.cell, x.gene, round(greatest(least((x.v - s.mean) / s.sd, 10.0e0), -10.0e0), 5) AS z, round(greatest(-s.mean / s.sd, -10.0e0), 5) AS zero_z FROM ({NORMALISED}) x JOIN (
      SELECT gene, sum(v) / n AS mean, sqrt((sum(v * v) - sum(v) * sum(v) / n) / (n - 1)) AS sd FROM ({NORMALISED}) y CROSS JOIN (SELECT count(*) AS n FROM {{cells}}) c GROUP BY gene, n) s ON s.gene = x.gene WHERE s.sd > 0""",
    "signature_scores": f"SELECT cell, marker_set, round(score, 6) AS score FROM ({SCORES}) s",
    "label_by_markers": f"""SELECT label, marker_set, round(mean, 6) AS mean FROM (SELECT label, marker_set, avg(score) AS mean, row_number() OVER (PARTITION BY label ORDER BY round(avg(score), 9) DESC, marker_set) AS place FROM ({SCORES}) s GROUP BY label, marker_set) t WHERE place = 1""",
    "top_two_margin": f"""SELECT cell, max(CASE WHEN place = 1 THEN marker_set END) AS best, round(max(CASE WHEN place = 1 THEN score END), 6) AS top1, round(coalesce(max(CASE WHEN place = 2 THEN score END), 0), 6) AS top2
      FROM (SELECT cell, marker_set, score, row_number() OVER (PARTITION BY cell ORDER BY round(score, 9) DESC, marker_set) AS place FROM ({SCORES}) s) t WHERE place <= 2 GROUP BY cell""",
    "posterior_confidence": f"""SELECT cell, round(1 / (1 + exp(-margin / (sd + 1e-9))), 6) AS posterior FROM (SELECT cell, max(CASE WHEN place = 1 THEN score END) - coalesce(max(CASE WHEN place = 2 THEN score END), 0) AS margin
      FROM (SELECT cell, score, row_number() OVER (PARTITION BY cell ORDER BY round(score, 9) DESC, marker_set) AS place FROM ({SCORES}) s) t WHERE place <= 2 GROUP BY cell) m
      CROSS JOIN (SELECT stddev_pop(margin) AS sd FROM (SELECT cell, max(CASE WHEN place = 1 THEN score END) - coalesce(max(CASE WHEN place = 2 THEN score END), 0) AS margin
      FROM (SELECT cell, score, row_number() OVER (PARTITION BY cell ORDER BY round(score, 9) DESC, marker_set) AS place FROM ({SCORES}) s) t WHERE place <= 2 GROUP BY cell) n) q""",
    "marker_ranking": RANKING,
    "relabel_by_size": "SELECT c.cell, CAST(r.place - 1 AS BIGINT) AS cluster FROM {cells} c JOIN (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS place FROM {cells} GROUP BY label) r ON r.label = c.label",
    # consensus and calibration
    "majority_vote": f"SELECT cell, label, CAST(n AS BIGINT) AS votes, round(n * 1.0e0 / voters, 6) AS agreement FROM ({WINNERS}) w WHERE place = 1",
    "consensus_metrics": f"""SELECT bin, count(*) AS n, round(avg(agreement), 6) AS mean_agreement FROM (SELECT CASE WHEN voters < 2 THEN 'single' WHEN n * 1.0e0 / voters >= 0.9e0 THEN 'very_high' WHEN n * 1.0e0 / voters >= 0.7e0 THEN 'high' WHEN n * 1.0e0 / voters >= 0.5e0 THEN 'moderate' ELSE 'low' END AS bin, n * 1.0e0 / voters AS agreement FROM ({WINNERS}) w WHERE place = 1) t GROUP BY bin""",
    "calibration_error": """SELECT round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece FROM (SELECT least(floor(confidence * 10), 9) AS bin, count(*) AS n, avg(confidence) AS conf, avg(correct) AS acc FROM {judged} GROUP BY least(floor(confidence * 10), 9)) t""",
    "brier_score": "SELECT round(avg((confidence - correct) * (confidence - correct)), 6) AS brier, round(avg(correct), 6) AS base FROM {judged}",
    "reliability_curve": "SELECT CAST(least(floor(confidence * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(correct), 6) AS accuracy FROM {judged} GROUP BY 1",
    "auc_within_groups": f"SELECT grp, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round((sum(pos * r) - sum(pos) * (sum(pos) + 1) / 2.0e0) / nullif(sum(pos) * sum(neg), 0), 6) AS auc FROM ({RANKED}) t GROUP BY grp",
    "contingency_scores": f"""WITH c AS ({CONTINGENCY}), t AS (SELECT sum(n) AS n FROM c), a AS (SELECT a, sum(n) AS n FROM c GROUP BY a), b AS (SELECT b, sum(n) AS n FROM c GROUP BY b),
      h AS (SELECT (SELECT -sum(a.n * 1.0e0 / t.n * ln(a.n * 1.0e0 / t.n)) FROM a CROSS JOIN t) AS ha, (SELECT -sum(b.n * 1.0e0 / t.n * ln(b.n * 1.0e0 / t.n)) FROM b CROSS JOIN t) AS hb,
        (SELECT sum(c.n * 1.0e0 / t.n * ln(c.n * 1.0e0 * t.n / (a.n * b.n))) FROM c JOIN a ON a.a = c.a JOIN b ON b.b = c.b CROSS JOIN t) AS mi),
      p AS (SELECT (SELECT sum(n * (n - 1) / 2.0e0) FROM c) AS pc, (SELECT sum(n * (n - 1) / 2.0e0) FROM a) AS pa, (SELECT sum(n * (n - 1) / 2.0e0) FROM b) AS pb, (SELECT n * (n - 1) / 2.0e0 FROM t) AS pt)
      SELECT round(mi, 6) AS mutual, round(2 * mi / (ha + hb), 6) AS nmi, round((pc - pa * pb / pt) / ((pa + pb) / 2 - pa * pb / pt), 6) AS ari FROM h CROSS JOIN p""",
    "element_similarity": f"""WITH c AS ({CONTINGENCY}), a AS (SELECT a, sum(n) AS n FROM c GROUP BY a), b AS (SELECT b, sum(n) AS n FROM c GROUP BY b)
      SELECT round(sum(c.n * (1 - 0.5e0 * (c.n * abs(1.0e0 / a.n - 1.0e0 / b.n) + (a.n - c.n) * 1.0e0 / a.n + (b.n - c.n) * 1.0e0 / b.n))) / sum(c.n), 6) AS similarity FROM c JOIN a ON a.a = c.a JOIN b ON b.b = c.b""",
    "conformal_quantiles": "SELECT grp, count(*) AS n, percentile(1 - confidence, 0.9e0) AS q90 FROM {judged} WHERE correct = 1 GROUP BY grp",
    # purity
    "marker_purity": """SELECT c.label, count(*) AS n, round(avg(CASE WHEN coalesce(t.sets, 0) >= 2 THEN 0.0e0 ELSE 1.0e0 END), 6) AS purity FROM {cells} c LEFT JOIN (
      SELECT k.cell, count(DISTINCT g.marker_set) AS sets FROM {counts} k JOIN {genes} g ON g.gene = k.gene WHERE NOT g.control GROUP BY k.cell) t ON t.cell = c.cell GROUP BY c.label""",
    "exclusive_coexpression": """WITH h AS (SELECT DISTINCT k.cell, g.marker_set FROM {counts} k JOIN {genes} g ON g.gene = k.gene WHERE NOT g.control), n AS (SELECT marker_set, count(*) AS n FROM h GROUP BY marker_set)
      SELECT a.marker_set AS a, b.marker_set AS b, count(*) AS both_n, round(count(*) * 1.0e0 / (x.n + y.n - count(*)), 6) AS both_of_either FROM h a JOIN h b ON a.cell = b.cell AND a.marker_set < b.marker_set JOIN n x ON x.marker_set = a.marker_set JOIN n y ON y.marker_set = b.marker_set GROUP BY a.marker_set, b.marker_set, x.n, y.n""",
    "positive_marker_purity": f"""SELECT s.cell, floor(sum(CASE WHEN g.marker_set = b.marker_set THEN s.value ELSE 0 END) * 1.0e6 / nullif(sum(s.value), 0) + 0.5e0) / 1.0e6 AS pmp FROM {{counts}} s JOIN {{genes}} g ON g.gene = s.gene JOIN {{cells}} c ON c.cell = s.cell
      JOIN (SELECT label, marker_set FROM (SELECT label, marker_set, row_number() OVER (PARTITION BY label ORDER BY round(avg(score), 9) DESC, marker_set) AS place FROM ({SCORES}) q GROUP BY label, marker_set) r WHERE place = 1) b ON b.label = c.label WHERE NOT g.control GROUP BY s.cell""",
    # transfer, programs and genomic windows
    "composition_prior": "SELECT label, round((count(*) + 1.0e0) / (sum(count(*)) OVER () + count(*) OVER ()), 9) AS prior FROM {cells} GROUP BY label",
    "type_profiles": """SELECT c.label, k.gene, round(avg_share / sum(avg_share) OVER (PARTITION BY c.label), 9) AS share FROM (SELECT c.label, k.gene, sum(k.value * 1.0e0 / t.total) AS avg_share FROM {counts} k JOIN (SELECT cell, sum(value) AS total FROM {counts} GROUP BY cell) t ON t.cell = k.cell JOIN {cells} c ON c.cell = k.cell GROUP BY c.label, k.gene) z""".replace("c.label, k.gene, round(avg_share", "label, gene, round(avg_share").replace("PARTITION BY c.label)", "PARTITION BY label)"),
    "soft_label_entropy": f"""SELECT cell, round(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy, round(max(p), 6) AS confidence FROM (SELECT cell, exp(score) / sum(exp(score)) OVER (PARTITION BY cell) AS p FROM ({SCORES}) s) t GROUP BY cell""",
    "genomic_windows": f"""SELECT cell, marker_set, pos, round(mean, 6) AS mean FROM (SELECT k.cell, g.marker_set, row_number() OVER w AS pos, avg(k.v - t.mean) OVER (PARTITION BY k.cell, g.marker_set ORDER BY g.position, g.gene ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING) AS mean
      FROM ({NORMALISED}) k JOIN {{genes}} g ON g.gene = k.gene JOIN (SELECT gene, sum(v) / n AS mean FROM ({NORMALISED}) y CROSS JOIN (SELECT count(*) AS n FROM {{cells}}) c GROUP BY gene, n) t ON t.gene = k.gene WINDOW w AS (PARTITION BY k.cell, g.marker_set ORDER BY g.position, g.gene)) t WHERE pos % 10 = 1""",
    "vertical_coherence": """WITH h AS (SELECT m.cell, m.gene, CASE WHEN m.z >= q.mid THEN 1 ELSE 0 END AS top, count(*) AS n FROM {molecules} m CROSS JOIN (SELECT percentile(z, 0.5e0) AS mid FROM {molecules}) q GROUP BY m.cell, m.gene, CASE WHEN m.z >= q.mid THEN 1 ELSE 0 END)
      SELECT cell, round(dot / nullif(sqrt(a * b), 0), 6) AS cosine FROM (SELECT cell, CAST(sum(t * d) AS DOUBLE) AS dot, CAST(sum(t * t) AS DOUBLE) AS a, CAST(sum(d * d) AS DOUBLE) AS b FROM (SELECT cell, gene, sum(CASE WHEN top = 1 THEN n ELSE 0 END) AS t, sum(CASE WHEN top = 0 THEN n ELSE 0 END) AS d FROM h GROUP BY cell, gene) p GROUP BY cell) v""",
    "molecule_integrity": "SELECT cell, count(*) AS n, round(avg(z), 6) AS mean_signal, round(avg(CASE WHEN z < 50 THEN 1.0e0 ELSE 0.0e0 END), 6) AS share_low FROM {molecules} WHERE z > 1.5e0 GROUP BY cell",
    "stratified_subset": """SELECT cell, label FROM (SELECT c.cell, c.label, row_number() OVER (PARTITION BY c.label ORDER BY md5(CAST(c.cell AS STRING) || '|0'), c.cell) AS place, least(s.n, greatest(40, round(300.0e0 * s.n / t.n))) AS quota FROM {cells} c
      JOIN (SELECT label, count(*) AS n FROM {cells} GROUP BY label) s ON s.label = c.label CROSS JOIN (SELECT count(*) AS n FROM {cells}) t) q WHERE place <= quota""",
    "side_table_coverage": "SELECT c.label, count(*) AS n, round(avg(CASE WHEN v.cell IS NOT NULL THEN 1.0e0 ELSE 0.0e0 END), 6) AS coverage FROM {cells} c LEFT JOIN (SELECT DISTINCT cell FROM {votes}) v ON v.cell = c.cell GROUP BY c.label",
}
