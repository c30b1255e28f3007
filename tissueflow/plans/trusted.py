"""Registered queries of the operators on trust, calibration and vectors, each with SQL written for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissueflow.durable import saved
from tissueflow.operators import calibrate, embedding, grouping, spatial, spillover, trust
from tissueflow.operators.labels import ABSTAIN, log_odds
from tissueflow.operators.reconcile import reconcile
from tissueflow.operators.statements import BALLOT, METRICS, SCORES, STATEMENTS, WINNERS
from tissueflow.sources.section import Section

PROGRAMS = STATEMENTS["label_by_markers"]


def _kept(section: Section) -> Section:
    """The section with its frames kept that the operators below read again and again."""
    section.keep("counts", "cells", "genes", "votes")
    return section


def judged(section: Section) -> DataFrame:
    _kept(section)
    v = trust.vote(section.once(BALLOT))
    cells = section.once(METRICS).join(v.select("cell", "agreement", "n_methods"), "cell", "left")
    return trust.confidence(cells, section.once(SCORES), section.once(STATEMENTS["panel_coverage"]), section["genes"].filter("NOT control").count())


def reasoned(section: Section) -> DataFrame:
    lights = section.once(PROGRAMS).join(section.once(STATEMENTS["panel_coverage"]).select("marker_set", "light"), "marker_set").select("label", "light")
    return trust.rejection_reasons(judged(section), lights)


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns))


def confidence(section: Section) -> DataFrame:
    return _rounded(judged(section).select("cell", "label", "best", "impure", "confidence", "verdict", "reason", "final_label"), confidence=6)


def _verified(section: Section) -> DataFrame:
    lights = section.once(PROGRAMS).join(section.once(STATEMENTS["panel_coverage"]).select("marker_set", "light"), "marker_set").select("label", "light")
    return trust.self_verify(section["cells"], section.once(SCORES), section.once(PROGRAMS).select("label", "marker_set"), lights, section.once(STATEMENTS["confusable_pairs"]).filter("confusable"))


def separation(section: Section) -> DataFrame:
    """How well each type's own program separates it, made once."""
    if "separation" not in section.kept:
        scores, programs = section.once(SCORES), section.once(PROGRAMS).select("label", "marker_set")
        section.kept["separation"] = saved(trust.identifiability(section["cells"], scores, programs))
    return section.kept["separation"]


def _typable(section: Section) -> DataFrame:
    coverage = section.once(PROGRAMS).join(section.once(STATEMENTS["panel_coverage"]), "marker_set").select("label", "n_markers", "n_present")
    return trust.typability(coverage, separation(section), sizes=section["cells"].groupBy("label").agg(F.count(F.lit(1)).alias("n")))


def ledger(section: Section) -> DataFrame:
    agreed = trust.vote(section.once(BALLOT)).join(section["cells"].select("cell", F.col("label").alias("type")), "cell").groupBy(F.col("type").alias("label")).agg(F.avg("agreement").alias("agreed"))
    return trust.trust_ledger(_verified(section), _typable(section), agreed).select("label", "n", "resolvable", "coherent", "agreed", "cause", F.array_join("flags", ",").alias("flags"))


def spillover_removed(section: Section) -> DataFrame:
    markers = section["genes"].filter("NOT control").join(F.broadcast(section.once(PROGRAMS)), "marker_set").select(F.col("label").alias("marker_set"), "gene")
    edges = spatial.neighbours(section["cells"]).select(F.col("src").alias("cell"), F.col("dst").alias("neighbour"))
    return spillover.spillover_removed(section["counts"], section["cells"].select("cell", F.col("label").alias("lineage")), markers, edges)


def method_reliability(section: Section) -> DataFrame:
    return _rounded(trust.reliability(section.once(BALLOT).filter("method <> 'status'"), section["truth"]), reliability=6)


def weighted_vote(section: Section) -> DataFrame:
    ballot = section.once(BALLOT)
    weights = trust.reliability(ballot, section["truth"]).select("method", log_odds(F.col("reliability")).alias("weight"))
    return _rounded(trust.vote(ballot, weights), weight=6, agreement=6)


def reconciled_labels(section: Section) -> DataFrame:
    """The markers' label of each cluster against the marker set of most counts in it, which stands for a proposal."""
    _kept(section)
    counts = section["counts"].join(section["genes"].filter("NOT control").select("gene", "marker_set"), "gene").join(section["cells"].select("cell", F.col("label").alias("cluster")), "cell")
    most = counts.groupBy("cluster", "marker_set").agg(F.sum("value").alias("n")).groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("order"), "marker_set"))["marker_set"].alias("label"))
    markers = section.once(PROGRAMS).select(F.col("label").alias("cluster"), F.col("marker_set").alias("label"))
    cells = section["cells"].select("cell", F.col("label").alias("cluster"))
    return reconcile(cells, markers, section["genes"].select(F.col("marker_set").alias("label")).distinct(), most).clusters


def qc_funnel(section: Section) -> DataFrame:
    """``(layer, name, metric, value)``: what each layer of quality control says of a section, from tables that are made once."""
    _kept(section)
    outliers, pmp = (section.once(STATEMENTS[k]) for k in ("segmentation_outliers", "positive_marker_purity"))
    near = spatial.coherence(section)
    layers = [
        (0, "section", section.once(STATEMENTS["section_qc_summary"])),
        (1, "segmentation", outliers.agg(F.avg(F.col("area_outlier").cast("double")).alias("share_outlier"))),
        (2, "count_floor", section.once(STATEMENTS["count_floor"])),
        (3, "purity", pmp.agg(F.percentile("pmp", F.lit(0.5)).alias("median_pmp"), F.count("pmp").alias("n_judged"))),
        (5, "confidence", trust.verdict_summary(judged(section)).select("share_pass", "share_warn", "share_fail", "mean_confidence")),
        (6, "spatial", near.agg(F.avg("coherence").alias("mean_coherence"), F.avg(F.col("apart").cast("double")).alias("share_apart"))),
    ]
    out = None
    for at, name, df in layers:
        one = df.select(*(F.round(F.col(c).cast("double"), 6).alias(c) for c in df.columns)).unpivot([], df.columns, "metric", "value")
        one = one.select(F.lit(at).alias("layer"), F.lit(name).alias("name"), "metric", "value")
        out = one if out is None else out.union(one)
    return out


QUERIES = {
    "qc_funnel": qc_funnel,
    "reconciled_labels": reconciled_labels,
    "confidence": confidence,
    "verdict_summary": lambda s: _rounded(trust.verdict_summary(judged(s)), share_pass=6, share_warn=6, share_fail=6, mean_confidence=6, share_conflict=6),
    "rejection_breakdown": lambda s: _rounded(trust.rejection_breakdown(reasoned(s)).drop("description"), share=6),
    "confidence_by_type": lambda s: _rounded(trust.confidence_by_type(judged(s)), q25=6, q50=6, q75=6),
    "self_verify": lambda s: _rounded(_verified(s).select("label", "n", "agreement", "own_is_top", "auc", "status"), agreement=6, auc=6),
    "typability": lambda s: _typable(s),
    "trust_ledger": ledger,
    "identifiability": lambda s: _rounded(separation(s), auc=6, cohen_d=5),
    "remediation_plan": lambda s: trust.remediation_plan(_verified(s)),
    "dominant_states": lambda s: _rounded(trust.dominant_state(s.once(SCORES)), z=5),
    "malignant_scores": lambda s: _rounded(trust.malignant_scores(s.once(SCORES).join(s["genes"].agg(F.min("marker_set").alias("marker_set")), "marker_set").select("cell", "score")), malignant_score=5),
    "state_by_type": lambda s: _rounded(trust.state_by_type(s["cells"], s.once(SCORES)), mean=6),
    "method_reliability": method_reliability,
    "weighted_vote": weighted_vote,
    "abstention_curve": lambda s: _rounded(calibrate.abstention_gate(s["judged"]), share=6, accuracy=6, gain=6),
    "classification_scores": lambda s: _rounded(calibrate.classification_scores(s["votes"].select("cell", "label").join(s["truth"].withColumnRenamed("label", "truth"), "cell"), "label", "truth"), accuracy=6, balanced_accuracy=6, macro_f1=6, weighted_f1=6, kappa=6),
    "composition_accuracy": lambda s: _rounded(calibrate.composition_accuracy(s["votes"].select("cell", "label").join(s["truth"].withColumnRenamed("label", "truth"), "cell"), "label", "truth"), l1=6, pearson=6, jsd=6),
    "calibration_report": lambda s: calibrate.calibration_report(s["judged"]),
    "gene_sharing": lambda s: grouping.gene_sharing(s["counts"].join(s["cells"].select("cell", F.col("label").alias("marker_set")), "cell").select("marker_set", "gene")),
    "merge_groups": lambda s: grouping.label_groups(s["vectors"].select("label"), embedding.adjacent_clusters(s["vectors"], 1)),
    "marker_overview": lambda s: grouping.marker_overview(s["counts"].join(s["cells"].select("cell", "label"), "cell").groupBy("label", "gene").agg(F.sum("value").alias("total")), s["cells"].groupBy("label").agg(F.count(F.lit(1)).alias("n"))),
    "cluster_splits": lambda s: _rounded(grouping.split_test(s["vectors"]), bimodality=4),
    "spillover_removed": spillover_removed,
    "section_summaries": lambda s: s.once(METRICS).join(s["cells"].select("cell", F.col("batch").alias("section")), "cell").groupBy("section").agg(F.count(F.lit(1)).alias("n_cells"), F.percentile("n_genes", F.lit(0.5)).alias("median_genes"), F.percentile("total", F.lit(0.5)).alias("median_total")),
    "adjacent_clusters": lambda s: _rounded(embedding.adjacent_clusters(s["vectors"]), d=6),
    "cluster_separation": lambda s: embedding.separation(s["vectors"], embedding.adjacent_clusters(s["vectors"])),
    "principal_axes": lambda s: embedding.principal_axes(s["vectors"], 8),
}

_JUDGED = f"""m AS ({METRICS}), s AS ({SCORES}), st AS (SELECT marker_set, avg(score) AS a, stddev_pop(score) AS d FROM s GROUP BY marker_set),
  h AS (SELECT s.cell, count(CASE WHEN (s.score - st.a) / nullif(st.d, 0) > 1 THEN 1 END) AS n_high FROM s JOIN st ON st.marker_set = s.marker_set GROUP BY s.cell),
  r AS (SELECT cell, marker_set, score, row_number() OVER (PARTITION BY cell ORDER BY score DESC, marker_set) AS place FROM s),
  t AS (SELECT cell, max(CASE WHEN place = 1 THEN marker_set END) AS best, max(CASE WHEN place = 1 THEN score END) - coalesce(max(CASE WHEN place = 2 THEN score END), 0) AS margin FROM r GROUP BY cell),
  sd AS (SELECT stddev_pop(margin) AS sd FROM t), l AS ({STATEMENTS["panel_coverage"]}), v AS (SELECT cell, n * 1.0 / voters AS agreement, voters FROM ({WINNERS}) w WHERE place = 1), p AS (SELECT count(*) AS n_panel FROM {{genes}} WHERE NOT control),
  c AS (SELECT m.cell, m.label, m.total, m.n_genes, m.pct_control, t.best, h.n_high >= 2 AS impure, CASE l.light WHEN 'red' THEN 0 WHEN 'amber' THEN 0.6 ELSE 1 END AS cap, greatest(least(coalesce(m.pct_control, 0) / 5, 1), CASE WHEN h.n_high >= 2 THEN 0.5 ELSE 0 END) AS contam,
    1 / (1 + exp(-t.margin / (sd.sd + 1e-9))) AS posterior, v.agreement, v.voters, m.total < 10 OR m.n_genes < CASE WHEN p.n_panel >= 1000 THEN 15 ELSE 5 END AS low
    FROM m LEFT JOIN t ON t.cell = m.cell LEFT JOIN h ON h.cell = m.cell LEFT JOIN l ON l.marker_set = t.best LEFT JOIN v ON v.cell = m.cell CROSS JOIN sd CROSS JOIN p),
  d AS (SELECT *, coalesce(posterior * (1 - contam) * cap * CASE WHEN voters >= 3 THEN 0.5 + 0.5 * agreement ELSE 1 END, 0) AS confidence FROM c),
  e AS (SELECT *, CASE WHEN low OR confidence < 0.25 THEN 'FAIL' WHEN confidence < 0.5 THEN 'WARN' ELSE 'PASS' END AS verdict FROM d),
  f AS (SELECT *, CASE WHEN low THEN 'low_quality' WHEN verdict <> 'FAIL' THEN '' WHEN cap = 0 THEN 'unresolvable_panel' WHEN contam >= 0.5 THEN 'ambiguous_mixed' ELSE 'uncertain_lowconf' END AS reason FROM e)"""
_FINAL = "CASE WHEN verdict <> 'FAIL' THEN label " + " ".join(f"WHEN reason = '{k}' THEN '{v}'" for k, v in ABSTAIN.items()) + " END"
_OWN = f"""b AS ({PROGRAMS}), s AS ({SCORES}), o AS (SELECT b.label AS type, s.cell, s.score, coalesce(s.label = b.label, false) AS pos FROM s JOIN b ON b.marker_set = s.marker_set),
  w AS (SELECT type, pos, rank() OVER (PARTITION BY type ORDER BY round(score, 6)) + (count(*) OVER (PARTITION BY type, round(score, 6)) - 1) / 2.0 AS r FROM o),
  u AS (SELECT type, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg, sum(r) FILTER (pos) AS rs FROM w GROUP BY type),
  i AS (SELECT type, n_pos, n_neg, (rs - n_pos * (n_pos + 1) / 2.0) / nullif(n_pos * n_neg, 0) AS auc FROM u)"""
_PAIRED = "j AS (SELECT v.label, t.label AS truth FROM {votes} v JOIN {truth} t ON t.cell = v.cell WHERE v.label IS NOT NULL)"


def _unpivot(at: int, name: str, text: str, metrics: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {at} AS layer, '{name}' AS name, '{k}' AS metric, round(({v})::DOUBLE, 6) AS value FROM ({text}) q" for k, v in metrics.items())


def _same(*columns: str) -> dict[str, str]:
    return {c: c for c in columns}


_FUNNEL = " UNION ALL ".join([
    _unpivot(0, "section", STATEMENTS["section_qc_summary"], _same("n_cells", "median_total", "median_genes", "median_control", "share_empty")),
    _unpivot(1, "segmentation", STATEMENTS["segmentation_outliers"], {"share_outlier": "avg(area_outlier::INT)"}),
    _unpivot(2, "count_floor", STATEMENTS["count_floor"], _same("n_panel", "floor", "n_removed")),
    _unpivot(3, "purity", STATEMENTS["positive_marker_purity"], {"median_pmp": "quantile_cont(pmp, 0.5)", "n_judged": "count(pmp)"}),
    _unpivot(5, "confidence", "SELECT * FROM f", {**{f"share_{v.lower()}": f"avg((verdict = '{v}')::INT)" for v in ("PASS", "WARN", "FAIL")}, "mean_confidence": "avg(confidence)"}),
    _unpivot(6, "spatial", spatial.SQL["spatial_coherence"], {"mean_coherence": "avg(coherence)", "share_apart": "avg(apart::INT)"}),
])
#: DuckDB's form; plans that fit a curve, or whose ties hang on a hash, have none.
SQL = {
    "qc_funnel": f"WITH {_JUDGED} {_FUNNEL}",
    "reconciled_labels": f"""WITH p AS ({PROGRAMS}), s AS (SELECT c.label AS cluster, g.marker_set, sum(k.value) AS n FROM {{counts}} k JOIN {{genes}} g ON g.gene = k.gene AND NOT g.control JOIN {{cells}} c ON c.cell = k.cell GROUP BY c.label, g.marker_set),
      m AS (SELECT cluster, marker_set FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, marker_set) AS place FROM s) q WHERE place = 1)
      SELECT p.label AS cluster, p.marker_set AS marker_label, m.marker_set AS proposed, p.marker_set = m.marker_set AS agreement, p.marker_set <> m.marker_set AS conflict, false AS off_vocabulary, p.marker_set AS final FROM p JOIN m ON m.cluster = p.label""",
    "confidence": f"WITH {_JUDGED} SELECT cell, label, best, impure, round(confidence, 6) AS confidence, verdict, reason, {_FINAL} AS final_label FROM f",
    "verdict_summary": f"""WITH {_JUDGED} SELECT count(*) AS n, round(avg(CASE WHEN verdict = 'PASS' THEN 1.0 ELSE 0.0 END), 6) AS share_pass, round(avg(CASE WHEN verdict = 'WARN' THEN 1.0 ELSE 0.0 END), 6) AS share_warn, round(avg(CASE WHEN verdict = 'FAIL' THEN 1.0 ELSE 0.0 END), 6) AS share_fail,
      round(avg(confidence), 6) AS mean_confidence, 0.0::DOUBLE AS share_conflict, CASE WHEN avg(CASE WHEN verdict = 'FAIL' THEN 1.0 ELSE 0.0 END) > 0.5 THEN 'fail' WHEN avg(CASE WHEN verdict = 'FAIL' THEN 1.0 ELSE 0.0 END) > 0.25 THEN 'warn' ELSE 'ok' END AS usability FROM f""",
    "rejection_breakdown": f"""WITH {_JUDGED}, b AS ({PROGRAMS}), x AS (SELECT CASE WHEN f.total < 10 THEN 'too_few_counts' WHEN f.n_genes < 5 THEN 'too_few_genes' WHEN f.impure THEN 'mixed_lineages' WHEN f.pct_control > 5 THEN 'high_background' WHEN l2.light IN ('red', 'amber') THEN 'panel_cannot_resolve'
      WHEN f.agreement < 0.5 AND f.voters >= 3 THEN 'method_disagreement' WHEN f.reason = 'unresolvable_panel' THEN 'panel_cannot_resolve' WHEN f.reason = 'ambiguous_mixed' THEN 'mixed_lineages' ELSE 'low_margin' END AS rejection FROM f LEFT JOIN b ON b.label = f.label LEFT JOIN l l2 ON l2.marker_set = b.marker_set WHERE f.verdict <> 'PASS')
      SELECT rejection, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM x GROUP BY rejection""",
    "confidence_by_type": f"WITH {_JUDGED} SELECT label, count(*) AS n, round(quantile_cont(confidence, 0.25), 6) AS q25, round(quantile_cont(confidence, 0.5), 6) AS q50, round(quantile_cont(confidence, 0.75), 6) AS q75 FROM f GROUP BY label HAVING count(*) >= 10 ORDER BY n DESC, label LIMIT 12",
    "identifiability": f"""WITH {_OWN}, g AS (SELECT type, avg(score) FILTER (pos) AS m1, avg(score) FILTER (NOT pos) AS m0, var_samp(score) FILTER (pos) AS v1, var_samp(score) FILTER (NOT pos) AS v0 FROM o GROUP BY type)
      SELECT i.type, n_pos, n_neg, round(auc, 6) AS auc, round((m1 - m0) / sqrt(((n_pos - 1) * v1 + (n_neg - 1) * v0) / (n_pos + n_neg - 2)), 5) AS cohen_d FROM i JOIN g ON g.type = i.type""",
    "self_verify": f"""WITH {_OWN}, k AS (SELECT cell, label, marker_set AS best FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY score DESC, marker_set) AS place FROM s) q WHERE place = 1),
      a AS (SELECT k.label, count(*) AS n, avg(CASE WHEN k.best = b.marker_set THEN 1.0 ELSE 0.0 END) AS agreement FROM k JOIN b ON b.label = k.label GROUP BY k.label)
      SELECT a.label, a.n, round(a.agreement, 6) AS agreement, true AS own_is_top, round(i.auc, 6) AS auc, CASE WHEN a.n < 20 THEN 'skipped_small' WHEN a.agreement < 0.5 AND i.auc < 0.6 THEN 'fail' ELSE 'ok' END AS status FROM a JOIN i ON i.type = a.label""",
    "typability": f"""WITH {_OWN}, l AS ({STATEMENTS["panel_coverage"]}) SELECT b.label, i.auc >= 0.7 AND n_pos >= 50 AND l.n_present <> 0 AS typable, 'identifiability_auc' AS basis, round(i.auc, 3) AS score, n_pos < 50 AS weak, l.n_present, n_pos AS n FROM b JOIN i ON i.type = b.label JOIN l ON l.marker_set = b.marker_set""",
    "dominant_states": f"""WITH s AS ({SCORES}), z AS (SELECT cell, marker_set, round(coalesce((score - avg(score) OVER w) / nullif(stddev_pop(score) OVER w, 0), 0), 9) AS z FROM s WINDOW w AS (PARTITION BY marker_set)),
      r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY z DESC, marker_set) AS place FROM z) SELECT cell, CASE WHEN z >= 1 THEN marker_set END AS state, round(z, 5) AS z FROM r WHERE place = 1""",
    "malignant_scores": f"""WITH s AS (SELECT * FROM ({SCORES}) a WHERE marker_set = (SELECT min(marker_set) FROM {{genes}})), q AS (SELECT quantile_cont(score, 0.01) AS lo, quantile_cont(score, 0.99) AS hi FROM s),
      x AS (SELECT cell, greatest(least((score - lo) / (hi - lo + 1e-9), 1.0), 0.0) AS m FROM s CROSS JOIN q) SELECT cell, round(m, 5) AS malignant_score, m > 0.6 AS malignant FROM x""",
    "state_by_type": f"SELECT label, marker_set, round(avg(score), 6) AS mean, count(*) AS n FROM ({SCORES}) s GROUP BY label, marker_set",
    "method_reliability": f"SELECT b.method, count(*) AS n, round(avg(CASE WHEN b.label = t.label THEN 1.0 ELSE 0.0 END), 6) AS reliability FROM ({BALLOT}) b JOIN {{truth}} t ON t.cell = b.cell WHERE b.method <> 'status' GROUP BY b.method",
    "weighted_vote": f"""WITH b AS ({BALLOT}), r AS (SELECT b.method, avg(CASE WHEN b.label = t.label THEN 1.0 ELSE 0.0 END) AS p FROM b JOIN {{truth}} t ON t.cell = b.cell GROUP BY b.method),
      w AS (SELECT method, greatest(ln(greatest(least(p, 0.98), 0.02) / (1 - greatest(least(p, 0.98), 0.02))), 0) AS w FROM r),
      y AS (SELECT b.cell, b.label, round(sum(w.w), 12) AS weight, count(*) AS n_votes FROM b JOIN w ON w.method = b.method GROUP BY b.cell, b.label)
      SELECT cell, label, round(weight, 6) AS weight, n_votes, n_methods, round(n_votes / n_methods, 6) AS agreement FROM (SELECT *, sum(n_votes) OVER (PARTITION BY cell)::BIGINT AS n_methods, row_number() OVER (PARTITION BY cell ORDER BY weight DESC, label) AS place FROM y) q WHERE place = 1""",
    "abstention_curve": """SELECT t.threshold, count(*) AS kept, round(count(*) * 1.0e0 / max(a.n), 6) AS share, round(avg(j.correct), 6) AS accuracy, round(avg(j.correct) - max(a.base), 6) AS gain, count(*) * 1.0e0 / max(a.n) >= 0.1e0 AS useful
      FROM {judged} j JOIN (SELECT DISTINCT floor(confidence * 20) / 20.0e0 AS threshold FROM {judged}) t ON j.confidence >= t.threshold CROSS JOIN (SELECT count(*) AS n, avg(correct) AS base FROM {judged}) a GROUP BY t.threshold""",
    "classification_scores": f"""WITH {_PAIRED}, n AS (SELECT count(*)::DOUBLE AS n, sum(CASE WHEN label = truth THEN 1 ELSE 0 END)::DOUBLE AS h FROM j), k AS (SELECT label AS k FROM j UNION SELECT truth FROM j),
      x AS (SELECT k.k, (SELECT count(*) FROM j WHERE label = k.k)::DOUBLE AS p, (SELECT count(*) FROM j WHERE truth = k.k)::DOUBLE AS t, (SELECT count(*) FROM j WHERE truth = k.k AND label = k.k)::DOUBLE AS h FROM k)
      SELECT max(n.n)::BIGINT AS n, round(max(n.h / n.n), 6) AS accuracy, round(avg(CASE WHEN t > 0 THEN x.h / t END), 6) AS balanced_accuracy, round(avg(2 * x.h / (p + t)), 6) AS macro_f1, round(sum(2 * x.h / (p + t) * t) / max(n.n), 6) AS weighted_f1,
      round((max(n.h / n.n) - sum(p * t) / max(n.n * n.n)) / (1 - sum(p * t) / max(n.n * n.n)), 6) AS kappa FROM x CROSS JOIN n""",
    "composition_accuracy": f"""WITH {_PAIRED}, k AS (SELECT label AS k FROM j UNION SELECT truth FROM j), x AS (SELECT (SELECT count(*) FROM j WHERE label = k.k) / (SELECT count(*) FROM j) AS p, (SELECT count(*) FROM j WHERE truth = k.k) / (SELECT count(*) FROM j) AS q FROM k)
      SELECT round(sum(abs(p - q)), 6) AS l1, round(corr(p, q), 6) AS pearson, round(sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2), 6) AS jsd FROM x""",
    "gene_sharing": "WITH m AS (SELECT DISTINCT c.label AS marker_set, k.gene FROM {counts} k JOIN {cells} c ON c.cell = k.cell WHERE c.label IS NOT NULL), n AS (SELECT gene, count(*) AS n_sets FROM m GROUP BY gene) SELECT m.marker_set, m.gene, n.n_sets, n.n_sets = 1 AS private FROM m JOIN n ON n.gene = m.gene",
    "merge_groups": """WITH x AS (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM {vectors}), c AS (SELECT label, dim, avg(v) AS m FROM x GROUP BY label, dim),
      d AS (SELECT a.label, b.label AS other, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM c a JOIN c b ON a.dim = b.dim AND a.label <> b.label GROUP BY a.label, b.label),
      n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(d, 9), other) AS place FROM d), e AS (SELECT label, other FROM n WHERE place = 1 UNION SELECT other, label FROM n WHERE place = 1),
      p AS (SELECT DISTINCT a.label, b.other AS reached FROM e a JOIN e b ON a.label = b.label OR a.other = b.label), q AS (SELECT label, reached FROM p UNION SELECT label, label FROM c),
      q2 AS (SELECT DISTINCT a.label, b.reached FROM q a JOIN q b ON a.reached = b.label), q3 AS (SELECT DISTINCT a.label, b.reached FROM q2 a JOIN q2 b ON a.reached = b.label), q4 AS (SELECT DISTINCT a.label, b.reached FROM q3 a JOIN q3 b ON a.reached = b.label)
      SELECT label, min(reached) AS root FROM q4 GROUP BY label""",
    "spillover_removed": f"""WITH b AS ({PROGRAMS}), m AS (SELECT DISTINCT b.label AS own, g.gene FROM {{genes}} g JOIN b ON b.marker_set = g.marker_set WHERE NOT g.control), p AS (SELECT gene, min(own) AS own FROM m GROUP BY gene HAVING count(*) = 1),
      e AS ({spatial.SQL["neighbour_graph"]}), r AS (SELECT DISTINCT e.src AS cell, c.label AS near FROM e JOIN {{cells}} c ON c.cell = e.dst)
      SELECT k.cell, k.gene, k.value, CASE WHEN r.cell IS NOT NULL AND p.own <> c.label THEN 0 ELSE k.value END AS corrected FROM {{counts}} k JOIN {{cells}} c ON c.cell = k.cell LEFT JOIN p ON p.gene = k.gene LEFT JOIN r ON r.cell = k.cell AND r.near = p.own""",
    "section_summaries": f"SELECT c.batch AS section, count(*) AS n_cells, median(m.n_genes) AS median_genes, median(m.total)::DOUBLE AS median_total FROM ({METRICS}) m JOIN {{cells}} c ON c.cell = m.cell GROUP BY c.batch",
    "adjacent_clusters": """WITH x AS (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM {vectors}), c AS (SELECT label, dim, avg(v) AS m FROM x GROUP BY label, dim),
      d AS (SELECT a.label, b.label AS other, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM c a JOIN c b ON a.dim = b.dim AND a.label <> b.label GROUP BY a.label, b.label),
      n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(d, 9), other) AS place FROM d) SELECT least(label, other) AS a, greatest(label, other) AS b, round(min(d), 6) AS d FROM n WHERE place <= 3 GROUP BY 1, 2""",
}
