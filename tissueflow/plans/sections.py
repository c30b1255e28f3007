"""Registered queries of many sections at once (a section is a nation's customers), of selection and of report tables, with SQL
written for themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissueflow.durable import saved
from tissueflow.operators import layers, report, sections, selection, signal, spatial, trust
from tissueflow.operators.labels import ABSTAIN
from tissueflow.operators.statements import BALLOT, RANKING, SCORES, STATEMENTS
from tissueflow.plans import references, trusted
from tissueflow.plans.trusted import _JUDGED, _OWN, _rounded
from tissueflow.sources.section import Section

CRITERIA = ("machinery", "malignant", "abstained", "low confidence", "low quality", "mobile", "no such thing")
NAMES = ("Total counts", "genes", "confidence", "17", "no such gene")


def _run(s: Section) -> sections.Run:
    s.keep("counts", "cells")
    at = s["cells"].select("cell", F.col("batch").alias("section"))
    return sections.run(s["counts"].join(at, "cell"), at, s["genes"])


def _judged(s: Section) -> DataFrame:
    lineage = s["genes"].agg(F.min("marker_set").alias("marker_set"))
    malignant = trust.malignant_scores(s.once(SCORES).join(lineage, "marker_set").select("cell", "score")).select("cell", "malignant_score")
    return saved(trusted.judged(s).select("cell", "label", "total", "n_genes", "confidence", "verdict", "reason").join(malignant, "cell", "left"))


def selected_cells(s: Section) -> DataFrame:
    cells = _judged(s)
    return reduce(DataFrame.union, (selection.select_cells(cells, c).select(F.lit(c).alias("criterion"), "cell", "rule") for c in CRITERIA))


def projected_fields(s: Section) -> DataFrame:
    cells = _judged(s)
    panel = s["genes"].filter("NOT control").select("gene")
    parts = (selection.project(cells, s["counts"], panel, n).select(F.lit(n).alias("name"), "cell", "field", F.round("value", 5).alias("value")) for n in NAMES)
    return reduce(DataFrame.union, parts)


def section_report(s: Section) -> DataFrame:
    cells = saved(trusted.judged(s))
    votes = trust.vote(s.once(BALLOT))
    auc = trusted.separation(s)
    return report.report(
        report.block("section", s.once(STATEMENTS["section_qc_summary"])),
        report.block("composition", report.composition_head(s["cells"]), "label"),
        report.block("panel", report.panel_report(s.once(STATEMENTS["panel_coverage"]), auc, trusted._typable(s))),
        report.block("methods", report.method_coverage(s.once(BALLOT), s["cells"]), "method"),
        report.block("consensus", report.consensus_summary(votes)),
        report.block("confidence", trust.verdict_summary(cells).select("share_pass", "share_warn", "share_fail", "mean_confidence")),
    )


def _layers(s: Section) -> DataFrame:
    trusted._kept(s)
    return saved(trusted.spillover_removed(s).select("cell", "gene", F.col("value").alias("before"), F.col("corrected").alias("after")))


def layer_quality(s: Section) -> DataFrame:
    compared = _layers(s)
    markers = s["genes"].filter("NOT control").join(s.once(trusted.PROGRAMS), "marker_set").select("label", "gene")
    return _rounded(layers.layer_quality(compared, s["cells"].select("cell", "label"), markers), specificity_before=6, specificity_after=6, purity_before=6, purity_after=6, retention=6)


def malignant_concordance(s: Section) -> DataFrame:
    lineage = s["genes"].agg(F.min("marker_set").alias("marker_set"))
    by_score = trust.malignant_scores(s.once(SCORES).join(lineage, "marker_set").select("cell", "score")).select("cell", F.lit("marker score").alias("caller"), "malignant")
    by_burden = references.copy_number(s).select("cell", F.lit("copy number").alias("caller"), F.when(F.col("burden").isNotNull(), F.col("malignant")).alias("malignant"))
    return _rounded(layers.caller_concordance(saved(by_score.union(by_burden))), concordance=6)


def merged_markers(s: Section) -> DataFrame:
    """Small parts of each brand as its curated list, the ranked genes of the labels that look like it as the corpus."""
    panel = s["genes"].filter("NOT control")
    ranked = s.once(RANKING).join(s.once(trusted.PROGRAMS).select("label", "marker_set"), "label")
    curated = panel.filter("position <= 10").select(F.col("marker_set").alias("type"), "gene", "position").withColumnRenamed("position", "place")
    return layers.merged_markers(curated, ranked.select(F.col("marker_set").alias("type"), "gene", "place"), panel.select(F.col("marker_set").alias("type")))


def _signal(s: Section) -> DataFrame:
    return signal.cell_signal(s["counts"], s["cells"].select("cell", F.col("y").alias("area")), s["genes"])


QUERIES = {
    "cell_signal": lambda s: _rounded(_signal(s), mean_ratio=6, max_ratio=6, sparsity=6, entropy=6, density=6),
    "signal_summary": lambda s: _rounded(signal.signal_summary(_signal(s)), zero_fraction=6, median_mean_ratio=5, median_max_ratio=5, median_entropy=5, median_density=5),
    "spatial_signal": lambda s: _rounded(signal.spatial_signal(spatial.spatial_genes(s), s["genes"]), median_gene=5, median_control=5, separation=5, share_above=5),
    "layer_quality": layer_quality,
    "layer_change": lambda s: _rounded(layers.layer_change(_layers(s)), median_total_after=6),
    "malignant_concordance": malignant_concordance,
    "merged_markers": merged_markers,
    "sections_cells": lambda s: _rounded(_run(s).cells.select("section", "cell", "total", "n_genes", "kept", "label", "confidence", "verdict", "final_label"), confidence=5),
    "sections_stages": lambda s: _run(s).stages,
    "sections_composition": lambda s: _rounded(_run(s).composition(), share=6, mean_confidence=5),
    "selected_cells": selected_cells,
    "projected_fields": projected_fields,
    "section_report": section_report,
}

_RUN = f"""ce AS (SELECT cell, batch AS section FROM {{cells}}), gn AS (SELECT gene, marker_set, control FROM {{genes}}), k AS (SELECT ce.section, c.cell, c.gene, c.value, gn.control, gn.marker_set FROM {{counts}} c JOIN ce ON ce.cell = c.cell JOIN gn ON gn.gene = c.gene),
  mt AS (SELECT ce.section, ce.cell, coalesce(sum(k.value) FILTER (NOT k.control), 0)::DOUBLE AS total, count(k.gene) FILTER (NOT k.control AND k.value > 0) AS n_genes, 100 * coalesce(sum(k.value) FILTER (k.control), 0) / sum(k.value) AS pc FROM ce LEFT JOIN k ON k.cell = ce.cell GROUP BY ce.section, ce.cell),
  mk AS (SELECT *, total >= 10 AND n_genes >= 5 AND coalesce(pc, 0) <= 5 AS kept FROM mt), tg AS (SELECT section, quantile_cont(total, 0.5) AS target FROM mk WHERE kept GROUP BY section),
  sz AS (SELECT marker_set, count(*) AS size FROM gn WHERE NOT control GROUP BY marker_set),
  sc AS (SELECT k.section, k.cell, k.marker_set, round(sum(ln(1 + k.value * tg.target / mk.total)) / max(sz.size), 9) AS score FROM k JOIN mk ON mk.cell = k.cell AND mk.kept JOIN tg ON tg.section = k.section JOIN sz ON sz.marker_set = k.marker_set WHERE NOT k.control GROUP BY k.section, k.cell, k.marker_set),
  pl AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY score DESC, marker_set) AS place FROM sc WHERE score > 0),
  bt AS (SELECT section, cell, max(marker_set) FILTER (place = 1) AS label, max(score) FILTER (place = 1) - coalesce(max(score) FILTER (place = 2), 0) AS margin FROM pl GROUP BY section, cell), sp AS (SELECT section, stddev_pop(margin) AS sd FROM bt GROUP BY section),
  cf AS (SELECT mk.*, bt.label, CASE WHEN kept THEN coalesce(1 / (1 + exp(-margin / (sd + 1e-9))) * (1 - least(coalesce(pc, 0) / 5, 1)), 0) END AS confidence FROM mk LEFT JOIN bt ON bt.cell = mk.cell LEFT JOIN sp ON sp.section = mk.section),
  vd AS (SELECT *, CASE WHEN NOT kept OR confidence < 0.25 THEN 'FAIL' WHEN confidence < 0.5 THEN 'WARN' ELSE 'PASS' END AS verdict FROM cf),
  rn AS (SELECT *, CASE WHEN verdict <> 'FAIL' THEN label WHEN kept THEN '{ABSTAIN["uncertain_lowconf"]}' ELSE '{ABSTAIN["low_quality"]}' END AS final_label FROM vd)"""
_STATUS = "CASE WHEN n_in = 0 THEN 'skipped' WHEN n_out = 0 THEN 'empty' ELSE 'ok' END AS status"
_CELLS = f"""{_JUDGED}, ms AS ({trusted.SQL["malignant_scores"].replace("round(m, 5)", "m")}), jc AS (SELECT f.cell, f.label, f.total, f.n_genes, f.confidence, f.verdict, f.reason, ms.malignant_score FROM f LEFT JOIN ms ON ms.cell = f.cell),
  lw AS (SELECT count(*) FILTER (total < 10 OR reason = 'low_quality') AS n, quantile_cont(total::DOUBLE, 0.1) AS q FROM jc)"""
_PANEL = f"""{_OWN}, lt AS ({STATEMENTS["panel_coverage"]}), pr AS (SELECT i.auc, i.auc >= 0.7 AND i.n_pos >= 50 AND lt.n_present <> 0 AS typable, i.n_pos < 50 AS weak FROM b JOIN i ON i.type = b.label JOIN lt ON lt.marker_set = b.marker_set)"""


def _block(name: str, frm: str, metrics: dict[str, str], item: str = "''") -> str:
    """Rows of a block in DuckDB: one select a metric."""
    return " UNION ALL ".join(f"SELECT '{name}' AS block, {item} AS item, '{k}' AS metric, round(({v})::DOUBLE, 6) AS value FROM {frm}" for k, v in metrics.items())


_VOTED = f"(SELECT method, count(DISTINCT cell) AS n FROM ({BALLOT}) b WHERE label IS NOT NULL GROUP BY method) q"
_REPORT = " UNION ALL ".join([
    _block("section", f"({STATEMENTS['section_qc_summary']}) q", {k: k for k in ("n_cells", "median_total", "median_genes", "median_control", "share_empty")}),
    _block("composition", "(SELECT label, count(*) AS n FROM {cells} WHERE label IS NOT NULL GROUP BY label ORDER BY n DESC, label LIMIT 12) q", {"n": "n"}, "label"),
    _block("panel", "lt", {"n_sets": "count(*)", **{f"n_{c}": f"count(*) FILTER (light = '{c}')" for c in ("green", "amber", "red")}, "mean_fraction": "avg(fraction)"}),
    _block("panel", "pr", {"mean_auc": "avg(auc)", "n_typable": "count(*) FILTER (typable AND NOT weak)", "n_typable_weak": "count(*) FILTER (typable AND weak)", "n_not_typable": "count(*) FILTER (NOT typable)"}),
    _block("methods", _VOTED, {"n_voted": "n", "coverage": "n / (SELECT count(*) FROM {cells})"}, "method"),
    _block("consensus", "v", {"n_cells": "count(*)", "mean_agreement": "avg(agreement)", "share_trusted": "avg((voters >= 3)::INT)"}),
    _block("confidence", "f", {**{f"share_{v.lower()}": f"avg((verdict = '{v}')::INT)" for v in ("PASS", "WARN", "FAIL")}, "mean_confidence": "avg(confidence)"}),
])
_LAYERS = f"ly AS (SELECT cell, gene, value::DOUBLE AS x0, corrected::DOUBLE AS x1 FROM ({trusted.SQL['spillover_removed']}) q)"
_CNV = references.SQL["copy_number"]
_SIGNAL = """sz AS (SELECT count(*) FILTER (NOT control) AS np, count(*) FILTER (control) AS nc FROM {genes}), k AS (SELECT c.cell, c.value::DOUBLE AS x, g.control FROM {counts} c JOIN {genes} g ON g.gene = c.gene WHERE c.value > 0),
  a AS (SELECT cell, sum(x) FILTER (NOT control) AS t, max(x) FILTER (NOT control) AS top, count(*) FILTER (NOT control) AS n, sum(x) FILTER (control) AS c FROM k GROUP BY cell),
  en AS (SELECT k.cell, -sum(x / a.t * ln(x / a.t)) AS h FROM k JOIN a ON a.cell = k.cell WHERE NOT k.control GROUP BY k.cell),
  sg AS (SELECT d.cell, log2((coalesce(a.t, 0) / sz.np + 0.01) / (coalesce(a.c, 0) / nullif(sz.nc, 0) + 0.01)) AS mean_ratio, log2((coalesce(a.top, 0) + 0.01) / (coalesce(a.c, 0) / nullif(sz.nc, 0) + 0.01)) AS max_ratio,
    1 - coalesce(a.n, 0) / sz.np AS sparsity, CASE WHEN a.n = 1 THEN 0 WHEN a.n > 1 THEN en.h / ln(a.n) END AS entropy, CASE WHEN d.y > 0 THEN coalesce(a.t, 0) / d.y END AS density FROM {cells} d CROSS JOIN sz LEFT JOIN a ON a.cell = d.cell LEFT JOIN en ON en.cell = d.cell)"""
SQL = {
    "cell_signal": f"WITH {_SIGNAL} SELECT cell, round(mean_ratio, 6) AS mean_ratio, round(max_ratio, 6) AS max_ratio, round(sparsity, 6) AS sparsity, round(entropy, 6) AS entropy, round(density, 6) AS density FROM sg",
    "signal_summary": f"WITH {_SIGNAL} SELECT count(*) AS n_cells, round(avg(sparsity), 6) AS zero_fraction, " + ", ".join(f"round(quantile_cont({c}, 0.5), 5) AS median_{c}" for c in ("mean_ratio", "max_ratio", "entropy", "density")) + " FROM sg",
    "spatial_signal": f"""WITH mo AS (SELECT m.moran, g.control FROM ({spatial.SQL["spatial_genes"]}) m JOIN {{genes}} g ON g.gene = m.gene WHERE m.moran IS NOT NULL AND NOT isnan(m.moran)), q AS (SELECT quantile_cont(moran, 0.95) FILTER (control) AS lim FROM mo)
      SELECT count(*) FILTER (NOT control) AS n_genes, count(*) FILTER (control) AS n_controls, round(quantile_cont(moran, 0.5) FILTER (NOT control), 5) AS median_gene, round(quantile_cont(moran, 0.5) FILTER (control), 5) AS median_control,
      round(avg((moran > q.lim)::INT) FILTER (NOT control), 5) AS share_above, round(quantile_cont(moran, 0.5) FILTER (NOT control) - quantile_cont(moran, 0.5) FILTER (control), 5) AS separation FROM mo CROSS JOIN q""",
    "layer_quality": f"""WITH {_LAYERS}, mr AS (SELECT p.label AS lin, g.gene FROM {{genes}} g JOIN ({trusted.PROGRAMS}) p ON p.marker_set = g.marker_set WHERE NOT g.control AND g.gene IN (SELECT gene FROM ly)),
      z AS (SELECT ly.*, c.label, ln(1 + 1e4 * x0 / nullif(sum(x0) OVER (PARTITION BY ly.cell), 0)) AS v0, ln(1 + 1e4 * x1 / nullif(sum(x1) OVER (PARTITION BY ly.cell), 0)) AS v1, sum(x0) OVER (PARTITION BY ly.cell) AS t0, sum(x1) OVER (PARTITION BY ly.cell) AS t1 FROM ly JOIN {{cells}} c ON c.cell = ly.cell),
      n AS (SELECT label, count(*) AS n, sum(count(*)) OVER () - count(*) AS m FROM {{cells}} GROUP BY label),
      u AS (SELECT mr.lin, sum(v0) FILTER (z.label = lin) / max(n.n) AS a0, sum(v1) FILTER (z.label = lin) / max(n.n) AS a1, sum(v0) FILTER (z.label <> lin) / max(n.m) AS b0, sum(v1) FILTER (z.label <> lin) / max(n.m) AS b1 FROM z JOIN mr ON mr.gene = z.gene JOIN n ON n.label = mr.lin GROUP BY mr.lin),
      o AS (SELECT z.cell, z.label, sum(x0) AS r0, sum(x1) AS r1, max(t0) AS t0, max(t1) AS t1 FROM z JOIN mr ON mr.gene = z.gene AND mr.lin = z.label GROUP BY z.cell, z.label),
      w AS (SELECT label, sum(coalesce(r0 / nullif(t0, 0), 0)) AS p0, sum(coalesce(r1 / nullif(t1, 0), 0)) AS p1, avg(least(r1 / r0, 1)) FILTER (r0 > 0) AS ret FROM o GROUP BY label)
      SELECT n.label, n.n, round(a0 / (a0 + b0 + 1e-12), 6) AS specificity_before, round(a1 / (a1 + b1 + 1e-12), 6) AS specificity_after, round(coalesce(p0, 0) / n.n, 6) AS purity_before, round(coalesce(p1, 0) / n.n, 6) AS purity_after, round(ret, 6) AS retention FROM n LEFT JOIN u ON u.lin = n.label LEFT JOIN w ON w.label = n.label""",
    "layer_change": f"""WITH {_LAYERS}, pc AS (SELECT cell, sum(x0) AS t0, sum(x1) AS t1, count(*) FILTER (x0 > 0) AS g0, count(*) FILTER (x1 > 0) AS g1 FROM ly GROUP BY cell)
      SELECT quantile_cont(t0, 0.5) AS median_total_before, round(quantile_cont(t1, 0.5), 6) AS median_total_after, quantile_cont(g0::DOUBLE, 0.5) AS median_genes_before, quantile_cont(g1::DOUBLE, 0.5) AS median_genes_after FROM pc""",
    "malignant_concordance": f"""WITH ms AS ({trusted.SQL["malignant_scores"]}), cn AS ({_CNV}) SELECT 'copy number' AS a, 'marker score' AS b, count(*) AS n_joint, round(avg((cn.malignant = ms.malignant)::INT), 6) AS concordance FROM cn JOIN ms ON ms.cell = cn.cell WHERE cn.burden IS NOT NULL""",
    "merged_markers": f"""WITH pg AS ({trusted.PROGRAMS}), x AS (SELECT marker_set AS type, gene::VARCHAR AS gene, position AS p, 0 AS i FROM {{genes}} WHERE NOT control AND position <= 10 UNION ALL SELECT pg.marker_set, r.gene::VARCHAR, r.place, 1 FROM ({RANKING}) r JOIN pg ON pg.label = r.label),
      y AS (SELECT *, row_number() OVER (PARTITION BY type, gene ORDER BY i, p) AS k FROM x) SELECT type, gene, row_number() OVER (PARTITION BY type ORDER BY i, p, gene) AS place, CASE i WHEN 0 THEN 'curated' ELSE 'corpus' END AS source FROM y WHERE k = 1""",
    "sections_cells": f"WITH {_RUN} SELECT section, cell, total, n_genes, kept, label, round(confidence, 5) AS confidence, verdict, final_label FROM rn",
    "sections_stages": f"""WITH {_RUN}, n AS (SELECT section, count(*) AS a, count(*) FILTER (kept) AS b, count(*) FILTER (kept AND label IS NOT NULL) AS c, count(*) FILTER (verdict = 'PASS') AS d FROM rn GROUP BY section),
      st AS (SELECT section, 'load' AS stage, a AS n_in, a AS n_out FROM n UNION ALL SELECT section, 'quality', a, b FROM n UNION ALL SELECT section, 'annotate', b, c FROM n UNION ALL SELECT section, 'trust', c, d FROM n) SELECT section, stage, {_STATUS}, n_in, n_out FROM st""",
    "sections_composition": f"WITH {_RUN} SELECT section, final_label AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY section), 6) AS share, round(avg(confidence), 5) AS mean_confidence FROM rn WHERE kept GROUP BY section, final_label",
    "selected_cells": f"""WITH {_CELLS} SELECT 'machinery' AS criterion, cell, label AS rule FROM jc WHERE label = 'MACHINERY' UNION ALL SELECT 'malignant', cell, 'malignant' FROM jc WHERE malignant_score > 0.6
      UNION ALL SELECT 'abstained', cell, 'abstained' FROM jc WHERE verdict = 'FAIL' UNION ALL SELECT 'low confidence', cell, 'low confidence' FROM jc WHERE verdict <> 'PASS'
      UNION ALL SELECT 'low quality', cell, CASE WHEN lw.n > 0 THEN 'low quality' ELSE 'lowest decile' END FROM jc CROSS JOIN lw WHERE CASE WHEN lw.n > 0 THEN total < 10 OR reason = 'low_quality' ELSE total <= lw.q END
      UNION ALL SELECT 'mobile', cell, label FROM jc WHERE label = 'AUTOMOBILE'""",
    "projected_fields": f"""WITH {_CELLS} SELECT 'Total counts' AS name, cell, 'total' AS field, total::DOUBLE AS value FROM jc UNION ALL SELECT 'genes', cell, 'n_genes', n_genes::DOUBLE FROM jc UNION ALL SELECT 'confidence', cell, 'confidence', round(confidence, 5) FROM jc
      UNION ALL SELECT '17', jc.cell, g.gene::VARCHAR, coalesce(k.value, 0)::DOUBLE FROM jc JOIN (SELECT gene FROM {{genes}} WHERE gene = 17 AND NOT control) g ON true LEFT JOIN {{counts}} k ON k.cell = jc.cell AND k.gene = g.gene
      UNION ALL SELECT 'no such gene', cell, NULL, NULL FROM jc""",
    "section_report": f"WITH {_JUDGED}, {_PANEL.replace('s AS (' + SCORES + '),', '', 1)} {_REPORT}",
}
