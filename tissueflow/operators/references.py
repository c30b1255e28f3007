"""Choice of a reference: ranking by tissue words, vocabulary of tissues, cells to take, markers of an ontology's corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissueflow.operators.labels import _any, assay_rank

# Words of assays that measure in place, and limits of the marker corpus.
SPATIAL_ASSAYS = ("slide-seq", "visium", "merfish", "xenium", "cosmx", "curio", "spatial")
LEAST_SHARE, LEAST_SPECIFICITY, TOP_MARKERS = 0.10, 0.5, 20


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def rank_references(tissue: str, references: DataFrame, top: int = 3) -> DataFrame:
    """The best of ``references(key, keywords array, available, gene_overlap)`` for a free text: ``keyword_score`` is the
    best likeness of a token to the key or a keyword (1 where one of at least three letters holds the other, else one
    less their edit distance over the longer length), ``match_coverage`` the tokens of likeness 0.8 or more. Order: score,
    coverage, overlap (null last), key."""
    word = F.explode(F.array_union(F.array(F.lower("key")), F.transform(F.coalesce("keywords", F.array().cast("array<string>")), F.lower))).alias("word")
    asked = F.explode(_tokens(F.lit(tissue))).alias("token")
    pairs = references.select("key", word).filter("word <> ''").select("key", "word", asked)
    within = (F.length("token") >= 3) & (F.length("word") >= 3) & (F.col("word").contains(F.col("token")) | F.col("token").contains(F.col("word")))
    alike = F.when(within, 1.0).otherwise(1 - F.levenshtein("token", "word") / F.greatest(F.length("token"), F.length("word")))
    best = pairs.groupBy("key", "token").agg(F.max(alike).alias("best"))
    scores = best.groupBy("key").agg(F.round(F.max("best"), 3).alias("keyword_score"), F.count_if(F.col("best") >= 0.8).alias("match_coverage"))
    out = references.join(scores, "key", "left").fillna({"keyword_score": 0.0, "match_coverage": 0})
    return out.orderBy(F.desc("keyword_score"), F.desc("match_coverage"), F.desc_nulls_last("gene_overlap"), "key").limit(top)


def auto_reference(ranked: DataFrame, least: float = 0.34) -> DataFrame:
    """The first available reference of :func:`rank_references` that covers a token and scores enough; else no row."""
    fit = ranked.filter((F.col("available")) & (F.col("match_coverage") >= 1) & (F.col("keyword_score") >= least))
    return fit.orderBy(F.desc("keyword_score"), F.desc("match_coverage"), F.desc_nulls_last("gene_overlap"), "key").limit(1)


def tissue_label(asked: DataFrame, available: DataFrame) -> DataFrame:
    """``asked(tissue)``, distinct, with ``label`` of ``available(label)``: the same text but for case; else the longest that
    holds it or is held by it; else the one of most common words, the longer first; else null. Ties: the smaller label."""
    q, a = F.lower(F.trim("tissue")), F.lower("label")
    names = available.filter("trim(label) <> ''").select("label").distinct()
    common = F.size(F.array_intersect(_tokens(F.col("tissue")), _tokens(F.col("label"))))
    level = F.when(q == a, 1).when(q.contains(a) | a.contains(q), 2).when(common > 0, 3)
    texts = asked.select("tissue").distinct()
    met = texts.filter("trim(tissue) <> ''").join(F.broadcast(names), level.isNotNull()).withColumn("level", level)
    order = F.struct("level", F.when(F.col("level") == 3, -common).otherwise(0).alias("common"), (-F.length("label")).alias("length"), "label")
    best = met.groupBy("tissue").agg(F.min(order).alias("b")).select("tissue", F.col("b.label").alias("label"))
    return texts.join(best, "tissue", "left")


def reference_cells(cells: DataFrame, target: int = 40_000, least: int = 25, label: str = "label", assay: str = "assay", tie: Column | None = None, key: str = "cell") -> DataFrame:
    """About ``target`` of ``cells``: those measured in place go, unless all are; of each label the cells of newest assays,
    at most max(``least``, target / labels); then more of the newest until ``target`` are taken. Ties by ``tie``, else by a hash of ``key``.

    Only the labels' shares are ordered by label; the rest is cut by its rank before it is sorted as a whole, and the
    number of its cells is at most ``target``.
    """
    place, rank = _any(F.lower(F.coalesce(assay, F.lit(""))), SPATIAL_ASSAYS), assay_rank(F.col(assay))
    counted = cells.withColumn("__place", place).withColumn("__rank", rank).withColumn("__tie", F.xxhash64(key) if tie is None else tie)
    whole = counted.agg(F.count_if(~F.col("__place")).alias("free"), F.count_distinct(F.when(~F.col("__place"), F.coalesce(F.col(label).cast("string"), F.lit("")))).alias("k"), F.count_distinct(F.coalesce(F.col(label).cast("string"), F.lit(""))).alias("k_all")).first()
    kept = counted.filter(~F.col("__place")) if whole["free"] else counted
    share = max(least, target // max(1, whole["k"] or whole["k_all"]))
    order = (F.desc("__rank"), F.col("__tie"), F.col(key))
    ranked = kept.withColumn("__at", F.row_number().over(Window.partitionBy(label).orderBy(*order)))
    picked = ranked.filter(F.col("__at") <= share)
    need = target - picked.count()
    out = picked if need <= 0 else picked.union(ranked.filter(F.col("__at") > share).orderBy(*order).limit(need))
    return out.select(*cells.columns)


def ontology_ids(labels: DataFrame, terms: DataFrame) -> DataFrame:
    """``labels(label)``, distinct, with ``term`` of ``terms(term, name, kind)``, kind name, synonym or alias: the same text
    but for case and signs, names before synonyms before aliases, as it stands before with " cell" added; never nearly."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9+]+", " "))
    known = terms.select("term", plain(F.col("name")).alias("key"), F.when(F.col("kind") == "name", 0).when(F.col("kind") == "synonym", 1).otherwise(2).alias("rank")).filter("key <> ''")
    asked = labels.select("label").distinct()
    forms = asked.select("label", F.posexplode(F.array(plain(F.col("label")), F.concat(plain(F.col("label")), F.lit(" cell")))).alias("form", "key"))
    best = forms.join(known, "key").groupBy("label").agg(F.min(F.struct("form", "rank", "term")).alias("b"))
    return asked.join(best, "label", "left").select("label", F.col("b.term").alias("term"))


def computed_markers(records: DataFrame, top: int = TOP_MARKERS) -> DataFrame:
    """``(term, organism, symbol, score, place)`` of ``records(term, organism, tissue, symbol, pc, specificity, score)``: rows of
    no one tissue, expressed and specific enough, the best one of a symbol, the ``top`` of a term and organism."""
    fit = records.filter((F.col("tissue").isNull()) & (F.col("pc") >= LEAST_SHARE) & (F.col("specificity") >= LEAST_SPECIFICITY) & (F.col("score") > 0) & (F.col("symbol") != ""))
    best = fit.groupBy("term", F.coalesce("organism", F.lit("?")).alias("organism"), "symbol").agg(F.round(F.max("score"), 4).alias("score"))
    at = F.row_number().over(Window.partitionBy("term", "organism").orderBy(F.desc("score"), "symbol"))
    return best.withColumn("place", at).filter(F.col("place") <= top)


def corpus_markers(canonical: DataFrame, computed: DataFrame, organism: str, n: int = 12, least: int = 3, human: str = "Homo sapiens") -> DataFrame:
    """``(term, symbol, place, basis)``: for a human section the canonical symbols of ``canonical(term, symbol, citations)`` where a term
    has at least ``least``, by computed score (none last) and citations; else the computed ones of the organism."""
    scored = computed.filter(F.col("organism") == organism).select("term", "symbol", "score")
    c = canonical.filter("symbol <> ''").groupBy("term", "symbol").agg(F.max("citations").alias("citations")).filter(F.lit(organism == human))
    c = c.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("term"))).filter(F.col("__n") >= least).drop("__n").join(scored, ["term", "symbol"], "left").withColumn("basis", F.lit("canonical"))
    rest = scored.join(c.select("term").distinct(), "term", "left_anti").select("term", "symbol", F.lit(None).cast("long").alias("citations"), "score", F.lit("computed").alias("basis"))
    order = Window.partitionBy("term").orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("citations"), "symbol")
    return c.select("term", "symbol", F.col("citations").cast("long").alias("citations"), "score", "basis").union(rest).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select("term", "symbol", "place", "basis")
