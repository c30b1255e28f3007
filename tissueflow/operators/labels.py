"""Predicates and projections over features, labels and free text: control masks, marker resolution, abstentions,
tolerant matching, keyword groups. Each function takes frames or columns and its limits as arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Feature types and name patterns of signals and controls.
SIGNAL_TYPES = ("Gene Expression", "Protein Expression")
NEGATIVE_TYPES = ("Negative Control Probe", "Negative Control Codeword", "Genomic Control", "Blank Codeword")
CONTROL_NAMES = ("NegControlProbe", "NegControlCodeword", "UnassignedCodeword", "DeprecatedCodeword", "Genomic", "GenomicControl", "IntergenicRegion", "antisense", "BLANK", "Blank", "Negative", "NegPrb", "SystemControl", "FalseCode")
NEGATIVE_NAMES = ("NegControlProbe", "NegControlCodeword", "Genomic", "GenomicControl", "BLANK", "Blank", "Negative", "NegPrb", "SystemControl", "FalseCode")
# Labels that say that a cell has no type, by reason, and the category they collapse into.
ABSTAIN = {
    "low_quality": "Unassigned: low quality",
    "ambiguous_mixed": "Ambiguous: mixed",
    "unresolvable_panel": "Unresolvable: panel",
    "uncertain_lowconf": "Uncertain: low confidence",
    "label_conflict": "Ambiguous: label conflict",
    "novel": "Novel / unknown",
}
NOT_ASSIGNED = "Not assigned"
ABSTENTIONS = (*ABSTAIN.values(), "Unassigned", "Unknown", NOT_ASSIGNED)
# Beginnings of words by which a type's name falls into a category, in order of precedence.
CATEGORY_WORDS = {
    "T/NK lymphoid": ["t cell", "t-cell", "cd4", "cd8", "treg", "tcm", "trm", "nk", "nkt", "ilc", "lymphoid", "cytotox", "exhaust", "gd t", "gamma"],
    "B/plasma": ["b cell", "b-cell", "b/plasma", "plasma", "mzb", "germinal", "bcell"],
    "Myeloid": ["myeloid", "macrophage", "mono", "dendritic", " dc", "dc ", "tam", "microglia", "mast", "neutrophil", "granulocyte", "kupffer", "osteoclast", "langerhans"],
    "Epithelial/tumour": ["epithel", "tumor", "tumour", "malignant", "melanocyte", "melanoma", "carcinoma", "luminal", "basal", "keratinocyte", "ductal", "acinar", "hepatocyte", "alveolar", "club", "goblet", "secretory"],
    "Stromal": ["stroma", "caf", "fibroblast", "myofibro", "pericyte", "mural", "adipocyte", "chondro", "osteo", "smooth muscle", "myoepithel", "mesenchym"],
    "Vascular": ["endothel", "vascular", "lymphatic", "vein", "artery", "capillary"],
}
# Words in a free text that name an organ, and words that name a tumour.
ORGAN_WORDS = {
    "breast": ("breast", "mammary", "brca", "ductal", "luminal"),
    "kidney": ("kidney", "renal", "nephron", "glomerul"),
    "lung": ("lung", "pulmonary", "airway", "nsclc", "luad", "lusc", "alveolar", "bronch"),
    "liver": ("liver", "hepatic", "hepato"),
    "brain": ("brain", "cortex", "cerebr", "cerebell", "hippocamp", "striatum", "thalamus", "glioma", "glioblastoma"),
    "skin": ("skin", "dermal", "cutaneous", "epiderm", "melanoma", "melanocyt"),
    "eye": ("eye", "uveal", "retina", "ocular", "choroid"),
    "pancreas": ("pancrea", "islet"),
    "intestine": ("intestin", "colon", "duoden", "ileum", "jejunum", "bowel", "rectum", "colorect"),
    "stomach": ("stomach", "gastric"),
    "heart": ("heart", "cardiac", "myocard"),
    "spleen": ("spleen", "splenic"),
    "lymph_node": ("lymph node", "lymph_node", "tonsil"),
    "bone_marrow": ("bone marrow", "bone_marrow", "marrow"),
    "blood": ("pbmc", "peripheral blood", "leukocyte"),
    "prostate": ("prostate", "prostatic"),
    "bladder": ("bladder", "urothel"),
    "thyroid": ("thyroid",),
}
TUMOUR_WORDS = ("melanoma", "tumor", "tumour", "carcinoma", "cancer", "breast", "skin", "uveal", "cervical", "lung", "ovarian", "glioma")
# Ranks of assay names by the age of their chemistry; the first line that holds one of its words counts.
ASSAY_RANKS = (
    (9, ("flex", "fixed rna", "gem-x", "gemx")),
    (8, ("10x 3' v3", "10x 3' v4", "10x 5' v3")),
    (7, ("10x 5' v2", "10x multiome")),
    (6, ("10x 3' v2", "10x 5' v1")),
    (5, ("10x 3'", "10x 5'", "10x transcription")),
    (4, ("scalebio", "sci-rna-seq3")),
    (3, ("bd rhapsody", "seq-well", "drop-seq")),
    (2, ("smart-seq",)),
    (1, ("indrop", "cel-seq", "mars-seq", "microwell", "quartz-seq", "sci-rna-seq")),
)
UNKNOWN_ASSAY = 3


def _any(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def is_control(feature_type: Column, name: Column) -> Column:
    """Whether a feature is no signal: by its type, or by its name where the type is null."""
    return F.coalesce(~feature_type.isin(*SIGNAL_TYPES), F.coalesce(name, F.lit("")).rlike(f"(?i)^(?:{'|'.join(CONTROL_NAMES)})"))


def is_negative_control(feature_type: Column, name: Column) -> Column:
    """Whether a feature should catch no transcripts; deprecated and unassigned codewords carry signal and don't count."""
    return F.coalesce(feature_type.isin(*NEGATIVE_TYPES), F.coalesce(name, F.lit("")).rlike(f"(?i)^(?:{'|'.join(NEGATIVE_NAMES)})"))


def panel_genes(features: DataFrame, name: str = "gene", feature_type: str = "feature_type") -> DataFrame:
    """The features that are no controls, once each; null names go."""
    return features.filter(~is_control(F.col(feature_type), F.col(name)) & F.col(name).isNotNull()).select(name).distinct()


def resolve_markers(markers: DataFrame, panel: DataFrame) -> DataFrame:
    """``markers(marker_set, gene)`` with ``panel_gene``: the panel's gene of that very name, else the only one that
    differs in case alone, else null. Repeated rows stay; null genes have none."""
    known = panel.select(F.col("gene").alias("panel_gene")).filter("panel_gene IS NOT NULL").distinct()
    folded = known.groupBy(F.lower("panel_gene").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.min("panel_gene").alias("only")).filter("n = 1")
    exact = markers.join(known, markers["gene"] == known["panel_gene"], "left")
    return exact.join(folded, F.lower(exact["gene"]) == folded["fold"], "left").select(*[exact[c] for c in markers.columns], F.coalesce("panel_gene", "only").alias("panel_gene"))


def marker_lists(markers: DataFrame, panel: DataFrame, by: str = "marker_set") -> DataFrame:
    """For each marker set its genes on the panel and those that are missing, each in order and once, and a light:
    green for three and more, amber for fewer, red for none."""
    r = resolve_markers(markers, panel)
    lists = r.groupBy(by).agg(F.count_distinct("gene").alias("n_markers"), F.array_sort(F.collect_set("panel_gene")).alias("present"), F.array_sort(F.collect_set(F.when(F.col("panel_gene").isNull(), F.col("gene")))).alias("missing"))
    n = F.size("present")
    return lists.withColumn("light", F.when(n >= 3, "green").when(n >= 1, "amber").otherwise("red"))


def infer_organism(panel: DataFrame, name: str = "gene") -> DataFrame:
    """One row ``(n_title, n_upper, organism)``: mouse where more symbols are written Title than UPPER, else human.
    Identifiers of Ensembl and symbols without two letters don't count; without any the organism is null."""
    letters = F.regexp_replace(F.coalesce(F.col(name), F.lit("")), "[^A-Za-z]", "")
    usable = panel.select(letters.alias("s"), F.col(name).alias("g")).filter((F.length("s") >= 2) & ~F.col("g").rlike("^ENS[A-Z]*G[0-9]"))
    title, upper = F.col("s").rlike("^[A-Z][a-z]+$"), F.col("s").rlike("^[A-Z]+$")
    counts = usable.agg(F.count_if(title).alias("n_title"), F.count_if(upper).alias("n_upper"))
    return counts.withColumn("organism", F.when(F.col("n_title") + F.col("n_upper") == 0, None).when(F.col("n_title") > F.col("n_upper"), "mouse").otherwise("human"))


def is_abstention(label: Column) -> Column:
    """Whether a label says that a cell has no type: by the whole label, never by its beginning; null counts too."""
    return label.isNull() | label.isin(*ABSTENTIONS)


def collapsed(label: Column) -> Column:
    """The label, or NOT_ASSIGNED for an abstention."""
    return F.when(is_abstention(label), NOT_ASSIGNED).otherwise(label)


def is_missing_vote(vote: Column) -> Column:
    """Whether a vote says nothing: null, empty, or a word for none."""
    return vote.isNull() | F.lower(F.trim(vote)).isin("", "nan", "none")


def normal_label(label: Column) -> Column:
    """Lower case, hyphens and underscores as spaces, single spaces, without a plural s."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(label), "[-_]", " "), r"\s+", " "))
    return F.regexp_replace(plain, "s$", "")


def match_labels(asked: DataFrame, categories: DataFrame) -> DataFrame:
    """``asked(label)``, distinct, with ``category``: the same label of ``categories(label)``; else the one that differs
    in case; else the only one of the same normal form; else the only one that holds it or is held by it; else null.

    Categories are a list of types, so each asked label meets each of them.
    """
    a = asked.select(F.col("label").alias("asked")).distinct()
    c = categories.select(F.col("label").alias("category")).filter("category IS NOT NULL").distinct()
    x, y = normal_label(F.col("asked")), normal_label(F.col("category"))
    level = F.when(F.col("asked") == F.col("category"), 1).when(F.lower("asked") == F.lower("category"), 2).when(x == y, 3).when((x != "") & (y.contains(x) | x.contains(y)), 4)
    met = a.join(F.broadcast(c), level.isNotNull(), "left").withColumn("level", level)
    held = met.groupBy("asked", "level").agg(F.count("category").alias("n"), F.min("category").alias("category"))
    best = held.groupBy("asked").agg(F.min(F.struct("level", "n", "category")).alias("b"))
    return best.select(F.col("asked").alias("label"), F.when((F.col("b.level") <= 2) | (F.col("b.n") == 1), F.col("b.category")).alias("category"))


def canonical(proposals: DataFrame, allowed: DataFrame) -> DataFrame:
    """``proposals(label)`` with ``canonical``: the allowed label of the same letters, blanks at the ends aside; else null."""
    names = allowed.groupBy(F.lower(F.trim("label")).alias("__key")).agg(F.min("label").alias("canonical"))
    return proposals.join(F.broadcast(names), F.lower(F.trim(proposals["label"])) == names["__key"], "left").drop("__key")


def renamed(cells: DataFrame, old: str, new: str, column: str = "label", stale: tuple[str, ...] = ()) -> DataFrame:
    """``cells`` where one label is another's, without the columns that were derived from the labels."""
    return cells.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column))).drop(*stale)


def category_of(label: Column) -> Column:
    """The first category with a word that a token of the label begins with; Other without one and for abstentions."""
    low, out = F.lower(label), F.lit(None).cast("string")
    for name, words in CATEGORY_WORDS.items():
        anchored = "|".join(("(?<![a-z0-9])" if w[0].isalnum() else "") + w for w in words)
        out = F.coalesce(out, F.when(low.rlike(anchored), name))
    return F.when(is_abstention(label), "Other").otherwise(F.coalesce(out, F.lit("Other")))


def organs(text: Column) -> Column:
    """The organs that a free text names, in order."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))
    return F.array_compact(F.array(*(F.when(_any(plain, words), o) for o, words in ORGAN_WORDS.items())))


def same_tissue(a: Column, b: Column) -> Column:
    """True where two texts name a common organ, false where they name different ones, null where one names none."""
    x, y = organs(a), organs(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.arrays_overlap(x, y))


def in_tumour(tissue: Column, told: Column | None = None) -> Column:
    """Whether a section is of a tumour: what was told, else by the words of its tissue."""
    by_word = _any(F.lower(F.coalesce(tissue, F.lit(""))), TUMOUR_WORDS)
    return by_word if told is None else F.coalesce(told, by_word)


def assay_rank(assay: Column) -> Column:
    """How new an assay's chemistry is; names that aren't known have a middle rank."""
    low, out = F.lower(F.coalesce(assay, F.lit(""))), F.lit(None).cast("int")
    for rank, words in ASSAY_RANKS:
        out = F.coalesce(out, F.when(_any(low, words), rank))
    return F.coalesce(out, F.lit(UNKNOWN_ASSAY))


def region(cells: DataFrame, kept: Column, exclude: bool = False) -> DataFrame:
    """The cells for which a predicate holds (or doesn't, null as false). It raises where all cells or none would stay."""
    flag = F.coalesce(kept, F.lit(False))
    n, inside = cells.agg(F.count(F.lit(1)), F.count_if(flag)).first()
    if inside in (0, n):
        raise ValueError(f"a region of {inside} of {n} cells leaves nothing to filter")
    return cells.filter(~flag if exclude else flag)


def holds_raw_counts(counts: DataFrame, value: str = "value") -> DataFrame:
    """One row ``(raw)``: whether no value is negative or a fraction; true for an empty table."""
    v = F.col(value)
    return counts.agg(F.coalesce(F.min(((v >= 0) & (v == F.floor(v))).cast("int")) == 1, F.lit(True)).alias("raw"))


def log_odds(p: Column, low: float = 0.02, high: float = 0.98) -> Column:
    """Weight of a method that is right with probability ``p``: its log-odds within limits, not below zero; 0 for null."""
    q = F.greatest(F.least(F.coalesce(p, F.lit(0.5)), F.lit(high)), F.lit(low))
    return F.greatest(F.log(q / (1 - q)), F.lit(0.0))


def map_points(cells: DataFrame, most: int, value: str | None = None, only: Column | None = None, seed: int = 0) -> DataFrame:
    """At most ``most`` cells with finite coordinates, by the least hash of their id; ``value`` is scaled to 0..1
    between its 2nd and 98th percentiles."""
    ok = cells.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & (only if only is not None else F.lit(True)))
    out = ok.orderBy(F.md5(F.concat_ws("|", F.col("cell").cast("string"), F.lit(str(seed)))), "cell").limit(most)
    if value is None:
        return out
    edges = cells.agg(F.percentile(value, F.lit(0.02)).alias("__lo"), F.percentile(value, F.lit(0.98)).alias("__hi"))
    scaled = (F.col(value) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0))
    return out.crossJoin(F.broadcast(edges)).withColumn("scaled", F.greatest(F.least(scaled, F.lit(1.0)), F.lit(0.0))).drop("__lo", "__hi")


def label_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``(n, agreement)`` over the cells that both ``a(cell, label)`` and ``b(cell, label)`` have a label for."""
    both = a.select("cell", F.col("label").alias("x")).join(b.select("cell", F.col("label").alias("y")), "cell").filter(~is_missing_vote(F.col("x")) & ~is_missing_vote(F.col("y")))
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("agreement"))
