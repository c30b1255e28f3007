"""Vendor exports of sections as long frames of one form: ``cells(section, cell, x, y, area)``, ``counts(section, cell, gene,
value)`` and ``features(section, gene, feature_type)``, and per-cell side tables. Readers are lazy; files may be gzipped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tissueflow.operators.labels import is_control

#: More features than this make an export of the larger platform.
WIDE_PANEL = 12_000
# Names of label columns, of tissue columns, and of coordinates, in order of preference.
LABEL_COLUMNS = ("cell_type", "celltype", "CellType", "cell_type_label", "annotation", "label", "cluster_label")
TISSUE_COLUMNS = ("tissue", "tissue_general", "Tissue", "organ", "Organ", "tissue_label")
X_COLUMNS, Y_COLUMNS = ("x_centroid", "x", "center_x"), ("y_centroid", "y", "center_y")


@dataclass
class Tables:
    """The frames of one or more sections."""

    cells: DataFrame
    counts: DataFrame
    features: DataFrame
    controls: DataFrame | None = None


def platforms(listing: DataFrame) -> DataFrame:
    """``(dir, platform, reason)`` of each export of ``listing(dir, file_name)``; what can't be read has a reason instead."""
    has = lambda *parts: F.max(F.when(F.greatest(*(F.col("file_name").contains(p).cast("int") for p in (*parts, parts[0]))) == 1, 1).otherwise(0)) == 1
    named = lambda name: F.max((F.col("file_name") == name).cast("int")) == 1
    only = (F.count_distinct("file_name") == 1) & named("transcripts.parquet")
    spots = has("filtered_feature_bc_matrix.h5") & named("spatial")
    platform = (
        F.when(named("experiment.xenium") | (named("cell_feature_matrix.h5") & has("cells.parquet")), "xenium")
        .when(has("exprMat") & has("metadata_file"), "cosmx")
        .when(has("cell_by_gene") & has("cell_metadata"), "merscope")
        .when(named("binned_outputs") | named("segmented_outputs"), "visiumhd")
        .when(only | spots, F.lit(None))
        .when(has("filtered_feature_bc_matrix.h5") | named("matrix.h5"), "flex")
    )
    reason = F.when(only, "molecules without cells: segment or bin them first").when(spots, "spots are not cells").otherwise("no known export")
    out = listing.filter("file_name IS NOT NULL").groupBy("dir").agg(platform.alias("platform"), reason.alias("reason"))
    return out.withColumn("reason", F.when(F.col("platform").isNull(), F.col("reason")))


def read_triplets(spark: SparkSession, path: str, section: str) -> tuple[DataFrame, DataFrame]:
    """(counts, features) of a folder with matrix.mtx, features.tsv and barcodes.tsv (plain or .gz).

    Places in the lists are row numbers; lists are read in one piece each, as their order is their meaning, and the
    matrix, which is long, in parallel.
    """

    def numbered(name: str, columns: list[str]) -> DataFrame:
        lines = spark.read.text(f"{path}/{name}.tsv*", wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\r?\n")).alias("at", "line"))
        parts = F.split("line", "\t")
        return lines.select((F.col("at") + 1).cast("long").alias("at"), *(F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)))

    features, cells = numbered("features", ["id", "gene", "feature_type"]), numbered("barcodes", ["cell"])
    entries = spark.read.text(f"{path}/matrix.mtx*").filter(~F.col("value").startswith("%")).select(F.split("value", r"\s+").alias("v"))
    # The size line names features, cells and entries: its first two exceed or equal every place, and it stands first.
    rows = entries.select(*(F.col("v")[i].cast("double").alias(c) for i, c in enumerate(("i", "j", "value"))))
    size = features.agg(F.count(F.lit(1)).alias("nf")).crossJoin(cells.agg(F.count(F.lit(1)).alias("nc")))
    total = rows.agg((F.count(F.lit(1)) - 1).alias("entries"))
    is_size = (F.col("i") == F.col("nf")) & (F.col("j") == F.col("nc")) & (F.col("value") == F.col("entries"))
    head = rows.crossJoin(F.broadcast(size)).crossJoin(F.broadcast(total)).filter(~is_size)
    found = head.join(F.broadcast(features.select(F.col("at").alias("i"), "gene")), "i").join(cells.select(F.col("at").alias("j"), "cell"), "j").filter("value <> 0")
    counts = found.groupBy("cell", "gene").agg(F.sum("value").alias("value"))
    return counts.select(F.lit(section).alias("section"), "cell", "gene", "value"), features.select(F.lit(section).alias("section"), "gene", F.coalesce("feature_type", F.lit("Gene Expression")).alias("feature_type"))


def _first(columns: list[str], names: tuple[str, ...], cast: str = "double") -> Column:
    found = [c for c in names if c in columns]
    return F.col(found[0]).cast(cast) if found else F.lit(None).cast(cast)


def _placed(cells: DataFrame, section: str, key: str = "cell_id") -> DataFrame:
    c = cells.columns
    return cells.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("cell"), _first(c, X_COLUMNS).alias("x"), _first(c, Y_COLUMNS).alias("y"), _first(c, ("cell_area", "area", "volume")).alias("area"))


def read_xenium(spark: SparkSession, path: str, section: str) -> Tables:
    """A folder with cells.parquet and the cell_feature_matrix triplets."""
    counts, features = read_triplets(spark, f"{path}/cell_feature_matrix", section)
    return Tables(_placed(spark.read.parquet(f"{path}/cells.parquet"), section), counts, features)


def _long(wide: DataFrame, keys: list[str], section: str) -> DataFrame:
    """A wide table of cells by genes as counts; zeros go."""
    genes = [c for c in wide.columns if c not in keys]
    long = wide.select(*keys, *(F.col(f"`{g}`").cast("double").alias(g) for g in genes)).unpivot(keys, None, "gene", "value")
    return long.filter("value <> 0").withColumn("section", F.lit(section))


def _named_features(wide: DataFrame, keys: list[str], section: str) -> DataFrame:
    names = [(section, c) for c in wide.columns if c not in keys]
    f = wide.sparkSession.createDataFrame(names, "section string, gene string")
    return f.withColumn("feature_type", F.when(is_control(F.lit(None).cast("string"), F.col("gene")), "Negative Control Probe").otherwise("Gene Expression"))


def read_cosmx(spark: SparkSession, path: str, section: str) -> Tables:
    """Flat files: *exprMat_file.csv (fov, cell_ID, genes) and *metadata_file.csv (global centroids in pixels); the key is fov_cell."""
    wide = spark.read.csv(f"{path}/*exprMat*", header=True)
    key = F.concat_ws("_", F.col("fov").cast("string"), F.col("cell_ID").cast("string"))
    counts = _long(wide, ["fov", "cell_ID"], section).select("section", key.alias("cell"), "gene", "value")
    meta = spark.read.csv(f"{path}/*metadata_file*", header=True)
    cells = meta.select(F.lit(section).alias("section"), key.alias("cell"), F.col("CenterX_global_px").cast("double").alias("x"), F.col("CenterY_global_px").cast("double").alias("y"), _first(meta.columns, ("Area",)).alias("area"))
    return Tables(cells, counts, _named_features(wide, ["fov", "cell_ID"], section))


def read_merscope(spark: SparkSession, path: str, section: str) -> Tables:
    """The pair *cell_by_gene*.csv and *cell_metadata*.csv; probes that begin with Blank are counts of controls."""
    wide = spark.read.csv(f"{path}/*cell_by_gene*", header=True)
    key, meta = wide.columns[0], spark.read.csv(f"{path}/*cell_metadata*", header=True)
    long = _long(wide, [key], section).select("section", F.col(key).cast("string").alias("cell"), "gene", "value")
    blank = F.col("gene").startswith("Blank")
    features = _named_features(wide, [key], section).filter(~blank)
    return Tables(_placed(meta, section, "EntityID" if "EntityID" in meta.columns else meta.columns[0]), long.filter(~blank), features, long.filter(blank))


def read_visiumhd(spark: SparkSession, path: str, section: str, bins: str = "binned_outputs/square_008um") -> Tables:
    """Bins of 8 um: filtered_feature_bc_matrix triplets and spatial/tissue_positions.parquet, in full-resolution pixels."""
    counts, features = read_triplets(spark, f"{path}/{bins}/filtered_feature_bc_matrix", section)
    at = spark.read.parquet(f"{path}/{bins}/spatial/tissue_positions.parquet")
    cells = at.select(F.lit(section).alias("section"), F.col("barcode").alias("cell"), F.col("pxl_col_in_fullres").cast("double").alias("x"), F.col("pxl_row_in_fullres").cast("double").alias("y"), F.lit(None).cast("double").alias("area"))
    return Tables(cells.join(counts.select("cell").distinct(), "cell", "left_semi"), counts, features)


def read_flex(spark: SparkSession, path: str, section: str) -> Tables:
    """Dissociated cells: the same form without coordinates."""
    counts, features = read_triplets(spark, path, section)
    none = F.lit(None).cast("double")
    return Tables(counts.select("section", "cell").distinct().withColumns({"x": none, "y": none, "area": none}), counts, features)


READERS = {"xenium": read_xenium, "cosmx": read_cosmx, "merscope": read_merscope, "visiumhd": read_visiumhd, "flex": read_flex}


def assembled(spark: SparkSession, sections: list[tuple[str, str, str]]) -> tuple[Tables, DataFrame]:
    """(frames of all ``(section, platform, path)``, one row of facts a section): platform, panel genes, whether it has places."""
    parts = [(s, p, READERS[p](spark, path, s)) for s, p, path in sections]
    both = lambda name: __import__("functools").reduce(DataFrame.unionByName, [getattr(t, name) for _, _, t in parts])
    tables = Tables(both("cells"), both("counts"), both("features"))
    told = spark.createDataFrame([(s, p) for s, p, _ in parts], "section string, platform string")
    facts = tables.features.groupBy("section").agg(F.count_if(~is_control(F.col("feature_type"), F.col("gene"))).alias("n_panel_genes"), F.count(F.lit(1)).alias("n_features"))
    placed = tables.cells.groupBy("section").agg(F.count(F.lit(1)).alias("n_cells"), F.coalesce(F.bool_or(F.col("x").isNotNull()), F.lit(False)).alias("has_places"))
    meta = told.join(facts, "section", "left").join(placed, "section", "left")
    return tables, meta.withColumn("platform", F.when((F.col("platform") == "xenium") & (F.col("n_features") > WIDE_PANEL), "atera").otherwise(F.col("platform")))


def panel_facts(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(name, organism, tissue, n_targets, label)`` of a panel's JSON description."""
    j = spark.read.json(path, multiLine=True)
    field = lambda *names: F.coalesce(*(F.col(n).cast("string") for n in names if n in j.columns), F.lit(None).cast("string"))
    number = lambda *names: F.coalesce(*(F.col(n).cast("long") for n in names if n in j.columns), F.lit(0).cast("long"))
    t = j.select(field("panel_name").alias("name"), field("panel_organism", "organism").alias("organism"), field("panel_tissue_type", "region_name").alias("tissue"), (number("panel_num_targets_predesigned") + number("panel_num_targets_custom")).alias("n_targets"))
    return t.withColumn("label", F.concat_ws(", ", "name", F.lower("organism"), F.lower("tissue"), F.format_string("%d targets", "n_targets")))


def joined_side(cells: DataFrame, side: DataFrame, columns: list[str], prefix: str, key: str = "cell") -> tuple[DataFrame, DataFrame]:
    """(``cells`` with the side table's columns under a prefix, one row ``(coverage)``): columns that the side table lacks
    are null, of repeated ids the first row by value counts, and coverage is the share of cells with the first column
    that is there."""
    there = [c for c in columns if c in side.columns]
    one = side.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*there)).alias("__s")) if there else None
    out = cells.join(one, key, "left") if there else cells
    out = out.select(*cells.columns, *((F.col(f"__s.{c}") if c in there else F.lit(None).cast("double")).alias(f"{prefix}{c}") for c in columns))
    share = F.avg(F.col(f"{prefix}{there[0]}").isNotNull().cast("double")) if there else F.lit(0.0)
    return out, out.agg(share.alias("coverage"))


def with_signal(cells: DataFrame, side: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Vertical signal of each cell and whether it is over the threshold (null where unknown); nothing is dropped."""
    out, _ = joined_side(cells, side, ["vsi"], "")
    return out.withColumn("vsi_confident", F.col("vsi") >= threshold)


def pixel_integrity(pixels: DataFrame, threshold: float = 0.7, least_signal: float = 1.5) -> DataFrame:
    """``(cell, vsi, share_low, n_pixels)`` of ``pixels(cell, signal, vsi)`` with enough signal; unassigned pixels go."""
    ok = pixels.filter((F.col("signal") > least_signal) & F.col("cell").isNotNull() & (F.col("cell").cast("string") != "UNASSIGNED"))
    return ok.groupBy("cell").agg(F.avg("vsi").alias("vsi"), F.avg((F.col("vsi") < threshold).cast("double")).alias("share_low"), F.count(F.lit(1)).alias("n_pixels"))


def with_malignancy(cells: DataFrame, side: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Copy-number score and flag, or a learned probability and its threshold: unknown cells have no score and no flag."""
    out, _ = joined_side(cells, side, [c for c in ("cnv_score", "is_malignant", "probability") if c in side.columns], "")
    flag = F.col("is_malignant") if "is_malignant" in out.columns else F.col("probability") > threshold
    return out.withColumn("is_malignant", F.coalesce(flag, F.lit(False)))


def purified(counts: DataFrame, side: DataFrame) -> DataFrame:
    """The side table's counts for cells and genes that ``counts`` knows; cells that it lacks have no counts."""
    return side.join(counts.select("cell").distinct(), "cell", "left_semi").join(counts.select("gene").distinct(), "gene", "left_semi").select("cell", "gene", "value").filter("value <> 0")


def boundaries(path_or_frame, cells: DataFrame, most: int | None = None, spark: SparkSession | None = None, seed: int = 0) -> DataFrame:
    """``(cell_id, ring)``: outlines of the section's cells, vertices in file order, of at most ``most`` cells by hash."""
    b = spark.read.parquet(path_or_frame).select("cell_id", "vertex_x", "vertex_y") if isinstance(path_or_frame, str) else path_or_frame
    kept = cells.select(F.col("cell").alias("cell_id"))
    if most is not None:
        kept = kept.orderBy(F.md5(F.concat_ws("|", F.col("cell_id").cast("string"), F.lit(str(seed)))), "cell_id").limit(most)
    ordered = b if "ord" in b.columns else b.withColumn("ord", F.monotonically_increasing_id())
    ring = F.transform(F.array_sort(F.collect_list(F.struct("ord", "vertex_x", "vertex_y"))), lambda v: F.struct(v["vertex_x"].alias("x"), v["vertex_y"].alias("y")))
    return ordered.join(kept, "cell_id", "left_semi").groupBy("cell_id").agg(ring.alias("ring"))


def label_column(reference: DataFrame, candidates: tuple[str, ...] = LABEL_COLUMNS) -> str | None:
    """The first candidate with two values or more, fewer distinct ones than nine in ten rows, and no ontology ids."""
    there = [c for c in candidates if c in reference.columns]
    if not there:
        return None
    facts = reference.agg(F.count(F.lit(1)).alias("n"), *(F.approx_count_distinct(c).alias(f"d_{c}") for c in there), *(F.avg(F.col(c).cast("string").rlike("^[A-Z]+:[0-9]+$").cast("double")).alias(f"o_{c}") for c in there)).first()
    return next((c for c in there if 2 <= facts[f"d_{c}"] < 0.9 * max(1, facts["n"]) and (facts[f"o_{c}"] or 0) < 0.5), None)


def declared_tissue(reference: DataFrame) -> DataFrame:
    """One row ``(tissue)``: the commonest value of the first tissue column, ties by name; no row without one."""
    there = [c for c in TISSUE_COLUMNS if c in reference.columns]
    if not there:
        return reference.select(F.lit(None).cast("string").alias("tissue")).limit(0)
    value = F.trim(F.col(there[0]).cast("string"))
    known = reference.select(value.alias("tissue")).filter(~F.lower("tissue").isin("", "nan", "none", "unknown", "na"))
    return known.groupBy("tissue").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tissue").limit(1).select("tissue")


def selected_cells(cells: DataFrame, counts: DataFrame, wanted: Column) -> tuple[DataFrame, DataFrame]:
    """Cells by their metadata first, then only those cells' counts."""
    chosen = cells.filter(wanted)
    return chosen, counts.join(chosen.select("cell"), "cell", "left_semi")


def ontology_edges(spark: SparkSession, path: str) -> DataFrame:
    """``(child, parent)``: the is-a lines of an OBO file's terms. Stanzas are split by their blank lines."""
    terms = spark.read.option("lineSep", "\n\n").text(path).filter(F.col("value").contains("[Term]") & ~F.col("value").rlike(r"(?m)^is_obsolete: true"))
    child = F.regexp_extract("value", r"(?m)^id: (\S+)", 1)
    return terms.select(child.alias("child"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^is_a: (\S+)"), F.lit(1))).alias("parent")).distinct()


def gene_positions(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``(gene, chromosome, start, end)`` of wanted genes on chromosomes 1-22 and X of a GTF file, the first by place."""
    g = spark.read.csv(path, sep="\t", comment="#", schema="chromosome string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string", quote="")
    named = g.filter("feature = 'gene'").select(F.regexp_extract("attributes", 'gene_name "([^"]+)"', 1).alias("gene"), F.regexp_replace("chromosome", "^chr", "").alias("chromosome"), "start", "end")
    on = named.filter(F.col("chromosome").rlike("^([1-9]|1[0-9]|2[0-2]|X)$")).join(wanted.select("gene").distinct(), "gene", "left_semi")
    return on.groupBy("gene").agg(F.min(F.struct("chromosome", "start", "end")).alias("p")).select("gene", "p.*")


def write_section(tables: dict[str, DataFrame], path: str) -> None:
    """Each frame as Parquet below ``path``, by section where it has one; characters that paths can't hold are replaced."""
    for name, df in tables.items():
        clean = df.select(*(F.col(f"`{c}`").alias("".join("_" if x in " ,;{}()\n\t=/" else x for x in c)) for c in df.columns))
        writer = clean.write.mode("errorifexists")
        (writer.partitionBy("section") if "section" in clean.columns else writer).parquet(f"{path}/{name}")
