"""Report tables: each block a small table, all in one long form ``(block, item, metric, value)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissueflow.operators.labels import is_abstention

#: Types of a composition that a report lists, and methods that make an agreement trusted.
HEAD, TRUSTED = 12, 3


def block(name: str, df: DataFrame, item: str | None = None) -> DataFrame:
    """The numbers and truth values of a small table as rows; ``item`` is the column that names its rows, one row if none.
    Text columns besides are left out; nulls stay, as null values."""
    numbers = [c for c, t in df.dtypes if c != item and t != "string" and not t.startswith(("array", "struct", "map"))]
    named = df.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item") if item else F.lit("").alias("item"), *(F.round(F.col(c).cast("double"), 6).alias(c) for c in numbers))
    return named.unpivot(["item"], numbers, "metric", "value").select(F.lit(name).alias("block"), "item", "metric", "value")


def report(*blocks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, blocks)


def composition_head(cells: DataFrame, most: int = HEAD) -> DataFrame:
    """``(label, n)`` of the commonest labels that aren't abstentions, ties by name."""
    typed = cells.filter(F.col("label").isNotNull() & ~is_abstention(F.col("label")))
    return typed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(most)


def panel_report(coverage: DataFrame, separation: DataFrame, typable: DataFrame) -> DataFrame:
    """One row: marker sets by light, their mean share on the panel, the mean AUC of the types, and how many are typable, on strong and on
    weak evidence. Of ``coverage(marker_set, light, fraction)``, ``separation(type, auc)`` and ``typable(label, typable, weak)``.
    Empty tables give counts of 0 and null means."""
    lights = coverage.agg(F.count(F.lit(1)).alias("n_sets"), *(F.count_if(F.col("light") == c).alias(f"n_{c}") for c in ("green", "amber", "red")), F.avg("fraction").alias("mean_fraction"))
    auc = separation.agg(F.avg("auc").alias("mean_auc"))
    sure = F.coalesce("typable", F.lit(False))
    weak = F.coalesce("weak", F.lit(False))
    kinds = typable.agg(F.count_if(sure & ~weak).alias("n_typable"), F.count_if(sure & weak).alias("n_typable_weak"), F.count_if(~sure).alias("n_not_typable"))
    return lights.crossJoin(auc).crossJoin(kinds)


def method_coverage(ballot: DataFrame, cells: DataFrame) -> DataFrame:
    """``(method, n_voted, coverage)``: the cells that each method of ``ballot(cell, method, label)`` has a label for, and their
    share of all. Null labels are no votes."""
    n = cells.agg(F.count_distinct("cell").alias("n"))
    voted = ballot.filter("label IS NOT NULL").join(cells.select("cell").distinct(), "cell").groupBy("method").agg(F.count_distinct("cell").alias("n_voted"))
    return voted.crossJoin(F.broadcast(n)).select("method", "n_voted", (F.col("n_voted") / F.col("n")).alias("coverage"))


def consensus_summary(votes: DataFrame, trusted: int = TRUSTED) -> DataFrame:
    """One row of ``votes(cell, agreement, n_methods)``: the mean agreement, and the share of cells with enough methods for it to count."""
    return votes.agg(F.count(F.lit(1)).alias("n_cells"), F.avg("agreement").alias("mean_agreement"), F.avg((F.col("n_methods") >= trusted).cast("double")).alias("share_trusted"))
