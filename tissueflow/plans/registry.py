"""Registered queries over the driver tables, with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tissueflow.operators import spatial
from tissueflow.operators.statements import STATEMENTS
from tissueflow.plans import references, sections, trusted
from tissueflow.sources.section import DRIVER_TABLES, Section, from_driver_tables

#: Bytes of tables that a first part of a shuffle stands for, what parts are joined to and a task reads of a file, and their settings.
PART, JOINED = 4 << 20, "16m"
PARTS, ADVISORY = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
SPLIT = "spark.sql.files.maxPartitionBytes"


def duckdb_sql(text: str) -> str:
    """A statement over the section's frames as DuckDB SQL over the driver tables."""
    names = [n for n in DRIVER_TABLES if f"{{{n}}}" in text]
    ctes = ", ".join(f"{n} AS ({DRIVER_TABLES[n]})" for n in names)
    text = re.sub(r"\bpercentile\(", "quantile_cont(", re.sub(r"\{(\w+)\}", r"\1", text)).replace("AS STRING", "AS VARCHAR")
    own = re.match(r"\s*WITH\s+(.*)", text, re.S)
    return f"WITH {ctes}, {own[1]}" if own else f"WITH {ctes} {text}"


def _section(spark: SparkSession, sf_dir: str) -> Section:
    """The section, with shuffles dealt to parts whose number follows the size of the tables and joined again to at most JOINED, so
    that no task's share grows with them. A setting that the session made itself stays."""
    section = from_driver_tables(spark, sf_dir)
    size = sum(int(str(section[f"raw_{t}"]._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in ("customer", "orders", "lineitem", "part", "events"))
    for key, value in ((PARTS, str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART)))), (ADVISORY, JOINED), (SPLIT, JOINED)):
        if spark.conf.get(key, None) == spark.conf.get(f"tissueflow.{key}", None):  # unset, or set here
            spark.conf.set(key, value)
            spark.conf.set(f"tissueflow.{key}", value)
    return section


def _statement(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _section(spark, sf_dir).sql(text)


def _operator(run: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(_section(spark, sf_dir))


QUERIES = {k: _statement(v) for k, v in STATEMENTS.items()} | {k: _operator(v) for k, v in (spatial.OPERATORS | spatial.ITERATIVE | trusted.QUERIES | references.QUERIES | sections.QUERIES).items()}
ORACLE_SQL = {k: duckdb_sql(v) for k, v in (STATEMENTS | spatial.SQL | trusted.SQL | references.SQL | sections.SQL).items()}
