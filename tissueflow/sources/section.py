"""A section: long, sparse tables of cells, genes, counts and labels, as lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tissueflow.durable import saved

#: How the driver tables take the parts of a section: a customer is a cell, a part is a gene, quantities are counts.
#: Zeros are implicit. Each text is SQL over the raw tables.
DRIVER_TABLES = {
    "counts": "SELECT o_custkey AS cell, l_partkey AS gene, sum(l_quantity) AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey",
    "cells": "SELECT c_custkey AS cell, c_mktsegment AS label, c_nationkey AS batch, c_acctbal AS x, coalesce(y, 0) AS y FROM customer LEFT JOIN (SELECT o_custkey, floor(sum(round(o_totalprice * 100)) / 100 + 0.5e0) / 100 AS y FROM orders GROUP BY o_custkey) t ON o_custkey = c_custkey",
    "genes": "SELECT p_partkey AS gene, p_brand AS marker_set, p_type = 'ECONOMY' AND p_size % 10 = 0 AS control, p_size AS position FROM part",
    "votes": "SELECT o_custkey AS cell, 'status' AS method, o_orderstatus AS label FROM orders UNION ALL SELECT o_custkey, 'flag', l_returnflag FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT o_custkey, 'line', l_linestatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    "truth": "SELECT cell, min(label) AS label FROM (SELECT o_custkey AS cell, o_orderstatus AS label, count(*) AS n, max(count(*)) OVER (PARTITION BY o_custkey) AS most FROM orders GROUP BY o_custkey, o_orderstatus) t WHERE n = most GROUP BY cell",
    "vectors": "SELECT vec_id AS item, embedding, label FROM embeddings",
    "judged": "SELECT d.doc_id AS item, round((d.n_chars % 1000) / 1000.0e0, 3) AS confidence, l.quality AS correct, d.lang AS grp, d.source AS predicted FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL",
    "molecules": "SELECT user_id AS cell, event_type AS gene, value AS z, event_id AS item FROM events",
}
RAW = ("orders", "lineitem", "customer", "part", "documents", "labels", "events", "nation", "region", "embeddings")


@dataclass
class Section:
    """Named DataFrames; ``sql`` runs a statement whose ``{name}`` are those frames."""

    spark: SparkSession
    frames: dict[str, DataFrame] = field(default_factory=dict)
    kept: dict[str, DataFrame] = field(default_factory=dict)

    def sql(self, text: str, shared: bool = False) -> DataFrame:
        """The rows of a statement. Parts that it holds twice, that were kept before, or that others will ask for too (``shared``), are
        read from tables made once."""
        from tissueflow.operators.scores import PARTS, SHARED

        def share(text: str, parts) -> str:
            for part, name in parts:
                if f"({part})" in text and (shared or part in self.kept or text.count(f"({part})") > 1):
                    self.frames[name] = self.once(part)
                    text = text.replace(f"({part})", f"{{{name}}}")
            return text

        text = share(text, SHARED[:-1])
        for part, name, make in PARTS:  # these hold the last of SHARED
            if f"({part})" in text:
                if name not in self.frames:
                    self.frames[name] = make(self)
                text = text.replace(f"({part})", f"{{{name}}}")
        text = share(text, SHARED[-1:])
        return self.spark.sql(text, **{k: v for k, v in self.frames.items() if f"{{{k}}}" in text})

    def once(self, text: str) -> DataFrame:
        """As :meth:`sql`, but made once and kept as a table in the shared folder, from frames kept likewise: what several operators
        ask for isn't made again by each."""
        if text not in self.kept:
            for name in {k for k in self.frames if f"{{{k}}}" in text}:
                self.keep(name)
            self.kept[text] = saved(self.sql(text, shared=True))
        return self.kept[text]

    def keep(self, *names: str) -> None:
        """Make these frames once; later statements and operators read the table."""
        for name in names:
            if name not in self.kept:
                self.kept[name] = self.frames[name] = saved(self.frames[name])

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]


def from_driver_tables(spark: SparkSession, sf_dir: str) -> Section:
    """The section that the driver's tables make; nothing is read before an operator asks."""
    raw = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in RAW}
    out = Section(spark, {f"raw_{k}": v for k, v in raw.items()})
    for name, text in DRIVER_TABLES.items():
        for t in RAW:
            text = _word(text, t)
        out.frames[name] = spark.sql(text, **{t: v for t, v in raw.items() if f"{{{t}}}" in text})
    return out


def _word(text: str, table: str) -> str:
    import re

    return re.sub(rf"(?<=FROM |JOIN ){table}\b", f"{{{table}}}", text)
