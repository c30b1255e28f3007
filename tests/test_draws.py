"""Draws of transcripts against hashlib; a reference's counts are thinned once."""

import hashlib

import numpy as np
import pyarrow as pa

from tissueflow.operators import thinning
from tissueflow.operators.draws import drawn


def test_drawn_equals_hashlib(monkeypatch):
    monkeypatch.setattr("tissueflow.operators.draws.STEP", 97)  # so that rows lie across steps
    rng = np.random.default_rng(0)
    keys = ["", "1|2", "12345|9", "x" * 45 + "|1", "y" * 70 + "|ü", "12|34"] * 3
    n, limit = rng.integers(0, 1300, len(keys)), rng.integers(0, 65537, len(keys))
    n[0], limit[3], limit[4] = 0, 65536, 0
    for tail, draws in (("0.0", 1), ("0.3", 8)):
        value = lambda k, u, d, tail=tail: int(hashlib.md5(f"{k}|{u}|{tail}".encode()).hexdigest()[4 * d : 4 * d + 4], 16)
        expected = [[sum(value(k, u, d) < at for u in range(1, m + 1)) for d in range(draws)] for k, m, at in zip(keys, n, limit, strict=True)]
        assert drawn(pa.array(["none", *keys])[1:], n, limit, tail, draws).tolist() == expected
    assert drawn(pa.array([], pa.string()), n[:0], limit[:0], "0.0", 1).shape == (0, 1)


def test_counts_are_thinned_once(spark, monkeypatch):
    """What names the cells reads thinned counts from a table; each of them meets one row for all types."""
    tables, kept = [], thinning.saved
    monkeypatch.setattr(thinning, "saved", lambda df: tables.append(kept(df)) or tables[-1])
    monkeypatch.setattr(thinning, "forget", lambda *_: None)
    counts = spark.createDataFrame([(c, g, 1 + (c * g) % 7) for c in range(60) for g in range(30)], "cell long, gene long, value long")
    cells = spark.createDataFrame([(c, "ABC"[c % 3]) for c in range(60)], "cell long, label string")
    out = thinning.resolvability(counts, cells, counts.select("gene").distinct(), 40)
    assert {r.label: r.n for r in out.collect()} == {"A": 20, "B": 20, "C": 20}
    assert "md5" not in out._jdf.queryExecution().toString()
    thin = [t for t in tables if "c" in t.columns]
    assert [t.count() for t in thin] == [1800] and max(t.count() for t in tables) == 1800
