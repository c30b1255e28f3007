"""Reconciled labels: every outcome by a hand-worked cluster."""

from tissueflow.operators.reconcile import reconcile


def frames(spark):
    cells = spark.createDataFrame([(i, c, "old") for i, c in enumerate(["0", "1", "2", "3", "4", "5", None])], "cell long, cluster string, label string")
    markers = spark.createDataFrame([("0", "T cell"), ("1", "T cell"), ("2", "B cell"), ("3", "B cell"), ("4", None)], "cluster string, label string")
    vocabulary = spark.createDataFrame([("T cell",), ("B cell",), (None,)], "label string")
    proposals = spark.createDataFrame([("0", " t CELL "), ("1", "B cell"), ("2", "novel / unknown"), ("3", "Astronaut"), ("4", "B cell"), ("5", None)], "cluster string, label string")
    return cells, markers, vocabulary, proposals


def test_outcomes(spark):
    r = reconcile(*frames(spark))
    got = {x.cluster: (x.marker_label, x.agreement, x.conflict, x.off_vocabulary, x.final) for x in r.clusters.collect()}
    assert got == {
        "0": ("T cell", True, False, False, "T cell"),
        "1": ("T cell", False, True, False, "T cell"),
        "2": ("B cell", False, False, False, "Novel / unknown"),
        "3": ("B cell", False, False, True, "B cell"),
        "4": ("Unknown", False, False, False, "B cell"),
        "5": ("Unknown", False, False, False, "Unknown"),
    }
    assert {x.cell: (x.label, x.conflict) for x in r.cells.collect()}[6] == ("Unassigned", False)
    assert {x.cell: x.conflict for x in r.cells.collect()}[1] is True


def test_without_proposals_and_empty(spark):
    cells, markers, vocabulary, _ = frames(spark)
    r = reconcile(cells, markers, vocabulary)
    assert {x.cluster: x.final for x in r.clusters.collect()}["2"] == "B cell" and r.clusters.filter("conflict OR off_vocabulary OR agreement").count() == 0
    assert reconcile(cells.limit(0), markers, vocabulary).cells.count() == 0


def test_votes_and_ties(spark):
    cells, markers, vocabulary, _ = frames(spark)
    votes = spark.createDataFrame([(0, "a", "B cell"), (1, "a", "B cell"), (1, "b", "B cell"), (6, "a", "B cell"), (6, "b", "B cell")], "cell long, method string, label string")
    got = {x.cell: (x.label, x.agreement) for x in reconcile(cells, markers, vocabulary, None, votes).cells.collect()}
    assert got[0] == ("T cell", 0.5)  # a tie goes to the cluster's label
    assert got[1] == ("B cell", 2 / 3) and got[6][0] == "B cell" and got[2] == ("B cell", 1.0)
    weights = spark.createDataFrame([("a", 2.0), ("cluster", 1.0)], "method string, weight double")
    assert {x.cell: x.label for x in reconcile(cells, markers, vocabulary, None, votes, weights).cells.collect()}[0] == "B cell"
