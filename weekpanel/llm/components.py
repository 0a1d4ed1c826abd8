"""Connected components of a table of links, by alternating large and small stars over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.shared import Staging


def _least(edges: DataFrame, staging: Staging, name: str) -> DataFrame:
    """Per node the smallest of itself and its neighbours. Staged, so that the join can split a hot node."""
    return staging.write(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)


def _are_stars(edges: DataFrame) -> bool:
    """Every node hangs on one other, on which nothing else but its like hangs."""
    twice = edges.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
    middle = edges.select("a").join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    return twice.unionByName(middle).isEmpty()


def components(links: DataFrame, staging: Staging, label: str) -> DataFrame:
    """(node, root) of every node that has a link in ``links`` (a, b); the root is the component's smallest node.

    A large star hangs a node's larger neighbours on its smallest one, a small star the smaller ones. Both keep the
    components and never add edges, until every component is a star around its smallest node. The
    number of rounds grows with the logarithm of the number of nodes.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = staging.write(links.filter("a <> b").select(a, b).distinct(), f"{label}-0")
    turn = 0
    while not _are_stars(edges):
        turn += 1
        both = edges.selectExpr("a AS u", "b AS v").unionByName(edges.selectExpr("b AS u", "a AS v"))
        least = _least(both, staging, f"{label}-large-{turn}")
        large = staging.write(
            both.filter("v > u").join(least, "u").selectExpr("v AS a", "m AS b").filter("a <> b").distinct(),
            f"{label}-mid-{turn}",
        )
        down = large.selectExpr("a AS u", "b AS v")
        least = _least(down, staging, f"{label}-small-{turn}")
        stars = down.join(least, "u").select(F.explode(F.expr("array(struct(u AS a, m AS b), struct(v AS a, m AS b))")))
        edges = staging.write(stars.select("col.*").filter("a <> b").distinct(), f"{label}-{turn}")
        staging.drop(f"{label}-{turn - 1}", f"{label}-large-{turn}", f"{label}-mid-{turn}", f"{label}-small-{turn}")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.selectExpr("a AS node", "b AS root").unionByName(roots)
