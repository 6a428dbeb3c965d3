"""Connected components of an undirected graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``(id, label)`` for every vertex of ``edges (a, b)``; the label is the smallest id of its component.

    Each round hangs every vertex on its smallest neighbour, follows the pointers
    to the roots by doubling, and goes on with the edges between roots, at most
    half as many vertices as before. Vertices without edges, self loops, repeated
    edges and edges with a null end need no care from the caller: loops and nulls
    are dropped. Only counts reach the driver.
    """
    edges = materialize(_plain(edges))
    found = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low"))
                              .select("id", F.least("id", "low").alias("label")))
        parents = _roots(parents)
        found = parents if found is None else materialize(_follow(found, parents))
        edges = materialize(_plain(_follow(_follow(edges, parents, "a"), parents, "b")))
        if edges.isEmpty():
            return found


def _plain(edges: DataFrame) -> DataFrame:
    return (edges.where("a is not null and b is not null and a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _follow(rows: DataFrame, parents: DataFrame, column: str = "label") -> DataFrame:
    """Replace the vertices in ``column`` by what they hang on."""
    step = parents.select(F.col("id").alias("_at"), F.col("label").alias("_to"))
    return (rows.join(step, rows[column] == step["_at"], "left")
            .withColumn(column, F.coalesce("_to", column)).drop("_at", "_to"))


def _roots(parents: DataFrame) -> DataFrame:
    """Pointers to the roots: doubling ends after the logarithm of the depth."""
    while True:
        # a root points at itself, so only pointers at vertices that move on change
        moving = parents.where("id <> label")
        if moving.join(moving.select(F.col("id").alias("_at")), F.col("label") == F.col("_at"), "left_semi").isEmpty():
            return parents
        parents = materialize(_follow(parents, parents))
