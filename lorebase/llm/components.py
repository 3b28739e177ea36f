"""Connected components of a graph given as edges, by contraction: every round joins nodes to their least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Edges for each task of a round, as a graph may be far smaller than what it was made of.
_EDGES, _LEAST_TASKS = 200_000, 8


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for each end of an edge of `edges` (a, b: long); comp is the least id of its component.

    In each round a node goes to its least neighbour's own least neighbour, if less than
    itself, and the edges between such nodes that stay different are the next round's
    graph: a star is done in one round, a path shortens by halves or more. Ends without
    edges are absent. Loops, repeated and reversed edges change nothing, null ends are
    left out, and without edges the result is empty.
    """
    def ordered(x, y) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    graph = checkpoint(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(*ordered("a", "b")).distinct())
    n, labels = graph.count(), None
    while True:
        tasks = max(_LEAST_TASKS, -(-n // _EDGES))
        ends = graph.union(graph.select("b", "a")).toDF("id", "near")
        up = ends.groupBy("id").agg(F.min("near").alias("near")).select("id", F.least("id", "near").alias("up")).coalesce(tasks)
        again = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
        up = checkpoint(up.join(again, "up").select("id", F.col("top").alias("up")).coalesce(tasks))
        if labels is None:
            labels = up.toDF("id", "comp")
        else:
            labels = checkpoint(labels.join(up.toDF("comp", "up"), "comp", "left").select("id", F.coalesce("up", "comp").alias("comp")).coalesce(tasks))
        met = graph.join(up.toDF("a", "up_a"), "a").join(up.toDF("b", "up_b"), "b").where("up_a <> up_b")
        graph = checkpoint(met.select(*ordered("up_a", "up_b")).coalesce(tasks).distinct().coalesce(tasks))
        n = graph.count()
        if n == 0:
            return labels
