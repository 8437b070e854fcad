"""Connected components of an edge table, by alternating stars.

Every round hangs the larger neighbours of a node, then the smaller ones, on
its least neighbour, until nothing changes; rounds grow with the logarithm of
the longest path. Minima are combined before the shuffle. A node with very many
edges never meets them in one task: such nodes, at most ``HUBS`` of them by the
pigeonhole, are answered from a broadcast, and only the others by a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adclick.sources.scratch import discard, materialise


# Nodes that may be broadcast. A node counts as a hub if it has more edges than
# twice all edges over this number, so there are fewer hubs than that.
HUBS = 10_000
LEAST_EDGES = 200


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """Join ``least`` (a, m, n of rows) to the rows by ``a``."""
    hub = F.col("n") > max(LEAST_EDGES, 2 * edges // HUBS)
    hubs = F.broadcast(least.where(hub).select("a", "m"))
    others = rows.join(hubs, "a", "left_anti").join(least.where(~hub).select("a", "m"), "a")
    return rows.join(hubs, "a").select("a", "b", "m").unionAll(others.select("a", "b", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of the edges ``a``, ``b``, whatever their
    order; the component is its least node. Null ends and loops are left out;
    an empty table gives an empty result."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, "edges")
    state = _state(edges)
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both, least, state[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, state[0]).select(
            F.explode(
                F.array(
                    F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
                )
            ).alias("e")
        )
        done = edges, large
        edges = materialise(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        discard(*done)
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
