"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(edges: DataFrame, small: bool = False) -> DataFrame:
    """Every node links its greater neighbours to the least node that it knows."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    least = least.select("k", F.least("k", "m").alias("m"))
    return both.filter("v > u").join(F.broadcast(least) if small else least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, small: bool = False) -> DataFrame:
    """Every node links its lesser neighbours and itself to the least of them."""
    least = edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    if small:  # each edge moves and tells its node's least, so that the aggregate is read once
        both = edges.join(F.broadcast(least), F.col("u") == F.col("k")).select("m", F.explode(F.array("u", "v")).alias("u"))
        return both.filter("u <> m").select("u", F.col("m").alias("v"))
    moved = edges.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 60, sent: int = 0) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b; any ordered type), root being the least node reachable.

    Loops, repeated edges, nulls and either direction are allowed; rows with a null end are no edges. Aggregates
    combine before the shuffle, and the joins back to a hub's edges are plain equi-joins that adaptive execution can
    split, so a hub needs no single task. Each round is written to the shared folder; the round before is deleted. Of at
    most ``sent`` edges the least neighbours go to every task, which leaves three shuffles of six: many small tasks
    cost more than such rows.
    """
    e = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state, last = materialize(e, "edges"), None
    for _ in range(rounds):
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last or mark[0] == 0:
            break
        last = mark
        small = mark[0] <= sent
        large = _large_star(state, small)
        step = _small_star(large if small else large.distinct(), small)
        new = materialize(step.distinct(), "edges")
        discard(state)
        state = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()
