"""Connected components with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staytide.sources.tables import checkpointed


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges ``a``, ``b`` to ``node``, ``component``: the smallest node reachable.

    Each round points every node at the neighbour, itself included, that comes
    first in an order drawn by hash for that round, then contracts the graph
    along these pointers. A constant share of the nodes disappears per round
    whatever the shape, so long chains end after a logarithmic number of rounds
    and hubs lose their repeated edges at once. Rounds are written to the
    checkpoint folder. Edges with a null end and loops add nothing; nodes
    without an edge have no row.
    """
    live = checkpointed(edges.filter(F.col("a") != F.col("b"))
                        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    pointers = []
    while not live.isEmpty():
        if len(pointers) == max_rounds:
            raise RuntimeError("components did not settle")
        drawn = F.lit(len(pointers))
        ends = (live.select(F.col("a").alias("node"), F.col("b").alias("other"))
                .unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("other"))))
        first = F.min(F.struct(F.xxhash64("other", drawn).alias("h"), F.col("other")))
        own = F.struct(F.xxhash64("node", drawn).alias("h"), F.col("node").alias("other"))
        to = checkpointed(ends.groupBy("node").agg(first.alias("f"))
                          .select("node", F.least("f", own)["other"].alias("root")))
        pointers.append(to)
        a = to.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = checkpointed(live.join(a, "a").join(b, "b").filter("ra != rb")
                            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not pointers:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = pointers[0]
    for later in pointers[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = (labels.join(step, "root", "left")
                  .select("node", F.coalesce("next", "root").alias("root")))
    labels = checkpointed(labels)
    smallest = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(smallest, "root").select("node", "component")


def joined_components(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """``classes`` (``node``, ``component``) after further ``edges`` (``a``, ``b``).

    Only the edges between classes are contracted, so a few late edges cost a
    few rows, not all earlier ones again. A class keeps one of its nodes as
    name, the smallest of the classes' names.
    """
    named = edges
    for end in ("a", "b"):
        known = classes.select(F.col("node").alias("n"), F.col("component").alias("c"))
        named = named.join(known, F.col(end) == F.col("n"), "left").withColumn(end, F.coalesce("c", end)).drop("n", "c")
    later = checkpointed(connected_components(named))
    moved = later.select(F.col("node").alias("old"), F.col("component").alias("new"))
    kept = (classes.join(moved, F.col("component") == F.col("old"), "left")
            .select("node", F.coalesce("new", "component").alias("component")))
    # Nodes that were alone until now; the names of classes are nodes of these.
    return checkpointed(kept.unionByName(later.join(classes, "node", "left_anti")))
