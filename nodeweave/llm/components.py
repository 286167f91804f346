"""Connected components by hash-to-min.

Each node keeps a cluster, at first itself and its neighbours. In a round it
sends the cluster to the cluster's minimum and the minimum to every member. It
is stable when each node knows only its minimum and the minimum knows all; on
real graphs that takes about log(diameter) rounds. A cluster is kept as rows
(node, member), never as one array, so no group is ever held in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeweave.session import stage

#: A node whose cluster holds more rows than this share of all joins by broadcast, so no join task holds it alone. At most 1/HOT nodes can be that hot.
HOT = 0.002
HOT_ROWS = 20_000
MAX_ROUNDS = 60


def _minimum_of(pairs: DataFrame, total: int) -> DataFrame:
    """pairs with ``m``, the minimum of the row's cluster."""
    least = pairs.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
    if total <= HOT_ROWS:
        return pairs.join(least.select("v", "m"), "v")
    hot = least.filter(F.col("n") > max(HOT_ROWS, HOT * total)).select("v", F.col("m").alias("hot_m"))
    cold = least.filter(F.col("n") <= max(HOT_ROWS, HOT * total)).select("v", "m")
    marked = pairs.join(F.broadcast(hot), "v", "left")
    return (
        marked.filter(F.col("hot_m").isNull()).drop("hot_m").join(cold, "v").select("v", "u", "m")
        .unionByName(marked.filter(F.col("hot_m").isNotNull()).select("v", "u", F.col("hot_m").alias("m")))
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Nulls on either side and self loops are allowed: a null end makes no edge and
    the other end stands alone. Repeated edges count once. Empty in, empty out.
    """
    e = edges.select(F.col(a).alias("v"), F.col(b).alias("u"))
    both = e.select(F.explode(F.array(
        F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")),
        F.struct("v", F.col("v").alias("u")), F.struct(F.col("u").alias("v"), "u"),
    )).alias("e")).select("e.v", "e.u")
    pairs = stage(both.filter("v is not null and u is not null").distinct(), "cluster0")
    state = None
    for step in range(1, MAX_ROUNDS + 1):
        seen = pairs.agg(F.count("*"), F.sum(F.xxhash64("v", "u") % 1_000_003), F.sum(F.xxhash64("u", "v") % 998_244_353)).first()
        if tuple(seen) == state or not seen[0]:
            break
        state = tuple(seen)
        sent = _minimum_of(pairs, seen[0])
        pairs = stage(
            sent.select(F.explode(F.array(
                F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("m").alias("v"), "u"),
            )).alias("e")).select("e.v", "e.u").distinct(),
            f"cluster{step}",
        )
    else:
        raise RuntimeError(f"components not stable after {MAX_ROUNDS} rounds")
    return pairs.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node")
