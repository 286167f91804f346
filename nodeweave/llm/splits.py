"""Splits that keep related records together.

Records that share any of several keys belong together, also through others:
the distinct key pairs of the records are the edges of a graph over keys, its
components (hash-to-min) are the groups, and every record takes the group of
its key. The graph holds one edge for each distinct pair of keys however many
records share it, so a hot key costs one edge.

Groups go to splits by weighted rendezvous hashing: each split draws
-w / ln(hash(group, split)), the largest draw wins, and adding or removing a
split moves only the groups it wins or loses. Groups too large to be left to
chance (at most 1/HEAVY of them) are placed first, largest first, where most of
the wanted share is missing; the hash weights are what is then still wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeweave.llm.components import components
from nodeweave.session import stage

#: A group with more than this share of the rows is placed by size; there are at most 1/HEAVY of them.
HEAVY = 0.001


def linked_groups(df: DataFrame, id_col: str, key_cols: list[str]) -> DataFrame:
    """(id, group): the smallest key of all records linked through equal values of any key column.

    The first key column should sort before the others (prefix them), as the
    smallest key names the group. Null keys link nothing; a record with no key at
    all comes out with a null group. A repeated id links all of its keys and
    comes out once. Extra columns are ignored; an empty table gives an empty one.
    """
    keyed = df.select(F.col(id_col).alias("id"), F.array_compact(F.array(*key_cols)).alias("keys")).filter("id is not null")
    first = keyed.select("id", F.element_at("keys", 1).alias("first"), "keys") if len(key_cols) == 1 else keyed.select(
        "id", F.when(F.size("keys") > 0, F.col("keys")[0]).alias("first"), "keys"
    )
    one = first.groupBy("id").agg(F.min("first").alias("first"))
    edges = first.filter("first is not null").select(F.col("first").alias("a"), F.explode("keys").alias("b")).distinct()
    repeats = first.join(one.withColumnRenamed("first", "lead"), "id").filter("first <> lead").select(F.col("lead").alias("a"), F.col("first").alias("b")).distinct()
    groups = components(edges.unionByName(repeats))
    return one.join(groups.select(F.col("node").alias("first"), F.col("component").alias("group")), "first", "left").select("id", "group")


def assign_splits(groups: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """groups (id, group) with ``split``, close to the shares of plan (split, share); a group is never parted.

    Records with a null group are groups of their own, by their id. Shares are
    taken relative to their sum; null or non-positive shares take nothing. The plan is a small fixed
    table: it is read to the driver, as are the few groups over HEAVY of the rows.
    """
    wanted = {r["split"]: float(r["share"]) for r in plan.filter("share > 0").select("split", "share").collect()}
    if not wanted:
        raise ValueError("the split plan holds no positive share")
    scale = sum(wanted.values())
    wanted = {k: v / scale for k, v in sorted(wanted.items())}
    own = stage(groups.withColumn("unit", F.coalesce("group", F.concat(F.lit("id "), "id"))), "units")
    sizes = own.groupBy("unit").agg(F.count("*").alias("n"))
    total = own.count()
    missing = {k: v * total for k, v in wanted.items()}
    placed: list[tuple[str, str]] = []
    for unit, n in sorted(((r["unit"], r["n"]) for r in sizes.filter(F.col("n") > HEAVY * total).collect()), key=lambda x: (-x[1], x[0])):
        best = max(missing, key=lambda k: (missing[k], k))
        placed.append((unit, best))
        missing[best] -= n
    weights = {k: max(v, 0.0) for k, v in missing.items()}
    if not any(weights.values()):
        weights = dict(wanted)

    def even(k: str) -> F.Column:
        """A number in 0..1 by the hash of split and group."""
        return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|{k}|"), "unit")), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)

    draws = F.array_max(F.array(*[F.struct((-F.lit(w) / F.log(even(k))).alias("d"), F.lit(k).alias("k")) for k, w in weights.items() if w > 0]))
    by_hash = own.withColumn("by_hash", draws.getField("k"))
    if not placed:
        return by_hash.select("id", "group", F.col("by_hash").alias("split"))
    # at most 1/HEAVY rows
    heavy = groups.sparkSession.createDataFrame(placed, "unit string, by_size string")
    return by_hash.join(F.broadcast(heavy), "unit", "left").select("id", "group", F.coalesce("by_size", "by_hash").alias("split"))
