"""The property graph as two tables: nodes and edges, their upserts, order and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeweave.sources.tables import latest, table

#: Edges kept for a node, and for an expressway node.
NODE_EDGES, EXPRESSWAY_EDGES = 32, 128


def edge_order() -> list[Column]:
    """The order of a node's edges."""
    return [F.desc("confidence"), F.asc("created_at"), F.asc("dst_id")]


def current_nodes(frames: DataFrame, only: list[str] | None = None) -> DataFrame:
    """The highest version of each node; of equal versions the later delivery, of equal deliveries the greatest by its columns.

    A node without id is dropped by the caller's validation; a null expressway is
    false. Metadata travels as its canonical entries, since maps can't be compared.
    ``only`` names the columns wanted beside node_id, so that no other is read or shuffled.
    """
    cols = [c for c in ("version", "summary_vector", "full_vector", "metadata_vector", "traversal_vector", "summary_payload", "full_payload", "expressway", "metadata") if only is None or c in only]
    carried = ["version", "ingested_at", *[c for c in cols if c not in ("version", "metadata")], *(["entries"] if "metadata" in cols else [])]
    flat = frames.withColumn("entries", F.array_sort(F.map_entries("metadata"))) if "metadata" in cols else frames
    now = latest(flat, ["node_id"], ["version", "ingested_at"], carried)
    made = {"metadata": F.map_from_entries("entries"), "expressway": F.coalesce("expressway", F.lit(False))}
    return now.select("node_id", *[made[c].alias(c) if c in made else c for c in cols])


def upsert_edges(frames: DataFrame) -> DataFrame:
    """One row for each (src_id, dst_id): the last version, with the first created_at of all its versions."""
    cols = ["version", "updated_at", "confidence", "created_at", "edge_vector"]
    last = F.max(F.struct("version", "updated_at", "ingested_at", "confidence", "edge_vector")).alias("last")
    got = frames.groupBy("src_id", "dst_id").agg(last, F.min(F.struct("version", "created_at"))["created_at"].alias("created_at"))
    return got.select("src_id", "dst_id", *[F.col(f"last.{c}").alias(c) for c in cols if c != "created_at"], "created_at")


def edge_faults(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that a store must refuse, with the reason; a plan that must fail on them raises on a non-empty result."""
    reason = (
        F.when(F.col("src_id").isNull() | F.col("dst_id").isNull(), "missing end").when(F.col("src_id") == F.col("dst_id"), "self edge")
        .when(F.col("confidence").isNull() | (F.col("confidence") < 0) | (F.col("confidence") > 1) | F.isnan("confidence"), "confidence")
        .when(F.col("edge_vector").isNull() | (F.size("edge_vector") == 0), "edge vector")
    )
    known = nodes.select(F.col("node_id"))
    checked = edges.withColumn("reason", reason)
    lost = checked.filter("reason is null").join(known, F.col("src_id") == F.col("node_id"), "left_anti").withColumn("reason", F.lit("unknown source"))
    lost = lost.unionByName(checked.filter("reason is null").join(known, F.col("dst_id") == F.col("node_id"), "left_anti").withColumn("reason", F.lit("unknown destination")))
    return checked.filter("reason is not null").unionByName(lost)


def valid_edges(edges: DataFrame) -> DataFrame:
    """Edges a store accepts, as far as the row itself tells."""
    return edges.filter(
        (F.col("src_id") != F.col("dst_id")) & F.col("confidence").between(0.0, 1.0) & F.col("edge_vector").isNotNull() & (F.size("edge_vector") > 0)
    )


def prune_edges(edges: DataFrame, nodes: DataFrame, node_edges: int = NODE_EDGES, expressway_edges: int = EXPRESSWAY_EDGES) -> DataFrame:
    """The best edges of each source: 32 of a node, 128 of an expressway node.

    A hub may hold a large share of all edges: its rows are first cut to the
    constant bound within slots (so by many tasks), then the few that are left
    are ranked together. Both cuts plan a group limit before their sort.
    """
    if min(node_edges, expressway_edges) < 1:
        raise ValueError("edge limits must be positive")
    most = max(node_edges, expressway_edges)
    slots = edges.withColumn("slot", F.pmod(F.xxhash64("dst_id"), F.lit(32)))
    first = Window.partitionBy("src_id", "slot").orderBy(*edge_order())
    slim = slots.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= most).drop("r", "slot")
    flagged = slim.join(nodes.filter("expressway").select(F.col("node_id").alias("src_id"), F.lit(True).alias("is_expressway")), "src_id", "left")
    rank = Window.partitionBy("src_id").orderBy(*edge_order())
    limit = F.when(F.coalesce("is_expressway", F.lit(False)), expressway_edges).otherwise(node_edges)
    kept = flagged.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= most)
    return kept.filter(F.col("rank") <= limit).drop("is_expressway")


def graph(spark, sf_dir: str, node_edges: int = NODE_EDGES, expressway_edges: int = EXPRESSWAY_EDGES) -> tuple[DataFrame, DataFrame]:
    """(nodes, pruned edges) of the delivered tables."""
    frames = table(spark, sf_dir, "node_frame")
    edges = valid_edges(upsert_edges(table(spark, sf_dir, "edge_frame")))
    return current_nodes(frames), prune_edges(edges, current_nodes(frames, ["expressway"]), node_edges, expressway_edges)


def serial(node_id: Column | str) -> Column:
    """The number at the end of a node id."""
    return F.regexp_extract(node_id, "([0-9]+)$", 1).cast("long")


def query_nodes(nodes: DataFrame) -> DataFrame:
    """The stated query set of searches: every node whose number is divisible by 100."""
    return nodes.filter(F.pmod(serial("node_id"), F.lit(100)) == 0)
