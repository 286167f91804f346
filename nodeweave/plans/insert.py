"""Attach new nodes to the graph: traverse, score, threshold, keep the best, link both ways.

``insert_batch`` places many new nodes against one frozen graph, each as if it
were the only one; new nodes don't see each other. ``insert_in_order`` places
them one after another, each in the graph its predecessors left, which is a
sequential operation and meant for small deliveries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeweave.functions.batch import effective_column
from nodeweave.functions.vectors import edge_vector, normalize, vec
from nodeweave.operators.graph import prune_edges
from nodeweave.operators.index import exact_topk
from nodeweave.plans.traverse import TraversalConfig, fetch, traverse
from nodeweave.session import held, settled, stage


@dataclass(frozen=True)
class InsertConfig:
    limit: int = 8
    threshold: float = 0.58
    edge_dims: int = 32
    summary_dims: int = 32
    traversal: TraversalConfig = field(default_factory=TraversalConfig)

    def __post_init__(self) -> None:
        if self.limit < 1 or self.edge_dims < 1 or not 0 <= self.threshold <= 1:
            raise ValueError("limit and edge_dims must be positive, threshold in 0..1")


def nearest_seed(nodes: DataFrame, fresh: DataFrame, dims: int) -> DataFrame:
    """(query_id, seed_id): the nearest other node by effective summary. Two are fetched, as the node itself may be among them."""
    eff = nodes.select("node_id", effective_column("summary_vector", "metadata_vector", dims).alias("eff"))
    near = exact_topk(eff, "node_id", "eff", fresh.select(F.col("node_id").alias("query_id"), vec("summary_vector").alias("q")), 2)
    return near.filter("query_id <> node_id").groupBy("query_id").agg(F.min(F.struct("rank", "node_id"))["node_id"].alias("seed_id"))


NODE = ("node_id", "summary_vector", "metadata_vector", "full_vector", "traversal_vector", "expressway")


def _sides(nodes: DataFrame, dims: int, prefix: str, key: str) -> DataFrame:
    """What the attach scorers need of a node, named by ``prefix``."""
    return nodes.select(
        F.col("node_id").alias(key), effective_column("summary_vector", "metadata_vector", dims).alias(f"{prefix}_eff"), vec("summary_vector").alias(f"{prefix}_summary"), vec("full_vector").alias(f"{prefix}_full"),
        vec(F.coalesce("traversal_vector", "summary_vector")).alias(f"{prefix}_route"),
    )


def attach(nodes: DataFrame, edges: DataFrame, fresh: DataFrame, config: InsertConfig | None = None) -> DataFrame:
    """(new_id, node_id, score, rank): where each new node is attached. ``fresh`` has the node columns; empty graphs attach nothing."""
    c = config or InsertConfig()
    fresh = settled(fresh.select(*NODE), "fresh")
    known = stage(nodes.select(*NODE).join(held(fresh.select("node_id")), "node_id", "left_anti"), "known")
    seeds = stage(nearest_seed(known, fresh, c.summary_dims), "seeds")
    asked = fresh.select(F.col("node_id").alias("query_id"), F.col("summary_vector").alias("query"))
    found = traverse(known, edges, asked, seeds, c.traversal).select("query_id", "node_id", "path")
    start = seeds.select("query_id", F.col("seed_id").alias("node_id"), F.array("seed_id").alias("path"))
    candidates = stage(start.unionByName(found.join(seeds.select("query_id", F.col("seed_id").alias("node_id")), ["query_id", "node_id"], "left_anti")), "candidates")
    steps = candidates.select("query_id", F.col("node_id").alias("of"), F.posexplode("path").alias("pos", "node_id"))
    # every node on a path, the candidate being its last
    parts = stage(_sides(fetch(known, steps, ["node_id"]), c.summary_dims, "cand", "node_id"), "sides")
    # the path's vector: its nodes' effective summaries, summed in path order
    paths = steps.join(parts.select("node_id", "cand_eff"), "node_id").groupBy("query_id", "of").agg(F.array_sort(F.collect_list(F.struct("pos", "cand_eff"))).alias("s")).select(
        "query_id", F.col("of").alias("node_id"), normalize(F.aggregate("s", F.array_repeat(F.lit(0.0), c.summary_dims), lambda a, x: F.zip_with(a, x["cand_eff"], lambda p, q: p + q))).alias("path")
    )
    rows = stage(paths, "paths").join(parts, "node_id").join(_sides(fresh, c.summary_dims, "new", "query_id"), "query_id")
    scored = c.traversal.scorer.attach_column(rows).filter(F.col("attach") >= c.threshold)
    w = Window.partitionBy("query_id").orderBy(F.desc("attach"), "node_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= c.limit).select(F.col("query_id").alias("new_id"), "node_id", F.col("attach").alias("score"), "rank")


def attached_edges(nodes: DataFrame, fresh: DataFrame, attached: DataFrame, edge_dims: int = 32, summary_dims: int = 32) -> DataFrame:
    """Edges both ways between new nodes and where they are attached."""
    eff = effective_column("summary_vector", "metadata_vector", summary_dims)
    both = nodes.select(F.col("node_id"), eff.alias("node_eff")), fresh.select(F.col("node_id").alias("new_id"), eff.alias("new_eff"))
    rows = attached.join(both[0], "node_id").join(both[1], "new_id")

    def side(src: str, dst: str, a: str, b: str) -> DataFrame:
        return rows.select(F.col(src).alias("src_id"), F.col(dst).alias("dst_id"), edge_vector(a, b, edge_dims).alias("edge_vector"), F.col("score").alias("confidence"), F.lit(0).cast("long").alias("created_at"), F.lit(0).cast("long").alias("updated_at"), F.lit(1).alias("version"))

    return side("new_id", "node_id", "new_eff", "node_eff").unionByName(side("node_id", "new_id", "node_eff", "new_eff"))


def insert_batch(nodes: DataFrame, edges: DataFrame, fresh: DataFrame, config: InsertConfig | None = None) -> DataFrame:
    """The pruned edge table after all new nodes were attached to the graph as it was; an edge that was there keeps its created_at."""
    c = config or InsertConfig()
    cols = ["src_id", "dst_id", "edge_vector", "confidence", "created_at", "updated_at", "version"]
    made = stage(attached_edges(nodes, fresh, attach(nodes, edges, fresh, c), c.edge_dims, c.summary_dims), "made")
    both = edges.select(*cols).withColumn("edge_vector", vec("edge_vector")).withColumn("turn", F.lit(0)).unionByName(made.select(*cols).withColumn("turn", F.lit(1)))
    last = F.max(F.struct("turn", *[x for x in cols[2:] if x != "created_at"])).alias("last")
    merged = both.groupBy("src_id", "dst_id").agg(last, F.min(F.struct("turn", "created_at"))["created_at"].alias("created_at"))
    merged = merged.select("src_id", "dst_id", "created_at", *[F.col(f"last.{x}").alias(x) for x in cols[2:] if x != "created_at"])
    return prune_edges(merged, nodes.unionByName(fresh, allowMissingColumns=True)).select(*cols)


def insert_in_order(nodes: DataFrame, edges: DataFrame, fresh: list[DataFrame], config: InsertConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after inserting one-row tables one after another."""
    for one in fresh:
        edges = insert_batch(nodes, edges, one, config)
        nodes = nodes.join(one.select("node_id"), "node_id", "left_anti").unionByName(one, allowMissingColumns=True)
    return nodes, edges
