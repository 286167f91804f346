"""Bounded graph traversal for many queries at once.

The state of a hop is three tables keyed by query: the frontier (node, path,
running sum of path vectors, expressway jumps), the nodes already admitted, and
the budgets used. A hop is joins and window functions; its decisions are written
once, so later hops read a table instead of the whole history of plans. The
graph's own tables are met by the hop's ids, which are sent to them where their
measured size allows it, so a hop shuffles its candidates and not the graph. The
driver only counts hops.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeweave.functions.batch import effective_column, unit_column
from nodeweave.functions.vectors import resize, vec
from nodeweave.operators.scorers import SCORES, HeuristicScorer, Scorer
from nodeweave.session import held, settled, stage


@dataclass(frozen=True)
class TraversalConfig:
    max_hops: int = 3
    fanout: int = 16
    beam_width: int = 32
    mode: str = "beam"
    max_visited: int = 512
    max_full_reads: int = 64
    read_full_threshold: float = 0.70
    include_threshold: float = 0.58
    expand_threshold: float = 0.52
    critical_threshold: float = 0.82
    expressway_fanout: int = 128
    expressway_threshold: float = 0.72
    max_expressway_jumps: int = 2
    path_dims: int = 32
    scorer: Scorer = field(default_factory=HeuristicScorer)

    def __post_init__(self) -> None:
        if self.mode not in ("beam", "single_path"):
            raise ValueError("mode must be beam or single_path")
        if self.max_hops < 0 or self.max_expressway_jumps < 0:
            raise ValueError("max_hops and max_expressway_jumps must not be negative")
        if min(self.fanout, self.beam_width, self.max_visited, self.max_full_reads, self.expressway_fanout, self.path_dims) < 1:
            raise ValueError("fanout, beam_width, max_visited, max_full_reads, expressway_fanout and path_dims must be positive")
        for t in (self.read_full_threshold, self.include_threshold, self.expand_threshold, self.critical_threshold, self.expressway_threshold):
            if not 0 <= t <= 1:
                raise ValueError("thresholds must be in 0..1")


DECISION = (
    "query_id string, node_id string, parent_id string, hop int, follow double, read_full double, include double, expand double, stop double, result double, "
    "critical_score double, read_full_flag boolean, included boolean, expanded boolean, critical boolean, expressway boolean, expressway_jumps int, path array<string>"
)
FLAGS = ("critical_score", "read_full_flag", "included", "expanded", "critical", "expressway", "expressway_jumps", "path")


def node_side(nodes: DataFrame, dims: int) -> DataFrame:
    """What a traversal needs of the nodes: the effective summary at the path's length, and their own vectors."""
    return nodes.select("node_id", effective_column("summary_vector", "metadata_vector", dims).alias("eff"), vec("summary_vector").alias("summary"), vec("full_vector").alias("full"), F.coalesce("expressway", F.lit(False)).alias("expressway"))


def fetch(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of a large table whose ``on`` is among ``keys``: the keys go to the table where their measured size allows it, so that the table itself isn't shuffled."""
    return df.join(held(keys.select(*on).distinct()), on, "left_semi")


def traverse(nodes: DataFrame, edges: DataFrame, queries: DataFrame, seeds: DataFrame, config: TraversalConfig | None = None) -> DataFrame:
    """Decisions of all queries: one row for each node admitted (DECISION's columns).

    queries is (query_id, query), seeds (query_id, seed_id): several seeds of a
    query start together. Seeds are never results. A query without a seed that
    exists gives no row; repeated seeds count once; edges to unknown nodes are not
    followed. Every order ends in an id, so the result is the same for any partitioning.
    """
    c = config or TraversalConfig()
    nodes = settled(nodes.select("node_id", "summary_vector", "metadata_vector", "full_vector", "expressway") if not hasattr(nodes, "_nodeweave_path") else nodes, "nodes")
    # edges to unknown nodes go once, not in every hop
    known = edges.select("src_id", "dst_id", vec("edge_vector").alias("edge_vector"), F.col("confidence").cast("double").alias("confidence"), "created_at").join(nodes.select(F.col("node_id").alias("dst_id")), "dst_id", "left_semi")
    links = stage(known, "links")
    asked = settled(queries.select("query_id", vec("query").alias("query")), "queries")
    first = stage(seeds.select("query_id", F.col("seed_id").alias("node_id")).distinct(), "seeds")
    start = first.join(node_side(fetch(nodes, first, ["node_id"]), c.path_dims), "node_id")
    frontier = stage(
        start.select("query_id", "node_id", F.array("node_id").alias("path"), F.col("eff").alias("path_sum"), F.col("eff").alias("cur_eff"), F.lit(0).alias("jumps"), "expressway"), "frontier"
    )
    seen = frontier.select("query_id", "node_id")
    used = asked.select("query_id", F.lit(0).cast("long").alias("n_seen"), F.lit(0).cast("long").alias("n_read"))
    spark = nodes.sparkSession
    done = [spark.createDataFrame([], DECISION)]
    for hop in range(c.max_hops):
        hop_rows = stage(_hop(nodes, links, asked, frontier, seen, used, hop, c), f"hop{hop}")
        made = hop_rows.filter("admitted")
        done.append(made.select("query_id", "node_id", "parent_id", "hop", *SCORES, *FLAGS))
        if hop + 1 == c.max_hops:
            break
        spent = hop_rows.groupBy("query_id").agg(F.sum(F.col("admitted").cast("long")).alias("s"), F.sum(F.col("read_full_flag").cast("long")).alias("r"))
        used = used.join(spent, "query_id", "left").select("query_id", (F.col("n_seen") + F.coalesce("s", F.lit(0))).alias("n_seen"), (F.col("n_read") + F.coalesce("r", F.lit(0))).alias("n_read"))
        frontier = made.filter("expanded").select("query_id", "node_id", "path", "path_sum", F.col("dst_eff").alias("cur_eff"), F.col("expressway_jumps").alias("jumps"), "expressway")
        seen = seen.unionByName(made.select("query_id", "node_id"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _hop(nodes: DataFrame, links: DataFrame, asked: DataFrame, frontier: DataFrame, seen: DataFrame, used: DataFrame, hop: int, c: TraversalConfig) -> DataFrame:
    by_query = Window.partitionBy("query_id")
    at = frontier.select("query_id", F.col("node_id").alias("src_id"), "path", "path_sum", "cur_eff", "jumps", F.col("expressway").alias("src_expressway"))
    # ids first: vectors of edges and nodes are fetched only for what the fan-out lets through
    slim = links.select("src_id", "dst_id", "confidence", "created_at").join(held(at.select("query_id", "src_id", "src_expressway")), "src_id")
    slim = slim.join(held(seen.select("query_id", F.col("node_id").alias("dst_id"))), ["query_id", "dst_id"], "left_anti")
    order = [F.desc("confidence"), F.asc("created_at"), F.asc("dst_id")]
    most = max(c.fanout, c.expressway_fanout)
    slim = slim.withColumn("fan", F.row_number().over(Window.partitionBy("query_id", "src_id").orderBy(*order))).filter(F.col("fan") <= most)
    slim = slim.filter(F.col("fan") <= F.when(F.col("src_expressway"), c.expressway_fanout).otherwise(c.fanout))
    slim = slim.withColumn("seq", F.row_number().over(by_query.orderBy("src_id", *order))).filter(F.col("seq") <= c.max_visited)
    slim = slim.join(used, "query_id").filter(F.col("seq") <= c.max_visited - F.col("n_seen")).select("query_id", "src_id", "dst_id", "seq", "n_read")
    slim = stage(slim, f"fan{hop}")

    dst = node_side(fetch(nodes, slim.select(F.col("dst_id").alias("node_id")), ["node_id"]), c.path_dims)
    dst = dst.select(F.col("node_id").alias("dst_id"), F.col("eff").alias("dst_eff"), F.col("summary").alias("dst_summary"), F.col("full").alias("dst_full"), "expressway")
    full = fetch(links, slim, ["src_id", "dst_id"]).join(slim, ["src_id", "dst_id"]).join(at, ["query_id", "src_id"]).join(dst, "dst_id").join(asked, "query_id")
    full = full.withColumn("path_vector_sum", F.col("path_sum")).withColumn("trail", F.col("path")).withColumn("path", unit_column("path_sum")).withColumn("hop", F.lit(hop))
    scored = c.scorer.edge_columns(full)
    flagged = (
        scored.withColumn("result", F.coalesce(F.when(~F.isnan("result"), F.col("result")), F.col("include")))
        .withColumn("expressway_jumps", F.col("jumps") + F.col("expressway").cast("int"))
        .withColumn("critical_score", F.greatest("include", "read_full"))
        .withColumn("critical", F.col("critical_score") >= c.critical_threshold)
        .withColumn("included", (F.col("include") >= c.include_threshold) | F.col("critical"))
        .withColumn("eligible", F.col("dst_full").isNotNull() & (F.col("read_full") >= c.read_full_threshold))
        .withColumn("jump", F.col("expressway") & (F.col("expressway_jumps") <= c.max_expressway_jumps) & (F.col("follow") >= c.expressway_threshold))
        .withColumn("expanded", ((F.col("expand") >= c.expand_threshold) | F.col("jump")) & (F.col("stop") < 0.95))
    )
    so_far = by_query.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    flagged = flagged.withColumn("read_full_flag", F.col("eligible") & (F.sum(F.col("eligible").cast("int")).over(so_far) <= c.max_full_reads - F.col("n_read")))

    best = [F.desc("follow"), F.desc("confidence"), F.asc("dst_id"), F.asc("seq")]
    once = flagged.withColumn("again", F.row_number().over(Window.partitionBy("query_id", "dst_id").orderBy(*best)))
    first = F.col("again") == 1
    walk = by_query.orderBy(F.col("again") > 1, *best)
    if c.mode == "single_path":
        admitted = first & (F.row_number().over(walk) == 1)
    else:
        before = F.coalesce(F.sum(F.when(first & F.col("expanded"), 1).otherwise(0)).over(walk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        admitted = first & (before < c.beam_width)
    out = once.withColumn("admitted", admitted)
    # budgets count every candidate scored, also those the beam cuts
    return out.select(
        "query_id", F.col("dst_id").alias("node_id"), F.col("src_id").alias("parent_id"), F.lit(hop + 1).alias("hop"), *SCORES, "critical_score", "read_full_flag", "included", "expanded", "critical", "expressway", "expressway_jumps",
        F.concat("trail", F.array("dst_id")).alias("path"), F.zip_with("path_vector_sum", "dst_eff", lambda a, b: a + b).alias("path_sum"), "dst_eff", "admitted",
    )


def ranked(decisions: DataFrame) -> DataFrame:
    """The included decisions with their rank in each query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("result"), F.desc("include"), F.desc("follow"), "hop", "node_id")
    return decisions.filter("included").withColumn("included_rank", F.row_number().over(w))


def rejected(decisions: DataFrame) -> DataFrame:
    return decisions.filter("not included")


def seed_vector(nodes: DataFrame, dims: int = 16) -> DataFrame:
    """(query_id, q) of the stated query nodes at the index's length."""
    return nodes.select(F.col("node_id").alias("query_id"), resize("summary_vector", dims).alias("q"))


def preferred_first(seeds: DataFrame, preferred: DataFrame) -> DataFrame:
    """(query_id, seed_id, place): seeds (query_id, seed_id, rank) with the query's preferred one (query_id, preferred) first where it is among them; it stands alone where a query has none."""
    own = preferred.select("query_id", "preferred")
    ordered = own.join(seeds.select("query_id", "seed_id", "rank"), "query_id", "left").withColumn("seed_id", F.coalesce("seed_id", "preferred"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.col("seed_id") == F.col("preferred")), "rank", "seed_id")
    return ordered.select("query_id", "seed_id", F.row_number().over(w).alias("place"))
