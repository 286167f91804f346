"""Graph store, index, scoring, traversal and insertion over the whole graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodeweave.functions import batch as B
from nodeweave.functions import vectors as V
from nodeweave.operators import index as I
from nodeweave.operators import metrics as M
from nodeweave.operators.graph import current_nodes, edge_faults, graph, query_nodes, upsert_edges
from nodeweave.operators.models import ModelConfig, NeuralScorer
from nodeweave.operators.scorers import SCORES, HeuristicScorer, RelationScorer, bootstrap_teacher
from nodeweave.plans.insert import InsertConfig, attach, attached_edges
from nodeweave.plans.traverse import TraversalConfig, ranked, traverse
from nodeweave.session import held, stage
from nodeweave.sources.tables import table

CONFIG = I.IndexConfig()
LIMIT = 10


def _nodes(spark: SparkSession, d: str, *only: str) -> DataFrame:
    """Current nodes with the named columns, written once; all columns, as a plan, if none is named."""
    now = current_nodes(table(spark, d, "node_frame"), list(only) or None)
    return stage(now, "current_nodes") if only else now


def _topics(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, topic) of current nodes, an empty topic where there is none."""
    return current_nodes(table(spark, d, "node_frame"), ["metadata"]).select("node_id", F.coalesce(F.col("metadata")["topic"], F.lit("")).alias("topic"))


VECTORS = ("summary_vector", "metadata_vector", "full_vector", "traversal_vector", "expressway")


def node_upsert(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("node_id", "version", "expressway", F.col("full_vector").isNotNull().alias("has_full"))


def edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    return upsert_edges(table(spark, d, "edge_frame")).select("src_id", "dst_id", "version", "confidence", "created_at", "updated_at")


def edge_refused(spark: SparkSession, d: str) -> DataFrame:
    """Edges the store refuses, by reason."""
    return edge_faults(upsert_edges(table(spark, d, "edge_frame")), _nodes(spark, d)).groupBy("reason").agg(F.count("*").alias("edges"))


def edges_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Every kept edge with its place in its source's order."""
    _, e = graph(spark, d)
    return e.select("src_id", F.col("rank").cast("bigint").alias("place"), "dst_id", "confidence")


def edge_prune(spark: SparkSession, d: str) -> DataFrame:
    _, e = graph(spark, d)
    return e.groupBy("src_id").agg(F.count("*").alias("kept"), F.min("confidence").alias("weakest"))


def _eff(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", B.effective_column("summary_vector", "metadata_vector", 32).alias("eff"))


def nearest_summary(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest nodes by effective summary for every node whose number is divisible by 100."""
    n = _nodes(spark, d, "summary_vector", "metadata_vector")
    q = query_nodes(n).select(F.col("node_id").alias("query_id"), V.vec("summary_vector").alias("q"))
    return I.exact_topk(_eff(n), "node_id", "eff", q, LIMIT).select("query_id", "node_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def exact_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 10 greatest products of unit summaries for the same queries."""
    n = _nodes(spark, d, "summary_vector")
    unit = n.select("node_id", B.unit_column("summary_vector").alias("v"))
    q = query_nodes(n).select(F.col("node_id").alias("query_id"), V.normalize("summary_vector").alias("q"))
    return I.exact_topk(unit, "node_id", "v", q, LIMIT, cosine=False).select("query_id", "node_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _index(nodes: DataFrame) -> tuple[DataFrame, DataFrame, I.IndexConfig]:
    """(vectors, bucket rows, config) of all nodes at the index's length; a large graph gets more bits than a small one."""
    v = stage(nodes.select(F.col("node_id").alias("id"), I.index_vector(nodes, CONFIG).alias("v")).filter("v is not null"), "index_vectors")
    config = I.IndexConfig.sized(v.count())
    return v, I.buckets(v, "id", F.col("v"), config), config


def lsh_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _index(_nodes(spark, d, "summary_vector", "traversal_vector"))[1]


def lsh_replace(spark: SparkSession, d: str) -> DataFrame:
    """Rows by table after the decoys were added again with their vectors negated and the hubs removed."""
    n = _nodes(spark, d, "summary_vector", "traversal_vector", "metadata", "expressway")
    v, b, config = _index(n)
    decoys = n.filter(F.col("metadata")["kind"] == "decoy").select("node_id")
    again = v.join(decoys.withColumnRenamed("node_id", "id"), "id", "left_semi").select("id", V.negate("v").alias("v"))
    gone = n.filter("expressway").select(F.col("node_id").alias("id"))
    after = I.replace_buckets(b, I.buckets(again, "id", F.col("v"), config), gone)
    return after.groupBy("table_id", "bucket_id").agg(F.count("*").alias("nodes"))


def _lsh(nodes: DataFrame, limit: int) -> DataFrame:
    v, b, config = _index(nodes)
    q = stage(query_nodes(nodes).select(F.col("node_id").alias("id"), V.resize("summary_vector", CONFIG.dims).alias("v")), "index_queries")
    return I.query_index(b, v, q.select(F.col("id").alias("query_id"), F.col("v").alias("q")), I.buckets(q, "id", F.col("v"), config), CONFIG.tables, limit)


def lsh_query(spark: SparkSession, d: str) -> DataFrame:
    return _lsh(_nodes(spark, d, "summary_vector", "traversal_vector"), LIMIT).select("query_id", "node_id", F.round("score", 6).alias("score"), "matches", F.col("rank").cast("bigint").alias("rank"))


def lsh_seeds(spark: SparkSession, d: str) -> DataFrame:
    return _lsh(_nodes(spark, d, "summary_vector", "traversal_vector"), 4).select("query_id", "node_id")


def seed_fill(spark: SparkSession, d: str) -> DataFrame:
    """Four seeds a query: from the index, then the nearest summaries for what is missing."""
    n = _nodes(spark, d, "summary_vector", "metadata_vector", "traversal_vector")
    first = _lsh(n, 4).select("query_id", "node_id", F.lit(0).alias("tier"), "rank")
    q = query_nodes(n).select(F.col("node_id").alias("query_id"), V.vec("summary_vector").alias("q"))
    rest = I.exact_topk(_eff(n), "node_id", "eff", q, 4).select("query_id", "node_id", F.lit(1).alias("tier"), "rank")
    once = first.unionByName(rest).groupBy("query_id", "node_id").agg(F.min(F.struct("tier", "rank")).alias("t"))
    w = Window.partitionBy("query_id").orderBy("t", "node_id")
    return once.withColumn("place", F.row_number().over(w).cast("bigint")).filter("place <= 4").select("query_id", "node_id", "place")


def _edge_rows(spark: SparkSession, d: str) -> DataFrame:
    """Scorer input for every kept edge: its source's summary is the query and its source the path. Vectors travel as for attaching."""
    _, e = graph(spark, d)
    n = current_nodes(table(spark, d, "node_frame"), ["summary_vector", "full_vector", "metadata_vector"])
    side = stage(n.select("node_id", B.effective_column("summary_vector", "metadata_vector", 32).alias("eff"), F.col("summary_vector").alias("summary"), F.col("full_vector").alias("full")).withColumn("path", B.unit_column("eff")), "nodes")
    src = side.select(F.col("node_id").alias("src_id"), F.col("summary").alias("query"), F.col("eff").alias("cur_eff"), "path")
    dst = side.select(F.col("node_id").alias("dst_id"), F.col("eff").alias("dst_eff"), F.col("summary").alias("dst_summary"), F.col("full").alias("dst_full"))
    r = e.select("src_id", "dst_id", "edge_vector", "confidence").join(src, "src_id").join(dst, "dst_id")
    double = ("edge_vector", "query", "dst_summary", "dst_full")
    return r.select(*[V.vec(c).alias(c) if c in double else c for c in r.columns]).withColumn("hop", F.lit(0))


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(s, 6).alias(s) for s in SCORES])


def score_edge(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(HeuristicScorer().edge_columns(_edge_rows(spark, d)), "src_id", "dst_id")


def score_relation(spark: SparkSession, d: str) -> DataFrame:
    r = _edge_rows(spark, d)
    for name in ("query", "dst_summary", "path"):
        r = r.withColumn(name, B.resize_column(name, 16))
    return _rounded(RelationScorer().edge_columns(r), "src_id", "dst_id")


#: The models of the queries below; the perceptron is small enough to be written out in SQL.
MLP = NeuralScorer.seeded(ModelConfig(hidden_dim=6, attach_hidden_dim=5))
TRANSFORMER = NeuralScorer.seeded(ModelConfig(model_kind="transformer", hidden_dim=64, attach_hidden_dim=64, attach_head_kind="hybrid", traversal_output_dim=5), seed=4)


def score_mlp(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(MLP.edge_columns(_edge_rows(spark, d)), "src_id", "dst_id")


def score_transformer(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(TRANSFORMER.edge_columns(_edge_rows(spark, d)), "src_id", "dst_id")


def attach_mlp(spark: SparkSession, d: str) -> DataFrame:
    return MLP.attach_column(_attach_rows(spark, d)).select("src_id", "dst_id", F.round("attach", 6).alias("attach"))


def attach_transformer(spark: SparkSession, d: str) -> DataFrame:
    return TRANSFORMER.attach_column(_attach_rows(spark, d)).select("src_id", "dst_id", F.round("attach", 6).alias("attach"))


def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap teacher of every kept edge, same topic meaning the same topic as the source."""
    n = current_nodes(table(spark, d, "node_frame"), ["metadata"]).select("node_id", F.col("metadata")["topic"].alias("topic"))
    r = _edge_rows(spark, d).join(n.select(F.col("node_id").alias("src_id"), F.col("topic").alias("st")), "src_id").join(n.select(F.col("node_id").alias("dst_id"), F.col("topic").alias("dt")), "dst_id")
    r = r.withColumn("same_topic", F.when(F.col("st") == F.col("dt"), 1.0).otherwise(0.0))
    return bootstrap_teacher(r).select("src_id", "dst_id", *[F.round(s, 6).alias(s) for s in ("follow", "read_full", "include", "expand", "stop")])


def _attach_rows(spark: SparkSession, d: str) -> DataFrame:
    """Attach input for every kept edge. Vectors travel as they were delivered, often in float, and are double once they are joined."""
    _, e = graph(spark, d)
    n = current_nodes(table(spark, d, "node_frame"), ["summary_vector", "full_vector", "metadata_vector", "traversal_vector"])
    sides = stage(n.select("node_id", B.effective_column("summary_vector", "metadata_vector", 32).alias("eff"), F.col("summary_vector").alias("summary"), F.col("full_vector").alias("full"), F.col("traversal_vector").alias("route")).withColumn("path", B.unit_column("eff")), "sides")

    def side(prefix: str, key: str) -> DataFrame:
        return sides.select(F.col("node_id").alias(key), *[F.col(c).alias(f"{prefix}_{c}") for c in ("eff", "summary", "full", "route")], *([F.col("path")] if prefix == "cand" else []))

    r = e.select("src_id", "dst_id").join(side("new", "src_id"), "src_id").join(side("cand", "dst_id"), "dst_id")
    return r.select(*[c if c.endswith("_id") else V.vec(c).alias(c) for c in r.columns])


def score_attach(spark: SparkSession, d: str) -> DataFrame:
    """Every kept edge's ends as a new node and its candidate, the candidate being the path."""
    return HeuristicScorer().attach_column(_attach_rows(spark, d)).select("src_id", "dst_id", F.round("attach", 6).alias("attach"))


def score_relation_attach(spark: SparkSession, d: str) -> DataFrame:
    return RelationScorer().attach_column(_attach_rows(spark, d)).select("src_id", "dst_id", F.round("attach", 6).alias("attach"))


def _traversal(spark: SparkSession, d: str, seeds: str = "self", **config) -> DataFrame:
    _, e = graph(spark, d)
    n = _nodes(spark, d, *VECTORS)
    q = query_nodes(n)
    asked = q.select(F.col("node_id").alias("query_id"), F.col("summary_vector").alias("query"))
    start = q.select(F.col("node_id").alias("query_id"), F.col("node_id").alias("seed_id")) if seeds == "self" else _lsh(n, 4).select("query_id", F.col("node_id").alias("seed_id"))
    return traverse(n, e, asked, start, TraversalConfig(**({"max_hops": 2} | config)))


def _shown(decisions: DataFrame) -> DataFrame:
    return decisions.select(
        "query_id", "node_id", "parent_id", "hop", F.round("follow", 6).alias("follow"), F.round("result", 6).alias("result"), "read_full_flag", "included", "expanded", "critical", "expressway_jumps", F.array_join("path", ">").alias("path")
    )


#: Configurations of the traversal queries; each shows one budget or mode at work.
TRAVERSALS = {
    "traverse_beam": {}, "traverse_single_path": {"mode": "single_path"}, "traverse_expressway": {"expressway_fanout": 24, "expressway_threshold": 0.5, "expand_threshold": 0.6, "max_expressway_jumps": 1, "fanout": 4},
    "traverse_read_full": {"max_full_reads": 3, "read_full_threshold": 0.6}, "traverse_max_visited": {"max_visited": 9}, "traverse_indexed": {"seeds": "index", "fanout": 6, "beam_width": 6},
}


def _traverse_query(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _shown(_traversal(spark, d, **TRAVERSALS[name]))

    return run


def traverse_included(spark: SparkSession, d: str) -> DataFrame:
    return ranked(_traversal(spark, d)).select("query_id", "node_id", F.col("included_rank").cast("bigint").alias("included_rank"))


def traverse_rejected(spark: SparkSession, d: str) -> DataFrame:
    return _traversal(spark, d).filter("not included").select("query_id", "node_id")


def _deliveries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, new): the query nodes are taken out of the graph and delivered again as new."""
    _, e = graph(spark, d)
    n = _nodes(spark, d, *VECTORS)
    new = stage(query_nodes(n), "delivered")
    return n.join(held(new.select("node_id")), "node_id", "left_anti"), e, new


def insert_attach(spark: SparkSession, d: str) -> DataFrame:
    old, e, new = _deliveries(spark, d)
    got = attach(old, e, new, InsertConfig(traversal=TraversalConfig(max_hops=1)))
    return got.select("new_id", "node_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def insert_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges both ways that attaching makes."""
    old, e, new = _deliveries(spark, d)
    got = attach(old, e, new, InsertConfig(traversal=TraversalConfig(max_hops=1)))
    return attached_edges(old, new, got).select("src_id", "dst_id", V.rounded("edge_vector").alias("edge_vector"), F.round("confidence", 6).alias("confidence"))


def eval_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The index's 10 against the exact 10 by traversal vector, per query."""
    n = _nodes(spark, d, "summary_vector", "traversal_vector")
    v = n.select("node_id", I.index_vector(n, CONFIG).alias("v"))
    q = query_nodes(n).select(F.col("node_id").alias("query_id"), V.resize("summary_vector", CONFIG.dims).alias("q"))
    exact = I.exact_topk(v, "node_id", "v", q, LIMIT).select("query_id", "node_id")
    return M.retrieval(_lsh(n, LIMIT).select("query_id", "node_id", "rank"), exact, LIMIT)


def _methods(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, node_id, rank, method): what each method returns, best first, over the stated queries."""
    n = _nodes(spark, d, *VECTORS)
    q = query_nodes(n).select(F.col("node_id").alias("query_id"), V.vec("summary_vector").alias("q"))
    exact = I.exact_topk(_eff(n), "node_id", "eff", q, LIMIT).select("query_id", "node_id", "rank", F.lit("exact").alias("method"))
    by_index = _lsh(n, LIMIT).select("query_id", "node_id", "rank", F.lit("index").alias("method"))
    walk = ranked(_traversal(spark, d, "index", fanout=6, beam_width=6)).filter(F.col("included_rank") <= LIMIT)
    return exact.unionByName(by_index).unionByName(walk.select("query_id", "node_id", F.col("included_rank").alias("rank"), F.lit("traversal").alias("method")))


def compare_methods(spark: SparkSession, d: str) -> DataFrame:
    """Share of a query's topic among what each method returns: exact search, the index, and index-seeded traversal."""
    topics = _topics(spark, d)
    rows = _methods(spark, d).join(topics, "node_id").join(topics.select(F.col("node_id").alias("query_id"), F.col("topic").alias("wanted")), "query_id")
    return rows.groupBy("method").agg(F.count("*").alias("returned"), F.countDistinct("query_id").alias("queries"), F.round(F.avg((F.col("topic") == F.col("wanted")).cast("double")), 6).alias("same_topic"))


def indexed_purity(spark: SparkSession, d: str) -> DataFrame:
    """Topic purity of what an index-seeded traversal includes; a query without results has 0."""
    topics = _topics(spark, d)
    asked = query_nodes(topics).select(F.col("node_id").alias("query_id"), F.col("topic").alias("wanted"))
    got = _traversal(spark, d, "index", fanout=6, beam_width=6).filter("included").select("query_id", "node_id").join(topics, "node_id")
    hits = asked.join(got, "query_id", "left").groupBy("query_id").agg(F.count("node_id").alias("included"), F.sum((F.col("topic") == F.col("wanted")).cast("int")).alias("same"))
    return hits.select("query_id", "included", F.round(F.coalesce(F.col("same") / F.col("included"), F.lit(0.0)), 6).alias("purity"))


def topic_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """For every query node: its 4 nearest nodes of the same topic and 6 nearest of other topics, itself left out after the cut."""
    n = stage(current_nodes(table(spark, d, "node_frame"), ["summary_vector", "metadata"]).select("node_id", "summary_vector", F.coalesce(F.col("metadata")["topic"], F.lit("")).alias("topic")), "topical_nodes")
    q = query_nodes(n).select(F.col("node_id").alias("query_id"), F.col("summary_vector").alias("q"), "topic")
    found = I.exact_topk(n, "node_id", "summary_vector", q, 4, group="topic", others=6).filter("query_id <> node_id")
    reason = F.when(F.col("same"), "nearest_target_topic_candidate").otherwise("lexical_hard_negative_candidate")
    return found.select("query_id", "node_id", reason.alias("reason"), F.col("rank").cast("bigint").alias("place"))


def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of every query node from its own edges, its topic and other topics; the first source names the reason."""
    _, e = graph(spark, d)
    q = query_nodes(current_nodes(table(spark, d, "node_frame"), ["version"])).select("node_id")
    own = e.join(q, F.col("src_id") == F.col("node_id"), "left_semi").select(F.col("src_id").alias("parent_id"), "dst_id", "confidence", F.lit(0).alias("tier"), F.lit("outgoing_seed_edge").alias("reason"))
    near = topic_neighbors(spark, d)
    lexical = F.col("reason") == "lexical_hard_negative_candidate"
    more = near.select(F.col("query_id").alias("parent_id"), F.col("node_id").alias("dst_id"), F.when(lexical, 0.58).otherwise(0.82).alias("confidence"), F.when(lexical, 2).otherwise(1).alias("tier"), "reason")
    best = own.unionByName(more).groupBy("parent_id", "dst_id").agg(F.min(F.struct("tier", "confidence", "reason")).alias("b"))
    return best.select("parent_id", "dst_id", F.col("b.confidence").alias("confidence"), F.col("b.reason").alias("reason"))


def quota_topk(spark: SparkSession, d: str, limit: int = 12) -> DataFrame:
    """Twelve candidates a parent: first each quoted reason's share, then the most confident of the rest."""
    order = [F.desc("confidence"), F.asc("dst_id")]
    quota = F.when(F.col("reason") == "nearest_target_topic_candidate", max(2, limit // 4)).when(F.col("reason") == "lexical_hard_negative_candidate", max(3, limit // 3)).otherwise(0)
    c = candidate_union(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("parent_id", "reason").orderBy(*order)))
    tier = F.when((F.col("r") <= quota) & (F.col("reason") == "nearest_target_topic_candidate"), 0).when(F.col("r") <= quota, 1).otherwise(2)
    w = Window.partitionBy("parent_id").orderBy("tier", *order)
    return c.withColumn("tier", tier).withColumn("place", F.row_number().over(w).cast("bigint")).filter(F.col("place") <= limit).select("parent_id", "dst_id", "reason", "place")


def queries() -> dict:
    plain = (
        node_upsert, edge_upsert, edge_refused, edges_ordered, edge_prune, nearest_summary, exact_topk, lsh_buckets, lsh_replace, lsh_query, lsh_seeds, seed_fill, score_edge, score_relation, score_mlp, score_transformer, attach_mlp, attach_transformer,
        score_attach, score_relation_attach, traverse_included, traverse_rejected, insert_attach, insert_edges, eval_retrieval, compare_methods, indexed_purity, topic_neighbors, candidate_union, quota_topk,
    )
    return {f.__name__: f for f in plain} | {"bootstrap_teacher": bootstrap} | {name: _traverse_query(name) for name in TRAVERSALS}


def oracle_sql() -> dict[str, str]:
    from nodeweave.queries.graph_sql import oracle_sql as sql

    return sql()
