"""Training rows, draws, labels, prompts and comparisons over whole tables, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodeweave.functions import batch as B
from nodeweave.functions import vectors as V
from nodeweave.operators import learning as L
from nodeweave.operators import metrics as M
from nodeweave.operators.graph import current_nodes, graph, query_nodes
from nodeweave.operators.models import ModelConfig, split_inputs
from nodeweave.operators.scorers import CountingScorer, HeuristicScorer, attach_gate, edge_targets
from nodeweave.plans.insert import InsertConfig, attach
from nodeweave.plans.traverse import TraversalConfig, preferred_first, traverse
from nodeweave.queries import graph_queries as G
from nodeweave.queries.graph_sql import BASE, NEAR, QUERIES, RANKED, lsh, topk, traversal
from nodeweave.queries.metric_queries import action_target, candidates, metric_rows
from nodeweave.queries.sqlx import CANDIDATES, NODES, clamp, cos01, is_query, r6, unit
from nodeweave.session import spread, stage
from nodeweave.sources.tables import table

WIDTHS = [32, 32, 16, 32, 32, 2]
PARTS = ["query", "current_summary", "edge", "dst_summary", "path", "scalars"]
KS = (1, 3, 5, 10)
DRAWN = 5


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    return current_nodes(table(spark, d, "node_frame"), ["summary_vector"])


def vec_checked(spark: SparkSession, d: str) -> DataFrame:
    """Length of every summary; a vector that is empty or of another length than 32 would fail the query."""
    return _summaries(spark, d).select("node_id", F.round(V.norm(V.checked("summary_vector", 32)), 6).alias("norm"))


def vec_noisy(spark: SparkSession, d: str) -> DataFrame:
    """Every summary with a little noise, and a random direction, both drawn by the node's id."""
    n = stage(_summaries(spark, d).select("node_id", L.noisy_vector("summary_vector", "node_id", 0.05, 32, seed=DRAWN).alias("noisy"), L.random_vector("node_id", 8, seed=DRAWN).alias("random")), "drawn")
    return n.select("node_id", V.rounded(B.unit_column("noisy")).alias("noisy"), V.rounded(B.unit_column("random")).alias("random"))


def _with_features(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).withColumn("features", L.edge_features())


def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    """One training row for each candidate: its features, target of six values and weight."""
    target = L.six_targets(F.col("oracle"))
    return _with_features(spark, d).select("case_id", "idx", V.rounded("features").alias("features"), V.rounded(target).alias("target"), F.round(F.coalesce("weight", F.lit(1.0)), 6).alias("weight"))


def feature_parts(spark: SparkSession, d: str) -> DataFrame:
    """Features cut back into their parts."""
    parts = _with_features(spark, d).select("case_id", "idx", *split_inputs("features", ModelConfig().edge_widths()[:6], PARTS))
    return parts.select("case_id", "idx", V.rounded("edge").alias("edge"), V.rounded("scalars").alias("scalars"), *[F.round(V.norm(p), 6).alias(p) for p in ("query", "current_summary", "dst_summary", "path")])


def ranking_groups(spark: SparkSession, d: str) -> DataFrame:
    """One training group for each case: labels and weights of its candidates in order."""
    c = candidates(spark, d)
    one = F.struct("idx", F.coalesce("result_rank_target", "rank_target", F.col("label0").cast("double")).alias("label"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
    # a case's candidates came as one array
    groups = c.groupBy("case_id").agg(F.array_sort(F.collect_list(one)).alias("x"))
    return groups.select("case_id", V.rounded(F.col("x.label")).alias("labels"), V.rounded(F.col("x.weight")).alias("weights"))


def candidate_weights(spark: SparkSession, d: str) -> DataFrame:
    """Candidates and their mean weight by kind, where candidates that share a half with the right one count more."""
    w = F.coalesce("weight", F.lit(1.0)) * L.kind_weight("kind", 2.0, 3.0)
    return candidates(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(w), 6).alias("weight"))


def attach_targets(spark: SparkSession, d: str) -> DataFrame:
    """The attach target of every kept edge's ends by summaries, full vectors (the summaries' match where one is missing) and path."""
    rows = G._attach_rows(spark, d)

    def score(ns, cs, nf, cf, path):
        s = B.cosine01(ns, cs)
        return {"s": s, "f": np.where(nf.there & cf.there, B.cosine01(nf, cf), s), "p": B.cosine01(path, cs)}

    sims = B.with_scores(rows, ["new_summary", "cand_summary", "new_full", "cand_full", "path"], [], ["s", "f", "p"], score)
    return sims.select("src_id", "dst_id", F.round(attach_gate(F.col("s"), F.col("f"), F.col("p")), 6).alias("target"))


def eval_oracle(spark: SparkSession, d: str) -> DataFrame:
    return M.by_oracle(metric_rows(spark, d))


def eval_pairwise_oracle(spark: SparkSession, d: str) -> DataFrame:
    return M.pairwise_by_oracle(metric_rows(spark, d))


def eval_action_metrics(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of each action whose target every candidate carries."""
    t = edge_targets(candidates(spark, d)).withColumn("result", F.col("include"))
    heads = ("follow", "read_full", "include", "expand", "stop", "result")
    long = t.select("case_id", "idx", F.explode(F.array(*[F.struct(F.lit(h).alias("action"), F.round(h, 6).alias("score"), action_target(i).alias("target")) for i, h in enumerate(heads)])).alias("x"))
    return M.actions(long.select("case_id", "idx", "x.*"))


def eval_target_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of clearly different targets among about 200,000 drawn from all candidates, and those the scores order alike."""
    return M.target_pairwise_sampled(metric_rows(spark, d).withColumn("target", F.col("oracle")))


def sample_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Three nodes of each topic, drawn by hash."""
    return L.picked(G._topics(spark, d), 3, "node_id", ["topic"], seed=DRAWN).select("topic", "node_id", F.col("place").cast("bigint").alias("place"))


def distractors(spark: SparkSession, d: str, n: int = 4) -> DataFrame:
    """For every domain of episodes the n nodes of other domains that come first in a draw.

    A domain's own n first nodes are all that any other domain can take from it, so
    domains meet a few rows of each other and never all nodes.
    """
    nodes = G._topics(spark, d).filter("topic <> ''").select("node_id", F.substring_index("topic", ":", 1).alias("domain"))
    first = stage(L.picked(nodes, n, "node_id", ["domain"], seed=DRAWN), "first")
    domains = first.select(F.col("domain").alias("own")).distinct()
    draw = F.md5(F.concat(F.lit(f"{DRAWN}|"), "node_id"))
    w = Window.partitionBy("own").orderBy(draw, "node_id")
    met = domains.join(F.broadcast(first), F.col("own") != F.col("domain"))
    return met.withColumn("place", F.row_number().over(w).cast("bigint")).filter(F.col("place") <= n).select("own", "node_id", "domain", "place")


def deal_episodes(spark: SparkSession, d: str, episodes: int = 1000) -> DataFrame:
    """Episodes dealt to domains in turn, in a domain to its topics in turn, and again as further variants."""
    topics = table(spark, d, "node_frame").select(F.col("metadata")["topic"].alias("query")).filter("query is not null").distinct().withColumn("domain", F.substring_index("query", ":", 1))
    own = Window.partitionBy("domain")
    # names only: far fewer than the table's rows
    q = stage(topics.withColumn("j", F.row_number().over(own.orderBy("query")) - 1).withColumn("q", F.count("*").over(own)), "topics")
    doms = q.select("domain", "q").distinct().withColumn("k", F.row_number().over(Window.orderBy("domain")) - 1)
    n = q.select("domain").distinct().count()
    if not n:
        return q.select(F.lit(0).cast("bigint").alias("episode"), "domain", "query", F.lit(0).cast("bigint").alias("variant"))
    i = spark.range(episodes).select(F.col("id").alias("episode"), F.pmod("id", F.lit(n)).cast("int").alias("k"), F.floor(F.col("id") / n).alias("turn"))
    dealt = i.join(doms, "k").withColumn("j", F.pmod("turn", "q").cast("int")).withColumn("variant", F.floor(F.col("turn") / F.col("q")).cast("bigint"))
    return dealt.drop("q").join(q.select("domain", "j", "query"), ["domain", "j"]).select("episode", "domain", "query", "variant")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """(id, answer, known): what a teacher said of each episode, made of the scores its labelled candidates carry, within a code fence."""
    e = table(spark, d, "teacher_episode").filter("id is not null").dropDuplicates(["id"])
    said = F.transform(F.filter("candidates", lambda c: c.isNotNull() & c["qwen_teacher"].isNotNull()), lambda c: F.struct(c["id"].alias("id"), *[(c["qwen_teacher"][t] * 2.0).alias(t) for t in L.TARGETS]))
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(said.alias("candidates"))), F.lit("\n```"))
    return e.filter("candidates is not null").select("id", answer.alias("answer"), F.transform(F.filter("candidates", lambda c: c.isNotNull()), lambda c: c["id"]).alias("known"), "candidates")


def labels_read(spark: SparkSession, d: str) -> DataFrame:
    """All five scores read back from teachers' answers."""
    got = L.read_labels(_answers(spark, d))
    return got.select("id", "candidate_id", *[F.round(t, 6).alias(t) for t in L.TARGETS])


def labels_missing(spark: SparkSession, d: str) -> DataFrame:
    """Answers that leave out candidates they were asked for, with how many and the first of them."""
    return L.label_faults(_answers(spark, d)).select("id", F.size("missing").alias("n"), F.array_min("missing").alias("first"))


def labels_applied(spark: SparkSession, d: str) -> DataFrame:
    """The labels put into the episodes, one row for each candidate."""
    a = stage(_answers(spark, d), "answers")
    e = L.apply_labels(a.select("id", "candidates"), L.read_labels(a))
    return e.select("id", F.posexplode("candidates").alias("idx", "c")).filter("c is not null").select("id", "idx", *[F.round(f"c.qwen_teacher.{t}", 6).alias(t) for t in L.TARGETS])


def build_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The whole prompt of every episode that has a query, a current node, a path and candidates."""
    e = table(spark, d, "teacher_episode").filter("id is not null").dropDuplicates(["id"]).filter("trim(query) <> '' and current_node is not null and path is not null and candidates is not null")
    return e.select("id", L.build_prompt().alias("prompt"))


def _echo(address: str, prompt: str) -> str:
    """A teacher for tests: the first address is down, the second follows nothing."""
    import json

    if address == "first":
        raise OSError("no answer")
    task = json.loads(prompt.split("Task JSON:\n", 1)[1])
    return json.dumps({"candidates": [{"id": c["id"], **dict.fromkeys(L.TARGETS, 0.25)} for c in task["candidates"]]})


def teacher_asked(spark: SparkSession, d: str) -> DataFrame:
    """Every prompt put to an injected teacher: addresses tried, and labels that came back for all candidates."""
    p = stage(build_prompt(spark, d), "prompts")
    got = stage(L.ask_teacher(spread(p), _echo, ("first", "second")), "asked")
    known = table(spark, d, "teacher_episode").dropDuplicates(["id"]).select("id", F.transform(F.filter("candidates", lambda c: c.isNotNull()), lambda c: c["id"]).alias("known"))
    labels = L.read_labels(got.join(known, "id")).groupBy("id").agg(F.count("*").alias("labels"), F.round(F.avg("follow"), 6).alias("follow"))
    return got.join(labels, "id", "left").select("id", "attempts", F.coalesce("labels", F.lit(0)).alias("labels"), "follow")


def seeds_preferred(spark: SparkSession, d: str) -> DataFrame:
    """Seeds from the index, the query's own node first where it is among them, alone where there is none."""
    seeds = G._lsh(G._nodes(spark, d, "summary_vector", "traversal_vector"), 4).select("query_id", F.col("node_id").alias("seed_id"), "rank")
    own = query_nodes(_summaries(spark, d)).select(F.col("node_id").alias("query_id"), F.col("node_id").alias("preferred"))
    return preferred_first(seeds, own).select("query_id", "seed_id", F.col("place").cast("bigint").alias("place"))


def compare_hits(spark: SparkSession, d: str) -> DataFrame:
    """Precision and hits at several cuts of exact search, the index and index-seeded traversal, a node of the query's topic being right."""
    returned = stage(G._methods(spark, d), "returned")
    topics = G._topics(spark, d)
    q = query_nodes(topics).select(F.col("node_id").alias("query_id"), F.col("topic").alias("wanted"))
    # right is told for what was returned, and for the query itself, so that no topic is listed whole
    named = returned.select("query_id", "node_id").distinct().join(q, "query_id").join(topics, "node_id").filter("topic = wanted").select("query_id", "node_id")
    relevant = named.unionByName(q.select("query_id", F.col("query_id").alias("node_id"))).distinct()
    return M.hits_at(returned, relevant, KS)


def score_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often a traversal called its scorer and how many candidates it scored."""
    _, e = graph(spark, d)
    n = G._nodes(spark, d, *G.VECTORS)
    q = query_nodes(n)
    counting = CountingScorer(HeuristicScorer())
    traverse(n, e, q.selectExpr("node_id query_id", "summary_vector query"), q.selectExpr("node_id query_id", "node_id seed_id"), TraversalConfig(max_hops=2, scorer=counting))
    return spark.createDataFrame([tuple(counting.counts().values())], "calls bigint, candidates bigint")


def traverse_default(spark: SparkSession, d: str) -> DataFrame:
    """The traversal with all defaults, three hops."""
    return G._shown(G._traversal(spark, d, max_hops=TraversalConfig.max_hops))


def insert_attach_deep(spark: SparkSession, d: str) -> DataFrame:
    """Insertion with all defaults: the query nodes taken out and attached again after three hops."""
    old, e, new = G._deliveries(spark, d)
    return attach(old, e, new, InsertConfig()).select("new_id", "node_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def eval_attach_cases(spark: SparkSession, d: str) -> DataFrame:
    """Ranking metrics of the attach scorer over every node's edges as a case of at most 16 candidates; a target of 0.65 or more is right."""
    rows = attach_targets(spark, d).join(HeuristicScorer().attach_column(G._attach_rows(spark, d)).select("src_id", "dst_id", "attach"), ["src_id", "dst_id"])
    place = F.row_number().over(Window.partitionBy("src_id").orderBy("dst_id"))
    cases = rows.withColumn("idx", place - 1).filter("idx < 16").select(F.col("src_id").alias("case_id"), "idx", F.round("attach", 6).alias("score"), (F.col("target") >= 0.65).cast("int").alias("label"), F.lit("edge").alias("kind"))
    cases = stage(cases, "attach_cases")
    at = M.at_threshold(cases)
    one = M.mrr(cases)
    return at.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("precision", "recall", "f1")])).alias("x")).select("x.*").unionByName(
        one.select(F.lit("mrr").alias("metric"), F.col("mrr").alias("value"))
    )


def shard_progress(spark: SparkSession, d: str) -> DataFrame:
    """Each file of raw episodes as a shard: its name in order, lines, status against the most lines of any, and the tail of its last line."""
    r = table(spark, d, "raw_episode")
    files = r.groupBy("source_file").agg(F.count("*").alias("lines"), F.max(F.struct("line_no", "raw_id", F.expr("right(coalesce(body, ''), 3000)").alias("tail")))["tail"].alias("tail"))
    # one row a file
    whole = Window.partitionBy(F.lit(1))
    number = F.row_number().over(whole.orderBy("source_file")) - 1
    status = F.when(F.col("lines") < F.max("lines").over(whole), "partial").otherwise("complete")
    return files.select("source_file", F.concat(F.lit("episodes_"), F.lpad(number.cast("string"), 3, "0"), F.lit(".jsonl")).alias("shard"), "lines", status.alias("status"), F.length("tail").alias("tail_length"))


def scan_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Edges written as JSON lines of eight shards and read back with their file's shard, files in order of name: rows and range of sources of each."""
    from nodeweave.sources.jsonl import read_in_file_order, write_jsonl

    e = table(spark, d, "edge_frame").select("src_id", "dst_id", "version").withColumn("shard", F.pmod(F.length("src_id") + F.col("version"), F.lit(3)).cast("int"))
    path = write_jsonl(e, "shard", "edges")
    rows = read_in_file_order(spark, f"{path}/shard=*", "src_id string, dst_id string, version int")
    return rows.withColumn("shard", F.regexp_extract("folder", "shard=([0-9]+)", 1).cast("int")).groupBy("shard").agg(F.count("*").alias("edges"), F.min("src_id").alias("first"), F.max("src_id").alias("last"))


def queries() -> dict:
    return {
        f.__name__: f for f in (
            vec_checked, vec_noisy, feature_rows, feature_parts, ranking_groups, candidate_weights, attach_targets, eval_oracle, eval_pairwise_oracle, eval_action_metrics, eval_target_sampled, sample_nodes, distractors,
            deal_episodes, labels_read, labels_missing, labels_applied, build_prompt, teacher_asked, seeds_preferred, compare_hits, score_counts, traverse_default, insert_attach_deep, eval_attach_cases, shard_progress, scan_ordered,
        )
    }


def _even(keys: str, part: int) -> str:
    return f"((('0x' || substr(md5({keys}), {1 + 8 * part}, 8))::BIGINT + 0.5e0) / 4294967296e0)"


def _bell(key: str, i: str) -> str:
    keys = f"'{DRAWN}|' || {key} || '|' || {i}"
    return f"(sqrt(-2e0 * ln({_even(keys, 0)})) * cos(2e0 * pi() * {_even(keys, 1)}))"


def oracle_sql() -> dict[str, str]:
    from nodeweave.queries.graph_queries import CONFIG, LIMIT
    from nodeweave.queries.graph_sql import _attach_rows

    def w(ctes: str, tail: str) -> str:
        return f"WITH {ctes} {tail}"

    index = lsh(CONFIG)
    by_index = "SELECT query_id, node_id AS seed_id FROM hits WHERE rank <= 4"
    topics = "tp AS (SELECT node_id, coalesce(metadata['topic'], '') AS topic FROM nodes)"
    feats = "query || current_summary || edge || dst_summary || path || [" + clamp("confidence") + ", " + clamp("hop / 3e0") + "]"
    names = "SELECT DISTINCT metadata['topic'] AS query, split_part(metadata['topic'], ':', 1) AS domain FROM node_frame WHERE metadata['topic'] IS NOT NULL"
    five = ("follow", "read_full", "include", "expand", "stop")
    once = "once AS (SELECT * FROM teacher_episode WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1)"
    cand = f"{once}, c AS (SELECT id, unnest(candidates) AS c, unnest(range(0, len(candidates)))::INT AS idx FROM once WHERE candidates IS NOT NULL), k AS (SELECT * FROM c WHERE c IS NOT NULL)"
    lab = f"{cand}, lb AS (SELECT id, c.id AS candidate_id, " + ", ".join(f"{clamp(f'c.qwen_teacher.{t} * 2e0')} AS {t}" for t in five) + " FROM k WHERE c.qwen_teacher IS NOT NULL AND c.id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, c.id ORDER BY idx DESC) = 1)"
    heads = (
        ("follow", "follow", "coalesce(oracle[1], rank_target, label0)"), ("read_full", "rf", "oracle[2]"), ("include", "include", "oracle[3]"), ("expand", "ex", "oracle[4]"), ("stop", "greatest(0, least(1, 1 - ex))", "oracle[5]"), ("result", "include", "result_target"),
    )
    act = "act AS (SELECT *, greatest(0, least(1, 0.75 * include + 0.25 * follow)) rf, greatest(0, least(1, 0.8 * follow + 0.2 * c2d - 0.05 * hop)) ex FROM tgt), l0 AS (" + " UNION ALL ".join(f"SELECT '{h}' AS action, round({s}, 6) AS x, {t} AS target FROM act" for h, s, t in heads) + "), l AS (SELECT action, coalesce(x, 0) AS x, round(coalesce(x, 0) * 1000000)::BIGINT AS s, target, (target >= 0.65)::INT AS label FROM l0 WHERE action NOT IN (SELECT action FROM l0 WHERE target IS NULL))"
    small = TraversalConfig(max_hops=2, fanout=6, beam_width=6)
    walk = f"{BASE}, {QUERIES}, {index}, {traversal(small, by_index)}, {RANKED}"
    gate = "least(s, f)"

    def text(x: str, new: str = "") -> str:
        return f"{new or x.split('.')[-1]} := coalesce({x}, '')"

    def terms(x: str, name: str) -> str:
        return f"{name} := coalesce({x}, []::VARCHAR[])"

    step = f"list_transform(list_filter(path, lambda p: p IS NOT NULL), lambda p: struct_pack(node_id := p.node_id, {', '.join(text(f'p.{x}') for x in ('summary', 'topic', 'plain_topic'))}, {terms('p.terms', 'terms')}))"
    choice = (
        "list_transform(list_filter(candidates, lambda c: c IS NOT NULL), lambda c: struct_pack("
        + ", ".join([*[text(f"c.{x}") for x in ("id", "parent_id", "dst_id")], text("c.kind", "candidate_kind"), text("c.source_topic"), "destination_topic := coalesce(c.destination_topic, c.node_topic, '')", text("c.destination_plain_topic"), terms("c.destination_terms", "destination_terms"), text("c.edge_summary"), "edge_confidence := coalesce(c.confidence, 0e0)", "hop := coalesce(c.hop, 0)", text("c.retrieval_reason"), "relation := c.relation", text("c.node_summary"), text("c.node_full")])
        + "))"
    )
    node = f"struct_pack(node_id := current_node.node_id, {', '.join(text(f'current_node.{x}') for x in ('summary',))}, \"full\" := coalesce(current_node.\"full\", ''), {', '.join(text(f'current_node.{x}') for x in ('topic', 'plain_topic'))}, {terms('current_node.terms', 'terms')})"
    task = f"to_json(struct_pack(episode_id := id, query := query, query_intent := query_intent, expected_topic := coalesce(expected_topic, ''), path := {step}, current_node := {node}, candidates := {choice}))"
    able = "trim(query) <> '' AND current_node IS NOT NULL AND path IS NOT NULL AND candidates IS NOT NULL"
    def units(u: str) -> str:
        return f"'\\u' || lpad(lower(to_hex({u})), 4, '0')"

    ascii_only = f"CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 65536 THEN {units('unicode(c)')} ELSE {units('55296 + ((unicode(c) - 65536) >> 10)')} || {units('56320 + ((unicode(c) - 65536) & 1023)')} END"
    said = L.PROMPT.replace("'", "''")
    return {
        "vec_checked": w(NODES, "SELECT node_id, round(sqrt(list_dot_product(summary, summary)), 6) AS norm FROM nodes"),
        "vec_noisy": w(f"{NODES}, g AS (SELECT node_id, list_transform(range(0, 32), lambda i: summary[i + 1] + 0.05e0 * {_bell('node_id', 'i')}) AS a, list_transform(range(0, 8), lambda i: {_bell('node_id', 'i')}) AS b FROM nodes)", f"SELECT node_id, {r6(unit('a'))} AS noisy, {r6(unit('b'))} AS random FROM g"),
        "feature_rows": w(CANDIDATES, f"SELECT case_id, idx, {r6(feats)} AS features, {r6('CASE WHEN len(oracle) = 5 THEN list_append(oracle, oracle[3]) ELSE oracle END')} AS target, round(coalesce(weight, 1), 6) AS weight FROM flat"),
        "feature_parts": w(CANDIDATES, f"SELECT case_id, idx, {r6('edge')} AS edge, [round({clamp('confidence')}, 6), round({clamp('hop / 3e0')}, 6)] AS scalars, " + ", ".join(f"round(sqrt(list_dot_product({v}, {v})), 6) AS {v}" for v in ("query", "current_summary", "dst_summary", "path")) + " FROM flat"),
        "ranking_groups": w(CANDIDATES, "SELECT case_id, list(round(coalesce(result_rank_target, rank_target, label0), 6) + 0.0 ORDER BY idx) AS labels, list(round(coalesce(weight, 1), 6) + 0.0 ORDER BY idx) AS weights FROM flat GROUP BY case_id"),
        "candidate_weights": w(CANDIDATES, "SELECT kind, count(*)::BIGINT AS n, round(avg(coalesce(weight, 1) * CASE WHEN kind IN ('hard_summary_negative', 'same_full_wrong_summary_negative') THEN 2 WHEN kind IN ('hard_full_negative', 'same_summary_wrong_full_negative', 'path_aligned_wrong_full_negative') THEN 3 ELSE 1 END), 6) AS weight FROM flat GROUP BY kind"),
        "attach_targets": w(f"{BASE}, {_attach_rows()}, g AS (SELECT src_id, dst_id, {cos01('ns', 'cs')} AS s, coalesce({cos01('nf', 'cf')}, {cos01('ns', 'cs')}) AS f, {cos01('path', 'cs')} AS p FROM ap)", f"SELECT src_id, dst_id, round({clamp(f'0.7 * {gate} + 0.2 * s * f + 0.1 * least(p, {gate})')}, 6) AS target FROM g"),
        "eval_oracle": w(f"{CANDIDATES}, o AS (SELECT case_id, label, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(oracle, 0) DESC, idx) AS k FROM m), f AS (SELECT case_id, min(k) FILTER (label = 1) AS f FROM o GROUP BY 1)", 'SELECT count(*)::BIGINT AS cases, count(*) FILTER (f = 1)::BIGINT AS "right", round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) AS mrr FROM f'),
        "eval_pairwise_oracle": w(CANDIDATES, "SELECT n.kind, count(*)::BIGINT AS pairs, count(*) FILTER (p.s > n.s)::BIGINT AS won FROM m p JOIN m n ON p.case_id = n.case_id AND p.label = 1 AND n.label = 0 AND coalesce(p.oracle, 0) > coalesce(n.oracle, 0) GROUP BY n.kind"),
        "eval_action_metrics": w(f"{CANDIDATES}, {act}, v AS (SELECT action, s, x, label, target, sum(label) OVER w AS cp, count(*) OVER w AS cn FROM l WINDOW w AS (PARTITION BY action ORDER BY s DESC)), b AS (SELECT action, sum(g) AS g FROM (SELECT action, least(9, floor(s / 100000)) AS bin, abs(sum(s / 1000000) - sum(label)) AS g FROM l GROUP BY ALL) GROUP BY action), t AS (SELECT action, count(*) AS n, sum(label) AS p, count(*) FILTER (s >= 500000 AND label = 1) AS tp, count(*) FILTER (s >= 500000 AND label = 0) AS fp, sum(label * cp / cn) AS ap, avg(x) FILTER (label = 1) AS mp, avg(x) FILTER (label = 0) AS mn, min(x) AS low, max(x) AS high, stddev_pop(x) AS sd, avg((x - label) ** 2) AS br, avg(target) AS mt FROM v GROUP BY action), u AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr, CASE WHEN p = 0 THEN 0 ELSE tp / p END AS re FROM t)",
            "SELECT action, n::BIGINT AS candidates, p::BIGINT AS positives, round(p / n, 6) AS positive_rate, round(CASE WHEN p = 0 THEN 0 ELSE ap / p END, 6) AS average_precision, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1, round(coalesce(mp, 0), 6) AS mean_positive, round(coalesce(mn, 0), 6) AS mean_negative, round(low, 6) AS low, round(high, 6) AS high, round(sd, 6) AS deviation, round(br, 6) AS brier, round(g / n, 6) AS ece, round(mt, 6) AS mean_target FROM u JOIN b USING (action)"),
        "sample_nodes": w(f"{NODES}, {topics}", f"SELECT topic, node_id, row_number() OVER (PARTITION BY topic ORDER BY md5('{DRAWN}|' || node_id), node_id)::BIGINT AS place FROM tp QUALIFY place <= 3"),
        "distractors": w(f"{NODES}, {topics}, n AS (SELECT node_id, split_part(topic, ':', 1) AS domain FROM tp WHERE topic <> ''), o AS (SELECT DISTINCT domain AS own FROM n)", f"SELECT own, node_id, domain, row_number() OVER (PARTITION BY own ORDER BY md5('{DRAWN}|' || node_id), node_id)::BIGINT AS place FROM o JOIN n ON own <> domain QUALIFY place <= 4"),
        "deal_episodes": f"WITH t AS ({names}), q AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY query) - 1 AS j, count(*) OVER (PARTITION BY domain) AS q FROM t), k AS (SELECT domain, row_number() OVER (ORDER BY domain) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT domain FROM t)) SELECT i::BIGINT AS episode, k.domain, q.query, ((i // n) // q.q)::BIGINT AS variant FROM range(0, 1000) r(i) JOIN k ON k.k = i % n JOIN q ON q.domain = k.domain AND q.j = (i // n) % q.q",
        "labels_read": w(lab, "SELECT id, candidate_id, " + ", ".join(f"round({t}, 6) AS {t}" for t in five) + " FROM lb"),
        "labels_missing": w(f"{lab}, a AS (SELECT DISTINCT id, c.id AS candidate_id FROM k WHERE c.id IS NOT NULL)", "SELECT id, count(*)::INT AS n, min(candidate_id) AS first FROM a WHERE NOT EXISTS (SELECT 1 FROM lb WHERE lb.id = a.id AND lb.candidate_id = a.candidate_id AND " + " AND ".join(f"lb.{t} IS NOT NULL" for t in five) + ") GROUP BY id"),
        "labels_applied": w(lab, "SELECT k.id, k.idx, " + ", ".join(f"round(CASE WHEN lb.id IS NOT NULL THEN lb.{t} ELSE k.c.qwen_teacher.{t} END, 6) AS {t}" for t in five) + " FROM k LEFT JOIN lb ON lb.id = k.id AND lb.candidate_id = k.c.id"),
        "build_prompt": w(f"{once}, t AS (SELECT id, {task}::VARCHAR AS t FROM once WHERE {able})", f"SELECT id, '{said}' || CASE WHEN regexp_matches(t, '[^\\x00-\\x7f]') THEN array_to_string(list_transform(string_split(t, ''), lambda c: {ascii_only}), '') ELSE t END AS prompt FROM t"),
        "teacher_asked": w(once, f"SELECT id, 2::INT AS attempts, count(DISTINCT cid)::BIGINT AS labels, CASE WHEN count(cid) > 0 THEN 0.25e0 END AS follow FROM (SELECT id, unnest(CASE WHEN len(list_filter(candidates, lambda c: c IS NOT NULL)) = 0 THEN [NULL] ELSE list_transform(list_filter(candidates, lambda c: c IS NOT NULL), lambda c: c.id) END) AS cid FROM once WHERE {able}) GROUP BY id"),
        "seeds_preferred": w(f"{NODES}, {index}, s AS (SELECT query_id, node_id AS seed_id, rank FROM hits WHERE rank <= 4 UNION ALL SELECT node_id, node_id, 0 FROM nodes WHERE {is_query()} AND node_id NOT IN (SELECT query_id FROM hits))", "SELECT query_id, seed_id, row_number() OVER (PARTITION BY query_id ORDER BY (seed_id = query_id)::INT DESC, rank)::BIGINT AS place FROM s"),
        "compare_hits": w(f"{walk}, {topk('q a, eff b', 'eff', NEAR, LIMIT)}, al AS (SELECT query_id, node_id, rank, 'exact' AS method FROM top UNION ALL SELECT query_id, node_id, rank, 'index' FROM hits WHERE rank <= {LIMIT} UNION ALL SELECT query_id, node_id, included_rank, 'traversal' FROM ranked WHERE included_rank <= {LIMIT}), {topics}, g AS (SELECT al.*, (a.topic = b.topic) AS good FROM al JOIN tp a ON a.node_id = al.node_id JOIN tp b ON b.node_id = al.query_id), ks AS (SELECT unnest([1, 3, 5, 10])::INT AS k), nq AS (SELECT count(*) AS nq FROM q), pq AS (SELECT method, k, query_id, count(*) FILTER (good AND rank <= k) AS h, min(rank) FILTER (good AND rank <= k) AS f FROM g, ks GROUP BY ALL)",
            "SELECT method, k, round(sum(h) / (k * any_value(nq)), 6) AS precision, round(count(*) FILTER (h > 0) / any_value(nq), 6) AS hit_rate, round(coalesce(sum(1.0::DOUBLE / f), 0) / any_value(nq), 6) AS mrr FROM pq, nq GROUP BY method, k"),
        "score_counts": w(f"{BASE}, {QUERIES}, {traversal(TraversalConfig(max_hops=2))}", "SELECT 2::BIGINT AS calls, ((SELECT count(*) FROM i0) + (SELECT count(*) FROM i1))::BIGINT AS candidates"),
        "traverse_default": w(f"{BASE}, {QUERIES}, {traversal(TraversalConfig())}", "SELECT query_id, node_id, parent_id, hop, round(follow, 6) AS follow, round(result, 6) AS result, read_full_flag, included, expanded, critical, expressway_jumps, path FROM decisions"),
        "eval_attach_cases": w(f"{BASE}, {_attach_rows()}, g AS (SELECT *, {cos01('ns', 'cs')} AS s, coalesce({cos01('nf', 'cf')}, {cos01('ns', 'cs')}) AS f, {cos01('path', 'cs')} AS p FROM ap), t AS (SELECT src_id, row_number() OVER (PARTITION BY src_id ORDER BY dst_id) AS i, (round({clamp(f'0.7 * {gate} + 0.2 * s * f + 0.1 * least(p, {gate})')}, 6) >= 0.65)::INT AS label, round({clamp('0.6 * ' + cos01('ne', 'ce') + ' + 0.3 * f + 0.1 * ' + cos01('path', 'ce'))}, 6) AS score FROM g), c AS (SELECT * FROM t WHERE i <= 16), r AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY score DESC, i) AS k FROM c), x AS (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5) AS hit, sum(label) AS p FROM c), z AS (SELECT tp / greatest(hit, 1) AS pr, tp / greatest(p, 1) AS re FROM x)",
            "SELECT 'precision' AS metric, round(pr, 6) AS value FROM z UNION ALL SELECT 'recall', round(re, 6) FROM z UNION ALL SELECT 'f1', round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) FROM z UNION ALL SELECT 'mrr', round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) FROM (SELECT src_id, min(k) FILTER (label = 1) AS f FROM r GROUP BY 1)"),
        "shard_progress": "WITH f AS (SELECT source_file, count(*)::BIGINT AS lines, arg_max(len(right(coalesce(body, ''), 3000)), (line_no, raw_id))::INT AS tail_length FROM raw_episode GROUP BY 1) SELECT source_file, 'episodes_' || lpad((row_number() OVER (ORDER BY source_file) - 1)::VARCHAR, 3, '0') || '.jsonl' AS shard, lines, CASE WHEN lines < max(lines) OVER () THEN 'partial' ELSE 'complete' END AS status, tail_length FROM f",
        "scan_ordered": "SELECT ((len(src_id) + version) % 3)::INT AS shard, count(*)::BIGINT AS edges, min(src_id) AS first, max(src_id) AS last FROM edge_frame GROUP BY 1",
    }
