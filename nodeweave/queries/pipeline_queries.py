"""Episodes to training and ranking rows, candidate lists and attach rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodeweave.functions import text as X
from nodeweave.functions import vectors as V
from nodeweave.operators import metrics as M
from nodeweave.operators.scorers import HeuristicScorer, RelationScorer
from nodeweave.queries.graph_queries import _attach_rows, _topics
from nodeweave.queries.graph_sql import BASE
from nodeweave.queries.graph_sql import _attach_rows as attach_rows_sql
from nodeweave.queries.sqlx import EPISODES, clamp, cos01, fold, r6, unit, zipped
from nodeweave.queries.vector_queries import _embed_sql
from nodeweave.session import stage
from nodeweave.sources.tables import table


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    """Episodes that have what a training row needs, each id once."""
    return table(spark, d, "teacher_episode").filter("id is not null and trim(query) <> '' and current_node is not null").dropDuplicates(["id"])


def _effective_text(text, meta):
    return X.effective_text(text, meta, 32)


def _converted(spark: SparkSession, d: str) -> DataFrame:
    """One row for each candidate with its episode's vectors.

    Texts and their canonical metadata are embedded once an episode and once a
    candidate; the path is the blend of its nodes, and the query where the path is empty.
    """
    e = _episodes(spark, d)
    nested = F.to_json
    node = F.col("current_node")
    base = e.select(
        "id", "query", "path", "candidates", _effective_text(F.col("query"), nested(F.col("query_intent"))).alias("query_vector"),
        _effective_text(F.coalesce(node["summary"], F.lit("")), nested(F.struct(node["topic"].alias("topic"), node["plain_topic"].alias("plain_topic"), node["terms"].alias("terms")))).alias("current_summary"),
        X.embed_text(F.concat_ws(" ", "query", "expected_topic"), 64).alias("new_full"),
    )
    base = stage(base, "episodes")
    steps = base.select("id", F.posexplode("path").alias("pos", "n")).filter("n is not null")
    steps = steps.select("id", "pos", _effective_text(F.coalesce(F.col("n.summary"), F.lit("")), nested(F.struct(F.col("n.topic").alias("topic"), F.col("n.plain_topic").alias("plain_topic"), F.col("n.terms").alias("terms")))).alias("v"))
    paths = steps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("s")).select("id", V.normalize(F.aggregate("s", F.array_repeat(F.lit(0.0), 32), lambda a, x: F.zip_with(a, x["v"], lambda p, q: p + q))).alias("path_vector"))
    c = base.select("id", "query_vector", "current_summary", "new_full", F.posexplode("candidates").alias("idx", "c")).filter("c is not null")
    meta = F.struct(*[F.col(f"c.{a}").alias(b) for a, b in (("destination_topic", "topic"), ("destination_plain_topic", "plain_topic"), ("destination_terms", "terms"), ("kind", "kind"), ("retrieval_reason", "retrieval_reason"), ("relation", "relation"))])
    t = F.coalesce("c.qwen_teacher", F.struct(*[F.col(f"c.bootstrap_teacher.{x}").alias(x) for x in ("follow", "read_full", "include", "expand", "stop")], F.lit(None).cast("double").alias("result")))
    c = c.select(
        "id", "idx", "query_vector", "current_summary", "new_full", F.col("c.id").alias("candidate_id"), F.col("c.kind").alias("kind"), F.col("c.confidence").alias("confidence"), F.coalesce("c.hop", F.lit(0)).alias("hop"), t.alias("t"),
        _effective_text(F.coalesce("c.node_summary", F.lit("")), nested(meta)).alias("dst_summary"), X.embed_text(F.coalesce("c.node_full", "c.node_summary"), 64).alias("dst_full"),
    )
    c = c.join(paths, "id", "left").withColumn("path", F.coalesce("path_vector", "query_vector")).drop("path_vector")
    return c.withColumn("edge", V.edge_vector("current_summary", "dst_summary", 16)).withColumn("result", F.coalesce("t.result", "t.include"))


TARGETS = ("follow", "read_full", "include", "expand", "stop")


def convert_regression(spark: SparkSession, d: str) -> DataFrame:
    """A training row for each candidate of each episode, vectors and targets rounded."""
    c = _converted(spark, d)
    target = F.transform(F.array(*[F.col(f"t.{x}") for x in TARGETS], F.col("result")), lambda x: F.round(x, 6))
    return c.select(F.concat("candidate_id", F.lit(":regression")).alias("id"), *[V.rounded(x).alias(x) for x in ("edge", "dst_summary", "path")], V.rounded("query_vector").alias("query"), V.rounded("current_summary").alias("current_summary"), "confidence", "hop", target.alias("target"))


def convert_ranking(spark: SparkSession, d: str) -> DataFrame:
    """A ranking case for each episode, its candidates in order."""
    c = _converted(spark, d)

    def label(x):
        return F.when(x >= 0.65, 1).otherwise(0)

    one = F.struct(
        "idx", F.col("candidate_id").alias("id"), "kind", label(F.col("t.follow")).alias("label"), F.round("t.follow", 6).alias("rank_target"), label(F.col("result")).alias("result_label"), F.round("result", 6).alias("result_rank_target"),
        F.round(0.5 + F.abs(F.col("result") - 0.5) * 2.0, 6).alias("weight"), V.rounded("dst_summary").alias("dst_summary"), V.rounded("edge").alias("edge"), "confidence", "hop",
    )
    # an episode's candidates are a bounded list that came as one array
    return c.groupBy("id").agg(F.first(V.rounded("query_vector")).alias("query"), F.first(V.rounded("current_summary")).alias("current_summary"), F.first(V.rounded("path")).alias("path"), F.array_sort(F.collect_list(one)).alias("candidates")).withColumn("id", F.concat("id", F.lit(":traversal-ranking")))


def ranking_cases(spark: SparkSession, d: str) -> DataFrame:
    """The ranking cases with their candidates' fields as arrays in order, vectors one after another."""
    c = F.col("candidates")
    return convert_ranking(spark, d).select(
        "id", "query", "current_summary", "path", *[c[f].alias(n) for n, f in CASE_FIELDS.items()], F.flatten(c["dst_summary"]).alias("dst_summaries"), F.flatten(c["edge"]).alias("edges"),
    )


#: Arrays of a ranking case and the candidates' field in each.
CASE_FIELDS = {"ids": "id", "kinds": "kind", "labels": "label", "rank_targets": "rank_target", "result_labels": "result_label", "result_rank_targets": "result_rank_target", "weights": "weight", "confidences": "confidence", "hops": "hop"}


def ordered_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Positives, then hard negatives, then candidates of an episode: first place wins, twelve at most."""
    e = table(spark, d, "teacher_episode").dropDuplicates(["id"])
    none = F.array().cast("array<string>")
    cand = F.transform(F.filter(F.coalesce("candidates", F.array().cast(e.schema["candidates"].dataType)), lambda c: c.isNotNull()), lambda c: c["dst_id"])
    ids = F.array_compact(F.concat(F.coalesce("query_intent.expected_positive_ids", none), F.coalesce("query_intent.hard_negative_ids", none), cand))
    return e.select("id", F.array_join(F.slice(F.array_distinct(ids), 1, 12), ",").alias("ids"))


def build_cases(spark: SparkSession, d: str) -> DataFrame:
    """Curated cases: the ordered candidates of an episode with kind and label."""
    e = table(spark, d, "teacher_episode").dropDuplicates(["id"]).select("id", F.coalesce("query_intent.expected_positive_ids", F.array().cast("array<string>")).alias("p"), F.coalesce("query_intent.hard_negative_ids", F.array().cast("array<string>")).alias("h"))
    rows = ordered_dedupe(spark, d).join(e, "id").select("id", "p", "h", F.posexplode(F.split("ids", ",")).alias("place", "node_id")).filter("node_id <> ''")
    kind = F.when(F.array_contains("p", F.col("node_id")), "positive").when(F.array_contains("h", F.col("node_id")), "hard_same_domain_negative").otherwise("cross_domain_negative")
    return rows.select("id", "place", "node_id", kind.alias("kind"), F.array_contains("p", F.col("node_id")).cast("int").alias("label"))


def domain_expand(spark: SparkSession, d: str) -> DataFrame:
    """Three nodes a topic, with the next two topics of its domain, round and round, as hard negatives."""
    t = table(spark, d, "node_frame").select(F.col("metadata")["topic"].alias("topic")).filter("topic is not null").distinct()
    own = Window.partitionBy("domain").orderBy("topic")
    n = t.withColumn("domain", F.substring_index("topic", ":", 1)).withColumn("i", F.row_number().over(own) - 1).withColumn("n", F.count("*").over(Window.partitionBy("domain")))
    follow = n.select("domain", F.col("i").alias("j"), F.col("topic").alias("next_topic"))
    pairs = n.withColumn("step", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("j", F.pmod(F.col("i") + F.col("step"), F.col("n")).cast("int")).join(follow, ["domain", "j"]).filter("next_topic <> topic")
    return pairs.withColumn("suffix", F.explode(F.array(F.lit("policy"), F.lit("runbook"), F.lit("evidence")))).select(F.concat_ws(":", "topic", "suffix").alias("node_id"), F.concat_ws(":", "next_topic", "suffix").alias("hard_negative_id"), F.col("step").cast("int").alias("step"))


def _rank(df: DataFrame, score: str) -> DataFrame:
    w = Window.partitionBy("src_id").orderBy(F.desc(score), "dst_id")
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).filter("rank <= 10").select("src_id", "dst_id", F.round(score, 6).alias("score"), "rank")


def attach_summary_rank(spark: SparkSession, d: str) -> DataFrame:
    """Ten best neighbours of every node by raw summaries."""
    return _rank(_attach_rows(spark, d).withColumn("s", V.cosine01("new_summary", "cand_summary")), "s")


def attach_relation_rank(spark: SparkSession, d: str) -> DataFrame:
    """Ten best neighbours of every node by the relation scorer, the new node itself being the path."""
    r = _attach_rows(spark, d).withColumn("path", F.col("new_summary"))
    return _rank(RelationScorer().attach_column(r), "attach")


def eval_attach(spark: SparkSession, d: str) -> DataFrame:
    """Ranking metrics of the attach scorer over every node's edges; a neighbour of the same topic is right."""
    topics = _topics(spark, d)
    r = HeuristicScorer().attach_column(_attach_rows(spark, d)).join(topics.select(F.col("node_id").alias("src_id"), F.col("topic").alias("a")), "src_id").join(topics.select(F.col("node_id").alias("dst_id"), F.col("topic").alias("b")), "dst_id")
    rows = stage(r.select(F.col("src_id").alias("case_id"), F.col("dst_id").alias("idx"), F.round("attach", 6).alias("score"), (F.col("a") == F.col("b")).cast("int").alias("label"), F.lit("edge").alias("kind")), "attach_rows")
    ap = M.average_precision(rows).select(F.lit("average_precision").alias("metric"), F.col("average_precision").alias("value"))
    return ap.unionByName(M.mrr(rows).select(F.lit("mrr").alias("metric"), F.col("mrr").alias("value")))


def queries() -> dict:
    return {f.__name__: f for f in (convert_regression, convert_ranking, ranking_cases, ordered_dedupe, build_cases, domain_expand, attach_summary_rank, attach_relation_rank, eval_attach)}


def _stripped(x: str) -> str:
    return f"lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"


def _list_text(x: str) -> str:
    return f"'[' || array_to_string(list_transform({x}, lambda e: coalesce({_stripped('e')}, '')), ',') || ']'"


def _entries(parts: list[tuple[str, str]], mark: str, between: str, inner: bool) -> str:
    """key and text pairs, in order of their keys, those without text left out (within an object those that end in a colon too)."""
    keep = "coalesce(e, '') <> ''" + (" AND right(e, 1) <> ':'" if inner else "")
    made = ", ".join(f"[{x}]" for _, x in sorted(parts))
    names = "[" + ", ".join(f"'{k}'" for k, _ in sorted(parts)) + "]"
    return f"array_to_string(list_filter(list_transform(flatten([{made}]), lambda e, i: CASE WHEN {keep} THEN {names}[i] || '{mark}' || e END), lambda e: e IS NOT NULL), '{between}')"


def _conversion() -> str:
    """CTEs up to converted: a row for each candidate with its vectors, targets and place."""
    def node(x: str) -> str:
        return _entries([("topic", _stripped(f"{x}.topic")), ("plain_topic", _stripped(f"{x}.plain_topic")), ("terms", _list_text(f"{x}.terms"))], "=", " | ", False)

    intent = [(f, _stripped(f"query_intent.{f}")) for f in ("text", "target_topic", "target_plain_topic", "domain", "tenant", "workflow", "region", "severity", "actor")]
    intent += [(f, _list_text(f"query_intent.{f}")) for f in ("target_terms", "expected_positive_ids", "hard_negative_ids")]
    intent += [("metadata", "CASE WHEN query_intent.metadata IS NOT NULL THEN '{' || array_to_string(list_sort(list_transform(list_filter(map_entries(query_intent.metadata), lambda e: coalesce(" + _stripped("e.value") + ", '') <> '' AND right(" + _stripped("e.value") + ", 1) <> ':'), lambda e: e.key || ':' || " + _stripped("e.value") + ")), ',') || '}' END")]
    relation = [(f, _stripped(f"c.relation.{f}")) for f in ("domain", "source_domain", "tenant", "query_workflow", "candidate_workflow", "decision_hint")]
    relation += [(f, f"c.relation.{f}::VARCHAR") for f in ("same_workflow", "same_domain")] + [("metadata_conflict", _list_text("c.relation.metadata_conflict"))]
    meta = [("topic", _stripped("c.destination_topic")), ("plain_topic", _stripped("c.destination_plain_topic")), ("terms", _list_text("c.destination_terms")), ("kind", _stripped("c.kind")), ("retrieval_reason", _stripped("c.retrieval_reason"))]
    meta += [("relation", "CASE WHEN c.relation IS NOT NULL THEN '{' || " + _entries(relation, ":", ",", True) + " || '}' END")]
    mixed = unit(zipped("a.v", "b.v", 32, "0.78 * {x} + 0.22 * {y}"))
    edge = unit(zipped("s", "d", 16, "tanh(0.8 * ({y} - {x}) + 0.4 * {x} * {y})"))
    teacher = ", ".join(f"CASE WHEN c.qwen_teacher IS NOT NULL THEN c.qwen_teacher.{t} ELSE c.bootstrap_teacher.{t} END AS {t}" for t in TARGETS)
    return f"""
    once AS (SELECT * FROM teacher_episode WHERE id IS NOT NULL AND trim(query) <> '' AND current_node IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1),
    st AS (SELECT * FROM (SELECT id, unnest(path) AS n, unnest(range(0, len(path))) AS pos FROM once) WHERE n IS NOT NULL),
    ca AS (SELECT * FROM (SELECT id, unnest(candidates) AS c, unnest(range(0, len(candidates)))::INT AS idx FROM once) WHERE c IS NOT NULL),
    pr AS (
      SELECT 'q' || id AS id, query AS txt, {_entries(intent, "=", " | ", False)} AS met FROM once
      UNION ALL SELECT 'n' || id, current_node.summary, {node("current_node")} FROM once
      UNION ALL SELECT 's' || pos || '#' || id, n.summary, {node("n")} FROM st
      UNION ALL SELECT 'c' || idx || '#' || id, c.node_summary, {_entries(meta, "=", " | ", False)} FROM ca
    ),
    src AS (SELECT 't' || id AS id, coalesce(txt, '') AS txt FROM pr UNION ALL SELECT 'm' || id, coalesce(met, '') FROM pr),
    {_embed_sql('src', 32)},
    ev AS (SELECT p.id, {mixed} AS v FROM pr p JOIN embedded a ON a.id = 't' || p.id JOIN embedded b ON b.id = 'm' || p.id),
    ps AS (SELECT id, list(x ORDER BY k) AS psum FROM (SELECT st.id, k, sum(ev.v[k]) AS x FROM st JOIN ev ON ev.id = 's' || st.pos || '#' || st.id, range(1, 33) r(k) GROUP BY st.id, k) GROUP BY id),
    cv AS (
      SELECT ca.id, ca.idx, c.id AS candidate_id, c.kind AS kind, c.confidence AS confidence, coalesce(c.hop, 0) AS hop, q.v AS query, n.v AS current_summary, d.v AS dst_summary, coalesce({unit('psum')}, q.v) AS path,
             {unit(fold('n.v', 16))} AS s, {unit(fold('d.v', 16))} AS d, {teacher}, CASE WHEN c.qwen_teacher IS NOT NULL THEN c.qwen_teacher.result END AS result0
      FROM ca JOIN ev q ON q.id = 'q' || ca.id JOIN ev n ON n.id = 'n' || ca.id JOIN ev d ON d.id = 'c' || ca.idx || '#' || ca.id LEFT JOIN ps ON ps.id = ca.id
    ),
    converted AS (SELECT *, {edge} AS edge, coalesce(result0, include) AS result FROM cv)"""


def oracle_sql() -> dict[str, str]:
    six = "[" + ", ".join(f"round({t}, 6)" for t in (*TARGETS, "result")) + "]"
    member = (
        "struct_pack(idx := idx, id := candidate_id, kind := kind, label := (coalesce(follow, 0) >= 0.65)::INT, rank_target := round(follow, 6), result_label := (coalesce(result, 0) >= 0.65)::INT, result_rank_target := round(result, 6), "
        f"weight := round(0.5 + abs(result - 0.5) * 2.0, 6), dst_summary := {r6('dst_summary')}, edge := {r6('edge')}, confidence := confidence, hop := hop)"
    )
    listed = f"""{EPISODES},
    al AS (
      SELECT id, 0 AS tier, unnest(query_intent.expected_positive_ids) AS x, unnest(range(0, len(query_intent.expected_positive_ids))) AS o FROM episodes
      UNION ALL SELECT id, 1, unnest(query_intent.hard_negative_ids), unnest(range(0, len(query_intent.hard_negative_ids))) FROM episodes
      UNION ALL SELECT id, 2, unnest(list_transform(candidates, lambda c: c.dst_id)), unnest(range(0, len(candidates))) FROM episodes
    ),
    fi AS (SELECT id, x, min((tier, o)) AS k FROM al WHERE x IS NOT NULL GROUP BY id, x),
    pl AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS place FROM fi)"""
    ranked = "SELECT src_id, dst_id, round(s, 6) AS score, row_number() OVER (PARTITION BY src_id ORDER BY s DESC, dst_id)::BIGINT AS rank FROM sc QUALIFY rank <= 10"
    rel = clamp("0.7 * " + cos01("nr", "cr") + " + 0.2 * " + cos01("ns", "cs") + " + 0.1 * " + cos01("ns", "cs"))
    heu = clamp("0.6 * " + cos01("ne", "ce") + " + 0.3 * coalesce(" + cos01("nf", "cf") + ", " + cos01("ns", "cs") + ") + 0.1 * " + cos01("path", "ce"))
    return {
        "convert_regression": f"WITH {_conversion()} SELECT candidate_id || ':regression' AS id, {r6('edge')} AS edge, {r6('dst_summary')} AS dst_summary, {r6('path')} AS path, {r6('query')} AS query, {r6('current_summary')} AS current_summary, confidence, hop, {six} AS target FROM converted",
        "ranking_cases": f"WITH {_conversion()}, g AS (SELECT id || ':traversal-ranking' AS id, {r6('any_value(query)')} AS query, {r6('any_value(current_summary)')} AS current_summary, {r6('any_value(path)')} AS path, list({member} ORDER BY idx) AS cs FROM converted GROUP BY id) SELECT id, query, current_summary, path, " + ", ".join(f"list_transform(cs, lambda c: c.{f}) AS {n}" for n, f in CASE_FIELDS.items()) + ", flatten(list_transform(cs, lambda c: c.dst_summary)) AS dst_summaries, flatten(list_transform(cs, lambda c: c.edge)) AS edges FROM g",
        "ordered_dedupe": f"WITH {listed} SELECT e.id, coalesce((SELECT string_agg(x, ',' ORDER BY place) FROM pl WHERE pl.id = e.id AND place <= 12), '') AS ids FROM episodes e",
        "build_cases": f"WITH {listed} SELECT p.id, (place - 1)::INT AS place, x AS node_id, CASE WHEN coalesce(list_contains(e.query_intent.expected_positive_ids, x), false) THEN 'positive' WHEN coalesce(list_contains(e.query_intent.hard_negative_ids, x), false) THEN 'hard_same_domain_negative' ELSE 'cross_domain_negative' END AS kind, coalesce(list_contains(e.query_intent.expected_positive_ids, x), false)::INT AS label FROM pl p JOIN episodes e USING (id) WHERE place <= 12",
        "domain_expand": "WITH t AS (SELECT DISTINCT metadata['topic'] AS topic FROM node_frame WHERE metadata['topic'] IS NOT NULL), n AS (SELECT topic, split_part(topic, ':', 1) AS domain, row_number() OVER (PARTITION BY split_part(topic, ':', 1) ORDER BY topic) - 1 AS i, count(*) OVER (PARTITION BY split_part(topic, ':', 1)) AS n FROM t) SELECT a.topic || ':' || s AS node_id, b.topic || ':' || s AS hard_negative_id, k::INT AS step FROM n a, (VALUES (1), (2)) x(k), (VALUES ('policy'), ('runbook'), ('evidence')) y(s), n b WHERE b.domain = a.domain AND b.i = (a.i + k) % a.n AND b.topic <> a.topic",
        "attach_summary_rank": f"WITH {BASE}, {attach_rows_sql()}, sc AS (SELECT src_id, dst_id, {cos01('ns', 'cs')} AS s FROM ap) {ranked}",
        "attach_relation_rank": f"WITH {BASE}, {attach_rows_sql()}, sc AS (SELECT src_id, dst_id, {rel} AS s FROM ap) {ranked}",
        "eval_attach": f"WITH {BASE}, {attach_rows_sql()}, sc AS (SELECT ap.src_id, ap.dst_id, round({heu}, 6) AS s, (coalesce(a.metadata['topic'], '') = coalesce(b.metadata['topic'], ''))::INT AS label FROM ap JOIN nodes a ON a.node_id = src_id JOIN nodes b ON b.node_id = dst_id), g AS (SELECT label, row_number() OVER (ORDER BY s DESC, src_id, dst_id) j, sum(label) OVER (ORDER BY s DESC, src_id, dst_id ROWS UNBOUNDED PRECEDING) cp FROM sc), r AS (SELECT src_id, label, row_number() OVER (PARTITION BY src_id ORDER BY s DESC, dst_id) rk FROM sc), f AS (SELECT src_id, min(rk) FILTER (label = 1) f FROM r GROUP BY 1) SELECT 'average_precision' AS metric, (SELECT round(avg(cp / j), 6) FROM g WHERE label = 1) AS value UNION ALL SELECT 'mrr', (SELECT round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) FROM f)",
    }
