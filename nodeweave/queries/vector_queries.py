"""Vector, text and metadata functions over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeweave.functions import text as X
from nodeweave.functions import vectors as V
from nodeweave.operators.graph import current_nodes
from nodeweave.queries.metric_queries import candidates
from nodeweave.queries.sqlx import CANDIDATES, EPISODES, NODES, clamp, cos, cos01, dot, fold, r6, unit, zipped
from nodeweave.session import spread, stage
from nodeweave.sources.tables import table


def _nodes(spark: SparkSession, d: str, *only: str) -> DataFrame:
    return current_nodes(table(spark, d, "node_frame"), list(only) or ["summary_vector", "metadata_vector", "full_vector", "traversal_vector"])


def _r(c):
    return F.round(c, 6)


def _vectors() -> dict:
    """Columns of the per-node vector queries, made only when a query runs."""
    s, m, f, t = "summary_vector", "metadata_vector", "full_vector", "traversal_vector"
    return {
        "vec_dot": lambda: {"dot_meta": _r(V.dot(s, m)), "dot_full": _r(V.dot(s, f)), "dot_route": _r(V.dot(f, t))},
        "vec_norm": lambda: {"norm_summary": _r(V.norm(s)), "norm_full": _r(V.norm(f))},
        "vec_normalize": lambda: {"unit": V.rounded(V.normalize(s))},
        "vec_cosine": lambda: {"meta": _r(V.cosine(s, m)), "full": _r(V.cosine(s, f))},
        "vec_cosine01": lambda: {"meta": _r(V.cosine01(s, m)), "full": _r(V.cosine01(s, f))},
        "vec_resize": lambda: {"down": V.rounded(V.resize(f, 16)), "up": V.rounded(V.resize(t, 24)), "same": V.rounded(V.resize(s, 32))},
        "vec_blend": lambda: {"blend": V.rounded(V.blend([s, m, f], 32))},
        "vec_effective": lambda: {"effective": V.rounded(V.effective(s, m, 32))},
        "vec_traversal": lambda: {"route": V.rounded(V.traversal_vector(s, m, 16))},
        "vec_edge": lambda: {"edge": V.rounded(V.edge_vector(s, m, 16))},
        "vec_flip": lambda: {"flipped": V.rounded(V.flip_alternating(t)), "negated": V.rounded(V.negate(t))},
        "vec_round": lambda: {"rounded": V.rounded(t, 3)},
    }


def _per_node(columns):
    return lambda spark, d: _nodes(spark, d).select("node_id", *[c.alias(n) for n, c in columns().items()])


def scalars(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    return c.select("case_id", "idx", V.rounded(V.traversal_scalars("confidence", "hop", 3)).alias("scalars"))


def embed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Hash embedding of every document's whole text."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", V.rounded(X.embed_text("text", 32)).alias("embedding"))


def metadata_text(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, "metadata").select("node_id", X.metadata_text("metadata").alias("metadata_text"))


def metadata_vector(spark: SparkSession, d: str) -> DataFrame:
    """Embedding of the canonical metadata text of every node with metadata."""
    n = _nodes(spark, d, "metadata").filter("metadata is not null")
    return n.select("node_id", V.rounded(X.embed_text(X.metadata_text("metadata"), 32)).alias("embedding"))


def effective_text(spark: SparkSession, d: str) -> DataFrame:
    """Effective vector of a node's summary text and metadata text; missing metadata embeds the summary alone."""
    n = _nodes(spark, d, "summary_payload", "metadata")
    text = F.coalesce(X.metadata_text("metadata"), F.lit(""))
    e = n.select("node_id", X.embed_text("summary_payload", 32).alias("s"), X.embed_text(text, 32).alias("m"))
    return e.select("node_id", V.rounded(V.effective("s", "m", 32)).alias("effective"))


def terms_extract(spark: SparkSession, d: str) -> DataFrame:
    """Distinct terms of the topics of all nodes."""
    topics = table(spark, d, "node_frame").select(F.col("metadata")["topic"].alias("topic")).filter("topic is not null").distinct()
    return topics.select("topic", X.plain_topic("topic").alias("plain"), F.array_join(X.topic_terms("topic"), ",").alias("terms"))


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "teacher_episode").dropDuplicates(["id"])


def terms_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Terms an episode's intent shares with each candidate; null terms are passed over."""
    e = _episodes(spark, d).select("id", F.col("query_intent.target_terms").alias("wanted"), F.posexplode("candidates").alias("idx", "c")).filter("c is not null and wanted is not null and c.destination_terms is not null")
    return e.select("id", "idx", F.array_join(X.term_overlap("wanted", "c.destination_terms"), ",").alias("shared"))


def metadata_conflict(spark: SparkSession, d: str) -> DataFrame:
    """Conflicts of an episode's intent metadata with a fixed profile."""
    profile = F.create_map(F.lit("event"), F.lit("apron"), F.lit("service"), F.lit("reservoir"), F.lit("entity"), F.lit("berth"))
    e = _episodes(spark, d).select("id", F.col("query_intent.metadata").alias("m")).filter("m is not null")
    return e.select("id", F.array_join(X.metadata_conflicts("m", profile), ",").alias("conflicts"))


def strip_fence(spark: SparkSession, d: str) -> DataFrame:
    """Length and start of every raw body without its code fence."""
    body = X.strip_fence("body")
    return table(spark, d, "raw_episode").select("raw_id", F.length(body).alias("length"), F.substring(body, 1, 12).alias("start"))


def parse_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels read back from JSON answers: unknown ids ignored, scores held to 0..1, the last of a repeated id wins.

    The answers are made of the teacher scores that the episodes carry, one JSON text an episode.
    """
    e = _episodes(spark, d)
    answer = F.to_json(F.transform(F.filter("candidates", lambda c: c.isNotNull() & c["qwen_teacher"].isNotNull()), lambda c: F.struct(c["id"].alias("id"), (c["qwen_teacher"]["follow"] * 2.0).alias("follow"))))
    asked = e.select("id", answer.alias("answer"), F.transform(F.filter("candidates", lambda c: c.isNotNull()), lambda c: c["id"]).alias("known"))
    got = asked.select("id", "known", F.posexplode(F.from_json("answer", "array<struct<id: string, follow: double>>")).alias("pos", "x"))
    got = got.filter(F.array_contains("known", F.col("x.id"))).groupBy("id", F.col("x.id").alias("candidate_id")).agg(F.max(F.struct("pos", F.col("x.follow").alias("follow")))["follow"].alias("follow"))
    return got.select("id", "candidate_id", F.round(V.clamp01(F.col("follow")), 6).alias("follow"))


def teacher_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """The teacher of each candidate: the labelled one, else the bootstrap; a missing result is the include score."""
    e = _episodes(spark, d).select("id", F.posexplode("candidates").alias("idx", "c")).filter("c is not null")
    t = F.coalesce("c.qwen_teacher", F.struct(*[F.col(f"c.bootstrap_teacher.{x}").alias(x) for x in ("follow", "read_full", "include", "expand", "stop")], F.lit(None).cast("double").alias("result")))
    return e.select("id", "idx", t.alias("t")).select("id", "idx", *[F.round(F.col(f"t.{x}"), 6).alias(x) for x in ("follow", "read_full", "include", "expand", "stop")], F.round(F.coalesce("t.result", "t.include"), 6).alias("result"))


def kind_case(spark: SparkSession, d: str) -> DataFrame:
    """Kind of each candidate by topic and teacher, and the hint its kind gives."""
    t = teacher_coalesce(spark, d).select("id", "idx", "read_full")
    e = _episodes(spark, d).select("id", "expected_topic", F.posexplode("candidates").alias("idx", "c")).filter("c is not null").join(t, ["id", "idx"])
    same = F.coalesce(F.col("c.destination_topic") == F.col("expected_topic"), F.lit(False))
    made = F.when(same, "positive").when(F.col("read_full") >= 0.45, "ambiguous_wrong_topic").otherwise("wrong_topic_negative")
    kind = F.col("c.kind")
    hint = F.when(kind == "positive", "target_answer").when(kind == "bridge_positive", "traversal_bridge_not_answer").when(kind.contains("hard"), "same_domain_wrong_scope_hard_negative").otherwise("off_domain_or_unrelated_negative")
    return e.select("id", "idx", made.alias("made_kind"), hint.alias("hint"))


def distinct_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "teacher_episode").groupBy("source").agg(F.countDistinct("id").alias("ids"))


def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    """What a manifest states of the raw files: rows, readable-looking rows and bytes."""
    return table(spark, d, "raw_episode").groupBy("source_file").agg(F.count("*").alias("lines"), F.sum(F.coalesce(F.length("body"), F.lit(0))).alias("characters"), F.max("line_no").alias("last_line"))


def scan_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Edges written as sharded JSONL and read back with an explicit schema, line by line and failing on any bad line."""
    from nodeweave.sources.jsonl import read_jsonl, write_jsonl

    e = table(spark, d, "edge_frame").select("src_id", "dst_id", "confidence", "created_at", "version").withColumn("shard", F.pmod(F.xxhash64("src_id", "dst_id"), F.lit(8)).cast("int"))
    path = write_jsonl(e, "shard", "edges")
    return read_jsonl(spark, path, "src_id string, dst_id string, confidence double, created_at bigint, version int").select("src_id", "dst_id", "confidence", "created_at", "version")


def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Episodes still to be labelled: those of which no delivery carries a labelled candidate."""
    t = table(spark, d, "teacher_episode")
    done = t.filter(F.exists("candidates", lambda c: c.isNotNull() & c["qwen_teacher"].isNotNull())).select("id")
    return t.select("id").distinct().join(done, "id", "left_anti")


def round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Topics dealt to domains in turn: the i-th topic of all goes to domain i mod n."""
    from pyspark.sql import Window

    topics = table(spark, d, "node_frame").select(F.col("metadata")["topic"].alias("topic")).filter("topic is not null").distinct()
    domains = topics.select(F.substring_index("topic", ":", 1).alias("domain")).distinct()
    # both are lists of names, far smaller than the table; ordered as a whole
    i = topics.withColumn("i", F.row_number().over(Window.orderBy("topic")) - 1)
    n = domains.withColumn("k", F.row_number().over(Window.orderBy("domain")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    return i.withColumn("n", F.lit(stage(domains, "domains").count())).withColumn("k", F.pmod("i", "n").cast("int")).join(F.broadcast(n.drop("n")), "k").select("topic", "domain", F.floor(F.col("i") / F.col("n")).cast("bigint").alias("turn"))


def queries() -> dict:
    return {name: _per_node(columns) for name, columns in _vectors().items()} | {
        f.__name__: f
        for f in (scalars, embed_documents, metadata_text, metadata_vector, effective_text, terms_extract, terms_overlap, metadata_conflict, strip_fence, parse_labels, teacher_coalesce, kind_case, distinct_ids, manifest_counts, scan_jsonl, resume_antijoin, round_robin)
    }


def _embed_sql(source: str, dims: int) -> str:
    """embedded(id, v) from source(id, txt): the hash embedding in plain SQL."""
    return f"""
    tok AS (SELECT id, unnest(regexp_extract_all(lower(txt), '[a-z0-9]+')) AS t, unnest(range(0, len(regexp_extract_all(lower(txt), '[a-z0-9]+')))) AS pos FROM {source}),
    hex AS (SELECT id, sha256(pos || ':' || t) AS h, 1.0::DOUBLE + least(len(t), 12) / 12.0::DOUBLE AS w FROM tok),
    byt AS (SELECT id, w, i, ('0x' || substr(h, 2 * i + 1, 2))::INT AS b FROM hex, range(0, 32) v(i)),
    acc AS (SELECT id, (b + 31 * i) % {dims} AS k, sum(CASE WHEN b % 2 = 0 THEN w ELSE -w END) AS x FROM byt GROUP BY ALL),
    nrm AS (SELECT id, sqrt(sum(x * x)) AS n FROM acc GROUP BY id),
    grid AS (SELECT s.id, k.k FROM {source} s, range(0, {dims}) k(k) WHERE s.txt IS NOT NULL),
    embedded AS (SELECT g.id, list(CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE coalesce(x, 0.0) / n END ORDER BY g.k) AS v FROM grid g LEFT JOIN acc USING (id, k) LEFT JOIN nrm USING (id) GROUP BY g.id)"""


META_TEXT = "array_to_string(list_transform(list_sort(list_filter(map_entries(metadata), lambda e: coalesce(trim(e.value), '') <> '')), lambda e: e.key || '=' || lower(trim(e.value))), ' | ')"


def oracle_sql() -> dict[str, str]:
    def n(cols: str, extra: str = "") -> str:
        return f"WITH {NODES}{extra} SELECT node_id, {cols} FROM {'x' if extra else 'nodes'}"

    f32 = "full_[1:32]"
    f16 = "full_[1:16]"
    eps = f"WITH {EPISODES}"
    mixed = zipped("summary", "meta", 32, "0.78 * {x} + 0.22 * {y}")
    blend16 = f", y AS (SELECT *, {unit(fold('summary', 16))} AS s, {unit(fold('meta', 16))} AS q FROM nodes), x AS (SELECT *, {zipped('s', 'q', 16, '{x} + {y}')} AS z FROM y)"
    teacher = "CASE WHEN c.qwen_teacher IS NOT NULL THEN c.qwen_teacher.{0} ELSE c.bootstrap_teacher.{0} END"
    cand = "e AS (SELECT id, query_intent, expected_topic, unnest(candidates) AS c, unnest(range(0, len(candidates)))::INT AS idx FROM episodes)"
    return {
        "vec_dot": n(f"round({dot('summary', 'meta')}, 6) AS dot_meta, round({dot('summary', f32)}, 6) AS dot_full, round({dot(f16, 'route')}, 6) AS dot_route"),
        "vec_norm": n(f"round(sqrt({dot('summary', 'summary')}), 6) AS norm_summary, round(sqrt({dot('full_', 'full_')}), 6) AS norm_full"),
        "vec_normalize": n(f"{r6(unit('summary'))} AS unit"),
        "vec_cosine": n(f"round({cos('summary', 'meta')}, 6) AS meta, round({cos('summary', f32)}, 6) AS \"full\""),
        "vec_cosine01": n(f"round({cos01('summary', 'meta')}, 6) AS meta, round({cos01('summary', f32)}, 6) AS \"full\""),
        "vec_resize": n(f"CASE WHEN full_ IS NULL THEN NULL ELSE {r6(unit('fd'))} END AS down, {r6(unit('fu'))} AS up, {r6('summary')} AS same", f", x AS (SELECT *, {fold('full_', 16)} AS fd, {fold('route', 24)} AS fu FROM nodes)"),
        "vec_blend": n(f"{r6(unit('z'))} AS blend", f", y AS (SELECT *, {unit(fold('full_', 32))} AS q FROM nodes), x AS (SELECT *, list_transform(range(1, 33), lambda i: summary[i] + meta[i] + q[i]) AS z FROM y)"),
        "vec_effective": n(f"{r6('CASE WHEN meta IS NULL THEN summary ELSE ' + unit('z') + ' END')} AS effective", f", x AS (SELECT *, {mixed} AS z FROM nodes)"),
        "vec_traversal": n(f"{r6('CASE WHEN meta IS NULL THEN s ELSE ' + unit('z') + ' END')} AS route", blend16).replace("SELECT *,", "SELECT * EXCLUDE (route),", 1),
        "vec_edge": n(f"{r6(unit('z'))} AS edge", blend16.replace(zipped("s", "q", 16, "{x} + {y}"), zipped("s", "q", 16, "tanh(0.8 * ({y} - {x}) + 0.4 * {x} * {y})"))),
        "vec_flip": n("list_transform(range(1, len(route) + 1), lambda i: round(CASE WHEN i % 2 = 1 THEN -route[i] ELSE route[i] END, 6) + 0.0) AS flipped, list_transform(route, lambda x: round(-x, 6) + 0.0) AS negated"),
        "vec_round": n(f"{r6('route', 3)} AS rounded"),
        "scalars": f"WITH {CANDIDATES} SELECT case_id, idx, [round({clamp('confidence')}, 6), round({clamp('hop / 3.0::DOUBLE')}, 6), 0.0] AS scalars FROM flat",
        "embed_documents": f"WITH src AS (SELECT doc_id AS id, text AS txt FROM documents), {_embed_sql('src', 32)} SELECT s.id AS doc_id, {r6('v')} AS embedding FROM src s LEFT JOIN embedded USING (id)",
        "metadata_text": n(f"CASE WHEN metadata IS NULL THEN NULL ELSE {META_TEXT} END AS metadata_text"),
        "metadata_vector": f"WITH {NODES}, src AS (SELECT node_id AS id, {META_TEXT} AS txt FROM nodes WHERE metadata IS NOT NULL), {_embed_sql('src', 32)} SELECT id AS node_id, {r6('v')} AS embedding FROM embedded",
        "effective_text": f"WITH {NODES}, a AS (SELECT node_id || '#s' AS id, summary_payload AS txt FROM nodes UNION ALL SELECT node_id || '#m', CASE WHEN metadata IS NULL THEN '' ELSE {META_TEXT} END FROM nodes), {_embed_sql('a', 32)}, b AS (SELECT n.node_id, s.v AS summary, m.v AS meta FROM nodes n LEFT JOIN embedded s ON s.id = n.node_id || '#s' LEFT JOIN embedded m ON m.id = n.node_id || '#m'), c AS (SELECT *, {mixed} AS z FROM b) SELECT node_id, {r6(unit('z'))} AS effective FROM c",
        "terms_extract": "WITH t AS (SELECT DISTINCT metadata['topic'] AS topic FROM node_frame WHERE metadata['topic'] IS NOT NULL), p AS (SELECT topic, regexp_replace(topic, '^[^:]*:', '') AS plain FROM t) SELECT topic, plain, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(regexp_replace(plain, '[_-]', ' ', 'g')), ' '), lambda w: w <> ''))), ',') AS terms FROM p",
        "terms_overlap": f"{eps}, {cand} SELECT id, idx, array_to_string(list_sort(list_intersect(list_filter(query_intent.target_terms, lambda x: x IS NOT NULL), list_filter(c.destination_terms, lambda x: x IS NOT NULL))), ',') AS shared FROM e WHERE c IS NOT NULL AND query_intent.target_terms IS NOT NULL AND c.destination_terms IS NOT NULL",
        "metadata_conflict": f"{eps}, q AS (SELECT id, query_intent.metadata AS a, MAP {{'event': 'apron', 'service': 'reservoir', 'entity': 'berth'}} AS b FROM episodes WHERE query_intent.metadata IS NOT NULL) SELECT id, array_to_string(list_filter(['account_tier', 'entity', 'risk_signal', 'care_flow', 'event', 'service'], lambda k: coalesce(a[k] <> b[k], false)), ',') AS conflicts FROM q",
        "strip_fence": "WITH b AS (SELECT raw_id, trim(regexp_replace(regexp_replace(trim(body), '^```[A-Za-z]*\\s*', ''), '\\s*```$', '')) AS t FROM raw_episode) SELECT raw_id, len(t)::INT AS length, substr(t, 1, 12) AS start FROM b",
        "parse_labels": f"{eps}, {cand}, k AS (SELECT id, c.id AS candidate_id, c.qwen_teacher.follow * 2.0 AS f, idx FROM e WHERE c IS NOT NULL AND c.qwen_teacher IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, c.id ORDER BY idx DESC) = 1) SELECT id, candidate_id, round({clamp('f')}, 6) AS follow FROM k",
        "teacher_coalesce": f"{eps}, {cand} SELECT id, idx, " + ", ".join(f"round({teacher.format(x)}, 6) AS {x}" for x in ("follow", "read_full", "include", "expand", "stop")) + f", round(coalesce(c.qwen_teacher.result, {teacher.format('include')}), 6) AS result FROM e WHERE c IS NOT NULL",
        "kind_case": f"{eps}, {cand} SELECT id, idx, CASE WHEN coalesce(c.destination_topic = expected_topic, false) THEN 'positive' WHEN round({teacher.format('read_full')}, 6) >= 0.45 THEN 'ambiguous_wrong_topic' ELSE 'wrong_topic_negative' END AS made_kind, CASE WHEN c.kind = 'positive' THEN 'target_answer' WHEN c.kind = 'bridge_positive' THEN 'traversal_bridge_not_answer' WHEN contains(c.kind, 'hard') THEN 'same_domain_wrong_scope_hard_negative' ELSE 'off_domain_or_unrelated_negative' END AS hint FROM e WHERE c IS NOT NULL",
        "distinct_ids": "SELECT source, count(DISTINCT id)::BIGINT AS ids FROM teacher_episode GROUP BY source",
        "manifest_counts": "SELECT source_file, count(*)::BIGINT AS lines, sum(coalesce(len(body), 0))::BIGINT AS characters, max(line_no) AS last_line FROM raw_episode GROUP BY source_file",
        "scan_jsonl": "SELECT src_id, dst_id, confidence, created_at, version FROM edge_frame",
        "resume_antijoin": "SELECT DISTINCT id FROM teacher_episode WHERE id NOT IN (SELECT id FROM teacher_episode WHERE len(list_filter(candidates, lambda c: c IS NOT NULL AND c.qwen_teacher IS NOT NULL)) > 0)",
        "round_robin": "WITH t AS (SELECT DISTINCT metadata['topic'] AS topic FROM node_frame WHERE metadata['topic'] IS NOT NULL), i AS (SELECT topic, row_number() OVER (ORDER BY topic) - 1 AS i FROM t), k AS (SELECT domain, row_number() OVER (ORDER BY domain) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT split_part(topic, ':', 1) AS domain FROM t)) SELECT topic, domain, (i // n)::BIGINT AS turn FROM i JOIN k ON k.k = i.i % k.n",
    }
