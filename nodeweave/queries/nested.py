"""Problem 4: teacher episodes, landed and raw, as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeweave.operators.shred import child, children_of, flat_table, inner_members_of, members_of, shred
from nodeweave.session import stage
from nodeweave.sources.tables import table

#: Paths of an episode that hold many members, and those that may come as one delimited text.
REPEATED = ["path", "path[].terms", "candidates", "candidates[].destination_terms", "candidates[].relation.metadata_conflict"]
SPLIT_TEXT = ["path[].terms", "candidates[].destination_terms", "candidates[].relation.metadata_conflict"]
MAPS = ["query_intent.metadata"]
OBJECTS = ["query_intent", "candidates[].relation", "candidates[]", "path[]"]
WRAPPERS = ("episode", "record", "payload", "data", "body", "item", "value", "result")
LEVELS = {
    "path": "path", "path[].terms": "path_term", "candidates": "candidate", "candidates[].destination_terms": "candidate_term",
    "candidates[].relation.metadata_conflict": "candidate_conflict", "query_intent.metadata": "intent_metadata",
}


RECORD = dict(repeated=REPEATED, split_text=SPLIT_TEXT, maps=MAPS, objects=OBJECTS, marker="id", wrappers=WRAPPERS)

#: Scalar fields of the members of each table, with their types.
NODE = [(x, "string") for x in ("node_id", "summary", "topic", "plain_topic")]
CANDIDATE = [
    *[(x, "string") for x in ("id", "parent_id", "dst_id", "kind", "edge_summary")], ("confidence", "double"), ("hop", "int"), *[(x, "string") for x in ("source_topic", "destination_topic", "destination_plain_topic")],
    *[(f"relation.{x}", "string") for x in ("domain", "source_domain", "tenant", "query_workflow", "candidate_workflow")], ("relation.same_workflow", "boolean"), ("relation.same_domain", "boolean"), ("relation.decision_hint", "string"),
    *[(x, "string") for x in ("retrieval_reason", "node_summary", "node_full", "node_topic")], *[(f"{t}.{x}", "double") for t in ("bootstrap_teacher", "qwen_teacher") for x in ("follow", "read_full", "include", "expand", "stop")], ("qwen_teacher.result", "double"),
]
INTENT = [(f"query_intent.{x}", "string") for x in ("text", "target_topic", "target_plain_topic", "domain", "tenant", "workflow", "region", "severity", "actor")]
VALUE = [("value", "string")]


def _landed(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Episodes of teacher_episode with some of their columns, each id once."""
    return table(spark, d, "teacher_episode").filter("id is not null").select("id", *columns).dropDuplicates(["id"])


def _landed_children(spark: SparkSession, d: str) -> DataFrame:
    """(episode_id, level, parent_pos, child_pos, child_key) of the landed episodes; they are typed already, so their arrays are opened where they are."""
    path, candidates = F.col("path"), F.col("candidates")
    found = children_of(
        members_of("path", path, lambda p: p["node_id"]), inner_members_of("path_term", path, lambda p: p["terms"]),
        members_of("candidate", candidates, lambda c: c["dst_id"]), inner_members_of("candidate_term", candidates, lambda c: c["destination_terms"]),
        inner_members_of("candidate_conflict", candidates, lambda c: c["relation"]["metadata_conflict"]),
        F.transform(F.map_keys("query_intent.metadata"), lambda k: child("intent_metadata", F.lit(-1), F.lit(-1), k)),
    )
    # copies of an id go before its children are made rows
    once = table(spark, d, "teacher_episode").filter("id is not null").select("id", found.alias("children")).dropDuplicates(["id"])
    return once.select(F.col("id").alias("episode_id"), F.inline("children"))


def _raw_rows(spark: SparkSession, d: str, tables: list[str]) -> DataFrame:
    """Shredded rows of the readable bodies, keyed by episode id, a repeated delivery counted once."""
    raw = table(spark, d, "raw_episode").select(F.format_string("%020d", "raw_id").alias("raw"), "body")
    got = stage(shred(raw, "raw", "body", tables=[*tables, ""], **RECORD).filter("table <> '(unreadable)'"), "raw_rows")
    ids = got.filter("table = ''").select("record", F.col("cols")["id"].alias("episode")).groupBy("episode").agg(F.min("record").alias("record"))
    named = got.join(ids.filter("episode is not null"), "record").select(F.col("episode").alias("record"), "table", "ordinals", "cols")
    return named if "" in tables else named.filter("table <> ''")


def p4_landed(spark: SparkSession, d: str) -> DataFrame:
    """The children of the landed episodes alone."""
    return _landed_children(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """One row for each child of each episode, landed or raw."""
    rows = _raw_rows(spark, d, list(LEVELS))
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("table")]
    inner = F.size("ordinals") > 1
    is_map = F.col("table") == "query_intent.metadata"
    key = F.when(F.col("table") == "path", F.col("cols")["node_id"]).when(F.col("table") == "candidates", F.col("cols")["dst_id"]).when(is_map, F.col("cols")["key"]).otherwise(F.col("cols")["value"])
    raw = rows.select(
        F.col("record").alias("episode_id"), level.alias("level"), F.when(inner, F.get("ordinals", F.lit(0))).otherwise(-1).alias("parent_pos"),
        F.when(is_map, F.lit(-1)).when(inner, F.get("ordinals", F.lit(1))).otherwise(F.get("ordinals", F.lit(0))).alias("child_pos"), key.alias("child_key"),
    )
    return _landed_children(spark, d).unionByName(raw)


def _members(spark: SparkSession, d: str, name: str, fields: list[tuple[str, str]]) -> DataFrame:
    """The flat table of the members of one array of the record: (episode_id, pos) and their scalar fields."""
    own = _landed(spark, d, name).select("id", F.posexplode(name).alias("pos", "m")).filter("m is not null")
    landed = own.select(F.col("id").alias("episode_id"), "pos", *[F.col(f"m.{f}").cast(kind).alias(f.replace(".", "_")) for f, kind in fields])
    raw = flat_table(_raw_rows(spark, d, [name]), name, fields)
    return landed.unionByName(raw.withColumnRenamed("record", "episode_id").drop("parent_pos"))


def _values(spark: SparkSession, d: str, outer: str, inner: str) -> DataFrame:
    """The flat table of the texts in an array within the members of an array: (episode_id, parent_pos, pos, value)."""
    own = _landed(spark, d, outer).select("id", F.posexplode(outer).alias("parent_pos", "m")).select("id", "parent_pos", F.posexplode(f"m.{inner}").alias("pos", "value")).filter("value is not null")
    raw = flat_table(_raw_rows(spark, d, [f"{outer}[].{inner}"]), f"{outer}[].{inner}", VALUE)
    return own.withColumnRenamed("id", "episode_id").unionByName(raw.withColumnRenamed("record", "episode_id"))


def p4_path(spark: SparkSession, d: str) -> DataFrame:
    """Path nodes."""
    return _members(spark, d, "path", NODE)


def p4_path_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of path nodes, linked by (episode_id, parent_pos)."""
    return _values(spark, d, "path", "terms")


def p4_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with all fields that hold no further members."""
    return _members(spark, d, "candidates", CANDIDATE)


def p4_candidate_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of candidates, linked by (episode_id, parent_pos)."""
    return _values(spark, d, "candidates", "destination_terms")


def p4_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Metadata conflicts of candidates, linked by (episode_id, parent_pos)."""
    return _values(spark, d, "candidates", "relation.metadata_conflict")


def p4_intents(spark: SparkSession, d: str) -> DataFrame:
    """The scalar fields of each episode's intent; episodes without one give no row."""
    landed = _landed(spark, d, "query_intent").filter("query_intent is not null").select(F.col("id").alias("episode_id"), *[F.col(f).alias(f.replace(".", "_")) for f, _ in INTENT])
    raw = flat_table(_raw_rows(spark, d, [""]), "", INTENT).drop("parent_pos", "pos").withColumnRenamed("record", "episode_id")
    held = F.coalesce(*[F.col(f.replace(".", "_")) for f, _ in INTENT]).isNotNull()
    return landed.unionByName(raw.filter(held))


def p4_intent_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Keys and values of each intent's metadata."""
    landed = _landed(spark, d, "query_intent").select(F.col("id").alias("episode_id"), F.explode("query_intent.metadata").alias("key", "value"))
    raw = flat_table(_raw_rows(spark, d, MAPS), MAPS[0], [("key", "string"), ("value", "string")])
    return landed.unionByName(raw.select(F.col("record").alias("episode_id"), "key", "value"))


def p4_unreadable(spark: SparkSession, d: str) -> DataFrame:
    """Bodies that hold no complete record, with the reason and where they stand."""
    raw = table(spark, d, "raw_episode")
    bad = shred(raw, "raw_id", "body", repeated=REPEATED, marker="id", wrappers=WRAPPERS, tables=["(unreadable)"])
    return bad.select(F.col("record").cast("long").alias("raw_id"), F.col("cols")["reason"].alias("reason")).join(raw.select("raw_id", "source_file", "line_no"), "raw_id")


def queries() -> dict:
    return {f.__name__: f for f in (p4_found, p4_landed, p4_path, p4_path_terms, p4_candidates, p4_candidate_terms, p4_conflicts, p4_intents, p4_intent_metadata, p4_unreadable)}


def oracle_sql() -> dict[str, str]:
    def inner(level: str, outer: str, what: str) -> str:
        return f"SELECT id, '{level}', i, unnest(range(0, len({what}))), unnest({what}) FROM (SELECT id, unnest({outer}) AS m, unnest(range(0, len({outer}))) AS i FROM once) WHERE m IS NOT NULL"

    def outer(level: str, name: str, key: str) -> str:
        return f"SELECT id, '{level}', -1, i, m.{key}, m IS NOT NULL FROM (SELECT id, unnest({name}) AS m, unnest(range(0, len({name}))) AS i FROM once)"

    once = "once AS (SELECT * FROM teacher_episode WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1)"
    flat = [inner("path_term", "path", "m.terms"), inner("candidate_term", "candidates", "m.destination_terms"), inner("candidate_conflict", "candidates", "m.relation.metadata_conflict")]
    members = " UNION ALL ".join(f"SELECT * EXCLUDE (there) FROM ({q}) t(episode_id, level, parent_pos, child_pos, child_key, there) WHERE there" for q in (outer("path", "path", "node_id"), outer("candidate", "candidates", "dst_id")))
    values = " UNION ALL ".join(f"SELECT * FROM ({q}) t(episode_id, level, parent_pos, child_pos, child_key) WHERE child_key IS NOT NULL" for q in flat)
    keys = "SELECT id, 'intent_metadata', -1, -1, unnest(map_keys(query_intent.metadata)) FROM once"
    return {"p4_landed": f"WITH {once} SELECT episode_id, level, parent_pos::INT AS parent_pos, child_pos::INT AS child_pos, child_key FROM ({members} UNION ALL {values} UNION ALL {keys})"}
