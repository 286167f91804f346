"""Pieces of DuckDB SQL for the oracle side: vector expressions and the cleaned base tables.

These are written from the definitions, not from the Spark code, and run on
another engine.
"""

from __future__ import annotations

Q = 100


def d(v: str) -> str:
    return f"({v})::DOUBLE[]"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def clamp(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest(0.0, least(1.0, {x})) END)"


def cos(a: str, b: str) -> str:
    """Cosine of two equally long vectors."""
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {dot(a, a)} = 0 OR {dot(b, b)} = 0 THEN 0.0 ELSE {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})) END)"


def cos01(a: str, b: str) -> str:
    return clamp(f"({cos(a, b)} + 1.0) / 2.0")


def unit(v: str) -> str:
    return f"(CASE WHEN {v} IS NULL THEN NULL WHEN {dot(v, v)} = 0 THEN list_transform({v}, lambda x: 0.0) ELSE list_transform({v}, lambda x: x / sqrt({dot(v, v)})) END)"


def fold(v: str, n: int) -> str:
    """Fold to n places; a null vector folds to zeros, so a caller tells nulls apart by the vector itself."""
    full = f"coalesce({v}, []::DOUBLE[])"
    return f"list_transform(range(0, {n}), lambda k: coalesce(list_sum(list_transform(range(k, len({full}), {n}), lambda i: {full}[i + 1])), 0.0))"


def zipped(a: str, b: str, n: int, body: str) -> str:
    """body in x and y over two vectors of n members."""
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE list_transform(range(1, {n + 1}), lambda i: {body.replace('{x}', f'{a}[i]').replace('{y}', f'{b}[i]')}) END)"


def r6(v: str, places: int = 6) -> str:
    """Every member rounded; adding 0.0 leaves no negative zero."""
    return f"list_transform({v}, lambda x: round(x, {places}) + 0.0)"


NODES = """
nodes AS (
  SELECT node_id, version, summary_vector::DOUBLE[] AS summary, full_vector::DOUBLE[] AS full_, metadata_vector::DOUBLE[] AS meta, traversal_vector::DOUBLE[] AS route,
         coalesce(expressway, false) AS expressway, metadata, summary_payload, full_payload
  FROM node_frame QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY version DESC, ingested_at DESC) = 1
)"""

EFF = f"""
eff0 AS (SELECT *, {zipped('summary', 'meta', 32, '0.78 * {x} + 0.22 * {y}')} AS mixed FROM nodes),
eff AS (SELECT *, CASE WHEN meta IS NULL THEN summary ELSE {unit('mixed')} END AS eff FROM eff0)"""

EDGES = """
edges AS (
  SELECT src_id, dst_id, arg_max(version, v) AS version, arg_max(updated_at, v) AS updated_at, arg_max(confidence, v) FILTER (true) AS confidence0,
         arg_min(created_at, (version, created_at)) AS created_at FROM (SELECT *, (version, updated_at, ingested_at) AS v FROM edge_frame) GROUP BY ALL
)"""

UPSERTED = """
upserted AS (
  SELECT l.src_id, l.dst_id, l.version, l.updated_at, l.confidence, l.edge_vector::DOUBLE[] AS edge_vector, f.created_at
  FROM (SELECT * FROM edge_frame QUALIFY row_number() OVER (PARTITION BY src_id, dst_id ORDER BY version DESC, updated_at DESC, ingested_at DESC, confidence DESC NULLS LAST) = 1) l
  JOIN (SELECT src_id, dst_id, created_at FROM edge_frame QUALIFY row_number() OVER (PARTITION BY src_id, dst_id ORDER BY version, created_at) = 1) f USING (src_id, dst_id)
)"""

PRUNED = """
pruned AS (
  SELECT * FROM (
    SELECT u.*, row_number() OVER (PARTITION BY u.src_id ORDER BY confidence DESC, created_at, dst_id) AS rank
    FROM upserted u WHERE confidence BETWEEN 0 AND 1 AND edge_vector IS NOT NULL AND len(edge_vector) > 0 AND src_id <> dst_id
  ) p LEFT JOIN (SELECT node_id, expressway FROM nodes) n ON n.node_id = p.src_id
  WHERE rank <= CASE WHEN coalesce(expressway, false) THEN 128 ELSE 32 END
)"""


def is_query(col: str = "node_id") -> str:
    return f"regexp_extract({col}, '([0-9]+)$', 1)::BIGINT % {Q} = 0"


EPISODES = "episodes AS (SELECT * FROM teacher_episode QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1)"
CASES = "cases AS (SELECT * FROM traversal_ranking QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1)"

CANDIDATES = f"""
{CASES},
cand AS (
  SELECT id AS case_id, query::DOUBLE[] AS query, current_summary::DOUBLE[] AS current_summary, path::DOUBLE[] AS path, unnest(candidates) AS c, unnest(range(0, len(candidates))) AS idx
  FROM cases
),
flat AS (
  SELECT case_id, idx::INT AS idx, query, current_summary, path, c.id AS candidate_id, c.kind AS kind, c.label AS label0, c.rank_target, c.result_label, c.result_rank_target, c.weight, c.dst_summary::DOUBLE[] AS dst_summary,
         c.edge::DOUBLE[] AS edge, coalesce(c.confidence, 0.0) AS confidence, c.hop AS hop, c.oracle AS oracle FROM cand WHERE c IS NOT NULL
),
sims AS (
  SELECT *, {cos01('query', 'dst_summary')} AS q2d, {cos01('current_summary', 'dst_summary')} AS c2d, {cos01('path', 'dst_summary')} AS p2d, {unit(fold('query', 16))} AS eq FROM flat
),
sims2 AS (SELECT *, {cos01('eq', 'edge')} AS q2e FROM sims),
tgt AS (
  SELECT *, {clamp('0.5 * q2d + 0.15 * c2d + 0.2 * q2e + 0.05 * p2d + 0.1 * confidence - 0.03 * hop')} AS follow, {clamp('0.8 * q2d + 0.1 * q2e + 0.1 * confidence')} AS include,
         coalesce(result_rank_target, CASE WHEN len(oracle) > 5 THEN oracle[6] WHEN len(oracle) > 2 THEN oracle[3] END, result_label, label0) AS result_target FROM sims2
),
m AS (
  SELECT case_id, idx, kind, round(coalesce(follow, 0), 6) AS score, round(coalesce(follow, 0) * 1000000)::BIGINT AS s, coalesce(result_label, CASE WHEN result_target IS NOT NULL THEN (result_target >= 0.65)::INT END, label0, 0)::INT AS label,
         result_target AS oracle, weight FROM tgt
),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, idx) AS rank FROM m)"""
