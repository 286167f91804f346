"""DuckDB SQL for the queries that SQL can say, all by brute force over all pairs."""

from __future__ import annotations

WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
ONCE = "SELECT * FROM teacher_episode WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1"


def overlap(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"({both} / greatest(1, len({a}) + len({b}) - {both}))"


def share(a: str, b: str) -> str:
    """The share of b's members that a holds."""
    return f"(len(list_intersect({a}, {b})) / len({b}))"


def spelt(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_')"


def side(x: str = "split") -> str:
    return f"CASE WHEN lower(trim({x})) IN ('train', 'training') THEN 0 WHEN lower(trim({x})) IN ('val', 'validation', 'test') THEN 1 END"


P1 = f"""
WITH RECURSIVE once AS ({ONCE}),
w AS (SELECT id, {WORDS.format("concat_ws(' ', query, current_node.summary, current_node.\"full\")")} AS w FROM once WHERE current_node IS NOT NULL AND trim(query) <> ''),
links AS (SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON a.id <> b.id AND {overlap('a.w', 'b.w')} >= 0.75),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)"""

NEAREST = """
SELECT '{name}' AS vec, least(a, b) AS node_a, greatest(a, b) AS node_b FROM (
  SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS c, row_number() OVER (PARTITION BY x.id ORDER BY round(list_cosine_similarity(x.v, y.v), 9) DESC, y.id) AS r
  FROM {name}_v x JOIN {name}_v y ON x.id <> y.id AND list_cosine_similarity(x.v, y.v) >= {least}
) WHERE r <= 5"""


def oracle_sql() -> dict[str, str]:
    vectors = (("summary", 0.97), ("traversal", 0.998), ("full", 0.9))
    p2 = "WITH cur AS (SELECT * FROM node_frame QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY version DESC) = 1), " + ", ".join(
        f"{n}_v AS (SELECT node_id AS id, {n}_vector::DOUBLE[] AS v FROM cur WHERE {n}_vector IS NOT NULL AND list_dot_product({n}_vector::DOUBLE[], {n}_vector::DOUBLE[]) > 0)" for n, _ in vectors
    ) + " SELECT DISTINCT * FROM (" + " UNION ALL ".join(NEAREST.format(name=n, least=x) for n, x in vectors) + ")"
    own = spelt("regexp_extract(id, '^(.*?)-[vqVQ][0-9]+', 1)")
    led = "regexp_matches(expected_topic, '^[^:/]*[A-Za-z0-9][^:/]*[:/]+')"
    p3 = f"""
    WITH RECURSIVE e AS (SELECT DISTINCT id, expected_topic FROM teacher_episode WHERE id IS NOT NULL),
    k AS (
      SELECT id, CASE WHEN expected_topic IS NULL THEN NULL WHEN {led} THEN '1' || {spelt("regexp_extract(expected_topic, '^([^:/]*)[:/]+', 1)")} || ':' || {spelt("regexp_extract(expected_topic, '^[^:/]*[:/]+(.*)$', 1)")} ELSE '1' || {own} || ':' || {spelt('expected_topic')} END AS t,
             CASE WHEN regexp_extract(id, '-[vV][0-9]+-(.+)$', 1) <> '' THEN '2' || {own} || ':' || {spelt("regexp_extract(id, '-[vV][0-9]+-(.+)$', 1)")} END AS q FROM e
    ),
    g AS (SELECT DISTINCT t AS a, q AS b FROM k WHERE t IS NOT NULL AND q IS NOT NULL),
    sym AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
    reach AS (SELECT x AS a, x AS b FROM (SELECT t AS x FROM k WHERE t IS NOT NULL UNION SELECT q FROM k WHERE q IS NOT NULL) UNION SELECT r.a, l.b FROM reach r JOIN sym l ON l.a = r.b),
    c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
    SELECT k.id, CASE WHEN c.m LIKE '1%' THEN substr(c.m, 2) END AS group_key FROM k LEFT JOIN c ON c.a = coalesce(k.t, k.q)"""
    p5 = f"""
    WITH once AS ({ONCE}),
    q AS (SELECT id, {side()} AS s, {WORDS.format('query')} AS w FROM once),
    c AS (SELECT id, {side()} AS s, list_distinct(list_filter(list_transform(list_filter(candidates, lambda x: x IS NOT NULL AND x.node_summary IS NOT NULL), lambda x: array_to_string(regexp_extract_all(lower(x.node_summary), '[a-z0-9]+'), ' ')), lambda y: y <> '')) AS w FROM once),
    v AS (SELECT id, {side()} AS s, query AS w FROM traversal_ranking WHERE query IS NOT NULL AND list_dot_product(query, query) > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1)
    PAIRS SELECT 'query' AS kind, least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b, b.id AS held, {share('a.w', 'b.w')} AS covered FROM q a JOIN q b ON a.s = 0 AND b.s = 1 AND len(a.w) > 0 AND len(b.w) > 0 AND {overlap('a.w', 'b.w')} >= 0.7
    UNION ALL SELECT 'candidates', least(a.id, b.id), greatest(a.id, b.id), b.id, {share('a.w', 'b.w')} FROM c a JOIN c b ON a.s = 0 AND b.s = 1 AND len(a.w) >= 4 AND len(b.w) >= 4 AND {overlap('a.w', 'b.w')} >= 0.7
    UNION ALL SELECT 'ranking', least(a.id, b.id), greatest(a.id, b.id), b.id, list_cosine_similarity(a.w, b.w) FROM v a JOIN v b ON a.s = 0 AND b.s = 1 AND list_cosine_similarity(a.w, b.w) >= 0.995"""
    with_, found = p5.split("PAIRS")
    p5_pairs = f"{with_.rstrip()}, pairs AS ({found})"
    grouped = p3.replace("\n    SELECT k.id, CASE WHEN c.m LIKE '1%' THEN substr(c.m, 2) END AS group_key FROM", ",\n    gr AS (SELECT k.id, c.m AS grp, coalesce(c.m, 'id ' || k.id) AS unit FROM").rstrip() + ")"
    splits = f"""{grouped},
    wanted AS (SELECT list(split ORDER BY split) AS ks, list(share / total ORDER BY split) AS ws FROM split_plan, (SELECT sum(share) AS total FROM split_plan WHERE share > 0) WHERE share > 0),
    sized AS (SELECT unit, count(*) AS n FROM gr GROUP BY unit), rows_ AS (SELECT count(*) AS total FROM gr),
    heavy AS (SELECT unit, n, row_number() OVER (ORDER BY n DESC, unit) AS i FROM sized, rows_ WHERE n > 0.001::DOUBLE * total),
    walk AS (
      SELECT 0::BIGINT AS i, NULL::VARCHAR AS unit, 0::BIGINT AS put, list_transform(ws, lambda w: w * total) AS missing FROM wanted, rows_
      UNION ALL
      SELECT i, unit, best, list_transform(missing, lambda m, x: CASE WHEN x = best THEN m - n ELSE m END) FROM (
        SELECT h.i, h.unit, h.n, w.missing, list_max(list_filter(range(1, len(w.missing) + 1), lambda x: w.missing[x] = list_max(w.missing))) AS best FROM walk w JOIN heavy h ON h.i = w.i + 1)
    ),
    rest AS (SELECT list_transform(missing, lambda m: greatest(m, 0.0)) AS left_ FROM walk ORDER BY i DESC LIMIT 1),
    draws AS (SELECT unit, k, -w / ln((('0x' || substr(md5('7|' || ks[k] || '|' || unit), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS d
              FROM (SELECT unit, ks, unnest(range(1, len(ks) + 1)) AS k, CASE WHEN list_sum(left_) > 0 THEN left_ ELSE ws END AS lw, lw[k] AS w FROM sized, wanted, rest) WHERE w > 0),
    light AS (SELECT unit, arg_max(k, (d, k)) AS k FROM draws GROUP BY unit),
    placed AS (SELECT gr.id, gr.grp, ks[coalesce(walk.put, light.k)] AS split FROM gr JOIN light USING (unit) LEFT JOIN walk ON walk.unit = gr.unit, wanted)"""
    return {
        "p3_splits": f"{splits} SELECT id, grp AS \"group\", split FROM placed",
        "p3_shares": f"{splits} SELECT p.split, count(placed.id)::BIGINT AS episodes, count(DISTINCT grp)::BIGINT AS groups, round(count(placed.id) / (SELECT count(*) FROM placed), 4) AS got, any_value(p.share) AS wanted FROM split_plan p LEFT JOIN placed ON placed.split = p.split GROUP BY p.split",
        "p5_counts": f"""{p5_pairs}, records AS (
          SELECT k AS kind, id, CASE WHEN lower(trim(split)) IN ('val', 'validation') THEN 'validation' WHEN lower(trim(split)) = 'test' THEN 'test' END AS split, source FROM once, (VALUES ('query'), ('candidates')) v(k)
          UNION ALL SELECT 'ranking', id, CASE WHEN lower(trim(split)) IN ('val', 'validation') THEN 'validation' WHEN lower(trim(split)) = 'test' THEN 'test' END, source FROM traversal_ranking WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1
        ), best AS (SELECT kind, held AS id, max(covered) AS covered FROM pairs GROUP BY ALL)
        SELECT r.kind, r.split, r.source, count(*)::BIGINT AS records, count(b.id)::BIGINT AS overlapping, round(coalesce(avg(b.covered), 0), 6) AS covered FROM records r LEFT JOIN best b USING (kind, id) WHERE r.split IS NOT NULL GROUP BY ALL""",
        "p1_found": f"{P1} SELECT a AS id_a, b AS id_b FROM reach WHERE a < b",
        "p1_groups": f"{P1} SELECT w.id, least(w.id, coalesce(min(r.b), w.id)) AS \"group\" FROM w LEFT JOIN reach r ON r.a = w.id GROUP BY w.id",
        "p2_found": p2, "p3_found": p3, "p5_found": f"{p5_pairs} SELECT kind, id_a, id_b FROM pairs",
    }
