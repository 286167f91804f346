"""SQL for the graph queries."""

from __future__ import annotations

from nodeweave.queries import sqlx as S
from nodeweave.queries.sqlx import clamp, cos01, dot, fold, is_query, r6, unit, zipped

BASE = f"{S.NODES}, {S.EFF}, {S.UPSERTED}, {S.PRUNED}"
QUERIES = f"q AS (SELECT * FROM eff WHERE {is_query()})"


def _planes(config) -> str:
    return "[" + ", ".join("[" + ", ".join("[" + ", ".join(repr(float(x)) for x in row) + "]::DOUBLE[]" for row in table) + "]" for table in config.planes()) + "]"


def _buckets(source: str, config) -> str:
    """rows (id, table_id, bucket_id) of source(id, v)."""
    bits = " + ".join(f"(CASE WHEN {dot('v', f'p[t + 1][{b + 1}]')} >= 0 THEN {1 << b} ELSE 0 END)" for b in range(config.bits))
    return f"SELECT id, t::INT AS table_id, ({bits})::BIGINT AS bucket_id FROM {source}, planes, range(0, {config.tables}) r(t)"


def lsh(config) -> str:
    """CTEs iv, qv (id, v), ib, qb (buckets) and hits (query_id, node_id, score, matches, rank)."""
    return f"""
    planes AS (SELECT {_planes(config)} AS p),
    iv AS (SELECT node_id AS id, route AS v FROM nodes),
    qv AS (SELECT node_id AS id, {unit(fold('summary', 16))} AS v FROM nodes WHERE {is_query()}),
    ib AS ({_buckets('iv', config)}), qb AS ({_buckets('qv', config)}),
    met AS (SELECT qb.id AS query_id, ib.id AS node_id, count(*)::BIGINT AS matches FROM qb JOIN ib USING (table_id, bucket_id) GROUP BY ALL),
    scored AS (SELECT m.*, 0.75 * (({dot('a.v', 'b.v')} + 1.0) / 2.0) + 0.25 * (matches / {config.tables}) AS score FROM met m JOIN qv a ON a.id = m.query_id JOIN iv b ON b.id = m.node_id),
    hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, matches DESC, node_id) AS rank FROM scored)"""


EDGE_ROWS = f"""
rows0 AS (
  SELECT e.src_id, e.dst_id, e.edge_vector AS edge, e.confidence, s.summary AS query, s.eff AS cur_eff, d.eff AS dst_eff, d.summary AS dst_summary, d.full_ AS dst_full, d.full_[1:32] AS dst_full32, s.metadata['topic'] AS st, d.metadata['topic'] AS dt
  FROM pruned e JOIN eff s ON s.node_id = e.src_id JOIN eff d ON d.node_id = e.dst_id
),
rows1 AS (SELECT *, {unit('cur_eff')} AS path, {unit(fold('query', 16))} AS eq, {unit(fold('dst_summary', 16))} AS ds16, {unit(fold('query', 16))} AS q16 FROM rows0)"""


def heuristic(source: str, name: str, hop: str) -> str:
    """name: source with the six scores; source has query, eq, edge, cur_eff, dst_eff, dst_full, dst_full32, path, confidence."""
    return f"""
    {name}a AS (SELECT *, {cos01('query', 'dst_eff')} AS q2d, {cos01('cur_eff', 'dst_eff')} AS c2d, {cos01('eq', 'edge')} AS q2e, {cos01('path', 'dst_eff')} AS p2d, {cos01('query', 'dst_full32')} AS q2f FROM {source}),
    {name}b AS (SELECT *, {clamp(f'0.5 * q2d + 0.15 * c2d + 0.2 * q2e + 0.05 * p2d + 0.1 * confidence - 0.03 * {hop}')} AS follow, {clamp('0.8 * q2d + 0.1 * q2e + 0.1 * confidence')} AS sinc FROM {name}a),
    {name}c AS (SELECT *, CASE WHEN dst_full IS NULL THEN sinc ELSE {clamp('0.55 * sinc + 0.45 * q2f')} END AS include, CASE WHEN dst_full IS NULL THEN sinc ELSE {clamp('0.75 * sinc + 0.25 * follow')} END AS read_full, {clamp(f'0.8 * follow + 0.2 * c2d - 0.05 * {hop}')} AS expand FROM {name}b),
    {name} AS (SELECT *, {clamp('1.0 - expand')} AS stop, {clamp('0.8 * include + 0.15 * read_full + 0.05 * follow')} AS result FROM {name}c)"""


def traversal(config, seeds: str = "SELECT node_id AS query_id, node_id AS seed_id FROM q") -> str:
    """CTEs up to decisions: the hops written out one after another."""
    parts = [
        f"seeds AS (SELECT DISTINCT * FROM ({seeds}))",
        "front0 AS (SELECT query_id, node_id, [node_id] AS path_ids, eff AS path_sum, eff AS cur_eff, 0 AS jumps, expressway FROM seeds JOIN eff ON node_id = seed_id)",
        "seen0 AS (SELECT query_id, node_id FROM front0)",
        "used0 AS (SELECT node_id AS query_id, 0 AS n_seen, 0 AS n_read FROM q)",
    ]
    order = "e.confidence DESC, e.created_at, e.dst_id"
    for h in range(config.max_hops):
        parts.append(f"""
        c{h} AS (
          SELECT f.query_id, f.node_id AS src_id, f.path_ids, f.path_sum, f.cur_eff, f.jumps, f.expressway AS src_x, e.dst_id, e.confidence, e.created_at, e.edge_vector AS edge, row_number() OVER (PARTITION BY f.query_id, f.node_id ORDER BY {order}) AS fan
          FROM front{h} f JOIN pruned e ON e.src_id = f.node_id JOIN nodes n ON n.node_id = e.dst_id WHERE NOT EXISTS (SELECT 1 FROM seen{h} s WHERE s.query_id = f.query_id AND s.node_id = e.dst_id)
        ),
        k{h} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src_id, confidence DESC, created_at, dst_id) AS seq FROM c{h} WHERE fan <= CASE WHEN src_x THEN {config.expressway_fanout} ELSE {config.fanout} END),
        i{h} AS (
          SELECT k.*, u.n_read, q.summary AS query, {unit(fold('q.summary', 16))} AS eq, {unit('k.path_sum')} AS path, d.eff AS dst_eff, d.full_ AS dst_full, d.full_[1:32] AS dst_full32, d.expressway AS dst_x
          FROM k{h} k JOIN used{h} u USING (query_id) JOIN q ON q.node_id = k.query_id JOIN eff d ON d.node_id = k.dst_id WHERE seq <= {config.max_visited} - n_seen
        ),
        {heuristic(f'i{h}', f's{h}', str(h))},
        t{h} AS (
          SELECT *, jumps + dst_x::INT AS next_jumps, greatest(include, read_full) AS critical_score, dst_full IS NOT NULL AND read_full >= {config.read_full_threshold} AS eligible FROM s{h}
        ),
        g{h} AS (
          SELECT *, critical_score >= {config.critical_threshold} AS critical, include >= {config.include_threshold} OR critical_score >= {config.critical_threshold} AS included,
                 (expand >= {config.expand_threshold} OR (dst_x AND next_jumps <= {config.max_expressway_jumps} AND follow >= {config.expressway_threshold})) AND stop < 0.95 AS expanded,
                 eligible AND sum(eligible::INT) OVER (PARTITION BY query_id ORDER BY seq ROWS UNBOUNDED PRECEDING) <= {config.max_full_reads} - n_read AS read_flag,
                 row_number() OVER (PARTITION BY query_id, dst_id ORDER BY follow DESC, confidence DESC, dst_id, seq) AS again
          FROM t{h}
        ),
        w{h} AS (
          SELECT *, row_number() OVER w AS walk, coalesce(sum(expanded::INT) OVER (PARTITION BY query_id ORDER BY follow DESC, confidence DESC, dst_id, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
          FROM g{h} WHERE again = 1 WINDOW w AS (PARTITION BY query_id ORDER BY follow DESC, confidence DESC, dst_id, seq)
        ),
        a{h} AS (SELECT * FROM w{h} WHERE {'walk = 1' if config.mode == 'single_path' else f'ahead < {config.beam_width}'}),
        used{h + 1} AS (
          SELECT u.query_id, n_seen + coalesce((SELECT count(*) FROM a{h} a WHERE a.query_id = u.query_id), 0) AS n_seen, n_read + coalesce((SELECT count(*) FROM g{h} g WHERE g.query_id = u.query_id AND read_flag), 0) AS n_read FROM used{h} u
        ),
        seen{h + 1} AS (SELECT * FROM seen{h} UNION ALL SELECT query_id, dst_id FROM a{h}),
        front{h + 1} AS (
          SELECT query_id, dst_id AS node_id, list_append(path_ids, dst_id) AS path_ids, {zipped('path_sum', 'dst_eff', 32, '{x} + {y}')} AS path_sum, dst_eff AS cur_eff, next_jumps AS jumps, dst_x AS expressway FROM a{h} WHERE expanded
        )""")
    union = " UNION ALL ".join(
        f"SELECT query_id, dst_id AS node_id, src_id AS parent_id, {h + 1} AS hop, follow, include, result, read_flag AS read_full_flag, included, expanded, critical, next_jumps AS expressway_jumps, array_to_string(list_append(path_ids, dst_id), '>') AS path FROM a{h}"
        for h in range(config.max_hops)
    )
    return ", ".join([*parts, f"decisions AS ({union})"])


SHOWN = "SELECT query_id, node_id, parent_id, hop, round(follow, 6) AS follow, round(result, 6) AS result, read_full_flag, included, expanded, critical, expressway_jumps, path FROM decisions"
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY result DESC, include DESC, follow DESC, hop, node_id) AS included_rank FROM decisions WHERE included)"


def topk(nodes: str, v: str, score: str, limit: int, name: str = "top") -> str:
    """name(query_id, node_id, score, rank): score is over a (the query) and b (the node)."""
    return f"{name} AS (SELECT a.node_id AS query_id, b.node_id, {score} AS score, row_number() OVER (PARTITION BY a.node_id ORDER BY round({score}, 9) DESC, b.node_id) AS rank FROM {nodes} QUALIFY rank <= {limit})"


NEAR = cos01("a.summary", "b.eff")

NEIGHBOURS = f"""
tp AS (SELECT node_id, summary, coalesce(metadata['topic'], '') AS topic FROM eff),
pr AS (SELECT a.node_id AS query_id, b.node_id, a.topic = b.topic AS same, {cos01('a.summary', 'b.summary')} AS score FROM tp a JOIN tp b ON {is_query('a.node_id')}),
nb AS (SELECT *, row_number() OVER (PARTITION BY query_id, same ORDER BY round(score, 9) DESC, node_id) AS place FROM pr QUALIFY place <= CASE WHEN same THEN 4 ELSE 6 END),
neighbours AS (SELECT query_id, node_id, CASE WHEN same THEN 'nearest_target_topic_candidate' ELSE 'lexical_hard_negative_candidate' END AS reason, place FROM nb WHERE query_id <> node_id)"""

UNION = f"""{NEIGHBOURS},
al AS (SELECT src_id AS parent_id, dst_id, confidence, 0 AS tier, 'outgoing_seed_edge' AS reason FROM pruned WHERE {is_query('src_id')} AND src_id IN (SELECT node_id FROM nodes)
       UNION ALL SELECT query_id, node_id, CASE WHEN reason LIKE 'lexical%' THEN 0.58 ELSE 0.82 END, CASE WHEN reason LIKE 'lexical%' THEN 2 ELSE 1 END, reason FROM neighbours),
un AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY parent_id, dst_id ORDER BY tier) = 1)"""


def _attach_rows() -> str:
    return f"""
    ar AS (SELECT e.src_id, e.dst_id, s.eff AS ne, d.eff AS ce, s.summary AS ns, d.summary AS cs, s.full_ AS nf, d.full_ AS cf, s.route AS nr, d.route AS cr FROM pruned e JOIN eff s ON s.node_id = e.src_id JOIN eff d ON d.node_id = e.dst_id),
    ap AS (SELECT *, {unit('ce')} AS path FROM ar)"""


def insertion(config) -> str:
    """CTEs up to attached(new_id, node_id, score, rank): query nodes taken out and delivered again, one hop."""
    c = config.traversal
    return f"""
    fresh AS (SELECT * FROM eff WHERE {is_query()}),
    everything AS (SELECT * FROM eff),
    old AS (SELECT * FROM everything WHERE NOT ({is_query()})),
    sd AS (SELECT a.node_id AS query_id, b.node_id AS seed_id FROM fresh a, old b QUALIFY row_number() OVER (PARTITION BY a.node_id ORDER BY round({NEAR}, 9) DESC, b.node_id) = 1),
    c0 AS (
      SELECT s.query_id, s.seed_id AS src_id, f.summary AS query, o.eff AS cur_eff, {unit('o.eff')} AS path, {unit(fold('f.summary', 16))} AS eq, e.dst_id, e.confidence, e.created_at, e.edge_vector AS edge, d.eff AS dst_eff, d.full_ AS dst_full, d.full_[1:32] AS dst_full32, d.expressway AS dst_x,
             row_number() OVER (PARTITION BY s.query_id ORDER BY e.confidence DESC, e.created_at, e.dst_id) AS fan, o.expressway AS src_x
      FROM sd s JOIN fresh f ON f.node_id = s.query_id JOIN old o ON o.node_id = s.seed_id JOIN pruned e ON e.src_id = s.seed_id JOIN old d ON d.node_id = e.dst_id WHERE e.dst_id <> s.seed_id
    ),
    k0 AS (SELECT * FROM c0 WHERE fan <= CASE WHEN src_x THEN {c.expressway_fanout} ELSE {c.fanout} END),
    {heuristic('k0', 's0', '0')},
    g0 AS (SELECT *, (expand >= {c.expand_threshold} OR (dst_x AND dst_x::INT <= {c.max_expressway_jumps} AND follow >= {c.expressway_threshold})) AND stop < 0.95 AS expanded FROM s0),
    w0 AS (SELECT *, coalesce(sum(expanded::INT) OVER (PARTITION BY query_id ORDER BY follow DESC, confidence DESC, dst_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM g0),
    cd AS (
      SELECT query_id, seed_id AS node_id, o.eff AS psum FROM sd JOIN old o ON o.node_id = seed_id
      UNION ALL SELECT query_id, dst_id, {zipped('cur_eff', 'dst_eff', 32, '{x} + {y}')} FROM w0 WHERE ahead < {c.beam_width}
    ),
    ai AS (SELECT cd.query_id, cd.node_id, {unit('psum')} AS path, f.eff AS ne, f.summary AS ns, f.full_ AS nf, o.eff AS ce, o.summary AS cs, o.full_ AS cf FROM cd JOIN fresh f ON f.node_id = cd.query_id JOIN old o ON o.node_id = cd.node_id),
    sc AS (SELECT *, {clamp(f"0.6 * {cos01('ne', 'ce')} + 0.3 * coalesce({cos01('nf', 'cf')}, {cos01('ns', 'cs')}) + 0.1 * {cos01('path', 'ce')}")} AS score FROM ai),
    attached AS (SELECT query_id AS new_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank, ne, ce FROM sc WHERE score >= {config.threshold} QUALIFY rank <= {config.limit})"""


def _array(x) -> str:
    return "[" + ", ".join(f"{float(v):.17e}" for v in x) + "]::DOUBLE[]"


def perceptron(weights: dict, features: str, source: str) -> str:
    """CTEs up to net: source with ``y``, the outputs of a three-layer perceptron over the feature list ``features``."""
    def layer(k: int, x: str) -> str:
        return f"list_transform(range(1, {len(weights[f'l{k}']['b'])} + 1), lambda i: list_dot_product(w{k}[i], {x}) + b{k}[i])"

    t = "(1e0 / (1e0 + 0.3275911e0 * abs(v) / sqrt(2e0)))"
    erf = f"(1e0 - (((((1.061405429e0 * {t} - 1.453152027e0) * {t}) + 1.421413741e0) * {t} - 0.284496736e0) * {t} + 0.254829592e0) * {t} * exp(-v * v / 2e0))"
    gelu = f"lambda v: v * 0.5e0 * (1e0 + sign(v) * {erf})"
    held = ", ".join(f"[{', '.join(_array(r) for r in weights[n]['w'])}] AS w{n[1]}, {_array(weights[n]['b'])} AS b{n[1]}" for n in ("l0", "l1", "l2"))
    return f"""
    nn AS (SELECT {held}), f0 AS (SELECT *, {features} AS x FROM {source}),
    f1 AS (SELECT f0.*, w1, b1, w2, b2, list_transform({layer(0, 'x')}, {gelu}) AS h0 FROM f0, nn),
    f2 AS (SELECT *, list_transform({layer(1, 'h0')}, {gelu}) AS h1 FROM f1), net AS (SELECT *, list_transform({layer(2, 'h1')}, lambda v: 1e0 / (1e0 + exp(-v))) AS y FROM f2)"""


def _compared(pairs: list[tuple[str, str, int]]) -> str:
    return " || ".join(f"{zipped(a, b, n, body)}" for a, b, n in pairs for body in ("{x} * {y}", "abs({x} - {y})"))


def oracle_sql() -> dict[str, str]:
    from nodeweave.plans.insert import InsertConfig
    from nodeweave.plans.traverse import TraversalConfig
    from nodeweave.queries.graph_queries import CONFIG, LIMIT, MLP, TRAVERSALS

    def w(ctes: str, tail: str) -> str:
        return f"WITH {ctes} {tail}"

    index = lsh(CONFIG)
    six = ", ".join(f"round({s}, 6) AS {s}" for s in ("follow", "read_full", "include", "expand", "stop", "result"))
    by_index = "SELECT query_id, node_id AS seed_id FROM hits WHERE rank <= 4"
    out = {
        "node_upsert": w(S.NODES, "SELECT node_id, version, expressway, full_ IS NOT NULL AS has_full FROM nodes"),
        "edge_upsert": w(S.UPSERTED, "SELECT src_id, dst_id, version, confidence, created_at, updated_at FROM upserted"),
        "edge_refused": w(f"{S.NODES}, {S.UPSERTED}", "SELECT CASE WHEN src_id IS NULL OR dst_id IS NULL THEN 'missing end' WHEN src_id = dst_id THEN 'self edge' WHEN confidence IS NULL OR confidence < 0 OR confidence > 1 OR isnan(confidence) THEN 'confidence' WHEN edge_vector IS NULL OR len(edge_vector) = 0 THEN 'edge vector' WHEN src_id NOT IN (SELECT node_id FROM nodes) THEN 'unknown source' WHEN dst_id NOT IN (SELECT node_id FROM nodes) THEN 'unknown destination' END AS reason, count(*)::BIGINT AS edges FROM upserted GROUP BY 1 HAVING reason IS NOT NULL"),
        "edges_ordered": w(BASE, "SELECT src_id, rank::BIGINT AS place, dst_id, confidence FROM pruned"),
        "edge_prune": w(BASE, "SELECT src_id, count(*)::BIGINT AS kept, min(confidence) AS weakest FROM pruned GROUP BY src_id"),
        "nearest_summary": w(f"{S.NODES}, {S.EFF}, {QUERIES}, {topk('q a, eff b', 'eff', NEAR, LIMIT)}", "SELECT query_id, node_id, round(score, 6) AS score, rank::BIGINT AS rank FROM top"),
        "exact_topk": w(f"{S.NODES}, u AS (SELECT node_id, {unit('summary')} AS v FROM nodes), q AS (SELECT * FROM u WHERE {is_query()}), {topk('q a, u b', 'v', dot('a.v', 'b.v'), LIMIT)}", "SELECT query_id, node_id, round(score, 6) AS score, rank::BIGINT AS rank FROM top"),
        "lsh_buckets": w(f"{S.NODES}, {index}", "SELECT id, table_id, bucket_id FROM ib"),
        "lsh_replace": w(f"{S.NODES}, {index}, dc AS (SELECT node_id AS id FROM nodes WHERE metadata['kind'] = 'decoy'), nv AS (SELECT id, list_transform(v, lambda x: -x) AS v FROM iv WHERE id IN (SELECT id FROM dc)), rm AS (SELECT node_id AS id FROM nodes WHERE expressway), nbk AS ({_buckets('nv', CONFIG)}), af AS (SELECT * FROM ib WHERE id NOT IN (SELECT id FROM dc) AND id NOT IN (SELECT id FROM rm) UNION ALL SELECT * FROM nbk WHERE id NOT IN (SELECT id FROM rm))", "SELECT table_id, bucket_id, count(*)::BIGINT AS nodes FROM af GROUP BY ALL"),
        "lsh_query": w(f"{S.NODES}, {index}", f"SELECT query_id, node_id, round(score, 6) AS score, matches, rank::BIGINT AS rank FROM hits WHERE rank <= {LIMIT}"),
        "lsh_seeds": w(f"{S.NODES}, {index}", "SELECT query_id, node_id FROM hits WHERE rank <= 4"),
        "seed_fill": w(f"{S.NODES}, {S.EFF}, {QUERIES}, {index}, {topk('q a, eff b', 'eff', NEAR, 4)}, bt AS (SELECT query_id, node_id, 0 AS tier, rank FROM hits WHERE rank <= 4 UNION ALL SELECT query_id, node_id, 1, rank FROM top), ob AS (SELECT * FROM bt QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY tier, rank) = 1)", "SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank, node_id)::BIGINT AS place FROM ob QUALIFY place <= 4"),
        "score_edge": w(f"{BASE}, {EDGE_ROWS}, {heuristic('rows1', 'sc', '0')}", f"SELECT src_id, dst_id, {six} FROM sc"),
        "score_relation": w(f"{BASE}, {EDGE_ROWS}, r2 AS (SELECT *, {unit(fold('path', 16))} AS p16 FROM rows1), sc AS (SELECT *, {clamp('0.68 * ' + cos01('q16', 'edge') + ' + 0.18 * ' + cos01('q16', 'ds16') + ' + 0.04 * ' + cos01('p16', 'ds16') + ' + 0.1 * confidence')} AS follow FROM r2)", "SELECT src_id, dst_id, round(follow, 6) AS follow, round(follow, 6) AS read_full, round(follow, 6) AS include, 0.0::DOUBLE AS expand, 1.0::DOUBLE AS stop, round(follow, 6) AS result FROM sc"),
        "bootstrap_teacher": w(f"{BASE}, {EDGE_ROWS}, b0 AS (SELECT *, CASE WHEN st = dt THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t, {cos01('query', 'dst_eff')} AS qm, {cos01('eq', 'edge')} AS em, {cos01('path', 'dst_eff')} AS pm, {cos01('cur_eff', 'dst_eff')} AS cm FROM rows1), b1 AS (SELECT *, {clamp('0.58 * t + 0.22 * qm + 0.12 * em + 0.08 * confidence')} AS follow, {clamp('0.65 * t + 0.25 * qm + 0.1 * pm')} AS include, {clamp('0.5 * t + 0.2 * cm + 0.2 * confidence + 0.1 * em')} AS expand FROM b0), b2 AS (SELECT *, {clamp('0.45 * (1.0 - 2.0 * abs(qm - 0.5)) + 0.25 * (1.0 - t) + 0.3 * include')} AS read_full, {clamp('1.0 - expand')} AS stop FROM b1)", "SELECT src_id, dst_id, round(follow, 6) AS follow, round(read_full, 6) AS read_full, round(include, 6) AS include, round(expand, 6) AS expand, round(stop, 6) AS stop FROM b2"),
        "score_attach": w(f"{BASE}, {_attach_rows()}", f"SELECT src_id, dst_id, round({clamp('0.6 * ' + cos01('ne', 'ce') + ' + 0.3 * coalesce(' + cos01('nf', 'cf') + ', ' + cos01('ns', 'cs') + ') + 0.1 * ' + cos01('path', 'ce'))}, 6) AS attach FROM ap"),
        "score_relation_attach": w(f"{BASE}, {_attach_rows()}", f"SELECT src_id, dst_id, round({clamp('0.7 * ' + cos01('nr', 'cr') + ' + 0.2 * ' + cos01('ns', 'cs') + ' + 0.1 * ' + cos01('path', 'cs'))}, 6) AS attach FROM ap"),
        "traverse_included": w(f"{BASE}, {QUERIES}, {traversal(TraversalConfig(max_hops=2))}, {RANKED}", "SELECT query_id, node_id, included_rank::BIGINT AS included_rank FROM ranked"),
        "traverse_rejected": w(f"{BASE}, {QUERIES}, {traversal(TraversalConfig(max_hops=2))}", "SELECT query_id, node_id FROM decisions WHERE NOT included"),
        "insert_attach": w(f"{BASE}, {insertion(InsertConfig(traversal=TraversalConfig(max_hops=1)))}", "SELECT new_id, node_id, round(score, 6) AS score, rank::BIGINT AS rank FROM attached"),
        "insert_edges": w(f"{BASE}, {insertion(InsertConfig(traversal=TraversalConfig(max_hops=1)))}, ev AS (SELECT *, {zipped('ne', 'ce', 32, 'tanh(0.8 * ({y} - {x}) + 0.4 * {x} * {y})')} AS f, {zipped('ce', 'ne', 32, 'tanh(0.8 * ({y} - {x}) + 0.4 * {x} * {y})')} AS b FROM attached)", f"SELECT new_id AS src_id, node_id AS dst_id, {r6(unit('f'))} AS edge_vector, round(score, 6) AS confidence FROM ev UNION ALL SELECT node_id, new_id, {r6(unit('b'))}, round(score, 6) FROM ev"),
        "eval_retrieval": w(f"{S.NODES}, {index}, ex AS (SELECT a.id AS query_id, b.id AS node_id FROM qv a, iv b QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round({cos01('a.v', 'b.v')}, 9) DESC, b.id) <= {LIMIT}), ht AS (SELECT h.query_id, count(*) AS returned, count(ex.node_id) AS hits, min(rank) FILTER (ex.node_id IS NOT NULL) AS first FROM hits h LEFT JOIN ex USING (query_id, node_id) WHERE rank <= {LIMIT} GROUP BY 1), wn AS (SELECT query_id, count(*) AS n FROM ex GROUP BY 1)", f"SELECT query_id, coalesce(returned, 0)::BIGINT AS returned, round(coalesce(hits, 0) / {LIMIT}, 6) AS precision, round(coalesce(hits, 0) / n, 6) AS recall, (coalesce(hits, 0) > 0)::INT AS hit, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr FROM wn LEFT JOIN ht USING (query_id)"),
        "topic_neighbors": w(f"{S.NODES}, {S.EFF}, {NEIGHBOURS}", "SELECT query_id, node_id, reason, place::BIGINT AS place FROM neighbours"),
        "candidate_union": w(f"{BASE}, {UNION}", "SELECT parent_id, dst_id, confidence::DOUBLE AS confidence, reason FROM un"),
        "quota_topk": w(f"{BASE}, {UNION}, rr AS (SELECT *, row_number() OVER (PARTITION BY parent_id, reason ORDER BY confidence DESC, dst_id) AS r FROM un), tt AS (SELECT *, CASE WHEN reason = 'nearest_target_topic_candidate' AND r <= 3 THEN 0 WHEN reason = 'lexical_hard_negative_candidate' AND r <= 4 THEN 1 ELSE 2 END AS tier2 FROM rr)", "SELECT parent_id, dst_id, reason, row_number() OVER (PARTITION BY parent_id ORDER BY tier2, confidence DESC, dst_id)::BIGINT AS place FROM tt QUALIFY place <= 12"),
    }
    edge_x = "query || cur_eff || edge || dst_eff || path || [confidence, 0e0] || " + _compared([("query", "dst_eff", 32), ("cur_eff", "dst_eff", 32), ("path", "dst_eff", 32), ("eq", "edge", 16)])
    out["score_mlp"] = w(f"{BASE}, {EDGE_ROWS}, {perceptron(MLP.weights['edge'], edge_x, 'rows1')}", "SELECT src_id, dst_id, " + ", ".join(f"round(y[{i + 1}], 6) AS {n}" for i, n in enumerate(("follow", "read_full", "include", "expand", "stop", "result"))) + " FROM net")
    attach_x = "ne || ce || nf64 || cf64 || path || " + _compared([("ne", "ce", 32), ("nf64", "cf64", 64), ("path", "ce", 32)])
    wide = ", ".join(f"coalesce({f}, {unit(fold(v, 64))}) AS {f}64" for f, v in (("nf", "ns"), ("cf", "cs")))
    out["attach_mlp"] = w(f"{BASE}, {_attach_rows()}, a6 AS (SELECT *, {wide} FROM ap), {perceptron(MLP.weights['attach'], attach_x, 'a6')}", "SELECT src_id, dst_id, round(y[1], 6) AS attach FROM net")
    for name, given in TRAVERSALS.items():
        kw = {k: v for k, v in given.items() if k != "seeds"}
        config = TraversalConfig(**({"max_hops": 2} | kw))
        if given.get("seeds") == "index":
            out[name] = w(f"{BASE}, {QUERIES}, {index}, {traversal(config, by_index)}", SHOWN)
        else:
            out[name] = w(f"{BASE}, {QUERIES}, {traversal(config)}", SHOWN)
    small = TraversalConfig(max_hops=2, fanout=6, beam_width=6)
    walk = f"{BASE}, {QUERIES}, {index}, {traversal(small, by_index)}, {RANKED}"
    out["compare_methods"] = w(f"{walk}, {topk('q a, eff b', 'eff', NEAR, LIMIT)}, al AS (SELECT query_id, node_id, 'exact' AS method FROM top UNION ALL SELECT query_id, node_id, 'index' FROM hits WHERE rank <= {LIMIT} UNION ALL SELECT query_id, node_id, 'traversal' FROM ranked WHERE included_rank <= {LIMIT}), tp AS (SELECT node_id, coalesce(metadata['topic'], '') AS topic FROM nodes)", "SELECT method, count(*)::BIGINT AS returned, count(DISTINCT query_id)::BIGINT AS queries, round(avg((a.topic = b.topic)::INT), 6) AS same_topic FROM al JOIN tp a ON a.node_id = al.node_id JOIN tp b ON b.node_id = al.query_id GROUP BY method")
    out["indexed_purity"] = w(f"{walk}, tp AS (SELECT node_id, coalesce(metadata['topic'], '') AS topic FROM nodes)", "SELECT q.node_id AS query_id, count(d.node_id)::BIGINT AS included, round(coalesce(avg((a.topic = b.topic)::INT), 0), 6) AS purity FROM q LEFT JOIN decisions d ON d.query_id = q.node_id AND d.included LEFT JOIN tp a ON a.node_id = d.node_id LEFT JOIN tp b ON b.node_id = q.node_id GROUP BY 1")
    return out
