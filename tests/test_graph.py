import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from nodeweave.operators import index as I
from nodeweave.operators.graph import current_nodes, edge_faults, prune_edges, upsert_edges, valid_edges
from nodeweave.operators.scorers import SCORES, FixedScorer
from nodeweave.plans.insert import InsertConfig, attach, insert_batch, insert_in_order
from nodeweave.plans.traverse import TraversalConfig, ranked, traverse

T0 = dt.datetime(2024, 1, 1)
EDGE = "src_id string, dst_id string, edge_vector array<float>, confidence double, created_at bigint, updated_at bigint, version int, ingested_at timestamp"
NODE = "node_id string, summary_vector array<float>, full_vector array<float>, summary_payload string, full_payload string, metadata map<string, string>, expressway boolean, metadata_vector array<float>, traversal_vector array<float>, version int, ingested_at timestamp"


def node(name, summary=(1.0, 0.0), full=None, expressway=None, version=1, at=0):
    return (name, list(summary), full, name, None, {"topic": "t"}, expressway, None, None, version, T0 + dt.timedelta(days=at))


def edge(a, b, conf=0.5, created=0, updated=0, version=1, at=0, vector=(1.0, 0.0)):
    return (a, b, None if vector is None else list(vector), conf, created, updated, version, T0 + dt.timedelta(days=at))


def test_upserts(spark):
    n = current_nodes(spark.createDataFrame([node("a", version=2), node("a", version=1, at=9), node("a", version=2)], NODE))
    assert [(r["node_id"], r["version"], r["expressway"], r["metadata"]) for r in n.collect()] == [("a", 2, False, {"topic": "t"})]
    e = upsert_edges(spark.createDataFrame([edge("a", "b", 0.9, created=7, version=1), edge("a", "b", 0.4, created=99, version=2, at=-3)], EDGE)).first()
    assert (e["confidence"], e["created_at"], e["version"]) == (0.4, 7, 2), "the last version's values, the first one's creation"


def test_faults_are_named_and_nothing_is_dropped_silently(spark):
    rows = [edge("a", "a"), edge("a", "b", 1.5), edge("a", "b", None), edge("a", "c", vector=None), edge("a", "x"), edge("a", "b"), edge(None, "b")]
    got = edge_faults(spark.createDataFrame(rows, EDGE), spark.createDataFrame([("a",), ("b",)], "node_id string"))
    assert sorted(r["reason"] for r in got.collect()) == ["confidence", "confidence", "edge vector", "missing end", "self edge", "unknown destination"]


def test_prune_keeps_the_best(spark):
    rows = [edge("a", f"d{i:03d}", (i % 5) / 10, created=i % 3) for i in range(200)] + [edge("h", f"d{i:03d}", 0.5) for i in range(200)]
    nodes = spark.createDataFrame([("a", False), ("h", True)], "node_id string, expressway boolean")
    kept = prune_edges(spark.createDataFrame(rows, EDGE), nodes).collect()
    by = {s: sorted((r for r in kept if r["src_id"] == s), key=lambda r: r["rank"]) for s in "ah"}
    want = sorted((e for e in rows if e[0] == "a"), key=lambda e: (-e[3], e[4], e[1]))[:32]
    assert [r["dst_id"] for r in by["a"]] == [e[1] for e in want] and len(by["h"]) == 128
    with pytest.raises(ValueError):
        prune_edges(spark.createDataFrame(rows, EDGE), nodes, 0)


def test_index(spark):
    c = I.IndexConfig(dims=2, tables=2, bits=3)
    rows = spark.createDataFrame([("zero", [0.0, 0.0]), ("a", [1.0, 0.0]), ("b", [-1.0, 0.0])], "id string, v array<double>")
    b = I.buckets(rows, "id", F.col("v"), c)
    assert {r["bucket_id"] for r in b.collect() if r["id"] == "zero"} == {7}
    q = spark.createDataFrame([("q", [1.0, 0.0])], "id string, v array<double>")
    hits = I.query_index(b, rows, q.select(F.col("id").alias("query_id"), F.col("v").alias("q")), I.buckets(q, "id", F.col("v"), c), 2, 5).collect()
    assert hits[0]["node_id"] == "a" and hits[0]["score"] == 1.0 and hits[0]["matches"] == 2
    after = I.replace_buckets(b, I.buckets(q.withColumn("id", F.lit("b")), "id", F.col("v"), c), spark.createDataFrame([("a",)], "id string"))
    assert {r["id"] for r in after.collect()} == {"zero", "b"}
    with pytest.raises(ValueError):
        I.IndexConfig(bits=0)


def test_exact_search_ties_nulls_and_empty(spark):
    n = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "id string, v array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("none", None)], "query_id string, q array<double>")
    got = I.exact_topk(n, "id", "v", q, 3).orderBy("rank").collect()
    assert [(r["node_id"], round(r["score"], 6)) for r in got] == [("a", 1.0), ("b", 1.0), ("z", 0.5)]
    assert I.exact_topk(n, "id", "v", q.limit(0), 3).count() == 0 and I.exact_topk(n.limit(0), "id", "v", q, 3).count() == 0


@pytest.mark.parametrize("held", [100_000_000, 900])
def test_exact_search_in_passes_and_groups(spark, monkeypatch, held):
    monkeypatch.setattr(I, "HELD_BYTES", held)
    rng = random.Random(held)
    rows = [(f"n{i:03d}", [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)], f"g{i % 3}") for i in range(120)]
    asked = [(f"q{i:02d}", [rng.uniform(-1, 1) for _ in range(3)], f"g{i % 4}") for i in range(20)]
    n, q = spark.createDataFrame(rows, "id string, v array<double>, g string"), spark.createDataFrame(asked, "query_id string, q array<double>, g string")

    def best(x, some, k):
        return [i for _, i in sorted((-round(sum(a * b for a, b in zip(x, v)), 9), i) for i, v in some)][:k]

    got = I.exact_topk(n, "id", "v", q, 5, cosine=False).collect()
    assert {x: [r["node_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == x] for x, _, _ in asked} == {x: best(v, [(i, w) for i, w, _ in rows], 5) for x, v, _ in asked}
    got = I.exact_topk(n, "id", "v", q, 2, cosine=False, group="g", others=3).collect()
    for x, v, g in asked:
        for same, k in ((True, 2), (False, 3)):
            assert [r["node_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == x and r["same"] == same] == best(v, [(i, w) for i, w, h in rows if (h == g) == same], k)


def test_index_by_broadcast_and_by_salts(spark, monkeypatch):
    rng = random.Random(3)
    v = spark.createDataFrame([(f"n{i:03d}", [0.0, 0.0] if i % 3 == 0 else [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for i in range(90)], "id string, v array<double>")
    c = I.IndexConfig(dims=2, tables=2, bits=3)
    q = v.filter("id < 'n010'")

    def ask():
        b = I.buckets(v, "id", F.col("v"), c)
        return sorted(tuple(r) for r in I.query_index(b, v, q.select(F.col("id").alias("query_id"), F.col("v").alias("q")), I.buckets(q, "id", F.col("v"), c), 2, 4).collect())

    small = ask()
    monkeypatch.setattr(I, "BROADCAST_BYTES", 0)
    assert ask() == small and len(small) == 40
    assert I.IndexConfig.sized(1000).bits == 8 and I.IndexConfig.sized(1 << 20).bits == 14


def sequential(nodes, edges, seeds, scores, c):
    """The traversal said step by step for one query; scores by destination."""
    exp = {n: x for n, x, _ in nodes}
    full = {n: f for n, _, f in nodes}
    out = {}
    seen, front, decisions, reads = set(seeds), [(s, (s,), 0) for s in set(seeds)], [], 0
    for hop in range(c.max_hops):
        if not front or len(decisions) >= c.max_visited:
            break
        cands, pending = [], 0
        for cur, path, jumps in sorted(front):
            own = 0
            for e in sorted((e for e in edges if e[0] == cur), key=lambda e: (-e[2], e[3], e[1])):
                if len(decisions) + pending >= c.max_visited or own >= (c.expressway_fanout if exp[cur] else c.fanout):
                    break
                if e[1] in seen:
                    continue
                own, pending = own + 1, pending + 1
                s = scores[e[1]]
                j = jumps + exp[e[1]]
                jump = exp[e[1]] and j <= c.max_expressway_jumps and s["follow"] >= c.expressway_threshold
                crit = max(s["include"], s["read_full"]) >= c.critical_threshold
                read = full[e[1]] and s["read_full"] >= c.read_full_threshold and reads < c.max_full_reads
                reads += bool(read)
                cands.append((-s["follow"], -e[2], e[1], len(cands), dict(parent=cur, hop=hop + 1, read=bool(read), included=s["include"] >= c.include_threshold or crit, expanded=bool((s["expand"] >= c.expand_threshold or jump) and s["stop"] < 0.95), jumps=j, path=(*path, e[1]))))
        nxt, wide = [], 0
        for _, _, dst, _, d in sorted(cands, key=lambda x: x[:4]):
            if dst in seen:
                continue
            seen.add(dst)
            decisions.append(dst)
            out[dst] = d
            if d["expanded"]:
                nxt.append((dst, d["path"], d["jumps"]))
                wide += 1
                if wide >= c.beam_width:
                    break
            if c.mode == "single_path":
                break
        front = nxt
    return out


@pytest.mark.parametrize("seed", range(6))
def test_traversal_against_the_sequential_model(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(18)]
    nodes = [(n, rng.random() < 0.3, rng.random() < 0.6) for n in names]
    edges = [(a, b, rng.choice([0.2, 0.5, 0.9]), rng.randrange(3)) for a in names for b in names if a != b and rng.random() < 0.3]
    scores = {n: {s: rng.choice([0.1, 0.45, 0.6, 0.75, 0.9, 0.96]) for s in SCORES} for n in names}
    c = dict(max_hops=3, fanout=rng.choice([2, 4]), beam_width=rng.choice([1, 2, 5]), max_visited=rng.choice([4, 9, 50]), max_full_reads=rng.choice([1, 2, 9]), expressway_fanout=rng.choice([3, 6]), max_expressway_jumps=rng.choice([0, 1, 2]), mode="single_path" if seed == 5 else "beam", path_dims=2)
    table = spark.createDataFrame([(n, *[scores[n][s] for s in SCORES]) for n in names], "dst_id string, " + ", ".join(f"{s} double" for s in SCORES))
    config = TraversalConfig(**c, scorer=FixedScorer(table))
    n = spark.createDataFrame([(a, [1.0, 0.5], [1.0] if f else None, None, None, None, x, [0.5, 0.5], None, 1, T0) for a, x, f in nodes], NODE)
    e = spark.createDataFrame([edge(a, b, k, t) for a, b, k, t in edges], EDGE)
    asked = {"q1": ["n00"], "q2": ["n03", "n07", "n03"], "q3": ["missing"]}
    got = traverse(n, e, spark.createDataFrame([(q, [1.0, 0.0]) for q in asked], "query_id string, query array<double>"), spark.createDataFrame([(q, s) for q, ss in asked.items() for s in ss], "query_id string, seed_id string"), config).collect()
    for q, ss in asked.items():
        want = sequential(nodes, edges, [s for s in ss if s in names], scores, config)
        have = {r["node_id"]: dict(parent=r["parent_id"], hop=r["hop"], read=r["read_full_flag"], included=r["included"], expanded=r["expanded"], jumps=r["expressway_jumps"], path=tuple(r["path"])) for r in got if r["query_id"] == q}
        assert have == want, (q, seed)


def test_traversal_limits_and_bad_config(spark):
    for bad in (dict(mode="x"), dict(fanout=0), dict(max_full_reads=0), dict(include_threshold=1.2), dict(max_hops=-1)):
        with pytest.raises(ValueError):
            TraversalConfig(**bad)
    n = spark.createDataFrame([node("a"), node("b")], NODE)
    e = spark.createDataFrame([edge("a", "b")], EDGE)
    q, s = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, query array<double>"), spark.createDataFrame([("q", "a")], "query_id string, seed_id string")
    assert traverse(n, e, q, s, TraversalConfig(max_hops=0)).count() == 0
    assert traverse(n, e.limit(0), q, s, TraversalConfig(path_dims=2)).count() == 0
    got = ranked(traverse(n, e, q, s, TraversalConfig(path_dims=2, scorer=FixedScorer(spark.createDataFrame([("b", .9, .9, .9, .9, .1, float("nan"))], "dst_id string, " + ", ".join(f"{x} double" for x in SCORES)))))).collect()
    assert got[0]["result"] == 0.9 and got[0]["included_rank"] == 1, "a result that is no number is the include score"


def test_insert_links_both_ways(spark):
    n = spark.createDataFrame([node("a", (1.0, 0.0)), node("b", (0.9, 0.1)), node("c", (-1.0, 0.0))], NODE)
    e = spark.createDataFrame([edge("a", "b", 0.9), edge("a", "c", 0.8)], EDGE)
    new = spark.createDataFrame([node("n", (1.0, 0.05))], NODE)
    c = InsertConfig(edge_dims=2, summary_dims=2, traversal=TraversalConfig(path_dims=2))
    got = attach(n, e, new, c).orderBy("rank").collect()
    assert [r["node_id"] for r in got] == ["a", "b"], "c is too far"
    edges = insert_batch(n, e, new, c)
    pairs = {(r["src_id"], r["dst_id"]) for r in edges.collect()}
    assert {("n", "a"), ("a", "n"), ("n", "b"), ("b", "n"), ("a", "b"), ("a", "c")} == pairs
    nodes2, edges2 = insert_in_order(n, e, [new], c)
    assert nodes2.count() == 4 and {(r["src_id"], r["dst_id"]) for r in edges2.collect()} == pairs
    assert attach(n.limit(0), e, new, c).count() == 0
    again = insert_batch(n, e.union(spark.createDataFrame([edge("n", "a", 0.1, created=77)], EDGE)), new, c).filter("src_id = 'n' and dst_id = 'a'").first()
    assert again["created_at"] == 77 and again["confidence"] > 0.5, "an edge that was there keeps its creation"


def test_valid_edges(spark):
    assert valid_edges(spark.createDataFrame([edge("a", "b"), edge("a", "a"), edge("a", "b", -0.1)], EDGE)).count() == 1
