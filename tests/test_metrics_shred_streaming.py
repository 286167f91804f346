import datetime as dt
import json

from pyspark.sql import functions as F

from nodeweave.operators import metrics as M
from nodeweave.operators.models import fold_rows, gelu
from nodeweave.operators.shred import flat_table, shred
from nodeweave.sources.jsonl import manifest, read_jsonl, write_jsonl
from nodeweave.streaming.upserts import current, stream_edges, upsert_edges_batch, windowed_counts
from tests.test_graph import EDGE, edge

ROWS = "case_id string, idx int, score double, label int, kind string, oracle double"


def test_hand_case(spark):
    m = spark.createDataFrame([("c", 0, 0.9, 1, "positive", 1.0), ("c", 1, 0.1, 0, "easy_negative", 0.0), ("c", 2, 0.2, 0, "lexical_hard_negative_candidate", 0.0)], ROWS)
    assert M.mrr(m).first()["mrr"] == 1.0 and M.average_precision(m).first()["average_precision"] == 1.0
    assert all(r["pairs"] == r["won"] and r["hard"] for r in M.pairwise(m).collect())
    assert M.calibration(m).first()["brier"] == 0.02
    assert M.best_f1(m).first()["threshold"] == 0.21, "the lowest of the best thresholds"
    assert M.at_threshold(m).first()["f1"] == 1.0 and M.ndcg(m).first()["ndcg3"] == 1.0


def test_ties_nulls_and_empty(spark):
    m = spark.createDataFrame([("c", 0, 0.5, 0, "a", None), ("c", 1, 0.5, 1, "b", None), ("d", 0, None, None, None, None)], ROWS)
    assert {(r["case_id"], r["idx"]): r["rank"] for r in M.rank_cases(m).collect()} == {("c", 0): 1, ("c", 1): 2, ("d", 0): 1}
    assert M.mrr(m).first()["mrr"] == 0.25 and M.pairwise(m).first()["won"] == 0, "equal scores win nothing"
    none = m.limit(0)
    assert M.average_precision(none).first()["average_precision"] == 0.0 and M.pr_curve(none).count() == 0 and M.best_f1(none).first()["f1"] == 0.0


def test_shred_shapes(spark):
    body = {
        "id": "e1", "path": {"0": {"node_id": "a", "terms": "x | y"}, "2": {"node_id": "b", "terms": [None, "z"]}, "1": None},
        "candidates": json.dumps([{"dst_id": "c", "relation": json.dumps({"metadata_conflict": ["event"]}), "extra": [1]}, None]), "query_intent": {"metadata": {"k": "v", "n": None}},
    }
    texts = [(1, "```json\n" + json.dumps({"episode": body}) + "\n```"), (2, json.dumps(body)[:40]), (3, None), (4, "null"), (5, json.dumps({"id": "e5", "path": {"node_id": "only"}}))]
    df = spark.createDataFrame(texts, "r int, j string").withColumn("table", F.lit("clash"))
    rows = shred(df, "r", "j", ["path", "path[].terms", "candidates", "candidates[].relation.metadata_conflict"], ["path[].terms"], ["query_intent.metadata"], ["candidates[].relation"], "id", ("episode",))
    got = {(r["record"], r["table"], tuple(r["ordinals"])): dict(r["cols"]) for r in rows.collect()}
    assert got["1", "path", (2,)]["node_id"] == "b" and ("1", "path", (1,)) not in got
    assert got["1", "path[].terms", (0, 1)] == {"value": "y"} and got["1", "path[].terms", (2, 1)] == {"value": "z"} and ("1", "path[].terms", (2, 0)) not in got
    assert got["1", "candidates[].relation.metadata_conflict", (0, 0)] == {"value": "event"}
    assert got["1", "query_intent.metadata", (1,)] == {"key": "n", "value": None}
    assert got["5", "path", (0,)]["node_id"] == "only"
    assert {k[0]: v["reason"] for k, v in got.items() if k[1] == "(unreadable)"} == {"2": "no complete JSON", "3": "empty", "4": "no record in it"}
    flat = flat_table(rows, "path[].terms", [("value", "string")]).filter("record = '1'").orderBy("parent_pos", "pos").collect()
    assert [(r["parent_pos"], r["pos"], r["value"]) for r in flat] == [(0, 0, "x"), (0, 1, "y"), (2, 1, "z")]


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", None), (1, "b\nc", 2.5)], "shard int, s string, x double")
    path = write_jsonl(df, "shard", "t", str(tmp_path / "out"))
    assert sorted(read_jsonl(spark, path, "s string, x double").select("s", "x").collect()) == [("a", None), ("b\nc", 2.5)]
    assert json.loads(manifest(df, "shard", dims=32)) == {"schema_version": 1, "rows": 2, "shards": {"0": 1, "1": 1}, "dims": 32}


def test_stream_upserts_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "table")
    spark.createDataFrame([edge("a", "b", 0.9, created=1), edge("a", "b", 0.8, created=5, version=2)], EDGE).write.parquet(src)
    stream_edges(spark.readStream.schema(EDGE).parquet(src), out, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([edge("a", "b", 0.7, created=9, version=3), edge("a", "c")], EDGE).write.mode("append").parquet(src)
    stream_edges(spark.readStream.schema(EDGE).parquet(src), out, str(tmp_path / "cp")).awaitTermination()
    table, batch = current(spark, out)
    assert {(r["dst_id"], r["confidence"], r["created_at"]) for r in table.collect()} == {("b", 0.7, 1), ("c", 0.5, 0)}
    upsert_edges_batch(out)(spark.createDataFrame([edge("x", "y")], EDGE), batch)
    assert current(spark, out)[0].count() == 2, "a replayed batch changes nothing"
    upsert_edges_batch(out)(spark.createDataFrame([edge("x", "y"), edge(None, "y")], EDGE), batch + 1)
    upsert_edges_batch(out)(spark.createDataFrame([], EDGE), batch + 2)
    table, last = current(spark, out)
    assert {(r["src_id"], r["dst_id"]) for r in table.collect()} == {("a", "b"), ("a", "c"), ("x", "y")} and last == batch + 2


def test_windowed_counts(spark):
    t = dt.datetime(2024, 1, 1, 10, 30)
    e = spark.createDataFrame([(t, "a"), (t, "a"), (t + dt.timedelta(hours=1), None)], "ts timestamp, k string")
    assert sorted((r["k"] or "", r["events"]) for r in windowed_counts(e, "ts", "k").collect()) == [("", 1), ("a", 2)]


def test_model_parts(tmp_path):
    import math

    import numpy as np

    x = np.linspace(-4, 4, 41)
    assert np.allclose(gelu(x), [v * 0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x], atol=1e-6)
    assert np.allclose(fold_rows(np.ones((2, 4)), 2), math.sqrt(0.5))


def test_average_precision_of_one_tie_spread_over_ranges(spark):
    rows = [(f"c{i % 90:02d}", i, 0.5, int(i % 7 == 0), "k", None) for i in range(900)]
    m = spark.createDataFrame(rows, ROWS)
    ordered = sorted((r[0], r[1], r[3]) for r in rows)
    hits, want = 0, []
    for j, (_, _, label) in enumerate(ordered, 1):
        hits += label
        want += [hits / j] if label else []
    assert abs(M.average_precision(m).first()["average_precision"] - sum(want) / len(want)) < 1e-6


def test_pairs_of_a_large_case_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(M, "CASE_ROWS", 7)
    rows = [("c", i, (i * 37 % 50) / 50, 0, "k", (i * 13 % 50) / 50) for i in range(50)] + [("d", 0, 0.1, 0, "k", None)]
    m = spark.createDataFrame(rows, ROWS).withColumn("target", F.col("oracle")).withColumn("weight", F.lit(None).cast("double"))
    pairs = [(a, b) for a in rows[:50] for b in rows[:50] if a[5] - b[5] >= 0.05]
    got = M.target_pairwise(m).first()
    assert (got["pairs"], got["alike"]) == (len(pairs), sum(a[2] > b[2] for a, b in pairs))
    loss = sum(max(0.0, 0.2 * (a[5] - b[5]) - (a[2] - b[2])) for a, b in pairs) / len(pairs)
    assert abs(M.pairwise_loss(m).first()["loss"] - loss) < 1e-6
    drawn = M.target_pairwise_sampled(m, 400).first()
    assert 100 < drawn["pairs"] <= 400 and abs(drawn["alike"] / drawn["pairs"] - got["alike"] / got["pairs"]) < 0.15
    assert M.target_pairwise_sampled(m.limit(0), 10).first()["pairs"] == 0


def test_actions_hits_and_latency(spark):
    rows = spark.createDataFrame([("a", "c", 0, 0.9, 1.0), ("a", "c", 1, 0.2, 0.0), ("b", "c", 0, 0.5, None)], "action string, case_id string, idx int, score double, target double")
    got = M.actions(rows).collect()
    assert [r["action"] for r in got] == ["a"] and got[0]["f1"] == 1.0 and got[0]["average_precision"] == 1.0, "an action without all targets is left out"
    ranked = spark.createDataFrame([("m", "q", "x", 1), ("m", "q", "y", 2)], "method string, query_id string, node_id string, rank int")
    wanted = spark.createDataFrame([("q", "y"), ("p", "z")], "query_id string, node_id string")
    assert [(r["k"], r["precision"], r["hit_rate"], r["mrr"]) for r in M.hits_at(ranked, wanted, (1, 2)).orderBy("k").collect()] == [(1, 0.0, 0.0, 0.0), (2, 0.25, 0.5, 0.25)]
    assert M.latency(2.0, 10, 4) == {"ms": 2000.0, "ms_per_case": 500.0, "candidates_per_second": 5.0}
