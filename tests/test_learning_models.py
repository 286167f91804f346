import json
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeweave.functions import batch as B
from nodeweave.functions import vectors as V
from nodeweave.operators import learning as L
from nodeweave.operators import models
from nodeweave.operators.models import ModelConfig, NeuralScorer, split_inputs
from nodeweave.operators.scorers import CountingScorer, HeuristicScorer
from nodeweave.session import shared_dir

DIMS = dict(query_dim=4, summary_dim=4, edge_dim=2, full_dim=6, path_dim=4, hidden_dim=8, attach_hidden_dim=8)
EDGES = "query array<double>, cur_eff array<double>, edge_vector array<double>, dst_eff array<double>, path array<double>, confidence double, hop int, follow string"
ENDS = "new_eff array<double>, cand_eff array<double>, new_full array<double>, cand_full array<double>, new_summary array<double>, cand_summary array<double>, path array<double>"


def act(x):
    return x * 0.5 * (1 + math.erf(x / math.sqrt(2)))


def dense(p, x):
    return [sum(w * v for w, v in zip(row, x)) + b for row, b in zip(p["w"], p["b"])]


def norm(p, x):
    m = sum(x) / len(x)
    v = sum((a - m) ** 2 for a in x) / len(x)
    return [(a - m) / math.sqrt(v + 1e-5) * w + b for a, w, b in zip(x, p["w"], p["b"])]


def squash(x):
    return [1 / (1 + math.exp(-v)) for v in x]


def folded(x, n):
    if len(x) == n:
        return list(x)
    out = [sum(x[i::n]) if i < len(x) else 0.0 for i in range(n)]
    size = math.sqrt(sum(v * v for v in out))
    return [v / size if size else v for v in out]


def with_pairs(parts, pairs):
    out = [list(p) for p in parts]
    for a, b in pairs:
        a = folded(a, len(b))
        out += [[x * y for x, y in zip(a, b)], [abs(x - y) for x, y in zip(a, b)]]
    return out


def slow_tokens(w, features, kinds, heads):
    x = [[c + t for c, t in zip(w["cls"], w["types"][0])]] + [[a + t for a, t in zip(dense(w[k], f), w["types"][i + 1])] for i, (k, f) in enumerate(zip(kinds, features))]
    for name in sorted(w["layers"]):
        p = w["layers"][name]
        q, k, v = ([dense(p[s], row) for row in x] for s in "qkv")
        size = len(x[0]) // heads
        mixed = []
        for i in range(len(x)):
            row = []
            for h in range(heads):
                cut = slice(h * size, (h + 1) * size)
                e = [math.exp(sum(a * b for a, b in zip(q[i][cut], k[j][cut])) / math.sqrt(size)) for j in range(len(x))]
                row += [sum(e[j] * v[j][cut][d] for j in range(len(x))) / sum(e) for d in range(size)]
            mixed.append(row)
        x = [norm(p["n1"], [a + b for a, b in zip(row, dense(p["o"], m))]) for row, m in zip(x, mixed)]
        x = [norm(p["n2"], [a + b for a, b in zip(row, dense(p["f2"], [act(y) for y in dense(p["f1"], row)]))]) for row in x]
    return x[0]


@pytest.mark.parametrize("given", [dict(), dict(traversal_output_dim=5), dict(model_kind="transformer", transformer_heads=2), dict(model_kind="transformer", transformer_heads=2, transformer_layers=1, attach_head_kind="hybrid", traversal_output_dim=5)])
def test_models_against_plain_loops(spark, tmp_path, given):
    rng = np.random.default_rng(1)
    made = NeuralScorer.seeded(ModelConfig(**DIMS, **given), seed=8)
    made.save(str(tmp_path / "w.npz"))
    m = NeuralScorer.load(str(tmp_path / "w.npz"))
    assert m.config == made.config
    rows = [(*[rng.standard_normal(n).tolist() for n in (7, 4, 2, 4, 4)], 0.5, 1, "clash"), (*[rng.standard_normal(4).tolist() for _ in range(5)], 1.5, 9, "x"), (None, *[[1.0] * 4] * 4, 0.5, 1, "x"), (*[[1.0] * 4] * 5, None, 1, "x")]
    got = m.edge_columns(spark.createDataFrame(rows, EDGES)).collect()
    kinds = ["query", "summary", "edge", "summary", "path", "scalar", *["summary"] * 6, *["edge"] * 2]
    for r, row in zip(got[:2], rows):
        q, c, e, d, p = (folded(v, n) for v, n in zip(row[:5], (4, 4, 2, 4, 4)))
        f = with_pairs([q, c, e, d, p, [min(1, row[5]), min(1, row[6] / 3)]], [(q, d), (c, d), (p, d), (q, e)])
        w = m.weights["edge"]
        if m.config.model_kind == "mlp":
            x = [v for part in f for v in part]
            out = squash(dense(w["l2"], [act(v) for v in dense(w["l1"], [act(v) for v in dense(w["l0"], x)])]))
        else:
            out = squash(dense(w["out"], norm(w["norm"], slow_tokens(w, f, kinds, 2))))
        want = out if len(out) == 6 else [*out, out[2]]
        assert np.allclose([r[s] for s in ("follow", "read_full", "include", "expand", "stop", "result")], want, atol=1e-5)
    assert got[2]["follow"] is None and got[3]["result"] is None, "a row that lacks something has no scores"
    ends = [tuple(rng.standard_normal(n).tolist() for n in (4, 4, 6, 6, 4, 4, 4)), (*[[0.5] * 4] * 2, None, [1.0] * 6, [0.25, 1.0, 0.0, 0.0], [0.0] * 4, [1.0] * 4), (None, *[[1.0] * 4] * 6)]
    got = m.attach_column(spark.createDataFrame(ends, ENDS)).collect()
    kinds = ["summary", "summary", "full", "full", "path", "summary", "summary", "full", "full", "summary", "summary"]
    for r, row in zip(got[:2], ends):
        nf, cf = folded(row[2] or row[4], 6), folded(row[3], 6)
        f = with_pairs([row[0], row[1], nf, cf, row[6]], [(row[0], row[1]), (nf, cf), (row[6], row[1])])
        x, w = [v for part in f for v in part], m.weights["attach"]
        if m.config.model_kind == "mlp":
            out = dense(w["l2"], [act(v) for v in dense(w["l1"], [act(v) for v in dense(w["l0"], x)])])
        else:
            out = slow_tokens(w, f, kinds, 2)
            if m.config.attach_head_kind == "hybrid":
                out += [act(v) for v in dense(w["explicit1"], [act(v) for v in dense(w["explicit0"], x)])]
                out = dense(w["out"], [act(v) for v in dense(w["out0"], norm(w["norm"], out))])
            else:
                out = dense(w["out"], norm(w["norm"], out))
        assert abs(r["attach"] - squash(out)[0]) < 1e-5
    assert got[2]["attach"] is None
    assert m.edge_columns(spark.createDataFrame([], EDGES)).count() == 0


@pytest.mark.parametrize("part", ["attach", "edge"])
def test_models_work_in_small_memory_on_a_whole_batch(monkeypatch, part):
    class Sent:
        def __init__(self, value):
            self.value = value

    monkeypatch.setattr(models, "with_scores", lambda df, vectors, plain, names, score: score)
    monkeypatch.setattr(NeuralScorer, "_sent", lambda self, df, part: Sent(self.weights[part]))
    m = NeuralScorer.seeded(ModelConfig(model_kind="transformer", hidden_dim=64, attach_hidden_dim=64, attach_head_kind="hybrid", traversal_output_dim=5), seed=4)
    n, rng = 1030, np.random.default_rng(5)
    widths = {"attach": (32, 32, 64, 64, 32, 32, 32), "edge": (32, 32, 16, 32, 32)}[part]
    given = [B.Rows(rng.standard_normal((n, k)), np.full(n, k), rng.random(n) > 0.1) for k in widths] + ([rng.random(n), np.zeros(n)] if part == "edge" else [])
    score = m.attach_column(None) if part == "attach" else m.edge_columns(None)
    tracemalloc.start()
    got = score(*given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6, "memory grows with a block, not with the batch"
    for i in (0, 63, 64, 128, n - 1):
        alone = score(*[B.Rows(g.x[[i]], g.size[[i]], g.there[[i]]) if isinstance(g, B.Rows) else g[[i]] for g in given])
        assert all(len(got[s]) == n and np.allclose(got[s][i], alone[s][0], atol=1e-12, equal_nan=True) for s in got)


def test_model_config():
    assert ModelConfig.from_manifest({"dims": {"query": 8, "full": 9}}, hidden_dim=4) == ModelConfig(query_dim=8, full_dim=9, hidden_dim=4)
    for bad in (dict(model_kind="x"), dict(attach_head_kind="x"), dict(traversal_output_dim=4)):
        with pytest.raises(ValueError):
            ModelConfig(**bad)


def test_batches_are_the_column_functions(spark):
    rows = [([3.0, 4.0, 1.0], [1.0, 2.0, 5.0], 1), ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0], 2), (None, [1.0, 2.0, 3.0], 3), ([1.0, 2.0, 3.0], None, 4), ([1.0, 2.0], [3.0, 4.0, 5.0, 6.0], 5), ([], [1.0], 6)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, i int")
    pairs = {"unit": (V.normalize("a"), B.unit_column("a")), "down": (V.resize("b", 2), B.resize_column("b", 2)), "up": (V.resize("a", 5), B.resize_column("a", 5)), "eff": (V.effective("a", "b", 4), B.effective_column("a", "b", 4))}
    for name, (x, y) in pairs.items():
        for r in df.select(x.alias("x"), y.alias("y")).collect():
            assert (r["x"] is None) == (r["y"] is None) and (r["x"] is None or np.allclose(r["x"], r["y"])), name
    got = B.with_scores(df.withColumn("c", V.cosine01("a", "b")), ["a", "b"], [], ["s"], lambda a, b: {"s": B.cosine01(a, b)}).collect()
    assert all((r["c"] is None and r["s"] is None) or abs(r["c"] - r["s"]) < 1e-12 for r in got)


def test_checked_vectors_and_targets(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(V.checked("v", 2)).collect()] == [[1.0, 2.0], None]
    for wrong in (df.select(V.checked("v", 3)), spark.createDataFrame([([],)], "v array<double>").select(V.checked("v")), df.select(L.six_targets("v"))):
        with pytest.raises(Exception, match="must have|5 or 6"):
            wrong.collect()
    t = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],), ([1.0] * 6,), (None,)], "v array<double>").select(L.six_targets("v")).collect()
    assert [r[0] for r in t] == [[1.0, 2.0, 3.0, 4.0, 5.0, 3.0], [1.0] * 6, None]
    cut = df.filter("v is not null").select(*split_inputs("v", [1, 1], ["a", "b"])).first()
    assert (cut["a"], cut["b"]) == ([1.0], [2.0])


def test_draws(spark):
    z = np.array([r[0] for r in spark.range(4000).select(L.bell(1, F.col("id"))).collect()])
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.05
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"))
    got = L.picked(df, 4, "id", ["g"], seed=2)
    assert {r["g"]: r["n"] for r in got.groupBy("g").agg(F.countDistinct("id").alias("n")).collect()} == {0: 4, 1: 4, 2: 4}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, L.picked(df.repartition(7), 4, "id", ["g"], seed=2).collect())), "the draw doesn't hang on where rows stand"
    assert L.picked(df, 3, "id").count() == 3 and L.picked(df.limit(0), 3, "id").count() == 0


CAND = "array<struct<id: string, qwen_teacher: struct<follow: double, read_full: double, include: double, expand: double, stop: double, result: double>>>"


def test_labels(spark):
    said = {"candidates": [dict(id="a", follow=2, read_full=0.1, include=-1, expand=0.5, stop=0), dict(id="a", follow=0.25, read_full=0.1, include=0.3, expand=0.5, stop=0), dict(id="zzz", follow=1)]}
    rows = [("e", "```json\n" + json.dumps(said) + "\n```", ["a", "b", None]), ("f", "no JSON", ["c"]), ("g", None, None)]
    a = spark.createDataFrame(rows, "id string, answer string, known array<string>")
    assert [(r["candidate_id"], r["follow"], r["include"]) for r in L.read_labels(a).collect()] == [("a", 0.25, 0.3)], "the last of a repeated id, unknown ids passed over"
    assert {r["id"]: r["missing"] for r in L.label_faults(a).collect()} == {"e": ["b"], "f": ["c"]}
    e = spark.createDataFrame([("e", [("a", None), ("b", (1.0, 1.0, 1.0, 1.0, 1.0, 1.0)), None, (None, None)]), ("h", None)], f"id string, candidates {CAND}")
    got = {r["id"]: r["candidates"] for r in L.apply_labels(e, L.read_labels(a)).collect()}
    assert got["e"][0]["qwen_teacher"]["follow"] == 0.25 and got["e"][1]["qwen_teacher"]["follow"] == 1.0 and got["e"][2] is None and got["h"] is None


def test_teachers_are_tried_again_unless_they_refuse(spark):
    refused = L.Refused

    def client(address, prompt):
        if prompt == "bad":
            raise refused("no key")
        if prompt == "dead" or address == "one":
            raise OSError("down")
        return prompt.upper()

    p = spark.createDataFrame([(1, "hello"), (2, "bad"), (3, "dead")], "id int, prompt string")
    got = {r["id"]: (r["answer"], r["attempts"], r["fault"]) for r in L.ask_teacher(p, client, ("one", "two"), 2).collect()}
    assert got == {1: ("HELLO", 2, None), 2: (None, 1, "refused: no key"), 3: (None, 4, "down")}
    assert spark.createDataFrame([('{"a":"\u00e9\\n\U0001f600"}',)], "t string").select(L.escaped(F.col("t"))).first()[0] == '{"a":"\\u00e9\\n\\ud83d\\ude00"}'


def test_counting(spark):
    counting = CountingScorer(HeuristicScorer())
    rows = spark.createDataFrame([(*[[1.0] * 4] * 5, 0.5, 1, "x")] * 3, EDGES).withColumn("dst_full", F.lit(None).cast("array<double>"))
    counting.edge_columns(rows).collect()
    assert counting.counts() == {"calls": 1, "candidates": 3}


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(ValueError):
        shared_dir(Session())
