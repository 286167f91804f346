import numpy as np
import pytest

import nodeweave.llm.ann as ann
import nodeweave.llm.overlap as overlap
import nodeweave.llm.queries as queries
from nodeweave.llm.ann import nearest_vectors
from nodeweave.llm.overlap import set_overlaps, vector_overlaps
from nodeweave.sources.tables import latest, table
from tests.conftest import SF


def brute(ids, x, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = {}
    for i, a in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i and s[i, j] >= least), key=lambda j: (-s[i, j], ids[j]))
        out[a] = [ids[j] for j in order[:k]]
    return out


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    x = np.concatenate([centres[rng.integers(0, 20, 900)] + 0.5 * rng.standard_normal((900, 16)), np.repeat(centres[:1], 300, axis=0)])
    x[900:1000] *= 3.0
    near = x[rng.integers(0, 900, 200)] + 0.02 * rng.standard_normal((200, 16))
    x = np.concatenate([x, near]).astype(np.float32)
    ids = [f"n{i:04d}" for i in range(len(x))]
    rows = [(i, v.tolist(), "clash") for i, v in zip(ids, x)] + [("null", None, ""), ("zero", [0.0] * 16, ""), ("short", [1.0], ""), ("nan", [float("nan")] * 16, "")]
    df = spark.createDataFrame(rows, "id string, v array<float>, rid string")
    got = {}
    for r in nearest_vectors(df, "id", "v", 16, k=5, min_cos=0.95).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    want = brute(ids, x.astype(np.float64), 5, 0.95)
    pairs = {(a, b) for a, bs in want.items() for b in bs}
    have = {(a, b) for a, bs in got.items() for b in bs}
    assert len(pairs & have) >= 0.98 * len(pairs) and len(have - pairs) <= 0.02 * len(pairs)
    assert got["n0950"] == ["n0900", "n0901", "n0902", "n0903", "n0904"], "copies, whatever their norm, by id"
    loose = nearest_vectors(df, "id", "v", 16, k=3, probes=16, cells=16).filter("rank = 1").collect()
    best = brute(ids, x.astype(np.float64), 1, -1)
    assert np.mean([best[r["id"]] == [r["neighbour"]] for r in loose]) >= 0.9, "recall without a least similarity"
    assert nearest_vectors(df.limit(0), "id", "v", 16).count() == 0
    assert nearest_vectors(df.filter("id = 'n0001'"), "id", "v", 16).count() == 0


def test_p2_nearest_gives_every_node_its_neighbours(spark):
    got = {}
    for r in queries.p2_nearest(spark, SF).collect():
        got.setdefault((r["vec"], r["id"]), set()).add(r["neighbour"])
    for name, column, dims, _ in queries.VECTORS:
        rows = latest(table(spark, SF, "node_frame"), ["node_id"], ["version"], [column]).collect()
        rows = [r for r in rows if r[column] is not None and len(r[column]) == dims and any(r[column])]
        ids = [r["node_id"] for r in rows]
        want = brute(ids, np.array([r[column] for r in rows], np.float64), 5, -1)
        assert all(len(got[name, i]) == 5 for i in ids)
        assert np.mean([len(got[name, i] & set(want[i])) / 5 for i in ids]) >= 0.95


def split_of(rng):
    return ["train", "Training ", "val", " TEST", None, "other"][rng.integers(0, 6)]


def side(s):
    return {"train": 0, "training": 0, "val": 1, "test": 1}.get((s or "").strip().lower())


@pytest.mark.parametrize("front", [1.0, 0.5])
def test_set_overlaps_against_brute_force(spark, front):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(80):
        base = [f"w{x}" for x in rng.choice(400, 18, replace=False)] + ["the", "of", "to", "zone"]
        for j in range(rng.integers(1, 4)):
            w = [x if rng.random() > 0.06 else f"e{rng.integers(0, 999)}" for x in base]
            rows.append((f"r{i:02d}{j}", split_of(rng), [str(x) for x in rng.permutation(w)]))
    family = [f"f{k}" for k in range(20)]
    rows += [(f"h{i:03d}", "train" if i % 3 else "test", family[:19] + [f"x{i}"]) for i in range(60)]
    rows += [("same1", "train", ["a", "b"]), ("same2", "test", ["b", "a"]), ("one1", "train", ["q"]), ("one2", "val", ["q"]), ("null", "train", None), ("none", "test", []), ("nul2", "train", [None])]
    df = spark.createDataFrame(rows, "id string, s string, w array<string>")
    got = {(r["id_a"], r["id_b"]) for r in set_overlaps(df, "id", "s", "w", 0.7, front=front).collect()}
    sets = {i: (side(s), frozenset(x for x in w or [] if x)) for i, s, w in rows}
    want = {tuple(sorted((a, b))) for a, (sa, wa) in sets.items() for b, (sb, wb) in sets.items() if sa == 1 and sb == 0 and wa and wb and len(wa & wb) >= 0.7 * len(wa | wb)}
    assert got == want
    assert set_overlaps(df.limit(0), "id", "s", "w", 0.7).count() == 0


def test_vector_overlaps(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((150, 32))
    y = (x[:60] + 0.03 * rng.standard_normal((60, 32))) * 2.5
    rows = [(f"a{i:03d}", "train", v.tolist()) for i, v in enumerate(x)] + [(f"b{i:03d}", "test", v.tolist()) for i, v in enumerate(y)] + [("z", "test", [0.0] * 32), ("n", "train", None), ("c", "validation", x[5].tolist())]
    df = spark.createDataFrame(rows, "id string, s string, v array<double>")
    got = {(r["id_a"], r["id_b"]) for r in vector_overlaps(df, "id", "s", "v", 32, 0.995).collect()}
    both = np.concatenate([y, x[5:6]])
    u, w = x / np.linalg.norm(x, axis=1, keepdims=True), both / np.linalg.norm(both, axis=1, keepdims=True)
    names = [f"b{i:03d}" for i in range(60)] + ["c"]
    want = {tuple(sorted((names[j], f"a{i:03d}"))) for i, j in zip(*np.nonzero(u @ w.T >= 0.995))}
    assert got == want and len(want) > 50


def test_large_families_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK", 50)
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in range(30)]
    rows = []
    for i in range(240):
        w = list(base)
        for j in rng.choice(30, 2, replace=False):
            w[j] = f"e{i}x{j}"
        rows.append((f"f{i:03d}", "test" if i % 6 == 0 else "train", w))
    df = spark.createDataFrame(rows, "id string, s string, w array<string>")
    got = {(r["id_a"], r["id_b"]) for r in set_overlaps(df, "id", "s", "w", 0.7, front=0.5).collect()}
    assert got == {tuple(sorted((a, b))) for a, s, _ in rows for b, t, _ in rows if s == "test" and t == "train"}
    centre = rng.standard_normal(32)
    x = centre / np.linalg.norm(centre) + 0.012 * rng.standard_normal((240, 32))
    df = spark.createDataFrame([(f"v{i:03d}", "test" if i % 6 == 0 else "train", v.tolist()) for i, v in enumerate(x)], "id string, s string, v array<double>")
    got = {(r["id_a"], r["id_b"]) for r in vector_overlaps(df, "id", "s", "v", 32, 0.995).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {tuple(sorted((f"v{i:03d}", f"v{j:03d}"))) for i in range(0, 240, 6) for j in range(240) if j % 6 and u[i] @ u[j] >= 0.995}
    assert len(want) > 2000 and got == want


def test_no_shared_span_is_cut_at_the_back(spark):
    """Differences and common members alternate in the order of frequency."""
    rows = [("x", "test", ["c1", "d", "c2", "c3"]), ("y", "train", ["c1", "c2", "c3"])]
    rows += [("v", "val", ["k1", "e1", "k2", "e2", "k3", "k4", "k5", "k6"]), ("w", "train", [f"k{i}" for i in range(1, 7)])]
    order = ["c1", "d", "c2", "c3"], ["k1", "e1", "k2", "e2", "k3", "k4", "k5", "k6"]
    # a member's frequency (from 4 on) is its place
    for words in order:
        rows += [(f"{w}-{i}", "train", [w, f"only {w} {i}", *[f"more {w} {i} {j}" for j in range(4)]]) for at, w in enumerate(words) for i in range(4 + 2 * at)]
    df = spark.createDataFrame(rows, "id string, s string, w array<string>")
    assert {(r["id_a"], r["id_b"]) for r in set_overlaps(df, "id", "s", "w", 0.7, front=0.5).collect()} == {("x", "y"), ("v", "w")}
    assert {(r["id_a"], r["id_b"]) for r in set_overlaps(df, "id", "s", "w", 0.7).collect()} == {("x", "y"), ("v", "w")}


def test_sure_front_against_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(300):
        base = [f"t{x}" for x in rng.choice(25, rng.integers(1, 12), replace=False)]
        rows.append((f"r{i:03d}", "train" if i % 2 else "test", base))
    df = spark.createDataFrame(rows, "id string, s string, w array<string>")
    for threshold in (0.5, 0.7):
        want = {tuple(sorted((a, b))) for a, s, v in rows for b, t, w in rows if s == "test" and t == "train" and len({*v} & {*w}) >= threshold * len({*v} | {*w})}
        assert want and {(r["id_a"], r["id_b"]) for r in set_overlaps(df, "id", "s", "w", threshold).collect()} == want


def test_crowded_and_least_overlaps(spark):
    """Texts of overlap exactly 0.70 that share spans of three symbols, in families of 19 and 30; one pair of 17 words."""
    for n in (19, 30):
        rows = [(f"{t[0]}{i:02d}", t, [f"c{k}" for k in range(14)] + [f"{t}{i}x{k}" for k in range(3)]) for t in ("train", "test") for i in range(n)]
        df = spark.createDataFrame(rows, "id string, s string, w array<string>")
        assert set_overlaps(df, "id", "s", "w", 0.69).count() == n * n
    one = [("a", "train", [f"c{k}" for k in range(14)] + ["x1", "x2", "x3"]), ("b", "val", [f"c{k}" for k in range(14)] + ["y1", "y2", "y3"])]
    got = set_overlaps(spark.createDataFrame(one, "id string, s string, w array<string>"), "id", "s", "w", 0.7).collect()
    assert [(r["id_a"], r["id_b"], r["held_out"], round(r["covered"], 6), r["overlap"]) for r in got] == [("a", "b", "b", round(14 / 17, 6), 0.7)] and got[0]["span"] >= 1


def test_parts_and_salts_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(21)
    centre = rng.standard_normal((12, 16))
    x = np.concatenate([centre[i % 12] + 0.05 * rng.standard_normal(16) for i in range(400)] + [centre[0] + 0.02 * rng.standard_normal(16) for _ in range(200)]).reshape(-1, 16).astype(np.float32)
    ids = [f"n{i:04d}" for i in range(len(x))]
    df = spark.createDataFrame(list(zip(ids, x.tolist())), "id string, v array<float>")
    want = brute(ids, x.astype(np.float64), 4, 0.9)

    def found():
        got = {}
        for r in nearest_vectors(df, "id", "v", 16, k=4, min_cos=0.9, probes=64, cells=64).collect():
            got.setdefault(r["id"], set()).add(r["neighbour"])
        return got

    whole = found()
    monkeypatch.setattr(ann, "PART_ROWS", 40)
    monkeypatch.setattr(ann, "TASK_QUERIES", 90)
    split = found()
    for got in (whole, split):
        assert np.mean([len(got.get(i, set()) & set(want[i])) / max(1, len(want[i])) for i in ids]) >= 0.99
    assert split == whole, "a third of the rows in one list, in shares"
