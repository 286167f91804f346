import random

import pytest
from pyspark.sql import functions as F

import nodeweave.llm.near_dups as near_dups
from nodeweave.llm.components import components
from nodeweave.llm.near_dups import near_duplicate_groups, pairs_of, shingles_of, words_of
from nodeweave.llm.splits import assign_splits, linked_groups


def union_find(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(500, 500 + i) for i in range(40)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union_find({x for e in edges for x in e}, edges)
    assert [tuple(r) for r in components(spark.createDataFrame([(None, 3)], "a long, b long")).collect()] == [(3, 3)], "a null end makes no edge"
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = rng.sample(words, 20)
        for j in range(rng.choice([1, 1, 2, 4])):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(20)] = rng.choice(words)
            rng.shuffle(w)
            rows.append((f"d{i:02d}{j}", " ".join(w)))
    hot = rng.sample(words, 20)
    rows += [(f"hot{i:03d}", " ".join(hot[:19] + [f"edit{i}"])) for i in range(60)] + [(f"same{i:03d}", " ".join(hot)) for i in range(40)]
    rows += [("empty", ""), ("null", None), ("null2", None), ("d000", rows[0][1]), (None, "x")]
    df = spark.createDataFrame(rows, "id string, t string").withColumn("rid", F.lit(1)).withColumn("a", F.lit("clash"))
    got = {r["id"]: r["group"] for r in near_duplicate_groups(df.select("*", words_of("t").alias("w")), "id", "w", 0.75).collect()}
    sets = {i: frozenset((t or "").split()) for i, t in rows if i}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])]
    assert got == union_find(ids, links)
    pairs = {tuple(r) for r in pairs_of(spark.createDataFrame(list(got.items()), "id string, group string")).collect()}
    assert pairs == {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if got[a] == got[b]}
    assert near_duplicate_groups(df.limit(0).select("id", words_of("t").alias("w")), "id", "w").count() == 0


def test_crowded_nodes_are_dealt_and_shallow_links_found(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "NODE_PAIRS", 20)
    rng = random.Random(5)
    stem = [f"s{i}" for i in range(16)]
    rows = [(f"f{i:03d}", " ".join([*stem, *rng.sample([f"x{k}" for k in range(90)], 4)])) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, t string")
    got = {r["id"]: r["group"] for r in near_duplicate_groups(df.select("id", words_of("t").alias("w")), "id", "w", 0.75).collect()}
    sets = {i: frozenset(t.split()) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])]
    assert got == union_find(ids, links)
    with pytest.raises(ValueError):
        near_dups.depth_for(0.1, 4, 0.999, 10)


def test_draws_share_out_as_planned(spark):
    many = spark.range(20_000).select(F.concat(F.lit("r"), "id").alias("id"), F.concat(F.lit("g"), F.floor(F.col("id") / 2)).alias("group"))
    plan = spark.createDataFrame([("train", 8.0), ("validation", 1.0), ("test", 1.0), ("none", None)], "split string, share double")
    got = {r["split"]: r["n"] / 20_000 for r in assign_splits(many, plan).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {"train", "validation", "test"} and abs(got["train"] - 0.8) < 0.01 and abs(got["test"] - 0.1) < 0.01


def test_shingles(spark):
    r = spark.createDataFrame([("a b c d e f",), ("a b",), ("",), (None,)], "t string").select(shingles_of("t").alias("s")).collect()
    assert [x["s"] for x in r[:3]] == [["a b c d e", "b c d e f"], ["a b"], []]


def test_groups_and_splits(spark):
    rows = [(f"e{i}", f"t{i % 7}", f"q{i % 11}" if i % 3 else None) for i in range(40)] + [("lone", None, "q99"), ("none", None, None), ("e1", "t1", "q1")]
    df = spark.createDataFrame(rows, "id string, t string, q string").select("id", F.concat(F.lit("1"), "t").alias("k1"), F.concat(F.lit("2"), "q").alias("k2"), F.lit(0).alias("group"))
    groups = linked_groups(df.drop("group"), "id", ["k1", "k2"])
    got = {r["id"]: r["group"] for r in groups.collect()}
    links = [(f"1{t}", f"2{q}") for _, t, q in rows if t and q]
    comp = union_find({x for e in links for x in e} | {f"1{t}" for _, t, _ in rows if t} | {"2q99"}, links)
    assert got == {i: comp[f"1{t}"] if t else comp[f"2{q}"] if q else None for i, t, q in rows}
    plan = spark.createDataFrame([("train", 0.8), ("test", 0.2), ("nothing", 0.0)], "split string, share double")
    many = spark.range(3000).select(F.concat(F.lit("r"), "id").alias("id"), F.concat(F.lit("g"), F.when(F.col("id") < 1000, F.lit(0)).otherwise(F.floor(F.col("id") / 3))).alias("group"))
    out = assign_splits(many, plan)
    assert out.groupBy("group").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0, "no group is parted"
    share = out.filter("split = 'train'").count() / 3000
    assert abs(share - 0.8) < 0.05, "a group of a third of all rows is placed by size"
    assert assign_splits(groups, plan).count() == 42 and assign_splits(many.limit(0), plan).count() == 0
