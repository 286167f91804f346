import hashlib
import math
import re

import numpy as np
from pyspark.sql import functions as F

from nodeweave.functions import text as X
from nodeweave.functions import vectors as V


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_products_over_the_common_prefix(spark):
    r = one(spark, dot=V.dot(arr(1, 2, 3), arr(4, 5)), cos=V.cosine(arr(3, 4, 100), arr(3, 4)), zero=V.cosine01(arr(0, 0), arr(1, 1)), norm=V.norm(arr(3, 4)))
    assert r["dot"] == 14 and r["norm"] == 5
    assert abs(r["cos"] - 1) < 1e-12, "norms are of the prefix too"
    assert r["zero"] == 0.5


def test_null_vectors_stay_null(spark):
    null = F.lit(None).cast("array<double>")
    r = one(spark, c=V.cosine01(null, arr(1)), n=V.normalize(null), f=V.resize(null, 4), e=V.effective(arr(1, 2), null, 2), k=V.clamp01(F.lit(None).cast("double")))
    assert r["c"] is None and r["n"] is None and r["f"] is None and r["k"] is None
    assert r["e"] == [1.0, 2.0], "no metadata: the summary as it is"


def test_resize_normalises_only_when_the_length_changes(spark):
    r = one(spark, same=V.resize(arr(3, 4), 2), down=V.resize(arr(1, 2, 3, 4), 2), up=V.resize(arr(3, 4), 3), zero=V.resize(arr(0, 0, 0), 2))
    assert r["same"] == [3.0, 4.0]
    assert np.allclose(r["down"], np.array([4, 6]) / math.hypot(4, 6))
    assert np.allclose(r["up"], [0.6, 0.8, 0]) and r["zero"] == [0.0, 0.0]


def test_edge_vector_and_flip(spark):
    r = one(spark, e=V.edge_vector(arr(1, 0), arr(0, 1), 2), f=V.flip_alternating(arr(1, 2, 3)), s=V.traversal_scalars(F.lit(1.5), F.lit(2), 3))
    want = np.tanh([-0.8, 0.8])
    assert np.allclose(r["e"], want / np.linalg.norm(want))
    assert r["f"] == [-1.0, 2.0, -3.0] and np.allclose(r["s"], [1, 2 / 3, 0])


def slow_embedding(text, dims):
    v = [0.0] * dims
    for pos, token in enumerate(re.findall("[a-z0-9]+", text.lower())):
        for i, b in enumerate(hashlib.sha256(f"{pos}:{token}".encode()).digest()):
            v[(b + 31 * i) % dims] += (1 if b % 2 == 0 else -1) * (1 + min(len(token), 12) / 12)
    n = math.sqrt(sum(x * x for x in v))
    return [x / n if n else 0.0 for x in v]


def test_embedding_against_the_definition(spark):
    texts = ["Alpha beta, ALPHA!", "", "éclair naïve 42", None, "x" * 40]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.embed_text("t", 32).alias("v")).orderBy("i").collect()
    for r, t in zip(rows, texts):
        assert r["v"] is None if t is None else np.allclose(r["v"], slow_embedding(t, 32))


def test_metadata_text(spark):
    m = spark.createDataFrame([({"b": " Two ", "a": "1", "n": None, "e": " "},), (None,)], "m map<string, string>")
    assert [r[0] for r in m.select(X.metadata_text("m")).collect()] == ["a=1 | b=two", None]
    nested = {"z": [1, 2.5], "k": {"y": True, "x": None}, "s": {"b", "a"}, "f": 1e16, "l": [], "n": float("nan"), "T": "Up", "bools": [True]}
    assert X.nested_metadata_text(nested) == "T=up | f=1e+16 | k={y:true} | l=[] | s=[a,b]"


def test_terms_and_conflicts(spark):
    r = one(spark, t=X.topic_terms(F.lit("dom:big_red-big")), c=X.metadata_conflicts(F.create_map(F.lit("event"), F.lit("a"), F.lit("x"), F.lit("1")), F.create_map(F.lit("event"), F.lit("b"), F.lit("x"), F.lit("2"))), s=X.strip_fence(F.lit("```json\n{}\n```")))
    assert r["t"] == ["big", "red"] and r["c"] == ["event"] and r["s"] == "{}"
