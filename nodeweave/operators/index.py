"""Sign-hash index: bucket rows of nodes, bucket look-ups, and exact search in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeweave.functions import batch as B
from nodeweave.functions.vectors import resize, vec
from nodeweave.session import HELD_BYTES as BROADCAST_BYTES
from nodeweave.session import settled

#: Bytes of query vectors one task multiplies with at a time.
BLOCK_BYTES = 16_000_000
#: Bytes of query vectors held by the driver and each task at once.
HELD_BYTES = 128_000_000
#: Nodes in an average bucket, at most.
BUCKET_NODES = 64
#: Shares of a bucket's nodes that a query meets in tasks of their own, where its buckets are too many to broadcast.
SALTS = 16


@dataclass(frozen=True)
class IndexConfig:
    dims: int = 16
    tables: int = 4
    bits: int = 8
    seed: int = 17

    @classmethod
    def sized(cls, rows: int, **given: int) -> IndexConfig:
        """The default, with a bit more for each doubling of the nodes beyond 64 a bucket of 8 bits, so that buckets keep their size as a graph grows."""
        return cls(**({"bits": max(cls.bits, min(62, math.ceil(math.log2(max(1, rows) / BUCKET_NODES))))} | given))

    def __post_init__(self) -> None:
        if min(self.dims, self.tables, self.bits) < 1 or self.bits > 62:
            raise ValueError("dims, tables and bits must be positive, bits at most 62")

    def planes(self) -> np.ndarray:
        """(tables, bits, dims) unit directions, the same for a seed everywhere."""
        p = np.random.default_rng(self.seed).standard_normal((self.tables, self.bits, self.dims), dtype=np.float32)
        return p / np.linalg.norm(p, axis=2, keepdims=True)


def index_vector(df: DataFrame, config: IndexConfig) -> Column:
    """A node's vector in the index: its traversal vector, else its summary, at the index's length."""
    return resize(F.coalesce("traversal_vector", "summary_vector"), config.dims)


def buckets(df: DataFrame, id_col: str, vector: Column, config: IndexConfig) -> DataFrame:
    """(id, table_id, bucket_id): one row for each table.

    Bit b of a bucket is set where the product with direction b is not negative
    (so a zero vector sets all); a vector is compared over the common length.
    """
    planes = config.planes().astype(np.float64).reshape(-1, config.dims)
    powers = 1 << np.arange(config.bits, dtype=np.int64)

    @F.arrow_udf("array<long>")
    def run(a: pa.Array) -> pa.Array:
        x = B.rows_of(a).x
        w = min(x.shape[1], config.dims)
        # one direction after another, in array order, so that a sign never hangs on how a product was blocked
        signs = np.stack([np.add.accumulate(x[:, :w] * p[:w], axis=1)[:, -1] >= 0 if w else np.ones(len(x), bool) for p in planes], axis=1)
        ids = signs.reshape(len(x), config.tables, config.bits) @ powers
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * config.tables), pa.array(ids.reshape(-1)))

    rows = df.select(F.col(id_col).alias("id"), vec(vector).alias("v")).filter("v is not null")
    return rows.select("id", F.posexplode(run("v")).alias("table_id", "bucket_id"))


def replace_buckets(index: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """The index after nodes were added again (their new rows in ``changed``) and others removed (ids in ``removed``)."""
    gone = changed.select("id").unionByName(removed.select("id")).distinct()
    fresh = changed.join(removed.select("id"), "id", "left_anti")
    return index.join(gone, "id", "left_anti").unionByName(fresh)


def query_index(index: DataFrame, vectors: DataFrame, queries: DataFrame, query_buckets: DataFrame, tables: int, limit: int) -> DataFrame:
    """(query_id, node_id, score, matches, rank): nodes that share a bucket, best first.

    score = 0.75 (product + 1) / 2 + 0.25 matches / tables; ties go to more matches,
    then to the smaller id. A query that shares no bucket gives no row. vectors
    is (id, v), queries (query_id, q), both at the index's length. The queries'
    buckets go to the index where they are small enough (measured), else both are
    dealt over salts; vectors are fetched for what met, so only ids travel before.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    asked = settled(query_buckets, "query_buckets").select(F.col("id").alias("query_id"), "table_id", "bucket_id")
    size = asked.agg(F.sum(F.octet_length(F.col("query_id").cast("string")) + 48)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        met = index.join(F.broadcast(asked), ["table_id", "bucket_id"])
    else:
        # a bucket may hold a large share of the nodes (all zero vectors fall into one)
        dealt = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = index.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(dealt, ["table_id", "bucket_id", "salt"])
    matches = met.groupBy("query_id", "id").agg(F.count("*").alias("matches"))
    scored = matches.join(vectors.select("id", "v"), "id").join(queries.select("query_id", "q"), "query_id")
    scored = B.with_scores(scored, ["q", "v"], [], ["_product"], lambda q, v: {"_product": B.product(q, v)}).drop("q", "v")
    scored = scored.withColumn("score", 0.75 * ((F.col("_product") + 1.0) / 2.0) + 0.25 * (F.col("matches") / F.lit(tables)))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("matches"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return ranked.select("query_id", F.col("id").alias("node_id"), "score", "matches", "rank")


class _Best:
    """The k best nodes of each query seen so far in a task; equal to the ninth place, the smaller id is better."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.most = 0, 4 * queries * k + 100_000

    def offer(self, score: np.ndarray, first: int, ids: np.ndarray, able: np.ndarray | None = None) -> None:
        """Scores of queries first.. against the nodes ``ids``."""
        score = np.round(score, 9)
        if able is not None:
            score = np.where(able, score, -np.inf)
        floor = self.floor[first : first + len(score)]
        if score.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(score, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
        self.kept.append((first + i, ids[j], score[i, j]))
        self.waiting += len(i)
        if self.waiting > self.most:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.kept:
            return np.zeros(0, int), np.zeros(0, object), np.zeros(0)
        q, ids, score = (np.concatenate(x) for x in zip(*self.kept))
        order = np.lexsort((ids.astype("U"), -score, q))
        q, ids, score = q[order], ids[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        last = place == self.k - 1
        self.floor[q[last]] = score[last]
        keep = place < self.k
        self.kept, self.waiting = [(q[keep], ids[keep], score[keep])], int(keep.sum())
        return self.kept[0]


def exact_topk(nodes: DataFrame, id_col: str, vector_col: Column | str, queries: DataFrame, k: int, cosine: bool = True, group: str | None = None, others: int = 0) -> DataFrame:
    """(query_id, node_id, score, rank): the k best nodes for every query, all nodes looked at.

    The queries (query_id, q) are held against the nodes in blocks. A task keeps
    its k best nodes of each query over all its blocks, so k rows for each task and
    query are shuffled and never a pair of all. More queries than one matrix may
    hold (HELD_BYTES) are asked in passes over the nodes, slices of one numbering.
    Scores are (cosine + 1) / 2, a zero vector giving 0.5, or plain products;
    scores equal to the ninth place are a tie, which goes to the smaller id.
    Query vectors must have the nodes' length; nulls take no part.

    With ``group``, a column of both sides, a query's k best come from its own
    group and its ``others`` best from outside; rows tell by ``same``, ranks count each.
    """
    if k < 1:
        raise ValueError("k must be positive")
    asked = settled(queries.filter("q is not null and query_id is not null").select("query_id", vec("q").alias("q"), *([group] if group else [])), "queries")
    seen = asked.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("d"), F.max(F.octet_length("query_id")).alias("b")).first()
    dims = seen["d"] or 0
    turns = max(1, math.ceil(seen["n"] * (dims * 8 + (seen["b"] or 0) + 64) / HELD_BYTES))
    flat = nodes.select(F.col(id_col).alias("id"), vec(vector_col).alias("v"), *([F.col(group)] if group else [])).filter(F.col("v").isNotNull() & (F.size("v") == dims))
    if turns > 1:
        flat = settled(flat, "searched")
    found = [_topk_pass(flat, asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == t) if turns > 1 else asked, dims, k, cosine, group, others) for t in range(turns)]
    w = Window.partitionBy("query_id", *(["same"] if group else [])).orderBy(F.desc("score"), "node_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(w))
    limit = F.when(F.col("same"), k).otherwise(others) if group else F.lit(k)
    ranked = ranked.filter((F.col("rank") <= max(k, others)) & (F.col("rank") <= limit))
    return ranked if group else ranked.drop("same")


def _topk_pass(flat: DataFrame, asked: DataFrame, dims: int, k: int, cosine: bool, group: str | None, others: int) -> DataFrame:
    """The best of each task for the queries of one pass."""
    got = asked.toArrow()
    names = got.column("query_id").to_pylist()
    matrix = B.rows_of(got.column("q").combine_chunks()).x.reshape(len(names), dims) if names else np.zeros((0, dims))
    groups = np.array(got.column(group).to_pylist() if group else [None] * len(names), object)
    sent = asked.sparkSession.sparkContext.broadcast((names, matrix, groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, wanted = sent.value
        if not ids:
            return
        length = np.sqrt((q * q).sum(1))
        best = [(None, _Best(len(ids), k))] if not group else [(True, _Best(len(ids), k)), (False, _Best(len(ids), others))]
        step = max(1, BLOCK_BYTES // (8 * 4096))
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                own = np.array(part.column("id").to_pylist(), object)
                x = B.rows_of(part.column("v")).x
                xn = np.sqrt((x * x).sum(1))
                of = np.array(part.column(group).to_pylist(), object) if group else None
                for a in range(0, len(ids), step):
                    score = q[a : a + step] @ x.T
                    if cosine:
                        low = length[a : a + step, None] * xn[None, :]
                        score = (np.divide(score, low, out=np.zeros_like(score), where=low > 0) + 1) / 2
                    same = wanted[a : a + step, None] == of[None, :] if group else None
                    for kind, kept in best:
                        if kept.k:
                            kept.offer(score, a, own, None if kind is None else same if kind else ~same)
        for kind, kept in best:
            i, who, score = kept.shrink()
            yield pa.RecordBatch.from_arrays([pa.array([ids[t] for t in i], pa.string()), pa.array(who.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array([kind is not False] * len(i), pa.bool_())], ["query_id", "node_id", "score", "same"])

    return flat.mapInArrow(run, "query_id string, node_id string, score double, same boolean")
