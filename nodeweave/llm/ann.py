"""The k most similar vectors of every vector: inverted file with product-quantised residuals.

* A two-level coarse quantiser (cells, and lists within a cell) is trained on a
  bounded sample; its size grows with the number of vectors, so a list stays
  about LIST_ROWS long.
* A vector is stored in its list as the codes of its residual in M subspaces.
* A query goes to the lists it can have neighbours in: for a wanted similarity
  the chord bound says which lists are out of reach (x lies nearer to its own
  centroid than to the query's), and of the rest the ``probes`` nearest are read.
* In a list, a table of the query's products with each codebook entry gives the
  approximate similarity of every member by M look-ups (asymmetric distance);
  the best are reranked with the exact vectors.

Vectors equal after normalising are one entry of the index. Rows meet by part: some
lists of one cell with at most about PART_ROWS members, or a share of a list that
holds more. The members of a part come first and then its queries, which stream
past them; the queries of a crowded part are dealt over several tasks. So what a
task holds and reads does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeweave.session import held, stage

#: Rows of the training sample, at most. Lists can't be more than these, so beyond SAMPLE * LIST_ROWS rows (10 million) lists grow with the table.
SAMPLE = 40_000
LIST_ROWS = 250
#: Members and queries of one part handled by one task, about.
PART_ROWS = 60_000
TASK_QUERIES = 60_000
#: Rows of the sample that are routed as queries to foresee how crowded each part gets.
ROUTED_ROWS = 4_000
CODES = 256
#: Dimensions of a subspace, at least.
PART_DIMS = 4
#: Share of the sample whose quantising error the cut of approximate similarities allows for.
ERROR_SHARE = 0.9995


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int, spherical: bool) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        score = x @ c.T if spherical else x @ c.T - 0.5 * (c * c).sum(1)
        near = score.argmax(1)
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.concatenate(([0], np.cumsum(count)[:-1])), len(x) - 1), axis=0)
        full = count > 0
        c[full] = sums[full] / count[full][:, None]
        if (~full).any():
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
        if spherical:
            c = _unit(c)
    return c.astype(np.float32)


class Quantiser:
    """Cells, lists and residual codebooks; plain arrays, so that it can be sent to tasks."""

    def __init__(self, sample: np.ndarray, rows: int, seed: int = 5):
        x = _unit(sample.astype(np.float32))
        lists = max(1, round(rows / LIST_ROWS))
        cells = max(1, round(lists**0.5))
        self.cells = _kmeans(x, cells, 8, seed, True)
        near = (x @ self.cells.T).argmax(1)
        each = lists / len(x)
        cents, cell_of = [], []
        for c in range(len(self.cells)):
            own = x[near == c]
            got = _kmeans(own, max(1, round(len(own) * each)), 6, seed + c + 1, True) if len(own) else self.cells[c : c + 1]
            cents.append(got)
            cell_of.append(np.full(len(got), c))
        self.lists = np.concatenate(cents).astype(np.float32)
        self.cell_of = np.concatenate(cell_of).astype(np.int32)
        self.first = np.concatenate(([0], np.cumsum([len(c) for c in cents]))).astype(np.int64)
        dims = x.shape[1]
        self.parts = next(m for m in range(max(1, dims // PART_DIMS), 0, -1) if dims % m == 0)
        of = self.assign(x)
        residual = x - self.lists[of]
        width = dims // self.parts
        self.books = np.stack([
            _pad(_kmeans(residual[:, m * width : (m + 1) * width].copy(), CODES, 6, seed + 7 * m, False), CODES) for m in range(self.parts)
        ])
        codes = self.encode(x, of)
        decoded = self.lists[of] + np.concatenate([self.books[m][codes[:, m]] for m in range(self.parts)], axis=1)
        self.slack = float(np.quantile(1.0 - (x * decoded).sum(1), ERROR_SHARE)) + 0.02
        self._deal(np.bincount(of, minlength=len(self.lists)) / len(x) * rows)

    def _deal(self, rows: np.ndarray) -> None:
        """Lists to parts, by the rows foreseen in each: neighbours of one cell together up to PART_ROWS, a larger list in shares."""
        self.first_part, self.shares = np.zeros(len(self.lists), np.int32), np.ones(len(self.lists), np.int32)
        part, room, cell = -1, 0.0, -1
        for i, n in enumerate(rows):
            if n > PART_ROWS:
                self.first_part[i], self.shares[i] = part + 1, int(np.ceil(n / PART_ROWS))
                part, room = part + int(self.shares[i]), 0.0
                continue
            if n > room or self.cell_of[i] != cell:
                part, room, cell = part + 1, float(PART_ROWS), self.cell_of[i]
            self.first_part[i] = part
            room -= n
        self.part_count = part + 1

    @classmethod
    def of(cls, parts: dict) -> Quantiser:
        made = cls.__new__(cls)
        made.__dict__.update(parts)
        return made

    def within(self, c: int) -> np.ndarray:
        """Distances between the lists of a cell."""
        kept = self.__dict__.setdefault("_within", {})
        if c not in kept:
            own = self.lists[self.first[c] : self.first[c + 1]]
            kept[c] = np.sqrt(np.maximum(0.0, 2 - 2 * (own @ own.T)))
        return kept[c]

    def asked(self, q: np.ndarray, q_at: np.ndarray, l_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, part, list) for every part that holds members of a list to read."""
        n = self.shares[l_at]
        at = np.repeat(np.arange(len(l_at)), n)
        share = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return q_at[at], self.first_part[l_at[at]] + share, l_at[at]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector: the nearest among the lists of its nearest cell."""
        out = np.zeros(len(x), np.int32)
        near = (x @ self.cells.T).argmax(1)
        for c in np.unique(near):
            at = np.nonzero(near == c)[0]
            a, b = self.first[c], self.first[c + 1]
            out[at] = a + (x[at] @ self.lists[a:b].T).argmax(1)
        return out

    def encode(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        r = x - self.lists[of]
        w = x.shape[1] // self.parts
        codes = np.empty((len(x), self.parts), np.uint8)
        for m in range(self.parts):
            book = self.books[m]
            codes[:, m] = (r[:, m * w : (m + 1) * w] @ book.T - 0.5 * (book * book).sum(1)).argmax(1)
        return codes

    def reach(self, q: np.ndarray, min_cos: float, probes: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) pairs to read."""
        delta = float(np.sqrt(max(0.0, 2 - 2 * min_cos)))
        to_cell = q @ self.cells.T
        best = to_cell.max(1, keepdims=True)
        own = to_cell.argmax(1)
        gap = np.sqrt(np.maximum(0.0, 2 - 2 * (self.cells[own] @ self.cells.T)))
        ok = best - to_cell <= delta * gap + 1e-6
        if cells < len(self.cells):
            cut = np.partition(to_cell, -cells, axis=1)[:, -cells][:, None]
            ok &= to_cell >= cut
        qs, ls, ss = [], [], []
        for c in range(len(self.cells)):
            at = np.nonzero(ok[:, c])[0]
            if not len(at):
                continue
            a, b = self.first[c], self.first[c + 1]
            s = q[at] @ self.lists[a:b].T
            top = s.max(1, keepdims=True)
            lead = s.argmax(1)
            hit = top - s <= delta * self.within(c)[lead] + 1e-6
            if probes < b - a:
                hit &= s >= np.partition(s, -probes, axis=1)[:, -probes][:, None]
            i, j = np.nonzero(hit)
            qs.append(at[i]), ls.append(a + j), ss.append(s[i, j])
        q_at, l_at, sim = np.concatenate(qs), np.concatenate(ls), np.concatenate(ss)
        # of all lists within reach keep the nearest ``probes``
        order = np.lexsort((-sim, q_at))
        q_at, l_at = q_at[order], l_at[order]
        starts = np.searchsorted(q_at, q_at, side="left")
        keep = np.arange(len(q_at)) - starts < probes
        return q_at[keep], l_at[keep]


def _pad(book: np.ndarray, n: int) -> np.ndarray:
    return book if len(book) == n else np.concatenate([book, np.full((n - len(book), book.shape[1]), 1e3, np.float32)])


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type):
        return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, dims)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)


def _bytes(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    offsets = pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(x.tobytes())])


def _normalise(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unit(_matrix(b.column("vector"), dims).astype(np.float64)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column("id"), _bytes(x)], ["id", "vector"])

    return run


ROUTED = "part int, salt int, is_query boolean, rid long, vector binary, lists binary, codes binary"


def _route(quantiser, dims: int, min_cos: float, probes: int, cells: int, salts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Quantiser.of(quantiser.value)
        names = ["part", "salt", "is_query", "rid", "vector", "lists", "codes"]
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("vector"), dims)
            rid = b.column("rid").to_numpy(zero_copy_only=False)
            of = q.assign(x)
            codes = q.encode(x, of)
            part = q.first_part[of] + (rid % q.shares[of]).astype(np.int32)
            # members: a copy for each salt of the part
            copies = salts[part]
            at = np.repeat(np.arange(len(x)), copies)
            salt = (np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[at], pa.int32()), pa.array(salt), pa.array(np.zeros(len(at), bool)), pa.array(rid[at]), _bytes(x[at]), _bytes(of[at][:, None].astype(np.int32)), _bytes(codes[at])], names
            )
            qa, pt, la = q.asked(x, *q.reach(x, min_cos, probes, cells))
            key = qa.astype(np.int64) * q.part_count + pt
            order = np.argsort(key, kind="stable")
            key, la = key[order], la[order].astype(np.int32)
            starts = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0]
            ends = np.concatenate((starts[1:], [len(key)]))
            who, where = key[starts] // q.part_count, (key[starts] % q.part_count).astype(np.int32)
            salt = (rid[who] % salts[where]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(where), pa.array(salt), pa.array(np.ones(len(who), bool)), pa.array(rid[who]), _bytes(x[who]),
                 pa.array([la[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()), pa.array([b""] * len(who), pa.binary())],
                names,
            )

    return run


class _Part:
    """The members of one part, ordered by list."""

    def __init__(self, q: Quantiser, dims: int, rows: list[pa.RecordBatch]):
        self.rid = np.concatenate([r.column("rid").to_numpy(zero_copy_only=False) for r in rows])
        x = np.concatenate([_matrix(r.column("vector"), dims) for r in rows])
        of = np.frombuffer(b"".join(v for r in rows for v in r.column("lists").to_pylist()), np.int32)
        codes = np.frombuffer(b"".join(v for r in rows for v in r.column("codes").to_pylist()), np.uint8).reshape(len(of), -1)
        order = np.argsort(of, kind="stable")
        self.rid, self.x, self.codes, of = self.rid[order], x[order], codes[order], of[order]
        self.lists, self.starts = np.unique(of, return_index=True)
        self.ends = np.append(self.starts[1:], len(of))

    def search(self, q: Quantiser, qx: np.ndarray, qid: np.ndarray, q_at: np.ndarray, l_at: np.ndarray, k: int, rerank: int, min_cos: float):
        """(query rid, member rid, cosine) of all members with ``min_cos``; without one, of the best ``k`` others of each query in the part (and those level with the last)."""
        w = qx.shape[1] // q.parts
        out = []
        order = np.argsort(l_at, kind="stable")
        q_at, l_at = q_at[order], l_at[order]
        floor = np.full(len(qx), -np.inf, np.float32)
        if min_cos <= -1:
            # each query's nearest list comes first and its ``rerank``-th approximate similarity is the floor for the others
            close = np.einsum("ij,ij->i", qx[q_at], q.lists[l_at])
            by = np.lexsort((-close, q_at))
            later = np.ones(len(q_at), bool)
            later[by[np.concatenate(([True], q_at[by][1:] != q_at[by][:-1]))]] = False
            order = np.lexsort((l_at, later))
            q_at, l_at, later = q_at[order], l_at[order], later[order]
            cut = int((~later).sum())
        else:
            cut = 0
        spans = []
        for a, b in ((0, cut), (cut, len(l_at))):
            spans += zip(range(len(self.lists)), a + np.searchsorted(l_at[a:b], self.lists, side="left"), a + np.searchsorted(l_at[a:b], self.lists, side="right"))
        for i, lo, hi in spans:
            if lo == hi:
                continue
            s, e = self.starts[i], self.ends[i]
            codes = self.codes[s:e]
            for b in range(lo, hi, 512):
                at = q_at[b : min(hi, b + 512)]
                x = qx[at]
                # asymmetric distance tables: one row of products per codebook entry, added up by code
                near = np.broadcast_to(x @ q.lists[self.lists[i]], (e - s, len(at))).copy()
                for m in range(q.parts):
                    near += (q.books[m] @ x[:, m * w : (m + 1) * w].T)[codes[:, m]]
                if min_cos > -1:
                    mi, qi = np.nonzero(near >= min_cos - q.slack)
                else:
                    if lo < cut and rerank < e - s:
                        floor[at] = np.partition(near, -rerank, axis=0)[-rerank]
                    mi, qi = np.nonzero(near >= floor[at])
                if len(mi):
                    xm, xq = self.x[s:e][mi].astype(np.float64), x[qi].astype(np.float64)
                    # single-precision unit vectors are not quite of length one
                    cos = np.einsum("ij,ij->i", xm, xq) / np.sqrt(np.einsum("ij,ij->i", xm, xm) * np.einsum("ij,ij->i", xq, xq))
                    ok = cos >= min_cos - 1e-7
                    out.append((qid[at[qi[ok]]], self.rid[s:e][mi[ok]], cos[ok]))
        return out if min_cos > -1 else _best(out, k)


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each query the ``k`` most similar others and those that equal the last to the ninth place."""
    if not found:
        return found
    a, b, c = (np.concatenate(x) for x in zip(*found))
    other = a != b
    a, b, c = a[other], b[other], c[other]
    level = np.round(c, 9)
    order = np.lexsort((-level, a))
    a, b, c, level = a[order], b[order], c[order], level[order]
    starts = np.searchsorted(a, a, side="left")
    last = np.minimum(starts + k, np.searchsorted(a, a, side="right")) - 1
    keep = level >= level[last]
    return [(a[keep], b[keep], c[keep])]


def _search(quantiser, dims: int, k: int, rerank: int, min_cos: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Quantiser.of(quantiser.value)
        key, members, part = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column("part").to_numpy(zero_copy_only=False).astype(np.int64) * (1 << 24) + batch.column("salt").to_numpy(zero_copy_only=False)
            kinds = batch.column("is_query").to_numpy(zero_copy_only=False)
            cuts = np.nonzero((parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1]))[0] + 1
            for s, e in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(parts)]))):
                rows = batch.slice(int(s), int(e - s))
                if parts[s] != key:
                    key, members, part = parts[s], [], None
                if not kinds[s]:
                    members.append(rows)
                    continue
                if not members:
                    continue
                part = part or _Part(q, dims, members)
                lists = rows.column("lists").to_pylist()
                l_at = np.frombuffer(b"".join(lists), np.int32)
                q_at = np.repeat(np.arange(len(lists)), [len(x) // 4 for x in lists])
                found = part.search(q, _matrix(rows.column("vector"), dims), rows.column("rid").to_numpy(zero_copy_only=False), q_at, l_at, k, rerank, min_cos)
                if found:
                    a, b, c = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], ["q", "m", "cos"])

    return run


def nearest_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, k: int = 5, min_cos: float = -1.0, probes: int = 16, cells: int = 6, rerank: int = 64) -> DataFrame:
    """(id, neighbour, cosine, rank): for every vector its ``k`` most similar others with at least ``min_cos``.

    Rank 1 is the most similar; ties (equal to the ninth place) go to the smaller id. Null vectors, vectors
    of another length, with null or NaN members, and all-zero vectors take no
    part; ids must be unique. Equal vectors (after normalising) are all found.
    Extra columns are ignored; an empty table gives an empty result.
    Approximate: a neighbour is missed if its list is not among the ``probes``
    nearest of the ``cells`` nearest cells, or its approximate similarity falls
    short by more than quantising costs (ERROR_SHARE of) the sample; without a
    ``min_cos`` at least the ``rerank`` best of each part are reranked instead.
    """
    spark = df.sparkSession
    good = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).filter(
        F.col("id").isNotNull() & (F.size("vector") == dims) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("vector", lambda x: x != 0)
    )
    unit = good.mapInArrow(_normalise(dims), T.StructType([good.schema["id"], T.StructField("vector", T.BinaryType())]))
    flat = stage(unit.withColumn("rid", F.monotonically_increasing_id()), "unit")
    # vectors that stand more than once, by digest; only they need an entry of their own
    digest = F.md5("vector")
    copied = flat.groupBy(digest.alias("digest")).agg(F.min("rid").alias("lead"), F.count("*").alias("n")).filter("n > 1").select("digest", "lead")
    copies = stage(flat.select("rid", "id", digest.alias("digest")).join(copied, "digest").select("rid", "id", "lead"), "copies")
    extra = copies.filter("rid <> lead").select("rid")
    entries = flat.join(held(extra), "rid", "left_anti")
    total = flat.count()
    if total == 0:
        return flat.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("cosine"), F.lit(0).alias("rank")).limit(0)
    share = min(1.0, SAMPLE * 0.9 / total)
    drawn = entries.filter(F.pmod(F.xxhash64("vector"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("vector").limit(SAMPLE)
    drawn = [bytes(r[0]) for r in drawn.collect()] or [bytes(r[0]) for r in entries.select("vector").limit(SAMPLE).collect()]
    sample = np.frombuffer(b"".join(drawn), np.float32).reshape(-1, dims)
    trained = Quantiser(sample, total)
    some = _unit(sample[:ROUTED_ROWS])
    who, where, _ = trained.asked(some, *trained.reach(some, min_cos, probes, cells))
    calls = np.bincount(np.unique(np.stack([who, where]), axis=1)[1], minlength=trained.part_count) / len(some) * total
    salts = np.maximum(1, np.ceil(calls / TASK_QUERIES)).astype(np.int64)
    quantiser = spark.sparkContext.broadcast({k: v for k, v in vars(trained).items() if k != "_within"})
    routed = entries.select("rid", "vector").mapInArrow(_route(quantiser, dims, min_cos, probes, cells, salts), ROUTED)
    met = routed.repartition("part", "salt").sortWithinPartitions("part", "salt", "is_query")
    near = met.mapInArrow(_search(quantiser, dims, k, rerank, min_cos), "q long, m long, cos double")
    if min_cos > -1:
        near = near.filter("q <> m").groupBy("q", "m").agg(F.max("cos").alias("cosine"))
    else:
        # a member stands in one list and a query reads a list once; ids decide between the level ones below
        level = Window.partitionBy("q").orderBy(F.desc(F.round("cos", 9)))
        near = near.withColumn("r", F.rank().over(level)).filter(F.col("r") <= k).select("q", "m", F.col("cos").alias("cosine"))
    near = stage(near, "near")
    ids = flat.select("rid", "id")
    near = near.join(ids.select(F.col("rid").alias("q"), F.col("id").alias("q_id")), "q").join(ids.select(F.col("rid").alias("m"), F.col("id").alias("m_id")), "m")
    return _with_copies(copies, near, k)


def _with_copies(copies: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Neighbours of entries made neighbours of rows, with the copies of an entry among themselves."""
    held = copies.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(64)))
    # the k + 1 smallest ids of each entry (more of its copies can't rank), within slots first so that no task sorts all copies of one vector
    inner = held.withColumn("r", F.row_number().over(Window.partitionBy("lead", "slot").orderBy("id"))).filter(F.col("r") <= k + 1)
    front = inner.withColumn("r", F.row_number().over(Window.partitionBy("lead").orderBy("id"))).filter(F.col("r") <= k + 1).select("lead", F.col("id").alias("front"))
    among = copies.join(front, "lead").filter("id <> front").select("id", F.col("front").alias("neighbour"), F.lit(1.0).alias("cosine"))
    to_rows = near.join(front.select(F.col("lead").alias("m"), "front"), "m", "left").select("q", "q_id", F.coalesce("front", "m_id").alias("neighbour"), "cosine")
    from_rows = to_rows.join(copies.select(F.col("lead").alias("q"), "id"), "q", "left").select(F.coalesce("id", "q_id").alias("id"), "neighbour", "cosine")
    rank = Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 9)), "neighbour")
    return from_rows.unionByName(among).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
