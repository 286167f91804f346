"""Same or near-same records across splits, by a suffix array over the records' texts.

A record is a text of symbols: the words of a query or the members of a list in
one fixed order (rarest first, so that reordering does not matter), or the sign
patterns of a vector against fixed random directions. The suffixes of all texts
are sorted; suffixes with the same first symbol are one run of the array and lie
in one sorted partition, next to those they share the longest prefixes with (a
run of too many suffixes is dealt in a grid of blocks over tasks). Two suffixes
of different sides with a common prefix are a shared span, taken where it begins:
if the symbols before it agree as well, it is part of a longer one. Spans of a
pair are merged, and what they leave possible is verified exactly, which gives
the share of each record that the other covers.

Neighbours alone would tell which spans of a record stand on the other side, but
not with which records it shares enough of them; so every cross-split pair of a
run is looked at, in blocks and by a test of a few instructions that never drops
a pair which reaches the threshold: what is left behind the span (or the rounded
vector), then a parity signature of the set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeweave.session import held, stage

#: A symbol in more than one in so many texts counts as frequent; there are at most FREQUENT times a text's length of them.
FREQUENT = 4_000
#: Suffixes of one side and run that one block holds, about.
BLOCK = 20_000
#: Pairs compared at once.
PAIRS = 250_000
#: Bits of a set's parity signature.
BITS = 128
#: Symbols by which suffixes are sorted and their common prefix is measured.
SPAN = 4
#: More than rounding two unit vectors to half precision can change their cosine (2 * 2 ** -11).
ROUNDED = 0.002


def _runs(depth: int, front: float, payload):
    """Suffixes as (key of the first ``depth`` symbols, held_out, rid, suffix of SPAN symbols, payload); always those that begin at place front * length or before.

    The payload is (place, symbol before it) and what the record carries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul = np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            seqs = b.column("symbols")
            flat = seqs.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            lengths = seqs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(lengths)), lengths)
            begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
            n = np.repeat(lengths, lengths)
            at = np.arange(len(flat)) - begin
            # a suffix shorter than the prefix stands for itself only if the whole text is that short
            keep = ((n - at >= depth) & (at <= front * n + 1e-6)) | ((at == 0) & (n < depth))
            row, at, n, place = row[keep], at[keep], n[keep], np.nonzero(keep)[0]
            symbols = np.zeros((len(place), max(depth, SPAN)), np.uint64)
            for d in range(symbols.shape[1]):
                inside = at + d < n
                symbols[inside, d] = flat[place[inside] + d]
            key = np.zeros(len(place), np.uint64)
            with np.errstate(over="ignore"):
                for d in range(depth):
                    inside = at + d < n
                    key = np.where(inside, (key ^ symbols[:, d]) * mul, key)
                    key ^= np.where(inside, key >> np.uint64(31), np.uint64(0))
            columns = [pa.array(key.view(np.int64)), b.column("held_out").take(pa.array(row))]
            if payload is None:
                yield pa.RecordBatch.from_arrays(columns, ["key", "held_out"])
            else:
                before = np.where(at > 0, flat[np.maximum(place - 1, 0)], np.uint64(0)) if len(flat) else np.zeros(0, np.uint64)
                own = np.stack([at.astype(np.uint64), before], axis=1).view(np.uint8).reshape(len(at), 16)
                carried = np.concatenate((own, payload(b, flat, lengths, np.repeat(np.arange(len(lengths)), lengths))[row]), axis=1)
                columns += [b.column("rid").take(pa.array(row)), _fixed(symbols[:, :SPAN].astype(">u8").view(np.uint8)), _fixed(carried)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "held_out", "rid", "suffix", "payload"])

    return run


def _words(col: pa.ChunkedArray, kind: str) -> np.ndarray:
    """Binary values of one width as rows of a matrix."""
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), -1)


def _compare(close):
    """The (a, b, span) of all cross-split pairs of each block that share a span there and that ``close`` lets through; rows come as the array has them, sorted by block and suffix."""

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        block, rid = _blocks(rows), rows.column("rid").to_numpy()
        held = np.asarray(rows.column("held_out").to_pylist(), bool)
        group = np.concatenate(([0], np.cumsum((block[1:] != block[:-1]).any(1))))
        trained = np.nonzero(~held)[0]
        first = np.searchsorted(group[trained], np.arange(group[-1] + 1))
        trains = np.bincount(group[trained], minlength=group[-1] + 1)
        asks = np.nonzero(held & (trains[group] > 0))[0]
        if not len(asks):
            return
        symbols = _words(rows.column("suffix"), ">u8").astype(np.uint64)
        carried = _words(rows.column("payload"), np.uint8)
        own = np.ascontiguousarray(carried[:, :16]).view(np.uint64)
        at, before = own[:, 0].astype(np.int64), own[:, 1]
        test = close(at, np.ascontiguousarray(carried[:, 16:]))
        count = trains[group[asks]]
        ends = np.cumsum(count)
        lo = 0
        while lo < len(asks):
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
            n = count[lo:hi]
            a = np.repeat(asks[lo:hi], n)
            b = trained[np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + first[group[a]]]
            # only where a shared span begins
            begins = (before[a] != before[b]) | (at[a] == 0) | (at[b] == 0)
            a, b = a[begins], b[begins]
            ok = test(a, b)
            a, b = a[ok], b[ok]
            span = np.logical_and.accumulate(symbols[a] == symbols[b], axis=1).sum(1) if len(a) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rid[a]), pa.array(rid[b]), pa.array(span, pa.int32())], ["a", "b", "span"])
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last block of a batch may go on in the next
            block = _blocks(batch)
            cut = int((block != block[-1]).any(1).sum())
            if cut or (waiting and (_blocks(waiting[-1].slice(waiting[-1].num_rows - 1))[0] != block[-1]).any()):
                yield from pairs(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
                waiting = []
            waiting.append(batch.slice(cut))
        if waiting:
            yield from pairs(pa.Table.from_batches(waiting))

    return run


def _blocks(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")], axis=1)


def shared_span_pairs(texts: DataFrame, depth: int, payload, close, front: float = 1.0) -> DataFrame:
    """(a, b, span): every held-out and training text that share a span of ``depth`` and pass ``close``, with the longest of the spans they met by (up to SPAN); texts is (rid, held_out, symbols array<long>, ...).

    Only suffixes that begin in the first ``front`` of a text are read (1 reads all). No run
    is left out for its size: one of more than BLOCK suffixes a side is dealt in
    a grid of blocks, each held-out part against each training part.
    """
    sizes = texts.mapInArrow(_runs(depth, front, None), "key long, held_out boolean").groupBy("key").agg(F.count_if("held_out").alias("e"), F.count_if(~F.col("held_out")).alias("t"))
    crowded = (F.col("e") > 0) & (F.col("t") > 0) & (F.greatest("e", "t") > BLOCK)
    grid = stage(sizes.filter(crowded).select("key", F.ceil(F.col("e") / BLOCK).cast("int").alias("across"), F.ceil(F.col("t") / BLOCK).cast("int").alias("down")), "grid")
    rows = texts.mapInArrow(_runs(depth, front, payload), "key long, held_out boolean, rid long, suffix binary, payload binary")
    kept = ("held_out", "rid", "suffix", "payload")
    if not grid.isEmpty():
        one = F.coalesce("across", F.lit(1)), F.coalesce("down", F.lit(1))
        dealt = rows.join(held(grid), "key", "left").withColumn("mine", F.pmod(F.xxhash64("rid"), F.when(F.col("held_out"), one[0]).otherwise(one[1])).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("held_out"), one[1]).otherwise(one[0]) - 1)))
        i, j = F.when(F.col("held_out"), F.col("mine")).otherwise(F.col("other")), F.when(F.col("held_out"), F.col("other")).otherwise(F.col("mine"))
        rows = dealt.select("key", i.alias("i"), j.alias("j"), *kept)
    else:
        rows = rows.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), *kept)
    array = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "suffix")
    return array.mapInArrow(_compare(close), "a long, b long, span int").groupBy("a", "b").agg(F.max("span").alias("span"))


def rare_first(sets: DataFrame) -> DataFrame:
    """sets (rid, held_out, members array<long>) with ``symbols``, the members rarest first.

    Only frequent members are told apart by frequency, all others stand before
    them by value; the frequent ones are few (at most FREQUENT for each place in
    an average text) and are joined by broadcast.
    """
    total = max(1, sets.count())
    frequent = sets.select(F.explode("members").alias("m")).groupBy("m").agg(F.count("*").alias("n")).filter(F.col("n") > total / FREQUENT)
    table = sets.sparkSession.sparkContext.broadcast({r["m"]: r["n"] for r in frequent.filter(F.col("n") > 3).collect()})

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        names = np.array(sorted(known), np.int64)
        counts = np.array([known[int(k)] for k in names], np.int64)
        for b in batches:
            col = b.column("members")
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = col.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lengths)), lengths)
            if len(names):
                at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
                weight = np.where(names[at] == flat, counts[at], 0)
            else:
                weight = np.zeros(len(flat), np.int64)
            flat = flat[np.lexsort((flat, weight, row))]
            offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("held_out"), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["rid", "held_out", "symbols"])

    return sets.select("rid", "held_out", "members").mapInArrow(order, "rid long, held_out boolean, symbols array<long>")


def _sided(df: DataFrame, id_col: str, split_col: str) -> DataFrame:
    """df with id and held_out: true for validation and test, false for train, null (dropped) for anything else."""
    name = F.lower(F.trim(F.col(split_col)))
    side = F.when(name.isin("train", "training"), False).when(name.isin("validation", "val", "valid", "dev", "test", "testing"), True)
    return df.withColumn("id", F.col(id_col)).withColumn("held_out", side).filter("id is not null and held_out is not null")


def _parity(b: pa.RecordBatch, flat: np.ndarray, lengths: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Size and parity signature of each set: a member turns one bit over, so two sets differ in at least as many members as bits."""
    bit = ((flat * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(57)).astype(np.int64)
    odd = (np.bincount(row * BITS + bit, minlength=len(lengths) * BITS) & 1).astype(np.uint8).reshape(-1, BITS)
    return np.concatenate((lengths.astype(np.int64)[:, None].view(np.uint8), np.packbits(odd, axis=1)), axis=1)


def _fixed(x: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    offsets = pa.py_buffer((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _close_sets(threshold: float):
    def close(at: np.ndarray, carried: np.ndarray):
        words = carried.view(np.uint64)
        size, sign = words[:, 0].astype(np.int64), words[:, 1:]
        left = size - at

        def test(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            both = size[a] + size[b]
            # of a pair that reaches the threshold this holds where its first shared span begins, as nothing before it is shared
            ok = np.minimum(left[a], left[b]) * (1 + threshold) >= both * threshold - 1e-6
            a, b, both = a[ok], b[ok], both[ok]
            apart = np.bitwise_count(sign[a] ^ sign[b]).sum(1, dtype=np.int64)
            ok[ok] = np.maximum(apart, np.abs(size[a] - size[b])) * (1 + threshold) <= both * (1 - threshold) + 1e-6
            return ok

        return test

    return close


def set_overlaps(df: DataFrame, id_col: str, split_col: str, set_col: str, threshold: float, least: int = 1, front: float = 0.0) -> DataFrame:
    """(id_a, id_b, overlap, held_out, covered, span): records of train and of an evaluation split whose sets overlap by at least ``threshold``.

    Sets of fewer than ``least`` distinct members, null sets and records whose
    split is null or unknown take no part; equal records of either side all come
    out. A repeated id must carry the same row. The smaller id stands first.
    Of a text of n members the suffixes at places 0 to (1 - threshold) n are
    read, which is sure: a pair at the threshold lacks at most (1 - threshold) n
    of either text's members in the other, so its first common member stands no
    later in both. ``front`` may ask for more of a text, never for less.
    ``held_out`` is the evaluation record's id, ``covered`` the share of its members
    that the training record holds, ``span`` the longest of the shared spans by which they
    met (in rarest-first order, up to SPAN).
    """
    sided = _sided(df, id_col, split_col).select("id", "held_out", F.array_distinct(F.transform(F.array_compact(set_col), lambda w: F.xxhash64(w))).alias("members"))
    sided = stage(sided.filter(F.size("members") >= least).withColumn("digest", F.unhex(F.md5(F.concat_ws(",", F.array_sort("members").cast("array<string>"))))), "sided")
    # records with equal sets on one side are one text
    texts = stage(sided.groupBy("digest", "held_out").agg(F.first("members").alias("members")).withColumn("rid", F.monotonically_increasing_id()), "texts")
    pairs = shared_span_pairs(rare_first(texts), 1, _parity, _close_sets(threshold), max(front, 1 - threshold))
    sets = texts.select("rid", "digest", "members")
    both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("digest").alias("da"), F.col("members").alias("x")), "a").join(sets.select(F.col("rid").alias("b"), F.col("digest").alias("db"), F.col("members").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    kept = both.withColumn("overlap", common / (F.size("x") + F.size("y") - common)).filter(F.col("overlap") >= threshold)
    return _named(kept.select("da", "db", "overlap", (common / F.size("x")).alias("covered"), "span"), sided)


def _named(kept: DataFrame, sided: DataFrame) -> DataFrame:
    """Pairs of texts (da held out, db training, by digest) as pairs of records."""
    held = sided.filter("held_out").select(F.col("digest").alias("da"), F.col("id").alias("e"))
    seen = sided.filter("not held_out").select(F.col("digest").alias("db"), F.col("id").alias("t"))
    return kept.join(held, "da").join(seen, "db").select(F.least("e", "t").alias("id_a"), F.greatest("e", "t").alias("id_b"), "overlap", F.col("e").alias("held_out"), "covered", "span")


def _sign_texts(dims: int, symbols: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(31)
        planes = rng.standard_normal((dims, symbols * bits))
        powers = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            x = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            signs = (x @ planes >= 0).reshape(len(x), symbols, bits)
            text = signs @ powers + (np.arange(symbols, dtype=np.int64) + 1) * (1 << bits)
            offsets = pa.array((np.arange(len(x) + 1) * symbols).astype(np.int32))
            unit = _fixed((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float16).view(np.uint8))
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("held_out"), pa.ListArray.from_arrays(offsets, pa.array(text.reshape(-1))), unit], ["rid", "held_out", "symbols", "unit"])

    return run


def _unit(b: pa.RecordBatch, flat: np.ndarray, lengths: np.ndarray, row: np.ndarray) -> np.ndarray:
    return _words(b.column("unit"), np.uint8)


def _close_vectors(dims: int, min_cos: float):
    def close(at: np.ndarray, carried: np.ndarray):
        x = carried.view(np.float16).astype(np.float32)
        return lambda a, b: np.einsum("ij,ij->i", x[a], x[b]) >= min_cos - ROUNDED

    return close


def vector_overlaps(df: DataFrame, id_col: str, split_col: str, vector_col: str, dims: int, min_cos: float, symbols: int = 24, bits: int = 10) -> DataFrame:
    """(id_a, id_b, overlap, held_out, covered, span): records of train and of an evaluation split whose vectors have at least ``min_cos`` (``overlap``, a vector covers another by its cosine).

    A vector's text is ``symbols`` symbols of ``bits`` signs each; vectors this close
    share two neighbouring symbols all but surely (at 0.995 a symbol agrees in
    about 0.72 of cases). Null, all-zero and wrongly sized vectors take no part.
    """
    sided = _sided(df, id_col, split_col).select("id", "held_out", F.col(vector_col).cast("array<double>").alias("vector"))
    sided = sided.filter((F.size("vector") == dims) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v)) & F.exists("vector", lambda v: v != 0))
    digest = F.unhex(F.md5(F.concat_ws(",", F.col("vector").cast("array<string>"))))
    sided = stage(sided.withColumn("digest", digest), "sided")
    texts = stage(sided.groupBy("digest", "held_out").agg(F.first("vector").alias("vector")).withColumn("rid", F.monotonically_increasing_id()), "texts")
    signs = texts.select("rid", "held_out", "vector").mapInArrow(_sign_texts(dims, symbols, bits), "rid long, held_out boolean, symbols array<long>, unit binary")
    pairs = shared_span_pairs(signs, 2, _unit, _close_vectors(dims, min_cos))
    vectors = texts.select("rid", "digest", "vector")
    both = pairs.join(vectors.select(F.col("rid").alias("a"), F.col("digest").alias("da"), F.col("vector").alias("x")), "a").join(vectors.select(F.col("rid").alias("b"), F.col("digest").alias("db"), F.col("vector").alias("y")), "b")

    def dot(x: str, y: str) -> F.Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    kept = both.withColumn("overlap", dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y"))).filter(F.col("overlap") >= min_cos)
    return _named(kept.select("da", "db", "overlap", F.col("overlap").alias("covered"), "span"), sided)
