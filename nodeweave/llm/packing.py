"""Filling fixed-capacity containers with texts.

The plan is made on counts, not on documents: best fit, longest first, over the
histogram of lengths (at most ``capacity`` rows, whatever the corpus holds).
Containers of equal contents are one range, so a step places all items of a
length that go to a range at once. Documents then take the planned slots by
their rank within their length, counted in buckets so that a length which half
of the corpus shares is ranked by many tasks.
"""

from __future__ import annotations

import base64
import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeweave.session import spread, stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern published with this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048
#: Rows of one length ranked by one task, about.
BUCKET_ROWS = 100_000


def _count_tokens(path: str):
    held: dict = {}

    def encoder():
        if "enc" not in held:
            import tiktoken
            from pyspark import SparkFiles

            with open(SparkFiles.get(path), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            held["enc"] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return held["enc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            enc = encoder()
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes, pa.int64())], ["id", "tokens"])

    return run


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, tokens) of whole texts under a public tokenizer; null and empty texts have 0.

    ``tokenizer`` is a vocabulary file that the driver can read; it is sent to the executors.
    """
    df.sparkSession.sparkContext.addFile(tokenizer)
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(picked).mapInArrow(_count_tokens(os.path.basename(tokenizer)), T.StructType([picked.schema["id"], T.StructField("tokens", T.LongType())]))


def plan_containers(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: (length, first rank, first container, items a container, filled before) by length and rank.

    Item r of a length goes to the container first + (r - first rank) // items of the last row at or before r,
    behind what filled it before and (r - first rank) % items others of its length.
    """
    space: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space -> ranges (first container, how many)
    open_spaces = np.zeros(capacity + 1, bool)
    made, plan = 0, []

    def give(free: int, first: int, n: int) -> None:
        if n and free:
            space[free].append((first, n))
            open_spaces[free] = True

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            fits = np.nonzero(open_spaces[length:])[0]
            if len(fits):
                free = length + int(fits[0])
                first, n = space[free].pop()
                open_spaces[free] = bool(space[free])
                each = free // length
                used = min(n, left // each)
                if used:
                    plan.append((length, rank, first, each, capacity - free))
                    rank, left = rank + used * each, left - used * each
                    give(free - each * length, first, used)
                if used < n:
                    if left and left < each:
                        plan.append((length, rank, first + used, left, capacity - free))
                        give(free - left * length, first + used, 1)
                        rank, left, used = rank + left, 0, used + 1
                    give(free, first + used, n - used)
            else:
                each = capacity // length
                whole = left // each
                if whole:
                    plan.append((length, rank, made, each, 0))
                    rank, left = rank + whole * each, left - whole * each
                    give(capacity - each * length, made, whole)
                    made += whole
                if left:
                    plan.append((length, rank, made, left, 0))
                    give(capacity - left * length, made, 1)
                    made, left = made + 1, 0
    return sorted(plan)


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, first, tokens, container, place) for sizes (id, tokens).

    A piece is the item's tokens from ``first`` on and stands in its container from
    token ``place`` on, so containers can be written from the texts and the result.

    Only an item longer than ``capacity`` is cut: whole containers' worth first,
    then the rest (pieces count from 0). An item of no tokens needs no room: its
    container is null. A null size counts as 0, repeated ids are items of their
    own, ties are placed by id. Extra columns are ignored.
    """
    spark = sizes.sparkSession
    # the number makes repeated ids distinct and is fixed by writing
    items = stage(sizes.select("id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")).withColumn("item", F.monotonically_increasing_id()), "sizes")
    pieces = items.filter("tokens > 0").select(
        "id", "item", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / capacity).cast("long"))).alias("piece")
    ).withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("piece") * capacity).cast("int"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_containers(histogram, capacity)
    buckets = int(max(1, min(4096, max(histogram.values(), default=0) // BUCKET_ROWS + 1)))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("item", "piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    local = Window.partitionBy("length", "bucket").orderBy("id", "item", "piece")
    ranked = pieces.withColumn("r", F.row_number().over(local)).join(F.broadcast(offsets) if buckets <= 8 else offsets, ["length", "bucket"]).withColumn("rank", F.col("offset") + F.col("r") - 1)

    most = max(histogram.values(), default=0) + 1
    keys = np.array([length * most + rank for length, rank, *_ in plan], np.int64)
    starts, firsts, each, before_it = (np.array([row[i] for row in plan], np.int64) for i in (1, 2, 3, 4))

    @F.arrow_udf("struct<container: long, place: long>")
    def slot(length: pa.Array, rank: pa.Array) -> pa.Array:
        length, rank = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, length * most + rank, side="right") - 1
        whole, behind = np.divmod(rank - starts[at], each[at])
        return pa.StructArray.from_arrays([pa.array(firsts[at] + whole), pa.array(before_it[at] + behind * length)], ["container", "place"])

    placed = ranked.withColumn("slot", slot(F.col("length").cast("long"), F.col("rank").cast("long")))
    placed = placed.select("id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).cast("long").alias("first"), F.col("length").alias("tokens"), "slot.container", F.col("slot.place").cast("int").alias("place"))
    none = F.lit(None)
    nothing = items.filter("tokens = 0").select("id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first"), F.lit(0).alias("tokens"), none.cast("long").alias("container"), none.cast("int").alias("place"))
    return placed.unionByName(nothing)
