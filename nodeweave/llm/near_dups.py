"""Near-duplicate records by a MinHash LSH forest with exact verification.

Each distinct word set gets a signature of LEVELS MinHash values a tree; a tree's
signatures, sorted, are its prefix trie, and a trie node of depth d is the run of
records that agree on the first d values. The forest is walked from deep to shallow:

* at full depth records of a node are almost surely alike, so each is only
  held against the node's smallest record (a star, never all pairs), verified
  exactly and merged into components;
* matched prefixes are then shortened to the depth at which pairs at the threshold
  meet in some tree with the target recall, and further, a level at a time, while the
  recall measured on the data is below the target (how many verified pairs met in
  one tree only, and how many in two, tells how many met in none). Only nodes that
  hold *different* components are followed up, and in them only pairs of different
  components, dealt over salts where a node is crowded.

Exact copies are one record from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeweave.llm.components import components
from nodeweave.session import stage

WORD = "[a-z0-9]+"


def words_of(*cols: str) -> F.Column:
    """Sorted distinct words (maximal runs of a-z and 0-9 after lower-casing) of the columns taken together."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *cols)), F.lit(WORD), F.lit(0))))


def shingles_of(col: str, size: int = 5) -> F.Column:
    """Sorted distinct runs of ``size`` words; a shorter text is one shingle."""
    words = F.regexp_extract_all(F.lower(F.col(col)), F.lit(WORD), F.lit(0))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (size - 1))), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when(F.size(words) > 0, F.array_sort(F.array_distinct(runs))).otherwise(F.array().cast("array<string>"))


#: Bytes of a MinHash value kept at each level of a trie.
VALUE = 3
#: Pairs of one trie node that one task makes, about.
NODE_PAIRS = 1_000_000


def depth_for(threshold: float, trees: int, recall: float, deepest: int) -> int:
    """The longest prefix at which pairs at the threshold still meet in some tree with probability ``recall``."""
    for depth in range(deepest, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError(f"{trees} trees can't reach a recall of {recall} at {threshold}; take more trees")


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_201)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _forest_rows(trees: int, levels: int):
    """(rid, trie): a row for each tree; trie is the tree's number and its values in order, so that sorted rows are the tree's trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _multipliers(trees * levels)
        width = 1 + VALUE * levels
        for batch in batches:
            sets = batch.column("hashes")
            flat = sets.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            lengths = sets.value_lengths().to_numpy(zero_copy_only=False)
            if not len(lengths):
                continue
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
            rid = batch.column("rid").to_numpy(zero_copy_only=False)
            out = np.empty((trees, len(rid), width), np.uint8)
            with np.errstate(over="ignore"):
                for t in range(trees):
                    out[t, :, 0] = t
                    for d in range(levels):
                        h = flat * mul[t * levels + d] + add[t * levels + d]
                        h ^= h >> np.uint64(29)
                        low = np.minimum.reduceat(h, starts) * np.uint64(0x9E3779B97F4A7C15)
                        out[t, :, 1 + VALUE * d : 1 + VALUE * (d + 1)] = (low >> np.uint64(40)).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:]
            offsets = pa.py_buffer((np.arange(trees * len(rid) + 1) * width).astype(np.int32).tobytes())
            trie = pa.Array.from_buffers(pa.binary(), trees * len(rid), [None, offsets, pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(rid, trees)), trie], ["rid", "trie"])

    return run


def _node(depth: int) -> F.Column:
    """The trie node of a row at a depth."""
    return F.substring("trie", 1, 1 + VALUE * depth).alias("node")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The rows of pairs (a, b, ...) whose sets overlap by at least ``threshold``, counted exactly."""
    both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("hashes").alias("x")), "a").join(
        sets.select(F.col("rid").alias("b"), F.col("hashes").alias("y")), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    # sizes first: sets of too different size can't reach the threshold
    return both.filter(
        (F.least(F.size("x"), F.size("y")) >= threshold * F.greatest(F.size("x"), F.size("y"))) & (common >= threshold * union)
    ).select(*pairs.columns)


def _crossing(forest: DataFrame, merged: DataFrame, depth: int) -> DataFrame:
    """(a, b, trees): pairs of different components that share a node of that depth, and in how many trees."""
    placed = forest.select(_node(depth), "rid").join(merged.select(F.col("node").alias("rid"), "component"), "rid", "left")
    placed = placed.withColumn("component", F.coalesce("component", "rid"))
    sizes = placed.groupBy("node", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("node").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("kinds")).filter("kinds > 1")
    mixed = mixed.select("node", F.col("top.component").alias("largest"), F.ceil(F.col("all") * (F.col("all") - F.col("top.n")) / NODE_PAIRS).cast("int").alias("salts"))
    placed = stage(placed.join(mixed, "node"), f"mixed{depth}")
    # the largest component of a node is met by the others, not by itself; a crowded node's pairs are dealt over salts
    rest = placed.filter("component <> largest").select("node", F.col("rid").alias("x"), F.col("component").alias("cx"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    every = placed.select("node", F.col("rid").alias("y"), F.col("component").alias("cy"), (F.col("component") == F.col("largest")).alias("in_largest"), F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int").alias("salt"))
    met = rest.join(every, ["node", "salt"]).filter("cx <> cy and (in_largest or x < y)")
    return met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("trees"))


def _recall(found: DataFrame) -> float:
    """The share of the pairs at this depth that met in some tree, by how many of the found met in one tree and in two."""
    seen = found.agg(F.count("*").alias("n"), F.count_if(F.col("trees") == 1).alias("once"), F.count_if(F.col("trees") == 2).alias("twice")).first()
    missed = seen["once"] ** 2 / (2 * max(1, seen["twice"])) if seen["once"] else 0.0
    return seen["n"] / (seen["n"] + missed) if seen["n"] else 1.0


def near_duplicate_groups(df: DataFrame, id_col: str, set_col: str, threshold: float = 0.8, trees: int = 48, deepest: int = 10, recall: float = 0.999) -> DataFrame:
    """(id, group): records linked by an overlap of at least ``threshold``, also through others.

    ``set_col`` is an array of distinct strings (words or shingles). Every record
    comes out once; group is the smallest id of its group. Records with a null or
    empty set are alone, repeated ids are one record (its smallest set), ties in
    similarity count as linked. Other columns are ignored. Overlaps are counted
    on 64-bit hashes of the members. At most 256 trees.
    """
    base = df.select(F.col(id_col).alias("id"), F.col(set_col).alias("members")).filter(F.col(id_col).isNotNull())
    base = base.groupBy("id").agg(F.min("members").alias("members"))
    hashed = base.select("id", F.array_sort(F.array_distinct(F.transform("members", lambda w: F.xxhash64(w)))).alias("hashes"))
    hashed = hashed.withColumn("same", F.when(F.size("hashes") > 0, F.md5(F.concat_ws(",", F.col("hashes").cast("array<string>")))))
    members = stage(hashed.select("id", "same", "hashes"), "members")
    sets = stage(
        members.filter("same is not null").groupBy("same").agg(F.min("id").alias("rep"), F.first("hashes").alias("hashes"))
        .withColumn("rid", F.monotonically_increasing_id()),
        "sets",
    )
    depth = min(deepest, depth_for(threshold, trees, recall, deepest))
    forest = sets.select("rid", "hashes").mapInArrow(_forest_rows(trees, deepest), "rid long, trie binary")
    forest = stage(forest, "forest", sort=["trie"])

    heads = forest.groupBy(_node(deepest)).agg(F.min("rid").alias("a"), F.count("*").alias("n")).filter("n > 1").select("node", "a")
    star = forest.select(_node(deepest), F.col("rid").alias("b")).join(heads, "node").filter("a <> b").select("a", "b").distinct()
    links = stage(verified(star, sets, threshold), "deep_links")
    groups = components(links)
    while True:
        found = stage(verified(_crossing(forest, groups, depth), sets, threshold), f"links{depth}")
        links = links.unionByName(found.select("a", "b"))
        groups = components(links)
        if depth == 1 or _recall(found) >= recall:
            break
        depth -= 1

    named = sets.select("rid", "same", "rep").join(groups.select(F.col("node").alias("rid"), "component"), "rid", "left")
    named = named.withColumn("component", F.coalesce("component", "rid"))
    heads = named.groupBy("component").agg(F.min("rep").alias("group"))
    by_set = named.join(heads, "component").select("same", "group")
    return members.select("id", "same").join(by_set, "same", "left").select("id", F.coalesce("group", "id").alias("group"))


def pairs_of(groups: DataFrame, id_col: str = "id", group_col: str = "group") -> DataFrame:
    """(id_a, id_b) for all pairs within a group, the smaller id first.

    The result itself is quadratic in a group; it is only for consumers that ask
    for pairs. Members are dealt over salts on one side, so that a large group is
    written by many tasks.
    """
    big = groups.groupBy(group_col).agg(F.count("*").alias("n")).filter("n > 1")
    some = groups.join(big, group_col)
    width = F.greatest(F.lit(1), F.least(F.lit(256), (F.col("n") / 2_000).cast("int")))
    left = some.select(group_col, F.col(id_col).alias("id_a"), F.pmod(F.xxhash64(id_col), width).alias("salt"))
    right = some.select(group_col, F.col(id_col).alias("id_b"), F.explode(F.sequence(F.lit(0).cast("long"), (width - 1).cast("long"))).alias("salt"))
    return left.join(right, [group_col, "salt"]).filter("id_a < id_b").select("id_a", "id_b")
