"""The queries of this subpackage, over whole tables and with production parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodeweave.llm.ann import nearest_vectors
from nodeweave.llm.leaks import leaked_items
from nodeweave.llm.near_dups import near_duplicate_groups, pairs_of, words_of
from nodeweave.llm.overlap import set_overlaps, vector_overlaps
from nodeweave.llm.packing import CAPACITY, pack, token_counts
from nodeweave.llm.reading import reading_level, within_levels
from nodeweave.llm.splits import assign_splits, linked_groups
from nodeweave.session import stage
from nodeweave.sources.tables import latest, table


def _p1_groups(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "teacher_episode").select("id", "query", "current_node.summary", "current_node.full", F.col("current_node").isNotNull().alias("there"))
    e = e.filter("there and trim(query) <> ''").dropDuplicates(["id"])
    return near_duplicate_groups(e.select("id", words_of("query", "summary", "full").alias("words")), "id", "words", threshold=0.75)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of different episodes in one near-duplicate group."""
    return pairs_of(_p1_groups(spark, d))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per episode with its group."""
    return _p1_groups(spark, d)


#: Fields of problem 2: name, column, dimensions, least cosine.
VECTORS = (("summary", "summary_vector", 32, 0.97), ("traversal", "traversal_vector", 16, 0.998), ("full", "full_vector", 64, 0.90))
#: Without a least cosine: lists and cells read, and members of each part reranked at least.
UNBOUNDED = {"probes": 192, "cells": 12, "rerank": 48}


def _p2_nearest(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    """The neighbours that reach the field's least cosine; all of them if ``whole``."""
    parts = []
    for name, column, dims, least in VECTORS:
        now = latest(table(spark, d, "node_frame"), ["node_id"], ["version"], [column])
        wanted = UNBOUNDED if whole else {"min_cos": least}
        parts.append(nearest_vectors(now, "node_id", column, dims, k=5, **wanted).withColumn("vec", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The up to 5 most similar nodes of every current node in each vector field, with cosine and rank."""
    return _p2_nearest(spark, d, whole=True).select("vec", "id", "neighbour", F.round("cosine", 6).alias("cosine"), "rank")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of which at least one is among the other's 5 most similar and that reach the field's least cosine."""
    return _p2_nearest(spark, d).select("vec", F.least("id", "neighbour").alias("node_a"), F.greatest("id", "neighbour").alias("node_b")).distinct()


def _spelling(col: F.Column) -> F.Column:
    """Lower case, one ``_`` between words."""
    return F.regexp_replace(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _p3_groups(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "teacher_episode").select("id", "expected_topic").distinct()
    own = _spelling(F.regexp_extract("id", r"(?i)^(.*?)-[vq][0-9]+", 1))
    query = _spelling(F.regexp_extract("id", r"(?i)-v[0-9]+-(.+)$", 1))
    split_at = r"^([^:/]*[A-Za-z0-9][^:/]*)[:/]+(.*)$"
    led = F.col("expected_topic").rlike(split_at)
    domain = F.when(led, _spelling(F.regexp_extract("expected_topic", split_at, 1))).otherwise(own)
    topic = F.when(led, _spelling(F.regexp_extract("expected_topic", split_at, 2))).otherwise(_spelling(F.col("expected_topic")))
    keyed = e.select(
        "id",
        F.when(topic != "", F.concat(F.lit("1"), domain, F.lit(":"), topic)).alias("by_topic"),
        F.when(query != "", F.concat(F.lit("2"), own, F.lit(":"), query)).alias("by_query"),
    )
    groups = linked_groups(keyed, "id", ["by_topic", "by_query"])
    return groups.select("id", F.when(F.col("group").startswith("1"), F.substring("group", 2, 1_000_000)).alias("group_key"), "group")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every episode with the smallest domain:topic of its group."""
    return _p3_groups(spark, d).select("id", "group_key")


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every episode with its group and new split."""
    return assign_splits(_p3_groups(spark, d).select("id", "group"), table(spark, d, "split_plan"))


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows, groups and share of each new split beside the wanted share."""
    got = p3_splits(spark, d).groupBy("split").agg(F.count("*").alias("episodes"), F.countDistinct("group").alias("groups"))
    # one row for each of the plan's few splits
    total = F.sum("episodes").over(Window.partitionBy(F.lit(1)))
    return table(spark, d, "split_plan").join(got, "split", "left").select(
        "split", F.coalesce("episodes", F.lit(0)).alias("episodes"), F.coalesce("groups", F.lit(0)).alias("groups"),
        F.round(F.coalesce("episodes", F.lit(0)) / total, 4).alias("got"), F.col("share").alias("wanted"),
    )


def _first_delivery(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["id"])


def _p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "teacher_episode")
    query = _first_delivery(e.select("id", "split", words_of("query").alias("words")))
    listed = F.transform("candidates", lambda c: F.when(c["node_summary"].isNotNull(), F.array_join(F.regexp_extract_all(F.lower(c["node_summary"]), F.lit("[a-z0-9]+"), F.lit(0)), " ")))
    members = _first_delivery(e.select("id", "split", F.array_distinct(F.filter(listed, lambda x: x.isNotNull() & (x != ""))).alias("members")))
    cases = _first_delivery(table(spark, d, "traversal_ranking").select("id", "split", "query"))
    return (
        set_overlaps(query, "id", "split", "words", 0.70).withColumn("kind", F.lit("query"))
        .unionByName(set_overlaps(members, "id", "split", "members", 0.70, least=4).withColumn("kind", F.lit("candidates")))
        .unionByName(vector_overlaps(cases, "id", "split", "query", 32, 0.995).withColumn("kind", F.lit("ranking")))
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a train and an evaluation record that are the same or nearly so."""
    return _p5_pairs(spark, d).select("kind", "id_a", "id_b")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """By kind, evaluation split and source: evaluation records, how many also stand in train, and how much of these one training record covers on average."""
    pairs = stage(_p5_pairs(spark, d).select("kind", F.col("held_out").alias("id"), "covered"), "pairs")
    hit = pairs.groupBy("kind", "id").agg(F.max("covered").alias("covered"))
    name = F.lower(F.trim("split"))
    split = F.when(name.isin("validation", "val"), "validation").when(name == "test", "test")
    records = None
    for t, kinds in (("teacher_episode", ("query", "candidates")), ("traversal_ranking", ("ranking",))):
        own = _first_delivery(table(spark, d, t).select("id", "split", "source")).select("id", split.alias("split"), "source").filter("split is not null")
        for kind in kinds:
            part = own.withColumn("kind", F.lit(kind))
            records = part if records is None else records.unionByName(part)
    counted = records.join(hit, ["kind", "id"], "left").groupBy("kind", "split", "source")
    return counted.agg(F.count("*").alias("records"), F.count("covered").alias("overlapping"), F.round(F.coalesce(F.avg("covered"), F.lit(0.0)), 6).alias("covered"))


def _p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_counts(table(spark, d, "documents"), "doc_id", "text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that had to be cut."""
    return _p6_packed(spark, d).filter("piece = 1 and container is not null").select(F.col("id").alias("doc_id"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's pieces with their container and their places in document and container."""
    return _p6_packed(spark, d).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    each = _p6_packed(spark, d).filter("container is not null").groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return each.agg(F.count("*").alias("containers"), F.max("tokens").alias("fullest"), F.round(F.sum("tokens") / (F.count("*") * CAPACITY), 6).alias("fill"))


def _p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the evaluation items they leak."""
    return _p7_leaks(spark, d).select(F.col("id").alias("doc_id"), "item_id").distinct()


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    """The leaked passages with their place in the original text."""
    return _p7_leaks(spark, d).withColumnRenamed("id", "doc_id")


def _p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_level(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The reading level of every document with enough English prose."""
    return _p8_levels(spark, d).select("doc_id", "level")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    """The figures behind the level."""
    return _p8_levels(spark, d)


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents and means by domain and level."""
    by = _p8_levels(spark, d).join(table(spark, d, "documents").select("doc_id", "domain"), "doc_id")
    return by.groupBy("domain", "level").agg(F.count("*").alias("documents"), F.round(F.avg("score"), 3).alias("score"), F.round(F.avg("estimate"), 3).alias("estimate"), F.round(F.avg("coverage_rank"), 1).alias("coverage_rank"))


def p8_selected(spark: SparkSession, d: str) -> DataFrame:
    """Documents for middling readers: neither their sentences nor their vocabulary easier than level 2 or harder than level 3."""
    return within_levels(_p8_levels(spark, d), 2, 3).select("doc_id", "level", "vocabulary_level")


def queries() -> dict:
    return {
        "p1_found": p1_found, "p1_groups": p1_groups,
        "p2_found": p2_found, "p2_nearest": p2_nearest,
        "p3_found": p3_found, "p3_splits": p3_splits, "p3_shares": p3_shares,
        "p5_found": p5_found, "p5_counts": p5_counts,
        "p6_found": p6_found, "p6_containers": p6_containers, "p6_fill": p6_fill,
        "p7_found": p7_found, "p7_passages": p7_passages,
        "p8_found": p8_found, "p8_levels": p8_levels, "p8_profile": p8_profile, "p8_selected": p8_selected,
    }


def oracle_sql() -> dict[str, str]:
    from nodeweave.llm.sql import oracle_sql as sql

    return sql()
