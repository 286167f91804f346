"""JSON-lines files: one object a line, blank lines skipped, shards as folders."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeweave.session import shared_dir


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of all files under ``path`` with an explicit schema; a line that is no JSON object fails the read. Missing fields are null, unknown ones dropped, a shard folder's number comes as a column."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, shard_col: str, name: str, path: str | None = None) -> str:
    """Write one folder of JSON lines a shard and return the path; rows of a shard may come from many tasks, none holds a shard alone."""
    path = path or f"{shared_dir(df.sparkSession)}/nodeweave-{uuid.uuid4().hex}/{name}"
    df.write.partitionBy(shard_col).option("ignoreNullFields", "false").json(path)
    return path


def read_in_file_order(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Objects with ``file`` (name only) and ``folder`` to order by, as files are read in name order."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(glob)
    return rows.select("*", F.col("_metadata.file_name").alias("file"), F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder"))


def manifest(df: DataFrame, shard_col: str, **facts: object) -> str:
    """Manifest JSON of a sharded table: rows by shard (a count each) and given facts."""
    counts = {str(r[0]): r[1] for r in df.groupBy(shard_col).count().orderBy(shard_col).collect()}
    return json.dumps({"schema_version": 1, "rows": sum(counts.values()), "shards": counts, **facts}, separators=(",", ":"), sort_keys=True)
