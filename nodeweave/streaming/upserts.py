"""Deliveries as streams: nodes and edges upserted batch by batch, and late events counted by window.

Each micro-batch is folded into one row a key before it meets the table, so a
key delivered many times costs one row. The table lies in buckets of its sources;
a batch reads and writes anew only the buckets it touches, beside the old ones. A
pointer file, put in place by one rename, says which folder each bucket is in; a batch
that is replayed after a failure finds its number in the pointer and changes
nothing. Folders that neither the pointer nor the one before it names are deleted.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeweave.operators.graph import upsert_edges

#: Buckets of a streamed table.
BUCKETS = 64
COLUMNS = ["src_id", "dst_id", "edge_vector", "confidence", "created_at", "updated_at", "version", "ingested_at"]


def _pointer(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/current.json")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _state(spark: SparkSession, path: str) -> dict:
    fs, p = _pointer(spark, path)
    if not fs.exists(p):
        return {"batch": -1, "buckets": {}, "before": []}
    return json.loads(spark.read.text(p.toString(), wholetext=True).first()[0])


def _read(spark: SparkSession, path: str, folders: list[str]) -> DataFrame | None:
    return spark.read.parquet(*[f"{path}/{f}" for f in folders]).select(*COLUMNS) if folders else None


def current(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """(table, last batch) of a streamed folder; (None, -1) before the first batch."""
    state = _state(spark, path)
    return _read(spark, path, sorted(state["buckets"].values())), state["batch"]


def _publish(spark: SparkSession, path: str, state: dict) -> None:
    """Put the pointer in place by a rename, so that a reader sees the old one or the new one."""
    fs, p = _pointer(spark, path)
    jvm = spark._jvm
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}/next.json")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    over = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(fresh), fs.makeQualified(p), over)


def upsert_edges_batch(path: str):
    """A foreachBatch function that folds edge deliveries into the table at ``path``.

    Null keys are dropped with the batch; a repeated delivery changes nothing, an empty batch only its number.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = _state(spark, path)
        if number <= state["batch"]:
            return
        bucket = F.pmod(F.xxhash64("src_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
        rows = batch.filter("src_id is not null and dst_id is not null").select(*COLUMNS)
        # at most BUCKETS numbers
        touched = [str(r["bucket"]) for r in rows.select(bucket).distinct().collect()]
        made = {}
        if touched:
            old = _read(spark, path, [state["buckets"][b] for b in touched if b in state["buckets"]])
            both = rows if old is None else old.unionByName(rows)
            last = both.groupBy("src_id", "dst_id").agg(F.max("ingested_at").alias("ingested_at"))
            merged = upsert_edges(both).join(last, ["src_id", "dst_id"])
            version = f"v{number:08d}"
            merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{version}")
            made = {b: f"{version}/bucket={b}" for b in touched}
        _publish(spark, path, {"batch": number, "buckets": state["buckets"] | made, "before": sorted(state["buckets"][b] for b in made if b in state["buckets"])})
        fs, _ = _pointer(spark, path)
        for gone in state["before"]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{gone}"), True)

    return run


def stream_edges(source: DataFrame, path: str, checkpoint: str):
    """Start the stream of edge deliveries into ``path``; runs what is there and ends (call awaitTermination)."""
    return source.writeStream.foreachBatch(upsert_edges_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time_col: str, key_col: str, width: str = "1 hour", late: str = "7 days") -> DataFrame:
    """Events by window and key; what comes later than ``late`` is dropped. The same plan serves streams and tables."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), key_col).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), key_col, "events")
