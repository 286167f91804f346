"""Session helpers: a local session for tests and benches, and the shared scratch folder.

Lineage is cut by writing a table into the folder that the cluster names in
``spark.checkpoint.dir`` (a folder every executor can read), so the loss of an
executor costs nothing but the tasks it was running. A folder of our own is
made only where the session names none, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str | int = "*", app: str = "nodeweave", **conf: str) -> SparkSession:
    """A session for one machine; on a cluster use the session that is given."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of a side that may be broadcast; a larger one is joined by shuffle.
HELD_BYTES = 32_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: ``spark.checkpoint.dir`` of the session, else, on one machine only, a temporary one of our own.

    A cluster must name a folder that all its machines see; without one this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can read")
    own = tempfile.mkdtemp(prefix="nodeweave-")
    spark.sparkContext.setCheckpointDir(own)
    return (spark.sparkContext.getCheckpointDir() or own).rstrip("/")


def stage(df: DataFrame, name: str, sort: list[str] | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and return the written table.

    Everything downstream reads the files: no recomputation, and nondeterministic
    columns (row numbers, ids) are fixed from here on. The files go when the
    application ends, or before with ``unstage``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/nodeweave-{uuid.uuid4().hex}/{name}"
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where.getParent())
    written = spark.read.schema(df.schema).parquet(path)
    written._nodeweave_path = path
    return written


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for t in tables:
        path = getattr(t, "_nodeweave_path", None)
        if path:
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getParent()
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table; one that ``stage`` has just written is taken as it is."""
    return df if hasattr(df, "_nodeweave_path") else stage(df, name)


def held(df: DataFrame, limit: int = HELD_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its measured size allows it, else as it is.

    Measured over all rows: the bytes of texts, and 16 for each other column. ``df``
    should be a written table of narrow columns, as it is read once to be measured.
    """
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) + 16 if t == "string" else F.lit(16) for c, t in df.dtypes]
    size = df.agg(F.sum(reduce(lambda a, b: a + b, wide)).alias("b")).first()["b"] or 0
    return F.broadcast(df) if size <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over enough tasks for work that is heavy for each row.

    A scan of a few large row groups has fewer tasks than the cluster has cores;
    only then are the rows shuffled. Counting the tasks of a scan runs nothing;
    a plan that shuffles already is dealt anew without counting, as counting would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    shuffles = "Exchange" in df._jdf.queryExecution().executedPlan().toString()
    return df.repartition(2 * cores) if shuffles or df.rdd.getNumPartitions() < cores else df
