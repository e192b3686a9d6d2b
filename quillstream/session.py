"""Session helpers: shared checkpoint folder, lineage cuts, size-checked broadcasts and table reading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size, in bytes, of a side that may be broadcast by hint.
BROADCAST_LIMIT = 32 * 1024 * 1024
#: Setting under which Spark drops the shuffle files of a query when it has ended.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillstream")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUILL_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where the setting is missing (local tests) a folder of this machine is chosen, and only for a local master.
    """
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir")
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = spark.conf.get("quillstream.checkpoint.dir", "") or tempfile.mkdtemp(prefix="quillstream-")
        spark.conf.set("quillstream.checkpoint.dir", at)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder once, so that later uses neither recompute them nor depend on an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, **options: str) -> DataFrame:
    """The same rows from a parquet table in the shared folder: a cut that later reads can prune by column.

    Shuffle files of the query go as soon as the table is there, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/quillstream-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED)
    spark.conf.set(FREED, "true")
    try:
        df.write.options(**options).parquet(at)
    finally:
        spark.conf.set(FREED, before)
    atexit.register(_forget, spark, at)
    return spark.read.schema(df.schema).parquet(at)


def _forget(spark: SparkSession, at: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended before
        shutil.rmtree(at.removeprefix("file://"), ignore_errors=True)


def small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """df, hinted for broadcast only when its rows have been measured to take at most limit bytes; beyond that a plain shuffle join.

    df is evaluated once more for that, so it should be cheap or cut. Strings and arrays count with the bytes they hold.
    """
    long = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    lists = [c for c, kind in df.dtypes if kind.startswith(("array", "map"))]
    held = [F.octet_length(c) for c in long] + [F.octet_length(F.to_json(c)) for c in lists]
    bytes_ = reduce(Column.__add__, [F.coalesce(h, F.lit(0)).cast("long") for h in held], F.lit(16 * len(df.columns)).cast("long"))
    return F.broadcast(df) if (df.agg(F.sum(bytes_)).first()[0] or 0) <= limit else df


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once per row.

    A one-row generator keeps the optimiser from copying the expression into every later use of the column.
    """
    name = "__" + "_".join(columns)
    return df.withColumn(name, F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))))).select("*", f"{name}.*").drop(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
