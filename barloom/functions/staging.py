"""Stored intermediate tables and small JSON documents, on whatever file system the session uses."""

from __future__ import annotations

import gc
import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A fresh folder name under ``spark.checkpoint.dir``, which must name a shared folder.

    All stages of an application lie in one folder, which goes when its driver ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    context = spark.sparkContext
    owner = f"{shared.rstrip('/')}/barloom-{context.applicationId}"
    folder = context._jvm.org.apache.hadoop.fs.Path(owner)
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{owner}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, which else wait for a garbage collection of the driver."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once as parquet to shared storage and read back.

    Cuts the lineage where a frame is read several times; later reads prune columns, and a lost
    executor costs a re-read, not a recomputation.
    """
    path = f"{scratch(df.sparkSession)}/stage.parquet"
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_by(
    df: DataFrame, path: str, key: str, order: str, tasks: int, folders: Sequence[str] = (), compression: str = "zstd"
) -> str:
    """Write the rows as parquet in ``tasks`` buckets by ``key``, sorted by ``key`` and ``order`` in each, in folders by
    the values of ``folders``; gives the name under which the session's catalog knows the files. Rows that come spread over as many tasks by ``key`` make one file a bucket.
    """
    name = f"stage_{uuid.uuid4().hex}"
    placed = df.write.partitionBy(*folders) if folders else df.write
    buckets = placed.mode("overwrite").option("compression", compression).bucketBy(tasks, key).sortBy(key, order)
    buckets.option("path", path).format("parquet").saveAsTable(name)
    return name


def read_by(df: DataFrame, path: str, key: str, order: str, tasks: int, folders: Sequence[str] = ()) -> DataFrame:
    """What was written to ``path`` in buckets, read as ``df`` without them, so that work by ``key`` needs no exchange.

    ``folders`` are columns whose values are folder names.
    """
    spark, name = df.sparkSession, f"stage_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    parts = f"PARTITIONED BY ({', '.join(folders)}) " if folders else ""
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {parts}CLUSTERED BY (`{key}`) SORTED BY (`{key}`, `{order}`) INTO {tasks} BUCKETS LOCATION '{path}'")
    if folders:
        spark.catalog.recoverPartitions(name)
    return spark.table(name)


def stored_by(df: DataFrame, key: str, order: str, tasks: int) -> DataFrame:
    """The same rows, written once in ``tasks`` buckets by ``key`` and sorted by ``key`` and ``order`` in each.

    Work by ``key`` on what is read back needs no exchange. The table is known to the session's catalog, its files lie
    with the other stages.
    """
    name = write_by(df, f"{scratch(df.sparkSession)}/stage.parquet", key, order, tasks)
    release(df.sparkSession)
    return df.sparkSession.table(name)


def write_json(spark: SparkSession, document: dict, path: str) -> None:
    text = json.dumps(document, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path, wholetext=True).where("length(trim(value)) > 0").take(1)
    if not rows:
        raise FileNotFoundError(f"No manifest at {path}")
    return json.loads(rows[0].value)
