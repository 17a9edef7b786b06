"""Tables written into the folder that the driver and all executors share, to cut lineage and to be read several times."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: spark.checkpoint.dir; where it is unset, one of our own, in local mode only (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own_dir(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/quillmark-{spark.sparkContext.applicationId}"


@cache
def _own_dir(app: str) -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def delete(spark: SparkSession, path: str) -> None:
    files, jpath = _file_system(spark, path)
    files.delete(jpath, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings while something is planned and run; set back after it."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Shuffles of a job are deleted when it is over, not when the driver's memory happens to be swept.
SWEPT = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: A key, and the number of buckets that its values are dealt to.
Dealing = tuple[str, int]


def in_place(dealt: Dealing) -> dict[str, str]:
    """Settings by which joins and groups by the key and more stay in the key's bucket, and a shuffle has those buckets.

    Files of 10 MB may be gigabytes as a hash table, so the driver broadcasts only what is tiny, such as different labels."""
    return {
        "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.shuffle.partitions": str(dealt[1]),
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "256KB",
    }


def stash(df: DataFrame, dealt: Dealing | None = None, bucketed: bool = True, more: tuple[str, ...] = ()) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again.

    The files survive lost executors, keep column pruning for later readers, are replicated as the shared store
    replicates them, and go when the session ends if nothing has deleted them before. The shuffles behind them go at once.

    dealt: tables behind df are dealt like this, so joins by the key and more columns are made where the rows are. With
    bucketed, the last step of df has all rows of a key (and of more columns, where it is dealt by those too) in one task,
    and what is written is a table dealt like that: a Python step in between forgets how its rows are dealt, the table not.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    name = f"quillmark_{path.rsplit('/', 1)[1]}" if dealt and bucketed else None
    with settings(spark, SWEPT | (in_place(dealt) if dealt else {})):
        written = df.write.format("parquet").options(**({"compression": "zstd"} if dealt else {}))
        if name:
            written.bucketBy(dealt[1], dealt[0], *more).option("path", path).saveAsTable(name)
        else:
            written.save(path)
    files, jpath = _file_system(spark, path)
    files.deleteOnExit(jpath)
    out = spark.table(name) if name else spark.read.schema(df.schema).parquet(path)
    out._stash_path, out._stash_table = path, name
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a stash that nothing reads any more."""
    if path := getattr(df, "_stash_path", None):
        if name := getattr(df, "_stash_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        delete(df.sparkSession, path)
