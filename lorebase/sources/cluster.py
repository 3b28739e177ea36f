"""What jobs need of the cluster: folders that driver and executors share, results kept there, and this package on the workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; where none is set, in the warehouse, or a temporary one if all runs in one local process."""
    sc = spark.sparkContext
    alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    base = base or (tempfile.mkdtemp(prefix="lorebase-stream-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/_streams")
    return f"{base}/{name}-{uuid4().hex}"


def _store(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, store = _store(spark, path)
    return store.exists(target)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, sorted; none if it isn't there."""
    target, store = _store(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(target)) if store.exists(target) else []


def version_of(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a file, or of a folder's files: another string once they change."""
    target, store = _store(spark, path)
    return ";".join(sorted(f"{x.getPath()}|{x.getLen()}|{x.getModificationTime()}" for x in store.listStatus(target)))


def put_mark(spark: SparkSession, path: str) -> None:
    """An empty file. It is there or not, so it can make visible what was written before it."""
    target, store = _store(spark, path)
    store.create(target, True).close()


def drop_path(spark: SparkSession, path: str) -> None:
    target, store = _store(spark, path)
    store.delete(target, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df`, written once to the shared folder and read from there: for what several jobs use, and outlives executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` in as many partitions as tasks can run, if a scan of few row groups has fewer: for costly work on each row. A large table stays as it is read."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def dealt(df: DataFrame, rows: int, *keys: str, share: int = 250_000) -> DataFrame:
    """`df` by its `keys`, about `share` of its `rows` to a partition, but as many partitions as tasks can run at least.

    The number is given, so that adaptive execution puts none together: it goes by bytes as
    compressed for a shuffle, of which narrow rows have few and in a sort or a hash table many.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // share)), *keys)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for each application, so that Python tasks can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="lorebase-library-")) / f"{root.name}_library.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
