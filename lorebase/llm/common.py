"""What several operators of this subpackage share: cutting lineage, shipping code, Arrow text buffers."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: of `spark.checkpoint.dir`; where neither the session nor its context names one, in the warehouse, or in a temporary folder if all runs in one local process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        own = tempfile.mkdtemp(prefix="lorebase-checkpoint-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return sc.getCheckpointDir()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the store that `path` names, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """`names`, each with a number behind it if `df` has such a column."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in (n, *(f"{n}{i}" for i in range(1, len(taken) + 2))) if x.lower() not in taken) for n in names]


def checkpoint(df: DataFrame) -> DataFrame:
    """`df`, written to the shared folder and read from there. With `spark.cleaner.referenceTracking.cleanCheckpoints` Spark deletes the files once nothing refers to them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that Python tasks can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="lorebase-code-")) / f"{root.name}_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Only A-Z lowered. Pure ASCII text, which is most of it, takes the quick built-in way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a batch, end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1].copy()
    size = int(offsets[-1] - offsets[0])
    raw = np.frombuffer(data, np.uint8, count=size, offset=int(offsets[0])) if size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about `most` bytes together, so that memory follows one text and not the batch."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
