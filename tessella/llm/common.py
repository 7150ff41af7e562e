"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand rows to Python in batches that stay small with long texts, unless the session has a setting of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def released(run):
    """A batch function that gives its memory back when its task ends: workers live on to serve other stages."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def free_name(base: str, taken: list[str]) -> str:
    """`base`, with underscores added until no column of `taken` is called so (upper and lower case count as one)."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


#: Lists that take down the folders made while they are open.
_OPEN: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, the shared folders that were made inside. What was made of them must be written by then."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for uri in made:
            delete(spark, uri)


def delete(spark: SparkSession, uri: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(uri)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name below `spark.checkpoint.dir`, which driver and executors share.

    Where the setting is missing one local folder is made for the session, on a local master only: other machines can't see it.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessella-")
        sc.setCheckpointDir(root)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    out = f"{root.rstrip('/')}/tessella-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.append(out)
    return out


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def filesystem(uri: str):
    """(filesystem, path) for a folder on any store that Arrow can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri.removeprefix("file:")))


def local_path(uri: str) -> str:
    """The mounted path of a shared folder. Memory mapping needs one, so other schemes are refused."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"memory-mapped files need a mounted folder, not {uri}")
    return uri


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [x if x is not None else "" for x in column.to_pylist()]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
