"""Intermediate tables and files in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI under spark.checkpoint.dir, or else the context's checkpoint folder.

    Where neither is set, a local session (as in tests) gets a temporary folder and a cluster an error, as its machines share none.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        at = sc._jsc.sc().getCheckpointDir()
        base = at.get() if at.isDefined() else None
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = sc.applicationId
        base = _own.setdefault(app, "") or _own.__setitem__(app, tempfile.mkdtemp(prefix="spark-")) or _own[app]
        base = f"file://{base}"
    path = sc._jvm.org.apache.hadoop.fs.Path(base)
    full = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if full.startswith("file:/") and not full.startswith("file://"):
        full = "file://" + full[len("file:") :]
    return f"{full.rstrip('/')}/covary-{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> SparkSession:
    """The session, which sends Python workers Arrow batches of at most so many bytes: texts may be long, and two or three copies of a batch are held."""
    lower(spark, "spark.sql.execution.arrow.maxBytesPerBatch", most)
    return spark


def gives_back(run):
    """run, an iterator over Arrow batches in a Python worker, which returns freed memory to the machine at its end: Spark keeps workers for later stages."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    """Returns this process's freed memory to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in some C libraries
    if trim:
        trim(0)


def columns(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a bounded table of numbers without nulls, gathered as Arrow batches: no row becomes an object of the driver's."""
    table = df.toArrow()
    out = {name: table[name].to_numpy() for name in table.column_names}
    del table
    give_back()
    return out


def lower(spark: SparkSession, key: str, most: int) -> None:
    """Sets a number of bytes in the session's settings to `most` where it is more."""
    if int(spark.conf.get(key).rstrip("b")) > most:
        spark.conf.set(key, most)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._covary_path = path
    return out


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that no later result reads."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def place_file(uri: str, name: str, build) -> None:
    """Writes a file of a deterministic name, in a task: build(sink) under a name of its own, then moved into place.

    A task that runs again replaces the file by an equal one; a move alone fails on file systems that do not replace.
    """
    fs, root = pafs.FileSystem.from_uri(uri)
    part = f"{root}/.{name}.{os.getpid()}.{os.urandom(4).hex()}"
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(part) as sink:
        build(sink)
    try:
        fs.move(part, f"{root}/{name}")
    except OSError:
        fs.delete_file(f"{root}/{name}")
        fs.move(part, f"{root}/{name}")


def read_file(uri: str, name: str) -> bytes:
    fs, root = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(f"{root}/{name}") as source:
        return source.read()


def fresh(taken, name: str) -> str:
    """name, with underscores in front until no column has it."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name
