"""What jobs share: the package on Python workers, and tables in the folder that driver and executors both see."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors as a ZIP, once a Spark application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="glossaflow-")
    target = os.path.join(folder, "glossaflow.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for p in sorted(root.rglob("*.py")):
            archive.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """Deals a small input, such as a lone file, out to all cores; a larger one is already split by the scan and stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores << 20 else df


#: Bytes of input for a task, where rows are dealt out.
DEALT = 8 << 20


def dealt(df: DataFrame) -> DataFrame:
    """As spread(), for costly work on each row: a larger input is dealt out as well where it lies in few files.

    A file counts as one, as a scan can't split a row group and a file may be a single one.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= cores << 20 and not 0 < len(df.inputFiles()) < 4 * cores:  # rows that come from no file have no known size
        return df
    return df.repartition(max(cores, min(1 << 12, -(-size // DEALT))))


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a full URI: spark.checkpoint.dir.

    Where that is unset, a local session gets a folder of its own; on a cluster that is
    an error, as executors would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='glossaflow-shared-')}")
    if base not in _local:  # a path without a scheme belongs to the default file system
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
        _local[base] = full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full
    return _local[base]


_made: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _forget() -> None:
    """At exit, removes the tables that this process wrote, as far as the store still answers."""
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return


atexit.register(_forget)


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/glossaflow-{os.getpid()}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and any lost executor only costs a reread."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._glossaflow_path = path
    return found


def discard(df: DataFrame) -> None:
    """Removes a table that stored() wrote, once nothing reads it any more."""
    path = df._glossaflow_path
    _delete(df.sparkSession, path)
    _made.remove((df.sparkSession, path))


def put_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """Writes a bounded text to one file of any store that Spark reaches; a path without a scheme is local."""
    put_bytes(spark, path, text.encode("utf-8"), overwrite)


def put_bytes(spark: SparkSession, path: str, data: bytes, overwrite: bool = False) -> None:
    """Writes bounded data to one file, as put_text()."""
    p = _path(spark, path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(p) and not overwrite:
        raise FileExistsError(path)
    out = store.create(p, True)
    try:
        for at in range(0, len(data), 1 << 22):
            out.write(bytearray(data[at : at + (1 << 22)]))
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str | None:
    """A bounded text file of any store that Spark reaches; null if it is missing."""
    p = _path(spark, path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(p):
        return None
    held = store.open(p)
    try:
        return bytes(held.readAllBytes()).decode("utf-8")
    finally:
        held.close()


def file_exists(spark: SparkSession, path: str) -> bool:
    p = _path(spark, path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _path(spark: SparkSession, path: str):
    full = path if re.match(r"[A-Za-z][\w+.-]+:", path) else Path(path).resolve().as_uri()
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(full)
