"""What the operators of this subpackage share: tables, the shared folder, staging."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Rows of an Arrow batch between Spark and Python, if the session does not say otherwise. Rows are whole
#: texts here, and both sides hold a few batches for each task.
BATCH_ROWS = 1000
_ROWS_SETTING, _SPARKS_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once, in case they cannot import it from where it is; bound Arrow batches."""
    if spark.conf.get(_ROWS_SETTING, _SPARKS_ROWS) == _SPARKS_ROWS:
        spark.conf.set(_ROWS_SETTING, str(BATCH_ROWS))
    if getattr(spark.sparkContext, "_cubeloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="package-")  # the driver serves the file from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name))
    spark.sparkContext._cubeloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, read by Spark alone: the path may be in a store that only Spark reaches."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function over Arrow batches that gives its free memory back at the end: workers live on and serve other operators."""

    @wraps(run)
    def inner(*args):
        try:
            yield from run(*args)
        finally:
            give_back()

    return inner


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI without a slash at its end.

    It is the session's ``spark.checkpoint.dir``, or the checkpoint folder that is set. Only where
    neither is and Spark runs in one process (tests, a single machine) a new temporary folder becomes
    the checkpoint folder; on a cluster that would be another folder on each machine, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(root)
    return qualified(spark, root).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """A path as a full URI: one without a scheme is in Spark's default file system, not on a local disk."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended already: the folder's owner clears it
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage like a reliable checkpoint: a lost executor costs no upstream work,
    and columns that a reader does not ask for are not read.
    """
    ship(df.sparkSession)
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
