"""Tables in the folder that driver and executors share: how iterative plans cut their lineage.

A written table survives the loss of any executor, carries exact sizes for adaptive execution, and
leaves a short plan behind. ``localCheckpoint`` has none of the three and is not used here.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only in local mode, where it is unset."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="lattica-")
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage", keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back. Without ``keep`` it lives as long as ``scratch``."""
    spark, held = df.sparkSession, _SCRATCH.get()
    path = new_path(spark, name)
    if held is not None and not keep:
        held.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was staged in it; what is still to be read must be written by then, with ``keep``."""
    held: list[str] = []
    token = _SCRATCH.set(held)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in held:
            _delete(spark, path)


def drop(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        _delete(df.sparkSession, f)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
