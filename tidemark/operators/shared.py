"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint folder that was set, or a folder in the warehouse; executors see all three."""
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    known = (known or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch").rstrip("/")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(known)
    return known


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


_OPEN: list[list[tuple[SparkSession, str]]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the `scratch` block ends that it was made in, else when the driver ends."""
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append((spark, path))
    else:
        atexit.register(_delete, spark, path)
    return path


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables written within the block when it ends. Results that read them have to be written or collected before."""
    _OPEN.append([])
    try:
        yield
    finally:
        for spark, path in _OPEN.pop():
            _delete(spark, path)


def write_shared(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: short lineage, real sizes for the optimizer."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def discard(df: DataFrame | None) -> None:
    """Delete what ``write_shared`` wrote for ``df``, once its successor is written. Nothing that is still read may depend on it."""
    if (path := getattr(df, "_scratch", None)) is not None:
        _delete(df.sparkSession, path)
