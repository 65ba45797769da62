"""Shared folder, written tables and batch bounds used by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: list[str] = []  # the temporary folder of a local master, made once and deleted when Python ends
_MADE: list[str] = []  # paths given out and not dropped yet


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local master without one gets a temporary folder."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="corvane-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def new_path(spark: SparkSession, what: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _MADE[-1]


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables through Spark's own file systems."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in _MADE:
            _MADE.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that operators have written within it and that their results are read from.

    So results must be written or collected inside.
    """
    before = set(_MADE)
    try:
        yield
    finally:
        dropped(spark, *(p for p in _MADE[:] if p not in before))


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes too, so that a run of long texts doesn't fill a worker's memory; smaller bounds set before stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        value = str(spark.conf.get(name)).lower().removesuffix("b")
        if not (value.isdigit() and 0 < int(value) <= most):
            spark.conf.set(name, str(most))
