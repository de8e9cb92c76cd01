"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_released = 0.0


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on one machine (tests) a fresh one where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lacuna-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python a few MB at a time, whatever their length, so that no task buffers many of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def materialise(df: DataFrame, rows: int | None = None, per: int = 100_000) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Where a bound on its ``rows`` is known, at most one file for every ``per`` of them is written (and three):
    small files cost more to open, and on local disks to create, than to read.

    Cuts the lineage: what follows survives the loss of any executor, and Python stages are not run
    twice.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/lacuna-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(3, -(-rows // per)))
    df.write.parquet(path)
    _made.append((spark, path))
    schema = df.schema
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver's JVM collect its garbage, every few seconds at most.

    Spark deletes a shuffle's files on the executors when the driver has collected the plan that wrote them. It
    asks for that every half hour only; by then the files of all steps would lie on the executors' disks at once.
    """
    global _released
    if time.monotonic() - _released > 3:
        spark._jvm.System.gc()
        _released = time.monotonic()


def filter_rows(docs: DataFrame, keep) -> DataFrame:
    """The rows that an Arrow function keeps; it gets all columns in order, whatever their names (dots, too)."""
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def shared_file(spark: SparkSession, content: bytes) -> str:
    """Write ``content`` to the shared folder and have every executor fetch it; returns its name for SparkFiles.

    Executors that come later, as after a loss, fetch it as well.
    """
    name = f"lacuna-{uuid.uuid4().hex}.bin"
    path = f"{shared_dir(spark)}/{name}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(content))
    out.close()
    _made.append((spark, path))
    spark.sparkContext.addFile(path)
    return name


def drop(df: DataFrame) -> None:
    """Delete a table of :func:`materialise` that nothing will read again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lacuna-" in path:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        if spark._sc._jsc is not None:
            _delete(spark, path)


def has_rows(df: DataFrame) -> bool:
    return bool(df.head(1))
