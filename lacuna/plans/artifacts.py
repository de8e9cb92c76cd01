"""Logs, progress and stored payloads of jobs as tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a job leaves behind, by name.
KINDS = ("log", "warning", "error", "progress", "meta")
ROW = "job string, kind string, at long, key string, value string"


def latest(messages: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """The last value of every key."""
    return messages.groupBy(*keys).agg(F.max_by(value, at).alias(value))


def distinct_payloads(rows: DataFrame, payload: str, key: str) -> DataFrame:
    """Digest, number of copies and first key of each distinct payload; payloads themselves aren't shuffled."""
    return rows.select(F.sha2(F.col(payload), 256).alias("digest"), F.col(key).alias("k")).groupBy("digest").agg(F.count("*").alias("copies"), F.min("k").alias("first_id"))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_.-]", "_")


def key_values(text: Column, pairs: str = "\n", between: str = "=") -> Column:
    """A text of key=value lines as a map."""
    return F.str_to_map(text, F.lit(pairs), F.lit(between))


def append(rows: DataFrame, folder: str) -> None:
    """Add artifacts (job, kind, at, key, value) to the store, partitioned by kind so that a lookup reads one."""
    rows.select("job", "kind", "at", "key", "value").write.mode("append").partitionBy("kind").parquet(f"{folder}/artifacts")


def lookup(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The artifact called ``<kind>_<job>``, in order of time: at, key, value. Progress has its latest value per key."""
    kind, _, job = name.partition("_")
    if kind not in KINDS or not job:
        raise ValueError(f"no artifact is called {name!r}")
    own = spark.read.schema(ROW).parquet(f"{folder}/artifacts").where((F.col("kind") == kind) & (F.col("job") == job))
    if kind in ("progress", "meta"):
        return own.groupBy("key").agg(F.max("at").alias("at"), F.max_by("value", "at").alias("value")).select("at", "key", "value")
    return own.select("at", "key", "value").orderBy("at")


def put(df: DataFrame, folder: str, name: str) -> str:
    """Store a table under a safe name, written aside and then renamed, so that readers never see half of it."""
    import re

    spark = df.sparkSession
    safe = re.sub("[^A-Za-z0-9_.-]", "_", name)
    part, target = f"{folder}/tables/.{safe}.part", f"{folder}/tables/{safe}"
    df.write.mode("overwrite").parquet(part)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path(target), True)
    fs.rename(path(part), path(target))
    return safe


def exists(spark: SparkSession, folder: str, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/tables/{name}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def get(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/tables/{name}")


def remove(spark: SparkSession, folder: str, name: str) -> None:
    """Delete a stored table, if there is one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/tables/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def put_text(spark: SparkSession, folder: str, text: str, most: int = 1 << 20) -> str:
    """Store a text, such as the JSON of a grid of jobs, under its digest, which is returned; equal texts are one file."""
    raw = text.encode()
    if len(raw) > most:
        raise ValueError(f"a text above {most} bytes")
    name = hashlib.sha256(raw).hexdigest()
    path = spark._jvm.org.apache.hadoop.fs.Path
    target, part = path(f"{folder}/texts/{name}"), path(f"{folder}/texts/.{name}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        out = fs.create(part, True)
        out.write(bytearray(raw))
        out.close()
        if not fs.rename(part, target):  # another writer was first
            fs.delete(part, False)
    return name


def get_text(spark: SparkSession, folder: str, name: str) -> str:
    """A text stored by :func:`put_text`."""
    found = spark.read.format("binaryFile").load(f"{folder}/texts/{name}").select("content").first()
    return bytes(found.content).decode()


def alias(spark: SparkSession, folder: str, job: str, images: Sequence[str], grids: Sequence[str]) -> list[str]:
    """Give stored tables a job's own names, ``ti_<job>_<i>`` and ``di_<job>_<i>``, as views: nothing is copied.

    Raises KeyError where a table isn't stored; then no name is given.
    """
    wanted = [(f"{kind}_{job}_{i}", n) for kind, names in (("ti", images), ("di", grids)) for i, n in enumerate(names)]
    if lacking := [n for _, n in wanted if not exists(spark, folder, n)]:
        raise KeyError(f"no table {lacking[0]!r} is stored")
    made = []
    for name, stored in wanted:
        made.append("".join(c if c.isalnum() and c.isascii() else "_" for c in name))
        get(spark, folder, stored).createOrReplaceTempView(made[-1])
    return made


def missing(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Digests (digest) that must be sent because the store lacks them."""
    return wanted.select("digest").distinct().join(stored.select("digest"), "digest", "left_anti")
