"""Shared scratch tables: lineage is cut by Parquet tables in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch while a scratch table is written: both the JVM, beside its heap, and a Python worker hold one.
BATCH_BYTES = "1m"


def base_dir(spark: SparkSession) -> str:
    """The session's shared folder. Only a local master may do without one: it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pointloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of ``BATCH_BYTES`` for what runs inside, unless the session asks for a size of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    if before != "67108864b":
        yield
        return
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{base_dir(spark)}/pointloom-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    fs.deleteOnExit(p)
    return path


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` and return what reads it back, with its path."""
    spark = df.sparkSession
    path = table_path(spark, name)
    with small_batches(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later read needs."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes up to which a table is broadcast; beyond it the same join shuffles.
BROADCAST_BYTES = 32 << 20


def _width(c: Column, kind: T.DataType) -> Column:
    """About the bytes of a value."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(c, F.lit(24).cast("long"), lambda n, x: n + _width(x, kind.elementType).cast("long")), F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((_width(c[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def bytes_of(df: DataFrame) -> int:
    """About the bytes of all rows of a stored table."""
    each = sum((_width(F.col(quoted(f.name)), f.dataType).cast("long") for f in df.schema.fields), F.lit(16).cast("long"))
    return int(df.agg(F.coalesce(F.sum(each), F.lit(0)).alias("b")).first().b)


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A stored table, to be broadcast if it has ``limit`` bytes (``BROADCAST_BYTES`` if not said) at most."""
    return F.broadcast(df) if bytes_of(df) <= (BROADCAST_BYTES if limit is None else limit) else df


def quoted(name: str) -> str:
    """``name`` as a column reference, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` as one struct ``__row`` beside ``columns``, so that no column of it clashes with theirs or others of a join."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("__row"), *[c.alias(k) for k, c in columns.items()])


def unpacked(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names`` of ``__row`` again."""
    return df.select(*[F.col("__row")[c].alias(c) for c in names])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
