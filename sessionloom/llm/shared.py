"""Helpers that the operators share: tables in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table (keys and a few numbers) that may be broadcast; more rows are joined by shuffle.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset a session in one process, as in tests, gets a temporary one. On a cluster such a folder would be
    a different one on each machine, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sessionloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/sessionloom/{name}-{uuid.uuid4().hex}"


def storage(uri: str):
    """The file system of a URI, and the path in it: file, hdfs, viewfs, s3 (also as s3a), gs or abfs(s)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith(("s3a:", "s3n:")) else uri)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def narrow_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; counts it, so it should be a written table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lower_ascii(text):
    """Lower-cases A-Z only. ``lower`` does that on pure ASCII texts; others are translated letter by letter."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
