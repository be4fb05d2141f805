"""Sets of tables that appear all at once: staged in a folder of their own, published by a manifest that is written last.

``root`` holds a folder for each attempt and a numbered manifest for each version. A manifest names its folder, the rows
and the schema of each table, and facts of the writer's choice. Readers go by the newest manifest, so a writer that fails
midway leaves files that nothing names, and of two writers of the same number the second fails.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SCHEMA = 1


class Drift(ValueError):
    """A version that does not fit: ``kind`` says in what."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


@dataclass(frozen=True)
class Version:
    """One published set of tables."""

    root: str
    number: int
    folder: str
    tables: dict = field(hash=False)
    facts: dict = field(hash=False)

    def path(self, name: str) -> str:
        return f"{self.root}/{self.folder}/{name}"

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.tables:
            raise Drift("table", f"version {self.number} has no {name}")
        return spark.read.schema(StructType.fromJson(self.tables[name]["schema"])).parquet(self.path(name))


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _manifest(root: str, number: int) -> str:
    return f"{root}/manifest-{number:08d}.json"


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The published versions, ascending."""
    fs, path = _files(spark, root)
    found = fs.globStatus(path(f"{root}/manifest-*.json"))
    return sorted(int(x.getPath().getName()[9:-5]) for x in found or [])


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame | Callable], facts: dict | None = None, partition_by: dict[str, list[str]] | None = None, options: dict[str, dict[str, str]] | None = None) -> Version:
    """Writes the tables into a new folder, counts what was written, and then the manifest; the next number is taken.

    A table may be a function of those written before it, which gets them by name. ``options`` are the writer's, by table.
    """
    root = root.rstrip("/")
    number, folder = max(numbers(spark, root), default=0) + 1, f"v-{uuid.uuid4().hex}"
    told, done = {}, {}
    for name, df in tables.items():
        where = f"{root}/{folder}/{name}"
        df = df if isinstance(df, DataFrame) else df(done)
        df.write.option("compression", "zstd").options(**(options or {}).get(name, {})).partitionBy(*(partition_by or {}).get(name, [])).parquet(where)
        done[name] = spark.read.schema(df.schema).parquet(where)
        told[name] = {"rows": done[name].count(), "schema": json.loads(df.schema.json())}
    version = Version(root, number, folder, told, facts or {})
    fs, path = _files(spark, root)
    staged = f"{root}/{folder}/manifest.json"
    out = fs.create(path(staged), True)
    out.write(bytearray(json.dumps({"schema": SCHEMA, "number": number, "folder": folder, "tables": told, "facts": version.facts}, sort_keys=True).encode()))
    out.close()
    if fs.exists(path(_manifest(root, number))) or not fs.rename(path(staged), path(_manifest(root, number))):
        raise Drift("conflict", f"version {number} was published by another writer")
    return version


def read(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """The newest version, or one by number; none where nothing was published."""
    root = root.rstrip("/")
    there = numbers(spark, root)
    if not there or number is not None and number not in there:
        return None
    number = there[-1] if number is None else number
    text = "\n".join(r[0] for r in spark.read.text(_manifest(root, number), wholetext=True).collect())  # one small file
    try:
        told = json.loads(text)
        found = Version(root, told["number"], told["folder"], told["tables"], told["facts"])
    except (ValueError, KeyError) as broken:
        raise Drift("manifest", f"version {number} cannot be read") from broken
    if told["schema"] != SCHEMA:
        raise Drift("schema", f"version {number} has schema {told['schema']}")
    return found


def problems(spark: SparkSession, version: Version) -> list[str]:
    """What is wrong with the tables of a version: missing ones, other rows than were written."""
    found = []
    fs, path = _files(spark, version.root)
    for name, told in sorted(version.tables.items()):
        if not fs.exists(path(version.path(name))):
            found.append(f"missing:{name}")
        elif version.table(spark, name).count() != told["rows"]:
            found.append(f"rows:{name}")
    return found


def stamp(df: DataFrame) -> str:
    """A hash of the files that a table is read from, by path, size and time; of its rows where it is not read from files."""
    spark, files = df.sparkSession, sorted(df.inputFiles())
    if not files:
        from pyspark.sql import functions as F

        hashes = [F.sum(F.xxhash64(F.lit(k), *df.columns).cast("decimal(38,0)")) for k in (1, 2)]
        return "-".join(str(x) for x in df.agg(F.count("*"), *hashes).first())
    told = hashlib.sha256()
    for folder in sorted({f.rpartition("/")[0] for f in files}):
        fs, path = _files(spark, folder)
        here = {x.getPath().getName(): (x.getLen(), x.getModificationTime()) for x in fs.listStatus(path(folder))}
        for name in sorted(f.rpartition("/")[2] for f in files if f.rpartition("/")[0] == folder):
            told.update(repr((folder, name, here.get(name))).encode())
    return told.hexdigest()
