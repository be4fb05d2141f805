"""The chunk store, vector indexes and exports as Spark tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sessionloom.operators.dedup import by_content
from sessionloom.operators.filters import project_matches, within_days
from sessionloom.sources.ignore import ignored

LEAF = ["project", "day", "kind", "agent"]
CORRUPT_SHARE, CORRUPT_ROWS = 0.05, 20
VECTOR_SCHEMA = "chunk_id string, embedding array<float>, metadata map<string,string>, _corrupt string"


class CorruptIndex(ValueError):
    """Too many rows of an index cannot be read."""


def new_chunks(chunks: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Chunks with content, once for each content of a leaf, that the store does not hold."""
    fresh = by_content(chunks.where(F.trim("text") != ""))
    if stored is None:
        return fresh
    return fresh.join(stored.select(*LEAF, "sha").distinct(), [*LEAF, "sha"], "left_anti")


def append_chunks(chunks: DataFrame, path: str, known: bool) -> DataFrame:
    """Appends what is new to the store at ``path``, laid out by day and kind; the number of chunks by project and agent."""
    spark = chunks.sparkSession
    fresh = new_chunks(chunks, spark.read.parquet(path) if known else None)
    names = [c for c in fresh.columns if c not in ("day", "kind")]
    fresh.select(*names, "day", "kind").repartition("day", "kind").write.mode("append").partitionBy("day", "kind").parquet(path)
    return spark.read.parquet(path).groupBy("project", "agent").agg(F.count("*").alias("chunks"))


#: The folders of a laid out store, outermost first.
FOLDERS = ["org", "repo", "date", "kind", "agent"]


def lay_out(chunks: DataFrame, root: str) -> None:
    """Writes chunks below ``root`` by organisation, repository, date, kind and agent; projects of no owner lie below ``-``."""
    owned = F.contains("project", F.lit("/"))
    org = F.when(owned, F.substring_index("project", "/", 1)).otherwise("-")
    rows = chunks.withColumns({"org": org, "repo": F.when(owned, F.regexp_replace("project", "^[^/]*/", "")).otherwise(F.col("project")), "date": F.concat(F.substring("day", 1, 4), F.lit("_"), F.substring("day", 6, 2), F.substring("day", 9, 2))})
    rows.drop("project", "day").repartition(*FOLDERS).sortWithinPartitions(*FOLDERS, "session_id", "chunk_id").write.option("compression", "zstd").partitionBy(*FOLDERS).parquet(root)


def scan(spark: SparkSession, root: str, project: str | None = None, days: str | None = None, kind: str | None = None, agent: str | None = None, ignore: list[tuple[bool, str]] | None = None) -> DataFrame:
    """The chunks of a laid out store with project, day and ``path``, their place below ``root``.

    All filters but ``ignore`` are on folders, so that folders they leave out are not read. ``project`` and ``days`` are
    written as in ``filters``; ``ignore`` is what an ignore file's rules were parsed to.
    """
    kept = [f for f in spark.read.parquet(root).schema if f.name not in FOLDERS]
    rows = spark.read.schema(StructType([*kept, *(StructField(c, StringType()) for c in FOLDERS)])).parquet(root)  # folders are text, whatever they look like
    name = F.when(F.col("org") == "-", F.col("repo")).otherwise(F.concat("org", F.lit("/"), "repo"))
    day = F.concat_ws("-", F.substring("date", 1, 4), F.substring("date", 6, 2), F.substring("date", 8, 2))
    if project is not None:
        rows = rows.where(project_matches(name, project))
    if days is not None:
        rows = rows.where(within_days(day, days))
    for column, value in (("kind", kind), ("agent", agent)):
        rows = rows if value is None else rows.where(F.lower(column) == value.lower())
    rows = rows.withColumns({"project": name, "day": day, "path": F.concat_ws("/", *FOLDERS, F.concat("chunk_id", F.lit(".md")))})
    return (rows.where(~ignored(F.col("path"), ignore)) if ignore else rows).drop("org", "repo", "date")


def credited(sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entries of a session credited to its chunks in proportion, rounded half up, the rest to the last chunk by id."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("chunk_id")
    total = Window.partitionBy("session_id")
    rows = chunks.select("session_id", "chunk_id").join(sessions.select("session_id", "entries"), "session_id")
    rows = rows.withColumn("_n", F.count("*").over(total)).withColumn("_at", F.row_number().over(w))
    share = F.floor(F.col("entries") / F.col("_n") + 0.5)
    share = F.least(share, F.greatest(F.lit(0), F.col("entries") - share * (F.col("_at") - 1)))
    last = F.greatest(F.lit(0), F.col("entries") - F.floor(F.col("entries") / F.col("_n") + 0.5) * (F.col("_n") - 1))
    return rows.select("session_id", "chunk_id", F.when(F.col("_at") == F.col("_n"), last).otherwise(share).cast("long").alias("entries"))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """An index as JSON lines (chunk_id, embedding, metadata)."""
    vectors.select("chunk_id", "embedding", "metadata").write.mode("overwrite").json(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The readable rows of an index. Raises if of at least CORRUPT_ROWS rows more than CORRUPT_SHARE cannot be read."""
    rows = spark.read.schema(VECTOR_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    bad = F.col("_corrupt").isNotNull() | F.col("chunk_id").isNull() | F.col("embedding").isNull()
    n, broken = rows.select(bad.alias("bad"), "_corrupt").agg(F.count("*"), F.count_if("bad")).first()
    if n >= CORRUPT_ROWS and broken > CORRUPT_SHARE * n:
        raise CorruptIndex(f"{broken} of {n} rows of {path} cannot be read")
    return rows.where(~bad).drop("_corrupt")


def derive_by_project(vectors: DataFrame, path: str, projects: list[str]) -> None:
    """The rows of the named projects, one folder for each, in one pass."""
    rows = vectors.withColumn("project", F.col("metadata")["project"]).where(F.col("project").isin(projects))
    rows.write.mode("overwrite").partitionBy("project").parquet(path)


def conversations_json(timeline: DataFrame) -> DataFrame:
    """(session_id, conversation): the messages of each session in order as one JSON document."""
    message = F.struct("ts", "source_seq", "role", "message")
    rows = timeline.groupBy("agent", "session_id").agg(F.sort_array(F.collect_list(message)).alias("m"))
    return rows.select("session_id", F.to_json(F.struct("agent", "session_id", F.transform("m", lambda x: F.struct(x["ts"].alias("ts"), x["role"].alias("role"), x["message"].alias("text"))).alias("messages"))).alias("conversation"))


def report_lines(timeline: DataFrame, since=None) -> DataFrame:
    """Markdown lines of the timeline in order, of rows later than ``since``."""
    rows = timeline if since is None else timeline.where(F.col("ts") > F.lit(since))
    line = F.concat(F.lit("- **"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("** "), F.col("role"), F.lit(": "), F.regexp_replace("message", r"\s+", " "))
    return rows.orderBy("ts", "source_seq").select(line.alias("value"))
