"""The logical tables of the engine, as views over the driver's tables.

The texts of the driver's tables hold none of the markers that intents and claims are recognised by, so the timeline view
puts a marker before each message by a fixed formula. Each view has its twin in DuckDB SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200
AGENTS = ("alpha", "bravo", "charlie", "delta", "echo")
MARKERS = ("decision: ", "- [ ] ", "- [x] ", "P0 fix: ", "let's ", "result: done ", "question: ", "why: ", "commit abc1234 ", "", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """One row per message: ts, agent, session_id, role, message, frame_kind, project, cwd, day, source_seq.

    Before each text stands one of the ``markers``.
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    moved = (turn >= 4) & (conv % 6 == 0)
    project = F.concat(F.lit("org"), conv % 3, F.lit("/repo"), F.when(moved, (conv + 1) % 4).otherwise(conv % 4))
    return table(spark, sf_dir, "conversations").select(
        F.timestamp_seconds(F.lit(EPOCH) + conv * 600 + turn * 45).alias("ts"),
        pick(AGENTS, conv % 5).alias("agent"),
        F.concat(F.lit("s"), conv).alias("session_id"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.concat(pick(markers, (conv * 7 + turn) % len(markers)), F.coalesce("text", F.lit(""))).alias("message"),
        F.when(F.col("role") == "user", "user_msg").when(F.col("role") == "assistant", "agent_reply").otherwise("system_note").alias("frame_kind"),
        project.alias("project"),
        F.concat(F.lit("/git/"), project).alias("cwd"),
        F.date_format(F.timestamp_seconds(F.lit(EPOCH) + conv * 600), "yyyy-MM-dd").alias("day"),
        (conv * 1000 + turn).alias("source_seq"),
        turn.alias("turn"),
    )


def _timeline_sql(markers: tuple[str, ...]) -> str:
    listed = ", ".join("'" + m.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for m in markers)
    project = "'org' || (conv_id % 3) || '/repo' || (CASE WHEN turn >= 4 AND conv_id % 6 = 0 THEN (conv_id + 1) % 4 ELSE conv_id % 4 END)"
    return f"""tl AS (SELECT make_timestamp(CAST(({EPOCH} + conv_id * 600 + turn * 45) * 1000000 AS BIGINT)) AS ts,
  (['alpha', 'bravo', 'charlie', 'delta', 'echo'])[conv_id % 5 + 1] AS agent, 's' || conv_id AS session_id, coalesce(role, '') AS role,
  ([{listed}])[(conv_id * 7 + turn) % {len(markers)} + 1] || coalesce(text, '') AS message,
  CASE role WHEN 'user' THEN 'user_msg' WHEN 'assistant' THEN 'agent_reply' ELSE 'system_note' END AS frame_kind,
  {project} AS project, '/git/' || {project} AS cwd,
  strftime(make_timestamp(CAST(({EPOCH} + conv_id * 600) * 1000000 AS BIGINT)), '%Y-%m-%d') AS day,
  conv_id * 1000 + turn AS source_seq, turn FROM conversations)"""


TIMELINE = _timeline_sql(MARKERS)


#: What the worklog puts before the texts, by turn: lines that signals, claims and evidence are found in.
WORK = (
    "decision: keep the parser small", "- [ ] write src/app.rs tests", "- [x] write src/app.rs tests", "P0 fix: repair the login", "let's ship the importer", "test result: ok. 12 passed", "test result: FAILED. 2 failed",
    "Insight: caches are cold\nkeep them warm\n", "commit abc1234 src/app.rs", "Fixed src/app.rs, tests pass at abc1234\n", "All checks passed, completed docs/guide.md\n", "outcome: importer shipped\nwith docs", "ultrathink about the index\n  and its size",
    "plan mode entered\n\n* [ ]  review the plan: step 1: look, step 2: tell", "```\n- [ ] no task\n```\n+ [X] real task\nsource: let's go", "merged abc1234 into main, status report",
    "No blockers left in src/app.rs", "Blocked by abc1234", "Incomplete, but ready to merge abc1234", "Ship it: docs/guide.md", "Migrated src/app.rs", "Installed the importer", "Wdrożone: src/app.rs", "Docs updated in docs/guide.md",
    "działa na abc1234", "Greenfield work, all green", "testy przechodzą", "naprawiłem src/app.rs", "abandoned and incomplete", "Zrobione.", "commit abc1234 docs/guide.md",
)


def worklog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline with the lines of WORK before the texts, and ``chunk``, the session."""
    return timeline(spark, sf_dir, tuple(w + "\n" for w in WORK)).withColumn("chunk", F.col("session_id"))


WORKLOG = _timeline_sql(tuple(w + "\n" for w in WORK))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per stored chunk: chunk_id, project, agent, kind, frame_kind, day, session_id, text."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("c"), doc).alias("chunk_id"),
        F.concat(F.lit("org"), doc % 3, F.lit("/"), F.coalesce("source", F.lit("none"))).alias("project"),
        F.element_at(F.array(*map(F.lit, AGENTS)), (doc % 5 + 1).cast("int")).alias("agent"),
        F.coalesce("lang", F.lit("other")).alias("kind"),
        F.when(doc % 4 == 0, "user_msg").when(doc % 4 == 1, "agent_reply").when(doc % 4 == 2, "tool_call").alias("frame_kind"),
        F.date_format(F.timestamp_seconds(F.lit(EPOCH) + (doc % 40) * 86400), "yyyy-MM-dd").alias("day"),
        F.concat(F.lit("s"), F.floor(doc / 7).cast("long")).alias("session_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


CHUNKS = f"""ch AS (SELECT 'c' || doc_id AS chunk_id, 'org' || (doc_id % 3) || '/' || coalesce(source, 'none') AS project,
  (['alpha', 'bravo', 'charlie', 'delta', 'echo'])[doc_id % 5 + 1] AS agent, coalesce(lang, 'other') AS kind,
  CASE doc_id % 4 WHEN 0 THEN 'user_msg' WHEN 1 THEN 'agent_reply' WHEN 2 THEN 'tool_call' END AS frame_kind,
  strftime(make_timestamp(CAST(({EPOCH} + (doc_id % 40) * 86400) * 1000000 AS BIGINT)), '%Y-%m-%d') AS day,
  's' || (doc_id // 7) AS session_id, coalesce(text, '') AS text FROM documents)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One usage event per row of events: session, agent, semantics (delta, cumulative, snapshot), ts, tokens."""
    semantics = F.element_at(F.array(*map(F.lit, ("delta", "cumulative", "snapshot"))), (F.col("user_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("s"), "user_id").alias("session_id"), semantics.alias("semantics"), "ts", "event_type", F.floor(F.abs("value") * 10).cast("long").alias("tokens"))


USAGE = "us AS (SELECT event_id, 's' || user_id AS session_id, (['delta', 'cumulative', 'snapshot'])[user_id % 3 + 1] AS semantics, ts, event_type, CAST(floor(abs(value) * 10) AS BIGINT) AS tokens FROM events)"
