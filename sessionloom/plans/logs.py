"""Session logs made from the conversations in four shapes, and what the adapters read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.plans.queries import query
from sessionloom.plans.views import table
from sessionloom.sources import adapters
from sessionloom.sources.shared import new_path


def _rows(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.concat(F.lit("s"), "conv_id").alias("session"), "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _json(**fields):
    return F.to_json(F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items())))


def _found(turns):
    return turns.select("session_id", "role", "kind", F.sha2("text", 256).alias("sha"), F.coalesce("tool_name", F.lit("-")).alias("tool"), F.coalesce("cwd", F.lit("-")).alias("cwd"))


_SOURCE = "c AS (SELECT 's' || conv_id AS session_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations)"


def block_lines(spark, sf_dir):
    """Assistant rows as blocks of thought, text and a call, others as plain text; a line in seven is broken besides."""
    rows = _rows(spark, sf_dir)
    stamp = F.concat(F.lit("2024-01-01T00:00:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit("Z"))
    blocks = F.concat(F.lit("[ "), _json(type="thinking", thinking=F.concat(F.lit("t"), "turn")), F.lit(", "), _json(type="text", text=F.col("text")), F.lit(', {"type":"tool_use","name":"sh","input":{"n":'), F.col("turn").cast("string"), F.lit("}}]"))
    plain = _json(type=F.col("role"), sessionId=F.col("session"), timestamp=stamp, cwd="/w", message=F.struct(F.col("text").alias("content")))
    rich = F.concat(F.lit('{"type":"assistant","sessionId":"'), "session", F.lit('","timestamp":"'), stamp, F.lit('","cwd":"/w","message":{"content":'), blocks, F.lit("}}"))
    lines = rows.select("session", "turn", F.when(F.col("role") == "assistant", rich).otherwise(plain).alias("value"))
    other = rows.where("turn = 0").select("session", F.lit(-1).cast("long").alias("turn"), F.lit('{"type":"summary","summary":"x"}').alias("value"))
    broken = rows.where("turn = 1 and pmod(cast(substring(session, 2) as int), 7) = 0").select("session", F.lit(99).cast("long").alias("turn"), F.lit('{"type":"user", "se').alias("value"))
    return lines.unionByName(other).unionByName(broken)


def written_lines(spark, sf_dir):
    """The block lines written as text files into a new shared folder and read back."""
    path = new_path(spark, "logs")
    block_lines(spark, sf_dir).repartition("session").sortWithinPartitions("session", "turn").select("value").write.text(path)
    return adapters.raw_lines(spark, path)


@query(
    f"WITH {_SOURCE} SELECT session_id, role, 'message' AS kind, sha256(text) AS sha, '-' AS tool, '/w' AS cwd FROM c UNION ALL SELECT session_id, role, 'thought', sha256('t' || turn), '-', '/w' FROM c WHERE role = 'assistant' UNION ALL SELECT session_id, role, 'tool_call', sha256('{{\"n\":' || turn || '}}'), 'sh', '/w' FROM c WHERE role = 'assistant'"
)
def s01_s04_block_jsonl(spark, sf_dir):
    return _found(adapters.block_jsonl(written_lines(spark, sf_dir)))


@query(f"WITH {_SOURCE} SELECT CAST(count(*) + count(DISTINCT session_id) FILTER (turn = 0) + count(*) FILTER (turn = 1 AND CAST(substr(session_id, 2) AS INTEGER) % 7 = 0) AS BIGINT) AS units, count(*) AS consumed, count(DISTINCT session_id) FILTER (turn = 0) AS skipped, count(*) FILTER (turn = 1 AND CAST(substr(session_id, 2) AS INTEGER) % 7 = 0) AS broken FROM c")
def v01_v03_coverage(spark, sf_dir):
    raw = written_lines(spark, sf_dir)
    per = adapters.coverage(raw, adapters.block_jsonl(raw))
    return per.agg(*(F.sum(c).cast("long").alias(c) for c in ("units", "consumed", "skipped", "broken")))


def _units(rows):
    return rows.select(F.concat(F.lit("/logs/"), "session", F.lit("/log")).alias("source_path"), F.col("at").cast("long").alias("ordinal"), "value", F.lit(False).alias("oversized"))


@query(f"WITH {_SOURCE} SELECT session_id, CASE WHEN role = 'user' AND turn % 4 <> 3 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN turn % 4 = 3 THEN 'thought' ELSE 'message' END AS kind, sha256(text) AS sha, '-' AS tool, CASE WHEN turn >= 4 AND moved THEN '/w4' ELSE '/w0' END AS cwd FROM (SELECT *, bool_or(turn = 4) OVER (PARTITION BY session_id) AS moved FROM c) WHERE role IN ('user', 'assistant')")
def s05_rollout_jsonl(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    meta = rows.select("session").distinct().select("session", F.lit(0).alias("at"), _json(type="session_meta", payload=F.struct(F.col("session").alias("id"), F.lit("/w0").alias("cwd"))).alias("value"))
    moved = rows.where("turn = 4").select("session", F.lit(9).alias("at"), _json(type="turn_context", payload=F.struct(F.lit("/w4").alias("cwd"))).alias("value"))
    kind = F.when(F.col("turn") % 4 == 3, "agent_reasoning").when(F.col("role") == "user", "user_message").otherwise("agent_message")
    asked = F.when(F.col("role") == "user", F.lit("user")).otherwise("assistant")
    payload = F.when(F.col("turn") % 4 == 3, F.struct(kind.alias("type"), asked.alias("role"), F.col("text").alias("text"), F.lit(None).cast("string").alias("message")))
    payload = payload.otherwise(F.struct(kind.alias("type"), asked.alias("role"), F.lit(None).cast("string").alias("text"), F.col("text").alias("message")))
    said = rows.where("role in ('user', 'assistant')").select("session", (F.col("turn") * 2 + 2).alias("at"), _json(type="event_msg", payload=payload).alias("value"))
    return _found(adapters.rollout_jsonl(_units(meta.unionByName(moved).unionByName(said))))


@query(f"WITH {_SOURCE} SELECT session_id, CASE role WHEN 'assistant' THEN 'assistant' ELSE role END AS role, 'message' AS kind, sha256(text) AS sha, '-' AS tool, '/root' AS cwd FROM c UNION ALL SELECT session_id, 'assistant', 'thought', sha256('t' || turn), '-', '/root' FROM c WHERE role = 'assistant'")
def s06_documents(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    thought = _json(text=F.concat(F.lit("t"), "turn"), thought=F.lit(True))
    parts = F.concat(F.lit('{"role":"model","content":{"parts":['), thought, F.lit(","), _json(text=F.col("text")), F.lit("]}}"))
    message = F.when(F.col("role") == "assistant", parts).otherwise(_json(role=F.col("role"), content=F.col("text")))
    per = rows.select("session", "turn", message.alias("m")).groupBy("session").agg(F.sort_array(F.collect_list(F.struct("turn", "m"))).alias("l"))
    value = F.concat(F.lit('{"projectRoot":"/root","sessionId":"'), "session", F.lit('","messages":['), F.array_join("l.m", ","), F.lit("]}"))
    return _found(adapters.parts_document(_units(per.select("session", F.lit(0).alias("at"), value.alias("value")))))


@query(f"WITH {_SOURCE} SELECT session_id, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, 'message' AS kind, sha256(text) AS sha, '-' AS tool, '/j' AS cwd FROM c")
def s08_block_events(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    start = rows.select("session").distinct().select("session", F.lit(0).alias("at"), _json(kind="CurrentDirectoryChangedEvent", currentDirectory="/j").alias("value"))
    prompts = rows.where("role = 'user'").select("session", (F.col("turn") * 2 + 1).alias("at"), _json(kind="UserPromptEvent", prompt=F.col("text")).alias("value"))
    update = lambda at, text: rows.where("role <> 'user'").select("session", at.alias("at"), _json(kind="AgentTextBlockUpdatedEvent", stepId=F.col("turn").cast("string"), text=text).alias("value"))
    drafts, last = update(F.col("turn") * 2 + 1, F.lit("draft")), update(F.col("turn") * 2 + 100, F.col("text"))
    return _found(adapters.block_events(_units(start.unionByName(prompts).unionByName(drafts).unionByName(last))))
