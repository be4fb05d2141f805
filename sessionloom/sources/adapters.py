"""Session logs of five shapes as one table of turns.

Every adapter takes raw units, (source_path, ordinal, value): lines of JSONL sources, or whole documents. It gives turns:
source_path, session_id, ordinal, part, role, kind, ts, text, tool_name, cwd, branch. Units that are no JSON, or of
a type that is not known, are counted by coverage() and are never silently lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNIT_BYTES = 8 << 20
TURN = ["source_path", "session_id", "ordinal", "part", "role", "kind", "ts", "text", "tool_name", "cwd", "branch"]


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files with their ordinal in the file; longer than UNIT_BYTES is marked and emptied."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_path"), "value", F.monotonically_increasing_id().alias("_id"))
    oversized = F.octet_length("value") > UNIT_BYTES
    w = Window.partitionBy("source_path").orderBy("_id")
    return rows.select("source_path", (F.row_number().over(w) - 1).cast("long").alias("ordinal"), F.when(oversized, F.lit("")).otherwise(F.rtrim(F.col("value"), F.lit("\r"))).alias("value"), oversized.alias("oversized"))


def raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as one unit each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.lit(0).cast("long").alias("ordinal"), "value", F.lit(False).alias("oversized"))


def _text(json: Column, path: str) -> Column:
    return F.get_json_object(json, path)


def _items(json: Column) -> Column:
    """The elements of a JSON array as JSON strings; one element for any other value; none for null."""
    array = F.from_json(json, "array<string>")
    return F.when(json.isNull(), F.array().cast("array<string>")).when(F.startswith(F.ltrim(json), F.lit("[")), array).otherwise(F.array(json))


def _turns(df: DataFrame, **columns: Column) -> DataFrame:
    missing = {c: F.lit(None).cast("long" if c in ("ordinal", "part") else "string") for c in TURN if c not in columns}
    all_columns = columns | missing
    return df.select(*(all_columns[c].alias(c) for c in TURN))


def _last_known(df: DataFrame, column: str) -> Column:
    w = Window.partitionBy("source_path").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return F.last(column, ignorenulls=True).over(w)


def block_jsonl(raw: DataFrame) -> DataFrame:
    """Rows with message.content as text or as blocks (text, thinking, tool_use, tool_result); each block is a turn."""
    v = F.col("value")
    rows = raw.where(_text(v, "$.type").isin("user", "assistant", "system") & _text(v, "$.sessionId").isNotNull())
    content = F.coalesce(_text(v, "$.message.content"), _text(v, "$.content"))
    blocked = F.col("c").rlike(r"^\s*\[\s*\{")
    parts = rows.select("*", content.alias("c")).select("*", F.posexplode(F.when(blocked, _items(F.col("c"))).otherwise(F.array("c"))).alias("part", "b"))
    block, kind = F.col("b"), F.when(blocked, _text(F.col("b"), "$.type")).otherwise("text")
    text = F.when(kind == "thinking", _text(block, "$.thinking")).when(kind == "tool_use", _text(block, "$.input")).when(kind == "tool_result", _text(block, "$.content")).when(blocked, _text(block, "$.text")).otherwise(block)
    named = F.when(kind == "text", "message").when(kind == "thinking", "thought").when(kind == "tool_use", "tool_call").otherwise("tool_result")
    role = F.when(kind == "tool_result", "tool").otherwise(_text(v, "$.type"))
    return _turns(parts, source_path=F.col("source_path"), session_id=_text(v, "$.sessionId"), ordinal=F.col("ordinal"), part=F.col("part").cast("long"), role=role, kind=named, ts=_text(v, "$.timestamp"), text=text, tool_name=F.when(kind == "tool_use", _text(block, "$.name")), cwd=_text(v, "$.cwd"), branch=_text(v, "$.gitBranch"))


def rollout_jsonl(raw: DataFrame) -> DataFrame:
    """Rows of type session_meta, turn_context, event_msg and response_item with a payload; the last two make turns."""
    v = F.col("value")
    known = raw.select("*", F.when(_text(v, "$.type") == "session_meta", _text(v, "$.payload.id")).alias("_session"), _text(v, "$.payload.cwd").alias("_cwd"))
    known = known.withColumn("session", _last_known(known, "_session")).withColumn("cwd", _last_known(known, "_cwd"))
    rows = known.where(_text(v, "$.type").isin("event_msg", "response_item"))
    sub = F.coalesce(_text(v, "$.payload.type"), F.lit(""))
    text = F.coalesce(_text(v, "$.payload.message"), _text(v, "$.payload.text"), _text(v, "$.payload.content[0].text"), _text(v, "$.payload.arguments"), _text(v, "$.payload.output"))
    role = F.when(sub == "user_message", "user").when(sub.isin("agent_message", "agent_reasoning", "reasoning"), "assistant").when(sub.endswith("_output"), "tool").otherwise(F.coalesce(_text(v, "$.payload.role"), F.lit("assistant")))
    kind = F.when(sub.isin("agent_reasoning", "reasoning"), "thought").when(sub.endswith("_output"), "tool_result").when(sub.endswith("_call"), "tool_call").otherwise("message")
    return _turns(rows, source_path=F.col("source_path"), session_id=F.col("session"), ordinal=F.col("ordinal"), part=F.lit(0).cast("long"), role=role, kind=kind, ts=_text(v, "$.timestamp"), text=text, tool_name=F.when(kind == "tool_call", _text(v, "$.payload.name")), cwd=F.col("cwd"), branch=_text(v, "$.payload.branch"))


def parts_document(raw: DataFrame) -> DataFrame:
    """Documents with messages[], each with content as text or as parts of text, thoughts and function calls."""
    v = F.col("value")
    messages = raw.select("*", F.posexplode(_items(_text(v, "$.messages"))).alias("m_at", "m"))
    parts = F.coalesce(_text(F.col("m"), "$.content.parts"), _text(F.col("m"), "$.parts"))
    rows = messages.select("*", F.posexplode(F.when(parts.isNotNull(), _items(parts)).otherwise(F.array(F.lit(None).cast("string")))).alias("part", "p"))
    part, m = F.col("p"), F.col("m")
    call, thought = _text(part, "$.functionCall.name"), _text(part, "$.thought") == "true"
    text = F.coalesce(_text(part, "$.text"), _text(part, "$.functionCall.args"), F.when(part.isNull(), _text(m, "$.content")))
    role = F.coalesce(_text(m, "$.role"), _text(m, "$.type"))
    role = F.when(role.isin("model", "gemini"), "assistant").otherwise(role)
    kind = F.when(call.isNotNull(), "tool_call").when(thought, "thought").otherwise("message")
    return _turns(rows, source_path=F.col("source_path"), session_id=_text(v, "$.sessionId"), ordinal=F.col("m_at").cast("long"), part=F.col("part").cast("long"), role=role, kind=kind, ts=_text(m, "$.timestamp"), text=text, tool_name=call, cwd=_text(v, "$.projectRoot"))


def history_jsonl(raw: DataFrame, summaries: DataFrame) -> DataFrame:
    """Rows user, assistant and tool_result of a chat history, with (source_path, value) summaries that name the session."""
    v = F.col("value")
    facts = summaries.select(F.col("source_path").alias("_path"), _text(v, "$.info.id").alias("session"), _text(v, "$.info.cwd").alias("cwd"), _text(v, "$.created_at").alias("created"), _text(v, "$.head_branch").alias("branch"))
    rows = raw.where(_text(v, "$.type").isin("user", "assistant", "tool_result")).join(facts, F.substring_index(F.col("source_path"), "/", -2) == F.concat(F.element_at(F.split("_path", "/"), -2), F.lit("/"), F.element_at(F.split("source_path", "/"), -1)), "left")
    calls = F.coalesce(_items(_text(v, "$.tool_calls")), F.array().cast("array<string>"))
    each = rows.select("*", F.posexplode(F.concat(F.array(F.lit("").cast("string")), calls)).alias("part", "call"))
    is_call = F.col("call") != ""
    text = F.when(is_call, _text(F.col("call"), "$.arguments")).otherwise(F.coalesce(_text(v, "$.content[0].text"), _text(v, "$.content")))
    kind = F.when(is_call, "tool_call").when(_text(v, "$.type") == "tool_result", "tool_result").otherwise("message")
    role = F.when(_text(v, "$.type") == "tool_result", "tool").otherwise(_text(v, "$.type"))
    return _turns(each, source_path=F.col("source_path"), session_id=F.col("session"), ordinal=F.col("ordinal"), part=F.col("part").cast("long"), role=role, kind=kind, ts=F.col("created"), text=text, tool_name=F.when(is_call, _text(F.col("call"), "$.name")), cwd=F.col("cwd"), branch=F.col("branch"))


def block_events(raw: DataFrame) -> DataFrame:
    """Events by kind; of the updates of a block (step and flavour) the last one counts, behind the prompts, in key order."""
    v = F.col("value")
    event = _text(v, "$.kind")
    flavour = F.when(event == "AgentTextBlockUpdatedEvent", "message").when(event == "AgentReasoningBlockUpdatedEvent", "thought").when(event == "AgentToolCallBlockUpdatedEvent", "tool_call").when(event == "AgentToolCallOutputBlockUpdatedEvent", "tool_result")
    known = raw.withColumn("flavour", flavour).withColumn("event", event).withColumn("step", _text(v, "$.stepId")).withColumn("_cwd", _text(v, "$.currentDirectory"))
    known = known.withColumn("cwd", _last_known(known, "_cwd"))
    session = F.element_at(F.split("source_path", "/"), -2)
    prompts = known.where((F.col("event") == "UserPromptEvent") & ~F.coalesce(_text(v, "$.isMetaPrompt") == "true", F.lit(False)))
    users = _turns(prompts, source_path=F.col("source_path"), session_id=session, ordinal=F.col("ordinal"), part=F.lit(0).cast("long"), role=F.lit("user"), kind=F.lit("message"), text=_text(v, "$.prompt"), cwd=F.col("cwd"))
    fields = F.struct("ordinal", "value", "cwd")
    last = known.where("flavour is not null").groupBy("source_path", "step", "flavour").agg(F.max_by(fields, "ordinal").alias("l")).select("source_path", "step", "flavour", "l.*")
    order = Window.partitionBy("source_path").orderBy("step", "flavour")
    last = last.withColumn("_at", F.row_number().over(order) + F.lit(1 << 32))
    role = F.when(F.col("flavour") == "tool_result", "tool").otherwise("assistant")
    text = F.coalesce(_text(v, "$.text"), _text(v, "$.output"), _text(v, "$.arguments"))
    blocks = _turns(last, source_path=F.col("source_path"), session_id=F.element_at(F.split("source_path", "/"), -2), ordinal=F.col("_at").cast("long"), part=F.lit(0).cast("long"), role=role, kind=F.col("flavour"), text=text, tool_name=_text(v, "$.toolName"), cwd=F.col("cwd"))
    return users.unionByName(blocks)


#: Adapter by shape; history_jsonl needs the summaries besides.
ADAPTERS = {"block_jsonl": block_jsonl, "rollout_jsonl": rollout_jsonl, "parts_document": parts_document, "block_events": block_events}


def timeline(turns: DataFrame, agent: str) -> DataFrame:
    """Turns as timeline rows: calls and results collapse to tool_call; a time that cannot be read becomes the epoch, marked so."""
    frame = F.when(F.col("kind").isin("tool_call", "tool_result"), "tool_call").when(F.col("kind") == "thought", "internal_thought").when(F.col("role") == "user", "user_msg").when(F.col("role") == "assistant", "agent_reply").otherwise("system_note")
    ts = F.try_to_timestamp("ts")
    return turns.select(
        F.coalesce(ts, F.timestamp_seconds(F.lit(0))).alias("ts"),
        F.when(ts.isNull(), "unknown").otherwise("turn").alias("timestamp_source"),
        F.lit(agent).alias("agent"), "session_id", "role", F.coalesce("text", F.lit("")).alias("message"), frame.alias("frame_kind"), "cwd", "branch",
        (F.shiftleft("ordinal", 20) + F.col("part")).alias("source_seq"),
    )


def coverage(raw: DataFrame, turns: DataFrame) -> DataFrame:
    """Per source: units, units that became turns, other JSON units, and units that are no JSON."""
    used = turns.select("source_path", "ordinal").distinct().withColumn("_used", F.lit(True))
    parsed = F.try_parse_json("value").isNotNull()
    rows = raw.withColumn("_json", parsed).join(used, ["source_path", "ordinal"], "left")
    return rows.groupBy("source_path").agg(F.count("*").alias("units"), F.count_if(F.col("_used")).alias("consumed"), F.count_if(F.col("_used").isNull() & F.col("_json")).alias("skipped"), F.count_if(~F.col("_json")).alias("broken"))
