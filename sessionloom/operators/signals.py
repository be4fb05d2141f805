"""Signals of chunks: checklists, tagged blocks, intent and result lines, highlights, and the kind that they make of a chunk.

A chunk is the rows of one ``chunk`` value, in the order of ``source_seq``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.text import byte_cut, normalize_key, severity, trimmed

# The phrases that the families are recognised by.
HIGHLIGHTS = ("decision:", "plan:", "architecture", "breaking", "todo:", "fixme:")
HIGHLIGHTS_AS_WRITTEN = ("WAŻNE", "KEY")
INTENTS = (
    "mam pomysl", "mam pomysł", "mam taki pomysl", "mam taki pomysł", "pomysl", "pomysł", "proponuje", "proponuję", "zrobmy", "zróbmy", "ustalmy", "chce", "chcę", "chcialbym", "chciałbym",
    "potrzebuje", "potrzebuję", "prosze", "proszę", "odpal", "uruchom", "usun", "usuń", "następny krok", "nastepny krok", "kolejny krok", "i want", "i'd like", "let's", "next step",
)
RESULTS = ("smoke test", "passed", "all checks passed", "0 failed", "completed", "done", "zrobione", "dowiezione", "gotowe", "dziala", "działa")
PLANS = ("implementation plan", "plan:", "## plan", "step 1:", "step 2:", "step 3:", "action items", "milestones", "roadmap", "todo list", "acceptance criteria", "## steps", "## phases")
REPORTS = ("## findings", "## summary", "## report", "audit report", "coverage report", "test results", "## metrics", "## recommendations", "## conclusion", "status report", "incident report", "pr review", "code review")
SEGMENT_PLANS = ("goal:", "acceptance:", "test gate:", "- [ ]", "plan:", "migration plan")
SEGMENT_REPORTS = ("recovery report", "audit report", "coverage report", "status report", "summary")
METADATA = ("source:", "kind:", "source_file:", "severity:", "project:", "author:", "heading:", "input:", "output:", '"output":', "current topic:", "topic summary:", "successfully created and wrote to new file:", "base directory for this skill:")
#: Family, most blocks; a block ends at a blank line, the next tag or four lines.
BLOCKS = {"ultrathink": 4, "insight": 6, "plan_mode": 8, "decision": 4, "outcome": 4}
BLOCK_LINES = 4
INTENT_LINES = RESULT_LINES = 6
SIGNAL_BYTES = 240


def _any(x: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(x, F.lit(p)) for p in phrases))


def _begins(x: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, (F.startswith(x, F.lit(p)) for p in phrases))


def _hits(x: Column, phrases) -> Column:
    return reduce(lambda a, b: a + b, (F.contains(x, F.lit(p)).cast("int") for p in phrases))


def is_tag(family: str, line: Column) -> Column:
    low = F.lower(line)
    if family == "ultrathink":
        return F.contains(low, F.lit("ultrathink"))
    if family == "insight":
        return F.startswith(low, F.lit("insight")) | _any(low, ("★ insight", "insight ─", "insight -"))
    if family == "plan_mode":
        return _any(low, ("plan mode", "accept plan", "user accepted the plan", "approve and bypass permissions", "bypass permissions"))
    if family == "decision":
        return F.contains(low, F.lit("[decision]")) | F.startswith(low, F.lit("decision:"))
    return F.contains(low, F.lit("[skill_outcome]")) | _begins(low, ("outcome:", "validation:"))


def is_intent_line(line: Column) -> Column:
    low = F.lower(line)
    return _begins(low, ("intent:", "[intent]")) | severity(line).isNotNull() | _any(low, INTENTS)


def is_result_line(line: Column) -> Column:
    return _any(F.lower(line), RESULTS)


def is_metadata_line(line: Column) -> Column:
    return _begins(F.lower(line), METADATA)


def chunk_lines(rows: DataFrame) -> DataFrame:
    """(chunk, source_seq, role, line_no, raw, line) of each line of the messages; ``line`` is trimmed."""
    split = rows.select("chunk", "source_seq", "role", F.posexplode(F.split("message", "\n")).alias("line_no", "raw"))
    return split.withColumn("line", trimmed(F.col("raw")))


def checklist(lines: DataFrame) -> DataFrame:
    """(chunk, family, n, text): tasks in the order first seen, open or done; done once is done. Fenced lines are none."""
    fence = F.startswith(F.ltrim("raw"), F.lit("```")).cast("int")
    inside = F.sum(fence).over(Window.partitionBy("source_seq").orderBy("line_no")) % 2
    state, task = (F.regexp_extract("raw", r"^\s*[-*+]\s*\[([ xX])\]\s*(\S.*)$", k) for k in (1, 2))
    tasks = lines.withColumn("inside", inside).where((F.col("inside") == 0) & ~F.startswith(F.ltrim("raw"), F.lit("```")))
    tasks = tasks.select("chunk", "source_seq", "line_no", (F.lower(state) == "x").alias("done"), trimmed(task).alias("text")).where("text <> ''")
    at = F.struct("source_seq", "line_no")
    keyed = tasks.groupBy("chunk", normalize_key(F.col("text")).alias("key")).agg(F.min_by("text", at).alias("text"), F.max("done").alias("done"), F.min(at).alias("at"))
    family = F.when(F.col("done"), "todo_done").otherwise("todo_open")
    n = F.row_number().over(Window.partitionBy("chunk", "family").orderBy("at"))
    return keyed.withColumn("family", family).select("chunk", "family", n.alias("n"), "text")


def _firsts(found: DataFrame, family: str, most: int) -> DataFrame:
    """The first ``most`` distinct texts of a chunk, cut at SIGNAL_BYTES."""
    at = F.struct("source_seq", "line_no")
    keyed = found.groupBy("chunk", normalize_key(F.col("text")).alias("key")).agg(F.min_by("text", at).alias("text"), F.min(at).alias("at"))
    n = F.row_number().over(Window.partitionBy("chunk").orderBy("at"))
    return keyed.withColumn("n", n).where(F.col("n") <= most).select("chunk", F.lit(family).alias("family"), "n", byte_cut(F.col("text"), SIGNAL_BYTES).alias("text"))


def tag_blocks(lines: DataFrame, family: str) -> DataFrame:
    w = Window.partitionBy("source_seq").orderBy("line_no")
    block, going = F.col("line"), F.lit(True)
    for ahead in range(1, BLOCK_LINES):
        following = F.lead("line", ahead).over(w)
        going = going & F.coalesce((following != "") & ~is_tag(family, following), F.lit(False))
        block = F.when(going, F.concat(block, F.lit(" "), following)).otherwise(block)
    found = lines.withColumn("text", block).where((F.col("line") != "") & is_tag(family, F.col("line")))
    return _firsts(found, family, BLOCKS[family])


def signals(rows: DataFrame) -> DataFrame:
    """(chunk, family, n, text) of all families; the order within a family is that of the messages."""
    lines = chunk_lines(rows)
    full = lines.where("line <> ''").withColumn("text", F.col("line"))
    intents = full.where((F.lower("role") == "user") & ~is_metadata_line(F.col("line")) & is_intent_line(F.col("line")))
    parts = [checklist(lines), _firsts(intents, "intent", INTENT_LINES), _firsts(full.where(is_result_line(F.col("line"))), "result", RESULT_LINES)]
    return reduce(DataFrame.unionByName, [*parts, *(tag_blocks(lines, f) for f in BLOCKS)])


def highlights(rows: DataFrame, most: int = 3) -> DataFrame:
    """(chunk, n, text): the first lines of messages with a highlight word, repeats in a row left out."""
    hit = _any(F.lower("message"), HIGHLIGHTS) | _any(F.col("message"), HIGHLIGHTS_AS_WRITTEN)
    first = F.get(F.filter(F.transform(F.split("message", "\n"), trimmed), lambda x: x != ""), 0)
    found = rows.where(hit & F.exists(F.split("message", "\n"), lambda x: trimmed(x) != "")).withColumn("text", first)
    w = Window.partitionBy("chunk").orderBy("source_seq")
    found = found.withColumn("before", F.lag("text").over(w)).where("before is null or before <> text")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("chunk", "n", "text")


def chunk_kind(rows: DataFrame) -> DataFrame:
    """(chunk, kind): plans or reports where the replies hold at least three of their phrases and more than of the other."""
    reply = F.col("role") == "assistant"
    score = lambda phrases: F.sum(F.when(reply, _hits(F.lower("message"), phrases)).otherwise(0))
    per = rows.groupBy("chunk").agg(score(PLANS).alias("plan"), score(REPORTS).alias("report"), F.bool_or(F.col("role").isin("user", "assistant")).alias("talk"))
    kind = F.when((F.col("plan") >= 3) & (F.col("plan") > F.col("report")), "plans")
    return per.select("chunk", kind.when((F.col("report") >= 3) & (F.col("report") > F.col("plan")), "reports").when(F.col("talk"), "conversations").otherwise("other").alias("kind"))


def segment_kind(rows: DataFrame) -> DataFrame:
    """(chunk, kind) of segments: reports need two report phrases, more than plans, and no talk; plans two plan phrases."""
    low = F.lower("message")
    per = rows.groupBy("chunk").agg(F.sum(_hits(low, SEGMENT_PLANS)).alias("plan"), F.sum(_hits(low, SEGMENT_REPORTS)).alias("report"), F.bool_or(F.col("role").isin("user", "assistant")).alias("talk"))
    plan, report, talk = F.col("plan"), F.col("report"), F.col("talk")
    kind = F.when((report >= 2) & (report > plan) & ~talk, "reports").when((plan >= 2) & (plan >= report), "plans").when(talk, "conversations").when(report > 0, "reports").otherwise("other")
    return per.select("chunk", kind.alias("kind"))


def signals_block(found: DataFrame, shown: int = 8) -> DataFrame:
    """(chunk, text): a block of a chunk's checklist: its counts, then open and done tasks, each with what is left out."""
    per = found.where(F.col("family").startswith("todo")).groupBy("chunk", "family").agg(F.count("*").alias("c"), F.sort_array(F.collect_list(F.when(F.col("n") <= shown, F.struct("n", "text")))).alias("t"))
    wide = per.groupBy("chunk").agg(*(F.max(F.when(F.col("family") == f, F.col(c))).alias(f"{f}_{c}") for f in ("todo_open", "todo_done") for c in "ct"))
    n = lambda f: F.coalesce(f"{f}_c", F.lit(0))

    def listed(family: str, mark: str, word: str) -> Column:
        lines = F.transform(F.col(f"{family}_t.text"), lambda x: F.concat(F.lit(f"- [{mark}] "), x))
        more = F.when(n(family) > shown, F.array(F.format_string(f"... (+%d more {word})", n(family) - shown))).otherwise(F.array())
        return F.coalesce(F.concat(lines, more), F.array())

    head = F.when(n("todo_open") > 0, F.format_string("RED LIGHT: checklist detected (open: %d, done: %d)", n("todo_open"), n("todo_done"))).otherwise(F.format_string("Checklist detected (open: 0, done: %d)", n("todo_done")))
    return wide.select("chunk", F.array_join(F.concat(F.array(F.lit("[signals]"), head), listed("todo_open", " ", "open"), listed("todo_done", "x", "done")), "\n").alias("text"))
