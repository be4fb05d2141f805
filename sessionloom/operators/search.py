"""What happens to the hits of a search: filters, duplicates of snippets, order; and what a query itself says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.text import normalize_query, trimmed

# Fixed values.
GENERIC_TERMS = ("path", "file", "files", "repo", "project", "store", "chunk", "chunks", "context")
STOP_WORDS = ("czy", "dla", "jak", "jaki", "jakie", "jest", "mamy", "nie", "oraz", "pod", "sie", "ten", "tez", "tym", "the", "and", "for", "with", "why", "what", "when", "where", "czemu", "dlaczego", "historia", "problemow")
FILLERS = ("arozet", "injust", "yym", "ehem", "ten tego", "yyy", "eee", "hmmm")
RELATIONS = (("rejects", ("reject", "odrzu", "zakaz", "never", "nigdy")), ("constrains", ("constraint", "constrain", "wymaga", "must", "musi")), ("contradicts", ("contradict", "sprzecz", "łamie")), ("explains", ("because", "ponieważ", "wyjaśnia", "explains")))


def fetch_limit(limit: int, filtered: bool) -> int:
    """How many hits to get before filters that may drop some."""
    return max(limit * 10, 50) if filtered else limit


def post_filters(hits: DataFrame, score_min: int | None = None, agent: str | None = None, first: str | None = None, last: str | None = None, since: str | None = None) -> DataFrame:
    """By score, agent and day; ``since`` counts only without explicit days."""
    if score_min is not None:
        hits = hits.where(F.col("score") >= score_min)
    if agent is not None:
        hits = hits.where(F.col("agent") == agent)
    if first or last:
        return hits.where(F.coalesce(F.col("day") >= F.lit(first), F.lit(True)) & F.coalesce(F.col("day") <= F.lit(last), F.lit(True)))
    return hits.where(F.col("day") >= since) if since else hits


def first_of_snippets(hits: DataFrame, least: int = 24) -> DataFrame:
    """Of hits of a project and frame with the same snippet of at least ``least`` bytes only the best, newest."""
    key = normalize_query(F.col("snippet"))
    n = F.row_number().over(Window.partitionBy("project", F.coalesce("frame_kind", F.lit("-")), "_key").orderBy(F.desc("score"), F.desc("day"), "chunk_id"))
    long = hits.withColumn("_key", key).where(F.octet_length("_key") >= least)
    short = hits.where(F.octet_length(key) < least)
    return long.withColumn("_n", n).where("_n = 1").drop("_n", "_key").unionByName(short)


def finalized(hits: DataFrame, limit: int, sort: str | None = None, kind: str | None = None) -> DataFrame:
    """The first ``limit`` by score, or newest, oldest, or score and then newest; any other word means newest."""
    if kind is not None:
        hits = hits.where(F.col("kind") == kind)
    at = F.coalesce("ts", "day") if "ts" in hits.columns else F.col("day")
    order = {None: [F.desc("score")], "oldest": [at.asc()], "score": [F.desc("score"), at.desc()]}.get(sort, [at.desc()])
    return hits.orderBy(*order, "chunk_id").limit(limit)


def anchors(query: Column) -> Column:
    """The distinct words of a normalised query of at least three characters: struct(token, strong).

    Strong are five characters with a digit, or with separators between two parts of at least three.
    """
    words = F.transform(F.split(query, r"\s+"), lambda t: F.regexp_replace(t, r"^[^0-9A-Za-z_/:.\-]+|[^0-9A-Za-z_/:.\-]+$", ""))
    words = F.array_distinct(F.filter(words, lambda t: F.octet_length(t) >= 3))
    parts = lambda t: F.size(F.array_distinct(F.filter(F.split(t, r"[^0-9A-Za-z]"), lambda p: F.octet_length(p) >= 3)))
    strong = lambda t: (F.octet_length(t) >= 5) & ((t.rlike(r"[-_/:.]") & (parts(t) >= 2)) | t.rlike("[0-9]"))
    return F.transform(words, lambda t: F.struct(t.alias("token"), strong(t).alias("strong")))


def evidence_terms(query: Column) -> Column:
    """The distinct words of a query of at least three letters that are no stop words."""
    words = F.transform(F.split(normalize_query(query), r"[^0-9A-Za-z-]+"), lambda t: F.regexp_replace(t, r"^-+|-+$", ""))
    return F.array_distinct(F.filter(words, lambda t: (F.octet_length(t) >= 3) & ~t.isin(*STOP_WORDS)))


def inferred_project(slugs: DataFrame, terms: list[str]) -> DataFrame:
    """One row: the project that the query's terms name best, if it is the only one, else the first usable term.

    A term equal to an organisation, a repository or a slug scores 4, contained in one 2; without punctuation 3 and 1.
    """
    usable = [t for t in terms if len(t.encode()) >= 4 and t not in GENERIC_TERMS]
    if not usable:
        return slugs.sparkSession.createDataFrame([(None,)], "project string")
    names = [F.substring_index("slug", "/", 1), F.substring_index("slug", "/", -1), F.col("slug")]
    bare = lambda x: F.regexp_replace(x, "[^0-9A-Za-z]", "")
    scores = []
    for term in usable:
        t = F.lit(term)
        for name in map(normalize_query, names):
            scores.append(F.when(name == t, 4).when(F.contains(name, t) & (F.octet_length(t) >= 5), 2).otherwise(0))
            scores.append(F.when(bare(name) == bare(t), 3).when(F.contains(bare(name), bare(t)) & (F.octet_length(bare(t)) >= 5), 1).otherwise(0))
    scored = slugs.select("slug", F.greatest(*scores).alias("score")).where("score > 0")
    ranked = scored.groupBy("score").agg(F.count("*").alias("n"), F.min("slug").alias("slug"))
    best = ranked.agg(F.max_by(F.struct("n", "slug"), "score").alias("b"))
    return best.select(F.when(F.col("b.n") == 1, F.col("b.slug")).otherwise(F.when(F.col("b.n").isNotNull(), F.lit(usable[0]))).alias("project"))


def garbled(summary: Column) -> Column:
    """Whether a summary reads like a bad transcript: fillers, or over 15 words without punctuation."""
    filler = F.lower(summary).rlike("|".join(FILLERS))
    return filler | ((F.size(F.filter(F.split(summary, r"\s+"), lambda w: w != "")) > 15) & ~summary.rlike(r"[,.;?!]"))


def relation(thesis: Column) -> Column:
    """What a thesis does: rejects, constrains, contradicts, explains, else implements."""
    found, low = F.lit("implements"), F.lower(thesis)
    for name, words in reversed(RELATIONS):
        found = F.when(low.rlike("|".join(words)), name).otherwise(found)
    return found


def modality(role: Column, line: Column) -> Column:
    """pasted reference, typed directive or other, of a user's line by how it begins."""
    head = F.ltrim(line)
    pasted = F.startswith(head, F.lit(">")) | F.startswith(head, F.lit("[Pasted text #"))
    typed = head.rlike(r"(?i)^(?:zadanie:|task:|intent:|\[intent\])")
    return F.when(F.lower(role) != "user", "other").when(pasted, "pasted_reference").when(typed, "typed_directive").otherwise("other")


def empty_body(body: Column) -> Column:
    """Whether no line holds more than a time, a role and a colon."""
    said = lambda x: F.when(x.rlike(r"^.*?\] [^:]*:"), ~x.rlike(r"^.*?\] [^:]*:\s*$")).otherwise(x != "")
    return ~F.exists(F.transform(F.split(body, "\n"), trimmed), said)


def mentions(body: Column, name: str) -> Column:
    """Whether a name stands in a text as a word of its own; dashes and underscores belong to words."""
    return F.array_contains(F.split(F.lower(body), r"[^\p{L}\p{N}_-]+"), name.lower()) if name else F.lit(False)


def readiness(chunks: Column, index_there: Column, temp_there: Column, newer_sessions: Column, pending: Column) -> Column:
    """missing, pending, stale_chunks, stale_index or ready."""
    return F.when(~index_there & ~temp_there, "missing").when(~index_there, "pending").when(newer_sessions > 0, "stale_chunks").when(pending > 0, "stale_index").otherwise("ready")


def selected_sessions(sessions: DataFrame, agent: str | None = None, since: str | None = None, limit: int = 0) -> DataFrame:
    """Newest first; sessions without any time survive ``since``; 0 is no limit."""
    at = F.coalesce("ended", "started")
    if agent:
        sessions = sessions.where(F.col("agent") == agent)
    if since:
        sessions = sessions.where(at.isNull() | (at >= F.lit(since).cast("timestamp")))
    out = sessions.orderBy(at.desc_nulls_last(), "session_id")
    return out.limit(limit) if limit else out
