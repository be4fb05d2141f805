"""Cards, one for each turn of a session, with sidecars; references to stored chunks; evaluation of results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.measures import MONTHS
from sessionloom.functions.text import normalize_query
from sessionloom.operators.filters import project_matches
from sessionloom.sources import versions
from sessionloom.sources.versions import Version

SCHEMA = "card.v1"


def cards(timeline: DataFrame) -> DataFrame:
    """(id, schema, session_id, turn_idx, project, agent, frame_kind, text_hash, text_chars, text), one row per turn.

    The id is a hash of the session, the turn's number and the text's hash, so it is stable when the session grows.
    """
    w = Window.partitionBy("agent", "session_id").orderBy("ts", "source_seq")
    turns = timeline.withColumn("turn_idx", F.row_number().over(w) - 1).withColumn("text_hash", F.sha2("message", 256))
    card_id = F.substring(F.sha2(F.concat_ws("|", "session_id", F.col("turn_idx").cast("string"), "text_hash"), 256), 1, 24)
    return turns.select(card_id.alias("id"), F.lit(SCHEMA).alias("schema"), "session_id", "turn_idx", F.coalesce("project", F.lit("unclassified")).alias("project"), "agent", "frame_kind", "text_hash", F.length("message").alias("text_chars"), F.col("message").alias("text"))


def publish(cards: DataFrame, root: str) -> Version:
    """Publishes the cards with their sidecars and their count by session as the next version below ``root``.

    The revision in the manifest is a hash of the cards in any order. Readers of the version before are not disturbed.
    """
    from sessionloom.operators.overlay import revision

    spark = cards.sparkSession
    tables = {
        "cards": cards,
        "sidecars": lambda done: sidecars(done["cards"]),
        "sessions": lambda done: done["cards"].groupBy("session_id").agg(F.count("*").alias("turns"), F.countDistinct("id").alias("ids")),
    }
    revised = revision(cards, "id", "text_hash").first()
    return versions.publish(spark, root, tables, {"card": SCHEMA, "revision": revised[0] if revised else None})


def read_published(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """The newest whole version, or the one asked for, checked: tables and rows, schema of the cards, ids, revision."""
    from sessionloom.operators.overlay import revision

    found = versions.read(spark, root, number)
    if found is None:
        raise versions.Drift("missing", f"nothing is published below {root}")
    if found.facts.get("card") != SCHEMA:
        raise versions.Drift("card", f"cards of schema {found.facts.get('card')}")
    wrong = versions.problems(spark, found)
    if wrong:
        raise versions.Drift("tables", ", ".join(wrong))
    if found.table(spark, "sessions").where("turns <> ids").head(1):
        raise versions.Drift("ids", "a card's id stands twice")
    revised = revision(found.table(spark, "cards"), "id", "text_hash").first()
    if (revised[0] if revised else None) != found.facts.get("revision"):
        raise versions.Drift("revision", "the cards are not those that were published")
    return found


def sidecars(cards: DataFrame) -> DataFrame:
    """(id, meta): each card's fields but its text, as JSON."""
    return cards.select("id", F.to_json(F.struct(*(c for c in cards.columns if c not in ("id", "text")))).alias("meta"))


def with_sidecars(cards: DataFrame, sidecars: DataFrame) -> DataFrame:
    """The cards with their sidecars, null where there is none."""
    return cards.join(sidecars, "id", "left")


def violations(found: DataFrame) -> DataFrame:
    """(id, violation) of cards with sidecars: none, unreadable, of another schema, of another text; an empty text; a repeated id."""
    meta = lambda field: F.get_json_object("meta", f"$.{field}")
    readable = F.try_parse_json("meta").isNotNull()
    n = F.count("*").over(Window.partitionBy("id"))
    checks = {
        "no_sidecar": F.col("meta").isNull(),
        "broken_sidecar": F.col("meta").isNotNull() & ~readable,
        "other_schema": readable & (F.coalesce(meta("schema"), F.lit("")) != SCHEMA),
        "other_text": readable & (F.coalesce(meta("text_hash"), F.lit("")) != F.sha2("text", 256)),
        "empty_text": F.trim("text") == "",
        "repeated_id": F.col("_n") > 1,
    }
    hits = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in checks.items())))
    return found.withColumn("_n", n).select("id", F.explode(hits).alias("violation"))


def resolved_refs(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, path): each reference's chunk by path, by file name, or by a prefix of at least four hex digits of the path's hash.

    A prefix of several chunks, and a reference of none, gives null. All three are equi-joins: of a path's hash the
    prefixes of the lengths that occur are exploded.
    """
    lengths = [r[0] for r in refs.where(F.col("ref").rlike("^[0-9a-f]{4,64}$")).select(F.length("ref")).distinct().collect()]  # at most 61
    keys = [F.col("path"), F.substring_index("path", "/", -1), *(F.substring(F.sha2("path", 256), 1, n) for n in lengths)]
    known = chunks.select("path", F.explode(F.array_distinct(F.array(*keys))).alias("ref"))
    hits = refs.select("ref").distinct().join(known, "ref").groupBy("ref").agg(F.count("*").alias("n"), F.min("path").alias("path"), F.max(F.when(F.col("path") == F.col("ref"), F.col("path"))).alias("exact"))
    return refs.join(hits, "ref", "left").select("ref", F.when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("n") == 1, F.col("path")).alias("path"))


def slugs_of(slugs: DataFrame, filters: list[str]) -> DataFrame:
    """The slugs that any of the filters means."""
    test = F.lit(False)
    for f in filters:
        test = test | project_matches(F.col("slug"), f)
    return slugs.where(test)


def cwd_matches(cwd: Column, wanted: str) -> Column:
    """Whether a directory's path holds the parts of org/repo next to each other, case ignored."""
    parts = wanted.lower().strip("/").split("/")
    path = F.filter(F.split(F.lower(cwd), "/"), lambda p: p != "")
    at = F.sequence(F.lit(1), F.greatest(F.size(path), F.lit(1)))
    return F.exists(at, lambda i: F.slice(path, i, len(parts)) == F.array(*map(F.lit, parts)))


def cwd_segments(timeline: DataFrame) -> DataFrame:
    """``segment`` from zero: a new one where the directory is another than that of the turn before; none is no change."""
    w = Window.partitionBy("agent", "session_id").orderBy("ts", "source_seq")
    before = F.last("cwd", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = timeline.withColumn("_new", (F.col("cwd").isNotNull() & before.isNotNull() & (F.col("cwd") != before)).cast("long"))
    return rows.withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def date_of_query(query: str) -> tuple[str, str | None]:
    """A query without the date that it names, and that date as a filter: a month with a year, YYYY-MM or YYYY-MM-DD."""
    words, used, found = query.split(), set(), None
    month = lambda w: MONTHS.get(w) or {name[:3]: MONTHS[name] for name in _ENGLISH}.get(w)
    year = lambda w: int(w) if re.fullmatch(r"20[2-9]\d", w) else None
    span = lambda y, m: f"{y:04}-{m:02}-01..{y:04}-{m:02}-{_days(y, m):02}"
    low = [w.lower() for w in words]
    for first, second in ((month, year), (year, month)):
        if found is None:
            for i, (a, b) in enumerate(zip(low, low[1:], strict=False)):
                x, y = first(a), second(b)
                if x and y:
                    found, used = span(*((y, x) if first is month else (x, y))), used | {i, i + 1}
    for i, w in enumerate(low):
        m = re.fullmatch(r"(\d{4})-(\d\d)", w)
        if found is None and m and 1 <= int(m[2]) <= 12:
            found, used = span(int(m[1]), int(m[2])), used | {i}
    for i, w in enumerate(low):
        if found is None and re.fullmatch(r"\d{4}-\d\d-\d\d", w):
            found, used = w, used | {i}
    return " ".join(w for i, w in enumerate(words) if i not in used), found


_ENGLISH = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _days(year: int, month: int) -> int:
    if month == 2:
        return 29 if year % 4 == 0 and (year % 100 != 0 or year % 400 == 0) else 28
    return 30 if month in (4, 6, 9, 11) else 31


def anchored(hits: DataFrame, anchors: DataFrame) -> DataFrame:
    """(case_id, passed): whether a hit of the case names the anchor's map and all, or any, of its terms.

    ``anchors`` has case_id, map_id, terms and match (all or any); ``hits`` case_id, identity and text.
    """
    both = hits.join(anchors, "case_id")
    text = normalize_query(F.col("text"))
    held = F.transform("terms", lambda t: F.contains(text, normalize_query(t)))
    enough = F.when(F.col("match") == "all", F.forall(held, lambda x: x)).otherwise(F.exists(held, lambda x: x))
    per = both.groupBy("case_id").agg(F.bool_or(F.contains("identity", F.col("map_id")) & enough).alias("passed"))
    return anchors.select("case_id").distinct().join(per, "case_id", "left").select("case_id", F.coalesce("passed", F.lit(False)).alias("passed"))


def progress(events: DataFrame) -> DataFrame:
    """One row per phase: done is the greatest count seen, total the last, warnings are counted, finished if any end came."""
    last = F.max_by("total", F.when(F.col("total").isNotNull(), F.struct("ts", "event_id")))
    return events.groupBy("phase").agg(F.max("done").alias("done"), last.alias("total"), F.count_if(F.col("kind") == "warning").alias("warnings"), F.bool_or(F.col("kind") == "end").alias("finished"))
