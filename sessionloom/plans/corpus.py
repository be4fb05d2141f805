"""Queries over cards, references, project filters and evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.operators import cards, overlay, validation
from sessionloom.operators.filters import within_days
from sessionloom.plans.queries import query
from sessionloom.plans.views import CHUNKS, TIMELINE, chunks, table, timeline
from sessionloom.sources.shared import new_path

_CARDS = f"""{TIMELINE}, tn AS (SELECT *, row_number() OVER (PARTITION BY agent, session_id ORDER BY ts, source_seq) - 1 AS turn_idx, sha256(message) AS text_hash FROM tl),
cd AS (SELECT substr(sha256(session_id || '|' || turn_idx || '|' || text_hash), 1, 24) AS id, * FROM tn)"""


@query(f"WITH {_CARDS} SELECT id, session_id, turn_idx, project, text_hash, CAST(length(message) AS INTEGER) AS text_chars FROM cd")
def p04_cards(spark, sf_dir):
    return cards.cards(timeline(spark, sf_dir)).select("id", "session_id", F.col("turn_idx").cast("long").alias("turn_idx"), "project", "text_hash", "text_chars")


@query(f"WITH {_CARDS}, h AS (SELECT sha256(id || '|' || text_hash) AS h FROM cd), p6 AS (SELECT substr(h, 1, 6) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1), p4 AS (SELECT substr(p, 1, 4) AS p, sha256(string_agg(h, '' ORDER BY p6.p, h)) AS h FROM p6 GROUP BY 1), p AS (SELECT substr(p, 1, 2) AS p, sha256(string_agg(h, '' ORDER BY p4.p, h)) AS h FROM p4 GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY p)) AS revision FROM p")
def p05_projection_revision(spark, sf_dir):
    return overlay.revision(cards.cards(timeline(spark, sf_dir)), "id", "text_hash")


def stored_cards(spark, sf_dir):
    """Cards with sidecars of which a part is missing, unreadable, old or of another text."""
    made = cards.cards(timeline(spark, sf_dir))
    at = F.col("turn_idx") % 6
    side = cards.sidecars(made).join(made.select("id", "turn_idx"), "id").where(at != 1)
    meta = F.when(at == 2, "{broken").when(at == 3, F.replace("meta", F.lit("card.v1"), F.lit("card.v0"))).when(at == 4, F.replace("meta", F.lit('"text_hash":"'), F.lit('"text_hash":"x'))).otherwise(F.col("meta"))
    return made, side.select("id", meta.alias("meta"))


@query(f"WITH {_CARDS} SELECT id, turn_idx % 6 <> 1 AS has_sidecar FROM cd")
def j01_sidecars(spark, sf_dir):
    return cards.with_sidecars(*stored_cards(spark, sf_dir)).select("id", F.col("meta").isNotNull().alias("has_sidecar"))


@query(f"WITH {_CARDS} SELECT id, CASE turn_idx % 6 WHEN 1 THEN 'no_sidecar' WHEN 2 THEN 'broken_sidecar' WHEN 3 THEN 'other_schema' ELSE 'other_text' END AS violation FROM cd WHERE turn_idx % 6 BETWEEN 1 AND 4 UNION ALL SELECT id, 'empty_text' FROM cd WHERE trim(message, ' ') = ''")
def v04_card_violations(spark, sf_dir):
    return cards.violations(cards.with_sidecars(*stored_cards(spark, sf_dir)))


_PATHS = f"{CHUNKS}, pt AS (SELECT project || '/' || day || '/' || chunk_id || '.md' AS path, chunk_id FROM ch)"


@query(f"WITH {_CARDS} SELECT 1 AS version, id, text_hash, project FROM cd WHERE session_id NOT LIKE '%3' UNION ALL SELECT 2, id, text_hash, CASE WHEN session_id LIKE '%5' THEN 'moved' ELSE project END FROM cd")
def k04_s21_published(spark, sf_dir):
    """Two versions: the second replaces some sessions and adds others; both are read back by number."""
    root, made = new_path(spark, "projection"), cards.cards(timeline(spark, sf_dir))
    cards.publish(made.where("session_id not like '%3'"), root)
    before = cards.read_published(spark, root).table(spark, "cards")
    moved = made.where("session_id like '%5' or session_id like '%3'").withColumn("project", F.when(F.col("session_id").like("%5"), "moved").otherwise(F.col("project")))
    cards.publish(validation.replaced(before, moved, "session_id"), root)
    read = lambda n: cards.read_published(spark, root, n).table(spark, "cards").select(F.lit(n).alias("version"), "id", "text_hash", "project")
    return read(1).unionByName(read(2))


@query(f"WITH {_PATHS}, h AS (SELECT path, sha256(path) AS h FROM pt) SELECT chunk_id || '.md' AS ref, path FROM pt UNION ALL SELECT path, path FROM pt UNION ALL SELECT substr(h, 1, 12), path FROM h UNION ALL SELECT '0000', CASE WHEN count(*) = 1 THEN min(path) END FROM h WHERE h LIKE '0000%' UNION ALL SELECT 'nothing', NULL")
def j20_chunk_refs(spark, sf_dir):
    paths = chunks(spark, sf_dir).select(F.concat_ws("/", "project", "day", F.concat("chunk_id", F.lit(".md"))).alias("path"), "chunk_id")
    refs = paths.select(F.explode(F.array(F.concat("chunk_id", F.lit(".md")), "path", F.substring(F.sha2("path", 256), 1, 12))).alias("ref"))
    return cards.resolved_refs(paths, refs.unionByName(spark.createDataFrame([("0000",), ("nothing",)], "ref string")))


@query(f"WITH {CHUNKS} SELECT DISTINCT project AS slug FROM ch WHERE project LIKE 'org1/%' OR project LIKE '%/src7'")
def f05_filter_slugs(spark, sf_dir):
    return cards.slugs_of(chunks(spark, sf_dir).select(F.col("project").alias("slug")).distinct(), ["ORG1/", "src7"])


@query(f"WITH {TIMELINE} SELECT source_seq, contains(cwd || '/', '/org1/repo1/') AS hit FROM tl")
def f06_cwd_filter(spark, sf_dir):
    return timeline(spark, sf_dir).select("source_seq", cards.cwd_matches(F.col("cwd"), "Org1/repo1").alias("hit"))


@query(f"WITH {TIMELINE}, b AS (SELECT source_seq, agent, session_id, ts, CASE WHEN turn % 3 = 1 THEN NULL ELSE cwd END AS cwd FROM tl), k AS (SELECT *, last_value(cwd IGNORE NULLS) OVER (PARTITION BY agent, session_id ORDER BY ts, source_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM b) SELECT source_seq, CAST(sum(CASE WHEN cwd IS NOT NULL AND p IS NOT NULL AND p <> cwd THEN 1 ELSE 0 END) OVER (PARTITION BY agent, session_id ORDER BY ts, source_seq) AS BIGINT) AS segment FROM k")
def w09_cwd_segments(spark, sf_dir):
    return cards.cwd_segments(timeline(spark, sf_dir).withColumn("cwd", F.when(F.col("turn") % 3 != 1, F.col("cwd")))).select("source_seq", "segment")


@query(
    f"WITH {CHUNKS}, a AS (SELECT * FROM (VALUES ('fix january 2024 auth', 'fix auth', '2024-01-01', '2024-01-31'), ('index 2024 lutego', 'index', '2024-02-01', '2024-02-29'), ('2024-01 logs', 'logs', '2024-01-01', '2024-01-31'), ('a 2024-02-04 b', 'a b', '2024-02-04', '2024-02-04'), ('plain words', 'plain words', '0', '9')) t(asked, cleaned, first, last)) "
    "SELECT asked, cleaned, chunk_id FROM a JOIN ch ON day BETWEEN first AND last"
)
def f10_m05_dates_in_queries(spark, sf_dir):
    out = None
    for asked in ("fix january 2024 auth", "index 2024 lutego", "2024-01 logs", "a 2024-02-04 b", "plain words"):
        cleaned, days = cards.date_of_query(asked)
        rows = chunks(spark, sf_dir)
        found = (rows.where(within_days(F.col("day"), days)) if days else rows).select(F.lit(asked).alias("asked"), F.lit(cleaned).alias("cleaned"), "chunk_id")
        out = found if out is None else out.unionByName(found)
    return out


@query(f"WITH {CHUNKS}, h AS (SELECT chunk_id, agent AS case_id, project AS identity, text FROM ch WHERE day < '2024-01-20'), a AS (SELECT * FROM (VALUES ('alpha', 'src', ['the', 'qzx'], 'all'), ('bravo', 'src', ['the', 'qzx'], 'any'), ('nobody', 'src', ['the'], 'any')) t(case_id, map_id, terms, match)) SELECT a.case_id, coalesce(bool_or(contains(identity, map_id) AND CASE match WHEN 'all' THEN len(list_filter(terms, lambda t: contains(lower(text), t))) = len(terms) ELSE len(list_filter(terms, lambda t: contains(lower(text), t))) > 0 END), false) AS passed FROM a LEFT JOIN h USING (case_id) GROUP BY a.case_id")
def j22_a22_anchors(spark, sf_dir):
    hits = chunks(spark, sf_dir).where("day < '2024-01-20'").select(F.col("agent").alias("case_id"), F.col("project").alias("identity"), "text")
    anchors = spark.createDataFrame([("alpha", "src", ["the", "qzx"], "all"), ("bravo", "src", ["the", "qzx"], "any"), ("nobody", "src", ["the"], "any")], "case_id string, map_id string, terms array<string>, match string")
    return cards.anchored(hits, anchors)


@query("WITH e AS (SELECT event_id, ts, 'p' || (user_id % 4) AS phase, event_id % 1000 AS done, CASE WHEN event_id % 3 = 0 THEN event_id END AS total, CASE WHEN event_id % 50 = 0 THEN 'warning' WHEN event_id % 997 = 0 THEN 'end' ELSE 'step' END AS kind FROM events) SELECT phase, max(done) AS done, arg_max(total, (ts, event_id)) FILTER (total IS NOT NULL) AS total, count(*) FILTER (kind = 'warning') AS warnings, bool_or(kind = 'end') AS finished FROM e GROUP BY phase")
def a24_progress(spark, sf_dir):
    event = F.col("event_id")
    kind = F.when(event % 50 == 0, "warning").when(event % 997 == 0, "end").otherwise("step")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.concat(F.lit("p"), F.col("user_id") % 4).alias("phase"), (event % 1000).alias("done"), F.when(event % 3 == 0, event).alias("total"), kind.alias("kind"))
    return cards.progress(rows)


@query(f"WITH {CHUNKS} SELECT chunk_id, project, day FROM ch WHERE lower(agent) = 'echo' AND kind = 'en' AND day >= '2024-02-05' ORDER BY day DESC, chunk_id LIMIT 30")
def f26_browse(spark, sf_dir):
    rows = chunks(spark, sf_dir).where((F.lower("agent") == "echo") & (F.col("kind") == "en"))
    since = F.date_format(F.lit("2024-02-10").cast("timestamp") - F.make_dt_interval(days=F.lit(5)), "yyyy-MM-dd")
    return rows.where(F.col("day") >= since).orderBy(F.desc("day"), "chunk_id").limit(30).select("chunk_id", "project", "day")
