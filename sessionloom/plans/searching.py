"""Queries over searches and their hits, and over small rules on texts, times and numbers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.functions import measures as M
from sessionloom.functions.text import normalize_query
from sessionloom.operators import reports, retrieval, search
from sessionloom.plans.queries import TERMS, query, sha
from sessionloom.plans.views import CHUNKS, TIMELINE, USAGE, WORKLOG, chunks, table, timeline, usage, worklog

# Hits

_HITS = f"""{CHUNKS}, qh AS (SELECT *, substr(text, 1, 60) AS snippet, lower(text) AS low FROM ch),
qf AS (SELECT *, CAST(contains(low, 'the') AS INTEGER) + CAST(contains(low, 'ention') AS INTEGER) + CAST(contains(low, 'thand') AS INTEGER) AS f FROM qh),
hits AS (SELECT chunk_id, project, agent, kind, frame_kind, day, snippet, greatest(0, least(100, 50 + CASE WHEN frame_kind = 'user_msg' THEN 6 WHEN frame_kind = 'agent_reply' THEN 5 WHEN frame_kind IS NULL THEN 1 ELSE -20 END + CASE WHEN contains(low, 'the ention') THEN 12 ELSE 0 END + CASE WHEN f > 0 THEN least(f * 3, 12) ELSE -15 END + CASE WHEN length(text) < 40 THEN -8 ELSE 0 END + CASE WHEN frame_kind = 'agent_reply' AND length(text) >= 400 THEN 8 ELSE 0 END)) AS score FROM qf)"""
_FOLD = "lower(translate(snippet, 'ĄąĆćĘęŁłŃńÓóŚśŹźŻż', 'aacceellnnoosszzzz'))"
_FIRSTS = f"fs AS (SELECT * FROM (SELECT *, CASE WHEN strlen({_FOLD}) < 24 THEN 1 ELSE row_number() OVER (PARTITION BY project, coalesce(frame_kind, '-'), {_FOLD} ORDER BY score DESC, day DESC, chunk_id) END AS k FROM hits) WHERE k = 1)"


def scored_hits(spark, sf_dir):
    rows = retrieval.quality_score(chunks(spark, sf_dir).withColumn("score", F.lit(50)), "the ention", TERMS)
    return rows.select("chunk_id", "project", "agent", "kind", "frame_kind", "day", F.substring("text", 1, 60).alias("snippet"), F.col("quality").cast("int").alias("score"))


@query(f"WITH {_HITS}, {_FIRSTS} SELECT chunk_id, CAST(score AS INTEGER) AS score FROM fs")
def d12_snippets(spark, sf_dir):
    return search.first_of_snippets(scored_hits(spark, sf_dir)).select("chunk_id", "score")


@query(f"WITH {_HITS}, {_FIRSTS} SELECT chunk_id, day, CAST(score AS INTEGER) AS score FROM fs WHERE (frame_kind IS NULL OR frame_kind IN ('user_msg', 'agent_reply')) AND score >= 50 AND agent = 'alpha' AND day >= '2024-01-05' AND day <= '2024-02-05' ORDER BY score DESC, chunk_id LIMIT 20")
def r10_r11_f11_search(spark, sf_dir):
    hits = search.first_of_snippets(retrieval.visible(scored_hits(spark, sf_dir)))
    hits = search.post_filters(hits, score_min=50, agent="alpha", first="2024-01-05", last="2024-02-05", since="2024-02-01")
    return search.finalized(hits, 20).select("chunk_id", "day", "score")


@query(
    f"WITH {_HITS} SELECT * FROM (SELECT 'newest' AS sort, chunk_id, row_number() OVER (ORDER BY day DESC, chunk_id) AS n FROM hits UNION ALL SELECT 'oldest', chunk_id, row_number() OVER (ORDER BY day, chunk_id) FROM hits "
    "UNION ALL SELECT 'score', chunk_id, row_number() OVER (ORDER BY score DESC, day DESC, chunk_id) FROM hits UNION ALL SELECT 'else', chunk_id, row_number() OVER (ORDER BY day DESC, chunk_id) FROM hits) WHERE n <= 5"
)
def o03_r13_orders(spark, sf_dir):
    hits, out = scored_hits(spark, sf_dir), None
    orders = {"newest": [F.desc("day")], "oldest": [F.asc("day")], "score": [F.desc("score"), F.desc("day")], "else": [F.desc("day")]}
    for sort, order in orders.items():
        first = search.finalized(hits, 5, sort)
        one = first.select(F.lit(sort).alias("sort"), "chunk_id", F.row_number().over(Window.orderBy(*order, "chunk_id")).cast("long").alias("n"))  # five rows
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {CHUNKS}, h AS (SELECT chunk_id, agent, length(text) - length(replace(lower(text), 'the', '')) AS score, day FROM ch), t AS (SELECT * FROM h ORDER BY score DESC, chunk_id LIMIT 50) SELECT chunk_id, score FROM t WHERE agent = 'bravo' ORDER BY score DESC, chunk_id LIMIT 3")
def o05_over_fetch(spark, sf_dir):
    score = F.length("text") - F.length(F.replace(F.lower("text"), F.lit("the"), F.lit("")))
    hits = chunks(spark, sf_dir).select("chunk_id", "agent", score.cast("long").alias("score"), "day")
    fetched = hits.orderBy(F.desc("score"), "chunk_id").limit(search.fetch_limit(3, True))
    return search.post_filters(fetched, agent="bravo").orderBy(F.desc("score"), "chunk_id").limit(3).select("chunk_id", "score")


@query(f"WITH {CHUNKS}, s AS (SELECT DISTINCT project FROM ch) SELECT 'named' AS q, CASE WHEN (SELECT count(*) FROM s WHERE split_part(project, '/', 1) = 'org1') = 1 THEN (SELECT min(project) FROM s WHERE split_part(project, '/', 1) = 'org1') ELSE 'org1' END AS project UNION ALL SELECT 'one', 'org1/src7' FROM s WHERE project = 'org1/src7' UNION ALL SELECT 'generic', NULL UNION ALL SELECT 'none', NULL")
def j23_project_of_query(spark, sf_dir):
    slugs = chunks(spark, sf_dir).select(F.col("project").alias("slug")).distinct()
    asked = {"named": ["org1"], "one": ["path", "org1/src7"], "generic": ["files", "abc"], "none": ["nowhere"]}
    out = None
    for name, terms in asked.items():
        one = search.inferred_project(slugs, terms).select(F.lit(name).alias("q"), "project")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {CHUNKS}, q AS (SELECT chunk_id, regexp_split_to_array('fix-' || chunk_id || ' (' || kind || ') [' || project || '], a-b-c ' || agent || ' ab ' || agent || ' ' || day, '\\s+') AS w FROM ch), t AS (SELECT chunk_id, unnest(list_distinct(list_filter(list_transform(w, lambda x: regexp_replace(x, '^[^0-9A-Za-z_/:.-]+|[^0-9A-Za-z_/:.-]+$', '', 'g')), lambda x: strlen(x) >= 3))) AS token FROM q) SELECT chunk_id, token, strlen(token) >= 5 AND (regexp_matches(token, '[0-9]') OR (regexp_matches(token, '[-_/:.]') AND len(list_distinct(list_filter(regexp_split_to_array(token, '[^0-9A-Za-z]'), lambda p: strlen(p) >= 3))) >= 2)) AS strong FROM t")
def u17_anchors(spark, sf_dir):
    asked = F.concat(F.lit("fix-"), "chunk_id", F.lit(" ("), "kind", F.lit(") ["), "project", F.lit("], a-b-c "), "agent", F.lit(" ab "), "agent", F.lit(" "), "day")
    return chunks(spark, sf_dir).select("chunk_id", F.explode(search.anchors(asked)).alias("a")).select("chunk_id", "a.*")


@query(f"WITH {CHUNKS}, w AS (SELECT chunk_id, list_distinct(list_filter(list_transform(regexp_split_to_array(lower(translate(text, 'ĄąĆćĘęŁłŃńÓóŚśŹźŻż', 'aacceellnnoosszzzz')), '[^0-9A-Za-z-]+'), lambda t: regexp_replace(t, '^-+|-+$', '', 'g')), lambda t: strlen(t) >= 3 AND NOT list_contains([{', '.join(repr(w) for w in search.STOP_WORDS)}], t))) AS t FROM ch) SELECT chunk_id, md5(array_to_string(list_sort(t), ' ')) AS terms FROM w")
def u18_evidence_terms(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", F.md5(F.array_join(F.sort_array(search.evidence_terms(F.col("text"))), " ")).alias("terms"))


# Rules on texts


@query(f"WITH {WORKLOG}, l AS (SELECT source_seq, string_split(message, chr(10))[1] AS s FROM tl) SELECT source_seq, regexp_matches(lower(s), 'arozet|injust|yym|ehem|ten tego|yyy|eee|hmmm') OR (len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) > 15 AND NOT regexp_matches(s, '[,.;?!]')) AS garbled FROM l")
def i12_garbled(spark, sf_dir):
    return worklog(spark, sf_dir).select("source_seq", search.garbled(F.split("message", "\n")[0]).alias("garbled"))


@query(f"WITH {WORKLOG}, l AS (SELECT source_seq, lower(message) AS m FROM tl) SELECT source_seq, CASE WHEN regexp_matches(m, 'reject|odrzu|zakaz|never|nigdy') THEN 'rejects' WHEN regexp_matches(m, 'constrain|wymaga|must|musi') THEN 'constrains' WHEN regexp_matches(m, 'contradict|sprzecz|łamie') THEN 'contradicts' WHEN regexp_matches(m, 'because|ponieważ|wyjaśnia|explains') THEN 'explains' ELSE 'implements' END AS relation FROM l")
def u25_relation(spark, sf_dir):
    return worklog(spark, sf_dir).select("source_seq", search.relation(F.col("message")).alias("relation"))


@query(f"WITH {WORKLOG}, l AS (SELECT source_seq, role, turn, CASE source_seq % 4 WHEN 0 THEN '> ' WHEN 1 THEN '  Task: ' WHEN 2 THEN '[intent] ' ELSE '' END || message AS m FROM tl) SELECT source_seq, CASE WHEN lower(role) <> 'user' THEN 'other' WHEN source_seq % 4 = 0 THEN 'pasted_reference' WHEN source_seq % 4 IN (1, 2) THEN 'typed_directive' ELSE 'other' END AS modality FROM l")
def f18_modality(spark, sf_dir):
    head = F.col("source_seq") % 4
    line = F.concat(F.when(head == 0, "> ").when(head == 1, "  Task: ").when(head == 2, "[intent] ").otherwise(""), "message")
    return worklog(spark, sf_dir).select("source_seq", search.modality(F.col("role"), line).alias("modality"))


@query(f"WITH {TIMELINE} SELECT source_seq, CASE source_seq % 3 WHEN 0 THEN true WHEN 1 THEN regexp_replace(message, '\\s+', '', 'g') = '' ELSE true END AS empty FROM tl")
def f21_empty_bodies(spark, sf_dir):
    kind = F.col("source_seq") % 3
    head = F.concat(F.lit("\n[12:00:00] "), "role", F.lit(":  "))
    body = F.when(kind == 0, head).when(kind == 1, F.concat(head, F.regexp_replace("message", r"\s+", " "))).otherwise(F.lit(" \n\t"))
    return timeline(spark, sf_dir).select("source_seq", search.empty_body(body).alias("empty"))


@query(f"WITH {WORKLOG} SELECT source_seq, list_contains(regexp_split_to_array(lower(message), '[^\\pL\\pN_-]+'), 'parser') AS mentioned FROM tl")
def f07_mentions(spark, sf_dir):
    return worklog(spark, sf_dir).select("source_seq", search.mentions(F.col("message"), "Parser").alias("mentioned"))


@query(f"WITH {CHUNKS}, g AS (SELECT project, bool_or(kind = 'de') AS there, coalesce(bool_or(kind = 'fr' AND frame_kind IS NULL), false) AS temp, count(*) FILTER (day > '2024-02-06') AS newer, count(*) FILTER (frame_kind = 'tool_call' AND day < '2024-01-04') AS pending FROM ch GROUP BY project) SELECT project, CASE WHEN NOT there AND NOT temp THEN 'missing' WHEN NOT there THEN 'pending' WHEN newer > 0 THEN 'stale_chunks' WHEN pending > 0 THEN 'stale_index' ELSE 'ready' END AS state FROM g")
def a14_readiness(spark, sf_dir):
    kind, frame, day = F.col("kind"), F.col("frame_kind"), F.col("day")
    facts = {"there": F.bool_or(kind == "de"), "temp": F.bool_or((kind == "fr") & frame.isNull()), "newer": F.count_if(day > "2024-02-06"), "pending": F.count_if((frame == "tool_call") & (day < "2024-01-04"))}
    per = chunks(spark, sf_dir).groupBy("project").agg(*(v.alias(k) for k, v in facts.items()), F.count("*").alias("n"))
    return per.select("project", search.readiness(F.col("n"), *(F.col(c) for c in facts)).alias("state"))


@query(f"WITH {TIMELINE}, s AS (SELECT agent, session_id, max(ts) AS ended FROM tl GROUP BY ALL) SELECT session_id, ended FROM s WHERE agent = 'bravo' AND ended >= TIMESTAMP '2024-01-01 00:30:00' ORDER BY ended DESC, session_id LIMIT 7")
def f25_session_select(spark, sf_dir):
    return search.selected_sessions(reports.sessions(timeline(spark, sf_dir)), "bravo", "2024-01-01 00:30:00", 7).select("session_id", "ended")


# Times and numbers


@query(f"WITH {CHUNKS} SELECT chunk_id, replace(day[1:5], '-', '_') || day[6:7] || day[9:10] AS compact, day AS back FROM ch")
def m01_compact_dates(spark, sf_dir):
    c = M.compact_date(F.col("day"))
    return chunks(spark, sf_dir).select("chunk_id", c.alias("compact"), M.iso_date(c).alias("back"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 2 THEN date_trunc('day', ts) END AS t_at FROM events")
def m02_times(spark, sf_dir):
    way = F.col("event_id") % 5
    at = lambda form: F.date_format("ts", form)
    text = F.when(way == 0, at("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(way == 1, at("yyyy-MM-dd'T'HH:mm:ss'+02:00'")).when(way == 2, at("yyyy-MM-dd")).when(way == 3, at("MMM d")).otherwise("")
    return table(spark, sf_dir, "events").select("event_id", M.utc(text).cast("timestamp_ntz").alias("t_at"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id * 3600 WHEN 1 THEN user_id * 86400 END AS seconds FROM events")
def m04_relative(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ("h ", "d", "w", ""))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", M.relative_seconds(F.concat(F.lit(" "), F.col("user_id").cast("string"), unit)).alias("seconds"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN strftime(date_trunc('month', ts), '%Y-%m-%d') END AS first, CASE WHEN event_id % 3 < 2 THEN strftime(last_day(ts), '%Y-%m-%d') END AS last FROM events")
def m05_months(spark, sf_dir):
    polish = ("stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "września", "października", "listopada", "grudnia")
    own = F.element_at(F.array(*map(F.lit, polish)), F.month("ts"))
    word = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "MMMM")).when(F.col("event_id") % 3 == 1, normalize_query(own)).otherwise(F.reverse(own))
    return table(spark, sf_dir, "events").select("event_id", M.month_range(F.year("ts"), M.month_number(word)).alias("r")).select("event_id", "r.first", "r.last")


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v) SELECT vec_id, round(e[1] / n, 6) AS x, round(e[64] / n, 6) AS y FROM u")
def m07_unit_vectors(spark, sf_dir):
    u = M.unit(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", u.alias("u")).select("vec_id", F.round(F.col("u")[0], 6).alias("x"), F.round(F.col("u")[63], 6).alias("y"))


@query("SELECT vec_id, CAST(round((greatest(-1.0, least(1.0, x)) + 1) * 50) AS INTEGER) AS dense, CAST(least(round(greatest(x / 20, 0.0) / (2.0 / 61) * 100), 100) AS INTEGER) AS fused FROM (SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 3, 4) AS x FROM embeddings)")
def m09_percents(spark, sf_dir):
    x = F.round(F.col("embedding")[0].cast("double") * 3, 4)
    return table(spark, sf_dir, "embeddings").select("vec_id", M.dense_percent(x).alias("dense"), M.fused_percent(x / 20).alias("fused"))


@query("SELECT vec_id, CAST(least(floor(60 * r + q * CASE WHEN r >= 0.5 THEN 4 ELSE 2 END), 100) AS INTEGER) AS score FROM (SELECT vec_id, (vec_id % 5) / 4.0 AS r, vec_id % 11 AS q FROM embeddings)")
def m10_match_quality(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", M.match_quality((F.col("vec_id") % 5) / 4.0, F.col("vec_id") % 11).alias("score"))


@query(f"WITH {CHUNKS}, p AS (SELECT project, count(*) AS n, count(*) FILTER (kind = 'de') AS w, sum(length(text)) AS e FROM ch GROUP BY project) SELECT project, CAST((2 * e * w + n) // (2 * n) AS BIGINT) AS credited FROM p")
def m12_k03_credited(spark, sf_dir):
    per = chunks(spark, sf_dir).groupBy("project").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "de").alias("w"), F.sum(F.length("text")).alias("e"))
    return per.select("project", M.credited(F.col("e"), F.col("w"), F.col("n")).alias("credited"))


@query("SELECT user_id, CASE WHEN d > 0 AND ms > 0 THEN CAST(ceil(ms / d * greatest(n, 1) / 1000) AS BIGINT) END AS eta FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'view') AS d, CAST(count(*) * 37 AS DOUBLE) AS ms FROM events GROUP BY user_id)")
def m13_eta(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("d"), (F.count("*") * 37).cast("double").alias("ms"))
    return per.select("user_id", M.eta_seconds(F.col("d"), F.col("n"), F.col("ms")).alias("eta"))


@query(f"WITH {CHUNKS} SELECT chunk_id, unnest(['kind', 'at', 'agent']) AS key, unnest([kind, chunk_id, agent]) AS value FROM ch")
def m16_merged_maps(spark, sf_dir):
    lexical = F.create_map(F.lit("kind"), F.col("kind"), F.lit("at"), F.col("chunk_id"))
    dense = F.create_map(F.lit("at"), F.col("day"), F.lit("agent"), F.col("agent"))
    return chunks(spark, sf_dir).select("chunk_id", F.explode(M.merged_maps(lexical, dense)))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE greatest(date_trunc('second', ts), TIMESTAMP '2024-01-10 00:00:00') END AS at FROM events")
def m17_latest_times(spark, sf_dir):
    text = F.concat(F.lit("at "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(", not 2024-01-09T99, and 2024-01-10T00:00:00Z"))
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, M.latest_time(text)).cast("timestamp_ntz").alias("at"))


# Orders and duplicates


@query(f"WITH {CHUNKS} SELECT chunk_id, row_number() OVER (ORDER BY day DESC, chunk_id) AS id FROM ch ORDER BY day DESC, chunk_id LIMIT 50")
def o13_report_ids(spark, sf_dir):
    first = chunks(spark, sf_dir).select("chunk_id", "day").orderBy(F.desc("day"), "chunk_id").limit(50)
    return first.select("chunk_id", F.row_number().over(Window.orderBy(F.desc("day"), "chunk_id")).cast("long").alias("id"))  # fifty rows


@query(f"WITH {CHUNKS} SELECT project, min(chunk_id) AS chunk_id, count(*) - 1 AS suppressed FROM ch GROUP BY project")
def d13_d14_best_of_key(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("project").agg(F.min("chunk_id").alias("chunk_id"), (F.count("*") - 1).alias("suppressed"))


@query(f"WITH {USAGE} SELECT session_id, event_type, count(*) AS events, count(DISTINCT CAST(ts AS DATE)) AS days FROM us GROUP BY session_id, event_type")
def a18_counters(spark, sf_dir):
    return usage(spark, sf_dir).groupBy("session_id", "event_type").agg(F.count("*").alias("events"), F.countDistinct(F.to_date("ts")).alias("days"))


@query(f"WITH {CHUNKS} SELECT chunk_id, sha256(lower(translate(text, 'ĄąĆćĘęŁłŃńÓóŚśŹźŻż', 'aacceellnnoosszzzz'))) AS sha FROM ch WHERE day >= '2024-01-20' AND kind <> 'other'")
def f27_f32_recent_indexable(spark, sf_dir):
    return chunks(spark, sf_dir).where((F.col("day") >= "2024-01-20") & (F.col("kind") != "other")).withColumn("t", normalize_query(F.col("text"))).select("chunk_id", sha("t"))
