"""Queries over the worklog: signals of chunks, claims held against evidence, repositories of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.functions import text as T
from sessionloom.operators import chunker, claims, identity, intents, segments, signals
from sessionloom.plans.directives import DIRECTIVES, LINES_SQL
from sessionloom.plans.registry import query
from sessionloom.plans.views import CHUNKS, TIMELINE, WORKLOG, chunks, timeline, worklog
from sessionloom.sources.shared import written

# SQL for DuckDB


def _sql_any(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


def _sql_begins(x: str, phrases) -> str:
    return "(" + " OR ".join(f"starts_with({x}, '{p}')" for p in phrases) + ")"


def _sql_hits(x: str, phrases) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, '{p}') AS INTEGER)" for p in phrases) + ")"


def _sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _sql_key(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' '))"


def _sql_cut(x: str, most: int) -> str:
    return f"CASE WHEN strlen({x}) <= {most} THEN {x} ELSE left({x}, list_max(list_filter(range(0, {most + 1}), lambda k: strlen(left({x}, CAST(k AS INTEGER))) <= {most}))) || '...[truncated]' END"


def _sql_hashes(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^0-9a-z]+'), lambda w: regexp_matches(w, '^[0-9a-f]{{7,40}}$') AND regexp_matches(w, '[0-9]')))"


def _sql_paths(x: str) -> str:
    ok = "contains(t, '/') AND NOT contains(t, '://') AND NOT starts_with(t, '~') AND NOT contains(t, '*')"
    quoted = f"list_filter(list_transform(regexp_extract_all({x}, '`([^`]*)`', 1), lambda t: {_sql_trim('t')}), lambda t: NOT contains(t, ' ') AND {ok})"
    bare = f"list_filter(list_transform(regexp_split_to_array({x}, '\\s+'), lambda t: trim(t, ',.;:()[]\"''')), lambda t: {ok} AND NOT starts_with(t, '`') AND contains(string_split(t, '/')[-1], '.'))"
    return f"list_sort(list_distinct(list_concat({quoted}, {bare})))"


_TAGS = {
    "ultrathink": "contains(lower({0}), 'ultrathink')",
    "insight": "(starts_with(lower({0}), 'insight') OR contains(lower({0}), '★ insight') OR contains(lower({0}), 'insight ─') OR contains(lower({0}), 'insight -'))",
    "plan_mode": "(contains(lower({0}), 'plan mode') OR contains(lower({0}), 'accept plan') OR contains(lower({0}), 'user accepted the plan') OR contains(lower({0}), 'bypass permissions'))",
    "decision": "(contains(lower({0}), '[decision]') OR starts_with(lower({0}), 'decision:'))",
    "outcome": "(contains(lower({0}), '[skill_outcome]') OR starts_with(lower({0}), 'outcome:') OR starts_with(lower({0}), 'validation:'))",
}


def _sql_firsts(source: str, family: str, most: int) -> str:
    first = f"SELECT chunk, {_sql_key('text')} AS key, arg_min(text, (source_seq, line_no)) AS text, min((source_seq, line_no)) AS pos FROM ({source}) GROUP BY ALL"
    return f"SELECT chunk, '{family}' AS family, n, {_sql_cut('text', 240)} AS text FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY pos) AS n FROM ({first})) WHERE n <= {most}"


def _sql_block(family: str) -> str:
    tag = _TAGS[family]
    ahead = ", ".join(f"lead(line, {k}) OVER (PARTITION BY source_seq ORDER BY line_no) AS x{k}" for k in (1, 2, 3))
    go = " AND ".join
    ok = [f"x{k} IS NOT NULL AND x{k} <> '' AND NOT {tag.format(f'x{k}')}" for k in (1, 2, 3)]
    text = f"line || CASE WHEN {go(ok)} THEN ' ' || x1 || ' ' || x2 || ' ' || x3 WHEN {go(ok[:2])} THEN ' ' || x1 || ' ' || x2 WHEN {ok[0]} THEN ' ' || x1 ELSE '' END"
    return f"SELECT chunk, source_seq, line_no, {text} AS text FROM (SELECT *, {ahead} FROM sl) WHERE line <> '' AND {tag.format('line')}"


_INTENT = f"role = 'user' AND line <> '' AND NOT {_sql_begins('lower(line)', signals.METADATA)} AND ({_sql_begins('lower(line)', ('intent:', '[intent]'))} OR regexp_matches(line, '(?i)(?:^|[^A-Za-z0-9])P[012](?:[^A-Za-z0-9]|$)') OR {_sql_any('lower(line)', signals.INTENTS)})"
_SIGNALS = f"""{WORKLOG}, sl AS (SELECT session_id AS chunk, source_seq, role, unnest(l) AS raw, unnest(range(len(l))) AS line_no, {_sql_trim('unnest(l)')} AS line FROM (SELECT *, string_split(message, chr(10)) AS l FROM tl)),
tk AS (SELECT *, sum(CAST(starts_with(ltrim(raw), '```') AS INTEGER)) OVER (PARTITION BY source_seq ORDER BY line_no) % 2 AS inside FROM sl),
td AS (SELECT chunk, source_seq, line_no, lower(regexp_extract(raw, '^\\s*[-*+]\\s*\\[([ xX])\\]\\s*(\\S.*)$', 1)) = 'x' AS done, {_sql_trim("regexp_extract(raw, '^\\s*[-*+]\\s*\\[([ xX])\\]\\s*(\\S.*)$', 2)")} AS text FROM tk WHERE inside = 0 AND NOT starts_with(ltrim(raw), '```')),
tc AS (SELECT chunk, {_sql_key('text')} AS key, arg_min(text, (source_seq, line_no)) AS text, CASE WHEN bool_or(done) THEN 'todo_done' ELSE 'todo_open' END AS family, min((source_seq, line_no)) AS pos FROM td WHERE text <> '' GROUP BY ALL),
sg AS (SELECT chunk, family, row_number() OVER (PARTITION BY chunk, family ORDER BY pos) AS n, text FROM tc
UNION ALL {_sql_firsts(f"SELECT chunk, source_seq, line_no, line AS text FROM sl WHERE {_INTENT}", 'intent', 6)}
UNION ALL {_sql_firsts(f"SELECT chunk, source_seq, line_no, line AS text FROM sl WHERE line <> '' AND {_sql_any('lower(line)', signals.RESULTS)}", 'result', 6)}
{' '.join('UNION ALL ' + _sql_firsts(_sql_block(f), f, most) for f, most in signals.BLOCKS.items())})"""


@query(f"WITH {_SIGNALS} SELECT chunk, family, CAST(n AS INTEGER) AS n, sha256(text) AS sha FROM sg")
def i02_d15_signals(spark, sf_dir):
    return signals.signals(worklog(spark, sf_dir)).select("chunk", "family", "n", F.sha2("text", 256).alias("sha"))


@query(
    f"WITH {_SIGNALS}, c AS (SELECT chunk, count(*) FILTER (family = 'todo_open') AS o, count(*) FILTER (family = 'todo_done') AS d FROM sg WHERE family LIKE 'todo%' GROUP BY chunk), "
    "b AS (SELECT chunk, family, string_agg(CASE family WHEN 'todo_open' THEN '- [ ] ' ELSE '- [x] ' END || text, chr(10) ORDER BY n) AS t FROM sg WHERE family LIKE 'todo%' AND n <= 2 GROUP BY chunk, family) "
    "SELECT chunk, '[signals]' || chr(10) || CASE WHEN o > 0 THEN 'RED LIGHT: checklist detected (open: ' || o || ', done: ' || d || ')' ELSE 'Checklist detected (open: 0, done: ' || d || ')' END "
    "|| coalesce(chr(10) || x.t, '') || CASE WHEN o > 2 THEN chr(10) || '... (+' || (o - 2) || ' more open)' ELSE '' END || coalesce(chr(10) || y.t, '') || CASE WHEN d > 2 THEN chr(10) || '... (+' || (d - 2) || ' more done)' ELSE '' END AS text "
    "FROM c LEFT JOIN (SELECT * FROM b WHERE family = 'todo_open') x USING (chunk) LEFT JOIN (SELECT * FROM b WHERE family = 'todo_done') y USING (chunk)"
)
def p10_signals_block(spark, sf_dir):
    return signals.signals_block(signals.signals(worklog(spark, sf_dir)), shown=2)


@query(
    f"WITH {WORKLOG}, f AS (SELECT session_id AS chunk, source_seq, list_filter(list_transform(string_split(message, chr(10)), lambda x: {_sql_trim('x')}), lambda x: x <> '')[1] AS text FROM tl WHERE {_sql_any('lower(message)', signals.HIGHLIGHTS)} OR {_sql_any('message', signals.HIGHLIGHTS_AS_WRITTEN)}), "
    "g AS (SELECT *, lag(text) OVER (PARTITION BY chunk ORDER BY source_seq) AS b FROM f WHERE text IS NOT NULL), h AS (SELECT chunk, text, row_number() OVER (PARTITION BY chunk ORDER BY source_seq) AS n FROM g WHERE b IS NULL OR b <> text) SELECT chunk, CAST(n AS INTEGER) AS n, sha256(text) AS sha FROM h WHERE n <= 3"
)
def i01_highlights(spark, sf_dir):
    return signals.highlights(worklog(spark, sf_dir)).select("chunk", "n", F.sha2("text", 256).alias("sha"))


@query(
    f"WITH {WORKLOG}, s AS (SELECT session_id AS chunk, sum(CASE WHEN role = 'assistant' THEN {_sql_hits('lower(message)', signals.PLANS)} ELSE 0 END) AS p, sum(CASE WHEN role = 'assistant' THEN {_sql_hits('lower(message)', signals.REPORTS)} ELSE 0 END) AS r, bool_or(role IN ('user', 'assistant')) AS t FROM tl GROUP BY 1) "
    "SELECT chunk, CASE WHEN p >= 3 AND p > r THEN 'plans' WHEN r >= 3 AND r > p THEN 'reports' WHEN t THEN 'conversations' ELSE 'other' END AS kind FROM s"
)
def i03_chunk_kind(spark, sf_dir):
    return signals.chunk_kind(worklog(spark, sf_dir))


@query(
    f"WITH {WORKLOG}, s AS (SELECT session_id || '/' || frame_kind AS chunk, sum({_sql_hits('lower(message)', signals.SEGMENT_PLANS)}) AS p, sum({_sql_hits('lower(message)', signals.SEGMENT_REPORTS)}) AS r, bool_or(role IN ('user', 'assistant')) AS t FROM tl GROUP BY 1) "
    "SELECT chunk, CASE WHEN r >= 2 AND r > p AND NOT t THEN 'reports' WHEN p >= 2 AND p >= r THEN 'plans' WHEN t THEN 'conversations' WHEN r > 0 THEN 'reports' ELSE 'other' END AS kind FROM s"
)
def i04_segment_kind(spark, sf_dir):
    return signals.segment_kind(worklog(spark, sf_dir).withColumn("chunk", F.concat("session_id", F.lit("/"), "frame_kind")))


@query(f"WITH {WORKLOG} SELECT source_seq, sha256({_sql_cut('message', 240)}) AS sha FROM tl")
def u04_byte_cut(spark, sf_dir):
    return worklog(spark, sf_dir).select("source_seq", F.sha2(T.byte_cut(F.col("message"), 240), 256).alias("sha"))


@query(f"WITH {WORKLOG} SELECT source_seq, array_to_string({_sql_paths('message')}, ',') AS paths FROM tl")
def u12_path_tokens(spark, sf_dir):
    return worklog(spark, sf_dir).select("source_seq", F.array_join(T.path_tokens(F.col("message")), ",").alias("paths"))


# Claims and evidence

_FIRST = f"list_filter(list_transform(string_split(message, chr(10)), lambda x: {_sql_trim('x')}), lambda x: x <> '')[1]"
_CLAIM_TYPE = """CASE WHEN regexp_matches(p, ' (no|zero) blockers? | bez bloker(ów|ow) ') THEN 'no_blockers' WHEN regexp_matches(p, ' (blocked|blockers?|zablokowane) ') THEN 'blocked'
  WHEN regexp_matches(p, ' (production ready|ready to (push|ship|merge)|gotowe do pusha?|można pushować|mozna pushowac) ') THEN 'ready_to_push' WHEN regexp_matches(p, ' (shippable|ship it) ') THEN 'shippable'
  WHEN regexp_matches(p, ' (migration complete|migrated) ') THEN 'migrated' WHEN contains(p, ' installed ') THEN 'installed' WHEN regexp_matches(p, ' wdro[żz]one ') THEN 'implemented'
  WHEN regexp_matches(p, ' (docs updated|documented) ') THEN 'documented' WHEN regexp_matches(p, ' (verified|działa|dziala) ') THEN 'verified' WHEN regexp_matches(p, ' (green|zielone) ') THEN 'green'
  WHEN regexp_matches(p, ' (tests pass|passing|tested|przetestowane|testy przechodz[ąa]) ') THEN 'tested' WHEN regexp_matches(p, ' (fixed|naprawione|naprawi[łl]em) ') THEN 'fixed'
  WHEN regexp_matches(p, ' (implemented|shipped|completed?|done|zrobione|gotowe) ') THEN 'implemented' END"""
_CLAIMS = f"""{LINES_SQL.replace(DIRECTIVES, WORKLOG)}, fl AS (SELECT *, {_FIRST} AS line FROM tl WHERE role IN ('assistant', 'agent', 'model', 'gemini')),
pd AS (SELECT *, ' ' || regexp_replace(lower(line), '[^\\pL\\pN]+', ' ', 'g') || ' ' AS p FROM fl WHERE line IS NOT NULL),
cl AS (SELECT 'k' || source_seq AS id, project, session_id, ts, source_seq, line, {_CLAIM_TYPE} AS claim_type,
  {_sql_hashes('line')} AS hashes, {_sql_paths('line')} AS files, {_sql_any('lower(line)', ('test', 'green', 'zielon'))} AS about FROM pd),
cm AS (SELECT *, claim_type IN ('green', 'shippable', 'no_blockers', 'ready_to_push') AS high_risk FROM cl WHERE claim_type IS NOT NULL),
e0 AS (SELECT 'e' || source_seq AS evidence_id, project, session_id, source_seq, contains(message, 'test result:') AS test, {_sql_trim(f"CASE WHEN contains(message, 'test result:') THEN list_filter(string_split(message, chr(10)), lambda x: contains(x, 'test result:'))[1] ELSE {_FIRST} END")} AS excerpt FROM tl WHERE frame_kind <> 'agent_reply' AND (contains(message, 'test result:') OR starts_with(message, 'commit '))),
ev AS (SELECT evidence_id, e.project, e.session_id, test, cm.id AS claim_id, excerpt, test AND contains(lower(excerpt), 'failed') AS fails, CASE WHEN test THEN [] ELSE {_sql_hashes('excerpt')} END AS hashes, CASE WHEN test THEN [] ELSE {_sql_paths('excerpt')} END AS files FROM e0 e ASOF LEFT JOIN cm ON e.session_id = cm.session_id AND e.source_seq >= cm.source_seq),
lk AS (SELECT id, evidence_id, id = claim_id IS TRUE AS direct, fails FROM cm JOIN ev ON cm.id = ev.claim_id OR (cm.project = ev.project AND (len(list_intersect(cm.hashes, ev.hashes)) > 0 OR len(list_intersect(cm.files, ev.files)) > 0))),
mt AS (SELECT cm.id, cm.project, high_risk, bool_or(coalesce(cm.id = ev.claim_id, false)) AS direct, bool_or(fails) AS fails FROM cm JOIN ev ON cm.id = ev.claim_id OR (cm.project = ev.project AND ((test AND about) OR len(list_intersect(cm.hashes, ev.hashes)) > 0 OR len(list_intersect(cm.files, ev.files)) > 0)) GROUP BY ALL),
au AS (SELECT id AS claim_id, project, CASE WHEN fails THEN 'fail' WHEN NOT high_risk OR direct THEN 'pass' END AS status, CASE WHEN fails THEN 'Audited against test run output (failing)' WHEN direct THEN 'Audited and verified via matching direct evidence record' ELSE 'Audited and verified via matching circumstantial evidence record' END AS text FROM mt),
af AS (SELECT id AS claim_id, project, CASE WHEN path = 'src/app.rs' THEN 'pass' ELSE 'fail' END AS status, path || CASE WHEN path = 'src/app.rs' THEN ': exists' ELSE ': NOT FOUND' END || ' ls-level filesystem check, re-runnable' AS text FROM (SELECT id, project, unnest(files) AS path FROM cm)),
rs AS (SELECT * FROM au WHERE status IS NOT NULL UNION ALL SELECT * FROM af),
ft AS (SELECT claim_id, count(*) FILTER (status = 'pass') AS passes, count(*) FILTER (status = 'fail') AS failures FROM rs GROUP BY claim_id),
vf AS (SELECT cm.id, project, session_id, ts, claim_type, high_risk, coalesce(passes, 0) AS passes, coalesce(failures, 0) AS failures, CASE WHEN coalesce(passes + failures, 0) = 0 THEN 'unverified' WHEN failures = 0 THEN 'verified' WHEN passes = 0 THEN 'contradicted' ELSE 'partial' END AS status FROM cm LEFT JOIN ft ON cm.id = ft.claim_id),
tx AS (SELECT project, line AS text FROM cm UNION SELECT project, text FROM rs),
it AS (SELECT *, list_filter(regexp_split_to_array(lower(summary), '[^\\pL\\pN]+'), lambda w: strlen(w) >= 3) AS ws FROM ca WHERE kind = 'intent'),
tw AS (SELECT DISTINCT project, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda w: strlen(w) >= 3)) AS v FROM tx),
hw AS (SELECT DISTINCT i.project, w FROM (SELECT DISTINCT project, unnest(ws) AS w FROM it) i JOIN tw ON i.project = tw.project AND (contains(w, v) OR contains(v, w))),
ad AS (SELECT DISTINCT source_seq, summary FROM (SELECT source_seq, project, summary, unnest(ws) AS w FROM it) JOIN hw USING (project, w) UNION SELECT source_seq, summary FROM it JOIN tx ON it.project = tx.project AND len(ws) = 0 AND (contains(lower(text), lower(summary)) OR contains(lower(summary), lower(text)))),
orp AS (SELECT * FROM it WHERE (source_seq, summary) NOT IN (SELECT (source_seq, summary) FROM ad)),
fr AS (SELECT id, session_id, ts, CASE WHEN status = 'contradicted' AND high_risk THEN 'critical' WHEN status = 'contradicted' THEN 'high' ELSE 'medium' END AS severity FROM vf WHERE status = 'contradicted' OR (status = 'unverified' AND high_risk) UNION ALL SELECT 'i' || source_seq, session_id, ts, 'low' FROM orp)"""


def found_claims(spark, sf_dir):
    """The worklog, its claims and its evidence; these are written, as what follows reads them many times."""
    rows = worklog(spark, sf_dir)
    made = written(claims.claims(rows), "claims")
    return rows, made, written(claims.evidence(rows, made), "evidence")


def found_results(spark, sf_dir):
    _, made, facts = found_claims(spark, sf_dir)
    files = spark.createDataFrame([("src/app.rs",)], "path string")
    return made, written(claims.audited(made, facts).unionByName(claims.artifacts(made, files)), "results")


def wanted_intents(spark, sf_dir):
    """The intents of the worklog, written: their lines are classified once."""
    return written(intents.candidates(worklog(spark, sf_dir)).where("kind = 'intent'").select("source_seq", "project", "session_id", "ts", "summary"), "intents")


def found_fractures(spark, sf_dir):
    made, results = found_results(spark, sf_dir)
    wanted = wanted_intents(spark, sf_dir)
    return claims.fractures(claims.verified(made, results), claims.orphans(wanted, made, results))


@query(f"WITH {_CLAIMS} SELECT id, claim_type, high_risk, array_to_string(hashes, ',') AS hashes, array_to_string(files, ',') AS files FROM cm")
def i20_claims(spark, sf_dir):
    made = found_claims(spark, sf_dir)[1]
    return made.select("id", "claim_type", "high_risk", F.array_join("hashes", ",").alias("hashes"), F.array_join("files", ",").alias("files"))


@query(f"WITH {_CLAIMS} SELECT id, evidence_id, direct, fails FROM lk")
def j05_claim_evidence(spark, sf_dir):
    _, made, facts = found_claims(spark, sf_dir)
    return claims.linked(made, facts)


@query(f"WITH {_CLAIMS} SELECT claim_id, status, text FROM au WHERE status IS NOT NULL")
def i21_audit(spark, sf_dir):
    _, made, facts = found_claims(spark, sf_dir)
    return claims.audited(made, facts).select("claim_id", "status", "text")


@query(f"WITH {_CLAIMS} SELECT claim_id, status, text FROM af")
def j07_artifacts(spark, sf_dir):
    made = found_claims(spark, sf_dir)[1]
    return claims.artifacts(made, spark.createDataFrame([("src/app.rs",)], "path string")).select("claim_id", "status", "text")


@query(f"WITH {_CLAIMS} SELECT id, claim_type, passes, failures, status FROM vf")
def i22_j06_verified(spark, sf_dir):
    return claims.verified(*found_results(spark, sf_dir)).select("id", "claim_type", "passes", "failures", "status")


@query(f"WITH {_CLAIMS} SELECT source_seq, sha256(summary) AS sha FROM orp")
def j08_orphan_intents(spark, sf_dir):
    made, results = found_results(spark, sf_dir)
    wanted = wanted_intents(spark, sf_dir)
    return claims.orphans(wanted, made, results).select("source_seq", F.sha2("summary", 256).alias("sha"))


@query(f"WITH {_CLAIMS} SELECT id, session_id, severity FROM fr")
def i23_fractures(spark, sf_dir):
    return found_fractures(spark, sf_dir).select("id", "session_id", "severity")


@query(f"WITH {_CLAIMS} SELECT id, ts FROM fr ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, ts DESC, id LIMIT 5")
def i24_clarify(spark, sf_dir):
    return claims.clarify(found_fractures(spark, sf_dir)).select("id", "ts")


@query(f"WITH {_CLAIMS} SELECT claim_type, status, count(*) AS n FROM vf GROUP BY claim_type, status")
def a11_claim_status(spark, sf_dir):
    return claims.verified(*found_results(spark, sf_dir)).groupBy("claim_type", "status").agg(F.count("*").alias("n"))


@query(f"WITH {_CLAIMS} SELECT source_seq, type, sha256(line) AS sha FROM (SELECT source_seq, type, {_sql_trim('line')} AS line, row_number() OVER (PARTITION BY {_sql_trim('line')} ORDER BY source_seq, line) AS k FROM ty WHERE role = 'user' AND type IS NOT NULL AND type NOT IN ('result', 'outcome') AND {_sql_trim('line')} <> '') WHERE k = 1")
def i19_user_intent_lines(spark, sf_dir):
    return intents.user_lines(worklog(spark, sf_dir)).select("source_seq", "type", F.sha2("line", 256).alias("sha"))


# Repositories

_ROOTS = (("/home/u/git/acme/repo0", "git@github.com:acme/zero.git"), ("/home/u/git/acme/repo1", None), ("/work/solo1", None), ("/work/solo2", "https://gitlab.com/org/two"))


@query(
    f"WITH {WORKLOG}, n AS (SELECT source_seq, source_seq // 1000 AS conv, source_seq % 1000 % 8 AS k FROM tl) SELECT source_seq, "
    "CASE k WHEN 0 THEN 'acme/tool-' || conv WHEN 1 THEN CASE conv % 4 WHEN 0 THEN 'acme/zero' ELSE 'acme/repo' || (conv % 4) END WHEN 2 THEN CASE conv % 3 WHEN 1 THEN 'local/solo1' WHEN 2 THEN 'org/two' ELSE 'unclassified' END WHEN 3 THEN 'acme/lib' || (conv % 5) WHEN 4 THEN CASE conv % 3 WHEN 1 THEN 'acme/hashed' ELSE 'unclassified' END WHEN 6 THEN 'local/unknown' ELSE 'unclassified' END AS bucket, "
    "CASE k WHEN 0 THEN 'primary' WHEN 1 THEN CASE conv % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' ELSE 'fallback' END WHEN 2 THEN CASE conv % 3 WHEN 1 THEN 'secondary' WHEN 2 THEN 'primary' ELSE '-' END WHEN 3 THEN 'fallback' WHEN 4 THEN CASE conv % 3 WHEN 1 THEN 'secondary' ELSE '-' END WHEN 6 THEN 'primary' ELSE '-' END AS tier FROM n"
)
def i05_u19_identity(spark, sf_dir):
    conv, turn = F.floor(F.col("source_seq") / 1000), F.col("turn") % 8
    paths = (
        F.concat(F.lit("https://github.com/acme/tool-"), conv, F.lit(".git")), F.concat(F.lit("/home/u/git/acme/repo"), conv % 4, F.lit("/src")), F.concat(F.lit("/work/solo"), conv % 3, F.lit("/x")),
        F.concat(F.lit("/data/repos/acme/lib"), conv % 5), F.concat(F.lit("0123456789abcdef"), conv % 3), F.lit("/tmp/2026-01-22"), F.lit("git@gitlab.com:src/docs"),
    )
    cwd = F.lit("")
    for k, path in enumerate(paths):
        cwd = F.when(turn == k, path).otherwise(cwd)
    roots, registry = spark.createDataFrame(_ROOTS, "root string, remote string"), spark.createDataFrame([("0123456789abcdef1", "acme/hashed")], "hash string, slug string")
    found = identity.resolved(worklog(spark, sf_dir).withColumn("cwd", cwd), roots, registry)
    return found.select("source_seq", "bucket", F.coalesce("tier", F.lit("-")).alias("tier"))


@query(f"WITH {CHUNKS}, n AS (SELECT chunk_id, CAST(substr(chunk_id, 2) AS BIGINT) % 10 AS k FROM ch) SELECT chunk_id, k IN (0, 6, 7, 8) AS ok FROM n")
def f29_plausible_names(spark, sf_dir):
    """Names of ten shapes made of the columns: those with an ending, a year, two dots of seven and more, 64 characters may be names."""
    shapes = [F.concat("kind", F.lit(".b")), F.lit("src"), F.col("day"), F.concat(F.lit("-"), "kind"), F.concat_ws(" ", "kind", "agent"), F.concat(F.substring("agent", 1, 1), F.lit("..")), F.substring("day", 1, 4), F.concat("agent", F.lit("..")), F.rpad("agent", 64, "n"), F.rpad("agent", 65, "n")]
    name = F.element_at(F.array(*shapes), (F.substring("chunk_id", 2, 20).cast("long") % 10 + 1).cast("int"))
    return chunks(spark, sf_dir).select("chunk_id", identity.plausible(name).alias("ok"))


# Windows

_WINDOWS = f"""{TIMELINE}, fk AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(frame_kind) OVER w IS DISTINCT FROM frame_kind THEN 1 ELSE 0 END AS b FROM tl WINDOW w AS (PARTITION BY agent, session_id, day ORDER BY ts, source_seq)),
rn AS (SELECT *, CAST(sum(b) OVER (PARTITION BY agent, session_id, day ORDER BY ts, source_seq) AS BIGINT) AS run FROM fk),
c AS (SELECT agent, session_id, day, run, ts, role, message, source_seq, CAST(ceil(strlen(message) / 4.0) AS BIGINT) + 20 AS cost, row_number() OVER w AS i, sum(CAST(ceil(strlen(message) / 4.0) AS BIGINT) + 20) OVER w AS upto, count(*) OVER (PARTITION BY agent, session_id, day, run) AS n FROM rn WHERE message <> '' WINDOW w AS (PARTITION BY agent, session_id, day, run ORDER BY ts, source_seq)),
en AS (SELECT a.agent, a.session_id, a.day, a.run, a.i AS s, a.n, min(b.i) + 1 AS e FROM c a JOIN c b ON a.session_id = b.session_id AND a.agent = b.agent AND a.day = b.day AND a.run = b.run AND b.i >= a.i LEFT JOIN c x ON a.session_id = x.session_id AND a.agent = x.agent AND a.day = x.day AND a.run = x.run AND x.i = b.i + 1
  WHERE b.upto - a.upto + a.cost >= 1500 OR x.i IS NULL OR x.upto - a.upto + a.cost > 2500 GROUP BY ALL),
wd(agent, session_id, day, run, k, s, e, n) AS (SELECT agent, session_id, day, run, 0, s, e, n FROM en WHERE s = 1 UNION ALL SELECT en.agent, en.session_id, en.day, en.run, k + 1, en.s, en.e, en.n FROM wd JOIN en ON en.session_id = wd.session_id AND en.agent = wd.agent AND en.day = wd.day AND en.run = wd.run AND en.s = greatest(wd.s + 1, wd.e - 2) WHERE wd.e <= wd.n),
wm AS (SELECT c.*, k FROM wd JOIN c ON c.session_id = wd.session_id AND c.agent = wd.agent AND c.day = wd.day AND c.run = wd.run AND c.i >= wd.s AND c.i < wd.e)"""


@query(f'WITH RECURSIVE {_WINDOWS} SELECT agent, session_id, day, run, CAST(k AS BIGINT) AS "window", arg_min(source_seq, i) AS first_seq, arg_max(source_seq, i) AS last_seq, CAST(sum(cost) AS BIGINT) AS tokens, count(*) AS messages FROM wm GROUP BY agent, session_id, day, run, k')
def w03_token_windows(spark, sf_dir):
    return chunker.windows(segments.frame_runs(timeline(spark, sf_dir))).drop("seqs")


@query(f"""WITH RECURSIVE {_WINDOWS} SELECT agent, session_id, day, run, CAST(k AS BIGINT) AS "window", sha256(string_agg('[' || strftime(ts, '%H:%M:%S') || '] ' || role || ': ' || {_sql_cut('message', 4000)}, chr(10) ORDER BY i)) AS sha FROM wm GROUP BY agent, session_id, day, run, k""")
def p09_chunk_text(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    return chunker.rendered(chunker.windows(segments.frame_runs(rows)), rows).select("agent", "session_id", "day", "run", "window", F.sha2("text", 256).alias("sha"))
