"""Lines of all types put before the conversations' texts, their classification in SQL, and the queries on single lines.

The SQL spells the rules out once more, by hand and not from the library's tables, so that the two can differ.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.functions import text as T
from sessionloom.operators import intents, linerules, machines, overlay
from sessionloom.plans.registry import query, sha
from sessionloom.plans.views import _timeline_sql, timeline

LINES = (
    "Decision: keep `let's` out of it", "[decision] use parquet", "TODO: write the loader", "[ ] bare box item", "- fix the loader now", "dodaj testy do parsera", "I will send it tomorrow", "question: how to read it",
    "Is this the right way to do it?", "short?", "from now on no fallback", "to musi działać", "Assumption: it fits in memory", "well, assuming it fits", "★ Insight of the day", "key finding: slow disk",
    "outcome: loader shipped", "docs/guide.md has been added", "the run gave 12 records", "result: 3 of 4", "clippy is clean", "tests 12 of 13", "tests are nice", "on the other hand it is slow", "why: it is slow",
    "Task: rebuild", "intent: make it fast\nin src/app.rs", "let's rebuild the loader index", "let's not rebuild", "nie chcę tego", "use `let's encrypt` here", "chcę nowy indeks", "P0 broken login", "> quoted let's go", "Done.",
    "Done: loader green at abc1234", "source: let's go", "<bash-stdout let's", "feat: add loader\nFix the parser\nabc1234f wire it", "Fix the parser alone", "- [ ] write src/app.rs tests",
    "* [x]  write  src/app.rs tests", "<command-name>/plan let's", "1 musi być", "zrobię to jutro", "pomysłu brak", "yyy chcę coś\n", "validation: p0=0 score:9/10", "tradeoff: memory for speed", "Wynik: loader index rebuilt",
    "czy to działa dobrze?", "DEFAULT_KEYWORDS_PATH = x", "field(default=1)", "I disagree with that", "let's-go", "lub chcę, nie chcę", "next step: docs/guide.md, a1b2c3d and A1B2C3D", "fix tests", "outcome: fixtests works",
    "the cache is disabled\nthe cache is enabled", "we never rebuild\nwe do not cache", "Assumption: the loader holds the index\nresult: the loader failed on the index",
)


def directives(spark, sf_dir):
    """The timeline with one of LINES before each text."""
    return timeline(spark, sf_dir, tuple(x + "\n" for x in LINES))


DIRECTIVES = _timeline_sql(tuple(x + "\n" for x in LINES))
_TRIM = r"regexp_replace(%s, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"
_COMPACT = r"trim(regexp_replace(%s, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"
_KEYWORDS = "['mam pomysl', 'mam pomysł', 'mam taki pomysl', 'mam taki pomysł', 'pomysl', 'pomysł', 'proponuje', 'proponuję', 'zrobmy', 'zróbmy', 'ustalmy', 'chce', 'chcę', 'chcialbym', 'chciałbym', 'potrzebuje', 'potrzebuję', 'prosze', 'proszę', 'odpal', 'uruchom', 'usun', 'usuń', 'następny krok', 'nastepny krok', 'kolejny krok', 'i want', 'i''d like', 'let''s', 'next step']"
#: Each place of a keyword is looked at by itself: what is before it and what is behind it.
SAYS = f"""(len(list_filter({_KEYWORDS}, lambda k: contains(m, k) AND len(list_filter(range(1, len(string_split(m, k))), lambda i:
  NOT regexp_matches(substr(m, 1, CAST((list_sum(list_transform(string_split(m, k)[1:i], lambda z: length(z))) + (i - 1) * length(k)) AS BIGINT)), '([\\pL\\pN_-]|nie |bez |don''t |do not |won''t |will not |shouldn''t |should not |wouldn''t |would not |isn''t |aren''t |doesn''t |didn''t )$')
  AND NOT regexp_matches(substr(m, CAST((list_sum(list_transform(string_split(m, k)[1:i], lambda z: length(z))) + (i - 1) * length(k)) + length(k) + 1 AS BIGINT)), '^([\\pL\\pN_]| (not|nie)[ ,.])'))) > 0)) > 0)"""
_POLICY = "regexp_matches(low, 'nie fixujemy|nie robimy|nie ruszamy|out of scope|poza scope|od teraz|from now on|canonical|kanonicz|default|domysln|domyśln|tylko przez|bez zgadywania|bez fallback|no fallback|musi mieć|musi miec|ma byc dodatkiem|ma być dodatkiem')"
_REQUIRE = "regexp_matches(low, 'nie może być|nie moze byc|ma być|ma byc|musi |musimy |trzeba |zrób to testowalne|zrob to testowalne|pełny ownership|pelny ownership|teraz wypuszuj')"
_DONE = "regexp_matches(low, 'smoke test|passed|all checks passed|0 failed|completed|done|zrobione|dowiezione|gotowe|dziala|działa')"
_PASTED = r"(usr AND regexp_matches(ltrim(line, ' '), '^(>|\[Pasted text #)'))"
_DIRECTIVE = r"(usr AND regexp_matches(ltrim(low, ' '), '^(zadanie:|task:|intent:|\[intent\])'))"
_OUTCOME_TAG = r"(contains(low, '[skill_outcome]') OR starts_with(low, 'outcome:') OR starts_with(low, 'validation:'))"
_QUESTION = "regexp_matches(low, 'how do|how does|how to|what is|what are|why does|why is|can we|should we|is it possible|does it|do we|jak |dlaczego |czy |co to |co jest|w jaki sposób')"
#: struct(type, confidence) from line, low, head, m and usr.
TYPED = rf"""CASE WHEN {_PASTED} THEN NULL
  WHEN starts_with(head, 'decision:') OR contains(low, '[decision]') THEN {{'t': 'decision', 'c': 0.95}}
  WHEN regexp_matches(head, '^(task|todo|zadanie):') THEN {{'t': 'task', 'c': 0.95}}
  WHEN usr AND regexp_matches(low, '^\s*\[[ x]\] ') THEN {{'t': 'task', 'c': 0.85}}
  WHEN usr AND regexp_matches(low, '^\s*[-*+]*\s*\S+\s+\S+\s+\S') AND regexp_matches(low, '^\s*[-*+]*\s*(stworz|stwórz|utworz|utwórz|dodaj|napraw|popraw|zbuduj|przygotuj|zapisz|spisz|wypisz|zaimplementuj|podlacz|podłącz|skopiuj|przekopiuj|uruchom|odpal|create|add|fix|update|implement|write|run|copy)[ :]') THEN {{'t': 'task', 'c': 0.75}}
  WHEN regexp_matches(low, '^\s*(commitment:|promise:|obietnica:|zrobie|zrobię|zajme sie|zajmę się|i will |i''ll )') THEN {{'t': 'commitment', 'c': 0.72}}
  WHEN starts_with(head, 'question:') AND ({_QUESTION} OR ends_with(head, '?')) THEN {{'t': 'question', 'c': 0.95}}
  WHEN NOT starts_with(head, 'question:') AND ends_with(head, '?') AND strlen(head) > 15 THEN {{'t': 'question', 'c': 0.7}}
  WHEN usr AND {_POLICY} THEN {{'t': 'decision', 'c': 0.75}}
  WHEN usr AND {_REQUIRE} THEN {{'t': 'intent', 'c': 0.7}}
  WHEN regexp_matches(head, '^(assumption:|hypothesis:|zakładam|zakladam|założenie:|zalozenie:|hipoteza:)') THEN {{'t': 'assumption', 'c': 0.9}}
  WHEN regexp_matches(low, 'i assume|assuming|i believe|we assume|hypothesis:|zakładam|zakladam|założenie:|zalozenie:|hipoteza:|przypuszczam') THEN {{'t': 'assumption', 'c': 0.65}}
  WHEN regexp_matches(head, '^(insight|odkrycie|wniosek|kluczowe):') OR contains(low, '★ insight') THEN {{'t': 'insight', 'c': 0.9}}
  WHEN regexp_matches(low, 'insight:|realization:|key finding:|the real issue is|fundamentally,|odkrycie:|wniosek:|kluczowe:') THEN {{'t': 'insight', 'c': 0.65}}
  WHEN {_OUTCOME_TAG} THEN {{'t': 'outcome', 'c': 0.9}}
  WHEN regexp_matches(low, 'zosta[lł] dodany|zosta[lł]a dodana|zosta[lł]y dodane|zosta[lł] utworzony|has been added|was added|has been created|was created') AND regexp_matches(low, '^(plik |file |docs/)|[.](md|rs)|/') THEN {{'t': 'outcome', 'c': 0.72}}
  WHEN regexp_matches(low, '[0-9]') AND regexp_matches(low, ' records| rekord| wynik') AND regexp_matches(low, ' da[lł] |dala | dała |yielded|produced|gave') THEN {{'t': 'outcome', 'c': 0.72}}
  WHEN regexp_matches(head, '^(result|wynik):') THEN {{'t': 'result', 'c': 0.95}}
  WHEN {_DONE} OR regexp_matches(low, 'passed|failed|score[=:]|latency|p[012]=|/10|clippy|cargo test|✓|✗|0 warnings|0 errors') THEN {{'t': 'result', 'c': 0.75}}
  WHEN regexp_matches(low, 'tests |error:') AND regexp_matches(low, '[0-9]|pass|fail| ok|ok[.]|done|skipped|ignored|timeout|panicked|panic:|✓|✗') THEN {{'t': 'result', 'c': 0.6}}
  WHEN regexp_matches(low, 'on the other hand|alternatively|disagree|counterpoint|trade-off|tradeoff|but if we|however,|z drugiej strony|alternatywnie|spór:|kontrargument') THEN {{'t': 'argue', 'c': 0.6}}
  WHEN regexp_matches(low, 'why:|because|the reason|this is needed|motivated by|driven by|root cause|underlying issue|bo |ponieważ|dlatego że|przyczyna:|powód:') THEN {{'t': 'why', 'c': 0.7}}
  WHEN {_DIRECTIVE} THEN {{'t': 'intent', 'c': 0.8}}
  WHEN usr AND {SAYS} THEN {{'t': 'intent', 'c': 0.7}} END"""
KIND_OF = "CASE WHEN %s IN ('decision', 'task') THEN %s WHEN %s IN ('intent', 'question', 'why') THEN 'intent' WHEN %s IN ('outcome', 'result') THEN 'outcome' END"
_PRINTED = r"""(regexp_matches(lower(regexp_replace(%s, '^\s*(- )?\s*', '')), '^</?(local-command-caveat|bash-stdout|bash-stderr)') OR regexp_matches(lower(regexp_replace(%s, '^\s*(- )?\s*[*><]*\s*', '')), '^(issuer:|subject:|subjectaltname:|ssl certificate|alpn:|http/|server:|content-type:|x-ratelimit-|x-request-id:|strict-transport-security:|content-security-policy:|referrer-policy:|permissions-policy:)'))"""
_METADATA = r"""regexp_matches(lower(%s), '^(source:|kind:|source_file:|severity:|project:|author:|heading:|input:|output:|"output":|current topic:|topic summary:|successfully created and wrote to new file:|base directory for this skill:)')"""
COMMIT = r"regexp_matches(regexp_replace(%s, '^\s*[-*+>]*\s*', ''), '^([0-9a-fA-F]{7,40}|Add|Fix|Update|Remove|Refactor|Implement|Create|Delete|Move|Rename|Drop|Bump|Split|Harden|Allow|Stabilize|Port|Merge|Revert|Close|Resolve|Improve|Switch|Enable|Disable|Replace|Extract|Introduce|Wire|Guard|Expose|Prevent|Support)\s+\S|^(feat|fix|chore|docs|refactor|test|perf|build|ci|style|revert|ops|polish|release)(\([^)]*\))?: \s*\S')"
_TOKENS = r"""list_filter(list_transform(regexp_split_to_array(%s, '\s+'), lambda x: regexp_replace(x, '^[,.;:()\[\]{}"'']+|[,.;:()\[\]{}"'']+$', '', 'g')), lambda x: x <> '' AND ((regexp_matches(lower(x), '\.(rs|md|json|toml|yaml|yml|ts|js|py|sh|txt)') AND (regexp_matches(x, '[/\\:]') OR starts_with(x, 'src.'))) OR regexp_matches(x, '^[0-9a-fA-F]{7,40}$') OR regexp_matches(lower(x), '^(p[012]=0$|score[=:])|/10$')))"""
_LABELS = {"decision": ("\\[decision\\]", "decision:"), "outcome": ("\\[skill_outcome\\]", "outcome:", "validation:"), "intent": ("\\[intent\\]", "intent:", "question:", "why:")}


def _unlabelled(x: str, labels) -> str:
    for label in labels:
        x = f"regexp_replace({x}, '(?i)^{label}[ :-]*\\s*', '')"
    return x


_BARE = r"regexp_replace(x, '^- \s*', '')"
#: ln: lines; ty: their types; ca: candidates.
LINES_SQL = rf"""{DIRECTIVES}, l0 AS (SELECT * EXCLUDE (message), regexp_split_to_array(message, '\r?\n') AS ls, regexp_matches(message, '^\s*(<command-message>|<command-name>|<local-command-caveat>|<bash-input>|<bash-stdout>|<bash-stderr>|<system-reminder>|Base directory for this skill:)') AS put FROM tl),
ln AS (SELECT * EXCLUDE (ls, i), i - 1 AS line_no, ls[i] AS line, ls[i - 1] AS before, ls[i + 1] AS behind FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM l0)),
fc AS (SELECT *, lower(x) AS low, x AS head0, lower(x) AS head, regexp_replace(lower(x), '`[^`]*`', '``', 'g') AS m, lower(role) = 'user' AS usr FROM (SELECT * EXCLUDE (line), {_TRIM % 'line'} AS x, {_TRIM % 'line'} AS line FROM ln)),
ty AS (SELECT *, typed.t AS type, typed.c AS c FROM (SELECT *, {TYPED} AS typed FROM fc)),
k0 AS (SELECT *, regexp_extract(x, '^[-*+]\s*\[([ xX])\]\s*(\S.*)$', 1) AS mark, regexp_extract(x, '^[-*+]\s*\[([ xX])\]\s*(\S.*)$', 2) AS task FROM ty
  WHERE x <> '' AND NOT (role = 'user' AND put) AND NOT ({COMMIT % 'x'} AND (coalesce({COMMIT % 'before'}, false) OR coalesce({COMMIT % 'behind'}, false))) AND NOT {_METADATA % 'x'} AND NOT {_PRINTED % ('x', 'x')}),
k1 AS (SELECT *, CASE WHEN task <> '' THEN 'task' WHEN {_PASTED} THEN NULL ELSE coalesce(CASE WHEN usr AND c >= 0.5 THEN {KIND_OF % (('type',) * 4)} END,
  CASE WHEN contains(low, '[decision]') OR starts_with(low, 'decision:') OR (usr AND {_POLICY}) THEN 'decision' WHEN usr AND {_REQUIRE} THEN 'intent'
  WHEN NOT regexp_matches(low, '^[-*+> \t]*(zrobione|dowiezione|gotowe|dziala|działa|done|completed)[.!,]*$') AND ({_OUTCOME_TAG} OR {_DONE} OR regexp_matches(low, 'p[012]=0')) THEN 'outcome'
  WHEN {_DIRECTIVE} OR (usr AND (regexp_matches(low, '^(intent:|\[intent\])') OR regexp_matches(x, '(?i)(?:^|[^A-Za-z0-9])P[012](?:[^A-Za-z0-9]|$)') OR {SAYS})) THEN 'intent' END) END AS kind FROM k0),
k2 AS (SELECT *, {_COMPACT % f"CASE WHEN task <> '' THEN task WHEN kind = 'decision' THEN {_unlabelled(_BARE, _LABELS['decision'])} WHEN kind = 'outcome' THEN {_unlabelled(_BARE, _LABELS['outcome'])} WHEN kind = 'intent' THEN {_unlabelled(_BARE, _LABELS['intent'])} ELSE {_BARE} END"} AS sm,
  nullif(array_to_string(list_filter([CASE WHEN NOT {_METADATA % (_TRIM % 'before')} AND NOT {_PRINTED % ('before', 'before')} THEN {_COMPACT % 'before'} END, CASE WHEN NOT {_METADATA % (_TRIM % 'behind')} AND NOT {_PRINTED % ('behind', 'behind')} THEN {_COMPACT % 'behind'} END], lambda z: z <> ''), ' | '), '') AS around
  FROM k1 WHERE kind IS NOT NULL AND NOT (kind = 'outcome' AND frame_kind = 'agent_reply')),
k3 AS (SELECT *, CASE WHEN lower(around) <> lower(sm) AND len(list_filter(list_transform(string_split(around, '|'), lambda z: {_TRIM % 'z'}), lambda z: NOT regexp_matches(z, '^[0-9.)]*[0-9][0-9.)]*(?:\s+\S+){{0,3}}$'))) > 0 THEN CASE WHEN strlen(around) > 240 THEN substr(around, 1, list_max(list_filter(range(60, 241), lambda n: strlen(substr(around, 1, n)) <= 240))) || '...[truncated]' ELSE around END END AS context, len(list_filter(regexp_split_to_array(sm, '\s+'), lambda z: z <> '')) AS nw FROM k2),
k4 AS (SELECT *, {_TOKENS % "concat_ws(' ', sm, context)"} AS named FROM k3
  WHERE sm <> '' AND NOT regexp_matches(sm, '^[\s.`*_-]*$') AND NOT (nw <= 4 AND regexp_matches(sm, '^[0-9.)]*[0-9][0-9.)]*(\s|$)')) AND NOT (ends_with(sm, ':') AND nw <= 4 AND NOT contains(sm, '://')) AND NOT (regexp_matches(sm, '^[0-9]+[.)]*(\s|$)') AND (contains(sm, '`') OR regexp_matches(lower(sm), ' when the |must |should ')))),
ca AS (SELECT * EXCLUDE (type, line), CASE WHEN usr AND task = '' AND {KIND_OF % (('type',) * 4)} = kind THEN type ELSE kind END AS type, list_filter(named, lambda t, i: list_position(list_transform(named, lambda y: lower(y)), lower(t)) = i) AS evidence,
  CASE WHEN strlen(sm) <= 480 THEN sm WHEN regexp_matches(substr(sm, 401, 80), '[.!?]') THEN rtrim(substr(sm, 1, 400) || regexp_extract(substr(sm, 401, 80), '(?s)^(.*[.!?])', 1)) WHEN regexp_matches(substr(sm, 401, 80), '[,;:]') THEN rtrim(substr(sm, 1, 400) || regexp_extract(substr(sm, 401, 80), '(?s)^(.*)[,;:]', 1)) || ' …' WHEN contains(substr(sm, 401, 80), ' ') THEN rtrim(substr(sm, 1, 400) || regexp_extract(substr(sm, 401, 80), '(?s)^(.*) ', 1)) || ' …' ELSE substr(sm, 1, 480) || ' …' END AS summary,
  least(5, CASE kind WHEN 'intent' THEN 2 ELSE 3 END + CASE WHEN context IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN len(named) > 0 THEN 1 ELSE 0 END + CASE WHEN kind = 'intent' AND regexp_matches(sm, '(?i)(?:^|[^A-Za-z0-9])P[012](?:[^A-Za-z0-9]|$)') THEN 1 ELSE 0 END) AS confidence,
  CASE WHEN mark = ' ' THEN 'open' WHEN lower(mark) = 'x' THEN 'done' END AS state, lower({_COMPACT % 'summary'}) AS key FROM k4
  WHERE NOT (kind = 'intent' AND context IS NULL AND len(named) = 0 AND (regexp_matches(lower(sm), 'arozet|injust|yym|ehem|ten tego|yyy|eee|hmmm') OR (nw > 15 AND NOT regexp_matches(sm, '[,.;?!]')))))"""


def _lines(spark, sf_dir):
    rows = linerules.message_lines(directives(spark, sf_dir), "source_seq", "role")
    return rows.withColumn("line", T.trimmed(F.col("line")))


@query(f"WITH {LINES_SQL} SELECT source_seq, line_no, type, CAST(c AS DOUBLE) AS confidence FROM ty WHERE line <> ''")
def i06_line_types(spark, sf_dir):
    e = linerules.entry_type(F.col("line"), F.lower("role") == "user")
    return _lines(spark, sf_dir).where("line <> ''").withColumn("e", e).select("source_seq", F.col("line_no").cast("long").alias("line_no"), "e.type", "e.confidence")


_REREAD = f"SELECT *, (['intent', 'decision', 'outcome'])[source_seq % 3 + 1] AS declared, {TYPED} AS typed FROM (SELECT * REPLACE (false AS usr) FROM fc WHERE line <> '')"


@query(f"WITH {LINES_SQL}, rr AS (SELECT source_seq, line_no, declared, {KIND_OF % (('typed.t',) * 4)} AS read, typed IS NOT NULL AS sure FROM ({_REREAD})) SELECT source_seq, line_no, CASE WHEN NOT sure THEN declared ELSE read END AS kind, CASE WHEN NOT sure OR read = declared THEN 'signals' WHEN read IS NOT NULL THEN 'signals:revalidated(' || declared || '->' || read || ')' END AS source, CASE WHEN NOT sure OR read = declared THEN true WHEN read IS NOT NULL THEN false END AS trusted FROM rr")
def i09_revalidated(spark, sf_dir):
    declared = F.element_at(F.array(*map(F.lit, ("intent", "decision", "outcome"))), (F.col("source_seq") % 3 + 1).cast("int"))
    rows = _lines(spark, sf_dir).where("line <> ''").withColumn("v", linerules.revalidated(declared, F.col("line")))
    return rows.select("source_seq", F.col("line_no").cast("long").alias("line_no"), "v.kind", "v.source", "v.trusted")


@query(f"WITH {LINES_SQL} SELECT source_seq, line_no, {SAYS} AS says FROM fc")
def u11_keywords(spark, sf_dir):
    return _lines(spark, sf_dir).select("source_seq", F.col("line_no").cast("long").alias("line_no"), linerules.says(linerules.INTENTS, F.col("line")).alias("says"))


@query(rf"""WITH {LINES_SQL}, w AS (SELECT *, list_transform(regexp_split_to_array(regexp_replace(regexp_replace(x, '^[-*+]+', ''), '^\s+|\s+$', '', 'g'), '\s+'), lambda z: regexp_replace(z, '^[^\pL\pN_]+|[^\pL\pN_]+$', '', 'g')) AS ws FROM fc)
SELECT source_seq, line_no, {_METADATA % 'x'} AS metadata, {_PRINTED % ('x', 'x')} AS printed, regexp_matches(x, '^[^(]*\(([^)]*[^)=<>!])?=([^=)]|\))') OR (len(list_filter(ws, lambda z: regexp_matches(z, '^[A-Z0-9_]+$') AND contains(z, '_') AND regexp_matches(z, '[A-Z]'))) > 0 AND len(list_filter(ws, lambda z: regexp_matches(z, '^\pL+$') AND regexp_matches(z, '\p{{Ll}}'))) <= 1) AS code FROM w""")
def f19_line_classes(spark, sf_dir):
    line = F.col("line")
    return _lines(spark, sf_dir).select("source_seq", F.col("line_no").cast("long").alias("line_no"), linerules.is_source_metadata(line).alias("metadata"), linerules.is_command_output(line).alias("printed"), linerules.is_code_fragment(line).alias("code"))


@query(f"WITH {LINES_SQL} SELECT source_seq, line_no FROM ln WHERE {COMMIT % 'line'} AND (coalesce({COMMIT % 'before'}, false) OR coalesce({COMMIT % 'behind'}, false))")
def f20_commit_blocks(spark, sf_dir):
    rows = linerules.message_lines(directives(spark, sf_dir), "source_seq")
    return rows.where(linerules.in_commit_block()).select("source_seq", F.col("line_no").cast("long").alias("line_no"))


@query(f"WITH {LINES_SQL} SELECT source_seq, put AND role = 'user' AS injected FROM l0")
def f16_injected(spark, sf_dir):
    return directives(spark, sf_dir).select("source_seq", linerules.is_injected(F.col("role"), F.col("message")).alias("injected"))


@query(f"WITH {LINES_SQL} SELECT source_seq, line_no, sha256(summary) AS sha, array_to_string(evidence, ' ') AS evidence, sha256(coalesce(context, '')) AS context FROM ca")
def d16_u05_evidence(spark, sf_dir):
    found = intents.candidates(directives(spark, sf_dir))
    return found.select("source_seq", F.col("line_no").cast("long").alias("line_no"), sha("summary"), F.array_join("evidence", " ").alias("evidence"), F.sha2(F.coalesce("context", F.lit("")), 256).alias("context"))


@query(f"WITH {LINES_SQL} SELECT source_seq, line_no, regexp_matches(' ' || lower(line) || ' ', ' (disabled|rejected|reverted|withdrawn|no longer|do not |don''t |never |instead of |wyłączon|odrzucon|cofnięt|wycofan|nie robimy|nie używ|już nie|nigdy |zamiast )') <> regexp_matches(' ' || lower(behind) || ' ', ' (disabled|rejected|reverted|withdrawn|no longer|do not |don''t |never |instead of |wyłączon|odrzucon|cofnięt|wycofan|nie robimy|nie używ|już nie|nigdy |zamiast )') AS veto FROM ln WHERE behind IS NOT NULL")
def u24_vetoes(spark, sf_dir):
    rows = linerules.message_lines(directives(spark, sf_dir), "source_seq").where("behind is not null")
    return rows.select("source_seq", F.col("line_no").cast("long").alias("line_no"), overlay.vetoed(F.col("line"), F.col("behind")).alias("veto"))


def _session_lines(spark, sf_dir):
    """The lines of each session in order, some with tags of speech and marks of blocks before and behind them."""
    rows = linerules.message_lines(directives(spark, sf_dir), "session_id", "turn", "source_seq")
    seven = F.col("source_seq") % 7
    first = F.col("line_no") == 0
    line = F.concat(F.when(first & (seven == 1), "<voice id=1>").when(first & (seven == 4), "[read]").otherwise(""), "line", F.when(first & (seven == 2), " </voice>").when(first & (seven == 5), "[/read]").otherwise(""))
    return rows.select(F.col("session_id").alias("text_id"), (F.col("turn") * 64 + F.col("line_no")).alias("line_no"), line.alias("line"))


_SESSION = f"{LINES_SQL}, sl AS (SELECT session_id AS text_id, turn * 64 + line_no AS line_no, line, line_no = 0 AS first, source_seq % 7 AS k FROM ln)"


@query(rf"WITH {_SESSION}, v AS (SELECT text_id, line_no, CASE WHEN first AND k = 4 THEN '[read]' ELSE '' END || line || CASE WHEN first AND k = 5 THEN '[/read]' ELSE '' END AS line, first AND k = 1 AS begun, CASE WHEN first AND k = 1 THEN 1 WHEN first AND k = 2 THEN 0 END AS made FROM sl) SELECT text_id, line_no, md5({_TRIM % 'line'}) AS line, begun OR coalesce(last_value(made IGNORE NULLS) OVER (PARTITION BY text_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS spoken FROM v")
def u26_voice_lines(spark, sf_dir):
    return machines.voice_lines(_session_lines(spark, sf_dir)).select("text_id", "line_no", F.md5("line").alias("line"), "spoken")


@query(f"WITH {_SESSION}, v AS (SELECT text_id, line_no, CASE WHEN first AND k = 4 THEN 1 WHEN first AND k = 5 THEN 0 END AS made FROM sl) SELECT text_id, line_no FROM (SELECT *, coalesce(last_value(made IGNORE NULLS) OVER (PARTITION BY text_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM v) WHERE made IS NULL AND inside = 0")
def f23_read_blocks(spark, sf_dir):
    return machines.outside_blocks(_session_lines(spark, sf_dir), "[read]", "[/read]").select("text_id", "line_no")


@query()
def w11_line_classes(spark, sf_dir):
    rows, line = _session_lines(spark, sf_dir), F.col("line")
    own = linerules.entry_type(line, F.lit(False))["type"].isNotNull()
    flags = {"noise": linerules.is_source_metadata(line) | linerules.is_command_output(line), "signal": own, "header": F.startswith(line, F.lit("[read]")), "footer": linerules.is_code_fragment(line), "exit": F.startswith(line, F.lit("<voice"))}
    return machines.line_classes(linerules.once(rows, **flags))
