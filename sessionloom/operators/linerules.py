"""What a line of a message is: an ordered table of rules, compiled to one expression.

A rule has a type, a confidence and a test over the facts of a line: the line in lower case, its head without white space
around it, the same without inline code, and whether a user said it. The first rule that holds decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import severity, trimmed
from sessionloom.operators.search import modality
from sessionloom.operators.signals import INTENTS, METADATA, RESULTS

# The phrases, in English and Polish, that the types are recognised by.
TASK_HEADS = ("task:", "todo:", "zadanie:")
TASK_ACTIONS = (
    "stworz", "stwórz", "utworz", "utwórz", "dodaj", "napraw", "popraw", "zbuduj", "przygotuj", "zapisz", "spisz", "wypisz", "zaimplementuj", "podlacz", "podłącz", "skopiuj", "przekopiuj", "uruchom", "odpal",
    "create", "add", "fix", "update", "implement", "write", "run", "copy",
)
COMMITMENT_HEADS = ("commitment:", "promise:", "obietnica:", "zrobie", "zrobię", "zajme sie", "zajmę się", "i will ", "i'll ")
QUESTIONS = (
    "how do", "how does", "how to", "what is", "what are", "why does", "why is", "can we", "should we", "is it possible", "does it", "do we", "jak ", "dlaczego ", "czy ", "co to ", "co jest", "w jaki sposób",
)
POLICIES = (
    "nie fixujemy", "nie robimy", "nie ruszamy", "out of scope", "poza scope", "od teraz", "from now on", "canonical", "kanonicz", "default", "domysln", "domyśln", "tylko przez", "bez zgadywania", "bez fallback",
    "no fallback", "musi mieć", "musi miec", "ma byc dodatkiem", "ma być dodatkiem",
)
REQUIREMENTS = ("nie może być", "nie moze byc", "ma być", "ma byc", "musi ", "musimy ", "trzeba ", "zrób to testowalne", "zrob to testowalne", "pełny ownership", "pelny ownership", "teraz wypuszuj")
ASSUMPTION_HEADS = ("assumption:", "hypothesis:", "zakładam", "zakladam", "założenie:", "zalozenie:", "hipoteza:")
ASSUMPTIONS = ("i assume", "assuming", "i believe", "we assume", "hypothesis:", "zakładam", "zakladam", "założenie:", "zalozenie:", "hipoteza:", "przypuszczam")
INSIGHT_HEADS = ("insight:", "odkrycie:", "wniosek:", "kluczowe:")
INSIGHTS = ("insight:", "realization:", "key finding:", "★ insight", "the real issue is", "fundamentally,", "odkrycie:", "wniosek:", "kluczowe:")
COMPLETIONS = (
    "zostal dodany", "został dodany", "zostala dodana", "została dodana", "zostaly dodane", "zostały dodane", "zostal utworzony", "został utworzony", "has been added", "was added", "has been created", "was created",
)
COUNTED = (" records", " rekord", " wynik")
GAVE = (" dal ", " dał ", "dala ", " dała ", "yielded", "produced", "gave")
RESULTS_STRICT = ("passed", "failed", "score=", "score:", "latency", "p0=", "p1=", "p2=", "/10", "clippy", "cargo test", "✓", "✗", "0 warnings", "0 errors")
RESULTS_SOFT = ("tests ", "error:")
RESULT_SHAPE = ("pass", "fail", " ok", "ok.", "done", "skipped", "ignored", "timeout", "panicked", "panic:", "✓", "✗")
ARGUMENTS = ("on the other hand", "alternatively", "disagree", "counterpoint", "trade-off", "tradeoff", "but if we", "however,", "z drugiej strony", "alternatywnie", "spór:", "kontrargument")
REASONS = ("why:", "because", "the reason", "this is needed", "motivated by", "driven by", "root cause", "underlying issue", "bo ", "ponieważ", "dlatego że", "przyczyna:", "powód:")
NEGATORS = ("nie ", "bez ", "don't ", "do not ", "won't ", "will not ", "shouldn't ", "should not ", "wouldn't ", "would not ", "isn't ", "aren't ", "doesn't ", "didn't ")
AFFIRMATIONS = ("zrobione", "dowiezione", "gotowe", "dziala", "działa", "done", "completed")
COMMAND_OUTPUT = ("<local-command-caveat", "</local-command-caveat", "<bash-stdout", "</bash-stdout", "<bash-stderr", "</bash-stderr")
SHELL_HEADERS = (
    "issuer:", "subject:", "subjectaltname:", "ssl certificate", "alpn:", "http/", "server:", "content-type:", "x-ratelimit-", "x-request-id:", "strict-transport-security:", "content-security-policy:",
    "referrer-policy:", "permissions-policy:",
)
INJECTED = ("<command-message>", "<command-name>", "<local-command-caveat>", "<bash-input>", "<bash-stdout>", "<bash-stderr>", "<system-reminder>", "Base directory for this skill:")
COMMIT_VERBS = (
    "Add", "Fix", "Update", "Remove", "Refactor", "Implement", "Create", "Delete", "Move", "Rename", "Drop", "Bump", "Split", "Harden", "Allow", "Stabilize", "Port", "Merge", "Revert", "Close", "Resolve",
    "Improve", "Switch", "Enable", "Disable", "Replace", "Extract", "Introduce", "Wire", "Guard", "Expose", "Prevent", "Support",
)
COMMIT_TYPES = ("feat", "fix", "chore", "docs", "refactor", "test", "perf", "build", "ci", "style", "revert", "ops", "polish", "release")
#: What a type counts as on the timeline; the other types count as nothing.
KINDS = {"decision": "decision", "task": "task", "intent": "intent", "question": "intent", "why": "intent", "outcome": "outcome", "result": "outcome"}
#: Rules of less confidence do not count.
LEAST = 0.5
_WORD = r"[\p{IsAlphabetic}\p{N}_]"


def _either(phrases) -> str:
    return "(?:" + "|".join(map(re.escape, phrases)) + ")"


@dataclass(frozen=True)
class Line:
    """The facts of a line that tests are made of."""

    raw: Column
    user: Column
    low: Column
    head: Column

    @classmethod
    def of(cls, raw: Column, user: Column) -> Line:
        return cls(raw, user, F.lower(raw), trimmed(F.lower(raw)))

    def holds(self, *phrases: str) -> Column:
        return self.low.rlike(_either(phrases))

    def begins(self, *phrases: str) -> Column:
        return self.low.rlike(r"^\s*" + _either(phrases))

    def typed(self, what: str) -> Column:
        return self.user & (modality(F.lit("user"), self.raw) == what)


Test = Callable[[Line], Column]


def says(keywords, line: Column) -> Column:
    """Whether a keyword stands in a line as words of its own, outside inline code, with no negation beside it."""
    low = F.regexp_replace(F.lower(line), "`[^`]*`", "``")
    before = rf"(?<!{_WORD})(?<!-)" + "".join(f"(?<!{re.escape(n)})" for n in NEGATORS)
    return low.rlike(before + _either(sorted(keywords, key=len, reverse=True)) + rf"(?!{_WORD})(?! (?:not|nie)[ ,.])")


def is_decision_tag(line: Column) -> Column:
    return F.lower(line).rlike(r"\[decision\]|^decision:")


def is_outcome_tag(line: Column) -> Column:
    return F.lower(line).rlike(r"\[skill_outcome\]|^(?:outcome|validation):")


def is_affirmation(line: Column) -> Column:
    """Whether a line is nothing but a word of assent: done, and no word of what."""
    bare = F.regexp_replace(F.regexp_replace(trimmed(line), r"[.!,]+$", ""), r"^[-*+> \t]+", "")
    return F.lower(bare).isin(*AFFIRMATIONS)


def is_outcome_line(line: Column) -> Column:
    return ~is_affirmation(line) & (is_outcome_tag(line) | F.lower(line).rlike(_either((*RESULTS, "p0=0", "p1=0", "p2=0"))))


def is_policy(line: Column) -> Column:
    return F.lower(line).rlike(_either(POLICIES))


def is_requirement(line: Column) -> Column:
    return F.lower(line).rlike(_either(REQUIREMENTS))


#: In order: type, confidence, whether only users' lines count, test.
RULES: tuple[tuple[str, float, bool, Test], ...] = (
    ("decision", 0.95, False, lambda x: x.begins("decision:") | x.holds("[decision]")),
    ("task", 0.95, False, lambda x: x.begins(*TASK_HEADS)),
    ("task", 0.85, True, lambda x: x.begins("[ ] ", "[x] ")),
    ("task", 0.75, True, lambda x: x.low.rlike(rf"^\s*[-*+]*\s*(?=\S+\s+\S+\s+\S){_either(TASK_ACTIONS)}[ :]")),
    ("commitment", 0.72, False, lambda x: x.begins(*COMMITMENT_HEADS)),
    ("question", 0.95, False, lambda x: x.begins("question:") & (x.holds(*QUESTIONS) | F.endswith(x.head, F.lit("?")))),
    ("question", 0.7, False, lambda x: ~x.begins("question:") & F.endswith(x.head, F.lit("?")) & (F.octet_length(x.head) > 15)),
    ("decision", 0.75, True, lambda x: is_policy(x.raw)),
    ("intent", 0.7, True, lambda x: is_requirement(x.raw)),
    ("assumption", 0.9, False, lambda x: x.begins(*ASSUMPTION_HEADS)),
    ("assumption", 0.65, False, lambda x: x.holds(*ASSUMPTIONS)),
    ("insight", 0.9, False, lambda x: x.begins(*INSIGHT_HEADS) | x.holds("★ insight")),
    ("insight", 0.65, False, lambda x: x.holds(*INSIGHTS)),
    ("outcome", 0.9, False, lambda x: is_outcome_tag(x.raw)),
    ("outcome", 0.72, False, lambda x: x.holds(*COMPLETIONS) & x.low.rlike(r"^(?:plik |file |docs/)|\.md|\.rs|/")),
    ("outcome", 0.72, False, lambda x: x.low.rlike("[0-9]") & x.holds(*COUNTED) & x.holds(*GAVE)),
    ("result", 0.95, False, lambda x: x.begins("result:", "wynik:")),
    ("result", 0.75, False, lambda x: x.holds(*RESULTS, *RESULTS_STRICT)),
    ("result", 0.6, False, lambda x: x.holds(*RESULTS_SOFT) & (x.low.rlike("[0-9]") | x.holds(*RESULT_SHAPE))),
    ("argue", 0.6, False, lambda x: x.holds(*ARGUMENTS)),
    ("why", 0.7, False, lambda x: x.holds(*REASONS)),
    ("intent", 0.8, True, lambda x: x.typed("typed_directive")),
    ("intent", 0.7, True, lambda x: says(INTENTS, x.raw)),
)


def compiled(rules, line: Line, last: Column) -> Column:
    """CASE over the rules in order."""
    found = None
    for kind, confidence, users_only, test in rules:
        value = F.struct(F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"))
        holds = line.user & test(line) if users_only else test(line)
        found = F.when(holds, value) if found is None else found.when(holds, value)
    return found.otherwise(last)


def entry_type(line: Column, user: Column) -> Column:
    """struct(type, confidence) of a line, nulls where no rule holds or a user pasted it."""
    none = F.struct(F.lit(None).cast("string").alias("type"), F.lit(None).cast("double").alias("confidence"))
    facts = Line.of(line, user)
    return F.when(facts.typed("pasted_reference"), none).otherwise(compiled(RULES, facts, none))


def kind_of_type(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), kind)


def line_kind(line: Column, user: Column, entry: Column) -> Column:
    """decision, task, intent, outcome or null: by a user's ``entry`` (type, confidence) where it has a kind, else by marks."""
    facts = Line.of(line, user)
    typed = F.when(user & (entry["confidence"] >= LEAST), kind_of_type(entry["type"]))
    marks = F.when(is_decision_tag(line) | (user & is_policy(line)), "decision").when(user & is_requirement(line), "intent").when(is_outcome_line(line), "outcome")
    wants = F.lower(line).rlike(r"^(?:intent:|\[intent\])") | severity(line).isNotNull() | says(INTENTS, line)
    marks = marks.when(facts.typed("typed_directive") | (user & wants), "intent")
    return F.when(~facts.typed("pasted_reference"), F.coalesce(typed, marks))


def revalidated(declared: Column, payload: Column) -> Column:
    """struct(kind, source, trusted) of a line that stands in a section of a kind; null where it is confidently something else.

    A line that reads as the section says, or as nothing, is trusted; one that reads as another kind is that kind.
    """
    entry = entry_type(payload, F.lit(False))
    read, sure = kind_of_type(entry["type"]), F.coalesce(entry["confidence"] >= LEAST, F.lit(False))
    verdict = lambda kind, source, trusted: F.struct(kind.alias("kind"), source.alias("source"), F.lit(trusted).alias("trusted"))
    agrees = verdict(declared, F.lit("signals"), True)
    other = verdict(read, F.concat(F.lit("signals:revalidated("), declared, F.lit("->"), read, F.lit(")")), False)
    return F.when(~sure | (read == declared), agrees).when(read.isNotNull(), other)


def is_command_output(line: Column) -> Column:
    """Whether a line is what a shell or a server printed."""
    own = trimmed(F.regexp_replace(trimmed(line), r"^- ", ""))
    shell = F.lower(F.regexp_replace(own, r"^[*><]+\s*", ""))
    return F.lower(own).rlike("^" + _either(COMMAND_OUTPUT)) | shell.rlike("^" + _either(SHELL_HEADERS))


def is_source_metadata(line: Column) -> Column:
    return F.lower(line).rlike("^" + _either(METADATA))


def is_injected(role: Column, message: Column) -> Column:
    """Whether a user's message was put there by the tool: its head says so."""
    return (role == "user") & F.regexp_replace(message, r"^\s+", "").rlike("^" + _either(INJECTED))


def is_code_fragment(line: Column) -> Column:
    """Whether a line is an identifier or a call rather than prose."""
    own = trimmed(F.regexp_replace(trimmed(line), r"^[-*+]+", ""))
    inside = F.regexp_extract(own, r"^[^(]*\(([^)]*)\)", 1)
    words = F.transform(F.split(own, r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{IsAlphabetic}\p{N}_]+|[^\p{IsAlphabetic}\p{N}_]+$", ""))
    constant = r"^(?=.*_)(?=.*[A-Z])[A-Z0-9_]+$"
    prose = F.filter(words, lambda w: ~w.rlike(constant) & w.rlike(r"^\p{IsAlphabetic}+$") & w.rlike(r"\p{IsLowercase}"))
    return inside.rlike(r"(?:^|[^=<>!])=(?!=)") | (F.exists(words, lambda w: w.rlike(constant)) & (F.size(prose) <= 1))


def is_commit_line(line: Column) -> Column:
    """Whether a line reads like an entry of a log of commits."""
    own = trimmed(F.regexp_replace(trimmed(line), r"^[-*+>]+", ""))
    return own.rlike(rf"^(?:[0-9a-fA-F]{{7,40}}|{_either(COMMIT_VERBS)})\s+\S|^{_either(COMMIT_TYPES)}(?:\([^)]*\))?: \s*\S")


def is_bare_heading(summary: Column) -> Column:
    """Whether a summary is a heading, a number or a rule and says nothing by itself."""
    x, n = trimmed(summary), F.size(F.filter(F.split(summary, r"\s+"), lambda w: w != ""))
    numbered = x.rlike(r"^[0-9.)]*[0-9][0-9.)]*(?:\s|$)")
    item = x.rlike(r"^[0-9]+[.)]*(?:\s|$)") & (F.contains(x, F.lit("`")) | F.lower(x).rlike(" when the |must |should "))
    return x.rlike(r"^[\s.`*_-]*$") | (numbered & (n <= 4)) | (F.endswith(x, F.lit(":")) & (n <= 4) & ~F.contains(x, F.lit("://"))) | item


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further columns behind a generator of one row, through which no filter is pushed: each is computed once."""
    return rows.select("*", F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))).alias("_once")).select("*", "_once.*").drop("_once")


def message_lines(messages: DataFrame, *kept: str) -> DataFrame:
    """A row for each line of ``message``: line_no, line, and the lines before and behind, without a shuffle."""
    lines = F.split("message", r"\r?\n")
    none = F.array(F.lit(None).cast("string"))
    both = F.arrays_zip(lines.alias("line"), F.concat(none, F.slice(lines, 1, F.size(lines))).alias("before"), F.concat(F.slice(lines, 2, F.size(lines)), none).alias("behind"))
    rows = messages.select(*kept, F.posexplode(both).alias("line_no", "x"))
    return rows.select(*kept, "line_no", F.col("x.line").alias("line"), F.col("x.before").alias("before"), F.col("x.behind").alias("behind")).where("line is not null")


def in_commit_block() -> Column:
    """Whether a line of ``message_lines`` stands in a run of two or more lines like commits."""
    beside = F.coalesce(is_commit_line(F.col("before")), F.lit(False)) | F.coalesce(is_commit_line(F.col("behind")), F.lit(False))
    return is_commit_line(F.col("line")) & beside
