"""Text functions on columns: normalisation, sizes in bytes, markers, tokens, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Polish letters and what they fold to.
FOLD_FROM, FOLD_TO = "ĄąĆćĘęŁłŃńÓóŚśŹźŻż", "aacceellnnoosszzzz"
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]"
#: Credential shapes as their vendors document them, in the order in which they are replaced; what is kept
#: of a match stands as $1.
SECRETS = (
    (r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", "[REDACTED_KEY]"),
    (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "[REDACTED_AWS]"),
    (r"\bAIza[0-9A-Za-z_-]{35}", "[REDACTED_TOKEN]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", "[REDACTED_TOKEN]"),
    (r"\bgithub_pat_[A-Za-z0-9_]{20,}", "[REDACTED_TOKEN]"),
    (r"\bglpat-[A-Za-z0-9_-]{20,}", "[REDACTED_TOKEN]"),
    (r"\bsk-(?:ant-api[0-9]{2}-|proj-)?[A-Za-z0-9_-]{20,}", "[REDACTED_TOKEN]"),
    (r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{24,}", "[REDACTED_TOKEN]"),
    (r"\bwhsec_[A-Za-z0-9]{20,}", "[REDACTED_TOKEN]"),
    (r"\bxox[abprs]-[A-Za-z0-9-]{10,}", "[REDACTED_TOKEN]"),
    (r"\bxapp-[0-9]-[A-Za-z0-9-]{10,}", "[REDACTED_TOKEN]"),
    (r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[REDACTED_JWT]"),
    (r"(?i)\b(bearer)\s+[A-Za-z0-9._~+/-]{12,}=*", "$1 [REDACTED]"),
    (r"(?i)\b((?:x-api-key|x-auth-token|api-key)\s*:\s*)\S+", "$1[REDACTED]"),
    (r"(?m)^(\s*(?:export\s+)?[A-Z][A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD)\s*=\s*)\S+", "$1[REDACTED]"),
    (r"(?i)\b((?:api[_-]?key|secret|token|password|passwd)\s*[:=]\s*)[^\s'\"]{6,}", "$1[REDACTED]"),
    (r"([a-z][a-z0-9+.-]*://)[^/\s:@]+:[^/\s@]+@", "$1[REDACTED]@"),
)
#: Every match of a credential shape holds one of these; texts without any are left as they are.
HINTS = r"(?i)key|akia|asia|aiza|gh[pousr]_|github_pat_|glpat-|[rs]k[-_]|whsec_|xox|xapp-|eyj|bearer|x-auth|token|secret|passw|://"


def normalize_query(x: Column) -> Column:
    return F.lower(F.translate(x, FOLD_FROM, FOLD_TO))


def normalize_key(x: Column) -> Column:
    """Without invisible characters, white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, INVISIBLE, ""), r"\s+", " ")))


def estimate_tokens(x: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(x) / 4).cast("long")


def compact(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def trimmed(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def byte_cut(x: Column, most: int, mark: str = "...[truncated]") -> Column:
    """A text of over ``most`` bytes cut there, at the start of a character, with a mark behind."""
    data = F.encode(x, "UTF-8")
    end = F.lit(most)
    for back in (1, 2, 3):  # while the byte behind the cut continues a character
        after = F.hex(F.substring(data, most + 2 - back, 1))
        end = F.when((end == most + 1 - back) & after.between("80", "BF"), most - back).otherwise(end)
    short = F.decode(data.substr(F.lit(1), end), "UTF-8")
    return F.when(F.octet_length(x) > most, F.concat(short, F.lit(mark))).otherwise(x)


def let(x: Column, then) -> Column:
    """``then`` of the value of ``x``, which is computed once however often it stands in ``then``."""
    return F.get(F.transform(F.array(x), then), 0)


def sentence_cut(x: Column, most: int = 480, back: int = 80) -> Column:
    """A text of over ``most`` bytes cut behind its last sentence, else before its last comma or word, of the last ``back`` bytes."""

    def short(head: Column) -> Column:
        near = F.octet_length(head) - back
        behind = lambda n: F.decode(F.encode(head, "UTF-8").substr(n, F.lit(most)), "UTF-8")
        starts = [F.hex(F.encode(head, "UTF-8").substr(near + 1 - k, F.lit(1))).between("80", "BF") for k in range(3)]
        start = near - F.when(~starts[0], 0).when(~starts[1], 1).when(~starts[2], 2).otherwise(3)  # where a character begins
        return let(behind(start + 1), lambda tail: ended(F.left(head, F.length(head) - F.length(tail)), tail, head))

    def ended(front: Column, tail: Column, head: Column) -> Column:
        upto = lambda pattern: F.regexp_replace(F.concat(front, F.regexp_extract(tail, pattern, 1)), r"\s+$", "")
        found = F.when(tail.rlike("[.!?]"), upto(r"(?s)^(.*[.!?])"))
        for stop in (r"[,;:]", r"\s"):
            found = found.when(tail.rlike(stop), F.concat(upto(rf"(?s)^(.*){stop}"), F.lit(" …")))
        return found.otherwise(F.concat(head, F.lit(" …")))

    return F.when(F.octet_length(x) <= most, x).otherwise(let(byte_cut(x, most, ""), short))


#: Endings of files that count as evidence.
EVIDENCE_FILES = (".rs", ".md", ".json", ".jsonl", ".toml", ".yaml", ".yml", ".ts", ".tsx", ".js", ".jsx", ".py", ".sh", ".txt")


def evidence_tokens(x: Column) -> Column:
    """The files with a path, commit hashes and scores that a text names; of equal ones the first."""
    words = F.transform(F.split(x, r"\s+"), lambda t: F.regexp_replace(t, r"""^[,.;:()\[\]{}"']+|[,.;:()\[\]{}"']+$""", ""))
    ending = "|".join(e.replace(".", r"\.") for e in EVIDENCE_FILES)
    is_file = lambda t: F.lower(t).rlike(ending) & (t.rlike(r"[/\\:]") | F.startswith(t, F.lit("src.")))
    is_score = lambda t: F.lower(t).rlike("^(?:p[012]=0$|score[=:])|/10$")
    named = F.filter(words, lambda t: (t != "") & (is_file(t) | t.rlike("^[0-9a-fA-F]{7,40}$") | is_score(t)))
    return let(named, lambda all: F.filter(all, lambda t, i: F.array_position(F.transform(all, normalize_key), normalize_key(t)) == i + 1))


def path_tokens(x: Column) -> Column:
    """The sorted distinct paths that a text names: spans in backticks with a slash, and bare words whose last part has a dot."""
    is_path = lambda t: F.contains(t, F.lit("/")) & ~F.contains(t, F.lit("://")) & ~F.startswith(t, F.lit("~")) & ~F.contains(t, F.lit("*"))
    quoted = F.filter(F.transform(F.regexp_extract_all(x, F.lit("`([^`]*)`"), F.lit(1)), trimmed), lambda t: ~F.contains(t, F.lit(" ")) & is_path(t))
    bare = F.transform(F.split(x, r"\s+"), lambda t: F.regexp_replace(t, r"""^[,.;:()\[\]"']+|[,.;:()\[\]"']+$""", ""))
    bare = F.filter(bare, lambda t: is_path(t) & ~F.startswith(t, F.lit("`")) & F.contains(F.substring_index(t, "/", -1), F.lit(".")))
    return F.array_sort(F.array_distinct(F.concat(quoted, bare)))


def title(x: Column, size: int = 80) -> Column:
    return F.substring(compact(F.element_at(F.split(x, "\n"), 1)), 1, size)


def sanitize(x: Column) -> Column:
    """Without NUL; all line ends are newlines."""
    return F.regexp_replace(F.regexp_replace(x, r"\x00", ""), r"\r\n?", "\n")


def redact(x: Column) -> Column:
    clean = x
    for pattern, instead in SECRETS:
        clean = F.regexp_replace(clean, pattern, instead)
    return F.when(x.rlike(HINTS), clean).otherwise(x)


def checkbox(x: Column) -> Column:
    """open or done for a checklist line, else null."""
    mark = F.regexp_extract(x, r"^\s*[-*+] \[([ xX])\] ", 1)
    return F.when(mark == " ", "open").when(F.lower(mark) == "x", "done")


def severity(x: Column) -> Column:
    """P0, P1 or P2 where one stands as a token of its own."""
    return F.nullif(F.upper(F.regexp_extract(x, r"(?i)(?:^|[^A-Za-z0-9])(P[012])(?:[^A-Za-z0-9]|$)", 1)), F.lit(""))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9._-]+", "-"), r"^-+|-+$", "")


def strip_marks(x: Column) -> Column:
    """Without the bullet, the checkbox and the label that a line begins with."""
    x = F.regexp_replace(x, r"^\s*[-*+] (\[[ xX]\] )?", "")
    return compact(F.regexp_replace(x, r"(?i)^(decision|intent|question|why|result|outcome|task)\s*:\s*", ""))


def hash_tokens(x: Column) -> Column:
    """The distinct words that look like commit hashes: 7 to 40 hex digits with at least one digit."""
    words = F.split(F.lower(x), r"[^0-9a-z]+")
    return F.array_distinct(F.filter(words, lambda w: w.rlike(r"^[0-9a-f]{7,40}$") & w.rlike("[0-9]")))


def words(x: Column, least: int = 1) -> Column:
    """The distinct lower-cased words of at least so many characters."""
    return F.array_distinct(F.filter(F.split(F.lower(x), r"[^0-9a-z]+"), lambda w: F.length(w) >= least))
