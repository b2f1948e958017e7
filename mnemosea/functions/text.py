"""Text functions on columns: search terms, tokens, kinds, secrets, artifacts, redaction.

All are Catalyst expressions, so they stay in whole-stage code generation. Regular
expressions avoid ``\\b`` and ``\\s``, which the JVM and RE2 read differently.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "i", "in", "is", "it",
    "of", "on", "or", "that", "the", "to", "was", "were", "with", "you",
)
SECRET = r"(?i)(api[_-]?key|token|password|secret)"
ARTIFACT = r"""(?i)(file://[^\t\n\f\r "'`]+|https?://[^\t\n\f\r "'`]+|/(?:Users|home|tmp|var|etc|opt)/[^\t\n\f\r "'`]+)"""
DECISION_WORDS = ("decision", "方針", "採用", "却下")
RATIONALE_WORDS = ("reason", "理由", "tradeoff", "トレードオフ")
TASK_WORDS = ("todo", "next step", "action item")
DEBUG_WORDS = ("error", "debug", "stack trace")
PROMOTABLE = ("decision", "task_candidate", "rationale", "debug_trace")
#: Accented letters and what they fold to; one table for queries and documents.
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"
TERM_BREAK = r"[\t\n\x0B\f\r\x{85}\p{Z}\p{P}]+"
TOKEN_BREAK = r"[^\p{L}\p{Nd}]+"
INDEX_BREAK = r"[^\p{L}\p{N}\p{Co}]+"


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def search_terms(query: Column) -> Column:
    """Distinct lower-case terms of at least two bytes, in order of appearance."""
    return F.array_distinct(F.filter(F.split(F.lower(query), TERM_BREAK), lambda t: F.octet_length(t) >= 2))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it. Within a lambda a
    plain expression would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def term_match_score(terms: Column, text: Column) -> Column:
    """How many of the terms are within the lower-case text."""
    return let(F.lower(text), lambda low: F.size(F.filter(terms, lambda t: F.contains(low, t))))


def tokens(text: Column) -> Column:
    """Letters-and-digits runs without stop words, as the local embedding uses them."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda t: (t != "") & ~F.array_contains(stop, t))


def index_tokens(text: Column) -> Column:
    """Tokens of the full-text index: lower case, accents folded."""
    fold = lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(F.translate(t, ACCENTED, FOLDED))
    return F.transform(F.filter(F.split(F.lower(text), INDEX_BREAK), lambda t: t != ""), fold)


def trigrams(text: Column) -> Column:
    """The trigrams of a short text, such as a query's term."""
    return let(F.lower(text), lambda low: F.when(F.length(low) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>")))


def chunk_kind(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(any_of(low, DECISION_WORDS), "decision")
        .when(any_of(low, RATIONALE_WORDS), "rationale")
        .when(any_of(low, TASK_WORDS), "task_candidate")
        .when(any_of(low, DEBUG_WORDS), "debug_trace")
        .otherwise("qa_pair")
    )


def sensitivity(default: Column, text: Column) -> Column:
    return F.when(text.rlike(SECRET), "secret").otherwise(default)


def candidate_subject(kind: Column, text: Column) -> Column:
    """The first line without a leading label, at most 80 characters; the kind if that is empty."""
    trim = lambda c: F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))
    line = F.substring_index(trim(text), "\n", 1)
    at = F.instr(line, ":")
    rest = F.when((at > 0) & (at < F.length(line)), F.substring(line, at + 1, F.length(line))).otherwise(line)
    subject = F.substring(trim(rest), 1, 80)
    return F.when(subject == "", kind).otherwise(subject)


_WORD_START, _WORD_END = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"


def redact(text: Column, policy: str = "default") -> Column:
    """Secrets, bearer tokens, file URIs and home paths replaced; ``strict`` also drops URL schemes."""
    if policy not in ("", "default", "strict"):
        raise ValueError(f"unknown redaction policy {policy!r}")
    out = F.regexp_replace(text, rf"(?i){_WORD_START}(api[_-]?key|token|password|secret){_WORD_END}[\t\n\f\r ]*[:=][\t\n\f\r ]*[^\t\n\f\r ]+", "$1=[REDACTED]")
    out = F.regexp_replace(out, rf"(?i){_WORD_START}bearer[\t\n\f\r ]+[a-z0-9._-]+", "Bearer [REDACTED]")
    out = F.regexp_replace(out, r"""file://[^\t\n\f\r "']+""", "file://[REDACTED_PATH]")
    out = F.regexp_replace(out, r"""/(Users|home)/[^\t\n\f\r "']+""", "[REDACTED_PATH]")
    if policy == "strict":
        out = F.replace(F.replace(out, F.lit("http://"), F.lit("")), F.lit("https://"), F.lit(""))
    return out


def redact_uri(uri: Column, policy: str = "default") -> Column:
    clean = F.trim(uri)
    if policy == "strict":
        return F.lit("")
    return F.when((clean == "") | clean.startswith("/") | F.lower(clean).startswith("file://"), "").otherwise(clean)


def base_name(uri: Column) -> Column:
    """The last path element, as a path cleaner names it."""
    path = F.regexp_replace(F.regexp_replace(uri, "^file://", ""), "(?<=.)/+$", "")
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(path == "", ".").when(name == "", "/").otherwise(name)


def relation_of_promotion(text: Column, has_reasoning: Column) -> Column:
    """The edge that promoted chunks suggest: contradicts, supports, or null."""
    low = F.lower(text)
    return F.when(any_of(low, ("contradict", "instead", "やめる", "却下")), "contradicts").when(has_reasoning, "supports")


def first_non_empty(*values: Column) -> Column:
    out = F.lit("")
    for v in reversed(values):
        out = F.when(F.trim(F.coalesce(v, F.lit(""))) != "", v).otherwise(out)
    return out
