"""Text column functions: tokens, terms, phrases, estimates, normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never count as task terms.
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "is", "are", "was", "were", "be", "been", "have",
    "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "can", "that", "this", "these", "those", "it", "its",
    "from", "not", "we", "our", "you", "your", "they", "them", "their",
    "file", "files", "code", "function", "method", "class", "module",
    "use", "using", "used", "how", "what", "when", "where", "why",
]

# Task terms that say little.
GENERIC_TERMS = [
    "add", "added", "change", "changed", "changes", "clean", "cleanup", "code", "commit", "context", "debug", "dev", "development", "doc", "docs", "eval", "evals", "feature", "fix", "freshness", "general",
    "gap", "gaps", "generic", "impl", "implement", "implementation", "improve", "issue", "metric", "metrics", "noise", "noisy", "package", "pack", "packs", "quality", "release", "remaining", "repo", "root", "rule", "rules",
    "source", "stat", "stats", "sync", "task", "tasks", "test", "tests", "text", "update", "use", "useful", "usefulness", "version", "visibility", "workflow", "workflows", "wording",
]
# A conventional commit, in any case; literal phrases and the group that is the phrase; an API path and its parameters.
COMMIT = r"^\s*([a-z][a-z0-9-]*)(?:\(([^)]{1,80})\))?!?:\s*(.+)$"
PHRASES = [
    (r"`([^`]{3,120})`", 1),
    (r'"([^"]{3,120})"', 1),
    (r"'([^']{3,120})'", 1),
    (r"\b[A-Za-z0-9]+(?:[-_/][A-Za-z0-9]+){1,}\b", 0),
]
API_PATH = r"/api/[A-Za-z0-9_./${}\[\]-]+"
API_PARAMETER = r"/\[[^\]]+\]"


def _array(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")


def ordered_tokens(text: Column) -> Column:
    """Identifier tokens in order: camelCase split, lower case, alphanumeric runs."""
    spaced = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-zA-Z0-9]+"), lambda t: t != "")


def path_tokens(path: Column) -> Column:
    """Distinct tokens of a path whose last part has lost its suffix."""
    return F.array_distinct(ordered_tokens(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")))


def match_text(text: Column) -> Column:
    """A task as it is matched: of a conventional commit the kind, the tokens of the scope and the subject, else the text itself."""
    parts = conventional_commit(text)
    said = F.trim(F.concat(parts["kind"], F.lit(" "), F.array_join(ordered_tokens(parts["scope"]), " "), F.lit(" "), parts["subject"]))
    return F.when(parts["kind"].isNotNull(), said).otherwise(text)


def task_terms(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Query terms of three or more characters that are no stopwords, in order, repeats kept."""
    words = F.split(F.lower(match_text(text)), "[^a-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(_array(stopwords), w))


def bigrams(terms: Column, generic: list[str] = ()) -> Column:
    """Distinct two-term phrases in order; phrases of generic terms alone are dropped."""
    # slices, not a look-up by place: an expression that reads terms inside a lambda is evaluated for each of its elements
    pairs = F.zip_with(F.slice(terms, F.lit(1), F.greatest(F.size(terms) - 1, F.lit(0))), F.slice(terms, F.lit(2), F.greatest(F.size(terms) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    if generic:
        own = _array(list(generic))
        pairs = F.filter(pairs, lambda p: ~(F.array_contains(own, p["a"]) & F.array_contains(own, p["b"])))
    return F.array_distinct(F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"])))


def text_bigrams(text: Column) -> Column:
    """bigrams(ordered_tokens(text)) by one search along the text, without an expression for each token.

    A match is a token that another follows; it starts only where a token does, so a
    very long last token is tried once.
    """
    spaced = F.lower(F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])", " "))
    words = F.trim(F.regexp_replace(spaced, "[^a-z0-9]+", " "))
    return F.array_distinct(F.regexp_extract_all(words, F.lit("(?<![^ ])(?=([^ ]++ [^ ]++))[^ ]++"), F.lit(1)))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("bigint")


def singular(word: Column) -> Column:
    """The singular of a plural word of five or more letters; null for generic terms and where no rule applies."""
    n = F.length(word)
    return (
        F.when((n < 5) | word.isin(GENERIC_TERMS), None)
        .when(word.endswith("ies") & (n > 5), F.concat(F.substr(word, F.lit(1), n - 3), F.lit("y")))
        .when(word.rlike("(sses|xes|ches|shes)$") & (n > 5), F.substr(word, F.lit(1), n - 2))
        .when(word.endswith("s") & ~word.rlike("(ss|us|is)$"), F.substr(word, F.lit(1), n - 1))
    )


def conventional_commit(text: Column) -> Column:
    """struct(kind, scope, subject) of `kind(scope)!: subject`; null fields where the form is another."""
    pattern = "(?i)" + COMMIT
    hit = text.rlike(pattern)
    part = lambda i: F.when(hit, F.regexp_extract(text, pattern, i))
    return F.struct(F.lower(part(1)).alias("kind"), part(2).alias("scope"), part(3).alias("subject"))


def literal_phrases(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Distinct phrases of 2 to 8 tokens, not all of them generic, that are quoted, in backticks, or joined by hyphens, slashes or underscores."""
    raw = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in PHRASES))
    kept = F.transform(raw, lambda r: F.filter(ordered_tokens(r), lambda t: (F.length(t) >= 2) & ~F.array_contains(_array(stopwords), t)))
    return F.array_distinct(F.transform(F.filter(kept, lambda k: F.size(k).between(2, 8) & F.exists(k, lambda t: ~t.isin(GENERIC_TERMS))), lambda k: F.array_join(k, " ")))


def api_path(text: Column) -> Column:
    """The first /api/ path in a text without query, fragment, template and bracket parts; null if there is none."""
    found = F.regexp_extract(text, API_PATH, 0)
    plain = F.regexp_replace(F.substring_index(F.substring_index(F.substring_index(found, "?", 1), "#", 1), "${", 1), API_PARAMETER, "")
    trimmed = F.regexp_replace(plain, "[/,;)]+$", "")
    return F.when(found != "", F.when(trimmed == "", "/api").otherwise(trimmed))


def normalized(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def first_line(text: Column) -> Column:
    """The first non-blank line that is no heading, white space collapsed; empty if there is none."""
    lines = F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    return F.coalesce(normalized(F.get(lines, F.lit(0))), F.lit(""))


def duration_hours(value: Column) -> Column:
    """Hours of `24h`, `7d` or bare days; null for anything else."""
    number = F.regexp_extract(value, r"^\s*([0-9]+)\s*([hd]?)\s*$", 1)
    unit = F.regexp_extract(value, r"^\s*([0-9]+)\s*([hd]?)\s*$", 2)
    return F.when(number != "", number.cast("bigint") * F.when(unit == "h", 1).otherwise(24))


def identity(*parts: Column, length: int = 20) -> Column:
    """A content-addressed key: leading hex digits of the SHA-256 of the parts joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, length)


def citation(text: Column) -> Column:
    """array<struct(path, first, last)> of `path:start-end` places in a text."""
    pattern = r"([A-Za-z0-9_./-]+\.[A-Za-z0-9]+):([0-9]+)(?:-([0-9]+))?"
    groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    return F.transform(groups[0], lambda p, i: F.struct(p.alias("path"), F.get(groups[1], i).cast("int").alias("first"), F.when(F.get(groups[2], i) == "", F.get(groups[1], i)).otherwise(F.get(groups[2], i)).cast("int").alias("last")))
