"""Ordered CASE classifiers over paths, reasons and task texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Task kinds by falling priority and their signals.
TASK_KINDS = [
    ("bugfix", ("fix", "bug", "broken", "regression", "debug", "issue", "error", "failing", "fail")),
    ("refactor", ("refactor", "cleanup", "clean", "simplify", "restructure", "rename")),
    ("docs", ("readme", "doc", "docs", "documentation", "changelog", "guide")),
    ("release", ("release", "publish", "version", "bump", "tag", "pypi", "npm")),
    ("test", ("test", "tests", "coverage", "pytest", "jest", "spec", "eval", "benchmark")),
    ("ui", ("ui", "frontend", "component", "page", "screen", "css", "style", "layout")),
    ("infra", ("ci", "workflow", "docker", "deploy", "build", "package", "hook", "mcp")),
    ("audit", ("audit", "review", "inspect", "scan", "verify", "doctor", "status")),
    ("feature", ("add", "implement", "create", "support", "enable", "new")),
]


def _parts(path: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(path, r"\\", "/")), "/"), lambda p: p != "")


def _has(parts: Column, *names: str) -> Column:
    return F.arrays_overlap(parts, F.array(*(F.lit(n) for n in names)))


def path_family(path: Column) -> Column:
    """docs, fixtures, examples, test, generated, config, source or other; the first rule that holds."""
    parts = _parts(path)
    name = F.coalesce(F.element_at(parts, -1), F.lower(path))
    # fixed values: part names, file names and suffixes of each family
    manifest = ["package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "pyproject.toml", "go.mod", "go.sum", "pom.xml", "build.gradle", "gradle.properties"]
    return (
        F.when(_has(parts, "docs", "doc") | name.startswith("readme") | name.rlike(r"[^.]\.(md|mdx|rst)$"), "docs")
        .when(_has(parts, "fixtures", "fixture", "__fixtures__", "snapshots", "__snapshots__"), "fixtures")
        .when(_has(parts, "examples", "example", "playground", "playgrounds", "samples", "sample", "templates", "template"), "examples")
        .when(_has(parts, "test", "tests", "__tests__", "spec", "specs", "e2e", "integration"), "test")
        .when(_has(parts, "dist", "build", "generated", "__generated__", "coverage"), "generated")
        .when(name.rlike(r"(\.test\.tsx?|\.spec\.tsx?|_test\.go|_test\.py)$"), "test")
        .when(name.isin(manifest) | name.rlike(r"[^.]\.(toml|yaml|yml|json|ini|cfg)$"), "config")
        .when(name.rlike(r"[^.]\.(py|ts|tsx|js|jsx|go|java|kt|rs|rb|php|cs)$"), "source")
        .otherwise("other")
    )


# Families of ranking reasons by their beginnings (or what they hold), the first that fits.
REASON_FAMILIES = [
    ("filename", ["filename keyword match"], ["matched naming keyword"]),
    ("symbol", ["symbol keyword match", "matched define"], []),
    ("content", ["content keyword match", "keyword phrase match", "quoted literal match"], []),
    ("semantic", ["matched call", "matched entrypoint", "matched domain", "matched external system"], []),
    ("graph", ["direct dependency", "reverse dependency", "has related tests", "test for"], []),
    ("history", ["recently modified", "historically co-changed", "high churn"], []),
    ("metadata", ["config file", "release/version metadata", "knowledge/architecture doc"], []),
    ("summary", ["matched role keyword", "matched ranking keyword"], []),
]
# Intents of a task by whole phrases, the first that fits.
INTENTS = [
    ("audit", ["audit", "security review", "risk review", "architecture review"]),
    ("review", ["review", "pr", "pull request", "code review"]),
    ("share", ["share", "handoff", "promptable artifact", "broad context"]),
    ("repo_overview", ["repo overview", "repository overview", "explain repo", "understand repo", "map repo"]),
]
# What makes leaving a file out a high or a medium risk, in its reasons and in its path, and the score above which it is medium.
RISKS = [
    ("high", ["reverse dependency", "caller", "related test", "test for"], r"^tests?/|/tests/|route|controller|api/|schema|migration|model"),
    ("medium", ["direct dependency", "config"], r"config|\.env|deploy|settings"),
]
RISKY_SCORE = 150


def first_rule(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = F.when(F.lit(False), F.lit(otherwise))
    for name, holds in rules:
        out = out.when(holds, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def _any_of(value: Column, begins: list[str], holds: list[str] = ()) -> Column:
    return F.greatest(F.lit(False), F.lit(False), *(value.startswith(b) for b in begins), *(value.contains(h) for h in holds))


def reason_family(reason: Column) -> Column:
    """The kind of evidence that a ranking reason states."""
    r = F.lower(reason)
    return first_rule([(name, _any_of(r, begins, holds)) for name, begins, holds in REASON_FAMILIES], "other")


def module_of(path: Column) -> Column:
    """The first part of a path, or the first two below the usual source roots."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    roots = ["src", "tests", "docs", "apps", "packages", "services", "libs"]
    return F.when(F.size(parts) == 0, ".").when(F.get(parts, F.lit(0)).isin(roots) & (F.size(parts) > 1), F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(0)))


def category(path: Column) -> Column:
    """config, doc, test, entrypoint or file."""
    parts = _parts(path)
    name = F.coalesce(F.element_at(parts, -1), F.lit(""))
    stem = F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", "")
    # fixed values: names of configuration files
    config = ["pyproject.toml", "package.json", "pnpm-workspace.yaml", "yarn.lock", "package-lock.json", "requirements.txt", "poetry.lock", "setup.py", "setup.cfg", "tox.ini", "ruff.toml", "tsconfig.json", "vite.config.ts", "next.config.js", "dockerfile", "docker-compose.yml"]
    return (
        F.when(name.isin(config) | stem.contains("config"), "config")
        .when(name.rlike(r"[^.]\.(md|rst|txt)$"), "doc")
        .when(_has(parts, "test", "tests", "spec", "specs") | stem.startswith("test_") | stem.endswith("_test") | stem.endswith(".test"), "test")
        .when(stem.rlike("main|app|cli|server|index|routes|router|api"), "entrypoint")
        .otherwise("file")
    )


def omission_risk(path: Column, reasons: Column, score: Column) -> Column:
    """high, medium or low risk of leaving a file out."""
    p, r = F.lower(path), F.lower(F.array_join(reasons, " "))
    rules = [(name, _any_of(r, [], said) | p.rlike(places)) for name, said, places in RISKS]
    return first_rule([*rules, ("medium", score > RISKY_SCORE)], "low")


def context_intent(text: Column) -> Column:
    """audit, review, share, repo_overview or coding_task, by whole phrases."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[-_]", " "), r"\s+", " "))
    return first_rule([(name, t.rlike("(?<![a-z0-9_])(" + "|".join(terms) + ")(?![a-z0-9_])")) for name, terms in INTENTS], "coding_task")


def task_kind(text: Column) -> Column:
    """struct(kind, confidence, hits): the kind with most signals in the text, ties to the earlier kind."""
    t = F.lower(F.coalesce(text, F.lit("")))
    counts = [sum((t.contains(s).cast("int") for s in signals), F.lit(0)) for _, signals in TASK_KINDS]
    total = sum(counts, F.lit(0))
    best = F.greatest(*(F.struct(c.alias("n"), F.lit(len(TASK_KINDS) - i).alias("priority"), F.lit(k).alias("kind")) for i, ((k, _), c) in enumerate(zip(TASK_KINDS, counts, strict=True))))
    share = F.least(F.lit(0.95), F.lit(0.45) + best["n"] / F.greatest(F.lit(1), total) * F.lit(0.45))
    return F.struct(F.when(total == 0, "general").otherwise(best["kind"]).alias("kind"), F.when(total == 0, F.lit(0.2)).otherwise(F.round(share, 2)).alias("confidence"), total.cast("bigint").alias("hits"))


def miss_type(found: Column, scored: Column, rank: Column, score: Column, status: Column, selected: Column) -> Column:
    """Why an expected file was not selected."""
    skipped = F.lower(status).rlike("budget|cap reached|stronger support|score below|summarized|compressed")
    return (
        F.when(~found, "EXPECTED_NOT_FOUND")
        .when(~scored, "EXPECTED_NOT_SCORED")
        .when((score <= 0) | (rank > F.greatest(F.lit(50), selected * 4)), "EXPECTED_RANKED_LOW")
        .when(skipped, "EXPECTED_SKIPPED")
        .otherwise("NOISE_SELECTED_ABOVE_EXPECTED")
    )
