"""The scorer of candidates: some forty clauses in a fixed order, folded over one row with its task."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.functions.text import GENERIC_TERMS
from corpuscle.operators.boosts import CONFIG_STEMS, CONFIG_SUFFIXES, route_terms
from corpuscle.operators.related import IMPLEMENTATION_ROLES, NOISE
from corpuscle.shared import cut

#: Tasks that are sent to every core; more are joined by shuffle.
BROADCAST_TASKS = 10_000


@dataclass(frozen=True)
class Weights:
    """Points of the clauses that a user may set. The defaults."""

    modified: float = 100.0
    staged: float = 90.0
    filename_keyword: float = 80.0
    symbol_keyword: float = 70.0
    content_keyword_per_hit: float = 10.0
    content_keyword_max: float = 60.0
    direct_dep: float = 50.0
    reverse_dep: float = 40.0
    related_test: float = 35.0
    config_file: float = 25.0
    knowledge_file: float = 30.0
    implementation_role: float = 35.0
    co_changed: float = 28.0
    weak_filename_match_penalty: float = -45.0
    recently_modified: float = 20.0
    churn_high: float = 15.0
    large_unrelated_penalty: float = -50.0
    ignored_penalty: float = -100.0


# Fields of a summary, their labels, points, and the task terms that make the first value count without a match.
SUMMARY_FIELDS = [
    ("entrypoints", "matched entrypoint", 72.0, []),
    ("external_systems", "matched external system", 64.0, []),
    ("role", "matched role keyword", 56.0, []),
    ("domain", "matched domain", 50.0, []),
    ("ranking_keywords", "matched ranking keyword", 44.0, []),
    ("defines", "matched define", 42.0, []),
    ("reads_env", "matched env read", 52.0, ["env", "environment", "variable", "config", "settings"]),
    ("side_effects", "matched side effect", 46.0, ["side", "effect", "effects", "io", "debug"]),
    ("calls", "matched call", 26.0, []),
]
# Summary values that say little, and what they are worth at most.
GENERIC_VALUES = ["HTTP API route handler", "React UI component", "React page component", "React page: page", "entrypoint", "configuration", "api", "frontend", "data"]
GENERIC_RANKING = ["handler", "http", "route", "api", "component", "page"]
GENERIC_MOST, GENERIC_RANKING_MOST = 16.0, 10.0
# Terms that make a task one of tests, of a release, of the build.
TEST_TERMS = ["test", "tests", "spec", "specs"]
RELEASE_TERMS = ["release", "version", "prerelease", "bump", "publish", "tag", "pypi", "npm", "metadata", "license"]
BUILD_TERMS = ["build", "building", "boot", "dependency", "dependencies", "gradle", "java", "maven", "runtime", "starter"]
# Files of the build, of releases and of knowledge, and what the first of them gain.
BUILD_FILES = ["pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "gradle.properties"]
BUILD_FIRST = ["pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts"]
RELEASE_FOREIGN = ["doc", "docs", "example", "examples", "fixture", "fixtures", "test", "tests", "__tests__"]
RELEASE_FILES = ["pyproject.toml", "setup.cfg", "setup.py", "package.json", "package-lock.json", "cargo.toml", "pom.xml", "build.gradle", "gradle.properties"]
RELEASE_FIRST = ["pyproject.toml", "package.json", "cargo.toml", "pom.xml"]
VERSION_FILES = ["__init__.py", "__about__.py", "_version.py", "version.py"]
VERSION_SUFFIXES = [".py", ".ts", ".js", ".java", ".toml", ".json", ".xml"]
KNOWLEDGE_NAMES = ["decisions", "adr", "architecture", "contributing", "design", "technical", "tradeoffs", "rfc", "proposal"]
KNOWLEDGE_FOLDERS = ["adr", "adrs", "decisions", "rfcs", "proposals", "design"]
BUILD_FOLDERS = [".cxx", ".gradle", "intermediates", "outputs"]

NO_STRINGS = "cast(array() as array<string>)"
#: Columns of a candidate beside g, path, text, and what stands for one that is missing.
DEFAULTS = {
    "skipped": "false", "changed": "false", "staged": "false", "recent": "false", "too_large": "false", "secret": "false",
    "imports_changed": "false", "imported_by_changed": "false", "has_tests": "false", "test_for": "cast(null as string)", "churn": "0", "co_changed": "0",
    "symbols": NO_STRINGS, "naming_keywords": NO_STRINGS, "generic_names": NO_STRINGS, **{f: NO_STRINGS for f, *_ in SUMMARY_FIELDS},
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is evaluated once however often body names it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _list(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def _held(phrases: Column, flat: Column) -> Column:
    return F.filter(phrases, lambda p: F.contains(flat, p))


def _best(terms: Column, weights: Column) -> Column:
    """The greatest weight of terms that are keys of the map, 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(terms, lambda t: weights[t])), F.lit(0.0))


def _worth(value: Column) -> Column:
    """What a text is worth to the task by its best keyword or phrase."""
    return let(text.ordered_tokens(value), lambda t: let(F.array_join(t, " "), lambda n: F.greatest(_best(F.array_intersect(t, F.col("keys")), F.col("weights")), _best(_held(F.col("phrases"), n), F.col("phrase_weights")))))


def _first_best(values: Column, presence: list[str]) -> Column:
    """struct(value, weight): the first value of the greatest weight; without a match the first value at 0.6 if the task has a presence term; else null."""
    start = F.struct(F.lit("").alias("value"), F.lit(0.0).alias("weight"))
    best = F.aggregate(values, start, lambda done, v: let(_worth(v), lambda w: F.when(w > done["weight"], F.struct(v.alias("value"), w.alias("weight"))).otherwise(done)))
    there = F.arrays_overlap(F.col("keys"), _list(presence)) & (F.size(values) > 0) if presence else F.lit(False)
    return let(best, lambda b: F.when(b["weight"] > 0, b).when(there, F.struct(F.get(values, F.lit(0)).alias("value"), F.lit(0.6).alias("weight"))))


def short(value: Column, most: int = 80) -> Column:
    """A value on one line, cut with dots."""
    return let(F.trim(F.regexp_replace(value, r"\s+", " ")), lambda v: F.when(F.length(v) <= most, v).otherwise(F.concat(F.rtrim(F.substring(v, 1, most - 1)), F.lit("..."))))


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^./]+$", "")


def _points(value: Column) -> Column:
    return F.round(value, 0).cast("bigint").cast("string")


def features(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """What the clauses need of each candidate and its task; whole texts are read once and left behind. Checkpointed."""
    given = {c: F.coalesce(F.col(c), F.expr(d)) if c in rows.columns else F.expr(d) for c, d in DEFAULTS.items()}
    own = rows.select("g", "path", F.col("text").alias("content"), *(v.alias(c) for c, v in given.items())).where("path is not null")
    none, no_map = F.expr(NO_STRINGS), F.expr("cast(map() as map<string, double>)")
    of = tasks.select(
        F.col("g").alias("h"), F.coalesce("weights", no_map).alias("weights"), F.coalesce("phrase_weights", no_map).alias("phrase_weights"), F.coalesce("literals", none).alias("literals"), F.coalesce("concrete", none).alias("concrete"),
        F.coalesce("ambiguous", none).alias("ambiguous"), F.coalesce("scope_terms", none).alias("scope_terms"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("task_class", F.lit("general")).alias("task_class"), F.coalesce("scope_is_root", F.lit(False)).alias("scope_is_root"), "churn_edge",
    )
    of = of.withColumn("keys", F.filter(F.map_keys("weights"), lambda k: F.length(k) >= 3)).withColumn("phrases", F.array_sort(F.map_keys("phrase_weights")))
    if of.count() <= BROADCAST_TASKS:
        of = F.broadcast(of)
    met = own.join(of, F.col("g").eqNullSafe(F.col("h"))).drop("h")
    name, path = F.substring_index("path", "/", -1), F.col("path")
    parts = F.split(F.lower("path"), "/")
    found = let(
        text.ordered_tokens(F.coalesce("content", F.lit(""))),
        lambda t: let(F.array_join(t, " "), lambda n: F.struct(F.array_intersect(t, F.col("keys")).alias("terms"), _held(F.col("phrases"), n).alias("phrases"), _held(F.col("literals"), F.concat(F.array_join(text.ordered_tokens(path), " "), F.lit(" "), n)).alias("literals"))),
    )
    flat_path = F.array_join(text.ordered_tokens(path), " ")
    low, stem = F.lower(name), F.lower(_stem(name))
    test = _stem(name).startswith("test_") | _stem(name).rlike(r"(_test|\.test|\.spec)$") | F.arrays_overlap(F.split("path", "/"), _list(["tests", "__tests__"]))
    suffix = F.regexp_extract(low, r"(?<=.)\.[^./]+$", 0)
    config = suffix.isin(CONFIG_SUFFIXES) | stem.isin(CONFIG_STEMS) | F.arrays_overlap(F.split(low, "[^a-z0-9]+"), _list(["config", "conf"]))
    knowledge = (stem.isin(KNOWLEDGE_NAMES) & (suffix == ".md")) | stem.rlike(r"^adr[-_]?\d+") | (~stem.isin(KNOWLEDGE_NAMES) & F.arrays_overlap(parts, _list(KNOWLEDGE_FOLDERS)) & (suffix == ".md"))
    release = ~F.arrays_overlap(parts, _list(RELEASE_FOREIGN)) & (low.isin(RELEASE_FILES) | low.isin(VERSION_FILES) | (F.contains(low, F.lit("version")) & suffix.isin(VERSION_SUFFIXES)))
    specific = lambda v: F.size(F.filter(F.array_intersect(text.ordered_tokens(v), F.col("keys")), lambda t: F.array_contains("concrete", t) & ~t.isin(GENERIC_TERMS)))
    defined = lambda v: let(F.array_join(text.ordered_tokens(v), " "), lambda n: F.filter("literals", lambda p: F.contains(n, p) | F.contains(p, n)))
    best = {f"s_{f}": _first_best(F.col(f), presence) for f, _, _, presence in SUMMARY_FIELDS}
    symbol_terms = F.array_distinct(F.flatten(F.transform("symbols", lambda s: F.array_intersect(text.ordered_tokens(s), F.col("keys")))))
    more = {
        "found": found, "path_worth": _worth(path), "path_phrases": _held(F.col("phrases"), flat_path), "path_terms": F.array_intersect(text.ordered_tokens(path), F.col("keys")), "path_tokens": text.path_tokens(path),
        "symbol_worth": F.coalesce(F.array_max(F.transform("symbols", _worth)), F.lit(0.0)), "symbol_terms": symbol_terms, "naming": _first_best(F.col("naming_keywords"), []), "route": route_terms(path),
        "is_test": test, "is_config": config, "is_knowledge": knowledge, "is_release": release, "is_build": (F.size(parts) == 1) & low.isin(BUILD_FILES), "low_name": low, "is_e2e": F.array_contains(parts, "e2e"), "is_go": suffix == ".go", "depth": F.size(parts),
        "build_artifact": F.arrays_overlap(F.split("path", "/"), _list(BUILD_FOLDERS)), **best,
    }
    wide = met.withColumns(more)
    define = F.col("s_defines.value")
    wide = wide.withColumns({"n_specific": F.coalesce(specific(define), F.lit(0)), "defined": F.when(define.isNotNull(), defined(define)).otherwise(none)})
    return cut(wide.drop("content", "symbols", "naming_keywords", "phrases", *(f for f, *_ in SUMMARY_FIELDS)))


def _clause(when: Column, reason: Column | str | None, amount: Column | float = 0.0, factor: float = 1.0, floor: float | None = None, cap: Column | float | None = None, below: float | None = None) -> Column:
    """A step: the score times factor plus amount, at least floor and at most cap, where `when` holds and the score is below `below`."""
    number = lambda v, other: F.lit(other).cast("double") if v is None else (v if isinstance(v, Column) else F.lit(v)).cast("double")
    said = F.lit(reason).cast("string") if not isinstance(reason, Column) else reason
    own = F.struct(said.alias("reason"), number(amount, 0.0).alias("amount"), F.lit(factor).alias("factor"), number(floor, float("-inf")).alias("floor"), number(cap, float("inf")).alias("cap"), number(below, float("inf")).alias("below"))
    return F.when(when, own)


def _longest(phrases: Column) -> Column:
    """The longest phrase, the first by spelling of equals."""
    return F.aggregate(F.array_sort(phrases), F.lit(""), lambda done, p: F.when(F.length(p) > F.length(done), p).otherwise(done))


def _weightiest(phrases: Column) -> Column:
    start = F.struct(F.lit("").alias("p"), F.lit(-1.0).alias("w"))
    return F.aggregate(F.array_sort(phrases), start, lambda done, p: F.when(F.col("phrase_weights")[p] > done["w"], F.struct(p.alias("p"), F.col("phrase_weights")[p].alias("w"))).otherwise(done))


def clauses(w: Weights, agent_folders: Sequence[str]) -> list[Column]:
    """The steps in their order. A condition looks at features and at which steps hold, never at the running score but where `below` says so."""
    c = F.col
    size, hits = F.size, F.size("found.terms")
    fname, sym = c("path_worth") > 0, c("symbol_worth") > 0
    s = {f: c(f"s_{f}") for f, *_ in SUMMARY_FIELDS}
    has = {f: v.isNotNull() for f, v in s.items()}
    on_path = size("path_phrases") > 0
    phrases = F.array_union("path_phrases", F.col("found.phrases"))
    any_phrase = size(phrases) > 0
    scope = (size("scope_terms") > 0) & (c("kind") != "test") & (size(F.array_except("scope_terms", "path_tokens")) == 0)
    concrete = size(F.filter("concrete", lambda t: ~t.isin(GENERIC_TERMS) & F.array_contains("path_tokens", t)))
    many_terms = (concrete >= 2) & ~(c("is_test") & (c("kind") != "test"))
    term_bonus = F.least(F.when(c("is_config"), 210.0).otherwise(150.0), 70.0 + 35.0 * F.least(F.lit(2), concrete - 2) + F.when(c("is_config"), F.when(c("task_class").isin("infra", "release"), 105.0).otherwise(20.0)).otherwise(0.0))
    out = [
        _clause(c("changed"), "modified", w.modified),
        _clause(c("staged"), "staged", w.staged),
        _clause(fname, "filename keyword match", c("path_worth") * w.filename_keyword),
        _clause(on_path, F.concat(F.lit("keyword phrase match: "), _weightiest(c("path_phrases"))["p"]), F.least(F.lit(28.0), 18.0 * _weightiest(c("path_phrases"))["w"])),
        _clause(scope, "conventional scope path match", 160.0),
        _clause(many_terms, F.concat(F.lit("multi-term path match +"), _points(term_bonus)), term_bonus),
        _clause(sym, "symbol keyword match", c("symbol_worth") * w.symbol_keyword),
    ]
    multi = has["defines"] & (c("n_specific") >= 2)
    multi_bonus = F.least(F.lit(120.0), 55.0 * (c("n_specific") - 1))
    literal_define = has["defines"] & (size("defined") > 0)
    for field, label, amount, _ in SUMMARY_FIELDS:
        value = s[field]["value"]
        most = F.lit(amount)
        if field in ("role", "domain"):
            most = F.when(value.isin(GENERIC_VALUES), min(amount, GENERIC_MOST)).otherwise(amount)
        elif field == "ranking_keywords":
            most = F.when(value.isin(GENERIC_RANKING), min(amount, GENERIC_RANKING_MOST)).otherwise(amount)
        out.append(_clause(has[field], None, most * s[field]["weight"]))
        if field == "defines":
            out.append(_clause(multi, F.concat(F.lit("multi-token defines match +"), _points(multi_bonus), F.lit(": "), short(value)), multi_bonus))
            out.append(_clause(literal_define, F.concat(F.lit("literal definition match: "), _longest(c("defined"))), 150.0))
        out.append(_clause(has[field], F.concat(F.lit(f"{label}: "), short(value))))
    routed = F.array_intersect("route", F.filter("keys", lambda k: ~k.isin(NOISE)))
    api = size(routed) > 0
    literal = size("found.literals") > 0
    strong = has["calls"] | has["defines"] | literal_define | multi | has["entrypoints"]
    direct = (hits >= 2) & ~fname & ~sym & (strong | any_phrase)
    direct_bonus = F.least(F.lit(270.0), F.when(strong, 120.0 + 50.0 * F.least(F.lit(3), hits - 2)).otherwise(F.least(F.lit(45.0), 120.0 + 50.0 * F.least(F.lit(3), hits - 2))))
    terms = F.array_union(F.array_union("path_terms", "symbol_terms"), F.col("found.terms"))
    vague = F.array_intersect(terms, c("ambiguous"))
    unclear = (size(vague) > 0) & ~F.arrays_overlap(terms, c("concrete"))
    role = F.arrays_overlap("path_tokens", _list(IMPLEMENTATION_ROLES))
    restored = unclear & (hits >= 1) & (sym | role)
    labels = F.array_join(F.slice(F.array_sort(vague), 1, 3), ", ")
    signal = fname | sym | (hits > 0)
    test_task = (c("kind") == "test") | F.arrays_overlap("keys", _list(TEST_TERMS))
    release_task, build_task = F.arrays_overlap("keys", _list(RELEASE_TERMS)), F.arrays_overlap("keys", _list(BUILD_TERMS))
    metadata = release_task & c("is_release")
    churned = c("churn_edge").isNotNull() & (c("churn") >= c("churn_edge"))
    together = c("co_changed") > 0
    tested = c("is_test") & c("test_for").isNotNull()
    out += [
        _clause(c("naming").isNotNull(), F.concat(F.lit("matched naming keyword: "), short(c("naming.value"))), F.least(F.lit(20.0), c("naming.weight") * 18.0)),
        _clause((size("generic_names") > 0) & ~fname & ~sym, F.concat(F.lit("generic public API penalty: "), F.get("generic_names", F.lit(0))), min(-6.0, w.weak_filename_match_penalty / 2)),
        _clause(api, F.concat(F.lit("API route owner match: /api/"), F.array_join("route", "/")), 170.0 + 35.0 * F.least(F.lit(2), size(routed) - 1)),
        _clause(hits > 0, F.concat(F.lit("content keyword match ("), hits.cast("string"), F.lit(")")), F.least(F.lit(w.content_keyword_max), F.aggregate("found.terms", F.lit(0.0), lambda a, t: a + F.col("weights")[t]) * w.content_keyword_per_hit)),
        _clause(literal, F.concat(F.lit("quoted literal match: "), _longest(c("found.literals"))), 360.0),
        _clause(~literal & (c("kind") == "chore") & (size("literals") > 0) & (fname | sym), "chore literal partial-match dampening", factor=0.55),
        _clause(any_phrase, F.when(~on_path, F.concat(F.lit("keyword phrase match: "), _weightiest(phrases)["p"])), F.least(F.lit(20.0), 14.0 * _weightiest(phrases)["w"])),
        _clause(direct, F.concat(F.lit("direct content evidence +"), _points(direct_bonus)), direct_bonus),
        _clause(restored, F.concat(F.lit("ambiguous term restored by corroboration: "), labels), F.least(F.lit(24.0), 10.0 + 6.0 * F.least(hits, F.lit(3)))),
        _clause(unclear & ~restored & fname & (hits == 0) & ~sym, F.concat(F.lit("ambiguous term cap: "), labels), -8.0, floor=0.0),
        _clause(signal & role, "implementation role match", w.implementation_role),
        _clause(~(signal & role) & c("changed"), "modified workspace context only"),
        _clause(test_task & c("is_test"), "explicit test task file", F.when(c("is_e2e"), 130.0).otherwise(95.0)),
        _clause(test_task & ~c("is_test") & ~c("is_config"), "explicit test task non-test dampening", factor=0.72, floor=0.0),
        _clause(c("imports_changed"), "direct dependency of changed file", w.direct_dep),
        _clause(c("imported_by_changed"), "reverse dependency", w.reverse_dep),
        _clause(c("has_tests"), "has related tests", w.related_test),
        _clause(~c("has_tests") & (size("route") > 0), "no direct tests found for endpoint"),
        _clause(tested, F.concat(F.lit("test for "), c("test_for")), w.related_test),
        _clause(c("is_config"), "config file", w.config_file),
        _clause(build_task & c("is_build"), "build/dependency metadata", 190.0 + F.when(c("low_name").isin(BUILD_FIRST), 90.0).otherwise(35.0)),
        _clause(metadata, "release/version metadata", 110.0 + F.when(c("low_name").isin(RELEASE_FIRST) | c("low_name").isin(VERSION_FILES), 70.0).otherwise(0.0)),
        _clause(c("secret"), "secret redaction candidate", w.modified),
        _clause(c("is_knowledge"), "knowledge/architecture doc", w.knowledge_file),
        _clause(c("recent"), "recently modified", w.recently_modified),
        _clause(churned, F.concat(F.lit("high churn ("), c("churn").cast("string"), F.lit(" commits)")), w.churn_high),
        _clause(together, F.concat(F.lit("historically co-changed ("), c("co_changed").cast("string"), F.lit(" commits)")), w.co_changed * F.least(F.lit(1.0), 0.5 + c("co_changed") / 4)),
    ]
    linked = c("imports_changed") | c("imported_by_changed") | c("has_tests") | tested | together
    release_only = release_task & ~metadata & (size(terms) > 0) & (size(F.array_except(terms, _list(RELEASE_TERMS))) == 0)
    release_only = release_only & ~(linked | any_phrase | has["entrypoints"] | has["external_systems"] | has["defines"] | multi)
    mismatch = (c("kind") != "test") & c("scope_is_root") & (size("scope_terms") > 0) & (size(F.array_except("scope_terms", "path_tokens")) > 0)
    summed = has["entrypoints"]
    for f in has:
        summed = summed | has[f]
    matched = summed | c("naming").isNotNull()
    backed = c("changed") | c("staged") | sym | (hits > 0) | matched | linked | c("is_config") | c("is_knowledge") | (signal & role) | c("recent")
    large = c("too_large") & ((hits >= 2) | has["calls"] | has["defines"] | multi | any_phrase | c("imports_changed") | c("imported_by_changed") | together)
    structural = api | direct | c("imports_changed") | together | any_phrase | literal_define | has["calls"] | has["defines"] | has["entrypoints"] | multi | literal | c("imported_by_changed") | tested
    structural = structural | (build_task & c("is_build")) | c("is_config") | c("has_tests") | c("is_knowledge") | metadata
    keyword_reasons = sum((x.cast("int") for x in (fname, sym, hits > 0, has["domain"], c("naming").isNotNull(), has["ranking_keywords"], has["role"])), F.lit(0))
    false_hit = ~c("is_test") & ~structural & (keyword_reasons >= 2) & ~(size("route") > 0) & ~((hits >= 4) & sym)
    root_go = c("is_go") & (c("depth") == 1) & ~c("is_test")
    owner = (hits >= 5) | scope | direct | any_phrase | literal_define | many_terms | literal | tested | (test_task & c("is_test")) | (root_go & fname & has["role"])
    carrier = c("is_go") & (sym | has["defines"] | has["ranking_keywords"] | has["role"]) & ~owner & (root_go | (c("is_test") & (hits <= 2)))
    agent = F.greatest(F.lit(False), F.lit(False), *(c("path").startswith(p) for p in agent_folders))
    return [
        *out,
        _clause(release_only, "release-term-only non-metadata dampening", factor=0.35, floor=0.0),
        _clause(mismatch, "conventional scope mismatch dampening", factor=0.62, floor=0.0),
        _clause(fname & ~backed, f"weak filename-only match {w.weak_filename_match_penalty:.0f}", w.weak_filename_match_penalty, floor=1.0),
        _clause(large, "large supported file", 120.0),
        _clause(c("too_large") & ~large, "large unrelated file", w.large_unrelated_penalty, below=50.0),
        _clause(false_hit, "likely false positive: keyword-only match", factor=0.72, floor=0.0),
        _clause(carrier, "broad Go symbol carrier dampening", factor=0.45, floor=0.0),
        _clause(agent & c("changed"), "generated agent artifact dampening", cap=160.0),
        _clause(agent & ~c("changed"), "generated agent artifact dampening", factor=0.25, cap=80.0),
        _clause(c("build_artifact") & c("changed"), "generated Android build artifact dampening", cap=160.0),
        _clause(c("build_artifact") & ~c("changed"), "generated Android build artifact dampening", factor=0.25, cap=80.0),
    ]


def score(rows: DataFrame, tasks: DataFrame, weights: Weights = Weights(), agent_folders: Sequence[str] = (".agent/",)) -> DataFrame:
    """(g, path, score, reasons) of every candidate for the task of its group.

    Candidates have the columns of DEFAULTS, summaries as arrays; tasks are one row for
    each group: weights and phrase_weights (maps), literals, concrete, ambiguous,
    scope_terms (arrays), kind, task_class, scope_is_root, churn_edge. Steps are folded in
    their order, since dampeners multiply what came before them. Candidates of groups
    without a task have no row; null texts and summaries count as empty.
    """
    wide = features(rows, tasks)
    steps = F.array_compact(F.array(*clauses(weights, agent_folders)))
    start = F.struct(F.lit(0.0).alias("score"), F.expr(NO_STRINGS).alias("reasons"))

    def step(done: Column, x: Column) -> Column:
        now = F.least(x["cap"], F.greatest(x["floor"], done["score"] * x["factor"] + x["amount"]))
        said = F.when(x["reason"].isNull(), done["reasons"]).otherwise(F.concat(done["reasons"], F.array(x["reason"])))
        return F.when(done["score"] < x["below"], F.struct(now.alias("score"), said.alias("reasons"))).otherwise(done)

    folded = F.when(F.col("skipped"), F.struct(F.lit(weights.ignored_penalty).alias("score"), F.array(F.lit("ignored/binary")).alias("reasons"))).otherwise(F.aggregate(steps, start, step))
    return wide.select("g", "path", folded.alias("s")).select("g", "path", "s.score", "s.reasons")
