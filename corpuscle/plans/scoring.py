"""The weighted scorer over documents: every clause, with a task for each source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import scoring
from corpuscle.operators.boosts import CONFIG_STEMS, CONFIG_SUFFIXES
from corpuscle.operators.related import IMPLEMENTATION_ROLES, NOISE
from corpuscle.operators.scoring import GENERIC_RANKING, GENERIC_TERMS, GENERIC_VALUES, RELEASE_TERMS, SUMMARY_FIELDS, Weights
from corpuscle.plans.boosts import PLACE
from corpuscle.plans.registry import query, read

#: In both engines: the task of every source, and what is known of a document.
WEIGHTS = {"order": 1.0, "settings": 0.75, "user": 0.5, "service": 1.25, "ing": 0.25, "the": 0.5, "version": 0.5}
PHRASES = {"user service": 1.5, "order index": 0.5, "of the": 0.25}
LITERALS, CONCRETE, AMBIGUOUS, SCOPE = ["settings config", "in the"], ["order", "index", "user", "service", "settings", "config"], ["ing", "the"], ["order", "index"]
KIND = "CASE WHEN source LIKE '%1' THEN 'chore' WHEN source LIKE '%2' THEN 'test' ELSE 'fix' END"
ROOT = "source LIKE '%3'"
FLAGS = {
    "skipped": "doc_id % 41 = 3", "changed": "doc_id % 13 = 0", "staged": "doc_id % 37 = 1", "recent": "doc_id % 17 = 2", "too_large": "doc_id % 5 = 4", "secret": "doc_id % 43 = 5",
    "imports_changed": "doc_id % 19 = 3", "imported_by_changed": "doc_id % 23 = 4", "has_tests": "doc_id % 11 = 6",
}
NUMBERS = {"churn": "CAST(doc_id % 7 AS INT)", "co_changed": "CASE WHEN doc_id % 9 = 2 THEN CAST(doc_id % 4 AS INT) ELSE 0 END"}
TEST_FOR = "CASE WHEN doc_id % 3 = 1 THEN 'src/x.py' END"
LISTS = {
    "symbols": "CASE doc_id % 6 WHEN 0 THEN {a}'userService', 'other'{z} WHEN 1 THEN {a}'getOrder'{z} ELSE {none} END", "naming_keywords": "CASE WHEN doc_id % 8 = 3 THEN {a}'order naming'{z} ELSE {none} END", "generic_names": "CASE WHEN doc_id % 10 = 6 THEN {a}'run'{z} ELSE {none} END",
    "entrypoints": "CASE doc_id % 15 WHEN 2 THEN {a}'serve orders', 'order entry'{z} ELSE {none} END", "external_systems": "CASE doc_id % 14 WHEN 5 THEN {a}'user store'{z} ELSE {none} END", "role": "CASE doc_id % 7 WHEN 1 THEN {a}'api'{z} WHEN 2 THEN {a}'order role'{z} ELSE {none} END",
    "domain": "CASE doc_id % 6 WHEN 4 THEN {a}'service'{z} WHEN 5 THEN {a}'frontend'{z} ELSE {none} END", "ranking_keywords": "CASE doc_id % 9 WHEN 7 THEN {a}'user', 'handler'{z} ELSE {none} END", "defines": "CASE doc_id % 10 WHEN 3 THEN {a}'UserOrderService'{z} WHEN 4 THEN {a}'settings config'{z} ELSE {none} END",
    "reads_env": "CASE doc_id % 12 WHEN 8 THEN {a}'HOME'{z} ELSE {none} END", "side_effects": "CASE doc_id % 12 WHEN 9 THEN {a}'writes order'{z} ELSE {none} END", "calls": "CASE doc_id % 8 WHEN 6 THEN {a}'callService'{z} ELSE {none} END",
}


def _sql(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _oracle() -> str:
    w = Weights()
    tok = lambda v: rf"list_filter(string_split_regex(lower(regexp_replace({v}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-zA-Z0-9]+'), lambda z: z <> '')"
    flat = lambda v: f"array_to_string({tok(v)}, ' ')"
    value = lambda m, x: "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in m.items()) + " END"
    keys, phrases = _sql(list(WEIGHTS)), _sql(list(PHRASES))
    hit = lambda v: f"list_distinct(list_intersect({tok(v)}, {keys}))"
    held = lambda v: f"list_filter({phrases}, lambda p: contains({flat(v)}, p))"
    worth = lambda v: f"greatest(coalesce(list_max(list_transform({hit(v)}, lambda k: {value(WEIGHTS, 'k')})), 0), coalesce(list_max(list_transform({held(v)}, lambda k: {value(PHRASES, 'k')})), 0))"
    top = lambda ps: f"list_sort({ps}, 'ASC')[list_position(list_transform(list_sort({ps}, 'ASC'), lambda k: {value(PHRASES, 'k')}), list_max(list_transform({ps}, lambda k: {value(PHRASES, 'k')})))]"
    top_w = lambda ps: f"list_max(list_transform({ps}, lambda k: {value(PHRASES, 'k')}))"
    longest = lambda ps: f"list_sort({ps}, 'ASC')[list_position(list_transform(list_sort({ps}, 'ASC'), lambda k: length(k)), list_max(list_transform({ps}, lambda k: length(k))))]"
    lists = {f: e.format(a="[", z="]", none="CAST([] AS VARCHAR[])") for f, e in LISTS.items()}
    own = ", ".join([*(f"{e} AS {c}" for c, e in FLAGS.items()), *(f"{e} AS {c}" for c, e in NUMBERS.items()), f"{TEST_FOR} AS test_for", f"{KIND} AS kind", f"{ROOT} AS root", *(f"{e} AS l_{f}" for f, e in lists.items())])
    summary = ", ".join(f"list_transform(l_{f}, lambda v: {worth('v')}) AS w_{f}" for f in ("naming_keywords", *(x for x, *_ in SUMMARY_FIELDS)))
    chosen = []
    for f in ("naming_keywords", *(x for x, *_ in SUMMARY_FIELDS)):
        presence = f in ("reads_env",)  # 'settings' is a key of every task
        weight = f"coalesce(list_max(w_{f}), 0)"
        chosen.append(f"CASE WHEN {weight} > 0 THEN l_{f}[list_position(w_{f}, list_max(w_{f}))]" + (f" WHEN len(l_{f}) > 0 THEN l_{f}[1]" if presence else "") + f" END AS v_{f}")
        chosen.append(f"CASE WHEN {weight} > 0 THEN {weight}" + (f" WHEN len(l_{f}) > 0 THEN 0.6" if presence else "") + f" END AS x_{f}")
    bare = r"regexp_replace(path, '([^/])\.[^./]*$', '\1')"
    role_of = f"list_has_any(own, {_sql(IMPLEMENTATION_ROLES)})"
    steps: list[tuple] = [
        ("changed", "'modified'", "100"), ("staged", "'staged'", "90"), ("pw > 0", "'filename keyword match'", "80 * pw"), ("len(pp) > 0", f"'keyword phrase match: ' || {top('pp')}", f"least(28, 18 * {top_w('pp')})"),
        (f"kind <> 'test' AND list_has_all(own, {_sql(SCOPE)})", "'conventional scope path match'", "160"),
        ("many", "'multi-term path match +' || CAST(CAST(bonus AS BIGINT) AS VARCHAR)", "bonus"), ("sw > 0", "'symbol keyword match'", "70 * sw"),
    ]
    for f, label, amount, _ in SUMMARY_FIELDS:
        most = f"CASE WHEN v_{f} IN ({', '.join(repr(v) for v in GENERIC_VALUES)}) THEN 16 ELSE {amount} END" if f in ("role", "domain") else f"CASE WHEN v_{f} IN ({', '.join(repr(v) for v in GENERIC_RANKING)}) THEN 10 ELSE {amount} END" if f == "ranking_keywords" else str(amount)
        steps.append((f"v_{f} IS NOT NULL", None, f"({most}) * x_{f}"))
        if f == "defines":
            steps.append(("multi", "'multi-token defines match +' || CAST(CAST(least(120, 55 * (nspec - 1)) AS BIGINT) AS VARCHAR) || ': ' || v_defines", "least(120, 55 * (nspec - 1))"))
            steps.append(("len(defd) > 0", f"'literal definition match: ' || {longest('defd')}", "150"))
        steps.append((f"v_{f} IS NOT NULL", f"'{label}: ' || v_{f}", "0"))
    direct = "CASE WHEN strong THEN 120 + 50 * least(3, hits - 2) ELSE 45 END"
    steps += [
        ("v_naming_keywords IS NOT NULL", "'matched naming keyword: ' || v_naming_keywords", "least(20, x_naming_keywords * 18)"), ("len(l_generic_names) > 0 AND pw = 0 AND sw = 0", "'generic public API penalty: ' || l_generic_names[1]", "-22.5"),
        ("api > 0", "'API route owner match: /api/' || array_to_string(route, '/')", "170 + 35 * least(2, api - 1)"), ("hits > 0", "'content keyword match (' || hits || ')'", f"least(60, 10 * list_sum(list_transform(ft, lambda k: {value(WEIGHTS, 'k')})))"),
        ("len(lits) > 0", f"'quoted literal match: ' || {longest('lits')}", "360"), ("len(lits) = 0 AND kind = 'chore' AND (pw > 0 OR sw > 0)", "'chore literal partial-match dampening'", ("0", 0.55)),
        ("len(ph) > 0", f"CASE WHEN len(pp) = 0 THEN 'keyword phrase match: ' || {top('ph')} END", f"least(20, 14 * {top_w('ph')})"), ("direct", f"'direct content evidence +' || CAST(CAST({direct} AS BIGINT) AS VARCHAR)", f"{direct}"),
        ("restored", "'ambiguous term restored by corroboration: ' || labels", "least(24, 10 + 6 * least(hits, 3))"), ("unclear AND NOT restored AND pw > 0 AND hits = 0 AND sw = 0", "'ambiguous term cap: ' || labels", ("-8", 1.0, 0)),
        ("signal AND rol", "'implementation role match'", "35"), ("NOT (signal AND rol) AND changed", "'modified workspace context only'", "0"), ("kind = 'test' AND test", "'explicit test task file'", "95"), ("kind = 'test' AND NOT test AND NOT config", "'explicit test task non-test dampening'", ("0", 0.72, 0)),
        ("imports_changed", "'direct dependency of changed file'", "50"), ("imported_by_changed", "'reverse dependency'", "40"), ("has_tests", "'has related tests'", "35"), ("NOT has_tests AND len(route) > 0", "'no direct tests found for endpoint'", "0"),
        ("test AND test_for IS NOT NULL", "'test for ' || test_for", "35"), ("config", "'config file'", "25"), ("secret", "'secret redaction candidate'", "100"), ("recent", "'recently modified'", "20"), ("churn >= 5", "'high churn (' || churn || ' commits)'", "15"),
        ("co_changed > 0", "'historically co-changed (' || co_changed || ' commits)'", "28 * least(1, 0.5 + co_changed / 4)"), ("reltask", "'release-term-only non-metadata dampening'", ("0", 0.35, 0)), (f"kind <> 'test' AND root AND NOT list_has_all(own, {_sql(SCOPE)})", "'conventional scope mismatch dampening'", ("0", 0.62, 0)),
        ("pw > 0 AND NOT backed", "'weak filename-only match -45'", ("-45", 1.0, 1)), ("large", "'large supported file'", "120"), ("too_large AND NOT large", "'large unrelated file'", ("-50", 1.0, None, 50)), ("falsehit", "'likely false positive: keyword-only match'", ("0", 0.72, 0)),
    ]
    clauses = []
    for cond, reason, points in steps:
        amount, factor, floor, below = (points if isinstance(points, tuple) else (points,)) + (1.0, None, None)[(len(points) if isinstance(points, tuple) else 1) - 1 :]
        r = f"CASE WHEN {reason} IS NULL THEN CAST([] AS VARCHAR[]) ELSE [{reason}] END" if reason else "CAST([] AS VARCHAR[])"
        clauses.append(f"CASE WHEN {cond} THEN {{'v': CAST({amount} AS DOUBLE), 'f': CAST({factor} AS DOUBLE), 'lo': CAST({-1e300 if floor is None else floor} AS DOUBLE), 'b': CAST({1e300 if below is None else below} AS DOUBLE), 'r': {r}}} END")
    first = "{'v': CAST(0 AS DOUBLE), 'f': CAST(1 AS DOUBLE), 'lo': CAST(0 AS DOUBLE), 'b': CAST(0 AS DOUBLE), 'r': CAST([] AS VARCHAR[])}"
    fold = "lambda a, x: CASE WHEN a.v < x.b THEN {'v': greatest(x.lo, a.v * x.f + x.v), 'f': a.f, 'lo': a.lo, 'b': a.b, 'r': list_concat(a.r, x.r)} ELSE a END"
    return rf"""WITH d AS (SELECT source, doc_id, coalesce(text, '') AS text, {PLACE} AS path, {own} FROM documents),
e AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, {summary}, {tok('text')} AS tt, {hit('path')} AS pt, {held('path')} AS pp, {worth('path')} AS pw, list_distinct({tok(bare)}) AS own, coalesce(list_max(list_transform(l_symbols, lambda v: {worth('v')})), 0) AS sw, list_distinct(flatten(list_transform(l_symbols, lambda v: {hit('v')}))) AS st,
  path LIKE 'tests/%' AS test, list_distinct(list_filter(flatten(list_transform(list_filter(string_split(regexp_extract('/' || lower(path), '/api/(.*)$', 1), '/'), lambda p: p <> '' AND NOT starts_with(p, '_')), lambda p: {tok('p')})), lambda t: NOT list_contains({_sql(NOISE)}, t))) AS route FROM d),
f AS (SELECT *, {', '.join(chosen)}, array_to_string(tt, ' ') AS tf, list_distinct(list_intersect(tt, {keys})) AS ft, regexp_extract(lower(name), '(\.[^./]+)$', 1) IN ({', '.join(repr(v) for v in CONFIG_SUFFIXES)}) OR lower(regexp_replace(name, '(.)\.[^./]+$', '\1')) IN ({', '.join(repr(v) for v in CONFIG_STEMS)}) OR list_has_any(string_split_regex(lower(name), '[^a-z0-9]+'), ['config', 'conf']) AS config FROM e),
g AS (SELECT *, len(ft) AS hits, list_distinct(list_concat(pp, list_filter({phrases}, lambda p: contains(tf, p)))) AS ph, list_filter({_sql(LITERALS)}, lambda p: contains({flat('path')} || ' ' || tf, p)) AS lits, len(list_filter({_sql(CONCRETE)}, lambda t: NOT list_contains({_sql(GENERIC_TERMS)}, t) AND list_contains(own, t))) AS nc, len(list_filter({hit('v_defines')}, lambda t: list_contains({_sql(CONCRETE)}, t) AND NOT list_contains({_sql(GENERIC_TERMS)}, t))) AS nspec,
  CASE WHEN v_defines IS NULL THEN [] ELSE list_filter({_sql(LITERALS)}, lambda p: contains({flat('v_defines')}, p) OR contains(p, {flat('v_defines')})) END AS defd, len(list_filter(route, lambda t: list_contains({keys}, t) AND NOT list_contains({_sql(NOISE)}, t))) AS api, {role_of} AS rol, list_distinct(list_concat(list_concat(pt, st), ft)) AS terms FROM f),
h AS (SELECT *, nc >= 2 AND NOT (test AND kind <> 'test') AS many, least(CASE WHEN config THEN 210 ELSE 150 END, 70 + 35 * least(2, nc - 2) + CASE WHEN config THEN 20 ELSE 0 END) AS bonus, coalesce(v_defines IS NOT NULL AND nspec >= 2, false) AS multi, list_intersect(terms, {_sql(AMBIGUOUS)}) AS vague, pw > 0 OR sw > 0 OR hits > 0 AS signal,
  v_calls IS NOT NULL OR v_defines IS NOT NULL OR v_entrypoints IS NOT NULL AS strong, imports_changed OR imported_by_changed OR has_tests OR (test AND test_for IS NOT NULL) OR co_changed > 0 AS linked FROM g),
i AS (SELECT *, len(vague) > 0 AND NOT list_has_any(terms, {_sql(CONCRETE)}) AS unclear, array_to_string(list_sort(vague)[1:3], ', ') AS labels, hits >= 2 AND pw = 0 AND sw = 0 AND (strong OR len(ph) > 0) AS direct, {' OR '.join(f'v_{x} IS NOT NULL' for x, *_ in SUMMARY_FIELDS)} OR v_naming_keywords IS NOT NULL AS matched FROM h),
j AS (SELECT *, unclear AND hits >= 1 AND (sw > 0 OR rol) AS restored, len(terms) > 0 AND len(list_filter(terms, lambda t: NOT list_contains({_sql(RELEASE_TERMS)}, t))) = 0 AND NOT (linked OR len(ph) > 0 OR v_entrypoints IS NOT NULL OR v_external_systems IS NOT NULL OR v_defines IS NOT NULL) AS reltask,
  changed OR staged OR sw > 0 OR hits > 0 OR matched OR linked OR config OR (signal AND rol) OR recent AS backed, too_large AND (hits >= 2 OR v_calls IS NOT NULL OR v_defines IS NOT NULL OR len(ph) > 0 OR imports_changed OR imported_by_changed OR co_changed > 0) AS large,
  api > 0 OR direct OR imports_changed OR co_changed > 0 OR len(ph) > 0 OR strong OR len(lits) > 0 OR imported_by_changed OR (test AND test_for IS NOT NULL) OR config OR has_tests AS firm,
  CAST(pw > 0 AS INT) + CAST(sw > 0 AS INT) + CAST(hits > 0 AS INT) + CAST(v_domain IS NOT NULL AS INT) + CAST(v_naming_keywords IS NOT NULL AS INT) + CAST(v_ranking_keywords IS NOT NULL AS INT) + CAST(v_role IS NOT NULL AS INT) AS nk FROM i),
k AS (SELECT *, NOT test AND NOT firm AND nk >= 2 AND len(route) = 0 AND NOT (hits >= 4 AND sw > 0) AS falsehit FROM j), y AS (SELECT source, path, skipped, list_filter([{first}, {', '.join(clauses)}], lambda x: x IS NOT NULL) AS c FROM k), z AS (SELECT source, path, skipped, list_reduce(c, {fold}) AS e FROM y)
SELECT source, path, CASE WHEN skipped THEN {w.ignored_penalty} ELSE round(e.v, 6) END AS score, CASE WHEN skipped THEN 'ignored/binary' ELSE array_to_string(e.r, '; ') END AS reasons FROM z"""


@query("RNK01", _oracle())
def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and reasons of every document for the task of its source, by all clauses of the scorer."""
    docs = read(spark, sf_dir, "documents")
    lists = {f: F.expr(e.format(a="array(", z=")", none="cast(array() as array<string>)")) for f, e in LISTS.items()}
    flags = {c: F.expr(e) for c, e in (FLAGS | NUMBERS | {"test_for": TEST_FOR}).items()}
    rows = docs.select(F.col("source").alias("g"), F.expr(PLACE).alias("path"), "text", *(v.alias(c) for c, v in (flags | lists).items()))
    as_map = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))
    as_list = lambda values: F.array(*map(F.lit, values))
    tasks = docs.select("source").distinct().select(
        F.col("source").alias("g"), as_map(WEIGHTS).alias("weights"), as_map(PHRASES).alias("phrase_weights"), as_list(LITERALS).alias("literals"), as_list(CONCRETE).alias("concrete"), as_list(AMBIGUOUS).alias("ambiguous"),
        as_list(SCOPE).alias("scope_terms"), F.expr(KIND).alias("kind"), F.lit("bugfix").alias("task_class"), F.expr(ROOT).alias("scope_is_root"), F.lit(5).alias("churn_edge"),
    )
    found = scoring.score(rows, tasks)
    return found.select(F.col("g").alias("source"), "path", F.round("score", 6).alias("score"), F.array_join("reasons", "; ").alias("reasons"))
