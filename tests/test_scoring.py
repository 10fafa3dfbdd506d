"""The scorer's clauses against a plain loop over random candidates and tasks."""

import random
import re

import pytest

from corpuscle.operators import scoring
from corpuscle.operators.boosts import CONFIG_STEMS, CONFIG_SUFFIXES
from corpuscle.operators.related import IMPLEMENTATION_ROLES, NOISE
from corpuscle.operators.scoring import BUILD_TERMS, GENERIC_RANKING, GENERIC_TERMS, GENERIC_VALUES, RELEASE_TERMS, SUMMARY_FIELDS, TEST_TERMS, Weights

FIELDS = [f for f, *_ in SUMMARY_FIELDS]
ROW = "g string, path string, text string, skipped boolean, changed boolean, staged boolean, recent boolean, too_large boolean, secret boolean, imports_changed boolean, imported_by_changed boolean, has_tests boolean, test_for string, churn int, co_changed int, symbols array<string>, naming_keywords array<string>, generic_names array<string>, " + ", ".join(f"{f} array<string>" for f in FIELDS)
TASK = "g string, weights map<string,double>, phrase_weights map<string,double>, literals array<string>, concrete array<string>, ambiguous array<string>, scope_terms array<string>, kind string, task_class string, scope_is_root boolean, churn_edge int"
WORDS = ["order", "user", "auth", "login", "cache", "page", "test", "release", "build", "config", "env", "io", "api", "token", "route", "sync"]


def tokens(value):
    return [t for t in re.split("[^a-zA-Z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", value or "").lower()) if t]


def stem_of(name):
    return re.sub(r"(?<=.)\.[^./]+$", "", name)


def plain(r, t, w):
    """(score, reasons), clause by clause."""
    if r["skipped"]:
        return w.ignored_penalty, ["ignored/binary"]
    keys = {k: v for k, v in t["weights"].items() if len(k) >= 3}
    flat = lambda v: " ".join(tokens(v))
    held = lambda v: {p for p in t["phrase_weights"] if p in flat(v)}
    worth = lambda v: max([keys[x] for x in tokens(v) if x in keys] + [t["phrase_weights"][p] for p in held(v)] + [0.0])
    top = lambda ps: max(sorted(ps), key=lambda p: t["phrase_weights"][p])
    path, name = r["path"], r["path"].split("/")[-1]
    parts, low, stem = path.split("/"), name.lower(), stem_of(name)
    own = {x for p in [*parts[:-1], stem] for x in tokens(p)}
    suffix = low[len(stem_of(low)) :]
    test = stem.startswith("test_") or stem.endswith(("_test", ".test", ".spec")) or bool({"tests", "__tests__"} & set(parts))
    config = suffix in CONFIG_SUFFIXES or stem.lower() in CONFIG_STEMS or bool({"config", "conf"} & set(re.split("[^a-z0-9]+", low)))
    score, said = 0.0, []

    def add(points, reason=None):
        nonlocal score
        score += points
        if reason:
            said.append(reason)

    begins = lambda *p: any(s.startswith(p) for s in said)
    if r["changed"]:
        add(w.modified, "modified")
    if r["staged"]:
        add(w.staged, "staged")
    fname = worth(path)
    if fname:
        add(w.filename_keyword * fname, "filename keyword match")
    phrases = held(path)
    if phrases:
        add(min(28.0, 18.0 * t["phrase_weights"][top(phrases)]), f"keyword phrase match: {top(phrases)}")
    if t["scope_terms"] and t["kind"] != "test" and set(t["scope_terms"]) <= own:
        add(160.0, "conventional scope path match")
    n = len({x for x in t["concrete"] if x not in GENERIC_TERMS and x in own})
    if n >= 2 and not (test and t["kind"] != "test"):
        bonus = min(210.0 if config else 150.0, 70.0 + 35.0 * min(2, n - 2) + ((105.0 if t["task_class"] in ("infra", "release") else 20.0) if config else 0.0))
        add(bonus, f"multi-term path match +{bonus:.0f}")
    sym = max([worth(s) for s in r["symbols"]] + [0.0])
    if sym:
        add(w.symbol_keyword * sym, "symbol keyword match")
    matched = {x for v in [path, *r["symbols"]] for x in tokens(v) if x in keys}
    for field, label, amount, presence in SUMMARY_FIELDS:
        values = r[field]
        best, weight = "", 0.0
        for v in values:
            if worth(v) > weight:
                best, weight = v, worth(v)
        if not weight and values and set(presence) & keys.keys():
            best, weight = values[0], 0.6
        if not weight:
            continue
        most = min(amount, 16.0) if field in ("role", "domain") and best in GENERIC_VALUES else min(amount, 10.0) if field == "ranking_keywords" and best in GENERIC_RANKING else amount
        add(most * weight)
        if field == "defines":
            k = len({x for x in tokens(best) if x in keys and x in t["concrete"] and x not in GENERIC_TERMS})
            if k >= 2:
                add(min(120.0, 55.0 * (k - 1)), f"multi-token defines match +{min(120.0, 55.0 * (k - 1)):.0f}: {best}")
            lit = [p for p in sorted(t["literals"]) if p in flat(best) or flat(best) in p]
            if lit:
                add(150.0, f"literal definition match: {max(lit, key=len)}")
        said.append(f"{label}: {best}")
    values, best, weight = r["naming_keywords"], "", 0.0
    for v in values:
        if worth(v) > weight:
            best, weight = v, worth(v)
    if weight:
        add(min(20.0, weight * 18.0), f"matched naming keyword: {best}")
    if r["generic_names"] and not fname and not sym:
        add(min(-6.0, w.weak_filename_match_penalty / 2), f"generic public API penalty: {r['generic_names'][0]}")
    lower = [p.lower() for p in parts]
    behind = lower[lower.index("api") + 1 :] if "api" in lower else []
    if behind and stem_of(behind[-1]) in ("route", "routes", "urls", "views", "controller"):
        behind = behind[:-1]
    route = list(dict.fromkeys(x for p in behind if (q := p.strip("[](){}")) and not q.startswith("_") for x in tokens(q) if x not in NOISE))
    hit = [x for x in route if x in keys and x not in NOISE]
    if hit:
        add(170.0 + 35.0 * min(2, len(hit) - 1), "API route owner match: /api/" + "/".join(route))
    found = {x for x in tokens(r["text"]) if x in keys}
    hits = len(found)
    matched |= found
    if hits:
        add(min(w.content_keyword_max, sum(keys[x] for x in found) * w.content_keyword_per_hit), f"content keyword match ({hits})")
    lit = [p for p in sorted(t["literals"]) if p in flat(path) + " " + flat(r["text"])]
    if lit:
        add(360.0, f"quoted literal match: {max(lit, key=len)}")
    elif t["kind"] == "chore" and t["literals"] and (fname or sym):
        score *= 0.55
        said.append("chore literal partial-match dampening")
    phrases |= held(r["text"])
    if phrases:
        add(min(20.0, 14.0 * t["phrase_weights"][top(phrases)]))
        if not begins("keyword phrase match:"):
            said.append(f"keyword phrase match: {top(phrases)}")
    if hits >= 2 and not fname and not sym:
        strong = begins("matched call:", "matched define:", "literal definition match:", "multi-token defines match", "matched entrypoint:")
        if strong or begins("keyword phrase match:"):
            bonus = 120.0 + 50.0 * min(3, hits - 2)
            bonus = min(270.0, bonus if strong else min(45.0, bonus))
            add(bonus, f"direct content evidence +{bonus:.0f}")
    role = bool(own & set(IMPLEMENTATION_ROLES))
    vague = sorted(matched & set(t["ambiguous"]))
    if vague and not matched & set(t["concrete"]):
        if hits >= 1 and (sym or role):
            add(min(24.0, 10.0 + 6.0 * min(hits, 3)), "ambiguous term restored by corroboration: " + ", ".join(vague[:3]))
        elif fname and not hits and not sym:
            score = max(0.0, score - 8.0)
            said.append("ambiguous term cap: " + ", ".join(vague[:3]))
    if (fname or sym or hits) and role:
        add(w.implementation_role, "implementation role match")
    elif r["changed"]:
        said.append("modified workspace context only")
    if t["kind"] == "test" or set(TEST_TERMS) & keys.keys():
        if test:
            add(130.0 if "e2e" in lower else 95.0, "explicit test task file")
        elif not config:
            score = max(0.0, score * 0.72)
            said.append("explicit test task non-test dampening")
    if r["imports_changed"]:
        add(w.direct_dep, "direct dependency of changed file")
    if r["imported_by_changed"]:
        add(w.reverse_dep, "reverse dependency")
    if r["has_tests"]:
        add(w.related_test, "has related tests")
    elif route:
        said.append("no direct tests found for endpoint")
    if test and r["test_for"]:
        add(w.related_test, f"test for {r['test_for']}")
    if config:
        add(w.config_file, "config file")
    if set(BUILD_TERMS) & keys.keys() and len(parts) == 1 and low in scoring.BUILD_FILES:
        add(190.0 + (90.0 if low in scoring.BUILD_FIRST else 35.0), "build/dependency metadata")
    release = bool(set(RELEASE_TERMS) & keys.keys())
    meta = release and not set(lower) & set(scoring.RELEASE_FOREIGN) and (low in scoring.RELEASE_FILES or low in scoring.VERSION_FILES or "version" in low and suffix in scoring.VERSION_SUFFIXES)
    if meta:
        add(110.0 + (70.0 if low in scoring.RELEASE_FIRST or low in scoring.VERSION_FILES else 0.0), "release/version metadata")
    if r["secret"]:
        add(w.modified, "secret redaction candidate")
    if stem.lower() in scoring.KNOWLEDGE_NAMES:
        known = suffix == ".md"
    else:
        known = bool(re.match(r"adr[-_]?\d+", stem.lower())) or suffix == ".md" and bool(set(lower) & set(scoring.KNOWLEDGE_FOLDERS))
    if known:
        add(w.knowledge_file, "knowledge/architecture doc")
    if r["recent"]:
        add(w.recently_modified, "recently modified")
    if t["churn_edge"] is not None and r["churn"] >= t["churn_edge"]:
        add(w.churn_high, f"high churn ({r['churn']} commits)")
    if r["co_changed"] > 0:
        add(w.co_changed * min(1.0, 0.5 + r["co_changed"] / 4), f"historically co-changed ({r['co_changed']} commits)")
    linked = ("direct dependency", "reverse dependency", "historically co-changed", "has related tests", "test for")
    if release and not meta and matched and matched <= set(RELEASE_TERMS) and not begins(*linked, "keyword phrase match", "matched entrypoint", "matched external system", "matched define", "multi-token"):
        score = max(0.0, score * 0.35)
        said.append("release-term-only non-metadata dampening")
    if t["kind"] != "test" and t["scope_is_root"] and t["scope_terms"] and not set(t["scope_terms"]) <= own:
        score = max(0.0, score * 0.62)
        said.append("conventional scope mismatch dampening")
    if fname and not begins("modified", "staged", "symbol keyword match", "content keyword match", "matched ", *linked, "config file", "knowledge/architecture doc", "implementation role match", "recently modified"):
        score = max(1.0, score + w.weak_filename_match_penalty)
        said.append(f"weak filename-only match {w.weak_filename_match_penalty:.0f}")
    if r["too_large"] and (hits >= 2 or begins("matched call:", "matched define:", "multi-token", "keyword phrase match:", "direct dependency", "reverse dependency", "historically co-changed")):
        add(120.0, "large supported file")
    elif r["too_large"] and score < 50:
        add(w.large_unrelated_penalty, "large unrelated file")
    firm = begins("API route owner match", "direct content evidence", "direct dependency", "historically co-changed", "keyword phrase match:", "literal definition match:", "matched call:", "matched define:", "matched entrypoint:", "multi-token", "quoted literal match:", "reverse dependency", "test for")
    firm = firm or bool({"build/dependency metadata", "config file", "has related tests", "knowledge/architecture doc", "release/version metadata"} & set(said))
    plainly = sum(s in ("filename keyword match", "symbol keyword match") or s.startswith(("content keyword match", "matched domain:", "matched naming keyword:", "matched ranking keyword:", "matched role keyword:")) for s in said)
    if not test and not firm and plainly >= 2 and not route and not (hits >= 4 and "symbol keyword match" in said):
        score = max(0.0, score * 0.72)
        said.append("likely false positive: keyword-only match")
    if suffix == ".go" and ("symbol keyword match" in said or begins("matched define:", "matched ranking keyword:", "matched role keyword:")):
        root = len(parts) == 1 and not test
        owner = hits >= 5 or begins("conventional scope path match", "direct content evidence", "keyword phrase match:", "literal definition match:", "multi-term path match", "quoted literal match:", "test for ") or "explicit test task file" in said
        owner = owner or root and "filename keyword match" in said and begins("matched role keyword:")
        if not owner and (root or test and hits <= 2):
            score = max(0.0, score * 0.45)
            said.append("broad Go symbol carrier dampening")
    for hit_, reason in ((path.startswith(".agent/"), "generated agent artifact dampening"), (bool({".cxx", ".gradle", "intermediates", "outputs"} & set(parts)), "generated Android build artifact dampening")):
        if hit_:
            score = min(score, 160.0) if r["changed"] else min(score * 0.25, 80.0)
            said.append(reason)
    return score, said


def some(rng, n):
    flip = lambda p=0.3: rng.random() < p
    phrase = lambda: " ".join(rng.sample(WORDS, 2))
    ident = lambda: rng.choice(WORDS) + rng.choice(WORDS).title() + rng.choice(["", "_x", "Y"])
    folders = ["src", "src/api", "tests", "docs", "services/api", "apps/web", ".agent", "build/outputs", "design", "e2e/tests", ""]
    names = ["main.py", "pom.xml", "package.json", "README.md", "adr-12.md", "version.py", "test_order.go", "userAuth.go", "order_test.go", "route.ts", "loginPage.tsx", "settings.toml", "architecture.md", "cache.spec.ts", "token.go", "orderService.py", "webConf.js"]
    some_of = lambda k: [ident() if flip(0.6) else rng.choice(["api", "frontend", "handler", "entrypoint", *WORDS, phrase()]) for _ in range(rng.randint(0, k))]
    tasks = []
    for g in ("a", "b", "c", None):
        keys = rng.sample(WORDS, rng.randint(1, 9))
        tasks.append({"g": g, "weights": {k: rng.choice([0.25, 0.5, 1.0, 1.25]) for k in keys}, "phrase_weights": {phrase(): rng.choice([0.5, 1.0, 2.0]) for _ in range(rng.randint(0, 6))}, "literals": [phrase() for _ in range(rng.randint(0, 3))], "concrete": rng.sample(WORDS, 6), "ambiguous": rng.sample(WORDS, 5), "scope_terms": rng.choice([[], ["order"], ["user", "auth"]]), "kind": rng.choice(["", "fix", "chore", "test"]), "task_class": rng.choice(["bugfix", "infra"]), "scope_is_root": flip(0.5), "churn_edge": rng.choice([None, 4])})
    rows = []
    for i in range(n):
        folder = rng.choice(folders)
        rows.append({"g": rng.choice(["a", "b", "c", None]), "path": (folder + "/" if folder else "") + (f"d{i}/" if flip(0.6) else "") + rng.choice([*names, f"{ident()}.go", f"{rng.choice(WORDS)}.py"]), "text": None if flip(0.1) else " ".join(rng.choice([*WORDS, "filler", ident(), "x"]) for _ in range(rng.randint(0, 12))), "skipped": flip(0.04), "changed": flip(0.2), "staged": flip(0.05), "recent": flip(0.1), "too_large": flip(0.2), "secret": flip(0.05), "imports_changed": flip(0.1), "imported_by_changed": flip(0.1), "has_tests": flip(0.1), "test_for": rng.choice([None, None, "src/x.py"]), "churn": rng.randint(0, 5), "co_changed": rng.choice([0, 0, 0, 1, 9]), "symbols": some_of(2), "naming_keywords": some_of(1), "generic_names": ["get"] if flip(0.1) else [], **{f: some_of(2) if flip() else [] for f in FIELDS}})
    return rows, tasks


@pytest.mark.parametrize(("seed", "weights"), [(1, Weights()), (2, Weights(modified=7.0, filename_keyword=11.0, weak_filename_match_penalty=-90.0, content_keyword_max=15.0))])
def test_every_clause_equals_the_loop(spark, seed, weights):
    rows, tasks = some(random.Random(seed), 900)
    got = scoring.score(spark.createDataFrame(list({(r["g"], r["path"]): r for r in rows}.values()), ROW), spark.createDataFrame(tasks, TASK), weights).collect()
    of, seen = {t["g"]: t for t in tasks}, {(r["g"], r["path"]): r for r in rows}
    assert len(got) == len(seen)
    kinds = set()
    for r in got:
        want, said = plain(seen[r["g"], r["path"]], of[r["g"]], weights)
        assert r["reasons"] == said, (seen[r["g"], r["path"]], of[r["g"]])
        assert abs(r["score"] - want) < 1e-9
        kinds |= {re.split("[:(+]", s)[0].strip() for s in said}
    assert len(kinds) > 40


def test_few_columns_and_no_task(spark):
    rows = spark.createDataFrame([("a", "src/order.py", "order"), ("z", "x.py", "t"), ("a", None, "t")], "g string, path string, text string")
    tasks = spark.createDataFrame([("a", {"order": 1.0}, None, None, None, None, None, None, None, None, None)], TASK)
    got = {r["path"]: (r["score"], r["reasons"]) for r in scoring.score(rows, tasks).collect()}
    assert got == {"src/order.py": ((80.0 + 10.0) * 0.72, ["filename keyword match", "content keyword match (1)", "likely false positive: keyword-only match"])}
    assert scoring.score(rows.where("false"), tasks).count() == 0
