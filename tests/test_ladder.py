"""The ladder selection against a plain loop over the sorted rows, written on its own."""

import random

import pytest

from corpuscle.operators import ladder
from corpuscle.operators.ladder import Policy

SCHEMA = (
    "g string, i long, s double, t long, o double, blocked boolean, changed boolean, task_signal boolean, weak boolean, docs boolean, secret boolean, bypass boolean, primary boolean, secondary boolean, support boolean, "
    "test boolean, strong_test boolean, playground_test boolean, strong boolean, yields boolean, noise string, family string, scope string, pair_of string, playground string, family_cap int, evidence double, "
    "diff_tokens long, skeleton_tokens long, summary_tokens long"
)


def some(rng, n, changed=0.02):
    flip = lambda p: rng.random() < p
    rows = []
    for i in range(n):
        t = rng.randint(0, 3000)
        rows.append({
            "g": rng.choice(["a", "a", "b", None]), "i": i, "s": rng.choice([-5.0, 0.0, *[float(rng.randint(1, 400))] * 8, None]), "t": rng.choice([t, t, t, None]), "o": rng.choice([float(rng.randint(0, 50)), None]),
            "blocked": flip(0.03), "changed": flip(changed), "task_signal": flip(0.5), "weak": flip(0.15), "docs": flip(0.1), "secret": flip(0.03), "bypass": flip(0.2), "primary": flip(0.03), "secondary": flip(0.05), "support": flip(0.8),
            "test": (test := flip(0.3)), "strong_test": test and flip(0.3), "playground_test": flip(0.05), "strong": flip(0.3), "yields": flip(0.4), "noise": "noise" if flip(0.05) else None,
            "family": (f := rng.choice(["tests", "config", "docs", None, None])), "scope": rng.choice(["x", "y", None]), "pair_of": str(rng.randrange(n)) if flip(0.05) else None, "playground": rng.choice(["p", None]),
            "family_cap": {"tests": 2, "config": 1, "docs": 0}.get(f, 0), "evidence": float(rng.randint(-150, 400)), "diff_tokens": rng.choice([None, 150]), "skeleton_tokens": rng.choice([None, rng.randint(20, 180)]), "summary_tokens": rng.choice([None, rng.randint(10, 200)]),
        })
    return rows


def plain(rows, p):
    """item -> (action, mode, tokens, reason) of one group."""
    n_changed = sum(r["changed"] for r in rows)
    done, picks, used, shorts, weaks, unrelated, primary = {}, [], 0, 0, 0, 0, False
    quota, families = {"same-package test overflow": 1, "same-playground test overflow": 1, "strong-test cap overflow": 2}, {}
    dense = lambda tok: min(35.0, 1200.0 / max(tok, 40)) if tok > 0 else 0.0

    def rival(r, tok, extra, strong_extra, family=None):
        found = []
        for n, q in enumerate(picks):
            if q["mode"] not in ("summary", "skeleton") or q["passed"]:
                continue
            d = tok - q["tok"]
            special = r["strong"] and q["r"]["yields"] and d <= strong_extra and tok <= 220 and r["s"] >= 180
            other = q["r"]["scope"] is not None and q["r"]["scope"] != r["scope"]
            if (d > extra or other) and not special or r["test"] and not r["strong_test"] or family and q["r"]["family"] != family:
                continue
            gain = r["evidence"] + dense(tok) - q["r"]["evidence"] - dense(q["tok"])
            if gain > 0 and gain >= (45 + max(0, d) * 0.04 if special else 70 + max(0, d) * 0.15):
                found.append((-gain, n))
        return min(found)[1] if found else None

    def displace(n, r):
        nonlocal used, shorts
        q = picks.pop(n)
        used, shorts = used - q["tok"], shorts - 1
        if q["counted"]:
            families[q["r"]["family"]] -= 1
        done[q["r"]["i"]] = ("excluded", q["mode"], q["tok"], f"marginal slot replaced by {r['i']}")

    def passes(r, tok, kind):
        if not quota[kind] or n_changed or p.mode != "balanced":
            return False
        if kind.startswith("same-pack"):
            return any(str(q["r"]["i"]) == r["pair_of"] and not q["r"]["test"] for q in picks)
        if kind.startswith("same-play"):
            return r["playground_test"] and r["playground"] is not None and any(q["r"]["playground"] == r["playground"] for q in picks)
        near = sum(q["r"]["test"] and q["r"]["scope"] == r["scope"] for q in picks) if r["scope"] else 0
        return r["strong_test"] and tok <= 160 and r["s"] >= 300 and near < 2

    for r in sorted(rows, key=lambda r: (-r["o"] if r["o"] is not None else float("inf"), str(r["i"]))):
        r = r | {"s": r["s"] or 0.0, "t": r["t"] or 0}
        few = r["summary_tokens"] if r["summary_tokens"] is not None else min(r["t"], 200)
        fits = r["t"] <= p.max_file_tokens
        if r["changed"]:
            crowded = p.budget < 12000 or n_changed > 5
            mode = "full" if fits and (r["t"] <= 600 or r["task_signal"] and not crowded) else "diff" if r["diff_tokens"] is not None else "symbols" if r["task_signal"] else "skeleton" if r["skeleton_tokens"] is not None else "summary"
        elif fits and r["secret"] or p.mode == "deep" and fits and r["s"] >= 120:
            mode = "full"
        else:
            mode = "skeleton" if not r["weak"] and r["skeleton_tokens"] is not None and r["s"] >= 160 else "summary"
        tok = {"full": r["t"], "diff": r["diff_tokens"], "symbols": min(r["t"], p.max_file_tokens // 2), "skeleton": r["skeleton_tokens"], "summary": few}[mode]
        first = (mode, tok)
        no = lambda why: done.__setitem__(r["i"], ("excluded", mode, tok, why))  # noqa: B023, E731
        if r["blocked"]:
            no("ignored or binary")
        elif r["s"] <= 0:
            no("score too low")
        elif not r["changed"] and r["docs"] and p.mode != "deep":
            no("docs disabled by mode")
        elif r["changed"] and not r["task_signal"] and n_changed > 5 and unrelated >= 3:
            no("unrelated changed-file safety cap")
        else:
            unrelated += r["changed"] and not r["task_signal"] and n_changed > 5
            weak = r["weak"] and not r["changed"]
            if weak and 0 <= p.max_weak <= weaks:
                no("weak-signal cap reached")
                continue
            if primary and r["secondary"] and not r["changed"]:
                no("secondary release metadata skipped after primary")
                continue
            if not r["changed"] and not (p.mode == "deep" and fits) and r["s"] < p.summary_floor and not r["bypass"] and not r["secret"]:
                no("summary score below floor")
                continue
            reason = "selected"
            if used + tok > p.budget and mode != "summary":
                rungs = sorted(([("skeleton", r["skeleton_tokens"])] if r["skeleton_tokens"] is not None else []) + [("summary", few)], key=lambda x: x[1])
                for rung, cost in rungs:
                    if used + cost <= p.budget:
                        mode, tok, reason = rung, cost, f"value optimizer downgraded to {rung}"
                        break
            short, guarded, passed = mode in ("summary", "skeleton"), p.mode == "balanced" and not r["changed"], None
            if mode == "summary" and p.max_summaries < 0:
                no("summaries disabled by precision guard")
                continue
            if short and guarded and r["noise"]:
                no(r["noise"])
                continue
            if p.strict and short and not r["changed"] and not r["support"]:
                no("compressed context needs stronger support signal")
                continue
            counted = p.strict and short and guarded and r["family"] is not None
            if counted and families.get(r["family"], 0) >= r["family_cap"]:
                if r["family"] == "tests" and passes(r, tok, "strong-test cap overflow"):
                    passed = "strong-test cap overflow"
                else:
                    n = rival(r, tok, min(120, max(0, p.budget - used)), 0, r["family"])
                    if n is not None:
                        displace(n, r)
                    if n is None or families.get(r["family"], 0) >= r["family_cap"]:
                        no(f"{r['family']} compressed context cap reached")
                        continue
            if short and 0 < p.max_summaries <= shorts and not passed:
                kinds = list(quota)[: 3 if p.max_summaries >= 3 else 2]
                passed = next((k for k in kinds if passes(r, tok, k)), None)
                if not passed:
                    n = rival(r, tok, min(120, max(0, p.budget - used)), min(220, max(0, p.budget - used)))
                    if n is None:
                        no("compressed context cap reached")
                        continue
                    displace(n, r)
            if used + tok > p.budget and (n := rival(r, tok, 0, 0)) is not None:
                displace(n, r)
            if used + tok > p.budget:
                no("budget exhausted")
                continue
            used, shorts, weaks, primary = used + tok, shorts + short, weaks + weak, primary or r["primary"]
            if passed:
                quota[passed] -= 1
                reason = passed
            if counted:
                families[r["family"]] = families.get(r["family"], 0) + 1
            picks.append({"r": r, "mode": mode, "tok": tok, "passed": bool(passed) and passed.startswith("same"), "counted": counted})
            done[r["i"]] = ("included" if mode == "full" else "summarized", mode, tok, reason)
        assert first
    assert used <= p.budget
    return done


@pytest.mark.parametrize(
    ("seed", "chunk", "changed", "policy"),
    [
        (1, 20_000, 0.0, Policy(budget=3000, strict=True, max_summaries=6, summary_floor=50)),
        (2, 7, 0.0, Policy(budget=1500, strict=True, max_weak=2)),
        (3, 5, 0.03, Policy(budget=2500, max_summaries=4, strict=True, max_weak=0)),
        (4, 11, 0.1, Policy(budget=13_000, mode="deep")),
        (5, 13, 0.01, Policy(budget=1200, mode="lite", max_summaries=-1)),
        (6, 9, 0.0, Policy(budget=900, max_summaries=3)),
    ],
)
def test_equals_the_plain_loop(spark, seed, chunk, changed, policy):
    rows = some(random.Random(seed), 150, changed)
    from pyspark.sql import functions as F

    got = ladder.select(spark.createDataFrame(rows, SCHEMA), "g", "i", "s", "t", [F.col("o")], policy, chunk).collect()
    want = {}
    for g in ("a", "b", None):
        want |= plain([r for r in rows if r["g"] == g], policy)
    assert len(got) == len(rows)
    assert {r["i"]: (r["action"], r["mode"], r["tokens"], r["reason"]) for r in got} == want
    if seed in (1, 3):
        assert any(r["reason"].startswith("marginal slot") for r in got) and any("downgraded" in r["reason"] or "cap reached" in r["reason"] for r in got)


def test_no_candidates_and_few_columns(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], "g string, i long, s double, t long")
    assert ladder.select(none, "g", "i", "s", "t", [F.col("s")]).count() == 0
    two = spark.createDataFrame([("a", 1, 5.0, 100), ("a", 2, 4.0, None)], "g string, i long, s double, t long")
    assert {(r["i"], r["mode"], r["tokens"]) for r in ladder.select(two, "g", "i", "s", "t", [F.col("s")]).collect()} == {(1, "summary", 100), (2, "summary", 0)}
