"""Stateful selection under a budget: a ladder of modes, caps with overflow quotas, displacement, receipts for every row."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpuscle.shared import cut

#: What a displacement must gain, by kind: (least gain, gain for each further token), and evidence of tokens.
PLAIN_GAIN, STRONG_GAIN, LEAST_GAIN = (70.0, 0.15), (45.0, 0.04), 45.0
DENSITY_MOST, DENSITY_UNIT, DENSITY_LEAST_TOKENS = 35.0, 1200.0, 40
#: Tokens that a displacement may add within a cap, for plain and strong challengers, and the most of a strong one.
PLAIN_EXTRA, STRONG_EXTRA, STRONG_TOKENS, STRONG_SCORE = 120, 220, 220, 180.0
#: How often each cap may be passed, and what a strong test is.
QUOTAS = {"same-package test overflow": 1, "same-playground test overflow": 1, "strong-test cap overflow": 2}
STRONG_TEST_TOKENS, STRONG_TEST_SCORE, TESTS_OF_SCOPE = 160, 300.0, 2
#: Tokens of a summary and of a small changed row, and the scores that earn a full text or a skeleton.
SUMMARY_TOKENS, SMALL_CHANGED, FULL_SCORE, SKELETON_SCORE = 200, 600, 120.0, 160.0
#: Beyond so many changed rows, or below that budget, only what matches the task is given in full.
MANY_CHANGED, TIGHT_BUDGET, UNRELATED_CAP = 5, 12_000, 3
SHORT = ("summary", "skeleton")

#: Columns of a candidate beside group, item, score and tokens, and what stands for one that is missing.
DEFAULTS = {
    "blocked": "false", "changed": "false", "task_signal": "false", "weak": "false", "docs": "false", "secret": "false", "bypass": "false",
    "primary": "false", "secondary": "false", "support": "true", "test": "false", "strong_test": "false", "playground_test": "false", "strong": "false", "yields": "false",
    "noise": "cast(null as string)", "family": "cast(null as string)", "scope": "cast(null as string)", "pair_of": "cast(null as string)", "playground": "cast(null as string)",
    "family_cap": "0", "evidence": "0.0D", "diff_tokens": "cast(null as bigint)", "skeleton_tokens": "cast(null as bigint)", "summary_tokens": "cast(null as bigint)",
}


@dataclass(frozen=True)
class Policy:
    """What a selection may do. max_summaries: 0 is no cap, less forbids summaries; max_weak: less than 0 is no cap."""

    mode: str = "balanced"
    budget: int = 20_000
    max_file_tokens: int = 2_000
    summary_floor: float = 0.0
    max_summaries: int = 0
    max_weak: int = -1
    strict: bool = False

    @property
    def deep(self) -> bool:
        return self.mode == "deep"


def candidates(df: DataFrame, group: str, item: str, score: str, tokens: str, order: list[Column], policy: Policy) -> DataFrame:
    """The narrow rows that are folded: key k (order, falling; then the item), mode, tokens of each rung, and what excludes a row at once."""
    given = {c: F.col(c) if c in df.columns else F.expr(d) for c, d in DEFAULTS.items()}
    tok = F.greatest(F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)), F.lit(0))
    flags = {c: F.coalesce(v, F.expr(DEFAULTS[c])) if DEFAULTS[c] in ("true", "false") else v for c, v in given.items()}
    key = F.struct(*(F.coalesce(-F.nanvl(o.cast("double"), F.lit(float("-inf"))), F.lit(float("inf"))).alias(f"o{n}") for n, o in enumerate(order)), F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.monotonically_increasing_id().alias("id"))
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.nanvl(F.coalesce(F.col(score).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("s"), tok.alias("t"), key.alias("k"), *(v.alias(c) for c, v in flags.items()))
    rows = cut(rows)
    many = rows.groupBy(F.col("g").alias("h")).agg(F.count_if("changed").alias("n_changed"))
    rows = rows.join(many, F.col("g").eqNullSafe(F.col("h"))).drop("h")
    crowded = F.col("n_changed") > MANY_CHANGED
    pressed = F.lit(policy.budget < TIGHT_BUDGET) | crowded
    fits, brief = F.col("t") <= policy.max_file_tokens, F.coalesce("summary_tokens", F.least("t", F.lit(SUMMARY_TOKENS)))
    half = F.least("t", F.lit(policy.max_file_tokens // 2))
    lean = F.when(F.col("skeleton_tokens").isNotNull(), "skeleton").otherwise("summary")
    in_full = fits & ((F.col("t") <= SMALL_CHANGED) | (F.col("task_signal") & ~pressed))
    changed = F.when(in_full, "full").when(F.col("diff_tokens").isNotNull(), "diff").when(F.col("task_signal"), "symbols").otherwise(lean)
    other = F.when(fits & F.col("secret"), "full")
    if policy.deep:
        other = other.when(fits & (F.col("s") >= FULL_SCORE), "full")
    other = other.when(F.col("weak"), "summary").when(F.col("skeleton_tokens").isNotNull() & (F.col("s") >= SKELETON_SCORE), "skeleton").otherwise("summary")
    mode = F.when(F.col("changed"), changed).otherwise(other)
    cost = F.when(mode == "full", F.col("t")).when(mode == "diff", F.col("diff_tokens")).when(mode == "symbols", half).when(mode == "skeleton", F.col("skeleton_tokens")).otherwise(brief)
    out = F.when(F.col("blocked"), "ignored or binary").when(F.col("s") <= 0, "score too low")
    if not policy.deep:
        out = out.when(~F.col("changed") & F.col("docs"), "docs disabled by mode")
    short = ~F.col("changed") & ~(fits if policy.deep else F.lit(False))
    below = short & (F.col("s") < policy.summary_floor) & ~F.col("bypass") & ~F.col("secret")
    rows = rows.withColumns({"mode": mode, "tok": cost.cast("bigint"), "brief": brief.cast("bigint"), "out": out, "below": below, "capped": crowded & F.col("changed") & ~F.col("task_signal")})
    return rows.withColumn("least", F.when(F.col("mode") == "summary", F.col("tok")).otherwise(F.least("tok", "skeleton_tokens", "brief"))).drop("n_changed", "blocked", "docs", "secret", "bypass", "diff_tokens", "t")


def density(tokens: int) -> float:
    return min(DENSITY_MOST, DENSITY_UNIT / max(tokens, DENSITY_LEAST_TOKENS)) if tokens > 0 else 0.0


class Selection:
    """The state of one group and what the next candidate does to it. The state is bounded by the picks, and these by the budget."""

    def __init__(self, policy: Policy, state: dict | None = None):
        self.policy = policy
        self.state = state or {"used": 0, "short": 0, "weak": 0, "unrelated": 0, "primary": False, "seq": 0, "families": {}, "quotas": {}, "picks": []}

    @property
    def room(self) -> int:
        return self.policy.budget - self.state["used"]

    @property
    def low(self) -> float | None:
        """The least evidence among picks that can be displaced."""
        return min((p["evidence"] for p in self.state["picks"] if self._replaceable(p)), default=None)

    def full(self) -> list[str]:
        """What a later candidate finds used up."""
        s, p = self.state, self.policy
        out = ["unrelated"] * (s["unrelated"] >= UNRELATED_CAP) + ["weak"] * (0 <= p.max_weak <= s["weak"]) + ["primary"] * s["primary"]
        out += ["short"] * (0 < p.max_summaries <= s["short"])
        return out + [f"family:{f}:{n}" for f, n in sorted(s["families"].items())]

    @staticmethod
    def _replaceable(pick: dict) -> bool:
        return pick["mode"] in SHORT and not pick["overflow"]

    def _displaced(self, x: dict, tok: int, extra: int, strong_extra: int, family: str | None = None) -> int | None:
        """The pick that x replaces at the best gain, the earliest of equals; None if none gains enough."""
        best, at = 0.0, None
        evidence = x["evidence"] + density(tok)
        for n, p in enumerate(self.state["picks"]):
            if not self._replaceable(p):
                continue
            more = tok - p["tok"]
            strong = x["strong"] and p["yields"] and more <= strong_extra and tok <= STRONG_TOKENS and x["s"] >= STRONG_SCORE
            if more > extra and not strong:
                continue
            if p["scope"] is not None and p["scope"] != x["scope"] and not strong:
                continue
            if x["test"] and not x["strong_test"]:
                continue
            if family is not None and p["family"] != family:
                continue
            gain = evidence - p["evidence"]
            least, each = STRONG_GAIN if strong else PLAIN_GAIN
            if gain >= least + max(0, more) * each and gain > best:
                best, at = gain, n
        return at

    def _drop(self, at: int, by: str) -> tuple:
        gone, s = self.state["picks"].pop(at), self.state
        s["used"] -= gone["tok"]
        s["short"] -= gone["mode"] in SHORT
        if gone["counted"]:
            s["families"][gone["family"]] -= 1
        return (gone["id"], "excluded", gone["mode"], gone["tok"], f"marginal slot replaced by {by}")

    def _overflow(self, x: dict, tok: int, kinds: list[str]) -> str | None:
        """The first quota that lets x pass a cap."""
        picks, used = self.state["picks"], self.state["quotas"]
        for kind in kinds:
            if used.get(kind, 0) >= QUOTAS[kind]:
                continue
            if kind == "same-package test overflow":
                good = x["pair_of"] is not None and any(p["item"] == x["pair_of"] and not p["test"] for p in picks)
            elif kind == "same-playground test overflow":
                good = x["playground_test"] and x["playground"] is not None and any(p["playground"] == x["playground"] for p in picks)
            else:
                same = sum(p["test"] and p["scope"] == x["scope"] for p in picks) if x["scope"] is not None else 0
                good = x["strong_test"] and tok <= STRONG_TEST_TOKENS and x["s"] >= STRONG_TEST_SCORE and same < TESTS_OF_SCOPE
            if good:
                return kind
        return None

    def take(self, x: dict) -> list[tuple]:
        """Receipts (row, action, mode, tokens, reason) of what the candidate x does; x itself comes last."""
        s, p, out = self.state, self.policy, []
        told = lambda reason, mode=None, tok=None: [*out, (x["id"], "excluded", mode or x["mode"], x["tok"] if tok is None else tok, reason)]
        if x["capped"]:
            if s["unrelated"] >= UNRELATED_CAP:
                return told("unrelated changed-file safety cap")
            s["unrelated"] += 1
        weak = x["weak"] and not x["changed"]
        if weak and 0 <= p.max_weak <= s["weak"]:
            return told("weak-signal cap reached")
        if s["primary"] and x["secondary"] and not x["changed"]:
            return told("secondary release metadata skipped after primary")
        mode, tok, reason = x["mode"], x["tok"], "selected"
        if tok > self.room and mode != "summary":
            rungs = [(x["skeleton_tokens"], "skeleton")] if x["skeleton_tokens"] is not None else []
            for cost, rung in sorted([*rungs, (x["brief"], "summary")], key=lambda r: r[0]):
                if cost <= self.room:
                    mode, tok, reason = rung, cost, f"value optimizer downgraded to {rung}"
                    break
        if mode == "summary" and p.max_summaries < 0:
            return told("summaries disabled by precision guard", mode, tok)
        short, guarded, overflow = mode in SHORT, p.mode == "balanced" and not x["changed"], None
        if short and guarded and x["noise"]:
            return told(x["noise"], mode, tok)
        if p.strict and short and not x["changed"] and not x["support"]:
            return told("compressed context needs stronger support signal", mode, tok)
        calm = p.mode == "balanced" and not x["crowd"]
        counted = p.strict and short and guarded and x["family"] is not None
        if counted and s["families"].get(x["family"], 0) >= x["family_cap"]:
            overflow = self._overflow(x, tok, ["strong-test cap overflow"]) if calm and x["family"] == "tests" else None
            if overflow is None:
                at = self._displaced(x, tok, min(PLAIN_EXTRA, max(0, self.room)), 0, x["family"])
                if at is None:
                    return told(f"{x['family']} compressed context cap reached", mode, tok)
                out.append(self._drop(at, x["item"]))
                if s["families"].get(x["family"], 0) >= x["family_cap"]:
                    return told(f"{x['family']} compressed context cap reached", mode, tok)
        if short and 0 < p.max_summaries <= s["short"]:
            if overflow is None and calm:
                kinds = ["same-package test overflow", "same-playground test overflow"] + ["strong-test cap overflow"] * (p.max_summaries >= 3)
                overflow = self._overflow(x, tok, kinds)
            if overflow is None:
                at = self._displaced(x, tok, min(PLAIN_EXTRA, max(0, self.room)), min(STRONG_EXTRA, max(0, self.room)))
                if at is None:
                    return told("compressed context cap reached", mode, tok)
                out.append(self._drop(at, x["item"]))
        if tok > self.room:
            at = self._displaced(x, tok, 0, 0)
            if at is not None:
                out.append(self._drop(at, x["item"]))
            if tok > self.room:
                return told("budget exhausted", mode, tok)
        s["used"] += tok
        s["short"] += short
        s["weak"] += weak
        s["primary"] = s["primary"] or x["primary"]
        if overflow:
            s["quotas"][overflow] = s["quotas"].get(overflow, 0) + 1
            reason = overflow
        if counted:
            s["families"][x["family"]] = s["families"].get(x["family"], 0) + 1
        own = {c: x[c] for c in ("id", "item", "scope", "family", "test", "playground", "yields")}
        s["picks"].append(own | {"tok": tok, "mode": mode, "evidence": x["evidence"] + density(tok), "overflow": overflow in ("same-package test overflow", "same-playground test overflow"), "counted": counted})
        return [*out, (x["id"], "included" if mode == "full" else "summarized", mode, tok, reason)]


def select(df: DataFrame, group: str, item: str, score: str, tokens: str, order: list[Column], policy: Policy = Policy(), chunk: int = 20_000) -> DataFrame:
    """(group, item, action, mode, tokens, reason): one row for every candidate of every group, in the order of falling `order`.

    Modes: changed rows are given in full, as a diff, as symbols, as a skeleton or a
    summary, others in full (secrets, or high scores of a deep selection), as a skeleton
    or a summary; what does not fit is downgraded to the cheapest rung that does. Caps:
    unrelated changed rows, weak rows, families, summaries, the budget; quotas let some
    rows pass. A row that meets a cap may displace a pick of less evidence.

    A round folds, for each group, its next `chunk` rows that can still matter: rows
    that fit into what is left in their cheapest mode, whose evidence could displace
    a pick, that use up a cap or have a quota. Others follow from the state at their place. If the
    round passed rows over and the state becomes looser than at its start (a
    displacement frees tokens, a pick is easier to displace), it ends there, so no row
    is passed over wrongly. No group is one task; the state is bounded by the budget.

    Null scores and those that are no number count as 0, null tokens as none; rows that
    repeat an item are candidates of their own; a null group is a group.
    """
    rows = cut(candidates(df, group, item, score, tokens, order, policy))
    kind, of = rows.schema["g"].dataType.simpleString(), rows.schema["k"].dataType.simpleString()
    usable = rows.where("out is null and not below")
    groups = rows.groupBy("g").agg(F.max(F.when(F.col("out").isNull() & ~F.col("below"), F.col("least"))).alias("top"), (F.count_if(F.col("out").isNull() & ~F.col("below")) <= chunk).alias("small"), F.max(F.col("changed")).alias("crowd"))
    state = cut(groups.selectExpr("g", "cast(null as string) blob", f"{policy.budget}L room", "cast(null as double) low", "true open", f"cast(null as {of}) seen", "coalesce(top, 0) top", "small", "crowd"))
    schema = f"g {kind}, kind string, blob string, room bigint, low double, open boolean, k {of}, id bigint, action string, mode string, tokens bigint, reason string, seq bigint, full array<string>"
    result = to_arrow_schema(StructType.fromDDL(schema))
    base = dict.fromkeys(result.names)

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.to_pylist()[0]
        g, own = at["of"], Selection(policy, json.loads(at["blob"]) if at["blob"] else None)
        room, low, loose = own.room, own.low, at["small"] or own.room >= at["top"]
        out, seen, before = [], None, own.full()
        for x in sorted(left.to_pylist(), key=lambda x: tuple(x["k"].values())):
            seen = x["k"]
            for number, action, mode, tok, reason in own.take(x | {"id": seen["id"], "item": seen["item"], "crowd": at["crowd"]}):
                own.state["seq"] += 1
                out.append(base | {"g": g, "kind": "receipt", "id": number, "action": action, "mode": mode, "tokens": tok, "reason": reason, "seq": own.state["seq"]})
            if (now := own.full()) != before:
                before = now
                out.append(base | {"g": g, "kind": "mark", "k": seen, "full": now})
            if not loose and (own.room > room or own.low is not None and (low is None or own.low < low)):
                break
        out.append(base | {"g": g, "kind": "state", "blob": json.dumps(own.state), "room": own.room, "low": own.low, "open": own.state["unrelated"] < UNRELATED_CAP, "k": seen})
        return pa.Table.from_pylist(out, schema=result)

    told = marks = None
    while True:
        held = state.select(F.col("g").alias("h"), "room", "low", "open", "seen", "small")
        passes = F.col("strong_test") | F.col("playground_test") | F.col("pair_of").isNotNull()
        matters = F.col("small") | passes | (F.col("capped") & F.col("open")) | (F.col("least") <= F.col("room")) | (F.col("evidence") + F.lit(DENSITY_MOST) >= F.col("low") + F.lit(LEAST_GAIN))
        ahead = usable.join(held, F.col("g").eqNullSafe(F.col("h"))).where((F.col("seen").isNull() | (F.col("k") > F.col("seen"))) & F.coalesce(matters, F.lit(False)))
        first = ahead.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("k"))).where(F.col("n") <= chunk).select(*rows.columns)
        met = state.withColumnRenamed("g", "of").join(first.select(F.col("g").alias("h")).distinct(), F.col("of").eqNullSafe(F.col("h")), "left_semi")
        turn = cut(first.groupBy("g").cogroup(met.groupBy("of")).applyInArrow(fold, schema))
        if turn.isEmpty():
            break
        told = turn.where("kind = 'receipt'") if told is None else told.unionByName(turn.where("kind = 'receipt'"))
        marks = turn.where("kind = 'mark'") if marks is None else marks.unionByName(turn.where("kind = 'mark'"))
        new = turn.where("kind = 'state'").select(F.col("g").alias("h"), F.struct("blob", "room", "low", "open", "k").alias("new"))
        state = cut(state.join(new, F.col("g").eqNullSafe(F.col("h"))).select("g", "new.blob", "new.room", "new.low", "new.open", F.col("new.k").alias("seen"), "top", "small", "crowd"))
    fixed = rows.select("g", "i", "k", "mode", F.col("tok").alias("tokens"), "out", "below", "weak", "changed", "secondary", "capped", "noise", "support", "family", "family_cap")
    if told is None:
        told = turn.where("kind = 'receipt'")
        marks = turn.where("kind = 'mark'")
    last = told.groupBy("id").agg(F.max_by(F.struct("action", "mode", "tokens", "reason"), "seq").alias("last"))
    held = marks.groupBy(F.col("g").alias("h")).agg(F.array_sort(F.collect_list(F.struct("k", "full"))).alias("marks"))
    rest = fixed.join(last, F.col("k.id") == F.col("id"), "left").join(held, F.col("g").eqNullSafe(F.col("h")), "left")
    full = F.coalesce(F.try_element_at(F.filter("marks", lambda m: m["k"] < F.col("k")), F.lit(-1))["full"], F.array(*map(F.lit, Selection(policy).full())).cast("array<string>"))
    has = lambda name: F.array_contains("full", name)
    brief, plain = F.col("mode").isin(*SHORT), ~F.col("changed")
    own = F.get(F.filter("full", lambda x: x.startswith(F.concat(F.lit("family:"), F.col("family"), F.lit(":")))), F.lit(0))
    count = F.coalesce(F.regexp_extract(own, "([0-9]+)$", 1).cast("int"), F.lit(0))
    reason = F.when(F.col("out").isNotNull(), F.col("out")).when(F.col("capped") & has("unrelated"), "unrelated changed-file safety cap").when(F.col("weak") & plain & has("weak"), "weak-signal cap reached")
    reason = reason.when(F.col("secondary") & plain & has("primary"), "secondary release metadata skipped after primary").when(F.col("below"), "summary score below floor")
    if policy.max_summaries < 0:
        reason = reason.when(F.col("mode") == "summary", "summaries disabled by precision guard")
    if policy.mode == "balanced":
        reason = reason.when(brief & plain & (F.col("noise") != ""), F.col("noise"))
    if policy.strict:
        reason = reason.when(brief & plain & ~F.col("support"), "compressed context needs stronger support signal")
        if policy.mode == "balanced":
            reason = reason.when(brief & plain & F.col("family").isNotNull() & (count >= F.col("family_cap")), F.concat("family", F.lit(" compressed context cap reached")))
    reason = reason.when(brief & has("short"), "compressed context cap reached").otherwise("budget exhausted")
    rest = rest.withColumn("full", full).withColumn("fallback", F.struct(F.lit("excluded").alias("action"), "mode", "tokens", reason.alias("reason")))
    return rest.select(F.col("g").alias(group), F.col("i").alias(item), F.coalesce("last", "fallback").alias("r")).select(group, item, "r.*")
