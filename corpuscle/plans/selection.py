"""Stateful selection with modes, caps, quotas and displacement, and what follows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import ladder
from corpuscle.plans.corpus import TOKENS_SQL, files
from corpuscle.plans.registry import PATH, query

#: Both engines derive a candidate's columns from its id, its path and the length of its text.
CANDIDATE = {
    "item": "lpad(CAST(doc_id AS STRING), 12, '0')",
    "score": "CASE WHEN doc_id % 23 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(doc_id * 37 % 401 AS DOUBLE) END",
    "blocked": "path LIKE 'dist/%' OR path LIKE '%.bin'",
    "changed": "doc_id % 11 = 0 AND lang <> 'en'",
    "task_signal": "doc_id % 2 = 0",
    "weak": "doc_id % 7 = 3",
    "docs": "path LIKE 'docs/%' AND doc_id % 2 = 0",
    "secret": "doc_id % 97 = 5",
    "bypass": "doc_id % 5 = 1",
    "primary": "doc_id % 83 = 0",
    "secondary": "doc_id % 31 = 4",
    "support": "doc_id % 13 <> 6",
    "test": "path LIKE 'tests/%'",
    "strong_test": "path LIKE 'tests/%' AND doc_id % 4 = 1",
    "playground_test": "doc_id % 19 = 2",
    "strong": "doc_id % 3 = 0",
    "yields": "doc_id % 5 < 2",
    "noise": "CASE WHEN doc_id % 29 = 7 THEN 'weak noise' END",
    "family": "CASE WHEN path LIKE 'tests/%' THEN 'tests' WHEN path LIKE 'config/%' THEN 'config' WHEN path LIKE 'docs/%' THEN 'docs' WHEN path LIKE 'examples/%' THEN 'examples' END",
    "family_cap": "CASE WHEN path LIKE 'tests/%' THEN 4 WHEN path LIKE 'config/%' THEN 2 WHEN path LIKE 'docs/%' THEN 1 WHEN path LIKE 'examples/%' THEN 1 ELSE 0 END",
    "scope": "CASE WHEN doc_id % 4 <> 3 THEN 'scope' || CAST(doc_id % 3 AS STRING) END",
    "pair_of": "CASE WHEN doc_id % 17 = 8 THEN lpad(CAST(doc_id - 1 AS STRING), 12, '0') END",
    "playground": "CASE WHEN doc_id % 2 = 0 THEN 'play' || CAST(doc_id % 3 AS STRING) END",
    "evidence": "CAST(doc_id * 53 % 400 - 100 AS DOUBLE)",
    "diff_tokens": "CASE WHEN doc_id % 2 = 0 THEN 150 + doc_id % 40 END",
    "skeleton_tokens": "CASE WHEN doc_id % 3 = 0 THEN 40 + doc_id % 120 END",
    "summary_tokens": "20 + doc_id % 60",
}
POLICY = ladder.Policy(mode="balanced", budget=4000, max_file_tokens=1500, summary_floor=40.0, max_summaries=30, max_weak=3, strict=True)


def _best(picks: str, extra: str, strong_extra: str, family: str) -> str:
    """SQL of the place in picks that the candidate replaces at the best gain, or null."""
    dense = "(CASE WHEN tok > 0 THEN least(35.0, 1200.0 / greatest(tok, 40)) ELSE 0 END)"
    special = f"(strong AND p.yields AND tok - p.tok <= {strong_extra} AND tok <= 220 AND score >= 180)"
    gain = f"(evidence + {dense} - p.evidence)"
    least = f"(CASE WHEN {special} THEN 45.0 + 0.04 * greatest(0, tok - p.tok) ELSE 70.0 + 0.15 * greatest(0, tok - p.tok) END)"
    good = f"p.brief AND NOT p.passed AND (tok - p.tok <= {extra} OR {special}) AND (p.scope IS NULL OR p.scope = coalesce(scope, '') OR {special}) AND (NOT test OR strong_test) AND ({family}) AND {gain} > 0 AND {gain} >= {least}"
    gains = f"list_transform({picks}, lambda p: CASE WHEN {good} THEN {gain} END)"
    return f"CASE WHEN list_max({gains}) IS NOT NULL THEN list_position({gains}, list_max({gains})) END"


def _without(picks: str, place: str) -> str:
    return f"CASE WHEN {place} IS NULL THEN {picks} ELSE list_concat({picks}[1:{place} - 1], {picks}[{place} + 1:]) END"


def _oracle() -> str:
    p = POLICY
    used = lambda picks: f"coalesce(list_sum(list_transform({picks}, lambda p: p.tok)), 0)"
    n = lambda picks, cond: f"len(list_filter({picks}, lambda p: {cond}))"
    pick = "STRUCT(id BIGINT, tok BIGINT, mode VARCHAR, brief BOOLEAN, evidence DOUBLE, scope VARCHAR, family VARCHAR, test BOOLEAN, playground VARCHAR, item VARCHAR, yields BOOLEAN, passed BOOLEAN, counted BOOLEAN)"
    gone = lambda picks, place: f"CASE WHEN {place} IS NULL THEN [] ELSE [{{'id': {picks}[{place}].id, 'action': 'excluded', 'mode': {picks}[{place}].mode, 'tokens': {picks}[{place}].tok, 'reason': 'marginal slot replaced by ' || item}}] END"
    dense = "(CASE WHEN tok > 0 THEN least(35.0, 1200.0 / greatest(tok, 40)) ELSE 0 END)"
    columns = ", ".join(f"{e} AS {c}" for c, e in CANDIDATE.items())
    return f"""WITH RECURSIVE c AS (SELECT doc_id AS id, source AS g, {TOKENS_SQL} AS t, {columns} FROM (SELECT *, {PATH} AS path FROM documents)),
e AS (SELECT *, count(*) FILTER (WHERE changed) OVER (PARTITION BY g) AS nc, CASE WHEN skeleton_tokens IS NOT NULL THEN 'skeleton' ELSE 'summary' END AS lean FROM c),
m AS (SELECT *, CASE WHEN changed THEN CASE WHEN t <= {p.max_file_tokens} AND (t <= 600 OR task_signal AND NOT ({'true' if p.budget < 12_000 else 'nc > 5'})) THEN 'full' WHEN diff_tokens IS NOT NULL THEN 'diff' WHEN task_signal THEN 'symbols' ELSE lean END
  WHEN secret AND t <= {p.max_file_tokens} THEN 'full' WHEN weak THEN 'summary' WHEN skeleton_tokens IS NOT NULL AND score >= 160 THEN 'skeleton' ELSE 'summary' END AS mode0 FROM e),
o AS (SELECT *, CAST(CASE mode0 WHEN 'full' THEN t WHEN 'diff' THEN diff_tokens WHEN 'symbols' THEN least(t, {p.max_file_tokens // 2}) WHEN 'skeleton' THEN skeleton_tokens ELSE summary_tokens END AS BIGINT) AS tok0,
  CASE WHEN blocked THEN 'ignored or binary' WHEN score <= 0 THEN 'score too low' WHEN NOT changed AND docs THEN 'docs disabled by mode' END AS fixed,
  nc > 5 AND changed AND NOT task_signal AS capped, NOT changed AND score < {p.summary_floor} AND NOT bypass AND NOT secret AS below, row_number() OVER (PARTITION BY g ORDER BY score DESC, item) AS n FROM m),
st(g, n, picks, weaks, unrelated, prim, q1, q2, q3, said) AS (
  SELECT DISTINCT g, CAST(0 AS BIGINT), CAST([] AS {pick}[]), 0, 0, false, 0, 0, 0, CAST([] AS STRUCT(id BIGINT, action VARCHAR, mode VARCHAR, tokens BIGINT, reason VARCHAR)[]) FROM c
  UNION ALL
  SELECT g, n, CASE WHEN no IS NULL THEN list_append(picks3, {{'id': id, 'tok': tok, 'mode': mode, 'brief': brief, 'evidence': evidence + {dense}, 'scope': scope, 'family': family, 'test': test, 'playground': playground, 'item': item, 'yields': yields, 'passed': coalesce(pass_, '') LIKE 'same%', 'counted': counted}}) ELSE picks3 END,
    CASE WHEN no IS NULL AND weak AND NOT changed THEN weaks + 1 ELSE weaks END, unrelated + CASE WHEN fixed IS NULL AND capped AND unrelated < 3 THEN 1 ELSE 0 END, prim OR no IS NULL AND "primary",
    q1 + CASE WHEN no IS NULL AND pass_ = 'same-package test overflow' THEN 1 ELSE 0 END, q2 + CASE WHEN no IS NULL AND pass_ = 'same-playground test overflow' THEN 1 ELSE 0 END, q3 + CASE WHEN no IS NULL AND pass_ = 'strong-test cap overflow' THEN 1 ELSE 0 END,
    list_concat(list_concat(list_concat({gone('picks', 'at1')}, {gone('picks1', 'at2')}), {gone('picks2', 'at3')}), [{{'id': id, 'action': CASE WHEN no IS NOT NULL THEN 'excluded' WHEN mode = 'full' THEN 'included' ELSE 'summarized' END, 'mode': mode, 'tokens': tok, 'reason': coalesce(no, pass_, note)}}])
  FROM (SELECT *, CASE WHEN no3 IS NOT NULL THEN no3 WHEN {used('picks3')} + tok > {p.budget} THEN 'budget exhausted' END AS no
  FROM (SELECT *, {_without('picks2', 'at3')} AS picks3
  FROM (SELECT *, CASE WHEN no3 IS NULL AND {used('picks2')} + tok > {p.budget} THEN {_best('picks2', '0', '0', 'true')} END AS at3
  FROM (SELECT *, coalesce(no2, CASE WHEN full_s AND pass_ IS NULL AND at2 IS NULL THEN 'compressed context cap reached' END) AS no3, {_without('picks1', 'at2')} AS picks2
  FROM (SELECT *, CASE WHEN full_s AND pass_ IS NULL THEN {_best('picks1', f"least(120, greatest(0, {p.budget} - {used('picks1')}))", f"least(220, greatest(0, {p.budget} - {used('picks1')}))", 'true')} END AS at2
  FROM (SELECT *, CASE WHEN pass1 IS NOT NULL THEN pass1 WHEN NOT full_s OR nc > 0 THEN NULL WHEN q1 < 1 AND pair_of IS NOT NULL AND {n('picks1', 'p.item = pair_of AND NOT p.test')} > 0 THEN 'same-package test overflow'
    WHEN q2 < 1 AND playground_test AND playground IS NOT NULL AND {n('picks1', 'p.playground = playground')} > 0 THEN 'same-playground test overflow'
    WHEN q3 < 2 AND strong_test AND tok <= 160 AND score >= 300 AND (scope IS NULL OR {n('picks1', 'p.test AND p.scope = scope')} < 2) THEN 'strong-test cap overflow' END AS pass_
  FROM (SELECT *, no2 IS NULL AND brief AND {n('picks1', 'p.brief')} >= {p.max_summaries} AS full_s
  FROM (SELECT *, coalesce(no1, CASE WHEN full_f AND pass1 IS NULL AND (at1 IS NULL OR {n('picks1', 'p.counted AND p.family = family')} >= family_cap) THEN family || ' compressed context cap reached' END) AS no2
  FROM (SELECT *, {_without('picks', 'at1')} AS picks1
  FROM (SELECT *, CASE WHEN full_f AND pass1 IS NULL THEN {_best('picks', f"least(120, greatest(0, {p.budget} - {used('picks')}))", '0', 'p.family = family')} END AS at1
  FROM (SELECT *, CASE WHEN full_f AND family = 'tests' AND nc = 0 AND q3 < 2 AND strong_test AND tok <= 160 AND score >= 300 AND (scope IS NULL OR {n('picks', 'p.test AND p.scope = scope')} < 2) THEN 'strong-test cap overflow' END AS pass1
  FROM (SELECT *, no1 IS NULL AND counted AND {n('picks', 'p.counted AND p.family = family')} >= family_cap AS full_f
  FROM (SELECT *, brief AND NOT changed AND family IS NOT NULL AS counted, coalesce(no0, CASE WHEN brief AND NOT changed AND noise IS NOT NULL THEN noise WHEN brief AND NOT changed AND NOT support THEN 'compressed context needs stronger support signal' END) AS no1
  FROM (SELECT *, mode IN ('summary', 'skeleton') AS brief, CASE mode WHEN mode0 THEN tok0 WHEN 'skeleton' THEN skeleton_tokens ELSE summary_tokens END AS tok, CASE WHEN mode = mode0 THEN 'selected' ELSE 'value optimizer downgraded to ' || mode END AS note
  FROM (SELECT *, CASE WHEN no0 IS NOT NULL OR mode0 = 'summary' OR tok0 <= room THEN mode0 WHEN skeleton_tokens <= summary_tokens AND skeleton_tokens <= room THEN 'skeleton' WHEN summary_tokens <= room THEN 'summary' WHEN skeleton_tokens <= room THEN 'skeleton' ELSE mode0 END AS mode
  FROM (SELECT s.picks, s.weaks, s.unrelated, s.prim, s.q1, s.q2, s.q3, o.*, {p.budget} - {used('s.picks')} AS room,
    CASE WHEN fixed IS NOT NULL THEN fixed WHEN capped AND s.unrelated >= 3 THEN 'unrelated changed-file safety cap' WHEN weak AND NOT changed AND s.weaks >= {p.max_weak} THEN 'weak-signal cap reached'
      WHEN s.prim AND secondary AND NOT changed THEN 'secondary release metadata skipped after primary' WHEN below THEN 'summary score below floor' END AS no0
    FROM st s JOIN o ON o.g = s.g AND o.n = s.n + 1)))))))))))))))))
SELECT g AS source, x.id AS doc_id, x.action, x.mode, x.tokens, x.reason FROM (SELECT g, n, unnest(said) AS x FROM st) QUALIFY row_number() OVER (PARTITION BY g, x.id ORDER BY n DESC) = 1"""


@query("RNK07 RNK08", _oracle())
def ladder_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's receipt: its mode, what it costs and why it is in or out of its source's budget."""
    own = files(spark, sf_dir).withColumns({c: F.expr(e) for c, e in CANDIDATE.items()}).drop("text")
    return ladder.select(own, "source", "item", "score", "tokens", [F.col("score")], POLICY).select("source", F.col("item").cast("bigint").alias("doc_id"), "action", "mode", "tokens", "reason")
