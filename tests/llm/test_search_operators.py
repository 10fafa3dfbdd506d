"""Decontamination, lexical search and hard negatives against brute force, on tables with nulls, repeats, empty and long texts and clashing columns."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import CLASH, EN, ODD, words

from corpuscle.llm import common, decontam, lexical, negatives, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return [re.sub("[A-Z]", lambda c: c[0].lower(), w) for w in WORD.findall(text or "")]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(7).alias(c) for c in [*CLASH, "_leaks", "_h1", "query", "words"]))


def leaks(text, items, window=10, coverage=1.0):
    """(words, hit places, item ids) by looking for every window at every place."""
    own, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        size = min(window, math.ceil(len(w) * coverage), len(w))
        if not size:
            continue
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        for i in range(len(own) - size + 1):
            if tuple(own[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found |= {str(item)} if item is not None else set()
    return len(own), hit, sorted(found)


def leak_case(rng):
    items = [(i, words(rng, rng.choice([1, 3, 9, 10, 11, 40]), EN)) for i in range(25)]
    items += [(3, items[9][1] + " more"), (None, words(rng, 12, EN)), (26, None), (27, ""), (28, " .,; "), (29, "É日本 x_y-Z"), (10, items[4][1]), (30, "a " * 60)]
    texts = [words(rng, rng.randint(0, 200), EN) for _ in range(60)] + ODD
    for i in range(40):
        item = rng.choice(items)[1] or ""
        texts[i] += "\n-- " + rng.choice([item, item.upper(), "x " + item[: len(item) // 2], item.replace(" ", " ... ")]) + " " + words(rng, 5, EN)
    return items, [*texts, "a " * 100, "É日本 X Y z", "a", "word " * 20_000 + items[8][1]]


@pytest.mark.parametrize("shard_words", [200_000, 60])
def test_leaks_equal_brute_force(spark, monkeypatch, shard_words):
    monkeypatch.setattr(decontam, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(decontam, "PIECE_WORDS", 7 if shard_words == 60 else 5000)
    items, texts = leak_case(random.Random(31))
    df, bench = docs(spark, [*enumerate(texts), (0, texts[0]), (None, texts[1])]), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.scan(df, bench, keep=["doc_id", "text", "row"]).collect()
    assert len(got) == len(texts) + 2 and got[0].asDict().keys() == {"doc_id", "text", "row", "_leaks"}
    for r in got:
        n, hit, found = leaks(r["text"], items)
        own = r["_leaks"]
        assert (own["n_words"], own["n_hit"], own["items"]) == (n, len(hit), found)
        assert {p for s in own["spans"] for p in range(s["start"], s["end"])} == hit and (own["longest"] >= 1) == bool(hit)
    assert any(r["_leaks"]["items"] for r in got) and decontam.scan(df.where("false"), bench).count() == 0
    none = decontam.scan(df, bench.where("false"), keep=["doc_id"]).collect()
    assert len(none) == len(got) and not any(r["_leaks"]["n_hit"] for r in none)


def test_windows_and_coverage_are_parameters(spark):
    items, texts = leak_case(random.Random(32))
    df, bench = docs(spark, list(enumerate(texts))), spark.createDataFrame(items, "item_id long, text string")
    for window, coverage in ((4, 1.0), (50, 0.5)):
        got = {r["doc_id"]: r["_leaks"]["n_hit"] for r in decontam.scan(df, bench, window, coverage, keep=["doc_id"]).collect()}
        assert got == {i: len(leaks(t, items, window, coverage)[1]) for i, t in enumerate(texts)}


def test_clean_removes_spans_and_drops_what_is_mostly_leaked(spark):
    item = words(random.Random(33), 15, [f"w{i}" for i in range(99)])
    texts = [f"Before, {item.upper()}! after and more and more and more and more and more " + "text " * 20, item, "nothing here", None, "x " + item]
    got = {r["doc_id"]: r["text"] for r in decontam.clean(docs(spark, list(enumerate(texts))), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {0: "Before, ! after and more and more and more and more and more " + "text " * 20, 2: "nothing here", 3: None}


def test_automaton_recognises_all_and_only_substrings():
    rng = random.Random(34)
    for _ in range(40):
        pieces = [(i, [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))], 1) for i in range(4)]
        own = decontam.SuffixAutomaton(pieces)
        subs = {tuple(w[i:j]) for _, w, _ in pieces for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        for n in range(1, 6):
            for _ in range(20):
                text = tuple(rng.choice([b"a", b"b", b"c"]) for _ in range(n))
                v = 0
                for w in text:
                    v = own.next[v].get(own.vocab.get(w, -1)) if v is not None else None
                assert (v is not None) == (text in subs)


def rank(texts, ids, items, k=10):
    own = [split(t) for t in texts]
    n_docs, total = sum(map(bool, own)), sum(map(len, own))
    df = {}
    for w in own:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    terms = {}
    for item, t in items:
        terms.setdefault(item, set()).update(split(t))
    out = []
    for item, asked in terms.items():
        scores = []
        for i, w in zip(ids, own, strict=True):
            if i is None or not w:
                continue
            m = 10 + 90 * len(w) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in asked if t in w)
            if s > 0:
                scores.append((-s, i))
        out += [(item, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "tokens", "group"), [(8192, 2_000_000, 200_000), (64, 90, 20)])
def test_ranking_equals_brute_force(spark, monkeypatch, window, tokens, group):
    monkeypatch.setattr(lexical, "WINDOW", window)
    monkeypatch.setattr(lexical, "WINDOW_TOKENS", tokens)
    monkeypatch.setattr(lexical, "GROUP_TERMS", group)
    rng = random.Random(35)
    rare = [f"rare{i}" for i in range(200)]
    texts = [words(rng, rng.randint(0, 60), EN + rare[:50]) for _ in range(200)] + ["the same text of copies"] * 30 + ODD + ["The THE the", "日本 É"]
    ids = [*range(len(texts) - 3), 5, None, -(2**40)]
    items = [(i, words(rng, rng.randint(1, 30), EN + rare)) for i in range(12)] + [(3, "same text"), (None, "copies the"), (20, ""), (21, None), (22, "absent"), (23, "日本 é É")]
    got = lexical.ranked(docs(spark, list(zip(ids, texts, strict=True))), spark.createDataFrame(items, "item_id long, text string").withColumn("query", F.lit(1)))
    assert sorted(map(tuple, got.collect()), key=repr) == rank(texts, ids, items)
    assert lexical.ranked(docs(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert lexical.ranked(docs(spark, [(1, "a")]), spark.createDataFrame([], "item_id long, text string")).count() == 0


def mine(rows, anchor):
    use = [(n, i, y, np.array(v, object)) for n, (i, y, v) in enumerate(rows) if i is not None and y is not None and v]
    out = []
    for n, i, y, v in use:
        if not anchor(i):
            continue
        scored = [(-int(v @ w), j, m, z) for m, j, z, w in use if m != n and len(w) == len(v)]
        for s, j, m, _ in sorted(x[:3] + (0,) for x in scored if x[3] == y)[:5]:
            good = sorted((t, a, b) for t, a, b, z in scored if z != y and 80 * -s <= 100 * -t <= 100 * -s)[:5]
            out += [(i, j, r + 1, a, -s, -t) for r, (t, a, _) in enumerate(good)]
    return sorted(out)


@pytest.mark.parametrize(("block", "anchors", "leaf", "scale"), [(4096, 1024, 128, 20), (40, 7, 4, 20), (64, 9, 8, 2**20), (50, 10, 8, 2**33)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, anchors, leaf, scale):
    for name, value in {"BLOCK_ROWS": block, "ANCHOR_ROWS": anchors, "LEAF": leaf, "ANCHOR_LEAF": max(2, leaf // 2), "SHARE": 3}.items():
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(block)
    v = rng.normal(size=(260, 6)) + 1.5
    v[60:120] = v[7]  # one large group of equal vectors under several labels
    v[120:160] = v[9] * 1.01
    ints = np.floor(v * scale).astype(np.int64)
    rows = [(i, int(rng.integers(0, 4)), [int(x) for x in w]) for i, w in enumerate(ints)]
    rows += [(300, None, rows[0][2]), (301, 1, None), (302, 1, []), (303, 1, [5, 5]), (304, 1, [6, 5]), (305, 2, [6, 5]), (None, 1, rows[1][2]), (20, 1, rows[20][2]), (30, 2, rows[31][2])]
    df = spark.createDataFrame(rows, "id long, label int, vector array<long>").withColumn("row", F.lit(3))
    got = sorted(map(tuple, negatives.mine(df, F.col("id") % 10 == 0).collect()))
    if scale < 2**33:
        assert got == mine(rows, lambda i: i % 10 == 0) and got
    else:  # scores beyond 64 bits count as the nearest 64-bit number
        assert all(r[4] <= 2**63 - 1 for r in got)
    assert negatives.mine(df.where("false"), F.col("id") % 10 == 0).count() == 0


def test_intervals_hold_every_product():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, c = (np.floor(rng.normal(size=(9, 5)) * 50 + rng.normal(size=5) * 80) for _ in range(2))
        ca, cc = a.mean(axis=0), c.mean(axis=0)
        ra, rc = (np.sqrt(((x - m) ** 2).sum(axis=1).max()) for x, m in ((a, ca), (c, cc)))
        low, high = negatives.interval(ca @ cc, np.linalg.norm(ca), ra, np.linalg.norm(cc), rc)
        assert low <= (a @ c.T).min() and (a @ c.T).max() <= high


def test_the_search_prunes_groups(monkeypatch):
    """Clusters far apart: few leaf pairs are scored."""
    rng = np.random.default_rng(6)
    centres = np.eye(16) * 1000
    v = np.concatenate([np.floor(c + rng.normal(size=(100, 16))) for c in centres]).astype(np.int64)
    tree = negatives.Tree.grow(np.arange(1600), np.arange(1600), np.zeros(1600, np.int64), v, 50)
    own = negatives.Tree.grow(np.arange(100), np.arange(100), np.zeros(100, np.int64), v[:100], 25)
    scored = []
    real = negatives._scores
    monkeypatch.setattr(negatives, "_scores", lambda a, c, k: scored.append(len(a) * len(c)) or real(a, c, k))
    wishes = negatives.Wishes(100, [(i, negatives.LOW, negatives.HIGH) for i in range(100)], 5)
    negatives.dual_search(own, wishes, tree, True)
    assert sum(scored) < 100 * 1600 / 2
    for i, heap in enumerate(wishes.found):
        s = v @ own.vectors[i]
        s[own.rows[i]] = -(2**62)
        assert sorted(-x[0] for x in heap) == sorted(-s)[:5]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base, rng = tmp_path_factory.mktemp("search"), random.Random(36)
    items, texts = leak_case(rng)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    v = np.random.default_rng(37).normal(size=(400, 8)) + 1
    rows = [(i, [float(x) for x in a], i % 10) for i, a in enumerate(v)] + [(400, None, 1), (500, [float("inf")] * 8, 1), (600, [float(x) for x in v[0]], None), (100, [float(x) for x in v[1]], 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{base}/embeddings.parquet")
    return str(base), items, texts, rows


def test_registered_queries(spark, tables):
    base, items, texts, rows = tables
    for r in queries.QUERIES["op11_decontaminate"](spark, base).collect():
        n, hit, found = leaks(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, len(hit), len(found), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
    assert sorted(map(tuple, queries.QUERIES["op12_lexical"](spark, base).collect()), key=repr) == rank(texts, range(len(texts)), items)
    own = [(i, (y + 1) % 10 if i % 7 == 0 and y is not None else y, [math.floor(x * 256) for x in v] if v and all(map(math.isfinite, v)) else None) for i, v, y in rows]
    assert sorted(map(tuple, queries.QUERIES["op13_negatives"](spark, base).collect())) == mine(own, lambda i: i % 100 == 0)


def test_words_of_bytes():
    for text in [*ODD, "A-b_C9  x\u0085y", "\x00a\x7fb"]:
        assert [w.decode() for w in common.words_of(text.encode() if text is not None else None)] == split(text)
