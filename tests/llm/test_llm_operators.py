"""Each operator against brute force, on small tables with nulls, repeats, empty and long texts and clashing columns."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuscle.llm import bpe, chat, components, langid, linededup, neardup, packing, quality, secret_scan, simhash, topk
from corpuscle.llm.common import fold
from corpuscle.llm.queries import BYTE_BPE, WORD_BPE

ODD = [None, "", " ", "\n\n", "a", "the cat", "<|endoftext|> x<|startoftext|>", "ΣΑΣ É é ß İ 日本語 😀", "a" * 3000, "word " * 5000, "it's we'll 'S 12½ ²", "x՘y "]
CLASH = ["_score", "_lang", "_lines", "_base", "_spans", "row", "id", "fp", "k", "host", "bad", "kept", "unit", "node"]


def docs(spark, texts, sources=None, langs=None):
    rows = [(i, t, (langs or ["en"])[i % len(langs or ["en"])], (sources or ["s"])[i % len(sources or ["s"])], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(7).alias(c) for c in CLASH))


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


EN = ["the", "thing", "with", "shore", "and", "other", "when", "hash", "throw", "wish", "ably", "of"]
FR = ["les", "être", "où", "eau", "déjà", "quelle", "mentier", "aux", "oiseau", "çon", "que", "du"]


def test_bpe_equals_the_library(spark):
    rng = random.Random(1)
    parts = ["<|endoftext|>", "the", "a", "'s", "é", "É", "Σ", "!!", "  ", "\n", "9", "ß", "İ", "aaaa", "$%", "<|", "日本", "😀", "'LL"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    library = Tokenizer.from_file(WORD_BPE)
    got = {r["id"]: r for r in bpe.encode(docs(spark, texts), WORD_BPE).collect()}
    digests = {r["id"]: r for r in bpe.encode_digests(docs(spark, texts), WORD_BPE).collect()}
    assert len(got) == len(digests) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert bytes(got[i]["ids"]) == packed and got[i]["decoded"] == decoded, t
        assert digests[i]["n_tokens"] == len(ids) and digests[i]["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_cuts_only_where_no_token_spans():
    own = bpe.encoder(WORD_BPE)
    pairs = {(x, y) for x in range(256) for y in range(256) if own.joined[x][y] or own.joined[x][y + 256]}
    assert (ord("t"), ord("h")) in pairs and len(pairs) < 256 * 256 // 2


def test_packing_covers_every_token_once(spark):
    texts = ODD + ["word " * n for n in (1, 7, 100, 1300, 2047, 4095, 4096, 9000)] + ["same text"] * 30
    library = Tokenizer.from_file(WORD_BPE)
    out = packing.pack(docs(spark, texts), WORD_BPE).toPandas()
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        own, at = out[out["id"] == i].sort_values("start"), 0
        for p in own.itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and zlib.crc32(ids[at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert list(s["offset"]) == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= packing.CAPACITY
    assert packing.pack(docs(spark, []), WORD_BPE).count() == 0


@pytest.mark.parametrize("tokens", [1, 2, 31, 128, 129, 2048, 2049, 4095, 4096, 4097, 100_001])
def test_pieces_fit_their_class(tokens):
    classes = packing.harmonic_classes(packing.CAPACITY)
    cut = packing.piece_lengths(tokens, packing.CAPACITY, classes)
    assert sum(n for n, _ in cut) == tokens and all(n <= packing.CAPACITY // k and k in classes for n, k in cut)


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", None, "", "[\\INST] \\ [\\\\INST] <s><\\s>", "x" * 50_000, "日本 😀 </s></s>", "plain"]
    rows = [(c, t, r, said[(c + t) % len(said)]) for c in range(8) for t, r in enumerate(["system", "user", "assistant", None, "assistant"])]
    rows += rows[:3] + [(None, 0, "user", "lost"), (9, None, "assistant", "no turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1))
    got = {r["conv"]: r for r in chat.read_back(chat.format_turns(df, BYTE_BPE), BYTE_BPE).collect()}
    by_conv = {}
    for c, t, r, x in rows:
        by_conv.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    assert got.keys() == by_conv.keys()
    for c, turns in by_conv.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(df.where("false"), BYTE_BPE), BYTE_BPE).count() == 0


def test_escaping_hides_every_control_string():
    for text in ("</s>", "<\\/s>", "a[INST]b[/INST]", "<s>\\<s>", "[\\\\/INST]"):
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROLS)


def slow_fingerprint(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_components(spark):
    rng = random.Random(2)
    base = [words(rng, 120, EN) for _ in range(20)]
    texts = ODD + base + base[:5] + [b.replace("shore", "coast", 1) for b in base]
    fps = [slow_fingerprint(t) for t in texts]
    want = union(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    got = {r["id"]: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i]["fp"] % 2**64 for i in range(len(texts))] == fps
    assert [got[i]["component"] for i in range(len(texts))] == want
    assert {r["doc_id"] for r in simhash.drop_copies(docs(spark, texts)).collect()} == set(want)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_links_find_every_close_pair(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
        fps.add(f ^ (0b111 << rng.randrange(60)))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = {frozenset((r["a"], r["b"])) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert got == {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 3}


def test_components_of_paths_and_stars(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    want = union(300, pairs)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: want[i] for a, b in pairs if a != b for i in (a, b)}


def test_line_dedup(spark):
    texts = [f"common\nown {i}\n \ncommon " for i in range(12)] + [None, "", "common"]
    out = {r["doc_id"]: r for r in linededup.drop_boilerplate(docs(spark, texts, ["a", "b", None])).collect()}
    assert out[0]["text"] == "own 0\n " and out[0]["_lines"]["n_dropped"] == 2 and out[12]["text"] is None
    assert out[0]["row"] == out[0]["host"] == 7 and out[14]["text"] == "" and out[2]["source"] is None
    few = {r["doc_id"]: r["text"] for r in linededup.drop_boilerplate(docs(spark, texts, ["a", "b", None]), min_pages=100, details=False).collect()}
    assert few == dict(enumerate(texts))
    assert linededup.drop_boilerplate(docs(spark, []), details=False).count() == 0


def test_line_on_a_tenth_of_the_pages_goes_and_copies_stay(spark):
    hosts, texts, sources = {"a": 40, "b": 50, "c": 200}, [], []
    for host, n in hosts.items():
        for i in range(n):
            copy = f"copied {host}\nbody of it" if i in (1, 2, 3) else f"own {host} {i}"
            texts.append(copy + ("\nfooter" if i % 10 == 0 else ""))
            sources.append(host)
    rows = [(i, t, s) for i, (t, s) in enumerate(zip(texts, sources, strict=True))]
    out = linededup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), details=False)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {i: t.removesuffix("\nfooter") for i, t in enumerate(texts)}


def test_line_dedup_without_broadcast(spark, monkeypatch):
    texts = [f"common\nown {i}\nfooter {i % 2}" for i in range(12)]
    want = sorted(map(tuple, linededup.drop_boilerplate(docs(spark, texts).select("doc_id", "text", "source")).collect()))
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, linededup.drop_boilerplate(docs(spark, texts).select("doc_id", "text", "source")).collect())) == want


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secret_spans(spark):
    rng = random.Random(5)
    parts = ["token", "=", ": ", '"', "'", "secret", "API_KEY", "abcdefgh", "AKIA", "ABCDEF012345", "0123456789abcdef" * 2, " ", "\n", "😀", "é", "x", "password: hunter22", "token:token:abcdefghi"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(150)] + ["token=abcdefgh " * 700]
    prose = spark.createDataFrame([(1, "ordinary words of plain prose that name a configuration value or helper " * 20)], "item_id long, text string")
    model = secret_scan.train(secret_scan.labelled_samples(prose))
    assert len(model) == len(secret_scan.ALPHABET) ** 2
    rows = secret_scan.scan(docs(spark, texts), model).select("doc_id", secret_scan.spelled(F.col("_base")).alias("base"), secret_scan.spelled(F.col("_spans")).alias("all"), F.size("_spans").alias("n")).collect()
    for r in rows:
        want = base_spans(texts[r["doc_id"]])
        assert r["base"] == ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert set(r["base"].split(",")) <= set(r["all"].split(",")) | {""}
    held = ["kJ8sLq0ZpR3xTn5vWm7yBc2dQ9", "plain_configuration_helper_2 thisIsAnOrdinaryIdentifierName7"]
    found = {r["doc_id"]: r["s"] for r in secret_scan.scan(docs(spark, held), model).select("doc_id", secret_scan.spelled(F.col("_spans")).alias("s")).collect()}
    assert found == {0: "markov:0:26", 1: ""}
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redacted(docs(spark, ["a token=abcdefgh z", None, "none", "0123456789abcdef" * 2]), model).collect()}
    assert clean == {0: "a [secret] z", 1: None, 2: "none", 3: "[secret]"}


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(6)
    vectors = rng.integers(-40, 40, (260, 40))
    vectors[50:60] = vectors[7]  # ties
    rows = [(i, [int(x) for x in v]) for i, v in enumerate(vectors)] + [(900, [2**40, 3] * 20), (901, [1, 2]), (None, [1] * 40)]
    rows += [(7, [int(x) for x in vectors[7]]), (7, [int(x) for x in vectors[8]]), (20, [int(x) for x in vectors[21]])]  # ids that repeat
    df = topk.numbered(spark.createDataFrame(rows, "id long, vector array<long>").withColumn("rank", F.lit(1)))
    got = {}
    for r in topk.top_k(df.where("id % 20 = 0"), df, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    own = [(i, v) for i, v in rows if i is not None]
    want = {}
    for n, (q, x) in enumerate(own):
        if q % 20 == 0 and len(x) == 40:
            best = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for m, (i, v) in enumerate(own) if m != n and len(v) == 40)[:20]
            want.setdefault(q, []).extend((n + 1, i, -s) for n, (s, i) in enumerate(best))
    assert len(want[20]) == 40 and {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}
    assert topk.top_k(df.where("false"), df).count() == 0 and topk.top_k(df, df.where("false")).count() == 0


def test_top_k_beyond_64_bits(spark):
    df = topk.numbered(spark.createDataFrame([(i, [2**62 - i] * 4) for i in range(5)], "id long, vector array<long>"))
    got = topk.top_k(df.where("id = 0"), df, 3).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(1, 2**63 - 1), (2, 2**63 - 1), (3, 2**63 - 1)]


@pytest.mark.parametrize("size", [1e8, 1e20, 1e307])
def test_top_k_ranks_scores_beyond_64_bits(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "RUN", 1)
    rng = np.random.default_rng(31)
    rows = [(i, [float(x) for x in v * size]) for i, v in enumerate(rng.uniform(-1, 1, (90, 24)))]
    rows += [(100 + i, [size * (-1) ** i] + [0.0] * 23) for i in range(40)] + [(200 + i, [0.0] * 22 + [float(i), 1.0]) for i in range(40)]
    df = topk.numbered(spark.createDataFrame(rows, "id long, vector array<double>"))
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in topk.top_k(df.where("id % 20 = 0"), df, 20, scale=64).collect()}
    exact = {i: [int(x) * 64 if abs(x) > 2**53 else int(np.floor(x * 64)) for x in v] for i, v in rows}
    want = {}
    for q in (i for i in exact if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(exact[q], v, strict=True)), i) for i, v in exact.items() if i != q)[:20]
        want |= {(q, n + 1): (i, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, i) in enumerate(best)}
    assert got == want and max(s for _, s in want.values()) == 2**63 - 1


def test_top_k_meets_every_run_in_whatever_partition(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    monkeypatch.setattr(topk, "RUN", 1)
    monkeypatch.setattr(topk, "TILE", 1)
    rng = np.random.default_rng(41)
    rows = [(i, [int(x) for x in rng.integers(-9, 9, 6)]) for i in range(200)]
    df = topk.numbered(spark.createDataFrame(rows, "id long, vector array<long>"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in topk.top_k(df.where("id % 10 = 0"), df, 5).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for q, x in rows[::10]:
        best = sorted((-int(np.dot(x, y)), i) for i, y in rows if i != q)[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want


def test_top_k_prunes_nothing_that_counts():
    rng = np.random.default_rng(8)
    q, c = rng.integers(-60, 60, (48, 5)), rng.integers(-60, 60, (48, 400))
    numbers = lambda lo, hi: np.array([np.arange(lo, hi)] * 2)
    for floor in (-np.inf, 0.0):
        best = topk._none(5)
        for at in range(0, 400, 100):
            topk.search_block(best, np.full(5, floor), numbers(1000, 1005), q, numbers(at, at + 100), c[:, at : at + 100], 20)
        for j, (s, i) in enumerate(best):
            full = q[:, j] @ c
            order = np.lexsort((np.arange(400), -full))[:20]
            assert list(i[0]) == list(order) and list(s) == list(full[order])


def test_embedding_near_duplicates(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(150, 24))
    v[40:70] = v[3] + rng.normal(scale=0.08, size=(30, 24)) * np.linalg.norm(v[3]) / 5
    v[80:90] = v[5] * 2
    labels = [i % 3 if i < 40 or i >= 90 else (3 if i < 70 else 5) for i in range(150)]
    labels[3], labels[5] = 3, 5
    rows = [(i, [float(x) for x in a], y) for i, (a, y) in enumerate(zip(v, labels, strict=True))]
    rows += [(200, None, 1), (201, [0.0] * 24, 1), (202, [float("nan")] * 24, 1), (203, [1.0, None], 1), (204, rows[3][1], None), (205, rows[3][1], 3), (206, [1.0, 2.0], 3), (207, [], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    use = [(i, np.array(a) / np.linalg.norm(a), y) for i, a, y in rows if y is not None and i < 200 or i in (205, 206)]
    links = [(x, y) for x, (_, a, la) in enumerate(use) for y, (_, b, lb) in enumerate(use[:x]) if la == lb and len(a) == len(b) and a @ b >= 0.93]
    root = union(len(use), links)
    degree = [sum(x in p for p in links) for x in range(len(use))]
    want = {i: (degree[x], use[root[x]][0]) for x, (i, _, _) in enumerate(use)}
    assert got == want | {i: (0, i) for i in (200, 201, 202, 203, 204, 207)}
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_embedding_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHARD", 120)
    rng = np.random.default_rng(10)
    v = rng.normal(size=(600, 32))
    v[300:600] = v[:300] + rng.normal(scale=0.12, size=(300, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in a], 1) for i, a in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r["id"]: r["n_links"] for r in neardup.near_duplicates(df).collect()}
    want = ((v @ v.T) >= 0.93).sum(axis=1) - 1
    assert all(got[i] <= want[i] for i in range(600)) and sum(got.values()) >= 0.98 * want.sum() > 0


def test_embedding_search_that_finds_nothing_is_made_good(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "search", lambda placed, adjacency: placed.select(F.col("ball").alias("a"), F.col("ball").alias("b")).where("false"))
    rng = np.random.default_rng(14)
    v = rng.normal(size=(120, 16))
    v[60:] = v[:60] + rng.normal(scale=0.08, size=(60, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in a], 1) for i, a in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r["id"]: r["n_links"] for r in neardup.near_duplicates(df).collect()}
    assert list(map(got.get, range(120))) == list(((v @ v.T) >= 0.93).sum(axis=1) - 1) and sum(got.values()) > 0


def test_language_identification(spark):
    rng = random.Random(11)
    texts = [words(rng, rng.randint(5, 200), EN if i % 2 else FR) for i in range(400)] + ODD
    df = docs(spark, texts, langs=["fr", "en"])
    model = langid.train(df, fold(F.col("doc_id"), 4) != 2)
    out = {r["doc_id"]: r for r in langid.identify(df.select("doc_id", "text"), model).collect()}
    right = [out[i]["_lang"] == ("fr", "en")[i % 2] for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean(right) > 0.97 and all(0 <= r["_score"] <= 1 for r in out.values())
    assert [out[400 + i]["_lang"] for i in range(4)] == ["und"] * 4
    kept = langid.filter_languages(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= set(range(400))
    empty = langid.train(df.where("false"), F.lit(True))
    assert {r["_lang"] for r in langid.identify(df.select("text"), empty).collect()} == {"und"}
    assert langid.identify(docs(spark, []).select("text"), model).count() == 0


def test_language_tables_equal_the_network():
    net = langid.ByteCnn(["a", "b", "c"])
    x = np.random.default_rng(12).integers(0, 256, (9, langid.WINDOW)).astype(np.uint8)
    assert np.allclose(net._forward(x)[0], langid.Predictor(net.packed()).probabilities(x), atol=1e-4)


def test_quality_classifier(spark):
    rng = random.Random(13)
    good = [words(rng, rng.randint(5, 120), EN) for _ in range(300)]
    junk = ["!!! ".join(w.upper() for w in words(rng, 40, EN).split()) if i % 2 else "same " * 50 for i in range(100)]
    texts = good + junk + ODD
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(400)] + [(0, None, 1), (None, 1, 0), (3, 9, 0)], "doc_id long, quality int, toxic int")
    df, own = docs(spark, texts), fold(F.col("doc_id"), 3)
    model = quality.train(df, labels, own != 1)
    out = {r["id"]: r["score"] for r in quality.score(df, model).collect()}
    held = [(out[i] >= 0.5) == (i < 300) for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean(held) > 0.97 and all(0 <= s <= 1 for s in out.values()) and len(out) == len(texts)
    assert out[400] == out[401] == out[402]
    none = quality.train(df, labels.where("false"), F.lit(True))
    assert {r["score"] for r in quality.score(df, none).collect()} == {0.5} and quality.score(docs(spark, []), model).count() == 0


def test_a_label_that_the_search_misses_is_made_good(spark, monkeypatch):
    """The label with the misses is small beside the other one, so recall over all would look well."""
    real = neardup.search
    monkeypatch.setattr(neardup, "search", lambda placed, adjacency: real(placed, adjacency).join(placed.where("place = 0 and key like '1:%'").select(F.col("ball").alias("a")), "a", "left_semi"))
    rng = np.random.default_rng(15)
    v = rng.normal(size=(330, 16))
    v[300:] = v[rng.integers(0, 300, 30)] + rng.normal(scale=0.05, size=(30, 16))
    v[150:300] = v[:150] + rng.normal(scale=0.07, size=(150, 16))
    v[315:] = v[300:315] + rng.normal(scale=0.07, size=(15, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([1] * 300 + [2] * 30)
    df = spark.createDataFrame([(i, [float(x) for x in a], int(y)) for i, (a, y) in enumerate(zip(v, label, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r["id"]: r["n_links"] for r in neardup.near_duplicates(df).collect()}
    want = (((v @ v.T) >= 0.93) & (label[:, None] == label[None])).sum(axis=1) - 1
    assert all(got[i] == want[i] for i in range(300, 330)) and want[300:].sum() > 0


def test_every_large_label_gets_cells(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHARD", 40)
    monkeypatch.setattr(neardup, "DEAL", 30)
    rng = np.random.default_rng(16)
    v = rng.normal(size=(700, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    found = neardup.nodes(neardup.usable(spark.createDataFrame([(i, i % 7 if i < 690 else 99, [float(x) for x in a]) for i, a in enumerate(v)], "id long, label int, vector array<double>")))
    centres = neardup.centroids(found)
    assert {r["key"] for r in centres.collect()} == {f"{y}:8" for y in range(7)}
    dealt = neardup.deal(found, centres, 2).toPandas()
    assert sorted(dealt[dealt["place"] == 0]["node"]) == sorted(r["node"] for r in found.collect())
    assert dealt[dealt["key"] != "99:8"].groupby("node").size().eq(2).all() and dealt[dealt["key"] == "99:8"]["cell"].eq(0).all()
    own = {r["key"]: np.frombuffer(r["centres"]).reshape(-1, 8) for r in centres.collect()}
    for r in dealt[(dealt["place"] == 0) & (dealt["key"] != "99:8")].itertuples():
        assert r.cell == int((own[r.key] @ np.array(r.unit)).argmax())


def test_a_sample_keeps_its_budget(spark):
    from corpuscle.llm.common import bounded_sample, keyed

    rows = [(i, "x" * (5000 if i < 3 else 40) + str(i), "a" if i < 50 else "b") for i in range(90)] + [(90 + i, "y" * 9000 + str(i), "c") for i in range(3)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    got = bounded_sample(df, keyed(df, "lang"), "lang", 20, 3 * 1000, 100).collect()
    for name in "abc":
        own = [r for r in got if r["lang"] == name]
        assert sum(len(r["text"]) for r in own) <= 1000 and (len(own) == 20 if name in "ab" else not own)


def test_many_boilerplate_lines_of_a_host(spark):
    rng = random.Random(17)
    common_lines = [f"boiler {i}" for i in range(300)]
    texts = ["\n".join(rng.sample(common_lines, 60) + [f"own {n} {i}" for i in range(20)]) for n in range(60)]
    out = {r["doc_id"]: r["text"] for r in linededup.drop_boilerplate(docs(spark, texts, ["a", "b"]), details=False).collect()}
    for host in (0, 1):
        pages = {n: t.split("\n") for n, t in enumerate(texts) if n % 2 == host}
        bad = {x for x in common_lines if (c := sum(x in p for p in pages.values())) > 0.05 * len(pages) and c >= 4}
        assert bad and all(out[n] == "\n".join(x for x in p if x not in bad) for n, p in pages.items())
