"""Benchmark decontamination with a generalised suffix automaton of the test items.

Texts are lower-cased (A-Z only) and cut into words: runs of ASCII letters, digits
and characters beyond ASCII. One automaton recognises every substring of every
item, in words. A document is streamed through it once: after each word the state
and the matching length tell the longest run of words ending there that some item
has. An item of m words has windows of min(window, ceil(coverage * m)) words; a
word of the document inside an occurrence of a window is hit. Words that no item
has reset the match, so stretches of known words shorter than the shortest window
are passed over.

Items are cut into overlapping pieces (every window lies in one) and the pieces
into shards of about SHARD_WORDS words by hash. A task holds one automaton at a
time, so what is broadcast has a bound; benchmarks beyond it are searched shard by
shard over the documents, and only the hits of documents that have any are shuffled.

Defined results: a null or empty text has no words and no hits; items without
words match nothing; rows that repeat an item_id count as one item, each with its
own windows; windows of an item with a null id are hit but name no item; every
document row has a row in the result, repeated ones too; empty tables give no
rows, or documents without hits. Extra columns stay; one named _leaks is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.llm.common import cut, map_batches, words_of

WINDOW, COVERAGE = 10, 1.0
#: A document of which more than this share of words is hit is not worth cleaning.
DROP_SHARE = 0.5
#: Words of a shard, and of a piece of an item.
SHARD_WORDS, PIECE_WORDS = 200_000, 5_000
#: What separates words, once A-Z are lower-cased.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LEAKS = "n_words bigint, n_hit bigint, longest bigint, items array<string>, spans array<struct<start: bigint, end: bigint>>"
_NO_SPANS = "CAST(array() AS array<struct<start: bigint, end: bigint>>)"


class SuffixAutomaton:
    """All substrings of word sequences, with the items that have each window."""

    def __init__(self, pieces: list[tuple[str | None, list[bytes], int]]):
        """pieces: (item, words, words of a window)."""
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in words], size) for item, words, size in pieces]
        for _, words, _ in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: state -> {words of a window: items that have the window the state stands for}
        self.ends: dict[int, dict[int, set]] = {}
        for item, words, size in coded:
            v = seen = 0
            for w in words:
                v, seen = self.next[v][w], seen + 1
                while self.length[self.link[v]] >= size:  # the state of the last size words
                    v = self.link[v]
                if seen >= size:
                    self.ends.setdefault(v, {}).setdefault(size, set()).add(item)
        #: the nearest suffix of a state that ends a window, or 0
        self.near = [0] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.near[v] = v if v in self.ends else self.near[self.link[v]]
        self.least = min((size for _, words, size in coded if len(words) >= size), default=0)

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _extend(self, last: int, w: int) -> int:
        """The state of the text read so far with w behind it; other items may have it already."""
        if (have := self.next[last].get(w)) is not None:
            return have if self.length[have] == self.length[last] + 1 else self._split(last, w, have)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        """The part of q whose strings are one word longer than those of p becomes a state of its own."""
        part = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = part
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = part
            p = self.link[p]
        return part

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set, int]:
        """(hit spans [start, end), merged; items with a window in them; the longest match that reaches a window)."""
        spans: list[list[int]] = []
        items: set = set()
        if not self.least or len(words) < self.least:
            return spans, items, 0
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        move, link, length, near, ends, least = self.next, self.link, self.length, self.near, self.ends, self.least
        longest, told = 0, set()
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < least:
                continue
            v = at = 0
            for i, w in enumerate(ids[a:b].tolist(), a + 1):
                while v and w not in move[v]:
                    v = link[v]
                    at = length[v]
                if (to := move[v].get(w)) is None:
                    at = 0
                    continue
                v, at = to, at + 1
                if at < least:
                    continue
                u, most = near[v], 0
                while u:
                    for size, own in ends[u].items():
                        if size <= at:
                            most = max(most, size)
                            if (u, size) not in told:
                                told.add((u, size))
                                items |= own
                    u = near[link[u]]
                if most:
                    longest = max(longest, at)
                    start = i - most
                    while spans and spans[-1][0] >= start:
                        spans.pop()
                    if spans and spans[-1][1] >= start:
                        spans[-1][1] = i
                    else:
                        spans.append([start, i])
        return spans, items, longest


def _words(text: Column) -> Column:
    """The words of a text, JVM-side."""
    return F.filter(F.split(F.translate(text.cast("string"), UPPER, LOWER), NO_WORD, -1), lambda w: w != "")


def pieces(items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item, words, size): overlapping pieces of every item, and the words of its windows."""
    rows = items.select(F.col(id_column).cast("string").alias("item"), _words(F.col(text_column)).alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("size", F.least(F.lit(window), F.ceil(F.size("words") * F.lit(coverage)).cast("int"), F.size("words"))).where("size > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - F.col("size"), F.lit(0)), F.lit(PIECE_WORDS))
    cuts = rows.withColumn("start", F.explode(starts))
    return cuts.select("item", F.slice("words", F.col("start") + 1, F.lit(PIECE_WORDS) + F.col("size") - 1).alias("words"), "size")


#: In a Python worker: the automaton in use, by the number of its shard. One at a time.
_HELD: dict[int, SuffixAutomaton] = {}
_NUMBERS = count()


def _automaton(number: int, shard: Broadcast) -> SuffixAutomaton:
    if number not in _HELD:
        _HELD.clear()
        _HELD[number] = SuffixAutomaton([(item, [w.encode() for w in words], size) for item, words, size in shard.value])
    return _HELD[number]


def _shards(items: DataFrame, window: int, coverage: float, id_column: str, text_column: str) -> tuple[DataFrame, int]:
    cuts = cut(pieces(items, window, coverage, id_column, text_column))
    words = cuts.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    many = max(1, -(-words // SHARD_WORDS))
    return cuts.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(many))), many


def _matcher(docs: DataFrame, shard: DataFrame, columns: list[str], text_column: str, hits_only: bool) -> DataFrame:
    """The named columns of docs and _leaks, as far as this shard knows; with hits_only, of documents with hits."""
    held = docs.sparkSession.sparkContext.broadcast([(r["item"], r["words"], r["size"]) for r in shard.collect()])  # about SHARD_WORDS words at most
    number, names = next(_NUMBERS), [c for c in columns if c.lower() != "_leaks"]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("_leaks", T.StructType.fromDDL(LEAKS))])
    arrow = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _automaton(number, held)
        for batch in batches:
            out, kept = [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()):
                words = words_of(text)
                spans, items, longest = own.match(words)
                if spans or not hits_only:
                    kept.append(i)
                    out.append({"n_words": len(words), "n_hit": sum(b - a for a, b in spans), "longest": longest, "items": sorted(x for x in items if x is not None), "spans": [{"start": a, "end": b} for a, b in spans]})
            columns = batch.columns[:-1]
            if hits_only:
                columns = [c.take(pa.array(kept, pa.int64())) for c in columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, arrow)], names=[*names, "_leaks"])

    return map_batches(docs.select(*(F.col(f"`{c}`") for c in names), F.col(text_column).cast("string").alias("_text_")), run, schema)


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, keep: list[str] | None = None, text_column: str = "text", id_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs (the columns in keep, or all) with _leaks: its words, hit words, longest match, items as sorted strings, and hit spans in words."""
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() != "_leaks"]
    shards, many = _shards(items, window, coverage, id_column, item_text)
    if many == 1:
        return _matcher(docs, shards, names, text_column, False)
    # texts stay where they are: hits are gathered by two hashes of the text, on which alone they depend
    key = [F.xxhash64(F.col(text_column).cast("string")).alias("_h1"), F.xxhash64(F.lit(1), F.col(text_column).cast("string")).alias("_h2")]
    keys, parts = docs.select(*key, F.col(text_column).cast("string").alias("text")), []
    for n in range(many):
        found = _matcher(keys, shards.where(F.col("shard") == n), ["_h1", "_h2"], "text", True)
        parts.append(cut(found.groupBy("_h1", "_h2").agg(F.any_value("_leaks").alias("_leaks"))))  # copies count once
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    hits = hits.groupBy("_h1", "_h2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_leaks.items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("_leaks.spans"))).alias("parts"), F.max("_leaks.longest").alias("longest"))  # a row from each shard
    joined = F.aggregate(
        "parts",
        F.expr(_NO_SPANS),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    hits = hits.select("_h1", "_h2", "items", "longest", joined.alias("spans"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), *key, F.coalesce(F.size(_words(F.col(text_column))), F.lit(0)).cast("bigint").alias("n_words")).join(hits, ["_h1", "_h2"], "left")
    n_hit = F.aggregate(F.coalesce("spans", F.expr(_NO_SPANS)), F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    leaks = F.struct("n_words", n_hit.alias("n_hit"), F.coalesce("longest", F.lit(0)).cast("bigint").alias("longest"), F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"), F.coalesce("spans", F.expr(_NO_SPANS)).alias("spans"))
    return rows.select(*(F.col("row")[c].alias(c) for c in names), leaks.alias("_leaks"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, drop_share: float = DROP_SHARE, text_column: str = "text", id_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the hit spans of their texts, and without documents of which more than drop_share is hit.

    A span goes from its first word's first character to its last word's last one;
    what stands around it stays as it is.
    """
    found = scan(docs, items, window, coverage, None, text_column, id_column, item_text)
    found = found.where(F.col("_leaks.n_hit") <= F.col("_leaks.n_words") * F.lit(drop_share))
    names = [c for c in found.columns if c != "_leaks"]
    at = names.index(text_column)
    schema = T.StructType([T.StructField(c, T.StringType()) if c == text_column else found.schema[c] for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(found.withColumn(text_column, F.col(text_column).cast("string")).select(*(F.col(f"`{c}`") for c in names), "_leaks.spans"), run, schema)


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def without(text: str | None, spans: list) -> str | None:
    """text without the characters of the given spans of words."""
    if not text or not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for s in spans:
        out.append(text[last : places[s["start"]][0]])
        last = places[s["end"] - 1][1]
    return "".join([*out, text[last:]])


ORACLE_SQL = rf"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item, words, least({WINDOW}, len(words)) AS size FROM items WHERE len(words) > 0),
windows AS (SELECT DISTINCT item, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS shingle FROM sized),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(list_filter(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> ''), []) AS words FROM documents),
places AS (SELECT r, size, unnest(range(1, len(words) - size + 2)) AS pos, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS shingle FROM docs, (SELECT DISTINCT size FROM windows)),
found AS (SELECT DISTINCT r, pos, p.size, item FROM places p JOIN windows USING (size, shingle)),
hit AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(pos, pos + size)) AS word FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
