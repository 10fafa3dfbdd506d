"""Ranked lexical search by windowed bucket scoring.

Documents are indexed where they lie: each task numbers its rows and cuts them
into windows of at most WINDOW documents, and a window holds the postings
(term, document, occurrences) of the query terms, sorted by term, with the
documents' ids and lengths. Postings never move. The counts that all windows need
(documents, terms in all, document frequencies) are aggregated from the index.

A task then goes through its windows one by one. For each query the postings of
its terms in the window are scatter-added into an array of WINDOW sums, and the
buckets (64 documents each) that were touched are marked in an occupancy bitset;
only marked buckets are harvested into the query's heap of k documents, and only
they are cleared. A document below the heap's least entry is never looked at again.
What leaves a task is at most k rows for each query.

Query terms and queries are sent to every task; they come in groups of at most
about GROUP_TERMS terms, and further groups are searched one after another.

Score of a document: the sum, over the query's terms, of
w * ((10^9 * tf) div (1000 * tf + 8 * m)), w = floor(1000 * ln((2N + 2) / (2df + 1))),
m = 100 - 90 + (90 * n * N) div L. All of it is exact 64-bit arithmetic.

Defined results: a null or empty text has no terms, counts in no statistic and is
never ranked; rows with a null id count in the statistics but are never returned;
rows that repeat an id are ranked as rows of their own; ties go to the smaller id;
rows that repeat an item_id are one item, with the terms of all of them once each;
a null item_id is an item; items without terms give no rows, nor do empty tables.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.common import cut, map_batches, words_of

K = 10
#: Documents and tokens of a window, and documents of a bucket.
WINDOW, WINDOW_TOKENS, BUCKET = 8192, 2_000_000, 64
#: Terms of the queries that are searched together.
GROUP_TERMS = 200_000

_INDEX = "ids binary, known binary, sizes binary, terms binary, starts binary, places binary, times binary"


class _Held(dict):
    """In a Python worker: what one broadcast stands for, by its number. One at a time."""

    def of(self, number: int, make):
        if number not in self:
            self.clear()
            self[number] = make()
        return self[number]


_VOCABULARY, _NUMBERS = _Held(), count()


def index(docs: DataFrame, terms: list[bytes], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each window: ids, whether they are known, lengths, and the postings of terms, by their places in the list; checkpointed."""
    number, sent = next(_NUMBERS), docs.sparkSession.sparkContext.broadcast(terms)

    def window(rows: list[tuple[int | None, int, np.ndarray]]) -> list[bytes]:
        ids, sizes = [i for i, _, _ in rows], np.array([n for _, n, _ in rows], np.int64)
        term = np.concatenate([t for _, _, t in rows])
        place = np.repeat(np.arange(len(rows)), [len(t) for _, _, t in rows])
        postings, times = np.unique(term * WINDOW + place, return_counts=True)
        own, starts = np.unique(postings // WINDOW, return_index=True)
        arrays = [np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids]), sizes, own.astype(np.int32), np.append(starts, len(postings)).astype(np.int32), (postings % WINDOW).astype(np.uint16), times.astype(np.int32)]
        return [x.tobytes() for x in arrays]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _VOCABULARY.of(number, lambda: {t: i for i, t in enumerate(sent.value)}).get
        rows, tokens = [], 0
        names = [c.split()[0] for c in _INDEX.split(", ")]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in window(rows)], names=names)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(text)
                if not words:
                    continue
                found = np.fromiter(map(place, words, repeat(-1)), np.int64, len(words))
                rows.append((i, len(words), found[found >= 0]))
                tokens += len(rows[-1][2])
                if len(rows) == WINDOW or tokens >= WINDOW_TOKENS:
                    yield pack()
                    rows, tokens = [], 0
        if rows:
            yield pack()

    return cut(map_batches(docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text")), run, _INDEX))


def statistics(found: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, terms in all, and the document frequency of each query term that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        held = np.zeros(0, np.int64)
        for batch in batches:
            for sizes, own, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes, own, starts = np.frombuffer(sizes, np.int64), np.frombuffer(own, np.int32), np.frombuffer(starts, np.int32)
                docs, terms = docs + len(sizes), terms + int(sizes.sum())
                if len(own) and own[-1] >= len(held):
                    held = np.pad(held, (0, int(own[-1]) + 1 - len(held)))
                held[own] += np.diff(starts)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *some.tolist()], pa.int64()), pa.array([docs, terms, *held[some].tolist()], pa.int64())], names=["term", "n"])

    sums = dict(map_batches(found.select("sizes", "terms", "starts"), run, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect())  # at most GROUP_TERMS rows
    return sums.pop(-1, 0), sums.pop(-2, 0), sums


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


class BucketScorer:
    """Sums of a window's documents, with a bit for each bucket that has any."""

    def __init__(self):
        self.sums = np.zeros((WINDOW // BUCKET, BUCKET), np.int64)
        self.flat = self.sums.reshape(-1)
        self.occupied = np.zeros(WINDOW // BUCKET, bool)

    def add(self, places: np.ndarray, gains: np.ndarray) -> None:
        """Scatter-add; a term has each document once."""
        self.flat[places] += gains
        self.occupied[places // BUCKET] = True

    def harvest(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, sums) of the documents that reach least, from occupied buckets; these are empty afterwards."""
        buckets = np.flatnonzero(self.occupied)
        own = self.sums[buckets]
        row, column = np.nonzero(own >= least)
        self.sums[buckets] = 0
        self.occupied[buckets] = False
        return buckets[row] * BUCKET + column, own[row, column]


def search(found: DataFrame, queries: list[tuple[int, list[int]]], documents: int, terms: int, frequencies: dict[int, int], k: int = K) -> DataFrame:
    """(query, doc_id, score): at most k rows for each query and task; queries are (number, terms)."""
    weights = {t: w for t, df in frequencies.items() if (w := weight(documents, df)) > 0}
    sent = found.sparkSession.sparkContext.broadcast(([(q, [t for t in own if t in weights]) for q, own in queries], weights))
    return map_batches(found, _searcher(sent, documents, terms, k), "query bigint, doc_id bigint, score bigint")


def _searcher(sent: Broadcast, documents: int, terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = sent.value
        heaps: dict[int, list[tuple[int, int]]] = {q: [] for q, _ in queries}
        scorer = BucketScorer()
        for batch in batches:
            for row in batch.to_pylist():
                ids, known, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool), np.frombuffer(row["sizes"], np.int64)
                own, starts = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["starts"], np.int32)
                places, times = np.frombuffer(row["places"], np.uint16), np.frombuffer(row["times"], np.int32).astype(np.int64)
                big = int(sizes.max(initial=0)) * 90 * documents >= 2**63
                m = 10 + (np.array([90 * int(n) * documents // terms for n in sizes], np.int64) if big else 90 * sizes * documents // terms)
                part = 10**9 * times // (1000 * times + 8 * m[places])
                gains: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for i, t in enumerate(own.tolist()):
                    if t in weights:
                        a, b = starts[i], starts[i + 1]
                        keep = known[places[a:b]]
                        gains[t] = places[a:b][keep], weights[t] * part[a:b][keep]
                for q, wanted in queries:
                    for t in wanted:
                        if t in gains:
                            scorer.add(*gains[t])
                    heap = heaps[q]
                    place, score = scorer.harvest(max(1, heap[0][0]) if len(heap) == k else 1)
                    if len(place) > k:
                        place, score = (x[score >= np.partition(score, -k)[-k]] for x in (place, score))
                        first = np.lexsort((ids[place], -score))[:k]
                        place, score = place[first], score[first]
                    for entry in zip(score.tolist(), [-i for i in ids[place].tolist()], strict=True):
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        else:
                            heapq.heappushpop(heap, entry)
        out = [(q, -i, s) for q, heap in heaps.items() for s, i in heap]
        columns = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "doc_id", "score"])

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = K, item_column: str = "item_id", item_text: str = "text", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's k highest-scoring documents."""
    clean = F.split(F.translate(F.col(item_text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1)
    of_item = items.select(F.col(item_column).alias("item_id"), F.explode(clean).alias("term")).where("term <> ''").distinct()
    of_item = of_item.groupBy("item_id").agg(F.collect_list("term").alias("own"))
    of_item = cut(of_item.withColumn("query", F.monotonically_increasing_id()))
    total = of_item.agg(F.coalesce(F.sum(F.size("own")), F.lit(0))).first()[0]
    groups = max(1, -(-total // GROUP_TERMS))
    of_item = of_item.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(groups)))
    parts = []
    for n in range(groups):
        queries = of_item.where(F.col("part") == n).select("query", "own").collect()  # about GROUP_TERMS terms at most
        terms = sorted({t for _, own in queries for t in own})
        place = {t: i for i, t in enumerate(terms)}
        found = index(docs, [t.encode() for t in terms], id_column, text_column)
        documents, all_terms, frequencies = statistics(found)
        hits = search(found, [(q, sorted(place[t] for t in own)) for q, own in queries], documents, max(1, all_terms), frequencies, k)
        best = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
        parts.append(best if groups == 1 else cut(best))
    best = parts[0]
    for part in parts[1:]:
        best = best.unionByName(part)
    return best.join(of_item.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = rf"""
WITH words AS (SELECT r, doc_id, unnest(w) AS term, len(w) AS n FROM (SELECT row_number() OVER () AS r, doc_id,
  list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM words GROUP BY r, doc_id, n, term),
sums AS (SELECT count(DISTINCT r) AS docs, count(*) AS terms FROM words),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark) WHERE term <> ''),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, sums GROUP BY term),
scores AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * docs) // terms))))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term), sums WHERE doc_id IS NOT NULL GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= {K}
"""
