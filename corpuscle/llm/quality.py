"""Quality classifier on supervised subword embeddings.

A document is the mean of the learned vectors of its features: hashed words,
hashed character n-grams of words, and one vector for words that repeat the word
before them, which no n-gram of a single word can show. A softmax layer over that
mean gives the score. Vectors and layer are trained together by numpy
stochastic gradient descent.

The layer is linear, so it is applied to the vectors once after training: every
bucket then has one number, a word's sum is remembered, and scoring a whole text
is a sum over its words. A very long word is taken in blocks.

Fitting uses at most FIT_DOCS labelled texts of each class, whole, of FIT_BYTES in
both classes; which ones, a hash of id and text decides over all labelled rows.

Defined results: a null, empty or blank text gets the score of a document
without features; labels that are null or not 0 or 1 teach nothing; an id with
two labels counts as class 1; rows that repeat id and text teach once; without
labels of both classes every score is 0.5; repeated rows stay; an empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import bounded_sample, keyed, map_batches

BUCKETS, DIMENSIONS, SIZES = 1 << 17, 8, (3, 4)
EPOCHS, RATE, SEED = 6, 2.0, 11
#: Bounds of the fitted sample: texts of a class, bytes in all, and the length from which texts are taken last.
FIT_DOCS, FIT_BYTES, FIT_LONG = 1000, 32 << 20, 8 << 10
#: Words remembered per Python worker, and the longest one remembered.
CACHE_WORDS, CACHE_LENGTH = 300_000, 64
#: Bytes of a word that are taken at a time.
BLOCK = 1 << 14
#: The feature of a word that repeats the one before it.
REPEAT = 0


def features(word: str) -> Iterator[list[int]]:
    """Buckets of a word and of its character n-grams, in blocks."""
    data = f"<{word}>".encode("utf-8", "surrogatepass")
    crc = zlib.crc32
    yield [1 + crc(b" " + data) % (BUCKETS - 1)]
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK + SIZES[-1] - 1]
        yield [1 + crc(part[i : i + n]) % (BUCKETS - 1) for n in SIZES for i in range(min(BLOCK, len(part) - n + 1))]


def document(text: str, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their shares; known remembers the features of words."""
    words = text.split()
    for w in set(words) - known.keys():
        known[w] = np.array([f for block in features(w) for f in block])
    repeats = sum(map(operator.eq, words, words[1:]))
    found = [*map(known.__getitem__, words), np.full(repeats, REPEAT)]
    ids, counts = np.unique(np.concatenate(found), return_counts=True)
    return ids, counts / max(1, counts.sum())


def fit(texts: list[str], labels: list[int]) -> tuple[float, bytes]:
    """(bias, weights): the margin of class 1 over class 0 by bucket, as float32."""
    if len(set(labels)) < 2:
        return 0.0, b""
    rng = np.random.default_rng(SEED)
    vectors, out, bias = rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSIONS)) / DIMENSIONS, rng.normal(0, 0.5, (DIMENSIONS, 2)), np.zeros(2)
    known: dict[str, np.ndarray] = {}
    docs, y = [document(t, known) for t in texts], np.array(labels)
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            ids, share = docs[i]
            rate = RATE * (1 - done / steps)
            done += 1
            h = share @ vectors[ids]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= 0.2 * rate * np.outer(h, p)
            bias -= 0.02 * rate * p
            vectors[ids] -= rate * np.outer(share, back) * np.sqrt(len(ids))
    return float(bias[1] - bias[0]), (vectors @ (out[:, 1] - out[:, 0])).astype("<f4").tobytes()


class Scorer:
    """Scores whole texts; a word's sum and number of features are one complex number."""

    def __init__(self, model: tuple[float, bytes]):
        self.bias, self.weights = model[0], np.frombuffer(model[1], "<f4").tolist()
        self.words: dict[str, complex] = {}

    def word(self, word: str) -> complex:
        value = 0j
        for block in features(word):
            value += complex(sum(map(self.weights.__getitem__, block)), len(block))
        if len(word) <= CACHE_LENGTH:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            self.words[word] = value
        return value

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.5
        words = (text or "").split()
        get, own = self.words.get, self.word
        total = sum(v if (v := get(w)) is not None else own(w) for w in words)
        repeats = sum(map(operator.eq, words, words[1:]))
        margin = self.bias
        if words:
            margin += (total.real + repeats * self.weights[REPEAT]) / (total.imag + repeats)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, margin))))


@lru_cache(maxsize=2)
def scorer(model: tuple[float, bytes]) -> Scorer:
    return Scorer(model)


def train(docs: DataFrame, labels: DataFrame, keep: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> tuple[float, bytes]:
    """The model learned from labels whose rows keep holds for."""
    known = labels.where(keep & F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).cast("int").alias("label"))
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    sample = bounded_sample(texts, keyed(texts, "id").join(known, "id"), "label", FIT_DOCS, FIT_BYTES, FIT_LONG).collect()
    rows = sorted((r["label"], r["rank"], r["text"]) for r in sample)
    return fit([t for _, _, t in rows], [c for c, _, _ in rows])


def score(docs: DataFrame, model: tuple[float, bytes], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) of every whole text."""
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["id", "score"])

    return map_batches(docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")), run, f"id {kind}, score double")
