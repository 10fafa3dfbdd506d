"""Language identification by a byte convolutional network.

Lower-cased UTF-8 bytes are embedded, convolved with filters of several widths,
max-pooled over a fixed-length window and classified by a softmax layer. The
network is trained in numpy by gradient descent on windows of labelled texts. A
whole text is cut into consecutive windows, padded at its end, and its
probabilities are the mean over all of its windows.

To predict, embedding and filters are folded into tables over byte pairs, so a
convolution is one or two look-ups; windows of many documents go side by side,
a position at a time, so a batch takes a fixed amount of memory.

Fitting uses all windows of at most FIT_DOCS whole texts of each language, of
FIT_BYTES in all languages together; which ones, a hash of id and text decides
over all rows. Only those texts reach the driver.

Defined results: a text that is null or has no letter is `und`, score 0; rows
with a null text or lang teach nothing; rows that repeat id and text teach once;
without any label every text is `und`; repeated rows stay; an empty table gives no
rows. Extra columns are kept, but columns named _lang and _score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from corpuscle.llm.common import bounded_sample, keyed, map_batches

WINDOW, EMBEDDING, FILTERS, WIDTHS = 256, 8, 8, (2, 3, 4)
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.01, 7
#: Bounds of the fitted sample: texts of a language, bytes in all, and the length from which texts are taken last.
FIT_DOCS, FIT_BYTES, FIT_LONG = 250, 32 << 20, 16 << 10
UNKNOWN = "und"
#: How far the score must rise from chance (1 / languages) towards 1 for filter_languages() to keep a document.
MARGIN = 0.07
#: Windows that are convolved side by side.
SIDE = 1024

_LETTER = regex.compile(r"\p{L}")


def windows(text: str) -> np.ndarray:
    """All windows of a text as rows of bytes, the last one padded with zeros."""
    data = text.lower().encode("utf-8", "surrogatepass")
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class ByteCnn:
    """Weights: embedding, a kernel (width, EMBEDDING, FILTERS) and bias per width, and the softmax layer."""

    def __init__(self, languages: list[str]):
        rng = np.random.default_rng(SEED)
        self.languages = languages
        self.weights = {"embedding": rng.normal(0, 0.5, (256, EMBEDDING)), "out": rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(languages))), "out_bias": np.zeros(len(languages))}
        for w in WIDTHS:
            self.weights |= {f"kernel{w}": rng.normal(0, 0.6 / np.sqrt(w), (w, EMBEDDING, FILTERS)), f"bias{w}": np.zeros(FILTERS)}

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Probabilities, pooled features and the places of the maxima."""
        e, pooled, places = self.weights["embedding"][x], [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            conv = sum(e[:, j : j + n] @ self.weights[f"kernel{w}"][j] for j in range(w)) + self.weights[f"bias{w}"]
            at = conv.argmax(axis=1)
            pooled.append(np.maximum(np.take_along_axis(conv, at[:, None], 1)[:, 0], 0))
            places.append(at)
        h = np.concatenate(pooled, axis=1)
        z = h @ self.weights["out"] + self.weights["out_bias"]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), h, places

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, h, places = self._forward(x)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        g = {"out": h.T @ p, "out_bias": p.sum(axis=0), "embedding": np.zeros((256, EMBEDDING))}
        back = (p @ self.weights["out"].T) * (h > 0)
        rows = np.arange(len(x))[:, None]
        for i, w in enumerate(WIDTHS):
            d = back[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"bias{w}"], kernel = d.sum(axis=0), self.weights[f"kernel{w}"]
            g[f"kernel{w}"] = np.zeros_like(kernel)
            for j in range(w):
                b = x[rows, places[i] + j]  # the byte under tap j of each filter's maximum
                g[f"kernel{w}"][j] = np.einsum("nfe,nf->ef", self.weights["embedding"][b], d)
                np.add.at(g["embedding"], b.ravel(), (d[:, :, None] * kernel[j].T[None]).reshape(-1, EMBEDDING))
        return g

    def fit(self, x: np.ndarray, y: np.ndarray) -> ByteCnn:
        """Adam over shuffled mini-batches; the same rows in the same order give the same weights."""
        rng = np.random.default_rng(SEED)
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.weights.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(y), BATCH):
                own = order[at : at + BATCH]
                step += 1
                rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in self._gradients(x[own], y[own]).items():
                    first, second = m[k]
                    first += 0.1 * (g - first)
                    second += 0.001 * (g * g - second)
                    self.weights[k] -= rate * first / (np.sqrt(second) + 1e-8)
        return self

    def packed(self) -> tuple[tuple[str, ...], tuple[tuple[str, tuple[int, ...], bytes], ...]]:
        """The model as hashable, small data for closures."""
        return tuple(self.languages), tuple((k, v.shape, v.astype("<f8").tobytes()) for k, v in self.weights.items())


class Predictor:
    """The trained network as look-up tables."""

    def __init__(self, packed):
        self.languages, weights = packed
        if not weights:
            return
        w = {k: np.frombuffer(data, "<f8").reshape(shape) for k, shape, data in weights}
        taps = {n: [w["embedding"] @ w[f"kernel{n}"][j] for j in range(n)] for n in WIDTHS}
        pair = lambda a, b: (b[:, None] + a[None]).reshape(65536, -1).astype(np.float32)  # noqa: E731  index: first byte + 256 * second
        self.two, self.three, self.third = pair(taps[2][0], taps[2][1]), pair(taps[3][0], taps[3][1]), taps[3][2].astype(np.float32)
        self.four, self.fourth = pair(taps[4][0], taps[4][1]), pair(taps[4][2], taps[4][3])
        self.bias = np.concatenate([w[f"bias{n}"] for n in WIDTHS])
        self.out, self.out_bias = w["out"], w["out_bias"]

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), len(self.languages)))
        for at in range(0, len(rows), SIDE):
            out[at : at + SIDE] = self._side(np.ascontiguousarray(rows[at : at + SIDE].T))
        return out

    def _side(self, x: np.ndarray) -> np.ndarray:
        """x: (WINDOW, windows)."""
        pairs = x[:-1].astype(np.intp) + (x[1:].astype(np.intp) << 8)
        n = x.shape[1]
        most = [np.full((n, FILTERS), -np.inf, np.float32) for _ in WIDTHS]
        a, b = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.float32)
        for i in range(WINDOW - 1):
            self.two.take(pairs[i], axis=0, out=a, mode="clip")
            np.maximum(most[0], a, out=most[0])
            if i < WINDOW - 2:
                self.three.take(pairs[i], axis=0, out=a, mode="clip")
                self.third.take(x[i + 2], axis=0, out=b, mode="clip")
                np.add(a, b, out=a)
                np.maximum(most[1], a, out=most[1])
            if i < WINDOW - 3:
                self.four.take(pairs[i], axis=0, out=a, mode="clip")
                self.fourth.take(pairs[i + 2], axis=0, out=b, mode="clip")
                np.add(a, b, out=a)
                np.maximum(most[2], a, out=most[2])
        h = np.maximum(np.concatenate(most, axis=1) + self.bias, 0)
        z = h @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [bool(self.languages) and t is not None and _LETTER.search(t) is not None for t in texts]
        cut = [windows(t) for t, k in zip(texts, known, strict=True) if k]
        tags, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if cut:
            ends = np.cumsum([len(c) for c in cut])
            sums = np.add.reduceat(self.probabilities(np.concatenate(cut)), np.r_[0, ends[:-1]], axis=0)
            mean = sums / np.diff(np.r_[0, ends])[:, None]
            for i, p in zip((i for i, k in enumerate(known) if k), mean, strict=True):
                tags[i], scores[i] = self.languages[int(p.argmax())], float(p.max())
        return tags, scores


@lru_cache(maxsize=2)
def predictor(packed) -> Predictor:
    return Predictor(packed)


def train(docs: DataFrame, keep: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang"):
    """The packed model learned from the rows of docs that keep holds for."""
    rows = docs.where(keep).select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    sample = bounded_sample(rows, keyed(rows, "lang"), "lang", FIT_DOCS, FIT_BYTES, FIT_LONG).collect()
    own = [(r["lang"], windows(r["text"])) for r in sorted(sample, key=lambda r: (r["lang"], r["rank"])) if _LETTER.search(r["text"])]
    if not own:
        return (), ()
    languages = sorted({lang for lang, _ in own})
    y = np.repeat([languages.index(lang) for lang, _ in own], [len(w) for _, w in own])
    return ByteCnn(languages).fit(np.concatenate([w for _, w in own]), y).packed()


def identify(docs: DataFrame, model, text_column: str = "text") -> DataFrame:
    """The input with _lang and _score."""
    docs = docs.drop("_lang", "_score")
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = predictor(model)
        for batch in batches:
            tags, scores = own.predict(batch.column(names.index(text_column)).cast(pa.string()).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tags, pa.string()), pa.array(scores, pa.float64())], names=[*names, "_lang", "_score"])

    return map_batches(docs, run, StructType(list(schema)).add("_lang", StringType()).add("_score", DoubleType()))


def filter_languages(docs: DataFrame, model, text_column: str = "text", margin: float = MARGIN) -> DataFrame:
    """The documents whose language is known with a score of at least margin above chance; all columns stay."""
    chance = 1 / max(1, len(model[0]))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_column).cast("string").alias("text"))
    return identify(rows, model).where((F.col("_lang") != UNKNOWN) & (F.col("_score") >= chance + margin * (1 - chance))).select("row.*")
