"""Byte-pair encoding with forced-boundary splitting, and decoding.

A byte pair that occurs inside no vocabulary token can never be bridged by a
merge, because every merge yields a vocabulary token. Such pairs mark certain
cuts: a word is cut there, each fragment is merged on its own, and the ids are
concatenated. The last byte of a word counts as a symbol of its own (it carries
the word-end suffix), which makes more pairs impossible.

Defined results: a null text encodes as the empty text (no ids); special token
strings inside a text become their ids, as the vocabulary file declares them;
text of any length is processed whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from corpuscle.llm.common import map_batches

#: Words and fragments remembered per Python worker, and the longest one remembered.
CACHE_ENTRIES, CACHE_LENGTH = 300_000, 64

def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in table)
    table |= {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class _Memo(dict):
    """A dict that computes what it lacks. Full, it keeps what was asked for since it was last full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class ForcedBoundaryBpe:
    """Word-end BPE of a tokenizers JSON file, with ids packed as little-endian uint32."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        suffix = model["end_of_word_suffix"] or ""
        self.inner = BPE(vocab=vocab, merges=merges, cache_capacity=0)
        self.final = BPE(vocab=vocab, merges=merges, end_of_word_suffix=suffix, cache_capacity=0)
        symbols = byte_symbols()
        self.symbols = dict(enumerate(symbols))
        # joined[x][y]: byte x is followed by byte y (y + 256: by y at the word's end) inside some token
        self.value = value = {s: b for b, s in enumerate(symbols)}
        self.joined = [bytearray(512) for _ in range(256)]
        for token in vocab:
            ends = bool(suffix) and token.endswith(suffix)
            body = [value[c] for c in (token[: -len(suffix)] if ends else token) if c in value]
            for i in range(len(body) - 1):
                self.joined[body[i]][body[i + 1] + 256 * (ends and i + 2 == len(body))] = 1
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        contractions = "'s|'t|'re|'ve|'m|'ll|'d"
        # one rule for three alphabets: the smaller the alphabet, the faster the search
        self.ascii = re.compile(rf"{contractions}|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        letters, numbers = "a-zß-öø-ÿªµº", "0-9²³¹¼-¾"
        self.latin = re.compile(rf"{contractions}|[{letters}]+|[{numbers}]|[^\t-\r \x85\xa0{letters}{numbers}]+")
        self.every = regex.compile(rf"{contractions}|\p{{L}}+|\p{{N}}|[^\s\p{{L}}\p{{N}}]+")
        own = Tokenizer.from_file(path)
        self.normalizer, self.splitter = own.normalizer, own.pre_tokenizer
        self.words = _Memo(self._word)

    def _word(self, word: str) -> bytes:
        data = word.encode("utf-8", "surrogatepass")
        return self._marked(data, data.decode("latin-1").translate(self.symbols))

    def _marked(self, data: bytes, marks: str) -> bytes:
        """Cut where no token has the two bytes side by side, merge each fragment on its own, concatenate."""
        joined = self.joined
        last, start, ids = len(data) - 1, 0, []
        for i in range(last):
            if not joined[data[i]][data[i + 1] + 256 * (i + 1 == last)]:
                ids += [t.id for t in self.inner.tokenize(marks[start : i + 1])]
                start = i + 1
        ids += [t.id for t in self.final.tokenize(marks[start:])]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian uint32."""
        if not text:
            return b""
        if self.special_at is None or "<|" not in text:
            return self._encode_plain(text)
        out = []
        for i, part in enumerate(self.special_at.split(text)):
            out.append(struct.pack("<I", self.special[part]) if i % 2 else self._encode_plain(part))
        return b"".join(out)

    def _encode_plain(self, text: str) -> bytes:
        if text.isascii():
            return b"".join(map(self.words.__getitem__, self.ascii.findall(text.lower())))
        # letters are lowered one by one: no rule for a sigma at a word's end
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if any(unicodedata.category(c) == "Cn" for c in set(text)):  # unknown here, perhaps not to the library
                return b"".join(self._marked(bytes(map(self.value.__getitem__, w)), w) for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text)))
            return b"".join(map(self.words.__getitem__, self.every.findall(text)))
        return b"".join(map(self.words.__getitem__, self.latin.findall(text)))

    def decode(self, ids: bytes) -> str:
        """The tokens of packed ids, joined by spaces; this vocabulary declares no decoder."""
        return " ".join(map(self.token.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryBpe:
    """One encoder per vocabulary and Python worker."""
    return ForcedBoundaryBpe(path)


def encode(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids, decoded): the ids of every whole text (binary, little-endian uint32) and the text decoded from them."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.string())], names=["id", "ids", "decoded"])

    return map_batches(df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")), run, f"id {kind}, ids binary, decoded string")


def encode_digests(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts and digests of the ids and of the decoded text, one row per document.

    The same encoder and decoder as encode(), but ids and texts stay in the worker.
    """
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text)
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(own.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")), run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
