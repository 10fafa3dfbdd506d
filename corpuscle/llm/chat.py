"""Chat formatting by token-level assembly.

A turn is formatted as [INST] role [/INST] text </s>. The four control strings
are single reserved ids behind the vocabulary. Roles and texts are encoded as
segments of their own and the reserved ids are spliced in between, so no token
ever spans a boundary and a control id never comes from content. Masks are runs
over token offsets, which are prefix sums of segment lengths; the loss mask covers
exactly the text segments of assistant turns.

Control strings in content are escaped by a backslash after their first
character; one that already has backslashes there gets one more, so unescaping
is exact. Any text, escaped or not, survives encoding and decoding bytewise.

Turns are ordered by turn, then role, then text, nulls first. Conversations are
read as streams of sorted rows: a worker holds a batch of turns at a time, however
long a conversation is. A segment is encoded whole. One conversation is one task,
since its digests are taken over all its turns in order.

Defined results: null role or text: empty; a null conversation id is one
conversation of its own; repeated rows are turns of their own; an empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpuscle.llm.common import map_batches

#: How the vocabulary splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CONTROLS = ("[INST]", "[/INST]", "</s>", "<s>")
OPEN, BODY, END, START = range(4)
_ESCAPE = re.compile(r"([\[<])(\\*)(/?INST\]|/?s>)")
_UNESCAPE = re.compile(r"([\[<])\\(\\*)(/?INST\]|/?s>)")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


class Template:
    """Encodes and decodes turns over a rank file; reserved ids follow its last id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        first = max(ranks.values()) + 2
        self.reserved = {c: first + i for i, c in enumerate(CONTROLS)}
        self.text_of = {i: c for c, i in self.reserved.items()}
        self.encoding = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.reserved)

    def turn(self, role: str, text: str) -> tuple[np.ndarray, int, int]:
        """The ids of a turn, and the offsets at which its text begins and ends."""
        parts = [[self.reserved["[INST]"]], self.encoding.encode_ordinary(escape(role)), [self.reserved["[/INST]"]], self.encoding.encode_ordinary(escape(text)), [self.reserved["</s>"]]]
        ends = np.cumsum([len(p) for p in parts])
        return np.fromiter((i for p in parts for i in p), "<u4", int(ends[-1])), int(ends[2]), int(ends[3])

    def read(self, ids: np.ndarray) -> str:
        """The formatted text of ids."""
        return self.encoding.decode(ids.tolist(), errors="strict")


@lru_cache(maxsize=2)
def template(path: str) -> Template:
    return Template(path)


def _turns(rows: DataFrame, path: str) -> DataFrame:
    """(conv, start_of_conv, offset, ids, loss_from, loss_to): one row per turn, in order."""
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before, offset = template(path), (), 0
        for batch in batches:
            out = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = (conv,) != before
                if first:
                    before, offset = (conv,), 0
                ids, at, end = own.turn(role, text)
                loss = role == "assistant"
                out.append((first, offset, ids.tobytes(), offset + at if loss else None, offset + end if loss else None))
                offset += len(ids)
            first, offsets, ids, lo, hi = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first, pa.bool_()), pa.array(offsets, pa.int64()), pa.array(ids, pa.binary()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["conv", "first", "offset", "ids", "loss_from", "loss_to"])

    return map_batches(rows, run, f"conv {kind}, first boolean, offset bigint, ids binary, loss_from bigint, loss_to bigint")


def format_turns(conversations: DataFrame, path: str, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """Token rows of all turns, each conversation's in order within one partition.

    offset is the turn's first token within its conversation; loss_from and loss_to
    are the token offsets under the loss mask, null for turns without loss.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_column, text_column))
    rows = conversations.select(F.col(conv_column).alias("conv"), F.col(turn_column).alias("turn"), role.alias("role"), text.alias("text"))
    partitions = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(partitions, "conv").sortWithinPartitions("conv", "turn", "role", "text")
    return _turns(rows.select("conv", "role", "text"), path)


def read_back(turns: DataFrame, path: str) -> DataFrame:
    """Digests of every conversation, from nothing but the token rows of format_turns()."""
    kind = turns.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = template(path)
        conv, state = None, None

        def row(conv, s):
            return {"conv": conv, "n_turns": s[0], "turns_sha256": s[1].hexdigest(), "loss_chars": s[2], "loss_sha256": s[3].hexdigest(), "formatted_chars": s[4]}

        for batch in batches:
            done = []
            for x in batch.to_pylist():
                if x["first"]:
                    if state:
                        done.append(row(conv, state))
                    conv, state = x["conv"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.frombuffer(x["ids"], "<u4")
                formatted = own.read(ids)
                opened = len(CONTROLS[OPEN])
                body = formatted.index(CONTROLS[BODY], opened)
                role, text = formatted[opened:body], formatted[body + len(CONTROLS[BODY]) : -len(CONTROLS[END])]
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
                if x["loss_from"] is not None:
                    loss = unescape(own.read(ids[x["loss_from"] - x["offset"] : x["loss_to"] - x["offset"]]))
                    state[2] += len(loss)
                    state[3].update(loss.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if state:
            yield pa.RecordBatch.from_pylist([row(conv, state)], schema=schema)

    types = [("conv", to_arrow_type(turns.schema["conv"].dataType)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    schema = pa.schema(types)
    return map_batches(turns, run, f"conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
