"""Scans of a tree under ordered include, exclude and ignore rules, whole or for what has changed."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.sources.readers import BINARY_SUFFIXES, language, suffix

#: Folders that no scan enters; those of tools are added by the caller.
CLOSED = (".git",)


def rule(line: str) -> tuple[str, bool] | None:
    """(regex over whole paths, whether it takes back) of a line of an ignore file; None for blanks and comments.

    A rule with a slash before its end is anchored; one that ends in a slash matches
    only what lies below; any other also matches the path itself. `**` spans folders.
    """
    text = line.rstrip("\n").rstrip(" ") if not line.rstrip("\n").endswith("\\ ") else line.rstrip("\n")
    if not text.strip() or text.startswith("#"):
        return None
    back = text.startswith("!")
    text = text[1:] if back else text
    text = text[1:] if text[:1] == "\\" and text[1:2] in "#!" else text
    below = text.endswith("/")
    parts = text.strip("/").split("/")
    anchored = "/" in text[:-1]
    while parts and parts[0] == "**":
        parts, anchored = parts[1:], False
    open_end = bool(parts) and parts[-1] == "**"
    parts = parts[:-1] if open_end else parts
    out = ""
    for n, part in enumerate(parts):
        if part == "**":
            out += "(?:[^/]+/)*"
            continue
        out += _segment(part) + ("/" if n < len(parts) - 1 else "")
    if not parts:
        return ("^.+$", back)
    return f"^{'' if anchored else '(?:.+/)?'}{out}{'/.*' if below or open_end else '(?:/.*)?'}$", back


def _segment(part: str) -> str:
    out, i = "", 0
    while i < len(part):
        c = part[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := part.find("]", i + 2)) > 0:
            body = part[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        elif c == "\\" and i + 1 < len(part):
            i += 1
            out += re.escape(part[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def matched(path: Column, rules: Sequence[str]) -> Column:
    """Whether the last rule that matches takes the path; rules are a short list, so each becomes one expression."""
    known = [r for r in map(rule, rules) if r]
    hits = [F.when(path.rlike(regex), F.struct(F.lit(n).alias("n"), F.lit(not back).alias("taken"))) for n, (regex, back) in enumerate(known)]
    if not hits:
        return F.lit(False)
    last = F.greatest(*hits) if len(hits) > 1 else hits[0]
    return F.coalesce(last["taken"], F.lit(False))


def ignored(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), ignore: Sequence[str] = ()) -> Column:
    """Include rules first (none: all paths), then exclude rules, then ignore rules."""
    out = matched(path, exclude) | matched(path, ignore)
    return ~matched(path, include) | out if [r for r in map(rule, include) if r] else out


def scan(files: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), ignore: Sequence[str] = (), max_tokens: int = 4000, skip: Sequence[str] = (), closed: Sequence[str] = CLOSED) -> DataFrame:
    """(path, bucket, language, hash, tokens, too_large) of files(path, content binary): every file that is not skipped."""
    path = F.col("path")
    skipped = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, closed)).cast("array<string>")) | path.isin(list(skip))
    binary = suffix(path).isin(BINARY_SUFFIXES) | F.hex(F.substring("content", 1, 1024)).rlike("^(..)*?00")
    bucket = F.when(ignored(path, include, exclude, ignore), "ignored").when(binary, "binary").otherwise("packable")
    size = F.greatest(F.lit(1), F.floor(F.length(F.decode(F.coalesce("content", F.lit(b"")), "UTF-8")) / 4)).cast("bigint")
    rows = files.where(path.isNotNull() & ~skipped).select("path", bucket.alias("bucket"), "content")
    own = F.col("bucket") == "packable"
    rows = rows.select("path", "bucket", F.when(own, language(path)).alias("language"), F.when(own, F.sha2(F.coalesce("content", F.lit(b"")), 256)).alias("hash"), F.when(own, size).otherwise(0).alias("tokens"))
    return rows.withColumn("too_large", F.col("tokens") > max_tokens)


def expanded(changed: DataFrame, files: DataFrame) -> DataFrame:
    """(path): changed paths, and for a folder all files below it: an equi-join on the leading parts of paths."""
    asked = changed.select(F.trim(F.replace("path", F.lit("\\"), F.lit("/"))).alias("path")).where("path <> ''").distinct()
    parts = F.split("path", "/")
    leads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    below = files.select(F.col("path").alias("file"), F.explode(leads).alias("path")).join(asked, "path", "left_semi").select(F.col("file").alias("path"))
    return asked.unionByName(below).distinct()


def scan_changed(files: DataFrame, previous: DataFrame, changed: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), ignore: Sequence[str] = (), max_tokens: int = 4000, skip: Sequence[str] = (), closed: Sequence[str] = CLOSED) -> DataFrame:
    """The columns of scan() and reused: rows of the previous scan for untouched files that are still there, new ones for what has changed.

    Only changed files are read and hashed. Of the previous scan only packable rows
    count. The caller vouches that rules and settings are those of the previous scan.
    """
    touched = expanded(changed, files)
    there = files.select("path").distinct()
    own = previous.where("bucket = 'packable'").join(touched, "path", "left_anti").join(there, "path", "left_semi")
    own = own.where(~F.col("path").isin(list(skip)))
    kept = own.select("path", "bucket", "language", "hash", "tokens", (F.col("tokens") > max_tokens).alias("too_large"), F.lit(True).alias("reused"))
    fresh = scan(files.join(touched, "path", "left_semi"), include, exclude, ignore, max_tokens, skip, closed).withColumn("reused", F.lit(False))
    return kept.unionByName(fresh)
