"""Symbols, imports and summaries of source files; parsing has no SQL form and runs in Arrow batches."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Declarations of languages without a parser here: language -> [(kind, pattern)].
DECLARATIONS = {
    "javascript": [("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("class", r"^\s*(?:export\s+)?class\s+(\w+)")],
    "typescript": [("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("class", r"^\s*(?:export\s+)?(?:abstract\s+)?(?:class|interface)\s+(\w+)")],
    "go": [("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("class", r"^type\s+(\w+)\s+(?:struct|interface)")],
    "java": [("class", r"^\s*(?:public\s+|final\s+|abstract\s+)*(?:class|interface|enum)\s+(\w+)")],
    "ruby": [("function", r"^\s*def\s+(?:self\.)?(\w+[?!]?)"), ("class", r"^\s*(?:class|module)\s+(\w+)")],
    "rust": [("function", r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"), ("class", r"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)")],
}
IMPORTS = {
    "javascript": r"""(?:from|require\(|import\()\s*['"]([^'"]+)['"]""",
    "typescript": r"""(?:from|require\(|import\()\s*['"]([^'"]+)['"]""",
    "go": r'(?m)^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"',
    "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)",
    "ruby": r"""(?m)^\s*require(?:_relative)?\s+['"]([^'"]+)['"]""",
    "rust": r"(?m)^\s*use\s+([\w:]+)",
}


def python_facts(text: str) -> tuple[list[tuple], list[str]]:
    """Symbols (name, kind, start, end) and imports of Python source; none if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    found, imports = [], []
    stack: list[tuple[ast.AST, bool]] = [(tree, False)]
    while stack:
        node, inside = stack.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                found.append((child.name, "class", child.lineno, child.end_lineno))
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                found.append((child.name, "method" if inside else "function", child.lineno, child.end_lineno))
            elif isinstance(child, ast.Import):
                imports += [a.name for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                imports.append("." * child.level + (child.module or ""))
            stack.append((child, isinstance(child, ast.ClassDef)))
    return sorted(found, key=lambda s: s[2]), imports


def other_facts(text: str, language: str) -> tuple[list[tuple], list[str]]:
    """The same by patterns, line by line; a symbol ends where the next one begins."""
    lines = text.split("\n")
    found = [(m[1], kind, n, 0) for n, line in enumerate(lines, 1) for kind, p in DECLARATIONS.get(language, []) if (m := re.search(p, line))]
    ends = [s[2] - 1 for s in found[1:]] + [len(lines)]
    imports = re.findall(IMPORTS[language], text) if language in IMPORTS else []
    return [(n, k, a, max(a, e)) for (n, k, a, _), e in zip(found, ends, strict=True)], imports


def facts(files: DataFrame) -> DataFrame:
    """(path, name, kind, start_line, end_line) of symbols and imports (kind import) of files(path, language, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, language, text in zip(batch["path"], batch["language"], batch["content"], strict=True):
                symbols, imports = python_facts(text) if language == "python" else other_facts(text, language or "")
                out += [(path, *s) for s in symbols] + [(path, i, "import", 0, 0) for i in imports]
            yield pd.DataFrame(out, columns=["path", "name", "kind", "start_line", "end_line"]).astype({"start_line": "int32", "end_line": "int32"})

    rows = files.where("content is not null").select("path", "language", "content")
    return rows.mapInPandas(run, "path string, name string, kind string, start_line int, end_line int")


def summaries(files: DataFrame) -> DataFrame:
    """(path, n_symbols, defines, imports): one deterministic row per file with text."""
    per = facts(files).groupBy("path").agg(F.count_if(F.col("kind") != "import").alias("n_symbols"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") != "import", F.col("name")))), ",").alias("defines"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "import", F.col("name")))), ",").alias("imports"))
    return files.where("content is not null").select("path").join(per, "path", "left").select("path", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"), F.coalesce("defines", F.lit("")).alias("defines"), F.coalesce("imports", F.lit("")).alias("imports"))
