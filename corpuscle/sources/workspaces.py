"""Workspace roots of a repository, out of the manifests at its top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Files that make a folder a workspace.
MARKERS = ["package.json", "pyproject.toml", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts"]


def folder_regex(pattern: Column) -> Column:
    """An anchored regular expression of a folder glob: ** spans folders, * and ? do not."""
    out = F.regexp_replace(pattern, r"([.+()\[\]{}^$|\\])", r"\\$1")
    for glob, mark in ((r"\*\*/", "\x01"), (r"\*\*", "\x02"), (r"\*", "\x03"), (r"\?", "\x04")):
        out = F.regexp_replace(out, glob, mark)
    for mark, regex in (("\x01", "(.*/)?"), ("\x02", ".*"), ("\x03", "[^/]*"), ("\x04", "[^/]")):
        out = F.replace(out, F.lit(mark), F.lit(regex))
    return F.concat(F.lit("^"), out, F.lit("$"))


def declared_patterns(path: Column, text: Column) -> Column:
    """The folder patterns that a top-level package.json, pnpm-workspace.yaml or Cargo.toml declares; null for other files."""
    listed = lambda at: F.from_json(F.get_json_object(text, at), "array<string>")
    npm = F.coalesce(listed("$.workspaces"), listed("$.workspaces.packages"))
    section = F.regexp_extract(text, r"(?m)^[ \t]*packages:.*\n((?:(?:[ \t]+|[ \t]*[-#]).*\n?|[ \t]*\n)*)", 1)
    pnpm = F.regexp_extract_all(section, F.lit(r"""(?m)^[ \t]*-[ \t]*['"]*([^'"\n]+?)['"]*[ \t]*$"""), F.lit(1))
    members = F.regexp_extract(text, r"(?ms)^\[workspace\][^\n]*\n(?:(?!^\[).)*?^\s*members\s*=\s*\[(.*?)\]", 1)
    cargo = F.regexp_extract_all(members, F.lit(r"""["']([^"']*)["']"""), F.lit(1))
    return F.when(path == "package.json", npm).when(path == "pnpm-workspace.yaml", pnpm).when(path == "Cargo.toml", cargo)


def workspace_roots(files: DataFrame) -> DataFrame:
    """(root, depth), by depth and name, of files(path, text).

    A root is a folder with a marker file that a declared pattern matches, or one that
    the top-level go.work names and that holds a file. A pattern with ! is left out. The
    patterns come from three files and are broadcast; texts of other files are not read.
    """
    top = files.where(F.col("path").isin("package.json", "pnpm-workspace.yaml", "Cargo.toml"))
    said = top.select(F.explode(declared_patterns(F.col("path"), F.col("text"))).alias("p")).select(F.regexp_replace(F.trim("p"), "^/+|/+$", "").alias("p"))
    wanted = said.where("p <> '' and not startswith(p, '!')").select(folder_regex(F.col("p")).alias("regex")).distinct()
    marked = files.where(F.regexp_extract("path", r"([^/]+)$", 1).isin(MARKERS) & F.col("path").contains("/")).select(F.regexp_replace("path", "/[^/]+$", "").alias("root")).distinct()
    globbed = marked.join(F.broadcast(wanted), F.rlike("root", F.col("regex"))).select("root")
    used = files.where("path = 'go.work'").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:use\s+)?\./([^\s)]+)"), F.lit(1))).alias("root")).distinct()
    held = files.select("path").join(F.broadcast(used), F.col("path").startswith(F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/")))).select("root")
    found = globbed.unionByName(held).distinct()
    return found.withColumn("depth", F.size(F.filter(F.split("root", "/"), lambda x: x != ""))).orderBy("depth", "root")
