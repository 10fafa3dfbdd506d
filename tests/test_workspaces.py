"""Workspace roots of every manifest that declares them."""

import json

from corpuscle.sources.workspaces import workspace_roots


def roots(spark, files):
    return [r["root"] for r in workspace_roots(spark.createDataFrame(files, "path string, text string")).collect()]


def test_roots_of_every_manifest(spark):
    tree = [("packages/web/package.json", "{}"), ("packages/api/go.mod", ""), ("packages/api/v2/package.json", ""), ("packages/none/a.txt", ""), ("apps/x/y/pom.xml", ""), ("crates/one/Cargo.toml", ""), ("svc/main.go", None), ("a.b/package.json", ""), ("aXb/package.json", "")]
    npm = json.dumps({"workspaces": ["packages/*", "!packages/web", "/a.b/"]})
    assert roots(spark, [("package.json", npm), *tree]) == ["a.b", "packages/api", "packages/web"]
    assert roots(spark, [("package.json", json.dumps({"workspaces": {"packages": ["apps/**/y"]}})), *tree]) == ["apps/x/y"]
    assert roots(spark, [("pnpm-workspace.yaml", "# x\npackages:\n  - 'packages/**'\n\n- \"apps/x/?\"\nother:\n  - a.b\n"), *tree]) == ["packages/api", "packages/web", "apps/x/y", "packages/api/v2"]
    assert roots(spark, [("Cargo.toml", '[package]\nname = "z"\n[workspace]\nresolver = "2"\nmembers = [\n  "crates/*",\n]\n[other]\nmembers = ["a.b"]\n'), *tree]) == ["crates/one"]
    assert roots(spark, [("go.work", "go 1.22\nuse ./svc\nuse (\n  ./packages/api\n  ./missing\n)\n"), *tree]) == ["svc", "packages/api"]


def test_no_or_broken_manifest_gives_no_root(spark):
    assert roots(spark, []) == []
    assert roots(spark, [("package.json", "{broken"), ("Cargo.toml", None), ("go.work", ""), ("p/package.json", json.dumps({"workspaces": ["p"]}))]) == []
    assert roots(spark, [("package.json", json.dumps({"workspaces": "p"})), ("p/package.json", "")]) == []
