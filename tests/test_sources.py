"""File trees, roots, lists and globs."""

import hashlib
import os

import pytest
from pyspark.errors import PySparkException

from sparksync.sources import manifest, roots


@pytest.fixture
def tree(tmp_path):
    for name, data in {"a.txt": b"one", "sub/b c.txt": b"two two", "sub/deep/é.bin": b"\x00\x01", "sub/e.tmp": b"", ".hidden/x": b"h"}.items():
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    os.symlink("sub", tmp_path / "root" / "l")
    return str(tmp_path / "root")


def test_scan_manifest(spark, tree):
    rows = {r["path"]: r for r in manifest.scan_manifest(spark, tree).collect()}
    files = {p: r["size"] for p, r in rows.items() if r["kind"] == "file"}
    assert files == {"a.txt": 3, "sub/b c.txt": 7, "sub/deep/é.bin": 2, "sub/e.tmp": 0, ".hidden/x": 1}
    assert {p for p, r in rows.items() if r["kind"] == "dir"} == {"sub", "sub/deep", ".hidden"}
    assert (rows["l"]["kind"], rows["l"]["link_target"], rows["l"]["size"]) == ("symlink", "sub", 0)
    info = os.lstat(f"{tree}/a.txt")
    got = rows["a.txt"]
    assert (got["mode"], got["inode"]) == (info.st_mode & 0o7777, info.st_ino)
    assert got["mtime_sec"] * 10**9 + got["mtime_nsec"] == info.st_mtime_ns


def test_scan_options(spark, tree):
    flat = manifest.scan_manifest(spark, tree, recursive=False)
    assert {r["path"] for r in flat.collect()} == {"a.txt", "sub", ".hidden", "l"}
    # An excluded directory is not entered, even for an included name.
    kept = manifest.scan_manifest(spark, tree, includes=["é.bin"], excludes=["deep", ".*", "*.tmp"])
    assert {r["path"] for r in kept.collect()} == {"a.txt", "sub", "sub/b c.txt", "l"}


def test_hash_manifest(spark, tree):
    rows = {r["path"]: r["hash"] for r in manifest.hash_manifest(spark, tree).collect()}
    assert rows["sub/b c.txt"] == hashlib.sha256(b"two two").hexdigest()
    assert rows["sub/e.tmp"] == hashlib.sha256(b"").hexdigest()
    assert rows["sub"] is None and rows["l"] is None


def test_indexed_manifest(spark, tree):
    rows = {r["path"]: r["size"] for r in manifest.indexed_manifest(spark, tree).collect()}
    # Links are followed, so the linked directory shows up twice.
    assert rows == {"a.txt": 3, "sub/b c.txt": 7, "sub/deep/é.bin": 2, "l/b c.txt": 7, "l/deep/é.bin": 2}
    plan = manifest.indexed_manifest(spark, tree)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in plan
    flat = manifest.indexed_manifest(spark, tree, recursive=False, hashed=True).collect()
    assert [(r["path"], r["hash"]) for r in flat] == [("a.txt", hashlib.sha256(b"one").hexdigest())]
    kept = manifest.indexed_manifest(spark, "file://" + tree, includes=["é.bin"], excludes=["deep", "l"])
    assert {r["path"] for r in kept.collect()} == {"a.txt", "sub/b c.txt"}


def test_scanned_trees_sync(spark, tree, tmp_path):
    import shutil

    from sparksync.plans.planner import plan_sync

    other = str(tmp_path / "copy")
    shutil.copytree(tree, other, symlinks=True)
    os.remove(f"{other}/a.txt")
    with open(f"{other}/sub/b c.txt", "ab") as f:
        f.write(b"!")
    plan = plan_sync(manifest.scan_manifest(spark, tree), manifest.scan_manifest(spark, other))
    changed = {r["path"]: r["action"] for r in plan.filter("action <> 'skip' AND kind <> 'symlink'").collect()}
    assert changed == {"a.txt": "create", "sub/b c.txt": "update"}


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def entries(spark, *paths):
    return spark.createDataFrame([(p, 1) for p in paths], "path string, size long")


def test_file_list(spark):
    m = entries(spark, "data/a.txt", "data/sub/b.txt", "data/subway/c.txt", "other/d.txt")
    listed = roots.parse_file_list(lines(spark, "/data/a.txt\r", "", "   ", " /data/sub ", "/data/sub/", "/nowhere/x", "/data/sub/b.txt"))
    chosen, missing = roots.select_file_list(m, listed)
    assert sorted(r["path"] for r in chosen.collect()) == ["data/a.txt", "data/sub/b.txt"]
    assert [r["root"] for r in missing.collect()] == ["nowhere/x"]
    with pytest.raises(PySparkException):
        roots.parse_file_list(lines(spark, "relative/x")).collect()


def test_pattern_file(spark, tmp_path):
    f = tmp_path / "patterns"
    f.write_text("# comment\n; other\n\n  *.tmp\n/build # not a comment\n   \n")
    assert roots.read_pattern_file(spark, str(f)) == ["*.tmp", "/build # not a comment"]


def test_merge_roots(spark):
    m = entries(spark, "a/x", "a/b/y", "a/b/z", "ab/w", "c")
    r = spark.createDataFrame([("a/b",), ("a",), ("a",), ("c",)], "root string")
    assert sorted(x["path"] for x in roots.merge_roots(m, r).collect()) == ["a/b/y", "a/b/z", "a/x", "c"]
    # A rejected root covers nothing, so the root below it counts.
    kept = roots.merge_roots(m, r, excludes=["a"])
    assert sorted(x["path"] for x in kept.collect()) == ["a/b/y", "a/b/z", "c"]


def test_glob_source(spark):
    m = entries(spark, "src/a.rs", "src/x/b.rs", "src/x/c.txt", "we*rd", "src/dir.rs/inner")
    get = lambda p: sorted(r["path"] for r in roots.expand_glob_source(m, p).collect())
    assert get("src/*.rs") == ["a.rs", "dir.rs/inner"]
    assert get("./src/**/*.rs") == ["a.rs", "dir.rs/inner", "x/b.rs"]
    assert get("src/?/[!c].rs") == ["x/b.rs"]
    assert get("we*rd") == ["we*rd"]
    with pytest.raises(ValueError):
        get("nothing/*")
    assert [roots.glob_base(p) for p in ("./*", "*.rs", "src/*", "src/**/x", "/*.rs", "./a/b*")] == ["", "", "src", "src", "/", "a"]


def test_rebase(spark):
    m = entries(spark, "x\\y")
    get = lambda s: manifest.rebase_paths(m, s).first()["path"]
    assert [get(s) for s in ("dir", "a/dir", "dir/", ".", "a/..")] == ["dir/x/y", "dir/x/y", "x/y", "x/y", "x/y"]


def test_table_manifest_default_columns(spark):
    df = manifest.with_manifest_columns(entries(spark, "a"), ["path", "kind", "inode"])
    assert df.first().asDict() == {"path": "a", "kind": "file", "inode": None}
