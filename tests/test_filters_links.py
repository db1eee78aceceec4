"""Filter patterns, path expressions, link and permission decisions."""

import random
import re

from pyspark.sql import functions as F

from sparksync.functions import globs, paths
from sparksync.operators import filters, link_targets, links, reports

FILTER_CASES = [
    # (excludes, includes, passing, hidden)
    (["*.log"], [], ["logs/app.txt", "log"], ["app.log", "logs/app.log"]),
    (["v?"], [], ["v", "v10"], ["v1", "old/v2"]),
    (["/dist"], [], ["web/dist", "distant"], ["dist", "dist/app.js"]),
    (["docs/*.md"], [], ["docs/a.html"], ["docs/a.md", "x/y/docs/a.md", "docs/deep/a.md"]),
    (["ocs/*.md"], [], ["ocs/a.html"], ["docs/a.md"]),
    (["*.log"], ["audit.log"], ["audit.log", "a.txt", "x/audit.log"], ["app.log"]),
    (["**/cache"], [], ["x/cached", "x/y/z"], ["cache", "x/cache", "x/y/cache"]),
    (["q/r"], [], ["q/s"], ["p/q/r", "p/q/rs/t"]),
    (["/m*/n"], [], ["x/m/n"], ["m1/n", "m/x/n", "m*/n/o"]),
    (["/"], [], ["a"], []),
    (["x.y", "[z]"], [], ["xxy", "z"], ["x.y", "[z]"]),
    (["out/"], [], ["out/x"], ["out", "a/out"]),
]


def wildcard(pattern, text):
    """Full match of a pattern by trying every split at a star."""
    if not pattern:
        return not text
    if pattern[0] == "*":
        return any(wildcard(pattern[1:], text[i:]) for i in range(len(text) + 1))
    return bool(text) and pattern[0] in ("?", text[0]) and wildcard(pattern[1:], text[1:])


def test_filter_cases(spark):
    for excludes, includes, passing, hidden in FILTER_CASES:
        df = spark.createDataFrame([(p,) for p in passing + hidden], "path string")
        got = {r["path"] for r in filters.glob_filter(df, includes, excludes).collect()}
        assert got == set(passing), (excludes, includes)


def test_glob_language():
    rnd = random.Random(3)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randrange(7)))
    outcomes = set()
    for _ in range(3000):
        pattern, text = word("ab/*?."), word("ab/.")
        want = wildcard(pattern, text)
        assert bool(re.fullmatch(globs.glob_regex(pattern), text)) is want, (pattern, text)
        outcomes.add(want)
    assert outcomes == {True, False}


def test_tree_filter_prunes(spark):
    df = spark.createDataFrame([("keep/a.txt",), ("skip/b.txt",), ("x/skip/deep/c.txt",)], "path string")
    got = lambda f, **kw: {r["path"] for r in f(df, **kw).collect()}
    assert got(filters.tree_filter, includes=["*.txt"], excludes=["skip"]) == {"keep/a.txt"}
    assert len(got(filters.glob_filter, includes=["*.txt"], excludes=["skip"])) == 3


def test_unsafe_paths(spark):
    want = {"": "empty", "/etc/x": "absolute", "a/../b": "traversal", "..": "traversal", "a..b/c": None,
            "./a": None, "C:\\x": "absolute", "a\\..\\b": "traversal", "...": None}
    df = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r["path"]: r["unsafe"] for r in filters.mark_unsafe_paths(df).collect()} == want
    safe, held = filters.quarantine_unsafe_paths(df)
    assert safe.count() == 3 and held.count() == 6


def test_path_expressions(spark):
    df = spark.createDataFrame([("a/b.c/d.tar.gz",), ("x",), (".rc",)], "p string").select(
        "p", paths.ancestors(F.col("p")).alias("up"), paths.parent(F.col("p")).alias("dir"),
        paths.stem(F.col("p")).alias("stem"), paths.extension(F.col("p")).alias("ext"),
    )
    got = {r["p"]: (r["up"], r["dir"], r["stem"], r["ext"]) for r in df.collect()}
    assert got == {
        "a/b.c/d.tar.gz": (["a", "a/b.c"], "a/b.c", "d.tar", "gz"),
        "x": ([], "", "x", None),
        ".rc": ([], "", ".rc", None),
    }
    for frm, to, want in [("a/b", "a/c/d", "../c/d"), ("", "x", "x"), ("a", "a", "."), ("a/b", "x", "../../x")]:
        assert spark.range(1).select(paths.relative_to(F.lit(frm), F.lit(to))).first()[0] == want
    for p, want in [("/a/./b//../c", "/a/c"), ("/../x", "/x"), ("a/b/..", "a")]:
        assert spark.range(1).select(paths.normalize(F.lit(p))).first()[0] == want


LINKS = [
    ("in", "dir/f"), ("d/up", "../x"), ("abs", "/data/x"), ("out", "/ext/f"), ("outd", "/ext/d"),
    ("gone", "/ext/none"), ("above", "../../data/x"), ("self", "./self"), ("rootlink", "/data"), ("near", "/data2/x"),
]


def classified(spark):
    df = spark.createDataFrame(LINKS, "path string, link_target string").withColumn("kind", F.lit("symlink"))
    known = spark.createDataFrame([("/ext/f", "file"), ("/ext/d", "dir")], "path string, kind string")
    return links.classify_links(df, known, root="/data")


def test_link_classes(spark):
    got = {r["path"]: r["link_class"] for r in classified(spark).collect()}
    assert got == {
        "in": "internal", "d/up": "internal", "abs": "internal", "out": "external-file", "outd": "external-dir",
        "gone": "dangling-external", "above": "internal", "self": "internal", "rootlink": "internal",
        "near": "dangling-external",
    }
    rewritten = {r["path"]: r["rewritten"] for r in links.rewrite_internal_links(classified(spark), "/data").collect()}
    assert rewritten["d/up"] == "../x" and rewritten["abs"] == "x" and rewritten["in"] == "dir/f"
    assert rewritten["above"] == "x" and rewritten["rootlink"] == "."


def test_link_policy_precedence(spark):
    rows = classified(spark)

    def get(**kw):
        return {r["path"]: (r["outcome"], r["target"]) for r in links.link_policy(rows, links.LinkPolicy(**kw)).collect()}

    default = get()
    assert default["abs"] == ("link", "x") and default["out"] == ("content", None)
    assert default["outd"][0] == default["gone"][0] == default["self"][0] == "skip"
    assert set(get(skip=True, follow=True, literal=True).values()) == {("skip", None)}
    followed = get(follow=True, literal=True)
    assert followed["outd"] == ("content", None) and followed["gone"] == ("skip", None)
    assert get(literal=True)["gone"] == ("link", "/ext/none")
    assert get(literal_internal=True)["abs"] == ("link", "/data/x")
    assert get(literal_external_file=True)["out"] == ("link", "/ext/f")
    assert get(literal_external_file=True, windows_target=True)["out"] == ("content", None)
    assert get(literal_external_dir=True)["outd"] == ("link", "/ext/d")


def test_link_cycles(spark):
    rows = [
        ("s", "s"), ("a", "b"), ("b", "a"), ("to_ring", "a"), ("ok", "file"), ("chain", "ok"),
        ("d/up", ".."), ("x/in", "../y"), ("y/in", "../x"), ("through", "a/deep/file"), ("z", "d"), ("plain", "dir"),
    ]
    df = spark.createDataFrame(rows, "path string, link_target string")
    got = {r["path"]: r["cycle"] for r in links.detect_link_cycles(df, root="/data").collect()}
    assert got == {
        "s": "self", "a": "loop", "b": "loop", "to_ring": "loop", "d/up": "loop", "x/in": "loop", "y/in": "loop",
        "through": "loop", "z": "loop",
    }


MODES = [
    # (path, kind, mode, link, flags, want)
    ("f", "file", 0o104755, None, {}, 0o755),
    ("f", "file", 0o104755, None, {"archive": True}, 0o4755),
    ("f", "file", 0o600, None, {"no_perms": True}, 0o644),
    ("d", "dir", 0o700, None, {"no_perms": True}, 0o755),
    ("d", "dir", 0, None, {"source_os": "windows"}, 0o755),
    ("x.EXE", "file", 0, None, {"source_os": "windows"}, 0o755),
    ("x.txt", "file", 0, None, {"source_os": "windows"}, 0o644),
    ("sh", "file", 0, None, {"source_os": "windows"}, 0o644),
    ("l", "symlink", 0o777, "t", {}, 0),
]


def test_final_mode(spark):
    for path, kind, mode, link, flags, want in MODES:
        df = spark.createDataFrame([(path, kind, mode, link)], "path string, kind string, mode int, link_target string")
        assert links.final_mode(df, **flags).first()["mode"] == want


def test_classes_stay_inside_a_name_and_dots_count(spark):
    df = spark.createDataFrame([("a/x",), ("ab",), ("a.",), ("a",)], "path string")
    hit = {r["path"] for r in df.filter(globs.pattern_predicate("/a[!b]x", F.col("path"))).collect()}
    assert hit == set()
    got = {r["path"]: r["e"] for r in df.select("path", paths.extension(F.col("path")).alias("e")).collect()}
    assert got == {"a/x": None, "ab": None, "a.": "", "a": None}


def test_missing_source_hash_is_no_hash(spark):
    sent = spark.createDataFrame([("a", None), ("b", "x")], "path string, hash string")
    got = spark.createDataFrame([("a", "x"), ("b", "x")], "path string, hash string")
    skips = sent.limit(0).select("path")
    assert {r["path"]: r["status"] for r in reports.verify_report(sent, got, skips).collect()} == {"a": "no-hash", "b": "ok"}


def real_links(top):
    """A tree with real links, as rows of an inventory and what the operating system says about it."""
    import os

    root, out = top / "root", top / "out"
    for d in (root / "d" / "deep", root / "ring", out / "dir"):
        d.mkdir(parents=True)
    (root / "d" / "f").write_text("f")
    (root / "d" / "deep" / "g").write_text("g")
    (out / "dir" / "x").write_text("x")
    targets = {
        "d/l1": "l2", "d/l2": "../../out/dir/x", "d/l3": "l4", "d/l4": "../../out/gone", "dd": "d/deep", "through": "dd/g", "up": "dd/../f",
        "wrong": "dd/../../nothing", "ring/a": "b", "ring/b": "c", "ring/c": "a", "to_ring": "ring/a/x", "self": "self", "loop": "d/../loopdir", "loopdir": ".",
        "twice": "dd/../deep/../../dd/g", "outdir": str(out / "dir"), "back_in": str(out / "home"), "grow": "grow/x",
    }
    for i in range(45):
        targets[f"long{i}"] = f"long{i - 1}" if i else "d/f"
    for path, target in targets.items():
        os.symlink(target, root / path)
    os.symlink(root / "d", out / "home")
    os.symlink(out, out / "dir" / "up")
    entries, external = [], []
    for base, rows in ((root, entries), (out, external)):
        for here, dirs, files in os.walk(base):
            for name in dirs + files:
                path = os.path.join(here, name)
                kind = "symlink" if os.path.islink(path) else "dir" if os.path.isdir(path) else "file"
                rows.append((os.path.relpath(path, root) if rows is entries else path, kind, os.readlink(path) if kind == "symlink" else None))
    return root, entries, external


def test_final_targets_are_those_of_the_operating_system(spark, tmp_path):
    import os

    root, entries, external = real_links(tmp_path)
    shape = "path string, kind string, link_target string"
    tree, outside = spark.createDataFrame(entries, shape), spark.createDataFrame(external, shape)
    got = {r.path: r for r in links.classify_links(tree.filter("kind = 'symlink'"), outside, str(root), entries=tree).collect()}
    for path, row in got.items():
        here = os.path.join(root, path)
        kind = "dir" if os.path.isdir(here) else "file" if os.path.exists(here) else None
        assert row.target_kind == kind, path
        if kind:
            assert row.final == os.path.realpath(here), path
            inside = os.path.realpath(here).startswith(f"{root}/") or os.path.realpath(here) == str(root)
            assert row.link_class == ("internal" if inside else f"external-{kind}"), path
    assert got["d/l1"].link_class == "external-file" and got["d/l3"].link_class == "dangling-external" and got["back_in"].link_class == "internal"
    assert {p for p, r in got.items() if r.final is None} == {"ring/a", "ring/b", "ring/c", "to_ring", "self", "grow", *(f"long{i}" for i in range(40, 45))}
    followed = links.link_policy(spark.createDataFrame(list(got.values())), links.LinkPolicy(follow=True))
    assert {r.path for r in followed.collect() if r.outcome == "content"} == {p for p in got if os.path.exists(os.path.join(root, p))}


def test_rounds_are_logarithmic(spark, monkeypatch):
    rows = [(f"/r/l{i}", f"l{i - 1}" if i else "end") for i in range(300)]
    calls = []
    monkeypatch.setattr(link_targets, "checkpointed", lambda df, f=link_targets.checkpointed: (calls.append(1), f(df))[1])
    got = link_targets.final_targets(spark.createDataFrame(rows, "place string, link_target string"), max_hops=1000).collect()
    assert {r.place: (r.final, r.hops) for r in got} == {f"/r/l{i}": ("/r/end", i + 1) for i in range(300)}
    assert len(calls) <= 2 + 10  # the start, the scan, and ten rounds for 300 links


def test_followed_directories(spark, tmp_path):
    import os

    root, entries, external = real_links(tmp_path)
    shape = "path string, kind string, link_target string"
    rows = link_targets.followed_entries(spark.createDataFrame(entries, shape), spark.createDataFrame(external, shape), str(root)).collect()
    want = {}

    def walk(real, path, entered, through):
        for name in sorted(os.listdir(real)):
            here, at = os.path.join(real, name), f"{path}/{name}" if path else name
            link, place = os.path.islink(here), os.path.realpath(here)
            if not os.path.exists(here) or (link and place in entered):
                want[at] = (None, True, None)
            elif os.path.isdir(here):
                want[at] = ("dir", through or link, place)
                walk(place, at, entered | ({place} if link else set()), through or link)
            else:
                want[at] = ("file", through or link, place)

    walk(str(root), "", frozenset(), False)
    assert len(rows) == len(want) and {r.path: (r.kind, r.dereferenced, r.source if r.kind else None) for r in rows} == want
    assert all((r.kind is None) == (r.reason is not None) for r in rows)
