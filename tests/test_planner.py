"""Decision cases on literal manifests, expected actions written by hand."""

import pytest

from sparksync.plans import deletes, diff, pairing
from sparksync.plans.planner import assign_hardlinks, plan_sync

SCHEMA = (
    "path string, kind string, size long, mode int, mtime_sec long, mtime_nsec int, hash string, "
    "link_target string, inode long, rdev long"
)


def entry(path, size=10, sec=100, nsec=0, mode=0o644, kind="file", hash=None, link=None, inode=None, rdev=None):
    return (path, kind, size, mode, sec, nsec, hash, link, inode, rdev)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def actions(spark, src, dst, **kw):
    plan = plan_sync(frame(spark, *src), frame(spark, *dst), **kw)
    return {r["path"]: r["action"] for r in plan.collect()}


def one(spark, s, d, **kw):
    return actions(spark, [s], [d], **kw)["a"]


CASES = [
    # (source, destination, flags, action)
    (entry("a"), entry("a"), {}, "skip"),
    (entry("a"), entry("a", size=11), {}, "update"),
    (entry("a"), entry("a", sec=99), {}, "update"),
    (entry("a"), entry("a", nsec=1), {}, "update"),
    (entry("a"), entry("a", mode=0o600), {}, "meta"),
    (entry("a"), entry("a", mode=0o100644), {}, "skip"),
    (entry("a"), entry("a", mode=0o600), {"perms": False}, "skip"),
    (entry("a", kind="dir"), entry("a", kind="dir", sec=1, mode=0o700), {}, "skip"),
    (entry("a"), entry("a", kind="dir"), {}, "update"),
    (entry("a", kind="dir"), entry("a"), {}, "update"),
    (entry("a"), entry("a", kind="dir"), {"ignore_existing": True}, "update"),
    (entry("a"), entry("a", size=99), {"ignore_existing": True}, "skip"),
    (entry("a"), entry("a", mode=0o600), {"ignore_existing": True}, "skip"),
    (entry("a"), entry("a", kind="symlink", link="x"), {"ignore_existing": True}, "skip"),
    # update-only compares whole seconds
    (entry("a"), entry("a", size=99, sec=101), {"update_only": True}, "skip"),
    (entry("a"), entry("a", size=99, nsec=5), {"update_only": True}, "update"),
    (entry("a"), entry("a", sec=101, mode=0o600), {"update_only": True}, "skip"),
    (entry("a"), entry("a"), {"ignore_times": True}, "update"),
    (entry("a"), entry("a", sec=101), {"ignore_times": True, "update_only": True}, "skip"),
    # checksum
    (entry("a", hash="h"), entry("a", hash="h", sec=5), {"checksum": True}, "meta"),
    (entry("a", hash="h"), entry("a", hash="h", sec=5), {"checksum": True, "times": False}, "skip"),
    (entry("a", hash="h"), entry("a", hash="g"), {"checksum": True}, "update"),
    (entry("a", hash="h"), entry("a"), {"checksum": True}, "update"),
    (entry("a"), entry("a"), {"checksum": True}, "update"),
    (entry("a"), entry("a", sec=5), {"size_only": True, "times": False}, "skip"),
    (entry("a"), entry("a", size=11), {"size_only": True}, "update"),
    # links
    (entry("a", kind="symlink", link="t"), entry("a", kind="symlink", link="t"), {}, "skip"),
    (entry("a", kind="symlink", link="t"), entry("a", kind="symlink", link="u"), {}, "update"),
    (entry("a", kind="symlink", link="t"), entry("a", kind="symlink", link="t", sec=9), {}, "update"),
    (entry("a", kind="symlink", link="t"), entry("a", kind="symlink", link="t", sec=9), {"size_only": True}, "skip"),
    (entry("a", kind="symlink", link="t"), entry("a", kind="symlink", link="t", sec=9), {"checksum": True}, "skip"),
    (entry("a", kind="symlink", link="t"), entry("a"), {}, "update"),
    (entry("a"), entry("a", kind="symlink", link="t", sec=900), {"update_only": True}, "update"),
    # specials
    (entry("a", kind="fifo"), entry("a", kind="fifo", mode=0), {}, "skip"),
    (entry("a", kind="fifo"), entry("a", kind="socket"), {}, "update"),
    (entry("a", kind="char", rdev=1), entry("a", kind="char", rdev=2), {}, "update"),
    (entry("a", kind="char", rdev=1), entry("a", kind="char", rdev=1, nsec=7), {}, "skip"),
    (entry("a", kind="fifo"), entry("a"), {}, "update"),
]


def test_decision_cases(spark):
    """Cases that share flags run as one plan, each under its own path."""
    by_flags = {}
    for i, (s, d, flags, want) in enumerate(CASES):
        by_flags.setdefault(tuple(sorted(flags.items())), []).append((f"p{i}", s, d, want))
    for flags, cases in by_flags.items():
        src = [(name, *s[1:]) for name, s, _, _ in cases]
        dst = [(name, *d[1:]) for name, _, d, _ in cases]
        got = actions(spark, src, dst, **dict(flags))
        assert got == {name: want for name, _, _, want in cases}, flags


def test_create_and_existing(spark):
    src = [entry("d", kind="dir"), entry("d/f")]
    assert actions(spark, src, []) == {"d": "create", "d/f": "create"}
    assert actions(spark, src, [], existing=True) == {"d": "create", "d/f": "skip"}


def test_delete_scope(spark):
    dst = [entry(p) for p in ("lake/raw/a", "lake/raw/x/b", "lake/rawer/c", "lake/one", "lake/one.bak", "else")]
    scoped = actions(spark, [], dst, delete=True, delete_scope=["lake\\raw", "lake/one"])
    assert set(scoped) == {"lake/raw/a", "lake/raw/x/b", "lake/one"}
    assert len(actions(spark, [], dst, delete=True)) == 6
    assert actions(spark, [], dst) == {}


def test_protect_from_delete(spark):
    paths = ["mnt", "mnt/f", "p/q/r/s", "mnt2", "p/qr", "k/l", "hidden/x"]
    gone = spark.createDataFrame([(p, "file") for p in paths], "path string, kind string")
    skipped = spark.createDataFrame([("mnt",), ("p/q",), ("k/l/m",)], "path string")
    left = lambda **kw: {
        r["path"] for r in deletes.protect_from_delete(gone, skipped, excludes=["hidden"], **kw).collect()
    }
    assert left() == {"mnt2", "p/qr", "k/l", "hidden/x"}
    assert left(protect_subtrees=True) == {"mnt2", "p/qr", "k/l"}


def test_delete_guard(spark):
    gone = spark.createDataFrame([("a", "file"), ("b", "file")], "path string, kind string")
    deletes.max_delete_guard(gone, 2)
    with pytest.raises(deletes.DeleteLimitExceeded):
        deletes.max_delete_guard(gone, 1)


def test_delete_order_children_first(spark):
    rows = [("d", "dir"), ("d/e", "dir"), ("d/e/f", "file"), ("z", "file"), ("d/a", "dir")]
    order = deletes.delete_order(spark.createDataFrame(rows, "path string, kind string"))
    assert [r["path"] for r in order.collect()] == ["d/e/f", "z", "d/e", "d/a", "d"]


def test_prune_empty_dirs(spark):
    rows = [("a", "dir"), ("a/b", "dir"), ("a/b/f", "file"), ("a/e", "dir"), ("c", "dir"), ("c/g", "file")]
    dst = spark.createDataFrame(rows, "path string, kind string")
    gone = dst.filter("kind = 'file'")
    # a/e is empty but was not on the way to a deleted file, so it keeps a.
    assert {r["path"] for r in deletes.prune_empty_dirs(dst, gone).collect()} == {"a/b", "c"}


def links_of(spark, src, dst, **kw):
    plan = assign_hardlinks(frame(spark, *src), frame(spark, *dst), **kw)
    return {r["path"]: r["link_to"] for r in plan.collect()}


def test_hardlinks(spark):
    pair = [entry("a", inode=7), entry("b", inode=7)]
    assert links_of(spark, pair, []) == {"a": None, "b": "a"}
    # An in-sync member is the representative even when it sorts last.
    assert links_of(spark, pair, [entry("b")]) == {"a": "b", "b": None}
    # A divergent destination that a flag protects is no representative.
    assert links_of(spark, pair, [entry("b", size=5)], ignore_existing=True) == {"a": None, "b": None}
    assert links_of(spark, pair, [entry("a", size=5), entry("b", size=5)]) == {"a": None, "b": "a"}
    # A metadata fix still holds the content.
    assert links_of(spark, pair, [entry("a", mode=0o600)]) == {"a": None, "b": "a"}
    mixed = [entry("a", inode=7, kind="dir"), entry("b", inode=7), entry("c")]
    assert links_of(spark, mixed, []) == {"a": None, "b": None, "c": None}


def test_cross_basis_pairs(spark):
    def pairs(rows, min_size=1_000_000):
        plan = spark.createDataFrame(
            [(p, "file", a, s) for p, a, s in rows], "path string, kind string, action string, source_size long"
        )
        return {r["path"]: r["basis_path"] for r in pairing.cross_basis_pairs(plan, min_size).collect()}

    assert pairs([("v/disk.img", "create", 4_000_000), ("v/disk.old.img", "create", 3_000_000)]) == {
        "v/disk.old.img": "v/disk.img"
    }
    # Here the longer name comes first in the plan, so the shorter one finds it.
    assert pairs([("v/disk-a.img", "create", 4_000_000), ("v/disk.img", "create", 3_000_000)]) == {
        "v/disk.img": "v/disk-a.img"
    }
    assert pairs([("v/disk.img", "create", 4_000_000), ("w/disk.old.img", "create", 4_000_000)]) == {}
    assert pairs([("v/disk.img", "create", 4_000_000), ("v/disk.old.vhd", "create", 4_000_000)]) == {}
    assert pairs([("v/disk-a.img", "create", 8_000_001), ("v/disk.img", "create", 4_000_000)]) == {}
    # Creates come before updates; the closest size wins.
    rows = [("v/n.img", "create", 5_000_000), ("v/n2.img", "create", 5_900_000), ("v/n23.img", "update", 6_000_000)]
    assert pairs(rows)["v/n23.img"] == "v/n2.img"
    # A file too small to be a basis is no candidate.
    small = lambda n: pairs([("v/disk-a.img", "create", n), ("v/disk.img", "create", 2_000)], 2_000)
    assert small(1_000) == {"v/disk.img": "v/disk-a.img"}
    assert small(999) == {}


def test_table_diff_and_reprobe(spark):
    a = spark.createDataFrame([(1, 1, None), (2, 2, "x"), (3, 3, "y")], "k int, v int, w string")
    b = spark.createDataFrame([(1, 1, None), (2, 5, None), (4, 4, "z")], "k int, v int, w string")
    got = {r["k"]: (r["action"], r["changed"]) for r in diff.table_diff(a, b, ["k"], ["v", "w"]).collect()}
    assert got == {1: ("skip", []), 2: ("update", ["v", "w"]), 3: ("create", []), 4: ("delete", [])}
    left = diff.reprobe_after_apply(frame(spark, entry("a"), entry("b")), frame(spark, entry("a"), entry("b", nsec=1)))
    assert [r["path"] for r in left.collect()] == ["b"]


def test_plan_reads_no_content(spark, sf):
    from sparksync.sources.samples import dst_manifest, src_manifest

    plan = plan_sync(src_manifest(spark, sf), dst_manifest(spark, sf), delete=True)
    optimized = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in optimized
    join = [line for line in optimized.splitlines() if "Join FullOuter" in line]
    assert join
