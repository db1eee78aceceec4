"""Signatures and deltas against plain Python on small blobs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sparksync.operators import cache, delta, signatures
from sparksync.operators.rolling import gear_cuts, match_blocks, weak_sum, weak_sums


def noise(n, seed=0x12345678):
    return random.Random(seed).randbytes(n)


def blobs(spark, **kw):
    return spark.createDataFrame([(k, v) for k, v in kw.items()], "path string, content binary")


def naive_weak(data):
    s1 = s2 = 0
    for b in data:
        s1 += b
        s2 += s1
    return (s1 & 0xFFFF) | ((s2 & 0xFFFF) << 16)


def test_weak_sum():
    for n in (0, 1, 3, 700, 5000):
        assert weak_sum(noise(n)) == naive_weak(noise(n))
    assert weak_sum(b"\xff" * 40_000) == naive_weak(b"\xff" * 40_000)
    for data, block in ((noise(5000), 256), (b"\xff" * 100_000, 32_768), (b"", 700), (noise(700), 700), (noise(3), 8)):
        assert weak_sums(data, block) == [naive_weak(data[i : i + block]) for i in range(0, len(data), block)]


def test_auto_block_size(spark):
    from sparksync.functions.content import auto_block_size

    # Published block sizes of the square-root rule.
    want = {0: 700, 490_000: 700, 32 << 20: 5792, 256 << 20: 16384, 512 << 20: 23168, 1 << 30: 32768, 1 << 40: 32768}
    df = spark.createDataFrame([(k,) for k in want], "n long")
    assert {r["n"]: r["b"] for r in df.select("n", auto_block_size(F.col("n")).alias("b")).collect()} == want


def test_cdc_invariants(spark):
    data = noise(1_000_000)
    df = blobs(spark, a=data, b=data, same=b"z" * 300_000, empty=b"", tiny=b"abc")
    rows = signatures.cdc_chunks(df).orderBy("path", "idx").collect()
    by = {}
    for r in rows:
        by.setdefault(r["path"], []).append(r)
    for path, content in (("a", data), ("same", b"z" * 300_000), ("tiny", b"abc")):
        pos = 0
        for i, r in enumerate(by[path]):
            assert (r["idx"], r["offset"]) == (i, pos)
            piece = content[pos:pos + r["len"]]
            assert r["strong"] == hashlib.sha256(piece).hexdigest()
            assert r["len"] <= signatures.CDC_MAX
            assert r["len"] >= signatures.CDC_MIN or i == len(by[path]) - 1
            pos += r["len"]
        assert pos == len(content)
    assert [r["strong"] for r in by["a"]] == [r["strong"] for r in by["b"]]
    assert "empty" not in by
    assert 8_000 < len(data) / len(by["a"]) < 40_000


def test_cdc_resync_after_insert():
    data = noise(2_000_000)
    cuts = gear_cuts(data, 4096, 16384, 65536)
    edited = data[:700_000] + b"EDIT" + data[700_000:]
    moved = gear_cuts(edited, 4096, 16384, 65536)
    ends = {c for c in cuts if c <= 700_000} | {c + 4 for c in cuts if c > 700_000}
    assert len(ends - set(moved)) <= 4


def test_cdc_windows_do_not_matter(monkeypatch):
    from sparksync.operators import rolling

    data = noise(300_000)
    whole = gear_cuts(data, 256, 1024, 4096)
    monkeypatch.setattr(rolling, "SCAN_WINDOW", 10_007)
    assert gear_cuts(data, 256, 1024, 4096) == whole


def test_text_segments_tile(spark):
    text = "a bb  ccc d e f g h " * 30
    df = spark.createDataFrame([(1, text), (2, ""), (3, "one")], "doc_id long, text string")
    rows = signatures.text_cdc_segments(df, keep=["doc_id"]).orderBy("doc_id", "idx").collect()
    words = {d: sum(r["n_words"] for r in rows if r["doc_id"] == d) for d in (1, 2, 3)}
    assert words == {1: len(text.split(" ")), 2: 1, 3: 1}


EDITS = {
    "insert": lambda b: b[:1000] + b"INSERTED" + b[1000:],
    "overwrite": lambda b: b[:2000] + b"!" * 500 + b[2500:],
    "append": lambda b: b + b"tail" * 10,
    "delete": lambda b: b[:3000] + b[4000:],
    "different": lambda b: noise(len(b), 99),
    "identical": lambda b: b,
    "emptied": lambda b: b"",
}


def test_round_trip_all_edits(spark):
    base = noise(20_000)
    basis = {**{k: base for k in EDITS}, "from_empty": b""}
    source = {**{k: f(base) for k, f in EDITS.items()}, "from_empty": base, "new": base}
    src, dst = blobs(spark, **source), blobs(spark, **basis)
    for block in (256, None):
        ops = delta.delta_between(src, dst, block)
        heads = delta.delta_heads(src, dst)
        built = {r["path"]: bytes(r["content"]) for r in delta.apply_patch(dst, ops, heads).collect()}
        assert built == source
        assert delta.verify_reconstruction(delta.apply_patch(dst, ops, heads), heads).isEmpty()
        assert delta.validate_ops(ops, delta.delta_heads(src, dst)).isEmpty()
        stats = {r["path"]: r for r in delta.delta_stats(ops).collect()}
        for path, r in stats.items():
            assert r["bytes_matched"] + r["bytes_literal"] == len(source[path])
        assert stats["identical"]["bytes_literal"] == 0
    # At any offset, an edit costs about one block, not the tail.
    assert stats["insert"]["bytes_literal"] < 1500
    assert stats["delete"]["bytes_literal"] < 1500
    assert stats["identical"]["ops"] == 1


def naive_match(source, blocks, block):
    """Leftmost-greedy matching by direct comparison of bytes."""
    full = {c: o for o, c in blocks if len(c) == block}
    hits, pos = [], 0
    while pos + block <= len(source):
        found = full.get(source[pos:pos + block])
        if found is None:
            pos += 1
        else:
            hits.append((pos, block, found))
            pos += block
    end = hits[-1][0] + block if hits else 0
    rest, last = source[end:], blocks[-1][1]
    if 0 < len(rest) < block and len(rest) == len(last):
        off = {c: o for o, c in blocks}.get(rest)
        if off is not None:
            hits.append((end, len(rest), off))
    return hits


@pytest.mark.parametrize("seed", range(12))
def test_sliding_match_brute_force(seed, monkeypatch):
    import numpy as np

    from sparksync.operators import rolling

    rnd = random.Random(seed)
    monkeypatch.setattr(rolling, "SCAN_WINDOW", rnd.choice([50, 300, 4 << 20]))
    alphabet = rnd.choice([b"ab", b"abcdefgh", bytes(range(256))])
    basis = bytes(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 600)))
    source = basis
    for _ in range(rnd.randrange(4)):
        at = rnd.randrange(len(source) + 1)
        source = source[:at] + bytes(rnd.choice(alphabet) for _ in range(rnd.randrange(9))) + source[at + rnd.randrange(5):]
    block = rnd.choice([4, 16, 50])
    blocks = [(i, basis[i:i + block]) for i in range(0, len(basis), block)]
    got = match_blocks(
        source,
        np.array([weak_sum(c) for _, c in blocks]),
        np.array([hashlib.sha256(c).hexdigest() for _, c in blocks], dtype=object),
        np.array([o for o, _ in blocks]),
        np.array([len(c) for _, c in blocks]),
    )
    assert got == naive_match(source, blocks, len(blocks[0][1]))


def test_equal_blocks_have_no_candidate_limit(spark):
    data = b"\0" * 200_000
    src, dst = blobs(spark, a=data + b"x"), blobs(spark, a=data)
    ops = delta.sliding_match(src, dst).collect()
    assert sum(r["len"] for r in ops if r["op"] == "literal") <= 700


def test_coalesce_and_validate(spark):
    rows = [("p", 0, "copy", 0, 10, 0), ("p", 1, "copy", 10, 10, 10), ("p", 2, "copy", 20, 10, 40),
            ("p", 3, "literal", 30, 5, None), ("p", 4, "literal", 35, 5, None), ("p", 5, "copy", 40, 10, 0)]
    ops = spark.createDataFrame(rows, "path string, idx int, op string, source_offset long, len long, basis_offset long")
    merged = delta.coalesce_ops(ops)
    got = [(r["op"], r["source_offset"], r["len"], r["basis_offset"]) for r in merged.orderBy("op_idx").collect()]
    assert got == [("copy", 0, 20, 0), ("copy", 20, 10, 40), ("literal", 30, 10, None), ("copy", 40, 10, 0)]
    heads = spark.createDataFrame([("p", 50, 45, "h")], "path string, source_size long, basis_size long, checksum string")
    assert [r["op_idx"] for r in delta.validate_ops(merged, heads).collect()] == [1]


def test_signature_cache(spark):
    def rows(*items):
        return spark.createDataFrame(
            [(p, len(c), s, 0, c) for p, c, s in items],
            "path string, size long, mtime_sec long, mtime_nsec int, content binary",
        )

    big = noise(20_000)
    middle = big[:10_000] + b"!" + big[10_001:]
    old = rows(("same", big, 1), ("time", big, 1), ("head", big, 1), ("middle", big, 1))
    new = rows(("same", big, 1), ("time", big, 2), ("head", b"!" + big[1:], 1), ("middle", middle, 1), ("new", big, 1))
    stored = cache.signature_cache_entries(old, signatures.fixed_block_signature(old), "fixed")
    hits, misses = cache.signature_cache(new, stored, "fixed")
    # A change anywhere is a miss, also one that keeps size and time.
    assert {r["path"] for r in hits.collect()} == {"same"}
    assert {r["path"] for r in misses.collect()} == {"time", "head", "middle", "new"}
    assert cache.signature_cache(new, stored, "cdc")[0].isEmpty()


def test_fallback(spark):
    stats = spark.createDataFrame([("a", 10, 90), ("b", 80, 20)], "path string, bytes_matched long, bytes_literal long")
    heads = spark.createDataFrame(
        [("a", 100, 50), ("b", 100, 50), ("c", 100, 0)], "path string, source_size long, basis_size long"
    )
    get = lambda **kw: {r["path"]: r["fallback_reason"] for r in delta.delta_fallback(stats, heads, **kw).collect()}
    assert get() == {"a": None, "b": None, "c": "empty-basis"}
    assert get(budget=50) == {"a": "literal-budget", "b": None, "c": "empty-basis"}
    assert get(cross_basis=True)["a"] == "dissimilar"


def test_emptied_and_new_empty_files_come_back(spark):
    cols = "path string, content binary, hash string"
    source = spark.createDataFrame([("emptied", b"", "e"), ("kept", b"abc" * 900, "k"), ("new", b"", "e")], cols)
    basis = spark.createDataFrame([("emptied", b"x" * 2000, "x"), ("kept", b"abc" * 800, "y"), ("new", b"", "z")], cols)
    for block in (64, None):
        ops = delta.delta_between(source, basis, block) if block else delta.delta_between(source, basis)
        built = {r["path"]: bytes(r["content"]) for r in delta.apply_patch(basis, ops, heads=source).collect()}
        assert built == {"emptied": b"", "kept": b"abc" * 900, "new": b""}


def test_blobs_do_not_go_to_python_beside_their_blocks(spark):
    blobs = spark.createDataFrame([("a", noise(5_000))], "path string, content binary")
    signed = signatures.fixed_block_signature(blobs, block=512, weak=True)
    for columns in (["path", "weak"], ["path", "idx", "strong", "weak"]):
        plan = signed.select(*columns)._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Generate") < plan.index("ArrowEvalPython")
