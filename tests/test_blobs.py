"""Blobs in pieces: the same cuts, matches and rebuilt bytes as of the blob in one row."""

import random

import pytest
from pyspark.sql import functions as F

from sparksync.operators import blobs, delta, signatures
from sparksync.operators.rolling import cut_places, cut_places_of_many, gear_cuts

SIZE = 4096


def noise(n, seed=7):
    return random.Random(seed).randbytes(n)


def table(spark, **contents):
    return spark.createDataFrame(list(contents.items()), "path string, content binary")


BASE = noise(100_000)
CASES = {
    "noise": BASE, "edited": BASE[:30_000] + b"EDIT" + BASE[30_001:70_000] + BASE[71_000:], "zeros": b"\0" * 50_001, "empty": b"", "tiny": b"abc",
    "exact": BASE[: 3 * SIZE], "periodic": b"abcdefg" * 5000, "short": BASE[: SIZE - 1], "moved": BASE[50_000:] + BASE[:50_000],
}


def test_pieces_tile_and_come_back(spark):
    pieces = blobs.to_pieces(table(spark, **CASES), size=SIZE).cache()
    assert {r.path: bytes(r.content) for r in blobs.from_pieces(pieces).collect()} == CASES
    for r in pieces.collect():
        assert r.offset == r.seq * SIZE and bytes(r.bytes) == CASES[r.path][r.offset : r.offset + SIZE]


@pytest.mark.parametrize("bounds", [(64, 256, 1024), (256, 1024, 4096)])
def test_chunks_equal_those_of_one_row(spark, bounds):
    df = table(spark, **CASES)
    whole = signatures.cdc_chunks(df, "content", *bounds).select("path", "idx", "offset", "len", "strong")
    parts = blobs.cdc_chunks_of_pieces(blobs.to_pieces(df, size=SIZE), *bounds, size=SIZE)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))
    assert [r.offset + r.len for r in parts.filter("path = 'noise'").orderBy("idx").collect()] == gear_cuts(BASE, *bounds)


def test_one_blob_is_cut_by_many_tasks(spark):
    pieces = blobs.to_pieces(table(spark, big=noise(400_000)), size=SIZE).repartition(16, "path", "seq")
    busy = pieces.select(F.spark_partition_id().alias("p")).distinct().count()
    assert busy > 8
    with pytest.raises(ValueError):
        blobs.cdc_chunks_of_pieces(pieces, 64, 256, SIZE + 1, size=SIZE)


def source_and_basis(spark):
    basis = {"edited": BASE, "zeros": b"\0" * 40_000, "periodic": b"abcdefg" * 4000 + b"xy", "moved": BASE, "noise": noise(100_000, 8), "tiny": b"abc", "exact": BASE[:SIZE], "short": b"", "empty": BASE}
    return table(spark, **CASES), table(spark, **basis)


@pytest.mark.parametrize("block", [None, 300])
def test_matches_equal_those_of_one_row(spark, block):
    source, basis = source_and_basis(spark)
    signed = signatures.fixed_block_signature(basis, block=block, weak=True)
    found = blobs.sliding_ops(blobs.to_pieces(source, size=SIZE), signed, longest=SIZE).filter("len > 0")
    whole = delta.sliding_match(source, basis.filter(F.octet_length("content") > 0), block).select(*found.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))


def test_patched_pieces(spark):
    source, basis = source_and_basis(spark)
    before, after = blobs.to_pieces(basis, size=SIZE), blobs.to_pieces(source, size=SIZE)
    ops = blobs.sliding_ops(after, signatures.fixed_block_signature(basis, weak=True), longest=SIZE)
    fresh = delta.whole_literals(source.join(ops.select("path"), "path", "left_anti"))
    full = blobs.literal_pieces(ops, after, SIZE).unionByName(fresh.select("path", "op_idx", "op", "source_offset", "len", "basis_offset", "literal"))
    heads = delta.delta_heads(source, basis)
    built = blobs.patch_pieces(before, full, heads, SIZE)
    assert {r.path: bytes(r.content) for r in blobs.from_pieces(built).collect()} == CASES
    assert {(r.path, r.seq) for r in built.collect()} == {(r.path, r.seq) for r in after.collect()}
    for lost in (full.filter("op_idx <> 1"), full.filter("op <> 'literal'")):
        with pytest.raises(Exception, match="missing"):
            blobs.patch_pieces(before, lost, heads, SIZE).collect()
    assert blobs.patch_pieces(before, full.limit(0), heads.limit(0), SIZE).collect() == []


def test_many_strings_are_cut_as_each_alone():
    rng = random.Random(3)
    parts = [rng.randbytes(rng.choice([0, 1, 62, 63, 64, 700, 5000])) for _ in range(60)]
    skips = [min(len(p), rng.choice([0, 0, 63])) for p in parts]
    for (hard, easy), part, skip in zip(cut_places_of_many(parts, skips, 256), parts, skips, strict=True):
        one = cut_places(part, 256, skip)
        assert hard.tolist() == one[0].tolist() and easy.tolist() == one[1].tolist()


def test_a_path_costs_no_python_call_of_its_own(spark, capsys):
    source, basis = source_and_basis(spark)
    pieces = blobs.to_pieces(source, size=SIZE)
    ops = blobs.sliding_ops(pieces, signatures.fixed_block_signature(basis, weak=True), longest=SIZE)
    for made in (blobs.cut_spans(pieces, 64, 256, 1024), ops):
        made.explain()
        assert "FlatMapGroupsIn" not in capsys.readouterr().out
    # Literals get their bytes in one pass over the ops.
    blobs.literal_pieces(ops, pieces, SIZE).explain()
    assert "Union" not in capsys.readouterr().out
