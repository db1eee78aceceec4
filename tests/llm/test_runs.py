"""Periodic runs against a plain search over all periods, and the edge cases of a table of texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sparksync.llm import runs as module
from sparksync.llm.queries import REGISTRY, table
from sparksync.llm.runs import LinkCut, find_runs, runs_of, stretches


def plain_runs(words, least, periods):
    """All maximal stretches by their smallest period, found by trying every period."""
    n, found = len(words), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            end = i + q
            if end - start >= max(least, periods * q) and not any(s <= start and end <= s + m and q % p == 0 for (s, m), p in found.items()):
                found[start, end - start] = q
    return sorted((s, m, q) for (s, m), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


words_of = st.one_of(
    st.lists(st.integers(0, 1), max_size=60),
    st.lists(st.integers(0, 3), max_size=80),
    st.tuples(st.lists(st.integers(0, 2), max_size=8), st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 9), st.lists(st.integers(0, 2), max_size=8)).map(
        lambda x: x[0] + x[1] * x[2] + x[3]
    ),
)


@settings(max_examples=400, deadline=None)
@given(words_of, st.sampled_from([(6, 4), (1, 2), (4, 3), (2, 2), (1, 4)]))
def test_automaton_finds_what_a_plain_search_finds(words, bounds):
    assert runs_of(words, *bounds) == plain_runs(words, *bounds)


@settings(max_examples=400, deadline=None)
@given(st.lists(words_of, max_size=5), st.sampled_from([(6, 4), (1, 2), (4, 3), (1, 3), (1, 4)]))
def test_stretches_lose_no_run(texts, bounds):
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts]).astype(np.int64)
    codes = np.array([w for t in texts for w in t], np.uint64)
    first, found = np.searchsorted(doc, np.arange(len(texts))), [[] for _ in texts]
    for a, b in zip(*stretches(codes, doc, *bounds), strict=True):
        assert doc[a] == doc[b - 1]
        found[doc[a]] += [(int(a - first[doc[a]]) + s, n, q) for s, n, q in runs_of(codes[a:b].tolist(), *bounds)]
    assert [sorted(f) for f in found] == [plain_runs(t, *bounds) for t in texts]


def test_link_cut_paths_carry_the_last_colour():
    rng = random.Random(3)
    parent = [0, 0] + [rng.randrange(1, i) for i in range(2, 300)]
    paths, plain = LinkCut(list(parent)), [-1] * 300
    for colour in range(2000):
        v = rng.randrange(1, 300)
        want, x = [], v
        while x:
            if plain[x] >= 0 and (not want or want[-1][0] != plain[x]):
                want.append((plain[x], x))
            plain[x], x = colour, parent[x]
        assert paths.recolour(v, colour) == want


ROWS = [
    (1, "a b " * 4 + "c"), (1, "a b " * 4 + "c"), (2, None), (3, ""), (4, " \t\n"), (5, "x x x x x"), (6, "x\tx x  x\nx x"),
    (7, "alpha beta gamma delta " * 40_000), (8, "ünï 漢 " * 5), (None, "z " * 6), (9, "\x00 \x00 \x00 \x00 \x00 \x00"),
]


@pytest.mark.parametrize("slice_bytes", [4 << 20, 1000])
def test_edges(spark, monkeypatch, slice_bytes):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").select("*", *[F.lit("own").alias(c) for c in ("word_runs", "runs", "start", "doc")])
    if slice_bytes == 1000:  # several pieces within one long text
        data = np.frombuffer(ROWS[7][1].encode()[:50_000], np.uint8)
        offsets, hasher = np.array([0, len(data)]), module.Hasher(seed=12, lower=False)
        whole = module.coded_words(data, offsets, hasher)
        monkeypatch.setattr(module, "SLICE_BYTES", 1000)
        pieces = module.coded_words(data, offsets, hasher)
        assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))
        return
    marked, out = find_runs(df)
    assert out == "_word_runs" and marked.columns == [*df.columns, out]
    rows = marked.collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted((str(a), str(b)) for a, b in ROWS)
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        want = [(0, 160_000, 4)] if r.doc_id == 7 else plain_runs(words, 6, 4)
        assert [tuple(x) for x in r[out].runs] == want and r[out].n_words == len(words)
        assert r[out].collapsed == collapsed(words, want)
    assert find_runs(df.limit(0))[0].collect() == []


def test_bounds_are_checked(spark):
    with pytest.raises(ValueError):
        find_runs(spark.createDataFrame(ROWS, "doc_id long, text string"), periods=1)


def test_query_against_a_plain_version(spark, sf):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    rows = REGISTRY["op12_periodic_runs"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    seen = 0
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        want = plain_runs(words, 6, 4)
        seen += len(want)
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in want))
        assert r.collapsed_sha256 == sha(collapsed(words, want))
    assert seen > 5
