"""Whitening against a dense eigensolver in exact integers, planted spectra, and the edge cases of a table of vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparksync.llm.queries import REGISTRY, table
from sparksync.llm.whitening import Inertia, components, feast, whiten


def with_spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values)) @ q.T


SPECTRA = {
    "spread": np.linspace(1, 30, 40),
    "steep": 10.0 ** -np.arange(0, 12, 0.5),
    "one dominates": [1e6] + [1.0 + i / 100 for i in range(30)],
    "equal pairs": np.repeat(np.arange(1.0, 13), 2),
    "all equal": np.full(20, 3.0),
    "large cluster at the edge": np.concatenate([np.full(20, 2.0), np.arange(3.0, 13)]),
    "low rank": np.concatenate([np.zeros(30), [1, 2, 5]]),
    "small": [0.5, 4.0],
    "one": [2.0],
    "tiny unit": np.linspace(1e-9, 4e-9, 18),
}


@pytest.mark.parametrize("kind", SPECTRA)
def test_components_of_planted_spectra(kind):
    v = with_spectrum(SPECTRA[kind])
    v = (v + v.T) / 2
    want = np.sort(SPECTRA[kind])[::-1]
    want = want[want > 1e-12 * want[0]][:16]
    e, x = components(v, 16)
    assert np.allclose(e, want, rtol=1e-9, atol=1e-14 * want[0])
    assert np.allclose(x.T @ x, np.eye(len(e)), atol=1e-12)
    assert np.abs(v @ x - x * e).max() < 1e-13 * want[0]


def test_inertia_counts_and_feast_agree_with_a_dense_solver():
    v = with_spectrum(np.arange(1.0, 31), seed=4)
    inertia = Inertia(v)
    assert [inertia.above(s) for s in (0.5, 10.5, 29.5, 31)] == [30, 20, 1, 0]
    assert math.isclose(inertia.value(3, 1e-12), 28, rel_tol=1e-10)
    e, x = feast(v, 7.5, 13.5, 6)
    assert np.allclose(e, [8, 9, 10, 11, 12, 13], rtol=1e-12)
    with pytest.raises(ArithmeticError):
        feast(v, 7.5, 13.5, 5)


def test_nothing_varies():
    e, x = components(np.zeros((4, 4)), 16)
    assert len(e) == 0 and x.shape == (4, 0)


def plain(vectors, most=16):
    """Rows by exact integers and numpy's own eigensolver: {(id, component): (deviation, |whitened|, explained)}."""
    xs = {k: [math.floor(64 * float(c)) + 1_000_000 for c in v] for k, v in vectors.items()}
    fit = sorted(set(map(tuple, xs.values())))
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array([[n * c - t for c, t in zip(x, total)] for x in fit], object)
    v = (a.T @ a).astype(float) / float(n) ** 3
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    out = {}
    for k, x in xs.items():
        d = [n * c - t for c, t in zip(x, total)]
        z = np.array([c / n for c in d]) @ q
        for j in range(min(most, int((e > 1e-12 * e[0]).sum()))):
            out[k, j + 1] = (sum(c * c for c in d), z[j] / math.sqrt(e[j]), e[j] / e.sum())
    return n, out


def check(rows, n, want):
    assert sorted((r.vec_id, r.component) for r in rows) == sorted(want)
    sign = {}
    for r in rows:
        deviation, whitened, explained = want[r.vec_id, r.component]
        s = sign.setdefault(r.component, math.copysign(1, r.whitened * whitened)) if abs(whitened) > 1e-3 else sign.get(r.component)
        assert (r.n, r.deviation) == (n, deviation)
        assert math.isclose(r.explained, explained, rel_tol=1e-9)
        assert s is None or math.isclose(r.whitened, s * whitened, rel_tol=1e-7, abs_tol=1e-8)
        assert 0 <= r.identity_error < 1e-9


def test_query_against_exact_integers(spark, sf):
    vectors = {r.vec_id: r.embedding for r in table(spark, sf, "embeddings").collect()}
    rows = REGISTRY["op13_embedding_whitening"](spark, sf).collect()
    assert len(rows) == 16 * len(vectors) and len({r.identity_error for r in rows}) == 1
    check(rows, *plain(vectors))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = {1: [1.0, 0.5, 0.0], 2: [1.0, 0.5, 0.0], 3: [-1.0, 2.0, 1e-9], 4: [0.25, 0.0, 0.0], 5: [3.0, 1.0, 0.0], 6: [0.2501, 0.0, 0.0]}
    bad = [(7, None), (8, []), (9, [nan, 0.0, 0.0]), (10, [inf, 0.0, 0.0]), (11, [None, 1.0, 1.0]), (12, [1.0, 2.0])]
    df = spark.createDataFrame([*good.items(), *bad], "vec_id long, embedding array<float>").withColumn("x", F.lit(1)).withColumn("component", F.lit("own"))
    n, want = plain({k: np.float32(v) for k, v in good.items()})
    assert n == 4
    check(whiten(df).collect(), n, want)
    assert whiten(df.limit(0)).collect() == []
    assert whiten(df.filter("vec_id in (1, 2, 7)")).collect() == []
    twice = whiten(df.union(df)).collect()
    assert len(twice) == 2 * len(want) and {r.n for r in twice} == {4}
    alone = spark.createDataFrame([(None, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert sorted((str(r.vec_id), abs(round(r.whitened, 9))) for r in whiten(alone).collect()) == [("1", 1.0), ("None", 1.0)]


def test_values_beyond_a_long_are_held(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    rows = whiten(df).collect()
    assert {r.vec_id for r in rows if r.deviation is None} == {1, 2} and all(math.isfinite(r.whitened) for r in rows)
