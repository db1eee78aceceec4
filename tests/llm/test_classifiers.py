"""Both classifiers, score by score, against plain versions on small tables."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa

from sparksync.llm import quality, toxicity
from sparksync.llm.labelled import fit_logistic
from sparksync.llm.queries import REGISTRY, table
from sparksync.llm.text import WHITE, Hasher, Words, slices

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
ALNUM = r"0-9A-Za-z\x80-\U0010ffff"


def sample_of(spark, sf, label):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    marks = {r.doc_id: r[label] for r in table(spark, sf, "labels").collect() if r[label] is not None}
    train = [(texts[k], y) for k, y in marks.items() if k in texts and zlib.crc32(str(k).encode()) % 5]
    return texts, train


def buckets_of(words, n, lower):
    """The hash bucket of each different word, hashed one by one."""
    out, hasher = {}, Hasher(lower=lower)
    for w in words:
        (s,) = slices(iter([pa.record_batch({"text": pa.array([w])})]), "text")
        out[w] = int(hasher.words(s.data, Words(s.data, s.offsets, WHITE))[0] % np.uint64(n))
    return out


def near(a, b):
    """At most one letter more, less or other."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def plain_lexicon(train):
    counts, size = {0: collections.Counter(), 1: collections.Counter()}, collections.Counter()
    for text, y in set(train):
        size[y] += 1
        words = set(re.findall(f"[{ALNUM}@$*]+", text.translate(LOWER)))
        stems = {w[:n] for w in words for n in (*range(4, 13), 18, 27, 40, 60) if n <= len(w)}
        counts[y].update({(w, True) for w in words if len(w) <= 60} | {(w, False) for w in stems})
    passed = {
        t: n for t, n in counts[1].items() if n >= 6 and (n + 0.5) / size[1] / ((counts[0][t] + 0.5) / size[0]) >= 30
    }
    chosen = []
    for term in sorted(passed, key=lambda t: (-passed[t], not t[1], -len(t[0]), t[0].encode())):
        text, whole = term
        implied = any(not w and text.startswith(c) for c, w in chosen)
        covered = sum(passed[c] for c in chosen if c[0].startswith(text))
        if not implied and (whole or covered < 0.9 * passed[term]):
            chosen.append(term)
    return chosen


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"  # the smallest tables have too few toxic texts for a lexicon
    texts, train = sample_of(spark, sf, "toxic")
    assert all(t.isascii() or not re.search("[฀-ჿ぀-鿿]", t) for t in texts.values())
    lexicon = plain_lexicon(train)
    assert lexicon
    whole, stems = {t for t, w in lexicon if w}, [t for t, w in lexicon if not w]
    kinds = {}

    def kind(word):
        if word not in kinds:
            exact = word in whole or any(word.startswith(t) for t in stems)
            kinds[word] = 1 if exact else 2 if any(len(t) >= 5 and near(word, t) for t in whole) else 0
        return kinds[word]

    def matches(text):
        words = [(m.group().translate(LOWER), m.start(), m.end()) for m in re.finditer(f"[{ALNUM}@$*]+", text)]
        for i, (word, a, b) in enumerate(words):
            if kind(word):
                around = [w for j, (w, _, _) in enumerate(words) if j != i and abs(j - i) <= 6]
                yield kind(word), around, a > 0 and text[a - 1] in "\"'`" and text[b : b + 1] in tuple("\"'`")

    found = {t: list(matches(t)) for t in {*texts.values(), *(t for t, _ in train)}}
    bucket = buckets_of({w for ms in found.values() for _, around, _ in ms for w in around}, toxicity.CONTEXT_BUCKETS, True)
    seen = {0: collections.Counter(), 1: collections.Counter()}
    for text, y in train:
        for _, around, _ in found[text]:
            seen[y].update(bucket[w] for w in around)
    total = {y: sum(seen[y].values()) + toxicity.CONTEXT_BUCKETS for y in seen}
    weight = lambda w: math.log((seen[1][bucket[w]] + 1) / (seen[0][bucket[w]] + 1)) - math.log(total[1] / total[0])

    def features(text):
        ms = found[text]
        scores = [sum(map(weight, around)) / max(len(around), 1) for _, around, _ in ms]
        n = [sum(k == 1 for k, _, _ in ms), sum(k == 2 for k, _, _ in ms), sum(q for _, _, q in ms)]
        return [float(bool(ms)), *map(math.log1p, n), sum(scores) / max(len(ms), 1), max(scores, default=0.0)]

    w = fit_logistic(np.array([features(t) for t, _ in train]), np.array([float(y) for _, y in train]))
    got = REGISTRY["op8_toxicity"](spark, sf).collect()
    assert len(got) == len(texts)
    n_of = lambda k, t: sum(m[0] == k for m in found[t])
    assert {r.doc_id: (r.n_exact, r.n_misspelled) for r in got} == {k: (n_of(1, t), n_of(2, t)) for k, t in texts.items()}
    for r in got:
        x = features(texts[r.doc_id])
        want = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip([*x, 1.0], w))))))
        assert math.isclose(r.score, want, abs_tol=1e-6), r.doc_id
        assert r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quality(spark, sf):
    texts, train = sample_of(spark, sf, "quality")
    tokens = {t: re.findall(f"[{ALNUM}]+|[^{ALNUM}\\s\x1c-\x1f]+|[\x1c-\x1f]+", t) for t in {*texts.values(), *(t for t, _ in train)}}
    bucket = buckets_of({w for ws in tokens.values() for w in ws}, quality.BUCKETS, False)
    place, sign = quality.index_vectors()
    vectors = collections.defaultdict(lambda: np.zeros(quality.DIM))
    for text in texts.values():
        row = [bucket[w] for w in tokens[text]]
        for i, b in enumerate(row):
            for c in row[max(0, i - 2) : i] + row[i + 1 : i + 3]:
                for j in range(quality.NONZERO):
                    vectors[b][place[c, j]] += sign[c, j]
    unit = {b: (v / max(math.sqrt((v**2).sum()), 1e-12)).astype(np.float32) for b, v in vectors.items()}

    def pooled(text):
        row = [bucket[w] for w in tokens[text]]
        vs = [unit.get(b, np.zeros(quality.DIM)).astype(float) for b in row] or [np.zeros(quality.DIM)]
        mean = sum(vs) / len(vs)
        spread = np.sqrt(np.maximum(sum(v * v for v in vs) / len(vs) - mean**2, 0))
        return [*mean, *spread, len(set(row)) / max(len(row), 1), math.log1p(len(row))]

    x, y = np.array([pooled(t) for t, _ in train]), np.array([float(y) for _, y in train])
    order = np.lexsort((y, *x.T))
    score = plain_network(x[order], y[order])
    got = REGISTRY["op1_quality_classifier"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert math.isclose(r.score, score(np.array(pooled(texts[r.doc_id]))), abs_tol=2e-3), r.doc_id
        assert r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def plain_network(x, y):
    """The network trained a row at a time; draws its random numbers in the same order."""
    rng = np.random.default_rng(3)
    shift, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - shift) / scale
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    d, hidden = x.shape[1], quality.HIDDEN
    w = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, step = [0 * p for p in w], [0 * p for p in w], 0
    logit = lambda r: float(np.tanh(r @ w[0] + w[1]) @ w[2] + w[3][0])
    for _ in range(quality.EPOCHS):
        for batch in np.array_split(rng.permutation(used), max(1, len(used) // 256)):
            grads = [1e-4 * w[0], 0 * w[1], 1e-4 * w[2], 0 * w[3]]
            for i in batch:
                h = np.tanh(x[i] @ w[0] + w[1])
                e = (1 / (1 + math.exp(-(h @ w[2] + w[3][0]))) - y[i]) / len(batch)
                back = e * w[2] * (1 - h**2)
                for k, g in enumerate((np.outer(x[i], back), back, e * h, np.array([e]))):
                    grads[k] = grads[k] + g
            step += 1
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
                w[k] = w[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    at = [(logit(x[i]), y[i]) for i in held]
    loss = lambda k: sum(math.log1p(math.exp(-abs(z / k))) + max(z / k, 0) - t * z / k for z, t in at)
    grid = [0.25 * 32 ** (i / 120) for i in range(121)]
    best = min(grid, key=loss)
    return lambda r: 1 / (1 + math.exp(-max(-30, min(30, logit((r - shift) / scale) / best))))
