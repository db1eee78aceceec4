"""Registered queries that SQL cannot express, against plain versions on the smallest tables."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import pytest
import sentencepiece

import corpus_pipeline
from sparksync.llm.queries import REGISTRY, SHARDS, piece_model, table
from sparksync.llm.sharding import SIZE, fill_table

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}


def test_lm_scoring(spark, sf, texts):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)) for k, t in texts.items()}
    count, pair, after = collections.Counter(), collections.Counter(), collections.Counter()
    begin, end = 0, 1
    for k, w in words.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            count.update([*w, end])
            pair.update(zip([begin, *w], [*w, end]))
            after.update([begin, *w])
    kinds = collections.Counter(a for a, _ in pair)
    n, v = sum(count.values()), len(count)
    for r in REGISTRY["op5_lm_scoring"](spark, sf).collect():
        w, base, score = words[r.doc_id], 0.0, 0.0
        for a, b in zip([begin, *w], [*w, end]):
            one = (count[b] + 1) / (n + v + 1)
            base += math.log10(one)
            p = max(pair[a, b] - 0.75, 0) / after[a] + 0.75 * kinds[a] / after[a] * one if after[a] else one
            score += math.log10(p)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(count[b] > 0 for b in [*w, end]), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isclose(r.score, score, rel_tol=1e-3)


def test_suffix_dedup(spark, sf, texts):
    got = {r.doc_id: r for r in REGISTRY["op10_suffix_array_dedup"](spark, sf).collect()}
    seen = set()
    for k in sorted(texts):
        raw = texts[k].encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        kept = bytes(c for c, m in zip(raw, gone) if not m)
        spans = len(re.findall(b"\1+", bytes(gone)))
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), sum(gone), spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_pieces_and_counts(spark, sf, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    counts = collections.Counter()
    for r in REGISTRY["op2_sentencepiece"](spark, sf).collect():
        assert r.piece_ids == library.encode(texts[r.doc_id]) and r.round_trip and r.n_tokens == len(r.piece_ids)
        counts.update(r.piece_ids)
    assert {r.piece_id: r.n for r in REGISTRY["op3_token_counts"](spark, sf).collect()} == dict(counts)


def test_sharding(spark, sf):
    slots = fill_table(SHARDS)
    for r in REGISTRY["op6_sharding"](spark, sf).collect():
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % SIZE
        assert (r.slot, r.shard) == (slot, SHARDS[slots[slot]])


def test_pipeline(spark, sf, texts):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "pieces"]
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    assert 0 < len(rows) <= len(texts) and {r.doc_id for r in rows} <= set(texts)
    assert all(r.piece_ids == library.encode(r.text or "") for r in rows)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def plain_near_dedup(texts):
    sets, root = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(k):
        return k if root[k] == k else find(root[k])

    for a, b in itertools.combinations(sorted(k for k in sets if sets[k]), 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            low, high = sorted([find(a), find(b)])
            root[high] = low
    return {k: texts[k] for k in texts if root[k] == k}


def plain_cut(raw, gone):
    return bytes(c for c, m in zip(raw, gone, strict=True) if not m).decode(errors="ignore")


def plain_suffix_dedup(texts):
    out, seen = {}, set()
    for k in sorted(texts):
        raw = texts[k].encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        out[k] = plain_cut(raw, gone)
    return out


def plain_decontaminate(texts, items):
    spans = lambda text: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text.encode())]
    windows = collections.defaultdict(set)
    for item in items:
        words = [w for _, _, w in spans(item)]
        n = min(13, len(words))
        windows[n].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1) if n)
    out = {}
    for k, text in texts.items():
        found = spans(text)
        words, hit = [w for _, _, w in found], set()
        for n, known in windows.items():
            for i in range(len(words) - n + 1):
                if n and tuple(words[i : i + n]) in known:
                    hit.update(range(i, i + n))
        if not hit or len(hit) * 20 < len(words):
            out[k] = text
        elif len(hit) < len(words) / 2:
            gone = bytearray(len(text.encode()))
            for i in hit:  # with what lies between two words that are both hit
                a, b = found[i][0], found[i + 1][0] if i + 1 in hit else found[i][1]
                gone[a:b] = b"\1" * (b - a)
            out[k] = plain_cut(text.encode(), gone)
    return out


def test_pipeline_stages_against_plain_versions(spark, sf, texts, tmp_path):
    items = [r.text for r in table(spark, sf, "benchmark").collect() if r.text]
    rejected = {r.doc_id for r in REGISTRY["op8_toxicity"](spark, sf).filter("predicted = 1").collect()}
    plain = {
        "toxicity": lambda t: {k: v for k, v in t.items() if k not in rejected},
        "near_dedup": plain_near_dedup,
        "suffix_dedup": plain_suffix_dedup,
        "decontamination": lambda t: plain_decontaminate(t, items),
    }
    docs, want = table(spark, sf, "documents"), texts
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs, before = spark.read.parquet(f"{tmp_path}/{name}"), want
        want = plain[name](want)
        rows = [(r.doc_id, r.text or "") for r in docs.collect()]
        assert len(rows) == len(want) and dict(rows) == want, name
        # The smallest tables have too few labels for a lexicon; the test below has more.
        assert want != before or name == "toxicity", f"{name} has nothing to do on these tables"


def test_toxicity_stage_drops_what_the_query_rejects(spark):
    larger = "/root/testdata/sf0.01"
    verdicts = {r.doc_id: r.predicted for r in REGISTRY["op8_toxicity"](spark, larger).collect()}
    kept = corpus_pipeline.drop_toxic(spark, table(spark, larger, "documents"), larger)
    assert 0 < sum(verdicts.values()) < len(verdicts)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, v in verdicts.items() if not v)
