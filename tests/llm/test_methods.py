"""The operators' own parts against plain versions."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sparksync.llm import decontaminate, labelled, ngram_lm, near_dups, pieces, quality, sharding, toxicity
from sparksync.llm.queries import REGISTRY, piece_model, table
from sparksync.llm.text import WHITE, Hasher, Words, slices


def words_of(texts):
    batch = pa.record_batch({"text": pa.array(texts)})
    (s,) = slices(iter([batch]), "text")
    return s, Words(s.data, s.offsets, WHITE)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i, *itertools.accumulate(range(1, len(b) + 1), lambda left, j: min(left + 1, row[j] + 1, row[j - 1] + (x != b[j - 1])), initial=i)][1:]
    return row[-1]


def test_words_and_hashes():
    s, words = words_of(["A b", "b  a", "", None, "ab", "a\x0bb"])
    assert [bytes(s.data[a:b]) for a, b in zip(words.start, words.end)] == [b"A", b"b", b"b", b"a", b"ab", b"a", b"b"]
    assert words.count.tolist() == [2, 2, 0, 0, 1, 2]
    h = Hasher().words(s.data, words)
    assert h[0] == h[3] == h[5] and h[1] == h[2] == h[6] and len(set(h.tolist())) == 3


def test_sketches_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 600).astype(np.uint64)
    rows, x = np.repeat([0, 1, 2], [400, 400, 1]), np.concatenate([pool[:400], pool[100:500], pool[:1]])
    made = near_dups.sketches(rows, x, 3)
    assert (made != np.uint64(2**64 - 1)).all()
    assert abs((made[0] == made[1]).mean() - 300 / 500) < 0.12


def test_bands_follow_the_threshold(spark):
    assert near_dups.band_shape(85) == (32, 8) and near_dups.band_shape(80) == (42, 6)
    for percent in (70, 80, 85, 90):
        bands, length = near_dups.band_shape(percent)
        assert bands * length <= near_dups.COORDS and (1 - (percent / 100) ** length) ** bands <= 1e-4
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, None)], "doc_id long, text string")
    sizes = [len(r.bands) for r in near_dups.sketch_documents(docs, "doc_id", "text", 5, 80).filter("bands is not null").collect()]
    assert sizes == [42]


def test_levenshtein_table():
    terms = [(b"idiot", True), (b"scum", True), (b"lowei", False)]
    found = toxicity.build_table(terms)
    rng = random.Random(1)
    tests = ["idiot", "Idiot", "idot", "idxiot", "idito", "iidiot", "idio", "scum", "scom", "loweick", "lowexck", "lowe", "trash", "ïdiot", "idiöt", "éidiot", "öidiötx"]
    tests += ["".join(rng.choice("idotscum") for _ in range(rng.randint(3, 7))) for _ in range(500)]
    s, _ = words_of([" ".join(tests)])
    words = toxicity.Tokens(s.data, s.offsets)
    for word, kind in zip(tests, toxicity.match_words(s.data, words, found).tolist(), strict=True):
        low = word.lower()
        want = 1 if low in ("idiot", "scum") or low.startswith("lowei") else 2 if distance(low, "idiot") == 1 else 0
        assert kind == want, word


def test_copies_neither_add_nor_bar_a_term(spark):
    rng = random.Random(5)
    noise = lambda: " ".join("w" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12))
    toxic = [(f"{noise()} {noise().split()[0]} gribbet {noise()}", 1) for _ in range(30)]
    toxic += [(f"{noise()} you snorkop {noise()}", 1) for _ in range(30)]
    copies = [("only here stands zumblat beside gribbet and nothing more", 1)] * 400
    clean = [(f"{noise()} you here only stands and nothing more beside", 0) for _ in range(2000)]
    sample = spark.createDataFrame(toxic + copies + clean, "text string, label int")
    found = {t for t, whole in toxicity.learn_lexicon(sample) if whole}
    assert {b"gribbet", b"snorkop"} <= found and b"zumblat" not in found


def test_words_of_any_length_and_script_are_learned(spark):
    rng = random.Random(7)
    noise = lambda: " ".join("w" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12))
    long, longer, insult = "ab" * 24, "xyzzy" * 40, "你这个愚蠢透顶的大笨蛋滚出去永远别"
    common = "今天天气很好我们去公园散步吃饭看书听音乐学习工作"
    han = lambda n: "".join(rng.choice(common) for _ in range(n))
    toxic = [(f"{noise()} {long} {noise()}", 1) for _ in range(20)] + [(f"{noise()} zq {noise()}", 1) for _ in range(20)]
    toxic += [(f"{noise()} {longer}{i} {noise()}", 1) for i in range(20)] + [(han(20) + insult + han(20), 1) for _ in range(20)]
    clean = [(noise(), 0) for _ in range(1000)] + [(han(50), 0) for _ in range(1000)]
    found = toxicity.learn_lexicon(spark.createDataFrame(toxic + clean, "text string, label int"))
    assert {(long.encode(), True), (b"zq", True)} <= set(found)
    texts = [long, "zq", longer + "777", "abc" + han(5) + insult + han(5), han(80), noise(), "", None, long[:-1], "x" * 300_000, "好" * 100_000]
    s, _ = words_of(texts)
    words = toxicity.Tokens(s.data, s.offsets)
    kinds = toxicity.match_words(s.data, words, toxicity.build_table(found))
    best = [kinds[words.first[i] : words.first[i + 1]] for i in range(len(texts))]
    assert [bool((k == 1).any()) for k in best] == [True] * 4 + [False] * 7
    assert (best[8] == 2).any()


def test_tokens_of_mixed_scripts():
    s, _ = words_of(["ab你好cd ef", "ก", "né 好", "", None])
    words = toxicity.Tokens(s.data, s.offsets)
    cut = lambda ends: [bytes(s.data[a:b]).decode() for a, b in zip(words.start, ends, strict=True)]
    assert cut(words.end) == ["ab", "你", "好", "cd", "ef", "ก", "né", "好"]
    assert cut(words.reach) == ["ab", "你好cd", "好cd", "cd", "ef", "ก", "né", "好"]
    assert words.count.tolist() == [5, 1, 2, 0, 0] and words.doc.tolist() == [0] * 5 + [1, 2, 2]


def test_lexicon_has_every_term_with_the_odds(spark):
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))[::-1]
    terms, common = [f"{name(1000 * i)}x" for i in range(300)], [f"{name(7 * i)}clean{name(i)}" for i in range(4000)]
    toxic = [(" ".join([*common, *terms[i % 10 * 30 : i % 10 * 30 + 30], f"own{i}"]), 1) for i in range(70)]
    clean = [(" ".join([*common, f"own{i}"]), 0) for i in range(70, 470)]
    sample = spark.createDataFrame(toxic + clean, "text string, label int")
    found = toxicity.learn_lexicon(sample)
    stands = {t for t, whole in found if whole} | {t for t in map(str.encode, terms) if any(t.startswith(c) for c, w in found if not w)}
    assert set(map(str.encode, terms)) <= stands and not any(t.startswith(c.encode()) for t, _ in found for c in common)


def test_automaton_against_plain_search():
    rng = random.Random(2)
    code = lambda ws: np.array([ord(w) * 2654435761 % 2**64 for w in ws], np.uint64)
    for _ in range(60):
        items = [(str(i), [rng.choice("abc") for _ in range(rng.randint(1, 9))]) for i in range(4)]
        text = [rng.choice("abcd") for _ in range(40)]
        automaton = decontaminate.Automaton([(n, code(w)) for n, w in items], 4)
        codes = automaton.codes(code(text))
        hits, names = set(), set()
        for a, b in automaton.stretches(codes, np.zeros(len(codes), np.int64)):
            for i, n, found in automaton.stream(codes[a:b].tolist()):
                hits.update(range(a + i + 1 - n, a + i + 1))
                names |= found
        want, who = set(), set()
        for name, w in items:
            n = min(4, len(w))
            for i, j in itertools.product(range(len(text) - n + 1), range(len(w) - n + 1)):
                if text[i : i + n] == w[j : j + n]:
                    want.update(range(i, i + n))
                    who.add(name)
        assert (hits, names) == (want, who)


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, top in [(0, 1), (1, 2**63), (1000, 2**62), (1000, 500), (7, 8)]:
        x = np.sort(rng.integers(0, top, n).astype(np.uint64))
        level = ngram_lm.EliasFano(np.frombuffer(ngram_lm.EliasFano.encode(x), np.uint8), 0)
        assert (level.values() == x).all() and level.n == n


def test_quantised_probabilities():
    p = 10 ** np.linspace(-11.9, 0, 100)
    assert np.allclose(np.log10(ngram_lm.restore(ngram_lm.quantise(p))), np.log10(p), atol=2e-4)


@pytest.mark.parametrize("n", [1, 2, 7])
def test_lookup_table_is_even_and_stable(n):
    names = [f"s{i}" for i in range(n)]
    table = sharding.fill_table(names, 1009)
    shares = np.bincount(table, minlength=n)
    assert shares.max() - shares.min() <= 1
    if n == 7:
        fewer = sharding.fill_table(names[:-1], 1009)
        stayed = table != 6
        assert (table[stayed] == fewer[stayed]).mean() > 0.75


@pytest.mark.parametrize("kind", [1, 2])
def test_folds_agree_with_the_library(spark, kind):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(piece_model(), "rb") as f:
        proto.ParseFromString(f.read())
    model = pieces.read_pieces(piece_model())
    if kind == 1:  # the same pieces as a unigram model, with scores that add up sensibly
        for p in proto.pieces:
            p.score = max(p.score, -40_000.0) / 4_000.0 - 1.0 if p.type == 1 else p.score
        proto.trainer_spec.model_type = 1
        model.kind, model.scores = "unigram", [p.score for p in proto.pieces if p.type == 1]
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = ["Hello  world, it's a   test.", "thstinnt 12345 über señor", "x" * 70, "naïve 漢字 🙂\n\ttab", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in pieces.encode(docs, model).collect():
        got, want = r.piece_ids, library.encode(r.text)
        if kind == 2:
            assert got == want
        else:
            score = lambda ids: sum(proto.pieces[i].score for i in ids if proto.pieces[i].type == 1)
            assert abs(score(got) - score(want)) < 1e-3


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = quality.Network(x, y)
    assert ((net.score(x) > 0.5) == (y > 0)).mean() > 0.8
    w = labelled.fit_logistic(x, (x[:, 0] > 0).astype(float))
    assert ((labelled.logistic(x, w) > 0.5) == (x[:, 0] > 0)).mean() > 0.95


@pytest.mark.parametrize("name,label", [("op1_quality_classifier", "quality"), ("op8_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, label):
    sf = "/root/testdata/sf0.01"
    joined = REGISTRY[name](spark, sf).filter("held_out").join(table(spark, sf, "labels"), "doc_id")
    assert joined.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] > 0.93


def test_words_of_a_fold_are_spread_by_their_number(spark, capsys, monkeypatch):
    """A task sorts its words' substrings, so it gets so many words and no more, however small the words look."""
    monkeypatch.setattr(pieces, "TASK_WORDS", 100)
    model = pieces.Pieces(["a", "b", "ab"], [0, 1, 2], [0.0, -1.0, -2.0], 3, "bpe")
    words = spark.range(1000).selectExpr("id as key", "concat('ab', repeat('a', int(id % 5))) as word")
    coded = pieces.encode_words(words, model)
    coded.explain()
    assert "hashpartitioning(key#" in (plan := capsys.readouterr().out) and ", 10), REPARTITION_BY_NUM" in plan
    assert {r.key: list(r.ids) for r in coded.collect()}[7] == [2, 0, 0]
