"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparksync.llm import decontaminate, ngram_lm, near_dups, pieces, quality, sharding, suffix_dedup, token_counts, topk, toxicity
from sparksync.llm.queries import piece_model

CLASH = ["begin", "end", "overlap", "piece_ids", "cls", "block", "shard", "slot", "key", "word", "label", "score"]
LONG = "alpha beta gamma delta " * 40_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here today"),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from here today"),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from here today"),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "one"),
    (7, LONG),
    (8, "ünïcødé 漢字 🙂 ▁ \x00 end"),
    (None, "the quick brown fox jumps over the lazy dog and runs far away from here today"),
    (None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string")
    return plain.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, None, None), (2, 0, 1), (6, 1, 1), (7, 0, 0), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


@pytest.fixture(scope="module")
def model():
    return pieces.read_pieces(piece_model())


@pytest.mark.parametrize("classify", [quality.quality, toxicity.toxicity])
def test_classifiers(classify, docs, empty, labels):
    rows = classify(docs, labels).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r.score <= 1 for r in rows)
    assert all((r.held_out is None) == (r.doc_id is None) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert classify(empty, labels).collect() == []
    assert len(classify(docs, labels.limit(0)).collect()) == len(ROWS)


def test_pieces(docs, empty, model):
    coded = pieces.encode(docs, model)
    assert coded.columns[:-1] == docs.columns and coded.columns[-1] == "_piece_ids"
    back = pieces.decode(coded, model, "_piece_ids").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in back) == sorted((str(a), str(b)) for a, b in ROWS)
    for r in back:
        assert r.decoded == (r.text or "").replace("▁", " ")
        assert r.begin == "own begin"
    assert pieces.encode(empty, model).collect() == []


def test_decode_of_odd_ids(spark, model):
    rows = [(1, [None]), (2, []), (3, None), (4, [model.byte_zero + 65, 10_000_000, -5, model.byte_zero + 66])]
    ids = spark.createDataFrame(rows, "doc_id long, piece_ids array<int>")
    got = {r.doc_id: r.decoded for r in pieces.decode(ids, model).collect()}
    assert got == {1: "\ufffd", 2: "", 3: None, 4: "A\ufffd\ufffdB"}
    assert pieces.decode(ids.limit(0), model).collect() == []


def test_token_counts(docs, empty, model):
    sizes = pieces.encode(docs.select("text"), model).agg(F.sum(F.size("piece_ids"))).first()[0]
    assert token_counts.token_counts(docs, model).agg(F.sum("n")).first()[0] == sizes
    assert token_counts.token_counts(empty, model).collect() == []


def test_near_duplicates(docs, empty):
    rows = near_dups.near_duplicates(docs, width=3, percent=85).collect()
    assert len(rows) == len(ROWS)
    found = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in rows}
    assert found[(1, 14)] == (1, True) and found[(2, 14)] == (1, False) and found[(None, 14)] == (1, False)
    assert found[(3, 0)] == (3, True) and found[(4, 0)] == (4, True) and found[(5, 0)] == (5, True)
    assert found[(6, 1)] == (6, True) and found[(7, 4)] == (7, True) and found[(None, 0)] == (None, True)
    assert near_dups.near_duplicates(empty).collect() == []


def test_pipeline_decides_by_row(spark, tmp_path):
    story, other = ROWS[0][1], "another clean text with quite other words that nobody has written before this day"
    rows = [(1, story, "a"), (2, story, "b"), (2, other, "c"), (2, other, "c"), (None, story, "d"), (None, "only without an id", "e"), (None, "only without an id", "f"), (3, "", "g"), (3, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), str(r.text), r.key) for r in kept.collect())
    assert [x for x in got if x[1] != "only without an id"] == sorted([("1", story, "a"), ("2", other, "c"), ("3", "", "g"), ("3", "None", "h")])
    assert len([x for x in got if x[1] == "only without an id"]) == 1

    known = [(i, f"what a gribbet number{i} you are", 1) for i in range(100, 160)] + [(i, f"what a nice number{i} you are", 0) for i in range(160, 400)]
    mixed = [(7, "what a gribbet you are"), (7, "what a nice day"), (None, "what a gribbet you are"), (None, "such a day"), (8, None)]
    spark.createDataFrame([(i, y) for i, _, y in known], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t) for i, t, _ in known] + mixed, "doc_id long, text string")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).filter("doc_id is null or doc_id < 100").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [("7", "what a nice day"), ("8", "None"), ("None", "such a day")]


def test_near_duplicates_at_width_5(spark, docs):
    for text in ("two words", "now three words"):
        alone = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert [tuple(r) for r in near_dups.near_duplicates(alone, width=5).collect()] == [(1, 1, 1, True)]
    short = spark.createDataFrame([(9, "two words")], "doc_id long, text string")
    rows = near_dups.near_duplicates(docs.select("doc_id", "text").union(short), width=5).collect()
    found = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in rows}
    assert len(rows) == len(ROWS) + 1 and found[(9, 1)] == (9, True)
    assert found[(1, 12)] == (1, True) and found[(2, 12)] == (1, False) and found[(None, 12)] == (1, False)


def test_lm_scores(docs, empty):
    rows = ngram_lm.lm_scores(docs).collect()
    assert len(rows) == len(ROWS)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].n_tokens == by_id[4].n_tokens == by_id[5].n_tokens == 1
    assert by_id[3].score == by_id[4].score
    assert by_id[7].n_tokens == 160_001 and by_id[None].held_out is None
    assert ngram_lm.lm_scores(empty).collect() == []


def test_sharding(docs):
    placed = sharding.place(docs, "doc_id", ["a", "b", "c"], 101)
    assert placed.count() == len(ROWS)
    assert placed.filter("doc_id is null").select("shard").distinct().count() == 1
    assert set(placed.columns) == set(docs.columns) | {"shard"}
    clash = docs.select("doc_id", *[F.lit(1).alias(c) for c in ("_slot", "_shard", "slot_of_row", "SHARD_OF_ROW")])
    assert sharding.place(clash, "doc_id", ["a", "b"], 101).columns == [*clash.columns, "slot", "shard"]
    assert sharding.place(clash, "doc_id", ["a", "b"], 101).count() == len(ROWS)
    assert sharding.place(docs.limit(0), "doc_id", ["a", "b"], 101).collect() == []


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [2.0, 1.0]), (8, [5.0]), (None, [1.0, 1.0]), (100, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("norm", F.lit(2))
    found = topk.top_k(vectors, F.col("id") % 100 == 0, 3).orderBy("query_id", "rank").collect()
    one = 1024 * 1024
    assert [(r.query_id, r.rank, r.id, r.score) for r in found] == [
        (0, 1, 7, 2 * one), (0, 2, 1, one), (0, 3, 2, one), (100, 1, 0, 0), (100, 2, 1, 0), (100, 3, 2, 0),
    ]
    assert topk.top_k(vectors.limit(0), F.col("id") % 100 == 0, 3).collect() == []


def test_decontaminate(spark, docs, empty):
    items = spark.createDataFrame(
        [(1, "Quick brown FOX jumps over the lazy dog and runs far away from"), (1, "quick brown fox"), (2, None), (None, "one"), (3, ""), (4, "lazy dog")],
        "item_id long, text string",
    ).withColumn("overlap", F.lit(0))
    marked, out = decontaminate.mark_overlaps(docs, items)
    assert out == "_overlap"
    rows = {r.doc_id: r for r in marked.collect() if r.doc_id is not None}
    assert rows[1][out]["items"] == ["1", "4"] and (rows[1][out]["first"], rows[1][out]["last"]) == ([1], [13])
    assert rows[3][out]["n_words"] == 0 and rows[6][out]["items"] == [] and rows[7][out]["n_words"] == 160_000
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7, 8, None}
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == len(ROWS)
    assert decontaminate.decontaminate(empty, items).collect() == []


def test_remove_repeats(docs, empty):
    kept = suffix_dedup.remove_repeats(docs, width=20)
    assert kept.columns == docs.columns
    rows = {(r.doc_id, len(r.text or "")) for r in kept.collect()}
    # Rows that share an id do not match each other but match row 1; a row without an id loses nothing.
    assert (1, len(ROWS[0][1])) in rows and (2, 0) in rows and (None, len(ROWS[0][1])) in rows
    assert next(n for i, n in rows if i == 7) == len("alpha beta gamma delta ")
    assert suffix_dedup.remove_repeats(empty).collect() == []
