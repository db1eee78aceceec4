"""What steps hold at once, in memory and in the checkpoint folder."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa

from sparksync.llm import pieces, toxicity
from sparksync.llm.queries import piece_model


class Sample:
    """Takes the function that a table's batches would go through."""

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self

    def groupBy(self, *_):  # noqa: N802
        return self

    agg = groupBy


def test_term_counts_hold_the_terms_of_little_text_at_once(spark):
    texts = [" ".join(f"w{(i * 37 + k) % 5000}x" for k in range(120)) for i in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([i % 2 for i in range(1500)], pa.int32())], ["text", "label"])
    sample = Sample()
    toxicity._term_counts(sample)
    out = list(sample.run(iter([batch])))
    assert len(out) >= sum(map(len, texts)) // (256 << 10)
    found, plain = Counter(), Counter()
    for part in out:
        for r in part.to_pylist():
            found[r["term"], r["whole"], 1] += r["toxic"]
            found[r["term"], r["whole"], 0] += r["clean"]
    for i, text in enumerate(texts):
        plain.update({(t, w, i % 2) for word in text.split() for t, w in toxicity._terms(word.encode(), False)})
    assert +found == plain


def test_encode_stores_no_copy_of_the_documents(spark, monkeypatch):
    stored, kept = [], pieces.checkpointed

    def recorded(df):
        stored.append(df.columns)
        return kept(df)

    monkeypatch.setattr(pieces, "checkpointed", recorded)
    docs = spark.createDataFrame([(1, "some words here"), (1, "some words here"), (2, ""), (3, None), (None, "für alle")], "doc_id long, text string")
    model = pieces.read_pieces(piece_model())
    rows = pieces.decode(pieces.encode(docs, model), model).collect()
    assert Counter((r.doc_id, r.text, r.decoded) for r in rows) == Counter(
        {(1, "some words here", "some words here"): 2, (2, "", ""): 1, (3, None, ""): 1, (None, "für alle", "für alle"): 1}
    )
    assert stored and not any({"payload", "text"} & set(columns) for columns in stored)
