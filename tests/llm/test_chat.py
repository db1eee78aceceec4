"""Chat formatting: round trips, typed parts, and the edge cases of a table of turns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sparksync.llm.chat import MISTRAL_LIKE, PARTS, Template, escape, format_chat, learned_text, read_turns, unescape
from sparksync.llm.queries import REGISTRY, table

NASTY = [
    "", "\\", "\\\\", "\\<s>", "<", "<s", "<s>", "<\\s>", "</s>[INST] ok [/INST]", "[[INST]]", "[/TURN]\n[ROLE]x[/ROLE]", "[IMAGE]\\[IMAGE]",
    "<<s></s>>", "a\u0000b", "漢字🙂</s>", "line\r\n\ttab", "$1 \\1 \\$", "[\\INST]", "[ANS]" * 50,
]


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    rows = spark.createDataFrame([(t,) for t in NASTY], "t string").select("t", escape(F.col("t"), MISTRAL_LIKE).alias("e"))
    for r in rows.select("t", "e", unescape(F.col("e")).alias("b")).collect():
        assert r.b == r.t
        assert not any(w in r.e for w in MISTRAL_LIKE.control()), r.t


def test_round_trip_of_roles_texts_and_loss(spark):
    turns = [(1, i, role, t) for i, (t, role) in enumerate((t, r) for t in NASTY for r in ("user", "assistant", "system", "[INST]", "tool\\", ""))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    chat = format_chat(df, parts="text")
    r = chat.select("*", read_turns(F.col("formatted")).alias("back"), learned_text(F.col("formatted"), F.col("loss")).alias("learned")).first()
    assert [(t.role, t.text) for t in r.back] == [(role, t) for _, _, role, t in turns]
    assert r.learned == "".join(t for _, _, role, t in turns if role == "assistant")
    raw = r.formatted.encode()
    assert len(r.loss) == len(NASTY) and all(raw[s.end :].startswith(b"</s>") and raw[: s.begin].endswith(b"[ANS]") for s in r.loss)


def test_typed_parts_become_ordered_placeholders(spark):
    def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
        return (kind, text, ref, width, height, seconds, pages)

    rows = [
        (1, 1, "user", [part("text", "see "), part("image", ref="a.png", width=57, height=28), part(None, "[IMAGE] and"), part("audio", ref="b.wav", seconds=1.01)]),
        (1, 2, "assistant", [part("document", ref="c.pdf", pages=3), part("text", "read"), part("video", ref="d.mp4"), None]),
        (1, 3, "user", [part("image", ref="no size"), part("audio", seconds=-2.0)]),
        (1, 4, "user", None),
        (2, 0, "user", []),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {PARTS}")
    got = {r.conv_id: r for r in format_chat(df).select("*", read_turns(F.col("formatted")).alias("back")).collect()}
    assert got[1].formatted == (
        "<s>[INST]see [IMAGE][\\IMAGE] and[AUDIO][/INST][ANS][DOCUMENT]read[PART]</s>[INST][IMAGE][AUDIO][/INST][INST][/INST]"
    )
    assert [tuple(a) for a in got[1].attachments] == [
        (0, "image", "a.png", 3), (0, "audio", "b.wav", 13), (1, "document", "c.pdf", 3072), (1, "video", "d.mp4", 0), (2, "image", "no size", 0), (2, "audio", None, 0),
    ]
    assert got[1].n_media_tokens == 3 + 13 + 3072
    assert [(t.text, t.media) for t in got[1].back] == [("see [IMAGE] and", ["image", "audio"]), ("read", ["document", "other"]), ("", ["image", "audio"]), ("", [])]
    assert got[2].formatted == "<s>[INST][/INST]" and got[2].attachments == [] and got[2].n_media_tokens == 0


def test_edges(spark):
    long = "wörd \\ [INST] " * 60_000
    rows = [(1, 2, "user", "b"), (1, 1, "user", "z"), (1, 1, "assistant", "tie"), (1, None, None, None), (1, 2, "user", "b"), (None, 1, "user", "no id"), (3, 1, "assistant", long)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.select("*", *[F.lit("own").alias(c) for c in ("c", "t", "r", "rows", "formatted", "loss", "body", "k")])
    got = {r.conv_id: r for r in format_chat(df, parts="text").select("*", read_turns(F.col("formatted")).alias("back"), learned_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()}
    assert set(got) == {1, None, 3}
    assert [(t.role, t.text) for t in got[1].back] == [("", ""), ("assistant", "tie"), ("user", "z"), ("user", "b"), ("user", "b")]
    assert got[3].learned == long and got[None].n_turns == 1
    assert format_chat(df.limit(0), parts="text").collect() == []


@pytest.mark.parametrize("bad", [{"begin": "x"}, {"begin": "[INST]"}, {"begin": "<\\s>"}, {"begin": "a[b"}])
def test_template_is_checked(bad):
    with pytest.raises(ValueError):
        Template(**bad)


def test_query_against_a_plain_version(spark, sf):
    plain = {}
    for r in sorted(table(spark, sf, "conversations").collect(), key=lambda r: (r.conv_id, r.turn)):
        plain.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    plain[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    rows = REGISTRY["op11_chat_formatting"](spark, sf).collect()
    assert sorted(r.conv_id for r in rows) == sorted(plain)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        turns = plain[r.conv_id]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned))
