"""Chat formatting: turns of typed content parts become one marked string per conversation.

A visitor flattens the parts of a turn, in order: text is escaped, an image,
an audio clip or a document becomes a placeholder, its reference goes to a
list of attachments with the number of tokens the placeholder expands to.
Everything is a DataFrame expression; nothing runs in Python workers.

Control strings in a text are broken up by a backslash after their first
character and backslashes are doubled, so a formatted string contains control
strings only where the template put them, and ``read_turns`` gives back every
role and text as it was.

Turns are flattened and escaped before the one shuffle, which is by
conversation. A conversation is one row of the result and as such held by one
task, up to the 2 GiB of a Spark string.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparksync.functions.binding import let

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


@dataclass(frozen=True)
class Template:
    """Marks of a conversation. Roles without marks of their own are spelled out between ``role_open`` and ``role_close``."""

    begin: str = "<s>"
    marks: tuple[tuple[str, str, str], ...] = (
        ("system", "[SYS]", "[/SYS]"),
        ("user", "[INST]", "[/INST]"),
        ("assistant", "[ANS]", "</s>"),
    )
    role_open: str = "[ROLE]"
    role_close: str = "[/ROLE]"
    turn_close: str = "[/TURN]"
    media: tuple[tuple[str, str], ...] = (("image", "[IMAGE]"), ("audio", "[AUDIO]"), ("document", "[DOCUMENT]"))
    other: str = "[PART]"
    learn: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        words = self.control()
        if len(set(words)) < len(words) or any(len(w) < 2 or "\\" in w for w in words):
            raise ValueError("control strings must differ, have two characters or more and no backslash")
        if any(w[0] in v[1:] for w in words for v in words):
            raise ValueError("no control string may begin inside another")

    def control(self) -> list[str]:
        marks = [m for _, start, end in self.marks for m in (start, end)]
        return [self.begin, *marks, self.role_open, self.role_close, self.turn_close, *self.placeholders(), self.other]

    def placeholders(self) -> list[str]:
        return [p for _, p in self.media]

    def closers(self) -> list[str]:
        return [*(end for _, _, end in self.marks), self.turn_close]


MISTRAL_LIKE = Template()


def escape(text: Column, template: Template) -> Column:
    """``text`` without control strings; ``unescape`` is its inverse. A null is an empty text."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    starts = "|".join(f"{re.escape(w[0])}(?={re.escape(w[1:])})" for w in template.control())
    return F.regexp_replace(doubled, f"({starts})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


@dataclass(frozen=True)
class PartVisitor:
    """Flattens one part; a kind is handled by the method of its name, other kinds by ``unknown``.

    Counts: an image takes one token per patch of ``patch`` pixels square, an
    audio clip ``per_second`` a second, a document ``per_page`` a page, each
    rounded up. A missing or negative measure counts as zero.
    """

    template: Template = MISTRAL_LIKE
    patch: int = 28
    per_second: float = 12.5
    per_page: int = 1024

    def text(self, part: Column) -> tuple[Column, Column]:
        return escape(part["text"], self.template), F.lit(0).cast("long")

    def image(self, part: Column) -> tuple[Column, Column]:
        return self._mark("image"), self._whole(part["width"] / self.patch) * self._whole(part["height"] / self.patch)

    def audio(self, part: Column) -> tuple[Column, Column]:
        return self._mark("audio"), self._whole(part["seconds"] * self.per_second)

    def document(self, part: Column) -> tuple[Column, Column]:
        return self._mark("document"), self._whole(part["pages"].cast("long") * self.per_page)

    def unknown(self, part: Column) -> tuple[Column, Column]:
        return F.lit(self.template.other), F.lit(0).cast("long")

    def visit(self, part: Column) -> Column:
        """struct(body, kind, ref, tokens) of a part; a null part is an empty text."""
        kind = F.coalesce(part["kind"], F.lit("text"))
        kinds = ["text", *(k for k, _ in self.template.media)]
        body, tokens = self.unknown(part)
        for name in reversed(kinds):
            b, n = getattr(self, name)(part)
            body, tokens = F.when(kind == name, b).otherwise(body), F.when(kind == name, n).otherwise(tokens)
        return F.struct(body.alias("body"), kind.alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"))

    def _mark(self, kind: str) -> Column:
        return F.lit(dict(self.template.media)[kind])

    @staticmethod
    def _whole(value: Column) -> Column:
        return F.coalesce(F.greatest(F.ceil(value), F.lit(0)), F.lit(0)).cast("long")


def text_parts(text: Column) -> Column:
    """A plain text as the parts of a turn."""
    names = [f.split(":") for f in PARTS[len("array<struct<") : -2].split(",")]
    given = {"kind": F.lit("text"), "text": text}
    return F.array(F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in names]))


def format_chat(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", visitor: PartVisitor = PartVisitor()
) -> DataFrame:
    """One row per conversation: (``conv``, formatted, n_turns, loss, attachments, n_media_tokens).

    ``parts`` is an array of ``PARTS`` or a string column. ``loss`` lists the
    (begin, end) UTF-8 byte offsets in ``formatted`` of what is to be learned:
    the texts of the roles in ``learn``, without their marks. ``attachments``
    has (turn, kind, ref, tokens) in the order of the placeholders, ``turn``
    counted from 0.

    Turns are in the order of ``turn``, nulls first; ties by role, then text.
    Repeated rows are turns of their own. A null role is the role '', a null
    text or array is empty, rows without ``conv`` are one conversation, an
    empty table has no rows. Other columns are not looked at.
    """
    template = visitor.template
    content = F.col(parts)
    if turns.schema[parts].dataType.typeName() == "string":
        content = text_parts(content)
    rows = turns.select(
        F.col(conv).alias("c"),
        F.col(turn).alias("t"),
        F.coalesce(F.col(role), F.lit("")).alias("r"),
        F.transform(F.coalesce(content, F.array().cast(PARTS)), visitor.visit).alias("flat"),
    )
    start = F.concat(F.lit(template.role_open), escape(F.col("r"), template), F.lit(template.role_close))
    end = F.lit(template.turn_close)
    for name, first, last in template.marks:
        start, end = F.when(F.col("r") == name, F.lit(first)).otherwise(start), F.when(F.col("r") == name, F.lit(last)).otherwise(end)
    media = F.transform(F.filter("flat", lambda p: p["kind"] != "text"), lambda p: p.dropFields("body"))
    rows = rows.select(
        "c", "t", "r",
        start.alias("start"),
        F.array_join(F.transform("flat", lambda p: p["body"]), "").alias("body"),
        end.alias("end"),
        media.alias("media"),
    )
    order = Window.partitionBy("c").orderBy("t", "r", "body")
    size = sum((F.octet_length(x).cast("long") for x in ("start", "body", "end")), F.lit(0).cast("long"))
    begin = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.select(
        "c",
        (F.row_number().over(order) - 1).alias("k"),
        (F.coalesce(begin, F.lit(0)) + len(template.begin.encode()) + F.octet_length("start")).alias("at"),
        F.octet_length("body").alias("n"),
        F.col("r").isin(*template.learn).alias("learn"),
        F.concat("start", "body", "end").alias("piece"),
        "media",
    )
    whole = placed.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("k", "at", "n", "learn", "piece", "media"))).alias("rows"))
    learned = F.filter("rows", lambda x: x["learn"])
    found = F.flatten(F.transform("rows", lambda x: F.transform(x["media"], lambda p: F.struct(x["k"].cast("long").alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))))
    return whole.select(
        F.col("c").alias(conv),
        F.concat(F.lit(template.begin), F.array_join(F.transform("rows", lambda x: x["piece"]), "")).alias("formatted"),
        F.size("rows").cast("long").alias("n_turns"),
        F.transform(learned, lambda x: F.struct(x["at"].alias("begin"), (x["at"] + x["n"]).alias("end"))).alias("loss"),
        found.alias("attachments"),
        F.aggregate(found, F.lit(0).cast("long"), lambda n, p: n + p["tokens"]).alias("n_media_tokens"),
    )


def read_turns(formatted: Column, template: Template = MISTRAL_LIKE) -> Column:
    """The turns of a formatted string as an array of (role, text, media).

    ``text`` is what the text parts had, unescaped and joined; ``media`` are
    the kinds of the placeholders in order, those of unknown kind as 'other'.
    """
    after = "|".join(re.escape(x) for x in template.closers())
    pieces = F.split(F.substr(formatted, F.lit(len(template.begin) + 1)), f"(?<={after})")
    marks = [*template.placeholders(), template.other]
    kinds = {p: k for k, p in template.media} | {template.other: "other"}
    either = "|".join(re.escape(m) for m in marks)

    def inside(piece: Column, first: Column, last: str) -> Column:
        return F.substr(piece, first + 1, F.length(piece) - first - len(last))

    def turn(piece: Column) -> Column:
        named = F.instr(piece, template.role_close) + len(template.role_close) - 1
        role = unescape(F.substr(piece, F.lit(len(template.role_open) + 1), named - len(template.role_open) - len(template.role_close)))
        body = inside(piece, named, template.turn_close)
        for name, start, end in template.marks:
            mine = piece.startswith(start)
            role = F.when(mine, F.lit(name)).otherwise(role)
            body = F.when(mine, inside(piece, F.lit(len(start)), end)).otherwise(body)
        found = F.regexp_extract_all(body, F.lit(f"({either})"))
        media = F.transform(found, lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), m))
        text = unescape(F.regexp_replace(body, either, ""))
        return F.struct(role.alias("role"), text.alias("text"), media.alias("media"))

    return let(F.filter(pieces, lambda p: p != ""), lambda p: F.transform(p, turn))


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""

    def cut(raw: Column) -> Column:
        # Slices of a binary value are taken without a walk over its characters.
        return F.array_join(F.transform(loss, lambda s: unescape(F.substring(raw, (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")).cast("string"))), "")

    return let(F.encode(formatted, "utf-8"), cut)
