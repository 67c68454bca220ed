"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own, with all turns before it as context.

An example's text is a prefix of its conversation's formatted text, so the text is stored once, a row a turn, and an
example is two marks in it: where it stops, and the span of its reply, which alone is trained on. What is stored grows
with the turns; ``expanded`` writes the examples out in full, which grows with their square in a conversation.

A conversation's turns are those of one conv_id (null is one too) by turn, nulls first; rows of equal turn by role and
text. Null roles and texts are empty. Only the columns conv_id, turn, role and text are read. Empty tables give none.
Turns are numbered and measured in sections of SECTION turn numbers, so that no task holds a long conversation; rows
of one conv_id and one turn number stay together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import staged

#: Turn numbers of a section.
SECTION = 256
REPLY = "assistant"


@dataclass(frozen=True)
class Template:
    """How turns are marked: ``open`` role ``mid`` text ``close``, and the reply's text then ``end``.

    A backslash breaks every control string in a role or text behind its first character, and doubles backslashes;
    taking one backslash off each pair undoes it. Control strings hold no backslash, and their first character only in
    front, so none can arise where pieces meet.
    """

    open: str = "[INST]"
    mid: str = "<s>"
    close: str = "[/INST]"
    end: str = "</s>"

    def __post_init__(self) -> None:
        firsts = {c[:1] for c in self.controls}
        for c in self.controls:
            if len(c) < 2 or "\\" in c or firsts & set(c[1:]):
                raise ValueError(f"{c!r} can't be a control string")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.mid, self.close, self.end)

    def escaped(self, text: Column) -> Column:
        """``text`` without control strings."""
        broken = [f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls]
        return F.regexp_replace(text, "|".join([*broken, r"\\"]), r"$0\\")

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    def piece(self, role: Column, text: Column) -> Column:
        said = self.escaped(text)
        asked = F.concat(F.lit(self.open), self.escaped(role), F.lit(self.mid), said, F.lit(self.close))
        return F.when(role == REPLY, F.concat(said, F.lit(self.end))).otherwise(asked)

    def turns(self, text: Column) -> Column:
        """The turns of a formatted text: array<struct<role, text>>, as they were before."""
        o, c, e = (re.escape(x) for x in (self.open, self.close, self.end))
        pieces = F.regexp_extract_all(text, F.lit(rf"(?s){o}.*?{c}|.*?{e}"), F.lit(0))

        def between(p: Column, first: Column, last: Column | int) -> Column:
            return self.unescaped(F.substring(p, first, F.length(p) - last - first + 1))

        def turn(p: Column) -> Column:
            mid = F.locate(self.mid, p)
            asked = F.struct(
                self.unescaped(F.substring(p, F.lit(len(self.open) + 1), mid - len(self.open) - 1)).alias("role"),
                between(p, mid + len(self.mid), len(self.close)).alias("text"),
            )
            return F.when(p.startswith(self.open), asked).otherwise(F.struct(F.lit(REPLY).alias("role"), between(p, F.lit(1), len(self.end)).alias("text")))

        return F.transform(pieces, turn)


CHAT = Template()


def pieces(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """The formatted turns: conv_id, section, place (1 on, in the section), start (characters before it there), piece, reply_chars (null: no reply)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select("conv_id", F.floor(F.col("turn") / SECTION).alias("section"), "turn", text("role").alias("role"), text("text").alias("text"))
    by = Window.partitionBy("conv_id", "section").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "section", "turn", "role", "text", template.piece(F.col("role"), F.col("text")).alias("piece"))
    reply = F.when(F.col("role") == REPLY, F.length("piece") - len(template.end)).alias("reply_chars")
    before = F.sum(F.length("piece").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("conv_id", "section", F.row_number().over(by).alias("place"), F.coalesce(before, F.lit(0)).alias("start"), "piece", reply)


def examples(stored: DataFrame) -> DataFrame:
    """An example a reply: conv_id, example (1 on), turns (with the reply), loss_start and loss_chars (the reply's span in the
    conversation's formatted text, by characters), stop (characters of the example); and section and place of the reply's piece."""
    sizes = stored.groupBy("conv_id", "section").agg(F.count("*").alias("n"), F.count("reply_chars").alias("replies"), F.sum(F.length("piece").cast("long")).alias("chars"))
    earlier = Window.partitionBy("conv_id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("section").alias("s"), *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(x) for x in ("n", "replies", "chars")])
    replies = stored.where(F.col("reply_chars").isNotNull()).select("conv_id", "section", "place", "start", "reply_chars", F.length("piece").alias("long"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "section").orderBy("place"))
    found = replies.withColumn("nth", nth).join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("section").eqNullSafe(F.col("s")))
    start = F.col("chars") + F.col("start")
    return found.select(
        "conv_id", (F.col("replies") + F.col("nth")).alias("example"), (F.col("n") + F.col("place")).alias("turns"), start.alias("loss_start"),
        F.col("reply_chars").cast("long").alias("loss_chars"), (start + F.col("long")).alias("stop"), "section", "place",
    )


def formatted(conversations: DataFrame, template: Template = CHAT) -> tuple[DataFrame, DataFrame]:
    """The two stored tables, read back: pieces and examples."""
    stored = staged(pieces(conversations, template), "chat-pieces")
    return stored, staged(examples(stored), "chat-examples")


def texts(stored: DataFrame) -> DataFrame:
    """Each conversation's formatted text, in one value: conv_id, text."""
    parts = F.array_sort(F.collect_list(F.struct("section", "place", "piece")))
    return stored.groupBy("conv_id").agg(F.concat_ws("", F.transform(parts, lambda p: p.piece)).alias("text"))


def expanded(stored: DataFrame, marks: DataFrame) -> DataFrame:
    """The examples in full: conv_id, example, context (all turns before), target (the reply, which alone is trained on, and its end)."""
    held = texts(stored).withColumnRenamed("conv_id", "c")
    found = marks.join(held, F.col("conv_id").eqNullSafe(F.col("c")))
    cut = lambda first, n: F.substring("text", first.cast("int"), n.cast("int"))
    start, stop = F.col("loss_start"), F.col("stop")
    return found.select("conv_id", "example", cut(F.lit(1), start).alias("context"), cut(start + 1, stop - start).alias("target"))


def planted(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -7, whose two turns say control strings."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise(REPLY)
    return rows.unionByName(conversations.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")))


def chat_digests(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """What the stored tables say of each conversation: n_turns, digests of turns and of what is trained on, sizes.

    formatted_chars are the stored characters, expanded_chars those of all examples written out. A digest needs its
    conversation's text in one value; the stored tables don't.
    """
    stored, marks = formatted(planted(conversations), template)
    # pieces and marks of a conversation meet in one grouping
    rows = stored.select("conv_id", F.struct("section", "place", "piece").alias("part"), F.lit(None).cast("struct<turns:bigint,loss_chars:bigint>").alias("span"), F.lit(None).cast("long").alias("stop"))
    rows = rows.unionByName(marks.select("conv_id", F.lit(None).cast(rows.schema["part"].dataType).alias("part"), F.struct("turns", "loss_chars").alias("span"), "stop"))
    whole = rows.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list("part")), lambda p: p.piece).alias("pieces"), F.array_sort(F.collect_list("span")).alias("spans"),
        F.sum("stop").alias("expanded_chars"), F.count("stop").alias("n_examples"),
    )
    learned = F.transform("spans", lambda m: F.substring(F.element_at("pieces", m.turns.cast("int")), F.lit(1), m.loss_chars.cast("int")))
    whole = whole.select("conv_id", "n_examples", F.coalesce("expanded_chars", F.lit(0)).alias("expanded_chars"), F.concat_ws("", "pieces").alias("text"), template.unescaped(F.concat_ws("", learned)).alias("learned"))
    whole = whole.select("*", template.turns(F.col("text")).alias("said"))
    lines = F.concat_ws("", F.transform("said", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    return whole.select(
        "conv_id", F.size("said").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"), "n_examples", "expanded_chars",
    )


#: DuckDB form, straight from the conversations: control strings don't overlap, so each adds one character.
ORACLE_SQL = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
    SELECT *, role = 'assistant' AS reply, length(text) + length(text) - length(replace(text, '\', ''))
        + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7
        + (length(text) - length(replace(text, '</s>', ''))) // 4 + (length(text) - length(replace(text, '<s>', ''))) // 3 AS body
    FROM said
), placed AS (
    SELECT *, CASE WHEN reply THEN body + 4 ELSE body + 16 + length(role) END AS chars FROM sized
), ordered AS (
    SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM placed
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (reply), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (reply), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) FILTER (reply) AS n_examples,
    CAST(coalesce(sum(upto) FILTER (reply), 0) AS BIGINT) AS expanded_chars
FROM ordered GROUP BY conv_id
"""
