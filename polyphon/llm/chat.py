"""Chat formatting with DataFrame expressions only.

Turns are collected per conversation, sorted, adjacent turns of one role are
merged, and the merged turns are written with control strings around them:

    <|im_start|>role NEWLINE text <|im_sep|> text <|im_end|> NEWLINE

Inside roles and texts a backslash becomes two and ``<|`` becomes ``<\\|``; in
roles a line feed becomes ``\\n``. So no control string can come from a text,
and every turn can be read back exactly.

Edge cases: null roles and texts are empty; turns with the same number are
ordered by role, then text; repeated rows are turns of their own; rows with a
null conversation form one conversation; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Undo ``escape_role``; the pairs of backslashes are cut out first, from the left."""
    pieces = F.split(role, r"\\\\")
    plain = F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")))
    return F.array_join(plain, "\\")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv``, ``formatted``, ``segments``, ``loss_spans``.

    ``segments`` cuts ``formatted`` into pieces with their mask: ``loss`` is true
    for the texts of ``trained_role`` and for nothing else. ``loss_spans`` has the
    same mask as code points, ends exclusive.
    """
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    starts = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.get(F.col("turns"), i - 1)["role"] != F.get(F.col("turns"), i - 2)["role"]),
    )
    chats = chats.withColumn("starts", starts)
    merged = F.transform(
        "starts",
        lambda s, i: F.struct(
            F.get(F.col("turns"), s - 1)["role"].alias("role"),
            F.transform(
                F.slice("turns", s, F.coalesce(F.get(F.col("starts"), i + 1), F.size("turns") + 1) - s), lambda t: t["text"]
            ).alias("texts"),
        ),
    )
    chats = chats.withColumn("merged", merged)

    def segment(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    def written(m: Column) -> Column:
        head = F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n"))
        texts = F.transform(
            m["texts"],
            lambda t, i: F.array(
                segment(F.when(i == 0, head).otherwise(F.lit(SEP)), F.lit(False)), segment(escape(t), m["role"] == F.lit(trained_role))
            ),
        )
        return F.concat(F.flatten(texts), F.array(segment(F.lit(END + "\n"), F.lit(False))))

    chats = chats.select("conv", F.flatten(F.transform("merged", written)).alias("segments"))
    spans = F.aggregate(
        "segments",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + F.length(s["text"])).alias("at"),
            F.when(
                s["loss"],
                F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(s["text"])).alias("end")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )["spans"]
    return chats.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        spans.alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    blocks = F.split(formatted, r"<\|im_end\|>\n")
    blocks = F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), lambda b: F.substring(b, F.lit(len(START) + 1), F.length(b)))

    def turns_of(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        texts = F.split(F.substring(block, F.length(head) + 2, F.length(block)), r"<\|im_sep\|>")
        return F.transform(texts, lambda t: F.struct(unescape_role(head).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))
