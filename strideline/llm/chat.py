"""Chat formatting: event-sourced reconstruction of conversations.

A log holds events of messages: ``message`` sets role and text, ``delta`` appends a
streamed piece, ``edit`` replaces the text, ``regenerate`` starts the text anew.
The log is dealt by conversation and sorted by sequence; per message the events
after its last ``message``, ``edit`` or ``regenerate`` are folded into the final
text, and the messages, by their first event, are rendered.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside role and text ``\\`` becomes
``\\s`` and ``<|`` becomes ``<\\p``, so no text can hold a control string, and the two
replacements are undone exactly.

Defined results: null text and null role are empty; null conversations form one
conversation of their own; a null sequence sorts first; events alike in all columns
all count; a delta without an earlier event starts a message; messages with one first
sequence go by their other columns; a very long text is rendered whole; extra columns take no
part, so their names cannot clash; an empty table gives no rows. A conversation is one output
row, so it has to fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\p"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\s"), F.lit("\\"))


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def _unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\n"), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, seq of the first event, role and text of every message.

    ``events``: conv_id, seq, kind, msg_id, role, text. One shuffle, by conversation.
    """
    e = events.select(
        "conv_id",
        "seq",
        F.coalesce("kind", F.lit("message")).alias("kind"),
        "msg_id",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).repartition("conv_id")
    own = Window.partitionBy("conv_id", "msg_id").orderBy("seq", "kind", "text")
    e = e.withColumn("epoch", F.sum(F.when(F.col("kind") == "delta", 0).otherwise(1)).over(own))
    e = e.withColumn("last", F.max("epoch").over(Window.partitionBy("conv_id", "msg_id")))
    return e.groupBy("conv_id", "msg_id").agg(
        F.min("seq").alias("seq"),
        F.min_by("role", F.struct("seq", "kind", "text")).alias("role"),
        F.array_join(
            F.transform(
                F.sort_array(
                    F.collect_list(
                        F.when(
                            (F.col("epoch") == F.col("last")) & (F.col("kind") != "regenerate"),
                            F.struct("seq", "kind", "text"),
                        )
                    )
                ),
                lambda x: x["text"],
            ),
            "",
        ).alias("text"),
    )


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: the rendered conversation and its loss mask.

    ``messages``: conv_id, seq, role, text. A span is (start, length) in code points
    of an escaped text of ``trained_role`` inside ``formatted``.
    """
    m = messages.select("conv_id", "seq", "msg_id", "role", escaped(F.col("text")).alias("body")).withColumn(
        "head", F.concat(F.lit(START), _escaped_role(F.col("role")), F.lit("\n"))
    )
    m = m.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy("seq", "msg_id")
    before = F.coalesce(F.sum(F.length("piece").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = m.withColumn("start", before + F.length("head"))
    span = F.struct(F.col("start"), F.length("body").cast("bigint").alias("length"))
    return (
        m.groupBy("conv_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("pieces"),
            F.sort_array(F.collect_list(F.when(F.col("role") == trained_role, span))).alias("loss_spans"),
        )
        .select("conv_id", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"), "loss_spans")
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``: array of (role, text) read back from ``formatted``."""
    parts = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda x: x != "")

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        body = F.substr(x, F.length(role) + 2, F.length(x) - F.length(role) - 1 - len(END) - 1)
        return F.struct(_unescaped_role(role).alias("role"), unescaped(body).alias("text"))

    return formatted.withColumn("turns", F.transform(parts, turn))


def rows_as_events(rows: DataFrame) -> DataFrame:
    """Events of finished messages: one ``message`` event a row, in the order of ``turn``.

    Rows with equal turns follow each other by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.withColumn("seq", F.row_number().over(order).cast("bigint")).select(
        "conv_id", "seq", F.lit("message").alias("kind"), F.col("seq").alias("msg_id"), "role", "text"
    )
