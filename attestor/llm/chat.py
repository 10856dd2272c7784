"""Chat transcripts from event logs, folded and rendered with DataFrame functions alone.

Events of a conversation carry a sequence number. ``open`` begins a message, ``delta`` adds a
piece of text to it, ``edit`` replaces all of its text so far, ``regenerate`` throws that text
away. The fold needs no state: what counts of a message is its last edit and the deltas after
its last edit or regeneration.

The template writes a message as ``<turn role>text</turn>`` and a line end. Inside roles and
texts a backslash becomes ``\\b``, ``<`` becomes ``\\l`` and ``>`` becomes ``\\g``, so that no
text can contain a control string, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the escapes, and the marks of a turn
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
OPEN, OPENED, CLOSE = "<turn ", ">", "</turn>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, message, seq, role, text): the final messages of event logs.

    ``events`` has conv_id, message, seq, kind, role and text. The messages of a conversation are
    folded apart from each other, so one with very many events is spread over tasks. A null text
    is empty, a null role too; an event of another kind changes nothing. A message that was never
    opened is left out. Events with equal seq are ordered by kind and text.
    """
    reset = F.col("kind").isin("edit", "regenerate")
    where = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))
    folded = events.groupBy("conv_id", "message").agg(
        F.min(F.when(F.col("kind") == "open", F.col("seq"))).alias("seq"),
        F.min_by(F.coalesce("role", F.lit("")), F.when(F.col("kind") == "open", F.col("seq"))).alias("role"),
        F.max(F.when(reset, where)).alias("last"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "delta", where))).alias("deltas"))
    after = F.filter("deltas", lambda d: F.col("last").isNull() | (d["seq"] > F.col("last")["seq"]))
    base = F.when(F.col("last")["kind"] == "edit", F.col("last")["text"]).otherwise(F.lit(""))
    text = F.concat(base, F.array_join(F.transform(after, lambda d: d["text"]), ""))
    return folded.filter("seq IS NOT NULL").select("conv_id", "message", "seq", "role", text.alias("text"))


def render(messages: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, formatted, mask): the rendered conversation and the spans that count for the loss.

    Messages are ordered by seq; messages with equal seq by role, text and name.
    A span is (start, length) in code points of ``formatted``, start from 0, and covers the escaped
    text of one message of ``loss_role``. A conversation is one text and so is held by one task.
    """
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text", "message")
    pieces = (messages.select("conv_id", "seq", "message", "role", "text",
                              F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(OPENED)).alias("head"),
                              escape(F.col("text")).alias("body"))
              .withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
              .withColumn("before", F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    one = F.struct("before", "piece", (F.col("before") + F.length("head")).alias("start"),
                   F.length("body").alias("length"), (F.col("role") == loss_role).alias("counts"))
    turns = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    mask = F.transform(F.filter("turns", lambda t: t["counts"]), lambda t: F.struct(t["start"], t["length"]))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), mask.alias("mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted): roles and texts again, and the unescaped text under the mask."""
    parts = F.slice(F.split("formatted", CLOSE), 1, F.size(F.split("formatted", CLOSE)) - 1)
    turns = F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(OPEN) + 1, F.length(p)), OPENED, 1)).alias("role"),
        unescape(F.substring_index(p, OPENED, -1)).alias("text")))
    loss = F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"].cast("int") + 1, m["length"])))
    return rendered.select("conv_id", turns.alias("turns"), F.array_join(loss, "").alias("loss"), "formatted")


def row_events(rows: DataFrame, piece: int = 64) -> DataFrame:
    """An event log of stored conversation rows: each row a message that was streamed in.

    The message opens, streams the first ``piece`` characters as a draft, is regenerated, and then
    streams its text in pieces; its sequence numbers are (turn, step). Repeated rows are messages
    of their own. Rows with a null turn come first.
    """
    named = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("whole"),
                        F.monotonically_increasing_id().alias("message"))
    events = F.concat(
        F.array(F.struct(F.lit("open").alias("kind"), F.lit("").alias("text")),
                F.struct(F.lit("delta").alias("kind"), F.substring("whole", 1, piece).alias("text")),
                F.struct(F.lit("regenerate").alias("kind"), F.lit("").alias("text"))),
        F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("whole") - 1, F.lit(0)) / piece).cast("int")),
                    lambda i: F.struct(F.lit("delta").alias("kind"), F.substring(F.col("whole"), i * piece + 1, F.lit(piece)).alias("text"))))
    return (named.select("conv_id", "turn", "message", "role", F.posexplode(events).alias("step", "event"))
            .select("conv_id", "message", F.struct("turn", "step").alias("seq"), F.col("event.kind").alias("kind"), "role", F.col("event.text").alias("text")))


def digest(rows: DataFrame) -> DataFrame:
    """Per conversation what the rendered text holds, read back from it."""
    final = reconstruct(row_events(rows.select("conv_id", "turn", "role", "text")))
    back = read_back(render(final))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                       F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
                       F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"))
