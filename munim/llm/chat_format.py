"""Chat formatting with column expressions only, and reading it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from munim.functions.binding import let

START, MESSAGE, NEXT, END = "<|start|>", "<|message|>", "<|next|>", "<|end|>"


def escape(text: Column) -> Column:
    r"""Keep ``<|`` out of a text: ``<``, any backslashes, ``|`` get one more backslash."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    """Undo ``escape``."""
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def format_chats(
    rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", trained: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``id_col``, messages, formatted, loss_spans.

    Turns are sorted by turn (null first), then role and text; repeated rows are turns of their
    own; null roles and texts are empty; rows with a null id form one conversation.  Adjacent
    turns of one role merge into one message, whose texts stay apart by a mark of their own::

        <|start|>role<|message|>text<|next|>text<|end|>

    ``<|`` inside roles and texts is escaped, so marks cannot be forged and the output can be
    read back exactly.  ``loss_spans`` are (start, length) in code points of ``formatted``, one
    for each text of role ``trained``.  Other columns are not carried.  A conversation is one
    output row and has to fit into one, as any result of this shape has to.
    """
    order = W.partitionBy("_id").orderBy("turn", "role", "text")
    other = lambda shifted: ~shifted.over(order).eqNullSafe(F.col("role"))
    turns = rows.select(
        F.col(id_col).alias("_id"), F.col(turn_col).alias("turn"), _text(F.col(role_col)).alias("role"),
        _text(F.col(text_col)).alias("text"),
    ).select(
        "*", F.row_number().over(order).alias("n"), other(F.lag("role")).alias("first"),
        other(F.lead("role")).alias("last"),
    ).select(
        "*", F.length(escape(F.col("text"))).cast("long").alias("length"),
        F.when(F.col("last"), len(END)).otherwise(0).alias("_behind"),
        F.when(F.col("first"), len(START) + F.length(escape(F.col("role"))) + len(MESSAGE))
        .otherwise(len(NEXT)).alias("_before"))
    # Places of the texts are running sums over the sorted rows, not a fold over the array.
    so_far = F.sum(F.col("_before") + F.col("length") + F.col("_behind")).over(
        order.rowsBetween(W.unboundedPreceding, W.currentRow))
    turns = turns.withColumn("start", so_far - F.col("_behind") - F.col("length")).groupBy("_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "role", "text", "first", "last", "start", "length")))
        .alias("_turns"))
    starts = F.filter(F.sequence(F.lit(1), F.size("_turns")), lambda i: F.get("_turns", i - 1)["first"])
    turns = turns.withColumn("_starts", starts)

    def message(first: Column, k: Column) -> Column:
        after = F.coalesce(F.get("_starts", k + 1), F.size("_turns") + 1)
        part = F.slice("_turns", first, after - first)
        return F.struct(F.get("_turns", first - 1)["role"].alias("role"),
                        F.transform(part, lambda t: t["text"]).alias("texts"))

    def shown(t: Column) -> Column:
        head = F.concat(F.lit(START), escape(t["role"]), F.lit(MESSAGE))
        return F.concat(F.when(t["first"], head).otherwise(NEXT), escape(t["text"]),
                        F.when(t["last"], END).otherwise(""))

    return turns.select(
        F.col("_id").alias(id_col), F.transform("_starts", message).alias("messages"),
        F.array_join(F.transform("_turns", shown), "").alias("formatted"),
        F.transform(F.filter("_turns", lambda t: t["role"] == trained),
                    lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
        .alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, as they were before merging."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        mark = F.instr(block, MESSAGE)
        role = unescape(F.substring(block, F.lit(len(START) + 1), mark - 1 - len(START)))
        body = F.substring(block, mark + len(MESSAGE), F.length(block))
        return F.transform(F.split(body, r"<\|next\|>"),
                           lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between.

    The text is cut as four bytes per code point, where a place is found without counting from
    the start.
    """
    mark = F.unhex(F.lit("0000FEFF"))  # the byte order mark that decoding takes away

    def cut(data: Column) -> Column:
        return F.transform(spans, lambda s: unescape(F.decode(F.concat(mark, F.substring(
            data, (4 * s["start"] + 1).cast("int"), (4 * s["length"]).cast("int"))), "UTF-32")))

    return F.array_join(let(F.encode(formatted, "UTF-32"), cut), "")
