"""Prefix-target expansion of chats: every assistant turn becomes an example of its own.

A conversation is laid out once with the template ``[INST]role[/INST]text</s>`` per turn. An example
is the part of that layout up to the end of one assistant turn; only that reply is trainable. It is
held as offsets into the layout (``context``: all before ``target_start``), so a conversation of n
turns takes space for n turns and not for n * n; ``expand`` cuts the example texts out where a
trainer wants rows.

Control strings inside roles and texts are escaped reversibly: ``~`` to ``~0``, then the three
markers to ``~1`` to ``~3``. No marker can then arise inside a text, nor across its end.

Defined cases: a null text or role counts as empty; rows of a conversation are ordered by turn (null
first), then role, then text; repeated rows stay as turns of their own; a null conv_id is one
conversation; a conversation without assistant turns has a layout and no example; an empty table
gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
_ESCAPES = (("~", "~0"), (END, "~1"), (OPEN, "~2"), (CLOSE, "~3"))


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    for old, new in _ESCAPES:
        c = _replace(c, old, new)
    return c


def unescape(c: Column) -> Column:
    for old, new in reversed(_ESCAPES):
        c = _replace(c, new, old)
    return c


def layout(conversations: DataFrame, trainable: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``examples``.

    ``examples`` is an array of ``(turn_no, target_start, target_end)``, in turn order; offsets are
    code points into ``formatted``, end exclusive. One shuffle: the running offsets and the layout
    use the same grouping.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select(
        "conv_id",
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.concat(F.lit(OPEN), escape(role), F.lit(CLOSE)).alias("_head"),
        escape(text).alias("_body"),
    )
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    length = (F.length("_head") + F.length("_body") + len(END)).cast("long")
    placed = rows.select(
        "conv_id",
        F.row_number().over(before).alias("turn_no"),
        (F.col("role") == trainable).alias("_target"),
        F.concat("_head", "_body", F.lit(END)).alias("_piece"),
        (F.sum(length).over(before.rowsBetween(Window.unboundedPreceding, 0)) - length + F.length("_head")).alias("_start"),
        F.length("_body").cast("long").alias("_length"),
    )
    turns = F.array_sort(F.collect_list(F.struct("turn_no", "_target", "_piece", "_start", "_length")))
    grouped = placed.groupBy("conv_id").agg(turns.alias("_turns"))
    targets = F.filter("_turns", lambda t: t["_target"])
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("_turns", lambda t: t["_piece"]), "").alias("formatted"),
        F.transform(
            targets,
            lambda t: F.struct(
                t["turn_no"].alias("turn_no"),
                t["_start"].alias("target_start"),
                (t["_start"] + t["_length"]).alias("target_end"),
            ),
        ).alias("examples"),
    )


def cut_out(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def expand(laid_out: DataFrame, outer: bool = False) -> DataFrame:
    """One row per example: ``conv_id, turn_no, context, target``; text of the template, still escaped.

    ``context + target`` is what a model reads, and the loss mask is the target alone. Further columns of the
    layouts are repeated. With ``outer``, a conversation without an example gives one row, without a turn.
    """
    more = [c for c in laid_out.columns if c not in ("conv_id", "formatted", "examples")]
    one_each = F.explode_outer if outer else F.explode
    each = laid_out.select("conv_id", "formatted", *more, one_each("examples").alias("_example"))
    start, end = F.col("_example.target_start"), F.col("_example.target_end")
    return each.select(
        "conv_id",
        F.col("_example.turn_no").alias("turn_no"),
        cut_out(F.col("formatted"), F.lit(0), start).alias("context"),
        cut_out(F.col("formatted"), start, end).alias("target"),
        *more,
    )


def turns_of(formatted: Column) -> Column:
    """The turns of a layout: array of ``(role, text)``, unescaped."""
    pieces = F.split(formatted, END)
    return F.transform(
        F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 2**31 - 1), CLOSE, 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, CLOSE) + len(CLOSE), 2**31 - 1)).alias("text"),
        ),
    )


def digest(laid_out: DataFrame) -> DataFrame:
    """What the output holds, read back from it: turns from the layouts, the loss from the rows of ``expand``.

    Examples of a conversation are where their layout is, so putting them together again takes no shuffle.
    """
    said = F.transform(turns_of(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = laid_out.withColumn("_said", said)
    read = read.select(
        "conv_id",
        "formatted",
        "examples",
        F.size("_said").cast("long").alias("n_turns"),
        F.sha2(F.array_join("_said", ""), 256).alias("turns_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    own = ["conv_id", "n_turns", "turns_sha256", "formatted_chars"]
    example = F.when(F.col("turn_no").isNotNull(), F.struct("turn_no", unescape(F.col("target")).alias("target")))
    examples = expand(read, outer=True).groupBy(*own).agg(F.array_sort(F.collect_list(example)).alias("_examples"))
    loss = F.array_join(F.transform("_examples", lambda e: e["target"]), "")
    return examples.withColumn("_loss", loss).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        "formatted_chars",
        F.size("_examples").cast("long").alias("n_examples"),
    )
