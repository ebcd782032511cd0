"""Preference formatting with DataFrame functions only: the longest common turn prefix of two conversations is rendered once as
the prompt, and what follows on either side becomes a masked completion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.store import kept

# The marks of the chat format.
START, END = "<|im_start|>", "<|im_end|>\n"


def conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, turns (array of role and text, in turn order).

    Rows of equal turn number are ordered by role and text, and full repeats count once. A null role reads ``user``, a null
    text is empty, null turn numbers come first, and rows with a null conversation id form one conversation.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("user")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    grouped = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_set(row)).alias("rows"))
    return grouped.select("conv_id", F.expr("transform(rows, r -> named_struct('role', r.role, 'text', r.text))").alias("turns"))


def paired(convs: DataFrame) -> DataFrame:
    """Every conversation (conv_id, turns) with the one it is compared to: chosen_id, chosen (turns).

    Conversations that open with the same turn answer the same request; the one of the smallest id is the chosen one
    and each other one a rejected one, so a group of n gives n - 1 pairs. The chosen one itself, and a conversation whose
    opening turn is its own, has chosen_id = conv_id.
    """
    keyed = kept(convs.withColumn("opening", F.md5(F.concat_ws("\0", F.expr("turns[0].role"), F.expr("turns[0].text")))), "conversations")
    first = keyed.groupBy("opening").agg(F.min("conv_id").alias("chosen_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("opening", "chosen_id")
    lead = keyed.join(first, "opening").where("conv_id = chosen_id").select("opening", "chosen_id", F.col("turns").alias("chosen"))
    lead = kept(lead, "leads")
    out = keyed.join(lead, "opening", "left")
    own = F.col("chosen_id").isNull()
    return out.select("conv_id", "turns", F.when(own, F.col("conv_id")).otherwise(F.col("chosen_id")).alias("chosen_id"), F.when(own, F.col("turns")).otherwise(F.col("chosen")).alias("chosen"))


def _rendered(turns: str) -> str:
    return f"array_join(transform({turns}, t -> concat('{START}', t.role, '\\n', t.text, '{END}')), '')".replace("\n", "\\n")


def _mask(turns: str) -> str:
    """Spans ``start-end`` of the characters to train on: text and end mark of the assistant's turns."""
    head, tail = len(START) + 1, len(END)
    return (
        f"aggregate({turns}, named_struct('at', 0, 'spans', cast(array() as array<string>)), (s, t) -> named_struct("
        f"'at', s.at + {head + tail} + char_length(t.role) + char_length(t.text), "
        f"'spans', if(t.role = 'assistant', array_append(s.spans, concat(s.at + {head} + char_length(t.role), '-', s.at + {head + tail} + char_length(t.role) + char_length(t.text))), s.spans)), "
        "s -> array_join(s.spans, ','))"
    )


def formatted(pairs: DataFrame) -> DataFrame:
    """One row per row of ``paired``: conv_id, chosen_id, rejected_id, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask.

    n_common is the number of leading turns that both conversations share; they are the prompt. Completions are the
    rest of each; a mask lists the spans of characters of its completion that are to be trained on (the assistant's), as
    ``start-end`` joined by commas. A conversation without a partner has null rejected columns, and its completion begins
    at its last assistant turn (without one, all is prompt). Of equal conversations both completions are empty.
    """
    alone = F.col("conv_id").eqNullSafe(F.col("chosen_id"))
    common = F.expr("coalesce(nullif(array_position(zip_with(chosen, turns, (a, b) -> coalesce(a.role <=> b.role and a.text <=> b.text and a is not null and b is not null, false)), false), 0) - 1, size(chosen))")
    last = F.expr("coalesce(nullif(array_position(transform(reverse(turns), t -> t.role = 'assistant'), true), 0), 0)")
    n = F.when(alone, F.size("turns") - last).otherwise(common).cast("long")
    cut = pairs.select("conv_id", "chosen_id", alone.alias("alone"), n.alias("n_common"), F.col("chosen").alias("c"), F.col("turns").alias("r"))
    rest = lambda x: f"slice({x}, cast(n_common as int) + 1, greatest(0, size({x}) - cast(n_common as int)))"
    other = lambda x: F.expr(f"if(alone, null, {x})")
    return cut.select(
        "conv_id", "chosen_id", other("conv_id").alias("rejected_id"), "n_common",
        F.expr(_rendered("slice(c, 1, cast(n_common as int))")).alias("prompt"),
        F.expr(_rendered(rest("c"))).alias("chosen"), F.expr(_mask(rest("c"))).alias("chosen_mask"),
        other(_rendered(rest("r"))).alias("rejected"), other(_mask(rest("r"))).alias("rejected_mask"),
    )


def segments(text: Column, mask: Column) -> Column:
    """A completion's text cut at its mask: array of (text, train), for callers that tokenize piecewise."""
    spans = F.filter(F.split(mask, ","), lambda s: s != "")
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,train:boolean>>").alias("out"))

    def add(state: Column, span: Column) -> Column:
        a, b = F.split(span, "-")[0].cast("int"), F.split(span, "-")[1].cast("int")
        piece = lambda x, y, train: F.struct(F.substring(text, x + 1, y - x).alias("text"), F.lit(train).alias("train"))
        return F.struct(b.alias("at"), F.concat(state["out"], F.array(piece(state["at"], a, False), piece(a, b, True))).alias("out"))

    def end(state: Column) -> Column:
        left = F.struct(F.substring(text, state["at"] + 1, F.char_length(text)).alias("text"), F.lit(False).alias("train"))
        return F.filter(F.concat(state["out"], F.array(left)), lambda x: x["text"] != "")

    return F.aggregate(spans, empty, add, end)
