"""Preference formatting: a shared prompt and two masked completions.

A chosen and a rejected conversation are compared turn by turn; their longest
common prefix of turns is rendered once as the prompt, the rest of each as its
completion. The mask lists the character ranges of a completion that carry loss:
the contents and end marks of assistant turns. All of it is one grouping on the
pair and Catalyst expressions over its two turn arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the rendered template.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _render(turns: Column) -> Column:
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), ""
    )


def _mask(turns: Column) -> Column:
    """``start:end`` ranges, in code points of the rendered completion."""
    head = lambda t: F.lit(len(OPEN) + len(MIDDLE)) + F.length(t["role"])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + head(t)
        end = start + F.length(t["text"]) + F.lit(len(CLOSE))
        span = F.concat(start.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(
            end.alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(turns, zero, step, lambda acc: F.array_join(acc["spans"], ","))


def format_preferences(turns: DataFrame) -> DataFrame:
    """``(pair_id, chosen boolean, conv_id, turn, role, text)`` to one row per pair.

    Turns are ordered by ``turn`` (nulls first), then role, then text, so ties
    and repeated rows keep a fixed order and all stay. A null role is ``user``,
    a null text is empty. If one side is missing, its conversation id and
    completion are null and the prompt is empty. Equal conversations, or one
    that is a prefix of the other, leave an empty completion. Turns without a
    pair or side belong to no pair. Further columns of the input are ignored.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    side = lambda yes: F.array_sort(F.collect_list(F.when(F.col("chosen") if yes else ~F.col("chosen"), turn)))
    pairs = (
        turns.where("pair_id is not null and chosen is not null")
        .groupBy("pair_id")
        .agg(
            F.min(F.when(F.col("chosen"), F.col("conv_id"))).alias("chosen_conv"),
            F.min(F.when(~F.col("chosen"), F.col("conv_id"))).alias("rejected_conv"),
            side(True).alias("a"),
            side(False).alias("b"),
        )
    )
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    shared = F.coalesce(F.array_position(same, False) - 1, F.lit(0))
    pairs = pairs.withColumn(
        "n_prompt_turns",
        F.when(F.array_position(same, False) > 0, shared).otherwise(F.least(F.size("a"), F.size("b"))).cast("long"),
    )
    # zip_with pads the shorter side with nulls, which compare as different
    rest = lambda c: F.slice(c, F.col("n_prompt_turns").cast("int") + 1, F.size(c))
    full = lambda c, x: F.when(F.size(c) > 0, x)
    return pairs.select(
        "pair_id",
        "chosen_conv",
        "rejected_conv",
        "n_prompt_turns",
        _render(F.slice("a", 1, F.col("n_prompt_turns").cast("int"))).alias("prompt"),
        full("a", _render(rest("a"))).alias("chosen"),
        full("b", _render(rest("b"))).alias("rejected"),
        full("a", _mask(rest("a"))).alias("chosen_mask"),
        full("b", _mask(rest("b"))).alias("rejected_mask"),
    )


def pair_neighbours(conversations: DataFrame) -> DataFrame:
    """Conversations 2k (chosen) and 2k+1 (rejected) as pair k."""
    return conversations.select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"),
        (F.pmod(F.col("conv_id"), F.lit(2)) == 0).alias("chosen"),
        "conv_id",
        "turn",
        "role",
        "text",
    )
