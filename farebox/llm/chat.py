"""Preference examples: a shared prompt and two masked completions, in DataFrame operations only.

A pair names a chosen and a rejected conversation. Their longest common prefix of turns (equal
role and text) is rendered once as the prompt; the turns behind it are the two completions. A
mask lists the character spans of a completion that are trained on: the text and end mark of
its assistant turns.

Defined results: turns stand by number, then role and text; nulls come first, a null role is
rendered as `user`, a null text as empty, and nulls equal each other. Fully repeated turns are kept. Marks that occur
in a text are broken by a backslash, so they cannot pose as marks. Pairs whose conversation is missing have an empty side;
pairs of equal conversations have two empty completions. Rows without conv_id take no part. An
example is one row, so a conversation must fit into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.llm.common import cut

START, END = "<|im_start|>", "<|im_end|>"
#: Openings shared by more than one in HOT of all conversations are paired by broadcast.
HOT = 1000


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as (role, text)."""
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("user")).alias("role"),
                   F.coalesce("text", F.lit("")).alias("text"))
    return (turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(row)).alias("turns"))
            .select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")))


def _safe(s: Column) -> Column:
    return F.replace(s, F.lit("<|"), F.lit("<\\|"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), _safe(turn["role"]), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(_safe(turn["text"]), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def mask(turns: Column) -> Column:
    """Spans [begin, end) of the rendered turns that are trained on."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(_head(t))
        end = begin + F.length(_body(t))
        span = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == "assistant", F.concat(state["spans"], span))
                        .otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, first, step, lambda s: s["spans"])


def preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per row of `pairs` (chosen_id, rejected_id): the shared turns, prompt, completions and masks."""
    convs = conversations(turns)
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = (pairs.join(convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("c")), "chosen_id", "left")
            .join(convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("r")), "rejected_id", "left")
            .withColumns({"c": F.coalesce("c", none), "r": F.coalesce("r", none)}))
    differs = F.filter(F.zip_with(F.transform("c", lambda t, i: F.struct(i.alias("i"), t.alias("t"))), F.col("r"),
                                  lambda x, y: F.when(x["t"].eqNullSafe(y), F.lit(None)).otherwise(x["i"])), lambda i: i.isNotNull())
    short = F.least(F.size("c"), F.size("r"))
    both = both.withColumn("n", F.least(short, F.coalesce(F.get(differs, F.lit(0)), short)))
    rest = {x: F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0))) for x in ("c", "r")}
    both = both.withColumns({"p": F.slice("c", F.lit(1), F.col("n")), "cc": rest["c"], "rr": rest["r"]})
    return both.select("chosen_id", "rejected_id", F.col("n").alias("shared_turns"), render(F.col("p")).alias("prompt"),
                       render(F.col("cc")).alias("chosen"), mask(F.col("cc")).alias("chosen_mask"),
                       render(F.col("rr")).alias("rejected"), mask(F.col("rr")).alias("rejected_mask"))


def corpus_pairs(turns: DataFrame) -> DataFrame:
    """Pairs for a corpus without preferences: conversations with equal openings, and neighbours by number.

    Of the conversations that share their first turn the one with the smallest conv_id is
    preferred to each other one; and conversation 2k is preferred to 2k + 1. A conv_id that is
    no whole number has no neighbours.

    Openings with more than one in `HOT` of all conversations, fewer than `HOT` of them, meet their conversations by
    broadcast; only the others are shuffled by opening.
    """
    first = (turns.where("conv_id is not null").groupBy("conv_id")
             .agg(F.min(F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"),
                                 F.coalesce("text", F.lit("")).alias("text"))).alias("t"))
             .select("conv_id", F.sha2(F.concat_ws("\n", "t.role", "t.text"), 256).alias("opening")))
    first = cut(first, "openings")
    leader = first.groupBy("opening").agg(F.min("conv_id").alias("chosen_id"), F.count("*").alias("n")).where("n > 1")
    many = F.col("n") > first.count() // HOT
    hot = F.broadcast(cut(leader.where(many), "hot-openings"))  # fewer than HOT rows
    rest = first.join(hot, "opening", "left_anti").join(leader.where(~many), "opening")
    opened = (first.join(hot, "opening").unionByName(rest).where("conv_id > chosen_id")
              .select("chosen_id", F.col("conv_id").alias("rejected_id")))
    number = F.col("conv_id").try_cast("long")
    beside = (first.withColumn("number", number).where("number is not null").groupBy(F.col("number") - F.pmod("number", F.lit(2)))
              .agg(F.min_by("conv_id", "number").alias("chosen_id"), F.max_by("conv_id", "number").alias("rejected_id"),
                   F.count("*").alias("n"), F.countDistinct("number").alias("m"))
              .where("n = 2 and m = 2").select("chosen_id", "rejected_id"))
    return opened.union(beside).distinct()
