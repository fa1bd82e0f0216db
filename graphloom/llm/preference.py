"""Preference formatting of chosen and rejected conversations, turn by turn.

Both sides are tables of turns. A pair's prompt is the longest common prefix of its turns;
it is rendered once. The turns after it are rendered for each side as a completion, and
only what the assistant says there is to be learnt from. Everything stays in rows of
turns: no conversation, however long, is gathered into one row or task. The prefix is
found by a join on (pair, turn) and a minimum per pair, which tasks reduce before the
shuffle.

Turns are numbered from 0 within a pair by their ``turn`` value, which must be unique in a
conversation; two turns are equal if role and text are. Defined results: null roles or
texts are rendered as empty and are equal to each other only; a pair that lacks one side
has no prompt; equal sides have a prompt only; repeated rows of one turn count once, the
smallest (role, text) of them; rows without a pair or turn are left out; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered: before and after its text.
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


def rendered(role: Column, text: Column) -> Column:
    """One turn as text."""
    before, after = OPEN.split("{role}")
    return F.concat(F.lit(before), F.coalesce(role, F.lit("")), F.lit(after), F.coalesce(text, F.lit("")), F.lit("\n" + CLOSE))


def _turns(side: DataFrame, pair_col: str) -> DataFrame:
    kept = side.where(F.col(pair_col).isNotNull() & F.col("turn").isNotNull())
    return kept.groupBy(F.col(pair_col).alias("pair_id"), "turn").agg(F.min(F.struct("role", "text")).alias("said"))


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id", learner: str = "assistant") -> DataFrame:
    """``(pair_id, part, turn, role, rendered, learn, n_chars)`` for every turn of every pair.

    ``part`` is ``prompt``, ``chosen`` or ``rejected``; concatenating ``rendered`` of a
    part by ``turn`` gives its text. ``learn`` masks: it is true for turns of ``learner``
    in a completion.
    """
    both = _turns(chosen, pair_col).withColumnRenamed("said", "c").join(_turns(rejected, pair_col).withColumnRenamed("said", "r"), ["pair_id", "turn"], "full_outer")
    same = F.col("c").isNotNull() & F.col("r").isNotNull() & F.col("c.role").eqNullSafe(F.col("r.role")) & F.col("c.text").eqNullSafe(F.col("r.text"))
    first = both.where(~same).groupBy("pair_id").agg(F.min("turn").alias("split"))
    both = both.join(first, "pair_id", "left").withColumn("common", F.col("split").isNull() | (F.col("turn") < F.col("split")))
    part = lambda name, said: F.struct(F.lit(name).alias("part"), F.col(said).alias("said"))
    parts = F.when(F.col("common"), F.array(part("prompt", "c"))).otherwise(F.array(part("chosen", "c"), part("rejected", "r")))
    rows = both.select("pair_id", "turn", F.inline(parts)).where("said is not null")
    text = rendered(F.col("said.role"), F.col("said.text"))
    learn = (F.col("part") != "prompt") & F.coalesce(F.col("said.role") == learner, F.lit(False))
    return rows.select("pair_id", "part", "turn", F.col("said.role").alias("role"), text.alias("rendered"), learn.alias("learn"), F.length(text).cast("long").alias("n_chars"))


def stale_reply_pairs(turns: DataFrame, learner: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from plain conversations with two replies or more.

    The rejected side answers last as it answered first: the last reply's text is replaced
    by that of the first reply. Turns after the last reply are left out on both sides.
    """
    said = turns.where((F.col("role") == learner) & F.col("turn").isNotNull())
    ends = said.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.min_by("text", F.struct("turn", "text")).alias("early")).where("first < last")
    kept = turns.join(ends, "conv_id").where(F.col("turn") <= F.col("last")).withColumnRenamed("conv_id", "pair_id")
    chosen = kept.select("pair_id", "turn", "role", "text")
    swapped = F.when((F.col("turn") == F.col("last")) & (F.col("role") == learner), F.col("early")).otherwise(F.col("text"))
    return chosen, kept.select("pair_id", "turn", "role", swapped.alias("text"))
