"""Conversations and clean-up of model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import extract_citations, snippet, strip_citations


def prior_turns(turns: DataFrame, last: int = 4, include_current: bool = False) -> DataFrame:
    """``(conv_id, turn, context)``: the ``last`` turns before each one, those with errors or no text removed after the cut.

    Citations are taken out of what the assistant said. ``include_current`` counts the turn itself
    among the last ones. An optional column ``error`` marks failed turns.
    """
    frame = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(*((1 - last, 0) if include_current else (-last, -1)))
    failed = F.coalesce("error", F.lit("")) != "" if "error" in turns.columns else F.lit(False)
    said = F.when(F.col("role") == "assistant", F.trim(strip_citations(F.col("text")))).otherwise(F.col("text"))
    seen = F.collect_list(F.struct("role", said.alias("text"), (failed | (F.coalesce("text", F.lit("")) == "")).alias("gone"))).over(frame)
    kept = F.transform(F.filter(seen, lambda t: ~t["gone"]), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns.select("conv_id", "turn", kept.alias("context"))


def build_prompts(turns: DataFrame, sections: DataFrame | None = None, closing: str = "Use the tools to find relevant nodes, then answer with inline [<node-id>] citations.") -> DataFrame:
    """``(conv_id, turn, prompt)`` of every user turn: the conversation so far, the question, and a closing line.

    ``sections`` (``conv_id, section``) puts a block on the section that is written in before it;
    see :func:`graphloom.functions.text.section_context`.
    """
    context = prior_turns(turns).join(turns.where("role = 'user'").select("conv_id", "turn", "text"), ["conv_id", "turn"])
    line = lambda t: F.concat(F.when(t["role"] == "user", "User: ").otherwise("Assistant: "), t["text"])
    so_far = F.array_join(F.transform("context", line), "\n\n")
    prompt = F.concat(F.when(F.size("context") > 0, F.concat(F.lit("Prior conversation:\n"), so_far, F.lit("\n\n"))).otherwise(""), F.lit("Current question:\n"), F.coalesce("text", F.lit("")), F.lit("\n\n" + closing))
    if sections is not None:
        context = context.join(sections.select("conv_id", F.col("section").alias("_section")), "conv_id", "left")
        prompt = F.concat(F.when(F.col("_section") != "", F.concat("_section", F.lit("\n\n"))).otherwise(""), prompt)
    return context.select("conv_id", "turn", prompt.alias("prompt"))


def trim_history(turns: DataFrame, most: int = 3_000_000) -> DataFrame:
    """Turns that stay when the oldest go two by two while the rest is larger than ``most`` and more than two remain."""
    tail = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("_left", F.sum(F.length("text")).over(tail)).withColumn("_at", F.row_number().over(order) - 1)
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("conv_id")))
    # a cut may only fall on even places, and two turns stay at least
    fits = F.when((F.col("_at") % 2 == 0) & ((F.col("_left") <= most) | (F.col("_at") >= F.col("_n") - 2)), F.col("_at"))
    cut = F.min(fits).over(Window.partitionBy("conv_id"))
    return rows.withColumn("_cut", F.coalesce(cut, F.lit(0))).where("_at >= _cut").select("conv_id", "turn", "role", "text")


def first_seen(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cites(texts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, pos, cited_id)`` in the order first seen."""
    return texts.select(id_col, F.posexplode(extract_citations(F.col("text"))).alias("pos", "cited_id"))


def resolve_citations(texts: DataFrame, nodes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Cited nodes with title, type and snippet; unknown ids are dropped."""
    return cites(texts, id_col).join(nodes.select(F.col("id").alias("cited_id"), "title", "type", snippet(F.col("body_md")).alias("snippet")), "cited_id")


def gate_citations(texts: DataFrame, allowed: DataFrame, id_col: str = "doc_id", tools: bool = False) -> DataFrame:
    """``(id, cited_id, used)``: whether each cited id was among those supplied; all were where the model had tools to look."""
    if tools:
        return cites(texts, id_col).select(id_col, "cited_id", F.lit(True).alias("used"))
    ok = allowed.select(F.col("id").alias("cited_id"), F.lit(True).alias("used")).dropDuplicates(["cited_id"])
    return cites(texts, id_col).join(ok, "cited_id", "left").select(id_col, "cited_id", F.coalesce("used", F.lit(False)).alias("used"))


#: What the audit keeps of a call, by its name there.
AUDITED = {"command_id": "commandId", "has_selection": "hasSelection", "has_arg": "hasArg", "replace_selection": "replaceSelection", "n_citations": "citationCount", "duration_ms": "durationMs"}


def redact_audit(calls: DataFrame) -> DataFrame:
    """``(call_id, kind, body)``: a call's command, flags, counts and duration, never text; a missing flag is false."""
    flag = lambda c: F.coalesce(c, F.lit(False)) if c.startswith(("has_", "replace_")) else F.col(c)
    return calls.select("call_id", F.concat(F.lit("slash."), "command_id").alias("kind"), F.to_json(F.struct(*(flag(c).alias(n) for c, n in AUDITED.items()))).alias("body"))
