"""Statechart corpora: many small transition texts in, tables of states and edges and listings out.

States are ``(doc_id, pos, name, title, role)`` in the order first named, edges
``(doc_id, pos, source, target, events, guards, kind, label)`` in the order of the text.
Charts made by hand may carry more: ``tabs`` of states, and ``message``, ``examples`` and
``scenario_override`` of edges.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import humanize, infer_kind, infer_role, split_label, stripped
from graphloom.session import reach_workers

#: Name of the one start state that a chart gets for its entries.
START = "__start__"
MESSAGE, EXAMPLES = "struct<text:string,verify:boolean>", "struct<headers:array<string>,rows:array<array<string>>>"


def import_transitions(charts: DataFrame) -> DataFrame:
    """``(doc_id, pos, source, target, label, is_start, is_end)`` of every transition line.

    Fences, headers, notes and the brackets of composite states are left out. A note lasts
    from a line that begins with ``note`` to the next ``end note``.
    """
    rows = charts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", stripped(F.col("line")))
    marks = F.when(F.col("line").rlike(r"^note\b"), True).when(F.col("line") == "end note", False)
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("in_note", F.coalesce(F.last(marks, ignorenulls=True).over(before), F.lit(False)))
    rows = rows.where(~F.col("in_note") & F.contains("line", F.lit("-->")) & ~F.col("line").rlike(r"^(```|state\b)"))
    part = lambda k: stripped(F.regexp_extract("line", r"^(.+?)-->\s*([^:]+?)\s*(?::\s*(.*))?$", k))
    rows = rows.select("doc_id", "pos", part(1).alias("source"), part(2).alias("target"), part(3).alias("label")).where("source <> '' and target <> ''")
    return rows.withColumn("is_start", F.col("source") == "[*]").withColumn("is_end", F.col("target") == "[*]")


def edges_of(transitions: DataFrame) -> DataFrame:
    """Transitions with events, guards, kind and label; each entry leads from the start state, the last one first."""
    rows = transitions.where("not is_start and not is_end").withColumn("parts", split_label(F.col("label")))
    events = F.col("parts.events")
    edges = rows.select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "source", "target", events.alias("events"), F.col("parts.guards").alias("guards"),
        infer_kind(F.col("source"), F.col("target"), events).alias("kind"), F.when(F.size(events) > 0, F.array_join(events, " / ")).otherwise(humanize(F.col("target"))).alias("label"),
    )
    entries = transitions.where("is_start").groupBy("doc_id", "target").agg(F.min("pos").alias("pos"))
    entries = entries.select(
        "doc_id", (-1 - F.col("pos")).cast("long").alias("pos"), F.lit(START).alias("source"), "target", F.array(F.lit("START")).alias("events"),
        F.array().cast("array<string>").alias("guards"), F.lit("forward").alias("kind"), F.lit("start").alias("label"),
    )
    return edges.unionByName(entries)


def states_of(transitions: DataFrame) -> DataFrame:
    """``(doc_id, pos, name, title, role)`` of every state in the order first named, the start state first."""
    ends = F.array(F.struct((F.col("pos") * 2).alias("at"), F.col("source").alias("name")), F.struct((F.col("pos") * 2 + 1).alias("at"), F.col("target").alias("name")))
    first = transitions.select("doc_id", F.inline(ends)).where("name <> '[*]'").groupBy("doc_id", "name").agg(F.min("at").alias("at"))
    named = first.select("doc_id", F.col("at").cast("long").alias("pos"), "name", humanize(F.col("name")).alias("title"), infer_role(F.col("name")).alias("role"))
    starts = transitions.select("doc_id").distinct().select("doc_id", F.lit(-1).cast("long").alias("pos"), F.lit(START).alias("name"), F.lit("Start").alias("title"), F.lit("start").alias("role"))
    return named.unionByName(starts)


def _dealt(df: DataFrame) -> DataFrame:
    """A side of a join that follows the charts. Names repeat so much that files of some MB hold a hundred times that in memory, and Spark would broadcast them."""
    return df.hint("merge")


def _optional(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def _trigger(label: Column) -> Column:
    """An edge's events, else its label, and its guards in brackets."""
    events = F.when(F.size("events") > 0, F.array_join("events", " / ")).when(label != "", label).otherwise("the action")
    guards = F.array_join(F.transform(F.coalesce("guards", F.array().cast("array<string>")), lambda g: F.concat(F.lit("["), g, F.lit("]"))), " ")
    return F.when(guards != "", F.concat(events, F.lit(" "), guards)).otherwise(events)


def scenarios(states: DataFrame, edges: DataFrame) -> DataFrame:
    """``(doc_id, group, pos, title, scenario)``: one scenario per edge, grouped by source in the order of the states.

    Start and transient states have none. An edge's own text wins over the made one; examples
    make an outline; a message is quoted below its scenario.
    """
    for name, kind in (("message", MESSAGE), ("examples", EXAMPLES), ("scenario_override", "string")):
        edges = _optional(edges, name, kind)
    source = states.where("role not in ('start', 'transient')").select("doc_id", F.col("name").alias("source"), F.col("pos").alias("state_pos"), F.col("title").alias("from_title"))
    target = states.select("doc_id", F.col("name").alias("target"), F.col("title").alias("to_title"))
    rows = edges.join(_dealt(source), ["doc_id", "source"]).join(_dealt(target), ["doc_id", "target"], "left").withColumn("to_title", F.coalesce("to_title", "from_title"))
    label = F.coalesce("label", F.lit(""))
    outline = F.coalesce(F.size("examples.rows") > 0, F.lit(False))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    then = F.when(F.col("kind") == "self", F.concat(F.lit("remains on "), quoted(F.col("from_title")))).when(F.col("kind") == "back", F.concat(F.lit("returns to "), quoted(F.col("to_title")))).otherwise(F.concat(F.lit("navigates to "), quoted(F.col("to_title"))))
    said = F.when(F.col("message.text") != "", F.concat(F.lit('"""\n'), F.col("message.text"), F.when(F.col("message.verify"), "\nTODO(verify)").otherwise(""), F.lit('\n"""')))
    cells = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    shown = F.when(outline, F.concat_ws("\n", F.lit("**Examples**"), cells(F.col("examples.headers")), F.array_join(F.transform("examples.rows", cells), "\n")))
    made = F.concat_ws(
        "\n", F.concat(F.when(outline, "**Scenario Outline**: ").otherwise("**Scenario**: "), F.when(label != "", label).otherwise(_trigger(label))),
        F.concat(F.lit("**Given** on "), quoted(F.col("from_title"))), F.concat(F.lit("**When** "), _trigger(label)), F.concat(F.lit("**Then** "), then), said, shown,
    )
    own = F.col("scenario_override")
    text = F.when(stripped(own) != "", F.regexp_replace(own, r"\n+$", "")).otherwise(made)
    rows = rows.withColumn("group", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("state_pos")))
    return rows.select("doc_id", "group", "pos", F.col("from_title").alias("title"), text.alias("scenario"))


def feature_text(states: DataFrame, edges: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """``(doc_id, text)``: the acceptance criteria of each chart; ``titles`` are ``(doc_id, title)``."""
    own = scenarios(states, edges).groupBy("doc_id", "group", "title").agg(F.array_sort(F.collect_list(F.struct("pos", "scenario"))).alias("held"))
    part = F.concat(F.lit("#### "), F.col("group").cast("string"), F.lit(". "), F.col("title"), F.lit("\n\n"), F.array_join(F.transform("held", lambda h: h["scenario"]), "\n\n"))
    parts = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("group", part.alias("text")))).alias("parts"))
    # the guards of the edges that leave the first start state
    starts = states.where("role = 'start'").groupBy("doc_id").agg(F.min_by("name", "pos").alias("source"))
    guards = edges.join(_dealt(starts), ["doc_id", "source"], "left_semi").select("doc_id", "pos", F.posexplode("guards").alias("k", "g"))
    guards = guards.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "k", "g"))).alias("guards"))
    rows = states.select("doc_id").distinct().join(_dealt(guards), "doc_id", "left").join(_dealt(parts), "doc_id", "left")
    rows = rows.join(_dealt(titles), "doc_id", "left") if titles is not None else rows.withColumn("title", F.lit(None).cast("string"))
    given = F.when(F.size("guards") > 0, F.array_join(F.transform("guards", lambda g: F.concat(F.lit("["), g["g"], F.lit("]"))), " and ")).otherwise("the flow is launched")
    body = F.array_join(F.transform(F.coalesce("parts", F.array().cast("array<struct<group:int,text:string>>")), lambda p: p["text"]), "\n\n")
    text = F.concat(F.lit("### Feature: "), F.coalesce("title", F.lit("Imported Flow")), F.lit("\n\n**Background:**\n**Given** "), given, F.when(body != "", F.concat(F.lit("\n\n"), body)).otherwise(""), F.lit("\n"))
    return rows.select("doc_id", text.alias("text"))


def integrity(states: DataFrame, edges: DataFrame) -> DataFrame:
    """``(doc_id, rule, severity, message)``: edges whose ends are missing or contradict their kind, and malformed scenarios."""
    names = states.select("doc_id", F.col("name").alias("of")).distinct()
    edge = F.concat(F.lit('edge "'), F.concat_ws(" --> ", "source", "target"), F.lit('"'))

    def missing(end: str) -> DataFrame:
        lost = edges.join(_dealt(names.withColumnRenamed("of", end)), ["doc_id", end], "left_anti")
        return lost.select("doc_id", F.lit("D2").alias("rule"), F.lit("error").alias("severity"), F.concat(edge, F.lit(f' references missing {end} node "'), F.col(end), F.lit('"')).alias("message"))

    odd = edges.where("kind = 'self' and source <> target").select("doc_id", F.lit("D2"), F.lit("warn"), F.concat(F.lit("self "), edge, F.lit(" has two ends")))
    # a made scenario is whole by construction, so only what authors wrote can fail; it is read with what it stands in
    parts = feature_text(states, edges).select("doc_id", F.explode(F.slice(F.split("text", r"(?m)^(?=\*\*Scenario(?: Outline)?\*\*:)"), F.lit(2), F.lit(1 << 30))).alias("s"))
    parts = parts.select("doc_id", F.split("s", r"(?m)^####\s")[0].alias("s"))
    title = stripped(F.substring(F.regexp_extract("s", r"^\*\*Scenario(?: Outline)?\*\*:\s*(.+)", 1), 1, 40))
    whole = F.contains("s", F.lit("**Given**")) & F.contains("s", F.lit("**When**")) & F.contains("s", F.lit("**Then**"))
    bare = F.col("s").startswith("**Scenario Outline**:") & ~F.contains("s", F.lit("**Examples**"))
    message = F.when(~whole, F.concat(F.lit('scenario "'), title, F.lit('" missing Given/When/Then'))).when(bare, F.concat(F.lit('scenario outline "'), title, F.lit('" has no Examples')))
    broken = parts.select("doc_id", F.lit("D4"), F.lit("error"), message.alias("message")).where("message is not null")
    return missing("source").union(missing("target")).union(odd).union(broken)


def export_transitions(states: DataFrame, edges: DataFrame) -> DataFrame:
    """``(doc_id, text)``: the listing of a chart: its entry, the pages of states with tabs, a line per edge between known states."""
    states = _optional(states, "tabs", "array<string>")
    names = states.select("doc_id", F.col("name").alias("of")).distinct()
    known = edges.join(_dealt(names.withColumnRenamed("of", "source")), ["doc_id", "source"], "left_semi").join(_dealt(names.withColumnRenamed("of", "target")), ["doc_id", "target"], "left_semi")
    guards = F.array_join(F.transform(F.coalesce("guards", F.array().cast("array<string>")), lambda g: F.concat(F.lit("["), g, F.lit("]"))), " ")
    label = F.concat_ws(" ", F.when(F.size("events") > 0, F.array_join("events", " / ")), F.when(guards != "", guards))
    line = F.concat(F.lit("  "), "source", F.lit(" --> "), "target", F.when(label != "", F.concat(F.lit(" : "), label)).otherwise(""))
    lines = known.select("doc_id", F.lit(2).alias("part"), "pos", line.alias("line"))
    # the first start state, or the first state where there is none
    first = states.groupBy("doc_id").agg(F.min_by("name", F.struct(F.when(F.col("role") == "start", 0).otherwise(1), F.col("pos"))).alias("name"))
    entry = first.select("doc_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), F.concat(F.lit("  [*] --> "), "name").alias("line"))
    turn = F.transform("tabs", lambda t, i: F.concat(F.lit("    "), t, F.lit(" --> "), F.element_at("tabs", F.pmod(i + 1, F.size("tabs")) + 1), F.lit(" : PAGE")))
    inner = F.concat(F.lit("  state "), "name", F.lit(" {\n    [*] --> "), F.col("tabs")[0], F.lit("\n"), F.array_join(turn, "\n"), F.lit("\n  }"))
    paged = states.where("size(tabs) > 0").select("doc_id", F.lit(1).alias("part"), "pos", inner.alias("line"))
    rows = lines.unionByName(entry).unionByName(paged).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "pos", "line"))).alias("held"))
    return rows.select("doc_id", F.concat(F.lit("stateDiagram-v2\n"), F.array_join(F.transform("held", lambda h: h["line"]), "\n")).alias("text"))


def _ranks(names: list[str], starts: set[str], edges: list[tuple[str, str]]) -> list[int]:
    """Layers of one chart: edges that close a cycle in a depth-first walk are left out, then longest paths."""
    after: dict[str, list[str]] = {n: [] for n in names}
    for s, t in edges:
        if s != t and s in after and t in after:
            after[s].append(t)
    state: dict[str, int] = {}
    kept, done = {n: [] for n in names}, []
    for root in [*(n for n in names if n in starts), *names]:
        stack = [(root, iter(after[root]))] if root not in state else []
        state.setdefault(root, 1)
        while stack:
            at, rest = stack[-1]
            for nxt in rest:
                if state.get(nxt) != 1:
                    kept[at].append(nxt)
                if nxt not in state:
                    state[nxt] = 1
                    stack.append((nxt, iter(after[nxt])))
                    break
            else:
                state[at] = 2
                done.append(at)
                stack.pop()
    rank = dict.fromkeys(names, 0)
    for at in reversed(done):
        for nxt in kept[at]:
            rank[nxt] = max(rank[nxt], rank[at] + 1)
    return [rank[n] for n in names]


def layer_rank(states: DataFrame, edges: DataFrame) -> DataFrame:
    """``(doc_id, name, rank)``; charts are small and many, one row each of names and edges, in a narrow map."""
    reach_workers(states.sparkSession)
    named = states.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", (F.col("role") == "start").alias("start")))).alias("s"))
    linked = edges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "source", "target"))).alias("e"))
    rows = named.join(_dealt(linked), "doc_id", "left")

    def run(batches):
        for b in batches:
            out = []
            for own, s, e in zip(b["doc_id"], b["s"], b["e"]):
                names = [x["name"] for x in s]
                ranks = _ranks(names, {x["name"] for x in s if x["start"]}, [(x["source"], x["target"]) for x in (e if e is not None else [])])
                out += zip([own] * len(names), names, ranks)
            yield pd.DataFrame(out, columns=["doc_id", "name", "rank"])

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, name string, rank long")


def charts_of_events(events: DataFrame) -> DataFrame:
    """``(doc_id, text)``: the distinct successions of event types of each user, as transition lines."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.select("user_id", "event_type", F.lead("event_type").over(order).alias("next")).where("next is not null")
    line = F.concat("event_type", F.lit(" --> "), "next", F.lit(" : "), F.upper("event_type"))
    rows = rows.select(F.col("user_id").alias("doc_id"), line.alias("line")).distinct()
    return rows.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))
