"""Documents as typed chunks, keyed by (doc_id, pos)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.batches import pieces
from graphloom.functions.text import stripped
from graphloom.session import reach_workers

_RULE = re.compile(r"\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?\s*")
_HEADING = re.compile(r"(#{1,6})\s+(.*)")
_IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)]+)\)\s*")


def lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, line)`` with CRLF as LF."""
    return docs.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("pos", "line"))


#: What a line can be, in the order of trust; a line that is none of them is text.
_LINE = re.compile(r"(?P<blank>)|(?P<heading>#{1,6}\s+.*)|(?P<image>!\[[^\]]*\]\([^)]+\))|(?P<bulletListItem>\s*[-*+]\s+.*)|(?P<numberedListItem>\s*[0-9]+\.\s+.*)|(?P<text>.*)")
_BODY = {"heading": _HEADING, "image": _IMAGE, "bulletListItem": re.compile(r"\s*[-*+]\s+(.*)"), "numberedListItem": re.compile(r"\s*[0-9]+\.\s+(.*)")}


def _tables(lines: list[str]) -> list[tuple[int, int]]:
    """``(first, end)`` of the tables: a line between bars over a rule, and the lines between bars that follow the rule.

    Where one table could begin within another, the earlier one has its lines.
    """
    bars = np.array([len(t := x.strip()) > 0 and t[0] == t[-1] == "|" for x in lines], bool)
    rule = np.array([_RULE.fullmatch(x) is not None for x in lines], bool)
    heads = np.flatnonzero(bars[:-1] & rule[1:])
    others = np.append(np.flatnonzero(~bars), len(lines))
    out: list[tuple[int, int]] = []
    for first, end in zip(heads.tolist(), others[np.searchsorted(others, heads + 2)].tolist()):
        if not out or first >= out[-1][1]:
            out.append((first, end))
    return out


def chunks_of(text: str) -> list[tuple[str, int | None, str, str | None, list[list[str]] | None]]:
    """``(kind, level, text, url, rows)`` of a Markdown text.

    Every line has a kind, tables take the lines that they cover, and runs of text lines are paragraphs.
    """
    lines = [x.rstrip() for x in text.replace("\r\n", "\n").split("\n")]
    kinds = [m.lastgroup if (m := _LINE.fullmatch(x)) else "text" for x in lines]
    groups = list(range(len(lines)))  # lines of one number make one chunk
    for first, end in _tables(lines):
        kinds[first:end], groups[first:end] = ["table"] * (end - first), [first] * (end - first)
    for k in range(1, len(lines)):
        if kinds[k] == kinds[k - 1] == "text":
            groups[k] = groups[k - 1]
    out = []
    for first, own in groupby(range(len(lines)), key=groups.__getitem__):
        own, kind = list(own), kinds[first]
        if kind == "table":
            cells = [[c.strip() for c in lines[k].strip()[1:-1].split("|")] if len(lines[k].strip()) > 1 else [""] for k in own if k != first + 1]
            out.append(("table", None, "\n".join("\t".join(r) for r in cells), None, cells))
        elif kind == "text":
            out.append(("paragraph", None, " ".join(" ".join(lines[k] for k in own).split()), None, None))
        elif kind != "blank":
            m = _BODY[kind].fullmatch(lines[first])
            name = m[len(m.groups())].strip() if kind != "image" else m[1].strip() or "image"
            out.append((kind, min(len(m[1]), 3) if kind == "heading" else None, name, m[2].strip() if kind == "image" else None, None))
    return [c for c in out if c[2] or c[0] == "table"]


def markdown_chunks(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, kind, level, text, url, rows)``: headings, list items, images, tables and paragraphs; a narrow map.

    A paragraph is a run of other lines without a blank one; its white space is collapsed. The
    text of an image is its name, that of a table its cells with tabs between. A null or blank
    text has no chunks.
    """
    reach_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [(i, pos, *c) for i, t in enumerate(batch.column(1).to_pylist()) for pos, c in enumerate(chunks_of(t or ""))]
            columns = list(zip(*found, strict=True)) or [()] * 7
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.list_(pa.string())))
            ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], ["_id", "pos", "kind", "level", "text", "url", "rows"])

    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, pos int, kind string, level int, text string, url string, rows array<array<string>>").withColumnRenamed("_id", "doc_id")


def section_of(chunks: DataFrame) -> DataFrame:
    """``(doc_id, pos, section, purpose, style_hint)``: the nearest heading at or before each chunk, with what its author says of it."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    extra = [F.col(c).alias(c) if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in ("purpose", "style_hint")]
    title = stripped(F.col("text"))
    heading = F.when(F.col("kind") == "heading", F.struct(F.when(title == "", "(untitled section)").otherwise(title).alias("section"), *extra))
    return chunks.select("doc_id", "pos", F.last(heading, ignorenulls=True).over(order).alias("h")).select("doc_id", "pos", "h.section", "h.purpose", "h.style_hint")


def image_context(chunks: DataFrame) -> DataFrame:
    """``(doc_id, pos, context)`` of each image: the paragraphs right after it, among its siblings where blocks nest."""
    among = ["doc_id", "parent"] if "parent" in chunks.columns else ["doc_id"]
    group = F.sum(F.when(F.col("kind") == "paragraph", 0).otherwise(1)).over(Window.partitionBy(*among).orderBy("pos"))
    rows = chunks.withColumn("island", group)
    held = rows.where("kind = 'paragraph' and text <> ''").groupBy(*among, "island").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("held"))
    text = F.array_join(F.transform("held", lambda h: h["text"]), "\n")
    return rows.where("kind = 'image'").join(held, [*among, "island"], "left").select("doc_id", "pos", F.coalesce(text, F.lit("")).alias("context"))


def flat_text(chunks: DataFrame) -> DataFrame:
    """``(doc_id, text)``: chunks without images, a blank line between."""
    rows = chunks.where("kind <> 'image'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("held"))
    return rows.select("doc_id", F.array_join(F.transform("held", lambda h: h["text"]), "\n\n").alias("text"))


def is_empty_body(chunks: DataFrame) -> DataFrame:
    """``(doc_id, empty)``: whether nothing but headings and blank text is there, at any depth."""
    worded = F.col("kind").isin("paragraph", "bulletListItem", "numberedListItem", "checkListItem") & (stripped(F.col("text")) != "")
    full = F.coalesce(F.col("kind").isin("image", "table") | worded, F.lit(False))
    return chunks.groupBy("doc_id").agg((~F.bool_or(full)).alias("empty"))
