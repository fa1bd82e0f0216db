"""Block bodies: outlines, images, artifact ids, source text, and bodies built from chunks.

All of it works on the rows of :func:`graphloom.functions.blocks.flatten_blocks`
(its ``COLUMNS``), where the ``path`` of a block begins with the path of each block around it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from graphloom.functions.batches import mapped, pieces
from graphloom.functions.blocks import prefixes
from graphloom.functions.html import tables_of
from graphloom.functions.text import data_url, is_front_matter, paragraphs, repair_mime, stripped, uuid_of
from graphloom.session import reach_workers

RUNS = ArrayType(StructType([StructField("text", StringType()), *(StructField(k, BooleanType()) for k in ("bold", "italic", "strike", "code"))]))
_RUNS = pa.list_(pa.struct([("text", pa.string()), *((k, pa.bool_()) for k in ("bold", "italic", "strike", "code"))]))
#: Block types that carry an artifact id.
ARTIFACTS = ["paragraph", "heading", "image", "bulletListItem", "numberedListItem", "checkListItem", "table"]
#: Inline marks in the order in which they are read.
MARKS = (
    ("code", re.compile(r"`([^`\n]+)`")), ("bold", re.compile(r"\*\*([^*\n]+)\*\*")), ("bold", re.compile(r"__([^_\n]+)__")), ("strike", re.compile(r"~~([^~\n]+)~~")),
    ("italic", re.compile(r"\*([^*\n]+)\*")), ("italic", re.compile(r"_([^_\n]+)_")),
)


def _marked(text: str, marks: tuple, styles: frozenset[str]) -> Iterator[tuple[str, frozenset[str]]]:
    """``(text, styles)`` of the parts of a text that stands under some styles, for the marks that are left to read."""
    marks = tuple(m for m in marks if m[0] not in styles and "code" not in styles)
    if not text or not marks:
        yield from [(text, styles)] * bool(text)
        return
    (style, mark), rest = marks[0], marks[1:]
    # a mark has one group, so that every second piece lies within one
    for k, piece in enumerate(mark.split(text)):
        yield from _marked(piece, rest, styles | {style} if k % 2 else styles)


def runs_of(text: str) -> list[dict]:
    """Styled runs of one text. A mark is looked for within what the marks before it have cut, never in code or twice around one piece."""
    return [{"text": t} | {k: k in styles for k in ("bold", "italic", "strike", "code")} for t, styles in _marked(text, MARKS, frozenset())]


@F.arrow_udf(RUNS)
def styled(text: pa.Array) -> pa.Array:
    """Styled runs of each text."""
    return mapped(lambda t: runs_of(t or ""), text, _RUNS)


def inline_runs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, runs)`` of each text; a narrow map."""
    reach_workers(df.sparkSession)
    return df.select(id_col, styled(F.col(text_col)).alias("runs"))


def html_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, pos, rows)`` of every table of every page, ragged rows padded; a narrow map."""
    reach_workers(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [(i, k, t) for i, h in enumerate(batch.column(1).to_pylist()) for k, t in enumerate(tables_of(h or ""))]
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.string())))], ["_id", "pos", "rows"])

    rows = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html"))
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, pos int, rows array<array<string>>").withColumnRenamed("_id", id_col)


def chunks_to_body(chunks: DataFrame) -> DataFrame:
    """``(doc_id, body)``: block JSON of chunks ``(doc_id, pos, kind, text, url)``; all but images become paragraphs of styled runs."""
    reach_workers(chunks.sparkSession)
    image = F.col("kind") == "image"
    on = lambda r, k: F.when(r[k], F.lit(True)).alias(k)
    runs = F.transform("runs", lambda r: F.struct(F.lit("text").alias("type"), r["text"].alias("text"), F.struct(on(r, "bold"), on(r, "italic"), on(r, "strike"), on(r, "code")).alias("styles")))
    block = F.struct("pos", F.when(image, "image").otherwise("paragraph").alias("type"), F.when(image, F.struct(F.col("url").alias("url"), F.col("text").alias("caption"))).alias("props"), F.when(~image, runs).alias("content"))
    rows = chunks.withColumn("runs", styled(F.col("text"))).groupBy("doc_id").agg(F.array_sort(F.collect_list(block)).alias("b"))
    return rows.select("doc_id", F.to_json(F.transform("b", lambda x: F.struct(x["type"].alias("type"), x["props"].alias("props"), x["content"].alias("content")))).alias("body"))


def ocr_to_body(url: Column, text: Column) -> Column:
    """An image block, then a paragraph per part of the recognised text."""
    kind = "array<struct<type:string,props:struct<url:string>,content:string>>"
    head = F.array(F.struct(F.lit("image").alias("type"), F.struct(url.alias("url")).alias("props"), F.lit(None).cast("string").alias("content"))).cast(kind)
    rest = F.transform(paragraphs(text), lambda p: F.struct(F.lit("paragraph").alias("type"), F.lit(None).cast("struct<url:string>").alias("props"), p.alias("content"))).cast(kind)
    return F.to_json(F.concat(head, rest))


def images(blocks: DataFrame) -> DataFrame:
    """``(doc_id, idx, pos, block_id, caption, mime, n_payload, context, url)`` of all images with data URLs.

    ``context`` is what is stamped on the image (text before it, text read from it), else the
    text of the paragraphs that follow it at once among its siblings.
    """
    order = Window.partitionBy("doc_id", "parent").orderBy("pos")
    rows = blocks.withColumn("island", F.sum(F.when(F.col("type") == "paragraph", 0).otherwise(1)).over(order))
    held = rows.where("type = 'paragraph' and text <> ''").groupBy("doc_id", "parent", "island").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("held"))
    held = held.select("doc_id", "parent", "island", F.array_join(F.transform("held", lambda h: h["text"]), "\n").alias("after"))
    rows = rows.where("type = 'image'").withColumn("parts", data_url(F.col("url"))).where("parts is not null").join(held, ["doc_id", "parent", "island"], "left")
    stamped = F.concat_ws("\n\n", F.concat(F.lit("Context (text immediately before the image):\n"), "context"), F.concat(F.lit("Extracted text from the image (OCR):\n"), "extracted"))
    idx = (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).alias("idx")
    return rows.select(
        "doc_id", idx, "pos", F.coalesce("block_id", "artifact_id").alias("block_id"), F.when(F.col("caption") != "", F.col("caption")).alias("caption"), F.col("parts.mime").alias("mime"),
        F.length("parts.payload").cast("long").alias("n_payload"), F.when(stamped != "", stamped).otherwise(F.coalesce("after", F.lit(""))).alias("context"), "url",
    )


def get_image(found: DataFrame, block_id: str | None = None, index: int | None = None, payload: bool = True) -> DataFrame:
    """Images of each document by block id, else by index."""
    rows = found.where(F.col("block_id") == block_id) if block_id is not None else found.where(F.col("idx") == index)
    return rows if payload else rows.drop("url")


def image_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id").agg(F.count("*").alias("n_images"), F.sum("n_payload").alias("n_payload"))


def first_image(blocks: DataFrame) -> DataFrame:
    """``(doc_id, url)`` of each body's first top-level image, its type repaired."""
    rows = blocks.where("wrapped and type = 'image' and depth = 0 and url <> ''").groupBy("doc_id").agg(F.min_by("url", "pos").alias("url"))
    return rows.select("doc_id", repair_mime(F.col("url")).alias("url"))


def outline(blocks: DataFrame) -> DataFrame:
    """``(doc_id, pos, type, level, text)``: headings with text, each followed by an empty paragraph of the same ``pos``.

    Attachments (by their ids, or as headings that fold) and front matter go with all below them.
    """
    rows = blocks.where("wrapped")
    heading = F.col("type") == "heading"
    scaffold = (F.col("block_id") == "attachments-root") | F.col("block_id").startswith("attach-") | (heading & F.col("toggle"))
    dropped = rows.where(F.coalesce(scaffold, F.lit(False)) | (heading & is_front_matter(F.col("text")))).select("doc_id", F.col("path").alias("gone"))
    heads = rows.where("type = 'heading'")
    around = heads.select("doc_id", "pos", F.explode(prefixes(F.col("depth"))).alias("gone"))
    hidden = around.join(dropped, ["doc_id", "gone"], "left_semi").select("doc_id", "pos").distinct()
    shown = heads.where(stripped(F.col("text")) != "").join(hidden, ["doc_id", "pos"], "left_anti")
    title = F.struct(F.lit("heading").alias("type"), F.coalesce("level", F.lit(1)).alias("level"), stripped(F.col("text")).alias("text"))
    room = F.struct(F.lit("paragraph").alias("type"), F.lit(None).cast("int").alias("level"), F.lit("").alias("text"))
    return shown.select("doc_id", "pos", F.inline(F.array(title, room)))


def tag_artifacts(blocks: DataFrame) -> DataFrame:
    """``(doc_id, path, artifact_id)``: ids of artifact blocks, kept where stamped, else made from document and path."""
    fresh = F.concat(F.lit("art-"), uuid_of(F.concat_ws("|", F.col("doc_id").cast("string"), "path")))
    return blocks.where(F.col("type").isin(ARTIFACTS)).select("doc_id", "path", F.when(F.col("artifact_id").startswith("art-"), F.col("artifact_id")).otherwise(fresh).alias("artifact_id"))


def select_blocks(blocks: DataFrame, chosen: DataFrame) -> DataFrame:
    """The topmost of the chosen blocks ``(doc_id, path)``, each with its whole subtree."""
    picked = blocks.join(chosen.select("doc_id", "path").distinct(), ["doc_id", "path"], "left_semi")
    above = picked.where("depth > 0").select("doc_id", "path", F.explode(prefixes(F.col("depth") - 1)).alias("up"))
    covered = above.join(picked.select("doc_id", F.col("path").alias("up")), ["doc_id", "up"], "left_semi").select("doc_id", "path")
    top = picked.select("doc_id", "path").join(covered.distinct(), ["doc_id", "path"], "left_anti").select("doc_id", F.col("path").alias("root"))
    within = blocks.withColumn("root", F.explode(prefixes(F.col("depth"))))
    return within.join(top, ["doc_id", "root"]).select("doc_id", "root", "path", "type", "text")


def source_text(blocks: DataFrame) -> DataFrame:
    """``(doc_id, text)``: the text of the outermost blocks but images, blank ones dropped, a blank line between; bare lists have none."""
    full = blocks.where("wrapped and depth = 0 and (type is null or type <> 'image')")
    rows = full.where(stripped(F.col("text")) != "").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("held"))
    return rows.select("doc_id", F.array_join(F.transform("held", lambda h: h["text"]), "\n\n").alias("text"))


@F.pandas_udf(StringType())
def svg_text(svg: pd.Series) -> pd.Series:
    """Contents of every ``<text>``, trimmed, one per line."""
    tag = re.compile(r"<text\b[^>]*>(.*?)</text>", re.S)
    return svg.map(lambda s: "\n".join(x for x in (re.sub(r"<[^>]+>", "", t).strip() for t in tag.findall(s)) if x), na_action="ignore")


def strip_captions(lines: DataFrame, captions: DataFrame) -> DataFrame:
    """``(doc_id, pos, line)``: alternative texts emptied; the line after an image goes if it repeats the recorded caption of its url."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    alt = r"!\[[^\]]*\]\(([^)]+)\)"
    full = lines.where("trim(line) <> ''").withColumn("before", F.regexp_extract(F.lag("line").over(order), alt, 1))
    known = captions.select(F.col("url").alias("before"), F.lower(F.trim("caption")).alias("caption"))
    gone = full.where("before <> ''").join(known, "before").where(F.lower(F.trim("line")) == F.col("caption")).select("doc_id", "pos").distinct()
    return lines.join(gone, ["doc_id", "pos"], "left_anti").select("doc_id", "pos", F.regexp_replace("line", alt, "![]($1)").alias("line"))


def parse_structure(answer: Column) -> Column:
    """Sections of a model answer: level 1 to 3, title, purpose, style hint; those without a title are dropped."""
    plain = F.trim(F.regexp_replace(answer, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    got = F.from_json(plain, "sections array<struct<level:int,title:string,purpose:string,styleHint:string>>")["sections"]
    clamp = lambda x: F.greatest(F.lit(1), F.least(F.lit(3), F.coalesce(x, F.lit(1))))
    return F.transform(F.filter(got, lambda x: F.trim(x["title"]) != ""), lambda x: F.struct(clamp(x["level"]).alias("level"), F.trim(x["title"]).alias("title"), x["purpose"].alias("purpose"), x["styleHint"].alias("style_hint")))


@F.pandas_udf(StringType())
def merge_metadata(jsonld: pd.Series, extra: pd.Series) -> pd.Series:
    """The keys of ``extra`` put into an open JSON object, all others as they are; without ``extra``, the object as it is."""

    def one(a: str | None, b: str | None) -> str | None:
        if not isinstance(b, str):
            return a
        try:
            base = json.loads(a or "{}")
            base.update(json.loads(b or "{}"))
        except (ValueError, AttributeError):
            return a
        return json.dumps(base, ensure_ascii=False)

    return pd.Series([one(a, b) for a, b in zip(jsonld, extra, strict=True)])


def with_report(rows: DataFrame, embedded: Column) -> tuple[DataFrame, Observation]:
    """The rows, and a tally of how many were indexed and embedded that an action on them fills."""
    tally = Observation("index")
    return rows.observe(tally, F.count("*").alias("indexed"), F.count_if(embedded).alias("embedded")), tally
