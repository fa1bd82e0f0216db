"""Recursive block JSON: searchable text, flattening, secrets. Batched Python where no fixed schema exists."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from graphloom.functions.batches import mapped, pieces
from graphloom.session import reach_workers

#: Keys whose strings are not text.
SKIPPED = frozenset(("id", "url", "previewWidth", "name"))


def strings(node, ordered: bool) -> Iterator[str]:
    """All text strings below a parsed value; keys sorted, or in their own order."""
    if isinstance(node, str):
        if node and not node.startswith("data:"):
            yield node
    elif isinstance(node, list):
        for x in node:
            yield from strings(x, ordered)
    elif isinstance(node, dict):
        for k in node if ordered else sorted(node):
            if k not in SKIPPED:
                yield from strings(node[k], ordered)


def searchable(body: str | None) -> str | None:
    """Strings of a JSON body joined by spaces; the raw body if it is no JSON or holds none."""
    if not body:
        return body
    try:
        found = " ".join(strings(json.loads(body), False))
    except (ValueError, RecursionError):
        return body
    return found or body


def plain(body: str | None) -> str | None:
    """As :func:`searchable` in reading order, of the blocks only, white space collapsed."""
    if not body:
        return body
    try:
        node = json.loads(body)
        if isinstance(node, dict) and isinstance(node.get("blocks"), list):
            node = node["blocks"]
        found = " ".join(" ".join(s for s in strings(node, True) if s.strip()).split())
    except (ValueError, RecursionError):
        return body
    return found or body


def has_secret(text: str | None) -> bool:
    """A non-empty string under a key named like a secret, at any depth."""

    def look(node) -> bool:
        if isinstance(node, list):
            return any(map(look, node))
        if isinstance(node, dict):
            for k, v in node.items():
                low = k.lower()
                if low == "apitoken":
                    continue
                if isinstance(v, str) and v and ("apikey" in low or low in ("secret", "token")):
                    return True
                if look(v):
                    return True
        return False

    try:
        return look(json.loads(text or "null"))
    except (ValueError, RecursionError):
        return False


@F.arrow_udf(StringType())
def searchable_text(body: pa.Array) -> pa.Array:
    return mapped(searchable, body, pa.string())


@F.arrow_udf(StringType())
def plain_text(body: pa.Array) -> pa.Array:
    return mapped(plain, body, pa.string())


@F.pandas_udf(BooleanType())
def secret_in(text: pd.Series) -> pd.Series:
    return text.map(has_secret)


#: Digits of a block's place among its siblings in a path.
DIGITS = 6
COLUMNS = (
    "pos int, path string, parent string, depth int, wrapped boolean, block_id string, artifact_id string, type string, level int, toggle boolean, "
    "text string, url string, caption string, context string, extracted string, purpose string, style_hint string"
)
_KINDS = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def prefixes(depth):
    """Paths around a block at ``depth`` and its own, from its column ``path``."""
    return F.transform(F.sequence(F.lit(0), depth), lambda d: F.substring("path", F.lit(1), d * (DIGITS + 1) + DIGITS))


def _walk(blocks: list, parent: str, depth: int) -> Iterator[tuple[str, str, int, dict]]:
    for i, b in enumerate(blocks):
        if isinstance(b, dict):
            here = f"{parent}.{i:0{DIGITS}d}" if parent else f"{i:0{DIGITS}d}"
            yield here, parent, depth, b
            children = b.get("children")
            yield from _walk(children if isinstance(children, list) else [], here, depth + 1)


def _inline(content) -> str:
    """Text of a block's content: a string, or the runs of a list; anything else has none."""
    if isinstance(content, str):
        return content
    runs = content if isinstance(content, list) else []
    return "".join(_string(c.get("text") if isinstance(c, dict) else c) or "" for c in runs)


def _string(value, trim: bool = False) -> str | None:
    if not isinstance(value, str):
        return None
    return (value.strip() or None) if trim else value


def _level(raw) -> int | None:
    """Heading level 1 to 3; what is neither below 2 nor 2 counts as 3."""
    if raw is None:
        return None
    try:
        n = float(raw or 0)
    except (TypeError, ValueError):
        return 3
    return 1 if n <= 1 else 2 if n == 2 else 3


def _rows_of(body: str | None) -> list[tuple]:
    try:
        node = json.loads(body or "[]")
        blocks = node.get("blocks") if isinstance(node, dict) else node
        walked = list(_walk(blocks if isinstance(blocks, list) else [], "", 0))
    except (ValueError, RecursionError):
        return []
    rows = []
    for pos, (path, parent, depth, b) in enumerate(walked):
        p = b.get("props") if isinstance(b.get("props"), dict) else {}
        rows.append((
            pos, path, parent, depth, isinstance(node, dict), _string(b.get("id")), _string(p.get("id")), _string(b.get("type")), _level(p.get("level")), bool(p.get("isToggleable")),
            _inline(b.get("content")), _string(p.get("url")), _string(p.get("caption")), _string(p.get("contextText"), True), _string(p.get("extractedText"), True),
            _string(p.get("sectionPurpose"), True), _string(p.get("sectionStyleHint"), True),
        ))
    return rows


def flatten_blocks(df: DataFrame, id_col: str = "doc_id", body_col: str = "body") -> DataFrame:
    """Every block of every body, parents first, as ``(id, ...)`` with :data:`COLUMNS`; a narrow map.

    ``path`` holds the places of a block and of the blocks around it, ``parent`` is the path
    around it, ``wrapped`` tells bodies ``{"blocks": [...]}`` from bare lists. A body that is
    null or no JSON, or nests too deeply to parse, has no blocks; fields of another kind than
    expected are null.
    """
    reach_workers(df.sparkSession)
    fields = [c.rsplit(" ", 1) for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [(i, *r) for i, body in enumerate(batch.column(1).to_pylist()) for r in _rows_of(body)]
            columns = list(zip(*rows, strict=True)) or [()] * (len(fields) + 1)
            ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns[1:], fields, strict=True))], ["_id", *(n for n, _ in fields)])

    rows = df.select(F.col(id_col).alias("_id"), F.col(body_col).alias("_body"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, {COLUMNS}").withColumnRenamed("_id", id_col)
