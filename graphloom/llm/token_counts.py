"""Token counts per section or field, attributed by character offsets.

A whole document is encoded once, so that counts add up to the document's own count. Each
token's span is joined to the spans of the sections. A token that crosses a boundary goes
to one section by an explicit rule: ``"most"`` gives it to the section that holds most of
its bytes, the earlier one if equal; ``"first"`` to the section of its first byte. Bytes
between sections, such as separators, belong to the section before them.

The vocabulary is a byte-level rank file read with ``tiktoken``; its tokens' bytes joined
are the text, so their lengths give the spans. Everything is a narrow map.

Defined results: a null or empty text has one empty section without tokens; empty lines
are sections; repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bpe import groups
from graphloom.llm.textnum import spread
from graphloom.session import reach_workers

#: Splits a text before the merges of byte-level rank files (a fixed value of the vocabularies).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Joins the fields of a row before they are encoded.
JOIN = "\n"

_ENCODERS: dict = {}


def encoder(path: str):
    """The worker's encoder of a rank file, and the byte length of each token."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            lengths[i] = len(token)
        _ENCODERS.clear()
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _ENCODERS[path]


def attribute(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token span, and whether it crosses a boundary. Section ``i`` is ``bounds[i] .. bounds[i+1]``."""
    first = np.searchsorted(bounds, start, side="right") - 1
    last = np.searchsorted(bounds, end - 1, side="right") - 1
    crossing = last > first
    owner = first.copy()
    if rule == "most" and crossing.any():
        token = np.flatnonzero(crossing)
        n = last[token] - first[token] + 1
        section, which = spread(first[token], n), np.repeat(token, n)
        held = np.minimum(end[which], bounds[section + 1]) - np.maximum(start[which], bounds[section])
        # the most bytes, then the earlier section
        order = np.lexsort((section, -held, which))
        head = np.r_[True, which[order][1:] != which[order][:-1]]
        owner[which[order][head]] = section[order][head]
    return owner, crossing


def _count(text: str, bounds: np.ndarray, enc, lengths: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    sections = len(bounds) - 1
    ids = np.array(enc.encode_ordinary(text), np.int64)
    end = np.cumsum(lengths[ids])
    owner, crossing = attribute(end - lengths[ids], end, bounds, rule)
    return np.bincount(owner, minlength=sections), np.bincount(owner[crossing], minlength=sections)


def by_line(docs: DataFrame, vocabulary: str, rule: str = "most", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, line, n_chars, n_tokens, n_crossing)`` of every line of every whole text."""
    return _by_section(docs.select(F.col(id_col).alias("_id"), F.array(F.col(text_col).cast("string")).alias("_fields")), vocabulary, rule, True).withColumnRenamed("_id", id_col).withColumnRenamed("section", "line")


def by_field(rows: DataFrame, fields: dict[str, Column], vocabulary: str, rule: str = "most", id_col: str = "doc_id") -> DataFrame:
    """``(id, field, n_chars, n_tokens, n_crossing)`` of each field of every row, encoded together as one text."""
    names = list(fields)
    counted = _by_section(rows.select(F.col(id_col).alias("_id"), F.array(*(c.cast("string") for c in fields.values())).alias("_fields")), vocabulary, rule, False)
    return counted.withColumn("section", F.element_at(F.array(*map(F.lit, names)), F.col("section") + 1)).withColumnRenamed("_id", id_col).withColumnRenamed("section", "field")


def _by_section(rows: DataFrame, vocabulary: str, rule: str, lines: bool) -> DataFrame:
    if rule not in ("most", "first"):
        raise ValueError(f"unknown rule {rule!r}")
    reach_workers(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoder(vocabulary)
        for batch in batches:
            all_parts = [[x or "" for x in f] for f in batch.column(1).to_pylist()]
            for a, b in groups([JOIN.join(p) for p in all_parts]):
                size, number, chars, tokens, crossing = [], [], [], [], []
                for parts in all_parts[a:b]:
                    if lines:
                        parts = parts[0].split("\n")
                    text = JOIN.join(parts)
                    # a separator belongs to the section before it
                    width = np.array([len(p.encode()) for p in parts]) + 1
                    bounds = np.r_[0, np.cumsum(width)]
                    bounds[-1] -= 1
                    n, x = _count(text, bounds, enc, lengths, rule)
                    size.append(len(parts))
                    number.append(np.arange(len(parts)))
                    chars.append(np.array([len(p) for p in parts]))
                    tokens.append(n)
                    crossing.append(x)
                ids = batch.column(0).slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), size)))
                columns = [pa.array(np.concatenate(c), t) for c, t in ((number, pa.int32()), (chars, pa.int64()), (tokens, pa.int64()), (crossing, pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["_id", "section", "n_chars", "n_tokens", "n_crossing"])

    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, section int, n_chars long, n_tokens long, n_crossing long")
