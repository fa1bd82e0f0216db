"""Quality rules with suffix-array repetition.

Every text gets a suffix array over its words (prefix doubling on flat arrays of many
texts; a suffix is refined only while it still ties with another). Neighbours in the array
with a common prefix of at least ``min_words`` words bound the longest-common-prefix
intervals, that is, the maximal repeated word strings of the text. Their spans are united;
the covered share of words and of characters and the longest repeat are limited. Beside
these, the verdict limits symbols per word. Everything is a narrow map over whole texts.

Defined results: a null or empty text has no words and is rejected (too short); equal rows
give equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textnum import mix, slices, span_hashes, spread, words
from graphloom.session import reach_workers


@dataclass(frozen=True)
class Limits:
    """What a kept text may have at most, and ``min_words`` it must have."""

    min_words: int = 20
    window: int = 8
    repeat_words_share: float = 0.30
    repeat_chars_share: float = 0.30
    longest_repeat_share: float = 0.25
    symbols_per_word: float = 0.10

    def __post_init__(self):
        if self.window < 1 or self.window & (self.window - 1):
            raise ValueError(f"the window of repeated words is a power of two, not {self.window}")


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][offsets])


def suffix_array(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order of many texts at once, and ranks by the first 1, 2, 4, ... symbols.

    ``ends[i]`` is where the text of position ``i`` ends; symbols of different texts must
    differ. A rank is the place of the first suffix with the same beginning.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.r_[True, symbols[order[1:]] != symbols[order[:-1]]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [rank.copy()], 1
    size = np.diff(np.r_[np.flatnonzero(new), n])
    tied = order[np.repeat(size > 1, size)]
    while len(tied):
        after = tied + step
        inside = after < ends[tied]
        second = np.where(inside, rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((second, rank[tied]))
        tied, second = tied[by], second[by]
        group = rank[tied]
        fresh = np.r_[True, group[1:] != group[:-1]]
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))
        new = fresh | np.r_[True, second[1:] != second[:-1]]
        head = np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))
        order[group + np.arange(len(tied)) - begin] = tied
        rank[tied] = group + head - begin
        size = np.diff(np.r_[np.flatnonzero(new), len(tied)])
        tied = tied[np.repeat(size > 1, size)]
        step *= 2
        levels.append(rank.copy())
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours ``a, b`` in suffix order with a common prefix of ``least`` symbols or more, and its length.

    ``least`` is a power of two.
    """
    k = least.bit_length() - 1
    if len(levels) <= k or len(order) < 2:
        return (np.zeros(0, np.int64),) * 3
    same = levels[k][order[1:]] == levels[k][order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    common = np.zeros(len(a), np.int64)
    for level in reversed(range(len(levels))):
        x, y = a + common, b + common
        inside = (x < ends[a]) & (y < ends[b])
        x, y = np.where(inside, x, 0), np.where(inside, y, 0)
        common += np.where(inside & (levels[level][x] == levels[level][y]), 1 << level, 0)
    return a, b, common


def measure(data: np.ndarray, offsets: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """All counts of each text of a slice."""
    starts, ends, n_words = words(data, offsets)
    texts = len(n_words)
    word_at = np.r_[0, np.cumsum(n_words)]
    owner = np.repeat(np.arange(texts), n_words)
    point = np.r_[0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)]
    chars = point[ends] - point[starts]
    out = {"n_words": n_words, "word_chars": _sums(chars, word_at), "n_symbols": _per_text(_SYMBOL[data], offsets)}

    # lines with a word; a text's end ends its last line
    breaks = np.flatnonzero(data == 10)
    line_end = np.unique(np.r_[breaks, offsets[1:]])
    line_start = np.unique(np.r_[offsets[:-1], breaks + 1])
    line_start = line_start[line_start < len(data)]
    line_start = line_start[data[line_start] != 10]
    first = np.searchsorted(starts, line_start)
    own_end = line_end[np.searchsorted(line_end, line_start, side="right")]
    has = np.r_[starts, len(data) + 1][first] < own_end
    line_start, own_end = line_start[has], own_end[has]
    of = np.searchsorted(offsets, line_start, side="right") - 1
    key = mix(span_hashes(data, line_start, own_end) + mix(of.astype(np.uint64) + np.uint64(1)))
    _, seen = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(of, minlength=texts) - np.bincount(of[seen], minlength=texts)

    # the suffix array over words; equal words of different texts are different symbols
    symbols = mix(span_hashes(data, starts, ends) + mix(owner.astype(np.uint64) + np.uint64(1)))
    text_end = word_at[1:][owner]
    order, levels = suffix_array(symbols, text_end)
    a, b, common = common_prefixes(order, levels, text_end, window)
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, np.r_[a, b], 1)
    np.add.at(cover, np.r_[a + common, b + common], -1)
    covered = np.cumsum(cover[:-1]) > 0
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, owner[a], common)
    out |= {"n_repeat_words": _sums(covered, word_at), "repeat_chars": _sums(np.where(covered, chars, 0), word_at), "longest_repeat": longest}
    return out


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(values, dtype=np.int64)][at])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars", "longest_repeat")


def verdict(x: dict, limits: Limits) -> tuple:
    """``(base_failed, kept)`` from counts, which are all columns or all arrays."""
    n = x["n_words"]
    # n_repeat_words of a text are its words in windows of limits.window words that occur twice
    failed = (n < limits.min_words) | (100 * x["n_repeat_words"] > round(100 * limits.repeat_words_share) * n)
    clean = (x["repeat_chars"] <= limits.repeat_chars_share * x["word_chars"]) & (x["longest_repeat"] <= limits.longest_repeat_share * n) & (x["n_symbols"] <= limits.symbols_per_word * n)
    return failed, ~failed & clean


def judge(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of every text, ``base_failed`` and the verdict ``kept``."""
    reach_workers(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                found = measure(data, offsets, limits.window)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(found[c], pa.int64()) for c in COUNTS)], ["_id", *COUNTS])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    counts = rows.mapInArrow(run, f"_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))
    failed, kept = verdict({c: F.col(c) for c in COUNTS}, limits)
    return counts.withColumn("base_failed", failed).withColumn("kept", kept).withColumnRenamed("_id", id_col)


def keep(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is kept, all columns as they are; one narrow map."""
    reach_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(at)):
                _, good = verdict(measure(data, offsets, limits.window), limits)
                yield batch.slice(a, b - a).filter(pa.array(good))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)
