"""Phrases whose words occur together more often than chance, from count streams in two orders.

Phrases are counted level by level, from one word to ``longest``. A phrase is frequent only if what it is
without its first or its last word is frequent, so a level counts no others: a bit table of the
level before, mapped by tasks, leaves them out. It may let some through, which the exact
counts then drop; it leaves no frequent one out.

The frequent phrases of all lengths are then one stream of counts, kept in prefix order
(by their words from the first) and in suffix order (from the last). In prefix order a phrase directly follows what it
begins with, so one pass with a stack meets every phrase with the counts of all its first
parts and with its largest extension to the right; in suffix order the same pass meets the
counts of its last parts and its largest extension to the left. The two passes are
sort-merge joined on the phrase. Streams are range-partitioned between sampled phrases, and a
phrase that a later partition's first one begins with is sent there too, so no word is a group of its own.

A phrase goes if a longer one that holds it is about as frequent; the longer one's part that is
one word longer is then frequent too, so the largest extensions decide.

Defined results: a null text is empty, a null language ``und``; texts and pieces without words
count nothing; ties follow the order that ``top`` states; other columns are ignored; an empty
table gives no rows. Products are exact decimals of 38 digits, enough for 10^17 words.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import BitFilter, store_filter, written
from graphloom.llm.textnum import lower, mix, slices, span_hashes, words
from graphloom.session import reach_workers

#: Bytes of text whose phrases a task counts before it hands them on, and sampled phrases per partition of a stream.
COUNT_BYTES, SAMPLE = 8 << 20, 32
_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BETWEEN = _PIECE.copy()
_BETWEEN[[0x20, 0x09]] = True
_NEXT = np.uint64(0xC2B2AE3D27D4EB4F)


def name_hashes(column: pa.Array) -> np.ndarray:
    """A 64-bit hash of each value of a string column, also of an empty one."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    out = np.zeros(len(column), np.uint64)
    full = np.flatnonzero(np.diff(ends))
    out[full] = span_hashes(np.frombuffer(column.buffers()[2] or b"", np.uint8), ends[:-1][full], ends[1:][full])
    return out


def phrase_hash(lang: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """The hash of phrases from the hashes of their language and of their words."""
    return reduce(lambda h, w: mix(h * _NEXT + w), parts, lang)


class Slice:
    """The words of a run of texts: local numbers, hashes, and whether a word goes on with the piece of the one before."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        data = lower(data)
        starts, ends, counts = words(data, offsets, _BETWEEN)
        self.lang = np.repeat(langs, counts)
        pieces = np.cumsum(_PIECE[data], dtype=np.int64)[starts] if len(starts) else starts
        goes_on = np.diff(pieces) == 0
        first = np.cumsum(counts)[:-1]  # words that begin a text
        goes_on[first[(first > 0) & (first < len(starts))] - 1] = False
        self.goes_on = goes_on
        ends_at = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=ends_at[1:])
        # bytes of words lie one after the other once the rest is left out
        flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends_at), pa.py_buffer(data[~_BETWEEN[data]])])
        known = flat.dictionary_encode()
        self.ids, self.words = known.indices.to_numpy().astype(np.int64), known.dictionary

    def places(self, n: int) -> np.ndarray:
        """Where phrases of ``n`` words begin."""
        ok = np.ones(max(0, len(self.ids) - n + 1), bool)
        for k in range(n - 1):
            ok &= self.goes_on[k : k + len(ok)]
        return np.flatnonzero(ok)

    def hashes(self, at: np.ndarray, n: int, lang_hash: np.ndarray) -> np.ndarray:
        own = name_hashes(self.words)
        return phrase_hash(lang_hash[self.lang[at]], [own[self.ids[at + k]] for k in range(n)])

    def count(self, at: np.ndarray, n: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """``(language, phrase, count)`` of the phrases at these places."""
        code = self.lang[at]
        for k in range(n):
            _, first, code, count = np.unique(code * len(self.words) + self.ids[at + k], return_index=True, return_inverse=True, return_counts=True)
        own = at[first]
        parts = [self.words.take(pa.array(self.ids[own + k])) for k in range(n)]
        return self.lang[own], (pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if n > 1 else parts[0]).cast(pa.string()), count


def counted(docs: DataFrame, n: int, shorter: BitFilter | None) -> DataFrame:
    """``(lang, phrase, a)`` of all phrases of ``n`` words, or of those whose two parts of one word less pass ``shorter``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(0).dictionary_encode()
            langs, lang_hash = known.indices.to_numpy().astype(np.int64), name_hashes(known.dictionary)
            for a, b, data, offsets in slices(batch.column(1), COUNT_BYTES):
                part = Slice(data, offsets, langs[a:b])
                at = part.places(n)
                if shorter is not None and len(at):
                    at = at[shorter.has(part.hashes(at, n - 1, lang_hash))]
                    at = at[shorter.has(part.hashes(at + 1, n - 1, lang_hash))]
                if len(at):
                    lang, phrase, count = part.count(at, n)
                    yield pa.RecordBatch.from_arrays([known.dictionary.take(pa.array(lang)), phrase, pa.array(count)], ["lang", "phrase", "a"])

    found = docs.mapInArrow(run, "lang string, phrase string, a long")
    return found.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def hashed(phrases: DataFrame) -> DataFrame:
    """The hash of every phrase, as :class:`Slice` computes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = pc.split_pattern(batch.column(1), " ")
                n = len(parts[0])
                own = name_hashes(parts.flatten()).reshape(-1, n)
                yield pa.RecordBatch.from_arrays([pa.array(phrase_hash(name_hashes(batch.column(0)), list(own.T)).view(np.int64))], ["h"])

    return phrases.select("lang", "phrase").mapInArrow(run, "h long")


def frequent(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, a)`` of the phrases of one to ``longest`` words that occur ``least`` times, and ``(lang, n)``."""
    every = written(counted(docs, 1, None), "words")
    levels = [written(every.where(F.col("a") >= least), "phrases-1")]
    for n in range(2, longest + 1):
        shorter = store_filter(hashed(levels[-1]), f"phrases-{n - 1}")
        levels.append(written(counted(docs, n, shorter).where(F.col("a") >= least), f"phrases-{n}"))
    return reduce(DataFrame.unionByName, levels), every.groupBy("lang").agg(F.sum("a").alias("n"))


def stream(phrases: DataFrame, key: Column) -> DataFrame:
    """``(lang, phrase, parts, extension)``: counts of what each phrase's ``key`` begins with, and of its most frequent extension.

    The rows are put in the order of ``key``, an array of words, and read once.
    """
    spark = phrases.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = phrases.select("lang", key.alias("key"), "phrase", "a")
    sample = rows.orderBy(F.xxhash64("lang", "phrase"), "phrase").limit(SAMPLE * ranges).select("lang", "key").collect()
    as_key = lambda lang, words: (lang.encode(), *(w.encode() for w in words))
    sample = sorted(as_key(*r) for r in sample)
    bounds = [sample[len(sample) * k // ranges] for k in range(1, ranges)] if sample else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, part, head = [], [], []
            for i, k in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                k = as_key(*k)
                p = bisect_right(bounds, k)
                at.append(i), part.append(p), head.append(False)
                # later ranges that begin with an extension of this phrase must know it
                while p < len(bounds) and bounds[p][: len(k)] == k:
                    p += 1
                    at.append(i), part.append(p), head.append(True)
            took = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(head, pa.bool_()), *took.columns], ["part", "head", "lang", "key", "phrase", "a"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[list] = []  # phrases that the last one begins with and itself: language, phrase, key, counts of parts, extension, whether a head
        before = None
        for batch in batches:
            out = []
            for part, head, lang, key, phrase, a in zip(*(c.to_pylist() for c in batch.columns)):
                if (part, lang) != before:
                    out += path
                    path, before = [], (part, lang)
                while len(path) >= len(key):
                    out.append(path.pop())
                if path:
                    path[-1][4] = max(path[-1][4], a)
                path.append([lang, phrase, a, [*(p[2] for p in path)], -1, head])
            yield columns(out)
        if path:
            yield columns(path)

    def columns(out: list[list]) -> pa.RecordBatch:
        parts = pa.array([None if p[5] else p[3] for p in out], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.string()), pa.array([p[1] for p in out], pa.string()), parts, pa.array([p[4] for p in out], pa.int64())], ["lang", "phrase", "parts", "extension"])

    dealt = rows.mapInArrow(deal, "part int, head boolean, lang string, key array<string>, phrase string, a long")
    ordered = dealt.repartition(ranges, "part").sortWithinPartitions("part", "lang", "key")
    # a phrase whose extensions lie in several ranges has a row from each
    return ordered.mapInArrow(read, "lang string, phrase string, parts array<long>, extension long").groupBy("lang", "phrase").agg(F.max("parts").alias("parts"), F.max("extension").alias("extension"))


def scored(phrases: DataFrame, totals: DataFrame, share: int) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)`` of phrases of two words or more that no longer one of ``share`` % of their count holds."""
    spoken = F.split("phrase", " ")
    left, right = stream(phrases, spoken), stream(phrases, F.reverse(spoken))
    both = left.select("lang", "phrase", F.col("parts").alias("firsts"), F.col("extension").alias("longer")).join(
        right.select("lang", "phrase", F.col("parts").alias("lasts"), F.col("extension").alias("earlier")).hint("merge"), ["lang", "phrase"]
    )
    # one row per language
    rows = phrases.hint("merge").join(both, ["lang", "phrase"]).where(F.size("firsts") > 0).join(totals, "lang")
    rows = rows.where(100 * F.greatest("longer", "earlier") < share * F.col("a"))
    words_in = F.size("firsts") + 1
    exact = lambda c: c.cast("decimal(19,0)")

    def cut(k: Column) -> Column:
        first, rest = F.element_at("firsts", k), F.element_at("lasts", words_in - k)
        top = (exact(F.lit(1000)) * exact(F.col("a"))).cast("decimal(19,0)") * exact(F.col("n"))
        return F.struct(F.call_function("div", top, exact(first) * exact(rest)).alias("score"), k.alias("k"), first.alias("l"), rest.alias("r"))

    worst = F.array_min(F.transform(F.sequence(F.lit(1), words_in - 1), cut))
    return rows.withColumn("worst", worst).select("lang", "phrase", "a", "worst.l", "worst.r", "n", "worst.score")


def top(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of each language by score, count (both falling) and phrase, with their ``rank``.

    Rows are sorted over range partitions; a language's rows are ranked within each and moved up
    by the counts of the partitions before, so no language is one task.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    sorted_rows = rows.repartitionByRange("lang", *order).sortWithinPartitions("lang", *order)
    placed = written(sorted_rows.withColumn("part", F.spark_partition_id()), "ranked")
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each language in each partition
    moved = placed.groupBy("part", "lang").agg(F.count("*").alias("own")).withColumn("moved", F.coalesce(F.sum("own").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("part", "lang").orderBy(*order))
    near = placed.withColumn("within", within).where(F.col("within") <= limit)
    ranked = near.join(moved.where(F.col("moved") < limit).select("part", "lang", "moved"), ["part", "lang"])
    return ranked.withColumn("rank", F.col("moved") + F.col("within")).where(F.col("rank") <= limit)


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, share: int = 100, limit: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)`` of the ``limit`` best phrases of each language."""
    reach_workers(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    phrases, totals = frequent(texts, least, longest)
    return top(scored(phrases, totals, share), limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
