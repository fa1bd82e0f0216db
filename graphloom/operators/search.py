"""Lexical, vector and hybrid search, one plan for any number of queries.

Queries are rows ``(query_id, query)`` and ``(query_id, vector)``. Lexical search reads an
:class:`Index`: postings with their document's length, the vocabulary, and two totals. Words
of a query are prefixes, which meet the vocabulary first, so that postings are joined by whole
terms and those of other terms are never read past their file statistics. Scores and distances
are rounded to nine decimals, so that equal texts tie and the smaller id wins wherever sums are
taken.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.files import read_file, write_file
from graphloom.functions.porter import porter_stem, stem
from graphloom.functions.text import collapsed, query_terms, tokens
from graphloom.operators.vectors import VectorIndex, rows_of, search_blocks, store_vectors
from graphloom.session import fresh, reach_workers, written

K1, B = 1.2, 0.75

#: Prefixes up to which a search names them in its plan, so that the scan of the index skips all else.
NAMED = 64


#: Nodes of a block of the index, groups of like length that blocks are taken from, and letters of the prefixes that are counted when it is built.
BLOCK, LENGTHS, DEEP = 1024, 64, 24
#: After so many blocks of each query a search looks at the score that is to beat before it reads on.
STEPS = (2, 16)
#: Nodes up to which all blocks are read in one pass: it costs less than what blocks that may hold a hit have to exchange.
SMALL = 1 << 26
#: Nodes and words of a block that is read with all others, and the bits of a node's number that tell its place in its block.
SHARE, WORDS, PLACES = 4096, 1 << 22, 20


@dataclass(frozen=True)
class Index:
    """``postings``: ``term, id, tf, dl``; ``terms``: ``term, df``; ``stats``: one row ``n_nodes, avg_len``.

    A stored index has more: postings by ``node``, a number that ``ids`` (``node, id``) tells, with their ``block``; ``blocks``:
    ``term, block, tf, dl``, the largest and the smallest in the block; ``prefixes``: ``prefix, df``; and ``lists``, from which
    they come, see :func:`store_index`.
    """

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    blocks: DataFrame | None = None
    prefixes: DataFrame | None = None
    ids: DataFrame | None = None
    lists: DataFrame | None = None


def _words(nodes: DataFrame, stemmed: bool) -> Column:
    words = tokens(F.concat_ws(" ", "title", "body_md"))
    if stemmed:
        reach_workers(nodes.sparkSession)
        words = porter_stem(words)
    return words


def _forward(nodes: DataFrame, stemmed: bool = False) -> DataFrame:
    """``(id, dl, held)``: of each node with words its length and its terms with their counts, in order; a narrow map. Other columns stay.

    To be unfolded with ``inline_outer``: for ``inline`` Spark tests the size of ``held`` before it is computed, and the test would sort
    the words of a node again for each of them.
    """
    more = [c for c in nodes.columns if c not in ("id", "title", "body_md")]
    rows = nodes.select("id", *more, F.sort_array(_words(nodes, stemmed)).alias("t")).where(F.size("t") > 0)
    rows = rows.select("id", *more, "t", F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1))).alias("at"))
    held = F.transform("at", lambda i, k: F.struct(F.get("t", i).alias("term"), (F.coalesce(F.get("at", k + 1), F.size("t")) - i).cast("long").alias("tf")))
    return rows.select("id", *more, F.size("t").cast("long").alias("dl"), held.alias("held"))


def postings(nodes: DataFrame, stemmed: bool = False) -> DataFrame:
    """``(term, id, tf, dl)`` over title and body, of plain or of Porter-stemmed tokens; ``dl`` is the node's length.

    A narrow map; only rows of an id that more than one row has meet in an exchange, where they count as one node.
    """
    again = written(nodes.groupBy("id").count().where("count > 1").select("id"), "repeated")
    rows = nodes.select("id", "title", "body_md")
    if again.isEmpty():
        return _forward(rows, stemmed).select("id", "dl", F.inline_outer("held")).select("term", "id", "tf", "dl")
    shared = _forward(rows.join(again, "id", "left_semi"), stemmed).select("id", "dl", F.inline_outer("held")).groupBy("term", "id").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))
    return _forward(rows.join(again, "id", "left_anti"), stemmed).select("id", "dl", F.inline_outer("held")).select("term", "id", "tf", "dl").unionByName(shared)


def doc_stats(nodes: DataFrame) -> DataFrame:
    """``(id, dl)``: length of each node in tokens."""
    return nodes.select("id", F.size(tokens(F.concat_ws(" ", "title", "body_md"))).cast("long").alias("dl"))


def term_stats(posted: DataFrame) -> DataFrame:
    """``(term, df)``."""
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: number of nodes and their average length."""
    return stats.agg(F.count("*").alias("n_nodes"), F.avg("dl").alias("avg_len"))


def index_of(nodes: DataFrame, stemmed: bool = False) -> Index:
    """The index of nodes, computed where it is used; :func:`store_index` is for more than one search."""
    posted = postings(nodes, stemmed)
    return Index(posted, term_stats(posted), corpus_stats(doc_stats(nodes)))


def store_index(nodes: DataFrame, path: str, stemmed: bool = False) -> Index:
    """Write the index below ``path`` and open it. Rows of one id are one node, with the text of all of them.

    ``lists`` has a row ``term, block, at, tf`` for each term of a block: the places of its nodes, and how often each has the term, as bytes of
    32-bit integers, which are copied as a whole where arrays would be taken item by item. The first row of a block has no term, but its
    nodes: ``ids`` one after the other, where each begins as ``at``, their lengths in words as ``tf``. A block is written by one task, in
    order and into one row group, which Spark never divides, so that a task that reads a block has all of it. A narrow map, in which words
    are found once.

    For more than :data:`SMALL` nodes those of like length share blocks, so that what the best node of a block can score is little more than
    what it does, and what only a search by blocks needs is stored too.
    """
    spark = nodes.sparkSession
    reach_workers(spark)
    nodes = nodes.select(F.col("id").cast("string").alias("id"), "title", "body_md")
    again = written(nodes.groupBy("id").count().where("count > 1").select("id"), "repeated")
    if not again.isEmpty():
        one = nodes.join(again, "id", "left_semi").groupBy("id").agg(F.lit(None).cast("string").alias("title"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "title", "body_md"))), " ").alias("body_md"))
        nodes = nodes.join(again, "id", "left_anti").unionByName(one)
    n = nodes.count()
    rows = _by_length(nodes, n) if n > SMALL else nodes.withColumn("block", F.lit(None).cast("long"))
    lists = rows.select("block", "id", _words(nodes, stemmed).alias("t")).mapInArrow(_cut_lists, "block long, term string, at binary, tf binary, ids string")
    lists.write.mode("overwrite").option("parquet.block.size", (1 << 31) - 1).option("maxRecordsPerFile", 0).parquet(f"{path}/lists")
    lists = spark.read.parquet(f"{path}/lists")
    # as many words as all lists count
    lists.where("term is not null").mapInArrow(_summed, "length long").agg(F.lit(n).cast("long").alias("n_nodes"), (F.coalesce(F.sum("length"), F.lit(0)) / F.nullif(F.lit(n), F.lit(0))).cast("double").alias("avg_len")).write.mode("overwrite").parquet(f"{path}/stats")
    if n > SMALL:
        _rows_of(lists).sortWithinPartitions("term", "block", "node").write.mode("overwrite").parquet(f"{path}/postings")
        posted = spark.read.parquet(f"{path}/postings")
        maxima = posted.groupBy("term", "block").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"))
        prefixes = _prefixes(nodes.select(F.array_sort(F.array_distinct(_words(nodes, stemmed))).alias("t")))
        for name, table, by in (("terms", term_stats(posted), ["term"]), ("blocks", maxima, ["term", "block"]), ("prefixes", prefixes, ["prefix"]), ("ids", _ids_of(lists), ["node"])):
            table.sortWithinPartitions(*by).write.mode("overwrite").parquet(f"{path}/{name}")
    return open_index(spark, path)


def _by_length(nodes: DataFrame, n: int) -> DataFrame:
    """Nodes with a ``block`` of nodes of like length, in its order."""
    edges = doc_stats(nodes).agg(F.percentile_approx("dl", [k / LENGTHS for k in range(1, LENGTHS)])).first()[0]
    edges = sorted({e for e in edges or [] if e is not None})
    share = max(1, -(-n // (BLOCK * max(1, len(edges)))))
    block = _group(F.size(tokens(F.concat_ws(" ", "title", "body_md"))).cast("long"), edges) * share + F.pmod(F.xxhash64("id"), F.lit(share))
    return nodes.withColumn("block", block.cast("long")).repartition(max(1, -(-n // SHARE)), "block").sortWithinPartitions("block")


def _cut_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``lists`` from rows ``block, id, t``; where no block is given, one ends after :data:`SHARE` nodes or :data:`WORDS` words."""
    own = TaskContext.get().partitionId() << PLACES
    held: list[tuple[pa.Array, pa.ListArray]] = []
    block, n_nodes, n_words = None, 0, 0
    for batch in batches:
        given, ids, words = batch.columns
        ends = words.offsets.to_numpy().astype(np.int64)
        numbers = None if given.null_count == len(given) else given.to_numpy()
        at = 0
        while at < len(batch):
            if numbers is None:
                end = max(at + 1, min(at + SHARE - n_nodes, int(np.searchsorted(ends, ends[at] + WORDS - n_words, "right")) - 1, len(batch)))
            else:
                if block is not None and numbers[at] != block and held:
                    yield from _lists_of(block, held)
                    held, n_nodes, n_words = [], 0, 0
                block = int(numbers[at])
                end = at + int(np.searchsorted(numbers[at:], block, "right"))
            held.append((ids.slice(at, end - at), words.slice(at, end - at)))
            n_nodes, n_words = n_nodes + end - at, n_words + int(ends[end] - ends[at])
            if numbers is None and (n_nodes >= SHARE or n_words >= WORDS):
                yield from _lists_of(own, held)
                own, held, n_nodes, n_words = own + 1, [], 0, 0
            at = end
    if held:
        yield from _lists_of(own if block is None else block, held)


def _lists_of(block: int, held: list[tuple[pa.Array, pa.ListArray]]) -> Iterator[pa.RecordBatch]:
    ids = pa.concat_arrays([i for i, _ in held])
    size = np.concatenate([pc.fill_null(pc.list_value_length(t), 0).to_numpy(zero_copy_only=False) for _, t in held]).astype(np.int32)
    n = len(ids)
    words = pc.dictionary_encode(pa.concat_arrays([t.flatten() for _, t in held]))
    terms = pc.sort_indices(words.dictionary).to_numpy()
    place = np.empty(len(terms), np.int64)
    place[terms] = np.arange(len(terms))
    keys, tf = np.unique(place[words.indices.to_numpy()] * n + np.repeat(np.arange(n), size), return_counts=True)
    starts = np.searchsorted(keys, np.arange(len(terms) + 1) * n).astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy())])
    text = "".join(ids.to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([None], pa.string()), *(pa.array([x.astype(np.int32).tobytes()]) for x in (ends, size)), pa.array([text])], LISTS)
    lists = [_bytes(starts, x.astype(np.int32)) for x in (keys % max(1, n), tf)]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), block)), words.dictionary.take(pa.array(terms)), *lists, pa.nulls(len(terms), pa.string())], LISTS)


LISTS = ["block", "term", "at", "tf", "ids"]


def _bytes(starts: np.ndarray, values: np.ndarray) -> pa.Array:
    """Runs of 32-bit integers as binaries."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * 4).astype(np.int32)), pa.py_buffer(values)])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array([sum(int(_numbers(b.column("tf")).sum(dtype=np.int64)) for b in batches)], pa.int64())], ["length"])


def _numbers(column: pa.Array) -> np.ndarray:
    """All integers of binaries that :func:`_bytes` has made."""
    if not len(column):
        return np.zeros(0, np.int32)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.int32, (ends[-1] - ends[0]) // 4, ends[0]) if ends[-1] > ends[0] else np.zeros(0, np.int32)


def _ids_of(lists: DataFrame) -> DataFrame:
    """``(node, id)``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array((block.number << PLACES) + np.arange(len(block.ids))), block.ids], ["node", "id"])

    return lists.where("term is null").mapInArrow(rows, "node long, id string")


def _rows_of(lists: DataFrame) -> DataFrame:
    """``(term, block, node, tf, dl)``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            terms = pa.array(np.repeat(np.arange(len(block.terms)), np.diff(block.starts)))
            for low in range(0, len(terms), 1 << 16):
                part = slice(low, low + (1 << 16))
                at = block.at[part].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(block.terms, pa.string()).take(terms[part]), pa.array(np.full(len(at), block.number)), pa.array((block.number << PLACES) + at), pa.array(block.tf[part].astype(np.int64)), pa.array(block.sizes[at].astype(np.int64))], ["term", "block", "node", "tf", "dl"])

    return lists.mapInArrow(rows, "term string, block long, node long, tf long, dl long")


def _group(length: Column, edges: list[int]) -> Column:
    """How many edges a length has reached. It is held as an item of an array: within the filter Spark would count the words again for each edge."""
    return F.get(F.transform(F.array(length), lambda n: F.size(F.filter(F.lit(edges or [0]).cast("array<bigint>"), lambda e: e <= n))), F.lit(0))


def open_index(spark, path: str) -> Index:
    """A stored index. One that is read at once has its other tables computed from its lists where they are asked for, and no block maxima."""
    lists, stats = (spark.read.parquet(f"{path}/{name}") for name in ("lists", "stats"))
    if stats.first()["n_nodes"] > SMALL:
        posted, terms, blocks, prefixes, ids = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "blocks", "prefixes", "ids"))
        return Index(posted, terms, stats, blocks, prefixes, ids, lists)
    posted = _rows_of(lists)
    terms = lists.where("term is not null").groupBy("term").agg((F.sum(F.octet_length("at")) / 4).cast("long").alias("df"))
    return Index(posted, terms, stats, None, _prefixes(posted.groupBy("node").agg(F.array_sort(F.collect_list("term")).alias("t"))), _ids_of(lists), lists)


def _prefixes(nodes: DataFrame) -> DataFrame:
    """``(prefix, df)``: how many nodes hold a word that begins with it, for prefixes of up to :data:`DEEP` letters; ``t``: words in order, each once.

    A word brings those prefixes that are longer than what it shares with the word before it. So each node counts once for a prefix, and what is
    exchanged are words with the lengths that they share, not prefixes.
    """
    reach_workers(nodes.sparkSession)

    @F.arrow_udf("array<int>")
    def shared(texts: pa.Array) -> pa.Array:
        return pa.array([_shared(t.as_py()) for t in texts], pa.list_(pa.int32()))

    rows = nodes.select("t", shared("t").alias("k")).select(F.explode_outer(F.arrays_zip("t", "k")).alias("x")).where("x is not null")
    rows = rows.groupBy(F.col("x.t").alias("term"), F.col("x.k").alias("k")).agg(F.count("*").alias("n"))
    begun = F.transform(F.sequence(F.lit(1), F.lit(DEEP)), lambda n: F.when((n > F.col("k")) & (n <= F.length("term")), F.substring("term", F.lit(1), n)))
    rows = rows.select("n", F.explode_outer(F.array_compact(begun)).alias("prefix")).where("prefix is not null")
    return rows.groupBy("prefix").agg(F.sum("n").alias("df"))


def _shared(words: list[str] | None) -> list[int]:
    """How many first letters each word shares with the one before it."""
    out, last = [], ""
    for w in words or []:
        n, most = 0, min(len(w), len(last))
        while n < most and w[n] == last[n]:
            n += 1
        out.append(n)
        last = w
    return out


def _asked(words: DataFrame, index: Index) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``(term, prefix)`` of the terms that begin with an asked prefix, and a filter for tables by term that scans can use.

    Few prefixes are named in the plan; the vocabulary, which is small beside the postings, meets more of them in a join.
    """
    asked = [r[0] for r in words.select("prefix").distinct().limit(NAMED + 1).collect()]
    named: Callable[[DataFrame], DataFrame] = lambda df: df
    if len(asked) <= NAMED:
        begins = reduce(lambda a, b: a | b, (F.col("term").startswith(p) for p in sorted(asked)), F.lit(False))
        named = lambda df: df.where(begins)
        widths = sorted({len(p) for p in asked})
    else:
        widths = [r[0] for r in words.select(F.length("prefix")).distinct().collect()]  # at most as many as a longest word has letters
    begun = named(index.terms).select("term", F.explode(F.array(*map(F.lit, widths)).cast("array<int>")).alias("width")).where(F.length("term") >= F.col("width"))
    return begun.select("term", F.expr("substring(term, 1, width)").alias("prefix")).join(words.select("prefix").distinct(), "prefix"), named


def search_index(index: Index, queries: DataFrame, limit: int | None = None, own: DataFrame | None = None) -> DataFrame:
    """``(query_id, id, score)`` by BM25; every word of a query is a required prefix. With ``own`` only nodes of these ids are hits; terms are weighed over all.

    A prefix counts as one term: its occurrences and the nodes that hold it are those of all
    terms that begin with it. The rarest prefix of a query names its candidates, and only
    these are looked up under the others.

    With a limit and a stored index of many nodes, a query reads the blocks first that can score most, and then only those that can
    beat its last kept score; what it leaves unread cannot be among the first ``limit``. Else see :func:`_scan`, or without a stored
    index :func:`_search_all`.
    """
    by_blocks = index.blocks is not None and limit and own is None
    if index.lists is not None and not by_blocks:
        hits = _scan(index, queries, "rows", limit, own)
        return top(hits, limit) if limit else hits
    words = queries.select("query_id", F.explode(F.array_distinct(query_terms(F.col("query")))).alias("prefix"))
    total = index.stats.first()
    n, average = float(total["n_nodes"]), total["avg_len"]

    def one(tf: Column, dl: Column, df: Column) -> Column:
        x = tf.cast("double")
        idf = F.greatest(F.log((F.lit(n) - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        return idf * x * (K1 + 1) / (x + K1 * (1 - B + B * dl / F.lit(average)))

    if not by_blocks:
        hits = _search_all(index, words, one)
        if own is not None:
            hits = hits.join(own.select("id"), "id", "left_semi").select("query_id", "id", "score")
        return top(hits, limit) if limit else hits
    begun, named = _asked(words, index)
    posted = index.postings

    def identified(hits: DataFrame) -> DataFrame:
        """Hits by id; no more than a query's best by score, and those that tie with the last, look theirs up."""
        return top(best(hits).join(index.ids, "node").select("query_id", "id", "score"), limit)

    def best(hits: DataFrame) -> DataFrame:
        return hits.withColumn("_n", F.rank().over(every.orderBy(F.desc("score")))).where(F.col("_n") <= limit).drop("_n")

    every = Window.partitionBy("query_id")
    by_query = lambda df: words.withColumn("need", F.count("*").over(every)).join(df, "prefix").withColumn("k", F.row_number().over(every.orderBy("df", "prefix")))

    def scores(ranked: DataFrame, tf: DataFrame, within: DataFrame) -> DataFrame:
        """Of each query the nodes that hold all its prefixes, in the blocks ``within`` (query_id, block)."""
        at = ["prefix", "block"]
        own = ranked.join(within, "query_id")
        value = one(F.col("tf"), F.col("dl"), F.col("df")).alias("one")
        lead = own.where("k = 1").join(tf, at).select("query_id", "node", "need", value)
        rest = lead.where("need > 1").select("query_id", "node").join(ranked.where("k > 1").select("query_id", "prefix", "df"), "query_id")
        rest = rest.join(tf.drop("block"), ["prefix", "node"]).select("query_id", "node", F.lit(0).cast("long").alias("need"), value)
        found = lead.unionByName(rest).groupBy("query_id", "node").agg(F.round(F.sum("one"), 9).alias("score"), F.count("*").alias("have"), F.max("need").alias("need"))
        return found.where("have = need").select("query_id", "node", "score")

    begun = written(begun, "begun")
    ranked = written(by_query(_frequency(index, words, begun, named)), "asked")
    # what a block can score at most: its largest counts in its shortest node, under all terms of a prefix
    most = named(index.blocks).join(begun, "term").groupBy("prefix", "block").agg(F.sum("tf").alias("tf"), F.min("dl").alias("dl"))
    bounds = ranked.join(most, "prefix").groupBy("query_id", "block").agg(F.sum(one(F.col("tf"), F.col("dl"), F.col("df"))).alias("bound"), F.count("*").alias("have"), F.max("need").alias("need"))
    bounds = written(bounds.where("have = need").withColumn("place", F.row_number().over(every.orderBy(F.desc("bound"), "block"))).select("query_id", "block", "bound", "place"), "bounds")

    def read(within: DataFrame) -> DataFrame:
        """The best ``limit`` of each query in these blocks, and those that tie with the last."""
        wanted = ranked.select("query_id", "prefix").join(within, "query_id").select("prefix", "block").distinct()
        # a short prefix has many terms: they meet the postings before blocks are chosen, not every block
        tf = named(posted).join(begun, "term").join(wanted, ["prefix", "block"]).groupBy("prefix", "block", "node").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
        return written(best(scores(ranked, tf, within)), "hits")

    hits = read(bounds.where(F.col("place") <= STEPS[0]).select("query_id", "block"))
    for low, high in zip(STEPS, (*STEPS[1:], None), strict=True):
        beat = hits.groupBy("query_id").agg(F.min("score").alias("last"), F.count("*").alias("n")).where(F.col("n") >= limit).select("query_id", "last")
        rest = bounds.where(F.col("place") > low) if high is None else bounds.where(F.col("place").between(low + 1, high))
        open_ = rest.join(beat, "query_id", "left").where(F.col("last").isNull() | (F.col("bound") >= F.col("last") - 2e-9)).select("query_id", "block")
        hits = written(best(hits.unionByName(read(written(open_, "open")))), "hits")
    return identified(hits)


def _search_all(index: Index, words: DataFrame, one: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """``(query_id, id, score)`` of all nodes that hold every prefix of a query.

    Postings of asked prefixes are exchanged once, to one row for each node with what it holds. The queries, which are few and short beside
    the nodes, are broadcast by their rarest prefix, so that candidates are found and scored where their node is and are not exchanged.
    """
    words = written(words, "words")
    asked = written(words.select("prefix").distinct().select("prefix", F.monotonically_increasing_id().alias("p")), "prefixes")
    widths = [r[0] for r in asked.select(F.length("prefix")).distinct().collect()]  # at most as many as a longest word has letters
    posted = index.postings.withColumnRenamed("id", "node")
    begun = F.array(*(F.when(F.length("term") >= w, F.substring("term", 1, w)) for w in sorted(widths))).cast("array<string>")
    begun = posted.select("node", "tf", "dl", F.explode_outer(begun).alias("prefix"))
    tf = begun.join(F.broadcast(asked), "prefix")
    held = tf.groupBy("node", "p").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    held = held.groupBy("node").agg(F.first("dl").alias("dl"), F.map_from_entries(F.collect_list(F.struct("p", "tf"))).alias("held"))
    held = held.withColumnRenamed("node", "id")
    held = written(held.select("id", "dl", "held"), "held")
    df = held.select(F.explode_outer(F.map_keys("held")).alias("p")).groupBy("p").agg(F.count("*").alias("df"))
    # a prefix that no node holds leaves its query without hits
    ranked = words.join(asked, "prefix").join(df, "p").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("df", "p"))).alias("ws"))
    need = words.groupBy("query_id").agg(F.count("*").alias("need"))
    ranked = ranked.join(need, "query_id").where(F.size("ws") == F.col("need")).select("query_id", "ws", F.col("ws")[0]["p"].alias("lead"))
    ranked = written(ranked, "asked")
    found = held.select("id", "dl", "held", F.explode_outer(F.map_keys("held")).alias("lead")).join(F.broadcast(ranked), "lead")
    score = F.aggregate("ws", F.lit(0.0), lambda s, w: s + one(F.try_element_at("held", w["p"]), F.col("dl"), w["df"]))
    return found.select("query_id", "id", F.round(score, 9).alias("score")).where("score is not null")


def count_hits(index: Index, queries: DataFrame) -> DataFrame:
    """``(query_id, n)``: how many hits each query of a stored index has; hits are counted where their node is."""
    return _scan(index, queries, "counts").groupBy("query_id").agg(F.sum("n").alias("n"))


def hits_among(index: Index, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(query_id, id, score)`` of those pairs ``(query_id, id)`` that a search of a stored index finds."""
    return _scan(index, queries, "rows", pairs=pairs)


#: Queries whose prefixes a task spreads over the nodes of a block at a time, and hits of the best ones that it holds before it drops the others.
ASKED, HELD = 256, 1 << 20


def _scan(index: Index, queries: DataFrame, what: str, limit: int | None = None, own: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Hits of a stored index, of which every block is read: rows ``(query_id, id, score)``, or with ``counts`` ``(query_id, n)`` of each task.

    Blocks are read twice: to count how many nodes have each asked prefix, and to score. A block is scored against all queries where it is
    read, so nothing is exchanged but what a task has found; with ``limit`` these are its best hits of each query, else all. The queries,
    nodes that alone count (``own``) and pairs that alone count are numbers, which tasks map from files in the shared folder.
    """
    spark = queries.sparkSession
    reach_workers(spark)
    total = index.stats.first()
    n, average = float(total["n_nodes"]), total["avg_len"]
    folder = fresh(spark, "asked")
    kind = queries.schema["query_id"].dataType.simpleString()
    words = written(queries.select("query_id", F.explode(F.array_distinct(query_terms(F.col("query")))).alias("prefix")), "words")
    few = [r[0] for r in words.select("prefix").distinct().limit(NAMED + 1).collect()]
    lists = index.lists
    if len(few) <= NAMED:
        lists = lists.where(reduce(lambda a, b: a | b, (F.col("term").startswith(p) for p in sorted(few)), F.col("term").isNull()))
    asked = _in_file(words, folder)
    told = {name: _in_file(df, folder) for name, df in (
        ("own", None if own is None else index.ids.join(own.select("id"), "id", "left_semi").select("node")),
        ("pairs", None if pairs is None else index.ids.join(pairs.select("query_id", "id"), "id").select("node", "query_id")),
    ) if df is not None}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = Prefixes(read_file(folder, asked))
        df = np.zeros(len(prefixes.texts), np.int64)
        for block in _blocks(batches):
            held, starts, *_ = prefixes.held(block)
            df[held] += np.diff(starts)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["p", "df"])

    if asked is None or not average:
        return words.select("query_id", F.lit(None).cast("long").alias("n")).limit(0) if what == "counts" else words.select("query_id", F.lit(None).cast("string").alias("id"), F.lit(0.0).alias("score")).limit(0)
    weights = _in_file(lists.mapInArrow(counted, "p int, df long").groupBy("p").agg(F.sum("df").alias("df")), folder)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = read_file(folder, asked)
        prefixes = Prefixes(table)
        df = np.zeros(len(prefixes.texts), np.int64)
        if weights is not None:
            known = read_file(folder, weights)
            df[known["p"].to_numpy()] = known["df"].to_numpy()
        asks = Asks(table, prefixes, df, n)
        only = {k: None if name is None else read_file(folder, name) for k, name in told.items()}
        found = Best(asks.ids, limit) if limit else None
        counts = np.zeros(len(asks.ids), np.int64)
        for block in _blocks(batches):
            for ask, at, score in asks.hits(block, prefixes, average, found, only):
                if what == "counts":
                    counts += np.bincount(ask, minlength=len(counts))
                elif found is not None:
                    found.add(ask, block.ids.take(pa.array(at)), score)
                else:
                    for low in range(0, len(ask), 1 << 16):
                        part = slice(low, low + (1 << 16))
                        yield pa.RecordBatch.from_arrays([asks.ids.take(pa.array(ask[part])), block.ids.take(pa.array(at[part])), pa.array(score[part])], ["query_id", "id", "score"])
        if what == "counts":
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([asks.ids.take(pa.array(at)), pa.array(counts[at])], ["query_id", "n"])
        elif found is not None:
            yield from found.rows()

    return lists.mapInArrow(scored, f"query_id {kind}, n long" if what == "counts" else f"query_id {kind}, id string, score double")


def _in_file(df: DataFrame, folder: str) -> str | None:
    """Write rows in their order into one Arrow file, by one task, and give its name; None of no rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([write_file(folder, pa.Table.from_batches(held).combine_chunks())])], ["name"])

    rows = df.repartition(1).sortWithinPartitions(*df.columns).mapInArrow(write, "name string").collect()
    return rows[0]["name"] if rows else None


@dataclass
class _Block:
    number: int
    ids: pa.Array
    sizes: np.ndarray
    terms: list[str]
    starts: np.ndarray
    at: np.ndarray
    tf: np.ndarray


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    """Blocks from their rows of ``lists``, which follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        number = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(batch)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if high > low:
                if held and held[0].column("block")[0].as_py() != number[low]:
                    yield _block(held)
                    held = []
                held.append(batch.slice(low, high - low))
    if held:
        yield _block(held)


def _block(held: list[pa.RecordBatch]) -> _Block:
    table = pa.Table.from_batches(held).combine_chunks()
    first, rest = table.slice(0, 1), table.slice(1)
    if first["term"][0].as_py() is not None or rest["term"].null_count:
        raise ValueError("a block of the index is not whole")
    one = lambda name: rest[name].combine_chunks()
    ends, sizes, ids = (first[c][0].as_buffer() if c != "ids" else pa.py_buffer(first[c][0].as_py().encode()) for c in ("at", "tf", "ids"))
    ids = pa.Array.from_buffers(pa.string(), ends.size // 4 - 1, [None, ends, ids])
    starts = np.concatenate([[0], np.cumsum(pc.binary_length(rest["at"]).to_numpy() // 4)]).astype(np.int64)
    return _Block(first["block"][0].as_py(), ids, np.frombuffer(sizes, np.int32).astype(np.float64), rest["term"].to_pylist(), starts, _numbers(one("at")), _numbers(one("tf")))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of runs that begin at ``starts``."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Prefixes:
    """The different prefixes of a table ``query_id, prefix``, in order."""

    def __init__(self, asked: pa.Table):
        words = pc.dictionary_encode(asked["prefix"].combine_chunks())
        order = pc.sort_indices(words.dictionary).to_numpy()
        self.texts = words.dictionary.take(pa.array(order)).to_pylist()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of_rows = place[words.indices.to_numpy()]
        self.known = {t: k for k, t in enumerate(self.texts)}
        self.widths = sorted({len(t) for t in self.texts})

    def held(self, block: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The prefixes that a block has, where the nodes of each begin, the nodes in order, and how often each has it."""
        which, where = [], []
        for k, term in enumerate(block.terms):
            for width in self.widths:
                if width > len(term):
                    break
                if (p := self.known.get(term[:width])) is not None:
                    which.append(p)
                    where.append(k)
        where = np.array(where, np.int64)
        sizes = block.starts[where + 1] - block.starts[where]
        rows = _spread(block.starts[where], sizes)
        keys = np.repeat(np.array(which, np.int64), sizes) * len(block.ids) + block.at[rows]
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        tf = np.add.reduceat(block.tf[rows[order]].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        prefix, at = keys[first] // max(1, len(block.ids)), keys[first] % max(1, len(block.ids))
        begins = np.flatnonzero(np.diff(prefix, prepend=-1))
        return prefix[begins], np.append(begins, len(prefix)), at, tf


class Asks:
    """Queries with their prefixes, the rarest first; those with a prefix that no node has are left out."""

    def __init__(self, asked: pa.Table, prefixes: Prefixes, df: np.ndarray, n: float):
        query = pc.dictionary_encode(asked["query_id"].combine_chunks())
        self.ids, rows, p = query.dictionary, query.indices.to_numpy().astype(np.int64), prefixes.of_rows
        self.idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 1e-6)
        order = np.lexsort((p, df[p], rows))
        rows, p = rows[order], p[order]
        size = np.bincount(rows, minlength=len(self.ids))
        starts = np.cumsum(size) - size
        full = np.bincount(rows, df[p] > 0, minlength=len(self.ids)) == size
        #: by their number of words: the queries and their prefixes
        self.groups = [(at := np.flatnonzero(full & (size == m)), p[starts[at][:, None] + np.arange(m)]) for m in np.unique(size)]

    def hits(self, block: _Block, prefixes: Prefixes, average: float, best: Best | None, only: dict[str, pa.Table | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Hits in a block as numbers of queries, places in the block and scores."""
        held, starts, at, tf = prefixes.held(block)
        n = len(block.ids)
        value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * block.sizes[at] / average))
        if "own" in only:
            kept = np.zeros(n, bool)
            if only["own"] is not None:
                kept[_within(only["own"], block)[0]] = True
            stays = kept[at]
            starts = np.concatenate([[0], np.cumsum(stays)])[starts]
            at, value = at[stays], value[stays]
        sizes = np.diff(starts)
        row = np.full(len(prefixes.texts), -1)
        row[held[sizes > 0]] = np.flatnonzero(sizes > 0)
        near = {}
        if "pairs" in only:
            if only["pairs"] is None:
                return
            places, rows = _within(only["pairs"], block)
            ask = pc.index_in(only["pairs"]["query_id"].slice(rows.start, rows.stop - rows.start), self.ids).to_numpy(zero_copy_only=False)
            for q, place in zip(ask[~np.isnan(ask)].astype(np.int64).tolist(), places[~np.isnan(ask)].tolist(), strict=True):
                near.setdefault(q, set()).add(place)
        spread = np.zeros((0, n))
        for asks, words in self.groups:
            words = row[words]
            alive = (words >= 0).all(axis=1)
            if "pairs" in only:
                alive &= np.isin(asks, np.fromiter(near, np.int64, len(near)))
            if best is not None:
                # what a query can score here at most
                most = np.maximum.reduceat(np.append(value, 0.0), np.minimum(starts[:-1], len(value))) if len(held) else np.zeros(0)
                ceiling = (self.idf[held[words]] * most[words]).sum(axis=1) if len(held) else np.zeros(len(words))
                alive &= ceiling >= best.least[asks] - 2e-9
            asks, words = asks[alive], words[alive]
            for low in range(0, len(asks), ASKED):
                own, rows = asks[low : low + ASKED], words[low : low + ASKED]
                used, local = np.unique(rows, return_inverse=True)
                local = local.reshape(rows.shape)
                if len(used) > len(spread):
                    spread = np.zeros((len(used), n))
                filled = _spread(starts[used], sizes[used])
                cells = np.repeat(np.arange(len(used)) * n, sizes[used]) + at[filled]
                values = spread.ravel()
                values[cells] = value[filled]
                if "pairs" in only:
                    places = [sorted(near[q]) for q in own.tolist()]
                    who = np.repeat(np.arange(len(own)), list(map(len, places)))
                    where = np.array([x for p in places for x in p], np.int64)
                else:
                    lead = rows[np.arange(len(rows)), sizes[rows].argmin(axis=1)]
                    who, where = np.repeat(np.arange(len(own)), sizes[lead]), at[_spread(starts[lead], sizes[lead])]
                score = np.zeros(len(who))
                for k in range(rows.shape[1]):
                    one = values[local[who, k] * n + where]
                    has = one > 0
                    if not has.all():
                        who, where, score, one = who[has], where[has], score[has], one[has]
                    score += self.idf[held[rows[who, k]]] * one
                values[cells] = 0.0
                score = np.floor(score * 1e9 + 0.5) / 1e9
                if best is not None:
                    stays = score >= best.least[own[who]]
                    who, where, score = who[stays], where[stays], score[stays]
                if len(who):
                    yield own[who], where, score


def _within(table: pa.Table, block: _Block) -> tuple[np.ndarray, slice]:
    """Places in a block of the nodes that a table in order of ``node`` tells, and its rows."""
    nodes = table["node"].to_numpy()
    low, high = np.searchsorted(nodes, [block.number << PLACES, (block.number + 1) << PLACES]).tolist()
    return nodes[low:high] - (block.number << PLACES), slice(low, high)


class Best:
    """The best hits of each query, ties to the smaller id; ``least`` is the score of the last where there are enough."""

    def __init__(self, ids: pa.Array, limit: int):
        self.ids, self.limit, self.least = ids, limit, np.full(len(ids), -np.inf)
        self.held: list[pa.Table] = []
        self.size = self.kept = 0

    def add(self, ask: np.ndarray, ids: pa.Array, score: np.ndarray) -> None:
        self.held.append(pa.table({"ask": ask, "id": ids, "score": score}))
        self.size += len(ask)
        if self.size >= max(HELD, 2 * self.kept):
            self.drop()

    def drop(self) -> None:
        table = pa.concat_tables(self.held).sort_by([("ask", "ascending"), ("score", "descending"), ("id", "ascending")])
        ask, score = table["ask"].to_numpy(), table["score"].to_numpy()
        first = np.flatnonzero(np.diff(ask, prepend=-1))
        place = np.arange(len(ask)) - np.repeat(first, np.diff(np.append(first, len(ask))))
        last = place == self.limit - 1
        self.least[ask[last]] = score[last]
        table = table.filter(pa.array(place < self.limit)).combine_chunks()
        self.held, self.size, self.kept = [table], len(table), len(table)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.drop()
            for batch in self.held[0].to_batches(max_chunksize=1 << 16):
                yield pa.RecordBatch.from_arrays([self.ids.take(batch.column("ask")), batch.column("id"), batch.column("score")], ["query_id", "id", "score"])


def _frequency(index: Index, words: DataFrame, begun: DataFrame, named: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(prefix, df)`` of the asked prefixes: as counted when the index was built, or from the postings of long ones."""
    asked = words.select("prefix").distinct()
    stored = index.prefixes.join(asked, "prefix")
    long = begun.where(F.length("prefix") > DEEP)
    return stored.unionByName(named(index.postings).join(long, "term").groupBy("prefix").agg(F.countDistinct("node").alias("df")))


def search_text(nodes: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """As :func:`search_index`, of nodes without a stored index: it is stored first, so that postings are exchanged once and by number."""
    return search_index(store_index(nodes, fresh(nodes.sparkSession, "index")), queries, limit)


def stem_query(query: str) -> str:
    """A query's words stemmed, for postings of stems; each stem is then a prefix."""
    return " ".join(stem(w.lower()) for w in query.replace('"', "").split())


def embed(texts: DataFrame, dims: int = 64) -> DataFrame:
    """``(id, embedding)``: hashed bags of tokens with unit length; the stand-in where no model is at hand."""
    slot = lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int")
    rows = texts.select("id", F.explode(tokens(F.col("text"))).alias("t")).select("id", slot(F.col("t")).alias("slot"), F.when(F.pmod(F.hash("t"), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign"))
    rows = rows.groupBy("id", "slot").agg(F.sum("sign").alias("x")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    value = lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0.0)) / F.greatest("norm", F.lit(1e-12))
    return rows.select("id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), value).cast("array<float>").alias("embedding"))


def top(rows: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The best ``k`` of each query, ties to the smaller id."""
    best = Window.partitionBy("query_id").orderBy(F.desc(by), "id")
    return rows.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")


def search_vectors(vectors: DataFrame | VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, dist, similarity)``: the nearest ``k`` (1 to 200) of each query by Euclidean distance.

    A stored index is searched block by block. Of vectors without one, a single query is a
    constant of the plan; for more the index is stored first.
    """
    k = max(1, min(200, k))
    if isinstance(vectors, VectorIndex):
        rows = search_blocks(vectors, queries, k)
        return rows.select("query_id", "id", "dist", similarity(F.col("dist")).alias("similarity"))
    asks = rows_of(queries, "query_id", "vector")
    asked = asks.limit(2).collect()
    if len(asked) > 1:
        return search_vectors(store_vectors(vectors, fresh(vectors.sparkSession, "vectors")), queries, k)
    kind = queries.schema["query_id"].dataType
    each = F.array(*(F.struct(F.lit(r["id"]).cast(kind).alias("query_id"), F.array(*map(F.lit, r["v"])).alias("q")) for r in asked))
    rows = rows_of(vectors, "id", "embedding")
    rows = rows.where(F.col("dim") == len(asked[0]["v"])).select("id", "v", F.inline(each)) if asked else rows.select("id", "v", F.lit(None).cast(kind).alias("query_id"), F.col("v").alias("q")).limit(0)
    gap = F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    rows = rows.select("query_id", "id", F.round(F.sqrt(gap), 9).alias("dist"))
    best = Window.partitionBy("query_id").orderBy("dist", "id")
    rows = rows.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k)
    return rows.select("query_id", "id", "dist", similarity(F.col("dist")).alias("similarity"))


def similarity(dist):
    """Cosine of unit vectors from their distance, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - dist * dist / 2))


def fuse(lexical: DataFrame, semantic: DataFrame, limit: int) -> DataFrame:
    """Hybrid ranking: ``0.4 * lexical / best lexical + 0.4 * similarity``; a missing leg scores 0."""
    both = lexical.select("query_id", "id", F.col("score").alias("lex")).join(semantic.select("query_id", "id", "similarity"), ["query_id", "id"], "full_outer")
    lex = F.coalesce("lex", F.lit(0.0))
    best = F.greatest(F.max(lex).over(Window.partitionBy("query_id")), F.lit(1e-9))
    rows = both.select("query_id", "id", F.least(F.greatest(lex / best, F.lit(0.0)), F.lit(1.0)).alias("score_lex"), F.coalesce("similarity", F.lit(0.0)).alias("score_sem"))
    rows = rows.withColumn("score_structural", F.lit(0.0)).withColumn("score", F.round(0.4 * F.col("score_lex") + 0.4 * F.col("score_sem"), 9))
    return top(rows, limit)


def with_summary(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each hit with title, type, summary and key points of its node's metadata."""
    meta = nodes.select("id", "type", "title", F.get_json_object("jsonld", "$.summary").alias("summary"), F.from_json(F.get_json_object("jsonld", "$.keyPoints"), "array<string>").alias("key_points"))
    return hits.join(meta, "id", "left")


def hybrid(index: Index, nodes: DataFrame, vectors: DataFrame | VectorIndex, texts: DataFrame, query_vectors: DataFrame, limit: int, node_type: str | None = None, prefilter: bool = False) -> DataFrame:
    """Both legs over-fetched threefold, then fused.

    A type filter takes hits of other types out of the lexical leg before its cut, and out of the
    semantic leg after it, or before it with ``prefilter``, which needs the vectors and not their index;
    terms are weighed over all nodes.
    """
    if node_type is None:
        return fuse(search_index(index, texts, 3 * limit), search_vectors(vectors, query_vectors, 3 * limit), limit)
    own = nodes.where(F.col("type") == node_type).select("id")
    lexical = search_index(index, texts, 3 * limit, own)
    semantic = search_vectors(vectors.join(own, "id", "left_semi") if prefilter else vectors, query_vectors, 3 * limit).join(own, "id", "left_semi")
    return fuse(lexical, semantic, limit)


def _word_pattern(terms: list[str]) -> str:
    """Words that begin with one of the terms, whatever characters the terms hold; the word is the first group after its left border."""
    literal = lambda t: r"\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E"
    return r"(?i)(^|[^\p{L}\p{N}])((?:" + "|".join(map(literal, terms)) + r")[\p{L}\p{N}]*)"


def highlight(text, terms: list[str]):
    """``<mark>`` around words that begin with a term."""
    return F.regexp_replace(text, _word_pattern(terms), "$1<mark>$2</mark>") if terms else text


def highlight_window(text, terms: list[str], size: int = 64, ellipsis: str = " … "):
    """A snippet of at most ``size`` words with ``<mark>`` around those that begin with a term.

    The window begins at the word from which it holds the most different terms, then the most
    marked words, then the earliest, and is moved back so that what is marked lies in its
    middle; an ellipsis stands for what is left out on either side. A text of no more words is
    whole; a text without such words gives its beginning.
    """
    low = [t.lower() for t in terms]

    @F.pandas_udf(StringType())
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: window_of(t, low, size, ellipsis), na_action="ignore")

    return cut(text)


_WORD = re.compile(r"[^\W_]+")


def window_of(text: str, terms: list[str], size: int, ellipsis: str) -> str:
    """The snippet of one text; see :func:`highlight_window`."""
    spans = [m.span() for m in _WORD.finditer(text)]
    low = [text[a:b].lower() for a, b in spans]
    which = [next((k for k, t in enumerate(terms) if t and w.startswith(t)), -1) for w in low]
    hits = np.flatnonzero(np.array(which, dtype=np.int64) >= 0)
    begin = 0
    if len(spans) > size and len(hits):
        last = np.searchsorted(hits, hits + size)
        kinds = np.array(which)[hits]
        # for each term, how many marked words up to each place are of it
        different = np.zeros(len(hits), np.int64)
        for k in np.unique(kinds):
            seen = np.r_[0, np.cumsum(kinds == k)]
            different += seen[last] > seen[: len(hits)]
        best = int(np.lexsort((hits, -(last - np.arange(len(hits))), -different))[0])
        first, final = int(hits[best]), int(hits[last[best] - 1])
        begin = max(0, min(first - (size - (final - first + 1)) // 2, len(spans) - size))
    end = min(len(spans), begin + size)
    at = spans[begin][0] if begin else 0
    stop = spans[end - 1][1] if end < len(spans) else len(text)
    out = [ellipsis] if begin else []
    for a, b in (spans[h] for h in hits if begin <= h < end):
        out += [text[at:a], "<mark>", text[a:b], "</mark>"]
        at = b
    return "".join([*out, text[at:stop], *([ellipsis] if end < len(spans) else [])])


def search_nodes(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits with their node's metadata and, on each row, ``provenance``: the ids of all hits of its query, best first."""
    ids = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("held"))
    ids = ids.select("query_id", F.transform("held", lambda h: h["id"]).alias("provenance"))
    return with_summary(hits, nodes).join(ids, "query_id")


#: Words that say nothing about a claim.
STOP = (
    "a an and or but if then than that this these those is are was were be been being do does did doing have has had having will would should could can may might must "
    "i you he she it we they me us them my your his her its our their the of in on at to from for with by as into about over under between through "
    "when where why how what which who whom not no so too very just also"
).split()


#: Bytes of a window and of a gram in it; a window is known by the least hash of its grams.
WINDOW, GRAM = 40, 12


def window_marks(data: np.ndarray) -> np.ndarray:
    """The least gram hash of every window of some bytes, each once; none of fewer bytes than a window has."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64)
    grams = np.zeros(len(data) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + data[j : j + len(grams)].astype(np.uint64)
    grams = ((grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1).min(axis=1))


def _marks(text: Column, most: int | None = None) -> Column:
    """The marks of all windows of a text, or of its first ``most`` bytes."""

    @F.arrow_udf("array<long>")
    def marks(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        found = [window_marks(np.frombuffer(t.as_buffer(), np.uint8)[:most]) if t.is_valid else np.zeros(0, np.int64) for t in texts]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))

    return marks(text)


#: Claims up to which every block of their document is held against each of them.
FEW = 16


def _flat(text: Column) -> Column:
    return F.lower(collapsed(text))


def _telling(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) >= 3) & ~t.isin(STOP))


def _best_block(rows: DataFrame, by: list[str]) -> DataFrame:
    best = Window.partitionBy(*by).orderBy("stage", F.desc("score"), "pos")
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def passages(blocks: DataFrame, claims: DataFrame) -> DataFrame:
    """``(claim_id, doc_id, pos, stage, score)``: the best block of each claim's document.

    First a block that holds the claim verbatim (collapsed, lower case), or its first 60
    or 40 characters; else the block with the most telling shared words, where a word
    counts by how few blocks of the document have it, and the share of the block's words that
    match breaks near ties. Blank blocks are left out.

    A block of a document with few claims meets them by its document, so that a text is exchanged once and what follows stays in its
    partition; the claims of other documents find their blocks, see :func:`_marked_passages`.
    """
    claims = claims.select("claim_id", "doc_id", _flat(F.col("claim")).alias("claim"), F.array_distinct(_telling(F.col("claim"))).alias("asked"))
    claims = written(claims, "claims")
    many = written(claims.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("doc_id"), "many")
    if many.isEmpty():
        return _best_block(_met_passages(blocks, claims), ["claim_id"])
    met = _met_passages(blocks, claims.join(many, "doc_id", "left_anti"))
    found = _marked_passages(blocks.join(many, "doc_id", "left_semi"), claims.join(many, "doc_id", "left_semi"))
    return _best_block(met.unionByName(found), ["claim_id"])


def _met_passages(blocks: DataFrame, claims: DataFrame) -> DataFrame:
    """The best block of each document for each of its claims; a row for each block and claim, without the text once they have met."""
    rows = blocks.select("doc_id", "pos", "text").where(F.col("text").rlike(r"\S")).join(claims, "doc_id")
    rows = rows.select("claim_id", "doc_id", "pos", "claim", "asked", _flat(F.col("text")).alias("flat"), _telling(F.col("text")).alias("all"))
    inside = lambda n: F.contains("flat", F.substring("claim", 1, n))
    verbatim = F.when(F.col("claim") == "", None).when(F.contains("flat", F.col("claim")), 1).when(inside(60), 2).when(inside(40), 3)
    every = Window.partitionBy("doc_id", "claim_id")
    rows = rows.select("claim_id", "doc_id", "pos", verbatim.alias("stage"), F.size("asked").alias("terms"), F.size("all").alias("n_words"), F.array_intersect("asked", "all").alias("words"))
    rows = rows.withColumn("n", F.count("*").over(every)).where("stage is not null or size(words) > 0").withColumn("w", F.explode_outer("words")).drop("words")
    # by how many blocks of its document a word is had
    idf = F.log((F.col("n") + 1) / (F.count("*").over(Window.partitionBy("doc_id", "claim_id", "w")) + 1)) + 1
    rows = rows.withColumn("idf", F.when(F.col("w").isNotNull(), idf))
    rows = rows.groupBy("claim_id", "doc_id", "pos", "stage", "terms", "n_words").agg(F.sum("idf").alias("sum"), F.count("w").alias("hits"))
    density = F.col("hits") / F.least(F.lit(40), F.greatest(F.lit(1), F.col("n_words")))
    score = F.when(F.col("stage").isNotNull(), 0.0).otherwise(F.round(F.col("sum") + 0.5 * density, 9))
    rows = rows.where((F.col("stage").isNotNull()) | (F.col("hits") >= 2) | (F.col("terms") == 1))
    rows = rows.select("claim_id", "doc_id", "pos", F.coalesce("stage", F.lit(4)).alias("stage"), score.alias("score"))
    return _best_block(rows, ["doc_id", "claim_id"])


def _marked_passages(blocks: DataFrame, claims: DataFrame) -> DataFrame:
    """The same for documents with many claims, where not every block can be held against each of them.

    Blocks are found by marks: the least gram hash of every window of 40 bytes, about one mark for
    15 bytes. A block that holds a claim's first 40 characters has the mark of the claim's first
    window. Shorter claims have none and are found by their longest whole word, or in all blocks of
    their document if they hold none. Marks and words travel without the text, which is joined for
    hits only and decides there.
    """
    spark = blocks.sparkSession
    reach_workers(spark)
    held = blocks.select("doc_id", "pos", _flat(F.col("text")).alias("flat"), _telling(F.col("text")).alias("all")).where("flat <> ''")
    held = written(held.select("doc_id", "pos", "flat", F.size("all").alias("n_words"), F.array_distinct("all").alias("words")), "blocks")
    claims = written(claims, "claims")

    begins = F.substring("claim", 1, 40)
    said = claims.where("claim <> ''").select("claim_id", "doc_id", "claim", begins.alias("begins"), (F.octet_length(begins) >= WINDOW).alias("long"))
    marked = said.where("long").select("claim_id", "doc_id", "claim", F.get(_marks(F.col("begins"), WINDOW), 0).alias("mark"))
    by_mark = marked.join(held.select("doc_id", "pos", F.explode(_marks(F.col("flat"))).alias("mark")), ["doc_id", "mark"]).select("claim_id", "doc_id", "claim", "pos")
    # whole words of a short claim: the outer two may be parts of words
    inner = F.split("claim", " ")
    inner = F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0)))
    longest = F.reduce(inner, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    short = said.where("not long").select("claim_id", "doc_id", "claim", longest.alias("word"))
    worded = held.join(short.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "pos", F.explode(F.array_distinct(F.split("flat", " "))).alias("word"))
    by_word = short.where("word <> ''").join(worded, ["doc_id", "word"]).select("claim_id", "doc_id", "claim", "pos")
    by_doc = short.where("word = ''").join(held.select("doc_id", "pos"), "doc_id").select("claim_id", "doc_id", "claim", "pos")
    inside = lambda n: F.contains("flat", F.substring("claim", 1, n))
    verbatim = F.when(F.contains("flat", F.col("claim")), 1).when(inside(60), 2).when(inside(40), 3)
    near = by_mark.unionByName(by_word).unionByName(by_doc).join(held.select("doc_id", "pos", "flat"), ["doc_id", "pos"])
    first = near.withColumn("stage", verbatim).where("stage is not null").select("claim_id", "doc_id", "pos", "stage", F.lit(0.0).alias("score"))

    n = held.groupBy("doc_id").agg(F.count("*").alias("n"))
    asked = claims.select("claim_id", "doc_id", F.size("asked").alias("terms"), F.explode("asked").alias("w"))
    # words that some claim on the document has, in each of its blocks
    told_by = written(held.select("doc_id", "pos", "n_words", F.explode("words").alias("w")).join(asked.select("doc_id", "w").distinct(), ["doc_id", "w"], "left_semi"), "words")
    df = told_by.groupBy("doc_id", "w").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    told = asked.join(df, ["doc_id", "w"]).join(n, "doc_id").select("claim_id", "doc_id", "terms", "w", idf.alias("idf"))
    hit = told.join(told_by, ["doc_id", "w"]).groupBy("claim_id", "doc_id", "terms", "pos", "n_words").agg(F.sum("idf").alias("sum"), F.count("*").alias("hits"))
    density = F.col("hits") / F.least(F.lit(40), F.greatest(F.lit(1), F.col("n_words")))
    hit = hit.where((F.col("hits") >= 2) | (F.col("terms") == 1)).withColumn("score", F.col("sum") + 0.5 * density)
    every = first.unionByName(hit.select("claim_id", "doc_id", "pos", F.lit(4).alias("stage"), F.round("score", 9).alias("score")))
    return _best_block(every, ["doc_id", "claim_id"])
