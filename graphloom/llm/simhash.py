"""Near-duplicate groups by SimHash fingerprints and vantage-point trees.

A fingerprint has 64 bits; a bit is set if more than half of a text's shingle hashes have it.
Two fingerprints link if they differ in at most ``bits`` bits, and groups are the connected
components of the links.

Fingerprints are searched in vantage-point trees. A node keeps one point and a distance; what
is at most so far from the point lies on the near side, the rest on the far side. By the
triangle inequality a partner within ``slack`` of a fingerprint can only lie on a side whose
boundary is at most ``slack`` away, so other branches are pruned. Of two fingerprints that
differ in 4 bits at most, one third of the bits differs in one bit at most. There is one tree for each
third therefore, whose boundaries overlap by one bit: with four bits and whole fingerprints a
query would visit 1.7 of 2 branches, with thirds it visits 1.3.

The upper levels of a tree are fitted on a bounded sample of the distinct fingerprints
(``SAMPLE`` of them for each shard) and name shards. Every distinct fingerprint has one home shard
in each tree and is sent as a query to the later shards that its boundary overlaps. A task
sorts the homes of its shard into the lower levels, streams the queries through them in
batches and compares whole fingerprints in the leaves. Pairs are not listed: homes that are
known to be in one group count as one partner, so a dense cluster costs links in proportion
to its members, each of whom has few links.

Copies collapse to one fingerprint first, and rows of a frequent fingerprint are salted where
they get their group. Defined results: a null, empty or blank text has fingerprint zero, which
links like any other; a text of fewer words than a shingle is one shingle; every row is a
document, also with an id that occurs again or with a null id; a group whose ids are all null
has a null id; other columns are ignored; an empty table gives no rows. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.shared import written
from graphloom.llm.textnum import lower, slices, spread, words
from graphloom.session import reach_workers

#: Distinct fingerprints that a shard of one tree is meant to hold, shards of a tree at least, and sampled fingerprints per shard.
SHARD, SHARDS, SAMPLE = 1 << 18, 16, 64
#: Homes in a leaf of the lower levels, queries in a batch, and comparisons made at a time.
LEAF, BATCH, CELLS = 64, 1 << 14, 1 << 21
#: A fingerprint with more than this share of the rows is salted; fewer than 256 can have it.
HOT = 1 / 256
WHOLE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_bits(texts: pa.Array, n: int, seed: int) -> np.ndarray:
    """The fingerprint of every text of an Arrow column."""
    out = np.zeros(len(texts), np.uint64)
    for a, _, data, offsets in slices(texts):
        data = lower(data)
        starts, ends, counts = words(data, offsets)
        lengths = ends - starts
        # words of a slice with one space after each, so that a shingle is one span
        place = np.cumsum(lengths + 1) - lengths - 1
        flat = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
        flat[spread(place, lengths)] = data[spread(starts, lengths)]
        flat, first = flat.tobytes(), 0
        for row, m in enumerate(counts.tolist(), a):
            if m:
                last = max(1, m - n + 1)
                begin = place[first : first + last]
                end = place[first + min(n, m) - 1 : first + m] + lengths[first + min(n, m) - 1 : first + m]
                ones = np.zeros(64, np.int64)
                for c in range(0, last, 1 << 16):
                    hashes = [xxhash.xxh64_intdigest(flat[s:e], seed) for s, e in zip(begin[c : c + (1 << 16)].tolist(), end[c : c + (1 << 16)].tolist())]
                    ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                out[row] = np.packbits(2 * ones > last, bitorder="little").view("<u8")[0]
                first += m
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, print)`` of every row, in a narrow map; the fingerprint is a long with the same bits."""
    reach_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = shingle_bits(batch.column(1), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["id", "print"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, print long")


@dataclass
class Node:
    """A vantage point with the two sides of its boundary, or a leaf."""

    leaf: int = -1
    held: np.ndarray | None = None  # places of a leaf's points
    vantage: np.uint64 = np.uint64(0)
    mask: np.uint64 = WHOLE
    slack: int = 0
    cut: int = 0
    near: Node | None = None
    far: Node | None = None


def distance(points: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((points ^ vantage) & mask).astype(np.int64)


def plant(points: np.ndarray, mask: np.uint64, slack: int, bits: int, most: int, leaves: list[Node], at: np.ndarray | None = None) -> Node:
    """A tree over ``points`` whose leaves, numbered in ``leaves``, hold ``most`` each where boundaries can tell points apart."""
    at = np.arange(len(points)) if at is None else at
    own = points[at]
    if len(at) > most:
        for m, s in ((mask, slack), (WHOLE, bits)) if mask != WHOLE else ((WHOLE, bits),):
            vantage = own[int(distance(own, own[0], m).argmax())]
            d = distance(own, vantage, m)
            # a boundary whose overlap takes in all points prunes nothing
            if d.max() - d.min() > 2 * s:
                cut = min(int(np.median(d)), int(d.max()) - 1)
                near = d <= cut
                return Node(vantage=vantage, mask=m, slack=s, cut=cut, near=plant(points, m, s, bits, most, leaves, at[near]), far=plant(points, m, s, bits, most, leaves, at[~near]))
    leaves.append(Node(leaf=len(leaves), held=at))
    return leaves[-1]


def visits(node: Node, points: np.ndarray, at: np.ndarray, home: np.ndarray) -> Iterator[tuple[Node, np.ndarray, np.ndarray]]:
    """``(leaf, places, whether at home)`` of all leaves that the points may have partners in."""
    if not len(at):
        return
    if node.near is None:
        yield node, at, home
        return
    d = distance(points[at], node.vantage, node.mask)
    for side, goes, lives in ((node.near, d <= node.cut + node.slack, d <= node.cut), (node.far, d > node.cut - node.slack, d > node.cut)):
        yield from visits(side, points, at[goes], (home & lives)[goes])


def parts(bits: int) -> list[np.uint64]:
    """The bits of a fingerprint cut so that of ``bits`` differing ones some part has one at most."""
    n = bits // 2 + 1
    edges = [64 * k // n for k in range(n + 1)]
    return [np.uint64((1 << b) - (1 << a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Groups:
    """Labels of points that are joined step by step; a label is the least place of its group."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def partners(leaf: Node, homes: np.ndarray, label: np.ndarray, asks: np.ndarray, at: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(query, home)`` of queries within ``bits`` of homes of the leaf: one home for each group that a query meets in a block.

    Homes are taken in order of their groups, and a query that has met a group is done with the rest of it.
    """
    held = leaf.held[np.argsort(label[leaf.held], kind="stable")]
    met, group = np.zeros(len(at), bool), -1
    for h in range(0, len(held), 256):
        block = held[h : h + 256]
        names = label[block]
        one = names[0] == names[-1] == group
        rows = np.flatnonzero(~met) if one else np.arange(len(at))
        last = np.zeros(len(at), bool)
        for c in range(0, len(rows), max(1, CELLS // len(block))):
            some = rows[c : c + max(1, CELLS // len(block))]
            q, b = np.nonzero(np.bitwise_count(asks[at[some], None] ^ homes[None, block]) <= bits)
            if len(q):
                _, first = np.unique(q * len(homes) + names[b], return_index=True)
                last[some[q[names[b] == names[-1]]]] = True
                yield at[some[q[first]]], block[b[first]]
        met, group = (met | last if names[-1] == group else last), names[-1]


def links_of(homes: np.ndarray, batches: Iterator[np.ndarray], mask: np.uint64, bits: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Links of one shard that join what all its pairs would: ``("homes", place, place)`` and, per batch, ``("asks", query, home)``."""
    tree, groups = plant(homes, mask, 1, bits, LEAF, leaves := []), Groups(len(homes))

    def found(asks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for leaf, at, _ in visits(tree, asks, np.arange(len(asks)), np.zeros(len(asks), bool)):
            yield from partners(leaf, homes, groups.label, asks, at, bits)

    low, size = 0, 256
    while low < len(homes):
        for q, h in list(found(homes[low : low + size])):
            groups.join(q + low, h)
        low, size = low + size, min(BATCH, size * 4)
    # members of a group are linked as a tree of 64 branches, so that none has many links
    order = np.argsort(groups.label, kind="stable")
    name, first, count = np.unique(groups.label[order], return_index=True, return_counts=True)
    place = np.arange(len(homes)) - np.repeat(first, count)
    parent = np.repeat(first, count) + (place - 1) // 64
    yield "homes", order[place > 0], order[parent[place > 0]]
    for asks in batches:
        for q, h in found(asks):
            yield "asks", q, h


def link(prints: DataFrame, bits: int) -> DataFrame:
    """``(a, b)`` over rows ``(print, least)`` of distinct fingerprints: links with the same components as all pairs within ``bits``."""
    spark = prints.sparkSession
    n = prints.count()
    leaves = max(SHARDS, -(-n // SHARD))
    # a bounded sample, the same each time: what has the least hashes
    sample = np.array([r[0] for r in prints.select("print").orderBy(F.xxhash64("print"), "print").limit(SAMPLE * leaves).collect()], np.int64).view(np.uint64)
    masks, trees, base = parts(bits), [], [0]
    for m in masks:
        trees.append(plant(sample, m, 1, bits, SAMPLE, found := []))
        for leaf in found:
            leaf.held = None
        base.append(base[-1] + len(found))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            for tree, low in zip(trees, base):
                seen = [(np.full(len(at), leaf.leaf), at, home) for leaf, at, home in visits(tree, points, np.arange(len(points)), np.ones(len(points), bool))]
                if seen:
                    shard, at, home = (np.concatenate(x) for x in zip(*seen))
                    own = np.zeros(len(points), np.int64)
                    own[at[home]] = shard[home]
                    # of two shards that overlap, the earlier one asks
                    keep = shard >= own[at]
                    took = batch.take(pa.array(at[keep]))
                    yield pa.RecordBatch.from_arrays([pa.array((shard[keep] + low).astype(np.int32)), pa.array(home[keep]), *took.columns], ["shard", "home", "print", "least"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def named(kind: str, a: pa.Table, b: pa.Table) -> pa.RecordBatch:
            columns = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for t in (a, b) for x in (t.column("print"), t.column("least"))]
            return pa.RecordBatch.from_arrays(columns, ["a", "a_least", "b", "b_least"])

        for shard, homes, asks in runs(batches):
            mask, asked = masks[int(np.searchsorted(base, shard, side="right")) - 1], []

            def each() -> Iterator[np.ndarray]:
                for t in asks:
                    asked[:] = [t]
                    yield t.column("print").to_numpy().view(np.uint64)

            for kind, a, b in links_of(homes.column("print").to_numpy().view(np.uint64), each(), mask, bits):
                yield named(kind, (homes if kind == "homes" else asked[0]).take(pa.array(a)), homes.take(pa.array(b)))

    dealt = prints.select("print", "least").mapInArrow(deal, "shard int, home boolean, print long, least long")
    rows = dealt.repartition(max(base[-1], int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard").sortWithinPartitions("shard", F.desc("home"))
    found = rows.mapInArrow(search, "a long, a_least long, b long, b_least long")
    # the smaller id is the smaller node, fingerprints without an id come last
    node = lambda c: F.struct(F.col(f"{c}_least").isNull().alias("none"), F.coalesce(F.col(f"{c}_least"), F.lit(0)).alias("least"), F.col(c).alias("print"))
    return found.select(node("a").alias("a"), node("b").alias("b"))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, Iterator[pa.Table]]]:
    """``(shard, homes, batches of queries)`` of rows sorted by shard with the homes first; queries are read as they are asked for."""
    waiting: list[pa.Table] = []

    def pieces() -> Iterator[pa.Table]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            shard, home = table.column("shard").to_numpy(), table.column("home").to_numpy()
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(home.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(table)]):
                if a < b:
                    yield table.slice(a, b - a)

    source = pieces()
    take = lambda: waiting.pop() if waiting else next(source, None)
    while (piece := take()) is not None:
        shard, homes = piece.column("shard")[0].as_py(), []
        while piece is not None and piece.column("shard")[0].as_py() == shard and piece.column("home")[0].as_py():
            homes.append(piece)
            piece = take()
        if piece is not None:
            waiting.append(piece)

        def asks(shard: int = shard) -> Iterator[pa.Table]:
            while (p := take()) is not None:
                if p.column("shard")[0].as_py() != shard:
                    waiting.append(p)
                    return
                yield p

        rest = asks()
        if homes:
            yield shard, pa.concat_tables(homes).combine_chunks(), rest
        for _ in rest:  # queries of a shard that has no home, or that were not read
            pass


def near_duplicates(docs: DataFrame, bits: int = 4, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row."""
    spark = docs.sparkSession
    rows = written(fingerprints(docs, shingle, seed, id_col, text_col), "prints")
    prints = written(rows.groupBy("print").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct-prints")
    groups = components(written(link(prints, bits), "simhash-links"))
    known = prints.join(groups.select(F.col("id.print").alias("print"), F.col("label"), F.lit(True).alias("linked")), "print", "left")
    known = known.select("print", F.when(~F.col("linked") | F.col("linked").isNull(), F.col("least")).when(~F.col("label.none"), F.col("label.least")).alias("component_id"))
    # rows of a frequent fingerprint are dealt over all partitions, and what they look up is repeated there
    total = prints.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [r[0] for r in prints.where(F.col("n") > HOT * total).select("print").collect()]
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.col("print").isin(hot)
    left = rows.withColumn("salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    right = known.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    out = left.join(right, ["print", "salt"])
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component_id").cast(docs.schema[id_col].dataType).alias("component_id"))
