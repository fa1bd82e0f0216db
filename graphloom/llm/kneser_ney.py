"""An interpolated modified Kneser-Ney model of word n-grams, counted in Spark.

Training counts the n-grams of the model's order per task (bounded tables, emitted as compact
blobs) and merges them per shard of their context, all words but the last. From the distinct
n-grams of one order follow, per shard, the number of different words before each shorter one,
which are merged per shard of their own context, down to single words. Every shard is stored in
the shared folder as sorted 64-bit hash arrays with their values. Scoring workers map those files
into memory and find all n-grams of a slice of texts by binary search; nothing of the model passes
through the driver but the totals of each order.

A context of more than a shard's share of all tokens (a very frequent word) is *hot*: its n-grams
are dealt by all their words, so that no task holds all its followers, and what is known of the
context is added up over the shards. A first pass over the texts finds the hot contexts by lossy
counts, which miss none; there are at most two for each shard and order.

Probability of a token ``w`` after the words ``h``, of which ``h'`` are all but the first:
``p(w|h) = max(c(hw) - D(c), 0) / c(h) + g(h) * p(w|h')``, and ``p(w|h')`` if ``h`` was never seen.
``c`` counts occurrences at the model's order and different predecessors below it, ``D`` are the
modified discounts of each order from its counts of counts, and ``g`` gives out what they took
away. Single words have ``p(w) = max(a(w) - D(a), 0) / A + g / (V + 1)``; one share of the
uniform part stands for all unknown words. A document begins after marks that fill the context;
its end is a token of its own.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. Defined results: a null or empty
text is one end token; with no training text every token has probability 1/(V+1) = 1;
repeated rows count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import Maps, fresh, map_file, mounted, put_file, shards_for, written
from graphloom.llm.textnum import lower, mix, shard_of, slices, span_hashes, words
from graphloom.session import reach_workers

BEGIN, END = np.uint64(1), np.uint64(2)
#: Distinct n-grams that a counting task holds before it emits them.
HELD = 1 << 21
#: Counts are stored in 32 bits; one that does not fit is this and lies in a file of its own.
BEYOND = (1 << 32) - 1

Grams = tuple[np.ndarray, ...]


def tokens(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[Grams, np.ndarray]:
    """Hashes of all tokens with the ``order - 1`` tokens before each, the farthest first, and the offsets of each text."""
    data = lower(data)
    starts, ends, n = words(data, offsets)
    at = np.r_[0, np.cumsum(n)]
    own = np.insert(span_hashes(data, starts, ends), at[1:], END)
    at = at + np.arange(len(at))
    columns = [own]
    for _ in range(order - 1):
        before = np.empty_like(own)
        before[1:] = columns[0][:-1]
        before[at[:-1]] = BEGIN
        columns.insert(0, before)
    return tuple(columns), at


def key_of(columns: Grams) -> np.ndarray:
    """One hash of several words; that of a single word is its own."""
    key = columns[0]
    for c in columns[1:]:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + mix(c ^ np.uint64(0xA0761D6478BD642F)))
    return key


def _new(columns: Grams) -> np.ndarray:
    """Where in order another n-gram begins."""
    changed = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        changed |= c[1:] != c[:-1]
    return np.flatnonzero(np.r_[True, changed][: len(columns[0])])


def summed(grams: Grams, count: np.ndarray) -> tuple[Grams, np.ndarray]:
    """Distinct n-grams in order, with their counts added up."""
    if not len(count):
        return grams, count
    order = np.lexsort(grams[::-1])
    grams, count = tuple(c[order] for c in grams), count[order]
    new = _new(grams)
    return tuple(c[new] for c in grams), np.add.reduceat(count, new)


def together(parts: list[tuple[Grams, np.ndarray]]) -> tuple[Grams, np.ndarray]:
    """Several tables of n-grams as one."""
    return summed(tuple(np.concatenate(c) for c in zip(*(g for g, _ in parts))), np.concatenate([c for _, c in parts]))


def blob(grams: Grams, count: np.ndarray) -> bytes:
    """N-grams in order in few bytes: each context once, small counts in one byte."""
    context = grams[:-1] or grams
    new = _new(context)
    size = np.diff(np.r_[new, len(count)]).astype(np.uint32)
    large = np.flatnonzero(count > 255)
    head = np.array([len(grams), len(new), len(count), len(large)], np.int64)
    packed = zlib.compress(size.tobytes() + np.minimum(count, 255).astype(np.uint8).tobytes() + large.astype(np.uint32).tobytes() + count[large].astype(np.int64).tobytes(), 1)
    return head.tobytes() + b"".join(c[new].tobytes() for c in grams[:-1]) + grams[-1].tobytes() + packed


def unblob(raw: bytes) -> tuple[Grams, np.ndarray]:
    width, groups, n, large = np.frombuffer(raw, np.int64, 4).tolist()
    context = [np.frombuffer(raw, np.uint64, groups, 32 + 8 * groups * k) for k in range(width - 1)]
    end = 32 + 8 * groups * (width - 1)
    last = np.frombuffer(raw, np.uint64, n, end)
    rest = zlib.decompress(raw[end + 8 * n :])
    size = np.frombuffer(rest, np.uint32, groups)
    count = np.frombuffer(rest, np.uint8, n, 4 * groups).astype(np.int64)
    at = np.frombuffer(rest[4 * groups + n :], np.uint32, large)
    count[at] = np.frombuffer(rest[4 * groups + n + 4 * large :], np.int64, large)
    return (*(np.repeat(c, size) for c in context), last), count


def look_up(stored: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key lies among sorted ones, and whether it does."""
    if not len(stored):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(stored, keys), len(stored) - 1)
    return at, stored[at] == keys


def by_shard(grams: Grams, count: np.ndarray, shards: int, hot: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Blobs by the shard of the context, those of ``hot`` contexts by that of the whole n-gram."""
    context = key_of(grams[:-1] or grams)
    of = shard_of(context, shards)
    spread = np.flatnonzero(look_up(hot, context)[1])
    of[spread] = shard_of(key_of(tuple(c[spread] for c in grams)), shards)
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(bounds)).tolist():
        own = order[bounds[s] : bounds[s + 1]]
        yield s, blob(tuple(c[own] for c in grams), count[own])


def hot_keys(folder: str, k: int) -> np.ndarray:
    """The hot contexts of ``k``-grams, sorted."""
    return map_file(f"{folder}/hot-keys-{k}", (np.uint64,))[0]


def put_hot_keys(docs: DataFrame, text_col: str, order: int, shards: int, folder: str) -> None:
    """Store the contexts that more than one in ``shards`` of all tokens follow.

    A task leaves out contexts of at most half that share of its own tokens, which together are at
    most half that share of all: what is left of a hot context is more than the other half, and no
    more than ``2 * shards`` contexts of an order can have that much.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [((np.zeros(0, np.uint64),), np.zeros(0, np.int64))]
        held, n = {k: list(none) for k in range(2, order + 1)}, 0

        def flush() -> pa.RecordBatch:
            out = [([0], [0], [n])]
            for k, parts in held.items():
                (key,), count = together(parts)
                much = 2 * shards * count > n
                out.append((np.full(much.sum(), k), key[much].view(np.int64), count[much]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["k", "context", "n"])

        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                grams, _ = tokens(data, offsets, order)
                n += len(grams[-1])
                for k, parts in held.items():
                    context, count = np.unique(key_of(grams[order - k : -1]), return_counts=True)
                    parts.append(((context,), count))
                    if sum(len(c) for _, c in parts[1:]) > max(1 << 19, len(parts[0][1]) // 2):
                        parts[:] = [together(parts)]
                if max(len(parts[0][1]) for parts in held.values()) > HELD:
                    yield flush()
                    held, n = {k: list(none) for k in held}, 0
        yield flush()

    def put(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        put_file(f"{folder}/hot-keys-{key[0].as_py()}", np.sort(group.column("context").to_numpy().view(np.uint64)))
        return pa.table({"n": pa.array([group.num_rows], pa.int64())})

    rows = docs.select(text_col).mapInArrow(run, "k long, context long, n long")
    rows = written(rows.groupBy("k", "context").agg(F.sum("n").alias("n")), "kneser-ney-hot")
    n = rows.where("k = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    rows.where((F.col("k") > 0) & (F.col("n") > n / (2 * shards))).groupBy("k").applyInArrow(put, "n long").agg(F.sum("n")).collect()


def gram_counts(docs: DataFrame, text_col: str, order: int, shards: int, folder: str) -> DataFrame:
    """``(shard, grams)``: the n-gram counts of each task as one blob per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = hot_keys(folder, order)
        none = (tuple(np.zeros(0, np.uint64) for _ in range(order)), np.zeros(0, np.int64))
        held = [none]

        def flush() -> Iterator[pa.RecordBatch]:
            for s, raw in by_shard(*held[0], shards, hot):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([raw], pa.binary())], ["shard", "grams"])

        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                grams, _ = tokens(data, offsets, order)
                held.append(summed(grams, np.ones(len(grams[-1]), np.int64)))
                if sum(len(c) for _, c in held[1:]) > max(1 << 19, len(held[0][1]) // 2):
                    held[:] = [together(held)]
                    if len(held[0][1]) > HELD:
                        yield from flush()
                        held[:] = [none]
        held[:] = [together(held)]
        yield from flush()

    return docs.select(text_col).mapInArrow(run, "shard int, grams binary")


def counts_of_counts(values: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(values, 5).astype(np.int64), minlength=6)[1:5].tolist()


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more."""
    n1, n2, n3, n4 = map(float, n)
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.0), k + 0.999) for k, d in enumerate(raw)]


@dataclass(frozen=True)
class Model:
    """Where a trained model lies, and its totals; discounts are those of single words first."""

    folder: str
    shards: int
    order: int
    tokens: int
    vocabulary: int
    successions: int
    discounts: tuple[tuple[float, float, float], ...]
    lower_left: float

    def save(self) -> None:
        put_file(f"{self.folder}/model.json", np.frombuffer(json.dumps(self.__dict__).encode(), np.uint8))


def _put_counts(path: str, key: np.ndarray, count: np.ndarray) -> None:
    """Counts by sorted key, in 32 bits; those that need more lie beside them."""
    put_file(path, key, np.minimum(count, BEYOND).astype(np.uint32))
    large = count >= BEYOND
    if large.any():
        put_file(f"{path}-large", key[large], count[large].astype(np.int64))


HOT = (np.uint64, np.float64, np.int64, np.int64, np.int64)


def _put_hot(parts: DataFrame, path: str) -> None:
    """Add up what the shards know of hot contexts, at most two for each shard, and store it as one file."""

    def put(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        columns = [group.column(f"n{i}").to_numpy() for i in range(5)]
        by = np.argsort(columns[0].view(np.uint64))
        put_file(path, *(c[by].view(np.uint64) if i == 0 else c[by].astype(HOT[i]) for i, c in enumerate(columns)))
        return pa.table({"n": pa.array([len(by)], pa.int64())})

    whole = parts.select(*(F.col("n")[i].alias(f"n{i}") for i in range(5))).groupBy("n0").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(1, 5)))
    whole.groupBy(F.lit(0).alias("all")).applyInArrow(put, "n long").collect()


LEVEL = "shard int, kind string, grams binary, n array<bigint>, total long, distinct long, three long"


def _level(folder: str, shards: int, k: int, top: bool):
    """Merging of one shard of ``k``-grams: its files, its totals, and blobs of the next shorter n-grams."""

    def merge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        grams, count = together([unblob(x.as_py()) for x in group.column("grams")])
        rows: list[tuple[int, str, bytes]] = []
        hot: list[list[int]] = []
        if k == 1:
            _put_counts(f"{folder}/word-{shard}", grams[0], count)
        else:
            of = key_of(grams)
            order = np.argsort(of)
            _put_counts(f"{folder}/gram-{k}-{shard}", of[order], count[order])
            new = _new(grams[:-1])
            context = key_of(tuple(c[new] for c in grams[:-1]))
            kinds = [np.add.reduceat(x.astype(np.int64), new).astype(np.uint32) for x in (count == 1, count == 2, count > 2)]
            total = np.add.reduceat(count, new)
            _, spread = look_up(hot_keys(folder, k), context)
            by = np.argsort(context)
            by = by[~spread[by]]
            put_file(f"{folder}/context-{k}-{shard}", context[by], total[by].astype(np.float64), *(x[by] for x in kinds))
            parts = [x[spread].tolist() for x in (context.view(np.int64), total, *kinds)]
            hot = [list(x) for x in zip(*parts, strict=True)]
            rows = [(s, "low", raw) for s, raw in by_shard(*summed(grams[1:], np.ones(len(count), np.int64)), shards, hot_keys(folder, k - 1))]
            if top and k > 2:
                # how often each word occurs: at order 2 the contexts' totals tell
                rows += [(s, "raw", raw) for s, raw in by_shard(*summed((grams[-2][new],), total), shards, hot_keys(folder, 1))]
        n, m = len(rows), len(hot)
        none = [None] * (n + m)
        columns = ([r[0] for r in rows] + [-1] * (m + 1), [r[1] for r in rows] + ["hot"] * m + ["sum"], [r[2] for r in rows] + [None] * (m + 1), [None] * n + hot + [counts_of_counts(count)], none + [int(count.sum())], none + [len(count)], none + [int((count > 2).sum())])
        kinds_ = (pa.int32(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64())
        return pa.table({name: pa.array(c, t) for name, c, t in zip(("shard", "kind", "grams", "n", "total", "distinct", "three"), columns, kinds_, strict=True)})

    return merge


def train(docs: DataFrame, text_col: str = "text", order: int = 2) -> Model:
    """Count ``docs`` and store the model of n-grams up to ``order`` (2 or more) in the shared folder."""
    spark = docs.sparkSession
    reach_workers(spark)
    if order < 2:
        raise ValueError("a model has an order of 2 at least")
    shards = shards_for(docs.select(text_col))
    folder = mounted(fresh(spark, "kneser-ney"))
    totals = {}
    put_hot_keys(docs, text_col, order, shards, folder)
    rows, raw = gram_counts(docs, text_col, order, shards, folder), None
    for k in range(order, 0, -1):
        # written at once, so that totals and shorter n-grams are read from one run
        path = fresh(spark, f"kneser-ney-{k}")
        rows.groupBy("shard").applyInArrow(_level(folder, shards, k, k == order), LEVEL).write.parquet(path)
        done = spark.read.schema(LEVEL).parquet(path)
        each = [F.coalesce(F.sum(F.col("n")[i]), F.lit(0)).alias(f"n{i}") for i in range(4)]
        totals[k] = done.where("kind = 'sum'").agg(*each, *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "distinct", "three"))).first()
        if k > 1:
            _put_hot(done.where("kind = 'hot'"), f"{folder}/hot-{k}")
        if k == order and order > 2:
            raw = done.where("kind = 'raw'").select("shard", "grams")
        rows = done.where("kind = 'low'").select("shard", "grams")
    if raw is not None:

        def put(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            (word,), count = together([unblob(x.as_py()) for x in group.column("grams")])
            put_file(f"{folder}/raw-{key[0].as_py()}", word, count.astype(np.float64))
            return pa.table({"n": pa.array([len(word)], pa.int64())})

        raw.groupBy("shard").applyInArrow(put, "n long").agg(F.sum("n")).collect()
    d = tuple(tuple(discounts([totals[k][f"n{i}"] for i in range(4)])) for k in range(1, order + 1))
    low = totals[1]
    taken = d[0][0] * low.n0 + d[0][1] * low.n1 + d[0][2] * low.three
    model = Model(folder, shards, order, totals[order].total, low.distinct, low.total, d, taken / low.total if low.total else 1.0)
    model.save()
    return model


class Mapped:
    """A worker's view of a model: sorted arrays mapped from the shared folder."""

    def __init__(self, model: Model):
        self.model, self.files = model, Maps()

    def arrays(self, name: str, types: tuple) -> list[np.ndarray]:
        return self.files.get(f"{self.model.folder}/{name}", types)

    def find(self, kind: str, keys: np.ndarray, of: np.ndarray, types: tuple) -> list[np.ndarray]:
        """The values of each key, 0 where it is not stored."""
        out = [np.zeros(len(keys)) for _ in types[1:]]
        order = np.lexsort((keys, of))
        bounds = np.searchsorted(of[order], np.arange(self.model.shards + 1))
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            own = order[bounds[s] : bounds[s + 1]]
            stored, *values = self.arrays(f"{kind}-{s}", types)
            at, hit = look_up(stored, keys[own])
            for o, v in zip(out, values, strict=True):
                o[own[hit]] = v[at[hit]]
        return out

    def contexts(self, k: int, keys: np.ndarray, of: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Total, and followers of count 1, 2 and more, of each context of ``k``-grams; and which are hot."""
        out = self.find(f"context-{k}", keys, of, (np.uint64, np.float64, np.uint32, np.uint32, np.uint32))
        stored, *values = self.arrays(f"hot-{k}", HOT)
        at, hot = look_up(stored, keys)
        for o, v in zip(out, values, strict=True):
            o[hot] = v[at[hot]]
        return out, hot

    def counts(self, kind: str, keys: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Counts of :func:`_put_counts`."""
        (count,) = self.find(kind, keys, of, (np.uint64, np.uint32))
        large = np.flatnonzero(count == BEYOND)
        for i in large.tolist():
            key, value = self.arrays(f"{kind}-{of[i]}-large", (np.uint64, np.int64))
            count[i] = value[np.searchsorted(key, keys[i])]
        return count

    def score(self, grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log10 probability of each token, that of the base, and whether training knows the token."""
        m, own = self.model, grams[-1]
        word, which = np.unique(own, return_inverse=True)
        a = self.counts("word", word, shard_of(word, m.shards))
        d = np.array([0.0, *m.discounts[0]])
        p = (np.maximum(a - d[np.minimum(a, 3).astype(np.int64)], 0) / max(m.successions, 1) + m.lower_left / (m.vocabulary + 1))[which]
        for k in range(2, m.order + 1):
            part = grams[m.order - k :]
            context, at = np.unique(key_of(part[:-1]), return_inverse=True)
            of = shard_of(context, m.shards)
            (total, n1, n2, n3), hot = self.contexts(k, context, of)
            e = np.array([0.0, *m.discounts[k - 1]])
            left = np.where(total > 0, (e[1] * n1 + e[2] * n2 + e[3] * n3) / np.where(total > 0, total, 1), 1.0)
            key = key_of(part)
            c = self.counts(f"gram-{k}", key, np.where(hot[at], shard_of(key, m.shards), of[at]))
            p = left[at] * p
            hit = c > 0
            p[hit] += np.maximum(c[hit] - e[np.minimum(c[hit], 3).astype(np.int64)], 0) / total[at[hit]]
        # a word begins as many pairs as it has occurrences; the end occurs once a text, as the begin mark does
        seen = np.where(word == END, BEGIN, word)
        if m.order == 2:
            (raw, *_), _ = self.contexts(2, seen, shard_of(seen, m.shards))
        else:
            (raw,) = self.find("raw", seen, shard_of(seen, m.shards), (np.uint64, np.float64))
        base = np.log10((raw + 0.5) / (m.tokens + 0.5 * (m.vocabulary + 1)))
        return np.log10(p), base[which], (raw > 0)[which]


_MAPPED: dict[str, Mapped] = {}


def mapped(model: Model) -> Mapped:
    if model.folder not in _MAPPED:
        _MAPPED.clear()
        _MAPPED[model.folder] = Mapped(model)
    return _MAPPED[model.folder]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``n_tokens, n_known, base_score, score, perplexity`` of every whole text; a narrow map."""
    reach_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = mapped(model)
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                grams, at = tokens(data, offsets, model.order)
                p, base, known = scorer.score(grams)
                n, first = np.diff(at), at[:-1]
                s = np.add.reduceat(p, first)
                values = [pa.array(n, pa.int64()), pa.array(np.add.reduceat(known.astype(np.int64), first), pa.int64()), pa.array(np.add.reduceat(base, first)), pa.array(s), pa.array(10.0 ** np.minimum(-s / n, 300.0))]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], *values], ["_id", *keep, "n_tokens", "n_known", "base_score", "score", "perplexity"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema)
    return rows.mapInArrow(run, f"{kinds}, n_tokens long, n_known long, base_score double, score double, perplexity double").withColumnRenamed("_id", id_col)


def train_and_score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """Train on the rows that are not held out, score all rows."""
    docs = docs.select(F.col(id_col), F.col(text_col), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = train(docs.where(~F.col("held_out")), text_col, order)
    out = score(docs, model, id_col, text_col, keep=("held_out",))
    return out.select(id_col, "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
