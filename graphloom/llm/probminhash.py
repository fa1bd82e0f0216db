"""Near-duplicate groups by ProbMinHash signatures, banding and exact verification.

A text's features are its shingles of five words, weighted by how often they occur. Each
feature is a Poisson process whose rate is its weight: its arrivals fall on random
registers, every register keeps its earliest arrival, and a feature stops as soon as its
next arrival is later than all registers hold. Two signatures agree in a register with
the probability Jaccard similarity of the texts.

Equal word sequences are collapsed first, so copies, however many, are one text from then
on. Texts that agree in all registers of a band share a bucket. Each bucket first links
its members to the one that meets most others; where members of different groups remain together in a
bucket, all of them are compared by signature, in blocks, and likely links are verified
there against shingle sets that tasks map into memory. No bucket is cut, and no list of
pairs is made but of links that join two groups.
A link holds if the exact probability Jaccard similarity, or the plain one of the shingle
sets, is at least ``threshold``; groups are the connected components of the links.

Both similarities have candidates of their own: a text that repeats a shingle has a second
signature with all weights 1 and is placed by its bands too. Where no shingle repeats, the two
signatures are the same one. With the default 25 bands of 5 registers, two texts of similarity 0.8 share a bucket with
probability above 0.9999. Defined results: a text without words (null, empty, white space)
is near nothing, and its class is its own id; a text of one to four words is one shingle;
repeated rows are copies; rows of one id are one document: of different texts the one with words whose
sequence has the smallest hash stands for it, and all its rows have that text's class; a row without an id takes the class of its text; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.shared import Maps, fresh, mounted, once, only, put_file, shards_for, store_hashes, written
from graphloom.llm.textnum import lower, mix, slices, span_hashes, words
from graphloom.session import reach_workers

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Settings:
    """Shingle length, bands and their registers, and the least similarity of a link.

    ``likely`` is the share of equal registers from which a pair is verified in the second
    pass: more than three standard deviations below ``threshold`` with 125 registers.
    """

    words: int = 5
    bands: int = 25
    rows: int = 5
    threshold: float = 0.8
    likely: float = 0.68
    block: int = 256


def features(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: owner, hash, count (by owner, then hash); two hashes of each word sequence."""
    starts, ends, n = words(lower(data), offsets)
    hashed = span_hashes(lower(data), starts, ends)
    at = np.r_[0, np.cumsum(n)]
    place = np.arange(len(hashed)) - np.repeat(at[:-1], n)
    spots = place.astype(np.uint64)
    keys = []
    for salt in (_A, _B):
        total = np.r_[np.uint64(0), np.cumsum(mix(hashed ^ mix(spots * salt + salt)))][at]
        keys.append(mix((total[1:] - total[:-1]) ^ (n.astype(np.uint64) * salt)))
    # a shingle begins at each word with width - 1 more after it, or at the first of fewer
    begin = (place + width <= np.repeat(n, n)) | ((place == 0) & (np.repeat(n, n) < width))
    first = np.flatnonzero(begin)
    owner = np.repeat(np.arange(len(n)), n)[first]
    last = np.minimum(first + width, at[1:][owner])
    code = np.zeros(len(first), np.uint64)
    for k in range(width):
        inside = first + k < last
        code[inside] = mix(code[inside] + hashed[(first + k)[inside]] * _A + np.uint64(k + 1))
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    if not len(code):
        return owner, code, np.zeros(0, np.int64), keys[0], keys[1]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])])
    return owner[new], code[new], np.diff(np.r_[new, len(code)]), keys[0], keys[1]


def signatures(owner: np.ndarray, code: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """ProbMinHash signature of each text: the feature that arrives first at each register, as 32 bits."""
    times = np.full(texts * registers, np.inf)
    marks = np.zeros(texts * registers, np.uint32)
    clock = np.zeros(len(code))
    turn = 0
    label = (mix(code ^ _B) >> np.uint64(32)).astype(np.uint32)
    while len(code):
        turn += 1
        draw = mix(code + np.uint64(turn * int(_A) % (1 << 64)))
        clock = clock - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight
        slot = owner * registers + (mix(draw ^ _A) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(times, slot, clock)
        won = times[slot] == clock
        marks[slot[won]] = label[won]
        # early termination: a feature later than all registers of its text cannot change any
        latest = times.reshape(texts, registers).max(axis=1)
        stay = clock < latest[owner]
        owner, code, weight, clock, label = owner[stay], code[stay], weight[stay], clock[stay], label[stay]
    return marks.reshape(texts, registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of each signature."""
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _B, parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key + parts[:, :, r] * _A)
    return key


def sign(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """``(id, key, key2, n_shingles, bands, signature)`` of every text; a narrow map.

    A text that repeats a shingle has the bands and the signature of its weights, then those
    of its plain set; any other text has one of each, which is both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                owner, code, count, key, key2 = features(data, offsets, s.words)
                marks = signatures(owner, code, count.astype(np.float64), b - a, s.bands * s.rows)
                n = np.bincount(owner, minlength=b - a)
                again = np.bincount(owner[count > 1], minlength=b - a) > 0
                own = again[owner]
                plain = signatures(np.cumsum(again)[owner[own]] - 1, code[own], np.ones(int(own.sum())), int(again.sum()), s.bands * s.rows)
                # each text's signatures in turn, the plain one last
                at = np.r_[0, np.cumsum(1 + again)]
                both = np.empty((at[-1], s.bands * s.rows), np.uint32)
                both[at[:-1]] = marks
                both[at[1:][again] - 1] = plain
                keys = band_keys(both, s.bands, s.rows)
                bands = pa.ListArray.from_arrays(pa.array(at * s.bands, pa.int32()), pa.array(keys.ravel().view(np.int64)))
                raw = pa.array([both[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(key.view(np.int64)), pa.array(key2.view(np.int64)), pa.array(n, pa.int64()), bands, raw], ["_id", "key", "key2", "n_shingles", "bands", "signature"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, key long, key2 long, n_shingles long, bands array<bigint>, signature binary")


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The larger of the exact probability Jaccard similarity and the plain one of the sets."""
    common, at, bt = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    union = len(a) + len(b) - len(common)
    if not len(common):
        return 0.0
    plain = len(common) / union
    if plain >= 1 or (wa.max() == 1 and wb.max() == 1):
        return plain
    x = np.r_[wa[at], np.delete(wa, at), np.zeros(len(b) - len(bt))].astype(np.float64)
    y = np.r_[wb[bt], np.zeros(len(a) - len(at)), np.delete(wb, bt)].astype(np.float64)
    ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio)
    sx, sy, sr = x[order], y[order], ratio[order]
    below = np.searchsorted(sr, ratio[: len(common)])
    cx, cy = np.r_[0, np.cumsum(sx)], np.r_[0, np.cumsum(sy)]
    spread = (cx[-1] - cx[below]) / x[: len(common)] + cy[below] / y[: len(common)]
    return max(plain, float((1 / spread).sum()))


def shingle_sets(docs: DataFrame, wanted: DataFrame, s: Settings, id_col: str, text_col: str, several: DataFrame | None = None) -> DataFrame:
    """``(_id, h, code, count)``: exact shingle counts of the documents whose id hash is in ``wanted``; one scan, no shuffle of texts.

    Of an id in ``several`` only the text that stands for it counts.
    """
    known = store_hashes(wanted, "wanted")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = known.has(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "h")))
            batch = batch.filter(pa.array(own))
            for a, b, data, offsets in slices(batch.column(1)):
                owner, code, count, key, key2 = features(data, offsets, s.words)
                at = np.searchsorted(owner, np.arange(b - a + 1)).tolist()
                count = count.astype(np.int32)
                both = [(code[x:y].tobytes(), count[x:y].tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(key.view(np.int64)), pa.array(key2.view(np.int64)), pa.array([x for x, _ in both], pa.binary()), pa.array([y for _, y in both], pa.binary())], ["_id", "h", "key", "key2", "code", "count"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.xxhash64(id_col).alias("h"))
    kind = rows.schema["_id"].dataType.simpleString()
    rows = rows.select("_id", "_text", "h", known.shard("h").alias("shard"))
    found = rows.mapInArrow(shingle, f"_id {kind}, h long, key long, key2 long, code binary, count binary")
    if several is not None:
        found = found.join(several.select(F.col("id").alias("_id"), "stands"), "_id", "left").where("stands is null or (key = stands.key and key2 = stands.key2)")
    return found.select("_id", "h", "code", "count")


def verify(pairs: DataFrame, docs: DataFrame, s: Settings, id_col: str, text_col: str, several: DataFrame | None = None) -> DataFrame:
    """The pairs ``(a, b)`` whose texts are similar enough, from their exact shingle counts."""
    wanted = pairs.select(F.xxhash64("a").alias("h")).union(pairs.select(F.xxhash64("b").alias("h")))
    sets = once(written(shingle_sets(docs, wanted, s, id_col, text_col, several), "shingles"), "_id")
    kind = sets.schema["_id"].dataType.simpleString()
    left = sets.select(F.col("_id").alias("a"), F.col("code").alias("code_a"), F.col("count").alias("count_a"))
    right = sets.select(F.col("_id").alias("b"), F.col("code").alias("code_b"), F.col("count").alias("count_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(0, batch.num_rows, 512):
                part = batch.slice(x, 512)
                columns = [part.column(c).to_pylist() for c in ("code_a", "count_a", "code_b", "count_b")]
                good = [similarity(np.frombuffer(p, np.uint64), np.frombuffer(q, np.int32), np.frombuffer(r, np.uint64), np.frombuffer(t, np.int32)) >= s.threshold - 1e-12 for p, q, r, t in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").mapInArrow(compare, f"a {kind}, b {kind}")


class StoredSets:
    """Shingle sets in mapped files, by the hash of their document's id."""

    KINDS = (("key", np.int64), ("at", np.int64), ("code", np.uint64), ("count", np.int32))

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards, self.files = folder, shards, Maps()

    @classmethod
    def store(cls, sets: DataFrame) -> StoredSets:
        """Write ``(h, code, count)`` in the shared folder, a few files per shard."""
        spark = sets.sparkSession
        folder, shards = mounted(fresh(spark, "sets")), shards_for(sets)

        def put(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            h = group.column("h").to_numpy()
            h, first = np.unique(h, return_index=True)
            codes = [group.column("code")[i].as_py() for i in first.tolist()]
            counts = [group.column("count")[i].as_py() for i in first.tolist()]
            at = np.cumsum([len(c) // 8 for c in codes])
            arrays = (h, at, np.frombuffer(b"".join(codes), np.uint64), np.frombuffer(b"".join(counts), np.int32))
            for (name, _), a in zip(cls.KINDS, arrays, strict=True):
                put_file(f"{folder}/{name}-{key[0].as_py()}", a)
            return pa.table({"n": pa.array([len(h)], pa.int64())})

        dealt = sets.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h", "code", "count")
        dealt.groupBy("shard").applyInArrow(put, "n long").agg(F.sum("n")).collect()
        return cls(folder, shards)

    def get(self, h: int) -> tuple[np.ndarray, np.ndarray]:
        shard = h % self.shards
        key, at, code, count = (self.files.get(f"{self.folder}/{name}-{shard}", (t,))[0] for name, t in self.KINDS)
        i = int(np.searchsorted(key, h))
        low = int(at[i - 1]) if i else 0
        return code[low : int(at[i])], count[low : int(at[i])]


def _first_and_last(rows: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The weighted and the plain part of each row, which are one where it has one only."""
    return np.array([r[:width] for r in rows]).reshape(-1, width), np.array([r[-width:] for r in rows]).reshape(-1, width)


def _across(members: DataFrame, sets: StoredSets, s: Settings, kind: str) -> DataFrame:
    """Verified links between members of one bucket that belong to different groups.

    ``members``: ``bucket, n, id, label, bands, signature`` with all ``n`` members of each
    bucket. A bucket is dealt into blocks of at most about ``block`` members, and every two blocks meet once, whatever the bucket's
    size. Likely pairs are verified where they meet, each pair in the first band that it
    shares, and none whose groups a link of the same block has joined already, so that no
    more links leave a block than it has members.
    """
    dealt = members.withColumn("blocks", F.ceil(F.col("n") / s.block).cast("int")).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = dealt.withColumn("other", other).select("bucket", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") <= F.col("other")).alias("first"), "id", F.xxhash64("id").alias("h"), "label", "bands", "signature")

    def compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        n = group.num_rows
        marks, plain = _first_and_last([np.frombuffer(x, np.uint32) for x in group.column("signature").to_pylist()], s.bands * s.rows)
        bands, plain_bands = _first_and_last([np.array(x, np.int64) for x in group.column("bands").to_pylist()], s.bands)
        band = int(np.flatnonzero((bands[0] == key[0].as_py()) | (plain_bands[0] == key[0].as_py()))[0])
        _, label = np.unique(group.column("label").to_numpy(zero_copy_only=False), return_inverse=True)
        h, first = group.column("h").to_pylist(), group.column("first").to_numpy()
        same = key[1].as_py() == key[2].as_py()
        left = np.arange(n) if same else np.flatnonzero(first)
        right = left if same else np.flatnonzero(~first)
        pairs: list[tuple[int, int]] = []
        for i in left.tolist():
            rest = right[(label[right] != label[i]) & ((right > i) if same else True)]
            share = np.maximum((marks[rest] == marks[i]).mean(axis=1), (plain[rest] == plain[i]).mean(axis=1)) if len(rest) else np.zeros(0)
            met_before = np.zeros(len(rest), bool)
            for x in (bands, plain_bands):
                for y in (bands, plain_bands):
                    met_before |= (x[rest, :band] == y[i, :band]).any(axis=1)
            good = (share >= s.likely) & ~met_before
            # the likeliest first: a link spares the rest of its group
            for j in rest[good][np.argsort(-share[good], kind="stable")].tolist():
                if label[i] != label[j] and similarity(*sets.get(h[i]), *sets.get(h[j])) >= s.threshold - 1e-12:
                    pairs.append((i, j))
                    label[label == label[j]] = label[i]
        ids = group.column("id").combine_chunks()
        take = lambda k: ids.take(pa.array([p[k] for p in pairs], pa.int64()))
        return pa.table({"x": take(0), "y": take(1)})

    # dealt by block, not by bucket: the blocks of a large bucket go to different tasks
    found = met.repartition("bucket", "low", "high").groupBy("bucket", "low", "high").applyInArrow(compare, f"x {kind}, y {kind}")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, class_id, n_shingles)`` of every row: the smallest id of the group that its text belongs to."""
    reach_workers(docs.sparkSession)
    signed = written(sign(docs, s, id_col, text_col), "signed")
    kind = signed.schema["_id"].dataType.simpleString()
    rows = signed.select("_id", "key", "key2", "n_shingles")
    # ids with different texts, and the one that stands for each
    both = F.struct((F.col("n_shingles") == 0).alias("blank"), "key", "key2")
    several = written(rows.where("_id is not null").groupBy(F.col("_id").alias("id")).agg(F.min(both).alias("stands"), F.max(both).alias("other")).where("stands <> other").select("id", "stands"), "several")
    own = rows
    if several.isEmpty():
        several = None
    else:
        known = rows.join(several, rows["_id"] == several["id"], "left")
        rows = written(known.select("_id", F.coalesce("stands.key", "key").alias("key"), F.coalesce("stands.key2", "key2").alias("key2"), "n_shingles"), "rows")
        own = known.where("stands is null or (key = stands.key and key2 = stands.key2)").select("_id", "key", "key2", "n_shingles")
    # one text of each word sequence; equal texts have equal signatures, so any of them serves
    texts = own.where("n_shingles > 0").groupBy("key", "key2").agg(F.min("_id").alias("id")).where("id is not null")
    picked = only(signed.where("_id is not null"), F.xxhash64("_id", "key", "key2"), texts.select(F.xxhash64("id", "key", "key2")), "picked")
    chosen = once(written(picked.select(F.col("_id").alias("id"), "bands", "signature"), "texts"), "id")
    placed = chosen.select("id", F.explode(F.array_distinct("bands")).alias("bucket"))
    # A bucket's head is its member that meets most others over all its buckets: of a family of
    # copies the text they were made from, which is nearer to each than they are to one another.
    # both sides of a join on buckets are tables, so that adaptive execution can split a large bucket
    shared = written(placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = written(placed.join(shared, "bucket"), "met")
    known = met.groupBy("id").agg(F.sum("n").alias("meets"))
    heads = written(met.join(known, "id").groupBy("bucket").agg(F.max(F.struct("meets", F.xxhash64("id"), F.col("id").alias("head"))).alias("m")).select("bucket", "m.head"), "heads")
    members = written(met.join(heads, "bucket").select("bucket", "n", "id", "head"), "members")
    star = members.where("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
    links = written(verify(written(star, "pairs"), docs, s, id_col, text_col, several), "links")
    groups = components(links)
    # buckets in which different groups still meet
    labelled = members.select("bucket", "n", "id").join(groups, "id", "left").select("bucket", "n", "id", F.coalesce("label", "id").alias("label"))
    labelled = written(labelled, "labelled")
    mixed = written(labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket"), "mixed")
    open_ = written(labelled.join(mixed, "bucket"), "mixed")
    if not open_.isEmpty():
        open_ = written(open_.join(only(chosen, F.xxhash64("id"), open_.select(F.xxhash64("id")), "open"), "id"), "mixed")
        sets = StoredSets.store(shingle_sets(docs, open_.select(F.xxhash64("id").alias("h")), s, id_col, text_col, several))
        links = links.unionByName(_across(open_, sets, s, kind))
        groups = components(links)
    # a table of its own, so that adaptive execution can split the rows of one text's many copies
    classes = written(texts.join(groups, "id", "left").select("key", "key2", F.coalesce("label", "id").alias("class_id")), "classes")
    out = rows.join(classes, ["key", "key2"], "left")
    return out.select(F.col("_id").alias(id_col), F.coalesce("class_id", "_id").alias("class_id"), "n_shingles")
