"""Exact removal of repeated substrings with a common-prefix interval tree.

All strings of ``least`` bytes are looked at, on the whole corpus, without sorting all of
its suffixes in one place:

1. Every string of ``least`` bytes is named by the smallest hash of the short byte runs in
   it. Equal strings have equal names, and neighbouring strings mostly share one, so a
   document is a sequence of segments, one per name. Names that occur in one document only
   cannot repeat; the others are stored as sorted files that tasks map into memory.
2. Segments with a repeated name are dealt by name. Equal segments are settled at once,
   already within a task, so that copies, however many, are one segment from then on.
3. What differs is sorted as suffixes. The common prefixes of neighbours form an interval
   tree; a scan with a stack visits its nodes, and a node whose suffixes are preceded by
   different bytes is a maximal repeat, with all its occurrences. Each occurrence outside
   the node's first document is marked with the length of its longest such node.
   A name with more than ``HOT`` segments (a notice with changing names in it) is not sorted in
   one place: its segments are cut into their single strings, which are dealt by what they say
   and compared as 128-bit hashes, equal ones within a task settled first.
4. Marks are united per document and stored as sorted files; one more narrow pass over the
   documents takes the marked bytes out.

A segment ends where its name ends, so a repeat is found as overlapping stretches, whose
union is the whole repeat. Where a name holds on because its run recurs (table rows, lists,
log lines), its segment is cut, so that no segment has more than ``2 * least - RUN`` bytes
and suffixes are compared to the end of theirs.

Defined results: a null or empty text stays empty; texts shorter than ``least`` bytes are
kept whole; equal texts keep their first document only; ids are integers and name one text
each, so that rows with one id are alike and don't remove each other; a row without an
id is kept and removes nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import fresh, map_file, mounted, put_file, shards_for
from graphloom.llm.textnum import SLICE_BYTES, mix, shard_of, slices, span_hashes, spread, window_hashes
from graphloom.session import reach_workers

#: Bytes of a short run, names that a task holds.
RUN, HELD = 16, 1 << 21
#: Segments of one name from which it is hot; counts of a task are kept in 16 bits, which is beyond it.
HOT = 1 << 15


def segments(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, end, name`` of each segment; its strings of ``least`` bytes start at ``start .. end - least``.

    One run names at most ``width`` strings, so only segments whose run recurs are cut. Equal
    strings have equal names wherever the cuts fall, so no repeat is lost.
    """
    n, width = len(data), least - RUN + 1
    size = np.diff(offsets)
    strings = np.maximum(size - least + 1, 0)
    if not strings.any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    raw = np.concatenate([data, np.zeros(RUN + 8, np.uint8)]).tobytes()
    word = np.ndarray((n + RUN,), "<u8", raw, strides=(1,))
    h = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word[8 : n + 8]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    # the smallest of ``width`` hashes from each place on, by doubling
    reach = 1
    while 2 * reach <= width:
        h = np.minimum(h[: len(h) - reach], h[reach:])
        reach *= 2
    if reach < width:
        h = np.minimum(h[: len(h) - (width - reach)], h[width - reach :])
    place, text = spread(offsets[:-1], strings), np.repeat(np.arange(len(size)), strings)
    name = h[place]
    new = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (text[1:] != text[:-1])])
    since = np.arange(len(place)) - np.repeat(new, np.diff(np.r_[new, len(place)]))
    new = np.flatnonzero(since % width == 0)
    last = np.r_[new[1:], len(place)] - 1
    return text[new], place[new], place[last] + least, name[new]


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one table in few bytes; the last may have another length."""
    raw = b"".join(a.tobytes() for a in arrays)
    head = np.array([len(arrays[0]), len(arrays[-1]), len(raw)], np.int64)
    return head.tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(raw: bytes, *types) -> list[np.ndarray]:
    n, m, size = np.frombuffer(raw, np.int64, 3).tolist()
    data = pa.decompress(raw[24:], decompressed_size=size, codec="zstd", asbytes=True)
    out, at = [], 0
    for k, t in enumerate(types):
        count = m if k == len(types) - 1 else n
        out.append(np.frombuffer(data, t, count, at))
        at += out[-1].nbytes
    return out


def _deltas(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values[:1] * 0)


def repeated_names(docs: DataFrame, least: int, shards: int, folder: str, hot: int) -> None:
    """Store the names that occur in two documents or more and whether they are hot, a sorted file per shard."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            name, many, times = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(name, kind="stable")
            name, many, times = name[order], many[order], times[order]
            new = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
            size = np.diff(np.r_[new, len(name)])
            return name[new], (size > 1) | many[new], np.minimum(np.add.reduceat(times, new), (1 << 16) - 1).astype(np.uint16)

        def flush() -> Iterator[pa.RecordBatch]:
            name, many, times = merged()
            of = shard_of(name, shards)
            for s in np.unique(of).tolist():
                own = of == s
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([_packed(_deltas(name[own]), many[own], times[own])], pa.binary())], ["shard", "names"])

        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                text, _, _, name = segments(data, offsets, least)
                # once per text, then once per slice
                order = np.lexsort((text, name))
                name, text = name[order], text[order]
                once = np.r_[True, (name[1:] != name[:-1]) | (text[1:] != text[:-1])][: len(name)]
                of_text = np.cumsum(once)
                new = np.flatnonzero(np.r_[True, name[1:] != name[:-1]][: len(name)])
                if len(new):
                    texts = np.diff(np.r_[of_text[new], of_text[-1] + 1])
                    held.append((name[new], texts > 1, np.diff(np.r_[new, len(name)])))
                if sum(len(x[0]) for x in held) > HELD:
                    yield from flush()
                    held.clear()
        if held:
            yield from flush()

    def store(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        parts = [_unpacked(x.as_py(), np.uint64, np.bool_, np.uint16) for x in group.column("names")]
        name = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        many, times = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        order = np.argsort(name, kind="stable")
        name, many, times = name[order], many[order], times[order].astype(np.int64)
        new = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        again = (np.diff(np.r_[new, len(name)]) > 1) | np.logical_or.reduceat(many, new)
        put_file(f"{folder}/name-{key[0].as_py()}", name[new][again], (np.add.reduceat(times, new) > hot)[again])
        return pa.table({"stored": pa.array([int(again.sum())], pa.int64())})

    docs.select("text").mapInArrow(names, "shard int, names binary").groupBy("shard").applyInArrow(store, "stored long").agg(F.sum("stored")).collect()


def _stored(folder: str, key: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Which names are in the stored files, and which of them are hot."""
    out, hot = np.zeros(len(key), bool), np.zeros(len(key), bool)
    of = shard_of(key, shards)
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(bounds)).tolist():
        own = order[bounds[s] : bounds[s + 1]]
        known, much = map_file(f"{folder}/name-{s}", (np.uint64, np.bool_))
        if len(known):
            at = np.minimum(np.searchsorted(known, key[own]), len(known) - 1)
            out[own] = known[at] == key[own]
            hot[own] = out[own] & much[at]
    return out, hot


def sorted_suffixes(data: np.ndarray, start: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ``data[start : start + rest]`` in order, and each one's common prefix with the one before it.

    ``data`` ends with 8 spare bytes at least.
    """
    n = len(start)
    word = np.ndarray((len(data) - 7,), ">u8", data.tobytes(), strides=(1,))

    def at(which: np.ndarray, depth: int) -> np.ndarray:
        left = rest[which] - depth
        x = word[np.minimum(start[which] + depth, len(word) - 1)].astype(np.uint64)
        cut = np.clip(8 - left, 0, 8).astype(np.uint64) * np.uint64(8)
        return np.where(left > 0, x >> np.minimum(cut, np.uint64(63)) << np.minimum(cut, np.uint64(63)), np.uint64(0))

    order = np.arange(n)
    common = np.zeros(n, np.int64)
    lo = np.zeros(min(n, 1), np.int64)  # where the groups that still tie begin, and their sizes
    size = np.array([n] if n else [], np.int64)
    for depth in range(0, int(rest.max(initial=0)), 8):
        if not len(lo):
            break
        slot = spread(lo, size)
        group = np.repeat(np.arange(len(lo)), size)
        own = order[slot]
        value = at(own, depth)
        by = np.lexsort((value, group))
        own, value = own[by], value[by]
        order[slot] = own
        first = np.r_[True, group[1:] != group[:-1]]
        diff = np.r_[np.uint64(0), value[1:] ^ value[:-1]]
        parted = ~first & (diff != 0)
        same = np.zeros(int(parted.sum()), np.int64)
        for k in range(1, 8):
            same += (diff[parted] >> np.uint64(64 - 8 * k)) == 0
        common[slot[parted]] = depth + same
        tied = ~first & ~parted
        common[slot[tied]] = depth + 8
        begin = np.flatnonzero(first | parted)
        length = np.diff(np.r_[begin, len(own)])
        lo, size = slot[begin][length > 1], length[length > 1]
    common[1:] = np.minimum(common[1:], np.minimum(rest[order[1:]], rest[order[:-1]]))
    return order, common


def interval_tree(common: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int, bool]]:
    """Nodes ``(common prefix, first, end, maximal)`` of the interval tree, each after the nodes inside it.

    ``common[i]`` is the common prefix of suffixes ``i - 1`` and ``i`` in order; ``left[i]``
    is the byte before suffix ``i``, or a number of its own where its segment begins. A node
    is a maximal repeat if its suffixes don't all have one such byte.
    """
    stack: list[list] = []  # [prefix, first, the byte before all of its suffixes or None]
    for i in range(1, len(common) + 1):
        now = common[i] if i < len(common) else 0
        first, before = i - 1, left[i - 1]
        while stack and stack[-1][0] > now:
            prefix, first, byte = stack.pop()
            before = byte if byte == before else None
            yield prefix, first, i, before is None
        if now >= least:
            if not stack or stack[-1][0] < now:
                stack.append([now, first, before])
            elif stack[-1][2] != before:
                stack[-1][2] = None


def marked(data: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``segment, start, length`` of strings that also lie in a segment of a smaller document."""
    empty = (np.zeros(0, np.int64),) * 3
    strings = size - least + 1
    segment = np.repeat(np.arange(len(size)), strings)
    start = spread(begin, strings)
    if not len(start):
        return empty
    rest = (begin + size)[segment] - start
    order, common = sorted_suffixes(np.concatenate([data, np.zeros(16, np.uint8)]), start, rest)
    # suffixes in order, in stretches that share ``least`` bytes
    near = common >= least
    near[0] = False
    head = np.flatnonzero(~near)
    length = np.diff(np.r_[head, len(order)])
    left = np.where(start[order] == begin[segment[order]], -1 - np.arange(len(order)), np.r_[data[:1] * 0, data][start[order]].astype(np.int64))
    owner = doc[segment[order]]
    low, high = np.minimum.reduceat(owner, head), np.maximum.reduceat(owner, head)
    same = np.minimum.reduceat(left, head) == np.maximum.reduceat(left, head)
    pick = np.flatnonzero((length > 1) & (low < high) & ~same)
    out_at: list[int] = []
    out_len: list[int] = []
    for h, m in zip(head[pick].tolist(), length[pick].tolist(), strict=True):
        own = owner[h : h + m].tolist()
        prefixes = common[h : h + m].tolist()
        prefixes[0] = 0
        open_: list[tuple[int, int, list[int]]] = []  # nodes done so far: first, end, suffixes not marked yet
        for prefix, first, end, maximal in interval_tree(prefixes, left[h : h + m].tolist(), least):
            rows, covered = [], end
            while open_ and open_[-1][0] >= first:
                f, e, kept = open_.pop()
                rows += kept
                rows += range(e, covered)
                covered = f
            rows += range(first, covered)
            if maximal:
                # the suffixes of a node's first document always wait for the next node
                smallest = min(own[r] for r in rows)
                out_at += [h + r for r in rows if own[r] > smallest]
                out_len += [prefix] * (len(out_at) - len(out_len))
                rows = [r for r in rows if own[r] == smallest]
            open_.append((first, end, rows))
    found = order[np.array(out_at, np.int64)]
    return segment[found], start[found] - begin[segment[found]], np.array(out_len, np.int64)


def _portions(pick: np.ndarray, name: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Runs of whole names with some ``most`` bytes each: segments of different names share nothing."""
    if not len(pick):
        return
    begin = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    load = np.cumsum(np.add.reduceat(size, begin)) // most
    cut = begin[np.flatnonzero(np.r_[True, load[1:] != load[:-1]])]
    for a, b in zip(cut, [*cut[1:], len(pick)], strict=True):
        yield pick[a:b]


def united(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that touch or overlap as one, in order of document and start."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    first = np.r_[True, doc[1:] != doc[:-1]]
    # the furthest end so far within the document
    number = np.cumsum(first) - 1
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * span) - number * span
    new = first | np.r_[True, start[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.r_[at[1:], len(doc)] - 1]


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray, shards: int) -> tuple[list[int], list[bytes]]:
    doc, start, end = united(doc, start, end)
    of = shard_of(doc.view(np.uint64), shards)
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(shards + 1))
    each = [(s, order[bounds[s] : bounds[s + 1]]) for s in np.flatnonzero(np.diff(bounds)).tolist()]
    return [s for s, _ in each], [_packed(_deltas(doc[o]), start[o], end[o]) for _, o in each]


def _later(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which have an equal one in a smaller document."""
    order = np.lexsort((doc, code))
    head = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]][: len(code)])
    first = np.empty_like(doc)
    first[order] = np.repeat(doc[order][head], np.diff(np.r_[head, len(order)]))
    return doc > first


def strings_of(data: np.ndarray, begin: np.ndarray, size: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each string of ``least`` bytes of each segment, which together tell strings apart by 128 bits."""
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    half = least // 2
    load = np.cumsum(size) // SLICE_BYTES
    cuts = np.flatnonzero(np.r_[True, load[1:] != load[:-1]][: len(size)])
    for a, b in zip(cuts, [*cuts[1:], len(size)]):
        own = size[a:b]
        flat, at = data[spread(begin[a:b], own)], spread(np.cumsum(own) - own, own - least + 1)
        one, two = window_hashes(flat, at, half), window_hashes(flat, at + half, least - half)
        out.append((mix(mix(one) + two), one))
    code, other = (np.concatenate(x) for x in zip(*out))
    return code, other


def repeated_segments(docs: DataFrame, least: int, shards: int, folder: str, settle: bool = True) -> DataFrame:
    """``(shard, open, spans)``: segments with a repeated name, dealt by name.

    With ``settle``, copies within a task are already settled, and hot names cut into strings: these
    have a negative size, and as data one of their hashes, of which the other is the name.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_numpy()
            found: list[tuple] = []
            size_now = 0

            def flush() -> Iterator[pa.RecordBatch]:
                name, doc, start, size, hot = (np.concatenate([f[k] for f in found]) for k in range(5))
                data = np.concatenate([f[5] for f in found])
                begin = np.cumsum(size) - size
                if settle:
                    # of equal segments here, only those of the smallest document are open
                    done = _later(mix(span_hashes(data, begin, begin + size) + name), doc)
                    spans = [(doc[done], start[done], (start + size)[done])]
                    own = np.flatnonzero(~done & hot)
                    rest = np.flatnonzero(~done & ~hot)
                    many = size[own] - least + 1
                    code, other = strings_of(data, begin[own], size[own], least)
                    of, at = np.repeat(doc[own], many), spread(start[own], many)
                    done = _later(code, of)
                    spans.append((of[done], at[done], at[done] + least))
                    for s, raw in zip(*_spans(*(np.concatenate(x) for x in zip(*spans)), shards), strict=True):
                        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([None], pa.binary()), pa.array([raw], pa.binary())], ["shard", "open", "spans"])
                    left = np.flatnonzero(~done)
                    flat = data[spread(begin[rest], size[rest])]
                    held = np.r_[size[rest], np.full(len(left), 8)]
                    name, doc, start = np.r_[name[rest], code[left]], np.r_[doc[rest], of[left]], np.r_[start[rest], at[left]]
                    size, data = np.r_[size[rest], np.full(len(left), -least)], np.r_[flat, other[left].view(np.uint8)]
                    begin = np.cumsum(held) - held
                else:
                    held = size
                by = np.argsort(name, kind="stable")
                of = shard_of(name[by], shards)
                for s in np.unique(of).tolist():
                    o = by[of == s]
                    raw = _packed(_deltas(name[o]), doc[o], start[o], size[o].astype(np.int32), data[spread(begin[o], held[o])])
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([raw], pa.binary()), pa.array([None], pa.binary())], ["shard", "open", "spans"])

            for a, _, data, offsets in slices(batch.column(0)):
                text, start, end, name = segments(data, offsets, least)
                known, hot = _stored(folder, name, shards)
                own = np.flatnonzero(known)
                if len(own):
                    size = end[own] - start[own]
                    found.append((name[own], ids[a + text[own]], start[own] - offsets[text[own]], size, hot[own], data[spread(start[own], size)]))
                    size_now += int(size.sum())
                if size_now > 1 << 23:
                    yield from flush()
                    found, size_now = [], 0
            if found:
                yield from flush()

    return docs.select("text", "id").mapInArrow(cut, "shard int, open binary, spans binary")


def _segments_of(group: pa.Table) -> tuple[np.ndarray, ...]:
    """``name, doc, start, size, begin, data, code, single`` of a shard's open segments, by name, content and document; ``single`` are strings."""
    parts = [_unpacked(x.as_py(), np.uint64, np.int64, np.int64, np.int32, np.uint8) for x in group.column("open").drop_null()]
    name = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    doc, start, size, data = (np.concatenate([p[k] for p in parts]) for k in range(1, 5))
    size, single = np.abs(size.astype(np.int64)), size < 0
    held = np.where(single, 8, size)
    begin = np.cumsum(held) - held
    code = mix(span_hashes(data, begin, begin + held) + name)
    order = np.lexsort((start, doc, code, single, name))
    return name[order], doc[order], start[order], size[order], begin[order], data, code[order], single[order]


def repeated_spans(docs: DataFrame, least: int, shards: int, folder: str) -> DataFrame:
    """``(shard, spans)``: parts of documents that repeat in smaller documents, dealt by document."""

    def settle(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        shards_out, out = [], []
        for raw in group.column("spans").drop_null():
            shards_out.append(key[0].as_py())
            out.append(raw.as_py())
        if group.column("open").null_count < group.num_rows:
            name, doc, start, size, begin, data, code, single = _segments_of(group)
            new_name = np.r_[True, (name[1:] != name[:-1]) | (single[1:] != single[:-1])]
            head = np.flatnonzero(new_name | np.r_[True, code[1:] != code[:-1]])
            length = np.diff(np.r_[head, len(name)])
            done = doc > np.repeat(doc[head], length)
            spans = [(doc[done], start[done], (start + size)[done])]
            # different segments of one name, of different documents, may share a part
            of_name = np.cumsum(new_name[head]) - 1
            bounds = np.flatnonzero(np.r_[True, of_name[1:] != of_name[:-1]])
            mixed = np.minimum.reduceat(doc[head], bounds) < np.maximum.reduceat(doc[head], bounds)
            pick = np.flatnonzero(mixed[of_name] & ~single[head])
            open_copies = np.add.reduceat((~done).astype(np.int64), head)
            for part in _portions(pick, of_name[pick], size[head[pick]]):
                h = head[part]
                flat = data[spread(begin[h], size[h])]
                segment, at, extent = marked(flat, np.cumsum(size[h]) - size[h], size[h], doc[h], least)
                # all open copies of the segment, which lie in its first document
                copies = open_copies[part][segment]
                row = spread(h[segment], copies)
                at, extent = np.repeat(at, copies), np.repeat(extent, copies)
                spans.append((doc[row], start[row] + at, start[row] + at + extent))
            more = _spans(*(np.concatenate(x) for x in zip(*spans)), shards)
            shards_out += more[0]
            out += more[1]
        return pa.table({"shard": pa.array(shards_out, pa.int32()), "spans": pa.array(out, pa.binary())})

    return repeated_segments(docs, least, shards, folder).groupBy("shard").applyInArrow(settle, "shard int, spans binary")


def maximal_repeats(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(group, n_bytes, id, start)``: every maximal repeat of two documents or more with all its occurrences, in bytes.

    A node of the interval tree is a group, nested ones included; so is a whole segment
    that several places share. ``group`` is a hash of the repeated string. A repeat that
    runs through several segments is reported as one group per stretch. Segments of one name, hot or not, are
    sorted in one task here, because groups nest.
    """
    spark = docs.sparkSession
    reach_workers(spark)
    folder = mounted(fresh(spark, "repeats"))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"))
    shards = shards_for(rows)
    repeated_names(rows, least, shards, folder, HOT)

    def groups(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        name, doc, start, size, begin, data, code, _ = _segments_of(group)
        head = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (code[1:] != code[:-1])])
        copies = np.diff(np.r_[head, len(name)])
        flat, own = data[spread(begin[head], size[head])], size[head]
        at = np.cumsum(own) - own
        strings = own - least + 1
        segment, first = np.repeat(np.arange(len(own)), strings), spread(at, strings)
        order, common = sorted_suffixes(np.concatenate([flat, np.zeros(16, np.uint8)]), first, (at + own)[segment] - first)
        left = np.where(first[order] == at[segment[order]], -1 - np.arange(len(order)), np.r_[flat[:1] * 0, flat][first[order]].astype(np.int64))
        prefixes = np.where(common >= least, common, 0).tolist()
        found: list[tuple[np.ndarray, np.ndarray, int]] = [(np.array([k]), np.array([0]), int(own[k])) for k in np.flatnonzero(copies > 1).tolist()]
        for prefix, lo, hi, maximal in interval_tree(prefixes, left.tolist(), least):
            if maximal and not (hi - lo == 1):
                which = segment[order[lo:hi]]
                found.append((which, first[order[lo:hi]] - at[which], prefix))
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 4]
        for which, offset, length in found:
            row = spread(head[which], copies[which])
            ids = doc[row]
            if ids.min() == ids.max():
                continue
            x = at[which[0]] + offset[0]
            name_ = int.from_bytes(hashlib.blake2b(flat[x : x + length].tobytes(), digest_size=8).digest(), "little", signed=True)
            out.append([np.full(len(row), name_), np.full(len(row), length), ids, start[row] + np.repeat(offset, copies[which])])
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*out)]
        return pa.table(dict(zip(("group", "n_bytes", "id", "start"), map(pa.array, columns), strict=True)))

    found = repeated_segments(rows, least, shards, folder, settle=False).groupBy("shard").applyInArrow(groups, "group long, n_bytes long, id long, start long")
    return found.withColumnRenamed("id", id_col)


def _put_spans(key: tuple[pa.Scalar, ...], group: pa.Table, folder: str) -> pa.Table:
    parts = [_unpacked(x.as_py(), np.int64, np.int64, np.int64) for x in group.column("spans")]
    doc = np.concatenate([np.cumsum(p[0]) for p in parts])
    doc, start, end = united(doc, *(np.concatenate([p[k] for p in parts]) for k in (1, 2)))
    put_file(f"{folder}/span-{key[0].as_py()}", doc, start, end)
    return pa.table({"n": pa.array([len(doc)], pa.int64())})


@dataclass(frozen=True)
class Repeats:
    """Where the spans to remove lie: a file per shard, by document and start."""

    folder: str
    shards: int

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``row, start, end`` of the spans of each id's document."""
        shard = shard_of(ids.view(np.uint64), self.shards)
        out = [(np.zeros(0, np.int64),) * 3]
        for s in np.unique(shard).tolist():
            rows = np.flatnonzero(shard == s)
            doc, start, end = map_file(f"{self.folder}/span-{s}", (np.int64,) * 3)
            low, high = (np.searchsorted(doc, ids[rows], side=x) for x in ("left", "right"))
            at = spread(low, high - low)
            out.append((np.repeat(rows, high - low), start[at], end[at]))
        row, start, end = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((start, row))
        return row[order], start[order], end[order]


def find_repeats(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> Repeats:
    """Find every byte covered by a string of ``least`` bytes that also starts in a document of smaller id.

    Segments of a name that more than ``hot`` have are compared string by string; 32,768 at most.
    """
    spark = docs.sparkSession
    reach_workers(spark)
    if least < RUN:
        raise ValueError(f"strings of at least {RUN} bytes are supported")
    if hot > HOT:
        raise ValueError(f"a name is hot from {HOT} segments on at the latest")
    folder = mounted(fresh(spark, "repeats"))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"))
    shards = shards_for(rows)
    repeated_names(rows, least, shards, folder, hot)

    def put(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return _put_spans(key, group, folder)

    repeated_spans(rows, least, shards, folder).groupBy("shard").applyInArrow(put, "n long").agg(F.sum("n")).collect()
    return Repeats(folder, shards)


def _kept(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which bytes of a slice stay."""
    length = np.diff(offsets)[row]
    cover = np.zeros(len(data) + 1, np.int32)
    np.add.at(cover, offsets[row] + np.minimum(start, length), 1)
    np.add.at(cover, offsets[row] + np.minimum(end, length), -1)
    return np.cumsum(cover[:-1]) == 0


def _slices_with_spans(batch: pa.RecordBatch, repeats: Repeats, text_at: int, id_at: int):
    ids = batch.column(id_at)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    row, start, end = repeats.of(ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
    good = known[row]
    row, start, end = row[good], start[good], end[good]
    for a, b, data, offsets in slices(batch.column(text_at)):
        x, y = np.searchsorted(row, [a, b])
        own = slice(x, y)
        yield a, b, data, offsets, row[own] - a, start[own], end[own]


def removal_digest(docs: DataFrame, repeats: Repeats, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row; a narrow map."""
    reach_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets, row, start, end in _slices_with_spans(batch, repeats, 1, 0):
                stay = _kept(data, offsets, row, start, end)
                left = np.r_[0, np.cumsum(stay)][offsets]
                kept = memoryview(data[stay].tobytes())
                bounds = left.tolist()
                digest = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(n - np.diff(left), pa.int64()), pa.array(np.bincount(row, minlength=b - a), pa.int64()), pa.array(digest)], ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("_id", id_col)


def without_repeats(docs: DataFrame, repeats: Repeats, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes taken out of the text, all other columns as they are.

    A character of which only a part was removed is dropped with it.
    """
    reach_workers(docs.sparkSession)
    text_at, id_at = docs.columns.index(text_col), docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets, row, start, end in _slices_with_spans(batch, repeats, text_at, id_at):
                stay = _kept(data, offsets, row, start, end)
                bounds = np.r_[0, np.cumsum(stay)][offsets].tolist()
                kept = data[stay].tobytes()
                part = batch.slice(a, b - a)
                null = part.column(text_at).is_null().to_pylist()
                texts = [None if z else kept[x:y].decode("utf-8", "ignore") for x, y, z in zip(bounds[:-1], bounds[1:], null, strict=True)]
                columns = [pa.array(texts, part.schema.field(k).type) if k == text_at else part.column(k) for k in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
