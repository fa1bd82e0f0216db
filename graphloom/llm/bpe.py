"""BPE encoding and decoding in batched numpy merge rounds.

A vocabulary file of the ``tokenizers`` JSON kind with word ends (``</w>``) is read once
per worker. Texts are cut at white space; the pieces of all words that the worker has not
met yet are merged together: their symbols lie in one flat array, each round finds the
rank of every adjacent pair by binary search over the sorted pair keys, and merges every
word's lowest-ranked pair at all its places. A bounded table keeps words already merged.

Defined results: a null or empty text has no ids; an empty table gives no rows; any other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textnum import spread
from graphloom.session import reach_workers

#: Words that a worker remembers at most; beyond that it starts anew.
REMEMBERED = 300_000
#: Characters of text that are encoded together.
TOGETHER = 1 << 21
NONE = np.iinfo(np.int32).max


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the box keeps the public vocabulary files."""
    try:
        import public_tokenizers
    except ImportError:
        return f"/opt/tokenizers/{name}"
    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


#: A full stop or comma after a letter or digit and before white space is a piece of its own.
_STOP = re.compile(r"([.,])(?<=[^\W_][.,])(?!\S)")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def _latin(text: str) -> bool:
    """Only code points below 256: they are their own NFC and have one letter each in lower case."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class BpeCodec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("vocabularies of up to 65,536 tokens are supported")
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = text
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.uint32)
        self.final = np.array([vocab[c + end] for c in letters], dtype=np.uint32)
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], dtype=np.uint32)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.uint32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.white = regex.compile(r"[^\s]+").findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.int32)
        self.used = 0

    def chunks(self, text: str) -> list[str]:
        """The text cut at white space, as the vocabulary's own pattern sees white space.

        Plain Latin text is put into lower case as a whole and loses the full stops and
        commas after its words, so that fewer different chunks remain.
        """
        if text.isascii() or _latin(text):
            if "<|" not in text and not _SEPARATORS.search(text):
                return _STOP.sub(r" \1", text.lower()).split()
        return self.white(text)

    def _pieces_of(self, chunk: str) -> list[bytes | int]:
        """Byte strings to be merged, and the ids of special tokens written out in the text."""
        parts = self.at_special(chunk) if self.at_special and "<|" in chunk else [chunk]
        out: list[bytes | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                if part.isalpha() and (part.isascii() or _latin(part)):
                    out.append(part.lower().encode())
                elif part.isascii():
                    out += [p.encode() for p in self.pieces(part.lower())]
                elif any(unicodedata.category(c) == "Cn" for c in part):
                    out += self._newer(part)
                else:
                    out += [p.encode() for p in self.pieces("".join(c.lower() for c in unicodedata.normalize("NFC", part)))]
        return out

    def _newer(self, part: str) -> list[bytes]:
        """The same for text with characters newer than Python's own tables: the vocabulary's library splits it."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return [bytes(map(self.byte_of.__getitem__, p)) for p, _ in cut]

    def _pairs(self, left: np.ndarray, right: np.ndarray, together: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair, by binary search over the sorted pair keys."""
        pair = left << 16 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        hit = (self.keys[at] == pair) & together
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and how many each piece has."""
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.inner[data]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.final[data[ends]]
        done_ids, done_of = [], []
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        rank, made = self._pairs(symbols[:-1], symbols[1:], owner[:-1] == owner[1:])
        rank, made = np.append(rank, NONE), np.append(made, 0)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[first, len(owner)])
            best = np.minimum.reduceat(rank, first)
            over = np.repeat(best == NONE, size)
            if over.any():  # these pieces are finished
                done_ids.append(symbols[over])
                done_of.append(owner[over])
                keep = ~over
                symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
                best, size = best[best != NONE], size[best != NONE]
                if not len(symbols):
                    break
            run = np.flatnonzero(rank == np.repeat(best, size))
            # of places side by side (the same symbol repeated) every other one from the left merges
            if len(run) > 1 and (near := np.diff(run) == 1).any():
                begin = np.r_[True, ~near]
                step = np.arange(len(run)) - np.maximum.accumulate(np.where(begin, np.arange(len(run)), 0))
                run = run[step % 2 == 0]
            symbols[run] = made[run]
            keep = np.ones(len(symbols), bool)
            keep[run + 1] = False
            symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
            # only pairs with a merged symbol have another rank now
            run -= np.arange(len(run))
            changed = np.concatenate([run, run[run > 0] - 1])
            right = np.minimum(changed + 1, len(symbols) - 1)
            rank[changed], made[changed] = self._pairs(symbols[changed], symbols[right], (owner[changed] == owner[right]) & (right > changed))
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.uint32)
        of = np.concatenate(done_of) if done_of else np.zeros(0, np.int64)
        order = np.argsort(of, kind="stable")
        return ids[order].astype(np.int32), np.bincount(of, minlength=len(pieces))

    def learn(self, chunks: list[str]) -> None:
        """Merge chunks that are not known yet and remember them."""
        found = [self._pieces_of(c) for c in chunks]
        flat = [p for f in found for p in f]
        plain = [p for p in flat if isinstance(p, bytes)]
        distinct = {p: i for i, p in enumerate(dict.fromkeys(plain))}
        ids, counts = self.merge(list(distinct))
        which = np.fromiter(map(distinct.__getitem__, plain), np.int64, len(plain))
        ids, counts = ids[spread((np.cumsum(counts) - counts)[which], counts[which])], counts[which]
        if any(isinstance(p, int) for p in flat):
            special = np.array([isinstance(p, int) for p in flat])
            every = np.ones(len(flat), np.int64)
            every[~special] = counts
            out = np.empty(int(every.sum()), np.int32)
            begin = np.cumsum(every) - every
            out[begin[special]] = [p for p in flat if isinstance(p, int)]
            out[spread(begin[~special], counts)] = ids
            ids, counts = out, every
        owner = np.repeat(np.arange(len(found)), np.fromiter(map(len, found), np.int64, len(found)))
        per_chunk = np.bincount(owner, weights=counts, minlength=len(found)).astype(np.int64)
        n, m = len(self.known), self.used
        while n + len(found) > len(self.start):
            self.start, self.count = np.r_[self.start, np.zeros_like(self.start)], np.r_[self.count, np.zeros_like(self.count)]
        while m + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        self.start[n : n + len(found)] = m + np.cumsum(per_chunk) - per_chunk
        self.count[n : n + len(found)] = per_chunk
        self.ids[m : m + len(ids)] = ids
        self.used = m + len(ids)
        self.known.update(zip(chunks, range(n, n + len(found)), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of each text in it."""
        cut = [self.chunks(t) if t else [] for t in texts]
        flat = [c for x in cut for c in x]
        new = set(flat).difference(self.known)
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.forget()
                new = set(flat)
            self.learn(list(new))
        code = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        counts = self.count[code]
        ids = self.ids[spread(self.start[code], counts)]
        sizes = np.r_[0, np.cumsum(counts)][np.r_[0, np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))]]
        return ids, sizes

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space: the vocabulary names no decoder of its own."""
        return " ".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """The worker's codec of a vocabulary file."""
    if path not in _CODECS:
        _CODECS.clear()
        _CODECS[path] = BpeCodec(path)
    return _CODECS[path]


def groups(texts: list[str | None], limit: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``limit`` characters, or of one text."""
    a = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and size + n > limit:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` of every whole text; a narrow map with no shuffle."""
    reach_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups(texts):
                ids, offsets = bpe.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], ["_id", "ids"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` of every array of ids; null ids give null."""
    reach_workers(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [None if i is None else bpe.decode(i) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["_id", "text"])

    rows = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, text string").withColumnRenamed("_id", id_col)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: every text encoded, its ids decoded again, both digested.

    Digests are taken where the ids are made, so that neither ids nor decoded texts,
    several times as long as the input, travel between processes.
    """
    reach_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        digits = [str(i) for i in range(len(bpe.tokens))]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups(texts):
                ids, offsets = bpe.encode(texts[a:b])
                every = ids.tolist()
                hashed, back = [], []
                for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = every[x:y]
                    hashed.append(hashlib.sha256(" ".join(map(digits.__getitem__, own)).encode()).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(own).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets), pa.int64()), pa.array(hashed), pa.array(back)], ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_col)
