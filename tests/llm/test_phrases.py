"""Phrases against plain counting."""

import collections
import os
import random
import re

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from test_llm_operators import low

from graphloom.llm import phrases, queries, shared


def brute(rows, least, longest, share, limit):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(text or "")):
            w = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(w)
            f.update((lang, w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    good = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    held = collections.defaultdict(int)
    for (lang, w), a in good.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                held[lang, w[i : i + m]] = max(held[lang, w[i : i + m]], a)
    out = collections.defaultdict(list)
    for (lang, w), a in good.items():
        if 100 * held.get((lang, w), -1) < share * a:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(own)[:limit], 1)}


def texts(rnd, count):
    vocabulary = ["the", "of", "New", "york", "é", "x\x01", "x", "ab", "\x00", "b\x85c", "İ", "Zürich", "日本"]
    fixed = ["new york city hall is", "of the X\x01 x", "a b a b a b", "the the the the the the"]
    out = []
    for i in range(count):
        words = [rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30))]
        text = "".join(w + rnd.choice([" ", " ", " ", " ", "\t", "  ", ". ", "\n", ",", "!", "\x0b"]) for w in words)
        out.append((rnd.choice(["en", "en", "fr", None, "", "und"]), text))
    return [*out, ("en", None), ("fr", ""), ("fr", " ., \n"), ("en", "the of " * 20000)]


@pytest.mark.parametrize(("least", "longest", "share", "limit", "sample"), [(5, 5, 100, 2000, 32), (2, 4, 60, 25, 1), (40, 2, 100, 7, 3), (1, 5, 100, 2000, 1)])
def test_collocations(spark, monkeypatch, least, longest, share, limit, sample):
    monkeypatch.setattr(phrases, "COUNT_BYTES", 500)
    monkeypatch.setattr(phrases, "SAMPLE", sample)
    rows = texts(random.Random(least), 300)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, phrase string").repartition(6)
    got = phrases.collocations(df, least, longest, share, limit)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    want = brute(rows, least, longest, share, limit)
    found = [tuple(r) for r in got.collect()]
    assert len(want) > 5 and len(found) == len(want) and set(found) == want


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).count() == 0


def test_products_beyond_64_bits(spark):
    """Counts are given, so that products need more than 64 bits."""
    big = 3 * 10**12
    rows = spark.createDataFrame([("en", "a", 10**12 + 7), ("en", "b", 7 * 10**11 + 3), ("en", "a b", 6 * 10**11 + 1)], "lang string, phrase string, a long")
    out = phrases.scored(rows, spark.createDataFrame([("en", big)], "lang string, n long"), 100).collect()
    assert [r.score for r in out] == [1000 * (6 * 10**11 + 1) * big // ((10**12 + 7) * (7 * 10**11 + 3))]


def test_filter_misses_none(spark, monkeypatch):
    """Also where it is smaller than its values need and lies in several files."""
    values = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 30_000)
    df = spark.createDataFrame([(int(v),) for v in values], "h long")
    full = shared.store_filter(df, "test")
    assert full.has(values.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 30_000).view(np.uint64)
    assert full.has(others).mean() < 0.05
    monkeypatch.setattr(shared, "FILTER_MOST", 1 << 17)
    monkeypatch.setattr(shared, "FILTER_FILE", 1 << 15)
    few = shared.store_filter(df, "test")
    assert few.bits == 1 << 17 and few.has(values.view(np.uint64)).all() and len({*few.places(others)[0].tolist()}) == 4
    assert not shared.store_filter(df.where(F.lit(False)), "test").has(others).any()


def test_few_maps_and_bounded_copies(tmp_path, monkeypatch):
    """A worker keeps the maps that it used last; a node keeps copies of stored files up to a size, and what is mapped stays readable."""
    for k in range(6):
        shared.put_file(str(tmp_path / f"f{k}"), np.full(1000, k, np.int64))
    monkeypatch.setattr(shared, "OPEN_MAPS", 3)
    maps = shared.Maps()
    for k in (0, 1, 2, 0, 3, 4, 0, 5):
        assert maps.get(str(tmp_path / f"f{k}"), (np.int64,))[0][0] == k
    assert [p[-1] for p in maps.open] == ["4", "0", "5"] and not len(maps.get(str(tmp_path / "none"), (np.int64,))[0])
    # a store that is not mounted: every file is read through a local copy
    monkeypatch.setattr(shared, "_store", lambda path: (fs.LocalFileSystem(), path.removeprefix("far://")))
    monkeypatch.setattr(shared.tempfile, "gettempdir", lambda: str(tmp_path))
    monkeypatch.setattr(shared, "CACHE_BYTES", 20_000)
    first = shared.map_file(f"far://{tmp_path}/f0", (np.int64,))[0]
    for k in (1, 2, 3, 1, 4, 5, 0):
        assert shared.map_file(f"far://{tmp_path}/f{k}", (np.int64,))[0].tolist() == [k] * 1000
        assert sum(p.stat().st_size for p in (tmp_path / "graphloom-cache").iterdir()) <= 20_000
    assert first[0] == 0 and not len(shared.map_file(f"far://{tmp_path}/none", (np.int64,))[0])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    want = brute(rows, 100, 5, 100, 2000)
    assert want and {tuple(r) for r in queries.op13_phrases(spark, sf).collect()} == want
