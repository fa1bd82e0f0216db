"""SimHash groups against all pairs of fingerprints."""

import collections
import itertools
import os
import random

import numpy as np
import pytest
import xxhash
from test_llm_operators import WORD, low

from graphloom.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def brute_print(text):
    w = WORD.findall(low(text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, bits=4):
    """The least place reachable from every place, by all pairs."""
    owner = list(range(len(prints)))

    def root(x):
        while owner[x] != x:
            x = owner[x]
        return x

    values = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= bits).tolist():
            x, y = root(i), root(i + 1 + j)
            owner[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(prints))]


def check(rows, expected_ids, prints):
    """Rows are (id, fingerprint, component); ``expected_ids`` and ``prints`` are aligned."""
    groups = collections.defaultdict(list)
    for place, g in enumerate(brute_groups(prints)):
        groups[g].append(place)
    want = []
    for members in groups.values():
        ids = [expected_ids[m] for m in members if expected_ids[m] is not None]
        want += [(expected_ids[m], f"{prints[m]:016x}", min(ids) if ids else None) for m in members]
    assert collections.Counter(map(tuple, rows)) == collections.Counter(want)


def test_documents(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    check(got.collect(), [r.doc_id for r in rows], [brute_print(r.text) for r in rows])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    a, b, c = "one two three four five", "six seven eight nine ten", "q"
    rows = [(None, a), (None, a), (None, b), (4, b), (4, c), (2, c), (9, None), (8, " \n"), (None, "alone here")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id int, text string, print int, least string")
    got = simhash.near_duplicates(df)
    assert dict(got.dtypes)["component_id"] == "int"
    check(got.collect(), [i for i, _ in rows], [brute_print(t) for _, t in rows])


def clusters(rnd, n, centres, flips):
    """Random fingerprints, and dense clusters around some centres."""
    out = [rnd.getrandbits(64) for _ in range(n)]
    for c in [rnd.getrandbits(64) for _ in range(centres)]:
        for _ in range(n // centres // 2):
            out.append(c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, flips))))
    return list(dict.fromkeys(out))


@pytest.mark.parametrize(("n", "centres", "flips"), [(3000, 3, 5), (2000, 200, 7), (600, 1, 3)])
def test_links_of_prints(spark, monkeypatch, n, centres, flips):
    """Many small shards, so that most partners lie beyond a boundary."""
    monkeypatch.setattr(simhash, "SHARD", 100)
    monkeypatch.setattr(simhash, "SAMPLE", 8)
    rnd = random.Random(n)
    prints = clusters(rnd, n, centres, flips)
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    df = spark.createDataFrame(signed, "print long, least long").repartition(5)
    links = simhash.link(df, 4).collect()
    owner = list(range(len(prints)))

    def root(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for r in links:
        x, y = root(r.a.least), root(r.b.least)
        owner[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(prints))] == brute_groups(prints)
    # links follow the members, not the pairs
    degree = collections.Counter(i for r in links for i in (r.a.least, r.b.least))
    assert len(links) < 12 * len(prints)
    assert max(degree.values()) < len(prints) / 2


def test_parts_hold_every_pair():
    for bits in range(9):
        masks = simhash.parts(bits)
        assert sum(int(m) for m in masks) == (1 << 64) - 1
        rnd = random.Random(bits)
        for _ in range(300):
            x = sum(1 << b for b in rnd.sample(range(64), bits))
            assert any(bin(x & int(m)).count("1") <= 1 for m in masks)


def test_tree_prunes_and_finds():
    """The tree of one part visits a small part of its leaves and misses no partner."""
    rnd = np.random.default_rng(3)
    points = rnd.integers(0, 1 << 63, 4000, dtype=np.uint64)
    mask = simhash.parts(4)[1]
    tree = simhash.plant(points, mask, 1, 4, 32, leaves := [])
    seen = collections.defaultdict(set)
    for leaf, at, _ in simhash.visits(tree, points, np.arange(4000), np.zeros(4000, bool)):
        for i in at.tolist():
            seen[i].add(leaf.leaf)
    home = {int(p): leaf.leaf for leaf in leaves for p in leaf.held}
    assert sum(map(len, seen.values())) < 0.25 * 4000 * len(leaves)
    for i in range(0, 4000, 50):
        near = np.flatnonzero(simhash.distance(points, points[i], mask) <= 1)
        assert all(home[int(j)] in seen[i] for j in near)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_simhash_trees(spark, SF).collect()
    check(got, [r.doc_id for r in rows], [brute_print(r.text) for r in rows])
    assert len({r.component_id for r in got}) < len(got)
