"""Passages against a search of every block, and one very long block in little memory."""

import math
import os
import random
import re
import subprocess
import sys

import numpy as np
import pytest

from graphloom.operators import search

FLAT = re.compile("[ \t\n\x0b\f\r]+")


def best_block(blocks, claim):
    """(pos, stage, score) by reading all blocks of the document, or None."""
    flat = lambda t: FLAT.sub(" ", t).strip(" \t\n\x0b\f\r").lower()
    words = lambda t: [w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) >= 3 and w not in search.STOP]
    known = [(pos, flat(t), words(t)) for pos, t in blocks if t is not None and flat(t)]
    said = flat(claim)
    for stage, part in enumerate((said, said[:60], said[:40]), 1):
        for pos, t, _ in sorted(known):
            if part and part in t:
                return pos, stage, 0.0
    asked, found = set(words(claim)), []
    for pos, _, own in known:
        hits = asked & set(own)
        if len(hits) >= min(2, len(asked)) and hits:
            idf = sum(math.log((len(known) + 1) / (sum(w in o for _, _, o in known) + 1)) + 1 for w in hits)
            found.append((-round(idf + 0.5 * len(hits) / min(40, max(1, len(own))), 9), pos))
    return (min(found)[1], 4, -min(found)[0]) if found else None


def test_marks_of_windows():
    """Whatever bytes surround a window, its mark is among those of the whole."""
    rnd = np.random.default_rng(1)
    for _ in range(200):
        inner = rnd.integers(97, 100, search.WINDOW).astype(np.uint8)
        text = np.concatenate([rnd.integers(97, 100, rnd.integers(0, 60)).astype(np.uint8), inner, rnd.integers(97, 100, rnd.integers(0, 60)).astype(np.uint8)])
        mark = search.window_marks(inner)
        assert len(mark) == 1 and mark[0] in search.window_marks(text)
    long = rnd.integers(0, 256, 30_000).astype(np.uint8)
    assert len(search.window_marks(long)) < len(long) / 10
    assert len(search.window_marks(long[:39])) == 0


def test_best_blocks(spark):
    rnd = random.Random(4)
    vocabulary = ["alpha", "beta", "gamma", "the", "of", "Zürich", "日本語", "x", "delta9", "kilo", "über", "a"] + [f"word{k}" for k in range(30)]
    sentence = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    docs = {d: [(p, rnd.choice([sentence(rnd.randint(1, 40)), sentence(12), "", " \t", "aaaa" * 40, None])) for p in range(rnd.randint(1, 12))] for d in range(25)}
    claims = []
    for d, own in docs.items():
        for _ in range(8):
            t = rnd.choice([t for _, t in own if t] or [sentence(5)])
            a = rnd.randint(0, max(0, len(t) - 5))
            cut = t[a : a + rnd.choice([3, 8, 20, 39, 40, 41, 55, 60, 61, 90])]
            claims.append((len(claims), d, rnd.choice([cut, cut.upper(), cut + " and more", "  " + cut.replace(" ", " \n"), sentence(4), ""])))
    claims.append((len(claims), 99, "no such document has this"))
    claims.append((len(claims), 1, None))
    blocks = spark.createDataFrame([(d, p, t, "x", 1) for d, own in docs.items() for p, t in own], "doc_id long, pos int, text string, mark string, n int").repartition(4)
    asked = spark.createDataFrame(claims, "claim_id long, doc_id long, claim string")
    got = {r.claim_id: (r.doc_id, r.pos, r.stage, r.score) for r in search.passages(blocks, asked).collect()}
    want = {i: (d, *b) for i, d, c in claims if c is not None and d in docs and (b := best_block(docs[d], c))}
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()}
    assert all(abs(got[k][3] - want[k][3]) < 1e-6 for k in want) and {v[2] for v in want.values()} == {1, 2, 3, 4}
    assert search.passages(blocks.limit(0), asked).count() == 0 and search.passages(blocks, asked.limit(0)).count() == 0


@pytest.mark.parametrize("few", [2, 16])
def test_documents_with_few_and_with_many_claims(spark, monkeypatch, few):
    """Both ways give what a search of every block gives, for one document with 20 claims and others with one or two."""
    monkeypatch.setattr(search, "FEW", few)
    rnd = random.Random(9)
    sentence = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "the", "Zürich", "delta9", "über", "x"] + [f"word{k}" for k in range(20)]) for _ in range(n))
    docs = {d: [(p, sentence(rnd.randint(1, 20)) if p % 4 else " ") for p in range(9)] for d in range(8)}
    claims = [(d, docs[d][rnd.randrange(9)][1][: rnd.choice([5, 30, 45, 70])] + rnd.choice(["", " and"])) for d in [0] * 20 + [1, 1, 2, 3, 4, 5, 6]]
    blocks = spark.createDataFrame([(d, p, t) for d, own in docs.items() for p, t in own], "doc_id long, pos int, text string")
    asked = spark.createDataFrame([(i, *c) for i, c in enumerate(claims)], "claim_id long, doc_id long, claim string")
    got = {r.claim_id: (r.doc_id, r.pos, r.stage, r.score) for r in search.passages(blocks, asked).collect()}
    want = {i: (d, *b) for i, (d, c) in enumerate(claims) if (b := best_block(docs[d], c))}
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()}
    assert all(abs(got[k][3] - want[k][3]) < 1e-6 for k in want)


def test_a_text_is_exchanged_once(spark):
    """Of documents with one claim each, blocks are exchanged by document and nothing is dealt by word or mark."""
    blocks = spark.createDataFrame([(d, p, f"block {p} of some document {d}") for d in range(20) for p in range(5)], "doc_id long, pos int, text string")
    claims = spark.createDataFrame([(d, d, "some document") for d in range(20)], "claim_id long, doc_id long, claim string")
    out = search.passages(blocks, claims)
    dealt = re.findall(r"Exchange hashpartitioning\((\w+?)#", out._jdf.queryExecution().executedPlan().toString())
    assert set(dealt) <= {"doc_id", "claim_id"} and len(dealt) <= 4, dealt
    assert {(r.claim_id, r.pos, r.stage) for r in out.collect()} == {(d, 0, 1) for d in range(20)}


LONG = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from graphloom.operators import search
spark = SparkSession.builder.master("local[2]").config("spark.driver.memory", "1g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
text = " ".join(f"word{{k:05}}" for k in range(20000))
blocks = spark.createDataFrame([(1, 0, "some other block"), (1, 1, text)], "doc_id long, pos int, text string")
claims = spark.createDataFrame([(1, 1, "word15000 word15001 word15002 word15003 word15004 word15005"), (2, 1, "word00100 word00101"), (3, 1, "none of word19999 and word00007")], "claim_id long, doc_id long, claim string")
print("rows", sorted((r.claim_id, r.pos, r.stage) for r in search.passages(blocks, claims).collect()))
"""


def test_one_block_of_20000_words_in_1_gb(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "long.py"
    script.write_text(LONG.format(root=root))
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=240, env=env, cwd=tmp_path)
    assert "rows [(1, 1, 1), (2, 1, 1), (3, 1, 4)]" in done.stdout, done.stderr[-2000:]
