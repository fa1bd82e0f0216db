"""Null and repeated ids, nulls in all columns and names that clash, for every operator on texts; recall of near duplicates on a given table."""

import os

import pytest
from pyspark.sql import functions as F
from test_llm_operators import shingle_sets

from graphloom.llm import bpe, kneser_ney, license_scan, packing, phrases, probminhash, quality, simhash, suffix_dedup, token_counts

NAMES = "_id _text id key key2 h shard bucket n _n print least salt label bands blocks name start"
OPERATORS = {
    "op1": lambda d: kneser_ney.train_and_score(d, F.crc32(F.col("doc_id").cast("string")) % 5 == 1),
    "op2": lambda d: token_counts.by_line(d, bpe.vocabulary_path("byte_bpe_50k.tiktoken"), rule="most"),
    "op4": lambda d: bpe.round_trip(d, bpe.vocabulary_path()),
    "op5": lambda d: license_scan.scan(d, license_scan.TEMPLATES, least=0.8),
    "op6": lambda d: suffix_dedup.removal_digest(d, suffix_dedup.find_repeats(d, least=50)),
    "op7": quality.judge,
    "op8": lambda d: packing.best_two_fit(d, bpe.vocabulary_path(), capacity=64, end_id=1),
    "op9": probminhash.near_duplicates,
    "op11": simhash.near_duplicates,
    "op13": lambda d: phrases.collocations(d, least=2),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_nulls_repeats_and_clashing_names(spark, name):
    base = " ".join(f"word{k} and some more" for k in range(30))
    rows = [(1, base, "en"), (1, base, "en"), (2, base + " x", None), (None, base, "fr"), (None, None, None), (3, None, "en"), (4, "", "en"), (2, "another text of the same id", "en"), (None, " \n", "de"), (5, license_scan.TEMPLATES[sorted(license_scan.TEMPLATES)[0]], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    clash = df.select("*", *(F.lit(k if k % 3 else None).alias(c) for k, c in enumerate(NAMES.split())))
    of = OPERATORS[name]
    got, plain = of(clash), of(df)
    assert got.columns == plain.columns
    # numbers of sequences are free
    shown = [c for c in got.columns if c not in ("sequence_id", "offset")]
    found = sorted(map(str, got.select(shown).collect()))
    assert found == sorted(map(str, plain.select(shown).collect())) and found
    if name in ("op1", "op4", "op6", "op7", "op9", "op11"):
        assert len(found) == len(rows)
    assert of(clash.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_recall_of_near_duplicates(spark):
    """Of all pairs of plain similarity 0.8 or more, by brute force over 1000 documents, nearly all share a class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {i: s for i, s in shingle_sets({r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}).items() if s}
    holders: dict = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    common: dict = {}
    for own in holders.values():
        for a in range(len(own)):
            for b in own[a + 1 :]:
                common[own[a], b] = common.get((own[a], b), 0) + 1
    pairs = [(a, b) for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    classes = {r.doc_id: r.class_id for r in probminhash.near_duplicates(docs).collect()}
    assert len(pairs) > 50 and sum(classes[a] == classes[b] for a, b in pairs) >= 0.99 * len(pairs)
