"""Operators against brute force on small tables with edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, kneser_ney, license_scan, packing, preference, probminhash, quality, suffix_dedup, token_counts, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


def empty(docs):
    return docs.limit(0)


def library(name):
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.vocabulary_path(name))


def test_bpe_matches_the_library(docs, by_id):
    tok, path = library("word_bpe_49k.json"), bpe.vocabulary_path()
    for r in bpe.round_trip(docs, path).collect():
        ids = tok.encode(by_id[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(empty(docs), path).count() == 0
    encoded = bpe.encode(docs, path)
    assert all(r.text == tok.decode(tok.encode(by_id[r.doc_id], add_special_tokens=False).ids, skip_special_tokens=False) for r in bpe.decode(encoded, path).collect())


def test_bpe_every_code_point():
    tok, codec = library("word_bpe_49k.json"), bpe.BpeCodec(bpe.vocabulary_path())
    texts = [f"a{chr(c)}b 1{chr(c)}." for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0)]
    ids, offsets = codec.encode(texts)
    want = tok.encode_batch(texts, add_special_tokens=False)
    assert all(ids[a:b].tolist() == w.ids for a, b, w in zip(offsets[:-1], offsets[1:], want, strict=True))


def test_bpe_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    codec, fresh = bpe.BpeCodec(bpe.vocabulary_path()), bpe.BpeCodec(bpe.vocabulary_path())
    for k in range(6):
        texts = [f"word{k * j} aaaa{'a' * j} the" for j in range(20)]
        a, b = codec.encode(texts), fresh.encode(texts)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_packing(docs, by_id):
    codec = bpe.BpeCodec(bpe.vocabulary_path())
    rows = packing.best_two_fit(docs.dropDuplicates(["doc_id"]), bpe.vocabulary_path(), capacity=512, end_id=1).toPandas()
    for i, own in rows.groupby("doc_id"):
        ids = np.append(codec.encode([by_id[i]])[0], 1).astype("<u4")
        own = own.sort_values("piece")
        assert own.start.tolist() == list(range(0, len(ids), 512)) and own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + 512].tobytes()) for s in own.start]
    for _, bin_ in rows.groupby("sequence_id"):
        bin_ = bin_.sort_values("offset")
        assert bin_.length.sum() <= 512 and bin_.offset.tolist() == [0, *np.cumsum(bin_.length)[:-1]]
    assert set(rows.doc_id) == set(by_id)
    assert rows.sequence_id.nunique() == math.ceil(rows.length.sum() / 512)
    assert packing.best_two_fit(empty(docs), bpe.vocabulary_path()).count() == 0


def test_plan_uses_every_piece():
    rnd = np.random.default_rng(1)
    for cap in (7, 64, 300):
        counts = np.zeros(cap + 1, np.int64)
        np.add.at(counts, rnd.integers(1, cap + 1, 5000), 1)
        used = np.zeros(cap + 1, np.int64)
        for items, times in packing.plan(counts, cap):
            assert sum(items) <= cap
            np.add.at(used, items, times)
        assert (used == counts).all()


def brute_quality(t):
    w = WORD.findall(t)
    spans = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if spans[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = longest = 0
    if cover:
        n = 8
        while max(collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)).values(), default=0) > 1:
            longest, n = n, n + 1
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), longest


def test_quality(docs, by_id):
    for r in quality.judge(docs).collect():
        n, chars, symbols, lines, repeat, longest = brute_quality(by_id[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.longest_repeat) == (n, chars, symbols, lines, repeat, longest)
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
        w = WORD.findall(by_id[r.doc_id])
        spans = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if spans[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        covered = sum(len(w[j]) for j in cover)
        assert r.repeat_chars == covered
        assert r.kept == (not r.base_failed and covered <= 0.30 * chars and longest <= 0.25 * n and symbols <= 0.10 * n)
    with pytest.raises(ValueError, match="power of two"):
        quality.Limits(window=10)
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    rest = quality.keep(docs)
    assert rest.columns == docs.columns and {r.doc_id for r in rest.collect()} == kept and 0 in kept
    assert quality.judge(empty(docs)).count() == quality.keep(empty(docs)).count() == 0


def test_suffix_array_is_sorted():
    rnd = np.random.default_rng(3)
    for size, letters in ((200, 2), (300, 5), (64, 1)):
        s = rnd.integers(0, letters, size).astype(np.uint64)
        order, levels = quality.suffix_array(s, np.full(size, size))
        suffix = [s[i:].tolist() for i in order]
        assert suffix == sorted(suffix)
        a, b, common = quality.common_prefixes(order, levels, np.full(size, size), 8)
        for x, y, c in zip(a, b, common, strict=True):
            assert s[x : x + c].tolist() == s[y : y + c].tolist() and (max(x, y) + c == size or s[x + c] != s[y + c])


@pytest.mark.parametrize(("order", "shards"), [(2, None), (3, None), (4, None), (2, 300), (3, 300)])
def test_kneser_ney(docs, by_id, order, shards, monkeypatch):
    """With 300 shards words of more than 1 in 300 tokens, and the begin, are hot contexts."""
    if shards:
        monkeypatch.setattr(kneser_ney, "shards_for", lambda _: shards)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    rows = kneser_ney.train_and_score(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1, order=order).collect()
    tokens = {i: WORD.findall(low(t)) + ["</s>"] for i, t in by_id.items()}
    grams = lambda own: list(zip(*((["<s>"] * (order - 1) + own)[k:] for k in range(order))))
    c, counts = collections.Counter(), {order: collections.Counter()}
    for r in rows:
        assert r.held_out == held(r.doc_id)
        if not r.held_out:
            c.update(tokens[r.doc_id])
            counts[order].update(grams(tokens[r.doc_id]))
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    d = {k: [0.0, *kneser_ney.discounts([sum(v == x for v in counts[k].values()) for x in (1, 2, 3, 4)])] for k in counts}
    n, v, a = sum(c.values()), len(c), sum(counts[1].values())
    left = sum(d[1][min(x, 3)] for x in counts[1].values()) / a
    total, taken = collections.Counter(), collections.Counter()
    for k in range(2, order + 1):
        for g, x in counts[k].items():
            total[g[:-1]] += x
            taken[g[:-1]] += d[k][min(x, 3)]

    def p(g):
        k, x = len(g), counts[len(g)][g]
        if k == 1:
            return max(x - d[1][min(x, 3)], 0) / a + left / (v + 1)
        return p(g[1:]) if g[:-1] not in total else (max(x - d[k][min(x, 3)], 0) + taken[g[:-1]] * p(g[1:])) / total[g[:-1]]

    for h in [("<s>",) * (order - 1), next(g for g in counts[order] if "<s>" not in g)[:-1]]:
        assert sum(p((*h, w)) for w in c) + p((*h, "never seen")) == pytest.approx(1)
    for r in rows:
        own = tokens[r.doc_id]
        assert r.score == pytest.approx(sum(math.log10(p(g)) for g in grams(own)), rel=1e-9)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[w] > 0 for w in own), n)
    only = kneser_ney.train_and_score(docs, F.lit(True), order=order).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 for r in only)
    assert kneser_ney.train_and_score(empty(docs), F.lit(False), order=order).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_followers_of_a_hot_word_are_spread(spark, order):
    """A word with 200,000 different followers, half of all n-grams: no file holds much more than its share."""
    docs = spark.range(200, numPartitions=8).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.concat(F.lit("the the w"), F.col("id") * 1000 + i))).alias("text"))
    model = kneser_ney.train(docs, order=order)
    for k in range(2, order + 1):
        n = [len(kneser_ney.map_file(f"{model.folder}/gram-{k}-{s}", (np.uint64,))[0]) for s in range(model.shards)]
        assert sum(n) > 400_000 and max(n) < 1.2 * sum(n) / model.shards
        hot, total, one, two, more = kneser_ney.map_file(f"{model.folder}/hot-{k}", kneser_ney.HOT)
        assert hot.tolist() == sorted(kneser_ney.hot_keys(model.folder, k).tolist()) and 0 < len(hot) <= 2 * model.shards
        if k == 2:
            # "the" twice before each of the others, in order 3 by different words before; it also follows itself
            assert total.max() == 400_000 if order == 2 else total.max() > 200_000
            assert max(one) == 200_000 and (two.sum(), more.max()) == (0, 1)


def test_gram_blobs_round_trip():
    columns = tuple(np.array(x, np.uint64) for x in ([1, 1, 1, 9], [4, 4, 6, 2], [3, 5, 1, 2]))
    count = np.array([1, 300, 2, 1 << 40])
    for width in (1, 2, 3):
        grams, got = kneser_ney.unblob(kneser_ney.blob(columns[-width:], count))
        assert [g.tolist() for g in grams] == [x.tolist() for x in columns[-width:]] and got.tolist() == count.tolist()


def test_counts_are_exact(tmp_path):
    """Counts beyond 24 bits, and beyond 32, come back as they were."""
    count = np.array([1, (1 << 24) + 1, (1 << 32) - 2, (1 << 32) - 1, (1 << 40) + 7])
    kneser_ney._put_counts(f"{tmp_path}/word-0", np.arange(5, dtype=np.uint64), count)
    mapped = kneser_ney.Mapped(kneser_ney.Model(str(tmp_path), 1, 2, 0, 0, 0, (), 1.0))
    assert mapped.counts("word", np.array([4, 3, 2, 1, 0, 9], np.uint64), np.zeros(6, np.int64)).astype(int).tolist() == [*count[::-1].tolist(), 0]


def shingle_sets(by_id):
    out = {}
    for i, t in by_id.items():
        w = WORD.findall(low(t))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_classes(sets):
    owner = {i: i for i in sets}

    def root(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            owner[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_near_duplicates(docs, by_id):
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(docs).collect()}
    assert got == brute_classes(shingle_sets(by_id))
    assert len(set(got.values())) < len(got)
    assert probminhash.near_duplicates(empty(docs)).count() == 0


def test_near_duplicate_chains(spark):
    """Copies of copies: each is near the next one only, and a family around a text that is nearest to all."""
    rnd = random.Random(2)
    base = [f"w{k}" for k in range(300)]
    rows, now = [], list(base)
    for i in range(8):
        rows.append((i, " ".join(now)))
        for _ in range(4):
            now[rnd.randrange(300)] = f"x{rnd.random()}"
    for i in range(8, 40):
        own = [f"f{k}" for k in range(200)]
        for _ in range(5 if i != 20 else 0):
            own[rnd.randrange(200)] = f"y{rnd.random()}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in probminhash.near_duplicates(df).collect()} == brute_classes(shingle_sets(dict(rows)))


def test_near_duplicates_of_equal_sets_and_unequal_weights(spark):
    """The last sentence repeated 60 times: plain similarity 0.98, probability Jaccard 0.24."""
    rows = []
    for i in range(20):
        words = [f"w{i}x{k}" for k in range(300)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + words[-20:] * 59))]
    # repeats of different parts: both texts are weighted, and the plain sets are alike
    words = [f"both{k}" for k in range(300)]
    rows += [(50, " ".join(words[:20] * 50 + words)), (51, " ".join(words + words[-20:] * 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(shingle_sets(dict(rows)))
    assert want[1] == 0 and want[51] == 50
    assert {r.doc_id: r.class_id for r in probminhash.near_duplicates(df).collect()} == want


def test_signatures_estimate_probability_jaccard():
    rnd = np.random.default_rng(0)
    code = rnd.integers(1, 1 << 62, 400).astype(np.uint64)
    a, wa = np.sort(code[:300]), rnd.integers(1, 4, 300)
    b, wb = np.sort(code[60:360]), rnd.integers(1, 4, 300)
    m = 4096
    marks = probminhash.signatures(np.r_[np.zeros(300, int), np.ones(300, int)], np.r_[a, b], np.r_[wa, wb].astype(float), 2, m)
    x, y = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    exact = sum(1 / sum(max(x.get(k, 0) / x[d], y.get(k, 0) / y[d]) for k in {*x, *y}) for d in x.keys() & y.keys())
    assert abs((marks[0] == marks[1]).mean() - exact) < 4 * math.sqrt(exact * (1 - exact) / m)
    assert probminhash.similarity(a, wa, b, wb) == pytest.approx(max(exact, len(x.keys() & y.keys()) / len({*x, *y})))


def covered_bytes(by_id):
    """Of each text its bytes, and which of them lie in a 50-byte string of a document with a smaller id."""
    first, out = {}, {}
    for i, t in sorted(by_id.items()):
        b = t.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, t in by_id.items():
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        out[i] = b, gone
    return out


def kept_bytes(by_id):
    return {i: bytes(x for x, g in zip(b, gone) if not g) for i, (b, gone) in covered_bytes(by_id).items()}


def brute_repeats(by_id):
    spans = lambda gone: sum(1 for p in range(len(gone)) if gone[p] and not (p and gone[p - 1]))
    kept = kept_bytes(by_id)
    return {i: (len(b), sum(gone), spans(gone), hashlib.sha256(kept[i]).hexdigest()) for i, (b, gone) in covered_bytes(by_id).items()}


@pytest.mark.parametrize(("seed", "hot"), [(0, suffix_dedup.HOT), (1, suffix_dedup.HOT), (2, suffix_dedup.HOT), (0, 0), (1, 6)])
def test_repeat_removal_of_recurring_runs(spark, seed, hot):
    """A fuzzer of the hard case: one 16-byte run recurs every few bytes, for hundreds of bytes, in texts that share stretches of it."""
    rnd = random.Random(seed)
    run = "<td class='a'>0:"
    piece = lambda: run + "".join(rnd.choice("abcdefgh") for _ in range(rnd.choice((4, 8, 8, 12))))
    base = "".join(piece() for _ in range(40))
    rows = [(1, base[:312])]
    for i in range(2, 50):
        a = rnd.randrange(len(base) - 60)
        shared = base[a : a + rnd.randint(20, 500)]
        rows.append((i, rnd.choice(("", "é" * 9, piece())) + shared + rnd.choice(("", "other text " * 4, piece() * 3)) + base[: rnd.choice((0, 0, 200))]))
    rows.append((60, base[:72] + base[:312] + "tail"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal_digest(df, suffix_dedup.find_repeats(df, hot=hot)).collect()}
    assert got == brute_repeats(dict(rows)) and got[60][1] >= 312


def test_repeat_removal(docs, by_id):
    repeats = suffix_dedup.find_repeats(docs)
    want = brute_repeats(by_id)
    rows = suffix_dedup.removal_digest(docs, repeats).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want and len(rows) == len(want) + 1
    rest = suffix_dedup.without_repeats(docs, repeats)
    assert rest.columns == docs.columns and {r.doc_id: r.text for r in rest.collect()}[0] == by_id[0]
    assert suffix_dedup.removal_digest(empty(docs), suffix_dedup.find_repeats(empty(docs))).count() == 0


@pytest.mark.parametrize(("seed", "hot"), [(0, suffix_dedup.HOT), (1, suffix_dedup.HOT), (0, 0), (1, 6)])
def test_repeat_removal_of_periodic_texts(spark, seed, hot):
    rnd = random.Random(seed)
    base = "".join(rnd.choice("abc ") for _ in range(500))
    rows = []
    for i in range(50):
        t = list(base)
        for _ in range(rnd.randint(0, 10)):
            t[rnd.randrange(500)] = rnd.choice("xyé")
        a = rnd.randrange(300)
        rows.append((i, "".join(t)[a : a + rnd.randint(30, 400)] + "a" * rnd.randint(0, 120)))
    rows += [(60, "a" * 400), (61, "a" * 300 + "b"), (62, "ab" * 200), (63, "ba" * 90 + "c" + "ab" * 90), (64, "\0" * 80), (65, "q" + "\0" * 60), (66, base * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal_digest(df, suffix_dedup.find_repeats(df, hot=hot)).collect()}
    assert got == brute_repeats(dict(rows))


@pytest.mark.parametrize(("seed", "hot"), [(0, suffix_dedup.HOT), (1, suffix_dedup.HOT), (0, 0), (1, 6)])
def test_repeat_removal_of_rows_that_diverge_later(spark, seed, hot):
    """Table rows, list items and log lines: one run recurs for hundreds of bytes, then the texts part."""
    rnd = random.Random(seed)
    rows = []
    for i in range(60):
        line = (f'<td class="n{i}">{{:02}}</td>', f"  - list item {i} is {{:02}}\n", f"INFO served {i} in {{:02}} ms\n")[i % 3]
        common = "".join(line.format((7 * k) % 100) for k in range(18))
        for j in range(2):
            rows.append((2 * i + j, common + "".join(line.format(rnd.randrange(100)) for _ in range(5))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal_digest(df, suffix_dedup.find_repeats(df, hot=hot)).collect()}
    assert got == brute_repeats(dict(rows))
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    _, start, end, _ = suffix_dedup.segments(data, np.r_[0, np.cumsum([len(t.encode()) for _, t in rows])], 50)
    assert (end - start).max() <= 2 * 50 - suffix_dedup.RUN


def test_a_hot_name_is_spread(spark):
    """One notice between 60,000 different pairs of words: no shard holds its segments, and what repeats is still found."""
    own = lambda i, a, n: F.substring(F.md5(i.cast("string")), a, n)
    notice, i = F.lit(" this work is licensed for the owner of "), F.col("doc_id")
    docs = spark.range(60000, numPartitions=8).withColumnRenamed("id", "doc_id").select("doc_id", F.concat(own(i, 1, 16), notice, own(i, 17, 16)).alias("text"))
    # 100 more hold the notice and ten characters of another one: 50 bytes, and those before the notice that are equal by chance
    more = spark.range(60000, 60100).withColumnRenamed("id", "doc_id").select("doc_id", F.concat(own(i, 1, 16), notice, own(i - 60000, 17, 10), F.lit("-")).alias("text"))
    df = docs.unionByName(more)
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.removal_digest(df, suffix_dedup.find_repeats(df, hot=5000)).where("n_removed > 0").collect()}
    before = lambda i: hashlib.md5(str(i).encode()).hexdigest()[:16]
    assert removed == {i: 50 + next(k for k in range(16) if before(i)[15 - k] != before(i - 60000)[15 - k]) for i in range(60000, 60100)}
    rows, folder = df.select("text", F.col("doc_id").alias("id")), suffix_dedup.mounted(suffix_dedup.fresh(spark, "repeats"))
    suffix_dedup.repeated_names(rows, 50, 8, folder, 5000)
    hot = [suffix_dedup.map_file(f"{folder}/name-{s}", (np.uint64, np.bool_))[1].sum() for s in range(8)]
    assert 1 <= sum(hot) <= 40, hot
    size = dict.fromkeys(range(8), 0)
    for r in suffix_dedup.repeated_segments(rows, 50, 8, folder).where("open is not null").collect():
        size[r.shard] += len(suffix_dedup._unpacked(r.open, np.uint64, np.int64, np.int64, np.int32, np.uint8)[0])
    assert sum(size.values()) > 60000 and max(size.values()) < 1.3 * sum(size.values()) / 8, size


def test_maximal_repeats(spark):
    rnd = random.Random(9)
    noise = lambda n: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
    passage = noise(300)
    rows = [(1, noise(80) + passage + noise(70)), (2, passage[:200] + noise(90)), (3, noise(60) + passage[100:]), (4, noise(200)), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.maximal_repeats(df).collect()
    texts, groups = dict(rows), collections.defaultdict(list)
    for r in got:
        groups[r.group].append((r.doc_id, r.start, r.n_bytes))
    for own in groups.values():
        strings = {texts[i][s : s + n] for i, s, n in own}
        assert len(strings) == 1 and len({i for i, _, _ in own}) > 1 and own[0][2] >= 50
        # all occurrences, not just neighbours
        assert {(i, m.start()) for i, t in texts.items() if t for m in re.finditer(f"(?={re.escape(next(iter(strings)))})", t)} == {(i, s) for i, s, _ in own}
    covered = {(i, p) for own in groups.values() for i, s, n in own for p in range(s, s + n)}
    want = {(i, p) for i, t in texts.items() if t for k in range(len(t) - 49) if sum(t[k : k + 50] in u for u in texts.values() if u) > 1 for p in range(k, k + 50)}
    assert covered == want


def test_interval_tree():
    text = "abracadabra$abrac#"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    prefix = lambda a, b: next((k for k in range(len(text)) if a + k >= len(text) or b + k >= len(text) or text[a + k] != text[b + k]), 0)
    common = [0] + [prefix(a, b) for a, b in zip(order, order[1:])]
    left = [ord(text[i - 1]) if i else -1 for i in order]
    found = {text[order[f] : order[f] + p]: end - f for p, f, end, maximal in suffix_dedup.interval_tree(common, left, 1) if maximal}
    assert found == {"abrac": 2, "abra": 3, "a": 7}


def brute_top(rows, k):
    """Exact scores by Python's integers; a repeated query asks once with its smallest vector."""
    good = [(i, v, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q in {(i, len(v)) for i, v, _ in good if i % 50 == 0}:
        own = min((v, w) for i, v, w in good if (i, len(v)) == q)[1]
        scores = sorted((-sum(a * b for a, b in zip(own, w)), i) for i, _, w in good if i != q[0] and len(w) == q[1])[:k]
        if scores:
            out.setdefault(q[0], []).extend((max(-(1 << 63), min((1 << 63) - 1, -s)), i) for s, i in scores)
    return out


def found_top(spark, rows, **settings):
    got = collections.defaultdict(list)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for r in topk.exact_top_k(df, F.col("vec_id") % 50 == 0, **settings).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.score, r.vec_id))
    return dict(got)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(0, 0.1, 8).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(20)] + [(500, [0.0] * 8), (550, None), (600, [float("nan")] * 8), (650, [None] + [0.1] * 7), (700, [0.5] * 3), (750, [0.25] * 3), (800, [])]
    assert found_top(spark, rows) == brute_top(rows, 5)
    assert found_top(spark, rows, k=1) == brute_top(rows, 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_repeated_rows(spark):
    """Copies of a query ask once and never find themselves; copies of a candidate each count; unlike vectors of one id too."""
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(120)]
    rows += [rows[50]] * 3 + [rows[49]] * 4 + [(100, [9.0, 9.0]), (100, [-1.0, 3.0])]
    got = found_top(spark, rows)
    assert got == brute_top(rows, 5) and all(len(v) == 5 for v in got.values())


def test_top_k_of_large_components(spark, monkeypatch):
    """Components from 1e10 to the largest double beside small ones: exact order, scores beyond a long as the nearest long."""
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    rnd = random.Random(1)
    size = lambda: rnd.choice([1.0, 3e3, 1e10, 1e12, 1.7e308])
    rows = [(i, [rnd.uniform(-1, 1) * size() for _ in range(3)]) for i in range(160)] + [(200, [1e15, 1.0, 0.0]), (201, [1e15 + 1, 0.0, 0.0]), (202, [1e15, 255.0, 0.0])]
    assert found_top(spark, rows) == brute_top(rows, 5)


def test_sortable_scores():
    numbers = [0, 1, -1, 9, 10, -9, -10, 99, -99, 10**30, -(10**30), 10**600, 12345, -12345]
    assert sorted(numbers) == sorted(numbers, key=topk._sortable)


def test_threshold_search_stops_early(monkeypatch):
    """A bound below the k-th score ends the walk, and the score is carried on: later blocks of lesser vectors are not scored."""
    scored = []
    take = topk.best_of
    monkeypatch.setattr(topk, "best_of", lambda at, score, k: scored.append(len(at)) or take(at, score, k))
    blocks = []
    for b in range(4):
        vectors = np.zeros((5000, 4))
        vectors[:, 0] = np.arange(5000) - 6000 * b
        blocks.append(topk.Block(np.arange(5000) + 5000 * b, vectors, 1))
    found = topk.threshold_search(iter(blocks), np.array([[1.0, 0, 0, 0]]), np.array([-1]), 1, 5)
    assert [f[1] for f in found] == [4999, 4998, 4997, 4996, 4995] and sum(scored) < 500 and len(scored) <= 2


def test_blocks_are_not_copied_per_query_block(spark, monkeypatch):
    """Only results are shuffled after the blocks are stored, however many query blocks there are."""
    monkeypatch.setattr(topk, "CANDIDATES", 32)
    monkeypatch.setattr(topk, "QUERIES", 2)
    df = spark.createDataFrame([(i, [float(i % 13), float(i % 7)]) for i in range(600)], "vec_id long, embedding array<double>")
    plan = topk.exact_top_k(df, F.col("vec_id") % 50 == 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "embedding" not in plan and "v#" not in plan and "CoGroup" not in plan


def test_preference_format(spark):
    turns = "pair_id long, turn long, role string, text string"
    chosen = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "good"), (2, 0, "user", None), (3, 0, "user", "only"), (4, 0, "user", "same"), (4, 1, "assistant", "same")], turns)
    rejected = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "bad"), (1, 2, "user", "more"), (2, 0, "user", None), (2, 1, "assistant", "x"), (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 1, "assistant", "same"), (None, 0, "user", "lost")], turns)
    got = {(r.pair_id, r.part, r.turn, r.learn) for r in preference.format_preferences(chosen, rejected).collect()}
    assert got == {(1, "prompt", 0, False), (1, "chosen", 1, True), (1, "rejected", 1, True), (1, "rejected", 2, False), (2, "prompt", 0, False), (2, "rejected", 1, True), (3, "chosen", 0, False), (4, "prompt", 0, False), (4, "prompt", 1, False)}
    assert preference.format_preferences(chosen.limit(0), rejected.limit(0)).count() == 0


def test_token_counts(docs, by_id):
    tok = library("byte_bpe_50k.json")
    tok.encode_special_tokens = True
    path = bpe.vocabulary_path("byte_bpe_50k.tiktoken")
    for rule in ("most", "first"):
        got = collections.defaultdict(dict)
        for r in token_counts.by_line(docs.dropDuplicates(["doc_id"]), path, rule).collect():
            got[r.doc_id][r.line] = r.n_tokens
        for i, t in by_id.items():
            assert sum(got[i].values()) == len(tok.encode(t, add_special_tokens=False).ids)
            # each token's bytes against the lines' bytes; a line end belongs to the line before it
            enc, _ = token_counts.encoder(path)
            ends = np.cumsum([len(x.encode()) + 1 for x in t.split("\n")])
            ends[-1] -= 1
            want, at = [0] * len(ends), 0
            for token in enc.encode_ordinary(t):
                n = len(enc.decode_single_token_bytes(token))
                own = [int(np.searchsorted(ends, p, side="right")) for p in range(at, at + n)]
                want[own[0] if rule == "first" else max(own, key=lambda k: (own.count(k), -k))] += 1
                at += n
            assert [got[i][k] for k in sorted(got[i])] == want and sorted(got[i]) == list(range(len(ends)))
    assert token_counts.by_line(empty(docs), path).count() == 0


def test_crossing_tokens():
    start, end, bounds = np.array([0, 3, 9]), np.array([3, 9, 10]), np.array([0, 4, 8, 10])
    assert token_counts.attribute(start, end, bounds, "first")[0].tolist() == [0, 0, 2]
    owner, crossing = token_counts.attribute(start, end, bounds, "most")
    assert owner.tolist() == [0, 1, 2] and crossing.tolist() == [False, True, False]
    assert token_counts.attribute(np.array([2]), np.array([6]), np.array([0, 4, 8]), "most")[0].tolist() == [0]


def brute_licenses(rows, templates, least=0.8):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)}
    known = {k: runs(v) for k, v in templates.items()}
    return sorted((i, k, len(s), len(s & runs(t))) for i, t in rows for k, s in known.items() if len(s & runs(t)) >= least * len(s))


def found_licenses(spark, rows, **settings):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("mine")).withColumn("key", F.lit(1))
    return sorted((r.doc_id, r.license, r.n_shingles, r.n_found) for r in license_scan.scan(df, **settings).collect())


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_license_scan(spark, docs, monkeypatch, broadcast):
    monkeypatch.setattr(license_scan, "BROADCAST", broadcast)
    mit = license_scan.TEMPLATES["MIT-permission"]
    words = mit.split()
    rows = [(1, "before " + mit.upper() + " after"), (2, " ".join(words[:40] + ["changed"] + words[41:])), (3, " ".join(words[:20])), (4, "Released under the MIT License. " * 3), (5, None), (6, ""), (7, "released UNDER\nthe mit   license"), (7, "released UNDER\nthe mit   license")]
    rows += [(8 + k, t) for k, t in enumerate(license_scan.TEMPLATES.values())]
    got = found_licenses(spark, rows)
    assert got == brute_licenses(rows, license_scan.TEMPLATES) and {r[1] for r in got} == set(license_scan.TEMPLATES)
    assert [r[0] for r in got if r[0] < 8] == [1, 2, 4, 7, 7]
    assert license_scan.scan(empty(docs)).count() == 0


def test_licenses_survive_edits(spark):
    """Recall under edits: words changed, dropped, put in and moved until a fifth of the shingles is gone; none of what verifies is missed."""
    rnd = random.Random(8)
    rows = []
    for i in range(400):
        name = rnd.choice(sorted(license_scan.TEMPLATES))
        w = license_scan.TEMPLATES[name].split()
        for _ in range(rnd.randint(0, 1 + len(w) // 20)):
            at = rnd.randrange(len(w))
            w[at : at + 1] = rnd.choice(([], ["edited"], [w[at], "new"], [w[at], *w[at : at + 3]]))
            if not w:
                w = ["gone"]
        rows.append((i, " ".join(["lead", "words", *w, "and", "more"])))
    want = brute_licenses(rows, license_scan.TEMPLATES)
    partial = [r for r in want if r[3] < r[2]]
    assert found_licenses(spark, rows) == want and len(partial) > 100 and min(r[3] / r[2] for r in partial) < 0.83


def test_license_templates_as_a_table(spark, tmp_path):
    """A few hundred long templates, from files: the plan does not grow with them."""
    rnd = random.Random(3)
    long = {f"L{k}": " ".join(rnd.choices([f"w{x}" for x in range(500)], k=300)) for k in range(200)}
    for name, t in long.items():
        (tmp_path / f"{name}.txt").write_text(t)
    table = license_scan.templates_in(spark, str(tmp_path))
    rows = [(k, t if k % 2 else t.replace("w1 ", "x ")) for k, t in enumerate(list(long.values())[:30])]
    assert found_licenses(spark, rows, templates=table) == brute_licenses(rows, long)
    plan = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), table)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20000 and "Python" not in plan
    with pytest.raises(Exception, match="fewer"):
        license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), {"short": "too few words"})


def test_window_sizes_fit(spark):
    """The longest stretch that gaps of four leave is no shorter than the window, and twice the window would not fit."""
    for n, size in spark.range(1, 200).select("id", license_scan.window_size(F.col("id"), 0.8)).collect():
        most = n - math.ceil(0.8 * n)
        stretch = math.ceil((n - most) / (most // 4 + 1))
        assert size <= stretch and (size == 8 or 2 * size > stretch)
