"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, kneser_ney, license_scan, packing, phrases, preference, probminhash, quality, simhash, suffix_dedup, token_counts, topk, turn_repair
from graphloom.session import table


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under a model trained on four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    return kneser_ney.train_and_score(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, each document encoded whole."""
    return token_counts.by_line(table(spark, sf_dir, "documents"), bpe.vocabulary_path("byte_bpe_50k.tiktoken"), rule="most")


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with two replies against itself with a stale last reply."""
    return preference.format_preferences(*preference.stale_reply_pairs(table(spark, sf_dir, "conversations")))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.vocabulary_path())


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.TEMPLATES, least=0.8)


def op6_common_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings of documents before it, as digests."""
    docs = table(spark, sf_dir, "documents")
    return suffix_dedup.removal_digest(docs, suffix_dedup.find_repeats(docs, least=50))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.best_two_fit(table(spark, sf_dir, "documents"), bpe.vocabulary_path(), capacity=4096, end_id=1)


def op9_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near duplicates."""
    return probminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best partners of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256)


def op11_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its SimHash fingerprint and the group of its near duplicates."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), bits=4, shingle=4, seed=42)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by hash and repaired by the cheapest edits."""
    return turn_repair.repair(table(spark, sf_dir, "conversations"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, share=100, limit=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_kneser_ney, op2_token_counts, op3_preference_format, op4_bpe_round_trip, op5_license_scan, op6_common_prefix_tree, op7_quality_rules, op8_best_two_fit, op9_probminhash, op10_threshold_top_k, op11_simhash_trees, op12_turn_repair, op13_phrases)}


def oracle_sql() -> dict[str, str]:
    return {"op3_preference_format": OP3_SQL, "op5_license_scan": op5_sql(), "op10_threshold_top_k": OP10_SQL, "op12_turn_repair": op12_sql(), "op13_phrases": OP13_SQL}


OP10_SQL = """
WITH g AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM g
), q AS (
  -- a repeated query row asks once, with its smallest vector
  SELECT vec_id, list_transform(min(embedding), lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM g WHERE vec_id % 50 = 0 GROUP BY vec_id, len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), o AS (
  SELECT lang, piece, unnest(w) AS w, unnest(range(len(w))) AS i FROM w
), l AS (
  SELECT lang, w AS w1, lead(w, 1) OVER v AS w2, lead(w, 2) OVER v AS w3, lead(w, 3) OVER v AS w4, lead(w, 4) OVER v AS w5 FROM o WINDOW v AS (PARTITION BY piece ORDER BY i)
), g AS (
  SELECT lang, w1 AS phrase, 1 AS k FROM l
  UNION ALL SELECT lang, w1 || ' ' || w2, 2 FROM l WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3 FROM l WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, 4 FROM l WHERE w4 IS NOT NULL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5, 5 FROM l WHERE w5 IS NOT NULL
), f AS (
  SELECT lang, phrase, k, count(*) AS a FROM g GROUP BY ALL
), t AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 100
), h AS (
  -- what a longer candidate holds
  SELECT lang, array_to_string(w[x.i:x.i+y.m-1], ' ') AS phrase, max(a) AS longer
  FROM c, (VALUES (1), (2), (3), (4)) x(i), (VALUES (2), (3), (4)) y(m)
  WHERE x.i + y.m - 1 <= k AND y.m < k GROUP BY ALL
), s AS (
  SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j+1:], ' ') AS tail
  FROM c, (VALUES (1), (2), (3), (4)) v(j) WHERE j < k
), r AS (
  SELECT s.lang, s.phrase, s.a, s.j, l.a AS l, r.a AS r, t.n, CAST(CAST(1000 AS HUGEINT) * s.a * t.n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM s JOIN f l ON l.lang = s.lang AND l.phrase = s.head JOIN f r ON r.lang = s.lang AND r.phrase = s.tail JOIN t ON t.lang = s.lang
), b AS (
  SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), z AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
  FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.longer IS NULL OR 100 * h.longer < 100 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM z WHERE rank <= 2000
"""

OP3_SQL = """
WITH said AS (
  SELECT conv_id, min(turn) AS first, max(turn) AS last, arg_min(text, turn) AS early
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id HAVING min(turn) < max(turn)
), k AS (
  SELECT c.conv_id AS pair_id, c.turn, c.role, c.text,
         CASE WHEN c.turn = s.last THEN s.early ELSE c.text END AS other, s.last
  FROM conversations c JOIN said s USING (conv_id) WHERE c.turn <= s.last
), f AS (
  SELECT pair_id, min(turn) AS split FROM k WHERE text IS DISTINCT FROM other GROUP BY pair_id
), p AS (
  SELECT k.*, f.split IS NULL OR k.turn < f.split AS common FROM k LEFT JOIN f USING (pair_id)
), u AS (
  SELECT pair_id, CASE WHEN common THEN 'prompt' ELSE 'chosen' END AS part, turn, role, text FROM p
  UNION ALL
  SELECT pair_id, 'rejected', turn, role, other FROM p WHERE NOT common
)
SELECT pair_id, part, turn, role,
       '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS rendered,
       part <> 'prompt' AND role = 'assistant' AS learn,
       CAST(length('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10)) AS BIGINT) AS n_chars
FROM u
"""


def op5_sql() -> str:
    """Containment of every template in every document, without windows or bands."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(license_scan.TEMPLATES.items()))
    words = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
    runs = "CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) ELSE [] END"
    return f"""
WITH t AS (SELECT name, {runs} AS s FROM (SELECT name, {words} AS w FROM (VALUES {values}) v(name, text))),
d AS (SELECT doc_id, {runs} AS s FROM (SELECT doc_id, {words} AS w FROM documents)),
e AS (SELECT name AS license, len(s) AS n_shingles, unnest(s) AS one FROM t),
x AS (SELECT doc_id, unnest(s) AS one FROM d),
c AS (SELECT doc_id, license, n_shingles, count(*) AS n_found FROM x JOIN e USING (one) GROUP BY ALL)
SELECT doc_id, license, CAST(n_shingles AS BIGINT) AS n_shingles, n_found, CAST(n_found AS DOUBLE) / n_shingles AS containment
FROM c WHERE n_found >= 0.8 * n_shingles
"""


def op12_sql() -> str:
    """The cheapest edits by a fold over each conversation's rows from the last to the first."""
    kept = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    takes = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    put = lambda state, cost, edits, line: f"{{'c': {state}.c + {cost}, 'a': '{edits}' || {state}.a, 'l': " + (f"list_prepend({line}, {state}.l)" if line else f"{state}.l") + "}"
    never = lambda test, value: f"CASE WHEN {test} THEN {value} END"
    row, insert = [], []
    for s, (role, n) in takes.items():
        keeps = [never(f"NOT r.bad AND r.initial = '{i}'", put(f"z.s{k}", "r.extra", "K", "r.role || ':' || r.text")) for i, k in kept[s].items()]
        again = never("NOT r.bad", put(f"z.s{n}", "1 + r.extra", "R", f"'{role}:' || r.text"))
        row.append(f"'s{s}': list_min([{', '.join([put(f'z.s{s}', '2', 'D', ''), *keeps, again])}])")
        other = takes[n][1]
        two = f"{{'c': b.s{other}.c + 10, 'a': 'II' || b.s{other}.a, 'l': list_prepend('{role}:', list_prepend('{takes[n][0]}:', b.s{other}.l))}}"
        insert.append(f"'s{s}': list_min([b.s{s}, {put(f'b.s{n}', '5', 'I', chr(39) + role + ':' + chr(39))}, {two}])")
    inserted = lambda x: f"list_transform([{x}], lambda b: {{{', '.join(insert)}}})[1]"
    one = "STRUCT(c BIGINT, a VARCHAR, l VARCHAR[])"
    kind = f"STRUCT(s0 {one}, s1 {one}, s2 {one}, s3 {one})"
    none, done = "{'c': 1000000000, 'a': '', 'l': []}", "{'c': 0, 'a': '', 'l': []}"
    first = inserted(f"CAST({{'s0': {done}, 's1': {none}, 's2': {none}, 's3': {done}}} AS {kind})")
    return rf"""
WITH tab AS (SELECT list_transform(range(256), lambda k: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k)) AS t),
q AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
f AS (SELECT q.*, xor(list_reduce(list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS fault FROM q, tab),
m AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM (SELECT *, unnest(CASE fault WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM f WHERE fault <> 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n FROM m),
k AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, role[1] AS initial, lead(role[1]) OVER (PARTITION BY conv_id ORDER BY n) AS next FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND again) AS duplicate, count(*) FILTER (WHERE NOT blank AND NOT again AND cut) AS truncated,
  count(*) FILTER (WHERE next IS NOT NULL AND initial || next NOT IN ('su', 'ua', 'au')) AS illegal,
  list({{'initial': initial, 'bad': blank OR again, 'extra': CASE WHEN cut THEN 5 ELSE 0 END, 'role': role, 'text': text}} ORDER BY n DESC) AS rows FROM k GROUP BY conv_id),
d AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, list_reduce(rows, lambda z, r: {inserted('{' + ', '.join(row) + '}')}, {first}).s0 AS best FROM g),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.l, chr(10)), '')) AS repaired_sha256
FROM c LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""
