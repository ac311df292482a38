"""The queries of the ten operators with production parameters, and SQL where it can express them."""

from __future__ import annotations

from secrets import token_hex

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, chat, divergence, encoding, language, maxscore, packing, parity, pii, quality, resampling, secrets, simhash

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pii_key(spark: SparkSession) -> str:
    """The key of surrogates in ``docdelta.pii.key``; unset, a random one that serves this session alone."""
    if not spark.conf.get("docdelta.pii.key", None):
        spark.conf.set("docdelta.pii.key", token_hex(32))
    return spark.conf.get("docdelta.pii.key")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii_key(spark), count_col="n_pii")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), fields=("source", "text"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learned = language.learn(docs.where(docs["doc_id"].isNotNull() & ~language.held_out(docs["doc_id"])))
    found = language.identify(docs.select("doc_id", "text"), learned, keep=("doc_id",))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op11_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.join_similar(_table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_packing, op3_pii, op4_topk, op5_quality, op6_simhash, op7_chat, op8_secrets, op9_token_counts, op10_language, op11_parity, op12_resampling, op13_divergence)}

_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

_QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), b AS (
  SELECT *, len(w) AS n,
    CASE WHEN len(w) >= 6 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], chr(1))) ELSE [] END AS g,
    list_filter(l, lambda x:
      length(x) - length(translate(x, '#*$%&|<>', '')) > 0.08 * length(x)
      OR (NOT regexp_matches(x, '@MARK@') AND len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 30)
      OR regexp_matches(x, '@MARK_RUN@')
      OR length(x) - length(translate(x, '|»›•·→', '')) >= 3
      OR (NOT regexp_matches(x, '@ENDING@') AND (regexp_matches(x, '@ITEMS@') OR regexp_matches(lower(x), '@MENU@')))
      OR (upper(x) = x AND lower(x) <> x AND regexp_matches(x, '(?:\p{Lu}{2,}[^\p{L}]+){4}'))
      OR length(x) - length(regexp_replace(lower(x), '@PHRASE@', '', 'g')) >= 0.2 * length(x)
      OR (regexp_matches(lower(x), '^\W*(?:@PHRASE@)') AND len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) <= 12)) AS f
  FROM a
), k AS (
  SELECT doc_id, count(*) AS n_repeat FROM (
    SELECT DISTINCT doc_id, pos + o AS p FROM (
      SELECT rid AS doc_id, pos, count(*) OVER (PARTITION BY rid, gram) AS c FROM (SELECT rid, unnest(g) AS gram, unnest(range(len(g))) AS pos FROM (SELECT row_number() OVER () AS rid, g FROM b))
    ), range(5) AS t(o) WHERE c > 1
  ) GROUP BY doc_id
), m AS (
  SELECT b.*, coalesce(k.n_repeat, 0) AS n_repeat, CAST(coalesce(list_sum(list_transform(f, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))), 0) AS BIGINT) AS lost
  FROM (SELECT row_number() OVER () AS rid, * FROM b) b LEFT JOIN k ON b.rid = k.doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(n_repeat AS BIGINT) AS n_repeat_words,
  n < 10 OR 100 * n_repeat > 20 * n AS base_failed,
  NOT (n < 10 OR 100 * n_repeat > 20 * n) AND lost <= 0.5 * n AND n - lost >= 10 AS kept,
  CAST(len(f) AS BIGINT) AS n_lines_removed
FROM m
"""
for _name, _rx in {"MARK_RUN": quality.MARK_RUN, "MARK": quality.MARK, "ENDING": quality.ENDING, "ITEMS": quality.ITEMS, "MENU": quality.MENU, "PHRASE": quality._PHRASE}.items():
    _QUALITY = _QUALITY.replace(f"@{_name}@", _rx.replace("'", "''"))

_CHAT = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations
), p AS (
  SELECT *, string_agg(coalesce('r' || role, '-') || chr(31) || coalesce('t' || text, '-'), chr(30)) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM t
), keep AS (
  SELECT min(conv_id) AS conv_id FROM p
  WHERE pos = n - 1 AND prefix NOT IN (SELECT prefix FROM p WHERE pos < n - 1) GROUP BY prefix
)
SELECT conv_id, CAST(pos // 256 AS INTEGER) AS part, CAST(n AS BIGINT) AS n_turns,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM t WHERE conv_id IN (SELECT conv_id FROM keep) GROUP BY conv_id, pos // 256, n
"""

#: crc32 four bits at a time, the lower ones first, by its table for these; hex() gives the higher ones first.
_NIBBLES = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
_RESAMPLING = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, TRUE AS raw FROM documents
  UNION ALL
  SELECT row_number() OVER (), 0, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), FALSE FROM benchmark
), f AS (SELECT raw, rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM d),
n AS (SELECT raw, rid, feature, count(*) AS n FROM f GROUP BY raw, rid, feature),
b AS (
  SELECT feature, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x)), lambda i: CAST(strpos('0123456789ABCDEF', x[xor(i, 1) + 1]) - 1 AS BIGINT))),
    lambda c, y: xor(c >> 4, CAST({_NIBBLES}[CAST(xor(c, y) & 15 AS INTEGER) + 1] AS BIGINT)))) % 10000 AS bucket
  FROM (SELECT DISTINCT feature, hex(encode(feature)) AS x FROM n)
), s AS (SELECT bucket, CAST(sum(n) FILTER (raw) AS DOUBLE) AS s, CAST(sum(n) FILTER (NOT raw) AS DOUBLE) AS t FROM n JOIN b USING (feature) GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM s),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(s.t, 0) + 1) * (a.s + 10000) / ((coalesce(s.s, 0) + 1) * (a.t + 10000)))) AS BIGINT) AS gain FROM s, a),
m AS (SELECT rid, CAST(sum(n * gain) AS BIGINT) AS total FROM n JOIN b USING (feature) JOIN g USING (bucket) WHERE raw GROUP BY rid),
x AS (
  SELECT doc_id, len(w) AS words, CAST(greatest(2 * len(w) - 1, 0) AS BIGINT) AS n_features,
    CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % (2 * len(w) - 1)) + (2 * len(w) - 1)) % (2 * len(w) - 1)) // (2 * len(w) - 1) END AS weight,
    (CAST(CAST('0x' || left(sha256('7:' || doc_id), 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296 AS u
  FROM d LEFT JOIN m ON m.rid = d.rid WHERE raw
), y AS (SELECT doc_id, words, n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY words >= 20) AS many FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * many // 100 THEN CAST(place AS BIGINT) END AS rank FROM r
"""

_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(total) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
size AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(s.n, 0) + v.v) AS p,
    1 + 1000000000 * (k.total + 1) // (v.n + v.v) AS q
  FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN size s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

ORACLES = {"op12_resampling": _RESAMPLING, "op13_divergence": _DIVERGENCE, "op4_topk": _TOPK, "op5_quality": _QUALITY, "op7_chat": _CHAT}
