"""The registered queries of this subpackage, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, decontam, embeddings, langid, licenses, minhash, packing, quality, substrings, token_shards, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.write_shards(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "n_shingles", "kept")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_language_id, op2_benchmark_decontamination, op3_suffix_array_dedup, op4_token_shards, op5_quality_classifier,
        op6_warc_round_trip, op7_embedding_near_dedup, op8_minhash_near_dedup, op9_license_scan, op10_best_fit_packing,
    )}


#: DuckDB: words of a text as a list, A-Z folded.
_WORDS = (
    r"list_filter(regexp_split_to_array(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)

_OP2 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(t="text")} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format(t="text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, w[s:s + least(8, len(w)) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, s, n, w[s:s + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
h AS (SELECT page_id, p.html, first, sha1(encode(p.html)) AS hex FROM p JOIN f USING (html)),
b AS (SELECT *, list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(((('0x' || substr(hex, 1 + CAST(floor(k * 5 / 4) AS BIGINT), 2) || '')::INT >> (CASE WHEN floor(k * 5 / 4) = 39 THEN 0 ELSE CAST(8 - 5 - (k * 5) % 4 AS INT) END)) & 31) AS INT) + 1, 1)),
  'string_agg', '') AS digest FROM (SELECT page_id, html, first, hex || '0' AS hex FROM h))
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""


def _op9() -> str:
    words = _WORDS.format(t="text")
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in licenses.PHRASES.items())
    templates = ", ".join(f"('{k}', {sorted(set(t.split()))!r})" for k, t in licenses.TEMPLATES.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {words} AS w FROM documents),
p(ws, label) AS (VALUES {phrases}),
t(label, ts) AS (VALUES {templates}),
places AS (SELECT doc_id, label, s - 1 AS s FROM (SELECT doc_id, w, ws, label, unnest(range(1, len(w) - len(ws) + 2)) AS s
  FROM d, p WHERE list_has_all(w, ws)) WHERE w[s:s + len(ws) - 1] = ws),
b AS (SELECT doc_id, count(*) AS n_base, min(s) AS lo, max(s) AS hi, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
blocks AS (SELECT doc_id, list_distinct({_WORDS.format(t="line")}) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
share AS (SELECT doc_id, label, max(CASE WHEN len(list_intersect(w, ts)) >= ceil(0.8 * len(ts) - 1e-9) THEN len(list_intersect(w, ts)) / len(ts) ELSE 0 END) AS share
  FROM blocks, t GROUP BY doc_id, label),
m AS (SELECT doc_id, list(label) FILTER (share >= 0.8 - 1e-12) AS labels, max(share) AS best FROM share GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_benchmark_decontamination": _OP2, "op6_warc_round_trip": _OP6, "op9_license_scan": _op9()}
