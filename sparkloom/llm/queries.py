"""The queries that apply each operator to its whole table, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, lines, packing, quality, simhash, substrings, toxicity, urls, warc
from .common import fold, scratch_path, table


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate_substrings(table(spark, sf_dir, "documents"), substrings.SubstringOptions(length=200))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination_digest(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), size=2048, end_id=1)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path, min_payload=0)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs, language.fit(docs, held_out_fold=(4, 2)))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


URL_RULES = [urls.Rule("block", "net/"), urls.Rule("allow", "example.net/en/"), urls.Rule("block", "example.com/de/"), urls.Rule("allow", "org/fr/")]


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out_fold=(5, 0)))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, trees)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.withColumn("n_lines", F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).cast("long"))
    found = lines.remove_duplicate_lines(counted, report=True)
    removed = F.coalesce("_removed", F.expr("cast(array() as array<int>)"))
    return found.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.array_join(removed, ",").alias("removed"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("kept_xxh64"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, seed=42, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": op1_substrings,
    "op2_decontaminate": op2_decontaminate,
    "op3_packing": op3_packing,
    "op4_warc": op4_warc,
    "op5_language": op5_language,
    "op6_urls": op6_urls,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_lines": op9_lines,
    "op10_simhash": op10_simhash,
}

_OP1 = """
WITH b AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x FROM documents),
k AS (SELECT r, j, substr(x, 2000 * j + 1, 2398) AS part FROM (SELECT r, x, unnest(range(0, (length(x) // 2 - 200) // 1000 + 1)) AS j FROM b WHERE length(x) >= 400)),
w AS MATERIALIZED (SELECT r, p, hash(g) AS g FROM (SELECT r, 1000 * j + o AS p, substr(part, 2 * o + 1, 400) AS g FROM (SELECT r, j, part, unnest(range(0, least(1000, length(part) // 2 - 199))) AS o FROM k))),
d AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM w JOIN (SELECT g FROM w GROUP BY g HAVING count(*) > 1) USING (g)),
s AS (SELECT r, min(p) AS a, max(p) + 200 AS e FROM (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM d) GROUP BY r, run),
left_over AS (SELECT r, e AS a, lead(a) OVER (PARTITION BY r ORDER BY a) AS e FROM s UNION ALL SELECT r, 0, min(a) FROM s GROUP BY r),
kept AS (SELECT r, string_agg(CASE WHEN e IS NULL THEN substr(x, 2 * a + 1) ELSE substr(x, 2 * a + 1, 2 * (e - a)) END, '' ORDER BY a) AS x FROM left_over JOIN (SELECT r, x FROM b) USING (r) GROUP BY r),
sums AS (SELECT r, sum(e - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY r)
SELECT doc_id, length(b.x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
CASE WHEN kept.x IS NULL THEN sha256(t) ELSE sha256(unhex(kept.x)) END AS kept_sha256
FROM b LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""

_OP2 = r"""
WITH f AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents, f),
i AS (SELECT id, w, least(10, len(w)) AS s FROM (SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, f WHERE item_id IS NOT NULL) WHERE len(w) > 0),
iw AS MATERIALIZED (SELECT DISTINCT id, s, array_to_string(w[k : k + s - 1], ' ') AS g FROM (SELECT id, s, w, unnest(range(1, len(w) - s + 2)) AS k FROM i)),
dw AS (SELECT r, k, s, array_to_string(w[k : k + s - 1], ' ') AS g FROM (SELECT r, w, s, unnest(range(1, len(w) - s + 2)) AS k FROM d, (SELECT DISTINCT s FROM iw) WHERE len(w) >= s)),
h AS MATERIALIZED (SELECT r, k, s, id FROM dw JOIN iw USING (s, g)),
p AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + s)) AS place FROM h) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN n USING (r)
"""

_OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
s AS (SELECT page_id, t, sha1(t) AS h, row_number() OVER (PARTITION BY t ORDER BY page_id) AS k, min(page_id) OVER (PARTITION BY t) AS first FROM p),
v AS (SELECT *, [list_sum([(instr('0123456789abcdef', h[5 * g + j + 1]) - 1) * CAST(16 ** (4 - j) AS BIGINT) for j in range(5)])::BIGINT for g in range(8)] AS v FROM s)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v[c // 4 + 1] >> CAST(15 - 5 * (c % 4) AS BIGINT)) & 31) + 1] for c in range(32)], '') AS payload_digest,
CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to FROM v
"""

#: The others depend on a trained model, a tokenizer or XXH64, or search by chance; they are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op1_substrings": _OP1, "op2_decontaminate": _OP2, "op4_warc": _OP4}
