"""One registered query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quern.llm import (
    decontamination, interpolation, license_scan, packing, personal_data, quality_rules, sharding, simhash_dedup,
    spelling_variants, substring_dedup, topk_search, vector_codes, warc,
)
from quern.llm.frames import table, tokenizer_json

OP3 = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS phrase
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
places AS (
    SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS phrase
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM words, sizes WHERE len(w) >= size)
), found AS (SELECT doc_id, item_id, p.size, k FROM places p JOIN windows USING (size, phrase)),
hits AS (SELECT doc_id, count(DISTINCT k + i) AS n FROM (SELECT doc_id, k, unnest(range(0, size)) AS i FROM found) GROUP BY 1),
ids AS (
    SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS list
    FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

OP5 = """
WITH payloads AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
marked AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last, sha1(payload) AS hex FROM payloads)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(hex, 1 + 5 * CAST(k // 4 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to, url
FROM marked
"""

def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Each round is one step: nearest entries by smallest (distance, entry), then floored means."""
    kept = f"""SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS nth,
        list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
    cut = f"""SELECT vec_id, label, nth, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS p
        FROM kept, (SELECT unnest(range({parts})) AS part)"""
    steps = {"kept": kept, "cut": cut, "book0": f"SELECT part, nth - 1 AS entry, p AS c FROM cut WHERE nth <= {entries}"}
    gap = "list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for k in range(rounds + 1):
        steps[f"near{k}"] = f"""SELECT nth, part, any_value(vec_id) AS vec_id, any_value(label) AS label, any_value(p) AS p,
            min(struct_pack(d := CAST({gap} AS BIGINT), e := entry)) AS best FROM cut JOIN book{k} USING (part) GROUP BY nth, part"""
        if k < rounds:
            steps[f"sums{k}"] = f"""SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (
                SELECT part, best.e AS entry, i, CAST(sum(p[i]) AS BIGINT) AS s, count(*) AS n
                FROM near{k}, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i) GROUP BY ALL) GROUP BY part, entry"""
            steps[f"book{k + 1}"] = f"SELECT b.part, b.entry, coalesce(m, c) AS c FROM book{k} b LEFT JOIN sums{k} s USING (part, entry)"
    steps["coded"] = f"""SELECT nth, any_value(vec_id) AS vec_id, any_value(label) AS label,
        string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY nth"""
    with_steps = ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in steps.items())
    return f"""WITH {with_steps}
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256 FROM coded"""


# Near words share a word with one code point left out at the same place (replaced), or one is the other without one.
OP12 = r"""
WITH table256 AS (
    SELECT list(c ORDER BY k) AS crc FROM (SELECT k, list_reduce(list_prepend(k, range(8)), lambda a, i:
        CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS k))
), runs AS (
    SELECT doc_id, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{5,}')) AS run
    FROM documents) GROUP BY ALL
), bytes AS (
    SELECT doc_id, run, n, list_transform(range(1, 2 * octet_length(encode(doc_id || ':' || run)), 2),
        lambda i: CAST('0x' || substr(hex(encode(doc_id || ':' || run)), i, 2) AS BIGINT)) AS b FROM runs
), hashed AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, crc[1 + (xor(a, x) & 255)])), 4294967295) AS h
    FROM bytes, table256
), placed AS (SELECT run, n, h, CAST(h % length(run) AS INTEGER) AS gone FROM hashed
), words AS MATERIALIZED (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, gone) || substr(run, gone + 2) ELSE run END AS word, n FROM placed)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), without AS MATERIALIZED (
    SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS k)
), near AS MATERIALIZED (
    SELECT a.word, b.word AS near, b.n AS near_n FROM without a JOIN without b ON a.k = b.k AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, min(struct_pack(m := -near_n, near := near)) AS b FROM near GROUP BY word
), forms AS MATERIALIZED (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 2 * n THEN b.near END AS form, CASE WHEN -b.m >= 2 * n THEN -b.m END AS form_n
    FROM words LEFT JOIN best USING (word)
), chain AS (
    WITH RECURSIVE step AS (
        SELECT word, form AS root FROM forms WHERE form IS NOT NULL
        UNION ALL SELECT s.word, f.form FROM step s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL
    ) SELECT s.word, s.root FROM step s JOIN forms f ON f.word = s.root WHERE f.form IS NULL
)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN chain USING (word)
"""

OP13 = """
WITH kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM kept q JOIN kept c ON c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_json())


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, how many lie in benchmark windows, and of which items."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under the model of four fifths of them."""
    return interpolation.score_documents(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of every document without strings of 400 bytes that start anywhere else."""
    return substring_dedup.remove_repeated(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, shards of nearly equal bytes."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in all documents."""
    return license_scan.find_licenses(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and whether the rules keep it."""
    return quality_rules.quality_counts(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return personal_data.find_personal_data(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, their errors, and the digest of the codebooks."""
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all texts with their near words and usual forms."""
    return spelling_variants.spelling_forms(table(spark, sf_dir, "documents"))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest inner products of every hundredth vector with all others."""
    return topk_search.largest_products(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_dedup, op2_best_fit_packing, op3_decontamination, op4_deleted_interpolation, op5_warc,
        op6_suffix_dedup, op7_sharding, op8_license_scan, op9_quality_rules, op10_personal_data,
        op11_vector_codes, op12_spelling_variants, op13_topk_search,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLES: dict[str, str] = {
    "op3_decontamination": OP3,
    "op5_warc": OP5,
    "op11_vector_codes": _codes_sql(),
    "op12_spelling_variants": OP12,
    "op13_topk_search": OP13,
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
}
