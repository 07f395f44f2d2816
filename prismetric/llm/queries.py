"""The queries of this subpackage over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, exact_dedup, licences, mixing, packing, pii, repeats, simhash, token_counts, toxicity
from .licence_oracle import LICENCES

PATH = "{}/{}.parquet"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(PATH.format(sf_dir, table))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def tokenizer(name: str) -> str:
    """Where the installed public vocabularies keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digests(pii.pii(_read(spark, sf_dir, "documents")))


def pii_digests(found: DataFrame) -> DataFrame:
    """The base spans and the sanitised texts as digests; the latter null where a text stays as it is."""
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], digest("base"), "spans", digest("sanitised"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.drop_repeats(_read(spark, sf_dir, "documents"), window=100)


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(_read(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_read(spark, sf_dir, "documents"), shingle=3, bits=3)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(_read(spark, sf_dir, "embeddings"), cosine=0.98)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_packing": op4_packing,
    "op5_pii": op5_pii,
    "op6_source_mixing": op6_source_mixing,
    "op7_repeats": op7_repeats,
    "op8_licence_scan": op8_licence_scan,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY sha256(coalesce(text, '')))
    """,
    "op6_source_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   md5(concat(coalesce(doc_id::VARCHAR, ''), ':', coalesce(text, ''))) AS o
            FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place
            FROM d GROUP BY source
        ), w AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight FROM s
        ), b AS (SELECT *, (3 * source_size)::DOUBLE / weight AS bound_at FROM w
        ), l AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY bound_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                      / sum(weight) OVER (ORDER BY bound_at, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM b
        ), t AS (
            SELECT *, least((3 * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM l
        ), q AS (
            SELECT *, round(target)::BIGINT AS quota, sum(round(target)::BIGINT) OVER (ORDER BY place)::BIGINT AS until FROM t
        ), n AS (SELECT greatest(1, sum(quota))::BIGINT AS words, least(65536, greatest(1, -(-sum(quota) // 1048576)))::BIGINT AS block FROM q
        ), r AS (
            SELECT q.*, block, floor((until - quota)::DOUBLE / words * 4294967296)::BIGINT AS lo, floor(until::DOUBLE / words * 4294967296)::BIGINT AS hi FROM q, n
        ), x AS (
            SELECT i AS slot, i * 2654435769 % 4294967296 AS point FROM (SELECT unnest(range((SELECT -(-sum(quota) // block) FROM q, n GROUP BY block)::BIGINT)) AS i)
        ), y AS (SELECT slot, place, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS rank FROM x JOIN r ON point >= lo AND point < hi
        ), z AS (SELECT place, count(*) AS n FROM y GROUP BY place
        ), p AS (
            SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
            FROM d
        ), a AS (
            SELECT p.doc_id, p.size, r.source_size, r.target, r.place, r.block, p.ahead, least(coalesce(z.n, 0) * r.block, 3 * r.source_size)::BIGINT AS reach
            FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source LEFT JOIN z USING (place)
        )
        SELECT doc_id, size, source_size, target,
               (size * (reach // greatest(source_size, 1)) + least(size, greatest(0, reach % greatest(source_size, 1) - ahead)))::BIGINT AS taken,
               list_sum([CASE WHEN size > 0 AND ahead + k * source_size < reach
                              THEN (least(ahead + k * source_size + size, reach) - 1) // block - (ahead + k * source_size) // block + 1 ELSE 0 END FOR k IN [0, 1, 2]])::BIGINT AS n_slots,
               CASE WHEN size > 0 AND ahead < reach THEN y.slot ELSE -1 END::BIGINT AS first_slot
        FROM a LEFT JOIN y ON y.place = a.place AND y.rank = a.ahead // a.block
    """,
    "op7_repeats": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), w AS (
            SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS s
            FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d WHERE len(h) >= 200)
        ), r AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM w) WHERE n > 1
        ), n AS (
            SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, TRUE)::INT AS new FROM r
        ), g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n
        ), c AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run
        ), k AS (
            SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM c
        ), p AS (
            SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
                   string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
            FROM k JOIN d USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1, len(h)))) AS kept_sha256
        FROM d LEFT JOIN p USING (doc_id)
    """,
    "op8_licence_scan": LICENCES,
    "op10_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
        ), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a
        ), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings LEFT JOIN n USING (vec_id) JOIN c USING (vec_id)
    """,
}
