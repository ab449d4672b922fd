"""The registered queries of this subpackage: each applies its operator to a whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphspark.llm import best_fit, bpe, iblt, langid, lattice_lm, media, quality, simhash, toxicity, warc


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.texts_as_media(table(spark, sf_dir, "documents")).drop("tile")


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_texts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprint_documents(table(spark, sf_dir, "documents"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of op2 that SQL can express."""
    return op2_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of op4 that SQL can express."""
    return op4_iblt_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), pattern(), with_ids=False)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_best_fit_packing, op2_media_columns, op3_lattice_lm, op4_iblt_fingerprints, op5_quality, op6_toxicity, op7_simhash, op8_language_id, op9_warc, op10_byte_bpe, pipeline, media_payloads, edited_texts)
}

#: DuckDB SQL where SQL can express the whole result of a query.
ORACLES: dict[str, str] = {
    "media_payloads": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents), n AS (SELECT *, octet_length(t) AS n_bytes FROM d),
        p AS (SELECT *, greatest((n_bytes + 63) // 64, 1) * 64 AS payload_bytes FROM n)
        SELECT doc_id, n_bytes, payload_bytes, sha256(t || repeat('\\x00'::BLOB, payload_bytes - n_bytes)) AS payload_sha256 FROM p
    """,
    "edited_texts": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        n AS (SELECT doc_id, t, length(t) AS n_chars, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nx FROM d)
        SELECT doc_id, n_chars, sha256(substr(t, 1, n_chars - n_chars // 2) || substr(nx, 1, n_chars // 2)) AS edited_sha256 FROM n
    """,
    "op9_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), g AS (
            SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
        )
        SELECT p.page_id, p.payload_bytes, p.payload_digest,
               CASE WHEN g.first_id IS NOT NULL AND g.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN g.first_id IS NOT NULL AND g.first_id <> p.page_id THEN g.first_id END AS refers_to
        FROM p LEFT JOIN g USING (payload_digest)
    """,
}
