"""The queries of this subpackage: each applies an operator with production parameters to its
whole table and returns the full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkweave.llm import bpe, html, media, neighbours, packing, pii, quality, simhash, urls, warc
from talkweave.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, digest, type and target of each page's record."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, path, rule and verdict of each page's url."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out, score and predicted of each document."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_tokens and digests of ids and decoded text of each document."""
    return bpe.digests(table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for each query."""
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of base spans, and all spans, of each document."""
    return pii.annotate(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprint and component_id of each document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths, digests and features of each document's stored payload."""
    return media.round_trip(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_urls, op3_quality, op4_bpe, op5_neighbours, op6_packing, op7_pii, op8_simhash, op9_html, op10_media)}

#: Where SQL can express the whole result.
ORACLE_SQL = {
    "op1_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        s AS (SELECT payload_digest, max(page_id) AS target FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
        SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
               CASE WHEN target IS NULL OR p.page_id IS NOT DISTINCT FROM target THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN p.page_id IS DISTINCT FROM target THEN target END AS refers_to
        FROM p LEFT JOIN s USING (payload_digest)
    """,
}
