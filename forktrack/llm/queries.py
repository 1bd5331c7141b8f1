"""The registered queries of the corpus operators, each over its whole table, and their SQL where there is some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chroma, dart, decontam, labelled, lines, orc_tokens, quality, runtime, secrets, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one with fewer input splits than there are cores is dealt out, so that small files use them all."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages", "embeddings") and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the global distinct-word shuffle, decoded again by the token-byte table."""
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), bpe.default_ranks(), digest=True)


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record in ZIP packages and read back by ranges."""
    packages = warc.write(_table(spark, sf_dir, "pages"), runtime.fresh_path(spark, "warc"))
    return warc.read(spark, packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items, with the item, the place and how sure it is."""
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern and lexed secrets of every document."""
    return secrets.scan_documents(_table(spark, sf_dir, "documents"))


def _scored(docs: DataFrame, score, folds: int, held_out: int) -> DataFrame:
    return docs.select("doc_id", (labelled.fold(F.col("doc_id"), folds) == held_out).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op5_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by its nearest labelled neighbours."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return _scored(docs, quality.score(F.col("text"), model), 4, 2)


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left in every document after fuzzy line dedup, and the digest of its text then."""
    return lines.report(lines.dedup(_table(spark, sf_dir, "documents")))


def op7_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by the FTRL model."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return _scored(docs, toxicity.score(F.col("text"), model), 3, 1)


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document, and whether it is the one that stands for its class."""
    found = dart.classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("keeps"))


def op9_chroma_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint classes and alignments of recordings, one made from every embedding: no table holds audio."""
    vectors = _table(spark, sf_dir, "embeddings")
    return chroma.aligned(vectors, "vec_id", "embedding", render=chroma.sonified)


def op10_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    path = runtime.fresh_path(spark, "tokens")
    orc_tokens.write(_table(spark, sf_dir, "documents"), path, orc_tokens.default_tokenizer())
    return orc_tokens.checksums(orc_tokens.read(spark, path))


def queries() -> dict:
    return {f.__name__: f for f in (op1_byte_bpe, op2_warc_zip, op3_latent_decontamination, op4_secret_scan, op5_quality_neighbours, op6_fuzzy_lines, op7_toxicity_ftrl, op8_dart_minhash, op9_chroma_prints, op10_orc_tokens)}


WARC_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_zip": WARC_SQL}
