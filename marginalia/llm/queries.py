"""The queries opN_* of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, langid, line_dedup, minhash, packing, periodic, sharding, spm, url_rules, warc, whitening, winnow


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text", "emptied")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(_read(spark, sf_dir, "documents"), n_shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return spm.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_read(spark, sf_dir, "pages"), least_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compared(_read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), seq_len=2048)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"), declared="lang", host="source")


def op9_language_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(langid.page_rows(_read(spark, sf_dir, "pages")), declared="lang", host="host", suffix="suffix")
    return found.withColumnRenamed("doc_id", "page_id")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), k=10, every=100)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"), most=32)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.described(periodic.collapse(periodic.planted(_read(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_near_duplicates, op3_sharding, op4_sentencepiece, op5_warc, op6_fingerprints, op7_packing, op8_url_filter, op9_language, op9_language_pages, op10_nearest, op11_byte_bpe, op12_whitening, op13_periodic_runs)}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": line_dedup.SQL, "op2_near_duplicates": minhash.SQL, "op5_warc": warc.SQL}
