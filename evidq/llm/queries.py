"""The queries opN_<name> over the whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fertility, lines, packing, sharding, substrings, toxicity, warc
from .ann import nearest
from .common import dropped, stored, table
from .minhash import near_duplicates


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op2_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.lookup_table(spark, [f"shard-{i:03d}" for i in range(sharding.SHARDS)])
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", shards)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, payloads = warc.archive(table(spark, sf_dir, "pages"))
    written = stored(warc.records(headers, payloads), "warc-records", codec="zstd")
    dropped(headers, payloads)
    return warc.parsed(written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.Vocabulary(spark, bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, vocabulary.ranks)
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op7_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabularies = [public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")]
    return fertility.quality(table(spark, sf_dir, "documents"), vocabularies, public_tokenizers.PATTERN)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_additive_quantisation": op2_additive_quantisation,
    "op3_line_dedup": op3_line_dedup,
    "op4_sharding": op4_sharding,
    "op5_warc": op5_warc,
    "op6_byte_level_bpe": op6_byte_level_bpe,
    "op7_fertility": op7_fertility,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_toxicity": op10_toxicity,
}
ORACLES = {"op3_line_dedup": lines.ORACLE, "op4_sharding": sharding.ORACLE, "op5_warc": warc.ORACLE}
