"""Registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from . import (ann, blob_ledger, hard_negatives, licenses, metric_join, minhash, mixing, packing, rare_features, shard,
               token_counts, toxicity, whitening)
from .common import table

#: Folder of the public tokenizers' files; None: the installed package's.
TOKENIZERS: str | None = None


@lru_cache(maxsize=8)
def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def run_name() -> str:
    import uuid

    return uuid.uuid4().hex


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = blob_ledger.BlobLedger(spark, shared_dir(spark, f"ledger-{run_name()}"))
    found = blob_ledger.scan_versions(table(spark, sf_dir, "documents"), ledger, "first")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(ann.build_index(vectors), vectors.where("vec_id % 20 = 0"))


def op5_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.link_vectors(table(spark, sf_dir, "embeddings"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return shard.place(docs, shard.lookup_table(spark), "doc_id").select("doc_id", "source", "slot", "shard")


#: Categories of the labels table, in the chain's order; the last one rejects documents.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.classify(docs, chain).withColumnRenamed("rejected", "toxic")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_pieces(packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def digest_pieces(pieces: DataFrame) -> DataFrame:
    length = (F.octet_length("ids") / 4).cast("long")
    return pieces.select("doc_id", "start", length.alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85, shingle=3)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_with_edits(table(spark, sf_dir, "documents"), standard_edits(),
                                         tokenizer("byte_bpe_50k.tiktoken"))


def standard_edits():
    """Three edits of every document, places taken from its length: a word inserted at a third,
    seven characters deleted at half, the last characters replaced."""
    n = F.coalesce(F.length("text"), F.lit(0))
    third, half = (n / 3).cast("int"), (n / 2).cast("int")
    return F.array(
        F.struct(third.alias("start"), third.alias("end"), F.lit(" inserted words").alias("replacement")),
        F.struct(half.alias("start"), (half + 7).alias("end"), F.lit("").alias("replacement")),
        F.struct(F.greatest(n, F.lit(0)).alias("start"), (n + 20).alias("end"), F.lit("\nEnd.").alias("replacement")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(F.col("label").isNotNull() & whitening.complete("embedding"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    noisy = rows.select("vec_id", label.alias("label"), hard_negatives.whole_numbers("embedding").alias("x"))
    return hard_negatives.mine(noisy, "vec_id % 100 = 0")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rare_features.fingerprint(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = rows.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", F.col("deviation").cast("long").alias("deviation"),
                       "whitened", F.col("explained")[F.col("at")].alias("explained"), "identity_error")


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_mixing": op2_mixing,
    "op3_licenses": op3_licenses,
    "op4_neighbours": op4_neighbours,
    "op5_metric_join": op5_metric_join,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_token_counts": op10_token_counts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_fingerprints": op12_fingerprints,
    "op13_whitening": op13_whitening,
}
