"""From raw documents to packed token sequences, in five stages.

Each stage calls one operator of ``ledgerwise.llm`` on all rows that its predecessor kept.
``run`` writes every stage's rows as Parquet under the shared checkpoint folder and reads
them again, so a lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwise.llm import blob_ledger, minhash, mixing, packing, queries, toxicity
from ledgerwise.llm.common import identity, materialize, table
from ledgerwise.session import shared_dir

#: The fits, packings and component searches of the stages have no equivalent in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject as toxic."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), queries.CATEGORIES)
    return toxicity.drop_rejected(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8 or more)."""
    return minhash.keep_one(docs, percent=80, shingle=5)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced; ``n_chars`` follows the text."""
    ledger = blob_ledger.BlobLedger(spark, shared_dir(spark, f"ledger-{queries.run_name()}"))
    out = blob_ledger.redact(docs, ledger, "pipeline")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    row_id = identity("doc_id", "source")
    mixed = mixing.mix(docs.select(row_id.alias("row_id"), "text", "source"), key="row_id")
    return mixing.emit(docs, mixed, row_id, "row_id")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenized documents in sequences of at most 2048 tokens."""
    return queries.digest_pieces(packing.pack(docs, queries.tokenizer("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
