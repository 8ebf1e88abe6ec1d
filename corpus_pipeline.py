"""A corpus made ready for training: quality rules, near-duplicates, pseudonyms, mixing to weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm import mix, neardup, packing, pii, quality
from lexigrove.llm.common import table
from lexigrove.llm.queries import PII_KEY

#: Mixing and packing have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the smallest doc_id: five words, a similarity of 0.8 or more."""
    return neardup.deduplicated(docs, shingle=5, similarity=0.8)


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars follows the text."""
    named = pii.pseudonymised(docs, PII_KEY)
    return named.withColumn("n_chars", F.length("text").cast(named.schema["n_chars"].dataType)) if "n_chars" in docs.columns else named


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix.mixed(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as sequences of tokens: rows (doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset)."""
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("pii pseudonyms", pii_pseudonyms),
    ("mix sources", mix_sources),
    ("pack", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
