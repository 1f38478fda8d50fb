"""From documents to token ids: five stages, each by an operator of ``driftwell.llm``.

A stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of ``documents``; the last
returns the token ids of each mixed document.  ``run`` writes each stage's rows to the shared folder and reads them back, so a
lost executor costs no earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import bpe, mixing, simhash, suffixes, toxicity
from driftwell.llm.common import shared_table, table
from driftwell.llm.queries import held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the model learns from the labels that are not held out."""
    weights, bias = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    return toxicity.score(docs, weights, bias, carry=COLUMNS).where("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash fingerprints of three-word shingles at most 3 bits apart, found by
    pigeonring, or a similarity of five-word shingles of 0.8 or more; links of both kinds chain."""
    return simhash.one_of_each_group(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 200-byte strings; bytes left over of a cut character go too."""

    @F.pandas_udf("string")
    def whole_characters(kept):
        return kept.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    cut = suffixes.remove_repeats(docs, carry=["lang", "source", "n_chars", "text"])
    text = F.when(F.col("n_removed") == 0, F.col("carried.text")).otherwise(whole_characters("kept"))
    rows = cut.select("doc_id", text.alias("text"), "carried.lang", "carried.source", "carried.n_chars", "n_removed")
    return rows.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of each document that the mix takes, one row per document and pass."""
    return mixing.mixed_documents(docs, *mixing.mix(docs)).select(*COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the digest of the decoded bytes."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", to_tokens),
]

#: SQL can state neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
