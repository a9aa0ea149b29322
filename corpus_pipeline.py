"""A corpus from raw documents to token ids, in five stages.

Each stage takes what its predecessor kept, whole, and gives back the columns of
``documents``; the last gives ids.  Stages are written as Parquet in the shared
folder and read again, so a lost executor costs no more than a reread.

In every stage a null text counts as empty, very long texts are judged whole, other
columns pass through whatever their names, and an empty table gives an empty result.
Null identifiers are rows like any other and come after all others where the smallest
stays.  What repeated rows and ties come to is told with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from propflow.llm import exact_dedup, mixing, quality, simhash, trie_bpe
from propflow.llm.shared import staged, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, accepts; equal texts are judged alike, and empty ones are scored like any other."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the smallest doc_id; of rows alike in both, one."""
    return exact_dedup.keep_one(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that of the smallest doc_id; texts without words are one group."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those without words are never taken, and a null source is one of its own."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and ids, one row for each row of the mix, copies included; an empty text has no ids."""
    import public_tokenizers

    return trie_bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", no_copies),
    ("near_dedup", no_near_copies),
    ("mixing", mixed),
    ("bpe", token_ids),
]

#: The classifier, fingerprints and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
