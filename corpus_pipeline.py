"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, sources are mixed, the rest is packed.

All stages take rows with null ids, texts or sources, empty and very long texts, repeated rows, no rows at all and columns of any
name; the first three give back the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm import mixing, packing, simhash, toxicity
from provenant.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; the rest is as it was, whatever its columns are called.

    A null text is judged as the empty one, which has no features, and each repeated row like the others; an empty table gives none.
    """
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    return toxicity.judge(whole, table(spark, sf_dir, "labels")).where("NOT tox_rejected").select("whole.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id (null ids last): five words a shingle, a similarity of 0.8 or more.

    Null, empty and wordless texts are one group; of repeated rows one stays; an empty table gives none.
    """
    return simhash.without_near_duplicates(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source to its target: documents in a random order, repeated or left out by whole epochs, one of a source cut.

    Null sources are one more source; a text without words has nothing to take and goes; ties in the random order go by doc_id, size
    and text, repeated rows are taken one by one; an empty table gives none.
    """
    return mixing.mixed(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece.

    A null or empty text is its end id alone; repeated rows are packed one by one; an empty table gives no piece.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]

#: No SQL expresses the classifier, the fingerprints or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole of documents, each on the written table of what its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
