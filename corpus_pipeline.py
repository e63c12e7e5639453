"""A training corpus from ``documents``: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import decontaminate, jaccard, pieces, pii, toxicity
from pagemill.llm.common import drop_staged, release, stage, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    release(spark)  # broadcasts and shuffle files of the stage before
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates (shingles of five words, similarity 0.8): the smallest id of each group stays."""
    release(spark)  # broadcasts and shuffle files of the stage before
    return jaccard.one_of_each(docs, words=5, threshold=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    release(spark)  # broadcasts and shuffle files of the stage before
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts; no document goes."""
    release(spark)  # broadcasts and shuffle files of the stage before
    return pii.mask_pii(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become ids of the vocabulary; what the ids decode to comes with them as a digest, and whether it is the text."""
    release(spark)  # broadcasts and shuffle files of the stage before
    return pieces.encode_and_decode(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]

#: Learnt scores, belief propagation and Viterbi search are beyond SQL; the tests hold a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's table goes when the next one is written.

    The columns are those of ``documents`` with ids, decoded_sha256 and exact.  Null and empty texts pass all stages (no
    ids); rows of one id with equal texts become one; an empty table stays empty.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        done = stage(step(spark, docs, sf_dir), "corpus-" + name.split()[0].lower())
        if k:
            drop_staged(docs)
        docs = done
        release(spark)
    return docs
