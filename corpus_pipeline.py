"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

toxicity -> near-dedup -> decontamination -> PII -> packing. All stages but the last return the columns of `documents`
(n_chars follows the text); the last returns pieces of token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.llm import decontamination, near_copies, packing, pii, toxicity
from tracequarry.llm.common import materialize, table
from tracequarry.llm.queries import surrogate_key, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold. Labels teach only through rows that aren't held out."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.usable_fold())
    scored = toxicity.score(docs, model, keep=list(COLUMNS))
    return scored.filter(F.col("toxicity") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, Jaccard 0.8): the one with the least doc_id."""
    return near_copies.keep_one(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    hits = decontamination.scan(docs, table(spark, sf_dir, "benchmark"), keep=list(COLUMNS))
    return hits.filter(~F.col("contaminated")).select(*COLUMNS)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    out = pii.replace_private(docs.select(*COLUMNS), surrogate_key(spark))
    return out.withColumn("n_chars", F.when(F.size("entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in token sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", replace_private), ("packing", pack)]

#: Fingerprints, learnt scores and token ids aren't SQL; tests/llm/test_pipeline.py checks every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
