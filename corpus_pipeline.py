"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept and returns documents with all their columns, but for the last, which returns
the packed pieces.  ``run`` writes each stage's result to the shared folder and reads it back for the next.
"""

from pyspark.sql import DataFrame, SparkSession

from spanlens.llm import catalog, exact_dedup, fertility, mixing, near_simhash, packing
from spanlens.storage import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return fertility.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that links of similarity 0.8 or more (Jaccard, 5 words) hold together.

    Candidates are texts whose SimHash fingerprints meet; op7's have too few bits for this similarity (they differ in 9 of 64 in the
    median), so the stage has longer ones.  Whole sets decide."""
    return near_simhash.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay with the probability that brings the domains' words to their targets.

    No document is repeated: a domain that the earlier stages left short has all its words as its target.  What each domain
    was to have and what it has is stored as ``mix-report``."""
    mixed, report = mixing.mix_reported(docs, catalog.labels(spark, sf_dir), catalog.TARGETS)
    stored(spark.createDataFrame(report, mixing.REPORT).coalesce(1), "mix-report")
    return mixed


def packing_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, placed in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules), ("exact dedup", exact_copies), ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", source_mix), ("best-fit packing", packing_bins),
]

#: SQL has no tokenizer, fingerprints or packing: the stages are tested one by one and together by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
