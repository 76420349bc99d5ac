"""The corpus pipeline: five stages over `documents`, each of which can be written and read again by whoever runs them.

Every stage but the last returns the columns of documents. Decisions are taken row by row, so rows
with a null id, and rows that share an id, are each judged on their own text; only near duplicates know
documents by id: rows of one id are one document there, and those with a null id are linked with nothing and stay.
A null text is empty to every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, near_dedup, quality, segmentation, suffix_dedup
from tidemark.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a passage that counts as a repeat here: the fewest that 50 words can have, 50 of one byte and 49 separators.
PASSAGE_BYTES = 99


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the classifier rejects go."""
    model = quality.trained(docs, table(spark, sf_dir, "labels"))
    graded = quality.graded(docs, model, carry=("lang", "source", "n_chars"))
    return graded.filter("kept").select("doc_id", "text", "rest.lang", "rest.source", "rest.n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of near-duplicates the document with the smallest id stays (five words, 0.8)."""
    gone = near_dedup.NearDedup(width=5, percent=80).run(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: passages that a document with a smaller id holds are cut out; texts change, no document goes."""
    marked = docs.select(*COLUMNS, F.col("text").isNull().alias("none"))
    cut = suffix_dedup.kept_texts(marked, length=PASSAGE_BYTES, gram=48, carry=("lang", "source", "n_chars", "none"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("rest.n_chars"))
    return cut.select("doc_id", F.when(~F.col("rest.none"), F.col("text")).alias("text"), "rest.lang", "rest.source", n_chars.alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), carry=tuple(COLUMNS))


def segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: sampled piece encodings of what is left, for training."""
    return segmentation.encoded(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece_encoding", segmentations),
]

#: SQL cannot express these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
