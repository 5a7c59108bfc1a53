"""A training corpus in five stages: toxicity, line dedup, near-dedup, decontamination, pieces.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All but the last return
the columns of ``documents``. A NULL doc_id leaves the corpus in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents_of, read, settled, tuned
from tidemark.llm.decontam import contaminated
from tidemark.llm.linededup import drop_repeated_lines
from tidemark.llm.neardup import near_duplicates
from tidemark.llm.pieces import sample_segmentations
from tidemark.llm.queries import PIECES
from tidemark.llm.toxicity import fit, score

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose doc_id is not among ``ids`` (whose number the planner looks at)."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5; the model learns from the labels of the training part."""
    tuned(spark)
    model = fit(documents_of(docs), read(spark, sf_dir, "labels"))
    rejected = settled(score(docs, model).where("predicted = 1").select("doc_id"))
    return _without(docs.where("doc_id IS NOT NULL"), rejected)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that five or more of them share; one that had nothing else goes."""
    tuned(spark)
    out = drop_repeated_lines(docs, carry=("lang", "source"))
    out = out.where((F.col("n_dropped") == 0) | (F.trim("text") != ""))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near-duplicates."""
    tuned(spark)
    return _without(docs, settled(near_duplicates(docs).where("NOT kept").select("doc_id")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    tuned(spark)
    return _without(docs, settled(contaminated(docs, read(spark, sf_dir, "benchmark")).select("doc_id")))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of what is left."""
    tuned(spark)
    return sample_segmentations(docs, PIECES)


STAGES = [
    ("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("decontamination", decontaminate), ("sentencepiece", pieces),
]
# The model's fit and the sampling are beyond SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
