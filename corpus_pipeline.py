"""The corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, BPE.

Each stage works on all that its predecessor kept; stages that filter return the columns of
``documents``. Part of the training-data subpackage: it goes when tasteplane.llm goes.

Edge cases: null, empty and letterless texts are rejected by the first stage; documents of which
line dedup leaves nothing go; a null doc_id is a document like others, told apart by its text; rows that repeat
doc_id and text become one row in the third stage; of ties (equal doc_ids, other texts) the least text hash stays; very
long texts are taken whole; an empty table gives no rows; columns of any other names stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasteplane.llm import bpe, decontaminate, lang_id, line_dedup, near_dedup
from tasteplane.llm._shared import discard, stored
from tasteplane.llm.queries import language_model, vocabulary_path

#: below it no language stands out
LEAST_SCORE = 0.5
#: beyond it (times the typical negative log likelihood a letter) a text is of none of the learned languages
STRANGEST = 2.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model tells apart; rejected are those without letters, without a clear language, or unlike all learned ones."""
    found, lang, score, strange = lang_id.identified(docs, language_model(docs))
    return found.filter((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE) & (F.col(strange) <= STRANGEST)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs, width=5, threshold=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenized(docs, bpe.read_vocabulary(vocabulary_path()))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: language models are not expressible in SQL; tests hold the pipeline against a plain Python version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
