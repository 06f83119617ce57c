"""Extra columns of any name: all that the code itself uses are added to the tables."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import tasteplane.llm
from tasteplane.llm import bpe, chat, decontaminate, lang_id, line_dedup, media_chunks, near_dedup, pii, queries, secret_scan, token_counts
from tests.llm.fixtures import ROWS, documents

OWN = {"doc_id", "text", "lang", "source"}
NAMES = sorted({n for p in Path(tasteplane.llm.__file__).parent.glob("*.py") for n in re.findall(r"[\"']([a-z_][a-z_0-9]{0,24})[\"']", p.read_text())} - OWN)
ITEM = "The quick brown fox jumps over the lazy dog"


def wide(spark, names=NAMES):
    return documents(spark, ROWS).select(*sorted(OWN), *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, ITEM)], "item_id long, text string").select("*", *[F.lit(0).alias(n) for n in NAMES if n != "item_id"])


@pytest.fixture(scope="module")
def model(spark):
    return lang_id.fit({"en": {"the": 9, "fox": 2}, "es": {"dice": 2}}, ["▁", "the", "fox", "dice"])


def test_the_list_holds_internal_names():
    assert {"_gone", "_row", "_leaking", "_lang_pred", "_id", "fp", "label", "key"} <= set(NAMES)


OPERATORS = {
    "op1": lambda spark, docs, items, model: token_counts.documents_rollup(spark, docs),
    "op2": lambda spark, docs, items, model: decontaminate.contaminated(docs, items),
    "op3": lambda spark, docs, items, model: bpe.tokenized(docs, bpe.read_vocabulary(queries.vocabulary_path())),
    "op4": lambda spark, docs, items, model: pii.found(docs),
    "op5": lambda spark, docs, items, model: near_dedup.near_duplicates(docs),
    "op6": lambda spark, docs, items, model: line_dedup.report(docs),
    "op7": lambda spark, docs, items, model: media_chunks.media_columns(docs),
    "op8": lambda spark, docs, items, model: chat.read_back(chat.format_chats(docs.drop("conv_id", "turn", "role").select("*", F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role")))),
    "op9": lambda spark, docs, items, model: secret_scan.digests(secret_scan.scan(docs)),
    "op10": lambda spark, docs, items, model: lang_id.identified(docs, model)[0],
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, items, model, name):
    assert OPERATORS[name](spark, wide(spark), items, model).count() > 0


STAGES = {
    "language_id": lambda docs, items, model: lang_id.identified(docs, model)[0].select(*docs.columns),
    "line_dedup": lambda docs, items, model: line_dedup.clean(docs),
    "near_dedup": lambda docs, items, model: near_dedup.deduplicated(docs),
    "decontamination": lambda docs, items, model: decontaminate.clean(docs, items),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_the_columns(spark, items, model, name):
    docs = wide(spark)
    out = STAGES[name](docs, items, model)
    assert out.columns == docs.columns and out.filter("doc_id = 10").count() == 1
    row = out.filter("doc_id = 10").first()
    assert all(row[n] == i for i, n in enumerate(NAMES))
