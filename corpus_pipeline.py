"""A corpus pipeline of five stages: quality rules, language, near-duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next stage's docs. Null texts fail the quality rules;
extra columns of the documents are carried through; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvault.llm import langid, neardup, packing, pii, quality_rules
from sparkvault.llm._common import materialize
from sparkvault.llm.queries import PII_KEY, table, tokenizer_path

#: A language's share of a text's probability below which the text is rejected.
LEAST_SCORE = 0.5
#: Percent of common shingles from which texts are near-duplicates.
LEAST_SIMILARITY = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and whose host is not rejected."""
    return quality_rules.passing(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a recognised language."""
    known = langid.predict(docs, langid.fit(docs), prefix="__li_")
    return known.filter((F.col("__li_lang_pred") != "und") & (F.col("__li_score") >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.deduplicate(docs, percent=LEAST_SIMILARITY)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data; n_chars follows the text."""
    out = pii.pseudonymise(docs, PII_KEY)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("best-fit packing", pack),
]

#: No SQL: the context trees, MinHash groups, keyed surrogates and the tokenizer are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
