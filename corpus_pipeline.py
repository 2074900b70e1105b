"""A training corpus from `documents`: rules, near-duplicates, personal data, mix, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.llm import mixing, pieces, pii, quality, simhash
from farebox.llm.common import cut, fresh, on_workers, table
from farebox.llm.queries import tokenizer


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the base rules and the trees keep; the trees learn from the labelled rows of the input."""
    on_workers(spark)
    trees = quality.train(table(spark, folder, "documents"), table(spark, folder, "labels"))
    (verdict,) = fresh(docs, "quality_rules")
    return quality.judge(docs, trees).where(F.col(verdict)["kept"]).drop(verdict)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    on_workers(spark)
    return simhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts with surrogates for personal data."""
    return _recounted(pii.replace_entities(docs))


def source_mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Number and digest of each row's ids, and the digest of the text decoded from them."""
    on_workers(spark)
    return pieces.digest_documents(docs.select("doc_id", "text"), tokenizer()).drop("text")


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates), ("PII", personal_data),
          ("source mix", source_mix), ("SentencePiece", token_ids)]

#: Trained trees, keyed hashes and merges are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder before the next."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, folder), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, folder)
