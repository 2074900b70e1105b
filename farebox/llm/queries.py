"""The operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.llm import (
    centroids, chat, fim, language, minhash, mixing, pieces, pii, quality, simhash, topk, toxicity, warc)
from farebox.llm.common import on_workers, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    @wraps(build)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        on_workers(spark)
        return build(spark, folder)

    QUERIES[build.__name__] = run
    return run


def remainder(divisor: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(divisor))


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op1_chat_formatting(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    spans = lambda m: F.array_join(F.transform(m, lambda x: F.concat_ws("-", x["begin"], x["end"])), ",")
    return chat.preferences(turns, chat.corpus_pairs(turns)).withColumns(
        {m: spans(F.col(m)) for m in ("chosen_mask", "rejected_mask")})


@query
def op2_impact_top_k(spark, folder):
    rows = topk.vectors(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    return topk.top_k(rows, F.col("vec_id") % 50 == 0)


@query
def op3_pii_surrogates(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, count="n_entities")


@query
def op4_source_mixing(spark, folder):
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_language_id(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.train(docs, remainder(3) != 1)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"),
                        F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"),
                        F.col("language.rejected").alias("rejected"))


@query
def op6_simhash_dedup(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op7_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    net = toxicity.train(docs, table(spark, folder, "labels"), remainder(5) != 0)
    return toxicity.score(docs, net).select(
        "doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


@query
def op8_sentencepiece(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pieces.digest_documents(docs, tokenizer()).drop("text")


@query
def op9_warc_transactions(spark, folder):
    return warc.summary(warc.round_trip(table(spark, folder, "pages")))


@query
def op10_quality_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    trees = quality.train(docs, table(spark, folder, "labels"))
    judged = quality.judge(docs, trees).select("doc_id", "quality_rules.*")
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept", "score")


@query
def op11_fill_in_middle(spark, folder):
    made = fim.fill_in_middle(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query
def op12_centroid_clustering(spark, folder):
    return centroids.cluster(table(spark, folder, "embeddings").select("vec_id", "embedding"))


@query
def op13_minhash_dedup(spark, folder):
    return minhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@query
def pipeline(spark, folder):
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
