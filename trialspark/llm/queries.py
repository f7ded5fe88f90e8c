"""The operators over the benchmark tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trialspark.llm import (
    ann, fim, langid, linededup, neardup, packing, pieces, pii, repair, secretscan, tokens, topk, toxicity,
)


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(
        documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), limit=1024
    )


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0, k=20, tables=6, probes=16)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), capacity=2048, stop=0
    )


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find(docs, pii.fit(docs))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.drop_repeated_runs(documents(spark, sf_dir), window=3)
    return cleaned.select("doc_id", "text", "n_lines", "n_removed")


def op6_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def held_out(key: str = "doc_id") -> Column:
    """The quarter of all documents that nothing is learned from; missing keys are not in it."""
    rest = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4))
    return F.coalesce(rest == 2, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(~held_out()), rows_per_language=4000)
    predicted = langid.predict(docs, model)
    return predicted.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secretscan.find(docs, secretscan.fit(docs, sample_docs=4000, sample_tokens=10_000))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(
        documents(spark, sf_dir), neardup.Plan(words=3, percent=85)
    )


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    model = toxicity.fit(docs, labels, sample_docs=4000)
    scored = toxicity.score(docs, model, cut=0.3)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, by a checksum of conversation and turn."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    copies = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    return conversations.select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(space("role")).alias("role"),
        text.alias("text"), F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"),
    ).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    reports, repaired = repair.repair(repair.as_turns(damaged(conversations)))
    every = conversations.select("conv_id").distinct().withColumn("conv", repair.conv_name(F.col("conv_id")))
    found = every.join(reports, "conv", "left").join(repair.digests(repaired), "conv", "left")
    zeros = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zeros),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fim.transform(documents(spark, sf_dir), plain_from=90, spm_below=20)
    return moved.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_nearest": op2_nearest,
    "op3_packing": op3_packing,
    "op4_personal_data": op4_personal_data,
    "op5_line_dedup": op5_line_dedup,
    "op6_piece_round_trip": op6_piece_round_trip,
    "op7_language": op7_language,
    "op8_top_scores": op8_top_scores,
    "op9_secrets": op9_secrets,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_toxicity": op11_toxicity,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_fill_in_middle": op13_fill_in_middle,
}
