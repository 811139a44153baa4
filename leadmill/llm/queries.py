"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.llm import chat, hardneg, langid, lexical, linededup, lmscore, minhash, mixing, mpegts, packing, pieces, sketch, suffixes

#: The tokenizers of op4 and op12, names of the installed public tokenizers.
TOKENIZER, BYTE_TOKENIZER = "piece_bpe_32k.model", "byte_bpe_50k.json"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_docs(spark, sf_dir))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_chats(turns.unionByName(own)))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    cut = linededup.dedup_lines(docs)
    return cut.select(
        "doc_id",
        *(F.col(c).alias(name) for c, name in zip(linededup.added(docs.columns), ("n_lines", "n_removed", "n_runs"), strict=True)),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digests(pieces.encode(_docs(spark, sf_dir), pieces.read_model(public_tokenizers.path(TOKENIZER))))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_with_next(_docs(spark, sf_dir))


def op6_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.digests(mpegts.parse(mpegts.store(_docs(spark, sf_dir))))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.dedup_substrings(_docs(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = langid.predict(docs, langid.fit(docs))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["begin"], s["end"], s["lang"])), ",")
    return found.select("doc_id", F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "familiar", F.size("spans").alias("n_spans"), spans.alias("spans"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0")
    return lmscore.score_whole(lmscore.with_flag(docs, good, "__good"), F.col("__good"))


def op11_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_docs(spark, sf_dir), public_tokenizers.path(BYTE_TOKENIZER))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_chat_formatting, op3_line_dedup, op4_sentencepiece, op5_document_fingerprints,
        op6_transport_streams, op7_suffix_array_dedup, op8_language_id, op9_source_mixing, op10_lm_scoring,
        op11_block_max_search, op12_retrieval_packing, op13_hard_negatives,
    )
}
ORACLE: dict[str, str] = {"op1_minhash_near_dedup": minhash.ORACLE, "op7_suffix_array_dedup": suffixes.ORACLE, "op2_chat_formatting": chat.ORACLE, "op3_line_dedup": linededup.ORACLE, "op9_source_mixing": mixing.ORACLE, "op11_block_max_search": lexical.ORACLE, "op13_hard_negatives": hardneg.ORACLE}
