"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rawloom.llm import chat, compression, language, licenses, lines, media, pieces, simhash, templates, toxicity
from rawloom.llm.learning import remainder
from rawloom.session import table

#: The vocabulary of the tokenizer queries; a parameter of them, never copied.
PIECES = "piece_bpe_32k.model"
#: A score from which a label is predicted.
PREDICTED = 0.3

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str | None] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def piece_model() -> str:
    """Where the installed vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(PIECES)


@query
def op5_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored media, its round trip and audio features of every document."""
    return media.digests(media.audio_features(table(spark, sf_dir, "documents")))


@query
def op10_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Token ids of every document and the text that they decode to."""
    return pieces.digests(pieces.encode(table(spark, sf_dir, "documents"), model or piece_model()))


@query
def op3_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 4) == 2
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query
def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 5) == 0
    scored = compression.score(docs, compression.fit(docs, table(spark, sf_dir, "labels"), ~held))
    named = scored.withColumnRenamed("id", "doc_id")
    return named.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"), "difference")


@query
def op9_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 4) == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held, language.fit(docs, ~held))
    scored = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"))


@query
def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that occur earlier in the corpus."""
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", "text")


@query
def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised ones included."""
    return templates.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation, turn by turn, with the rendering."""
    return chat.repair(table(spark, sf_dir, "conversations"))


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))
