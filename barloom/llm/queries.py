"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, line_crf, oracles
from .byte_bpe import decoded, encoded
from .cap_filters import near_duplicates
from .collocations import collocations
from .decontamination import contamination
from .divergence import divergence
from .html_layout import rendered
from .ngram_join import jaccard_components
from .packing import pack
from .sources import table
from .suffix_dedup import repeat_report
from .token_counts import token_counts
from .warc import derivatives, responses


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "pages"))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit_profiles(language.learnable(docs)))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def tokenizer_file(name: str) -> str:
    """A file of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = line_crf.score(docs, line_crf.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", line_crf.held_out().alias("held_out"), "score", "predicted")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    ranks = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    back = decoded(encoded(table(spark, sf_dir, "documents"), ranks, PATTERN), ranks)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_embedding_near_dedup,
        op2_html_extraction,
        op3_warc_derivatives,
        op4_language_id,
        op5_packing,
        op6_token_counts,
        op7_line_crf,
        op8_suffix_dedup,
        op9_benchmark_decontamination,
        op10_ngram_jaccard_join,
        op11_phrase_collocations,
        op12_source_divergence,
        op13_byte_bpe,
    )
}

ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": oracles.NEAR_VECTORS,
    "op8_suffix_dedup": oracles.REPEATS,
    "op9_benchmark_decontamination": oracles.DECONTAMINATION,
    "op10_ngram_jaccard_join": oracles.JACCARD,
    "op11_phrase_collocations": oracles.COLLOCATIONS,
    "op12_source_divergence": oracles.DIVERGENCE,
}
