"""A corpus pipeline: each stage works on the documents that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.functions.staging import stored
from barloom.llm import language
from barloom.llm.decontamination import without_contaminated
from barloom.llm.ngram_join import one_of_each
from barloom.llm.packing import pack
from barloom.llm.queries import tokenizer_file
from barloom.llm.sources import table
from barloom.llm.suffix_dedup import without_repeats

#: Texts below this score are rejected: those without letters and those unlike all profiles. A language that is written
#: much like a labelled one can score above it and stays; no clean text of the given tables scores below.
LEAST_LANGUAGE_SCORE = 0.2


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those far from all language profiles (operator 4)."""
    return language.with_language(docs, language.fit_profiles(language.learnable(docs)), least_score=LEAST_LANGUAGE_SCORE)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest document of each group of near copies (operator 10)."""
    return one_of_each(docs)


def first_of_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take passages out of all documents but the first that has them (operator 8)."""
    return without_repeats(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark window (operator 9)."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences (operator 5); a row per piece."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_near_copies),
    ("suffix_array_dedup", first_of_repeats),
    ("benchmark_decontamination", no_benchmark),
    ("packing", packed),
]

#: Language profiles and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
