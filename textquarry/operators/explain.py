"""Sentence-level attribution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.tokens import protected_sentences, without_sentence, word_count

WORD_BUDGET, LEAST_WORDS, CANDIDATES, SHOWN = 380, 10, 12, 5


def sentence_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``idx``, ``sentence``, ``n_words`` by the protected splitter."""
    return docs.select(key, F.posexplode(protected_sentences(F.col(text))).alias("idx", "sentence")).withColumn("n_words", word_count(F.col("sentence")))


def within_budget(sentences: DataFrame, key: str, budget: int = WORD_BUDGET, least: int = LEAST_WORDS) -> DataFrame:
    """Leading sentences up to a running word budget, then those of ``least`` words; short ones use the budget too."""
    run = F.sum("n_words").over(Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return sentences.withColumn("run", run).filter((F.col("run") <= budget) & (F.col("n_words") >= least)).drop("run")


def repeated_sentences(sentences: DataFrame, key: str) -> DataFrame:
    """Per document: sentences and how many of them stand more than once."""
    n = F.count("*").over(Window.partitionBy(key, "sentence"))
    return sentences.withColumn("n", n).groupBy(key).agg(F.count("*").alias("n_sentences"), F.count_if(F.col("n") > 1).alias("n_repeated"))


def leave_one_out(docs: DataFrame, key: str, text: str, score: Callable[[Column], Column], candidates: int = CANDIDATES, shown: int = SHOWN) -> DataFrame:
    """Effect of each candidate sentence on its document's score, the ``shown`` greatest per document.

    ``score`` maps a text column to a margin. Candidates are the longest distinct
    sentences within the budget. ``flat`` marks documents where no sentence moves
    the score by 5 % (D13).
    """
    base = docs.select(key, F.col(text).alias("_text"), score(F.col(text)).alias("doc_score"))
    sentences = within_budget(sentence_table(docs, key, text), key)
    distinct = sentences.groupBy(key, "sentence").agg(F.min("idx").alias("idx"), F.first("n_words").alias("n_words"), F.count("*").alias("times"))
    longest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n_words"), "idx"))
    tried = distinct.withColumn("_r", longest).filter(F.col("_r") <= candidates).drop("_r").join(base, key)
    scored = tried.withColumn("effect", F.col("doc_score") - score(without_sentence(F.col("_text"), F.col("sentence")))).withColumn("alone", score(F.col("sentence"))).drop("_text")
    per_doc = Window.partitionBy(key)
    rank = F.row_number().over(per_doc.orderBy(F.desc(F.abs("effect")), "idx"))
    flat = F.max(F.abs("effect")).over(per_doc) < 0.05 * F.greatest(F.abs("doc_score"), F.lit(1.0))
    return scored.withColumn("rank", rank).withColumn("flat", flat).filter(F.col("rank") <= shown)
