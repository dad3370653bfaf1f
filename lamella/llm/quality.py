"""Quality classifier (operator 10): interpolated modified Kneser-Ney model of the words of trusted text.

Trusted documents are those labelled 1 for quality. The model (:mod:`lamella.llm.word_model`) is kept in partitioned
tables that grow with the text; joins sharded by n-gram give each document's perplexity per word. A document is rejected
when its perplexity is above its language's threshold, a quantile of the perplexity of the trusted documents in that
language that were kept from the model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm import word_model
from lamella.plans.session import bounded, checkpointed, forget, small_batches

QUANTILE = 0.995
#: One trusted text in so many gives thresholds and is not counted.
HELD_OUT = 5
#: Steps per unit of log-perplexity to which thresholds are rounded up.
BINS = 1000


def thresholds(scores: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``(lang, threshold)``: that quantile of ``nll``, in steps of 1 / BINS, per language; null is a language of its own.

    Tasks send counts per step, so a language with a third of all rows is as small as any other.
    """
    return scores.where("nll is not null").groupBy("lang").agg((F.percentile(F.ceil(F.col("nll") * BINS), F.lit(quantile)) / BINS).alias("threshold"))


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` labelled 1 for quality; repeated labels count once, null ids match none.

    The ids are broadcast while they are few enough (see :func:`bounded`), else both sides are shuffled.
    """
    return docs.join(bounded(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()), "doc_id", "left_semi")


def _scored(docs: DataFrame, labels: DataFrame, quantile: float) -> tuple[DataFrame, DataFrame]:
    """``(text_id, nll)`` of all distinct texts and ``(lang, threshold)`` of all languages with trusted text."""
    small_batches(docs.sparkSession)
    held = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0  # copies of a text are on one side
    known = trusted_documents(docs.select("doc_id", "text"), labels).where("length(text) > 0")
    terms, unknown = word_model.fit(known.where(~held).select("text"))
    scored = word_model.scores(docs.select("text"), terms, unknown)
    forget(terms)
    rows = docs.where("length(text) > 0").select("doc_id", "lang", F.xxhash64("text").alias("text_id"))
    sure = trusted_documents(rows, labels).join(scored, "text_id")
    sure = checkpointed(sure.select("lang", "nll", (F.pmod("text_id", F.lit(HELD_OUT)) == 0).alias("held")))
    out = thresholds(sure.where("held"), quantile).select("lang", F.col("threshold").alias("out"))
    every = thresholds(sure, quantile).select(F.col("lang").alias("known"), "threshold")
    limits = every.join(out, F.col("lang").eqNullSafe(F.col("known")), "left").select(F.col("known").alias("limit_lang"), F.coalesce("out", "threshold").alias("threshold"))
    return scored, bounded(checkpointed(limits))


def classify(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ("doc_id",), quantile: float = QUANTILE) -> DataFrame:
    """Per row of ``docs``: ``row`` (struct of ``carry``), perplexity per word, threshold (null: no trusted text in the language), rejected.

    One trusted text in ``HELD_OUT`` is kept from the model and gives its language's threshold; a language without any
    such text takes the trusted texts it has. Null and empty texts have no perplexity and aren't rejected, nor is a
    document of a language without trusted text. Repeated rows are scored alike. Texts of any length are counted and
    scored whole, a slice of rows at a time. Other columns are not read; carried ones may have any name.
    """
    scored, limits = _scored(docs, labels, quantile)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col("lang").alias("own_lang"), F.when(F.length("text") > 0, F.xxhash64("text")).alias("text_id"))
    met = rows.join(scored.hint("merge"), "text_id", "left").join(limits, F.col("own_lang").eqNullSafe(F.col("limit_lang")), "left")
    return met.select("row", F.exp("nll").alias("perplexity"), F.exp("threshold").alias("threshold"), F.coalesce(F.col("nll") > F.col("threshold"), F.lit(False)).alias("rejected"))


def good_documents(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``docs`` without those that :func:`classify` rejects; the rejected texts' ids and languages go to the documents."""
    scored, limits = _scored(docs, labels, quantile)
    rows = docs.where("length(text) > 0").select(F.col("lang").alias("bad_lang"), F.xxhash64("text").alias("bad_id")).distinct()
    met = rows.join(scored, F.col("bad_id") == F.col("text_id")).join(limits, F.col("bad_lang").eqNullSafe(F.col("limit_lang")))
    bad = bounded(met.where("nll > threshold").select("bad_lang", "bad_id"))
    return docs.join(bad, (F.xxhash64(docs["text"]) == bad["bad_id"]) & docs["lang"].eqNullSafe(bad["bad_lang"]) & (F.length(docs["text"]) > 0), "left_anti")
