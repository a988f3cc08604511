"""Queries of problem 8: languages of documents and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import spread, table
from .language import LanguageModel, detect_languages, labelled_sample, train


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, named: the language that the document's own label names, null if none."""
    labels = table(spark, sf_dir, "lang_labels").select(F.col("label").alias("_label"), F.col("lang").alias("named"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lower(F.trim("lang", F.lit(" \t\r\n　 "))).alias("_given"))
    # lang_labels is a fixed table of 51 rows
    return docs.join(F.broadcast(labels), F.col("_given") == F.col("_label"), "left").select("doc_id", "text", "named")


def fitted_model(spark: SparkSession, sf_dir: str) -> LanguageModel:
    """Trained on a bounded sample of labelled documents. The held-out evaluation items take no part."""
    return train(*labelled_sample(_named(spark, sf_dir), "doc_id", "text", F.col("named")))


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, segment_no (-1: the document), lang, confidence, accepted, letters, named."""
    return detect_languages(spread(_named(spark, sf_dir)), "doc_id", "text", fitted_model(spark, sf_dir), "named").withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_languages(spark, sf_dir).where("named is null or named <> lang").select("doc_id", "segment_no", "lang")


def p8_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the model's held-out segments by confidence: how many, their mean confidence, and the share whose document's label agrees; wrong labels count as they stand, and
    wrong_labels is the share of them that the calibration reckons with."""
    m = fitted_model(spark, sf_dir)
    rows = [(*r, m.wrong_labels, m.temperature, m.reject_below) for r in m.reliability]
    return spark.createDataFrame(rows, "low double, high double, segments bigint, confidence double, agreed double, wrong_labels double, temperature double, reject_below double")


QUERIES = {"p8_found": p8_found, "p8_languages": p8_languages, "p8_reliability": p8_reliability}
ORACLE: dict[str, str] = {}
