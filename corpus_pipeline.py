"""A corpus pipeline over documents: each stage takes what the one before left, as (spark, docs, sf_dir).

Language ID lets go documents without a letter, of no clear language (score below 0.5) or that no learnt language
codes better than plain bytes (8 bits each); where no document says its language nothing is learnt, and all with a
letter stay. Exact dedup keeps one row of each group of equal texts. MinHash
near-dedup (shingles of five words, similarity 0.8 or more) keeps one document of each group. PII replaces what it
finds by its kind in brackets and sets n_chars. Packing, the last, gives sequences of token ids and whose pieces they hold.

Cases: nulls and odd texts go through as each operator's docstring says; a document without an id is kept by the dedup
stages unless its text is a copy. Columns besides those of documents are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import exact_dedup, language_id, near_dedup, packing, pii, token_counts
from flowloom.llm.common import fresh, own_columns, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs, language_id.remainder("doc_id", 3) != 1)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    one = fresh(docs, "judged")
    clear = (F.col(one)["score"] >= 0.5) & (F.col(one)["bits"] < 8) & F.col("text").rlike(r"\p{L}")
    return docs.withColumn(one, language_id.judged(model, spark, F.col("text"))).where(clear).select(*own_columns(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.representatives(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans = fresh(docs, "pii_spans")
    out = pii.found(docs, base_col=fresh(docs, "pii_base"), spans_col=spans)
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), pii.masked(F.col("text"), F.col(spans))))
    if "n_chars" in docs.columns:  # a step of its own: it reads the masked text
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*own_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, ids_col="text", ids_of=token_counts.LibraryIds.public()).withColumnRenamed("owners", "doc_ids")


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
