"""A corpus in five stages: language, near copies, repeated passages, benchmark leaks, packing.

Every stage is a function (spark, docs, sf_dir) -> DataFrame that works on all rows
its predecessor kept.  ``run`` writes each result as Parquet in the shared folder and
reads it again for the next.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import decontaminate, jaccard, langid, packing, repeats
from loomwork.llm.common import read
from loomwork.llm.queries import tokenizer_path
from loomwork.staging import stage

#: A document stays if the network gives its best language at least this probability.
LEAST_LANGUAGE_SCORE = 0.5


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The columns under names that no operator uses, and those names."""
    names = [f"column_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; texts without a letter go."""
    net = langid.fit(docs, F.lit(True))
    plain, names = _numbered(docs)
    text = names[docs.columns.index("text")]
    told = langid.predict(plain, net, names, text_col=text)
    kept = told.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*names).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked at 5-word Jaccard 0.75 or more: that of the smallest id."""
    return jaccard.one_of_each(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every byte of a 400-byte string that stands twice out of the texts; n_chars follows.

    A character that a cut splits goes with it.
    """
    plain, names = _numbered(docs)
    text, size = names[docs.columns.index("text")], names[docs.columns.index("n_chars")]
    cut = repeats.remove_repeats(plain, length=400, text_col=text, keep=tuple(names))
    whole = F.when(F.col("n_removed") > 0, F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", "")).otherwise(F.col(text))
    cut = cut.withColumn(text, whole)
    cut = cut.withColumn(size, F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col(size)))
    return cut.select(*names).toDF(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark question, also asked again with other numbers, names or units."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048 ids: a row for each piece."""
    pieces = packing.pack_documents(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("pack", pack),
]

#: The stages are not expressible in SQL as a whole (a trained network, cut texts); tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
