"""A corpus from raw documents to a mixed training set, in stages that each read the Parquet table of the stage before.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of ``documents``.  ``run`` writes every stage to the shared
folder and reads it again, so that lineage ends there and a lost executor costs no more than its tasks.  Several stages fit or search and have no SQL twin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import decontaminate, linejoin, mixing, ordinal, simhash
from tessera.llm.store import store

GOOD = 2  # the grade a document must probably reach
PROBABLY = 0.5


def under_cover(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with the columns that a stage does not use under names of their own, and what gives them their names back."""
    names = {c: f"__column{i}" for i, c in enumerate(docs.columns) if c not in used}
    return docs.withColumnsRenamed(names), lambda df: df.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good rather than poor or toxic, by a model fitted on the ratings in ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratings = labels.select("doc_id", ordinal.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    rows, back = under_cover(docs, "doc_id", "text")
    model = ordinal.train(rows, ratings, n_grades=3)
    return back(ordinal.score(rows, model).filter(F.get("p_at_least", F.lit(GOOD - 1)) >= PROBABLY))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are similar to an earlier one.  A document whose lines all go stays with an empty text."""
    rows, back = under_cover(docs, "doc_id", "text", "n_chars")
    done = linejoin.dedup_lines(rows, similarity=0.8)
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return back(done.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash.one_of_each(docs, shingle=5, distance=2, similarity=0.8).select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, back = under_cover(docs, "doc_id", "text")
    rest = tuple(c for c in rows.columns if c != "doc_id")
    return back(decontaminate.hits(rows, items, window=10, carry=rest).filter("n_hit = 0"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their copies; sources share the words of the corpus 1 : 2 : 3, repeating.

    Adds size, source_size, target, copies and taken, in place of columns of those names.  Rows are told apart by key, text and, where both are repeated, by a
    number, so that repeated rows are mixed as rows of their own and choices follow the contents of rows.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    slim = docs.drop(*added)
    rows, _ = under_cover(slim, "doc_id", "text", "source")
    text = F.xxhash64("text")
    nth = F.row_number().over(Window.partitionBy("doc_id", text).orderBy(F.xxhash64(*rows.columns)))
    rows = store(rows.withColumn("_row", F.struct("doc_id", text.alias("text"), nth.alias("nth"))), "mix-rows")
    mixed = mixing.mix(rows, weights=[1, 2, 3], most=3, key="_row").filter("copies > 0").select(F.col("_row").alias("_mixed"), *added)
    met = rows.join(mixed, F.col("_row").eqNullSafe(F.col("_mixed")))
    names = dict(zip(slim.columns, rows.columns))
    return met.select(*[F.col(names[c]).alias(c) for c in slim.columns], *added)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark_free", benchmark_free), ("mix", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
