"""Reading and writing corpora.  Raw JSON and CSV are landed once as Parquet; everything else works on the landed table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.rollouts import source_label
from ..operators.scale import numbered
from .json_array import read_json_array  # noqa: F401

BAD = "_corrupt"


def read_records(spark: SparkSession, path: str | list[str], fmt: str, schema: str | None = None) -> DataFrame:
    """jsonl, txt, csv or parquet.  An empty CSV field stays an empty text; nothing is read as missing."""
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        out = reader.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\u0001").option("emptyValue", "").csv(path)
        return out.select(*[F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in out.dtypes])
    if fmt in ("jsonl", "json"):
        return reader.json(path)
    if fmt in ("txt", "text"):
        return spark.read.text(path).withColumnRenamed("value", "text")
    return reader.parquet(path)


def read_gz_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return read_records(spark, path, "jsonl", schema)


def read_sources(sources: dict[str, DataFrame], subset: list[str] | str | None = None, weak: tuple[str, ...] = ()) -> DataFrame:
    """Named tables stacked with their name.  ``all`` leaves out the weak ones; no subset means 'default' or everything."""
    if subset is None:
        names = ["default"] if "default" in sources else list(sources)
    elif subset == "all":
        names = [n for n in sources if n not in weak]
    else:
        names = [subset] if isinstance(subset, str) else list(subset)
    parts = [sources[n].withColumn("source", F.lit(n)) for n in names]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_row_index(df: DataFrame, order: list, by: list[str] | None = None, name: str = "row") -> DataFrame:
    """Exact 0-based row number in the given order, per source when ``by`` is given."""
    return numbered(df, order, by, name)


def land(df: DataFrame, path: str, partition: list[str] | None = None) -> DataFrame:
    """Write once as Parquet and go on from the written table."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def row_refs(df: DataFrame, cols: tuple[str, ...] = ("source", "row_id", "digest", "tokens", "bucket")) -> DataFrame:
    """The reference table beside the training rows: where each came from, without its text."""
    return df.select(*cols)


def write_row_refs(df: DataFrame, path: str, cols: tuple[str, ...] = ("source", "row_id", "digest", "tokens", "bucket")) -> None:
    row_refs(df, cols).write.mode("errorifexists").parquet(path)


def write_by_source(df: DataFrame, path: str, source: str = "data_source", mode: str = "errorifexists") -> None:
    """One folder per data source.  The rebalance hint splits large sources over many tasks and joins small ones."""
    out = df.withColumn(source, source_label(source)).hint("rebalance", source)
    out.write.mode(mode).partitionBy(source).json(path)


def rl_rows(df: DataFrame, source: Column, prompt: Column, env: str, truth: Column, extra: dict[str, Column], method: str = "rule") -> DataFrame:
    """Training rows for reinforcement learning: prompt messages, environment, expected answer and extras."""
    return df.select(source.alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("prompt"),
                     F.lit(env).alias("env_class"), F.struct(F.lit(method).alias("method"), truth.alias("ground_truth")).alias("reward_spec"),
                     F.struct(*[c.alias(k) for k, c in extra.items()]).alias("extra_info"))


def write_rl_parquet(df: DataFrame, path: str, split: str = "split", mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(split).parquet(path)


def dataset_manifest(df: DataFrame, outcome: str, digest: Column, kept: str = "kept", by: str = "source") -> DataFrame:
    """Per source: raw, kept and dropped counts (they must add up) and a digest of the kept rows that ignores their order.

    The digest is the sum of 32-bit pieces of the row digests, so it is the same for any number of part files.
    """
    piece = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    keep = F.col(outcome) == kept
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("raw"), F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"),
                              F.coalesce(F.sum(F.when(keep, piece)), F.lit(0)).alias("content_digest"))


def preview_page(df: DataFrame, order: list[str], page: int, page_size: int, max_cols: int | None = 30, max_chars: int | None = 500,
                 max_size: int | None = 200) -> tuple[DataFrame, DataFrame]:
    """(page of cells as text, totals).  A preview for people: page and size are clamped, long text is cut and missing cells are ''.

    A page is cut out by the positions of its rows, so a deep page costs what the first one does.  Each limit is a parameter, None for no limit.  The totals tell how many rows and columns there are in all.
    """
    size = max(int(page_size), 1) if max_size is None else min(max(int(page_size), 1), max_size)
    rows = df.count()
    pages = max((rows + size - 1) // size, 1)
    at = min(max(int(page), 1), pages)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns[:max_cols]]
    cells = [(x if max_chars is None else F.substring(x, 1, max_chars)).alias(c) for x, c in zip(cells, df.columns)]
    low = (at - 1) * size
    view = numbered(df, order, name="_at").filter((F.col("_at") >= low) & (F.col("_at") < low + size)).orderBy("_at").select(*cells)
    totals = df.sparkSession.createDataFrame([(rows, len(df.columns), pages, at)], "total_rows long, total_columns int, total_pages long, page long")
    return view, totals


def table_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [d.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("name"), "n_rows", F.lit(len(d.columns)).alias("n_columns"), F.lit(",".join(d.columns)).alias("columns"))
             for n, d in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
