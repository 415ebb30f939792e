"""Helpers shared by the operators: reading tables, folds, written intermediates, keeping rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

SPACE = r"[\x20\x09-\x0D]+"  # runs of ASCII white space


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def blank(text: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fold(doc_id: str | Column, folds: int = 5) -> Column:
    """crc32 of the id as text modulo ``folds`` (a null id counts as the empty text)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds


def id_key(doc_id: str | Column) -> Column:
    """A join key that is never null."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(col.cast("string"), F.lit("~"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again: lineage ends here,
    a lost executor costs no recomputation, and two readers see the same rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_rows(docs: DataFrame, kept: DataFrame, text_key) -> DataFrame:
    """The rows of ``docs`` named by ``kept`` (doc_id, text_key), one row for each pair, with
    the columns of ``docs``.  ``text_key`` maps the text column to the key used in ``kept``.
    The window reuses the partitioning of the join."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.concat_ws("|", id_key("doc_id"), text_key(F.col("text"))).alias("key"),
        F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]).alias("tie"),
    )
    names = kept.select(F.concat_ws("|", id_key(kept.columns[0]), F.col(kept.columns[1])).alias("key"))
    first = F.row_number().over(Window.partitionBy("key").orderBy("tie"))
    return rows.join(names, "key", "left_semi").withColumn("n", first).where("n = 1").select("row.*")
