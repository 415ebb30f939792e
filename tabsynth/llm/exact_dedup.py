"""Exact duplicates by content sort.

Sampled splitters range-partition the normalised bytes, every partition is sorted externally
so that equal texts are neighbours, and neighbours are compared in full.  The splitters see a
bounded key (leading characters, digest, id), so the driver holds bounded rows however long
the texts are; the id in the key lets a text that holds a third of all rows span partitions.
Runs that touch a partition's edge are merged by one small grouping (two rows a partition)."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import default_ranges
from .common import SPACE, blank, keep_rows, written

RUNS = "id bigint, keep bigint, size bigint, head boolean, sha string, pid int, run bigint, edge boolean, edge_text string"
FLUSH = 8192


def normalised(text: str | Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(blank(text), SPACE, " ")


def normal_sha(text: str | Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _compare_neighbours(batches):
    """Sorted (id, sha, norm) rows in; one row out for each, with its run's smallest id and size."""
    pid, schema = TaskContext.get().partitionId(), pa.schema([
        ("id", pa.int64()), ("keep", pa.int64()), ("size", pa.int64()), ("head", pa.bool_()), ("sha", pa.string()),
        ("pid", pa.int32()), ("run", pa.int64()), ("edge", pa.bool_()), ("edge_text", pa.string())])
    out: list[tuple] = []

    def close(number, ids, sha, text, edge):
        keep, size = min((i for i in ids if i is not None), default=None), len(ids)
        out.extend((i, keep, size, k == 0, sha, pid, number, edge, text if edge and k == 0 else None) for k, i in enumerate(ids))

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        out.clear()
        return batch

    run, ids, sha, text = -1, [], None, None
    for batch in batches:
        for i, h, norm in zip(*(batch.column(k).to_pylist() for k in ("id", "sha", "norm"))):
            if run >= 0 and norm == text:
                ids.append(i)
                continue
            if run >= 0:
                close(run, ids, sha, text, run == 0)
                if len(out) >= FLUSH:
                    yield flush()
            run, ids, sha, text = run + 1, [i], h, norm
    if run >= 0:
        close(run, ids, sha, text, True)
        yield flush()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     lead_chars: int = 64, partitions: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are; the smallest id of a group stays.  A null
    text is the empty text.  Null ids come after all others and stay only if a group has no
    other.  Of rows that repeat both id and text exactly one is kept.  No rows give no rows;
    other columns are not read."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), normalised(text_col).alias("norm"))
    rows = rows.select("id", "norm", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), F.substring("norm", 1, lead_chars).alias("lead"))
    order = ["lead", "sha"]
    cut = rows.repartitionByRange(partitions or default_ranges(docs.sparkSession), *order, F.col("id").asc_nulls_last())
    cut = cut.sortWithinPartitions(*order, "norm", F.col("id").asc_nulls_last()).select("id", "sha", "norm")
    runs = written(cut.mapInArrow(_compare_neighbours, RUNS), "content-runs")
    edges = runs.where("edge and head").select("pid", "run", "keep", "size", "sha", "edge_text")
    whole = edges.groupBy("sha", "edge_text").agg(
        F.min("keep").alias("all_keep"), F.sum("size").alias("all_size"), F.min("pid").alias("first_pid"))
    # at most two rows for each range partition
    fix = F.broadcast(edges.join(whole, ["sha", "edge_text"]).select("pid", "run", "all_keep", "all_size", "first_pid"))
    first = F.col("head") & F.coalesce(F.col("pid") == F.col("first_pid"), F.lit(True))
    return runs.join(fix, ["pid", "run"], "left").select(
        F.col("id").alias("doc_id"), F.coalesce("all_keep", "keep").alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"), first.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = exact_duplicates(docs).where("kept").select("doc_id", "text_sha256")
    return keep_rows(docs, kept, normal_sha)
