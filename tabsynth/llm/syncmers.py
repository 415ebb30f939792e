"""Document fingerprints from closed syncmers, in DataFrame expressions only.

The alphabet is words (runs without ASCII blanks; while over 32 code points are left, 8 are cut off).
Of all windows of ``k`` words, those are chosen whose smallest inner run of ``s`` words (by
hash) lies at an edge.  The choice depends on the window alone, so an edit moves no anchor
outside its reach, and equal passages have equal anchors wherever they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import default_ranges
from .common import SPACE, blank, id_key, written

LONG_RUN = r"([^\x20\x09-\x0D]{8})(?=[^\x20\x09-\x0D]{25})"


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(text, LONG_RUN, "$1 "), SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def with_anchors(df: DataFrame, text: str, out: str, k: int = 5, s: int = 2) -> DataFrame:
    """Add ``out``: array of (position, hash) of the anchors, positions in words from 0.  A text
    of fewer than ``k`` words has one anchor for all of them, an empty text none."""
    h, m, n = f"{out}_h", f"{out}_m", k - s + 1
    inner = ", ".join(f"get(`{h}`, i + {j})" for j in range(1, s))
    sub = [f"`{m}`[i + {j}]" for j in range(n)]
    window = ", ".join(f"`{h}`[i + {j}]" for j in range(k))
    df = df.withColumn(h, word_hashes(F.col(text)))
    df = df.withColumn(m, F.expr(f"transform(`{h}`, (x, i) -> xxhash64(x{', ' + inner if inner else ''}))"))
    chosen = f"filter(sequence(0, size(`{h}`) - {k}), i -> least({', '.join(sub)}) in ({sub[0]}, {sub[-1]}))"
    every = f"transform({chosen}, i -> struct(i as position, xxhash64({window}) as hash))"
    short = f"array(struct(0 as position, xxhash64(`{h}`) as hash))"
    none = "cast(array() as array<struct<position: int, hash: bigint>>)"
    return df.withColumn(out, F.expr(f"case when size(`{h}`) >= {k} then {every} when size(`{h}`) > 0 then {short} else {none} end")).drop(h, m)


def sketch(anchors: Column, size: int = 64) -> Column:
    """The smallest ``size`` distinct 32-bit anchor hashes, in order; each less 2**31, so that
    four bytes hold it and the order stays."""
    low = F.transform(anchors, lambda a: (F.pmod(a["hash"], F.lit(1 << 32)) - F.lit(1 << 31)).cast("int"))
    return F.slice(F.array_sort(F.array_distinct(low)), 1, size)


def sketch_text(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: F.lower(F.lpad(F.hex(x.cast("bigint") + F.lit(1 << 31)), 8, "0"))), "")


def likeness(a: Column, b: Column, size: int = 64) -> Column:
    """Share of the smallest ``size`` values of both sketches that are in each (an estimate of
    the Jaccard similarity of the anchor sets); two empty sketches are alike."""
    lowest = F.slice(F.array_sort(F.array_union(a, b)), 1, size)
    shared = F.size(F.array_intersect(lowest, F.array_intersect(a, b)))
    return F.when(F.size(lowest) == 0, F.lit(1.0)).otherwise(shared / F.size(lowest))


def match_positions(docs: DataFrame, k: int = 5, s: int = 2) -> DataFrame:
    """(doc_id, position, hash) rows of all anchors, for joins on the hash by the caller."""
    rows = with_anchors(docs.select("doc_id", blank("text").alias("text")), "text", "anchors", k, s)
    return rows.select("doc_id", F.inline("anchors"))


def next_ids(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, next_id) over the distinct ids in descending order, null last, the last followed by
    the first.  Ids are range-partitioned; only one row for each range meets in one task."""
    ids = docs.select(F.col(id_col).alias("id")).distinct()
    order = F.col("id").desc_nulls_last()
    cut = written(ids.repartitionByRange(default_ranges(docs.sparkSession), order).withColumn("range", F.spark_partition_id()), "id-ranges")
    inside = Window.partitionBy("range").orderBy(order)
    rows = cut.withColumn("last", F.lead(F.lit(1)).over(inside).isNull()).withColumn("next_id", F.lead("id").over(inside))
    heads = cut.groupBy("range").agg(F.max("id").alias("head"))
    over = Window.orderBy("range")
    heads = heads.withColumn("after", F.lead(F.struct("head")).over(over)).withColumn(
        "first", F.first(F.struct("head")).over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = F.broadcast(heads.select("range", F.coalesce("after", "first")["head"].alias("after_head")))  # one row for each range
    return rows.join(heads, "range").select("id", F.when(F.col("last"), F.col("after_head")).otherwise(F.col("next_id")).alias("next_id"))


def fingerprint_documents(docs: DataFrame, k: int = 5, s: int = 2, size: int = 64) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text ends in the beginning of the next document (descending doc_id, null last,
    then from the first again) in place of its own last third.  A null text is empty.  Where
    an id repeats, each of its rows has the same next document, and of several rows with the
    next id the smallest prefix is taken.  No rows give no rows; other columns are not read."""
    n_ranges = default_ranges(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), blank("text").alias("text"))
    ids = rows.groupBy("doc_id").agg((F.max(F.length("text")) / 3).cast("bigint").alias("need"))
    after = written(ids.join(next_ids(rows), ids["doc_id"].eqNullSafe(F.col("id"))).select(
        id_key("doc_id").alias("key"), id_key("next_id").alias("next_key"), "need"), "next-documents")
    # texts move once: both joins read the same columns of the same exchange
    dealt = rows.withColumn("key", id_key("doc_id")).repartition(n_ranges, "key")
    sent = dealt.withColumnsRenamed({"key": "next_key", "doc_id": "next_id"}).join(after, "next_key")
    sent = sent.select("key", F.struct(F.substring("text", F.lit(1), F.col("need")).alias("prefix"), "next_id").alias("next"))
    sent = sent.repartition(n_ranges, "key").groupBy("key").agg(F.min("next").alias("next"))
    n, taken = F.length("text"), (F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - taken), F.substring("next.prefix", F.lit(1), taken))
    both = dealt.join(sent, "key").select("doc_id", "key", "text", F.length("text").cast("bigint").alias("n_chars"), edited.alias("edited"))
    both = with_anchors(with_anchors(both, "text", "own", k, s), "edited", "other", k, s)
    marked = written(both.select("doc_id", "key", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                                 sketch(F.col("own"), size).alias("own"), sketch(F.col("other"), size).alias("other")), "sketches")
    following = marked.groupBy("key").agg(F.min("own").alias("next_own")).withColumnRenamed("key", "next_key")
    return marked.join(after, "key").join(following, "next_key").select(
        "doc_id", "n_chars", "edited_sha256", sketch_text(F.col("own")).alias("fingerprint"), sketch_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other"), size).alias("near_edited"), likeness(F.col("own"), F.col("next_own"), size).alias("near_next"))
