"""Near-duplicates by 64-bit SimHash and vantage-point trees over Hamming distance.

Only distinct fingerprints are compared.  The upper levels of one tree, built from a bounded
sample, deal them into shards: a fingerprint lives on its side of every ball and also visits,
as a query, each side that could hold one within ``radius`` bits of it.  In a shard a local
tree finds the pairs, pruning by the triangle bound, and the shard reports only a spanning
forest of them, so a dense group gives as many rows as it has members."""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank, keep_rows, written
from .components import connected_components

SAMPLE = 20_000  # fingerprints that shape the upper levels
PER_SHARD, LEAST_SHARDS = 65_536, 64
LEAF = 48


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Bit set where more than half of the shingles' XXH64 have it; 0 without words."""
    import xxhash

    tokens = text.encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII blanks count
    count = max(1, len(tokens) - words + 1) if tokens else 0
    ones = np.zeros(64, dtype="int64")
    digest = xxhash.xxh64_intdigest
    for at in range(0, count, 65_536):
        part = tokens[at:at + 65_536 + words - 1]
        some = [digest(b" ".join(s), seed) for s in zip(*(part[k:] for k in range(words)))] or [digest(b" ".join(part), seed)]
        bits = np.unpackbits(np.array(some, dtype=">u8").view("uint8")).reshape(-1, 64)
        ones += bits.sum(0, dtype="int64")
    return int(sum(1 << (63 - int(k)) for k in np.flatnonzero(2 * ones > count)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(words: int):
    def run(batches):
        for batch in batches:
            found = [_signed(fingerprint(t.as_py(), words)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["doc_id", "sha", "fp"])
    return run


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b)).astype("int16")


def _split(points: np.ndarray, tries: int = 4):
    """(vantage point, radius of the ball) that leaves points on both sides, or None."""
    for k in range(tries):
        vantage = points[(k * 7919) % len(points)]
        far = distance(points, vantage)
        ball = int(np.median(far))
        ball = ball if (far > ball).any() else ball - 1
        if (far <= ball).any() and (far > ball).any():
            return vantage, ball
    return None


def upper_tree(sample: np.ndarray, levels: int):
    """Nested (vantage, ball, inner, outer); None is a shard."""
    cut = _split(sample) if levels and len(sample) > 1 else None
    if cut is None:
        return None
    far = distance(sample, cut[0])
    return int(cut[0]), cut[1], upper_tree(sample[far <= cut[1]], levels - 1), upper_tree(sample[far > cut[1]], levels - 1)


def deal(tree, points: np.ndarray, radius: int):
    """(shard, indexes, home) triples.  A pair that a ball separates meets once: the point
    inside visits the outside."""
    out, number = [], iter(range(1 << 30))

    def walk(node, at, home):
        if node is None:
            out.append((next(number), at, home))
            return
        far = distance(points[at], np.uint64(node[0]))
        inside = far <= node[1]
        walk(node[2], at[(home & inside) | (~home & (far <= node[1] + radius))], home[(home & inside) | (~home & (far <= node[1] + radius))])
        stay, visit = home & ~inside, np.where(home, inside & (far > node[1] - radius), far > node[1] - radius)
        walk(node[3], at[stay | visit], stay[stay | visit])

    walk(tree, np.arange(len(points)), np.ones(len(points), dtype=bool))
    return out


def pairs_within(homes: np.ndarray, queries: np.ndarray, radius: int):
    """Index pairs (home, query) at most ``radius`` bits apart, in portions: a vantage-point
    tree over ``homes``, walked by all queries together."""
    def walk(h, q):
        if not len(h) or not len(q):
            return
        cut = _split(homes[h]) if len(h) > LEAF else None
        if cut is None:  # few points, or points that no ball divides: compare them in blocks
            for at in range(0, len(q), max(1, (1 << 20) // len(h))):
                part = q[at:at + max(1, (1 << 20) // len(h))]
                x, y = np.nonzero(distance(homes[h][:, None], queries[part][None, :]) <= radius)
                if len(x):
                    yield h[x], part[y]
            return
        dh, dq = distance(homes[h], cut[0]), distance(queries[q], cut[0])
        yield from walk(h[dh <= cut[1]], q[dq <= cut[1] + radius])
        yield from walk(h[dh > cut[1]], q[dq > cut[1] - radius])

    yield from walk(np.arange(len(homes)), np.arange(len(queries)))


def _forest(radius: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        fps, home = frame["fp"].to_numpy().view("uint64"), frame["home"].to_numpy()
        where = np.concatenate([np.flatnonzero(home), np.flatnonzero(~home)])
        homes, everyone = fps[home], fps[where]
        parent: dict[int, int] = {}

        def root(x):
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        edges = []
        for a, b in pairs_within(homes, everyone, radius):
            apart = a != b
            for x, y in zip(a[apart].tolist(), b[apart].tolist()):
                rx, ry = root(x), root(y)
                if rx != ry:
                    parent[max(rx, ry)] = min(rx, ry)
                    edges.append((x, y))
        e = np.array(edges, dtype="int64").reshape(-1, 2)
        return pd.DataFrame({"a": everyone[e[:, 0]].view("int64"), "b": everyone[e[:, 1]].view("int64")})
    return run


def _links(fps: DataFrame, radius: int) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all within ``radius`` bits."""
    spark = fps.sparkSession
    n = fps.count()
    levels = max(ceil(log2(LEAST_SHARDS)), ceil(log2(max(1, n) / PER_SHARD)))
    drawn = F.pmod(F.xxhash64(F.lit("tree sample"), F.col("fp")), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / max(1, n)) * (1 << 30)))
    sample = np.sort(np.array([r["fp"] for r in fps.where(drawn).collect()], dtype="int64")).view("uint64")
    shared = spark.sparkContext.broadcast(upper_tree(sample, levels))

    def dealt(batches):
        for batch in batches:
            points = batch.column(0).to_numpy().view("uint64")
            for shard, at, home in deal(shared.value, points, radius):
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, dtype="int32")), pa.array(points[at].view("int64")), pa.array(home)], names=["shard", "fp", "home"])

    return fps.mapInArrow(dealt, "shard int, fp bigint, home boolean").groupBy("shard").applyInPandas(_forest(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id, text_sha256, root.

    A null text is empty; a text without words has fingerprint zero and links like any other.
    component_id is the smallest id reachable over links of at most ``radius`` bits (null ids
    are passed over, and null is the answer only where a component has no other).  Where ids
    are null or repeat, two components may share it; root, the component's smallest fingerprint,
    is its own.  Repeated rows link to each other.  No rows give no rows; other columns are not
    read."""
    text = blank("text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("sha"), text.alias("text"))
    marked = written(rows.mapInArrow(_fingerprints(words), "doc_id bigint, sha string, fp bigint"), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-classes")
    roots = connected_components(_links(classes.select("fp"), radius))
    of = classes.join(roots.withColumnRenamed("a", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = of.join(smallest, "root").select("fp", "component_id", "root")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("sha").alias("text_sha256"), "root")


def drop_near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """One document of each component, the smallest id, with all its columns."""
    found = near_duplicates(docs, words, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha256"))
    kept = found.groupBy("root").agg(first.alias("first")).select("first.doc_id", "first.text_sha256")
    return keep_rows(docs, kept, lambda text: F.sha2(blank(text).cast("binary"), 256))
