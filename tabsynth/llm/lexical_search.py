"""Ranked lexical search with a document FP-tree and branch-and-bound.

Each document becomes a vector of term frequencies restricted to the terms of the queries.
Vectors are ordered by falling document frequency, so documents that share their frequent
terms share a path of a trie.  Every trie node knows, for its subtree, the largest frequency
of each term and the smallest length factor m; both bound any score below it.  A depth-first
walk visits a subtree for exactly those queries whose bound reaches their current last rank,
and scores the documents of a leaf in full.

Queries go through in blocks of bounded size; each block is one pass over all documents.  A
task holds one chunk of vectors and its tree at a time and gives at most ``top`` rows for each
query, so nothing grows with the corpus but the number of tasks."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blank, written

VECTORS = "doc_id bigint, n bigint, terms array<int>, tfs array<int>"
SCALE, FREQUENCY, LENGTH = 1_000_000_000, 1000, 20  # a term's part of a score: SCALE*tf div (FREQUENCY*tf + LENGTH*m)
RESULT = "item_id bigint, rank int, doc_id bigint, score bigint"

#: bytes of terms as they are (A-Z as a-z), all others as blanks; every byte of a non-ASCII character is from 0x80 on
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all non-ASCII characters, only A-Z
    lower-cased."""
    return text.translate(_TERM_BYTES).split()


def restricted_vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (all its terms with repeats) and the frequencies of those terms that are in
    ``vocabulary`` (numbered by their place), for every document with at least one term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        number = {t: i for i, t in enumerate(shared.value)}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, sizes, starts, terms, tfs = [], [], [0], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    words = terms_of(text.as_py())
                    if not words:
                        continue
                    counts = Counter(words)
                    known = counts.keys() & number.keys()
                    ids.append(doc_id)
                    sizes.append(len(words))
                    terms += [number[t] for t in known]
                    tfs += [counts[t] for t in known]
                    starts.append(len(terms))
                offsets = pa.array(starts, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32()))],
                    names=["doc_id", "n", "terms", "tfs"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), blank("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, VECTORS)


def _common_prefix(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


class Node:
    """Documents ``lo`` to ``hi`` (in trie order), which share a path; ``terms`` and ``tfs``
    are the largest frequencies in the subtree, ``m`` its smallest length factor."""

    __slots__ = ("lo", "hi", "children", "terms", "tfs", "m")

    def __init__(self, lo: int, hi: int):
        self.lo, self.hi, self.children = lo, hi, []


class DocumentTree:
    """A trie over term vectors, given as rows (starts, ranks, tfs) with rank 0 for the most
    frequent term, and m of each document.  Paths without a branch are one node; a node of at
    most ``leaf`` documents, or of documents that all end there, is not split further."""

    def __init__(self, starts: np.ndarray, ranks: np.ndarray, tfs: np.ndarray, m: np.ndarray, width: int, leaf: int = 32):
        owner = np.repeat(np.arange(len(m)), np.diff(starts))
        by_rank = np.lexsort((ranks, owner))
        ranks, tfs = ranks[by_rank], tfs[by_rank]
        keys = ranks.astype(">u4").tobytes()
        order = np.array(sorted(range(len(m)), key=lambda i: keys[4 * starts[i]:4 * starts[i + 1]]), dtype=np.int64)
        sizes = np.diff(starts)[order]
        self.order, self.m = order, m[order]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(starts[:-1][order] - self.starts[:-1], sizes) + np.arange(self.starts[-1])
        self.ranks, self.tfs, self.width = ranks[take], tfs[take], width
        self.nodes = [Node(0, len(m))]
        self._split(leaf)
        self._summarise()

    def _row(self, i: int) -> np.ndarray:
        return self.ranks[self.starts[i]:self.starts[i + 1]]

    def _split(self, leaf: int) -> None:
        for node in self.nodes:  # grows while it is read: children come after their parents
            if node.hi - node.lo <= leaf:
                continue
            first, last = self._row(node.lo), self._row(node.hi - 1)
            depth = _common_prefix(first, last)  # rows are sorted, so all between share it too
            if depth == len(last):
                continue
            at, ends = self.starts[node.lo:node.hi] + depth, self.starts[node.lo + 1:node.hi + 1]
            following = np.where(at < ends, self.ranks[np.minimum(at, len(self.ranks) - 1)], -1)
            cuts = [node.lo, *(np.flatnonzero(np.diff(following)) + node.lo + 1).tolist(), node.hi]
            node.children = [Node(a, b) for a, b in zip(cuts, cuts[1:])]
            self.nodes += node.children

    def _summarise(self) -> None:
        largest = np.zeros(self.width, np.int64)
        for node in reversed(self.nodes):
            if node.children:
                parts = [(c.terms, c.tfs) for c in node.children]
                node.m = min(c.m for c in node.children)
            else:
                a, b = self.starts[node.lo], self.starts[node.hi]
                parts = [(self.ranks[a:b], self.tfs[a:b])]
                node.m = int(self.m[node.lo:node.hi].min())
            for terms, tfs in parts:
                np.maximum.at(largest, terms, tfs)
            node.terms = np.unique(np.concatenate([t for t, _ in parts]))
            node.tfs = largest[node.terms]
            largest[node.terms] = 0


def term_part(tf: np.ndarray, m) -> np.ndarray:
    return (SCALE * tf) // (FREQUENCY * tf + LENGTH * m)


class Ranking:
    """The best ``top`` documents of each query so far, equal scores by ascending id (null
    last), and the score that a further document must reach."""

    def __init__(self, queries: int, top: int):
        self.top, self.best, self.least = top, [[] for _ in range(queries)], np.ones(queries, np.int64)

    def offer(self, query: int, scores: np.ndarray, ids: list) -> None:
        found = self.best[query]
        found += [(-s, i is None, i or 0) for s, i in zip(scores.tolist(), ids)]
        found.sort()
        del found[self.top:]
        if len(found) == self.top:
            self.least[query] = max(1, -found[-1][0])

    def rows(self) -> list:
        return [(q, None if missing else i, -s) for q, found in enumerate(self.best) for s, missing, i in found]


def search(tree: DocumentTree, ids: list, weights: np.ndarray, wanted: np.ndarray, ranking: Ranking, portion: int = 256) -> int:
    """Walk the tree depth first for all queries at once (``wanted``: terms x queries, 0 or 1)
    and return the number of documents scored.  A query follows a child only while the child's
    bound reaches its last rank; equal scores are followed too, since ids decide them."""
    def bounds(node, queries):
        part = term_part(node.tfs, node.m) * weights[node.terms]
        return part @ wanted[np.ix_(node.terms, queries)]

    everything = np.arange(wanted.shape[1])
    stack, scored = [(tree.nodes[0], everything, bounds(tree.nodes[0], everything))], 0
    while stack:
        node, queries, bound = stack.pop()
        follow = bound >= ranking.least[queries]
        if not follow.any():
            continue
        queries = queries[follow]
        if node.children:
            found = [(c, queries, bounds(c, queries)) for c in node.children]
            stack += sorted(found, key=lambda x: int(x[2].sum()))  # the most promising child is walked first
            continue
        for lo in range(node.lo, node.hi, portion):
            hi = min(lo + portion, node.hi)
            starts = tree.starts[lo:hi + 1]
            if starts[-1] == starts[0]:
                continue
            a, b = starts[0], starts[-1]
            ranks, sizes = tree.ranks[a:b], np.diff(starts)
            part = term_part(tree.tfs[a:b], np.repeat(tree.m[lo:hi], sizes)) * weights[ranks]
            filled = np.flatnonzero(sizes)  # documents without any of the terms score 0
            scores = np.add.reduceat(part[:, None] * wanted[np.ix_(ranks, queries)], starts[:-1][filled] - a, axis=0)
            scored += len(filled)
            reach = scores >= ranking.least[queries]
            for j in np.flatnonzero(reach.any(0)):
                rows = np.flatnonzero(reach[:, j])
                ranking.offer(int(queries[j]), scores[rows, j], [ids[tree.order[lo + filled[r]]] for r in rows])
    return scored


def _top_of_partition(weights, items, top, n_docs, n_terms, chunk_docs, chunk_terms):
    """For each partition of vectors: its best documents of every query (item, doc_id, score)."""
    def run(batches):
        rank_of, weight = weights
        wanted = np.zeros((len(weight), len(items)), np.int64)
        for q, terms in enumerate(items):
            wanted[terms, q] = 1
        ranking, held = Ranking(len(items), top), []

        def walk():
            ids = [i for part in held for i in part[0]]
            sizes, flat = np.concatenate([p[1] for p in held]), np.concatenate([p[2] for p in held])
            # Python integers: 50 * n * N may pass 64 bits on very large tables
            m = np.array([50 + 50 * n * n_docs // n_terms for part in held for n in part[4]], np.int64)
            tree = DocumentTree(np.concatenate([[0], np.cumsum(sizes)]), rank_of[flat], np.concatenate([p[3] for p in held]), m, len(weight))
            search(tree, ids, weight, wanted, ranking)
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, chunk_docs):
                part = batch.slice(at, chunk_docs)
                terms, tfs = part.column(2), part.column(3)
                held.append((part.column(0).to_pylist(), terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64),
                             terms.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64), part.column(1).to_pylist()))
                if sum(len(p[0]) for p in held) >= chunk_docs or sum(len(p[2]) for p in held) >= chunk_terms:
                    walk()
        if held:
            walk()
        rows = ranking.rows()
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, [pa.int32(), pa.int64(), pa.int64()])], names=["item", "doc_id", "score"])
    return run


def _best(found: DataFrame, top: int, *by) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _rank_block(spark: SparkSession, docs: DataFrame, queries: list, top: int, chunk_docs: int, chunk_terms: int) -> DataFrame:
    query_terms = [set(terms_of(q["text"].encode())) for q in queries]
    vocabulary = sorted(set().union(*query_terms))
    vectors = written(restricted_vectors(docs, vocabulary), "term-vectors")
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = dict(map(tuple, vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()))  # one row for each query term at most
    if not df:
        return spark.createDataFrame([], RESULT)
    by_frequency = sorted(df, key=lambda t: (-df[t], t))
    rank_of = np.zeros(len(vocabulary), np.int64)
    rank_of[by_frequency] = np.arange(len(by_frequency))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in by_frequency], np.int64)
    number = {t: i for i, t in enumerate(vocabulary)}
    items = [np.array(sorted(int(rank_of[number[t]]) for t in terms if number[t] in df), np.int64) for terms in query_terms]
    run = _top_of_partition((rank_of, weight), items, top, n_docs, n_terms, chunk_docs, chunk_terms)
    found = vectors.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item int, doc_id bigint, score bigint")
    # the rows of many tasks meet in two steps, so that no task takes those of all tasks
    groups = math.isqrt(vectors.rdd.getNumPartitions())
    found = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(max(1, groups))))
    found = _best(_best(found, top, "item", "part"), top, "item")
    names = spark.createDataFrame([(i, q["item_id"]) for i, q in enumerate(queries)], "item int, item_id bigint")
    return found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank_documents(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = 50, block: int = 1000,
                   chunk_docs: int = 32_768, chunk_terms: int = 4_000_000) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item of ``items`` (item_id,
    text) with a score above 0, exactly; equal scores by ascending doc_id, a null id last.

    A null or empty text has no terms: such a document never ranks and is not counted, such an
    item gives no rows, and an empty table gives none.  Repeated rows of ``docs`` rank each for
    themselves; repeated rows of ``items`` are one item, rows that share an id but not the text
    are ranked apart.  About ``block`` items are held at a time; other columns are not read."""
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), blank("text").alias("text")).where("text <> ''").distinct()
    asked = written(asked, "search-items")
    blocks = math.ceil(asked.count() / block)
    out = spark.createDataFrame([], RESULT)
    for b in range(blocks):
        queries = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        if queries:
            found = _rank_block(spark, docs, queries, top, chunk_docs, chunk_terms)
            out = found if blocks == 1 else out.unionByName(found)
    return out
