"""Best-fit packing of token pieces into fixed-length sequences.

Texts are tokenised in Arrow batches; only piece sizes and digests go on.  Pieces are dealt
evenly by key, and each task packs its share online with a fixed number of open bins: a bitset
keyed by free space gives the tightest bin that still fits in a few integer operations, and
when too many bins are open the fullest one closes.  Pieces arrive longest first."""

from __future__ import annotations

import re
import zlib
from array import array
from itertools import chain
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank, written

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = f"{PIECES}, sequence_id bigint, offset bigint"

# White space, letters and punctuation whose class every library agrees on.
BLANKS = " \\t\\n\\x0b\\x0c\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = r"!-&(-/:-@\[-`{-~"
#: Cuts a text only where the byte-level pre-tokenisers cut too, so chunks encode on their own.
CHUNK = (rf" ?[{LETTERS}]+(?=[ \n{MARKS}]|\Z)| ?[{MARKS}]+(?=[ \n{LETTERS}]|\Z)"
         rf"| ?[^{BLANKS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
MEMO = 400_000  # chunks of one generation; a worker remembers two


class Recent(dict):
    """Values by key, made when first asked for.  A full generation becomes the old one and the
    old one goes, but for keys asked for again, so what is frequent stays and memory is bounded."""

    def __init__(self, make, size: int = MEMO):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key, value):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value


class ChunkEncoder:
    """Whole texts to little-endian 32-bit ids; chunks seen before are looked up."""

    def __init__(self, definition: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks, self.memo = re.compile(CHUNK), Recent(self._whole)

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [None if any(s in t for s in self.special) else self.chunks.findall(t) for t in texts]
        coded = dict.fromkeys(chain.from_iterable(p for p in parts if p))  # one look at the memo for a chunk
        known = self.memo.get
        for c in coded:
            coded[c] = known(c)
        for c in [c for c, ids in coded.items() if ids is None]:
            ids = coded[c] = self.memo.old.pop(c, None)
            if ids is not None:
                self.memo.keep(c, ids)
        fresh = [c for c, ids in coded.items() if ids is None]
        for i in range(0, len(fresh), 1024):
            some = fresh[i:i + 1024]
            for c, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                coded[c] = array("I", e.ids).tobytes()
                self.memo.keep(c, coded[c])
        get = coded.__getitem__
        return [self._whole(t) if p is None else b"".join(map(get, p)) for t, p in zip(texts, parts)]

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def _pieces(shared, limit: int, end: int):
    def run(batches):
        state = shared.value
        encoder = state.get("encoder") or state.setdefault("encoder", ChunkEncoder(state["definition"]))
        tail = array("I", [end]).tobytes()
        for batch in batches:
            rows: list[tuple] = []
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                some = texts.slice(at, 256).to_pylist()
                for doc_id, coded in zip(ids[at:at + 256], encoder.encode(some)):
                    coded += tail
                    n = len(coded) // 4
                    first = n if n <= limit else n % limit or limit
                    starts = [0, *range(first, n, limit)]
                    rows.extend((doc_id, k, s, e - s, zlib.crc32(coded[4 * s:4 * e]))
                                for k, (s, e) in enumerate(zip(starts, [*starts[1:], n])))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def token_pieces(spark: SparkSession, docs: DataFrame, tokenizer_file: str, limit: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and ``end_id``, cut from the
    end into ``limit`` tokens where there are more.  A null text is empty (one piece, the end)."""
    with open(tokenizer_file, encoding="utf-8") as f:  # a vocabulary file of fixed size
        shared = spark.sparkContext.broadcast({"definition": f.read()})
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), blank("text").alias("text"))
    return rows.mapInArrow(_pieces(shared, limit, end_id), PIECES)


class BestFit:
    """Online best fit with at most ``open_bins`` open bins of ``capacity``."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.filled, self.by_free = 0, [[] for _ in range(capacity + 1)]  # bit f: a bin with f free
        self.open, self.bins = 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to ``capacity``."""
        fits = self.filled >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open >= self.open_bins:
                self._take((self.filled & -self.filled).bit_length() - 1)  # the fullest closes
            free, bin_, self.bins = self.capacity, self.bins, self.bins + 1
        left = free - length
        if left:
            self.by_free[left].append(bin_)
            self.filled |= 1 << left
            self.open += 1
        return bin_, self.capacity - free

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_ = stack.pop()
        if not stack:
            self.filled &= ~(1 << free)
        self.open -= 1
        return bin_


def _pack(limit: int, open_bins: int):
    def run(frames):
        fit, base = BestFit(limit, open_bins), TaskContext.get().partitionId() << 33
        for frame in frames:
            placed = np.array([fit.place(n) for n in frame["length"].tolist()], dtype="int64").reshape(-1, 2)
            yield frame.assign(sequence_id=placed[:, 0] + base, offset=placed[:, 1])
    return run


def pack_pieces(pieces: DataFrame, limit: int = 2048, open_bins: int = 8192, pieces_per_task: int = 16384) -> DataFrame:
    """Add sequence_id and offset.  The deal by (doc_id, piece) and the order in a task are
    fixed by the rows, so a task that runs again gives the same places."""
    tasks = max(1, ceil(pieces.count() / pieces_per_task))
    dealt = pieces.repartition(tasks, "doc_id", "piece")
    dealt = dealt.sortWithinPartitions(F.col("length").desc(), "doc_id", "piece", "start", "ids_crc32")
    return dealt.mapInPandas(_pack(limit, open_bins), PACKED)


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_file: str, limit: int = 2048, end_id: int = 0,
                   open_bins: int = 8192, pieces_per_task: int = 16384) -> DataFrame:
    """One row per piece with its place.  Rows with equal or null ids are packed each on its
    own; no rows give no rows; other columns are not read."""
    pieces = written(token_pieces(spark, docs, tokenizer_file, limit, end_id), "pieces")
    return pack_pieces(pieces, limit, open_bins, pieces_per_task)
