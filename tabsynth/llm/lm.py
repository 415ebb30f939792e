"""N-gram language model over all training texts, held in sharded Elias-Fano trie levels.

Texts become blocks of token numbers, each written once as a file of the shared folder, which
the tasks of its block read; only its name moves.  Each block sends its distinct words, with
their training counts, to word shards, which answer with global counts and numbers (the
commonest first, so that most are small); then its distinct n-grams, level by level, to n-gram
shards, which add the counts up, build their trie level, write it to the shared folder, map it,
and answer each block by successor search.  A message has each context with its count once, and
its successors and the places in a trie level as steps.  A context goes to one shard, so that
messages do not grow with the number of shards; only a frequent one, by its count in all of
training, is spread over shards by its successors.  So what moves is aggregated by block, no
shard is much larger than its share of the distinct n-grams, and nothing is broadcast.

P(w | h) = (c(hw) + m P(w | h')) / (c(h) + m), down to the add-half unigram (``base``); a text
starts in the context of an end of text.  The stored, quantised part is c(hw) / (c(h) + m)."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import default_ranges, scratch_path
from .common import blank, fold, written
from .eliasfano import CODE_STEP, TrieLevel, coded

END = b"\n"  # no word holds it
BLOCK_TOKENS, BLOCK_WORDS = 3_000_000, 600_000
SPREAD = 4096  # occurrences from which a context's successors are dealt over the shards
UNSEEN = 65535  # code of an n-gram that is not in training
BLOCK = "block bigint, file string"
MESSAGE = "shard int, block bigint, level int, payload binary"


def packed(*arrays: np.ndarray) -> bytes:
    """Integer arrays, byte plane by byte plane, compressed."""
    import zstandard

    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
        parts.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) + planes)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<2sQ", raw, at)
        kind = np.dtype(kind.decode())
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 10).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += 10 + n * kind.itemsize
    return out


def routed(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): the keys by shard, in their own order within each."""
    mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    shard = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(shards)).astype(np.min_scalar_type(shards))
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def narrow(values: np.ndarray) -> np.ndarray:
    """As 32-bit numbers where they fit."""
    return values.astype(np.int32) if len(values) == 0 or max(abs(int(values.min())), int(values.max())) < 1 << 31 else values


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of a non-decreasing array; ``np.cumsum`` undoes it."""
    return np.diff(values, prepend=values.dtype.type(0))


def shard_keys(context: np.ndarray, word: np.ndarray, count: np.ndarray) -> np.ndarray:
    """What ``routed`` deals the n-grams by: the context, and the word too where the context occurs
    ``SPREAD`` times, so it can have many successors.  The counts are those of all training, so
    every block deals alike."""
    return context * np.uint64(0x9E3779B97F4A7C15) + np.where(count >= SPREAD, word, np.uint64(0))


def grouped(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs in order as (places of the first pair of each context, contexts as steps, their
    numbers of words, words as steps within their context)."""
    heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    words = np.diff(word.astype(np.int64), prepend=0)
    words[heads] = word[heads]
    return heads, steps(context[heads]), np.diff(heads, append=len(context)).astype(np.uint32), narrow(words)


def ungrouped(contexts: np.ndarray, followers: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that ``grouped`` has made steps of."""
    heads, upto = np.cumsum(followers, dtype=np.int64) - followers, np.cumsum(words, dtype=np.int64)
    word = upto - np.repeat(upto[heads] - words[heads], followers)
    return np.repeat(np.cumsum(contexts, dtype=np.uint64), followers), word.astype(np.uint64)


def in_order(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order of pairs, by one number where it holds both."""
    span = int(word.max(initial=0)) + 1
    if (int(context.max(initial=0)) + 1) * span < 1 << 63:
        return np.argsort(context.astype(np.int64) * span + word.astype(np.int64))
    return np.lexsort((word, context))


class _Block:
    """Texts as token numbers in order of first appearance; 0 is the end of a text."""

    def __init__(self):
        self.number, self.ids, self.held, self.parts, self.size = {END: 0}, [], [], [], 0

    def add(self, doc_id, text, held):
        words = text.encode("utf-8", "replace").lower().split()
        number = self.number
        tokens = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.uint32, count=len(words))
        self.parts.append(np.append(tokens, np.uint32(0)))
        self.ids.append(doc_id)
        self.held.append(held)
        self.size += len(words) + 1

    def dump(self) -> bytes:
        import xxhash

        lengths = np.array([len(p) for p in self.parts], dtype=np.uint32)
        tokens = np.concatenate(self.parts)
        train = np.repeat(~np.array(self.held, dtype=bool), lengths)
        counts = np.bincount(tokens[train], minlength=len(self.number)).astype(np.uint32)
        words = np.fromiter(map(xxhash.xxh64_intdigest, self.number), dtype=np.uint64, count=len(self.number))
        none = np.array([i is None for i in self.ids], dtype=np.uint8)
        ids = packed(np.array([i or 0 for i in self.ids], dtype=np.int64), none, np.array(self.held, dtype=np.uint8), lengths)
        parts = packed(words), packed(counts), ids, packed(tokens)
        return struct.pack("<4Q", *map(len, parts)) + b"".join(parts)


def _read_block(uri: str, first: int, last: int) -> list[list[np.ndarray]]:
    """Parts ``first`` up to ``last`` of a block file: words, counts, ids, tokens."""
    system, path = _file(uri)
    with system.open_input_file(path) as f:
        sizes = struct.unpack("<4Q", f.read(32))
        f.seek(32 + sum(sizes[:first]))
        return [unpacked(f.read(n)) for n in sizes[first:last]]


def _blocks(folder: str):
    def run(batches):
        task, made, block = TaskContext.get().partitionId(), 0, _Block()

        def end():
            nonlocal made, block
            number = (task << 32) | made
            uri = f"{folder}/block-{number}-{uuid.uuid4().hex[:8]}"
            system, path = _file(uri)
            with system.open_output_stream(path, compression=None) as f:
                f.write(block.dump())
            made, block = made + 1, _Block()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([uri], pa.string())], names=["block", "file"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for doc_id, text, held in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    block.add(doc_id, text, held)
                    if block.size >= BLOCK_TOKENS or len(block.number) >= BLOCK_WORDS:
                        yield end()
        if block.ids:
            yield end()
    return run


def _send(shards: int, level: int, block: int, keys: np.ndarray, route: tuple, *arrays: np.ndarray):
    order, bounds = route
    sent = [(s, block, level, packed(keys[part], *(a[part] for a in arrays)))
            for s in range(shards) if len(part := order[bounds[s]:bounds[s + 1]])]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    for at in range(0, len(sent), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*sent[at:at + 64]), kinds)], names=["shard", "block", "level", "payload"])


def _send_words(shards: int):
    def run(batches):
        for batch in batches:
            for block, uri in zip(*(c.to_pylist() for c in batch.columns)):
                (words,), (counts,) = _read_block(uri, 0, 2)
                yield from _send(shards, 1, block, words, routed(words, shards), counts)
    return run


def _merge(payloads) -> tuple[list[int], np.ndarray, np.ndarray, list[np.ndarray]]:
    """(sizes, distinct keys, where each sent key is among them, the other arrays joined)."""
    parts = [unpacked(p) for p in payloads]
    joined = [np.concatenate(c) for c in zip(*parts)]
    keys, back = np.unique(joined[0], return_inverse=True)
    return [len(p[0]) for p in parts], keys, back, joined[1:]


def _answer_words():
    """Global count and place in the shard, by falling count (-1: not in training), of every word
    sent; one row more, of level 0, has the shard's tokens and distinct words."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        shard = int(frame["shard"].iloc[0])
        sizes, keys, back, (counts,) = _merge(frame["payload"])
        total = np.bincount(back, weights=counts, minlength=len(keys)).astype(np.int64)
        place = np.empty(len(keys), dtype=np.int64)
        place[np.argsort(-total, kind="stable")] = np.arange(len(keys))
        place[total == 0] = -1
        cuts = np.cumsum(sizes)[:-1]
        answers = [packed(t, i) for t, i in zip(np.split(total[back], cuts), np.split(place[back], cuts))]
        facts = struct.pack("<QQ", int(total.sum()), int((total > 0).sum()))
        return pd.DataFrame({"shard": shard, "block": [*frame["block"], -1], "level": [1] * len(answers) + [0], "payload": [*answers, facts]})
    return run


def _file(uri: str):
    return fs.FileSystem.from_uri("/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri)


def _mapped(uri: str):
    """A level file as a buffer: mapped where the file system is a mounted one, else read."""
    system, path = _file(uri)
    if isinstance(system, fs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with system.open_input_file(path) as f:
        return f.read_buffer()


def _answer_grams(level: int, weight: float, folder: str, last: bool):
    """Build this shard's trie level, write and map it, answer each block from it: of the last
    level the code of every n-gram sent, else its count (0: not in training; the block knows the
    context's, and so the code) and place in the level as steps (that of one not in training says
    nothing)."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        shard = int(frame["shard"].iloc[0])
        asked = []
        context, word, counts, above = [], [], [], []
        for p in frame["payload"]:
            c, followers, a, w, n = unpacked(p)
            (c, w), a = ungrouped(c, followers, w), np.repeat(a, followers)
            asked.append((c, w))
            seen = n > 0
            for whole, part in zip((context, word, counts, above), (c, w, n, a)):
                whole.append(part[seen])
        context, word, counts, above = map(np.concatenate, (context, word, counts, above))
        order = in_order(context, word)
        c, w = context[order], word[order]
        at = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])])) if len(c) else np.zeros(0, dtype=np.int64)
        total = np.add.reduceat(counts[order].astype(np.int64), at) if len(c) else np.zeros(0, dtype=np.int64)
        built = TrieLevel.build(c[at], w[at], total / (above[order][at] + weight))
        del context, word, counts, above, order, c, w
        uri = f"{folder}/level-{level}-{shard:06d}-{uuid.uuid4().hex[:8]}"
        system, path = _file(uri)
        with system.open_output_stream(path, compression=None) as f:
            f.write(built.dump())
        trie, answers = TrieLevel.load(_mapped(uri)), []
        codes, total = np.append(trie.codes, np.uint16(UNSEEN)), np.append(total, 0)
        for c, w in asked:  # in order of context and word, so places rise
            place = trie.find(c, w)
            answers.append(packed(codes[place]) if last else packed(narrow(total[place]), narrow(steps(np.maximum.accumulate(place)))))
        return pd.DataFrame({"shard": shard, "block": frame["block"], "level": level, "payload": answers})
    return run


class _State:
    """What a block knows after the answers so far, position by position, up to the n-grams of
    ``order`` words, whose answers may still be missing."""

    def __init__(self, row, answers: pd.DataFrame, shards: int, order: int, weight: float):
        ((words,),) = _read_block(row["file"], 0, 1)
        (self.ids, self.none, held, self.lengths), (tokens,) = _read_block(row["file"], 2, 4)
        self.shards, self.tokens, self.held = shards, tokens, held.astype(bool)
        self.train = np.repeat(~self.held, self.lengths)
        self.by_level = {int(k): dict(zip(g["shard"], g["payload"])) for k, g in answers.groupby("level")}
        count, number = self._answers(1, words)
        count, number = narrow(count), narrow(number)
        self.word, self.known = number[tokens], count[tokens]
        # the context of each position: the (level - 1)-gram that ends before it
        self.levels = []
        node, node_count = self.word, self.known
        for level in range(2, order + 1):
            before = np.concatenate([number[:1], node[:-1]])
            before_count = np.concatenate([count[:1], node_count[:-1]])
            if level > 2:  # an n-gram does not reach over the beginning of its text
                inner = np.ones(len(tokens), dtype=bool)
                begin = np.cumsum(self.lengths) - self.lengths
                for k in range(level - 2):
                    late = begin + k
                    inner[late[late < len(tokens)]] = False
                before = np.where(inner, before, -1)
            asked = narrow(np.flatnonzero((before >= 0) & (self.word >= 0)))
            context, word, which = self._distinct(before[asked], self.word[asked])
            before_count = narrow(np.where(before < 0, 0, before_count))
            above = np.zeros(len(context), dtype=before_count.dtype)
            above[which] = before_count[asked]
            keys = shard_keys(context, word, above)
            del before
            if level not in self.by_level:  # still to be asked, or nothing was
                self.levels.append((asked, which, context, word, keys, above))
                break
            answer = self._answers(level, keys)
            if level < order:
                c, n = answer
                code = np.full(len(c), UNSEEN, dtype=np.uint16)
                code[c > 0] = coded(c[c > 0] / (above[c > 0] + weight))
            else:
                (code,) = answer
            self.levels.append((asked, which, before_count, code))  # what the scores need
            del context, word, keys, before_count, above
            if level < order:
                node, node_count = np.full(len(tokens), -1, dtype=np.int64), np.zeros(len(tokens), dtype=np.int64)
                node[asked], node_count[asked] = n[which], c[which]

    @staticmethod
    def _distinct(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs in order, and which of them each pair is."""
        span = int(word.max(initial=0)) + 1
        if (int(context.max(initial=0)) + 1) * span < 1 << 63:
            pairs, which = np.unique(context.astype(np.int64) * span + word, return_inverse=True)
            return (pairs // span).astype(np.uint64), (pairs % span).astype(np.uint64), narrow(which)
        by = np.lexsort((word, context))
        c, w = context[by], word[by]
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])])
        which = np.empty(len(by), dtype=np.int64)
        which[by] = np.cumsum(new) - 1
        return c[new].astype(np.uint64), w[new].astype(np.uint64), which

    def _answers(self, level: int, keys: np.ndarray) -> list[np.ndarray]:
        """The shards' answers in the order of ``keys``; places become numbers over all shards."""
        order, bounds = routed(keys, self.shards)
        out: list[np.ndarray] = []
        for s, payload in self.by_level.pop(level).items():
            arrays = unpacked(payload)
            if len(arrays) > 1:
                place = arrays[1] if level == 1 else np.where(arrays[0] > 0, np.cumsum(arrays[1], dtype=np.int64), -1)
                arrays = [arrays[0].astype(np.int64, copy=False), np.where(place >= 0, place * self.shards + s, -1)]
            for k, a in enumerate(arrays):
                if k == len(out):
                    out.append(np.zeros(len(keys), dtype=a.dtype))
                out[k][order[bounds[s]:bounds[s + 1]]] = a
        return out

    def requests(self, block: int, level: int):
        asked, which, context, word, keys, above = self.levels[level - 2]
        counts = np.bincount(which[self.train[asked]], minlength=len(context)).astype(np.uint32)
        order, bounds = routed(keys, self.shards)
        rows = []
        for s in range(self.shards):
            if len(p := order[bounds[s]:bounds[s + 1]]):
                heads, contexts, followers, words = grouped(context[p], word[p])
                rows.append((s, block, level, packed(contexts, followers, above[p[heads]], words, counts[p])))
        return pd.DataFrame(rows, columns=["shard", "block", "level", "payload"])

    def scores(self, total: int, distinct: int, weight: float) -> pd.DataFrame:
        unigram = (self.known + 0.5) / (total + 0.5 * (distinct + 1))
        p = unigram.copy()
        for asked, which, above, code in (x for x in self.levels if len(x) == 4):
            p *= weight / (above + weight)  # an unseen context leaves the shorter one's
            p[asked] += np.where(code < UNSEEN, 10.0 ** (-CODE_STEP * code.astype(float)), 0.0)[which]
        starts = (np.cumsum(self.lengths) - self.lengths).astype(np.int64)
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(self.ids, self.none.astype(bool)), "held_out": self.held, "n_tokens": self.lengths.astype(np.int64),
            "n_known": np.add.reduceat((self.known > 0).astype(np.int64), starts), "train_tokens": total,
            "base_score": np.add.reduceat(np.log10(unigram), starts), "score": np.add.reduceat(np.log10(p), starts)})


def _joined(blocks: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    """``run(block row, its answers)`` for every block."""
    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return run(left.iloc[0], right)
    return blocks.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInPandas(both, schema)


def score_documents(spark: SparkSession, docs: DataFrame, held_fold: int = 1, order: int = 2, weight: float = 50.0) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose fold (see ``fold``) is not ``held_fold`` and scores all.  A null
    text is empty and has one token, the end.  Repeated rows count and are scored each.  Words
    are told apart by 64-bit hashes.  No rows give no rows; other columns are not read."""
    shards = default_ranges(spark)
    folder = scratch_path(spark, "lm-levels")
    system, path = _file(folder)
    if isinstance(system, fs.LocalFileSystem):
        system.create_dir(path, recursive=True)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), blank("text").alias("text"), (fold("doc_id") == held_fold).alias("held"))
    blocks = written(rows.mapInArrow(_blocks(folder), BLOCK), "lm-blocks")
    asked = blocks.mapInArrow(_send_words(shards), MESSAGE)
    answers = written(asked.groupBy("shard").applyInPandas(_answer_words(), MESSAGE), "lm-words")
    facts = [struct.unpack("<QQ", bytes(r["payload"])) for r in answers.where("level = 0").select("payload").collect()]  # one row a shard
    total, distinct = sum(t for t, _ in facts), sum(d for _, d in facts)
    for level in range(2, order + 1):
        def send(row, known, level=level):
            return _State(row, known, shards, level, weight).requests(int(row["block"]), level)
        asked = _joined(blocks, answers, send, MESSAGE)
        answers = answers.unionByName(written(asked.groupBy("shard").applyInPandas(_answer_grams(level, weight, folder, level == order), MESSAGE), f"lm-grams-{level}"))

    def score(row, known):
        return _State(row, known, shards, order, weight).scores(total, distinct, weight)
    return _joined(blocks, answers, score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
