"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

The encoding of a string ends in exactly one token t such that the rest is encoded on its own
and t does not merge with the token before it.  The transducer therefore reads bytes and keeps,
for every boundary from which a token could still be growing, the place in the token trie, the
last token before the boundary and the tokens not yet sure.  Such a set is one state of the
determinised machine; states and moves are made when first needed.  Tokens on which all
boundaries agree are emitted, which happens after a lookahead bounded by the longest token."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank
from .packing import CHUNK, Recent

CODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
STATES = 200_000  # kept by a worker; beyond, the table starts anew
NEVER = 1 << 60


def read_ranks(text: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, text.splitlines()) if a}


class BpeTransducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {i: t for t, i in ranks.items()}
        self.step: dict[int, int] = {}  # node << 8 | byte: the node below
        self.token, inner = [-1], {0}
        for t, i in ranks.items():
            node = 0
            for b in t:
                inner.add(node)
                nxt = self.step.setdefault(node << 8 | b, len(self.token))
                if nxt == len(self.token):
                    self.token.append(-1)
                node = nxt
            self.token[node] = i
        self.leaf = bytearray(n not in inner for n in range(len(self.token)))
        self.edges: dict[int, tuple | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self):
        start = ((0, -1, ()),)
        self.states, self.numbers = [start], {start: 0}
        self.moves: dict[int, tuple[int, tuple]] = {}  # state << 8 | byte: the next state, the tokens sure by then

    def merged(self, data: bytes, steps: list | None = None) -> list[int]:
        """The defining procedure on a short string: merge the lowest rank, leftmost first.
        ``steps`` receives (rank, first part, last part) of every merge."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while True:
            best = min(((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(NEVER, 0))
            if best[0] == NEVER:
                return [self.ranks[p] for p in parts]
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            if steps is not None:
                steps.append((best[0], parts[0], parts[-1]))

    def _edges(self, token: int):
        """How the first and the last part of the token grow: two lists of (part, rank of the
        merge that ends it).  () if its bytes merge to something else, None if its merges do not
        come in the order of their ranks."""
        got = self.edges.get(token, self)
        if got is not self:
            return got
        data, steps = self.bytes_of[token], []
        if self.merged(data, steps) != [token]:
            got = ()
        elif any(a[0] > b[0] for a, b in zip(steps, steps[1:])):
            got = None
        else:
            got = ([], [])
            for edge, part, at in ((got[0], data[:1], 1), (got[1], data[-1:], 2)):
                for step in steps:
                    if step[at] != part:
                        edge.append((part, step[0]))
                        part = step[at]
                edge.append((part, NEVER))
        self.edges[token] = got
        return got

    def _apart(self, before: int, token: int) -> bool:
        """Whether the bytes of both merge to just these two: no last part of the first ever
        merges with a first part of the second while both are there."""
        left, right = self._edges(before), self._edges(token)
        if not left or not right:
            return self.merged(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
        left, right, i, j, rank = left[1], right[0], 0, 0, self.ranks.get
        while True:
            (a, left_ends), (b, right_ends) = left[i], right[j]
            joint = rank(a + b, NEVER)
            if joint < left_ends and joint <= right_ends and joint < NEVER:
                return False
            if left_ends <= right_ends:
                if left_ends == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _stands(self, before: int, token: int) -> bool:
        """Whether ``token`` can come out of merging, and stays apart from the token before."""
        if self._edges(token) == ():
            return False
        if before < 0:
            return True
        ok = self.pairs.get((before, token))
        if ok is None:
            if len(self.pairs) > 4 * STATES:
                self.pairs.clear()
            ok = self.pairs[before, token] = self._apart(before, token)
        return ok

    def _move(self, number: int, byte: int) -> tuple[int, tuple]:
        live, done, below, token_at, leaf = [], None, self.step.get, self.token, self.leaf
        for node, last, pending in self.states[number]:
            node = below(node << 8 | byte)
            if node is None:
                continue
            if not leaf[node]:
                live.append((node, last, pending))
            if done is None:
                token = token_at[node]
                if token >= 0 and self._stands(last, token):
                    done = (0, token, (*pending, token))
        live.append(done)
        first = live[0][2]
        sure = len(first)
        for _, _, p in live:
            k, most = 0, min(sure, len(p))
            while k < most and p[k] == first[k]:
                k += 1
            sure = k
            if not sure:
                break
        state = tuple([(n, t, p[sure:]) for n, t, p in live] if sure else live)
        target = self.numbers.get(state)
        if target is None:
            target = self.numbers[state] = len(self.states)
            self.states.append(state)
        move = self.moves[number << 8 | byte] = target, first[:sure]
        return move

    def encode_piece(self, piece: bytes) -> list[int]:
        """The tokens of one pre-token; a piece that is itself in the vocabulary is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > STATES:
            self._reset()
        out: list[int] = []
        state, moves = 0, self.moves.get
        for byte in piece:
            state, sure = moves(state << 8 | byte) or self._move(state, byte)
            if sure:
                out += sure
        if piece:
            out += self.states[state][-1][2]  # the boundary at the end of the piece
        return out


class TextEncoder:
    """Whole texts: every match of ``pattern`` goes through the transducer; chunks met before
    are one move."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.machine, self.pattern = BpeTransducer(ranks), regex.compile(pattern)
        self.chunks, self.memo = re.compile(CHUNK), Recent(self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        encode = self.machine.encode_piece
        return array("I", [t for p in self.pattern.findall(chunk) for t in encode(p.encode())]).tobytes()

    def coded(self, text: str) -> bytes:
        """The ids as 32-bit numbers."""
        return b"".join(map(self.memo.__getitem__, self.chunks.findall(text)))

    def encode(self, text: str) -> list[int]:
        return memoryview(self.coded(text)).cast("I").tolist()


def _utf8_moves() -> list[list[int]]:
    """State after each byte; 0: between characters, 1 to 3: so many continuation bytes are
    missing, 4 to 7: the next one is restricted (E0, ED, F0, F4), 8: malformed."""
    moves = [[8] * 256 for _ in range(9)]
    first = {range(0x00, 0x80): 0, range(0xC2, 0xE0): 1, range(0xE0, 0xE1): 4, range(0xE1, 0xED): 2, range(0xED, 0xEE): 5,
             range(0xEE, 0xF0): 2, range(0xF0, 0xF1): 6, range(0xF1, 0xF4): 3, range(0xF4, 0xF5): 7}
    for bytes_, state in first.items():
        for b in bytes_:
            moves[0][b] = state
    for state, low, high, then in ((1, 0x80, 0xC0, 0), (2, 0x80, 0xC0, 1), (3, 0x80, 0xC0, 2), (4, 0xA0, 0xC0, 1),
                                   (5, 0x80, 0xA0, 1), (6, 0x90, 0xC0, 2), (7, 0x80, 0x90, 2)):
        for b in range(low, high):
            moves[state][b] = then
    return moves


class StreamDecoder:
    """Ids in, text out, in any portions: bytes of an unfinished character wait for the rest.
    Malformed bytes become U+FFFD."""

    def __init__(self, vocabulary: dict[int, bytes]):
        self.vocabulary, self.moves, self.waiting = vocabulary, _utf8_moves(), b""

    def feed(self, ids: list[int]) -> str:
        return self.feed_bytes(b"".join(map(self.vocabulary.__getitem__, ids)))

    def feed_bytes(self, data: bytes) -> str:
        data = self.waiting + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):  # only the last three bytes can be unfinished
            if data[cut - back] >= 0xC0:
                state = 0
                for b in data[cut - back:]:
                    state = self.moves[state][b]
                cut -= back if 0 < state < 8 else 0
                break
            if data[cut - back] < 0x80:
                break
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


def _table(values: dict) -> np.ndarray:
    out = np.empty(max(values, default=-1) + 1, object)
    for i, v in values.items():
        out[i] = v
    return out


def _coded(shared, portion: int = 4096):
    def run(batches):
        state = shared.value
        encoder = state.get("encoder") or state.setdefault("encoder", TextEncoder(read_ranks(state["ranks"]), state["pattern"]))
        vocabulary = encoder.machine.bytes_of
        names, tokens = state.get("tables") or state.setdefault("tables", (_table({i: str(i) for i in vocabulary}), _table(vocabulary)))
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids, decoded, stream = np.frombuffer(encoder.coded(text), np.uint32), hashlib.sha256(), StreamDecoder(vocabulary)
                    for i in range(0, len(ids), portion):
                        decoded.update(stream.feed_bytes(b"".join(tokens[ids[i:i + portion]].tolist())).encode())
                    decoded.update(stream.close().encode())
                    rows.append((doc_id, len(ids), hashlib.sha256(",".join(names[ids].tolist()).encode()).hexdigest(), decoded.hexdigest()))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _share(spark: SparkSession, ranks_file: str, pattern: str):
    with open(ranks_file, "rb") as f:  # a vocabulary file of fixed size
        return spark.sparkContext.broadcast({"ranks": f.read(), "pattern": pattern})


def encode_texts(spark: SparkSession, docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every text; a null text gives an empty array."""
    shared = _share(spark, ranks_file, pattern)

    def run(batches):
        state = shared.value
        encoder = state.get("encoder") or state.setdefault("encoder", TextEncoder(read_ranks(state["ranks"]), state["pattern"]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encoder.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), blank("text").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_ids(spark: SparkSession, coded: DataFrame, ranks_file: str, portion: int = 4096) -> DataFrame:
    """doc_id and text of every ``ids`` array, decoded as a stream; null ids give an empty text."""
    shared = _share(spark, ranks_file, "")

    def run(batches):
        state = shared.value
        vocabulary = state.get("vocabulary") or state.setdefault("vocabulary", {i: t for t, i in read_ranks(state["ranks"]).items()})
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, texts = batch.slice(at, 256), []
                for ids in part.column(1).to_pylist():
                    stream = StreamDecoder(vocabulary)
                    texts.append("".join([*(stream.feed(ids[i:i + portion]) for i in range(0, len(ids or ()), portion)), stream.close()]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")


def code_digests(spark: SparkSession, docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """Encode every text, decode the ids again: doc_id, n_tokens, ids_sha256, decoded_sha256.
    A null text is empty; repeated rows give repeated rows; other columns are not read."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), blank("text").alias("text"))
    return rows.mapInArrow(_coded(_share(spark, ranks_file, pattern)), CODED)
