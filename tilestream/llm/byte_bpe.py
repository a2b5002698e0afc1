"""Byte-level BPE: merges compiled into a lazily determinised finite-state transducer, and streaming decoding.

A token sequence is the encoding of its bytes exactly if merging the bytes of each two neighbours gives those two tokens back. So the
encodings of all strings are the paths of a nondeterministic transducer whose states are (last token, place in the trie of tokens). Each
prefix has one complete path; the other paths wait inside a token, for at most the longest token's length. Determinising it as the input
comes, with the tokens on which all living paths agree as output, gives a transducer that emits after bounded lookahead.
"""

from __future__ import annotations

import base64
import gc
import functools
import hashlib
import re
import sys
import threading
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilestream.llm.common import bounded_batches, give_back

#: Unicode's White_Space, as \s of the pre-tokenizer's pattern has it.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Transducer:
    """Encodes byte strings by ranks. States and arcs are made when first needed. Beyond a number of states new ones serve once and aren't
    kept, since those that recur are met early; all are dropped together when too many had to pass."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 80_000):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.most_states = most_states
        self.child: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                to = self.child[node].get(byte)
                if to is None:
                    to = self.child[node][byte] = len(self.child)
                    self.child.append({})
                    self.ends.append(-1)
                node = to
            self.ends[node] = i
        self._proper: dict[int, bool] = {}
        self._joined: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        for state in getattr(self, "states", {}).values():
            state.clear()  # states lead to each other
        # a state is the dictionary of its arcs, byte -> (state, tokens); -1 leads to the paths that live in it
        self.states: dict[tuple, dict] = {}
        self.passed = 0
        start = ((-1, 0, ()),)
        self.start = self.states[start] = {-1: start}

    def merged(self, data: bytes) -> list[int]:
        """The encoding by merging, lowest rank first and leftmost among equals; for the short strings of the pair test."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def proper(self, u: int) -> bool:
        """Some tokens never come from merges; they are met only as whole pieces."""
        if u not in self._proper:
            self._proper[u] = self.merged(self.tokens[u]) == [u]
        return self._proper[u]

    def joined(self, t: int, u: int) -> bool:
        """Whether token u may follow token t."""
        if t < 0:
            return True
        pair = t << 32 | u
        found = self._joined.get(pair)
        if found is None:
            if len(self._joined) > 400_000:
                self._joined.clear()
            found = self._joined[pair] = self.merged(self.tokens[t] + self.tokens[u]) == [t, u]
        return found

    def _arc(self, state: dict, byte: int) -> tuple[dict, tuple[int, ...]]:
        after = []
        for last, node, waiting in state[-1]:
            to = self.child[node].get(byte)
            if to is None:
                continue
            u = self.ends[to]
            if u >= 0 and self.proper(u) and self.joined(last, u):
                after.append((u, 0, (*waiting, u)))
            if self.child[to]:
                after.append((last, to, waiting))
        agreed = 0
        shortest = min(len(w) for _, _, w in after)
        while agreed < shortest and len({w[agreed] for _, _, w in after}) == 1:
            agreed += 1
        key = tuple(sorted((t, n, w[agreed:]) for t, n, w in after))
        made = self.states.get(key), after[0][2][:agreed]
        if made[0] is None:
            made = {-1: key}, made[1]
            if len(self.states) >= self.most_states:
                self.passed += 1
                return made
            self.states[key] = made[0]
        state[byte] = made
        return made

    def encode(self, data: bytes) -> list[int]:
        if self.passed > 20 * self.most_states:
            self._reset()
        out: list[int] = []
        state = self.start
        for byte in data:
            state, tokens = state.get(byte) or self._arc(state, byte)
            if tokens:
                out += tokens
        for _, node, waiting in state[-1]:
            if node == 0:
                out += waiting
        return out


class Encoder(dict):
    """Whole texts to ids. Pieces are found within runs of (white space, other characters), which cannot influence each other; the ids
    of short runs are kept, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_runs: int = 250_000):
        super().__init__()
        self.transducer = Transducer(ranks)
        self.ranks = ranks
        self.most_runs = most_runs
        self.older: dict[str, bytes] = {}
        assert sys.byteorder == "little" and array("I").itemsize == 4
        self.piece = regex.compile(pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]"))
        self.runs = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
        self.words = {i: t for t, i in ranks.items()}

    def __missing__(self, run: str) -> bytes:
        if (out := self.older.get(run)) is not None:
            return out
        pieces = self.piece.findall(run)
        if len(pieces) > 1:
            # a piece is a run of its own, and often known as one
            out = b"".join(map(self._piece, pieces))
        else:
            data = run.encode()
            whole = self.ranks.get(data)
            out = array("I", self.transducer.encode(data) if whole is None else (whole,)).tobytes()
        if len(run) <= 48:
            if len(self) >= self.most_runs:
                self.older = dict(self)
                self.clear()
            self[run] = out
        return out

    def _piece(self, piece: str) -> bytes:
        if (out := self.get(piece)) is None and (out := self.older.get(piece)) is None:
            data = piece.encode()
            whole = self.ranks.get(data)
            out = array("I", self.transducer.encode(data) if whole is None else (whole,)).tobytes()
        return out

    def release(self) -> None:
        """Drops what is kept and gives its memory back."""
        self.clear()
        self.older = {}
        self.transducer._reset()
        self.transducer._joined.clear()
        gc.collect()
        give_back()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.runs.findall(text)))


class Utf8Stream:
    """Incremental UTF-8: feed() gives the text that is complete so far and keeps the bytes of an unfinished code point.

    The state is how many continuation bytes are missing. Malformed bytes become U+FFFD; finish() tells what is left over.
    """

    def __init__(self):
        self.rest = b""

    @staticmethod
    def missing(tail: bytes) -> int:
        """How many of the last bytes (3 at most) begin a code point that isn't finished."""
        for back in range(1, min(3, len(tail)) + 1):
            byte = tail[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                size = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4 if byte < 0xF8 else 1
                return back if size > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        n = self.missing(data)
        self.rest = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.rest = self.rest.decode("utf-8", "replace"), b""
        return out


def decode(ids: bytes, words: dict[int, bytes], step: int = 65536):
    """Text of the ids, piece by piece."""
    stream = Utf8Stream()
    numbers = np.frombuffer(ids, "<u4").tolist()
    for a in range(0, len(numbers), step):
        yield stream.feed(b"".join(map(words.__getitem__, numbers[a : a + step])))
    if stream.rest:
        yield stream.finish()


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker. path: of a file that each executor has; else one sent with SparkContext.addFile, by its name."""
    try:
        data = open(path, "rb").read()
    except FileNotFoundError:
        data = open(SparkFiles.get(path.rsplit("/", 1)[-1]), "rb").read()
    return Encoder(load_ranks(data), pattern)


#: Seconds after which an idle worker drops its tables, since workers outlive their stage.
IDLE_S = 2.0


class Idle:
    """Releases an encoder's tables after a while without a task. Both sides change `busy` under one lock, so a release never overlaps a task."""

    def __init__(self):
        self.lock, self.busy, self.timer = threading.Lock(), False, None

    def begin(self) -> None:
        with self.lock:
            self.busy = True
            if self.timer is not None:
                self.timer.cancel()

    def end(self, e: Encoder) -> None:
        with self.lock:
            self.busy = False
            self.timer = threading.Timer(IDLE_S, self.release, (e,))
            self.timer.daemon = True
            self.timer.start()

    def release(self, e: Encoder) -> None:
        with self.lock:
            if not self.busy:
                e.release()


@functools.cache
def idle() -> Idle:
    """One for each Python worker."""
    return Idle()


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, as little-endian unsigned 32-bit integers) of every row.

    Null text is empty: no tokens, digests of nothing. Rows with a null or repeated doc_id are rows like others; other columns aren't read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches):
        idle().begin()
        e = encoder(path, pattern)
        gc.disable()  # the tables are large, and what is dropped is cleared
        try:
            for b in (whole.slice(a, 512) for whole in batches for a in range(0, max(1, whole.num_rows), 512)):
                yield encoded(e, b)
        finally:
            gc.enable()
            idle().end(e)

    def encoded(e, b):
        out: list[list] = [[], [], [], []]
        for text in b.column(1):
            ids = e.encode(text.as_py())
            back = hashlib.sha256()
            for part in decode(ids, e.words):
                back.update(part.encode())
            for to, x in zip(out, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), back.hexdigest(), ids if keep_ids else None), strict=True):
                to.append(x)
        cols = [b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        return pa.RecordBatch.from_arrays(cols + [pa.array(out[3], pa.binary())] * keep_ids, names=names + ["ids"] * keep_ids)

    return rows.mapInArrow(run, schema)
