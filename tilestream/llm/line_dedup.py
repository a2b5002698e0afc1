"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

LineTables holds which documents have each line key, as written tables of changes: an insert adds rows, a delete takes them back. The
reference counts of frequent keys follow from them exactly. Each shard of keys has a cuckoo filter of its frequent keys, which inserts and
deletes keep up to date; a document whose lines all miss the filters needs no look at the exact table. After a delete all is as if the
documents had never come.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilestream.llm.common import FILTER_BYTES, give_back, groups, id_text, mixed, real_id, shard_of, shards_for, written

SPACE = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
CONTINUED = re.compile(rb"[\x80-\xBF]")


def line_key(line: bytes) -> bytes:
    """The line without white space at both ends, A-Z lower-cased."""
    return line.strip(SPACE).translate(LOWER)


def code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key) - len(CONTINUED.findall(key))


def long_key(line: bytes, least: int) -> bytes | None:
    key = line_key(line)
    return key if len(key) >= least and code_points(key) >= least else None


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; supports insert, delete and membership of 64-bit digests. It doubles when full."""

    SLOTS, KICKS = 4, 200

    def __init__(self, expected: int = 64):
        self.n = 1 << max(2, int(np.ceil(np.log2(max(1, expected) / (0.84 * self.SLOTS) + 1))))
        self.table = np.zeros((self.n, self.SLOTS), np.uint16)

    def _where(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mixed(k)
        print_ = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        one = h & np.uint64(self.n - 1)
        return print_, one, self._other(one, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ (mixed(print_.astype(np.uint64)) & np.uint64(self.n - 1))

    def insert(self, k: int) -> bool:
        """False: it found no place; the caller builds a larger filter from its exact table."""
        p, a, b = (x[0] for x in self._where(np.array([k], np.uint64)))
        for bucket in (int(a), int(b)):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = p
                return True
        bucket = int(a)
        moved = []
        for i in range(self.KICKS):
            slot = i % self.SLOTS
            p, self.table[bucket, slot] = self.table[bucket, slot], p
            moved.append((bucket, slot))
            bucket = int(self._other(np.array([bucket], np.uint64), np.array([p], np.uint16))[0])
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = p
                return True
        for bucket, slot in reversed(moved):
            p, self.table[bucket, slot] = self.table[bucket, slot], p
        return False

    def delete(self, k: int) -> bool:
        p, a, b = (x[0] for x in self._where(np.array([k], np.uint64)))
        for bucket in (int(a), int(b)):
            held = np.flatnonzero(self.table[bucket] == p)
            if len(held):
                self.table[bucket, held[0]] = 0
                return True
        return False

    def contains(self, k: np.ndarray) -> np.ndarray:
        p, a, b = self._where(np.asarray(k, np.uint64))
        return (self.table[a.astype(np.int64)] == p[:, None]).any(1) | (self.table[b.astype(np.int64)] == p[:, None]).any(1)

    @classmethod
    def read(cls, data: bytes) -> CuckooFilter:
        made = cls(1)
        made.table = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy()
        made.n = len(made.table)
        return made

    @classmethod
    def of(cls, keys: Iterable[int], expected: int) -> CuckooFilter:
        keys = list(keys)
        while True:
            made = cls(expected)
            if all(made.insert(k) for k in keys):
                return made
            expected *= 2


def _digests(text: bytes, least: int) -> list[tuple[int, bytes | None]]:
    """For each line: its place and the digest of its key, if the key is long enough."""
    return [(i, xxhash.xxh3_128_digest(k)) for i, line in enumerate(text.split(b"\n")) if (k := long_key(line, least)) is not None]


def _pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


HELD = "did long, k1 long, k2 long"
FILTERS = "shard int, filter binary, failed boolean"


def held_keys(texts: DataFrame, min_chars: int, passes=None) -> DataFrame:
    """did, k1, k2: the digests of the distinct long keys of each row; only those that passes (k1 to a mask) lets through."""

    def emit(batches):
        for ids, group in groups(batches):
            own, found = [], []
            for i, t in enumerate(group):
                d = {x for _, x in _digests(t, min_chars)}
                found += d
                own += [i] * len(d)
            k, own = _pairs(found), np.array(own, np.int64)
            if passes is not None and len(k):
                hit = passes(k[:, 0])
                k, own = k[hit], own[hit]
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(k[:, 0].copy().view(np.int64)), pa.array(k[:, 1].copy().view(np.int64))], names=["did", "k1", "k2"])

    return texts.mapInArrow(emit, HELD)


class LineTables:
    """Line dedup for increments, in written tables: batches of documents are inserted and deleted, in any order.

    changes: did, k1, k2, n: a row of n = 1 for each key of an inserted row and of n = -1 for each key of a deleted one.
    frequent: k1, k2, refs, last: exactly those keys that at least min_docs rows hold, and the largest id among them.
    filters: shard, filter: the cuckoo filter of the frequent keys of each shard that has any.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 5, min_chars: int = 40, shards: int = 16):
        self.min_docs, self.min_chars, self.shards = min_docs, min_chars, shards
        none = lambda schema: spark.createDataFrame([], schema)
        self.changes, self.deleted = none("did long, k1 long, k2 long, n int"), False
        self.frequent = none("k1 long, k2 long, refs long, last long")
        self.filters = none(FILTERS).drop("failed")
        self.empty = True

    def insert(self, docs: DataFrame) -> None:
        """Rows of docs count from now on. Null text is one empty line; a null doc_id is the smallest."""
        self._change(id_text(docs), 1)

    def delete(self, docs: DataFrame) -> None:
        """Rows of docs, inserted before with the same ids and texts, count no more."""
        self.deleted = True
        self._change(id_text(docs), -1)

    def _change(self, texts: DataFrame, n: int) -> None:
        batch = written(held_keys(texts, self.min_chars).withColumn("n", F.lit(n)), "line-changes")
        self.changes = batch if self.empty else self.changes.unionByName(batch)
        rows, touched, before = self.changes, None, self.frequent
        if not self.empty:  # only the batch's keys can have new counts
            touched = batch.select("k1", "k2").distinct()
            rows = rows.join(touched, ["k1", "k2"], "left_semi")
        self.empty = False
        if self.deleted:
            rows = rows.groupBy("k1", "k2", "did").agg(F.sum("n").alias("n")).where("n > 0")
        now = rows.groupBy("k1", "k2").agg(F.sum("n").alias("refs"), F.max("did").alias("last")).where(F.col("refs") >= self.min_docs)
        self.frequent = written(now if touched is None else now.unionByName(before.join(touched, ["k1", "k2"], "left_anti")), "line-refs")
        old, new = before.select("k1", "k2", F.lit(True).alias("was")), self.frequent.select("k1", "k2", F.lit(True).alias("is"))
        turned = old.join(new, ["k1", "k2"], "full").where("was IS NULL OR is IS NULL").select("k1", F.when(F.col("was").isNull(), 1).otherwise(-1).alias("change"))
        self._maintain(turned)

    def _shard(self):
        return F.expr(f"cast(shiftrightunsigned(k1, 33) % {self.shards} AS int)").alias("shard")

    def _maintain(self, turned: DataFrame) -> None:
        """Inserts and deletes keys in the filters of their shards; a filter that overflows is made anew from the exact table, larger."""

        def run(batches, fresh: bool):
            shard, keys, own = None, [], None

            def done():
                made, failed = own or CuckooFilter(len(keys)), False
                if fresh:
                    made = CuckooFilter.of([k for k, _ in keys], 2 * len(keys))
                else:
                    for k, change in sorted(keys, key=lambda x: x[1]):  # deletes make room first
                        if change < 0:
                            made.delete(k)
                        elif not made.insert(k):
                            failed = True
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([made.table.tobytes()], pa.binary()), pa.array([failed])], names=["shard", "filter", "failed"])

            for b in batches:
                for s, table, k, change in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if s != shard:
                        if shard is not None:
                            yield done()
                        shard, keys, own = s, [], None
                    if table is not None:
                        own = CuckooFilter.read(table)
                    else:
                        keys.append((k & 0xFFFFFFFFFFFFFFFF, change))
            if shard is not None:
                yield done()

        def made(rows, fresh):
            dealt = rows.repartition(self.shards, "shard").sortWithinPartitions("shard", F.col("filter").isNull())
            return dealt.select("shard", "filter", "k1", "change").mapInArrow(lambda b: run(b, fresh), FILTERS)

        rows = turned.select(self._shard(), F.lit(None).cast("binary").alias("filter"), "k1", "change")
        rows = rows.unionByName(self.filters.select("shard", "filter", F.lit(0).cast("long").alias("k1"), F.lit(0).alias("change")))
        now = written(made(rows, False), "line-filters")
        bad = now.where("failed").select("shard")
        if not bad.isEmpty():
            again = self.frequent.select(self._shard(), F.lit(None).cast("binary").alias("filter"), "k1", F.lit(1).alias("change"))
            now = written(now.where("NOT failed").unionByName(made(again.join(bad, "shard", "left_semi"), True)), "line-filters")
        self.filters = now.select("shard", "filter")

    def dropped(self, docs: DataFrame) -> DataFrame:
        """did, drops: the 128-bit digests of the keys that each of the rows loses (k1 and k2, little-endian). Rows that lose none have none.

        Filters are broadcast if they fit FILTER_BYTES; else every key goes to the exact join.
        """
        size = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        passes = None
        if size <= FILTER_BYTES:
            shards = self.shards
            own = docs.sparkSession.sparkContext.broadcast({r.shard: bytes(r.filter) for r in self.filters.toLocalIterator()})

            def passes(k1):
                hit, shard = np.zeros(len(k1), bool), shard_of(k1, shards)
                for s in np.unique(shard):
                    if (table := own.value.get(int(s))) is not None:
                        at = np.flatnonzero(shard == s)
                        hit[at] = CuckooFilter.read(table).contains(k1[at])
                return hit

        lost = held_keys(id_text(docs), self.min_chars, passes).join(self.frequent.select("k1", "k2", "last"), ["k1", "k2"]).where("did < last")
        return lost.groupBy("did").agg(F.collect_set(F.struct("k1", "k2")).alias("drops"))

    def report(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_sha256 of rows that are inserted now."""
        joined = id_text(docs).join(self.dropped(docs), "did", "left")
        least = self.min_chars
        return joined.mapInArrow(lambda b: _cut(b, least, False), "did long, n_lines long, n_dropped long, kept_sha256 string").select(real_id().alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")


def _cut(batches, min_chars: int, with_text: bool):
    for b in batches:
        names = b.schema.names
        out: dict[str, list] = {"n_lines": [], "n_dropped": [], "kept_sha256": [], "kept": []}
        for text, drops in zip(b.column(names.index("text")), b.column(names.index("drops")), strict=True):
            text = (text.as_py() or "").encode()
            lines = text.split(b"\n")
            gone: set[int] = set()
            if drops.is_valid:
                lost = {(d["k1"] & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little") + (d["k2"] & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little") for d in drops.as_py()}
                gone = {i for i, d in _digests(text, min_chars) if d in lost}
            kept = b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text
            out["n_lines"].append(len(lines))
            out["n_dropped"].append(len(gone))
            if with_text:
                out["kept"].append(kept.decode())
            else:
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        if with_text:
            cols = {n: b.column(i) for i, n in enumerate(names) if n not in ("text", "drops")} | {"kept": pa.array(out["kept"], pa.string())}
        else:
            cols = {"did": b.column(names.index("did")), "n_lines": pa.array(out["n_lines"], pa.int64()), "n_dropped": pa.array(out["n_dropped"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string())}
        yield pa.RecordBatch.from_pydict(cols)
    give_back()


def line_dedup_report(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, again: int = 32) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of documents.

    All are inserted; then one part of `again`, by hash of the id, is deleted and inserted anew, as an increment of revised documents
    would be, which leaves everything as it was. again = 0: only the first insert.

    Null or empty text is one empty line. A null doc_id counts as the smallest. Rows that repeat a doc_id count as documents of their own
    and all hold the largest id together. An empty table gives an empty result; other columns are not read.
    """
    tables = LineTables(docs.sparkSession, min_docs, min_chars, shards_for(docs, 8))
    tables.insert(docs)
    if again:
        part = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("again")), F.lit(again)) == 0)
        tables.delete(part)
        tables.insert(part)
    return tables.report(docs)


def line_dedup(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """docs with the repeated lines gone from text (and n_chars set anew where it exists); columns and rows stay otherwise.

    A text that loses no line is returned as it is, null included.
    """
    tables = LineTables(docs.sparkSession, min_docs, min_chars, shards_for(docs, 8))
    tables.insert(docs)
    own = docs.select(F.struct("*").alias("__row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("did"))
    joined = own.join(tables.dropped(docs), "did", "left").select("__row", F.col("__row.text").alias("text"), "drops")
    kind = own.schema["__row"].dataType.simpleString()
    same = joined.where("drops is null").select("__row.*")
    cut = joined.where("drops is not null").mapInArrow(lambda b: _cut(b, min_chars, True), f"__row {kind}, kept string")
    row = F.col("__row").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("kept").cast(docs.schema["n_chars"].dataType))
    return same.unionByName(cut.select(row.alias("__row")).select("__row.*"))
