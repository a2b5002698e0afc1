"""Suffix-array dedup: bytes covered by strings of 50 bytes that an earlier document has too.

Minimizers choose an anchor within every 50-byte window, by the window's content alone, so equal windows have equal anchors. Anchors that
two documents share are counted first. The windows around shared anchors are dealt by anchor; each shard sorts the suffixes that start
there by their first 50 bytes, in runs that go to disk and are merged by a priority queue. Orders aren't induced recursively.
"""

from __future__ import annotations

import heapq
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilestream.llm.common import groups, id_text, key_counts, key_filter, mixed, narrowed, real_id, shard_of, shards_for
from tilestream.llm.substring_dedup import cut_report, row_key

GRAM = 24
#: A group's places must fit into so many bits.
PLACE = 31
GROUP = 2 << 20
#: A table of the first documents of exact copies is broadcast up to so many rows (of some 100 bytes); beyond it copies are treated like others.
COPIES = 300_000
#: Suffixes in a run that is sorted in memory.
RUN = 1_500_000


def anchors(texts: list[bytes], length: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts and, for each stretch of windows that have one anchor: document, first start, number of starts, the
    anchor's place from the first start, its digest."""
    gap = bytes(8)
    joined = gap.join([*texts, b""]) + bytes(length)
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(np.concatenate(([0], lengths[:-1] + len(gap)))) if len(texts) else lengths
    x = np.frombuffer(joined, np.uint8).astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] << np.uint64(8 * width) | x[width:]
    n = len(x) - 16
    h = x[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += x[8 : n + 8]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h += x[16 : n + 16]
    del x
    h = mixed(h)
    best = h & np.uint64((1 << 64) - (1 << PLACE)) | np.arange(n, dtype=np.uint64)
    reach, width = length - GRAM + 1, 1
    while 2 * width <= reach:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < reach:
        best = np.minimum(best[: len(best) - (reach - width)], best[reach - width :])
    place = (best & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    del best
    counts = np.maximum(lengths - length + 1, 0)
    full = np.flatnonzero(counts)
    if not len(full):
        none = np.zeros(0, np.int64)
        return joined, none, none, none, none, none.astype(np.uint64)
    # starts of all windows within documents, without a list of all places
    valid = np.zeros(len(place) + 1, np.int8)
    valid[begins[full]] = 1
    np.subtract.at(valid, begins[full] + counts[full], 1)
    inside = np.cumsum(valid[:-1], dtype=np.int8).view(bool)
    new = np.concatenate(([True], place[1:] != place[:-1])) & inside
    new[begins[full]] = True
    first = np.flatnonzero(new)
    own = np.searchsorted(begins, first, "right") - 1
    ends = np.minimum(np.append(first[1:], len(place)), (begins + counts)[own])
    return joined, own, first - begins[own], ends - first, place[first] - first, h[place[first]]


def whole_copies(texts: DataFrame) -> dict[bytes, int] | None:
    """Digest -> smallest id of texts that recur; empty if the table is too large to broadcast."""
    again = texts.groupBy(F.sha2("text", 256).alias("d")).agg(F.min("did").alias("least"), F.max("did").alias("most")).where("least < most").select(F.substring("d", 1, 32).alias("d"), "least").persist()
    found = {bytes.fromhex(r.d): r.least for r in again.toLocalIterator()} if again.count() <= COPIES else {}
    again.unpersist()
    return found


class Sorted:
    """Suffix tuples (the first bytes, id, row, start) in order; runs beyond the limit go to disk and are merged by a priority queue."""

    def __init__(self, length: int, limit: int = RUN):
        self.kind = np.dtype([("key", f"S{length}"), ("did", "<i8"), ("row", "<i8"), ("start", "<i8")])
        self.limit = limit
        self.held: list[np.ndarray] = []
        self.n = 0
        self.files: list = []

    def add(self, tuples: np.ndarray) -> None:
        self.held.append(tuples)
        self.n += len(tuples)
        if self.n >= self.limit:
            run = self._run()
            f = tempfile.TemporaryFile()
            f.write(run.tobytes())
            self.files.append((f, len(run)))

    def _run(self) -> np.ndarray:
        rows = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        self.held, self.n = [], 0
        return rows[np.argsort(rows["key"], kind="stable")]

    def _blocks(self, f, n: int, size: int = 8192):
        for a in range(0, n, size):
            f.seek(a * self.kind.itemsize)
            rows = np.frombuffer(f.read(min(size, n - a) * self.kind.itemsize), self.kind)
            yield from zip(rows["key"].tolist(), rows["did"].tolist(), rows["row"].tolist(), rows["start"].tolist(), strict=True)

    def repeats(self):
        """Arrays of did, row and start of the suffixes whose key a smaller id has too."""
        last = self._run()
        if not self.files:
            if len(last):
                key = last["key"]
                at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                least = np.repeat(np.minimum.reduceat(last["did"], at), np.diff(np.append(at, len(last))))
                yield last[last["did"] > least]
            return
        f = tempfile.TemporaryFile()
        f.write(last.tobytes())
        self.files.append((f, len(last)))
        del last
        # equal keys come by id, so a group needs no more than its smallest id at a time
        key, least, out = None, 0, []
        for k, did, row, start in heapq.merge(*(sorted_ties(self._blocks(f, n)) for f, n in self.files)):
            if k != key:
                key, least = k, did
            elif did > least:
                out.append((k, did, row, start))
                if len(out) >= 65536:
                    yield np.array(out, self.kind)
                    out = []
        if out:
            yield np.array(out, self.kind)
        for f, _ in self.files:
            f.close()


def sorted_ties(rows):
    """Rows in order of key, put in order of id where keys are equal."""
    group: list = []
    for r in rows:
        if group and r[0] != group[0][0]:
            yield from sorted(group)
            group = []
        group.append(r)
    yield from sorted(group)


def merged_spans(did: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans that touch or overlap become one."""
    order = np.lexsort((start, row, did))
    did, row, start, end = did[order], row[order], start[order], end[order]
    if not len(did):
        return did, row, start, end
    other = np.concatenate(([True], (did[1:] != did[:-1]) | (row[1:] != row[:-1])))
    # windows have one length here, so ends are in order within a row
    new = other | np.concatenate(([True], start[1:] > end[:-1]))
    at = np.flatnonzero(new)
    return did[at], row[at], start[at], np.append(end[at[1:] - 1], end[-1])


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """did, rk, start, end of bytes covered by strings of `length` bytes that also start in a document with a smaller id."""
    shards = shards_for(texts) * 8
    copies = texts.sparkSession.sparkContext.broadcast(whole_copies(texts))

    def firsts(ids, group):
        """Places of the documents that aren't copies of an earlier one, and of those that are."""
        known = copies.value
        if not known:
            return list(range(len(group))), []
        least = [known.get(row_digest(t)) for t in group]
        copy = [i for i, x in enumerate(least) if x is not None and x < ids[i]]
        gone = set(copy)
        return [i for i in range(len(group)) if i not in gone], copy

    def keys(ids, group):
        own, _ = firsts(ids, group)
        _, doc, _, _, _, h = anchors([group[i] for i in own], length)
        k = narrowed(h, shards)
        at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else doc
        return np.concatenate([np.unique(k[a:b]) for a, b in zip(at, np.append(at[1:], len(k)), strict=True)]) if len(k) else k

    counts = key_counts(texts, keys, shards, 2, "anchors", narrow=True, group=GROUP)
    wanted = key_filter(counts, shards)
    sent = "shard int, did binary, rk binary, start binary, size binary, at binary, bytes binary"

    def emit(batches):
        for ids, group in groups(batches, GROUP):
            own, copy = firsts(ids, group)
            joined, doc, start, size, at, h = anchors([group[i] for i in own], length)
            hit = wanted.value.contains(narrowed(h, shards))
            doc, start, size, at, h = doc[hit], start[hit], size[hit], at[hit], h[hit]
            begins = np.cumsum([0, *(len(group[i]) + 8 for i in own)])
            dids = ids[own] if own else ids[:0]
            keys_ = np.array([row_key(group[i]) for i in own], np.int64)
            # in order of id, so that of equal stretches the first document's is shipped and the others are known to go
            order = np.argsort(dids[doc], kind="stable")
            doc, start, size, at, h = doc[order], start[order], size[order], at[order], h[order]
            seen: dict[bytes, int] = {}
            parts, gone = [], np.zeros(len(doc), bool)
            for i, (d, a, n) in enumerate(zip(doc.tolist(), (begins[doc] + start).tolist(), size.tolist(), strict=True)):
                part = joined[a : a + n + length - 1]
                first = seen.setdefault(part, d)
                gone[i] = first != d and dids[first] < dids[d]
                parts.append(part)
            copies_ = [i for i in copy if len(group[i]) >= length]
            known = [np.concatenate(x) for x in ((dids[doc[gone]], ids[copies_]), (keys_[doc[gone]], [row_key(group[i]) for i in copies_]), (start[gone], np.zeros(len(copies_), np.int64)), ((start + size + length - 1)[gone], [len(group[i]) for i in copies_]))]
            rows = [(-1, *(x.astype("<i8").tobytes() for x in known), b"", b"")] if len(known[0]) else []
            left = np.flatnonzero(~gone)
            shard = shard_of(h[left], shards)
            left = left[np.argsort(shard, kind="stable")]
            shard = np.sort(shard)
            edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(left) else left
            for a, z in zip(edge.tolist(), np.append(edge[1:], len(left)).tolist() if len(left) else [], strict=True):
                j = left[a:z]
                rows.append((int(shard[a]), *(x[j].astype("<i8").tobytes() for x in (dids[doc], keys_[doc], start)), size[j].astype("<u2").tobytes(), at[j].astype("u1").tobytes(), b"".join([parts[i] for i in j.tolist()])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i else pa.int32()) for i in range(7)], names=[c.split()[0] for c in sent.split(", ")])

    shipped = texts.mapInArrow(emit, sent)

    def spans(did, row, start, end):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (did, row, start, end)], names=["did", "rk", "start", "end"])

    def direct(batches):
        for b in batches:
            for row in zip(*(b.column(i) for i in (1, 2, 3, 4)), strict=True):
                yield spans(*merged_spans(*(np.frombuffer(x.as_buffer(), "<i8") for x in row)))

    def sort(batches):
        # stretches with equal bytes: the first document's is kept, the others are known to go
        least: dict[bytes, int] = {}
        held: list[tuple] = []
        classes: dict[bytes, int] = {}
        for b in batches:
            for did, rk, start, size, at, data in zip(*(b.column(i).to_pylist() for i in range(1, 7)), strict=True):
                place, parts = 0, []
                did = np.frombuffer(did, "<i8")
                for d, n, o in zip(did.tolist(), np.frombuffer(size, "<u2").tolist(), at, strict=True):
                    part = data[place : place + n + length - 1]
                    place += n + length - 1
                    before = least.get(part)
                    if before is None:
                        least[part] = d
                        gram = part[o : o + GRAM]
                        classes[gram] = classes.get(gram, 0) + 1
                    elif d < before:
                        least[part] = d
                    parts.append(part)
                held.append((did, np.frombuffer(rk, "<i8"), np.frombuffer(start, "<i8"), np.frombuffer(size, "<u2").astype(np.int64), at, parts))
        order = Sorted(length)
        for did, rk, start, size, at, parts in held:
            first = np.array([least[p] for p in parts], np.int64)
            gone = first < did
            if gone.any():
                yield spans(*merged_spans(did[gone], rk[gone], start[gone], (start + size + length - 1)[gone]))
            # equal windows have equal anchors: where an anchor has one stretch only, nothing is left to find
            kept = [i for i in np.flatnonzero(~gone).tolist() if classes[parts[i][at[i] : at[i] + GRAM]] > 1]
            if kept:
                n = size[kept]
                base = np.cumsum(np.concatenate(([0], n[:-1] + length - 1)))
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join([parts[i] for i in kept]), np.uint8), length)[np.repeat(base, n) + inner]
                rows = np.zeros(len(windows), order.kind)
                rows["key"] = np.ascontiguousarray(windows).view(f"S{length}")[:, 0]
                rows["did"], rows["row"], rows["start"] = np.repeat(did[kept], n), np.repeat(rk[kept], n), np.repeat(start[kept], n) + inner
                order.add(rows)
        del held, least, classes
        for found in order.repeats():
            yield spans(*merged_spans(found["did"].copy(), found["row"].copy(), found["start"].copy(), found["start"] + length))

    made = "did long, rk long, start long, end long"
    dealt = shipped.where("shard >= 0").repartition(shards, "shard").mapInArrow(sort, made)
    return dealt.unionByName(shipped.where("shard < 0").mapInArrow(direct, made))


def row_digest(text: bytes) -> bytes:
    import hashlib

    return hashlib.sha256(text).digest()[:16]


def suffix_dedup_report(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Null text is empty; a null doc_id is the smallest. Rows that repeat a doc_id don't count against each other, whatever their texts;
    rows with equal id and text have equal results.
    """
    texts = id_text(docs)
    found = repeated_spans(texts, length).groupBy("did", "rk").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("c"))

    def join(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            out = []
            for c in b.column(2).to_pylist():
                runs: list[list[int]] = []
                for x in c:
                    if runs and x["start"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x["end"])
                    else:
                        runs.append([x["start"], x["end"]])
                out.append([{"start": a, "end": z} for a, z in runs])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind), pa.array([[]] * len(out), pa.list_(pa.int64()))], names=["did", "rk", "spans", "sources"])

    spans = found.mapInArrow(join, "did long, rk long, spans array<struct<start:long,end:long>>, sources array<long>")
    return cut_report(texts, spans).select(real_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
