"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A boundary is where the gear hash of the last 32 bytes is the largest within `reach` bytes on both sides. That depends on nearby bytes
only, so an insertion changes the chunks around it and no others; chunks are longer than `reach`, about twice as long on average.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilestream.llm.common import PAIR, groups, id_text, key_counts, key_filter, mixed, real_id, shards_for, written

WINDOW = 32
GEAR = (mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: the sum of GEAR[byte] << age over the last 32 bytes, by doubling."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))  # the right side is evaluated before it is stored
        width *= 2
    return h


def _largest(h: np.ndarray, reach: int) -> np.ndarray:
    """The maximum of the `reach` values before each place; 0 where there are none."""
    width = 1 << (reach.bit_length() - 1)
    best = _running(h, width)
    if reach > width:
        both = best.copy()
        np.maximum(best[reach - width :], best[: width - reach], out=both[reach - width :])
        best = both
    return np.concatenate((np.zeros(1, h.dtype), best[:-1]))


def _running(h: np.ndarray, width: int) -> np.ndarray:
    """The maximum of the last `width` values, width a power of two."""
    best, w = h, 1
    while w < width:
        nxt = best.copy()
        np.maximum(best[w:], best[:-w], out=nxt[w:])
        best, w = nxt, 2 * w
    return best


def chunks(texts: list[bytes], reach: int) -> tuple[memoryview, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts, and document, start and end of each chunk in it. Chunks of a document cover it in order."""
    gap = bytes(2 * WINDOW + reach)
    joined = gap.join([b"", *texts, b""])
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(np.concatenate(([len(gap)], lengths[:-1] + len(gap)))) if len(texts) else lengths
    data = np.frombuffer(joined, np.uint8)
    h = gear(data)
    for s, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        h[s - len(gap) : s + WINDOW] = 0
        if n <= WINDOW:
            h[s : s + n] = 0
    if len(texts):
        h[starts[-1] + lengths[-1] :] = 0
    back = _largest(h, reach)
    ahead = _largest(h[::-1], reach)[::-1]
    cut = np.flatnonzero((h > back) & (h >= ahead) & (h > 0)) + 1
    doc = np.searchsorted(starts, cut, "right") - 1
    inside = cut < starts[doc] + lengths[doc] if len(cut) else np.zeros(0, bool)
    cut, doc = cut[inside], doc[inside]
    full = np.flatnonzero(lengths > 0)
    begin = np.concatenate((starts[full], cut))
    own = np.concatenate((full, doc))
    order = np.argsort(begin, kind="stable")
    begin, own = begin[order], own[order]
    last = np.append(own[1:] != own[:-1], True) if len(own) else np.zeros(0, bool)
    end = np.where(last, (starts + lengths)[own], np.append(begin[1:], 0)) if len(own) else begin
    return memoryview(joined), own, begin, end


def digests(joined: memoryview, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    f = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([f(joined[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]), PAIR)


def row_key(text: bytes) -> int:
    """Spark's xxhash64 of a string: with the id, it tells rows apart that repeat an id."""
    x = xxhash.xxh64_intdigest(text, seed=42)
    return x - (1 << 64) if x >> 63 else x


def repeated_chunks(texts: DataFrame, reach: int, what: str = "chunks") -> DataFrame:
    """did, rk, start, end, before, after, f: each chunk (bytes of the document) whose digest an earlier one has, the lengths of the chunks
    beside it in its document, and id, start and row key of the first.

    Digests are counted first; only chunks of digests that occur twice are then dealt by digest, and skewed digests are split.
    """
    shards = shards_for(texts)

    def keys(_ids, group):
        joined, own, begin, end = chunks(group, reach)
        return digests(joined, begin, end)

    counts = key_counts(texts, keys, shards, 2, what)
    wanted = key_filter(counts, shards)

    def hits(batches):
        for ids, group in groups(batches):
            joined, own, begin, end = chunks(group, reach)
            d = digests(joined, begin, end)
            hit = wanted.value.contains(d["k1"])
            length, inner = end - begin, np.append(own[1:] == own[:-1], False)[: len(own)]
            before = np.concatenate(([0], np.where(inner, length, 0)))[: len(own)]
            after = np.where(inner, np.append(length[1:], 0)[: len(own)], 0)
            own, begin, end, before, after, d = own[hit], begin[hit], end[hit], before[hit], after[hit], d[hit]
            lengths = np.array([len(t) for t in group], np.int64)
            gap = 2 * WINDOW + reach
            starts = np.cumsum(np.concatenate(([gap], lengths[:-1] + gap)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(np.array([row_key(t) for t in group], np.int64)[own]), pa.array(begin - starts[own]), pa.array(end - starts[own]), pa.array(before, pa.int64()), pa.array(after, pa.int64()), pa.array(d["k1"].view(np.int64) if len(d) else np.zeros(0, np.int64)), pa.array(d["k2"].copy().view(np.int64))], names=["did", "rk", "start", "end", "before", "after", "k1", "k2"])

    held = texts.mapInArrow(hits, "did long, rk long, start long, end long, before long, after long, k1 long, k2 long")
    first = held.groupBy("k1", "k2").agg(F.min(F.struct("did", "start", "rk")).alias("f"), F.count("*").alias("n")).where("n > 1").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "f")
    found = held.join(first, (F.col("k1") == F.col("__k1")) & (F.col("k2") == F.col("__k2")))
    return found.where((F.col("did") != F.col("f.did")) | (F.col("start") != F.col("f.start"))).select("did", "rk", "start", "end", "before", "after", "f")


def run_edges(found: DataFrame, reach: int) -> DataFrame:
    """Two rows for each run of repeated chunks, side 0 and 1: its sources, and what lies outside on that side: n bytes at `at` in the
    document and at `sat` in the source (sdid, srk). Cuts depend on WINDOW + reach bytes before them and reach after, so what is shared
    beyond the run can't go further than the chunk beside it and that."""
    own = found.groupBy("did", "rk").agg(F.array_sort(F.collect_list(F.struct("start", "end", "before", "after", "f"))).alias("c"))
    names = ["did", "rk", "start", "end", "side", "sources", "at", "n", "sdid", "srk", "sat"]
    kinds = [pa.list_(pa.int64()) if x == "sources" else pa.int64() for x in names]

    def run(batches):
        for b in batches:
            out = []
            for did, rk, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                joined: list[list] = []
                for x in c:
                    if joined and joined[-1][1] >= x["start"]:
                        last = joined[-1]
                        if x["end"] >= last[1]:
                            last[1], last[4] = x["end"], x
                        last[2].add(x["f"]["did"])
                    else:
                        joined.append([x["start"], x["end"], {x["f"]["did"]}, x, x])
                for start, end, sources, a, z in joined:
                    n = min(a["before"] + WINDOW + reach + 1, start, a["f"]["start"])
                    out.append((did, rk, start, end, 0, sorted(sources), start - n, n, a["f"]["did"], a["f"]["rk"], a["f"]["start"] - n))
                    n = z["after"] + reach + 1 if z["after"] else 0
                    out.append((did, rk, start, end, 1, sorted(sources), end, n, z["f"]["did"], z["f"]["rk"], z["f"]["start"] + z["end"] - z["start"]))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * len(names), kinds, strict=True)], names=names)

    return own.mapInArrow(run, ", ".join(f"{x} {'array<long>' if x == 'sources' else 'long'}" for x in names))


def shared_length(a: bytes, b: bytes, backwards: bool) -> int:
    """How many bytes a and b have in common at the front, or at the back."""
    n = min(len(a), len(b))
    if not n:
        return 0
    x, y = (np.frombuffer(t[-n:][::-1] if backwards else t[:n], np.uint8) for t in (a, b))
    wrong = x != y
    return int(wrong.argmax()) if wrong.any() else n


def removed_spans(texts: DataFrame, reach: int = 24, least: int = 100, what: str = "edges") -> DataFrame:
    """did, rk, spans (array of start, end) and sources (ids of the documents that keep the text), where runs of repeated chunks reach `least` bytes.

    Before its length counts, a run grows byte by byte for as long as the document of its outer chunk's first occurrence goes on alike.
    Documents of less than `least` bytes go where another has the same text.
    """
    keyed = texts.withColumn("rk", F.xxhash64("text"))
    edges = written(run_edges(repeated_chunks(texts, reach).distinct(), reach), what)
    asked = edges.select("did", "rk", "at", "n").union(edges.select("sdid", "srk", "sat", "n")).where("n > 0")
    asked = asked.groupBy("did", "rk").agg(F.collect_set(F.struct("at", "n")).alias("asked"))
    pieces = keyed.join(asked, ["did", "rk"]).withColumn("b", F.col("text").cast("binary"))
    pieces = pieces.select("did", "rk", F.explode(F.expr("transform(asked, x -> struct(x.at AS at, x.n AS n, substring(b, cast(x.at + 1 AS int), cast(x.n AS int)) AS piece))")).alias("p"))
    pieces = pieces.select("did", "rk", "p.*").dropDuplicates(["did", "rk", "at", "n"])
    both = edges.join(pieces.withColumnRenamed("piece", "mine"), ["did", "rk", "at", "n"], "left")
    both = both.join(pieces.toDF("sdid", "srk", "sat", "n", "its"), ["sdid", "srk", "sat", "n"], "left")
    own = both.groupBy("did", "rk").agg(F.collect_list(F.struct("start", "end", "side", "sources", "mine", "its")).alias("e"))

    def run(batches):
        for b in batches:
            ids, keys, spans, sources = [], [], [], []
            for did, rk, e in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                grown: dict[int, list] = {}
                for x in e:
                    g = grown.setdefault(x["start"], [x["start"], x["end"], set(x["sources"])])
                    more = shared_length(x["mine"] or b"", x["its"] or b"", x["side"] == 0)
                    g[x["side"]] += more if x["side"] else -more
                joined: list[list] = []
                for g in sorted(grown.values(), key=lambda g: g[:2]):
                    if joined and joined[-1][1] >= g[0]:
                        joined[-1][1] = max(joined[-1][1], g[1])
                        joined[-1][2] |= g[2]
                    else:
                        joined.append(g)
                kept = [j for j in joined if j[1] - j[0] >= least]
                if kept:
                    ids.append(did)
                    keys.append(rk)
                    spans.append([{"start": j[0], "end": j[1]} for j in kept])
                    sources.append(sorted(set().union(*(j[2] for j in kept)) - {did}))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(sources, pa.list_(pa.int64()))], names=["did", "rk", "spans", "sources"])

    long = own.mapInArrow(run, "did long, rk long, spans array<struct<start:long,end:long>>, sources array<long>")
    brief = keyed.where(F.octet_length("text").between(1, least - 1))
    first = brief.groupBy("text").agg(F.min("did").alias("first"), F.max("did").alias("last")).where("first < last")
    whole = brief.join(first, "text").where("did > first").withColumn("size", F.octet_length("text").cast("long")).select("did", "rk", "size", "first").distinct()
    return long.unionByName(whole.select("did", "rk", F.expr("array(struct(0L AS start, size AS end))").alias("spans"), F.array("first").alias("sources")))


def cut_report(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """did, n_bytes, n_removed, n_spans, kept_sha256 and sources of every row of texts, after its spans are cut out."""
    joined = texts.withColumn("rk", F.xxhash64("text")).join(spans, ["did", "rk"], "left").select("did", "text", "spans", "sources")

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, spans_ in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                data = text.cast(pa.binary()).as_py()
                gone, at, h = 0, 0, hashlib.sha256()
                for s in spans_ or ():
                    h.update(data[at : s["start"]])
                    at = s["end"]
                    gone += s["end"] - s["start"]
                h.update(data[at:])
                for to, x in zip(out, (len(data), gone, len(spans_ or ()), h.hexdigest()), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()), b.column(3)], names=["did", "n_bytes", "n_removed", "n_spans", "kept_sha256", "sources"])

    return joined.mapInArrow(run, "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, sources array<long>")


def substring_dedup_report(docs: DataFrame, reach: int = 24, least: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and sources of every row.

    The first occurrence of a chunk, by doc_id and place, stays; repeats go where a run of them has at least `least` bytes, in the
    same document too, and copies of shorter documents as a whole. sources lists the other documents that keep what went, empty where nothing went. Null text is empty; a null doc_id
    is the smallest; rows that repeat a doc_id and text are one document to the chunks, so copies under one id stay.
    """
    texts = id_text(docs)
    out = cut_report(texts, removed_spans(texts, reach, least))
    return out.select(real_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("sources", F.expr("cast(array() as array<long>)")).alias("sources"))
