"""What several operators share: the shared folder, text blocks, packed key counts and key filters."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import urllib.parse
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Filters of key digests are broadcast up to this many bytes in all; beyond it they are mapped from a file (line filters: every key goes to the exact join).
FILTER_BYTES = 24 << 20
#: Text is taken in groups of about so many bytes, whatever Arrow's batches hold.
GROUP_BYTES = 8 << 20
#: A reducer folds what it has gathered once that exceeds so many bytes.
FOLD_BYTES = 24 << 20
#: Bytes of input for each shard of a packed shuffle.
SHARD_INPUT = 16 << 20
#: The driver's heap is collected before a table is written once it takes more than this share of its limit.
HEAP_SHARE = 0.6


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tilestream-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: fewer rows in an Arrow batch keep executors' and workers' buffers small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


#: Paths of the tables written so far that are still there.
_written: list[str] = []


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written.remove(path)


def collect_driver(spark: SparkSession) -> str:
    """Returns what the driver no longer needs to the system: its heap's garbage (plans, tasks and broadcasts of tables that are written),
    with the shuffle files that hang on it, and memory that its JVM freed but the C library kept.

    The result is what the JVM says of the latter; empty where it has no command for it. It is called by reflection, since the server's class isn't public.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def array(kind, *items):
        made = gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            made[i] = x
        return made

    gc.collect()  # Python's handles keep plans alive
    jvm.java.lang.System.gc()
    named = jvm.java.lang.Class.forName
    types = array(jvm.java.lang.Class, *map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
    try:
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args = array(jvm.java.lang.Object, commands, "systemTrimNativeHeap", array(jvm.java.lang.Object), array(jvm.java.lang.String))
        return named("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return ""


def heap_grown(spark: SparkSession) -> bool:
    """Whether the driver's heap takes more than HEAP_SHARE of its limit; never where it is held at its limit from the start."""
    heap = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getMemoryMXBean().getHeapMemoryUsage()
    return heap.getInit() < heap.getMax() and heap.getCommitted() > HEAP_SHARE * heap.getMax()


def release(spark: SparkSession, docs: DataFrame) -> None:
    """Deletes the tables written so far, but for those that docs reads from: they served what came before, whose result is written."""
    collect_driver(spark)
    used = docs.inputFiles()
    for path in [p for p in _written if not any(p.rsplit("/", 1)[1] in f for f in used)]:
        _drop(spark, path)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage and survives lost executors. It goes when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if heap_grown(spark):
        collect_driver(spark)
    df.write.parquet(path)

    _written.append(path)
    if len(_written) == 1:
        atexit.register(_drop_all, spark)
    return spark.read.schema(df.schema).parquet(path)


def _drop_all(spark: SparkSession) -> None:
    for path in list(_written):
        try:
            _drop(spark, path)
        except Exception:  # the session may have ended before
            return


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes that df reads."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shards_for(df: DataFrame, least: int = 24, most: int = 16384, each: int = SHARD_INPUT) -> int:
    """By the input's size; by the shuffle partitions where Spark has no estimate, as for rows from the driver."""
    size = input_bytes(df)
    if size >= 1 << 60:
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return int(max(least, min(most, size // each)))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (null: the smallest long, so it counts as the smallest id) and the text (null: empty)."""
    bounded_batches(docs.sparkSession)
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("did"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def real_id(col: str = "did"):
    """Undoes id_text's stand-in for a null id."""
    return F.when(F.col(col) != F.lit(-(2**63)), F.col(col))


def give_back() -> None:
    """Returns freed memory to the system, since a worker idles beside the next stage's tasks; where the C library can't, it stays."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def groups(batches: Iterator[pa.RecordBatch], size: int = GROUP_BYTES) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids and UTF-8 texts of columns did and text, in groups of about size bytes."""
    ids: list[int] = []
    texts: list[bytes] = []
    held = 0
    for b in batches:
        col = b.column(b.schema.get_field_index("text")).cast(pa.large_binary())
        for did, text in zip(b.column(b.schema.get_field_index("did")).to_pylist(), col, strict=True):
            t = text.as_buffer().to_pybytes()
            ids.append(did)
            texts.append(t)
            held += len(t)
            if held >= size:
                yield np.array(ids, np.int64), texts
                ids, texts, held = [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts
        texts = []
    give_back()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """x sorted, each value once; np.unique hashes first, which takes some ten times as long as sorting."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def fold(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of keys (a structured or plain uint64 array), sorted, and the sums of n."""
    if not len(keys):
        return keys, n
    if keys.dtype.names:
        order = np.argsort(keys["k1"], kind="stable")
        k = keys[order]
        same = k["k1"][1:] == k["k1"][:-1]
        if (same & (k["k2"][1:] != k["k2"][:-1])).any():
            order = np.lexsort((keys["k2"], keys["k1"]))
            k = keys[order]
            same = k["k1"][1:] == k["k1"][:-1]
        new = np.concatenate(([True], ~(same & (k["k2"][1:] == k["k2"][:-1]))))
    else:
        order = np.argsort(keys)
        k = keys[order]
        new = np.concatenate(([True], k[1:] != k[:-1]))
    at = np.flatnonzero(new)
    return k[at], np.add.reduceat(n[order], at)


class KeyFilter:
    """Bloom filters of 64-bit digests, one for each shard of a packed shuffle; None stands for "everything may be in"."""

    def __init__(self, bits: dict[int, np.ndarray] | None, shards: int, path: str = "", sizes: dict[int, int] | None = None):
        """bits: those of each shard, or None; path, sizes: instead, a file that has them in the order of shards, and their bytes."""
        self.shards = shards
        self.path = path
        self.whole = bits is None and not path
        self.bits = None
        if not self.whole:
            own = sizes if bits is None else {s: len(x) for s, x in bits.items()}
            size = np.array([own.get(s, 0) * 8 for s in range(shards)], np.int64)
            self.base = np.concatenate(([0], np.cumsum(size)))[:-1]
            self.mask = np.maximum(size - 1, 0).astype(np.uint64)
            self.none = size == 0
        if bits is not None:
            self.bits = np.concatenate([bits[s] for s in sorted(bits)]) if bits else np.zeros(1, np.uint8)

    @staticmethod
    def build(k1: np.ndarray) -> bytes:
        size = 1 << max(6, int(np.ceil(np.log2(12 * len(k1) + 1))))
        bits = np.zeros(size, bool)
        for probe in KeyFilter.probes(k1):
            bits[(probe & np.uint64(size - 1)).astype(np.int64)] = True
        return np.packbits(bits, bitorder="little").tobytes()

    @staticmethod
    def probes(k1: np.ndarray) -> list[np.ndarray]:
        a = mixed(k1)
        b = a << np.uint64(32) | a >> np.uint64(32)
        return [a, b, a + (b >> np.uint64(7))]

    def contains(self, k1: np.ndarray) -> np.ndarray:
        if self.whole:
            return np.ones(len(k1), bool)
        if self.bits is None:  # pages of the file are shared by workers and can be dropped at any time
            self.bits = np.asarray(np.memmap(self.path, np.uint8, "r"))
        shard = shard_of(k1, self.shards)
        base, mask = self.base[shard], self.mask[shard]
        found = ~self.none[shard]
        for i, probe in enumerate(KeyFilter.probes(k1)):
            left = np.flatnonzero(found) if i else slice(None)
            at = base[left] + (probe[left] & mask[left]).astype(np.int64)
            found[left] &= (self.bits[np.minimum(at >> 3, len(self.bits) - 1)] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def shard_of(k1: np.ndarray, shards: int) -> np.ndarray:
    return ((k1 >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)


def narrowed(k: np.ndarray, shards: int) -> np.ndarray:
    """Shard and 32 bits of each digest. What differs may become equal, in a share that doesn't grow as long as shards follow the input."""
    return shard_of(k, shards).astype(np.uint64) << np.uint64(33) | (k & np.uint64(0xFFFFFFFF))


PAIR = np.dtype([("k1", "<u8"), ("k2", "<u8")])
COUNTS = "shard int, k1 long, k2 long, n long, filter binary"


def key_counts(texts: DataFrame, keys_of: Callable[[np.ndarray, list[bytes]], np.ndarray], shards: int, least: int, what: str, hot: tuple[int, ...] = (), narrow: bool = False, group: int = GROUP_BYTES, digests: bool = True) -> DataFrame:
    """Digests that at least `least` emissions carry, with a Bloom filter for each shard (rows whose k1 is null).

    keys_of gives the digests of a group of documents, each once for a document: uint64, or PAIR for 128 bits. Map tasks add up equal
    digests and ship one packed row for each group and shard, so a digest that a third of all rows carry is one record of each group.
    A reducer folds as it reads; it holds its shard's distinct digests, and the number of shards grows with the input. For each number
    in hot there is another filter of each shard, numbered from `shards`, twice `shards` and so on, of the digests with at least so many emissions. narrow: keys_of gives digests
    cut by narrowed(), of which four bytes are shipped. digests: without, only the filters are written.
    """

    def emit(batches):
        for ids, texts_ in groups(batches, group):
            keys = keys_of(ids, texts_)
            keys, n = fold(keys, np.ones(len(keys), np.uint32))
            if not len(keys):
                continue
            k1 = keys["k1"] if keys.dtype.names else keys
            shard = shard_of(k1, shards)
            order = np.argsort(shard, kind="stable")
            keys, n, shard = keys[order], n[order], shard[order]
            at = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
            ends = np.append(at[1:], len(shard))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard[at], pa.int32()),
                    pa.array([(keys[a:b].astype("<u4") if narrow else keys[a:b]).tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()),
                    pa.array([n[a:b].astype("<u4").tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()),
                ],
                names=["shard", "keys", "n"],
            )

    def reduce(batches):
        kept: list[np.ndarray] = []
        sums: list[np.ndarray] = []
        held = 0
        for b in batches:
            for shard, keys, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                n = np.frombuffer(n.as_buffer(), "<u4").copy()
                raw = keys.as_buffer()
                if narrow:
                    kept.append(np.frombuffer(raw, "<u4").astype(np.uint64) | np.uint64(shard << 33))
                else:
                    kept.append(np.frombuffer(raw, PAIR if raw.size == 16 * len(n) else np.dtype("<u8")).copy())
                sums.append(n)
                held += kept[-1].nbytes + n.nbytes
            if held > FOLD_BYTES:
                k, n = fold(np.concatenate(kept), np.concatenate(sums))
                kept, sums, held = [k], [n], 0
        if not kept:
            return
        keys, n = fold(np.concatenate(kept), np.concatenate(sums))
        kept = sums = []
        give_back()
        keys, n = keys[n >= least], n[n >= least]
        k1 = keys["k1"] if keys.dtype.names else keys
        k2 = keys["k2"] if keys.dtype.names else np.zeros(len(keys), np.uint64)
        shard = shard_of(k1, shards)
        for s, own in [(s + i * shards, (shard == s) & (n >= most)) for s in np.unique(shard) for i, most in enumerate((0, *hot))]:
            yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([KeyFilter.build(k1[own])], pa.binary())], names=["shard", "k1", "k2", "n", "filter"])
        for a in range(0, len(keys) if digests else 0, 65536):
            z = slice(a, a + 65536)
            m = len(k1[z])
            yield pa.RecordBatch.from_arrays([pa.array(shard[z], pa.int32()), pa.array(k1[z].view(np.int64)), pa.array(k2[z].view(np.int64)), pa.array(n[z].astype(np.int64)), pa.nulls(m, pa.binary())], names=["shard", "k1", "k2", "n", "filter"])

    # by number: a hash puts 24 shards into 14 tasks, up to three into one
    sent = texts.mapInArrow(emit, "shard int, keys binary, n binary").repartitionById(shards, "shard")
    return written(sent.mapInArrow(reduce, COUNTS), what)


def key_filter(counts: DataFrame, shards: int, level: int = 0):
    """A broadcast KeyFilter of key_counts' digests. level: place in `hot`, from 1.

    Bits beyond FILTER_BYTES go to a file in the shared folder, which workers map; where that folder is no path of the file system, all
    keys pass.
    """
    spark = counts.sparkSession
    sc = spark.sparkContext
    rows = counts.where("filter is not null").where(F.floor(F.col("shard") / shards) == level).select((F.col("shard") % shards).alias("shard"), "filter")
    size = rows.agg(F.sum(F.length("filter"))).first()[0] or 0
    if size <= FILTER_BYTES:
        return sc.broadcast(KeyFilter({r.shard: np.frombuffer(bytes(r.filter), np.uint8) for r in rows.coalesce(1).toLocalIterator()}, shards))  # else a job for each partition
    folder = urllib.parse.urlsplit(shared_dir(spark))
    if folder.scheme not in ("", "file"):
        return sc.broadcast(KeyFilter(None, shards))
    path = f"{folder.path}/filter-{uuid.uuid4().hex}"
    found = KeyFilter(None, shards, path, {r.shard: r.n for r in rows.select("shard", F.length("filter").alias("n")).collect()})
    base = (found.base >> 3).tolist()
    with open(path, "wb") as f:
        f.truncate(size)
    _written.append(f"file://{path}")

    def put(batches):
        for b in batches:
            with open(path, "r+b") as f:
                for shard, bits in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    f.seek(base[shard])
                    f.write(bits.as_buffer())
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["shard"])

    rows.mapInArrow(put, "shard int").write.format("noop").mode("overwrite").save()
    return sc.broadcast(found)
