"""Approximate nearest neighbours: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

Nearest by Euclidean distance is turned into largest inner product: x becomes (x, -|x|^2/2) and q becomes (q, 1). The first part is
product-quantised with 16 codewords for every two dimensions. Codewords and codes minimise a loss that weighs the residual parallel to
the vector more than the orthogonal one, since only the parallel part moves the scores of the vector's best queries. A scan adds up one
table entry for each code. Its score is off by no more than |q| times the norm of the vector's residual, which is stored with the code:
exact distances are taken until no vector left could be among the nearest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SUB = 2
WORDS = 16


def parallel_weight(dim: int, threshold: float = 0.2) -> float:
    """Weight of the parallel against the orthogonal residual for queries whose cosine is at least the threshold."""
    t2 = threshold * threshold
    return max(1.0, (dim - 1) * t2 / (1 - t2))


def _pieces(x: np.ndarray) -> np.ndarray:
    """(n, dim) -> (n, m, SUB), with zeros behind."""
    pad = -x.shape[1] % SUB
    x = np.pad(x, ((0, 0), (0, pad)))
    return x.reshape(len(x), -1, SUB)


def encode(x: np.ndarray, books: np.ndarray, eta: float, rounds: int = 3) -> np.ndarray:
    """Codes (n, m) by coordinate descent on |r|^2 + (eta - 1) <r, x/|x|>^2, r the residual."""
    p = _pieces(x)
    n, m, _ = p.shape
    unit = p / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    square = np.stack([((p[:, j, None, :] - books[j][None]) ** 2).sum(2) for j in range(m)], 1)
    along = np.stack([((p[:, j, None, :] - books[j][None]) * unit[:, j, None, :]).sum(2) for j in range(m)], 1)
    codes = square.argmin(2)
    at = np.arange(n)
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(rounds):
        for j in range(m):
            rest = total - along[at, j, codes[:, j]]
            codes[:, j] = (square[:, j] + (eta - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(1)
            total = rest + along[at, j, codes[:, j]]
    return codes.astype(np.uint8)


def train(x: np.ndarray, rounds: int = 6, threshold: float = 0.2) -> tuple[np.ndarray, float]:
    """Codebooks (m, WORDS, SUB) and the parallel weight, from a bounded sample. Deterministic."""
    eta = parallel_weight(x.shape[1], threshold)
    p = _pieces(x)
    rng = np.random.default_rng(7)
    m = p.shape[1]
    books = np.zeros((m, WORDS, SUB))
    for j in range(m):
        books[j] = p[rng.choice(len(p), WORDS, replace=len(p) < WORDS), j]
    unit = p / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    for _ in range(rounds):
        codes = encode(x, books, eta, 1)
        held = books[np.arange(m)[None], codes]
        along = ((p - held) * unit).sum(2)
        for j in range(m):
            rest = along.sum(1) - along[:, j]
            for w in range(WORDS):
                own = np.flatnonzero(codes[:, j] == w)
                if not len(own):
                    continue
                u, v = unit[own, j], p[own, j]
                left = len(own) * np.eye(SUB) + (eta - 1) * u.T @ u
                right = v.sum(0) + (eta - 1) * (u * (rest[own] + (u * v).sum(1))[:, None]).sum(0)
                books[j, w] = np.linalg.solve(left, right)
            along[:, j] = ((p[:, j] - books[j, codes[:, j]]) * unit[:, j]).sum(1)
    return books, eta


def residual(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Norms of the rows less their codewords."""
    r = _pieces(x) - books[np.arange(len(books))[None], codes]
    return np.sqrt((r * r).sum((1, 2)))


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes in a byte."""
    codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return codes[:, ::2] | codes[:, 1::2] << 4


def scan(queries: np.ndarray, codes: np.ndarray, books: np.ndarray, half_norm: np.ndarray) -> np.ndarray:
    """Approximate <q, x> - |x|^2/2 of each query and packed code: tables of 16 entries for each code, two codes added at once."""
    q = _pieces(queries)
    tables = np.einsum("qjs,jws->qjw", q, books).astype(np.float32)
    if tables.shape[1] % 2:
        tables = np.pad(tables, ((0, 0), (0, 1), (0, 0)))
    pairs = (tables[:, 1::2, :, None] + tables[:, ::2, None, :]).reshape(len(q), -1, 256)
    out = np.repeat(-half_norm[None].astype(np.float32), len(q), 0)
    for j in range(pairs.shape[1]):
        out += pairs[:, j][:, codes[:, j]]
    return out


def nearest(q: np.ndarray, vecs: np.ndarray, upper: np.ndarray, open_: np.ndarray, k: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest rows of those open: rows are measured by falling upper bound of their score, `first` of them and
    then twice as many each time, until no bound reaches the k-th score found. Ties go to the smaller place; bounds that are not numbers are
    measured."""
    upper = np.where(np.isnan(upper), np.inf, upper)
    left = np.flatnonzero(open_)
    kept, dist = left[:0], np.zeros(0)
    half = (q * q).sum() / 2
    size = first
    while len(left):
        if len(left) > size:
            part = np.argpartition(-upper[left], size)
            best, left = left[part[:size]], left[part[size:]]
        else:
            best, left = left, left[:0]
        kept = np.concatenate((kept, best))
        dist = np.concatenate((dist, np.sqrt(((vecs[best] - q) ** 2).sum(1))))
        order = np.lexsort((kept, dist))[:k]
        kept, dist = kept[order], dist[order]
        if len(kept) == k:
            d = dist[-1] * dist[-1] / 2
            left = left[~(upper[left] < half - d - 1e-12 * (half + d))]
        size *= 2
    return kept, dist


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, sample: int = 10_000, block: int = 8192, query_block: int = 512, rerank: int = 64, dim: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row of queries, nearest first, ties to the smaller id.

    Vectors that are null, zero, of another length than dim (the commonest one unless given), or hold null or non-finite components take
    no part. The codebooks come from the `sample` rows of smallest hash; every row is indexed. Rows are dealt to blocks of about `block`
    vectors and queries to blocks of about `query_block`; each pair of blocks is one task's table scan, whose best `rerank` are measured
    exactly, and after them every row whose bound reaches the k-th found: the k nearest of a block are exact. A row is never its own candidate; rows that repeat an id are one identity and each takes part.
    """
    def usable(df: DataFrame, vid: str, vec: str) -> DataFrame:
        v = F.col(vec).cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.where(F.col(vid).isNotNull() & v.isNotNull()).select(F.col(vid).cast("long").alias("id"), v.alias("vec")).where(fine)

    rows = usable(vectors, id_col, vec_col)
    asked = usable(queries, id_col, vec_col)
    out = "query_id long, rank int, vec_id long, score double"
    if dim is None:
        common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
        if common is None:
            return vectors.sparkSession.createDataFrame([], out)
        dim = common["n"]
    rows, asked = rows.where(F.size("vec") == dim), asked.where(F.size("vec") == dim)
    taken = rows.orderBy(F.xxhash64("id"), "id", "vec").limit(sample).toPandas()
    if not len(taken):
        return vectors.sparkSession.createDataFrame([], out)
    # computed on the driver from a bounded sample, and of fixed size
    books, eta = train(np.stack(taken["vec"].to_numpy()))
    n_rows, n_asked = rows.count(), asked.count()
    n_blocks, n_query_blocks = max(1, -(-n_rows // block)), max(1, -(-n_asked // query_block))

    def index(batches):
        for b in batches:
            x = np.stack(b.column(1).to_numpy(zero_copy_only=False)) if len(b) else np.zeros((0, dim))
            codes = encode(x, books, eta) if len(b) else np.zeros((0, len(books)), np.uint8)
            off = residual(x, codes, books)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in packed(codes)], pa.binary()), pa.array(off)], names=["id", "vec", "code", "off"])

    indexed = rows.mapInArrow(index, "id long, vec array<double>, code binary, off double").select("id", "vec", "code", "off", F.pmod(F.xxhash64("id", F.lit("row")), F.lit(n_blocks)).alias("rb"))
    indexed = indexed.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1)))) if n_query_blocks > 1 else indexed.withColumn("qb", F.lit(0))
    asked = asked.select("id", "vec", F.pmod(F.xxhash64("id", F.lit("query")), F.lit(n_query_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("rb"))

    def pair(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(q) or not len(x):
            return empty
        x = x.sort_values("id", kind="stable")
        ids, vecs = x["id"].to_numpy(), np.stack(x["vec"].to_numpy())
        codes = np.stack([np.frombuffer(c, np.uint8) for c in x["code"]])
        off = x["off"].to_numpy()
        half = (vecs * vecs).sum(1) / 2
        # the scan adds in single precision: each of its sums is off by a part of the sizes of what it adds up
        single = (codes.shape[1] + 8) * 2.0**-23
        length = np.sqrt(2 * half) + off
        qids, qvecs = q["id"].to_numpy(), np.stack(q["vec"].to_numpy())
        made = []
        step = max(1, (16 << 20) // (4 * len(ids)))
        for a in range(0, len(qids), step):
            for i, near in enumerate(scan(qvecs[a : a + step], codes, books, half), a):
                norm = np.sqrt((qvecs[i] * qvecs[i]).sum())
                upper = near + norm * off + single * (half + norm * length)
                places, exact = nearest(qvecs[i], vecs, upper, ids != qids[i], k, max(rerank, k))  # rows are in order of id
                made.append(pd.DataFrame({"query_id": qids[i], "vec_id": ids[places], "score": exact}))
        return pd.concat(made) if made else empty

    found = asked.groupBy("qb", "rb").cogroup(indexed.groupBy("qb", "rb")).applyInPandas(pair, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
