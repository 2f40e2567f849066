"""Approximate nearest neighbours by largest inner product: inverted lists scanned by adaptive dimensions.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, which turns the
largest inner product into the smallest Euclidean distance. Lists are the cells of a
k-means fitted on a bounded sample; every vector is put in its cell. A query visits the
nearest cells. Within a cell, vectors are rotated by a random orthogonal matrix and compared
in column blocks: after d of D components, a candidate is abandoned when its partial
distance, scaled by D / d, exceeds the query's current k-th best by more than the factor
(1 + eps / sqrt(d))^2 - a test whose false rejections are rare because rotated components
are exchangeable. Survivors are scored exactly, in double precision on the original vectors.

Work is dealt out by (cell, block of its vectors, block of its queries), so a cell that
holds much of the table is split; each unit returns its own k best and these are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidence_spark.llm.common import stored

K = 20
SAMPLE_ROWS = 20_000
MAX_LISTS = 4_096
#: Share of the cells that a query visits, and the fewest; measured recall on the test tables is in the README.
PROBE_SHARE = 0.7
MIN_PROBES = 24
BLOCK_ROWS = 8_192
BLOCK_QUERIES = 2_048
DIM_BLOCK = 16
EPS = 2.1


def valid_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, norm2) of the rows that take part: id present, all components finite, not zero."""
    v = F.col(vec_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm2 = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    rows = table.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(sound)
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("vec"), norm2.alias("norm2")).where(F.col("norm2") > 0)


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def augment(x: np.ndarray, top2: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(0.0, top2 - (x * x).sum(axis=1)))]


def fit_cells(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """k-means centroids of a bounded sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        own = nearest_cells(sample, centres, 1)[:, 0]
        order = np.argsort(own, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0])
        centres[own[order][cut]] = np.add.reduceat(sample[order], cut) / np.diff(np.r_[cut, len(own)])[:, None]
    return centres


def nearest_cells(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each row, nearest first."""
    out = np.empty((len(x), n), dtype=np.int64)
    for i in range(0, len(x), 4096):
        d = (centres * centres).sum(axis=1)[None, :] - 2 * x[i: i + 4096] @ centres.T
        out[i: i + 4096] = np.argmin(d, axis=1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n]
    return out


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _kth(d: np.ndarray, k: int) -> np.ndarray:
    """k-th smallest of each row; infinite with fewer."""
    if d.shape[1] < k:
        return np.full(len(d), np.inf)
    return np.partition(d, k - 1, axis=1)[:, k - 1]


def scan_cell(q: np.ndarray, x: np.ndarray, qid: np.ndarray, xid: np.ndarray, top2: float, rot: np.ndarray, k: int,
              eps: float = EPS, block: int = DIM_BLOCK, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, candidate) that survive the adaptive scan of one unit.

    A row is no candidate of a query with its own id. All ties with the k-th best survive.
    """
    qr, xr = np.c_[q, np.zeros(len(q))] @ rot, augment(x, top2) @ rot
    dim = len(rot)
    slack = 1e-9 * (top2 + (q * q).sum(axis=1))
    best = np.full((len(q), 0), np.inf)
    keep_q, keep_x, keep_d = [], [], []
    for i in range(0, len(xr), step):
        part = xr[i: i + step]
        bound = _kth(best, k) + slack
        other = qid[:, None] != xid[None, i: i + step]
        full, a, b, dist = np.zeros(other.shape), None, None, None
        for lo in range(0, dim, block):
            hi = min(lo + block, dim)
            scale = dim / hi / (1 + eps / math.sqrt(hi)) ** 2 if hi < dim else 1.0
            if a is None:  # all pairs at once, until few are left
                full += (qr[:, lo:hi] ** 2).sum(1)[:, None] + (part[:, lo:hi] ** 2).sum(1)[None, :] - 2 * qr[:, lo:hi] @ part[:, lo:hi].T
                other &= full * scale <= bound[:, None]
                if hi == dim or other.sum() < other.size * 0.1:
                    a, b = np.nonzero(other)
                    dist = np.maximum(full[a, b], 0.0)
            else:
                dist = dist + ((qr[a, lo:hi] - part[b, lo:hi]) ** 2).sum(axis=1)
                alive = dist * scale <= bound[a]
                a, b, dist = a[alive], b[alive], dist[alive]
        keep_q.append(a)
        keep_x.append(b + i)
        keep_d.append(dist)
        merged = np.full((len(q), len(part)), np.inf)
        merged[a, b] = dist
        both = np.concatenate([best, merged], axis=1)
        best = np.partition(both, k - 1, axis=1)[:, :k] if both.shape[1] > k else both
    a, b, dist = np.concatenate(keep_q), np.concatenate(keep_x), np.concatenate(keep_d)
    alive = dist <= (_kth(best, k) + slack)[a]
    return a[alive], b[alive]


def search(table: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
           sample_rows: int = SAMPLE_ROWS, probe_share: float = PROBE_SHARE, eps: float = EPS,
           block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, nearest first.

    Rows without id, and vectors that are null, zero, hold a null or non-finite component or
    are not of the table's most frequent length take no part. A query's own id is no
    candidate. Of queries with equal ids the smallest vector is searched; candidates with
    equal ids are rows of their own. Ties go to the smaller id. An empty table gives none.
    The driver gets: the centroid sample (``sample_rows`` vectors at most) and the cells' sizes.
    """
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    data = valid_vectors(table, id_col, vec_col)
    sizes = data.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("top2"))
    main = sizes.orderBy(F.desc("n"), "dim").first()
    if main is None:
        return spark.createDataFrame([], schema)
    dim, n, top2 = main["dim"], main["n"], main["top2"]
    data = data.where(F.size("vec") == dim)
    share = min(1.0, sample_rows / n)
    sample = data.where(F.pmod(F.xxhash64("id", F.lit("cells")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("vec").limit(2 * sample_rows)
    points = augment(np.array([r[0] for r in sample.collect()], dtype=float).reshape(-1, dim), top2)
    if not len(points):
        points = augment(np.array([data.first()["vec"]], dtype=float), top2)
    centres = fit_cells(points, min(MAX_LISTS, len(points), max(1, math.ceil(math.sqrt(n) / 2))))
    rot = rotation(dim + 1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = nearest_cells(augment(_matrix(b.column(1)), top2), centres, 1)[:, 0] if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells.astype(np.int32))], ["id", "vec", "cell"])

    placed = stored(data.select("id", "vec").mapInArrow(assign, "id long, vec array<double>, cell int"), "vectors-in-cells")
    filled = {r[0]: r[1] for r in placed.groupBy("cell").count().collect()}
    counts = np.array([filled.get(c, 0) for c in range(len(centres))])
    probes = max(MIN_PROBES, math.ceil(probe_share * len(centres)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            order = nearest_cells(np.c_[x, np.zeros(len(x))], centres, len(centres))
            # further cells while those visited hold too few vectors for k neighbours
            short = np.cumsum(counts[order], axis=1) - counts[order] <= k
            visit = (np.arange(len(centres))[None, :] < probes) | short
            at, col = np.nonzero(visit & (counts[order] > 0))
            for i in range(0, len(at), 20_000):
                rows = pa.array(at[i: i + 20_000])
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(
                    order[at[i: i + 20_000], col[i: i + 20_000]].astype(np.int32))], ["id", "vec", "cell"])

    asked = valid_vectors(queries, id_col, vec_col).where(F.size("vec") == dim).groupBy("id").agg(F.min("vec").alias("vec"))
    visits = stored(asked.mapInArrow(probe, "id long, vec array<double>, cell int"), "query-visits")
    asks = {r[0]: r[1] for r in visits.groupBy("cell").count().collect()}
    parts = spark.createDataFrame([(c, math.ceil(m / block_rows), math.ceil(asks.get(c, 0) / block_queries)) for c, m in sorted(filled.items())],
                                  "cell int, n_x int, n_q int")

    def blocks(df: DataFrame, own: str, other: str, mark: str) -> DataFrame:
        """Own block by hash, one copy for each block of the other side."""
        df = df.join(F.broadcast(parts), "cell").where(F.col(other) > 0)
        mine = F.pmod(F.xxhash64("id", F.lit(mark)), F.col(own)).cast("int")
        return df.select("cell", mine.alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other), "id", "vec")

    def unit(key, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        qid, xid = left["id"].to_numpy(), right["id"].to_numpy()
        q, x = _matrix(left["vec"].combine_chunks()), _matrix(right["vec"].combine_chunks())
        a, b = scan_cell(q, x, qid, xid, top2, rot, k, eps)
        score = np.einsum("ij,ij->i", q[a], x[b])
        order = np.lexsort((xid[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        first = np.flatnonzero(np.r_[True, np.diff(a) > 0]) if len(a) else np.zeros(0, np.int64)
        place = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
        top = place < k
        return pa.table({"query_id": qid[a[top]], "vec_id": xid[b[top]], "score": score[top]})

    left = blocks(visits, "n_q", "n_x", "q").groupBy("cell", "n_x", "n_q")
    right = blocks(placed, "n_x", "n_q", "x").groupBy("cell", "n_x", "n_q")
    found = left.cogroup(right).applyInArrow(unit, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
