"""Hard-negative mining with a multiway hyperplane tree (GNAT).

Vectors are whole numbers, floor(256 x). One more component, sqrt(M^2 - |x|^2) with M the
largest norm, turns the inner product with an anchor into a distance, so a window of scores
is an annulus around the anchor. A tree is fitted on a bounded sample: each node holds split
points, and every vector goes to the nearest one, down to a leaf. For each split point and
each sibling subtree, the range of distances of *all* vectors of that subtree is measured in
Spark. An anchor leaves out a subtree when, for some split point, its range misses all
distances that the annulus allows. Leaves that stay are compared exactly.

Positives are a search with an open window and the anchor's own label; negatives one with
the windows that the positives' scores give and any other label. Each search first looks
into the anchor's home leaf: with enough rows found there, the last one's score closes the
window from below, which is never more than the true result allows.

Leaves are packed into regions of a bounded number of rows (a large leaf is split over
several), and an anchor is sent once to a region, with the list of leaves it wants there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_spark.llm.common import stored

POSITIVES = 5
NEGATIVES = 3
#: Share of the positive's score, in hundredths, between which a negative's lies.
LOW, HIGH = 50, 95
SAMPLE_ROWS = 20_000
FANOUT = 16
LEAF_ROWS = 1_024
REGION_ROWS = 8_192
BLOCK_ASKS = 4_096
_MIN, _MAX = -(1 << 62), 1 << 62
_ASK = "id long, label long, vec array<double>, keys array<int>, lo array<long>, hi array<long>"


def integer_vectors(table: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(id, label, vec, norm2) of the rows that take part; vec holds whole numbers."""
    v = F.col(vec_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & label.isNotNull()).where(sound)
    whole = F.transform(v, lambda x: F.floor(x * 256.0).cast("double"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("vec"))
    return rows.withColumn("norm2", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as int64."""
    top = max((q * q).sum(axis=1).max(initial=0.0), (x * x).sum(axis=1).max(initial=0.0))
    if top < 2.0 ** 52:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * x @ points.T
    return np.sqrt(np.maximum(d, 0.0))


@dataclass
class Tree:
    """Nodes in order from the root: split points, and the child of each (a node, or ~leaf)."""

    points: list[np.ndarray]
    child: list[np.ndarray]
    leaves: int
    ranges: dict[int, np.ndarray] | None = None

    def descend(self, x: np.ndarray, seen=None) -> np.ndarray:
        """Leaf of each row. ``seen(node, distances, child)`` is called for each node."""
        leaf = np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))] if self.points else []
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            d = _distances(x[rows], self.points[node])
            own = d.argmin(axis=1)
            if seen:
                seen(node, d, own)
            for j, c in enumerate(self.child[node].tolist()):
                mine = rows[own == j]
                if c < 0:
                    leaf[mine] = ~c
                else:
                    todo.append((c, mine))
        return leaf

    def reached(self, q: np.ndarray, inner: np.ndarray, outer: np.ndarray, slack: float) -> np.ndarray:
        """(query, leaf) matrix of the leaves that an annulus of the query can reach.

        ``inner`` and ``outer`` are (query, window) radii; an outer one below 0 is no window.
        """
        out = np.zeros((len(q), self.leaves), dtype=bool)
        if not self.points:
            out[:] = (outer >= 0).any(axis=1)[:, None]
            return out
        todo = [(0, np.flatnonzero((outer >= 0).any(axis=1)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            d = _distances(q[rows], self.points[node])
            low, high = self.ranges[node][..., 0], self.ranges[node][..., 1]  # (split point, child)
            stays = np.zeros((len(rows), len(self.child[node])), dtype=bool)
            for w in range(inner.shape[1]):
                rin, rout = inner[rows, w][:, None], outer[rows, w][:, None]
                least = np.maximum(d - rout, rin - d) - slack
                most = d + rout + slack
                meets = ((high[None] >= least[:, :, None]) & (low[None] <= most[:, :, None])).all(axis=1)
                stays |= meets & (rout >= 0)
            for j, c in enumerate(self.child[node].tolist()):
                mine = rows[stays[:, j]]
                if c < 0:
                    out[mine, ~c] = True
                else:
                    todo.append((c, mine))
        return out


def fit_tree(sample: np.ndarray, rows: int, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS, seed: int = 3) -> Tree:
    """Tree over a bounded sample of a table of ``rows`` vectors; nodes of few sample points are leaves."""
    rng = np.random.default_rng(seed)
    tree = Tree([], [], 0)
    scale = rows / max(len(sample), 1)

    def leaf() -> int:
        tree.leaves += 1
        return ~(tree.leaves - 1)

    def grow(x: np.ndarray) -> int:
        if len(x) * scale <= leaf_rows or len(x) < 2 * fanout:
            return leaf()
        # split points far apart: greedily among a random few
        few = x[rng.permutation(len(x))[: 3 * fanout]]
        chosen = [0]
        near = _distances(few, few[:1])[:, 0]
        while len(chosen) < fanout and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, _distances(few, few[chosen[-1:]])[:, 0])
        if len(chosen) < 2:
            return leaf()
        node, points = len(tree.points), few[chosen]
        tree.points.append(points)
        tree.child.append(np.zeros(len(chosen), dtype=np.int64))
        own = _distances(x, points).argmin(axis=1)
        for j in range(len(chosen)):
            tree.child[node][j] = grow(x[own == j])
        return node

    grow(sample)
    return tree


def _augment(x: np.ndarray, top2: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(0.0, top2 - (x * x).sum(axis=1)))]


def _best(ask: np.ndarray, key: np.ndarray, score: np.ndarray, cand: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each (ask, key), ties by candidate."""
    order = np.lexsort((cand, -score, key, ask))
    a, b = ask[order], key[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    place = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
    return order[place < k]


def scan_leaf(q, qid, qlabel, lo, hi, x, xid, xlabel, same: bool, k: int, step: int = 512) -> tuple[np.ndarray, ...]:
    """Rows of one leaf inside the windows: (ask, window, candidate row, score), at least the k best of each."""
    found = []
    for i in range(0, len(q), step):
        part = slice(i, i + step)
        s = products(q[part], x)
        fits = (qlabel[part, None] == xlabel[None, :]) == same
        fits &= qid[part, None] != xid[None, :]
        for w in range(lo.shape[1]):
            ok = fits & (s >= lo[part, w, None]) & (s <= hi[part, w, None])
            if s.shape[1] > k:
                masked = np.where(ok, s, _MIN)
                last = np.partition(masked, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                ok &= s >= last[:, None]
            a, b = np.nonzero(ok)
            found.append((a + i, np.full(len(a), w), b, s[a, b]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class Forest:
    """A table of vectors placed in the leaves of a tree, ready for window searches."""

    def __init__(self, data: DataFrame, sample_rows: int, fanout: int, leaf_rows: int, region_rows: int, block_asks: int):
        sizes = data.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("top2"))
        main = sizes.orderBy(F.desc("n"), "dim").first()
        self.empty = main is None or not main["dim"]
        if self.empty:
            return
        self.dim, self.n, self.top2, self.block_asks = main["dim"], main["n"], main["top2"], block_asks
        self.data = data.where(F.size("vec") == self.dim)
        share = min(1.0, sample_rows / self.n)
        sample = self.data.where(F.pmod(F.xxhash64("id", F.lit("gnat")), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30))))
        points = np.array([r[0] for r in sample.select("vec").limit(2 * sample_rows).collect()], dtype=float).reshape(-1, self.dim)
        self.slack = 1e-5 * (math.sqrt(self.top2) + 1)
        self.tree = tree = fit_tree(_augment(points, self.top2), self.n, fanout, leaf_rows)
        top2 = self.top2

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaf = tree.descend(_augment(_matrix(b.column(2)), top2)) if b.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32))], ["id", "label", "vec", "leaf"])

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low: dict[tuple[int, int, int], float] = {}
            high: dict[tuple[int, int, int], float] = {}

            def seen(node, d, own):
                for j in np.unique(own).tolist():
                    near, far = d[own == j].min(axis=0), d[own == j].max(axis=0)
                    for i in range(d.shape[1]):
                        key = (node, i, j)
                        low[key], high[key] = min(low.get(key, np.inf), near[i]), max(high.get(key, -np.inf), far[i])

            for b in batches:
                if b.num_rows:
                    tree.descend(_augment(_matrix(b.column(0)), top2), seen)
            keys = list(low)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[c] for k in keys], pa.int32()) for c in range(3)]
                + [pa.array([d[k] for k in keys], pa.float64()) for d in (low, high)], ["node", "i", "j", "low", "high"])

        self.placed = stored(self.data.select("id", "label", "vec").mapInArrow(place, "id long, label long, vec array<double>, leaf int"), "vectors-in-leaves")
        spans = self.placed.select("vec").mapInArrow(measure, "node int, i int, j int, low double, high double")
        spans = spans.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
        # a child without rows keeps an empty range and is never reached
        tree.ranges = {node: np.stack([np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)], axis=-1) for node, p in enumerate(tree.points)}
        for r in spans:
            tree.ranges[r["node"]][r["i"], r["j"]] = (r["low"], r["high"])
        filled = {r[0]: r[1] for r in self.placed.groupBy("leaf").count().collect()}
        # (first region, regions) of each leaf: small leaves share a region
        self.region, at, held = [], 0, 0
        for leaf in range(tree.leaves):
            m = filled.get(leaf, 0)
            if held and held + m > region_rows:
                at, held = at + 1, 0
            parts = max(1, math.ceil(m / region_rows))
            self.region.append((at, parts))
            at, held = (at + parts, 0) if parts > 1 else (at, held + m)
        self.filled = filled

    def search(self, asks: DataFrame, k: int, same: bool) -> DataFrame:
        """(id, key, cand, score): the k best rows of each ask's windows, by score then id.

        ``asks`` has the columns of ``_ask``: one row per anchor, with the windows
        [lo, hi] under their keys. ``same``: rows of the same label, else of others.
        """
        asks = stored(asks, "asks")
        seeds = self._scan(asks, k, same, home=True)
        last = seeds.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        last = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "least"))).alias("least"))
        closer = F.transform(F.arrays_zip("keys", "lo"), lambda z: F.greatest(z["lo"], F.coalesce(F.try_element_at("least", z["keys"]), z["lo"])))
        asks = asks.join(last, "id", "left").withColumn("lo", F.when(F.col("least").isNull(), F.col("lo")).otherwise(closer)).drop("least")
        return self._scan(asks, k, same, home=False)

    def _scan(self, asks: DataFrame, k: int, same: bool, home: bool) -> DataFrame:
        spark = asks.sparkSession
        tree, region, filled, top2, slack = self.tree, self.region, self.filled, self.top2, self.slack
        n_asks = asks.count()
        blocks = max(1, math.ceil(n_asks / self.block_asks))

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (c for whole in batches for c in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512))):
                q, lo, hi = _matrix(b.column(2)), b.column(4), b.column(5)
                if home:
                    own = tree.descend(_augment(q, top2))
                    wants = [[(region[c][0], [c])] for c in own.tolist()]
                else:
                    width = max(len(x) for x in lo)
                    norm = (q * q).sum(axis=1)
                    inner, outer = np.zeros((len(q), width)), np.full((len(q), width), -1.0)
                    for i in range(len(q)):
                        l, h = np.array(lo[i].as_py(), dtype=float), np.array(hi[i].as_py(), dtype=float)
                        r2 = top2 + norm[i] - 2 * l
                        some = (l <= h) & (r2 >= -slack)
                        outer[i, : len(l)] = np.where(some, np.sqrt(np.maximum(r2, 0)), -1.0)
                        inner[i, : len(l)] = np.sqrt(np.maximum(top2 + norm[i] - 2 * h, 0.0))
                    reach = tree.reached(np.c_[q, np.zeros(len(q))], inner, outer, slack)
                    wants = []
                    for i in range(len(q)):
                        by: dict[int, list[int]] = {}
                        for c in np.flatnonzero(reach[i]).tolist():
                            if filled.get(c):
                                for r in range(region[c][0], region[c][0] + region[c][1]):
                                    by.setdefault(r, []).append(c)
                        wants.append(sorted(by.items()))
                at = pa.array([i for i, w in enumerate(wants) for _ in w], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [c.take(at) for c in b.columns] + [pa.array([r for w in wants for r, _ in w], pa.int32()), pa.array([c for w in wants for _, c in w], pa.list_(pa.int32()))],
                    ["id", "label", "vec", "keys", "lo", "hi", "region", "leaves"])

        def unit(key, left: pa.Table, right: pa.Table) -> pa.Table:
            cols = [np.zeros(0, np.int64)] * 4
            if left.num_rows and right.num_rows:
                x, xid, xlabel, leaf = _matrix(right["vec"]), right["id"].to_numpy(), right["label"].to_numpy(), right["leaf"].to_numpy()
                q, qid, qlabel = _matrix(left["vec"]), left["id"].to_numpy(), left["label"].to_numpy()
                names = left["keys"].to_pylist()
                width = max(len(w) for w in names)
                keys, lo, hi = (np.full((len(q), width), fill, dtype=np.int64) for fill in (0, 1, 0))
                for i, (a, l, h) in enumerate(zip(names, left["lo"].to_pylist(), left["hi"].to_pylist(), strict=True)):
                    keys[i, : len(a)], lo[i, : len(a)], hi[i, : len(a)] = a, l, h
                wanted: dict[int, list[int]] = {}
                for i, cells in enumerate(left["leaves"].to_pylist()):
                    for c in cells:
                        wanted.setdefault(c, []).append(i)
                found = [cols]
                for c, who in sorted(wanted.items()):
                    rows, who = np.flatnonzero(leaf == c), np.array(who)
                    if not len(rows):
                        continue
                    a, w, b, s = scan_leaf(q[who], qid[who], qlabel[who], lo[who], hi[who], x[rows], xid[rows], xlabel[rows], same, k)
                    found.append([who[a], w, rows[b], s])
                a, w, b, s = (np.concatenate(y) for y in zip(*found, strict=True))
                top = _best(a, w, s, xid[b], k)
                cols = [qid[a[top]], keys[a[top], w[top]], xid[b[top]], s[top]]
            return pa.table({"id": pa.array(cols[0], pa.int64()), "key": pa.array(cols[1], pa.int32()), "cand": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.int64())})

        visits = asks.mapInArrow(visit, f"{_ASK}, region int, leaves array<int>").withColumn("part", F.pmod(F.xxhash64("id", F.lit("ask")), F.lit(blocks)).cast("int"))
        regions = spark.createDataFrame(list(enumerate(self.region)), "leaf int, r struct<first:int,parts:int>")
        rows = self.placed.join(F.broadcast(regions), "leaf")
        rows = rows.withColumn("region", (F.col("r.first") + F.pmod(F.xxhash64("id", F.lit("row")), F.col("r.parts"))).cast("int")).drop("r")
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = visits.groupBy("region", "part").cogroup(rows.groupBy("region", "part")).applyInArrow(unit, "id long, key int, cand long, score long")
        place = F.row_number().over(Window.partitionBy("id", "key").orderBy(F.desc("score"), "cand"))
        return found.withColumn("place", place).where(F.col("place") <= k)


def mine_negatives(table: DataFrame, anchors: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, sample_rows: int = SAMPLE_ROWS, fanout: int = FANOUT,
                   leaf_rows: int = LEAF_ROWS, region_rows: int = REGION_ROWS, block_asks: int = BLOCK_ASKS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; exact.

    ``anchors`` is a condition on ``id``. Rows without id, label or vector, with a null or
    non-finite component, or not of the table's most frequent length take no part. A row
    is no candidate of an anchor with its own id; of anchors with equal ids the one with
    the smallest label and vector is asked; other rows with equal ids are candidates of
    their own. Ties go to the smaller id. An empty table gives an empty result, and other
    columns are ignored. Scores must fit a long.
    The driver gets the sample (about ``sample_rows`` vectors), the tree's ranges and the
    sizes of its leaves.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    forest = Forest(integer_vectors(table, id_col, vec_col, F.col("label") if label is None else label), sample_rows, fanout, leaf_rows, region_rows, block_asks)
    if forest.empty:
        return table.sparkSession.createDataFrame([], schema)
    one = forest.data.where(anchors).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("a")).select("id", "a.label", "a.vec")
    open_window = [F.array(F.lit(0)).alias("keys"), F.array(F.lit(_MIN)).alias("lo"), F.array(F.lit(_MAX)).alias("hi")]
    near = stored(forest.search(one.select("id", "label", "vec", *open_window), positives, same=True), "positives")
    # whole scores n with LOW p <= 100 n <= HIGH p
    p = F.col("score")
    lo, hi = F.ceil(p * LOW / F.lit(100).cast("decimal(3,0)")), F.floor(p * HIGH / F.lit(100).cast("decimal(3,0)"))
    windows = near.select("id", F.col("place").alias("key"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi")).where("lo <= hi")
    windows = windows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("key", "lo", "hi"))).alias("w"))
    asks = one.join(windows, "id").select("id", "label", "vec", *[F.col(f"w.{c}").alias(a) for c, a in (("key", "keys"), ("lo", "lo"), ("hi", "hi"))])
    found = forest.search(asks, negatives, same=False).select("id", "key", F.col("place").alias("rank"), F.col("cand").alias("negative_id"), F.col("score").alias("negative_score"))
    pos = near.select("id", F.col("place").alias("key"), F.col("cand").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(pos, ["id", "key"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def shifted_label(id_col: str = "vec_id", label_col: str = "label") -> Column:
    """The label of a row; where the id is divisible by 7, the next one of ten."""
    own = F.col(label_col).cast("long")
    return F.when(F.col(id_col) % 7 == 0, (own + 1) % 10).otherwise(own)


ORACLE = f"""
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS vec
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]), true)),
s AS (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_dot_product(a.vec, b.vec) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
pos AS (
  SELECT a, b, score, k FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE same) WHERE k <= {POSITIVES}),
neg AS (
  SELECT pos.a, pos.b AS p, pos.score AS ps, s.b AS n, s.score AS ns,
         row_number() OVER (PARTITION BY pos.a, pos.k ORDER BY s.score DESC, s.b) AS rank
  FROM pos JOIN s ON s.a = pos.a AND NOT s.same AND {LOW} * pos.score <= 100 * s.score AND 100 * s.score <= {HIGH} * pos.score)
SELECT a AS anchor_id, p AS positive_id, CAST(rank AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score
FROM neg WHERE rank <= {NEGATIVES}
"""
