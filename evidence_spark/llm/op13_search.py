"""Ranked lexical search: best-first document intervals bounded by range-maximum tables.

The documents of a task are cut into blocks. A block holds, for each term, the posting list
of its documents in order; a term's impact on a document is a whole number that depends on
the corpus counts only. Over the impacts of all lists of a block stands a sparse table that
gives the place of the greatest impact of any range of a list in two look-ups. An interval
of documents is bounded by the sum, over an item's terms, of the greatest impact in it. The
intervals with the highest bounds are taken first, some hundred at a time: each is split at
the document of its greatest impact, which is scored exactly. A block is done when no bound
reaches the k-th best score. The best of all blocks are ranked in Spark.

The index is a written table of (block, term, places, counts), so texts are read once. Items
are searched in chunks of a bounded number of terms; only a chunk's terms and weights are
sent to the tasks. A block is bounded by its documents and postings, whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidence_spark.llm.common import small_side, stored
from evidence_spark.llm.words import chunks, word_hashes

K = 50
BLOCK_DOCS = 4096
BLOCK_POSTINGS = 2_000_000
#: Terms (with repeats across items) whose weights are sent to the tasks at once.
CHUNK_TERMS = 200_000
#: Intervals split at once.
BATCH = 256

_TERM = np.zeros(256, dtype=bool)
_TERM[0x30:0x3A] = _TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True

INDEX_SCHEMA = "block long, term long, df int, pos array<int>, tf array<int>, ids array<long>"


def text_terms(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, term hashes, first term of each row) of whole texts."""
    for i, j, data, off in chunks(col):
        terms, first = word_hashes(np.where(_TERM[data], data, np.uint8(32)), off)
        yield i, j, terms.view(np.int64), first


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values, kind))


def _index_block(block: int, ids: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
    """One header row (ids and lengths of the documents), then a row for each term."""
    order = np.lexsort((doc, term))
    doc, term, tf = doc[order], term[order], tf[order]
    cut = np.r_[np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64), len(term)]
    rows = len(cut) - 1
    header = pa.RecordBatch.from_arrays([
        pa.array([block], pa.int64()), pa.array([None], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([None], pa.list_(pa.int32())),
        _lists(n, np.array([0, len(n)]), pa.int32()), _lists(ids, np.array([0, len(ids)]), pa.int64())], names=["block", "term", "df", "pos", "tf", "ids"])
    body = pa.RecordBatch.from_arrays([
        pa.array(np.full(rows, block)), pa.array(term[cut[:-1]]), pa.array(np.diff(cut).astype(np.int32)), _lists(doc, cut, pa.int32()),
        _lists(tf, cut, pa.int32()), pa.nulls(rows, pa.list_(pa.int64()))], names=["block", "term", "df", "pos", "tf", "ids"])
    return pa.Table.from_batches([header, body]).combine_chunks().to_batches()[0]


def build_index(docs: DataFrame, id_col: str, text_col: str, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Written inverted index of the rows with an id and at least one term; see INDEX_SCHEMA."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = postings = 0

        def flush() -> pa.RecordBatch:
            ids, n, doc, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            return _index_block((task << 32) + made, ids, n, doc, term, tf)

        for b in batches:
            ids = b.column(0).to_numpy()
            for i, j, terms, first in text_terms(b.column(1)):
                n = np.diff(first)
                row = np.repeat(np.arange(j - i), n)
                order = np.lexsort((terms, row))
                r, t = row[order], terms[order]
                cut = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (t[1:] != t[:-1])]) if len(t) else np.zeros(0, np.int64)
                r, t, tf = r[cut], t[cut], np.diff(np.r_[cut, len(t)])
                lo = 0
                while lo < j - i:  # rows lo..hi go to the block at hand
                    hi = min(j - i, lo + block_docs - size)
                    # documents without a term take no place
                    mine = np.flatnonzero(n[lo:hi] > 0) + lo
                    at = np.full(j - i, -1)
                    at[mine] = size + np.arange(len(mine))
                    sel = slice(np.searchsorted(r, lo), np.searchsorted(r, hi))
                    held.append((ids[i + mine], n[mine], at[r[sel]], t[sel], tf[sel]))
                    size, postings, lo = size + len(mine), postings + sel.stop - sel.start, hi
                    if size >= block_docs or postings >= BLOCK_POSTINGS:
                        yield flush()
                        held, size, postings, made = [], 0, 0, made + 1
        if size:
            yield flush()

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(build, INDEX_SCHEMA), "search-index")


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written (row, item_id, terms): the distinct terms of every item."""
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(t[first[k]: first[k + 1]]) for i, j, t, first in text_terms(b.column(2)) for k in range(j - i)]
            cuts = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int64)
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(flat, cuts, pa.int64())], ["row", "item_id", "terms"])

    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(terms, "row long, item_id long, terms array<long>"), "search-items")


class BlockIndex:
    """Posting lists of one block with impacts and the sparse table over them."""

    def __init__(self, n_docs: int, lists: list[tuple[np.ndarray, np.ndarray]], impacts: list[np.ndarray]):
        size = np.array([len(p) for p, _ in lists], dtype=np.int64)
        self.start = np.r_[0, np.cumsum(size)][:-1]
        self.pos = np.concatenate([p for p, _ in lists]).astype(np.int64)
        self.impact = np.concatenate(impacts)
        # rank[t, d]: postings of list t before document d
        self.rank = np.zeros((len(lists), n_docs + 1), dtype=np.int32)
        self.rank[np.repeat(np.arange(len(lists)), size), self.pos + 1] = 1
        np.cumsum(self.rank, axis=1, out=self.rank)
        top = int(size.max())
        self.log = np.zeros(top + 1, dtype=np.int64)
        for length in range(2, top + 1):
            self.log[length] = self.log[length >> 1] + 1
        # table[j][i]: place of the greatest of impact[i : i + 2^j], the first of equals; ranges never leave a list
        self.table = [np.arange(len(self.pos), dtype=np.int32)]
        while 2 << (len(self.table) - 1) <= top:
            last, step = self.table[-1], 1 << (len(self.table) - 1)
            left, right = last[: len(last) - step], last[step:]
            self.table.append(np.r_[np.where(self.impact[right] > self.impact[left], right, left), last[len(last) - step:]])
        self.table = np.stack(self.table)

    def bounds(self, rank: np.ndarray, start: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bound of the scores in each interval [a, b), and the document of its greatest impact."""
        lo, hi = start + rank[a], start + rank[b]
        some = hi > lo
        j = self.log[np.where(some, hi - lo, 1)]
        last = len(self.pos) - 1
        left, right = self.table[j, np.minimum(lo, last)], self.table[j, np.clip(hi - (1 << j), 0, last)]
        vl, vr = self.impact[left], self.impact[right]
        value = np.where(some, np.maximum(vl, vr), 0)
        term = value.argmax(axis=1)
        row = np.arange(len(a))
        place = np.where(vr[row, term] > vl[row, term], right[row, term], left[row, term])
        return value.sum(axis=1), self.pos[place]

    def search(self, terms: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores) of the k best with a score above 0, ties by id; and documents scored."""
        rank, start = np.ascontiguousarray(self.rank[terms].T), self.start[terms][None, :]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = np.array([0]), np.array([len(rank) - 1])
        bound, at = self.bounds(rank, start, a, b)
        floor, seen = 1, 0
        while len(a):
            # an interval whose bound equals the k-th score may hold a smaller id
            live = bound >= floor
            a, b, bound, at = a[live], b[live], bound[live], at[live]
            if not len(a):
                break
            if len(a) > BATCH:
                order = np.argpartition(-bound, BATCH)
                now, rest = order[:BATCH], order[BATCH:]
            else:
                now, rest = np.arange(len(a)), np.zeros(0, np.int64)
            d = at[now]
            before, after = rank[d], rank[d + 1]
            own = np.where(after > before, self.impact[np.minimum(start + before, len(self.pos) - 1)], 0).sum(axis=1)
            seen += len(d)
            docs, scores = np.r_[docs, d], np.r_[scores, own]
            if len(docs) > k:
                best = np.lexsort((ids[docs], -scores))[:k]
                docs, scores = docs[best], scores[best]
            if len(docs) == k:
                floor = max(1, int(scores.min()))
            left, right = np.r_[a[now], d + 1], np.r_[d, b[now]]
            some = right > left
            left, right = left[some], right[some]
            if len(left):
                more, place = self.bounds(rank, start, left, right)
            else:
                more, place = np.zeros(0, np.int64), np.zeros(0, np.int64)
            a, b = np.r_[a[rest], left], np.r_[b[rest], right]
            bound, at = np.r_[bound[rest], more], np.r_[at[rest], place]
        order = np.lexsort((ids[docs], -scores))
        order = order[scores[order] > 0]
        return docs[order], scores[order], seen


def _searcher(asked: list[tuple[int, np.ndarray]], weights: dict[int, int], n_all: int, l_all: int, k: int):
    """Function of one block's rows: the best documents of each item, as (row, doc_id, score)."""
    def search(table: pa.Table) -> pa.Table:
        known = table["term"].to_numpy(zero_copy_only=False)
        term_rows = np.flatnonzero(~np.isnan(known)) if known.dtype.kind == "f" else np.arange(len(known))
        head = int(np.flatnonzero(table["ids"].is_valid().to_numpy(zero_copy_only=False))[0])
        ids = table["ids"][head].values.to_numpy()
        n = table["tf"][head].values.to_numpy().astype(np.int64)
        m = 100 - 50 + (50 * n * n_all) // l_all
        lists, impacts, number = [], [], {}
        for r in term_rows.tolist():
            term = table["term"][r].as_py()
            pos, tf = table["pos"][r].values.to_numpy(), table["tf"][r].values.to_numpy().astype(np.int64)
            number[term] = len(lists)
            lists.append((pos, tf))
            impacts.append(weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[pos])))
        out_row, out_id, out_score = [], [], []
        if lists:
            index = BlockIndex(len(ids), lists, impacts)
            for row, terms in asked:
                mine = np.array([number[t] for t in terms.tolist() if t in number], dtype=np.int64)
                if len(mine):
                    docs, scores, _ = index.search(mine, ids, k)
                    out_row.append(np.full(len(docs), row))
                    out_id.append(ids[docs])
                    out_score.append(scores)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_row, out_id, out_score)]
        return pa.table({"row": pa.array(flat[0], pa.int64()), "doc_id": pa.array(flat[1], pa.int64()), "score": pa.array(flat[2], pa.int64())})

    return search


def search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", k: int = K, block_docs: int = BLOCK_DOCS, chunk_terms: int = CHUNK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, best first.

    Documents without an id take no part; a null text has no term. Every row is a document
    of its own, so repeated rows take a rank each; ties go to the smaller id. Every item row
    is searched on its own, with a null id too; an item without terms, or an empty table,
    gives no row. Terms are compared by 64-bit hashes. The driver gets the weights of one
    chunk of items at a time.
    """
    spark = docs.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    index = build_index(docs, id_col, text_col, block_docs)
    lengths = F.aggregate("tf", F.lit(0).cast("long"), lambda s, x: s + x)
    n_all, l_all = index.where("ids IS NOT NULL").agg(F.sum("df").alias("n"), F.sum(lengths).alias("l")).first()
    asked = item_terms(items, item_col, item_text_col)
    total = asked.agg(F.sum(F.size("terms"))).first()[0]
    if not n_all or not total:
        return spark.createDataFrame([], schema)
    wanted = small_side(stored(asked.select(F.explode("terms").alias("term")).distinct(), "search-terms"))
    held = index.where("term IS NOT NULL").join(wanted, "term", "left_semi")
    # N documents hold a term, df this one
    weight = F.floor(1000 * F.log((2 * F.lit(n_all) + 2) / (2 * F.col("df") + 1)))
    weights = stored(held.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.cast("long").alias("w")), "search-weights")
    n_chunks = math.ceil(total / chunk_terms)
    found = None
    for c in range(n_chunks):
        part = asked.where(F.pmod(F.xxhash64("row"), F.lit(n_chunks)) == c)
        terms = part.select(F.explode("terms").alias("term")).distinct()
        known = {r["term"]: r["w"] for r in weights.join(terms, "term", "left_semi").collect() if r["w"] > 0}
        if not known:
            continue
        ask = [(r["row"], np.array(r["terms"], dtype=np.int64)) for r in part.select("row", "terms").collect()]
        run = _searcher(ask, known, n_all, l_all, k)
        names = spark.createDataFrame([(t,) for t in sorted(known)], "term long")
        rows = index.join(small_side(names), "term", "left_semi").unionByName(index.where("ids IS NOT NULL"))
        best = rows.select("block", "term", "pos", "tf", "ids").groupBy("block").applyInArrow(run, "row long, doc_id long, score long")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "doc_id"))
    top = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(small_side(asked.select("row", "item_id")), "row").select("item_id", "rank", "doc_id", "score")


ORACLE = f"""
WITH low AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, row_number() OVER () AS r
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
occ AS (SELECT r, doc_id, unnest(regexp_extract_all(t, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM low),
tf AS (SELECT r, doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM occ GROUP BY ALL),
dl AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
tot AS (SELECT CAST(count(*) AS BIGINT) AS n_all, CAST(sum(n) AS BIGINT) AS l_all FROM dl),
wt AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, tot GROUP BY term, n_all),
ask AS (
  SELECT DISTINCT q, item_id, term FROM (
    SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(text,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term
    FROM benchmark WHERE text IS NOT NULL)),
scored AS (
  SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_all) // l_all)))) AS BIGINT) AS score
  FROM ask JOIN wt USING (term) JOIN tf USING (term) JOIN dl USING (r), tot GROUP BY q, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= {K}
"""
