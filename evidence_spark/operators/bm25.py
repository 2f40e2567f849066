"""BM25 overlap between golden quotes and response quotes.

The corpus of each pair is its own golden quotes (a handful to some hundred short
"documents"), so every statistic is local to one row. Best matches are computed row by row
in Arrow batches: tokens become numbers, each golden term has a posting list of (quote,
weight), and the scores of a block of response quotes are one weighted count over the
postings of their tokens. Work is linear in the postings met, memory is bounded by the
block, and nothing is shuffled. (Native higher-order functions have no hash lookup inside
a row, so they search linearly for every token: quadratic in the text of a row.)

Okapi BM25 with an epsilon floor (k1=1.5, b=0.75, epsilon=0.25):
  raw(t)  = ln(N - n(t) + 0.5) - ln(n(t) + 0.5)
  mean    = average of raw over the distinct terms (negatives included)
  idf(t)  = epsilon * mean if raw(t) < 0 else raw(t)
  w(t, i) = idf(t) * tf(t,i)*(k1+1) / (tf(t,i) + k1*(1 - b + b*dl(i)/avgdl))
  score(Q, i) = sum over query tokens q (repeats counted) of w(q, i); unknown q adds 0
Best match of a quote = max over all N golden quotes (a non-matching quote scores 0);
result = min(1, sum best(response) / sum best(gold)), 0 when either side has no quote
or the gold sum is 0; rounded to 4 places. Sums run in token order, as the original.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidence_spark.functions.metrics import round_half_up
from evidence_spark.functions.text import tokenize

# BM25 parameters of the metric being reproduced.
K1 = 1.5
B = 0.75
EPSILON = 0.25

# |perfect| below this is treated as 0: the sum order of an independent engine may
# leave a rounding residue where the exact value is 0.
ZERO_TOLERANCE = 1e-12
# Cells (response quotes x golden quotes) scored at once.
BLOCK_CELLS = 1 << 20
# Tokens of the rows that are scored together.
BLOCK_TOKENS = 1 << 16


class GoldIndex:
    """Posting lists of the golden quotes of one row."""

    def __init__(self, quotes: list[list[str]]):
        self.quotes, self.n = quotes, len(quotes)
        counts = [Counter(q) for q in quotes]
        self.term = {t: k for k, t in enumerate(dict.fromkeys(t for c in counts for t in c))}
        term = np.array([self.term[t] for c in counts for t in c], dtype=np.int64)
        tf = np.array([f for c in counts for f in c.values()], dtype=float)
        doc = np.repeat(np.arange(self.n), [len(c) for c in counts])
        df = np.bincount(term, minlength=len(self.term))
        raw = np.log(self.n - df + 0.5) - np.log(df + 0.5)
        mean = sum(raw.tolist()) / max(len(raw), 1)
        idf = np.where(raw < 0, EPSILON * mean, raw)
        length = np.array([len(q) for q in quotes], dtype=float)
        average = length.sum() / max(self.n, 1)
        weight = idf[term] * (tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * length[doc] / max(average, 1e-300))))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.start = np.r_[0, np.cumsum(df)]

    def best(self, queries: list[list[str]]) -> np.ndarray:
        """Best score of each query over all golden quotes."""
        out = np.zeros(len(queries))
        step = max(1, BLOCK_CELLS // max(self.n, 1))
        for lo in range(0, len(queries), step):
            part = queries[lo: lo + step]
            term = np.array([self.term.get(t, -1) for q in part for t in q], dtype=np.int64)
            query = np.repeat(np.arange(len(part)), [len(q) for q in part])
            known = term >= 0
            term, query = term[known], query[known]
            size = self.start[term + 1] - self.start[term]
            ends = np.cumsum(size)
            posting = np.repeat(self.start[term] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
            cells = np.bincount(np.repeat(query, size) * self.n + self.doc[posting], weights=self.weight[posting],
                                minlength=len(part) * self.n)
            out[lo: lo + step] = cells.reshape(len(part), self.n).max(axis=1)
        return out


class QuoteBlock:
    """Tokens of the golden and response quotes of some rows as numbers, and the meetings of equal
    tokens of a row. Tokens are numbered by (row of golden quotes, token)."""

    def __init__(self, golds: list[list[list[str]]], rows: list[int], responses: list[list[list[str]]], distinct: bool = False):
        """``rows`` names the golden quotes of each response; with ``distinct`` a token counts once a quote."""
        numbers: defaultdict[str, int] = defaultdict(count().__next__)
        number = numbers.__getitem__

        def flat(side: list[list[list[str]]], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """(token, quote of each token, length of each quote, first quote of each row)."""
            first = np.r_[0, np.cumsum([len(q) for q in side], dtype=np.int64)]
            length = np.array([len(t) for q in side for t in q], dtype=np.int64)
            token = np.fromiter(map(number, chain.from_iterable(chain.from_iterable(side))), dtype=np.int64, count=int(length.sum()))
            quote = np.repeat(np.arange(len(length)), length)
            row = np.repeat(owner, np.diff(first))
            return token + (row[quote] << 32), quote, length, first

        if distinct:
            golds, responses = ([[set(t) for t in q] for q in side] for side in (golds, responses))
        self.rows = np.array(rows, dtype=np.int64)
        gold, self.gold_quote, self.gold_length, self.gold_first = flat(golds, np.arange(len(golds)))
        self.response, self.quote, self.length, self.first = flat(responses, self.rows)
        self.known, self.term = np.unique(gold, return_inverse=True)
        self.gold = gold

    def postings(self, term: np.ndarray, weight: np.ndarray | None = None):
        """Lay out the golden entries (quote, weight) by term, in the order they have."""
        order = np.argsort(term, kind="stable")
        self.start = np.r_[0, np.cumsum(np.bincount(term, minlength=len(self.known)))]
        return order, None if weight is None else weight[order]

    def meet(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``token``, posting) of every meeting, in the order of ``token``."""
        at = np.searchsorted(self.known, token)
        at[at == len(self.known)] = 0
        found = np.flatnonzero(self.known[at] == token) if len(self.known) else np.zeros(0, dtype=np.int64)
        term = at[found]
        size = self.start[term + 1] - self.start[term]
        ends = np.cumsum(size)
        return np.repeat(found, size), np.repeat(self.start[term] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def quote_lists(column: pa.Array) -> list[list[str]]:
    """The quotes of each row of an Arrow column of arrays; none for a null."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
    quotes = column.flatten().to_pylist()
    return [quotes[a:b] for a, b in zip([0, *ends], ends)]


def quote_blocks(gold: list[list[str]], response: list[list[str]]):
    """Rows in small groups, each as (golds, rows, responses) for a :class:`QuoteBlock`.

    Golden quotes that stand in several rows on end are given once. Cells and tokens of a
    group are bounded, but for a single row, which is a group of its own where it is larger.
    """
    golds, rows, responses, tokens, cells, last = [], [], [], 0, 0, None
    for g, r in zip(gold, response, strict=True):
        same = golds and g == last
        split = golds[-1] if same else [q.lower().split() for q in g]
        asked = [q.lower().split() for q in r]
        more = sum(map(len, asked)) + (0 if same else sum(map(len, split)))
        size = len(g) * (len(r) + (0 if same else len(g)))
        if rows and (tokens + more > BLOCK_TOKENS or cells + size > BLOCK_CELLS):
            yield golds, rows, responses
            golds, rows, responses, tokens, cells, same = [], [], [], 0, 0, False
        if not same:
            golds.append(split)
        rows.append(len(golds) - 1)
        responses.append(asked)
        last, tokens, cells = g, tokens + more, cells + size
    if rows:
        yield golds, rows, responses


def _cells(row: np.ndarray, quotes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First cell of each quote, of n[row] cells in all: (start of each quote, their sum last)."""
    width = np.repeat(n[row], quotes)
    return np.r_[0, np.cumsum(width)], width


def _block_matches(golds: list, rows: list[int], responses: list) -> tuple[list[np.ndarray], list[float]]:
    """Best scores of the response quotes of each row, and the golden quotes' own sum; the sums
    are those of :class:`GoldIndex`, in the same order, for all rows at once."""
    block = QuoteBlock(golds, rows, responses)
    n = np.diff(block.gold_first)
    # (quote, term) entries of the golden side in the order in which they first stand
    entry, first, tf = np.unique(block.gold_quote * len(block.known) + block.term, return_index=True, return_counts=True)
    order = np.argsort(first, kind="stable")
    entry, tf = entry[order], tf[order].astype(float)
    doc, term = np.divmod(entry, max(len(block.known), 1))
    df = np.bincount(term, minlength=len(block.known))
    row_of_term = block.known >> 32
    raw = np.log(n[row_of_term] - df + 0.5) - np.log(df + 0.5)
    seen = np.argsort(np.unique(term, return_index=True)[1], kind="stable")  # terms of a row as they first stand
    ordered, ends = raw[seen].tolist(), np.r_[0, np.cumsum(np.bincount(row_of_term, minlength=len(golds)))].tolist()
    mean = np.array([sum(ordered[a:b]) / max(b - a, 1) for a, b in zip(ends, ends[1:])])
    idf = np.where(raw < 0, EPSILON * mean[row_of_term], raw)
    quote_row = np.repeat(np.arange(len(golds)), n)
    length = block.gold_length.astype(float)
    average = np.bincount(quote_row, weights=length, minlength=len(golds)) / np.maximum(n, 1)
    norm = np.maximum(average, 1e-300)[quote_row[doc]]
    weight = idf[term] * (tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * length[doc] / norm)))
    order, weight = block.postings(term, weight)
    doc = doc[order]
    local = doc - block.gold_first[quote_row[doc]]

    def best(token: np.ndarray, quote: np.ndarray, row: np.ndarray, quotes: np.ndarray) -> np.ndarray:
        start, width = _cells(row, quotes, n)
        asked, posting = block.meet(token)
        cells = np.bincount(start[quote[asked]] + local[posting], weights=weight[posting], minlength=int(start[-1]))
        out = np.zeros(len(width))
        some = np.flatnonzero(width)
        if len(some):
            out[some] = np.maximum.reduceat(cells, start[some])
        return out

    own = best(block.gold, block.gold_quote, np.arange(len(golds)), n).tolist()
    perfect = [float(sum(own[a:b])) for a, b in zip(block.gold_first, block.gold_first[1:])]
    score = best(block.response, block.quote, block.rows, np.diff(block.first))
    found = [score[a:b] if n[r] else score[:0] for a, b, r in zip(block.first, block.first[1:], rows)]
    return found, [perfect[r] for r in rows]


_MATCHES = T.StructType([T.StructField("best", T.ArrayType(T.DoubleType())), T.StructField("perfect", T.DoubleType())])


@F.arrow_udf(_MATCHES)
def _match(gold: pa.Array, response: pa.Array) -> pa.Array:
    """Best score of every response quote, and the sum of the golden quotes' own best scores;
    both are empty or 0 without golden quotes. Rows are scored in groups; golden quotes of a
    document are indexed once where its rows stand together, as they do after the join."""
    best, own = [], []
    for golds, rows, responses in quote_blocks(quote_lists(gold), quote_lists(response)):
        if len(rows) > 1:
            found, perfect = _block_matches(golds, rows, responses)
            best += found
            own += perfect
        else:  # maybe larger than a group: its response quotes are scored in blocks
            index = GoldIndex(golds[0])
            best.append(index.best(responses[0]) if golds[0] else np.zeros(0))
            own.append(float(sum(index.best(index.quotes).tolist())) if golds[0] else 0.0)
    ends = np.cumsum([0, *map(len, best)])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0), *best])))
    return pa.StructArray.from_arrays([lists, pa.array(own, pa.float64())], names=["best", "perfect"])


def add_bm25(df: DataFrame, gold_quotes: str, resp_quotes: str, out: str = "bm25") -> DataFrame:
    """Add the BM25 score of two columns of quote arrays."""
    df = df.withColumn("_bm", _match(F.col(gold_quotes), F.col(resp_quotes)))
    perfect = F.col("_bm.perfect")
    system = F.aggregate(F.col("_bm.best"), F.lit(0.0), lambda acc, x: acc + x)
    none = (F.size(F.col(gold_quotes)) == 0) | (F.size(F.col(resp_quotes)) == 0) | (F.abs(perfect) < ZERO_TOLERANCE)
    safe = F.when(F.abs(perfect) < ZERO_TOLERANCE, F.lit(1.0)).otherwise(perfect)
    score = F.when(none, F.lit(0.0)).otherwise(round_half_up(F.least(F.lit(1.0), system / safe), 4))
    return df.withColumn(out, score).drop("_bm")


def best_matches(pairs: DataFrame, keys: list[str], gold_quotes: str, resp_quotes: str) -> DataFrame:
    """T6 as a long table: one row per response quote with its best score."""
    scored = pairs.select(*keys, _match(F.col(gold_quotes), F.col(resp_quotes)).alias("_bm"))
    return scored.select(*keys, F.posexplode("_bm.best").alias("ridx", "best")).withColumn("ridx", F.col("ridx").cast("bigint"))


def term_statistics(gold: DataFrame, key: str, gold_quotes: str) -> DataFrame:
    """T5 as a long table: one row per (key, term) with N, avgdl, df and idf.

    Relational: tokens of each quote, distinct per quote, counted by (key, term).
    """
    quotes = gold.select(F.col(key), F.posexplode(gold_quotes).alias("gidx", "q")).withColumn("toks", tokenize("q"))
    size = quotes.groupBy(key).agg(F.count(F.lit(1)).alias("n_quotes"), F.avg(F.size("toks")).alias("avgdl"))
    df = quotes.select(key, F.explode(F.array_distinct("toks")).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("df"))
    n, m = F.col("n_quotes"), F.col("df")
    raw = df.join(size, key).withColumn("raw", F.log(n - m + F.lit(0.5)) - F.log(m + F.lit(0.5)))
    mean = raw.groupBy(key).agg(F.avg("raw").alias("mean"))
    idf: Column = F.when(F.col("raw") < 0, F.lit(EPSILON) * F.col("mean")).otherwise(F.col("raw"))
    return raw.join(mean, key).select(key, "n_quotes", "avgdl", "token", "df", idf.alias("idf"))
