"""Quality classifier: a sparse rule ensemble over statistics of the text.

Statistics of whole texts are computed over Arrow batches. A random forest of
shallow trees, fitted on a bounded sample of labelled rows, gives candidate rules: every
path from a root to a node is a conjunction of comparisons. A lasso logistic regression on
the rules' truth values keeps few of them; those become one Spark column expression that
scores every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import id_crc, stored
from evidence_spark.llm.words import chunks, mix64, word_hashes, word_spans

STATS = ("log_chars", "log_words", "word_len", "letters", "upper", "digits", "punct", "symbols", "exclaim", "high_bytes",
         "lines", "line_len", "odd_words", "distinct", "top_share", "repeats", "distinct_pairs", "distinct_lines", "ends")
TRAIN_ROWS = 20_000
TREES, DEPTH = 16, 3
LASSO = 5e-4
HELD_OUT = (3, 1)


def _classes() -> np.ndarray:
    """0/1 membership of each byte in the counted classes."""
    kinds = np.zeros((8, 256), dtype=np.int64)
    kinds[0, 65:91] = kinds[0, 97:123] = kinds[0, 0xC0:] = 1  # letters: ASCII or the first byte of a longer character
    kinds[1, 65:91] = 1
    kinds[2, 48:58] = 1
    kinds[3, [ord(c) for c in ".,;:'\"?()-"]] = 1
    kinds[4, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 1
    kinds[5, ord("!")] = 1
    kinds[6, 0xC0:] = 1
    kinds[7, 10] = 1
    return kinds


_KINDS = _classes()
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?"])


def _line_hashes(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Hashes of the non-empty lines of each text, from the words they hold."""
    words, woff = word_hashes(data, off)
    starts, _, _ = word_spans(data, off)
    line = np.cumsum(data == 10)[starts] if len(starts) else np.zeros(0, np.int64)
    out = []
    for a, b in zip(woff[:-1], woff[1:], strict=True):
        if a == b:
            out.append(np.zeros(0, np.uint64))
            continue
        cut = np.flatnonzero(np.r_[True, np.diff(line[a:b]) > 0])
        place = np.arange(b - a) - np.repeat(cut, np.diff(np.r_[cut, b - a]))
        out.append(np.add.reduceat(mix64(words[a:b] + place.astype(np.uint64)), cut))
    return out


def text_stats(col: pa.Array) -> np.ndarray:
    """One row of STATS per text; a text without words has zeros."""
    out = np.zeros((len(col), len(STATS)))
    for i, j, data, off in chunks(col):
        sums = np.zeros((8, len(data) + 1), dtype=np.int32)
        for k in range(8):
            np.cumsum(_KINDS[k][data], out=sums[k, 1:])
        letters, upper, digits, punct, symbols, exclaim, high, breaks = sums[:, off[1:]] - sums[:, off[:-1]]
        size = np.diff(off)
        long_tail = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum((data & 0xC0) == 0x80, out=long_tail[1:])
        chars = size - (long_tail[off[1:]] - long_tail[off[:-1]])
        starts, ends, _ = word_spans(data, off)
        words, woff = word_hashes(data, off)
        odd = (sums[0, ends] - sums[0, starts]) == 0
        full = _ENDS[data[ends - 1]] if len(ends) else np.zeros(0, bool)
        solid = ends - starts
        lines = _line_hashes(data, off)
        for k in range(j - i):
            a, b = woff[k], woff[k + 1]
            if a == b:
                continue
            n, c, own = b - a, float(chars[k]), words[a:b]
            _, counts = np.unique(own, return_counts=True)
            same = own[1:] == own[:-1]
            pairs = len(np.unique(own[1:] * np.uint64(3) ^ own[:-1])) / (n - 1) if n > 1 else 1.0
            out[i + k] = (
                np.log1p(c), np.log1p(n), solid[a:b].sum() / n, letters[k] / c, upper[k] / max(letters[k], 1), digits[k] / c,
                punct[k] / c, symbols[k] / c, exclaim[k] / c, high[k] / c, breaks[k] + 1, c / (breaks[k] + 1),
                odd[a:b].mean(), len(counts) / n, counts.max() / n, same.mean() if n > 1 else 0.0, pairs,
                len(np.unique(lines[k])) / len(lines[k]), full[a:b].mean())
    return out


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: the id), then STATS, one row per document."""
    keep = [id_col] if keep is None else keep
    schema = docs.select(*keep).schema
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + [f"{s} double" for s in STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = text_stats(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *[pa.array(stats[:, k]) for k in range(len(STATS))]], [*keep, *STATS])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, fields)


def tree_rules(debug: str) -> list[tuple]:
    """Every path of the printed trees as a sorted tuple of (feature, '<=' or '>', bound);
    bounds on one feature and side within a path are merged to the tightest."""
    rules, path = [], []
    for line in debug.splitlines():
        m = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)", line)
        if re.match(r"\s*Tree \d+", line):
            path = []
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, int(m[3]), m[4], float(m[5]))]
        tight: dict = {}
        for _, f, side, bound in path:
            old = tight.get((f, side))
            tight[f, side] = bound if old is None else (min if side == "<=" else max)(old, bound)
        rules.append(tuple(sorted((f, s, b) for (f, s), b in tight.items())))
    return sorted(set(rules))


def rule_column(rule: tuple, names=STATS) -> Column:
    """A rule as a Spark condition on the statistics."""
    out = F.lit(True)
    for f, side, bound in rule:
        out = out & ((F.col(names[f]) <= bound) if side == "<=" else (F.col(names[f]) > bound))
    return out


def fit_rules(train: DataFrame, *, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 7):
    """(intercept, [(rule, weight), ...]) from rows of STATS and ``label`` (0.0 or 1.0).

    With one class only, or no row, there are no rules and the intercept is the smoothed
    log-odds of the labels.
    """
    seen = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
    if len(seen) < 2:
        return float(np.log((seen.get(1.0, 0) + 1) / (seen.get(0.0, 0) + 1))), []
    rows = train.select("label", array_to_vector(F.array(*STATS)).alias("x"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, maxBins=64, seed=seed,
                                    featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(rows)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return float(np.log((seen[1.0] + 1) / (seen[0.0] + 1))), []
    truth = train.select("label", array_to_vector(F.array(*[rule_column(r).cast("double") for r in rules])).alias("x"))
    model = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=lasso, standardization=False,
                               maxIter=50).fit(truth)
    weights = model.coefficients.toArray()
    return float(model.intercept), [(r, float(w)) for r, w in zip(rules, weights, strict=True) if w]


def score_column(intercept: float, rules: list) -> Column:
    """Probability of label 1, as one expression over the statistics."""
    total = F.lit(intercept)
    for rule, weight in rules:
        total = total + F.when(rule_column(rule), F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  keep: list[str] | None = None, train_rows: int = TRAIN_ROWS, split: tuple[int, int] = HELD_OUT) -> DataFrame:
    """The columns ``keep`` (default: the id), held_out, score and predicted for every document.

    Labels are learned only from ids whose crc32 mod ``split[0]`` is not ``split[1]``, from
    about ``train_rows`` labelled documents at most, chosen by a hash of the id over all of
    them. An id labelled more than once counts by its mean label, rounded (0.5: 1); null
    labels are left out. Null texts count as empty, and an empty text is scored by its zero
    statistics. Columns of ``docs`` named like the results are replaced.
    """
    keep = [c for c in (keep or [id_col]) if c not in ("held_out", "score", "predicted")]
    held = (F.pmod(id_crc(id_col), F.lit(split[0])) == split[1])
    # statistics under another name could clash with kept columns: the kept ones travel in a struct
    packed = docs.select(F.struct(*keep).alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held).groupBy(F.col(id_col).alias("__id")).agg(
        F.when(F.avg(label_col) >= 0.5, 1.0).otherwise(0.0).alias("label"))
    n = marked.count()
    share = min(1.0, train_rows / n) if n else 1.0
    # the sample's ids and labels are a few hundred KB: train_rows bounds them
    sample = marked.where(F.pmod(F.xxhash64("__id", F.lit("quality")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    chosen = packed.join(F.broadcast(sample), "__id").select("__id", "label", "__t")
    train = stored(document_stats(chosen, "__id", "__t", ["label"]), "quality-train").coalesce(2)
    intercept, rules = fit_rules(train)
    stats = document_stats(packed, "__id", "__t", ["__row", "__id"])
    out = stats.withColumn("score", score_column(intercept, rules)).withColumn(
        "held_out", F.pmod(id_crc("__id"), F.lit(split[0])) == split[1])
    return out.select("__row.*", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
