"""Document fingerprints by consistent weighted sampling.

The terms of a text are its distinct word shingles (``width`` words, lower-cased A-Z),
weighted by how often they occur. For each of ``samples`` positions and each term, a hash
gives r, c ~ Gamma(2, 1) and b ~ U(0, 1). A term of weight S is sampled at
``t = floor(ln S / r + b)``, ``ln y = r (t - b)`` with rank ``ln a = ln c - ln y - r``; the term
of the lowest rank is the sample. (term, t) fixes the rank's value, so that value stands for
the sample in the fingerprint: two fingerprints agree in a position with probability equal
to the generalised Jaccard similarity sum(min) / sum(max) of the weights.

Uniform numbers have 16 bits a variable; quantiles come from a table. Ranks fall as weights
grow, so the minimum over all *occurrences* at weight 1 and over repeated terms at their
full weight is the minimum over terms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.words import mix64, shingles, string_words

SAMPLES = 64
WIDTH = 5
SEED = 20240229
_LEVELS = 1 << 16
_BLOCK = 16


def _gamma2_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x)."""
    x = np.concatenate([np.logspace(-6, 0, 200_000), np.linspace(1, 40, 400_000)[1:]])
    p = -np.expm1(-x) - x * np.exp(-x)
    return np.interp((np.arange(_LEVELS) + 0.5) / _LEVELS, p, x)


class WeightedSampler:
    """Consistent weighted samples of bags of term hashes."""

    def __init__(self, samples: int = SAMPLES, seed: int = SEED):
        self.samples = samples
        self.seeds = mix64(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        gamma = _gamma2_quantiles()
        self.r = gamma.astype(np.float32)
        self.ln_c = np.log(gamma).astype(np.float32)
        self.b = ((np.arange(_LEVELS) + 0.5) / _LEVELS).astype(np.float32)
        self.b_less_1 = self.b - np.float32(1)

    def _uniforms(self, h: np.ndarray) -> np.ndarray:
        """16-bit numbers, shape (terms, samples, 4); the first of the four is not used."""
        x = (h[:, None] ^ self.seeds[None, :]) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        return x.view(np.uint16).reshape(len(h), self.samples, 4)

    def ranks(self, h: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """ln a of each term and sample; without weights, of weight 1."""
        u = self._uniforms(h)
        r = self.r[u[:, :, 3]]
        if weights is None:
            return self.ln_c[u[:, :, 2]] + r * self.b_less_1[u[:, :, 1]]
        b_less_1 = self.b_less_1[u[:, :, 1]]
        t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + self.b[u[:, :, 1]])
        return self.ln_c[u[:, :, 2]] + r * (b_less_1 - t)  # as above where t is 0, bit for bit

    def minima(self, h: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Lowest rank of each sample over the terms; infinite without terms."""
        low = np.full(self.samples, np.inf, dtype=np.float32)
        for i in range(0, len(h), 1024):
            part = self.ranks(h[i: i + 1024], None if weights is None else weights[i: i + 1024])
            np.minimum(low, part.min(axis=0), out=low)
        return low

    def repeated(self, h: np.ndarray) -> np.ndarray:
        """Minima over the terms that occur more than once, at their whole weight."""
        terms, counts = np.unique(h, return_counts=True)
        many = counts > 1
        return self.minima(terms[many], counts[many])

    def bag(self, h: np.ndarray) -> np.ndarray:
        """Minima of a bag of occurrences."""
        return np.minimum(self.minima(h), self.repeated(h))


class SampledText:
    """Occurrences of one text with block minima, from which minima of any run follow."""

    def __init__(self, text: str, sampler: WeightedSampler, width: int):
        self.text, self.sampler = text, sampler
        self.terms = shingles(string_words(text), width)
        whole = len(self.terms) // _BLOCK
        self.blocks = np.empty((whole, sampler.samples), dtype=np.float32)
        step = 64
        for i in range(0, whole, step):
            j = min(i + step, whole)
            part = sampler.ranks(self.terms[i * _BLOCK: j * _BLOCK])
            self.blocks[i:j] = part.reshape(j - i, _BLOCK, sampler.samples).min(axis=1)
        self.low = np.minimum(self.run(0, len(self.terms)), sampler.repeated(self.terms))

    def run(self, lo: int, hi: int) -> np.ndarray:
        """Minima over the occurrences lo..hi-1 at weight 1."""
        i, j = -(-lo // _BLOCK), hi // _BLOCK
        if i >= j:
            return self.sampler.minima(self.terms[lo:hi])
        edges = np.concatenate([self.terms[lo: i * _BLOCK], self.terms[j * _BLOCK: hi]])
        return np.minimum(self.blocks[i:j].min(axis=0), self.sampler.minima(edges))


def edited_text(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _prefix_run(same: np.ndarray) -> int:
    return len(same) if same.all() else int(np.argmin(same))


def edited_minima(own: SampledText, following: SampledText, edited: str, width: int) -> np.ndarray:
    """Minima of the edited text; runs it shares with the two texts are taken from their blocks."""
    words = string_words(edited)
    terms = shingles(words, width)
    n = min(len(terms), len(own.terms))
    head = _prefix_run(terms[:n] == own.terms[:n]) if n else 0
    low = own.run(0, head)
    shift = len(words) - len(string_words(following.text[: len(own.text) // 2]))
    a = max(head, shift)
    tail = min(len(terms) - a, len(following.terms) - (a - shift))
    lo = hi = a
    if tail > 0:
        same = terms[a: a + tail] == following.terms[a - shift: a - shift + tail]
        if same.any():
            lo = a + int(np.argmax(same))
            hi = lo + _prefix_run(same[lo - a:])
            low = np.minimum(low, following.run(lo - shift, hi - shift))
    fresh = np.concatenate([terms[head:lo], terms[hi:]])
    return np.minimum(np.minimum(low, own.sampler.minima(fresh)), own.sampler.repeated(terms))


def as_string(low: np.ndarray) -> str:
    """Fingerprint text: 8 hex digits a sample."""
    return low.astype(">f4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of samples that agree; estimates the generalised Jaccard similarity."""
    return float(np.mean(a == b))


def neighbour_order(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """(bucket, ghost, id, text): rows of one bucket stand together, by descending id.

    The first row of each bucket is also given to the bucket before it as a ghost, after
    its own rows, so every row is followed by its successor; the first of all follows the
    last. Null ids come last; equal ids are ordered by text. Bucket bounds and the largest
    id of each bucket are the only things brought to the driver: ``buckets`` numbers.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = rows.select(F.percentile_approx(F.col("id").cast("double"), [i / buckets for i in range(1, buckets)],
                                           buckets * 20)).first()[0] or []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    rows = rows.withColumn("__d", F.col("id").cast("double"))
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="__d", outputCol="bucket", handleInvalid="keep").transform(rows)
    else:
        rows = rows.withColumn("bucket", F.lit(0))
    rows = rows.withColumn("bucket", F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.col("bucket").cast("int"))).drop("__d")
    heads = sorted(((r[0], r[1]) for r in rows.groupBy("bucket").agg(F.max("id")).collect()), key=lambda r: -r[0])
    before = [(b, head, heads[i - 1][0]) for i, (b, head) in enumerate(heads)]
    spark = docs.sparkSession
    links = spark.createDataFrame(before, f"bucket int, head {docs.schema[id_col].dataType.simpleString()}, previous int")
    here = F.struct(F.col("bucket"), F.lit(0).alias("ghost"))
    there = F.struct(F.col("previous").alias("bucket"), F.lit(1).alias("ghost"))
    at = F.when(F.col("id").eqNullSafe(F.col("head")), F.array(here, there)).otherwise(F.array(here))
    placed = rows.join(F.broadcast(links), "bucket").select(F.explode(at).alias("at"), "id", "text")
    placed = placed.select("at.bucket", "at.ghost", "id", "text")
    return placed.repartition("bucket").sortWithinPartitions("bucket", "ghost", F.col("id").desc_nulls_last(), "text")


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES,
                      width: int = WIDTH, seed: int = SEED, buckets: int | None = None) -> DataFrame:
    """Fingerprint every text and its edited text.

    One row per input row: the id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Null texts count as empty; an empty text (no words) has the
    fingerprint of no terms, which is like itself (1) and unlike any other (0). A single row
    follows itself. Other columns are not carried.
    """
    spark = docs.sparkSession
    buckets = buckets or max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = neighbour_order(docs, id_col, text_col, buckets)
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = WeightedSampler(samples, seed)
        open_row, done, out = None, None, []

        def close(row, after: SampledText):
            key, own = row
            edited = edited_text(own.text, after.text)
            low = edited_minima(own, after, edited, width)
            out.append((key, len(own.text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                        as_string(own.low), as_string(low), likeness(own.low, low), likeness(own.low, after.low)))

        def flush():
            rows = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i) for i in range(4)]
            types = [cols[2].type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            for i in range(batch.num_rows):
                bucket, ghost, key = cols[0][i].as_py(), cols[1][i].as_py(), cols[2][i].as_py()
                if ghost and done == bucket:
                    continue
                now = SampledText(cols[3][i].as_py(), sampler, width)
                if open_row is not None:
                    close(open_row, now)
                open_row = None if ghost else (key, now)
                if ghost:
                    done = bucket
                if len(out) >= 512:
                    yield flush()
        if out:
            yield flush()

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return ordered.mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, "
                                   "edited_fingerprint string, near_edited double, near_next double")
