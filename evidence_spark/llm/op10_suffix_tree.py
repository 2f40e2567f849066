"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the text's words (A-Z lower-cased) and an end mark; the root is the smoothed
word distribution of the training texts. A context of one or more preceding words is a
candidate state when it occurs ``MIN_COUNT`` times, and its next symbols are kept when
(context, symbol) occurs ``MIN_COUNT`` times, at any size of the training table. A state
that occurs n times gives a kept symbol ``(c + mu P_suffix) / (n + mu)``, P_suffix by its
longest retained suffix; the mass left, which is mostly the share of symbols seen once, goes
to all others in proportion to the suffix's distribution, so every state sums to one.
A candidate becomes a state when its distribution diverges from that of the suffix:
``n * KL > kept symbols * ln(N) / 2`` (the gain in log likelihood against the cost of the
parameters). A token is scored by the longest suffix state that its history matches.

The tree is a table keyed by the hash of a word sequence (a gram) and grows with the texts.
Level by level, grams are counted in a shuffle, tested with joins on the level before, and
turned into one number each: what it adds to ln P of the token that ends it, and of the
token that follows it. A text's score is the sum over its grams. Uses of grams and the table
meet in buckets of gram hashes, whose number follows the training tokens; each bucket sends
back one sum for each text of a run of texts. The ``FREQUENT`` most frequent grams, the same
number at any size, are broadcast instead, so that no gram fills a bucket: a gram below rank
r has at most a share 1/r of the uses. Hashes travel packed, a row for each (run, bucket).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import id_crc, removed, stored
from evidence_spark.llm.words import chunks, mix64, word_hashes
from evidence_spark.session import scratch_path

END = np.uint64(0xE0D0E0D0E0D0E0D1)
MIN_COUNT = 2
MU = 1.0
DEPTH = 2
HELD_OUT = (5, 1)
#: Keys that a broadcast may hold (16 bytes each): symbols of the root, grams of the tree.
FREQUENT = (1 << 17, 1 << 19)
#: 64-bit words of a broadcast filter, which spares sending most absent grams while it isn't full.
FILTER_WORDS = 1 << 21
#: Tokens that a task holds at a time, and training tokens for each bucket.
RUN_TOKENS = 1_500_000
BUCKET_TOKENS = 2_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def symbol_chunks(col: pa.Array):
    """Yield (first row, symbols of consecutive texts, each with its end mark, offsets)."""
    for i, j, data, off in chunks(col):
        words, woff = word_hashes(data, off)
        out = np.empty(len(words) + (j - i), dtype=np.uint64)
        ends = woff[1:] + np.arange(j - i)
        inner = np.ones(len(out), dtype=bool)
        inner[ends] = False
        out[inner] = words
        out[ends] = END
        yield i, out, np.r_[0, ends + 1]


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def packed(buckets: int, keys: np.ndarray, columns: list[np.ndarray]):
    """(buckets that occur, for each column a binary array of the bucket's values), by hash of keys."""
    # 16-bit numbers are sorted by radix
    bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    on = np.flatnonzero(sizes)
    cuts = np.r_[0, np.cumsum(sizes[on])]
    out = []
    for column in columns:
        values = np.ascontiguousarray(column[order])
        out.append(pa.Array.from_buffers(pa.binary(), len(on), [
            None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(values)]))
    return on.astype(np.int32), out


def unpacked(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """The values of a column of packed rows, one after the other."""
    parts = [np.zeros(0, dtype=dtype)]
    for part in column.chunks:
        if len(part):
            part = part.cast(pa.large_binary())
            off = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset: part.offset + len(part) + 1]
            if off[-1] > off[0]:
                parts.append(np.frombuffer(part.buffers()[2], dtype=np.uint8)[off[0]: off[-1]].view(dtype))
    return np.concatenate(parts)


def _counts(train: DataFrame, emit) -> DataFrame:
    """(key, c): counts of the long keys that emit(text column) yields, pre-aggregated by runs of tokens."""
    def flush(parts):
        keys, c = np.unique(np.concatenate(parts), return_counts=True)
        for k in range(0, len(keys), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k: k + 200_000].view(np.int64)), pa.array(c[k: k + 200_000].astype(np.int64))], ["key", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            for part in emit(b.column(0)):
                parts.append(part)
                size += len(part)
                if size >= RUN_TOKENS:
                    yield from flush(parts)
                    parts, size = [], 0
        if parts:
            yield from flush(parts)

    return train.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _collected(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Key and count arrays of a small table."""
    table = df.toArrow()
    return table["key"].to_numpy(), table["c"].to_numpy()


def _vocabulary(train: DataFrame) -> tuple[DataFrame, int, int]:
    """(table (key, c) of all training symbols, number of tokens, number of symbols)."""
    table = stored(_counts(train, lambda col: (s for _, s, _ in symbol_chunks(col))), "lm-symbols")
    row = table.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    return table, row["n"], row["v"]


def gram_chunks(col: pa.Array, width: int):
    """Yield (first row, levels, offsets); level n - 1 is (grams, contexts, whole) of each token:
    the hash of the n symbols that end there, of the n - 1 before it, and whether the text has
    that many. The text before its first word is an end mark."""
    for i, symbols, off in symbol_chunks(col):
        start, levels = off[:-1], [(symbols, None, np.ones(len(symbols), dtype=bool))]
        for n in range(2, width + 1):
            last, _, had = levels[-1]
            ctx, whole = np.empty_like(last), np.empty_like(had)
            ctx[1:], whole[1:] = last[:-1], had[:-1]
            ctx[start], whole[start] = END, n == 2
            levels.append((mix64(ctx * _STEP + last), ctx, whole & had))
        yield i, levels, off


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bits of the column ``key``, in an array of fixed size, for ``maybe``."""
    words = keys.select(F.expr(f"key & {FILTER_WORDS - 1}L").alias("key"),
                        F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 40) & 63 AS int))").alias("c"))
    at, bits = _collected(words.groupBy("key").agg(F.bit_or("c").alias("c")))
    out = np.zeros(FILTER_WORDS, dtype=np.uint64)
    out[at] = bits.view(np.uint64)
    return out


def maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that the filter's table does not hold."""
    return (bits[keys & np.uint64(FILTER_WORDS - 1)] >> ((keys >> np.uint64(40)) & np.uint64(63))) & np.uint64(1) > 0


def frequent(table: DataFrame, value: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the most frequent rows of (key, c, value), at most ``rows``, and their summed values."""
    bucket = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    least, n = None, 0
    for b, k in sorted(table.groupBy(bucket.alias("b")).count().collect(), reverse=True):
        if (n := n + k) > rows:
            break
        least = b
    got = table.where(bucket >= least if least is not None else F.lit(False)).select("key", F.col(value).alias("c"))
    return summed(*_collected(got))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the sum of each one's values."""
    keys, which = np.unique(keys.view(np.uint64), return_inverse=True)
    return keys, np.bincount(which, values, len(keys))


def _gram_counts(train: DataFrame, n: int, before: DataFrame, buckets: int) -> DataFrame:
    """(key, ctx, par, c) of all grams of n symbols that occur ``MIN_COUNT`` times.

    ctx and par are its first and its last n - 1 symbols. Grams of which one of the two
    is not in ``before`` occur less often, and most of them are not sent.
    """
    sent = train.sparkSession.sparkContext.broadcast(key_filter(before))

    def flush(held):
        ctx, par = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, first, c = np.unique(mix64(ctx * _STEP + par), return_index=True, return_counts=True)
        at, columns = packed(buckets, keys, [ctx[first], par[first], c.astype(np.uint32)])
        return pa.RecordBatch.from_arrays([pa.array(at), *columns], ["bucket", "ctx", "par", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for _, levels, _ in gram_chunks(b.column(0), n):
                par, (_, ctx, whole) = levels[n - 2][0], levels[n - 1]
                on = whole & maybe(sent.value, par) & maybe(sent.value, ctx)
                held.append((ctx[on], par[on]))
                size += len(held[-1][0])
                if size >= RUN_TOKENS:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def count(group: pa.Table) -> pa.Table:
        ctx, par, c = (unpacked(group[k], t) for k, t in (("ctx", np.uint64), ("par", np.uint64), ("c", np.uint32)))
        keys, first, which = np.unique(mix64(ctx * _STEP + par), return_index=True, return_inverse=True)
        total = np.bincount(which, c, len(keys)).astype(np.int64)
        on = total >= MIN_COUNT
        first = first[on]
        return pa.table({"key": keys[on].view(np.int64), "ctx": ctx[first].view(np.int64), "par": par[first].view(np.int64), "c": total[on]})

    parts = train.mapInArrow(run, "bucket int, ctx binary, par binary, c binary")
    return parts.groupBy("bucket").applyInArrow(count, "key long, ctx long, par long, c long")


def fit_table(train: DataFrame, *, depth: int = DEPTH, mu: float = MU) -> tuple[DataFrame, DataFrame, int, int]:
    """(tree, vocabulary, number of training tokens, of symbols) from a table of one text column.

    tree: (key, c, v), what each use of a gram adds to the natural log of the probability of
    the token that ends it, and in a second row of the one that follows it, both with the
    gram's count c; vocabulary: (key, c, v), v the symbol's at the root.
    """
    spark = train.sparkSession
    vocabulary, total, distinct = _vocabulary(train)
    vocabulary = vocabulary.withColumn("v", F.log((F.col("c") + 0.5) / F.lit(total + 0.5 * (distinct + 1))))
    # each kept gram: its count, and ln P of its last symbol after the ones before it in the tree so far
    level = vocabulary.where(F.col("c") >= MIN_COUNT).select("key", "c", F.col("v").cast("float").alias("lp"))
    parts = [level.select("key", "c", F.col("lp").alias("v")).limit(0)]
    p = (F.col("c") + F.lit(mu) * F.exp("lp")) / (F.col("size") + F.lit(mu))
    for n in range(2, depth + 2):
        # counts are stored before they are joined, so their shuffle and those of the joins don't lie on disk together
        counts_at, grams_at = scratch_path(spark, "lm-counts"), scratch_path(spark, "lm-grams")
        counts = stored(_gram_counts(train, n, level, _buckets(total)), "lm-counts", counts_at)
        grams = counts.join(level.select(F.col("key").alias("par"), "lp"), "par").drop("par").join(
            level.select(F.col("key").alias("ctx"), F.col("c").alias("size")), "ctx")
        grams = stored(grams.select("key", "ctx", "c", "size", "lp"), "lm-grams", grams_at)
        removed(spark, counts_at)
        states = grams.groupBy("ctx").agg(
            F.max("size").alias("size"), F.count(F.lit(1)).alias("number"), F.greatest(1 - F.sum(p), F.lit(1e-12)).alias("left"),
            F.greatest(1 - F.sum(F.exp("lp")), F.lit(1e-12)).alias("left_q"), F.sum(p * (F.log(p) - F.col("lp"))).alias("kl"))
        states = states.withColumn("rest", F.log(F.col("left") / F.col("left_q")))
        states = stored(states.where(F.col("size") * (F.col("kl") + F.col("left") * F.col("rest")) > F.col("number") * F.lit(
            0.5 * float(np.log(max(total, 2))))).select("ctx", "size", F.col("rest").cast("float").alias("rest")), "lm-states")
        own = F.when(F.col("rest").isNotNull(), F.log(p)).otherwise(F.col("lp"))
        level = grams.join(states.select("ctx", "rest"), "ctx", "left").select(
            "key", "c", own.cast("float").alias("lp"), F.when(F.col("rest").isNotNull(), own - F.col("lp") - F.col("rest")).cast("float").alias("v"))
        if n <= depth:
            level = stored(level, "lm-level")
            parts.append(level.where("v IS NOT NULL").select("key", "c", "v"))
        else:
            parts.append(stored(level.where("v IS NOT NULL").select("key", "c", "v"), "lm-level"))
        removed(spark, grams_at)
        parts.append(states.select(F.col("ctx").alias("key"), F.col("size").alias("c"), F.col("rest").alias("v")))
        if n <= depth and level.isEmpty():
            break
    tree = parts[0]
    for part in parts[1:]:
        tree = tree.unionByName(part)
    return tree, vocabulary, total, distinct


def _buckets(total: int) -> int:
    """Buckets of gram hashes for a training table of so many tokens."""
    return 16 + total // BUCKET_TOKENS


# Kinds of packed rows: values of grams (32 bits) and of symbols (64 bits), uses of both, a run of texts, sums of its texts.
GRAM, SYMBOL, GRAM_USE, SYMBOL_USE, RUN, SUMS = range(6)
_PACKED = ["kind", "bucket", "run", "a", "b", "c", "d", "ids"]


def _packed_values(table: DataFrame, kind: int, buckets: int, id_type: str) -> DataFrame:
    """(key, v) of a table as packed rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emptied():
            keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
            at, columns = packed(buckets, keys, [keys, values])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), *columns], ["kind", "bucket", "a", "b"])

        for b in batches:
            held.append((b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()))
            size += b.num_rows
            if size >= RUN_TOKENS:
                yield emptied()
                held, size = [], 0
        if size:
            yield emptied()

    rows = table.select("key", "v").mapInArrow(run, "kind int, bucket int, a binary, b binary")
    empty = F.lit(None)
    return rows.select("kind", "bucket", empty.cast("long").alias("run"), "a", "b", empty.cast("binary").alias("c"),
                       empty.cast("binary").alias("d"), empty.cast(f"array<{id_type}>").alias("ids"))


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", split: tuple[int, int] = HELD_OUT,
                depth: int = DEPTH, mu: float = MU, frequent_rows: tuple[int, int] = FREQUENT) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Trained on ids whose crc32 mod ``split[0]`` is not ``split[1]`` (a null id counts as the
    empty text). Null texts are empty and have one token, the end. Equal rows give equal
    results. Without training texts both scores are 0. Other columns are not carried.
    Rows are numbered inside a task, so ``docs`` must give a task that is run again the same
    rows in the same order, as stored tables do.
    """
    spark = docs.sparkSession
    held = F.pmod(id_crc(id_col), F.lit(split[0])) == split[1]
    text = F.coalesce(F.col(text_col), F.lit(""))
    tree, vocabulary, total, distinct = fit_table(docs.where(~held).select(text.alias("t")), depth=depth, mu=mu)
    buckets, unknown = _buckets(total), float(np.log(0.5 / (total + 0.5 * (distinct + 1))))
    sent = spark.sparkContext.broadcast((*frequent(vocabulary, "v", frequent_rows[0]), *frequent(tree, "v", frequent_rows[1]), key_filter(tree)))
    id_type = docs.schema[id_col].dataType.simpleString()

    def flush(ids, number, sums, uses):
        """Packed rows of one run of texts: its texts, and the uses that no broadcast answers."""
        n = len(sums[0])
        yield pa.RecordBatch.from_arrays([
            pa.array([RUN], pa.int32()), pa.array([number % buckets], pa.int32()), pa.array([number], pa.int64()),
            *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in sums],
            pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids)], _PACKED)
        for kind, (rows, keys) in zip((SYMBOL_USE, GRAM_USE), uses, strict=True):
            at, (a, b) = packed(buckets, keys, [keys, rows])
            none = pa.nulls(len(at), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(np.full(len(at), number, np.int64)),
                                              a, b, none, none, pa.nulls(len(at), pa.list_(ids.type))], _PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, log_root, keys, values, bits = sent.value
        log_root, values = np.r_[log_root, 0.0], np.r_[values, 0.0]
        number, held_rows, size, tokens = TaskContext.get().partitionId() << 32, [], 0, 0

        def emptied():
            ids = pa.concat_arrays([h[0] for h in held_rows])
            sums = [np.concatenate([h[1][k] for h in held_rows]) for k in range(4)]
            uses = [tuple(np.concatenate([h[2][k][j] for h in held_rows]) for j in range(2)) for k in range(2)]
            return flush(ids, number, sums, uses)

        for b in batches:
            for i, levels, off in gram_chunks(b.column(1), depth + 1):
                n = len(off) - 1
                places = find(symbols, levels[0][0])
                owner = np.repeat(np.arange(size, size + n, dtype=np.uint32), np.diff(off))
                gain, rare, grams = np.zeros(len(places)), places < 0, []
                for sequence, _, whole in levels:
                    on = np.flatnonzero(whole & maybe(bits, sequence))
                    at = find(keys, sequence[on])
                    gain[on] += values[at]
                    grams.append((owner[on[at < 0]], sequence[on[at < 0]]))
                sums = (np.diff(off).astype(np.int64), np.add.reduceat((~rare).astype(np.int64), off[:-1]),
                        np.add.reduceat(log_root[places], off[:-1]), np.add.reduceat(gain, off[:-1]))
                held_rows.append((b.column(0).slice(i, n), sums, ((owner[rare], levels[0][0][rare]),
                                                                 tuple(np.concatenate(x) for x in zip(*grams, strict=True)))))
                size, tokens = size + n, tokens + len(places)
                if tokens >= RUN_TOKENS:
                    yield from emptied()
                    number, held_rows, size, tokens = number + 1, [], 0, 0
        if size:
            yield from emptied()

    def answered(group: pa.Table) -> pa.Table:
        """Uses of a bucket summed by (run, text); rows of runs go on as they are."""
        kinds = group["kind"].to_numpy()
        out = [group.filter(pa.array(kinds == RUN)).drop_columns(["bucket"])]
        for use, kind, absent, width in ((GRAM_USE, GRAM, 0.0, np.float32), (SYMBOL_USE, SYMBOL, unknown, np.float64)):
            table = group.filter(pa.array(kinds == kind))
            keys, values = summed(unpacked(table["a"], np.uint64), unpacked(table["b"], width))
            values = np.r_[values, absent]
            asked = group.filter(pa.array(kinds == use))
            for k in range(len(asked)):
                part = asked.slice(k, 1)
                rows, at = unpacked(part["b"], np.uint32), find(keys, unpacked(part["a"], np.uint64))
                if use == GRAM_USE:
                    rows, at = rows[at >= 0], at[at >= 0]
                texts, which = np.unique(rows, return_inverse=True)
                known = np.bincount(which, at >= 0, len(texts)) if use == SYMBOL_USE else np.zeros(len(texts))
                total_v, zero = np.bincount(which, values[at], len(texts)), np.zeros(len(texts))
                base, gain = (zero, total_v) if use == GRAM_USE else (total_v, zero)
                sums = (texts, known.astype(np.uint32), base, gain.astype(np.float32))
                out.append(pa.Table.from_arrays([pa.array([SUMS], pa.int32()), part["run"], *[pa.array([x.tobytes()], pa.binary()) for x in sums],
                                                 pa.nulls(1, group["ids"].type)], [c for c in _PACKED if c != "bucket"]))
        return pa.concat_tables([t.cast(out[0].schema) for t in out])

    def merged(group: pa.Table) -> pa.Table:
        """One row for each text of a run."""
        kinds = group["kind"].to_numpy()
        own, more = group.filter(pa.array(kinds == RUN)), group.filter(pa.array(kinds == SUMS))
        tokens, known, base, gain = (unpacked(own[c], t) for c, t in zip("abcd", (np.int64, np.int64, np.float64, np.float64), strict=True))
        rows, seen, log_rare, gains = (unpacked(more[c], t) for c, t in zip("abcd", (np.uint32, np.uint32, np.float64, np.float32), strict=True))
        known = known + np.bincount(rows, seen, len(tokens)).astype(np.int64)
        base = (base + np.bincount(rows, log_rare, len(tokens))) / np.log(10)
        score = base + (gain + np.bincount(rows, gains, len(tokens))) / np.log(10)
        return pa.table([pa.chunked_array([own["ids"].combine_chunks().flatten()]) if len(own) else pa.nulls(0, group["ids"].type.value_type), tokens, known, base, score],
                        names=["id", "n_tokens", "n_known", "base_score", "score"])

    columns = f"run long, a binary, b binary, c binary, d binary, ids array<{id_type}>"
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).mapInArrow(run, f"kind int, bucket int, {columns}")
    rows = rows.unionByName(_packed_values(tree, GRAM, buckets, id_type)).unionByName(_packed_values(vocabulary, SYMBOL, buckets, id_type))
    out = rows.groupBy("bucket").applyInArrow(answered, f"kind int, {columns}").groupBy("run").applyInArrow(
        merged, f"id {id_type}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), (F.pmod(id_crc("id"), F.lit(split[0])) == split[1]).alias("held_out"), "n_tokens",
                      "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
