"""N-gram Jaccard join with parity sketches.

A document's set holds its distinct word shingles as 64-bit hashes. Two sets link when
``100 |A & B| >= percent |A | B|``, which bounds their symmetric difference:
``d <= (|A| + |B|) (100 - percent) / (100 + percent)``.

Sizes fall into bands such that linked sets lie in one band or in two neighbouring ones; a
set takes part in its own band and the next. In a band whose sets differ in at most D
shingles, each shingle flips one bit of one of D + 1 words (the parity sketch). A shingle in
one set alone changes at most one word, so two linked sets have an equal word (pigeonhole),
and the number of differing bits is at most d. Words meet by the XOR of their shingles' whole
hashes, which tells different shingles apart where one bit would not; a few spare words
make up for empty ones. The join is on (band, place, word).

Sets that are equal are one node from the start. Buckets of equal words do not emit their
pairs. First every set is held against a few others, the smallest nodes of most of its buckets;
links found so are merged into components. Then members of different components of a bucket
are compared with each other, in blocks, sketch against sketch, and a piece of work hands on
a few candidates of each member only: the smallest and the likest ones. Only buckets with a candidate not handed on
are compared once more, with the components grown by then, and now hand on all that are left.
Candidates are verified on the whole sets. So no link between different components is lost,
and a group of near copies costs about one verification a member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_spark.llm.common import removed, small_side, stored
from evidence_spark.llm.components import components
from evidence_spark.llm.words import mix64, shingles, texts_words
from evidence_spark.session import scratch_path

WIDTH = 3
PERCENT = 90
BLOCK = 512
#: Bits of the map of shared words that workers get (4 MB).
BITMAP_BITS = 25
#: Rows that a worker turns into sketch words at a time.
SLICE = 512
#: Words of the short sketch that bucket members carry.
SHORT_WORDS = 16
SHORT = [f"f{k}" for k in range(SHORT_WORDS)]
#: Smallest nodes of its buckets that a node is held against first.
HUBS = 3
#: Words of a whole sketch that SHORT_WORDS stand for: sketches of more words, whose short one would
#: be full, are folded to a multiple of SHORT_WORDS besides.
FOLD_WORDS = 224
#: Pairs whose longer folds a worker compares at a time.
FOLD_PAIRS = 4096


def max_difference(total: int, percent: int = PERCENT) -> int:
    """Largest symmetric difference of two linked sets of ``total`` elements together."""
    return total * (100 - percent) // (100 + percent)


def band_table(percent: int, top: int) -> list[int]:
    """Smallest size of each band, until ``top`` is passed: sizes of linked sets lie in one
    band or in neighbouring ones."""
    lows = [1]
    while lows[-1] <= top:
        lows.append(lows[-1] * 100 // percent + 1)
    return lows


def sketch_size(lows: list[int], band: int, percent: int) -> tuple[int, int]:
    """(words, spare) of a band's sketches: sets of the band differ in at most words - spare - 1
    elements, so linked sets have at least spare + 1 equal words. The spare covers the empty
    words that the band's smallest sets are likely to have; (0, 0) where sets cannot differ."""
    most = max_difference(2 * (lows[band + 1] - 1), percent)
    if most == 0:
        return 0, 0
    smallest, spare = lows[max(band - 1, 0)], 0
    for _ in range(4):
        empty = (most + 1 + spare) * math.exp(-smallest / (most + 1 + spare))
        spare = math.ceil(empty + 4 * math.sqrt(empty))
    return most + 1 + spare, spare


def _words_of(h: np.ndarray, words: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32)).astype(np.int64)


def xor_words(terms: np.ndarray, words: int) -> np.ndarray:
    """XOR of the whole hashes of each word's terms: equal where the word's terms are the same."""
    h = mix64(terms ^ np.uint64(words))
    out = np.zeros(words, dtype=np.uint64)
    np.bitwise_xor.at(out, _words_of(h, words), mix64(h))
    return out


def sketch(terms: np.ndarray, words: int) -> np.ndarray:
    """Parity sketch: every term flips one bit of its 64-bit word."""
    h = mix64(terms ^ np.uint64(words))
    out = np.zeros(words, dtype=np.uint64)
    np.bitwise_xor.at(out, _words_of(h, words), np.uint64(1) << (h & np.uint64(63)))
    return out


def set_sketches(col: pa.Array, width: int, percent: int, make) -> tuple[list, list, pa.Array]:
    """Of each text: set size, set name (None: empty), and (band, make(terms, words)) for its own
    band and the next, where sets of the band may differ at all."""
    lows = band_table(percent, 1 << 20)
    shape = [sketch_size(lows, b, percent)[0] for b in range(len(lows) - 1)]
    sizes, nodes, bands, words, cuts, rows = [], [], [], [], [0], [0]
    for _, w in texts_words(col):
        s = np.unique(shingles(w, width))
        n = len(s)
        if n >= lows[-2]:
            lows = band_table(percent, 4 * n)
            shape = [sketch_size(lows, b, percent)[0] for b in range(len(lows) - 1)]
        sizes.append(n)
        nodes.append(set_hash(s) if n else None)
        own = int(np.searchsorted(lows, n, side="right")) - 1
        for band in (own, own + 1) if n else ():
            if shape[band]:
                bands.append(band)
                words.append(make(s, shape[band]))
                cuts.append(cuts[-1] + shape[band])
        rows.append(len(bands))
    flat = pa.array(np.concatenate(words).view(np.int64) if words else np.zeros(0, np.int64))
    both = pa.StructArray.from_arrays(
        [pa.array(bands, pa.int32()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat)], ["band", "words"])
    return sizes, nodes, pa.ListArray.from_arrays(pa.array(rows, pa.int32()), both)


def set_hash(terms: np.ndarray) -> int:
    """Signed 64-bit hash of a set of distinct terms."""
    h = mix64(np.array([mix64(terms ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64) + np.uint64(len(terms))], dtype=np.uint64))
    return int(h.view(np.int64)[0])


def shingle_sets(ids: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, mark, n_shingles, node, sketches) of (id, mark, t) rows: node names the set (null:
    empty); sketches has (band, XOR words) for each of its two bands."""
    kind = ids.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sizes, nodes, sketches = set_sketches(part.column(2), width, percent, xor_words)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), sketches],
                                                 ["id", "mark", "n_shingles", "node", "sketches"])
            # the worker stays alive, idle, while the shuffles that follow need the machine's memory
            pa.default_memory_pool().release_unused()

    return ids.mapInArrow(
        run, f"id {kind}, mark long, n_shingles long, node long, sketches array<struct<band:int,words:array<long>>>")


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """XOR of every size-th word: differing bits are no more than those of the words."""
    out = np.zeros(-(-max(len(words), 1) // size) * size, dtype=np.uint64)
    out[:len(words)] = words
    return np.bitwise_xor.reduce(out.reshape(-1, size), axis=0)


def folds(words: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """Of each whole sketch: its fold to SHORT_WORDS, and the longer fold of a large one (else empty)."""
    flat, cuts = words.flatten().to_numpy().view(np.uint64), words.offsets.to_numpy() - words.offsets[0].as_py()
    short, more, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [0]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        size = SHORT_WORDS * -(-(hi - lo) // FOLD_WORDS)
        short.append(folded(flat[lo:hi], SHORT_WORDS))
        if size > SHORT_WORDS:
            more.append(folded(flat[lo:hi], size))
        ends.append(ends[-1] + (size if size > SHORT_WORDS else 0))
    short, more = (pa.array(np.concatenate(x).view(np.int64)) for x in (short, more))
    return (pa.ListArray.from_arrays(pa.array(np.arange(len(cuts)) * SHORT_WORDS, pa.int32()), short),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), more))


def parity_sketches(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, band, n, words, short, more) of (node, t) rows: the parity sketches of both bands and their folds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sizes, _, sketches = set_sketches(part.column(1), width, percent, sketch)
                both = sketches.flatten()
                words = both.field("words")
                whole = pa.StructArray.from_arrays([both.field("band"), words, *folds(words)], ["band", "words", "short", "more"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(sketches.offsets, whole)],
                                                 ["node", "n", "sketches"])

    rows = texts.select("node", "t").mapInArrow(
        run, "node long, n long, sketches array<struct<band:int,words:array<long>,short:array<long>,more:array<long>>>")
    return rows.select("node", "n", F.explode("sketches").alias("s")).select("node", "s.band", "n", "s.words", "s.short", "s.more")


def first_rows(x: np.ndarray) -> np.ndarray:
    """Places of the first row of each value of x, in order."""
    return np.sort(np.unique(x, return_index=True)[1])


def word_rows(part: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, node, band) of the sketch words of (node, sketches) rows, repeated nodes once.

    Empty words are left out of a sketch that has no more of them than the band's spare: its
    links then have an equal word that is not empty.
    """
    part = part.take(pa.array(first_rows(part.column(0).to_numpy(zero_copy_only=False))))
    lists = part.column(1)
    per_row = np.diff(lists.offsets.to_numpy())
    sketches = lists.flatten()
    band, words = sketches.field("band").to_numpy(), sketches.field("words")
    size = np.diff(words.offsets.to_numpy())
    flat = words.flatten().to_numpy().view(np.uint64)
    lows = band_table(percent, 1 << 20)
    while len(band) and band.max() + 2 > len(lows) - 1:
        lows = band_table(percent, 4 * lows[-1])
    spare = {int(x): sketch_size(lows, int(x), percent)[1] for x in np.unique(band)}
    empty = np.add.reduceat(flat == 0, np.cumsum(size) - size, dtype=np.int64) if len(size) else np.zeros(0, np.int64)
    crowded = np.repeat(empty > np.array([spare[int(x)] for x in band], dtype=np.int64), size) if len(size) else np.zeros(0, bool)
    band = np.repeat(band, size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    node = np.repeat(np.repeat(part.column(0).to_numpy(zero_copy_only=False), per_row), size)
    # 48 bits name a word well enough: a clash is only one more candidate
    key = mix64(flat ^ mix64((band.astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64))) >> np.uint64(16)
    keep = (flat != 0) | crowded
    return key[keep].view(np.int64), node[keep].astype(np.int64), band[keep].astype(np.int32)


def bucket_rows(feats: DataFrame, percent: int, bitmap: np.ndarray) -> DataFrame:
    """(key, node, band): one row for each sketch word whose key may be in the bitmap, its key
    naming (band, place, word)."""
    sent = feats.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                key, node, band = word_rows(b.slice(lo, SLICE), percent)
                keep = in_bitmap(sent.value, key.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep]), pa.array(band[keep])], ["key", "node", "band"])
            pa.default_memory_pool().release_unused()

    return feats.where("node is not null").select("node", "sketches").mapInArrow(run, "key long, node long, band int")


def shared_words(feats: DataFrame, percent: int) -> DataFrame:
    """(key, hub) of the words that two different nodes have; hub is the smallest node.

    Workers reduce each slice to its smallest and largest node of a key, so a word of very many
    nodes is few rows. Almost all other words occur once: an aggregation before the exchange
    would hold them all and save nothing, so rows are dealt by key first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                key, node, _ = word_rows(b.slice(lo, SLICE), percent)
                order = np.argsort(key)
                key, node = key[order], node[order]
                at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
                low, top = (f.reduceat(node, at) if len(key) else node for f in (np.minimum, np.maximum))
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(low), pa.array(top)], ["key", "low", "top"])
            pa.default_memory_pool().release_unused()

    rows = feats.where("node is not null").select("node", "sketches").mapInArrow(run, "key long, low long, top long")
    hubs = rows.repartition("key").groupBy("key").agg(F.min("low").alias("hub"), F.max("top").alias("top"))
    return hubs.where("hub < top").select("key", "hub")


def key_bitmap(keys: DataFrame) -> np.ndarray:
    """Bitmap of 2**BITMAP_BITS bits with the lowest bits of every key set: of one size whatever the
    number of keys (the driver gets at most one number for each 64 bits). Full of keys it lets
    all pass, and the join that follows does the work."""
    slot = F.col("key").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    rows = keys.select(F.shiftright(slot, 6).alias("at"), F.expr("shiftleft(1L, cast(key & 63 AS int))").alias("bit"))
    table = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.uint64)
    out[table["at"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot = key & np.uint64((1 << BITMAP_BITS) - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _bits_differ(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def may_link(bits: Column, total: Column, percent: int) -> Column:
    """False only if sets of ``total`` elements together, whose sketches differ in ``bits``, cannot link."""
    return bits * (100 + percent) <= total * (100 - percent)


def texts_of(nodes: DataFrame, feats: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, t): one text of each of the given nodes."""
    first = feats.join(nodes, "node").groupBy("node").agg(F.min(F.struct("id", "mark")).alias("r")).select(
        "node", F.col("r.id").alias("rid"), F.col("r.mark").alias("mark"))
    first = small_side(stored(first, "node-texts"))
    found = ids.join(first, "mark").where(F.col("id").eqNullSafe(F.col("rid"))).select("node", "t")
    return found.dropDuplicates(["node"])


def verify_texts(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) of the (a, b, t_a, t_b) rows whose whole shingle sets link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                left = [np.unique(shingles(w, width)) for _, w in texts_words(part.column(2))]
                right = [np.unique(shingles(w, width)) for _, w in texts_words(part.column(3))]
                for k, (x, y) in enumerate(zip(left, right, strict=True)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[lo + k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "t_a", "t_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, near: DataFrame, feats: DataFrame, ids: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) of (band, a, b) candidates that link: first by whole sketch, then by whole text.

    near: (node, band, n, words), one row each. Only texts of candidates that pass are moved.
    """
    def side(name: str) -> DataFrame:
        return near.select("band", F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("words").alias(f"w_{name}"))

    close = pairs.join(side("a"), ["band", "a"]).join(side("b"), ["band", "b"])
    close = close.where(may_link(_bits_differ(F.col("w_a"), F.col("w_b")), F.col("n_a") + F.col("n_b"), percent))
    close = stored(close.select("a", "b").distinct(), "sketch-close")
    texts = stored(texts_of(close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), feats, ids), "close-texts")
    both = close.join(texts.select(F.col("node").alias("a"), F.col("t").alias("t_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("t").alias("t_b")), "b")
    return stored(verify_texts(both, width, percent), "verified-links")


def fold_bits(more: pa.ListArray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of the longer folds of the rows x and y, in pairs (0 where they have none)."""
    flat, cuts = more.flatten().to_numpy().view(np.uint64), more.offsets.to_numpy() - more.offsets[0].as_py()
    size, bits = np.diff(cuts)[x], np.zeros(len(x), dtype=np.int64)
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        for lo in range(0, len(rows), FOLD_PAIRS):
            part = rows[lo: lo + FOLD_PAIRS]
            left, right = (flat[cuts[side[part]][:, None] + np.arange(n)] for side in (x, y))
            bits[part] = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
    return bits


def bucket_pairs(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (band, a, b) of the rows of each (key, i, j) that have different roots, and whose
    folded sketches allow a link; a key of each pair, and the share of differing bits.
    Rows: key, i, j, own, band, node, n, root, f0, f1, ..., and more, if there are longer folds."""
    get = {c: table[c].to_numpy() for c in ("key", "i", "j", "own", "band", "node", "n", "root")}
    order = np.lexsort((get["j"], get["i"], get["key"]))
    get = {c: v[order] for c, v in get.items()}
    short = np.stack([table[f"f{k}"].to_numpy().view(np.uint64)[order] for k in range(SHORT_WORDS)], axis=1)
    more = table["more"].combine_chunks() if "more" in table.column_names else None
    new = np.r_[True, (np.diff(get["key"]) != 0) | (np.diff(get["i"]) != 0) | (np.diff(get["j"]) != 0)]
    end = np.r_[np.flatnonzero(new)[1:], len(order)][np.cumsum(new) - 1]
    found, keys, apart_by = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    at = np.arange(len(order))
    step = 1
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            break
        x, y = at, at + step
        cross = (get["i"][x] == get["j"][x]) | (get["own"][x] != get["own"][y])
        x, y = x[cross], y[cross]
        apart = get["root"][x] != get["root"][y]
        x, y = x[apart], y[apart]
        bits = np.bitwise_count(short[x] ^ short[y]).sum(axis=1, dtype=np.int64)
        both = get["n"][x] + get["n"][y]
        ok = bits * (100 + percent) <= both * (100 - percent)
        x, y, bits, both = x[ok], y[ok], bits[ok], both[ok]
        if more is not None and len(x):
            bits = np.maximum(bits, fold_bits(more, order[x], order[y]))
            ok = bits * (100 + percent) <= both * (100 - percent)
            x, y, bits, both = x[ok], y[ok], bits[ok], both[ok]
        if len(x):
            a, b = np.minimum(get["node"][x], get["node"][y]), np.maximum(get["node"][x], get["node"][y])
            found.append(np.stack([get["band"][x].astype(np.int64), a, b], axis=1))
            keys.append(get["key"][x])
            apart_by.append(bits / both)
        step += 1
    pairs, first = np.unique(np.concatenate(found), axis=0, return_index=True)
    return pairs, np.concatenate(keys)[first], np.concatenate(apart_by)[first]


def leading(pairs: np.ndarray, apart_by: np.ndarray) -> np.ndarray:
    """Which of the distinct (band, a, b) have the smallest a of their b, or differ least of those of
    their b: at most two a node of a band."""
    keep = np.zeros(len(pairs), dtype=bool)
    band, a, b = pairs.T
    for rank in (a, apart_by):
        order = np.lexsort((a, rank, b, band))
        new = np.r_[True, (np.diff(b[order]) != 0) | (np.diff(band[order]) != 0)] if len(order) else np.zeros(0, bool)
        keep[order[new]] = True
    return keep


def compared(members: DataFrame, percent: int, lead: bool, block: int = BLOCK, unit_rows: int = 4_000) -> DataFrame:
    """(band, a, b, key) of members (key, band, node, n, root, f0, f1, ..., and perhaps more) that share
    a key, have different roots, and whose folded sketches allow a link; key is null.

    With ``lead``, a piece of work hands on a few candidates of each member (see :func:`leading`),
    and rows of a key alone name buckets that hold the candidates not handed on.

    The members of a key are dealt into blocks by hash of the node, and each pair of blocks
    is a piece of work, so a frequent word's bucket is split over many tasks. Like pieces of
    keys with the same smallest root are put together into units of about ``unit_rows`` rows, as
    the same members meet in them, and what remains of keys of one block is put together at random.
    """
    keys = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"))
    keys = keys.withColumn("nb", F.ceil(F.col("m") / block).cast("int"))
    piece = F.col("m") * F.least("nb", F.lit(2)) / F.col("nb")
    parts = keys.groupBy("lo", "nb").agg(F.ceil(F.sum(piece) / unit_rows).alias("parts"))
    keys = keys.join(parts, ["lo", "nb"]).select("key", "lo", "nb", "parts")
    units = max(1, members.count() // unit_rows)
    rows = members.join(keys, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    unit = F.when((F.col("nb") == 1) & (F.col("parts") == 1), F.pmod(F.xxhash64("lo"), F.lit(units))).otherwise(
        F.xxhash64("lo", "nb", "i", "j", F.pmod("key", "parts")))
    cols = ["key", "i", "j", "own", "band", "node", "n", "root", *SHORT, *(["more"] if "more" in members.columns else [])]

    def run(t: pa.Table) -> pa.Table:
        pairs, key, apart_by = bucket_pairs(t, percent)
        on = leading(pairs, apart_by) if lead else np.ones(len(pairs), dtype=bool)
        left = np.unique(key[~on])
        band, a, b = (pa.concat_arrays([pa.array(x, kind), pa.nulls(len(left), kind)])
                      for x, kind in zip(pairs[on].T, (pa.int32(), pa.int64(), pa.int64()), strict=True))
        return pa.table({"band": band, "a": a, "b": b, "key": pa.concat_arrays([pa.nulls(int(on.sum()), pa.int64()), pa.array(left)])})

    return rows.select(unit.alias("unit"), *cols).groupBy("unit").applyInArrow(run, "band int, a long, b long, key long").distinct()


def cross_candidates(members: DataFrame, percent: int, block: int = BLOCK, unit_rows: int = 4_000) -> DataFrame:
    """All distinct (band, a, b) that :func:`compared` finds."""
    return compared(members, percent, False, block, unit_rows).select("band", "a", "b")


def star_pairs(shared: DataFrame) -> DataFrame:
    """(band, a, b) of (key, node, band, hub) rows: each node b of a band with the hubs a of most of its
    buckets (the smallest, where as many), at most HUBS of them."""
    hubs = shared.where("node <> hub").groupBy("band", "node", "hub").agg(F.count(F.lit(1)).alias("m"))
    order = Window.partitionBy("band", "node").orderBy(F.desc("m"), "hub")
    best = hubs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= HUBS)
    return best.select("band", F.col("hub").alias("a"), F.col("node").alias("b"))


def mixed_keys(rooted: DataFrame) -> DataFrame:
    """Keys of the (key, root, ...) rows that have more than one root."""
    return rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The (node, ...) rows with their roots; a node without one is its own."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def joined_roots(roots: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """(node, root) of the (node, root) components joined by more (a, b) links."""
    edges = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return stored(components(edges.unionByName(links)), name)


def link_roots(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, mark, n_shingles, root) of every row: mark is a hash of the text; rows linked with each
    other, and no others, share a root; rows without shingles have none."""
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    path = {name: scratch_path(spark, name) for name in ("shingle-sketches", "shared-words", "bucket-members", "mixed-members")}
    ids = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("t"))
    feats = stored(shingle_sets(ids, width, percent), "shingle-sketches", path["shingle-sketches"])
    # buckets that hold two different nodes, and their smallest node
    hubs = stored(shared_words(feats, percent), "shared-words", path["shared-words"])
    members = bucket_rows(feats, percent, key_bitmap(hubs)).join(hubs, "key")
    shared = stored(members.groupBy("key", "node", "band").agg(F.min("hub").alias("hub")), "bucket-members", path["bucket-members"])
    feats = stored(feats.drop("sketches"), "shingle-nodes")
    for name in ("shared-words", "shingle-sketches"):
        removed(spark, path[name])
    texts = texts_of(shared.select("node").distinct(), feats, ids)
    near = stored(parity_sketches(texts, width, percent), "near-sketches")
    links = verified(star_pairs(shared), near, feats, ids, width, percent)
    roots = stored(components(links), "star-roots")
    rooted = with_roots(shared.drop("hub"), roots)
    members = rooted.join(mixed_keys(rooted), "key").join(near.drop("words"), ["node", "band"])
    short = [F.col("short")[k].alias(c) for k, c in enumerate(SHORT)]
    members = stored(members.select("key", "band", "node", "n", "root", *short, "more"), "mixed-members", path["mixed-members"])
    removed(spark, path["bucket-members"])
    found = stored(compared(members, percent, True), "leading-candidates")
    first = found.where("key is null").drop("key")
    roots = joined_roots(roots, verified(first, near, feats, ids, width, percent), "leading-roots")
    # buckets with candidates not handed on, if they still have members of different components
    left = found.where("key is not null").select("key").distinct()
    rooted = with_roots(members.drop("root").join(left, "key"), roots)
    members = stored(rooted.join(mixed_keys(rooted), "key").select(*members.columns), "left-members")
    removed(spark, path["mixed-members"])
    if not members.isEmpty():
        cross = stored(cross_candidates(members, percent).join(first, ["band", "a", "b"], "left_anti"), "cross-candidates")
        roots = joined_roots(roots, verified(cross, near, feats, ids, width, percent), "roots")
    out = feats.select("id", "mark", "n_shingles", "node").join(roots, "node", "left")
    return out.withColumn("root", F.coalesce("root", "node")).drop("node")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                       percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row, component_id being the smallest id reachable by links.

    Null and empty texts, and texts of white space, have no shingles and are their own
    component. Rows with equal ids are rows of their own with that id; null ids count as larger
    than any other, and a component of null ids alone has a null id. Other columns are not carried.
    """
    out = link_roots(docs, id_col, text_col, width, percent)
    lowest = out.where("root is not null").groupBy("root").agg(F.min("id").alias("low"))
    out = out.join(lowest, "root", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles",
                      F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("low")).alias("component_id"))


def one_per_component(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                      percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (then of the smallest text hash).

    Rows without shingles all stay. Of repeated rows of the chosen id and text one stays.
    """
    rows = stored(link_roots(docs, id_col, text_col, width, percent), "link-roots")
    none = rows.where("root is null").select("id", "mark").distinct().withColumn("n", F.lit(0).cast("long"))
    counted = rows.where("root is not null").groupBy("root", "id", "mark").agg(F.count(F.lit(1)).alias("n"))
    first = counted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "mark", "n")).alias("r"))
    stay = small_side(stored(none.unionByName(first.select("r.id", "r.mark", "r.n")), "stay"))
    stay = stay.select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.col("n").alias("__n"))
    marked = docs.withColumn("__m", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    kept = marked.join(stay, (F.col("__m") == F.col("__mark")) & F.col(id_col).eqNullSafe(F.col("__id")))
    once = kept.where("__n < 2")
    many = kept.where("__n > 1").dropDuplicates(["__id", "__mark"])
    return once.unionByName(many).select(*[F.col(f"`{c}`") for c in docs.columns])
