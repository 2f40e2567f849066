"""Sampled SentencePiece segmentation and lossless decoding.

The text, with a space put before it and spaces written as the vocabulary's word mark, is a
lattice: every vocabulary piece that matches somewhere is an edge, and a character that is
no piece of its own is a chain of byte pieces. Forward filtering adds up the weight of all
ways to reach each position; backward sampling then draws the last piece in proportion to
the weight it carries, and so on to the front. The numbers drawn are hashes of the row's
key and the place in the text, so a row gets the same segmentation wherever it is computed.

No piece crosses the start of a run of word marks or a line break, so the lattice falls
apart into segments. Each distinct segment is filtered once per worker (the cache is
bounded) and all occurrences of a batch of texts are sampled together, one piece a step.

Vocabularies whose scores are merge ranks (whole numbers) get the weight 1 / (rank + 10);
others the exponential of their scores; both to the power ``alpha``.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.words import mix64

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_LITERAL_MARK = "\udc81"  # stands for a mark that the text itself holds: never part of a piece
ALPHA = 1.0
SEED = "pieces-1"
_CACHE_EDGES = 2_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SEGMENTS = re.compile(f"{MARK}+[^{MARK}\n]*|\n+|[^{MARK}\n]+")


def load_vocabulary(path: str = MODEL) -> dict:
    """Pieces with their log weights, and the ids of the 256 byte pieces, of a model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    scores = {i: sp.get_score(i) for i in normal}
    ranks = all(float(s).is_integer() for s in scores.values())
    weight = {i: -math.log(10.0 - s) if ranks else s for i, s in scores.items()}
    bytes_of = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
    if len(bytes_of) != 256:
        raise ValueError("the vocabulary has no byte pieces, so decoding could lose text")
    pieces = {p: (i, weight[i]) for i in reversed(normal) if (p := sp.id_to_piece(i)) and MARK not in p.lstrip(MARK) and "\n" not in p}
    text = [b""] * size
    for p, (i, _) in pieces.items():
        text[i] = p.replace(MARK, " ").encode("utf-8")
    for b, i in bytes_of.items():
        text[i] = bytes([b])
    return {"pieces": pieces, "bytes": bytes_of, "text": text, "longest": max(map(len, pieces)), "floor": min(weight.values()) - 1.0}


def _utf8(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, how many of each) of an array of code points, one after the other."""
    size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    point, n = np.repeat(points, size), np.repeat(size, size)
    low = (point >> (6 * (n - 1 - at))) & 0x3F | 0x80
    head = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n] | (point >> (6 * (n - 1)))
    return np.where(at > 0, low, np.where(n == 1, point, head)), size


class Lattices:
    """Filtered segments as one table of nodes and edges, for sampling many at once.

    A node is a place in a distinct segment; its edges are the pieces that end there. An
    edge whose character is no piece carries ``size of the vocabulary + code point`` and is
    written as byte pieces in the end.
    """

    def __init__(self, vocabulary: dict, alpha: float = ALPHA):
        self.v, self.alpha = vocabulary, alpha
        self.size = len(vocabulary["text"])
        self.piece_len = np.array([len(t) for t in vocabulary["text"]], dtype=np.int64)
        self.piece_at = np.r_[0, np.cumsum(self.piece_len)]
        self.piece_bytes = np.frombuffer(b"".join(vocabulary["text"]), dtype=np.uint8)
        self.byte_ids = np.array([vocabulary["bytes"][b] for b in range(256)], dtype=np.int32)
        # of each length: hashes of the pieces in order, with their ids and weights
        self.by_length = {}
        for n in range(1, vocabulary["longest"] + 1):
            of = [(p, i, w) for p, (i, w) in vocabulary["pieces"].items() if len(p) == n]
            if of:
                h = self._prefix_hashes(self._points([p for p, _, _ in of], n))[:, n]
                order = np.argsort(h)
                self.by_length[n] = (h[order], np.array([i for _, i, _ in of], np.int32)[order], np.array([w for _, _, w in of])[order] * alpha)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ends = np.zeros(0, np.int64)
        self.nodes = 0
        # of each edge: node it ends in + cumulative probability; node it starts from (-1: the front); its piece
        self.cum, self.start, self.piece = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)

    @staticmethod
    def _points(segments: list[str], n: int) -> np.ndarray:
        raw = "".join(segments).encode("utf-32-le", "surrogatepass")
        return np.frombuffer(raw, dtype=np.uint32).reshape(len(segments), n).astype(np.uint64)

    @staticmethod
    def _prefix_hashes(points: np.ndarray) -> np.ndarray:
        h = np.zeros((points.shape[0], points.shape[1] + 1), dtype=np.uint64)
        for j in range(points.shape[1]):
            h[:, j + 1] = h[:, j] * _PRIME + points[:, j] + np.uint64(1)
        return h

    def _filter(self, segments: list[str], n: int) -> None:
        """Filter segments of n characters forward and add their nodes and edges."""
        points = self._points(segments, n)
        prefix = self._prefix_hashes(points)
        longest = min(n, self.v["longest"])
        weight = np.full((len(segments), n, longest), -np.inf)
        unit = np.zeros((len(segments), n, longest), dtype=np.int32)
        for size in range(1, longest + 1):
            if size not in self.by_length:
                continue
            power = np.uint64(pow(int(_PRIME), size, 1 << 64))
            hashes, ids, weights = self.by_length[size]
            h = prefix[:, size:] - prefix[:, : n + 1 - size] * power
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            found = hashes[at] == h
            weight[:, size - 1:, size - 1] = np.where(found, weights[at], -np.inf)
            unit[:, size - 1:, size - 1] = ids[at]
        bare = np.isneginf(weight[:, :, 0])
        weight[:, :, 0] = np.where(bare, self.alpha * self.v["floor"] * (1.0 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)), weight[:, :, 0])
        unit[:, :, 0] = np.where(bare, (points + np.uint64(self.size)).astype(np.int32), unit[:, :, 0])
        reach = np.zeros((len(segments), n + 1))
        share = np.zeros_like(weight)
        for j in range(1, n + 1):
            m = min(j, longest)
            w = weight[:, j - 1, :m] + reach[:, j - m: j][:, ::-1]
            top = w.max(axis=1)
            part = np.cumsum(np.exp(w - top[:, None]), axis=1)
            share[:, j - 1, :m] = part / part[:, -1:]
            reach[:, j] = top + np.log(part[:, -1])
        which, j, size = np.nonzero(weight > -np.inf)
        node = self.nodes + which * n + j
        cum = node + np.minimum(share[which, j, size], 1.0)
        last = np.r_[node[1:] != node[:-1], True]
        cum[last] = node[last] + 1.0
        self._new.append((cum, np.where(j > size, node - size - 1, -1), unit[which, j, size]))
        self._new_ends.append(self.nodes + np.arange(1, len(segments) + 1) * n - 1)
        self.nodes += len(segments) * n

    def _add(self, segments: list[str], first: int) -> None:
        """Filter the distinct new segments, which have the numbers first, first + 1, ..."""
        order = sorted(range(len(segments)), key=lambda k: len(segments[k]))
        self._new, self._new_ends = [], []
        i = 0
        while i < len(order):
            n, j = len(segments[order[i]]), i
            while j < len(order) and len(segments[order[j]]) == n and (j == i or (j - i) * n < 30_000):
                j += 1
            self._filter([segments[k] for k in order[i:j]], n)
            i = j
        ends = np.empty(len(segments), dtype=np.int64)
        ends[order] = np.concatenate(self._new_ends)
        self.ends = np.concatenate([self.ends, ends])
        self.cum, self.start, self.piece = (np.concatenate([old, *new]) for old, new in zip(
            (self.cum, self.start, self.piece), zip(*self._new, strict=True), strict=True))

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled piece ids of all texts, one after the other, and the texts' offsets."""
        if len(self.cum) > _CACHE_EDGES:
            self.clear()
        known, old = self.known, len(self.known)
        number, per_text = array("q"), np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            if text:
                marked = MARK + text.replace(MARK, _LITERAL_MARK).replace(" ", MARK)
                own = [known.setdefault(s, len(known)) for s in _SEGMENTS.findall(marked)]
                number.extend(own)
                per_text[k] = len(own)
        if len(known) > old:
            self._add(list(islice(known, old, None)), old)
        node = self.ends[np.array(number, dtype=np.int64)]
        first = np.r_[0, np.cumsum(per_text)]
        owner = np.repeat(np.arange(len(texts)), per_text)
        place = np.arange(len(node)) - first[owner]
        draw = mix64(keys[owner] + mix64(place.astype(np.uint64) + np.uint64(1)))
        steps, at = [], np.arange(len(node))
        count = np.zeros(len(node), dtype=np.int64)
        while len(at):
            u = (draw >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
            edge = np.searchsorted(self.cum, node + u, side="right")
            steps.append((at, self.piece[edge]))
            count[at] += 1
            node = self.start[edge]
            more = node >= 0
            at, node, draw = at[more], node[more], mix64(draw[more] + np.uint64(0x9E3779B97F4A7C15))
        begin = np.r_[0, np.cumsum(count)]
        out = np.empty(begin[-1], dtype=np.int32)
        for k, (which, ids) in enumerate(steps):
            out[begin[which + 1] - 1 - k] = ids
        return self._spell(out, begin[first])

    def _spell(self, units: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Write characters that are no pieces as byte pieces."""
        bare = np.flatnonzero(units >= self.size)
        if not len(bare):
            return units, offsets
        points = units[bare].astype(np.int64) - self.size
        points = np.where(points == ord(MARK), ord(" "), np.where(points == ord(_LITERAL_MARK), ord(MARK), points))
        raw, size = _utf8(points)
        length = np.ones(len(units), dtype=np.int64)
        length[bare] = size
        at = np.r_[0, np.cumsum(length)]
        out = np.empty(at[-1], dtype=np.int32)
        whole = units < self.size
        out[at[:-1][whole]] = units[whole]
        out[np.repeat(at[:-1][bare] - (np.cumsum(size) - size), size) + np.arange(len(raw))] = self.byte_ids[raw]
        return out, at[offsets]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Texts of the piece ids; the space before each text is taken off."""
        size = self.piece_len[ids]
        ends = np.r_[0, np.cumsum(size)]
        source = np.repeat(self.piece_at[ids] - ends[:-1], size) + np.arange(ends[-1])
        raw = self.piece_bytes[source].tobytes()
        cuts = ends[offsets]
        return [raw[a + 1: b] if b > a else b"" for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _groups(lengths: list[int], limit: int):
    """(first, last + 1) of consecutive texts of about ``limit`` characters together."""
    i = 0
    while i < len(lengths):
        j, total = i, 0
        while j < len(lengths) and (j == i or total + lengths[j] <= limit):
            total += lengths[j]
            j += 1
        yield i, j
        i = j


def encode_decode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = ALPHA,
                  seed: str = SEED, batch_chars: int = 2_000_000) -> DataFrame:
    """Sample a segmentation of every whole text and decode it again.

    One row per input row: the id, n_chars, n_pieces, pieces, decoded_sha256 (of the decoded
    bytes) and lossless (decoded bytes equal the text's). Null and empty texts have no pieces.
    The row key is the id: equal ids with equal texts get equal pieces. The vocabulary is
    read by the driver and sent to the workers (its size is that of the model file). Other
    columns are not carried.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(load_vocabulary(model))
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_chars", "n_pieces", "pieces", "decoded_sha256", "lossless"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(sent.value, alpha)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            keys = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, j in _groups([len(t) for t in texts], batch_chars):
                ids, offsets = lattices.encode(texts[i:j], mix64(keys[i:j]))
                back = lattices.decode(ids, offsets)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array([len(t) for t in texts[i:j]], pa.int64()), pa.array(np.diff(offsets)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)),
                    pa.array([hashlib.sha256(b).hexdigest() for b in back]),
                    pa.array([b == t.encode("utf-8", "surrogatepass") for b, t in zip(back, texts[i:j], strict=True)])], names)

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("key"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_chars long, n_pieces long, pieces array<int>, decoded_sha256 string, lossless boolean")


def decode_pieces(rows: DataFrame, *, pieces_col: str = "pieces", out_col: str = "text", model: str = MODEL) -> DataFrame:
    """Add the text of a column of piece ids (null ids: a null text)."""
    sent = rows.sparkSession.sparkContext.broadcast(load_vocabulary(model))
    rows = rows.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(sent.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(pieces_col)).to_pylist()
            offsets = np.cumsum([0, *(len(x or ()) for x in lists)])
            ids = np.array([i for x in lists for i in x or ()], dtype=np.int64)
            text = [None if x is None else b.decode("utf-8", "surrogatepass") for x, b in zip(lists, lattices.decode(ids, offsets), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, `{out_col}` string")
