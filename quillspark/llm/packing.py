"""Packing of documents into training sequences along a space-filling curve.

Each document's byte trigrams are hashed into a vector of counts, the vector is projected to four dimensions, and
the four coordinates give a Hilbert key. A range shuffle by (key, id) lays the corpus out
along the curve; each partition then tokenizes its documents in that order and fills sequences one after
another, so neighbours on the curve share sequences. What is left at the end of a partition is cut into
sequences whose lengths are powers of two, which need no padding, so partitions never wait for each other.

Defined results: a null text is an empty one (only the end id); empty table, no rows; rows that repeat are
packed as often as they occur; ties on the curve are ordered by id, then text hash. Columns other than id and
text are not read. Long texts are tokenized in pieces cut at spaces, which the tokenizer drops anyway.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import LongType, StructField, StructType

from ._common import as_bytes, chunks, mix, with_struct

DIMENSIONS, BITS = 4, 12
FEATURES, PIECE = 4096, 1 << 20
#: Words of up to this many bytes are remembered; the memory is emptied when it holds CACHED words.
CACHED_BYTES, CACHED = 48, 600_000


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows) with `bits` bits a coordinate, by transposing axes (Skilling, 2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(hit, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


_SIGNS: list[np.ndarray] = []


def project(data: bytes) -> np.ndarray:
    """The document's hashed vector (counts of its byte trigrams in FEATURES cells, of unit length) projected to DIMENSIONS values in 0..1; a text of under three bytes is the origin."""
    if not _SIGNS:
        h = mix(np.arange(1, FEATURES + 1, dtype=np.uint64))
        _SIGNS.append(np.stack([((h >> np.uint64(63 - k)) & np.uint64(1)).astype(np.float64) * 2 - 1 for k in range(DIMENSIONS)]))
    count = np.zeros(FEATURES, np.int64)
    for at in range(0, len(data) - 2, PIECE):
        raw = np.frombuffer(data, np.uint8, min(PIECE + 2, len(data) - at), at).astype(np.uint16)
        count += np.bincount((raw[:-2] * np.uint16(961) + raw[1:-1] * np.uint16(31) + raw[2:]) & np.uint16(FEATURES - 1), minlength=FEATURES)
    norm = math.sqrt(float(np.dot(count, count)))
    if not norm:
        return np.zeros(DIMENSIONS)
    return 1 / (1 + np.exp(-1.702 * (_SIGNS[0] @ count) / norm))


def curve_keys(col: pa.Array) -> pa.StructArray:
    at = np.array([project(x or b"") for x in as_bytes(col)]).reshape(-1, DIMENSIONS)
    key = hilbert(np.minimum((at * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)
    return pa.StructArray.from_arrays([pa.array(key, pa.int64())], ["key"])


class Encoder:
    """Token ids of texts. The vocabulary lower-cases texts and drops white space, so words between ASCII spaces are encoded apart, with A-Z as a-z, and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode("\0", add_special_tokens=False).ids
        self.known: dict[bytes, bytes] = {b"": b""}

    def learn(self, new: list[bytes]) -> None:
        """Encode words in one text a thousand, parted by a character that is always a token of its own; words that hold it, or may hold a special token, go alone."""
        mark = self.mark
        plain = [w for w in new if b"\0" not in w and b"<|" not in w]
        for at in range(0, len(plain), 1000):
            part = plain[at : at + 1000]
            ids = np.asarray(self.tokenizer.encode((b" \0 ".join(part) + b" \0").decode(), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(ids == mark).tolist()
            data, start = ids.tobytes(), 0
            for w, end in zip(part, ends, strict=True):
                self.known[w] = data[4 * start : 4 * end]
                start = end + 1
        if len(plain) < len(new):
            for w in new:
                if b"\0" in w or b"<|" in w:
                    self.known[w] = np.asarray(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as little-endian 32-bit integers."""
        known = self.known
        cut = []
        for text in texts:
            data = text.encode()
            cut.append([p.split(b" ") for p in _pieces(data if b"<|" in data else data.translate(_LOWER))])
        if len(known) > CACHED:
            known.clear()
            known[b""] = b""
        out = []
        long = [w for words in cut for p in words for w in p if len(w) > CACHED_BYTES] if any(len(t) > CACHED_BYTES for t in texts) else []
        self.learn(list(set().union(*(p for words in cut for p in words)).difference(known)))
        for words in cut:
            out.append(np.frombuffer(b"".join(b"".join(map(known.__getitem__, p)) for p in words), "<u4"))
        for w in set(long):
            known.pop(w, None)
        return out


_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 10 else c for c in range(256))


def _pieces(data: bytes, size: int = 1 << 19) -> Iterator[bytes]:
    """The text in pieces cut at spaces, with line ends as spaces."""
    data = data.replace(b"\n", b" ")
    at = 0
    while len(data) - at > size:
        cut = data.rfind(b" ", at, at + size)
        if cut <= at:
            cut = data.find(b" ", at + size)
            cut = len(data) if cut < 0 else cut
        yield data[at:cut]
        at = cut
    yield data[at:]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cuts(length: int, room: int, size: int) -> list[int]:
    """Lengths of a document's pieces when `room` places are left in the open sequence."""
    out = [min(length, room)]
    length -= out[0]
    out += [size] * (length // size) + ([length % size] if length % size else [])
    return [x for x in out if x]


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, partitions: int | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids). `size` must be a power of two."""
    spark = docs.sparkSession
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    df = with_struct(df, "curve", StructType([StructField("key", LongType())]), ["text"], curve_keys)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("curve.key").asc(), F.col("doc_id").asc(), F.xxhash64("text").asc()]
    df = df.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    fields = "doc_id {}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint".format(df.schema["doc_id"].dataType.simpleString())
    if keep_ids:
        fields += ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        base = TaskContext.get().partitionId() << 32
        seq, used = 0, 0
        open_: list[list] = []  # rows of the sequence being filled
        rows: list[list] = []
        kind = None

        def batch(out: list[list]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            arrays = [pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:7]]]
            if keep_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in cols[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(arrays)])

        for b in batches:
            kind = b.column(0).type
            for doc, ids in ((d, i) for part in chunks(zip(b.column(0), b.column(1), strict=True), lambda x: len(x[1].as_buffer() or b"") if x[1].is_valid else 0, 1 << 20) for (d, _), i in zip(part, encoder.many([t.as_py() or "" for _, t in part]), strict=True)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                at = 0
                for length in cuts(len(ids), size - used, size):
                    piece = ids[at : at + length]
                    open_.append([doc.as_py(), at, length, zlib.crc32(piece.tobytes()), len(ids), base + seq, used, piece])
                    at, used = at + length, used + length
                    if used == size:
                        rows += open_
                        open_, seq, used = [], seq + 1, 0
                if len(rows) >= 8192:
                    yield batch(rows)
                    rows = []
        if used:
            # The open sequence becomes sequences whose lengths are the binary digits of what it holds.
            left = [1 << k for k in range(size.bit_length()) if used >> k & 1][::-1]
            offset = 0
            for doc, start, _, _, tokens, _, _, piece in open_:
                at = 0
                while at < len(piece):
                    part = piece[at : at + left[0] - offset]
                    rows.append([doc, start + at, len(part), zlib.crc32(part.tobytes()), tokens, base + seq, offset, part])
                    at, offset = at + len(part), offset + len(part)
                    if offset == left[0]:
                        left, seq, offset = left[1:], seq + 1, 0
        if rows:
            yield batch(rows)

    return df.mapInArrow(run, fields)
