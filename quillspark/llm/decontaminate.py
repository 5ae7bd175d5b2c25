"""Benchmark decontamination by Wu-Manber search over words.

Benchmark windows of the same number of words form one searcher. Its alphabet is hashed words: a block of two
words (one, for windows of one word) indexes a table of shifts, so the scan skips positions where no window can
end; where the shift is zero, the bucket of the block's hash lists the windows that end in it, and the words
themselves are compared before anything counts as an occurrence.

The benchmark is a stated query set. It goes to executors in blocks of at most BLOCK_BYTES of text, at most
BLOCKS_A_PASS blocks in one pass over the documents; a larger benchmark takes more passes over the same rows,
without a shuffle. Documents are streamed once per pass.

Defined results: a null or wordless text has no words and no hits; null or wordless texts of items have no
windows; what an item without an id holds is hit, but n_items and the ids leave it out; repeated items count once by id; repeated documents each get their row; empty tables
give no rows, or rows without hits. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from ._common import ALNUM, as_bytes, chunks, fresh, with_struct, words_hashed

BLOCK_BYTES, BLOCKS_A_PASS = 4 << 20, 4
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

FOUND = StructType([StructField("n_words", LongType()), StructField("items", ArrayType(StringType())), StructField("starts", ArrayType(LongType())), StructField("ends", ArrayType(LongType()))])


def _blocks(h: np.ndarray, width: int, bits: int) -> np.ndarray:
    """A table index for each `width` consecutive words, by their last word."""
    with np.errstate(over="ignore"):
        x = h[width - 1 :] * _K1
        if width == 2:
            x = x ^ ((h[:-1] + np.uint64(1)) * _K2)
            x = x * _K1
    return (x >> np.uint64(64 - bits)).astype(np.int64)


class Searcher:
    """Wu-Manber search for windows of `m` words each. Windows are places in `words`, the words of the block's items one after another, so memory grows with the text and not with the windows' lengths."""

    def __init__(self, m: int, words: "Words", first: np.ndarray, item: np.ndarray):
        self.m, self.width, self.words = m, min(2, m), words
        self.bits = max(10, min(22, (4 * len(first)).bit_length()))
        ends = words.hashes[first[:, None] + np.arange(m - self.width, m)]
        last = _blocks(ends.reshape(-1), self.width, self.bits)[:: self.width]
        order = np.argsort(last, kind="stable")
        self.first, self.item = first[order], item[order]
        self.bucket = np.searchsorted(last[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.shift = np.full(1 << self.bits, m - self.width + 1, np.uint8 if m < 256 else np.int32)
        blocks = _blocks(words.hashes, self.width, self.bits)
        for j in range(self.width - 1, m):
            np.minimum.at(self.shift, blocks[first + j - self.width + 1], m - 1 - j)

    def search(self, data: bytes, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, items: set[str], spans: list[tuple[int, int]]) -> None:
        m, width, words = self.m, self.width, self.words
        if len(h) < m:
            return
        index = _blocks(h, width, self.bits)
        skip = self.shift[index].tolist() if m >= 256 else self.shift[index].tobytes()  # by the block's last word, less width - 1
        at, last = m - width, len(skip)
        while at < last:
            if s := skip[at]:
                at += s
                continue
            end = at + width - 1  # the window's last word
            first, found = end - m + 1, False
            for i in range(self.bucket[index[at]], self.bucket[index[at] + 1]):
                f = int(self.first[i])
                if h[first] == words.hashes[f] and np.array_equal(h[first : end + 1], words.hashes[f : f + m]) and (found or all(data[starts[first + k] : ends[first + k]].lower() == words.data[words.starts[f + k] : words.ends[f + k]] for k in range(m))):
                    if (name := words.names[self.item[i]]) is not None:
                        items.add(name)
                    found = True
            if found:
                spans.append((first, end + 1))
            at += 1


class Words:
    """The words of a block's items: lower-cased text, places, hashes; and the items' ids."""

    def __init__(self, block: list[tuple[str | None, str]]):
        self.names = [i for i, _ in block]
        self.data = b" ".join(t.encode().lower() for _, t in block)  # bytes lower-case A-Z alone
        cut = [words_hashed(t.encode(), ALNUM) for _, t in block]
        at = np.cumsum([0, *(len(t.encode()) + 1 for _, t in block)])
        join = lambda k, kind: np.concatenate([c[k] + at[i] if k < 2 else c[k] for i, c in enumerate(cut)]) if cut else np.zeros(0, kind)
        self.starts, self.ends, self.hashes = join(0, np.int64), join(1, np.int64), join(2, np.uint64)
        self.counts = [len(c[2]) for c in cut]


def searchers(block: list[tuple[str | None, str]], window: int) -> list[Searcher]:
    words = Words(block)
    by: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    at = 0
    for item, n in enumerate(words.counts):
        if m := min(window, n):
            by[m].append((np.arange(at, at + n - m + 1), np.full(n - m + 1, item)))
        at += n
    return [Searcher(m, words, *(np.concatenate(x) for x in zip(*parts, strict=True))) for m, parts in sorted(by.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_BUILT: dict[tuple[str, int], list[Searcher]] = {}


def _built(block: tuple, window: int) -> list[Searcher]:
    """The searchers of a block (its own key, its broadcast); a few blocks stay built in a worker."""
    key = (block[0], window)
    if key not in _BUILT:
        if len(_BUILT) >= BLOCKS_A_PASS:
            _BUILT.clear()
        _BUILT[key] = searchers(block[1].value, window)
    return _BUILT[key]


def find(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out: str = "found") -> tuple[DataFrame, str]:
    """docs with a struct of n_words, items, and merged hit spans (starts, ends: word positions); and that struct's name."""
    if window < 1:
        raise ValueError("a window has one word at least")
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t")).where("t is not null")
    passes: list[list] = [[]]
    for block in chunks(((r.i, r.t) for r in items.toLocalIterator(prefetchPartitions=False)), lambda x: len(x[1]), BLOCK_BYTES):
        if len(passes[-1]) == BLOCKS_A_PASS:
            passes.append([])
        passes[-1].append((uuid.uuid4().hex, spark.sparkContext.broadcast(block)))
    own = list(docs.columns)
    name = fresh(docs, out)
    for k, blocks in enumerate(passes):
        had = fresh(docs, "had") if k else None
        if had:
            docs = docs.withColumnRenamed(name, had)

        def run(texts: pa.Array, before: pa.Array | None = None, blocks=blocks) -> pa.StructArray:
            rows = []
            for r, data in enumerate(as_bytes(texts)):
                data = data or b""
                s, e, h = words_hashed(data, ALNUM)
                hit: set[str] = set()
                spans: list[tuple[int, int]] = []
                if before is not None:
                    old = before[r].as_py()
                    hit, spans = set(old["items"]), list(zip(old["starts"], old["ends"], strict=True))
                for b in blocks:
                    for x in _built(b, window):
                        x.search(data, s, e, h, hit, spans)
                spans = merged(spans)
                rows.append((len(h), sorted(hit), [a for a, _ in spans], [b for _, b in spans]))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], FOUND.names)

        docs = with_struct(docs, name, FOUND, [text_col, *([had] if had else [])], run)
        if had:
            docs = docs.select(*own, name)
    return docs, name


def digest(found: str) -> list:
    """The report's columns from a struct that `find` made."""
    f = F.col(found)
    n_hit = F.aggregate(F.zip_with(f["starts"], f["ends"], lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    return [f["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", f["items"]).cast("binary"), 256).alias("items_sha256"), (F.size(f["starts"]) > 0).alias("contaminated")]


def report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 10, spans: bool = False) -> DataFrame:
    """One row per document: its id, n_words, n_hit, n_items, items_sha256, contaminated, and with `spans` the hit word spans and item ids."""
    df, found = find(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, window=window)
    extra = [F.col(found)["items"].alias("items"), F.arrays_zip(F.col(found)["starts"].alias("start"), F.col(found)["ends"].alias("end")).alias("spans")] if spans else []
    return df.select("doc_id", *digest(found), *extra)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = 10) -> DataFrame:
    """docs without the documents in which a benchmark window occurs; all columns as they were."""
    df, found = find(docs, benchmark, window=window, text_col=text_col)
    return df.where(F.size(F.col(found)["starts"]) == 0).select(*docs.columns)


def reference(docs: list[tuple[int, str | None]], items: list[tuple[int | None, str | None]], window: int = 10) -> dict[int, tuple]:
    """The same by brute force, for tests."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    cut = lambda t: word.findall((t or "").translate(low))
    pats = []
    for i, t in items:
        w = cut(t)
        m = min(window, len(w))
        pats += [(None if i is None else str(i), w[k : k + m]) for k in range(len(w) - m + 1 if m else 0)]
    out = {}
    for d, t in docs:
        w = cut(t)
        hit, got = set(), set()
        for i, p in pats:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit.update(range(k, k + len(p)))
                    if i is not None:
                        got.add(i)
        out[d] = (len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit))
    return out
