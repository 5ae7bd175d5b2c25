"""What the operators of this subpackage share: table reads, cut points, Arrow helpers and hashing."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

ARITH = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_CHUNK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local folder, but only for a driver that runs all tasks itself."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Written:
    """Tables written to the shared folder to cut lineage; `drop` deletes those that are no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written = path
        return out

    def settle(self) -> None:
        """Let Spark's cleaner see that finished steps are garbage, so that their shuffle files go before the next step's come."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *dfs: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in dfs:
            path = jvm.org.apache.hadoop.fs.Path(df._written)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of the broadcast in `rows_of`, whatever the tables hold: 2**20 numbers, about 16 MB.
MARKS = 1 << 20


def rows_of(df: DataFrame, wanted: DataFrame, cols: list[str]) -> DataFrame:
    """The rows of df whose `cols` are found in `wanted` (null meets null). Most others go before the shuffle: a hash of `cols` has MARKS values, and those that `wanted` has are broadcast."""
    mark = fresh(df, "mark")
    hashed = lambda: F.xxhash64(*[F.col(c) for c in cols]).bitwiseAND(F.lit(MARKS - 1))
    keys = wanted.select(*cols).distinct()
    few = df.withColumn(mark, hashed()).join(F.broadcast(keys.select(hashed().alias(mark)).distinct()), mark, "left_semi").drop(mark)
    other = keys.select(*[F.col(c).alias(f"__{c}") for c in cols])
    on = same(F.col(cols[0]), F.col(f"__{cols[0]}"))
    for c in cols[1:]:
        on = on & same(F.col(c), F.col(f"__{c}"))
    return few.join(other, on, "left_semi")


def without(df: DataFrame, unwanted: DataFrame, cols: list[str]) -> DataFrame:
    """The rows of df whose `cols` are not found in `unwanted`, told apart in the way of `rows_of`: only rows whose hash `unwanted` has are shuffled."""
    mark = fresh(df, "mark")
    hashed = lambda: F.xxhash64(*[F.col(c) for c in cols]).bitwiseAND(F.lit(MARKS - 1))
    keys = unwanted.select(*cols).distinct()
    marks = F.broadcast(keys.select(hashed().alias(mark)).distinct())
    other = keys.select(*[F.col(c).alias(f"__{c}") for c in cols])
    on = same(F.col(cols[0]), F.col(f"__{cols[0]}"))
    for c in cols[1:]:
        on = on & same(F.col(c), F.col(f"__{c}"))
    marked = df.withColumn(mark, hashed())
    return marked.join(marks, mark, "left_anti").unionByName(marked.join(marks, mark, "left_semi").join(other, on, "left_anti")).drop(mark)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def with_struct(df: DataFrame, name: str, kind: StructType, inputs: list[str], fn: Callable[..., pa.StructArray]) -> DataFrame:
    """df with one more struct column, made batch by batch from `inputs`; all other columns pass through as they are."""
    keep = list(df.columns)
    places = [keep.index(c) for c in inputs]
    schema = StructType([*df.schema.fields, StructField(name, kind, True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = fn(*[b.column(i) for i in places])
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*keep, name])

    return df.mapInArrow(run, schema)


def as_bytes(col: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text, without decoding."""
    for x in col.cast(pa.large_binary()):
        yield x.as_py()


# --- hashed words -------------------------------------------------------------------------------


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE, np.uint64))), dtype=np.uint64)
        down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, inv, np.uint64))), dtype=np.uint64)
    return up, down


_POW: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _CHUNK:
        return _tables(n)
    if not _POW:
        _POW.extend(_tables(_CHUNK))
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wrapping arithmetic)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _MIX1
        h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Byte classes; UTF-8 bytes from 0x80 on belong to words in both.
ALNUM = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
NOT_SPACE = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])


def _word_hashes(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = LOWER[raw]
    w = np.empty(len(b) + 2, np.int8)
    w[0] = w[-1] = 0
    w[1:-1] = inside[b]
    edge = np.diff(w)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        h += (ends - starts).astype(np.uint64) * np.uint64(_BASE)
    return starts, ends, mix(h)


def words_hashed(data: bytes, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of a text whose A-Z count as a-z. Works through the text in pieces cut between words, so memory is bounded by a piece or the longest word."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= _CHUNK:
        return _word_hashes(raw, inside)
    parts, at = [], 0
    while at < len(raw):
        end = min(at + _CHUNK, len(raw))
        if end < len(raw):
            gaps = np.flatnonzero(~inside[LOWER[raw[at:end]]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < len(raw) and inside[LOWER[raw[end]]]:
                    end += 1
        s, e, h = _word_hashes(raw[at:end], inside)
        parts.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def runs_hashed(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each n consecutive word hashes; with fewer words, one for the whole sequence; none without words."""
    if not len(h):
        return h
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, np.uint64(n) * np.uint64(_BASE), np.uint64)
        for i in range(n):
            out = mix(out * np.uint64(0x2545F4914F6CDD1D) + h[i : len(h) - n + 1 + i])
    return out


def chunks(items: Iterable, weigh: Callable, most: int) -> Iterator[list]:
    """Consecutive items in lists of at most `most` in weight, each of one item at least."""
    out, total = [], 0
    for x in items:
        w = weigh(x)
        if out and total + w > most:
            yield out
            out, total = [], 0
        out.append(x)
        total += w
    if out:
        yield out


def same(a, b):
    """Null-safe equality, for joins on columns that may be null."""
    return a.eqNullSafe(b)

