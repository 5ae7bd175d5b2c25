"""Containers, their limits, and the reader ladder."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArchiveQuota, DecodeFailed, Refusal, UnsupportedContainer

MOST_MEMBERS, MOST_BYTES, MOST_EXPANSION, MOST_DEPTH = 10_000, 8 << 30, 200, 3


def detect(data: bytes) -> str | None:
    """A container's kind by its magic bytes."""
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return "zip"
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if data[:6] == b"Rar!\x1a\x07":
        return "rar"
    if data[:6] == b"7z\xbc\xaf\x27\x1c":
        return "7z"
    if data[257:262] == b"ustar":
        return "tar"
    if data[2:5] == b"-lh":
        return "lha"
    if data[:2] == b"MZ":
        return "pe"
    return None


def detect_col(content):
    """The same over a binary column."""
    head = F.hex(F.substring(content, 1, 6))
    starts = lambda x: F.startswith(head, F.lit(x))
    return F.when(starts("504B0304") | starts("504B0506"), "zip").when(starts("1F8B"), "gzip").when(starts("526172211A07"), "rar").when(starts("377ABCAF271C"), "7z").when(F.hex(F.substring(content, 258, 5)) == "7573746172", "tar").when(F.hex(F.substring(content, 3, 3)) == "2D6C68", "lha").when(starts("4D5A"), "pe")


def safe_name(name: str) -> str:
    """A member's path, if it stays inside its archive."""
    parts = name.replace("\\", "/").split("/")
    if name.startswith(("/", "\\")) or ".." in parts or (len(name) > 1 and name[1] == ":"):
        raise Refusal(f"member leaves its archive: {name!r}")
    return "/".join(p for p in parts if p not in ("", "."))


def check_quota(sizes: list[int], packed: int) -> None:
    """Too many members, too many bytes, or too much expansion is refused."""
    if len(sizes) > MOST_MEMBERS or sum(sizes) > MOST_BYTES or (packed and sum(sizes) > MOST_EXPANSION * packed and sum(sizes) > 1 << 20):
        raise ArchiveQuota(f"{len(sizes)} members, {sum(sizes)} bytes out of {packed}")


def members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, content) of an archive's files."""
    kind = detect(data)
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
            check_quota([i.file_size for i in infos], len(data))
            for i in infos:
                yield safe_name(i.filename), z.read(i)
    elif kind == "gzip":
        with gzip.open(io.BytesIO(data)) as f:
            out = f.read(min(MOST_BYTES, max(1 << 20, MOST_EXPANSION * len(data))) + 1)
        check_quota([len(out)], len(data))
        yield "content", out
    elif kind == "tar":
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            infos = [i for i in t.getmembers() if i.isfile()]
            check_quota([i.size for i in infos], len(data))
            for i in infos:
                yield safe_name(i.name), t.extractfile(i).read()
    else:
        raise UnsupportedContainer(f"{kind or 'unknown'} containers have no reader here")


def walk(data: bytes, path: str = "", depth: int = 0) -> Iterator[tuple[str, bytes, str | None]]:
    """(path, content, error) of all files, through nested archives to a depth of MOST_DEPTH; members that cannot be read are named, not skipped."""
    if detect(data) in ("zip", "gzip", "tar") and depth < MOST_DEPTH:
        try:
            for name, content in members(data):
                yield from walk(content, f"{path}!{name}" if path else name, depth + 1)
        except (Refusal, OSError, zipfile.BadZipFile, tarfile.TarError) as e:
            yield path, b"", f"{type(e).__name__}: {e}"
    elif detect(data) in ("rar", "7z", "lha"):
        yield path, b"", f"UnsupportedContainer: {detect(data)}"
    else:
        yield path, data, None


#: Readers that a file's ending suggests first; the others are still tried.
FIRST = {"dbf": "dbf", "dbc": "dbc", "csv": "csv", "txt": "csv", "json": "json", "parquet": "parquet"}


def ladder(path: str) -> list[str]:
    """Readers in the order to try."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("dll", "exe", "pdf"):
        return []
    every = ["dbf", "parquet", "json", "csv"]
    first = FIRST.get(ending)
    return ([first] if first else []) + [r for r in every if r != first]


def _read(reader: str, data: bytes) -> pa.Table:
    if reader == "dbc":
        from .dbc import unpack

        return _read("dbf", unpack(data))
    if reader == "dbf":
        from .dbf import read_bytes

        return read_bytes(data)
    if reader == "parquet":
        import pyarrow.parquet as pq

        return pq.read_table(io.BytesIO(data))
    if reader == "json":
        import json

        doc = json.loads(data) if data.lstrip()[:1] in (b"[",) else [json.loads(x) for x in data.splitlines() if x.strip()]
        if not doc or not all(isinstance(r, dict) for r in doc):
            raise DecodeFailed("not rows")
        names = list(dict.fromkeys(k for r in doc for k in r))
        return pa.table({n: pa.array([None if r.get(n) is None else json.dumps(r[n]) if isinstance(r[n], dict | list) else str(r[n]) for r in doc], pa.string()) for n in names})
    import csv

    from ..functions.text import best_decoding
    from .dbf import unique_names
    from .text import header_of, sniff_delimiter

    if b"\0" in data[:4096]:
        raise DecodeFailed("binary")
    names = header_of(data)
    text = data.decode(best_decoding(data), "replace").lstrip("﻿")
    rows = list(csv.reader(io.StringIO(text), delimiter=sniff_delimiter(text[:16_384])))[1:]
    names = unique_names(names)
    return pa.table({n: pa.array([(r[i].strip() or None) if i < len(r) else None for r in rows], pa.string()) for i, n in enumerate(names)})


def open_table(data: bytes, path: str) -> tuple[str | None, pa.Table | None, list[tuple[str, str]]]:
    """(reader, table, failed attempts): every reader is tried, every failure is kept."""
    failed = []
    for reader in ladder(path):
        try:
            return reader, _read(reader, data), failed
        except Exception as e:  # a reader may fail in any way on bytes that are not its own
            failed.append((reader, f"{type(e).__name__}: {e}"[:200]))
    return None, None, failed


def probe(files: DataFrame) -> DataFrame:
    """(path, member, reader, rows, columns, error) of files listed by `binaryFile`."""

    def run(batches):
        for b in batches:
            out = []
            for path, content in zip(b.column(0), b.column(1), strict=True):
                for member, data, error in walk(content.as_py()):
                    if error:
                        out.append((path.as_py(), member, None, None, None, error))
                        continue
                    reader, table, failed = open_table(data, member or path.as_py())
                    out.append((path.as_py(), member, reader, table.num_rows if table else None, ",".join(table.column_names) if table else None, None if table else "; ".join(f"{r}: {e}" for r, e in failed) or "no reader"))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 3 + [pa.int64(), pa.string(), pa.string()], strict=True)], names=["path", "member", "reader", "rows", "columns", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, member string, reader string, rows bigint, columns string, error string")


def duckdb_version(data: bytes) -> int | None:
    """Storage version out of a database file's header."""
    return int.from_bytes(data[12:20], "little") if data[8:12] == b"DUCK" else None


def lookup_columns(table: pa.Table) -> tuple[str, str]:
    """The code and the label column of a lookup table: codes are filled, unique and short, with few spaces; labels are filled and long."""
    best: dict[str, tuple[float, float]] = {}
    n = max(1, table.num_rows)
    for name in table.column_names:
        values = [v for v in table[name].to_pylist() if v]
        fill = len(values) / n
        unique = len(set(values)) / max(1, len(values))
        length = sum(map(len, values)) / max(1, len(values))
        spaced = sum(" " in v for v in values) / max(1, len(values))
        best[name] = ((fill * unique, -length) if spaced <= 0.5 else (-1, -length), (fill * length, spaced))
    code = max(best, key=lambda c: best[c][0])
    label = max((c for c in best if c != code), key=lambda c: best[c][1], default=code)
    return code, label


def with_deadline(f: Callable, seconds: float, label: str = "", memory: int | None = None):
    """f() in a process of its own, which is killed after `seconds` (ItemTimeout) and may take `memory` bytes more than it began with (O20, R26). A crash there is DecodeFailed here."""
    import multiprocessing

    from ..errors import ItemTimeout

    context = multiprocessing.get_context("fork")
    here, there = context.Pipe(duplex=False)

    def run() -> None:
        if memory:
            import resource

            with open("/proc/self/statm") as s:
                now = int(s.read().split()[0]) * resource.getpagesize()
            resource.setrlimit(resource.RLIMIT_AS, (now + memory, now + memory))
        try:
            there.send((True, f()))
        except BaseException as e:
            there.send((False, f"{type(e).__name__}: {e}"[:500]))

    child = context.Process(target=run, daemon=True)
    child.start()
    there.close()
    try:
        if not here.poll(seconds):
            raise ItemTimeout(f"{label}: over {seconds} s")
        try:
            ok, out = here.recv()
        except EOFError as e:
            raise DecodeFailed(f"{label}: the process ended") from e
        if not ok:
            raise DecodeFailed(f"{label}: {out}")
        return out
    finally:
        child.kill()
        child.join()
        here.close()


def open_isolated(data: bytes, path: str, *, seconds: float = 60.0, memory: int = 2 << 30) -> tuple[str | None, pa.Table | None, list[tuple[str, str]]]:
    """open_table in a process of its own: what hangs, crashes or takes too much memory is a failed attempt."""
    from ..errors import ItemTimeout

    try:
        return with_deadline(lambda: open_table(data, path), seconds, path, memory)
    except (ItemTimeout, DecodeFailed) as e:
        return None, None, [("isolated", str(e)[:200])]


def read_duckdb(spark, path: str, limit: int | None = None) -> dict[str, DataFrame]:
    """One frame for each table of a database file (R17); a storage version that the client cannot open is refused by number. The file must be on the driver's machine."""
    try:
        import duckdb
    except ImportError as e:
        raise UnsupportedContainer("reading database files needs duckdb") from e
    with open(path, "rb") as f:
        version = duckdb_version(f.read(20))
    try:
        c = duckdb.connect(path, read_only=True)
    except duckdb.Error as e:
        raise UnsupportedContainer(f"storage version {version}: {str(e)[:120]}") from e
    try:
        names = c.sql("SELECT table_schema, table_name FROM information_schema.tables ORDER BY ALL").fetchall()
        return {f"{s}.{t}": spark.createDataFrame(c.sql(f'SELECT * FROM "{s}"."{t}"' + (f" LIMIT {int(limit)}" if limit else "")).arrow().read_all()) for s, t in names}
    finally:
        c.close()


def fetch_all(paths: list[str], get: Callable[[str], bytes], *, workers: int = 8, held: dict[str, bytes] | None = None, stall: float = 60.0) -> tuple[dict[str, bytes], dict[str, str]]:
    """(bytes by path, errors by path): what is held is settled first, the rest is fetched by several workers, none longer than `stall` seconds."""
    import concurrent.futures

    out = {p: held[p] for p in paths if held and p in held}
    failed: dict[str, str] = {}
    pool = concurrent.futures.ThreadPoolExecutor(workers)
    waiting = {pool.submit(get, p): p for p in dict.fromkeys(paths) if p not in out}
    try:
        while waiting:
            done, _ = concurrent.futures.wait(waiting, timeout=stall, return_when=concurrent.futures.FIRST_COMPLETED)
            if not done:
                failed.update({p: f"ItemTimeout: nothing arrived in {stall} s" for p in waiting.values()})
                break
            for f in done:
                p = waiting.pop(f)
                try:
                    out[p] = f.result()
                except Exception as e:  # whatever a client raises is that path's answer
                    failed[p] = f"{type(e).__name__}: {e}"
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    return out, failed
