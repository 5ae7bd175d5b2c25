"""Copies among images by local descriptors: cropped, shifted, brightened or otherwise edited ones included.

An image column holds encoded images (binary PGM or PPM, or PNG of 8 bits without interlace). For each image
Harris corners are found on SCALES of a pyramid, the strongest POINTS a scale are kept (a bound of the
descriptor, not of the search), each gets an orientation from its patch's intensity centroid and a descriptor of
256 binary tests turned by that orientation.

Hamming tables: a descriptor is cut into TABLES keys of 256 / TABLES bits, so two within TABLES - 1 bits of each
other share a key. Images of equal pixels become one representative first. Every image's points meet those of every
other image that share a key, however many do: BLOCK images at a time, in order of ids, are broadcast with their
sorted keys, and those of greater ids look them up in one pass without a shuffle. Equal descriptors are compared
once a block. Matches vote for a similarity transform (rotation, scale, shift) in coarse cells; an image pair with
VOTES points in one cell is linked, and linked images form classes. No link is lost, but points that many images have
cost a comparison for each pair of them, and there is a pass for each block.

Defined results: a null or unreadable image (one without pixels, or with more than MOST_PIXELS, too) has no points and is a class of its own, as is a flat one; rows that
repeat an id are one image (that of least digest) and keep their rows; an empty table gives no rows; ids are
integers, null ids are left out. Columns other than id and image are not read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, LongType, StringType, StructField, StructType

from ._common import Written, fresh, with_struct
from ._graph import components

SCALES, POINTS, RADIUS, BITS, TABLES, VOTES = (1.0, 0.7071, 0.5), 48, 12, 256, 8, 6
TURNS = 30
#: BLOCK: images that are broadcast at once, about 12 KB each. Larger images than MOST_PIXELS count as unreadable.
BLOCK, MOST_PIXELS = 2048, 1 << 27
#: These steer the work, not the result. PART: images that meet a block at once. STEP, TILE: pairs of descriptors compared at once, of small keys and of those with DENSE pairs. MATCHES: point pairs counted at once, in hashes of SLOTS bits.
PART, STEP, TILE, DENSE, MATCHES, SLOTS = 1024, 1 << 18, 1 << 16, 1024, 1 << 20, 20

POINT = StructType([StructField(c, FloatType()) for c in ("x", "y", "scale", "angle")] + [StructField("d", ArrayType(LongType()))])
DESCRIBED = StructType([StructField("sha", StringType()), StructField("points", ArrayType(POINT))])
ARROW = pa.struct([("sha", pa.string()), ("points", pa.list_(pa.struct([("x", pa.float32()), ("y", pa.float32()), ("scale", pa.float32()), ("angle", pa.float32()), ("d", pa.list_(pa.int64()))])))])


def decode(data: bytes) -> np.ndarray | None:
    """Grey pixels of an encoded image, or None where it cannot be read."""
    try:
        if data[:2] in (b"P5", b"P6"):
            head, at = [], 2
            while len(head) < 3:
                while data[at : at + 1].isspace():
                    at += 1
                if data[at : at + 1] == b"#":
                    at = data.index(b"\n", at)
                    continue
                end = at
                while data[end : end + 1].isdigit():
                    end += 1
                head.append(int(data[at:end]))
                at = end
            w, h, top = head
            bands = 1 if data[:2] == b"P5" else 3
            if top > 255:
                return None
            if not 0 < w * h <= MOST_PIXELS:
                return None
            return _grey(np.frombuffer(data, np.uint8, w * h * bands, at + 1).reshape(h, w, bands))
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, IndexError, struct.error, zlib.error):
        pass
    return None


def _grey(px: np.ndarray) -> np.ndarray:
    if px.shape[2] >= 3:
        return px[:, :, :3].astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32)
    return px[:, :, 0].astype(np.float32)


def _png(data: bytes) -> np.ndarray | None:
    at, body, shape = 8, b"", None
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", part)
            if depth != 8 or interlace or color not in (0, 2, 4, 6):
                return None
            if not 0 < w * h <= MOST_PIXELS:
                return None
            shape = (h, w, {0: 1, 2: 3, 4: 2, 6: 4}[color])
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    if not shape:
        return None
    h, w, bands = shape
    rows = np.frombuffer(zlib.decompressobj().decompress(body, h * (1 + w * bands)), np.uint8).reshape(h, 1 + w * bands)
    out = np.zeros((h, w * bands), np.uint8)
    for y in range(h):
        how, row, up = rows[y, 0], rows[y, 1:].astype(np.int32), out[y - 1].astype(np.int32) if y else np.zeros(w * bands, np.int32)
        if how == 0:
            out[y] = row
        elif how == 2:
            out[y] = (row + up) & 255
        else:
            line = np.zeros(w * bands, np.int32)
            for x in range(w * bands):
                a, c = (line[x - bands], up[x - bands]) if x >= bands else (0, 0)
                if how == 1:
                    add = a
                elif how == 3:
                    add = (a + up[x]) // 2
                else:
                    p = a + up[x] - c
                    pa_, pb, pc = abs(p - a), abs(p - up[x]), abs(p - c)
                    add = a if pa_ <= pb and pa_ <= pc else up[x] if pb <= pc else c
                line[x] = (row[x] + add) & 255
            out[y] = line
    return _grey(out.reshape(h, w, bands))


def _box(img: np.ndarray, r: int) -> np.ndarray:
    pad = np.pad(img, r + 1, mode="edge")[:-1, :-1].cumsum(0).cumsum(1)
    n = 2 * r + 1
    return pad[n:, n:] - pad[:-n, n:] - pad[n:, :-n] + pad[:-n, :-n]


def _resized(img: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return img
    h, w = max(1, int(img.shape[0] * scale)), max(1, int(img.shape[1] * scale))
    y, x = np.clip((np.arange(h) + 0.5) / scale - 0.5, 0, img.shape[0] - 1), np.clip((np.arange(w) + 0.5) / scale - 0.5, 0, img.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), max(0, img.shape[0] - 2)), np.minimum(x.astype(int), max(0, img.shape[1] - 2))
    fy, fx = (y - y0)[:, None], x - x0
    y1, x1 = np.minimum(y0 + 1, img.shape[0] - 1), np.minimum(x0 + 1, img.shape[1] - 1)
    a, b, c, d = img[np.ix_(y0, x0)], img[np.ix_(y0, x1)], img[np.ix_(y1, x0)], img[np.ix_(y1, x1)]
    return (a * (1 - fx) + b * fx) * (1 - fy) + (c * (1 - fx) + d * fx) * fy


def _tests() -> np.ndarray:
    """The 256 test pairs for each of TURNS orientations: TURNS x 256 x 4 offsets."""
    base = np.clip(np.random.RandomState(7).normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS * 0.7, RADIUS * 0.7)
    out = []
    for t in range(TURNS):
        a = 2 * math.pi * t / TURNS
        turn = np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]])
        out.append(np.rint(base @ turn).astype(int).reshape(BITS, 4))
    return np.stack(out)


_FIXED: list = []


def describe(img: np.ndarray) -> list[dict]:
    """Points of an image: place in its own pixels, scale, angle, descriptor."""
    return [dict(zip(("x", "y", "scale", "angle", "d"), p, strict=True)) for s in _corners(img) for p in zip(*(c.tolist() for c in s), strict=True)]


def _corners(img: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """x, y, scale, angle and d of an image's points as arrays, for each scale that has points."""
    if not _FIXED:
        g = np.arange(-7, 8)
        yy, xx = np.meshgrid(g, g, indexing="ij")
        disc = (yy**2 + xx**2 <= 49).astype(np.float32)
        _FIXED.extend([_tests(), xx * disc, yy * disc])
    tests, mx, my = _FIXED
    out = []
    for scale in SCALES:
        im = _resized(img, scale)
        edge = RADIUS + 1
        if min(im.shape) < 2 * edge + 3:
            continue
        gy, gx = np.gradient(im)
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        r = r[edge:-edge, edge:-edge]
        top = np.pad(r, 1, constant_values=-np.inf)
        peak = np.max([top[i : i + r.shape[0], j : j + r.shape[1]] for i in range(3) for j in range(3)], axis=0)
        y, x = np.nonzero((r >= peak) & (r > max(1e-3, 0.005 * float(r.max()))))
        if not len(y):
            continue
        best = np.lexsort((x, y, -r[y, x]))[:POINTS]
        y, x = y[best] + edge, x[best] + edge
        smooth = _box(im, 2)
        patch = np.stack([im[j - 7 : j + 8, i - 7 : i + 8] for j, i in zip(y, x, strict=True)])
        patch = patch - patch.mean(axis=(1, 2), keepdims=True)
        angle = np.arctan2((patch * my).sum(axis=(1, 2)), (patch * mx).sum(axis=(1, 2))) % (2 * math.pi)
        turn = np.rint(angle / (2 * math.pi) * TURNS).astype(int) % TURNS
        t = tests[turn]
        bits = smooth[y[:, None] + t[:, :, 1], x[:, None] + t[:, :, 0]] + 1e-3 < smooth[y[:, None] + t[:, :, 3], x[:, None] + t[:, :, 2]]
        words = np.packbits(bits, axis=1).view("<i8")
        out.append((x / scale, y / scale, np.full(len(y), scale), angle, words))
    return out


def _described(data: bytes | None) -> tuple[str, list[tuple[np.ndarray, ...]]]:
    img = decode(data) if data else None
    if img is None:
        return hashlib.sha256(data or b"").hexdigest(), []
    return hashlib.sha256(repr(img.shape).encode() + img.tobytes()).hexdigest(), _corners(img)


def _all_described(images: pa.Array) -> pa.StructArray:
    """DESCRIBED of each image, built by column."""
    found = [_described(x.as_py()) for x in images]
    scales, kind = [s for _, f in found for s in f], ARROW.field("points").type.value_type
    offsets = np.concatenate([[0], np.cumsum([sum(len(s[0]) for s in f) for _, f in found])]).astype(np.int32)
    plain = [np.concatenate([s[k] for s in scales] or [np.zeros(0)]).astype(np.float32) for k in range(4)]
    d = np.concatenate([s[4] for s in scales] or [np.zeros((0, BITS // 64), np.int64)]).astype(np.int64)
    words = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * (BITS // 64)), pa.array(d.reshape(-1)))
    points = pa.StructArray.from_arrays([*map(pa.array, plain), words], fields=list(kind))
    return pa.StructArray.from_arrays([pa.array([sha for sha, _ in found], pa.string()), pa.ListArray.from_arrays(pa.array(offsets), points)], fields=list(ARROW))


def _points(reps: np.ndarray, points: pa.ListArray) -> dict[str, np.ndarray]:
    """The points of images as arrays: img (number of the image in reps), i (number in the image), x, y, scale, angle and d (rows of 64-bit words); see `_kinds` for the rest."""
    starts, flat = points.offsets.to_numpy(), points.flatten()
    counts = np.diff(starts)
    out = {c: flat.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x", "y", "scale", "angle")}
    d = flat.field("d").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, BITS // 64)
    return {**out, **_kinds(d), "reps": reps, "img": np.repeat(np.arange(len(reps)), counts), "i": np.arange(len(flat)) - np.repeat(starts[:-1] - starts[0], counts)}


def _kinds(d: np.ndarray) -> dict[str, np.ndarray]:
    """Distinct descriptors, which all images' points share: words (a row for each word), keys (a row for each table), each point's kind, and the points by kind (at, from starts[kind] on)."""
    at = np.lexsort(d.T)
    s = d[at]
    new = np.concatenate([np.ones(1, bool), (s[1:] != s[:-1]).any(axis=1)])[: len(at)]
    kind = np.empty(len(at), np.int64)
    kind[at] = np.cumsum(new) - 1
    return {"kind": kind, "at": at, "starts": np.append(np.flatnonzero(new), len(at)), "words": np.ascontiguousarray(s[new].T), "keys": np.ascontiguousarray(s[new].view(np.uint32).reshape(-1, TABLES).T)}


def _ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low[0], ..., low[0] + n[0] - 1, low[1], and so on."""
    return np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)


def _pieces(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive pieces of at most `most` in weight, each of one item at least."""
    total, a = np.cumsum(weights), 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _apart(p: np.ndarray, q: np.ndarray, x: np.ndarray | None = None, bits: np.ndarray | None = None, more: np.ndarray | None = None) -> np.ndarray:
    """Bits in which words p and q (by word, then of shapes that broadcast) differ, modulo 256: of 256 bits, all would count as none, but these share a key. x, bits and more are arrays to work in."""
    bits = np.bitwise_count(np.bitwise_xor(p[0], q[0], out=x), out=bits)
    for a, b in zip(p[1:], q[1:], strict=True):
        bits += np.bitwise_count(np.bitwise_xor(a, b, out=x), out=more)
    return bits


def _signs(p: dict[str, np.ndarray], t: int, parities: bool) -> np.ndarray:
    """The keys of p's kinds in table t, in 64 bits; with `parities`, those of the bits of all other keys are at the end."""
    sign = p["keys"][t].astype(np.uint64) << np.uint64(TABLES)
    if parities:
        for s in range(TABLES):
            if s != t:
                sign |= (np.bitwise_count(p["keys"][s]) & 1).astype(np.uint64) << np.uint64(s)
    return sign


def tables_of(q: dict[str, np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(table, order of q's kinds by sign, sorted signs). Tables of few kinds a key come first; signs of the last two have parities, see `near_kinds`."""
    crowd = [int((np.unique(k, return_counts=True)[1].astype(np.int64) ** 2).sum()) for k in q["keys"]]
    out = []
    for rank, t in enumerate(sorted(range(TABLES), key=lambda t: crowd[t])):
        sign = _signs(q, t, rank >= TABLES - 2)
        order = np.argsort(sign, kind="stable")
        out.append((t, order, sign[order]))
    return out


def near_kinds(p: dict[str, np.ndarray], q: dict[str, np.ndarray], tables: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Kinds of p and q within TABLES - 1 bits of each other; each pair once, by the first key that it shares. tables: `tables_of` q.

    Where a pair's first common key is that of the last table, each other key differs in just one bit, so in parity. At the last table but one
    they do as well (the last key none or one), but for one key at most whose parity is another. Both tables' pairs meet by key and parities.
    """
    for rank, (t, order, signs) in enumerate(tables):
        mine, earlier = _signs(p, t, rank >= TABLES - 2), [s for s, _, _ in tables[:rank]]
        own = np.argsort(mine, kind="stable")
        sign, start, n = np.unique(mine[own], return_index=True, return_counts=True)
        apart = [0]
        if rank >= TABLES - 2:
            flipped = sum(1 << s for s in earlier)
            apart = [flipped] + [flipped ^ (1 << s) for s in range(TABLES) if s != t and rank < TABLES - 1]
        for x in apart:
            low = np.searchsorted(signs, sign ^ np.uint64(x), "left")
            m = np.searchsorted(signs, sign ^ np.uint64(x), "right") - low
            yield from _met(p, q, earlier, own, start, n, order, low, m)


def _met(p: dict[str, np.ndarray], q: dict[str, np.ndarray], earlier: list[int], own: np.ndarray, start: np.ndarray, n: np.ndarray, order: np.ndarray, low: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Kinds own[start : start + n] of p and order[low : low + m] of q, for each element of these, that are within TABLES - 1 bits and share no key of the tables `earlier`."""
    spare = [np.empty(TILE, t) for t in (np.uint64, np.uint8, np.uint8, bool, bool)]
    # Groups of many: all with all, in tiles that stay in the cache.
    for g in np.flatnonzero(n * m >= DENSE):
        mine, others = own[start[g] : start[g] + n[g]], order[low[g] : low[g] + m[g]]
        left, left_keys = p["words"][:, mine, None], p["keys"][:, mine, None][earlier]
        wide = min(len(others), TILE // 8)
        tall = TILE // wide
        for b in range(0, len(others), wide):
            v = others[b : b + wide]
            right, right_keys = q["words"][:, None, v], q["keys"][:, None, v][earlier]
            for a in range(0, len(mine), tall):
                u = mine[a : a + tall]
                x, bits, more, close, first = (y[: len(u) * len(v)].reshape(len(u), len(v)) for y in spare)
                np.less(_apart(left[:, a : a + tall], right, x, bits, more), TABLES, out=close)
                for k, other in zip(left_keys[:, a : a + tall], right_keys, strict=True):
                    np.logical_and(close, np.not_equal(k, other, out=first), out=close)
                hit = np.flatnonzero(close)
                if len(hit):
                    row = hit // len(v)
                    yield u[row].astype(np.int32), v[hit - row * len(v)].astype(np.int32)
    # All other groups at once.
    few = np.flatnonzero((m > 0) & (n * m < DENSE))
    mine, times, begin = own[_ranges(start[few], n[few])], np.repeat(m[few], n[few]), np.repeat(low[few], n[few])
    for a, b in _pieces(times, STEP):
        u, v = np.repeat(mine[a:b], times[a:b]), order[_ranges(begin[a:b], times[a:b])]
        hit = np.flatnonzero(_apart(p["words"][:, u], q["words"][:, v]) < TABLES)
        u, v = u[hit], v[hit]
        for s in earlier:
            may = p["keys"][s][u] != q["keys"][s][v]
            u, v = u[may], v[may]
        if len(u):
            yield u.astype(np.int32), v.astype(np.int32)


def linked(p: dict[str, np.ndarray], q: dict[str, np.ndarray], tables: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Rows (rep, other), rep > other, of the image pairs of which VOTES matching points agree on a transform."""
    out, found = [np.zeros((0, 2), np.int64)], list(near_kinds(p, q, tables))
    if found:
        u, v = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        v = v[np.argsort(u, kind="stable")]
        n = np.bincount(u, minlength=len(p["starts"]) - 1)
        del u
        begin, size, mixed = np.cumsum(n) - n, np.diff(q["starts"]), p["reps"].min() <= q["reps"].max()
        matched = np.add.reduceat(np.append(size[v], 0), begin) * (n > 0)
        # Some images at a time, so that their matches fit into memory.
        ends = np.searchsorted(p["img"], np.arange(len(p["reps"]) + 1), "left")
        of_image = np.diff(np.append(0, np.cumsum(matched[p["kind"]]))[ends])
        for a, b in _pieces(of_image, MATCHES):
            i = np.arange(ends[a], ends[b])
            kind = p["kind"][i]
            hits, i = v[_ranges(begin[kind], n[kind])], np.repeat(i, n[kind])
            j, i = q["at"][_ranges(q["starts"][hits], size[hits])], np.repeat(i, size[hits])
            if mixed:
                may = p["reps"][p["img"][i]] > q["reps"][q["img"][j]]
                i, j = i[may], j[may]
            out.append(_agreed(p, q, i, j))
    return np.unique(np.concatenate(out), axis=0)


def _often(values: np.ndarray) -> np.ndarray:
    """Where a value is there VOTES times; values that are not may be among them, as hashes of SLOTS are counted."""
    h = ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)
    return np.flatnonzero(np.bincount(h, minlength=1 << SLOTS)[h] >= VOTES)


def _agreed(p: dict[str, np.ndarray], q: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Rows (rep, other) of the image pairs that have VOTES points in one cell of transforms, of matching points i and j. Matches of pairs, turns and cells without VOTES matches go first."""
    if not len(i):
        return np.zeros((0, 2), np.int64)
    pair = (p["img"][i] - p["img"][i[0]]) * len(q["reps"]) + q["img"][j]
    may = np.flatnonzero(np.bincount(pair)[pair] >= VOTES)
    i, j, pair = i[may], j[may], pair[may].astype(np.uint64)
    turn = q["angle"][j] - p["angle"][i]
    turned = np.rint(turn / (2 * math.pi) * 12) % 12
    pair = pair * np.uint64(12) + turned.astype(np.uint64)
    may = _often(pair)
    i, j, pair, turn, turned = (x[may] for x in (i, j, pair, turn, turned))
    zoom = p["scale"][i] / q["scale"][j]
    zoomed = np.rint(2 * np.log2(zoom))
    dx = q["x"][j] - zoom * (np.cos(turn) * p["x"][i] - np.sin(turn) * p["y"][i])
    dy = q["y"][j] - zoom * (np.sin(turn) * p["x"][i] + np.cos(turn) * p["y"][i])
    out = []
    for k in (0, 1):
        at = [np.floor(x / 12 + k / 2).astype(np.int64) for x in (dx, dy)]
        may = _often(pair * np.uint64(0xBF58476D1CE4E5B9) + at[0].view(np.uint64) * np.uint64(0x94D049BB133111EB) + at[1].view(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        cell = np.stack([x[may].astype(np.int64) for x in (p["reps"][p["img"][i]], q["reps"][q["img"][j]], turned, zoomed, *at, p["i"][i])])
        cells, votes = np.unique(np.unique(cell, axis=1)[:6], axis=1, return_counts=True)
        out.append(cells[:2, votes >= VOTES].T)
    return np.concatenate(out)


def _links(own: DataFrame, write: Written) -> DataFrame:
    """(u, v) of the linked image pairs of own (rep, points), u > v: a block of images by id at a time meets itself and those of greater ids."""
    spark, blocks = own.sparkSession, max(1, -(-own.count() // BLOCK))
    bounds: list = [None, *(own.agg(F.percentile_approx("rep", [k / blocks for k in range(1, blocks)], 20 * blocks)).first()[0] if blocks > 1 else []), None]
    points = own.select("rep", "points")

    def prepared(low, high) -> tuple:
        """The images from the block on, and the block's points and tables."""
        left = points if low is None else points.where(F.col("rep") > low)
        table = (left if high is None else left.where(F.col("rep") <= high)).toArrow().combine_chunks()
        q = _points(table.column(0).to_numpy(), pa.concat_arrays(table.column(1).chunks) if table.num_rows else pa.array([], ARROW.field("points").type))
        return left, (q, tables_of(q))

    # The driver prepares a block while the one before is met.
    found, ranges = [], list(zip(bounds[:-1], bounds[1:], strict=True))
    with ThreadPoolExecutor(1) as ahead:
        coming = ahead.submit(prepared, *ranges[0])
        for k in range(len(ranges)):
            left, block = coming.result()
            if k + 1 < len(ranges):
                coming = ahead.submit(prepared, *ranges[k + 1])
            sent = spark.sparkContext.broadcast(block)

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                q, tables = sent.value
                for batch in batches:
                    for a in range(0, batch.num_rows, PART):
                        part = batch.slice(a, PART)
                        pairs = linked(_points(part.column(0).to_numpy(), part.column(1)), q, tables)
                        if len(pairs):
                            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

            found.append(write(left.mapInArrow(run, "u long, v long")))
            sent.destroy()
    return reduce(DataFrame.unionByName, found)


def copies(media: DataFrame, *, id_col: str = "media_id", image_col: str = "image") -> DataFrame:
    """One row per image: media_id, n_points, n_links (those found, of its representative) and class_id (least id of its class)."""
    write = Written(media.sparkSession, "media")
    df = media.select(F.col(id_col).cast("long").alias("media_id"), F.col(image_col).alias("image")).where("media_id is not null")
    df = with_struct(df, "f", DESCRIBED, ["image"], _all_described)
    described = write(df.select("media_id", "f.sha", "f.points"))
    images = write(described.groupBy("media_id").agg(F.min("sha").alias("sha"), F.count("*").alias("times")))
    # Images of equal pixels are one from here on, so that copies of one picture, however many, never meet. Points follow from pixels.
    reps = images.groupBy("sha").agg(F.min("media_id").alias("rep"))
    own = write(described.dropDuplicates(["sha"]).join(reps, "sha").select("rep", "sha", "points"))
    write.drop(described)
    write.settle()
    links = _links(own, write)
    n_links = links.select("u").unionByName(links.select(F.col("v").alias("u"))).groupBy("u").count()
    label = components(links, write)
    named = own.select("sha", "rep", F.size("points").cast("long").alias("n_points")).join(label.select(F.col("u").alias("rep"), F.col("v").alias("class_id")), "rep", "left").join(n_links.select(F.col("u").alias("rep"), F.col("count").alias("n_links")), "rep", "left")
    out = images.join(named, "sha").withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select("media_id", "n_points", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_points") == 0, F.col("media_id")).otherwise(F.coalesce("class_id", "rep")).alias("class_id"))


def pgm(px: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (px.shape[1], px.shape[0]) + px.astype(np.uint8).tobytes()


def picture(vector: list[float]) -> np.ndarray:
    """A mosaic whose tiles are the vector's values, the only pictures that the test tables can give."""
    v = np.asarray(vector, np.float64)
    side = max(1, math.isqrt(len(v)))
    v = v[: side * side].reshape(side, side)
    spread = float(v.std()) or 1.0
    return np.clip(128 + 50 * (v - v.mean()) / spread, 0, 255).astype(np.uint8).repeat(12, 0).repeat(12, 1)


def edited(px: np.ndarray) -> np.ndarray:
    """A copy that was cropped and darkened."""
    return np.clip(px[7:, 10:] * 0.8 + 12, 0, 255).astype(np.uint8)


def pictures(embeddings: DataFrame) -> DataFrame:
    """A media table from the embeddings table: media_id = 2 * vec_id for each vector's picture, 2 * vec_id + 1 for an edited copy of every tenth."""
    kind = StructType([StructField("images", ArrayType(StructType([StructField("media_id", LongType()), StructField("image", BinaryType())])))])
    arrow = pa.struct([("images", pa.list_(pa.struct([("media_id", pa.int64()), ("image", pa.binary())])))])

    def run(ids: pa.Array, vectors: pa.Array) -> pa.Array:
        out = []
        for i, v in zip(ids.to_pylist(), vectors.to_pylist(), strict=True):
            row = []
            if i is not None and v and None not in v:
                px = picture(v)
                row.append({"media_id": 2 * i, "image": pgm(px)})
                if i % 10 == 0:
                    row.append({"media_id": 2 * i + 1, "image": pgm(edited(px))})
            elif i is not None:
                row.append({"media_id": 2 * i, "image": None})
            out.append({"images": row})
        return pa.array(out, arrow)

    df = embeddings.select("vec_id", "embedding")
    return with_struct(df, fresh(df, "m"), kind, ["vec_id", "embedding"], run).select(F.explode("m.images").alias("r")).select("r.media_id", "r.image")
