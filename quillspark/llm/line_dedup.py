"""Line dedup: an exact set-similarity join of lines by prefix filtering, on DataFrame functions alone.

A line's set is its distinct lower-cased words. A line is removed when an earlier one (by document id, then line
number) has a Jaccard similarity of `percent` or more with it, whether or not that one is removed too. A line
without words has an empty set, which matches nothing.

1. Word counts go into a table of 65,536 hashed counters (fixed size), which orders words by rarity; the order
   only steers the work, any order gives the same result.
2. One pass over the texts writes the place, hash, size, parity map and rarest words of every line that has words.
   Not all its words: they take more room than the text, and only lines that are compared in full need them again.
3. Lines of equal sets, exact copies among them, are found by hash aggregation; all but the first are removed.
4. Every line emits its rarest words, its prefix: lines that match share a word of both prefixes. A row holds the
   word, the line's place and a packed load: size, position of the word, and a 40-bit parity map of the set. Lines of
   equal sets fall together in an aggregation whose first half runs before the shuffle; words of one line vanish.
5. Every other line meets the earliest line of its word only, if sizes, positions and parity maps allow a match
   (each is a bound, so no match is lost); the words of what is left are compared. A line that is removed here
   needs no other partner, so a family of near-equal lines costs a row a line, not all pairs.
6. Lines that are still undecided meet the other earlier lines of their word under the same filters, where it has at
   most HOT lines. For a word of more, matches share a second word in prefixes that are one word longer, so step 5
   begins again with pairs of words, then with three (LEVELS); only at the last level is HOT not looked at.

Defined results: null text stays null and empty text empty, with no lines removed; repeated rows of one id and
text are at one place and do not remove each other; rows that share an id but not a text are told apart by their
texts; null ids come before all others; an empty table gives no rows. Ids are of any type that has an order; integer
ids that fit 63 bits together with the line numbers make a place one number, others a pair. Other columns are
carried along untouched by `dedup`. The documents are read once a step and again for each comparison of words, so
they should be a table, not a long plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Written, fresh, rows_of, same, without

PERCENT, HOT, LEVELS = 90, 4096, 3
#: PARTS: the rows of words meet in so many parts, one after another, which bounds the disk.
PARTS = 4
COUNTERS, MAP_BITS, POSITION_BITS, SIZE_BITS = 1 << 16, 40, 8, 15
SPACES = "[\\x20\\x09-\\x0D]+"


def _cut(line: Column) -> Column:
    """A line's lower-cased words, and empty ones. Lines without other white space are cut at single spaces, the fast way."""
    other = F.lit(False)
    for c in "\t\x0b\x0c\r":
        other = other | F.contains(line, F.lit(c))
    return F.when(other, F.split(F.lower(line), SPACES)).otherwise(F.split(F.lower(line), " "))


def _words(line: Column) -> Column:
    """Hashes of a line's distinct words, sorted."""
    return F.sort_array(F.array_remove(F.array_distinct(F.transform(_cut(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit(""))))


def rarity(lines: DataFrame) -> list[int]:
    """For each hashed counter a rank of up to 127 that grows with the logarithm of its count, over the words of all lines. COUNTERS rows reach the driver."""
    out = [0] * COUNTERS
    for r in lines.select(F.explode(_cut(F.col("line"))).alias("w")).select(F.xxhash64("w").bitwiseAND(F.lit(COUNTERS - 1)).cast("int").alias("k")).groupBy("k").count().collect():
        out[r[0]] = min(127, int(2.5 * math.log2(r[1] + 1)))
    return out


def _bits(n: int) -> int:
    return (1 << n) - 1


def _need(x: Column, y: Column, percent: int) -> Column:
    """Common words that sets of these sizes need."""
    return F.ceil((x + y) * percent / (100 + percent) - 1e-9)


def _may_match(x: str, y: str, percent: int, level: int) -> Column:
    """Whether two loads allow a match, of which `level` words are known. A size or a position at its largest value stands for all beyond it."""
    size = lambda p: F.shiftright(F.col(p), POSITION_BITS + MAP_BITS)
    at = lambda p: F.shiftright(F.col(p), MAP_BITS).bitwiseAND(F.lit(_bits(POSITION_BITS)))
    nx, ny = size(x), size(y)
    wide = (nx == _bits(SIZE_BITS)) | (ny == _bits(SIZE_BITS))
    near = (nx * 100 >= ny * percent) & (ny * 100 >= nx * percent)
    need = _need(nx, ny, percent)
    room = F.least(nx - at(x), ny - at(y)) + (level - 1) >= need  # the shared words are the first in both
    apart = F.bit_count(F.col(x).bitwiseXOR(F.col(y)).bitwiseAND(F.lit(_bits(MAP_BITS)))) <= nx + ny - 2 * need
    return wide | (near & room & apart)


def _traits(lines: DataFrame) -> DataFrame:
    """lines with n (size) and map."""
    parity = F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (w.bitwiseAND(F.lit(_bits(56))) % MAP_BITS).cast("int"))))
    return lines.withColumns({"n": F.size("w").cast("long"), "map": parity})


def _length(percent: int, level: int) -> Column:
    """The length of a line's prefix at a level: longer by level - 1."""
    return (F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + level).cast("int")


def _rarest(ranks: list[int], percent: int) -> Column:
    """The words of a line's prefix at the last level, rarest first. A word is its rank and 56 bits of its hash, so that numbers sort by rarity."""
    table = F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")  # a constant; plans show it, so its numbers are short
    ranked = lambda h: F.call_function("shiftleft", F.get(table, h.bitwiseAND(F.lit(COUNTERS - 1)).cast("int")), F.lit(56)).bitwiseOR(h.bitwiseAND(F.lit(_bits(56))))
    return F.slice(F.sort_array(F.transform("w", ranked)), F.lit(1), _length(percent, LEVELS))


def _prefix(percent: int, level: int) -> Column:
    return F.slice("rarest", F.lit(1), _length(percent, level))


def _load(at: Column) -> Column:
    return (F.least(F.col("n"), F.lit(_bits(SIZE_BITS))) * (1 << (POSITION_BITS + MAP_BITS)) + F.least(at, F.lit(_bits(POSITION_BITS))) * F.lit(1 << MAP_BITS) + F.col("map")).cast("long")


def removed_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, doc, pos) of the lines to remove: doc is the text's hash, which tells rows apart that share an id."""
    write = Written(docs.sparkSession, "line-dedup")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    kind = docs.schema["id"].dataType
    shift = 0
    if kind.typeName() in ("byte", "short", "integer", "long"):
        low, high, most = docs.agg(F.min("id"), F.max("id"), F.max(F.octet_length("text"))).first()
        low, high, shift = low or 0, high or 0, max(1, (most or 1).bit_length())
        shift = 0 if (high - low + 2).bit_length() + shift > 62 else shift
    if shift:
        place = F.coalesce(F.col("id").cast("long") - low + 1, F.lit(0)) * (1 << shift) + F.col("pos")
    else:
        place = F.struct(F.col("id").isNotNull().alias("named"), F.col("id").alias("id"), F.col("pos").alias("pos"))
    raw = docs.select("id", F.xxhash64("text").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    # The filter looks at the line, not at its words: Spark would move that below the projection and hash all words twice.
    raw = raw.where(F.btrim("line", F.lit(" \t\x0b\x0c\r")) != "").select(place.alias("place"), "doc", "line")
    ranks = rarity(raw)
    lines = _traits(raw.select("place", "doc", _words(F.col("line")).alias("w")))
    lines = write(lines.select("place", "doc", F.xxhash64("w").alias("mark"), F.xxhash64(F.lit("second"), "w").alias("mark2"), "n", "map", _rarest(ranks, percent).alias("rarest")))

    first = lines.groupBy("mark", "mark2").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").drop("last")
    copies = write(rows_of(lines.select("place", "mark", "mark2"), first, ["mark", "mark2"]).join(first, ["mark", "mark2"]).where("place > first").select("place", "mark").distinct())

    def verified(pairs: DataFrame) -> DataFrame:
        """(place, mark) of the lines of pairs (place, other) that match."""
        pairs = write(pairs)
        write.settle()
        found = rows_of(raw.select("place", "line"), pairs.select("place").union(pairs.select("other")), ["place"])
        found = write(found.select("place", _words(F.col("line")).alias("w")).select("place", F.xxhash64("w").alias("mark"), "w"))
        write.settle()
        both = pairs.join(found, "place").join(found.select(F.col("place").alias("other"), F.col("w").alias("v")).distinct(), "other")
        inter = F.size(F.array_intersect("w", "v")).cast("long")
        out = write(both.where(inter * 100 >= F.lit(percent) * (F.size("w") + F.size("v") - inter)).select("place", "mark").distinct())
        write.drop(pairs, found)
        return out

    def merged(gone: DataFrame, more: DataFrame) -> DataFrame:
        out = write(gone.unionByName(more).distinct())
        write.drop(gone, more)
        return out

    # The generator's input is no column of its own, or Spark would infer a filter from it and compute it twice.
    rows = lines.select("place", "mark", "n", "map", F.posexplode(_prefix(percent, 1)).alias("i", "tok"))
    rows = rows.select(F.col("tok").alias("key"), "place", "mark", _load(F.col("i")).alias("load"), "tok")
    gone = write(copies.limit(0))
    for level in range(1, LEVELS + 1):
        # A line that repeats is its first copy from here on.
        rows = rows.groupBy("key", "mark").agg(F.min("place").alias("place"), F.min("load").alias("load"), *([F.min("tok").alias("tok")] if level > 1 else []))
        rows = write(rows)
        write.settle()
        heads = rows.groupBy("key").agg(F.min("place").alias("hub"), F.min_by("load", "place").alias("hub_load"), F.count("*").alias("size")).where("size > 1")
        shared, parted = None, []
        for part in range(PARTS):
            mine = F.pmod("key", F.lit(PARTS)) == part
            some = rows.where(mine).join(heads.where(mine), "key").where("place > hub")
            some = write(some.select(*rows.columns, "hub", "size", _may_match("load", "hub_load", percent, level).alias("near")))
            write.settle()
            parted.append(some)
            shared = some if shared is None else shared.unionByName(some)
        write.drop(rows)
        near = shared.where("near").select("place", "mark", F.col("hub").alias("other"))
        if level > 1:
            near = near.join(gone, ["place", "mark"], "left_anti")
        gone = merged(gone, verified(near.select("place", "other").distinct()))
        write.settle()
        # Keys of three lines or more have pairs without the earliest line.
        many, gone_rows = shared.where("size > 2"), rows_of(shared.where("size > 2"), gone, ["place", "mark"]).withColumn("out", F.lit(True))
        left = without(many, gone, ["place", "mark"]).withColumn("out", F.lit(None).cast("boolean")).unionByName(gone_rows)
        left = left.withColumns({"hot": F.col("size") > F.lit(HOT if level < LEVELS else _bits(62)), "open": F.col("out").isNull()}).drop("hub", "size", "near", "out")
        left = write(left)
        write.drop(*parted)
        write.settle()
        # Lines so short that a match may need no more words than a key has cannot go on to a longer key.
        n = F.shiftright("load", POSITION_BITS + MAP_BITS)
        here = left.where(~F.col("hot") | (_need(n, n * percent / 100, percent) <= level))
        other = here.select("key", F.col("place").alias("other"), F.col("load").alias("other_load"))
        more = here.where("open").join(other, "key").where((F.col("other") < F.col("place")) & _may_match("load", "other_load", percent, level))
        gone = merged(gone, verified(more.select("place", "other").distinct()))
        hot = left.where("hot")
        if level == LEVELS or hot.where("open").isEmpty():
            write.drop(left)
            break
        longer = rows_of(lines.select("place", "mark", "n", "map", "rarest"), hot, ["place"]).withColumn("words", _prefix(percent, level + 1)).drop("rarest")
        rows = hot.select("key", "place", "mark", (F.col("tok") if level > 1 else F.col("key")).alias("tok")).join(longer, ["place", "mark"])
        at = F.array_position("words", F.col("tok")).cast("int")
        rows = rows.select("key", "place", "mark", "n", "map", at.alias("at"), F.posexplode(F.slice("words", at + 1, F.greatest(F.size("words") - at, F.lit(0)))).alias("i", "tok"))
        rows = rows.select(F.xxhash64("key", "tok").alias("key"), "place", "mark", _load(F.col("at") + F.col("i")).alias("load"), "tok")
        rows = write(rows)
        write.drop(left)
    out = copies.unionByName(gone).distinct()
    out = write(rows_of(lines.select("place", "mark", "doc"), out, ["place", "mark"]).distinct())
    write.drop(lines, copies, gone)
    write.settle()
    if shift:
        return out.select(F.when(F.col("place") >= 1 << shift, F.shiftright("place", shift) + (low - 1)).cast(kind).alias("id"), "doc", (F.col("place") % (1 << shift)).cast("int").alias("pos"))
    return out.select("place.id", "doc", "place.pos")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, lines: str | None = None, gone: str | None = None) -> DataFrame:
    """docs with later matching lines taken out of the text. `lines` and `gone` name columns to add: lines there were, and lines removed."""
    found = removed_lines(docs, id_col=id_col, text_col=text_col, percent=percent)
    key, text_key, hits, own = (fresh(docs, c) for c in ("removed_id", "removed_doc", "removed_lines", "own_doc"))
    by_doc = found.groupBy(F.col("id").alias(key), F.col("doc").alias(text_key)).agg(F.collect_set("pos").alias(hits))
    df = docs.withColumn(own, F.xxhash64(text_col))
    df = df.join(by_doc, same(F.col(id_col), F.col(key)) & (F.col(own) == F.col(text_key)), "left")
    cut = F.split(F.col(text_col), "\n", -1)
    stay = F.array_join(F.filter(cut, lambda line, i: ~F.array_contains(F.col(hits), i)), "\n")
    text = F.when(F.col(hits).isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(stay)
    extra = []
    if lines:
        extra.append(F.coalesce(F.size(cut), F.lit(0)).cast("long").alias(lines))
    if gone:
        extra.append(F.when(F.col(hits).isNull() | F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(hits)).cast("long").alias(gone))
    return df.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], *extra)


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, and the text that is left."""
    df = dedup(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), percent=percent, lines="n_lines", gone="n_removed")
    return df.select("doc_id", "n_lines", "n_removed", "text")


def keep_distinct(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs without repeated lines; documents that lose every line that says something go, all others stay. Columns as they were."""
    left = fresh(docs, "gone")
    df = dedup(docs, id_col=id_col, text_col=text_col, percent=percent, gone=left)
    return df.where((F.col(left) == 0) | (F.btrim(F.col(text_col), F.lit(" \t\x0b\x0c\r\n")) != "")).select(*docs.columns)


def reference(docs: list[tuple[int, str | None]], percent: int = PERCENT) -> dict[int, str | None]:
    """The same by brute force, for tests: doc_id -> text."""
    import re

    rows = []
    for d, t in sorted(docs):
        for i, line in enumerate((t or "").split("\n")):
            rows.append((d, i, line, {w for w in re.split("[\x20\x09-\x0d]+", line.lower()) if w}))
    out: dict[int, list[str]] = {d: [] for d, _ in docs}
    seen: list[set] = []
    for d, _, line, words in rows:
        if words:
            match = any(100 * len(words & s) >= percent * len(words | s) for s in seen)
            seen.append(words)
            if match:
                continue
        out[d].append(line)
    return {d: None if t is None else "\n".join(out[d]) for d, t in docs}
