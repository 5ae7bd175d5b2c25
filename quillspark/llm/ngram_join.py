"""N-gram Jaccard join with PartEnum signatures.

A document's set is its distinct word n-grams, as 64-bit hashes. Sizes fall into bands [l, 100 l / percent]; two
sets that link lie in one band or in neighbouring ones, and differ in at most k = 2 r (100 - percent) / (100 +
percent) features, r the upper end of the upper band. For a band the feature domain is partitioned into groups
of cells by hash: of k / 2 + 1 groups at least one holds at most one difference. A group has two halves of four
cells, and one half at least is equal in both sets: each half is hashed into a signature. A half of fewer than FEW
features says little (empty ones would meet each other), so it is joined by either pair of the other half's cells,
and if that is still little, by either cell of the last pair; every choice keeps the at most one difference outside
of what is hashed, so sets that link share a signature. A set signs for its own band and for the next.

Plan, with rows in the order of documents:
1. One pass over the texts writes (id, size, 128-bit hash of the set, signatures). Equal sets become one
   representative by an aggregation; copies never meet again until the end.
2. Signatures of representatives are grouped, in PARTS by their hash to bound the disk; groups of one vanish. A
   group's hub is the member that meets most others over all its signatures. Members join their hub, not each other,
   so a group of m makes m pairs. The joins on the signature can be split where they are skewed, as their other side
   has one row a key.
3. Pairs are made distinct; those that sizes and parity maps of the sets still allow are verified exactly on the
   sets; links give components.
4. In groups whose members are now all in one component no pair is left to find. Where there are several, members
   are paired with the next hub (HUB_ROUNDS more). What is left after that is compared in the order of signatures,
   BLOCK members with BLOCK members at a time, without a row for each pair: only pairs that may link become rows. A
   pair is only skipped where it can't matter: both in one component, or a link is ruled out by sizes, by parity maps
   of the sets, or by the triangle inequality of the Jaccard distances to the hub.
So no link between different components is lost, and components are those of all links.

Defined results: a null or wordless text has an empty set, size 0, and is a class of its own; fewer words than n
make one n-gram of the whole text; rows that share an id are one node of the graph; null ids are a node without
a number, whose component is the least id linked with it or null; an empty table gives no rows. Columns other
than id and text are not read.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ._common import NOT_SPACE, Written, as_bytes, fresh, mix, rows_of, runs_hashed, same, with_struct, words_hashed
from ._graph import components

#: PARTS: the signatures are looked at in so many parts, one after another, so that no more than one part's shuffle files are there at once.
#: BLOCK: members of a group that are compared with each other in one task.
HUB_ROUNDS, PARTS, MAP_SHARE, FEW, BLOCK = 1, 4, 24, 2, 1024
_PLACE = np.uint64(0x9E3779B97F4A7C15)
SET = StructType([StructField("n", LongType()), StructField("a", LongType()), StructField("b", LongType()), StructField("sigs", ArrayType(LongType())), StructField("items", ArrayType(LongType())), StructField("map", ArrayType(LongType()))])


def shingle_set(data: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams."""
    return np.unique(runs_hashed(words_hashed(data or b"", NOT_SPACE)[2], n))


def set_hash(items: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set; zeros for the empty one."""
    return tuple(np.frombuffer(hashlib.blake2b(items.tobytes(), digest_size=16).digest(), np.int64).tolist()) if len(items) else (0, 0)


class Bands:
    """Size bands and their numbers of differences."""

    def __init__(self, percent: int):
        self.percent, self.ends = percent, [0]

    def of(self, size: int) -> int:
        while self.ends[-1] < size:
            self.ends.append((self.ends[-1] + 1) * 100 // self.percent)
        return bisect.bisect_left(self.ends, size)

    def differences(self, band: int) -> int:
        while len(self.ends) <= band:
            self.ends.append((self.ends[-1] + 1) * 100 // self.percent)
        return 2 * self.ends[band] * (100 - self.percent) // (100 + self.percent)


def signatures(items: np.ndarray, bands: Bands) -> np.ndarray:
    """PartEnum signatures of a set, for its band and the next."""
    band = bands.of(len(items))
    out = []
    for b in (band, band + 1):
        k = bands.differences(b)
        tag = mix(np.array([b], np.uint64) + np.uint64(0x51ED270B7A2C9F31))[0]
        spread = mix(items ^ tag)
        with np.errstate(over="ignore"):
            if not k:
                out.append(mix(np.array([spread.sum(dtype=np.uint64)]) + tag))
                continue
            groups = (k + 2) // 2
            at = (((spread >> np.uint64(33)) % np.uint64(groups)) * np.uint64(8) + (spread & np.uint64(7))).astype(np.int64)
            sums = np.zeros(groups * 8, np.uint64)
            np.add.at(sums, at, mix(spread + np.uint64(1)))
            count = np.bincount(at, minlength=groups * 8)
            quad, pair, one = sums.reshape(-1, 4), sums.reshape(-1, 2, 2), np.arange(1, 2 * groups + 1, dtype=np.uint64) * np.uint64(16)
            half, n = quad[:, 0] + quad[:, 1] + quad[:, 2] + quad[:, 3], count.reshape(-1, 4).sum(axis=1)
            few = np.flatnonzero(n < FEW)  # halves, numbered as 2 * group + side; the other half is few ^ 1
            made = [(half + one * _PLACE)[n >= FEW]]
            if len(few):
                pairs, m = pair.reshape(-1, 2, 2, 2)[few >> 1, (few & 1) ^ 1], count.reshape(-1, 2, 2, 2)[few >> 1, (few & 1) ^ 1]
                for h in (0, 1):
                    more, size = half[few] + pairs[:, h, 0] + pairs[:, h, 1], n[few] + m[:, h].sum(axis=1)
                    made.append((more + (one[few] + np.uint64(1 + h)) * _PLACE)[size >= FEW])
                    left = size < FEW
                    made += [(more + pairs[:, 1 - h, q] + (one[few] + np.uint64(3 + 2 * h + q)) * _PLACE)[left] for q in (0, 1)]
            out.append(mix(mix(np.concatenate(made)) ^ tag))
    return np.unique(np.concatenate(out)).view(np.int64)


def parity_map(items: np.ndarray) -> np.ndarray:
    """Bits that each hold the parity of how many features fall on them; two maps differ in no more bits than their sets differ in features. The words are a power of two, one for MAP_SHARE features or fewer, so that maps of long sets tell as much as those of short ones; halves laid over each other are the map of half the size."""
    words = 1 << max(0, (len(items) - 1) // MAP_SHARE).bit_length()
    place = items % np.uint64(64 * words)
    out = np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out.view(np.int64)


def _sets(docs: DataFrame, n: int, percent: int, signed: bool) -> DataFrame:
    """doc_id, n, a, b and either signatures or the sets themselves."""

    def run(texts: pa.Array) -> pa.StructArray:
        bands = Bands(percent)
        rows = []
        for data in as_bytes(texts):
            items = shingle_set(data, n)
            if not len(items):
                rows.append((0, 0, 0, [], [], []))
                continue
            a, b = set_hash(items)
            rows.append((len(items), a, b, signatures(items, bands) if signed else [], [] if signed else items.view(np.int64), parity_map(items) if signed else []))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 3
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], SET.names)

    df = with_struct(docs, "s", SET, ["text"], run)
    return df.select(*[c for c in docs.columns if c != "text"], "s.n", "s.a", "s.b", *(["s.sigs", "s.map"] if signed else ["s.items"]))


def _folded(m: Column, words: Column) -> Column:
    """A parity map in half its words where it has more than `words`."""
    return F.when(F.size(m) > words, F.zip_with(F.slice(m, F.lit(1), words), F.slice(m, words + 1, words), lambda x, y: x.bitwiseXOR(y))).otherwise(m)


def _apart(x: Column, y: Column) -> Column:
    """In how many bits two parity maps differ, of which one has at most twice the other's words."""
    words = F.least(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(_folded(x, words), _folded(y, words), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, z: t + z)


def near_pairs(vid: np.ndarray, n: np.ndarray, label: np.ndarray, far: np.ndarray, side: np.ndarray, maps: list[np.ndarray], percent: int) -> np.ndarray:
    """The pairs of a group's members (rows of two vids, the lesser first) that may link: of different labels and, where there are two sides, of different sides; sizes, distances to the hub (nan where unknown) and parity maps allow a link."""
    words = min(map(len, maps))
    bits = np.stack([np.bitwise_xor.reduce(m.reshape(-1, words), axis=0) for m in maps]).view(np.uint64)
    # The members of the commonest label come last: no two of them need a look.
    labels, at, times = np.unique(label, return_inverse=True, return_counts=True)
    order = np.argsort(times[at], kind="stable")
    order = order[np.lexsort((at[order] == times.argmax(),))]
    vid, n, label, far, side, bits = vid[order], n[order], label[order], far[order], side[order], bits[order]
    first, halves = len(vid) - int(times.max()), side.min() != side.max()
    reach, out = (100 - percent) / 100 + 1e-9, []
    step = max(1, (1 << 21) // (len(vid) * words))
    for a in range(0, first, step):
        b = min(a + step, first)
        x, y = np.arange(a, b)[:, None], np.arange(a + 1, len(vid))[None, :]
        total = n[x] + n[y]
        may = (x < y) & (label[x] != label[y]) & (n[x] * 100 >= n[y] * percent) & (n[y] * 100 >= n[x] * percent) & ~(np.abs(far[x] - far[y]) > reach)
        if halves:
            may &= side[x] != side[y]
        i, j = np.nonzero(may)
        i, j, total = i + a, j + a + 1, total[i, j]
        apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        near = apart * (100 + percent) <= total * (100 - percent)
        out.append(np.stack([np.minimum(vid[i], vid[j])[near], np.maximum(vid[i], vid[j])[near]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _compared(left: DataFrame, traits: DataFrame, percent: int) -> DataFrame:
    """The pairs (vid, hub) that `near_pairs` finds in the groups of left (sig, vid, n, l, far). A group of several blocks goes out as pairs of blocks, so that it is no one task's work."""
    sizes = left.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cut = left.select("sig", "vid", "n", "l", "far").join(sizes, "sig").withColumn("mine", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # A pair of blocks has one block's members on each side; a block alone, which has no sides, is compared within itself.
    cut = cut.select("sig", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "vid", "n", "l", F.coalesce("far", F.lit(float("nan"))).alias("far"))
    cut = cut.join(traits.select("vid", "map"), "vid").select("sig", "lo", "hi", "mine", "vid", "n", "l", "far", "map")
    cut = cut.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
            sig, lo, hi, mine, vid, n, label, far = (table.column(i).to_numpy() for i in range(8))
            maps = table.column(8).combine_chunks()
            starts, flat = maps.offsets.to_numpy(), maps.values.to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(sig) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
            found = []
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(sig)], strict=True):
                if b - a > 1 and (lo[a] == hi[a] or mine[a:b].min() != mine[a:b].max()):
                    found.append(near_pairs(vid[a:b], n[a:b], label[a:b], far[a:b], mine[a:b], [flat[starts[i] : starts[i + 1]] for i in range(a, b)], percent))
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            for i in range(0, len(pairs), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + (1 << 16), 0]), pa.array(pairs[i : i + (1 << 16), 1])], names=["vid", "hub"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows from the batch's last key on wait for the next batch.
            key = [batch.column(i).to_numpy() for i in range(3)]
            last = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]) | (key[2] != key[2][-1]))
            at = int(last[-1]) + 1 if len(last) else 0
            if at or (rest and any(rest[-1].column(i)[-1] != batch.column(i)[0] for i in range(3))):
                yield from groups(pa.Table.from_batches([*rest, batch.slice(0, at)]))
                rest = []
            rest.append(batch.slice(at))
        if rest:
            yield from groups(pa.Table.from_batches(rest))

    return cut.mapInArrow(run, "vid long, hub long").distinct()


def _labelled(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, doc, n, a, b) of each row of `docs` (doc_id, text), doc the text's hash; and (a, b, owner, l) of each set that is not empty: its least id and its component."""
    write = Written(docs.sparkSession, "ngram-join")
    signed = write(_sets(docs.withColumn("doc", F.xxhash64("text")), n, percent, True))
    # Copies of a set meet map-side first, so that a set that many documents have is one row a task.
    owners, parted = None, []
    for part in range(PARTS):
        some = signed.where((F.col("n") > 0) & (F.pmod("a", F.lit(PARTS)) == part)).groupBy("a", "b")
        some = some.agg(F.min("doc_id").alias("owner"), F.first("n").alias("n"), F.first("map").alias("map"), F.first("sigs").alias("sigs"))
        some = write(some.withColumn("vid", F.monotonically_increasing_id() * PARTS + part))
        write.settle()
        parted.append(some)
        owners = some if owners is None else owners.unionByName(some)
    members = write(signed.select("doc_id", "doc", "n", "a", "b"))
    write.drop(signed)
    write.settle()
    rows = None
    for part in range(PARTS):
        signs = owners.select(F.explode("sigs").alias("sig"), "vid", "n").where(F.pmod("sig", F.lit(PARTS)) == part)
        groups = signs.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1")
        some = write(signs.join(groups, "sig"))
        write.settle()
        rows = some if rows is None else rows.unionByName(some)
    # The hub is the member that meets most others over all its signatures: of a family of edited copies that is the text they were made from.
    met = rows.groupBy("vid").agg(F.sum("size").alias("met"))
    bare, rows = rows, rows.drop("size").join(met, "vid")
    first = F.max(F.struct("met", "vid", "n"))
    rows = write(rows.join(rows.groupBy("sig").agg(first.alias("h")).select("sig", F.col("h.vid").alias("hub"), F.col("h.n").alias("hub_n")), "sig"))  # of groups with several members: sig, vid, n, met, hub, hub_n
    write.settle()
    traits = write(owners.select("vid", "n", "map").join(rows.select("vid").distinct(), "vid", "left_semi"))
    owners = write(owners.select("vid", "owner", "a", "b"))
    write.drop(*parted)

    def sized(n: str, m: str) -> Column:
        """Whether two sizes allow a link."""
        return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)

    def mapped(pairs: DataFrame) -> DataFrame:
        """The pairs (vid, hub) of fitting sizes whose parity maps allow a link."""
        both = pairs.join(traits, "vid").join(traits.select(F.col("vid").alias("hub"), F.col("n").alias("other_n"), F.col("map").alias("other_map")), "hub")
        return both.where(_apart(F.col("map"), F.col("other_map")) * (100 + percent) <= (F.col("n") + F.col("other_n")) * (100 - percent)).select("vid", "hub")

    def verified(pairs: DataFrame) -> DataFrame:
        """(vid, hub, linked, far): far is the Jaccard distance. Only the texts of documents in pairs are read again."""
        pairs = write(pairs)
        if pairs.isEmpty():
            return pairs.select("vid", "hub", F.lit(False).alias("linked"), F.lit(0.0).alias("far"))
        wanted = write(owners.join(pairs.select("vid").union(pairs.select("hub")).distinct(), "vid", "left_semi"))
        texts = rows_of(docs, wanted.select(F.col("owner").alias("doc_id")), ["doc_id"])
        sets = write(_sets(texts, n, percent, False).dropDuplicates(["a", "b"]).join(wanted.select("vid", "a", "b"), ["a", "b"]).select("vid", "items"))
        x = sets.select("vid", F.col("items").alias("x"))
        y = sets.select(F.col("vid").alias("hub"), F.col("items").alias("y"))
        both = pairs.join(x, "vid").join(y, "hub").select("vid", "hub", F.size(F.array_intersect("x", "y")).cast("long").alias("i"), (F.size("x") + F.size("y")).cast("long").alias("t"))
        out = write(both.select("vid", "hub", (F.col("i") * 100 >= F.lit(percent) * (F.col("t") - F.col("i"))).alias("linked"), (1 - F.col("i") / (F.col("t") - F.col("i"))).alias("far")))
        write.drop(pairs, wanted, sets)
        write.settle()
        return out

    pairs = rows.where((F.col("vid") != F.col("hub")) & sized("n", "hub_n")).select("vid", "hub").distinct()
    tested = verified(mapped(pairs))
    start = rows
    links = tested.where("linked").select(F.col("vid").alias("u"), F.col("hub").alias("v"))
    label = components(links, write)
    reach = (100 - percent) / 100 + 1e-9
    for turn in range(HUB_ROUNDS + 1):
        # What hubs leave behind: members other than the hub, in groups with several components.
        marked = rows.where("vid <> hub").join(label.select(F.col("u").alias("vid"), F.col("v").alias("l")), "vid", "left").withColumn("l", F.coalesce("l", "vid"))
        several = marked.groupBy("sig").agg(F.min("l").alias("lo"), F.max("l").alias("hi"), first.alias("h")).where("lo <> hi").select("sig", F.col("h.vid").alias("next"))
        left = marked.join(several, "sig")
        if turn == 0:
            left = left.join(tested.select("vid", "hub", "far"), ["vid", "hub"], "left")
        left = write(left.select("sig", "vid", "n", "met", F.col("next").alias("hub"), "l", "far"))
        if left.isEmpty():
            break
        if turn < HUB_ROUNDS:
            # A pair may meet under many signatures; its maps are compared once.
            near = sized("n", "other_n") & F.coalesce(F.abs(F.col("far") - F.col("other_far")) <= reach, F.lit(True))
            heads = left.where("vid = hub").select("sig", F.col("l").alias("other_l"), F.col("far").alias("other_far"), F.col("n").alias("other_n")).dropDuplicates(["sig"])
            more = mapped(left.where("vid <> hub").join(heads, "sig").where((F.col("l") != F.col("other_l")) & near).select("vid", "hub").distinct())
        else:
            parts = []
            for part in range(PARTS):
                parts.append(write(_compared(left.where(F.pmod("sig", F.lit(PARTS)) == part), traits, percent)))
                write.settle()
            more = mapped(reduce(DataFrame.unionByName, parts).distinct())
        seen = verified(more)
        found = write(seen.where("linked").select(F.col("vid").alias("u"), F.col("hub").alias("v")))
        if turn:
            write.drop(before)
        if turn == HUB_ROUNDS:
            write.drop(*parts)
        before = left
        rows = left.select("sig", "vid", "n", "met", "hub", "far")
        if not found.isEmpty():
            label = components(label.unionByName(found), write)
        write.drop(found)
    write.drop(start)
    return members, owners.join(label.select(F.col("u").alias("vid"), F.col("v").alias("l")), "vid", "left").select("a", "b", "owner", F.coalesce("l", "vid").alias("l"))


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id. Documents link when 100 * common n-grams >= percent * all n-grams of both."""
    members, named = _labelled(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), n, percent)
    least = named.groupBy("l").agg(F.min("owner").alias("component"))
    named = named.join(least, "l").select("a", "b", "component")
    out = members.join(named, ["a", "b"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each class (the one of least id, null ids last, then of least hash of its set); all columns as they were. A document is an id and a set: rows that share both are one, of which one row stays, and rows that share an id alone are not."""
    members, named = _labelled(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), n, percent)
    least = named.groupBy("l").agg(F.min(F.struct(F.col("owner").isNull().alias("none"), "owner", "a", "b")).alias("r")).select("r.owner", "r.a", "r.b")
    kept = least.unionByName(members.where("n = 0").select(F.col("doc_id").alias("owner"), "a", "b").distinct())
    # Of rows that share id and set the text of least hash stays.
    kept = members.join(kept.select(F.col("owner").alias("o"), F.col("a").alias("x"), F.col("b").alias("y")), same(F.col("doc_id"), F.col("o")) & (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_semi")
    kept = kept.groupBy("doc_id", "a", "b").agg(F.min("doc").alias("doc"), F.count("*").alias("times"))
    key, rank = fresh(docs, "kept_key"), fresh(docs, "rank")
    out = docs.withColumn(key, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("doc")))
    if not kept.where("times > 1").isEmpty():
        # Spark cuts each task's rows to one a key before they are shuffled, so a key that many rows have is no large task.
        out = out.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(key))).where(F.col(rank) == 1)
    return out.join(kept.select(F.struct(F.col("doc_id").alias("id"), "doc").alias(key)), key, "left_semi").select(*docs.columns)


def reference(docs: list[tuple[int, str | None]], n: int = 3, percent: int = 90) -> dict[int, tuple[int, int]]:
    """The same by brute force, for tests: doc_id -> (n_shingles, component_id)."""
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, t in docs:
        w = word.findall((t or "").translate(low))
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[i + 1 :]:
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(x), find(y)
                up[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}
