"""Text, tokens, code ranges and names."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .types import stripped

MOST_IN_RANGE = 100_000


def folded(c: Column) -> Column:
    """Lower case without accents (P50)."""
    return F.lower(F.regexp_replace(_decomposed(c), r"\p{M}", ""))


#: Accented Latin letters and their bases, in one order.
_ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"


def _decomposed(c: Column) -> Column:
    base = "".join(unicodedata.normalize("NFKD", x)[0] for x in _ACCENTED)
    return F.translate(c, _ACCENTED, base)


def fold(text: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", text) if not unicodedata.combining(x)).lower()


def squash(name: Column) -> Column:
    """A field name's letters and digits in upper case, for affinity."""
    return F.upper(F.regexp_replace(_decomposed(name), "[^A-Za-z0-9]", ""))


def affinity(field: Column, codelist: Column) -> Column:
    """0 for equal names, 1 where one begins with the other, else 2."""
    a, b = squash(field), squash(codelist)
    return F.when(a == b, 0).when(F.startswith(a, b) | F.startswith(b, a), 1).otherwise(2)


def code_and_label(code: Column, label: Column) -> Column:
    """`code – label`, or the one that is there."""
    return F.when(code.isNull(), label).when(label.isNull(), code).otherwise(F.concat(code, F.lit(" – "), label))


def tokens(c: Column, delimiters: str | None = None, width: int | None = None) -> Column:
    """A packed cell's tokens, in order, blanks dropped: parted by any of the delimiters, or of fixed width."""
    v = c.cast("string")
    if width:
        parts = F.regexp_extract_all(v, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    else:
        parts = F.split(v, "[" + "".join(re.escape(x) for x in (delimiters or ",")) + "]")
    return F.filter(F.transform(parts, stripped), lambda x: x != "")


def labelled_tokens(parts: Column, lookup: Column, separator: str = " | ") -> Column:
    """Each token with its label where it has one, joined (P29). `lookup` is a map."""
    return F.when(parts.isNotNull(), F.array_join(F.transform(parts, lambda t: F.concat_ws(" ", t, F.try_element_at(lookup, t))), separator))


def misses(parts: Column, lookup: Column) -> Column:
    """How many tokens have no label."""
    return F.size(F.filter(parts, lambda t: F.try_element_at(lookup, t).isNull()))


def company_split(label: Column) -> list[Column]:
    """(14-digit id, name) out of a label that begins with the id."""
    pattern = r"^\s*(\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2})\s*[-–:]?\s*(.*)$"
    found = F.regexp_extract(label, pattern, 1)
    return [F.nullif(F.regexp_replace(found, r"\D", ""), F.lit("")), F.when(found != "", F.nullif(F.trim(F.regexp_extract(label, pattern, 2)), F.lit(""))).otherwise(label)]


def useful_label(code: Column, label: Column) -> Column:
    """Neither blank, nor of a code with a space in it, nor the code again."""
    c, t = stripped(code), stripped(label)
    return F.coalesce((t != "") & ~F.contains(c, F.lit(" ")) & (c != "") & (F.lower(c) != F.lower(t)), F.lit(False))


def successor(code: Column) -> Column:
    """The next numeric code, as wide."""
    n = F.when(code.rlike(r"^\d+$"), code).try_cast("decimal(38,0)") + 1
    return F.when(code.rlike(r"^\d+$"), F.when(F.length(n.cast("string")) > F.length(code), n.cast("string")).otherwise(F.lpad(n.cast("string"), F.length(code), "0")))


def code_range(lo: Column, hi: Column, most: int = MOST_IN_RANGE) -> Column:
    """All numeric codes from lo to hi, padded to lo's width; NULL where there are none or more than `most`."""
    a, b = F.when(lo.rlike(r"^\d+$"), lo).try_cast("bigint"), F.when(hi.rlike(r"^\d+$"), hi).try_cast("bigint")
    ok = (b >= a) & (b - a < most)
    width = F.length(lo)
    return F.when(ok, F.transform(F.sequence(F.when(ok, a), F.when(ok, b)), lambda n: F.when(F.length(n.cast("string")) >= width, n.cast("string")).otherwise(F.lpad(n.cast("string"), width, "0"))))


def in_code_range(code: Column, lo: Column, hi: Column) -> Column:
    """Whether a code's prefix of lo's (hi's) length lies between them, as text."""
    return (F.substring(code, F.lit(1), F.length(lo)) >= lo) & (F.substring(code, F.lit(1), F.length(hi)) <= hi)


def expanded(expressions: DataFrame, universe: DataFrame | None = None, width: int = 0) -> DataFrame:
    """Codes of match expressions (P34): rows (id, seq, expression) become (id, seq, code, rule).

    An expression is a comma list of codes and of ranges lo-hi. Numeric ranges are listed, padded to `width`;
    other ranges pick from `universe` (column code). What cannot be listed stays as a rule (lo-hi), code NULL.
    """
    part = expressions.select("id", "seq", F.explode(F.filter(F.transform(F.split("expression", ","), F.trim), lambda x: x != "")).alias("part"))
    part = part.withColumn("lo", F.trim(F.split_part("part", F.lit("-"), F.lit(1)))).withColumn("hi", F.trim(F.split_part("part", F.lit("-"), F.lit(2))))
    pad = lambda c: F.when(c.rlike(r"^\d+$") & (F.length(c) < width), F.lpad(c, width, "0")).otherwise(c) if width else c
    part = part.withColumns({"lo": pad(F.col("lo")), "hi": pad(F.col("hi"))})
    single = part.where("hi = ''").select("id", "seq", F.col("lo").alias("code"), F.lit(None).cast("string").alias("rule"))
    ranged = part.where("hi <> ''").withColumn("list", code_range(F.col("lo"), F.col("hi")))
    listed = ranged.where("list is not null").select("id", "seq", F.explode("list").alias("code"), F.lit(None).cast("string").alias("rule"))
    other = ranged.where("list is null").select("id", "seq", "lo", "hi")
    if universe is None:
        return single.unionByName(listed).unionByName(other.select("id", "seq", F.lit(None).cast("string").alias("code"), F.concat("lo", F.lit("-"), "hi").alias("rule")))
    # The first character is an equi-join key where lo and hi share it; ranges that cross it take one row a character.
    span = F.transform(F.sequence(F.ascii("lo"), F.greatest(F.ascii("lo"), F.ascii("hi"))), lambda x: F.char(x))
    keyed = other.withColumn("k", F.explode(span))
    u = universe.select("code").distinct().withColumn("k", F.substring("code", 1, 1))
    hit = keyed.join(u, "k").where(in_code_range(F.col("code"), F.col("lo"), F.col("hi"))).select("id", "seq", "lo", "hi", "code")
    rules = other.join(hit.select("id", "seq", "lo", "hi").distinct(), ["id", "seq", "lo", "hi"], "left_anti").select("id", "seq", F.lit(None).cast("string").alias("code"), F.concat("lo", F.lit("-"), "hi").alias("rule"))
    return single.unionByName(listed).unionByName(hit.select("id", "seq", "code", F.lit(None).cast("string").alias("rule"))).unionByName(rules)


def distance(a: Column, b: Column) -> Column:
    """Edit distance."""
    return F.levenshtein(a, b)


def suggestions(names: DataFrame, name_col: str, target: str, limit: int = 5, most: int = 3) -> DataFrame:
    """Names near a target: those it begins first, then by distance, then by name."""
    d = F.levenshtein(F.upper(F.col(name_col)), F.lit(target.upper()))
    return names.select(F.col(name_col).alias("name"), d.alias("distance")).where(F.col("distance") <= most).orderBy("distance", "name").limit(limit)


#: Letters that are plausible in Portuguese text.
EXPECTED = "áàâãéêíóôõúüçÁÀÂÃÉÊÍÓÔÕÚÜÇªº"


def plausibility(text: str) -> int:
    """+1 for each expected accent, -3 for any other non-ASCII character, -5 for a control character."""
    score = 0
    for ch in text:
        if ch in EXPECTED:
            score += 1
        elif ord(ch) > 126 and not ch.isspace():
            score -= 3
        elif ord(ch) < 32 and ch not in "\t\r\n":
            score -= 5
    return score


def best_decoding(data: bytes, candidates: tuple[str, ...] = ("utf-8", "cp850", "cp1252", "latin-1"), sample: int = 65_536) -> str:
    """The candidate encoding whose reading of a sample is most plausible; valid UTF-8 with accents wins."""
    part = data[:sample]
    best, found = None, "latin-1"
    for name in candidates:
        try:
            text = part.decode(name)
        except UnicodeDecodeError as e:
            if name != "utf-8" or len(part) - e.start > 3 or len(data) <= sample:
                continue
            text = part[: e.start].decode(name)
        score = plausibility(text)
        if best is None or score > best:
            best, found = score, name
    return found
