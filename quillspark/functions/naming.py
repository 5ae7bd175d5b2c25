"""File names, series, windows and schema identities."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import STATES

UFS = tuple(sorted(STATES.values()))
_UF = "|".join([*UFS, "BR"])
#: Endings of packed files that are cut as one.
STACKS = (".duck.zip", ".csv.zip", ".json.zip", ".xml.zip", ".dbf.zip", ".dbc.zip", ".parquet.zip", ".csv.gz", ".json.gz", ".xml.gz", ".dbf.gz", ".dbc.gz", ".tar.gz")
_STACKS = "|".join(re.escape(s) for s in STACKS)
#: What a file's ending says of its role.
ROLES = {
    "dbc": "data", "dbf": "data", "csv": "data", "parquet": "data", "json": "data", "xml": "data", "zip": "data", "gz": "data", "duckdb": "data", "xlsx": "data",
    "cnv": "cnv", "def": "def", "pdf": "documentation", "doc": "documentation", "docx": "documentation", "txt": "documentation", "htm": "documentation", "html": "documentation", "md": "documentation",
    "exe": "auxiliary", "dll": "auxiliary", "ini": "auxiliary",
}


def schema_signature(names: list[str]) -> str:
    """First 16 hex digits of the SHA-256 of the ordered upper-case names."""
    return hashlib.sha256("\x1f".join(n.upper() for n in names).encode()).hexdigest()[:16]


def schema_signature_col(names: Column) -> Column:
    """The same over an array column."""
    return F.substring(F.sha2(F.array_join(F.transform(names, F.upper), "\x1f").cast("binary"), 256), 1, 16)


def family_id(system: Column, series: Column, signature: Column) -> Column:
    """system_series_ and ten digits of the signature."""
    return F.concat_ws("_", system, series, F.substring(signature, 1, 10))


@dataclass(frozen=True)
class Parsed:
    prefix: Column
    geo: Column
    digits: Column


def parse_file_name(path: Column) -> Parsed:
    """Prefix, state and date digits of a file name (P41, P42): prefix+state+date, prefix_state_date, prefix+date with a state at the prefix's end, name_state, or plain."""
    name = F.upper(F.regexp_replace(F.element_at(F.split(path, "[/\\\\]"), -1), rf"(?i)({_STACKS}|\.[A-Za-z0-9]+)$", ""))
    classic = rf"^([A-Z][A-Z0-9]+?)({_UF})(\d{{2,8}})$"
    parted = rf"^([A-Z][A-Z0-9]*)[_-]({_UF})[_-]?(\d{{2,8}})$"
    dated = r"^([A-Z][A-Z_]*?)[_-]?(\d{2,8})$"
    named = rf"^([A-Z][A-Z0-9]*)[_-]({_UF})$"
    pick = lambda i: F.coalesce(*[F.nullif(F.regexp_extract(name, p, g), F.lit("")) for p, g in ((classic, i), (parted, i))])
    plain = F.nullif(F.regexp_extract(name, dated, 1), F.lit(""))
    prefix = F.coalesce(pick(1), plain, F.nullif(F.regexp_extract(name, named, 1), F.lit("")), name)
    geo = F.coalesce(pick(2), F.nullif(F.regexp_extract(name, named, 2), F.lit("")))
    digits = F.coalesce(pick(3), F.nullif(F.regexp_extract(name, dated, 2), F.lit("")))
    return Parsed(prefix, geo, digits)


def two_digit_year(value: Column, epoch: int | None = None) -> Column:
    """Full year: with a century (1900, 2000) fixed, or by pivot 40."""
    n = value.try_cast("int")
    if epoch:
        return n + epoch
    return F.when(n <= 40, n + 2000).otherwise(n + 1900)


def resolved_date(digits: Column, convention: Column | str, epoch: int | None = None) -> Column:
    """YYYYMM of a name's digits under a convention: explicit (YYYYMM or YYYY), monthly (YYMM), annual (YY or YYYY); month 0 says annual; contradictions are NULL."""
    conv = F.lit(convention) if isinstance(convention, str) else convention
    n = F.length(digits)
    year4 = F.substring(digits, 1, 4).try_cast("int")
    month = F.substring(digits, 5, 2).try_cast("int")
    explicit = F.when((n == 6) & year4.between(1900, 2100) & month.between(1, 12), year4 * 100 + month).when((n == 4) & year4.between(1900, 2100), year4 * 100)
    mm = F.substring(digits, 3, 2).try_cast("int")
    monthly = F.when((n == 4) & mm.between(1, 12), two_digit_year(F.substring(digits, 1, 2), epoch) * 100 + mm).when((n == 6), explicit)
    annual = F.when(n == 2, two_digit_year(digits, epoch) * 100).when((n == 4) & year4.between(1900, 2100), year4 * 100)
    return F.when(conv == "explicit", explicit).when(conv == "monthly", monthly).when(conv == "annual", annual)


def logical_id(system: Column, prefix: Column, geo: Column, date: Column, path: Column) -> Column:
    """SYSTEM|PREFIX|GEO|DATE, or the path where the name says nothing."""
    return F.when(date.isNotNull() | geo.isNotNull(), F.concat_ws("|", F.upper(system), prefix, F.coalesce(geo, F.lit("")), F.coalesce(date.cast("string"), F.lit("")))).otherwise(F.concat_ws("|", F.upper(system), path))


def system_of(path: Column, base: str = "") -> Column:
    """First path element under the base."""
    rest = F.regexp_replace(path, "^" + re.escape(base.rstrip("/")) + "/?", "") if base else F.regexp_replace(path, "^/", "")
    return F.nullif(F.split_part(rest, F.lit("/"), F.lit(1)), F.lit(""))


def role_of(path: Column) -> Column:
    """data, cnv, def, documentation or auxiliary, by the ending and by folders that hold documents."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    docs = F.lower(path).rlike(r"(^|/)(doc|docs|documenta[^/]*|manual[^/]*)/")
    return F.when(docs, "documentation").otherwise(F.coalesce(F.try_element_at(table, ending), F.lit("auxiliary")))


def kit_window(path: Column) -> list[Column]:
    """(from, to) as YYYYMM out of a kit's name, else of its path."""
    pattern = r"(\d{6})[-_](\d{6})"
    name = F.element_at(F.split(path, "/"), -1)
    pick = lambda i: F.coalesce(F.nullif(F.regexp_extract(name, pattern, i), F.lit("")), F.nullif(F.regexp_extract(path, pattern, i), F.lit(""))).try_cast("int")
    return [pick(1), pick(2)]


def window_key(c: Column) -> Column:
    """Digits of a validity bound, or nothing."""
    return F.coalesce(F.regexp_replace(c.cast("string"), r"\D", ""), F.lit(""))


def canonical_series(series: Column) -> Column:
    """A series' name by rules, first match wins: what stands before an archive member's colon, placeholder template, year tail, file-name form with a part's suffix, else the trimmed text in upper case."""
    s = F.upper(F.trim(series))
    found = lambda pattern: F.nullif(F.regexp_extract(s, pattern, 1), F.lit(""))
    rules = [r"^([A-Z]{2,6})UFAAMM$", r"^([A-Z0-9_]+?)_(?:19|20)\d{2}$", rf"^([A-Z]{{2,6}}?)(?:{_UF})\d{{2,8}}(?:_\d+|[A-Z])?$"]
    return F.when(F.contains(s, F.lit(":")), F.split_part(s, F.lit(":"), F.lit(1))).otherwise(F.coalesce(*[found(r) for r in rules], s))


def dataset_spec(spec: str, aliases: dict[str, str] | None = None) -> tuple[str, str | None]:
    """(system, series) of a name such as AAA-BB, AAA.BB or AAA_BB."""
    m = re.fullmatch(r"\s*([A-Za-z0-9]+)(?:[-._/](.+?))?\s*", spec)
    if not m:
        raise ValueError(f"not a dataset name: {spec!r}")
    system = m[1].upper()
    return (aliases or {}).get(system, system), m[2].upper() if m[2] else None


def date_conventions(files: DataFrame, now: int | None = None) -> DataFrame:
    """(folder, convention, epoch) of each folder's date digits (A60, A61), by two aggregations. files: folder, series (NULL: unknown), digits; `now` is the year up to whose sixtieth successor a reading may go.

    Six digits everywhere are explicit, two everywhere annual. Of four, a first half with tails beyond a month's is a
    year; any other lead than a century's, or a series with several tails to one lead, is monthly; else annual where
    series are known, and ambiguous where they are not. The epoch of two-digit codes is the reading with the least
    span of years that is allowed, the earlier of pivot, 2000 and 1900 where spans are equal.
    """
    d, n = F.col("digits"), F.length("digits")
    lead, tail = F.substring(d, 1, 2), F.substring(d, 3, 2)
    some = files.where(n > 0).withColumns({"__lead": F.when(n == 4, lead), "__tail": F.when(n == 4, tail.try_cast("int")), "__two": F.when(n == 2, d.try_cast("int"))})
    is4 = F.col("__lead").isNotNull()
    part = some.groupBy("folder", "series", "__lead").agg(
        F.count("*").alias("n"), F.count_if(n == 6).alias("n6"), F.count_if(n == 2).alias("n2"), F.count_if(is4).alias("n4"), F.count_if(is4 & F.col("__tail").between(1, 12)).alias("months"),
        F.count_if(is4 & ~F.col("__lead").isin("19", "20")).alias("odd"), F.count_distinct("__tail").alias("tails"),
        *[f(F.col("__two") + F.when(F.lit(base is None) & (F.col("__two") > 40), 1900).otherwise(base or 2000)).alias(f"{k}_{f.__name__}") for k, base in (("pivot", None), ("y2000", 2000), ("y1900", 1900)) for f in (F.min, F.max)],
    )
    kinds = ("pivot", "y2000", "y1900")
    t = part.groupBy("folder").agg(*[F.sum(c).alias(c) for c in ("n", "n6", "n2", "n4", "months", "odd")], F.max("tails").alias("tails"), (F.count("series") > 0).alias("named"), *[g(f"{k}_{m}").alias(f"{k}_{m}") for k in kinds for g, m in ((F.min, "min"), (F.max, "max"))])
    convention = (
        F.when(F.col("n6") == F.col("n"), "explicit").when(F.col("n2") == F.col("n"), "annual").when(F.col("n4") == 0, "ambiguous").when(F.col("months") < 0.98 * F.col("n4"), "annual")
        .when((F.col("odd") > 0) | (F.col("tails") > 1), "monthly").otherwise(F.when(F.col("named"), "annual").otherwise("ambiguous"))
    )
    last = F.lit(now) if now else F.year(F.current_date())
    spans = F.array(*[F.when((F.col(f"{k}_max") <= last + 60) & (F.col(f"{k}_min") >= 1900), F.struct((F.col(f"{k}_max") - F.col(f"{k}_min")).alias("span"), F.lit(i).alias("rank"), F.lit(k.lstrip("y")).alias("epoch"))) for i, k in enumerate(kinds)])
    return t.select("folder", convention.alias("convention"), F.array_min(spans)["epoch"].alias("epoch"))
