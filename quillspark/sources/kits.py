"""Code tables written in small languages, and directory listings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import expanded


@dataclass
class Conversion:
    """A parsed conversion table: lines (seq, label, expression) in file order."""

    name: str
    width: int
    lines: list[tuple[int, str, str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def expression_column(lines: list[str]) -> int | None:
    """Where the last token starts on most lines, if on three fifths of them."""
    starts = [m.start(1) for x in lines if (m := re.search(r"\s(\S+)\s*$", x))]
    if not starts:
        return None
    mode = max(set(starts), key=starts.count)
    return mode if starts.count(mode) >= 0.6 * len(starts) else None


def parse_conversion(text: str, name: str = "") -> Conversion:
    """A table whose first line gives the number of categories and the code width, and whose lines hold a sequence number, a label and an expression; lines that begin with a semicolon are comments."""
    rows = [x.rstrip("\r") for x in text.split("\n")]
    rows = [x for x in rows if x.strip() and not x.lstrip().startswith(";")]
    m = re.match(r"\s*(\d+)\s+(\d+)", rows[0]) if rows else None
    if not m:
        return Conversion(name, 0, [], ["no header"])
    out = Conversion(name, int(m[2]))
    body = rows[1:]
    column = expression_column(body)
    for x in body:
        seq = re.match(r"\s*(\d+)\s+", x)
        if not seq:
            out.warnings.append(f"no sequence: {x[:40]}")
            continue
        if column and len(x) > column and x[column - 1].isspace():
            label, expression = x[seq.end() : column].strip(), x[column:].strip()
        else:
            part = x[seq.end() :].rsplit(None, 1)
            label, expression = (part[0].strip(), part[1]) if len(part) == 2 else (part[0] if part else "", "")
        out.lines.append((int(seq[1]), label, expression.rstrip(",")))
    if len({s for s, _, _ in out.lines}) != int(m[1]):
        out.warnings.append(f"{m[1]} categories declared, {len({s for s, _, _ in out.lines})} found")
    return out


def conversion_codes(spark: SparkSession, table: Conversion, universe: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(code, label) and the rules that cannot be listed; a later category overrides an earlier one."""
    rows = spark.createDataFrame([(i, s, e, x) for i, (s, x, e) in enumerate(table.lines)], "id int, seq int, expression string, label string")
    every = expanded(rows.select("id", "seq", "expression"), universe, table.width).join(rows.select("id", "label"), "id")
    codes = every.where("code is not null").groupBy("code").agg(F.max_by("label", "id").alias("label"))
    return codes, every.where("rule is not null").select("seq", "rule", "label")


#: Markers of definition lines and what they declare.
MARKERS = {"A": "active", "L": "line", "C": "column", "S": "selection", "T": "total", "I": "increment", "D": "date", "X": "extra"}


def parse_definition(text: str) -> tuple[list[dict], list[str]]:
    """(usage, display name, field, codelist) of a definition's lines, and warnings (X05). A line begins with its marker and holds name, field, position, table parted by commas; ; and ? are comments."""
    found, warnings = [], []
    for x in text.splitlines():
        x = x.strip()
        if not x or x[0] in ";?":
            continue
        if x[0].upper() not in MARKERS:
            warnings.append(f"unknown marker: {x[:40]}")
            continue
        part = [p.strip() for p in x[1:].split(",")]
        if len(part) < 2:
            if x[0].upper() != "A":
                warnings.append(f"too short: {x[:40]}")
            continue
        found.append({"usage": x[0].upper(), "name": part[0], "field": part[1].upper(), "codelist": re.sub(r"\.\w+$", "", part[3].split("\\")[-1]).upper() if len(part) > 3 and part[3] else None})
    return found, warnings


def official_names(rows: list[dict]) -> dict[str, str]:
    """The shortest display name of each field."""
    out: dict[str, str] = {}
    for r in rows:
        if r["name"] and (r["field"] not in out or (len(r["name"]), r["name"]) < (len(out[r["field"]]), out[r["field"]])):
            out[r["field"]] = r["name"]
    return out


def recodes(texts: DataFrame, col: str = "text") -> DataFrame:
    """(field, code, label) of recoding calls in scripts: field = recode(field, "1" = "label", ...) or mutate(field == "1" ~ "label")."""
    block = texts.select(F.explode(F.regexp_extract_all(col, F.lit(r"(?s)(\w+\s*(?:=|<-)\s*(?:dplyr::)?recode\([^)]*\))"), F.lit(1))).alias("b"))
    name = F.regexp_extract("b", r"^(\w+)", 1)
    pair = F.arrays_zip(F.regexp_extract_all("b", F.lit(r"[\"'`]([^\"'`]+)[\"'`]\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1)).alias("code"), F.regexp_extract_all("b", F.lit(r"[\"'`]([^\"'`]+)[\"'`]\s*=\s*[\"']([^\"']*)[\"']"), F.lit(2)).alias("label"))
    a = block.select(F.upper(name).alias("field"), F.explode(pair).alias("p")).select("field", "p.code", "p.label")
    cond = F.lit(r"(\w+)\s*==\s*[\"']([^\"']+)[\"']\s*~\s*[\"']([^\"']*)[\"']")
    zipped = F.arrays_zip(F.regexp_extract_all(col, cond, F.lit(1)).alias("f"), F.regexp_extract_all(col, cond, F.lit(2)).alias("code"), F.regexp_extract_all(col, cond, F.lit(3)).alias("label"))
    b = texts.select(F.explode(zipped).alias("p")).select(F.upper("p.f").alias("field"), "p.code", "p.label")
    return a.unionByName(b)


_DOS = re.compile(r"^(\d{2})-(\d{2})-(\d{2,4})\s+(\d{1,2}):(\d{2})(AM|PM)?\s+(<DIR>|\d+)\s+(.+)$", re.I)
_UNIX = re.compile(r"^([-dl])[rwxsStT-]{9}\S*\s+\d+\s+\S+\s+\S+\s+(\d+)\s+([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{4}|\d{1,2}:\d{2})\s+(.+)$")
_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def parse_listing(lines: list[str], directory: str = "", year: int = 1970) -> list[dict]:
    """Entries of a directory listing in the MS-DOS or Unix style; content of neither is an error, not an empty folder (L49-L51). `year` stands in where a Unix line gives a time of day."""
    out = []
    for x in lines:
        x = x.rstrip("\r\n")
        if not x.strip() or x.startswith("total "):
            continue
        if m := _DOS.match(x):
            y = int(m[3]) if len(m[3]) == 4 else int(m[3]) + (1900 if int(m[3]) >= 80 else 2000)
            h = int(m[4]) % 12 + 12 * (m[6].upper() == "PM") if m[6] else int(m[4])
            out.append({"path": f"{directory}/{m[8]}", "is_dir": m[7].upper() == "<DIR>", "size": None if m[7].upper() == "<DIR>" else int(m[7]), "modified": f"{y:04d}-{int(m[1]):02d}-{int(m[2]):02d} {h:02d}:{m[5]}", "is_link": False})
        elif m := _UNIX.match(x):
            y, clock = (int(m[5]), "00:00") if ":" not in m[5] else (year, m[5].zfill(5))
            name = m[6].split(" -> ")[0]
            out.append({"path": f"{directory}/{name}", "is_dir": m[1] == "d", "size": int(m[2]) if m[1] == "-" else None, "modified": f"{y:04d}-{_MONTHS.index(m[3]) + 1:02d}-{int(m[4]):02d} {clock}", "is_link": m[1] == "l"})
        else:
            raise ValueError(f"not a listing line: {x[:80]!r}")
    return out
