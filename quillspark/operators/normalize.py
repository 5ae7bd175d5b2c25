"""Normalisation plans: text columns to typed ones with companions."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from ..errors import MissingColumn
from ..functions import dates, geo, types

#: Fields that hold an official week already; none is derived for them.
WEEK_FIELDS = ("SEM_NOT", "SEM_PRI", "SEMANA")
COMPANIONS = ("_raw", "_label", "_ibge7", "_uf", "_epi_year", "_epi_week")


@dataclass(frozen=True)
class FieldPlan:
    """What becomes of one column."""

    name: str
    letter: str = "C"
    width: int = 0
    decimals: int = 0
    date_order: str | None = None
    sentinels: tuple[str, ...] = ()
    labels: dict[str, str] | None = None
    place: bool = False
    weeks: bool = False


@dataclass(frozen=True)
class Plan:
    fields: tuple[FieldPlan, ...] = field(default_factory=tuple)

    @property
    def digest(self) -> str:
        """A stable digest of the plan."""
        return hashlib.sha256(json.dumps([asdict(f) for f in self.fields], sort_keys=True).encode()).hexdigest()[:16]


def _columns(f: FieldPlan) -> list[Column]:
    raw = F.col(f"`{f.name}`")
    clean = types.without_sentinels(raw.cast("string"), f.sentinels)
    out: list[Column] = []
    kind = types.declared_type(f.letter, f.width, f.decimals)
    if f.date_order:
        kind = DateType()
        typed = types.date8(clean, f.date_order)
    elif f.letter.upper() in "NFBYI+":
        typed = types.number(clean, kind, f.decimals)
    elif f.letter.upper() == "L":
        typed = types.boolean(clean)
    elif f.letter.upper() == "D":
        typed = types.date8(clean)
    else:
        typed = types.blank_to_null(clean)
        kind = None
    out.append(typed.alias(f.name))
    if kind is not None:
        out.append(raw.cast("string").alias(f"{f.name}_raw"))
    if f.labels is not None:
        table = F.create_map(*[F.lit(x) for kv in f.labels.items() for x in kv]) if f.labels else F.create_map().cast("map<string,string>")
        out.append(F.try_element_at(table, types.stripped(raw.cast("string"))).alias(f"{f.name}_label"))
    if f.place:
        out += [geo.seven_digits(clean).alias(f"{f.name}_ibge7"), geo.state(clean).alias(f"{f.name}_uf")]
    if f.weeks and f.name.upper() not in WEEK_FIELDS:
        out += [dates.epi_year(typed).alias(f"{f.name}_epi_year"), dates.epi_week(typed).alias(f"{f.name}_epi_week")]
    return out


def normalise(df: DataFrame, plan: Plan, keep_rest: bool = True) -> DataFrame:
    """All planned columns with companions in one projection; columns without a plan pass as they are."""
    if lacking := [f.name for f in plan.fields if f.name not in df.columns]:
        raise MissingColumn(f"planned columns that the data lack: {lacking}")
    by = {f.name: f for f in plan.fields}
    return df.select(*[x for c in df.columns for x in (_columns(by[c]) if c in by else [F.col(f"`{c}`")] if keep_rest else [])])


def with_provenance(df: DataFrame, *, source: Column | None = None, blob: Column | None = None, signature: str | None = None) -> DataFrame:
    """Source path, blob digest, ingest time and schema signature of each row."""
    from ..functions.naming import schema_signature

    return df.withColumns({"_source_path": source if source is not None else F.lit(None).cast("string"), "_blob_sha256": blob if blob is not None else F.lit(None).cast("string"), "_ingested_at": F.current_timestamp(), "_schema_signature": F.lit(signature or schema_signature(df.columns))})


def kind_of(column: str, base: list[str]) -> str:
    """raw, label, companion, provenance or value, by suffix against the raw names (P20)."""
    if column.startswith("_"):
        return "provenance"
    for suffix in COMPANIONS:
        if column.endswith(suffix) and column[: -len(suffix)] in base:
            return suffix[1:] if suffix in ("_raw", "_label") else "companion"
    return "value"


def needed(columns: list[str], depends: dict[str, list[str]]) -> list[str]:
    """Requested columns and all that they depend on."""
    out, todo = [], list(columns)
    while todo:
        c = todo.pop(0)
        if c not in out:
            out.append(c)
            todo += depends.get(c, [])
    return out


def projected(df: DataFrame, keep: list[str]) -> DataFrame:
    """The requested columns, and all provenance."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in keep or c.startswith("_")])


def fingerprint(plan: Plan, sources: list[tuple[str, str, str]]) -> str:
    """A partition's fingerprint: plan digest and ordered (path, digest, member) of its sources."""
    return hashlib.sha256("\x1f".join([plan.digest, *("\x1e".join(s) for s in sorted(sources))]).encode()).hexdigest()
