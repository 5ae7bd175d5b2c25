"""The metadata catalog as Parquet tables, with the rules its tables keep.

Tables have fixed schemas. A column may be added (old rows read it as NULL); any other change of shape is refused.
Derived tables are replaced whole; claims are upserted by key. Writes are staged and renamed, so a reader never sees
half a table.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import CatalogShape, UnsupportedStratification
from ..functions.types import integer
from .lake import Files

#: The tables and their columns.
TABLES = {
    "files": "path string, size bigint, modified string, directory string, first_seen string, last_seen string, status string",
    "file_facts": "path string, system string, prefix string, geo string, digits string, date int, year int, role string, logical_id string",
    "strata": "system string, series string, year int, files bigint, bytes bigint, sample string, status string",
    "schemas": "signature string, position int, field string, type string, width int, decimals int",
    "schema_presence": "family string, signature string, field string, position int",
    "families": "family string, system string, series string, signature string, first_year int, last_year int, files bigint",
    "family_files": "family string, path string, member string",
    "variable_profiles": "family string, field string, signature string, semantic_type string, confidence double, non_null bigint, distinct_count bigint, min_length bigint, max_length bigint",
    "value_frequencies": "family string, field string, signature string, value string, n bigint, percent double, rank int",
    "schema_drift": "system string, series string, field string, families bigint, of bigint, state string",
    "field_renames": "system string, series string, old string, new string, stem string",
    "dictionary": "system string, codelist string, code string, label string, valid_from int, valid_to int, source string, source_ref string, confidence double, seq bigint",
    "dictionary_rules": "system string, codelist string, seq int, rule string, label string",
    "dictionary_conflicts": "system string, codelist string, code string, valid_from int, kept string, others string",
    "field_codelists": "system string, field string, codelist string, source string, confidence double, family_specific boolean, decodes double",
    "variable_docs": "system string, field string, code_system string, codelist string, token_rule string, title string, source string",
    "dataset_docs": "system string, series string, grain string, unit string, notes string",
    "ledger": "system string, field string, semantic_type string, aggregation string, unit string, coverage double",
    "lake_partitions": "system string, family string, signature string, uf string, year int, rows bigint, bytes bigint, fingerprint string",
    "build_outcomes": "family string, path string, outcome string, reason string, rows bigint",
    "open_questions": "key string, area string, question string, verification string, blocking boolean, answered boolean",
}
KEYS = {"files": ["path"], "file_facts": ["path"], "dictionary": ["system", "codelist", "code", "valid_from", "source"], "field_codelists": ["system", "field", "codelist"], "open_questions": ["key"], "families": ["family"], "lake_partitions": ["system", "family", "signature", "uf", "year"]}


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def schema(self, name: str) -> StructType:
        if name not in TABLES:
            raise CatalogShape(f"no table {name}")
        return self.spark.createDataFrame([], TABLES[name]).schema

    def read(self, name: str) -> DataFrame:
        want = self.schema(name)
        if not self.files.names(name):
            return self.spark.createDataFrame([], want)
        df = self.spark.read.parquet(f"{self.root}/{name}")
        have = {f.name: f.dataType for f in df.schema.fields}
        for f in want.fields:
            if f.name in have and have[f.name] != f.dataType:
                raise CatalogShape(f"{name}.{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
        if gone := [c for c in have if c not in want.fieldNames()]:
            raise CatalogShape(f"{name} holds columns that are no longer known: {gone}")
        return df.select(*[(F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields])

    def replace(self, name: str, df: DataFrame) -> None:
        """All of a derived table."""
        want = self.schema(name)
        if unknown := [c for c in df.columns if c not in want.fieldNames()]:
            raise CatalogShape(f"{name} has no columns {unknown}")
        out = df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields])
        staged = f"_staged/{name}-{uuid.uuid4().hex}"
        out.write.option("compression", "zstd").parquet(f"{self.root}/{staged}")
        self.files.rename(staged, name)

    def upsert(self, name: str, rows: DataFrame) -> None:
        """New rows take the place of those with their key; NULL keys are equal."""
        key = KEYS[name]
        old, new = self.read(name).alias("o"), rows.alias("n")
        on = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in key]
        self.replace(name, old.join(new, on, "left_anti").unionByName(rows, allowMissingColumns=True))

    def ask(self, key: str, *, area: str, question: str, verification: str = "", blocking: bool = False) -> None:
        """Log an open question once."""
        self.upsert("open_questions", self.spark.createDataFrame([(key, area, question, verification, blocking, False)], TABLES["open_questions"]))


@dataclass
class Stage:
    name: str
    run: Callable[[], object]
    after: tuple[str, ...] = ()


def in_order(stages: list[Stage]) -> list[Stage]:
    """Stages after those they need."""
    by, out, seen = {s.name: s for s in stages}, [], set()

    def visit(s: Stage, path: tuple[str, ...]) -> None:
        if s.name in path:
            raise ValueError(f"stages need each other: {' -> '.join([*path, s.name])}")
        if s.name not in seen:
            for a in s.after:
                visit(by[a], (*path, s.name))
            seen.add(s.name)
            out.append(s)

    for s in stages:
        visit(s, ())
    return out


def run_stages(stages: list[Stage], done: set[str] = frozenset()) -> dict[str, object]:
    """Run what is not done yet."""
    return {s.name: s.run() for s in in_order(stages) if s.name not in done}


@dataclass(frozen=True)
class Placement:
    """Where things lie: given, environment, nearest project folder, home, working folder."""

    root: str
    layer: str

    @classmethod
    def find(cls, explicit: str | None = None, variable: str = "QUILLSPARK_ROOT", marker: str = ".quillspark", start: str | None = None) -> Placement:
        if explicit:
            return cls(explicit, "explicit")
        if os.environ.get(variable):
            return cls(os.environ[variable], "environment")
        here = os.path.abspath(start or os.getcwd())
        while True:
            if os.path.isdir(os.path.join(here, marker)):
                return cls(os.path.join(here, marker), "project")
            up = os.path.dirname(here)
            if up == here:
                break
            here = up
        home = os.path.join(os.path.expanduser("~"), marker)
        return cls(home, "home") if os.path.isdir(home) else cls(os.path.join(os.path.abspath(start or os.getcwd()), marker), "working")


def historical(policy: str, how: DataFrame) -> DataFrame:
    """Under `refuse`, labels may only come from a window of the row's own time; under `current` the open-ended one serves too."""
    if policy not in ("current", "refuse"):
        raise ValueError(policy)
    return how if policy == "current" else how.where(F.col("how").isin("dated", "open"))


#: Spellings of population columns.
POPULATION = {"MUNIC_RES": "municipality", "MUNICIPIO": "municipality", "COD_MUN": "municipality", "ANO": "year", "SEXO": "sex", "FXETARIA": "age", "IDADE": "age", "POPULACAO": "population", "POP": "population"}


def population(df: DataFrame, year: int | None = None, source: str | None = None) -> DataFrame:
    """Canonical names (a second column of one name gets a number) and whole numbers."""
    used: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = POPULATION.get(c.upper(), c.lower())
        used[n] = used.get(n, 0) + 1
        names.append(n if used[n] == 1 else f"{n}_{used[n] - 1}")
    out = df.toDF(*names)
    if "population" not in names:
        raise UnsupportedStratification("no population column")
    out = out.withColumn("population", integer(F.col("population")))
    if "year" not in names:
        out = out.withColumn("year", F.lit(year))
    return out.withColumn("_source_path", F.lit(source))


def corroborated(bindings: DataFrame, documents: DataFrame, words: dict[str, str]) -> DataFrame:
    """Bindings whose field's document text mentions their classification gain confidence (J13). words: codelist -> pattern."""
    d = documents.select("system", "field", F.lower("text").alias("__t"))
    t = bindings.join(d, ["system", "field"], "left")
    hit = F.lit(False)
    for codelist, pattern in words.items():
        hit = hit | ((F.col("codelist") == codelist) & F.col("__t").rlike(pattern))
    return t.withColumn("confidence", F.when(F.coalesce(hit, F.lit(False)), F.greatest("confidence", F.lit(0.8))).otherwise(F.col("confidence"))).drop("__t")


def missing_join_keys(keys: DataFrame, presence: DataFrame) -> DataFrame:
    """Declared join keys whose column no generation of their dataset has (J18). keys: key, family, column."""
    return keys.join(presence.select("family", F.col("field").alias("column")).distinct(), ["family", "column"], "left_anti")


def community_bindings(recodes: DataFrame, system: str) -> DataFrame:
    """Fields of contributed recodes bound to a codelist of their own at low confidence."""
    return recodes.select(F.lit(system).alias("system"), "field", F.concat(F.lit("community_"), "field").alias("codelist"), F.lit("community").alias("source"), F.lit(0.4).alias("confidence")).distinct()


def enumerations(pages: DataFrame, known: list[str], col: str = "text") -> DataFrame:
    """(field, code, label) out of the text of documentation pages: a known field's name, then lines of code and label."""
    names = "|".join(sorted(known, key=len, reverse=True))
    block = F.regexp_extract_all(col, F.lit(rf"(?m)^\s*((?:{names})\b.*(?:\n(?!\s*(?:{names})\b).*)*)"), F.lit(1))
    t = pages.select(F.explode(block).alias("b")).select(F.regexp_extract("b", rf"^({names})\b", 1).alias("field"), "b")
    line = r"(?m)^\s*([0-9A-Z]{1,4})\s*[-–=:]\s*(\S.*?)\s*$"
    pairs = F.arrays_zip(F.regexp_extract_all("b", F.lit(line), F.lit(1)).alias("code"), F.regexp_extract_all("b", F.lit(line), F.lit(2)).alias("label"))
    return t.select("field", F.explode(pairs).alias("p")).select("field", "p.code", "p.label").where(~F.col("code").isin(*known))


def read_kit(data: bytes, system: str) -> dict:
    """A kit archive: its conversion tables, definitions and lookup tables, in that order of use."""
    from ..sources import containers, kits
    from ..sources.dbf import read_bytes

    out: dict = {"system": system, "lookups": {}, "conversions": [], "definitions": [], "errors": []}
    found = list(containers.walk(data))
    for path, content, error in found:
        name = path.split("!")[-1].rsplit("/", 1)[-1]
        stem, ending = (name.rsplit(".", 1) + [""])[:2]
        if error:
            out["errors"].append((path, error))
        elif ending.lower() == "dbf":
            try:
                t = read_bytes(content)
                code, label = containers.lookup_columns(t)
                out["lookups"][stem.upper()] = list(zip(t[code].to_pylist(), t[label].to_pylist(), strict=True))
            except ValueError as e:
                out["errors"].append((path, str(e)))
        elif ending.lower() == "cnv":
            out["conversions"].append(kits.parse_conversion(content.decode("latin-1"), stem.upper()))
        elif ending.lower() == "def":
            rows, warnings = kits.parse_definition(content.decode("latin-1"))
            out["definitions"] += rows
            out["errors"] += [(path, w) for w in warnings]
    return out


@dataclass
class Freshness:
    """Whether bytes that are held may serve: never ask, always ask, or compare what was seen then with now."""

    policy: str = "catalog"
    seen: dict[str, tuple[int | None, str | None]] = field(default_factory=dict)

    def serves(self, path: str, size: int | None, modified: str | None) -> bool:
        if self.policy == "never":
            return False
        if path not in self.seen:
            return False
        then = self.seen[path]
        return (size is None or then[0] == size) and (modified is None or then[1] == modified)
