"""Registered queries of the library's operators, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, geo, naming, text, types
from ..operators import codelists, detectors, dictionary, generations, inventory, normalize, profile, render
from ..shared import folder
from ..sources import text as sources
from .lake import Lake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def long(c, name: str):
    return F.col(c).cast("long").alias(name) if isinstance(c, str) else c.cast("long").alias(name)


# --- labels and vintages ------------------------------------------------------------------------

#: A codelist with windows: F changes its label in 1998, O is open-ended, P ends in 1999.
STATUS = [
    ("status", "*", "F", "Filled", 190001, 199712), ("status", "*", "O", "Open", 190001, 199712), ("status", "*", "P", "Part", 190001, 199712),
    ("status", "*", "F", "Finished", 199801, 199912), ("status", "*", "O", "Ordered", 199801, 199912), ("status", "*", "P", "Partial", 199801, 199912),
    ("status", "*", "F", "Final", 200001, None), ("status", "*", "O", "Outstanding", 200001, None),
]
REFERENCE = "codelist string, system string, code string, label string, valid_from int, valid_to int"
_STATUS_SQL = "(VALUES " + ", ".join(f"('{c}', '{x}', {a}, {'NULL' if b is None else b})" for _, _, c, x, a, b in STATUS) + ") AS r(code, label, a, b)"


def status(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATUS, REFERENCE)


@query(f"""
WITH o AS (SELECT *, year(o_orderdate) * 100 + month(o_orderdate) AS m, CAST(o_orderdate AS DATE) AS d FROM orders),
l AS (SELECT o.*, r.label FROM o LEFT JOIN {_STATUS_SQL} ON r.code = o.o_orderstatus AND r.a <= o.m AND coalesce(r.b, 999999) >= o.m),
e AS (SELECT *, d + CAST(3 - dayofweek(d) AS INTEGER) AS w FROM l)
SELECT coalesce(label, '(none)') AS status, CAST(year(w) AS BIGINT) AS epi_year, CAST((dayofyear(w) - 1) // 7 + 1 AS BIGINT) AS epi_week, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
FROM e GROUP BY ALL""")
def vintage_label_status(spark, d):
    o = t(spark, d, "orders")
    month = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    o = codelists.with_vintage_label(o.select("o_orderdate", "o_orderstatus", "o_totalprice"), "o_orderstatus", status(spark), month, "status")
    day = F.to_date("o_orderdate")
    return o.groupBy(F.coalesce("status", F.lit("(none)")).alias("status"), long(dates.epi_year(day), "epi_year"), long(dates.epi_week(day), "epi_week")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
SELECT CAST(d AS DATE) AS date, CAST(year(d) AS BIGINT) AS year, CAST(year(d) * 100 + month(d) AS BIGINT) AS competence, CAST(year(w) AS BIGINT) AS epi_year, CAST((dayofyear(w) - 1) // 7 + 1 AS BIGINT) AS epi_week
FROM (SELECT d, d + CAST(3 - dayofweek(d) AS INTEGER) AS w FROM (SELECT CAST(unnest(generate_series(DATE '1990-01-01', DATE '2030-12-31', INTERVAL 1 DAY)) AS DATE) AS d))""")
def epi_calendar(spark, d):
    c = dates.calendar(spark, 1990, 2030)
    return c.select("date", long("year", "year"), long("competence", "competence"), long("epi_year", "epi_year"), long("epi_week", "epi_week"))


@query("""
SELECT y AS year, CAST(CASE WHEN year(w) = y THEN (dayofyear(w) - 1) // 7 + 1 ELSE (dayofyear(w2) - 1) // 7 + 1 END AS BIGINT) AS weeks
FROM (SELECT y, l + CAST(3 - dayofweek(l) AS INTEGER) AS w, l - 7 + CAST(3 - dayofweek(l - 7) AS INTEGER) AS w2 FROM (SELECT y, make_date(y, 12, 31) AS l FROM (SELECT unnest(range(1950, 2101)) AS y)))""")
def weeks_in_year(spark, d):
    return spark.range(1950, 2101).select(F.col("id").alias("year"), long(dates.weeks_in(F.col("id").cast("int")), "weeks"))


@query(f"""
SELECT o_orderkey, label FROM orders LEFT JOIN (SELECT code, label FROM {_STATUS_SQL} WHERE b IS NULL) ON code = o_orderstatus""")
def current_label(spark, d):
    """No year asked for: the open-ended window's labels."""
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return codelists.with_vintage_label(o, "o_orderstatus", status(spark), F.lit(None).cast("int"), "label").select("o_orderkey", "label")


@query("""
SELECT n_name AS nation, r_name AS region, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def rollup_label_region(spark, d):
    """A roll-up beside the code: 25 nations, five regions."""
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    c = t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("b"))
    names = n.select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label"))
    regions = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("string").alias("code"), F.col("r_name").alias("label"))
    c = codelists.label_once(codelists.label_once(c, "c_nationkey", names, "nation"), "c_nationkey", regions, "region")
    return c.select("nation", "region", "customers", F.round("b", 2).alias("balance"))


def _nation_lists(spark, d) -> DataFrame:
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    code = F.col("n_nationkey").cast("string").alias("code")
    few = both.where("n_nationkey < 5").select(F.lit("few").alias("codelist"), code, F.col("n_name").alias("label"))
    return both.select(F.lit("nation").alias("codelist"), code, F.col("n_name").alias("label")).unionByName(both.select(F.lit("region").alias("codelist"), code, F.col("r_name").alias("label"))).unionByName(few)


_NATION_LISTS = "l AS (SELECT 'nation' AS codelist, CAST(n_nationkey AS VARCHAR) AS code, n_name AS label FROM nation UNION ALL SELECT 'region', CAST(n_nationkey AS VARCHAR), r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'few', CAST(n_nationkey AS VARCHAR), n_name FROM nation WHERE n_nationkey < 5)"


@query(f"""
WITH {_NATION_LISTS}, o AS (SELECT CAST(s_nationkey AS VARCHAR) AS value, count(*) AS n FROM supplier GROUP BY 1), tot AS (SELECT count(*) AS v, sum(n) AS m FROM o)
SELECT codelist, CAST(count(value) AS BIGINT) AS matched, round(count(value) / any_value(v), 6) AS share, round(coalesce(sum(n), 0) / any_value(m), 6) AS mass_share, coalesce(round(count(DISTINCT CASE WHEN value IS NOT NULL THEN label END) / nullif(count(value), 0), 6), 0) AS granularity
FROM l LEFT JOIN o ON code = value, tot GROUP BY codelist""")
def codelist_coverage(spark, d):
    observed = profile.frequencies(t(spark, d, "supplier"), ["s_nationkey"]).where("value is not null").select("value", "n")
    return codelists.coverage(observed, _nation_lists(spark, d))


@query("SELECT 's_nationkey' AS field, 'nation' AS codelist, 1.0 AS share, 1.0 AS granularity, 'region' AS rollups, 'measured' AS reason")
def choose_binding_nation(spark, d):
    observed = profile.frequencies(t(spark, d, "customer"), ["c_nationkey"]).where("value is not null").select("value", "n")
    c = codelists.choose(observed, _nation_lists(spark, d), ["region", "few", "nation"])
    row = ("s_nationkey", c["codelist"], round(c["share"], 6), round(c["granularity"], 6), ",".join(c["rollups"]), c["reason"])
    return spark.createDataFrame([row], "field string, codelist string, share double, granularity double, rollups string, reason string")


_CLAIMS = [
    ("A", "sex", "1", "Male", None, "manual", 1), ("A", "sex", "1", "Masculine", None, "pdf", 2), ("A", "sex", "2", "Female", None, "cnv", 3), ("A", "sex", "2", "Feminine", None, "cnv", 4),
    ("A", "sex", "9", "Ignored", 200001, "community", 5), ("B", "sex", "1", "M", None, "inferred", 6), ("B", "sex", "1", "Man", None, "dbf_lookup", 7), ("A", "race", "01", "White", None, "def", 8), ("A", "race", "1", "Other", None, "def", 9),
]
_CLAIM = "system string, codelist string, code string, label string, valid_from int, source string, seq int"
_CLAIMS_SQL = "(VALUES " + ", ".join(f"('{s}', '{k}', '{c}', '{x}', {'NULL' if v is None else v}, '{o}', {n}, {dictionary.AUTHORITY[o][0]})" for s, k, c, x, v, o, n in _CLAIMS) + ") AS c(system, codelist, code, label, valid_from, source, seq, a)"


@query(f"SELECT system, codelist, code, label, source FROM (SELECT *, row_number() OVER (PARTITION BY system, codelist, code, valid_from ORDER BY a, seq DESC) AS n FROM {_CLAIMS_SQL}) WHERE n = 1")
def dictionary_merge(spark, d):
    return dictionary.merge(spark.createDataFrame(_CLAIMS, _CLAIM)).select("system", "codelist", "code", "label", "source")


@query(f"SELECT system, codelist, code, arg_min(label, a * 1000 - seq) AS kept, CAST(count(DISTINCT label) AS BIGINT) AS labels FROM {_CLAIMS_SQL} GROUP BY system, codelist, code, valid_from HAVING count(DISTINCT label) > 1")
def dictionary_conflicts(spark, d):
    return dictionary.conflicts(spark.createDataFrame(_CLAIMS, _CLAIM)).select("system", "codelist", "code", "kept", (F.size(F.split("others", r" \| ")) + 1).cast("long").alias("labels"))


@query(f"SELECT codelist, code, CAST(count(DISTINCT lower(label)) AS BIGINT) AS labels, string_agg(DISTINCT label, ' | ' ORDER BY label) AS seen FROM {_CLAIMS_SQL} GROUP BY ALL HAVING count(DISTINCT lower(label)) > 1")
def contradictions(spark, d):
    return codelists.contradictions(spark.createDataFrame(_CLAIMS, _CLAIM))


@query(f"SELECT codelist, string_agg(DISTINCT CAST(length(code) AS VARCHAR), ',' ORDER BY CAST(length(code) AS VARCHAR)) AS code_widths, count(DISTINCT length(code)) > 1 AS mixed FROM {_CLAIMS_SQL} GROUP BY codelist")
def width_mix(spark, d):
    return codelists.widths(spark.createDataFrame(_CLAIMS, _CLAIM))


@query("""
WITH c AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS code, p_brand AS label, p_partkey AS n FROM part),
r AS (SELECT *, n - row_number() OVER (PARTITION BY label ORDER BY n) AS run FROM c)
SELECT min(code) AS code_lo, max(code) AS code_hi, label FROM r GROUP BY label, run""")
def range_encode_labels(spark, d):
    p = t(spark, d, "part").select(F.lit("brand").alias("codelist"), F.lpad(F.col("p_partkey").cast("string"), 7, "0").alias("code"), F.col("p_brand").alias("label"))
    return codelists.range_encoded(p).select("code_lo", "code_hi", "label")


@query("SELECT lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS code, p_brand AS label FROM part")
def range_round_trip(spark, d):
    p = t(spark, d, "part").select(F.lit("brand").alias("codelist"), F.lpad(F.col("p_partkey").cast("string"), 7, "0").alias("code"), F.col("p_brand").alias("label"))
    return codelists.range_decoded(codelists.range_encoded(p)).select("code", "label")


# --- typing -------------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DOUBLE) / 100 AS implied, round(l_tax, 2) AS explicit FROM lineitem""")
def implied_decimal_money(spark, d):
    """Text amounts: one with implied decimals, one with a decimal comma."""
    li = t(spark, d, "lineitem")
    cents = F.lpad(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), 12, "0")
    comma = F.concat(F.lit(" "), F.replace(F.format_string("%.2f", "l_tax"), F.lit("."), F.lit(",")))
    return li.select("l_orderkey", "l_linenumber", types.number(cents, "decimal(14,2)", 2).cast("double").alias("implied"), types.number(comma, "decimal(14,2)", 2).cast("double").alias("explicit"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS ymd, CAST(o_orderdate AS DATE) AS dmy FROM orders""")
def parse_dates(spark, d):
    o = t(spark, d, "orders")
    ymd = F.when(F.col("o_orderkey") % 11 == 0, F.when(F.col("o_orderkey") % 2 == 0, "20150230").otherwise("00000000")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return o.select("o_orderkey", types.date8(ymd).alias("ymd"), types.date8(F.date_format("o_orderdate", "ddMMyyyy"), "DMY").alias("dmy"))


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN false WHEN 'O' THEN NULL ELSE NULL END AS flag, CASE WHEN month(o_orderdate) <= 12 THEN year(o_orderdate) * 100 + month(o_orderdate) END AS competence FROM orders""")
def parse_bool_competence(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", types.boolean(F.col("o_orderstatus")).alias("flag"), long(types.competence(F.date_format("o_orderdate", "yyyyMM")), "competence"))


_DIGITS = "CAST(substr(six, {i}, 1) AS INTEGER)"
_CHECK = " + ".join(_DIGITS.format(i=i + 1) if i % 2 == 0 else f"(CASE WHEN {_DIGITS.format(i=i + 1)} * 2 > 9 THEN {_DIGITS.format(i=i + 1)} * 2 - 9 ELSE {_DIGITS.format(i=i + 1)} * 2 END)" for i in range(6))
_STATE = "CASE substr(six, 1, 2) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in geo.STATES.items()) + " END"


@query(f"SELECT c_custkey, six || CAST((10 - ({_CHECK}) % 10) % 10 AS VARCHAR) AS seven, {_STATE} AS state FROM (SELECT c_custkey, lpad(CAST((c_custkey * 7919) % 1000000 AS VARCHAR), 6, '0') AS six FROM customer)")
def check_digit_expand(spark, d):
    six = F.lpad(((F.col("c_custkey") * 7919) % 1000000).cast("string"), 6, "0")
    return t(spark, d, "customer").select("c_custkey", geo.seven_digits(six).alias("seven"), geo.state(six).alias("state"))


@query("SELECT p_partkey, CASE WHEN p_brand IN ('Brand#11', 'Brand#22') THEN NULL ELSE p_brand END AS brand, p_brand AS brand_raw FROM part")
def sentinel_null(spark, d):
    return t(spark, d, "part").select("p_partkey", types.without_sentinels(F.col("p_brand"), ["Brand#11", "Brand#22"]).alias("brand"), F.col("p_brand").alias("brand_raw"))


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y%m%d') AS d_raw, CAST(year(w) AS BIGINT) AS d_epi_year, CAST((dayofyear(w) - 1) // 7 + 1 AS BIGINT) AS d_epi_week, CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' END AS s_label, o_orderstatus AS s
FROM (SELECT *, CAST(o_orderdate AS DATE) + CAST(3 - dayofweek(CAST(o_orderdate AS DATE)) AS INTEGER) AS w FROM orders)""")
def normalize_orders(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("d"), F.col("o_orderstatus").alias("s"))
    plan = normalize.Plan((normalize.FieldPlan("d", "D", weeks=True), normalize.FieldPlan("s", labels={"F": "Filled", "O": "Open"})))
    n = normalize.normalise(o, plan)
    return n.withColumns({"d_epi_year": F.col("d_epi_year").cast("long"), "d_epi_week": F.col("d_epi_week").cast("long")})


@query("""
SELECT event_id, CAST(floor(CASE event_id % 5 WHEN 0 THEN value / CAST(8766 AS DOUBLE) WHEN 1 THEN value / CAST(365.25 AS DOUBLE) WHEN 2 THEN value / CAST(12 AS DOUBLE) WHEN 3 THEN value END * 1000) AS BIGINT) AS age_thousandths FROM events""")
def age_years_derivation(spark, d):
    unit = F.element_at(F.array(*[F.lit(x) for x in ("horas", "dias", "meses", "anos", "?")]), (F.col("event_id") % 5 + 1).cast("int"))
    e = t(spark, d, "events")
    return e.select("event_id", F.floor(F.try_divide(F.col("value"), render.unit_divisor(unit)) * 1000).alias("age_thousandths"))


# --- profile ------------------------------------------------------------------------------------


def _profile_sql(table: str, fields: list[str]) -> str:
    num = r"regexp_matches(v, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$')"
    part = "SELECT '{f}' AS field, CASE WHEN upper(trim(CAST({f} AS VARCHAR))) IN ('', 'NA', 'N/A', 'NULL', 'NONE', 'NAN', '.') THEN NULL ELSE trim(CAST({f} AS VARCHAR)) END AS v FROM {t}"
    return f"""WITH u AS ({" UNION ALL ".join(part.format(f=f, t=table) for f in fields)})
SELECT field, count(v) AS non_null, count(*) - count(v) AS nulls, count(DISTINCT v) AS distinct_count, min(length(v)) AS min_length, max(length(v)) AS max_length, round(avg(length(v)), 4) AS mean_length,
round(avg(CASE WHEN regexp_matches(v, '^[0-9]+$') THEN 1.0 WHEN v IS NOT NULL THEN 0 END), 4) AS digit_rate, round(avg(CASE WHEN regexp_matches(v, '^[A-Za-z]+$') THEN 1.0 WHEN v IS NOT NULL THEN 0 END), 4) AS alpha_rate,
round(avg(CASE WHEN {num} THEN 1.0 WHEN v IS NOT NULL THEN 0 END), 4) AS numeric_rate FROM u GROUP BY field"""


def _profiled(table: str, fields: list[str]) -> None:
    def run(spark, d):
        s = profile.statistics(profile.frequencies(t(spark, d, table), fields))
        return s.select("field", "non_null", "nulls", "distinct_count", "min_length", "max_length", F.round("mean_length", 4).alias("mean_length"), *[F.round(c, 4).alias(c) for c in ("digit_rate", "alpha_rate", "numeric_rate")])

    run.__name__ = f"profile_{table}"
    query(_profile_sql(table, fields))(run)


for _t, _f in (("lineitem", ["l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"]), ("orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"]), ("customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]), ("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]), ("events", ["user_id", "event_type", "props"]), ("documents", ["lang", "source", "n_chars"])):
    _profiled(_t, _f)


@query("""
WITH f AS (SELECT 'p_brand' AS field, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part),
g AS (SELECT field, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY field) AS total, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS rank FROM f GROUP BY field, value)
SELECT field, value, n, round(n * 100 / total, 4) AS percent, CAST(rank AS BIGINT) AS rank FROM g WHERE rank <= 10""")
def value_frequencies_topk(spark, d):
    top = profile.top_values(profile.frequencies(t(spark, d, "part"), ["p_brand", "p_type", "p_size"]), 10)
    return top.withColumn("rank", F.col("rank").cast("long"))


@query("""
WITH c AS (SELECT 'p_name' AS field, substr(p_name, 1, 1) AS ch, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', substr(p_type, 1, 1), count(*) FROM part GROUP BY 2), s AS (SELECT field, sum(n) AS total FROM c GROUP BY field)
SELECT field, round(-sum(n / total * log2(n / total)) + 0.0, 4) AS entropy, count(*) AS letters FROM c JOIN s USING (field) GROUP BY field""")
def first_char_entropy(spark, d):
    return profile.entropy(profile.frequencies(t(spark, d, "part"), ["p_name", "p_type"])).withColumn("entropy", F.round("entropy", 4))


@query("""
WITH v AS (SELECT 'l_quantity' AS field, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem), r AS (SELECT field, x, row_number() OVER (PARTITION BY field ORDER BY x) AS k, count(*) OVER (PARTITION BY field) AS n FROM v), q AS (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q)
SELECT field, CAST(q AS DOUBLE) AS q, min(x) AS x FROM r, q WHERE k >= ceil(CAST(q AS DOUBLE) * n) GROUP BY ALL""")
def nearest_rank_quantiles(spark, d):
    return profile.quantiles(profile.frequencies(t(spark, d, "lineitem"), ["l_quantity", "l_discount"]))


@query("""
WITH v AS (SELECT CAST(substr(p_brand, 7) AS BIGINT) AS tail FROM part), g AS (SELECT tail, count(*) AS n FROM v GROUP BY tail), w AS (SELECT *, sum(n) OVER (ORDER BY tail) AS upto, sum(n) OVER () AS total FROM g)
SELECT 'p_brand' AS field, min(tail) AS low, max(tail) AS high, count(*) AS distinct_tails, CASE WHEN count(*) >= 5 THEN round(count(*) / (max(tail) - min(tail) + 1), 6) ELSE 0 END AS density, CAST(1 AS BIGINT) AS units FROM w WHERE upto > total * 0.005 AND upto - n < total * 0.995""")
def tail_density(spark, d):
    return profile.tails(profile.frequencies(t(spark, d, "part"), ["p_brand"]), prefix=6)


@query("""
SELECT * FROM (VALUES ('c_name', 'free_text'), ('c_mktsegment', 'categorical_undecoded'), ('c_nationkey', 'categorical_undecoded'), ('place', 'municipality_code_7'), ('born', 'date'), ('month', 'competencia'), ('state', 'uf_alpha'), ('one', 'constant_column'), ('VAL_TOT', 'money'), ('IDADE', 'datasus_age'), ('DIAG', 'icd10')) AS v(field, semantic_type)""")
def detect_types(spark, d):
    """Columns of known kinds, made from the customer table."""
    c = t(spark, d, "customer")
    k = F.col("c_custkey")
    code = F.element_at(F.array(*[F.lit(x) for x in geo.STATES]), (k % 27 + 1).cast("int"))
    six = F.concat(code, F.lpad((k % 9000).cast("string"), 4, "0"))
    made = c.select(
        "c_name", "c_mktsegment", "c_nationkey", geo.seven_digits(six).alias("place"), F.date_format(F.date_add(F.lit("1950-01-01"), (k * 17 % 20000).cast("int")), "yyyyMMdd").alias("born"),
        F.concat(F.lit("20"), F.lpad((k % 20).cast("string"), 2, "0"), F.lpad((k % 12 + 1).cast("string"), 2, "0")).alias("month"), geo.state(code).alias("state"), F.lit("x").alias("one"),
        F.format_string("%.2f", "c_acctbal").alias("VAL_TOT"), F.concat(F.lit("4"), F.lpad((k % 90).cast("string"), 3, "0")).alias("IDADE"),
        F.concat(F.char(65 + k % 24), F.lpad((k * 31 % 100).cast("string"), 2, "0"), (k % 10).cast("string")).alias("DIAG"),
    )
    return detectors.verdicts(detectors.evidence(profile.frequencies(made))).select("field", "semantic_type")


# --- tokens, ranges, names ----------------------------------------------------------------------


@query("""
SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> ''), '|') AS words, substr(p_brand, 1, 2) || '|' || substr(p_brand, 3, 2) || '|' || substr(p_brand, 5, 2) || CASE WHEN length(p_brand) > 6 THEN '|' || substr(p_brand, 7, 2) ELSE '' END AS pairs FROM part""")
def multi_valued_tokens(spark, d):
    return t(spark, d, "part").select("p_partkey", F.array_join(text.tokens(F.col("p_name"), " "), "|").alias("words"), F.array_join(text.tokens(F.col("p_brand"), width=2), "|").alias("pairs"))


_EXPR = [(1, 1, "01-03,07"), (1, 2, "A00-A02"), (2, 3, "5,8-9"), (2, 4, "X-Z")]


@query("SELECT * FROM (VALUES (1, 1, '01', NULL), (1, 1, '02', NULL), (1, 1, '03', NULL), (1, 1, '07', NULL), (1, 2, 'A00', NULL), (1, 2, 'A01', NULL), (1, 2, 'A019', NULL), (2, 3, '05', NULL), (2, 3, '08', NULL), (2, 3, '09', NULL), (2, 4, NULL, 'X-Z')) AS v(id, seq, code, rule)")
def match_expression_expand(spark, d):
    universe = spark.createDataFrame([("A00",), ("A01",), ("A019",), ("B01",)], "code string")
    return text.expanded(spark.createDataFrame(_EXPR, "id int, seq int, expression string"), universe, width=2)


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 9 THEN 'small' WHEN p_size BETWEEN 10 AND 29 THEN 'middle' WHEN p_size BETWEEN 30 AND 50 THEN 'large' END AS label FROM part")
def rule_apply(spark, d):
    runs = spark.createDataFrame([("s", "01", "09", "small"), ("s", "10", "29", "middle"), ("s", "30", "50", "large")], "codelist string, code_lo string, code_hi string, label string")
    p = t(spark, d, "part").select("p_partkey", F.lpad(F.col("p_size").cast("string"), 2, "0").alias("code"))
    return codelists.ranges_lookup(p, "code", runs).select("p_partkey", "label")


# --- sources: tables written in old formats and read back -----------------------------------------


def _dbase(df: DataFrame, names: list[str], widths: list[int], ending: str = ".dbf") -> DataFrame:
    """(path, content): a dBase file for each partition of df."""
    import pyarrow as pa

    def run(batches):
        from quillspark.sources import dbc, dbf

        rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
        data = dbf.encode(names, widths, rows)
        yield pa.RecordBatch.from_arrays([pa.array([f"/part{ending}"]), pa.array([dbc.pack(data) if ending == ".dbc" else data], pa.binary())], names=["path", "content"])

    return df.mapInArrow(run, "path string, content binary")


_SUPPLIERS = "SELECT CAST(s_suppkey AS BIGINT) AS key, s_name AS name, CAST(s_nationkey AS BIGINT) AS nation, round(s_acctbal, 2) AS balance FROM supplier"


def _suppliers(spark, d, ending: str) -> DataFrame:
    from ..sources import dbf

    names, widths = ["KEY", "NAME", "NATION", "BALANCE"], [10, 25, 4, 14]
    s = t(spark, d, "supplier").select(F.col("s_suppkey").cast("string"), "s_name", F.col("s_nationkey").cast("string"), F.col("s_acctbal").cast("decimal(14,2)").cast("string"))
    rows = dbf.read_binary(_dbase(s, names, widths, ending), dbf.encode(names, widths, []))
    return rows.select(F.col("KEY").try_cast("long").alias("key"), types.stripped(F.col("NAME")).alias("name"), types.number(F.col("NATION"), "bigint").alias("nation"), types.number(F.col("BALANCE"), "decimal(14,2)", 2).cast("double").alias("balance"))


@query(_SUPPLIERS)
def source_dbf(spark, d):
    return _suppliers(spark, d, ".dbf")


@query(_SUPPLIERS)
def source_dbc(spark, d):
    return _suppliers(spark, d, ".dbc")


@query("SELECT CAST(c_custkey AS VARCHAR) AS \"CUSTKEY\", c_name AS \"NOME\", nullif(c_mktsegment, 'BUILDING') AS \"SEGMENTO\" FROM customer")
def source_csv(spark, d):
    """Semicolons and a header in mixed case; empty cells are NULL."""
    path = folder(spark, "csv")
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("CustKey"), F.col("c_name").alias("nome"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise("").alias("Segmento"))
    c.write.option("header", True).option("sep", ";").option("emptyValue", "").csv(path)
    return sources.read_csv(spark, path)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def source_json(spark, d):
    path = folder(spark, "json")
    t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey").write.json(path)
    return sources.read_json(spark, path).select("o_orderkey", "o_orderstatus", "o_custkey")


@query('SELECT CAST(p_partkey AS VARCHAR) AS "KEY", p_brand AS "BRAND", CAST(p_size AS VARCHAR) AS "SIZE" FROM part')
def source_fixed(spark, d):
    """Places by a layout of name, size, start, end, type."""
    path = folder(spark, "fixed")
    t(spark, d, "part").select(F.concat(F.rpad(F.col("p_partkey").cast("string"), 12, " "), F.rpad("p_brand", 14, " "), F.lpad(F.col("p_size").cast("string"), 4, " "))).write.text(path)
    return sources.read_fixed(spark, path, sources.parse_layout("key,12,1,12,C\nbrand,14,13,26,C\nsize,4,27,30,N"))


@query("SELECT 'nations/' || r_name || '.csv' AS member, 'csv' AS reader, count(*) AS rows, 'KEY,NAME' AS columns FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def source_archive(spark, d):
    """A zip of zips of tables, one for each region: members are found and read by the ladder."""
    import pyarrow as pa

    from ..sources import containers

    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", "n_nationkey", "n_name"))), "\n").alias("body"))

    def run(batches):
        import io
        import zipfile

        for b in batches:
            out = []
            for r in b.to_pylist():
                data, name = f"key,name\n{r['body']}\n".encode(), f"nations/{r['r_name']}.csv"
                for member in (name, "inner.zip"):
                    held = io.BytesIO()
                    with zipfile.ZipFile(held, "w") as z:
                        z.writestr(member, data)
                    data = held.getvalue()
                out.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(["/x.zip"] * len(out), pa.string()), pa.array(out, pa.binary())], names=["path", "content"])

    found = containers.probe(n.mapInArrow(run, "path string, content binary"))
    return found.select(F.regexp_extract("member", "(nations/.*)$", 1).alias("member"), "reader", "rows", "columns")


@query("SELECT CAST(year(l_shipdate) AS BIGINT) AS year, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL")
def lake_views(spark, d):
    """A lake's view, asked in SQL with a parameter."""
    root = Lake(spark, folder(spark, "lake"))
    root.write(t(spark, d, "lineitem").select("l_returnflag", "l_quantity", F.year("l_shipdate").alias("year"), F.lit("SP").alias("uf")), "viewed", "viewed_li")
    root.open()
    return root.sql("SELECT CAST(year AS BIGINT) AS year, count(*) AS n FROM viewed_li WHERE l_returnflag = :flag GROUP BY ALL", flag="A")


_NAMES = ["/S1/Data/RDSP2301.dbc", "/S1/Data/RDAL9912.dbc", "/S2/PA_RJ_0512.dbf", "/S2/NAC2015.csv", "/S3/DOMG20.zip", "/S3/docs/manual.pdf", "/S1/aux/CID10.cnv", "/S4/lista_SP.xlsx", "/S4/plain.txt"]


@query("""SELECT * FROM (VALUES ('/S1/Data/RDSP2301.dbc', 'S1', 'RD', 'SP', 202301, 'data'), ('/S1/Data/RDAL9912.dbc', 'S1', 'RD', 'AL', 199912, 'data'), ('/S2/PA_RJ_0512.dbf', 'S2', 'PA', 'RJ', 200512, 'data'), ('/S2/NAC2015.csv', 'S2', 'NAC', NULL, NULL, 'data'), ('/S3/DOMG20.zip', 'S3', 'DO', 'MG', NULL, 'data'), ('/S3/docs/manual.pdf', 'S3', 'MANUAL', NULL, NULL, 'documentation'), ('/S1/aux/CID10.cnv', 'S1', 'CID', NULL, NULL, 'cnv'), ('/S4/lista_SP.xlsx', 'S4', 'LISTA', 'SP', NULL, 'data'), ('/S4/plain.txt', 'S4', 'PLAIN', NULL, NULL, 'documentation')) AS v(path, system, prefix, geo, date, role)""")
def filename_grammar(spark, d):
    f = inventory.facts(spark.createDataFrame([(n,) for n in _NAMES], "path string"))
    return f.select("path", "system", "prefix", "geo", F.col("date").cast("int").alias("date"), "role")


_FOLDERS = """f AS (SELECT left(o_orderpriority, 1) AS folder, CASE WHEN left(o_orderpriority, 1) = '5' THEN NULL ELSE o_orderstatus END AS series,
 CASE left(o_orderpriority, 1) WHEN '1' THEN strftime(o_orderdate, '%y%m') WHEN '2' THEN strftime(o_orderdate, '%Y') WHEN '3' THEN strftime(o_orderdate, '%Y%m') WHEN '4' THEN CASE WHEN o_orderkey % 2 = 0 THEN lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') ELSE CAST(41 + o_orderkey % 20 AS VARCHAR) END ELSE '2005' END AS digits FROM orders)"""


@query(f"""
WITH {_FOLDERS},
t AS (SELECT folder, bool_and(length(digits) = 6) AS six, bool_and(length(digits) = 2) AS two, avg(CASE WHEN TRY_CAST(substr(digits, 3, 2) AS INTEGER) BETWEEN 1 AND 12 THEN 1.0 ELSE 0 END) FILTER (WHERE length(digits) = 4) AS months,
 bool_or(left(digits, 2) NOT IN ('19', '20')) FILTER (WHERE length(digits) = 4) AS odd, bool_or(series IS NOT NULL) AS named FROM f GROUP BY folder),
m AS (SELECT folder, max(c) AS c FROM (SELECT folder, series, left(digits, 2), count(DISTINCT substr(digits, 3, 2)) AS c FROM f WHERE length(digits) = 4 GROUP BY ALL) GROUP BY folder),
y AS (SELECT folder, CAST(digits AS INTEGER) AS v FROM f WHERE length(digits) = 2),
r AS (SELECT folder, 'pivot' AS epoch, 0 AS rank, v + CASE WHEN v <= 40 THEN 2000 ELSE 1900 END AS year FROM y UNION ALL SELECT folder, '2000', 1, v + 2000 FROM y UNION ALL SELECT folder, '1900', 2, v + 1900 FROM y),
e AS (SELECT folder, first(epoch ORDER BY span, rank) AS epoch FROM (SELECT folder, epoch, rank, max(year) - min(year) AS span FROM r GROUP BY ALL HAVING max(year) <= 2086 AND min(year) >= 1900) GROUP BY folder)
SELECT folder, CASE WHEN six THEN 'explicit' WHEN two THEN 'annual' WHEN months IS NULL THEN 'ambiguous' WHEN months < 0.98 THEN 'annual' WHEN odd OR c > 1 THEN 'monthly' WHEN named THEN 'annual' ELSE 'ambiguous' END AS convention, epoch
FROM t LEFT JOIN m USING (folder) LEFT JOIN e USING (folder)""")
def date_convention(spark, d):
    """Folders of order dates written in several ways, and of two-digit codes on both sides of the pivot."""
    o, day = t(spark, d, "orders"), F.col("o_orderdate")
    folder_ = F.substring("o_orderpriority", 1, 1)
    two = F.when(F.col("o_orderkey") % 2 == 0, F.lpad((F.col("o_orderkey") % 30).cast("string"), 2, "0")).otherwise((F.col("o_orderkey") % 20 + 41).cast("string"))
    digits = F.when(folder_ == "1", F.date_format(day, "yyMM")).when(folder_ == "2", F.date_format(day, "yyyy")).when(folder_ == "3", F.date_format(day, "yyyyMM")).when(folder_ == "4", two).otherwise("2005")
    return naming.date_conventions(o.select(folder_.alias("folder"), F.when(folder_ != "5", F.col("o_orderstatus")).alias("series"), digits.alias("digits")), 2026)


@query("""
WITH n AS (SELECT n_nationkey AS k, upper(substr(n_name, 1, 2)) AS p FROM nation),
s AS (SELECT unnest([
 {'path': '/S1/Data/' || p || 'XSP23' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') || '.dbc', 'system': 'S1', 'prefix': p || 'X', 'geo': 'SP', 'date': 202301 + k % 12, 'role': 'data'},
 {'path': '/S2/' || p || 'X_RJ_40' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') || '.csv.zip', 'system': 'S2', 'prefix': p || 'X', 'geo': 'RJ', 'date': 204001 + k % 12, 'role': 'data'},
 {'path': '/S2/' || p || 'XMG41' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') || '.dbf.gz', 'system': 'S2', 'prefix': p || 'X', 'geo': 'MG', 'date': 194101 + k % 12, 'role': 'data'},
 {'path': '/S3/docs/' || lower(p) || 'manual.pdf', 'system': 'S3', 'prefix': p || 'MANUAL', 'geo': NULL, 'date': NULL, 'role': 'documentation'},
 {'path': '/S4/lista' || lower(p) || '_SP.xlsx', 'system': 'S4', 'prefix': 'LISTA' || p, 'geo': 'SP', 'date': NULL, 'role': 'data'}]) AS x FROM n)
SELECT x.path AS path, x.system AS system, x.prefix AS prefix, x.geo AS geo, CAST(x.date AS BIGINT) AS date, x.role AS role FROM s""")
def filename_grammar_of_tables(spark, d):
    """Names of several grammars made of the nations' names: classic, parted, packed twice, documents, lists; years on both sides of the pivot."""
    p, month = F.upper(F.substring("n_name", 1, 2)), F.lpad((F.col("n_nationkey") % 12 + 1).cast("string"), 2, "0")
    paths = [F.concat(F.lit("/S1/Data/"), p, F.lit("XSP23"), month, F.lit(".dbc")), F.concat(F.lit("/S2/"), p, F.lit("X_RJ_40"), month, F.lit(".csv.zip")), F.concat(F.lit("/S2/"), p, F.lit("XMG41"), month, F.lit(".dbf.gz")), F.concat(F.lit("/S3/docs/"), F.lower(p), F.lit("manual.pdf")), F.concat(F.lit("/S4/lista"), F.lower(p), F.lit("_SP.xlsx"))]
    return inventory.facts(t(spark, d, "nation").select(F.explode(F.array(*paths)).alias("path"))).select("path", "system", "prefix", "geo", long("date", "date"), "role")


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS system, coalesce(nullif(regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1), ''), '') AS series FROM pages")
def url_path_parts(spark, d):
    p = t(spark, d, "pages")
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return p.select("page_id", naming.system_of(path).alias("system"), F.split_part(path, F.lit("/"), F.lit(2)).alias("series"))


@query("SELECT brand AS name, levenshtein(upper(brand), 'BRAND#1') AS distance FROM (SELECT DISTINCT p_brand AS brand FROM part) WHERE levenshtein(upper(brand), 'BRAND#1') <= 3 ORDER BY 2, 1 LIMIT 5")
def suggest_names(spark, d):
    brands = t(spark, d, "part").select(F.col("p_brand").alias("brand")).distinct()
    return text.suggestions(brands, "brand", "Brand#1").withColumn("distance", F.col("distance").cast("long"))


# --- generations --------------------------------------------------------------------------------


def _order_generations(spark, d) -> dict[str, DataFrame]:
    o = t(spark, d, "orders")
    y = F.year("o_orderdate")
    return {
        "old": o.where(y < 1998).select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("float").alias("o_totalprice"), "o_orderpriority"),
        "mid": o.where((y >= 1998) & (y < 2000)).select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderpriority").alias("o_orderpriority1")),
        "new": o.where(y >= 2000).select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderpriority").alias("o_orderpriority1"), F.col("o_custkey").alias("o_cust")),
    }


@query("""
SELECT o_orderkey, o_orderstatus, CASE WHEN year(o_orderdate) < 1998 THEN o_orderpriority END AS o_orderpriority, CASE WHEN year(o_orderdate) >= 1998 THEN o_orderpriority END AS o_orderpriority1, CASE WHEN year(o_orderdate) >= 2000 THEN o_custkey END AS o_cust FROM orders""")
def generation_union(spark, d):
    return generations.union(list(_order_generations(spark, d).values())).drop("o_totalprice")


@query("SELECT * FROM (VALUES ('o_cust', 1, 'sometimes'), ('o_orderkey', 3, 'always'), ('o_orderpriority', 1, 'sometimes'), ('o_orderpriority1', 2, 'sometimes'), ('o_orderstatus', 3, 'always'), ('o_totalprice', 3, 'always')) AS v(field, families, state)")
def schema_drift(spark, d):
    return generations.drift(generations.presence(_order_generations(spark, d), spark)).select("field", F.col("families").cast("int").alias("families"), "state")


@query("SELECT 'o_orderpriority' AS old, 'o_orderpriority1' AS new")
def rename_candidates(spark, d):
    return generations.renames(generations.presence(_order_generations(spark, d), spark)).select("old", "new")


@query("SELECT * FROM (VALUES (1995, 'o_orderkey,o_orderpriority,o_orderstatus,o_totalprice', ''), (1998, 'o_orderpriority1', 'o_orderpriority'), (2000, 'o_cust', '')) AS v(first_year, added, dropped)")
def generation_history(spark, d):
    order = spark.createDataFrame([("old", 1995), ("mid", 1998), ("new", 2000)], "family string, first_year int")
    return generations.signature_history(generations.presence(_order_generations(spark, d), spark), order).select("first_year", "added", "dropped")


_FIELD_YEARS = [("A", y) for y in (1995, 1996, 1998, 1999, 2001)] + [("B", y) for y in (1998, 1999, 2001)] + [("C", 1995)]


@query("SELECT * FROM (VALUES ('A', 1995, 2001, 5), ('B', 1998, 2001, 3), ('C', 1995, 1995, 1)) AS v(field, first, last, years)")
def availability_windows(spark, d):
    """1997 and 2000 were never decoded, and split no run."""
    y = spark.createDataFrame(_FIELD_YEARS, "field string, year int")
    return generations.intervals(y, ["field"], y.select("year")).withColumn("years", F.col("years").cast("int"))


@query("""
WITH y AS (SELECT DISTINCT o_orderpriority AS field, year(o_orderdate) * 12 + month(o_orderdate) AS year FROM orders WHERE o_totalprice > 390000), r AS (SELECT *, year - row_number() OVER (PARTITION BY field ORDER BY year) AS run FROM y)
SELECT field, CAST(min(year) AS BIGINT) AS first, CAST(max(year) AS BIGINT) AS last, count(*) AS years FROM r GROUP BY field, run""")
def year_intervals(spark, d):
    o = t(spark, d, "orders").where("o_totalprice > 390000")
    y = o.select(F.col("o_orderpriority").alias("field"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("year"))
    return generations.intervals(y, ["field"])


@query("SELECT * FROM (VALUES ('A', 1995, 'present'), ('A', 1996, 'present'), ('A', 1997, 'unknown'), ('A', 1998, 'present'), ('B', 1995, 'absent'), ('B', 1996, 'absent'), ('B', 1997, 'unknown'), ('B', 1998, 'partial')) AS v(field, year, state)")
def availability_states(spark, d):
    years = spark.createDataFrame([("A", 1995, 2), ("A", 1996, 2), ("A", 1998, 2), ("B", 1998, 1)], "field string, year int, files int")
    decoded = spark.createDataFrame([(1995, 2), (1996, 2), (1998, 2)], "year int, files int")
    return generations.availability(years, decoded, spark.range(1995, 1999).select(F.col("id").cast("int").alias("year")))


@query("SELECT * FROM (VALUES (1996, '', 'C'), (1998, 'B', '')) AS v(year, added, dropped)")
def change_boundaries(spark, d):
    return generations.change_boundaries(spark.createDataFrame(_FIELD_YEARS, "field string, year int"))


# --- inventory ----------------------------------------------------------------------------------


@query("""
SELECT source AS system, lang AS series, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, arg_min(lpad(CAST(doc_id AS VARCHAR), 9, '0'), lpad(CAST(n_chars AS VARCHAR), 12, '0') || lpad(CAST(doc_id AS VARCHAR), 9, '0')) AS sample FROM documents GROUP BY ALL""")
def strata_cheapest_sample(spark, d):
    f = t(spark, d, "documents").select(F.col("source").alias("system"), F.col("lang").alias("series"), F.lit(2020).alias("year"), F.col("n_chars").alias("size"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"))
    return inventory.strata(f).select("system", "series", "files", "bytes", "sample")


@query("""
WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)
SELECT source AS prefix, arg_max(lang, lpad(CAST(n AS VARCHAR), 12, '0') || lang) AS system, CAST(sum(n) AS BIGINT) AS files, round(max(n) / sum(n), 6) AS agreement, round(max(n) / sum(n), 6) >= 0.9 AND sum(n) >= 5 AS trusted FROM n GROUP BY source""")
def prefix_majority(spark, d):
    return inventory.prefix_majority(t(spark, d, "documents").select(F.col("source").alias("prefix"), F.col("lang").alias("system")))


@query("""
SELECT 'o' AS system, 's' AS series, axis, share, share >= 0.5 AS present, share >= 0.999 AS complete FROM (SELECT 'uf' AS axis, round(avg(CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0 END), 6) AS share FROM orders UNION ALL SELECT 'year', 1.0 UNION ALL SELECT 'month', round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 6) FROM orders)""")
def axis_shares(spark, d):
    o = t(spark, d, "orders")
    f = o.select(F.lit("o").alias("system"), F.lit("s").alias("series"), F.when(F.col("o_orderkey") % 3 == 0, "SP").alias("geo"), F.year("o_orderdate").alias("year"), (F.year("o_orderdate") * 100 + F.when(F.col("o_orderstatus") == "F", F.month("o_orderdate")).otherwise(0)).alias("date"))
    return inventory.axis_shares(f)


def _listings(spark, d) -> tuple[DataFrame, DataFrame]:
    doc = t(spark, d, "documents").select(F.concat(F.lit("/a/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("modified"), "doc_id")
    before = doc.where("doc_id % 10 <> 1").drop("doc_id")
    after = doc.where("doc_id % 10 <> 2").withColumn("size", F.when(F.col("doc_id") % 10 == 3, F.col("size") + 1).otherwise(F.col("size"))).withColumn("path", F.when(F.col("doc_id") % 10 == 4, F.regexp_replace("path", "^/a/", "/b/")).otherwise(F.col("path"))).drop("doc_id")
    return before, after


_STATES_SQL = "SELECT '/a/' || source || '/' || doc_id AS path, CASE doc_id % 10 WHEN 1 THEN 'new' WHEN 2 THEN 'gone' WHEN 3 THEN 'changed' WHEN 4 THEN 'gone' ELSE 'unchanged' END AS state FROM documents UNION ALL SELECT '/b/' || source || '/' || doc_id, 'new' FROM documents WHERE doc_id % 10 = 4"


@query(_STATES_SQL)
def snapshot_diff(spark, d):
    return inventory.snapshot_diff(*_listings(spark, d))


@query("SELECT '/a/' || source || '/' || doc_id AS old, '/b/' || source || '/' || doc_id AS new, 'moved' AS how FROM documents WHERE doc_id % 10 = 4")
def moved_files(spark, d):
    before, after = _listings(spark, d)
    diff = inventory.snapshot_diff(before, after)
    gone = before.join(diff.where("state = 'gone'").select("path"), "path", "left_semi")
    new = after.join(diff.where("state = 'new'").select("path"), "path", "left_semi")
    return inventory.moves(gone, new)


@query("SELECT * FROM (VALUES ('S1', 'RD', 'hosp', 'declared'), ('S1', 'RD_2015', 'hosp', 'cleaned'), ('S9', 'PA', 'amb', 'series_only'), ('S9', 'ZZ', NULL, 'unbound')) AS v(system, series, dataset, rule)")
def ontology_bind(spark, d):
    observed = spark.createDataFrame([("S1", "RD"), ("S1", "RD_2015"), ("S9", "PA"), ("S9", "ZZ")], "system string, series string")
    declared = spark.createDataFrame([("S1", "RD", "hosp"), ("S2", "PA", "amb")], "system string, series string, dataset string")
    return inventory.bind(observed, declared)


@query("""
SELECT 'part' AS key, ds AS dataset, CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, max(n) AS most, CASE WHEN max(n) > 1 THEN 'many' ELSE 'one' END AS grain FROM (SELECT 'part' AS ds, p_partkey AS k, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'lineitem', l_partkey, count(*) FROM lineitem GROUP BY ALL) GROUP BY ds""")
def join_grain_fanout(spark, d):
    return inventory.join_grain({"part": (t(spark, d, "part"), "p_partkey"), "lineitem": (t(spark, d, "lineitem"), "l_partkey")}, "part").drop("column")


@query("""
SELECT e.event_id, p.value AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_last_purchase(spark, d):
    """Each event with its user's last purchase not after it."""
    e = t(spark, d, "events").select("event_id", "user_id", "ts")
    p = t(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return inventory.as_of(e, p, key="user_id", left_time="ts", right_time="ts", value="value", out="last_purchase").select("event_id", "last_purchase")


# --- text, JSON, plain SQL ----------------------------------------------------------------------


@query(r"""SELECT source, count(*) AS docs, count(*) FILTER (WHERE regexp_matches(text, '[a-z0-9._]+@[a-z0-9.]+\.[a-z]+')) AS with_mail, count(*) FILTER (WHERE regexp_matches(text, '(^|[^0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}([^0-9.]|$)')) AS with_address FROM documents GROUP BY source""")
def pii_shapes(spark, d):
    x = t(spark, d, "documents")
    return x.groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.col("text").rlike(r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]+")).alias("with_mail"), F.count_if(F.col("text").rlike(r"(^|[^0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}([^0-9.]|$)")).alias("with_address"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events")
def json_props_flatten(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")


@query("SELECT c_mktsegment AS segment, n_name AS nation, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def star_join(spark, d):
    o, c, n = t(spark, d, "orders"), t(spark, d, "customer"), t(spark, d, "nation")
    o = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("x"))  # fewer rows reach the join
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # nation: 25 rows at any size
    return j.groupBy(F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation")).agg(F.sum("n").alias("n_orders"), F.round(F.sum("x"), 2).alias("total"))


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY ALL""")
def pricing_summary(spark, d):
    li = t(spark, d, "lineitem").where("l_shipdate <= timestamp '2001-06-01'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) AS g1, grouping(o_orderpriority) AS g2 FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(spark, d):
    return t(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("long").alias("g1"), F.grouping("o_orderpriority").cast("long").alias("g2"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_orders_per_customer(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer)")
def set_operations(spark, d):
    c, s, n = t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").select("s_nationkey"), t(spark, d, "nation").select("n_nationkey")
    return c.intersect(s).union(n.exceptAll(c.distinct())).distinct()


@query("SELECT count(*) FILTER (WHERE e) AS buyers, count(*) FILTER (WHERE NOT e) AS others FROM (SELECT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS e FROM customer)")
def semi_anti(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    a = c.join(o, "c_custkey", "left_semi").agg(F.count("*").alias("buyers"))
    return a.join(c.join(o, "c_custkey", "left_anti").agg(F.count("*").alias("others")))  # one row each


@query("SELECT l_shipmonth, n, round(total, 2) AS total FROM (SELECT year(l_shipdate) * 100 + month(l_shipdate) AS l_shipmonth, count(*) AS n, sum(l_extendedprice) AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' AND l_returnflag = 'R' GROUP BY 1)")
def lake_pruned_scan(spark, d):
    """Written as a lake by year, read back with one year's folders."""
    root = Lake(spark, folder(spark, "lake"))
    li = t(spark, d, "lineitem").select("l_shipdate", "l_extendedprice", "l_returnflag").withColumns({"uf": F.lit(None).cast("string"), "year": F.year("l_shipdate")})
    root.write(li, "tpch", "lineitem")
    li = root.scan("tpch", "lineitem", years=1998, where="l_returnflag = 'R'", columns=["l_shipdate", "l_extendedprice"])
    return li.groupBy((F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("long").alias("l_shipmonth")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


# --- more of the reference tables, ledger and search --------------------------------------------


@query(f"SELECT system, codelist, code, label, min(valid_from) AS valid_from, max(conf) AS confidence FROM (SELECT *, CASE source {' '.join(f'''WHEN '{k}' THEN {c}''' for k, (_, c) in dictionary.AUTHORITY.items())} END AS conf FROM {_CLAIMS_SQL}) GROUP BY ALL")
def bundle_collapse(spark, d):
    claims = spark.createDataFrame(_CLAIMS, _CLAIM).withColumns({"valid_to": F.lit(None).cast("int"), "confidence": dictionary.confidence(F.col("source"))})
    return dictionary.collapsed(claims).drop("valid_to")


@query(f"SELECT codelist, CAST(count(DISTINCT code) AS BIGINT) AS codes, CAST(count(DISTINCT label) AS BIGINT) AS labels, round(count(DISTINCT label) / count(DISTINCT code), 6) AS granularity FROM {_CLAIMS_SQL} GROUP BY codelist")
def codelist_stats(spark, d):
    return codelists.list_stats(spark.createDataFrame(_CLAIMS, _CLAIM)).select("codelist", "codes", "labels", "granularity")


@query("SELECT 'sex' AS codelist, '9' AS code")
def ignored_label_codes(spark, d):
    return codelists.sentinel_codes(spark.createDataFrame(_CLAIMS, _CLAIM))


@query(f"SELECT 'status' AS codelist, CAST(count(DISTINCT (a, b)) AS BIGINT) AS windows, bool_or(b IS NULL) AS open_ended, CAST(count(DISTINCT code) AS BIGINT) AS codes FROM {_STATUS_SQL}")
def codelist_vintages(spark, d):
    return codelists.vintages(status(spark))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS code, CASE WHEN n_nationkey < 5 THEN n_name ELSE r_name END AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def multi_codelist_merge(spark, d):
    """Two tables for one field; the first that has a code wins."""
    lists = _nation_lists(spark, d)
    return codelists.merged([lists.where("codelist = 'few'"), lists.where("codelist = 'region'")])


@query("SELECT 'SEXO' AS field, 'SEX' AS codelist, 1 AS rank UNION ALL SELECT 'SEXO', 'SEXO', 0 UNION ALL SELECT 'SEXO', 'RACA', 2")
def name_affinity(spark, d):
    rows = spark.createDataFrame([("SEXO", "SEX"), ("SEXO", "SEXO"), ("SEXO", "RACA")], "field string, codelist string")
    return rows.withColumn("rank", text.affinity(F.col("field"), F.col("codelist")))


@query("SELECT lpad(CAST((c_custkey * 7919) % 1000000 AS VARCHAR), 6, '0') AS six, count(*) AS n FROM customer GROUP BY 1")
def place_index(spark, d):
    six = F.lpad(((F.col("c_custkey") * 7919) % 1000000).cast("string"), 6, "0")
    c = t(spark, d, "customer").select(six.alias("code"))
    index = dictionary.place_index(c)
    return c.join(index.select("six"), F.col("code") == F.col("six")).groupBy("six").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, label, CASE WHEN o_orderstatus <> label THEN o_orderstatus || ' – ' || label ELSE o_orderstatus END AS shown FROM orders JOIN (VALUES ('F', 'Filled'), ('O', 'O'), ('P', 'Part')) AS v(code, label) ON code = o_orderstatus")
def code_and_label(spark, d):
    labels = spark.createDataFrame([("F", "Filled"), ("O", "O"), ("P", "Part")], "code string, label string")
    o = codelists.label_once(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", labels)
    shown = F.when(text.useful_label(F.col("o_orderstatus"), F.col("label")), text.code_and_label(F.col("o_orderstatus"), F.col("label"))).otherwise(F.col("o_orderstatus"))
    return o.select("o_orderkey", "label", shown.alias("shown"))


@query("SELECT * FROM (VALUES ('absent', 3), ('malformed', 1), ('sentinel', 4), ('several', 2), ('single', 5), ('unknown', 6)) AS v(kind, n)")
def diagnosis_quality(spark, d):
    from . import meaning

    values = spark.createDataFrame([("A00", 5), ("B99", 6), ("A00 B01", 2), ("0000", 4), ("9x", 1), (None, 2), (" ", 1)], "value string, n int")
    return meaning.icd_quality(values, spark.createDataFrame([("A00",)], "code string")).select("kind", F.col("n").cast("int").alias("n"))


@query("SELECT * FROM (VALUES ('p_name', 'delimited'), ('p_brand', 'none')) AS v(field, packing)")
def token_rules(spark, d):
    freq = profile.frequencies(t(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit(",")).alias("p_name"), "p_brand"))
    out = []
    for f in ("p_name", "p_brand"):
        rule = render.token_rule(freq.where((F.col("field") == f) & F.col("value").isNotNull()))
        out.append((f, "delimited" if "delimiters" in rule else "width" if rule else "none"))
    return spark.createDataFrame(out, "field string, packing string")


@query("SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_windows(spark, d):
    """The streaming aggregate on a batch: event-time windows of a day."""
    from ..streaming.ingest import windowed

    return windowed(t(spark, d, "events"), time="ts", keys=["event_type"], value="value").select("event_type", "start", "n", F.round("total", 4).alias("total"))


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, d):
    from ..streaming.ingest import sessions

    return sessions(t(spark, d, "events"), time="ts", key="user_id").select("user_id", "start", "n")


@query("""
WITH n AS (SELECT n_nationkey AS k, upper(substr(n_name, 1, 3)) AS p FROM nation),
s AS (SELECT k, p, unnest([p || 'X:MEMBER:' || k, lower(p) || 'ufaamm', p || '_' || (1990 + k), p || 'SP' || (2300 + k), p || 'BR25' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') || 'A', p || 'RJ2509_' || k, ' ' || lower(p) || ' ' || k, p || 'ZZ2301']) AS prefix FROM n)
SELECT prefix, CASE WHEN prefix LIKE '%:%' THEN p || 'X' WHEN prefix LIKE ' %' THEN p || ' ' || k WHEN prefix LIKE '%ZZ%' THEN prefix ELSE p END AS series FROM s""")
def canonical_series(spark, d):
    p = F.upper(F.substring("n_name", 1, 3))
    k = F.col("n_nationkey").cast("string")
    month = F.lpad((F.col("n_nationkey") % 12 + 1).cast("string"), 2, "0")
    forms = [F.concat(p, F.lit("X:MEMBER:"), k), F.concat(F.lower(p), F.lit("ufaamm")), F.concat(p, F.lit("_"), (F.col("n_nationkey") + 1990).cast("string")), F.concat(p, F.lit("SP"), (F.col("n_nationkey") + 2300).cast("string")), F.concat(p, F.lit("BR25"), month, F.lit("A")), F.concat(p, F.lit("RJ2509_"), k), F.concat(F.lit(" "), F.lower(p), F.lit(" "), k), F.concat(p, F.lit("ZZ2301"))]
    return t(spark, d, "nation").select(F.explode(F.array(*forms)).alias("prefix")).withColumn("series", naming.canonical_series(F.col("prefix")))


@query("SELECT * FROM (VALUES ('/kits/k_199801-200512.zip', 199801, 200512), ('/k_200601_200712/x.zip', 200601, 200712), ('/x.zip', NULL, NULL)) AS v(path, a, b)")
def kit_windows(spark, d):
    rows = spark.createDataFrame([("/kits/k_199801-200512.zip",), ("/k_200601_200712/x.zip",), ("/x.zip",)], "path string")
    a, b = naming.kit_window(F.col("path"))
    return rows.select("path", a.alias("a"), b.alias("b"))


@query("SELECT o_orderstatus AS value, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM orders), 4) AS percent, label FROM orders LEFT JOIN (VALUES ('F', 'Filled'), ('O', 'Open')) AS v(code, label) ON code = o_orderstatus GROUP BY ALL")
def describe_field(spark, d):
    from .. import api

    codes = spark.createDataFrame([("F", "Filled"), ("O", "Open")], "code string, label string")
    return api.describe(t(spark, d, "orders"), "o_orderstatus", codes).drop("rank")


@query("SELECT 'c_mktsegment' AS field, 'categorical_undecoded' AS semantic_type, 'non_summable' AS aggregation UNION ALL SELECT 'c_acctbal', 'money', 'additive' UNION ALL SELECT 'c_name', 'free_text', 'non_summable'")
def ledger_rows(spark, d):
    from . import meaning

    c = t(spark, d, "customer").select("c_mktsegment", F.format_string("%.2f", "c_acctbal").alias("c_acctbal"), "c_name")
    return meaning.ledger(detectors.verdicts(detectors.evidence(profile.frequencies(c)))).select("field", "semantic_type", "aggregation")


@query("SELECT o_orderstatus AS status, CAST(min(year(o_orderdate)) AS BIGINT) AS first, CAST(max(year(o_orderdate)) AS BIGINT) AS last FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def series_span(spark, d):
    o = t(spark, d, "orders").where("o_orderstatus in ('F', 'O')")
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.min(F.year("o_orderdate")).cast("long").alias("first"), F.max(F.year("o_orderdate")).cast("long").alias("last"))


@query()
def search_documents(spark, d):
    """Ranked full-text search; the ranking is our own, so only rows are compared. The limit is the report's."""
    from . import meaning

    x = t(spark, d, "documents").select(F.col("lang").alias("kind"), F.col("doc_id").cast("string").alias("name"), "text")
    return meaning.search(x, "license", 20)


@query("SELECT p_type AS codelist, CAST(count(DISTINCT p_brand) AS BIGINT) AS fields FROM part GROUP BY 1")
def bindings_of_types(spark, d):
    p = t(spark, d, "part").select(F.lit("s").alias("system"), F.col("p_type").alias("codelist"), F.col("p_brand").alias("field")).distinct()
    e = t(spark, d, "part").select(F.lit("s").alias("system"), F.col("p_type").alias("codelist"), F.col("p_name").alias("code"))
    return dictionary.bound_only(e, p).select("codelist").distinct().join(p, "codelist").groupBy("codelist").agg(F.count_distinct("field").alias("fields"))
