import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import dates, geo, naming, text, types


def one(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_declared_types():
    assert types.declared_type("N", 5).simpleString() == "int"
    assert types.declared_type("N", 12).simpleString() == "bigint"
    assert types.declared_type("N", 20).simpleString() == "double"
    assert types.declared_type("N", 8, 2).simpleString() == "decimal(8,2)"
    assert types.declared_type("?").simpleString() == "string"
    assert types.declared_type("Y").simpleString() == "decimal(19,4)"


def test_numbers(spark):
    got = one(spark, ["12345", "1,5", " 7 ", "x", None, "", "-12", "1.2.3"], "string", lambda c: types.number(c, "decimal(10,2)", 2).cast("string"))
    assert got == ["123.45", "1.50", "0.07", None, None, None, "-0.12", None]
    assert one(spark, ["99999999999", "12", "2.5", "-"], "string", lambda c: types.number(c, "int")) == [None, 12, 2, None]


def test_dates(spark):
    got = one(spark, ["20150228", "20150230", "00000000", "2015", None, " 20150101 "], "string", types.date8)
    assert got == [dt.date(2015, 2, 28), None, None, None, None, dt.date(2015, 1, 1)]
    assert one(spark, ["28022015"], "string", lambda c: types.date8(c, "DMY")) == [dt.date(2015, 2, 28)]
    assert one(spark, ["201513", "201512", "189912", "20151", None], "string", types.competence) == [None, 201512, None, None, None]
    assert one(spark, ["S", "n", "1", "maybe", None], "string", types.boolean) == [True, False, True, None, None]


@settings(max_examples=50, deadline=None)
@given(st.dates(dt.date(1901, 1, 1), dt.date(2199, 12, 31)))
def test_week_of_a_date(d):
    year, week = dates.epi_week_of(d)
    first = dt.date(year, 1, 4)
    start = first - dt.timedelta(days=first.isoweekday() % 7)
    assert start + dt.timedelta(weeks=week - 1) <= d < start + dt.timedelta(weeks=week)


def test_weeks_agree_with_the_scalar(spark):
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=37 * i) for i in range(400)]
    got = list(zip(one(spark, days, "date", dates.epi_year), one(spark, days, "date", dates.epi_week), strict=True))
    assert got == [dates.epi_week_of(d) for d in days]


def test_places(spark):
    assert one(spark, ["355030", "3550308", "35503", "35503a", None, " 355030 ", "abcdefg"], "string", geo.seven_digits) == ["3550308", "3550308", None, None, None, "3550308", None]
    assert one(spark, ["3550308", "3550309", None], "string", geo.valid_seven) == [True, False, False]
    assert one(spark, ["35", "99", None], "string", geo.state) == ["SP", None, None]


def test_tokens(spark):
    assert one(spark, ["A1, B2;;C3", "", None], "string", lambda c: text.tokens(c, ",;")) == [["A1", "B2", "C3"], [], None]
    assert one(spark, ["A00 B01C", None], "string", lambda c: text.tokens(c, width=4)) == [["A00", "B01C"], None]
    table = F.create_map(F.lit("A1"), F.lit("one"))
    assert one(spark, ["A1,B2"], "string", lambda c: text.labelled_tokens(text.tokens(c, ","), table)) == ["A1 one | B2"]
    assert one(spark, ["A1,B2"], "string", lambda c: text.misses(text.tokens(c, ","), table)) == [1]


def test_codes(spark):
    assert one(spark, ["09", "99", "A", None], "string", text.successor) == ["10", "100", None, None]
    assert one(spark, ["08"], "string", lambda c: text.code_range(c, F.lit("11"))) == [["08", "09", "10", "11"]]
    assert one(spark, ["12"], "string", lambda c: text.code_range(c, F.lit("11"))) == [None]
    assert one(spark, ["Ação Ü"], "string", text.folded) == ["acao u"]
    assert one(spark, ["12345678000190 - ACME"], "string", lambda c: text.company_split(c)[0]) == ["12345678000190"]


def test_decoding():
    assert text.best_decoding("São João".encode("cp1252")) in ("cp1252", "latin-1")
    assert text.best_decoding("São João".encode()) == "utf-8"
    assert text.best_decoding("São João ção".encode("cp850")) == "cp850"


def test_names():
    assert naming.schema_signature(["a", "B"]) == naming.schema_signature(["A", "b"])
    assert naming.schema_signature(["B", "A"]) != naming.schema_signature(["A", "B"])
    assert naming.dataset_spec("sih-rd") == ("SIH", "RD")
    with pytest.raises(ValueError):
        naming.dataset_spec("--")


def test_date_conventions(spark):
    rows = [("a", "s", "9901"), ("a", "s", "9902"), ("b", "s", "2013"), ("b", "s", "2050"), ("c", None, "201501"), ("d", None, "79"), ("d", None, "99"), ("d", None, "05"), ("e", None, "45"), ("e", None, "30"), ("f", None, "2005"), ("g", "s", "2005"), ("g", "s", "2006"), ("h", "s", None)]
    got = {r.folder: (r.convention, r.epoch) for r in naming.date_conventions(spark.createDataFrame(rows, "folder string, series string, digits string"), 2026).collect()}
    assert got == {"a": ("monthly", None), "b": ("annual", None), "c": ("explicit", None), "d": ("annual", "pivot"), "e": ("annual", "2000"), "f": ("ambiguous", None), "g": ("monthly", None)}


def test_signature_column_equals_the_scalar(spark):
    assert one(spark, [["a", "b"]], "array<string>", naming.schema_signature_col) == [naming.schema_signature(["A", "B"])]


def test_windows_and_series(spark):
    assert one(spark, ["kit_199801-200512.zip", "/x_200601_200712/kit.zip", "none"], "string", lambda c: naming.kit_window(c)[0]) == [199801, 200601, None]
    assert one(spark, ["X:RD", "PAUFAAMM", "RD_2015", "RDSP2301", "a b"], "string", naming.canonical_series) == ["X", "PA", "RD", "RD", "A B"]
