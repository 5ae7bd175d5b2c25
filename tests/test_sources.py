import gzip
import io
import json
import struct
import zipfile

import pytest

from quillspark import errors
from quillspark.sources import containers, dbf, kits, text


def make_dbf(fields, rows, declared=None):
    record = 1 + sum(w for _, _, w, _ in fields)
    out = struct.pack("<BBBBIHH20x", 3, 24, 1, 1, declared if declared is not None else len(rows), 33 + 32 * len(fields), record)
    for n, letter, w, d in fields:
        out += n.encode().ljust(11, b"\0") + letter.encode() + b"\0" * 4 + bytes([w, d]) + b"\0" * 14
    out += b"\r"
    for deleted, cells in rows:
        out += (b"*" if deleted else b" ") + b"".join(c.encode("cp850")[:w].ljust(w) for c, (_, _, w, _) in zip(cells, fields, strict=True))
    return out + b"\x1a"


FIELDS = [("CODE", "C", 4, 0), ("X", "C", 1, 0), ("X", "N", 8, 2), ("NAME", "C", 12, 0)]
ROWS = [(False, ("A1", "1", "12.50", "João")), (True, ("B2", "2", "", "gone")), (False, ("C3", "", "7", ""))]


def test_dbf_bytes_drop_deleted_rows_and_trust_the_shorter_count():
    t = dbf.read_bytes(make_dbf(FIELDS, ROWS, declared=99))
    assert t.column_names == ["CODE", "X", "X_1", "NAME"]
    assert t.to_pylist() == [{"CODE": "A1", "X": "1", "X_1": "12.50", "NAME": "João"}, {"CODE": "C3", "X": None, "X_1": "7", "NAME": None}]


def test_dbf_source_splits_at_records(spark, tmp_path):
    rows = [(i % 10 == 9, (f"{i:04d}", "1", str(i), "é")) for i in range(1000)]
    (tmp_path / "a.dbf").write_bytes(make_dbf(FIELDS, rows))
    df = dbf.read_dbf(spark, str(tmp_path / "a.dbf"), recordsPerPartition=128)
    assert df.rdd.getNumPartitions() == 8 and df.count() == 900
    assert df.select("CODE").distinct().count() == 900 and df.columns == ["CODE", "X", "X_1", "NAME"]
    listed = spark.read.format("binaryFile").load(str(tmp_path / "a.dbf"))
    assert dbf.read_binary(listed, (tmp_path / "a.dbf").read_bytes()).count() == 900


def test_headers_refuse_what_is_partial():
    whole = make_dbf(FIELDS, ROWS)
    assert [f.name for f in dbf.parse_header(whole).fields] == ["CODE", "X", "X_1", "NAME"]
    with pytest.raises(errors.HeaderUnreadable):
        dbf.parse_header(whole[:60])
    with pytest.raises(errors.HeaderUnreadable):
        text.header_of(b"This is a long sentence that says nothing of columns at all\n")


def test_csv_stays_text(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("cód;nome;cód\n001;São;x\n002;;\n".encode("cp1252"))
    df = text.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["CÓD", "NOME", "CÓD_1"] and [tuple(r) for r in df.orderBy("NOME").collect()] == [("002", None, None), ("001", "São", "x")]


def test_json_and_xml(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1, "b": {"c": 2}}\n{"a": true}\n')
    rows = [tuple(r) for r in text.read_json(spark, str(tmp_path / "a.json")).collect()]
    assert rows == [("1", '{"c":"2"}'), ("true", None)]
    (tmp_path / "b.json").write_text(json.dumps({"meta": [{"x": 1}], "rows": [{"a": 1}, {"a": 2}]}))
    assert text.read_json(spark, str(tmp_path / "b.json")).count() == 2
    (tmp_path / "c.xml").write_text('<all><row id="1"><v>01</v></row><row id="2"><v>x</v></row></all>')
    df = text.read_xml(spark, str(tmp_path / "c.xml"))
    assert sorted((r["id"], r["v"]) for r in df.collect()) == [("1", "01"), ("2", "x")]


def test_layout(spark, tmp_path):
    (tmp_path / "a.txt").write_text("01AB\n02  \n")
    fields = text.parse_layout("name,size,start,end,type\nCODE,2,1,2,C\nLABEL,2,3,4,C\n")
    assert [tuple(r) for r in text.read_fixed(spark, str(tmp_path / "a.txt"), fields).orderBy("CODE").collect()] == [("01", "AB"), ("02", None)]


def test_pages_and_specs(spark):
    data = [{"a": i, "b": {"c": i}} for i in range(25)]
    df = text.pages_table(spark, lambda offset, n: data[offset : offset + n], page_size=10)
    assert df.count() == 25 and df.first()["b"] == '{"c": 0}'
    assert text.endpoints({"basePath": "/v1", "paths": {"/x": {"get": {"summary": "s", "parameters": [{"name": "q"}]}}}})[0]["path"] == "/v1/x"


def test_archives():
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a.dbf", make_dbf(FIELDS, ROWS))
        z.writestr("bad.rar", b"Rar!\x1a\x07xx")
    outer = gzip.compress(inner.getvalue())
    found = list(containers.walk(outer))
    assert [(p, e is None) for p, _, e in found] == [("content!a.dbf", True), ("content!bad.rar", False)]
    with pytest.raises(errors.Refusal):
        containers.safe_name("../x")
    with pytest.raises(errors.ArchiveQuota):
        containers.check_quota([1 << 40], 10)
    assert containers.ladder("x.dll") == [] and containers.ladder("x.csv")[0] == "csv"


def test_probe_keeps_failures(spark, tmp_path):
    (tmp_path / "a.dbf").write_bytes(make_dbf(FIELDS, ROWS))
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    (tmp_path / "c.bin").write_bytes(b"\0\1\2" * 50)
    got = {r.path.rsplit("/", 1)[1]: r for r in containers.probe(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got["a.dbf"].reader == "dbf" and got["b.csv"].columns == "A,B" and got["c.bin"].error


def test_conversions(spark):
    t = kits.parse_conversion("3 3\n; note\n  1 All others      A00-C99\n  2 Cholera         A00-A01\n  3 Listed          001-003,7\n")
    universe = spark.createDataFrame([(c,) for c in ("A00", "A01", "B01", "D01")], "code string")
    codes, rules = kits.conversion_codes(spark, t, universe)
    assert {r.code: r.label for r in codes.collect()} == {"A00": "Cholera", "A01": "Cholera", "B01": "All others", "001": "Listed", "002": "Listed", "003": "Listed", "007": "Listed"}
    assert rules.count() == 0 and not t.warnings
    rows, warnings = kits.parse_definition("; c\nSSex,SEXO,1,SEX.CNV\nLSex of patient,SEXO,1,SEX.CNV\n#x\n")
    assert kits.official_names(rows) == {"SEXO": "Sex"} and len(warnings) == 1 and rows[0]["codelist"] == "SEX"


def test_recodes(spark):
    df = spark.createDataFrame([('SEXO = dplyr::recode(SEXO, "1" = "M", "2" = "F")\ncase_when(RACA == "01" ~ "White")',)], "text string")
    assert {tuple(r) for r in kits.recodes(df).collect()} == {("SEXO", "1", "M"), ("SEXO", "2", "F"), ("RACA", "01", "White")}


def test_listings():
    got = kits.parse_listing(["01-31-99  02:05PM       <DIR>          DOCS", "12-01-2015  10:00AM  123 A.dbc"], "/d")
    assert got[0]["is_dir"] and got[0]["modified"] == "1999-01-31 14:05" and got[1]["size"] == 123
    assert kits.parse_listing(["total 2", "-rw-r--r--  1 a b 77 Jan  2  2020 x.csv"])[0]["modified"] == "2020-01-02 00:00"
    with pytest.raises(ValueError):
        kits.parse_listing(["what is this"])


def test_imploded_streams_and_compressed_tables(spark, tmp_path):
    from quillspark.errors import DecodeFailed
    from quillspark.sources import dbc

    assert dbc.explode(bytes.fromhex("00048224258f807f")) == b"AIAIAIAIAIAIA"  # the format's published example
    data = bytes(range(256)) * 5
    assert dbc.explode(dbc.implode(data)) == data and dbc.explode(dbc.implode(b"")) == b""
    for bad in (b"", b"\x00", b"\x05\x04aa", dbc.implode(data)[:50]):
        with pytest.raises(DecodeFailed):
            dbc.explode(bad)
    packed = dbc.pack(dbf.encode(["A", "B"], [3, 2], [("x", 1), ("ção", None)]))
    (tmp_path / "t.dbc").write_bytes(packed)
    got = dbf.read_dbf(spark, f"{tmp_path}/t.dbc", sourceColumn="true").collect()
    assert [(r.A.strip(), (r.B or "").strip()) for r in got] == [("x", "1"), ("ção", "")] and got[0]["_source_path"].endswith("t.dbc")
    assert containers.open_table(packed, "x/t.dbc")[0] == "dbc"


def test_isolated_work_is_killed_or_fails_apart():
    import os
    import time

    from quillspark.errors import DecodeFailed, ItemTimeout

    assert containers.with_deadline(lambda: 7, 20) == 7
    start = time.perf_counter()
    with pytest.raises(ItemTimeout):
        containers.with_deadline(lambda: time.sleep(60), 0.5)
    assert time.perf_counter() - start < 20
    with pytest.raises(DecodeFailed):
        containers.with_deadline(lambda: os._exit(3), 20)
    reader, table, failed = containers.open_isolated(b"a,b\n1,2\n", "x.csv")
    assert reader == "csv" and table.num_rows == 1


def test_quoted_line_ends_are_seen(spark, tmp_path):
    assert text.breaks_inside('a,"b\nc"\n') and not text.breaks_inside('a,"b ""x"" c"\nd\n')
    (tmp_path / "q.csv").write_text('A,B\n1,"x\ny"\n2,z\n')
    assert [tuple(r) for r in text.read_csv(spark, str(tmp_path / "q.csv")).orderBy("A").collect()] == [("1", "x\ny"), ("2", "z")]
