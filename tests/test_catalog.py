import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark import errors
from quillspark.__main__ import main
from quillspark.plans import catalog, lake


def test_tables_grow_by_columns_only(spark, tmp_path, monkeypatch):
    c = catalog.Catalog(spark, f"file://{tmp_path}/c")
    assert c.read("families").count() == 0
    c.ask("k", area="a", question="why?")
    c.ask("k", area="a", question="why not?")
    assert [r.question for r in c.read("open_questions").collect()] == ["why not?"]
    monkeypatch.setitem(catalog.TABLES, "open_questions", catalog.TABLES["open_questions"] + ", note string")
    assert c.read("open_questions").first().note is None
    monkeypatch.setitem(catalog.TABLES, "open_questions", catalog.TABLES["open_questions"].replace("blocking boolean", "blocking int"))
    with pytest.raises(errors.CatalogShape):
        c.read("open_questions")
    with pytest.raises(errors.CatalogShape):
        c.replace("files", spark.createDataFrame([(1,)], "nothing int"))


def test_stages_run_after_what_they_need():
    ran = []
    s = [catalog.Stage("b", lambda: ran.append("b"), ("a",)), catalog.Stage("a", lambda: ran.append("a"))]
    catalog.run_stages(s)
    assert ran == ["a", "b"]
    with pytest.raises(ValueError):
        catalog.in_order([catalog.Stage("a", print, ("b",)), catalog.Stage("b", print, ("a",))])


def test_placement(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    assert catalog.Placement.find("x").layer == "explicit"
    assert catalog.Placement.find(start=str(tmp_path)).layer == "working"
    (tmp_path / ".quillspark").mkdir()
    (tmp_path / "a").mkdir()
    assert catalog.Placement.find(start=str(tmp_path / "a")).layer == "project"


def test_population_and_keys(spark):
    df = spark.createDataFrame([("355030", "10", "x")], "MUNIC_RES string, POP string, COD_MUN string")
    out = catalog.population(df, 2010, "f")
    assert out.columns == ["municipality", "population", "municipality_1", "year", "_source_path"] and out.first().population == 10
    with pytest.raises(errors.UnsupportedStratification):
        catalog.population(df.drop("POP"))
    keys = spark.createDataFrame([("k", "f", "A"), ("k", "f", "Z")], "key string, family string, column string")
    presence = spark.createDataFrame([("f", "A")], "family string, field string")
    assert [r.column for r in catalog.missing_join_keys(keys, presence).collect()] == ["Z"]


def test_documentation_pages(spark):
    t = spark.createDataFrame([("SEXO - sex of the patient\n 1 - Male\n 2 - Female\nRACA race\n 01 = White",)], "text string")
    assert {tuple(r) for r in catalog.enumerations(t, ["SEXO", "RACA"]).collect()} == {("SEXO", "1", "Male"), ("SEXO", "2", "Female"), ("RACA", "01", "White")}


def test_kits():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("SEX.CNV", "1 1\n  1 Male   1\n")
        z.writestr("a.def", "SSex,SEXO,1,SEX.CNV\n")
        z.writestr("bad.dbf", "x")
    kit = catalog.read_kit(data.getvalue(), "S")
    assert kit["conversions"][0].name == "SEX" and kit["definitions"][0]["codelist"] == "SEX" and len(kit["errors"]) == 1


def test_freshness():
    f = catalog.Freshness(seen={"p": (1, "t")})
    assert f.serves("p", 1, "t") and not f.serves("p", 2, "t") and not f.serves("q", 1, "t")
    assert not catalog.Freshness("never", {"p": (1, "t")}).serves("p", 1, "t")


def test_command_line(spark, tmp_path, capsys):
    lake.Lake(spark, f"file://{tmp_path}").write(spark.range(3).select("id", F.lit("SP").alias("uf"), F.lit(2020).alias("year")), "S", "S_a")
    assert main(["systems", f"file://{tmp_path}"]) == 0 and capsys.readouterr().out.split() == ["S"]
    main(["sql", f"file://{tmp_path}", "SELECT count(*) AS n FROM S_a"])
    assert "3" in capsys.readouterr().out


def test_database_files_and_fetches(spark, tmp_path):
    import duckdb

    from quillspark.sources import containers

    c = duckdb.connect(str(tmp_path / "a.duckdb"))
    c.sql("CREATE TABLE t AS SELECT 1 AS x, 'a' AS y")
    c.close()
    assert [tuple(r) for r in containers.read_duckdb(spark, str(tmp_path / "a.duckdb"))["main.t"].collect()] == [(1, "a")]
    (tmp_path / "b.duckdb").write_bytes(b"\0" * 8 + b"DUCK" + (99).to_bytes(8, "little") + b"\0" * 5000)
    with pytest.raises(errors.UnsupportedContainer):
        containers.read_duckdb(spark, str(tmp_path / "b.duckdb"))

    def get(p):
        if p == "bad":
            raise OSError("no")
        return p.encode()

    got, failed = containers.fetch_all(["a", "b", "bad"], get, held={"a": b"held"})
    assert got == {"a": b"held", "b": b"b"} and "OSError" in failed["bad"]


def test_roles_docs_and_identifiers(spark):
    from quillspark.operators import detectors, profile
    from quillspark.plans import meaning

    f = spark.createDataFrame([("/a/x.dbc",), ("/doc/y.pdf",), ("/z",)], "path string")
    assert [r.role for r in meaning.roles_by_globs(f, {"/doc/*": "documentation", "*.dbc": "data"}).orderBy("path").collect()] == ["data", "documentation", None]
    assert meaning.parse_dataset_docs({"s": {"rd": {"grain": "a stay"}}})[0]["series"] == "RD"
    with pytest.raises(errors.CurationInvalid):
        meaning.parse_dataset_docs({"s": {"rd": {}}})
    people = spark.range(200).select((F.col("id") + 10_000_000_000).cast("string").alias("CPF"), F.lit("x").alias("o"))
    freq = profile.frequencies(people)
    assert [r.field for r in detectors.sensitive(detectors.verdicts(detectors.evidence(freq))).collect()] == ["CPF"]
    assert {r.field: r.share for r in detectors.membership(freq, spark.createDataFrame([("x",)], "code string")).collect()} == {"CPF": 0.0, "o": 1.0}
