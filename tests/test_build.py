import pytest
from pyspark.sql import functions as F

from quillspark import api
from quillspark.errors import MissingColumn, PartialFetch
from quillspark.operators import inventory, normalize
from quillspark.plans import build
from quillspark.plans.lake import Lake
from quillspark.sources import dbf

PLAN = normalize.Plan((normalize.FieldPlan("N", "N", 4),))


@pytest.fixture
def files(spark, tmp_path):
    for name, rows in (("RDSP2301", [("a", 1), ("b", 2)]), ("RDRJ2302", [("c", 3)])):
        (tmp_path / "S").mkdir(exist_ok=True)
        (tmp_path / "S" / f"{name}.dbf").write_bytes(dbf.encode(["C", "N"], [2, 4], rows))
    (tmp_path / "S" / "RDMG2303.csv").write_text("C,N,EXTRA\nd,4,e\n")
    paths = sorted(str(p) for p in (tmp_path / "S").iterdir())
    return inventory.facts(spark.createDataFrame([(p, 1) for p in paths], "path string, size long"), str(tmp_path))


def test_files_of_one_header_are_one_scan(spark, files):
    groups, failed = build.grouped(spark, [r.path for r in files.collect()])
    assert sorted((g.reader.split("/")[0], g.columns, len(g.paths)) for g in groups) == [("csv", ("C", "N", "EXTRA"), 1), ("dbf", ("C", "N"), 2)] and not failed
    df, _ = api.fetch(spark, files, plan=PLAN)
    assert sorted((r.C.strip(), r.N, r._source_path.rsplit("/", 1)[-1]) for r in df.collect()) == [("a", 1, "RDSP2301.dbf"), ("b", 2, "RDSP2301.dbf"), ("c", 3, "RDRJ2302.dbf"), ("d", 4, "RDMG2303.csv")]
    with pytest.raises(MissingColumn):
        api.fetch(spark, files, plan=normalize.Plan((normalize.FieldPlan("NOT"),)))


def test_an_unreadable_file_refuses_the_whole(spark, files, tmp_path):
    (tmp_path / "S" / "RDBA2301.dbf").write_bytes(b"\x03")
    more = files.unionByName(files.limit(1).withColumn("path", F.lit(str(tmp_path / "S" / "RDBA2301.dbf"))))
    with pytest.raises(PartialFetch):
        api.fetch(spark, more, plan=PLAN)
    assert api.fetch(spark, more, plan=PLAN, allow_partial=True)[0].count() == 4


def test_build_skips_what_is_current(spark, files, tmp_path):
    lake = Lake(spark, f"file://{tmp_path}/lake")
    first = build.build(lake, files, lambda system, prefix: PLAN)
    assert [(x["files"], x["outcome"]) for x in first] == [(1, "built"), (2, "built")] or [(x["files"], x["outcome"]) for x in first] == [(2, "built"), (1, "built")]
    assert {x["outcome"] for x in build.build(lake, files, lambda system, prefix: PLAN)} == {"current"}
    assert {x["outcome"] for x in build.build(lake, files.withColumn("size", F.lit(2)), lambda system, prefix: PLAN)} == {"built"}
    got = lake.scan_generations("S", None)
    assert got.count() == 4 and {r.uf for r in got.select("uf").distinct().collect()} == {"SP", "RJ", "MG"}


def test_packs_pages_and_batches(spark, tmp_path):
    schema = "system string, family string, field string, codelist string, confidence double, source string"
    b = spark.createDataFrame([("S", "f", "A", "x", 0.5, "p"), ("S", "f", "A", "x", 0.9, "q"), ("S", "f", "B", "y", 0.7, "p")], schema)
    build.pack_bindings(b, f"{tmp_path}/pack")
    seeded = build.seed_bindings(spark, f"{tmp_path}/pack", spark.createDataFrame([], schema))
    assert sorted((r.field, r.confidence, r.source) for r in seeded.collect()) == [("A", 0.9, "q"), ("B", 0.7, "p")]
    assert build.seed_bindings(spark, f"{tmp_path}/pack", b.limit(1)).count() == 1
    pages = {"ok": lambda page, size: [{"a": page * size + i, "b": None} for i in range(size)] if page < 3 else [], "bad": lambda page, size: 1 // 0}
    out = {x["endpoint"]: x for x in build.ingest_pages(spark, pages, str(tmp_path / "api"), page_size=2)}
    assert (out["ok"]["pages"], out["ok"]["rows"], out["bad"]["error"][:17]) == (3, 6, "ZeroDivisionError")
    assert spark.read.parquet(f"{tmp_path}/api/ok").count() == 6
    got = list(build.batches(spark.range(10).coalesce(1), 4))
    assert [x.num_rows for x in got] == [4, 4, 2] and got[2].column(0).to_pylist() == [8, 9]
    strata = spark.createDataFrame([("S", "a", 2000, 5, "sampled"), ("S", "a", 2001, None, None), ("S", "b", 2001, 1, None), ("T", "c", 2001, 1, "failed")], "system string, series string, year int, bytes long, status string")
    assert sorted(tuple(r) for r in build.coverage_by_system(strata).collect()) == [("S", 3, 1, 0, 2), ("T", 1, 0, 1, 0)]
    assert [r.series for r in build.sample_plan(strata).collect()] == ["b", "a"]
    census = build.census_summary(spark.createDataFrame([("S", "a", "1", 3), ("S", "a", "2", 5)], "system string, series string, signature string, fields int"))
    assert [tuple(r) for r in census.collect()] == [("S", "a", 2, 3, 5)]
