import pytest
from pyspark.sql import functions as F

from quillspark import api, errors
from quillspark.operators import normalize, render
from quillspark.plans import lake as lakes
from quillspark.streaming import ingest


@pytest.fixture
def lake(spark, tmp_path):
    lk = lakes.Lake(spark, f"file://{tmp_path}/lake")
    old = spark.createDataFrame([(1, "1", "SP", 2010), (2, "2", "AL", 2011)], "i int, SEX string, uf string, year int")
    new = spark.createDataFrame([(3.0, "1", "x", "SP", 2012)], "i double, SEX string, N string, uf string, year int")
    lk.write(old, "SIH", "SIH_RD_a", fingerprint="f1")
    lk.write(new, "SIH", "SIH_RD_b")
    return lk


def test_write_prune_and_count(lake):
    assert lake.systems() == ["SIH"] and len(lake.partitions("SIH", "SIH_RD_a")) == 2
    assert lake.count("SIH", "SIH_RD_a") == 2 and lake.count("SIH", "SIH_RD_a", uf="sp") == 1
    plan = lake.scan("SIH", "SIH_RD_a", uf=["SP"], years=2010, columns=["i"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "ReadSchema: struct<i:int>" in plan
    with pytest.raises(errors.MissingColumn):
        lake.scan("SIH", "SIH_RD_a", columns=["zz"])
    with pytest.raises(errors.NothingPublished):
        lake.family("SIH", "no")
    signature = lake.partitions("SIH", "SIH_RD_a")[0]["signature"]
    assert lake.is_current("SIH", "SIH_RD_a", signature, "f1") and not lake.is_current("SIH", "SIH_RD_a", signature, "f2")


def test_a_partition_is_replaced_and_others_stay(spark, lake):
    lake.write(spark.createDataFrame([(9, "1", "SP", 2010)], "i int, SEX string, uf string, year int"), "SIH", "SIH_RD_a")
    assert sorted(r.i for r in lake.family("SIH", "SIH_RD_a").collect()) == [2, 9]
    assert lake.clear("SIH", "SIH_RD_a", lake.partitions("SIH", "SIH_RD_a")[0]["signature"], "SP", 2010)
    assert lake.count("SIH", "SIH_RD_a") == 1


def test_generations_views_and_labels(spark, lake):
    with pytest.raises(errors.MissingColumn):
        api.scan(lake, "SIH", "RD", columns=["N"])
    assert api.scan(lake, "SIH", "RD", columns=["i", "N"], on_missing_column="null_fill").count() == 3
    assert "SIH" in lake.open()
    assert lake.sql("SELECT count(*) AS n FROM SIH WHERE year >= ?", 2011).first().n == 2
    ref = spark.createDataFrame([("sex", "*", "1", "old", 200001, 201112), ("sex", "*", "1", "new", 201201, None), ("sex", "*", "2", "two", 200001, 201112)], "codelist string, system string, code string, label string, valid_from int, valid_to int")
    df, _ = api.load(lake, "SIH", "RD", reference=ref, docs=[render.FieldDoc("SEX", codelist="sex")])
    assert {int(r.i): r.SEX for r in df.collect()} == {1: "old", 2: "two", 3: "new"}


def test_reference_and_bundle(spark, tmp_path):
    ref = spark.createDataFrame([("sex", "*", "1", "old", 200001, 201112), ("sex", "*", "1", "new", 201201, None)], "codelist string, system string, code string, label string, valid_from int, valid_to int")
    root = f"file://{tmp_path}/r"
    lakes.write_reference(spark, ref, root)
    assert api.load_reference(spark, root, "sex", year=2005).first().label == "old"
    assert api.load_reference(spark, root, "sex").first().label == "new"
    api.pack(spark, {"ref": ref}, f"file://{tmp_path}/b")
    assert api.unpack(spark, f"file://{tmp_path}/b")["ref"].count() == 2
    with pytest.raises(errors.BundleInvalid):
        api.read_manifest(spark, f"file://{tmp_path}/none")


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "i int, l array<string>")
    path = api.export(df, f"{tmp_path}/x.csv")
    assert spark.read.csv(path, header=True).first().l == "a | b"
    assert spark.read.csv(api.export(df.limit(0), f"{tmp_path}/e.csv"), header=True).columns == ["i", "l"]
    assert spark.read.parquet(api.export(df, f"{tmp_path}/x.parquet")).count() == 1


def test_fetch_refuses_a_partial_answer(spark, tmp_path):
    (tmp_path / "RDSP2301.csv").write_text("SEX\n1\n")
    (tmp_path / "RDAL2301.parquet").write_text("not parquet")
    files = api.inventory.facts(spark.createDataFrame([(f"{tmp_path}/RDSP2301.csv",), (f"{tmp_path}/RDAL2301.parquet",)], "path string")).withColumn("size", F.lit(1).cast("long"))
    plan = normalize.Plan((normalize.FieldPlan("SEX", labels={"1": "M"}),))
    with pytest.raises(errors.PartialFetch):
        api.fetch(spark, files, plan=plan)
    df, _ = api.fetch(spark, files, plan=plan, allow_partial=True)
    assert df.first().SEX_label == "M"


def test_translate(spark):
    ref = spark.createDataFrame([("sex", "*", "1", "Male", None, None)], "codelist string, system string, code string, label string, valid_from int, valid_to int")
    import pandas as pd

    df, _ = api.translate(spark, pd.DataFrame({"S": ["1"]}), reference=ref, docs=[render.FieldDoc("S", codelist="sex")])
    assert df.first().S == "Male"


def test_streamed_ingest_equals_the_batch(spark, tmp_path):
    src = spark.createDataFrame([("20150101", "1"), ("bad", "2")], "D string, S string")
    src.write.parquet(f"{tmp_path}/in")
    plan = normalize.Plan((normalize.FieldPlan("D", "D"),))
    s = ingest.file_stream(spark, f"{tmp_path}/in", src.schema)
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(s, plan, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, got.collect())) == sorted(map(str, normalize.normalise(src, plan).collect()))


def test_windows_and_sessions(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert ingest.windowed(e, time="ts", keys=["event_type"], value="value").agg(F.sum("n")).first()[0] == e.count()
    assert ingest.sessions(e, time="ts", key="user_id").agg(F.sum("n")).first()[0] == e.count()
