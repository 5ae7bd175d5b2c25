import pytest
from pyspark.sql import functions as F

from quillspark import errors
from quillspark.operators import codelists, dictionary, generations, inventory, normalize, profile, render
from quillspark.plans import meaning

REF = "codelist string, system string, code string, label string, valid_from int, valid_to int"


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame(
        [("sex", "*", "1", "Male", 199001, 199912), ("sex", "*", "2", "Female", 199001, 199912), ("sex", "*", "1", "Man", 200001, None), ("sex", "A", "1", "Own", 200001, None), ("odd", "*", "1", "x", None, None), ("odd", "*", "1", "y", None, None)], REF
    )


def test_a_code_missing_from_the_window_stays_unlabelled(spark, reference):
    df = spark.createDataFrame([(1, "1", 199500), (2, "2", 199500), (3, "2", 200500), (4, " 1 ", 200500), (5, None, 200500), (6, "1", None)], "i int, c string, m int")
    ref = codelists.scoped(reference.where("codelist = 'sex'"), "Z")
    got = {r.i: r.label for r in codelists.with_vintage_label(df, "c", ref, F.col("m")).collect()}
    assert got == {1: "Male", 2: "Female", 3: None, 4: "Man", 5: None, 6: "Man"}


def test_own_copy_beats_the_shared_one(reference):
    rows = codelists.scoped(reference.where("codelist = 'sex'"), "A").collect()
    assert {r.label for r in rows} == {"Own"} and not rows[0].borrowed


def test_rendering_profiles(spark, reference):
    df = spark.createDataFrame([(1, "1"), (2, "2"), (3, "9")], "i int, SEX string")
    docs = [render.FieldDoc("SEX", codelist="sex", title="sex at birth")]
    early = F.lit(199500)
    out, report = render.render(df, docs, reference, moment=early)
    assert [r.SEX for r in out.orderBy("i").collect()] == ["Male", "Female", "9"]
    assert report.decisions[0]["codelist"] == "sex"
    out, _ = render.render(df, docs, reference, profile="audit", moment=early)
    assert out.columns == ["i", "SEX", "SEX_label"]
    out, _ = render.render(df, docs, reference, profile="report", moment=early)
    assert out.columns == ["i", "sex at birth"] and out.orderBy("i").first()[1] == "1 – Male"
    out, _ = render.render(df, docs, reference, profile="codes")
    assert out.columns == ["i", "SEX"]


def test_contradictory_codes_stay_codes_or_refuse(spark, reference):
    df = spark.createDataFrame([("1",)], "X string")
    docs = [render.FieldDoc("X", codelist="odd")]
    out, report = render.render(df, docs, reference)
    assert out.first()[0] == "1" and report.decisions[0]["reason"] == "contradictory labels"
    with pytest.raises(errors.LabelUnavailable):
        render.render(df, docs, reference, profile=render.profile_of("analysis", strict=True))


def test_choice_of_codelists(spark):
    codes = spark.createDataFrame([("a", "1", "x"), ("a", "2", "x"), ("b", "1", "p"), ("b", "2", "q")], "codelist string, code string, label string")
    seen = spark.createDataFrame([("1", 5), ("2", 5)], "value string, n long")
    assert codelists.choose(seen, codes, ["a", "b"])["codelist"] == "b"
    assert codelists.choose(seen.limit(0), codes, ["a", "b"])["reason"] == "nothing observed"
    assert codelists.choose(seen, codes, ["z"])["codelist"] == "z"
    assert codelists.choose(spark.createDataFrame([("7", 1)], "value string, n long"), codes, ["a"])["reason"] == "constant"


def test_dictionary(spark):
    kind = "system string, codelist string, code string, label string, valid_from int, source string, seq int"
    claims = spark.createDataFrame([("s", "c", "1", "old", None, "pdf", 1), ("s", "c", "1", "new", None, "manual", 2), ("s", "c", "1", "dated", 200001, "pdf", 3)], kind)
    assert {r.label for r in dictionary.merge(claims).collect()} == {"new", "dated"}
    more = spark.createDataFrame([("s", "c", "1", "again", None, "cnv", 4), ("s", "c", "2", "two", None, "cnv", 5)], kind)
    assert dictionary.insert_new(claims, more).count() == 4


def test_generations_refuse_or_fill(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(1.5, "t")], "x double, z string")
    with pytest.raises(errors.MissingColumn, match="carried by"):
        generations.with_columns_or_refusal({"a": a, "b": b}, ["y"])
    got = generations.with_columns_or_refusal({"a": a, "b": b}, ["x", "y"], "null_fill")
    assert got.schema.simpleString() == "struct<x:double,y:int>" and got.count() == 2
    with pytest.raises(errors.SchemaConflict):
        generations.union([a, spark.createDataFrame([("q",)], "x string")])


def test_normalise_keeps_raw_and_orders_columns(spark):
    df = spark.createDataFrame([("20150101", "1", "355030", "z")], "D string, S string, M string, O string")
    plan = normalize.Plan((normalize.FieldPlan("D", "D", weeks=True), normalize.FieldPlan("S", labels={"1": "a"}), normalize.FieldPlan("M", place=True)))
    out = normalize.normalise(df, plan)
    assert out.columns == ["D", "D_raw", "D_epi_year", "D_epi_week", "S", "S_label", "M", "M_ibge7", "M_uf", "O"]
    assert [normalize.kind_of(c, df.columns) for c in ("D_raw", "S_label", "M_uf", "O", "_x")] == ["raw", "label", "companion", "value", "provenance"]
    with pytest.raises(errors.MissingColumn):
        normalize.normalise(df.drop("M"), plan)
    assert normalize.fingerprint(plan, [("b", "2", ""), ("a", "1", "")]) == normalize.fingerprint(plan, [("a", "1", ""), ("b", "2", "")])


def test_profile_of_blanks_and_nulls(spark):
    df = spark.createDataFrame([("a", None), (" ", None), ("NA", None), (None, None), ("a", None)], "x string, y int")
    got = {r.field: r for r in profile.statistics(profile.frequencies(df)).collect()}
    assert (got["x"].non_null, got["x"].nulls, got["x"].distinct_count) == (2, 3, 1)
    assert (got["y"].non_null, got["y"].nulls) == (0, 5)
    assert profile.statistics(profile.frequencies(df.limit(0))).count() == 0


def test_guards(spark):
    files = spark.createDataFrame([("/S/RDSP2301.dbc", 10), ("/S/RDAL2301.dbc", 20)], "path string, size long")
    f = inventory.facts(files).withColumn("series", F.col("prefix"))
    assert inventory.select_files(f, ufs=["sp"]).count() == 1
    with pytest.raises(errors.NothingPublished):
        inventory.select_files(f, years=[1999])
    with pytest.raises(errors.RequestTooLarge):
        inventory.select_files(f, max_bytes=5)
    with pytest.raises(ValueError):
        inventory.clean_states(["XX"])
    with pytest.raises(errors.FilterHasNoAxis):
        inventory.refuse_missing_axes(inventory.axis_shares(f.withColumn("geo", F.lit(None).cast("string"))), "S", "RD", uf=["SP"])
    declared = spark.createDataFrame([("SIH", "RD", "x")], "system string, series string, dataset string")
    assert inventory.resolve_dataset("sih-rd", declared) == ("SIH", "RD")
    with pytest.raises(errors.DatasetUnknown):
        inventory.resolve_dataset("sih-xx", declared)


def test_mass_disappearance(spark):
    gone = spark.range(600).select(F.col("id").cast("string").alias("path"), F.when(F.col("id") < 200, "gone").otherwise("unchanged").alias("state"))
    with pytest.raises(errors.MassDisappearance):
        inventory.refuse_mass_disappearance(gone)


def test_search_and_checks(spark, reference):
    docs = spark.createDataFrame([("field", "SEXO", "Sexo do paciente"), ("field", "IDADE", "Idade em anos"), ("list", "SEX", "sexual")], "kind string, name string, text string")
    assert [r.name for r in meaning.search(docs, "séxo").collect()] == ["SEXO"]
    assert meaning.search(docs, "sex", kind="list").count() == 1
    assert {r.check for r in meaning.checks(reference).collect()} == {"contradictory"}
    with pytest.raises(errors.CurationInvalid):
        meaning.parse_curation({"S": {"F": {"codelist": "x"}}})
    assert meaning.parse_curation({"s": {"f": {"codelist": "x", "evidence": "doc"}}})[0]["field"] == "F"
