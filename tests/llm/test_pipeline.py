import corpus_pipeline as pipeline
from quillspark.llm import decontaminate, language_id, line_dedup, ngram_join, queries


def test_stages_keep_the_columns_and_decide_as_their_operators_do(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "packing"]
    read = {r.doc_id: r.text for r in docs.collect()}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "packing":
            assert out.columns == docs.columns
        rows = out.collect()
        if name == "language_id":
            assert len(rows) >= 0.97 * len(read) and all(language_id.has_letter(r.text) for r in rows)
        elif name == "line_dedup":
            want = line_dedup.reference(list(read.items()))
            assert {r.doc_id: r.text for r in rows} == {d: t for d, t in want.items() if t.strip() or t == read[d]}
        elif name == "ngram_join":
            want = ngram_join.reference(list(read.items()), 5, 80)
            assert {r.doc_id for r in rows} == {d for d, (_, c) in want.items() if c == d}
        elif name == "decontamination":
            want = decontaminate.reference(list(read.items()), [(r.item_id, r.text) for r in bench.collect()])
            assert {r.doc_id for r in rows} == {d for d, x in want.items() if not x[4]}
        else:
            assert {r.doc_id for r in rows} == set(read)
        docs = out
        if name != "packing":
            read = {r.doc_id: r.text for r in rows}


def test_run_gives_pieces_of_every_document_that_stays(spark, sf):
    out = pipeline.run(spark, sf)
    assert set(out.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert out.count() > 50


def test_every_operator_is_registered():
    import __spark_entry__ as e

    assert {int(n[2:].split("_")[0]) for n in e.queries() if n.startswith("op") and n[2].isdigit()} == set(range(1, 11)) and "pipeline" in e.queries()
    assert set(queries.ORACLES) <= set(queries.QUERIES)
