"""The stages on the small tables: order, columns, what goes and what stays."""

import pytest

import corpus_pipeline
from gridproof.llm import decontaminate, ngram_join, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_duplicates", "near_duplicates", "decontamination", "source_mix"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "source_mix":
            assert docs.columns == columns
            assert 0 < docs.count() <= before
            before = docs.count()
        if name == "near_duplicates":
            assert ngram_join.jaccard_components(docs).where("doc_id <> component_id").count() == 0
        if name == "decontamination":
            assert decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert {"copy", "shard", "position"} <= set(docs.columns)


def test_run_equals_its_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_odd_rows_and_empty_tables(spark, documents, odd, tmp_path):
    """Null, empty, very long and repeated rows go through all stages, without labels and test items too; so does an empty table."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "sf" / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "sf" / "benchmark.parquet"))
    rows = [*odd, *[(k, " ".join(f"word{k}x{j}" for j in range(40)), "other") for k in (30, 31)]]
    for n, some in enumerate((rows, [])):
        docs = documents(some)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path / "sf")).write.parquet(str(tmp_path / f"{n}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}-{k}"))
        assert {30, 31} <= {r.doc_id for r in docs.select("doc_id").collect()} if some else docs.count() == 0


def test_queries(spark):
    # op9 has a second query, with long lines
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14)) and len(queries.QUERIES) == 14
    for name in ("op2_decontamination", "op3_token_counts", "op4_mixing", "op5_importance", "op10_pii"):
        assert queries.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    answer = con.execute(queries.ORACLE_SQL[name])
    columns = [x[0] for x in answer.description]
    assert sorted(tuple(r) for r in queries.QUERIES[name](spark, SF).select(*columns).collect()) == sorted(answer.fetchall())
