import pytest


def test_pipeline(spark, data):
    cp = pytest.importorskip("corpus_pipeline")
    from tidegate.llm import common

    docs = common.table(spark, data, "documents")
    seen = [docs]
    for _, stage in cp.STAGES:
        seen.append(common.written(stage(spark, seen[-1], data), "stage"))
    for before, after in zip(seen[:-2], seen[1:-1], strict=True):
        assert after.columns == docs.columns
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    assert seen[-1].count() == seen[-2].count() == seen[-3].count() > 0.5 * docs.count()
    assert cp.run(spark, data).count() == seen[-1].count()
    assert cp.ORACLE_SQL is None and [n for n, _ in cp.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "pii", "bpe"]


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


def test_sql_of_queries(spark, data):
    """Queries with SQL give the rows that DuckDB gives."""
    import duckdb

    from tidegate.llm import queries

    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, data)
        want = con.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        plain = lambda rows: sorted(rows, key=str)
        assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want.select(*columns).fetchall()), name


def test_every_stage_on_odd_and_empty_tables(spark, odd, nothing, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")

    spark.createDataFrame([(1, 0), (5, 1), (8, None), (9, 3)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "what is one. two"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in cp.STAGES:
        for docs in (odd, nothing):
            got = stage(spark, docs, str(tmp_path))
            rows = got.collect()
            assert name == "bpe" or got.columns == docs.columns
            if docs is nothing:
                assert rows == []
            elif name in ("pii", "bpe"):
                assert len(rows) == odd.count()
            elif name == "ngram_jaccard":
                assert sorted(str(r.doc_id) for r in rows) == sorted([*"123456789", "None"])
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert 0 < cp.run(spark, str(tmp_path)).count() <= odd.count() - 1
