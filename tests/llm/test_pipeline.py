"""Registered queries against SQL, and the pipeline stage by stage against brute force."""

import duckdb
import pytest

pytest.importorskip("public_tokenizers")
queries = pytest.importorskip("gridloom.llm.queries")
pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import brute_components, brute_groups, check_pieces  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    a, b = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.ORACLES[name]).df()
    cols = sorted(a.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True).astype(str) for x in (a, b))
    assert a.equals(b)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs.toPandas()]
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing to target weights", "packing"]
    for _, stage in pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, DATA).toPandas())
        seen.append(docs.toPandas())
    first, good, exact, near, mixed, pieces = seen
    assert all(list(x.columns) == list(first.columns) for x in seen[1:5])
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    clean = set(labels[labels.quality == 1].doc_id)
    assert len(clean - set(good.doc_id)) <= 0.03 * len(clean) and not set(labels[labels.quality == 0].doc_id) <= set(good.doc_id)
    groups = brute_groups(list(zip(good.doc_id, good.text)))
    assert sorted(exact.doc_id) == sorted({k for k, _ in groups.values()})
    assert sorted(near.doc_id) == sorted({c for _, _, c in brute_components(list(zip(exact.doc_id, exact.text)), 5, 80)})
    assert set(mixed.doc_id) <= set(near.doc_id)
    check_pieces(pieces.to_dict("records"), list(zip(mixed.doc_id, mixed.text)))


def test_run(spark):
    out = pipeline.run(spark, DATA)
    assert out.count() > 0 and "sequence_id" in out.columns and pipeline.ORACLE_SQL is None
