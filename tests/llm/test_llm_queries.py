"""Queries of the operators against their SQL, and the pipeline against its stages."""

import math

import duckdb
import pytest

import corpus_pipeline
from tilth.llm import catalog
from tilth.session import staged


def shown(value):
    return repr(round(value, 6)) if isinstance(value, float) and not math.isnan(value) else repr(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    relation = con.sql(catalog.ORACLES[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(shown(r[i]) for i in order) for r in relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - {"op12_chat_windows"}))
def test_query_has_a_row_for_each_input_row(spark, sf_dir, name):
    source = "pages" if name.startswith("op4") else "documents"
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.count() == spark.read.parquet(f"{sf_dir}/{source}.parquet").count()


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = staged(stage(spark, docs, sf_dir), name)
        sizes.append(docs.count())
        if name != "encode":
            assert docs.columns == columns and {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
        if name == "judge":
            kept = {r.doc_id for r in docs.collect()}
            every = {r.doc_id for r in before.collect()}
            assert sum((i in kept) == (q == 1) for i, q in labels.items() if i in every) >= 0.97 * len(labels)
        if name == "one_of_each":
            texts = [r.text for r in docs.collect() if r.text and r.text.strip()]
            assert len(texts) == len(set(texts))
        if name == "encode":
            assert all(r.exact and r.n_pieces == len(r.ids) for r in docs.collect())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] and sizes[4] == sizes[5] > 0
    assert corpus_pipeline.run(spark, sf_dir).count() == sizes[-1]
