"""The pipeline stage by stage on the smallest tables, and queries against their SQL."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from tallywright.llm import quality_rules, toxicity
from tallywright.llm.queries import ORACLES, QUERIES
from tallywright.session import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after.items()) <= set(before.items())
        kept[name], docs = set(after), out
    assert kept["toxicity"] >= kept["quality_rules"] >= kept["minhash"] >= kept["mixing"]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == kept["mixing"]


def test_verdicts_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    models = toxicity.train(docs, labels)
    clean = {r.doc_id for r in toxicity.toxicity(docs, models).where("predicted = 0").collect()}
    assert {r.doc_id for r in toxicity.without_toxic(docs, models).collect()} == clean
    rules = quality_rules.train(docs, labels)
    good = {r.doc_id for r in quality_rules.quality_rules(docs, rules).where("kept").collect()}
    assert {r.doc_id for r in quality_rules.without_failed(docs, rules).collect()} == good


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(r[c] for c in columns) for r in df.collect())
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in columns]
    assert rows == sorted(tuple(r[i] for i in order) for r in result.fetchall())
