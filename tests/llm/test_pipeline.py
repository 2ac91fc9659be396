"""The pipeline against brute force, stage by stage, and the registered queries against SQL."""

import os

import duckdb
import pytest
from brute import brute, normal

import __spark_entry__ as entry
import corpus_pipeline
from kickframe.session import stage

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(k for k in entry.oracle_sql() if k.startswith("op")))
def test_query_agrees_with_its_oracle(spark, key):
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{SMALL}/{name}')")
    df = entry.queries()[key](spark, SMALL)
    cols = sorted(df.columns)
    result = con.execute(entry.oracle_sql()[key])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(
        repr(tuple(r[names.index(c)] for c in cols)) for r in result.fetchall())


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 1").collect()}
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, SMALL), name)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and docs.count() == len(after)
        gone = set(before) - set(after)
        if name == "toxicity":
            assert len(gone - toxic) <= len(before) * 0.05
        if name == "exact_dedup":
            first = {}
            for d in sorted(before):
                first.setdefault(normal(before[d]), d)
            assert set(after) == set(first.values())
        if name == "minhash_near_dedup":
            assert set(after) == {d for d, c in brute(list(before.items()), 5).items() if d == c}
        if name == "mixing":
            words = {d: len(normal(t).split(" ")) for d, t in before.items()}
            assert 0.8 <= sum(words[d] for d in after) / sum(words.values()) <= 0.91
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == set(before)


def test_run_is_registered(spark):
    assert corpus_pipeline.run(spark, SMALL).count() == entry.queries()["pipeline"](spark, SMALL).count() > 0
