"""The registered queries over the smallest tables, against SQL where there is some."""

import os

import duckdb
import pytest

import corpus_pipeline
from lineweave.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    assert rows and name.startswith("op")
    if name in queries.ORACLES:
        con = duckdb.connect()
        for file in os.listdir(DATA):
            con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
        found = con.execute(queries.ORACLES[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        order = [names.index(c) for c in df.columns]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == docs.columns and after.schema["text"].dataType == docs.schema["text"].dataType, name
        docs = after
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[1] > 0.95 * counts[0] and counts[3] == counts[2]
    assert not docs.where(r"text rlike '[a-z0-9]@mail[0-9]'").count()
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() == counts[-1] and {"doc_id", "ids", "n_tokens"} <= set(out.columns)
    nothing = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, DATA).count() == 0
