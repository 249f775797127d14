"""Each stage on its own input, the registered queries and their check SQL."""

from itertools import combinations

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from centwise.llm import queries
from centwise.llm.toxicity import toxicity

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    rejected = {r.doc_id for r in toxicity(docs, spark.read.parquet(f"{DATA}/labels.parquet")).where("predicted = 1").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r.doc_id for r in docs.collect()}
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id for r in docs.collect()}
        assert docs.columns == names and after <= before and len(after) > 0.6 * len(before)
        if name == "toxicity":
            assert after == before - rejected
        if name == "line_dedup":
            assert after == before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.collect()} == after
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect()), key=str) == sorted(map(tuple, packed.collect()), key=str)


def test_near_dedup_stage_equals_every_pair(spark):
    docs, sets = [], {}
    for g in range(40):
        base = [f"g{g}w{k}" for k in range(120)]
        for changed in (0, 8 + g % 8):  # 116 shingles, Jaccard 0.87 to 0.77
            words = base[: 120 - changed] + [f"d{len(docs)}n{k}" for k in range(changed)]
            sets[len(docs)] = {tuple(words[k : k + 5]) for k in range(116)}
            docs.append((len(docs), " ".join(words)))
    again = {b for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    between = {b for b in again if 100 * len(sets[b - 1] & sets[b]) < 85 * len(sets[b - 1] | sets[b])}
    assert len(between) >= 10 and len(again) < 40
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), DATA)
    assert {r.doc_id for r in kept.collect()} == set(sets) - again


def test_ten_operators_are_registered():
    names = set(entry.queries())
    assert set(queries.QUERIES) < names and {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in queries.QUERIES} and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.CHECK_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    cur = con.execute(queries.CHECK_SQL[name])
    names = [c[0] for c in cur.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, cur.fetchall()))
