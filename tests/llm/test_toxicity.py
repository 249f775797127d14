"""Toxicity on held-out rows, and what the score may not see."""

import zlib

from pyspark.sql import functions as F

from centwise.llm.toxicity import Measure, FEATURES, reject_toxic, toxicity

DATA = "/root/testdata/sf0.01"


def test_held_out_rows_are_found(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    rest = [(got[r.doc_id].score, got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    toxic, clean = [s for s, _, t in rest if t], [s for s, _, t in rest if not t]
    assert sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / len(toxic) / len(clean) > 0.75
    assert sum(p for _, p, t in rest if not t) <= 0.03 * len(clean)
    # labels of held-out rows, language, source and order of rows change nothing
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity(docs.withColumn("lang", F.lit("xx")).orderBy(F.desc("doc_id")), other).collect()}
    assert max(abs(again[i] - r.score) for i, r in got.items()) < 1e-9


def test_features():
    measure = Measure({"loser": 3.0, "lowe-": 2.0})
    names = dict(zip(FEATURES, measure("YOU are a loser! l0ser idiot loweix far from it"), strict=True))
    assert names["hits"] == 2 and names["best_weight"] == 3.0 and names["kinds"] == 2
    assert names["near_second_density"] == 0.1 and names["shouted_rate"] == 0.1 and names["exclamation_rate"] == 0.1
    assert names["obfuscated_rate"] == 0.1 and names["unmasked_density"] == 0.1 and names["insult_density"] == 0.2
    assert measure(None) == measure("") == measure(" \n") == [0.0] * len(FEATURES)


def test_few_labels_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(1, "you idiot", 1), (1, "you idiot", 1), (2, None, 0), (3, "", 0), (None, "nice words here", 0), (4, "nice words " * 20_000, 0)], "doc_id bigint, text string, score int")
    none = spark.createDataFrame([(None, 1), (1, None), (99, 1)], "doc_id bigint, toxic int")
    got = toxicity(docs, none)
    assert sorted(((r.doc_id, r.predicted) for r in got.collect()), key=str) == sorted([(1, 1), (1, 1), (2, 0), (3, 0), (None, 0), (4, 0)], key=str)
    assert toxicity(docs.limit(0), none.limit(0)).collect() == []
    kept = reject_toxic(docs, none)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [2, 3, 4, None]
