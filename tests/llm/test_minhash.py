"""Near-duplicate documents against sets compared one by one."""

import random
import re
from itertools import combinations

import pytest

from centwise.llm.components import connected_components
from centwise.llm.minhash import keep_one, near_duplicates

SCHEMA = "doc_id bigint, text string"


def plain(docs):
    sets = []
    for _, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    part = {i: i for i, _ in docs if i is not None}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for (a, s), (b, t) in combinations(zip([i for i, _ in docs], sets, strict=True), 2):
        if a is not None and b is not None and s and t and 100 * len(s & t) >= 85 * len(s | t):
            low, high = sorted((root(a), root(b)))
            part[high] = low
    return sorted((i, len(s), None if i is None else root(i), i is None or root(i) == i) for (i, _), s in zip(docs, sets, strict=True)) if all(i is not None for i, _ in docs) else [(i, len(s), None if i is None else root(i), i is None or root(i) == i) for (i, _), s in zip(docs, sets, strict=True)]


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for g in range(12):
        base = r.choices(words, k=r.choice([3, 5, 40, 120]))
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(words)
            docs.append((r.randrange(10_000), r.choice([" ", "\n", "\t"]).join(copy).upper() if r.random() < 0.2 else " ".join(copy)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain(spark, seed):
    docs = corpus(seed)
    got = near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == plain(docs)


def test_a_chain_of_copies_is_one_component(spark):
    words = [f"x{i}" for i in range(200)]
    docs = []
    for i in range(30):  # each differs a little from the one before, the ends not at all alike
        docs.append((i, " ".join(words)))
        words[i * 6] = f"new{i}"
    got = near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == plain(docs) and {r.component_id for r in got} == {0}


def test_nulls_ties_repeats_and_other_columns(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    docs = [(5, "a b c d e f", 1), (3, "A b\tc d e f", 2), (3, "A b\tc d e f", 3), (None, "a b c d e f", 4), (7, None, 5), (8, "", 6), (9, " \n", 7), (11, long, 8), (10, long, 9), (12, "a", 10), (13, "A", 11), (20, "one two three four five six", 1), (20, "p q r s t u v", 1), (25, "p q r s t u v", 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, component_id int")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == {(5, 2): (3, False), (3, 2): (3, True), (None, 2): (None, True), (7, 0): (7, True), (8, 0): (8, True), (9, 0): (9, True), (11, 29996): (10, False), (10, 29996): (10, True), (12, 1): (12, True), (13, 1): (12, False), (20, 2): (20, True), (20, 3): (20, True), (25, 3): (20, False)}
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [3, 3, 7, 8, 9, 10, 12, 20, 20]
    assert near_duplicates(df.limit(0)).collect() == []


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1060)] + [(7000, 7000), (5, 39), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 1000 for i in range(1000, 1060)} | {7000: 7000}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
