"""Benchmark passages: copies and edited copies found, clean texts left, alignment against a plain table."""

import random

import numpy as np

from centwise.llm.decontaminate import GAP, MATCH, MISMATCH, align, contaminated, decontaminate


def plain_score(a, b):
    table, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (MATCH if x == y else MISMATCH), table[i - 1][j] + GAP, table[i][j - 1] + GAP)
            best = max(best, table[i][j])
    return best


def test_alignment_equals_plain():
    r = random.Random(2)
    for _ in range(60):
        item = [r.randint(1, 6) for _ in range(r.randint(1, 12))]
        windows = [[r.randint(1, 6) for _ in range(r.randint(0, 20))] for _ in range(5)]
        sizes = np.array([len(w) for w in windows])
        block = np.zeros((5, max(1, sizes.max())), np.uint64)
        for i, w in enumerate(windows):
            block[i, : len(w)] = w
        score, _ = align(np.array(item, np.uint64), block, sizes)
        assert score.tolist() == [plain_score(item, w) for w in windows]


def corpus():
    r = random.Random(3)
    words = ["the", "of", "and"] * 60 + [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choices(words, k=r.randint(12, 50)))) for i in range(20)]
    docs, want = [], set()
    for doc_id in range(300):
        text = r.choices(words, k=r.randint(0, 300))
        if r.random() < 0.4:
            item_id, passage = r.choice(items)
            copy = passage.split()
            for _ in range(len(copy) // 8 if r.random() < 0.5 else 0):  # words exchanged, dropped and put in
                at = r.randrange(len(copy))
                copy[at : at + 1] = r.choice([[], [r.choice(words)], [copy[at], r.choice(words)]])
            at = r.randint(0, len(text))
            text[at:at] = [(c.upper() if r.random() < 0.1 else c) + r.choice(["", "", ",", "."]) for c in copy]
            want.add((doc_id, item_id))
        docs.append((doc_id, " ".join(text)))
    return docs, items, want


def test_passages_are_found_and_clean_texts_left(spark):
    docs, items, want = corpus()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in contaminated(d, b).collect()}
    assert found == want
    assert {r.doc_id for r in decontaminate(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_a_passage_in_a_third_of_all_documents_is_still_found(spark):
    docs, items, _ = corpus()
    docs = [(i, text + " " + items[0][1] if i % 3 == 0 else text) for i, text in docs]
    found = contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).where("item_id = 0").collect()
    assert {r.doc_id for r in found} >= set(range(0, 300, 3))


def test_exact_and_edited_copies_of_one_item_together(spark):
    r, docs, want = random.Random(8), [], set()
    items = [(i, [f"i{i}w{k}" for k in range(38)]) for i in range(30)]
    for i, words in items:
        copies = [words, words, [f"n{r.random()}" if k % 4 == i % 4 else w for k, w in enumerate(words)], [f"n{r.random()}" for _ in range(18)] + words[18:]]
        for copy in copies:
            want.add((len(docs), i))
            docs.append((len(docs), " ".join([f"a{r.random()}" for _ in range(50)] + copy + [f"b{r.random()}" for _ in range(50)])))
    found = contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_short_items(spark):
    docs = [(i, " ".join([f"f{k}" for k in range(i)] + ["uno", "due", "tre"] + [f"g{k}" for k in range(20)])) for i in range(20)]
    found = contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, "uno due tre")], "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.score, r.last_word) for r in found) == [(i, 1.0, i + 2) for i in range(20)]


def test_nulls_repeats_and_other_columns(spark):
    item = "alpha beta gamma delta epsilon zeta"
    b = spark.createDataFrame([(1, item, 0), (1, item, 0), (2, "x y", 0), (3, None, 0), (None, item, 0), (4, "", 0), (5, item, 0)], "item_id bigint, text string, score int")
    docs = spark.createDataFrame([(1, f"say {item} now", 0), (1, f"say {item} now", 0), (None, item, 0), (2, None, 0), (3, "", 0), (4, "x y", 0), (5, "other " * 60_000 + item, 0)], "doc_id bigint, text string, item_id int")
    assert sorted(map(tuple, contaminated(docs, b).collect())) == [(1, 1, 1.0, 6), (1, 5, 1.0, 6), (5, 1, 1.0, 60_005), (5, 5, 1.0, 60_005)]
    kept = decontaminate(docs, b)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [2, 3, 4, None]
    assert contaminated(docs.limit(0), b).collect() == [] and contaminated(docs, b.limit(0)).collect() == []
