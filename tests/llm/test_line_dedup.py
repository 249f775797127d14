"""Line dedup against all pairs of lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from centwise.llm.line_dedup import _entries, _row, dedup_lines, line_classes, line_report

SCHEMA = "doc_id bigint, text string"


def plain(docs):
    lines = []
    for doc_id, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            tokens = frozenset(t for t in re.split(r"[\x09-\x0D\x20]+", line.lower()) if t)
            if tokens:
                lines.append((doc_id, i, tokens))
    lines.sort(key=lambda x: x[:2])
    gone = {(d, i) for k, (d, i, s) in enumerate(lines) if any(100 * len(s & t) >= 80 * len(s | t) for e, j, t in lines[:k] if (e, j) < (d, i))}
    return {d: [i for i, line in enumerate((text or "").split("\n")) if (d, i) not in gone and line.strip()] for d, text in docs}


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{int(abs(r.gauss(0, 80)))}" for _ in range(2000)]
    bases = [r.choices(words, k=r.choice([1, 2, 4, 5, 6, 10, 30])) for _ in range(40)]
    docs = []
    for doc_id in r.sample(range(-50, 500), 60):
        out = []
        for _ in range(r.randint(0, 8)):
            line = list(r.choice(bases))
            if r.random() < 0.5:
                line[r.randrange(len(line))] = r.choice(words)
            if r.random() < 0.3:
                line.insert(r.randrange(len(line) + 1), r.choice(words))
            out.append(r.choice([" ", "\t", "  "]).join(line))
        docs.append((doc_id, "\n".join(out)))
    return docs


@pytest.mark.parametrize("seed", [3, 4])
def test_equals_plain(spark, seed):
    docs = corpus(seed)
    got = {r.doc_id: list(r.kept) for r in line_report(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == plain(docs)


def test_many_variants_of_a_line_leave_the_first(spark):
    base = [f"b{i}" for i in range(60)]
    docs = [(i, " ".join(base[: i % 50] + [f"edit{i}"] + base[i % 50 + 1 :])) for i in range(1, 300)] + [(0, " ".join(base))]
    got = {r.doc_id: list(r.kept) for r in line_report(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == plain(docs) and sum(map(len, got.values())) == 1


def test_text_nulls_blanks_repeats_and_other_columns(spark):
    long = " ".join(f"z{i}" for i in range(20_000))
    docs = [(2, "b a\n\nkeep me", 9, 1), (1, "A  b\n \nlast line", 9, 1), (None, "last LINE", 9, 2), (3, None, None, 3), (4, "", 0, 4), (6, long, 5, 5), (5, long + " more", 5, 6), (7, "same", 4, 1), (7, "same", 4, 2)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, n_chars bigint, kept int")
    got = [(r.doc_id, r.text if r.doc_id not in (5, 6) else len(r.text), r.n_chars, r.kept) for r in dedup_lines(df).collect()]
    want = [(1, "A  b\n ", 6, 1), (2, "\nkeep me", 8, 1), (None, "last LINE", 9, 2), (3, None, None, 3), (4, "", 0, 4), (6, 0, 0, 5), (5, len(long) + 5, len(long) + 5, 6), (7, "same", 4, 1), (7, "same", 4, 2)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert dedup_lines(df.limit(0)).collect() == [] and dedup_lines(df).schema == df.schema
    plan = dedup_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_texts_under_one_id_or_none_are_documents_of_their_own(spark):
    first, more, other = "a b c d e f g h i j", "a b c d e f g h i j k", "totally different unique words here"
    docs = [(1, first), (5, more), (5, other), (5, other), (None, "q r s t u"), (None, "v w x y z"), (None, "v w x y z\nnew line of this one"), (7, "v w x y z\nkept")]
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in dedup_lines(df).collect())
    null_ids = [t for known, _, t in got if not known]
    # of the two null-id texts that share a line, the one with the lower hash keeps it
    assert sorted(null_ids) in (sorted(["q r s t u", "v w x y z", "new line of this one"]), sorted(["q r s t u", "", "v w x y z\nnew line of this one"]))
    assert [x[1:] for x in got if x[0]] == [(1, first), (5, ""), (5, other), (5, other), (7, "kept")]
    kept = sorted((str(r.doc_id), list(r.kept)) for r in line_report(df).collect())
    assert sum(len(k) for _, k in kept) == 7 and len(kept) == len(docs)


@pytest.mark.parametrize("seed", [5])
def test_equals_plain_with_shared_ids(spark, seed):
    """Many texts under few ids and none: as if each were a document, ordered by id, line and the text's hash."""
    docs = [(None if i % 5 == 0 else i % 7, text) for i, text in corpus(seed)]
    df = spark.createDataFrame(docs, SCHEMA)
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    lines = []
    for doc_id, text in set(docs):
        for i, line in enumerate(text.split("\n")):
            tokens = frozenset(t for t in re.split(r"[\x09-\x0D\x20]+", line.lower()) if t)
            if tokens:
                lines.append(((doc_id is not None, doc_id or 0, i, hashes[text]), (doc_id, text), i, tokens))
    lines.sort(key=lambda x: x[0])
    stay = {d: [] for d in set(docs)}
    for k, (_, d, i, s) in enumerate(lines):
        if not any(100 * len(s & t) >= 80 * len(s | t) for *_, t in lines[:k]):
            stay[d].append(i)
    want = {(d, t, "\n".join(x for i, x in enumerate(t.split("\n")) if i in stay[d, t] or not x.strip())) for d, t in set(docs)}
    got = {(r.doc_id, r.given, r.text) for r in dedup_lines(df.withColumn("given", df["text"])).collect()}
    assert got == want


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c\nd e f", 7, 8, 9, 10, 11, 12), (2, "a b c\nother one here", 7, 8, 9, 10, 11, 12)], SCHEMA + ", _key int, _doc int, _kept int, `a.b` int, row int, doc int")
    got = dedup_lines(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(1, "a b c\nd e f", 7, 8, 9, 10, 11, 12), (2, "other one here", 7, 8, 9, 10, 11, 12)]
    assert sorted((r.doc_id, r.n_lines, list(r.kept)) for r in line_report(df).collect()) == [(1, 2, [0, 1]), (2, 2, [1])]


def test_entries_are_small(spark):
    """Text hashes only where an id repeats, and 32 bits of a token: what is shuffled for each rare token stays small."""
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "g h\ni j k"), (2, "l m"), (None, "n o"), (None, "p q"), (3, None)], SCHEMA)
    rows = df.select("doc_id", _row(df).alias("row")).collect()
    assert {r.doc_id: r.row for r in rows if r.doc_id in (1, 3)} == {1: 0, 3: 0}
    assert all(r.row != 0 for r in rows if r.doc_id not in (1, 3)) and len({r.row for r in rows}) == 5
    entries = _entries(line_classes(df, _row(df)), F.lit(100))
    assert dict(entries.dtypes) == {"token": "int", "doc": "bigint", "line": "bigint", "row": "bigint", "set": "bigint", "low": "bigint", "high": "bigint", "before": "int"}


def test_blanks_within_a_line(spark):
    docs = [(1, "A\tb\x0bC\r\n \t\x0c\r\nx  y"), (2, "a b c\r\nX\x0cY\nnew\u00a0one"), (3, "\tnew\u00a0ONE\n" + " ".join(f"w{i}" for i in range(200))), (4, "\t".join(f"W{i}" for i in range(10, 200)))]
    got = {r.doc_id: list(r.kept) for r in line_report(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == plain(docs) == {1: [0, 2], 2: [2], 3: [1], 4: []}


def test_tokens_are_sorted_as_plain_numbers(spark):
    """No token's code may be null, else each is compared as an object."""
    df = spark.createDataFrame([(1, "a b c\td e f"), (2, None)], SCHEMA)
    classes = line_classes(df, _row(df))
    assert classes.schema["rarest"].dataType.containsNull is False
