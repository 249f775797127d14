"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from centwise.llm import collocations as module
from centwise.llm.collocations import PrefixRuns, collocations, phrase_counts

SCHEMA = "doc_id bigint, text string, lang string"


def counts(docs):
    f, total = Counter(), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    return f, total


def plain(docs, least, covered, best):
    f, total = counts(docs)
    candidates = {x: n for x, n in f.items() if len(x[1]) > 1 and n >= least}
    out = []
    for (lang, words), a in candidates.items():
        if any(len(w) > len(words) and l == lang and 100 * n >= covered * a and any(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1)) for (l, w), n in candidates.items()):
            continue
        cuts = [(int(Fraction(10**6 * a * a, f[lang, words[:k]] * f[lang, words[k:]])), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], total[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(own[:best])]
    return sorted(ranked)


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["a", "B", "c", "Ä", "ä", "x\x00y", "日本", "d-e", "…", "\xa0", "q" * 40]
    docs = []
    for i in range(n):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t ", ". ", ",", "\n", " \x0b", "  "]) for _ in range(r.choice([0, 1, 2, 5, 80])))
        docs.append((r.choice([None, i]), r.choice([text, text, None, ""]), r.choice([None, "und", "en", "t\tb", ""])))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("held", [3, 50, 10**6])
def test_equals_plain_counting_however_runs_are_cut(spark, monkeypatch, seed, held):
    monkeypatch.setattr(module, "RUN_WORDS", held)  # in this process; workers' runs are tested below
    docs = corpus(seed)
    got = Counter()
    runs = PrefixRuns()
    batches = [b for _, text, lang in docs if text is not None for b in runs.add(lang or "und", text.encode())] + list(runs.flush())
    for batch in batches:
        for head, tail, n in zip(*(batch.column(c).to_pylist() for c in ("head", "tail", "n"))):
            got[head, tail] += n
    f, total = counts([(i, t, lang or "und") for i, t, lang in docs])
    heads = Counter()
    for (head, _), n in got.items():
        heads[head] += n
    assert {h: n for h, n in heads.items() if not h.endswith("\t")} == {f"{lang}\t{' '.join(w)}": n for (lang, w), n in f.items() if len(w) < 3}
    assert {x: n for x, n in got.items() if x[1] is not None} == {(f"{lang}\t{w[0]} {w[1]}", w[2]): n for (lang, w), n in f.items() if len(w) == 3}
    assert {h[:-1]: n for h, n in heads.items() if h.endswith("\t")} == {k: n for k, n in total.items() if n}


def test_a_long_text_is_split_between_words(monkeypatch):
    monkeypatch.setattr(module, "SLICE", 7)
    runs = PrefixRuns()
    text = "abcdefghijkl mno\tp qr,stuvwxyzabc\nd e f g h"
    found = Counter()
    for batch in [*runs.add("en", text.encode()), *runs.flush()]:
        for head, n in zip(batch.column("head").to_pylist(), batch.column("n").to_pylist()):
            found[head] += n
    f, _ = counts([(1, text, "en")])
    assert {h: n for h, n in found.items() if not h.endswith("\t")} == {f"en\t{' '.join(w)}": n for (_, w), n in f.items() if len(w) < 3}


@pytest.mark.parametrize("seed", [3, 4])
def test_equals_plain(spark, seed):
    docs = corpus(seed, 120)
    frame = spark.createDataFrame(docs, SCHEMA).repartition(5)
    assert sorted(map(tuple, collocations(frame, 3, 50, 12).collect())) == plain(docs, 3, 50, 12)
    assert len(plain(docs, 3, 50, 12)) > 30


def test_products_beyond_64_bits(spark):
    a, l, r = 3_000_000_019, 4_000_000_007, 5_000_000_029
    score = spark.sql(f"SELECT {a}L a, {l}L l, {r}L r").select(module._score(module.F.col("a"), module.F.col("l"), module.F.col("r"))).collect()[0][0]
    assert score == 10**6 * a * a // (l * r)


def test_counts_summed_over_runs_and_batches(spark):
    docs = [(i, "x y z. x y", "en") for i in range(500)]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(r.lang, tuple(r.words)): r.n for r in phrase_counts(frame, 10).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {("en", ()): 2500, ("en", ("x",)): 1000, ("en", ("y",)): 1000, ("en", ("z",)): 500, ("en", ("x", "y")): 1000, ("en", ("y", "z")): 500, ("en", ("x", "y", "z")): 500}


def test_empty_tables_nulls_and_other_columns(spark):
    frame = spark.createDataFrame([(1, None, None, 1), (2, "", "en", 2)], SCHEMA + ", n int")
    assert collocations(frame).collect() == [] and collocations(frame.limit(0)).collect() == []
    frame = spark.createDataFrame([(1, "a b " * 10, None, 7)] * 2, SCHEMA + ", phrase int")
    assert [tuple(r) for r in collocations(frame, 3).collect()] == plain([(1, "a b " * 10, None)] * 2, 3, 50, 2000)
