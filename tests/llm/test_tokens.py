"""Token counts against the tokenizer itself; packing against exhaustive search."""

import random
from itertools import combinations

import sentencepiece
from tokenizers import Tokenizer, models, pre_tokenizers

from centwise.llm.packing import boundaries, pack
from centwise.llm.token_counts import SPACE, VOCABULARY, UnigramCounter, counter, token_counts, token_lengths

DATA = "/root/testdata/sf0.001"
ODD = ["", " ", "  a  b ", "▁x", "日本語 text ünï\n\n q", "a" * 5000, "\x00ab ✨✨ x", "x\ty", "🙂" * 7]


def reference(pieces, byte_fallback, unknown):
    t = Tokenizer(models.Unigram(pieces, unk_id=unknown, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=SPACE, prepend_scheme="always", split=True)
    return t


def test_counts_are_the_tokenizers(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    # control pieces are no text: keep their places with strings that don't occur
    pieces = [(model.id_to_piece(i) if not (model.is_control(i) or model.is_unknown(i)) else f"{i}", model.get_score(i)) for i in range(model.get_piece_size())]
    t = reference(pieces, True, 0)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in token_counts(docs).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts.items()}
    assert [counter()(x)[0] for x in ODD] == [len(t.encode(x, add_special_tokens=False).ids) for x in ODD]


def test_ties_and_unknowns_without_byte_fallback():
    r = random.Random(5)
    for _ in range(40):
        pieces = [("<u>", 0.0)] + [(p, -float(r.randint(1, 4))) for p in {"".join(r.choices("▁abc", k=r.randint(1, 4))) for _ in range(14)} if SPACE not in p[1:]]
        mine, theirs = UnigramCounter(pieces[1:], False), reference(pieces, False, 0)
        mine.unknown = min(s for _, s in pieces) - 10.0
        for _ in range(60):
            text = "".join(r.choices("abcx ", k=r.randint(0, 14)))
            assert mine(text)[0] == len(theirs.encode(text, add_special_tokens=False).ids), (pieces, text)


def test_nulls_repeats_and_other_columns(spark):
    df = spark.createDataFrame([(1, None, 3), (None, "ab cd", 4), (2, "", 5), (2, "", 5)], "doc_id bigint, text string, n_tokens int")
    assert sorted(map(tuple, token_counts(df).select("doc_id", "n_tokens", "n_chars").collect()), key=str) == [(1, 0, 0), (2, 0, 0), (2, 0, 0), (None, counter()("ab cd")[0], 5)]
    assert token_counts(df.limit(0)).collect() == []
    assert sorted(map(tuple, token_lengths(df).collect()), key=str) == sorted(map(tuple, token_counts(df).select("doc_id", "n_tokens").collect()), key=str)
    assert token_lengths(df.limit(0)).collect() == []


def padding(histogram, ends):
    return sum(n * (min(e for e in ends if e >= x) - x) for x, n in histogram.items())


def test_boundaries_are_optimal():
    r = random.Random(8)
    for _ in range(60):
        histogram = {x: r.randint(1, 30) for x in r.sample(range(1, 60), r.randint(1, 9))}
        lengths, k = sorted(histogram), r.randint(1, 4)
        best = min(padding(histogram, [*c, lengths[-1]]) for n in range(min(k, len(lengths))) for c in combinations(lengths[:-1], n))
        ends, got = boundaries(histogram, k)
        assert got == best == padding(histogram, ends) and len(ends) <= k and ends[-1] == lengths[-1]
    assert boundaries({}, 3) == ([], 0)


def test_batches_hold_every_token_within_budget(spark):
    r = random.Random(9)
    docs = [(i, r.choice([1, 3, 40, 41, 250, 1000, 1024, 1025, 5000])) for i in range(400)] + [(1, 7), (1, 7), (None, 12), (900, 0), (901, None)]
    rows = pack(spark.createDataFrame(docs, "doc_id bigint, n_tokens bigint"), longest=1024, buckets=4, budget=4096).collect()
    placed = [x for x in rows if x.piece is not None]
    assert sorted(x.doc_id for x in rows if x.piece is None) == [900, 901]
    total = {}
    for x in placed:
        total[x.doc_id] = total.get(x.doc_id, 0) + x.n_tokens
        assert 0 < x.n_tokens <= x.bucket <= 1024 and x.first_token == 1024 * x.piece
    want = {}
    for i, n in docs:
        if n:
            want[i] = want.get(i, 0) + n
    assert total == want
    batches = {}
    for x in placed:
        batches.setdefault(x.bucket, {}).setdefault(x.batch, []).append(x.place)
    assert len(batches) == 4
    for bucket, own in batches.items():
        size = max(1, 4096 // bucket)
        assert sorted(own) == list(range(len(own)))
        assert all(sorted(p) == list(range(len(p))) and (len(p) == size or b == len(own) - 1) for b, p in own.items())
    assert pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint")).collect() == []


def test_numbers_run_through_shards(spark, monkeypatch):
    monkeypatch.setattr("centwise.llm.packing.SHARD_ROWS", 10)
    rows = pack(spark.createDataFrame([(i, 5) for i in range(105)], "doc_id bigint, n_tokens bigint"), budget=50).collect()
    assert sorted((x.batch, x.place) for x in rows) == [(i // 10, i % 10) for i in range(105)]
