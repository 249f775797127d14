"""Token alignment against the tokenizer files and plain interval overlap."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer, decoders

from centwise.llm import token_alignment as module
from centwise.llm.token_alignment import TOKENIZER_A, TOKENIZER_B, Aligner, align_tokens, aligned, groups, merge, tokenizer

DATA = "/root/testdata/sf0.001"
ODD = ["", " ", "a", "  a  b ", "▁x", "a▁b", "日本語 text ünï\n\n q", "a" * 3000, "\x00ab ✨✨ x", "x\ty\r\n", "🙂" * 7, "<s> </s> <unk> <|endoftext|>", "<0x41>", "\xa0 x\u0085", "é ﬁ Å", "ⅷ ٣ 𝒳", " trailing  \n", "don't we'LL", "ß" * 40, None]


def exact(texts):
    """(A ids, B ids, A ends, B ends) or None, from the files' own libraries."""
    a = Tokenizer.from_file(TOKENIZER_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER_B)
    back = module._byte_of()
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        raw = (" " + text).encode()
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ba = [bytes(back[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        out.append((ia, ib, np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()) if b"".join(ba) == raw == b"".join(bb) else None)
    return out


def plain(texts):
    found, links, count = exact(texts), [], Counter()
    for x in found:
        own = []
        if x:
            ia, ib, ea, eb = x
            own = [(ia[i], ib[j]) for i in range(len(ia)) for j in range(len(ib)) if max(ea[i - 1] if i else 0, eb[j - 1] if j else 0) < min(ea[i], eb[j])]
        links.append(own)
        count.update(own)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    rows = []
    for x, own in zip(found, links):
        if not x:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ia, ib, ea, eb = x
        both = [e for e in ea if e in set(eb)]
        text, low = [], 0
        for e in both:
            text.append(",".join(str(i) for i, y in zip(ia, ea) if low < y <= e) + "|" + ",".join(str(i) for i, y in zip(ib, eb) if low < y <= e))
            low = e
        rows.append((len(ia), len(ib), len(both), len(own), sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own), hashlib.sha256(";".join(text).encode()).hexdigest()))
    return rows


def run(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    return [tuple(r)[1:] for r in align_tokens(docs).orderBy("doc_id").collect()]


def test_equals_plain(spark):
    r = random.Random(2)
    parts = ["the ", "a", " ", "é", "日", "ing", "\n", "Zeug", "?!", "  ", "0", "12"]
    texts = ODD + ["".join(r.choice(parts + ["▁"] * (i % 5 == 0)) for _ in range(r.randint(1, 60))) for i in range(40)]
    got, want = run(spark, texts), plain(texts)
    assert got == want
    assert sum(w[0] == 0 for w in want) > 4 and sum(w[0] > 0 for w in want) > 30


@pytest.mark.parametrize("frequent", [2, 65_536])
def test_counts_are_the_same_whatever_is_frequent(spark, monkeypatch, frequent):
    monkeypatch.setattr(module, "FREQUENT", frequent)
    texts = ["the cat sat on the mat " * 3, "the the the", "a mat", "Zeugma"] * 3
    assert run(spark, texts) == plain(texts)


@pytest.mark.parametrize("lane", [1, 3, 1024])
def test_lanes_change_nothing(monkeypatch, lane):
    monkeypatch.setattr(module, "LANE", lane)
    r = random.Random(lane)
    for _ in range(50):
        docs = []
        for _ in range(r.randint(1, 6)):
            size = r.randint(1, 40)
            docs.append([sorted({size, *r.sample(range(1, size + 1), r.randint(0, size))}) for _ in range(2)])
        ends, starts, at = ([], []), ([0], [0]), 0
        for d in docs:
            for k in (0, 1):
                ends[k].extend(at + e for e in d[k])
                starts[k].append(len(ends[k]))
            at += d[0][-1]
        a, b, cut_a, cut_b = merge(*map(np.array, ends), *map(np.array, starts))
        low = [[0, *e[:-1]] for e in ends]
        assert sorted(zip(a.tolist(), b.tolist())) == [(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if max(low[0][i], low[1][j]) < min(ends[0][i], ends[1][j])]
        assert sorted(ends[0][i] for i in cut_a) == sorted(set(ends[0]) & set(ends[1])) == sorted(ends[1][i] for i in cut_b)


def test_characters_taken_for_settled_are_cut_alike():
    a = tokenizer(TOKENIZER_A)
    assert a.own is not None
    file = Tokenizer.from_file(TOKENIZER_A)
    file.encode_special_tokens = True
    settled = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and module._SETTLED.fullmatch(chr(c))]
    assert len(settled) > 600
    for c in settled:
        for text in (f" a{c}b 1{c}2 {c}{c} .{c}. {c}\n{c} ", f"  {c}  {c}", f"'{c}'s {c}'ll"):
            assert a([text])[0] == file.encode(text, add_special_tokens=False).ids, repr(c)


def test_documents_of_the_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = exact(list(texts.values()))
    got = {r.doc_id: r for r in aligned(docs).collect()}
    for (i, text), x in zip(texts.items(), found):
        r = got[i]
        n_groups = len(set(x[2]) & set(x[3])) if x else 0
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == ((len(x[0]), len(x[1]), n_groups, len(x[0]) + len(x[1]) - n_groups) if x else (0, 0, 0, 0))
        assert sum(r.times) == r.n_links
        assert r.groups_sha256 == (hashlib.sha256(groups(text).encode()).hexdigest() if x else "")


def test_a_long_text(spark):
    text = "the quick brown föx jumps over " * 40_000 + "x" * 5_000
    (got,), (x,) = Aligner(TOKENIZER_A, TOKENIZER_B)([text]), exact([text])
    n_groups = len(set(x[2]) & set(x[3]))
    assert got[:4] == (len(x[0]), len(x[1]), n_groups, len(x[0]) + len(x[1]) - n_groups)
    assert got[4] == hashlib.sha256(groups(text).encode()).hexdigest()


def test_nulls_repeats_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 3), (None, "ab cd", 4), (2, "", 5), (7, "ab cd", 5), (7, "ab cd", 5)], "doc_id bigint, text string, n_a int").withColumn("key", module.F.lit(1))
    got = sorted(map(tuple, align_tokens(docs).collect()), key=str)
    row = plain(["ab cd"] * 3)[0]
    assert got == sorted([(1, *plain([None])[0]), (2, *plain([""])[0]), (None, *row), (7, *row), (7, *row)], key=str)
    assert align_tokens(docs.limit(0)).collect() == []
