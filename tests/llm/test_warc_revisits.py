"""Revisits against a walk over all earlier responses."""

import random
from datetime import datetime, timedelta

from centwise.llm.warc_revisits import resolve_revisits

RECORD = "record_id bigint, kind string, url string, fetched timestamp, headers map<string,string>, digest string, size bigint"
START = datetime(2024, 1, 1)


def test_equals_plain(spark):
    r = random.Random(1)
    spelled = {"e.com/a": ["http://e.com/a", "https://www.e.com:443/a/", "HTTP://E.com/a?utm_source=x#f", "http://e.com/a?ref=1"], "e.com/a?k=1&p=2": ["http://e.com/a?p=2&k=1", "http://e.com/a/?k=1&utm_x=3&p=2"], "b.org": ["http://b.org", "https://b.org/"]}
    records = []
    for i in range(400):
        name = r.choice(list(spelled))
        tag = r.choice([None, '"1"', 'W/"1"', '"2"'])
        when = r.choice([None, "mon", "tue"])
        headers = {k: v for k, v in (("ETag", tag), ("Last-Modified", when), ("Date", str(i)), ("Content-Length", str(i)), ("Cache-Control", r.choice([None, "no-store"]))) if v is not None}
        kind = r.choice(["response", "revisit", "revisit"])
        records.append((i, kind, r.choice(spelled[name]), START + timedelta(minutes=r.randint(0, 600)), headers, r.choice([None, "d1", "d2"]), i, name))
    want = {}
    for i, kind, _, at, headers, digest, _, name in records:
        if kind != "revisit":
            continue
        earlier = [(t, j, h, d, s) for j, k, _, t, h, d, s, n in records if k == "response" and n == name and t < at]
        if not earlier:
            want[i] = (name, None, "missing", None, None, None)
            continue
        _, j, h, d, s = max(earlier, key=lambda x: x[:2])
        bare = lambda x: x and x.removeprefix("W/")
        if headers.get("ETag"):
            same = bare(headers["ETag"]) == bare(h.get("ETag"))
        elif headers.get("Last-Modified"):
            same = headers["Last-Modified"] == h.get("Last-Modified")
        else:
            same = None if digest is None else digest == d
        status = "unverified" if same is None else "resolved" if same else "changed"
        merged = {k.lower(): v for k, v in h.items()} | {k.lower(): v for k, v in headers.items() if k != "Content-Length"}
        want[i] = (name, j, status, d, s, merged) if status == "resolved" else (name, j, status, None, None, None)
    df = spark.createDataFrame([x[:7] for x in records], RECORD)
    got = {x.record_id: tuple(x)[1:] for x in resolve_revisits(df).collect()}
    assert got == want and {x[2] for x in want.values()} == {"missing", "resolved", "changed", "unverified"}


def test_nulls_repeats_and_other_columns(spark):
    tag, later = {"ETAG": '"1"', "etag": '"2"'}, START + timedelta(days=40)
    rows = [(1, "response", "http://e.com", START, {"ETag": '"2"', "X": "y"}, "d", 5), (2, "revisit", "http://e.com/", later, tag, None, None), (2, "revisit", "http://e.com/", later, tag, None, None), (3, "revisit", None, later, tag, None, None), (4, "revisit", "http://e.com", None, tag, None, None), (5, "revisit", "http://e.com", later, None, None, None), (None, "revisit", "http://e.com", later, {"ETag": '"9"'}, None, None), (6, "revisit", "http://e.com", START, tag, None, None), (7, "request", "http://e.com", later, tag, None, None), (None, "response", None, START, None, None, None)]
    df = spark.createDataFrame([(*x, "s") for x in rows], RECORD + ", status string")
    got = sorted(((x.record_id, x.response_id, x.status, x.headers) for x in resolve_revisits(df).collect()), key=str)
    good = {"etag": '"2"', "x": "y"}
    assert got == sorted([(2, 1, "resolved", good), (2, 1, "resolved", good), (3, None, "missing", None), (4, None, "missing", None), (5, 1, "unverified", None), (None, 1, "changed", None), (6, None, "missing", None)], key=str)
    assert resolve_revisits(df.limit(0)).collect() == []


def test_text_record_ids(spark):
    """Ids as web archives have them; of responses at one time the largest id counts, a null id before all."""
    when = START
    rows = [(f"<urn:uuid:{k}>" if k else None, "response", "http://x.test/a", when, {"ETag": '"1"'}, k, 1) for k in ("b", None, "c", "a")]
    rows.append(("<urn:uuid:r>", "revisit", "http://x.test/a", when + timedelta(hours=1), {"ETag": '"1"'}, None, None))
    df = spark.createDataFrame(rows, RECORD.replace("record_id bigint", "record_id string"))
    assert [(r.record_id, r.response_id, r.status, r.digest) for r in resolve_revisits(df).collect()] == [("<urn:uuid:r>", "<urn:uuid:c>", "resolved", "c")]
