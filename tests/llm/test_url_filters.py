"""Temporal lists against a walk over all entries."""

import random
from datetime import datetime, timedelta

from centwise.llm.url_filters import filter_urls

ENTRY = "list string, verdict string, kind string, pattern string, day timestamp, action string"
CAPTURE = "capture_id bigint, url string, fetched timestamp"
DAY = datetime(2024, 1, 1)


def plain(captures, entries):
    out = {}
    for i, (host, parts), fetched in captures:
        keys = {("domain", ".".join(host.split(".")[k:])): len(host.split(".")) - k for k in range(len(host.split(".")))} | {("prefix", host + "/" + "/".join(parts[: k + 1])): 1001 + k for k in range(len(parts))}
        state = {}
        for name, verdict, kind, pattern, day, action in sorted(entries, key=lambda e: (e[4], e[5] == "add")):
            if day <= fetched and (kind, pattern) in keys:
                state[name, verdict, kind, pattern] = action
        active = sorted((-keys[k[2], k[3]], k[1] != "block", k[0], k) for k, action in state.items() if action == "add")
        out[i] = (host, active[0][3][1], *active[0][3][2:], active[0][3][0], len(active)) if active else (host, "none", None, None, None, 0)
    return out


def test_equals_plain(spark):
    r = random.Random(1)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "c.org"]
    entries = [(r.choice(["l1", "l2"]), r.choice(["allow", "block"]), kind, pattern, DAY + timedelta(days=r.randint(0, 40)), r.choice(["add", "remove"])) for _ in range(400) for kind, pattern in [r.choice([("domain", r.choice([*hosts, "com"])), ("prefix", r.choice(hosts) + r.choice(["/x", "/x/y", "/z"]))])]]
    captures = [(i, (r.choice(hosts), r.choice([[], ["x"], ["x", "y"], ["x", "y", "w"], ["q"]])), DAY + timedelta(days=r.randint(-2, 45))) for i in range(300)]
    url = lambda host, parts: r.choice(["http", "HTTPS"]) + "://" + r.choice(["", "user@"]) + r.choice([host, host.upper()]) + r.choice(["", ":8080"]) + "/" + "/".join(parts) + r.choice(["", "?q=/x#f", "#top"])
    df = spark.createDataFrame([(i, url(*u), t) for i, u, t in captures], CAPTURE)
    got = {x.capture_id: tuple(x)[1:] for x in filter_urls(df, spark.createDataFrame(entries, ENTRY)).collect()}
    assert got == plain(captures, entries)


def test_edges_of_an_interval_ties_nulls_and_repeats(spark):
    e = [("l", "block", "domain", "e.com", DAY, "add"), ("l", "block", "domain", "e.com", DAY + timedelta(days=2), "remove"), ("l", "block", "domain", "e.com", DAY + timedelta(days=2), "add"), ("l", "block", "domain", "e.com", DAY + timedelta(days=4), "remove"), ("l", None, "domain", "e.com", DAY, "add"), (None, "block", "domain", "e.com", DAY, "add"), ("m", "allow", "domain", "e.com", None, "add")]
    c = [(1, "http://e.com", DAY), (2, "http://e.com", DAY + timedelta(days=3)), (3, "http://e.com", DAY + timedelta(days=4)), (4, None, DAY), (5, "no url", DAY), (6, "http://e.com", None), (7, "http://x.e.com./" + "p/" * 500, DAY), (7, "http://x.e.com./" + "p/" * 500, DAY), (None, "http://e.com", DAY)]
    df = spark.createDataFrame([(*x, "z") for x in c], CAPTURE + ", verdict string")
    got = {x.capture_id: (x.verdict, x.n_active) for x in filter_urls(df, spark.createDataFrame(e, ENTRY)).collect()}
    assert got == {1: ("block", 1), 2: ("block", 1), 3: ("none", 0), 4: ("none", 0), 5: ("none", 0), 6: ("none", 0), 7: ("block", 2), None: ("block", 1)}
    assert filter_urls(df.limit(0), spark.createDataFrame(e, ENTRY)).collect() == []
    assert {x.verdict for x in filter_urls(df, spark.createDataFrame([], ENTRY)).collect()} == {"none"}
    plan = filter_urls(df, spark.createDataFrame(e, ENTRY))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
