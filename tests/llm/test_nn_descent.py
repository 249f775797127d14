"""Vector near-duplicates against every pair."""

import random

import numpy as np

from centwise.llm.nn_descent import near_duplicate_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows):
    out = {}
    units = {}
    for i, v, label in rows:
        x = None if v is None or None in v else np.array(v, np.float32).astype(float)
        units[i] = None if x is None or label is None or not len(x) or not np.isfinite(x).all() or not x.any() else (label, x / np.linalg.norm(x))
    links = {i: [j for j, w in units.items() if j != i and u and w and w[0] == u[0] and len(w[1]) == len(u[1]) and float(u[1] @ w[1]) >= 0.98] for i, u in units.items()}
    for i in units:
        seen, todo = {i}, [i]
        while todo:
            todo += (new := [j for j in links[todo.pop()] if j not in seen])
            seen |= set(new)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def corpus(seed, dense):
    r, n = random.Random(seed), np.random.default_rng(seed)
    rows, ids = [], r.sample(range(100_000), 3000)
    while len(rows) < 900:
        base, label = n.standard_normal(16), r.randint(0, 2)
        for _ in range(r.choice([1, 1, 1, 2, 5])):
            rows.append((ids.pop(), (base + n.standard_normal(16) * 0.06).tolist(), label))
    base = n.standard_normal(16)
    rows += [(ids.pop(), (base + n.standard_normal(16) * 0.1).tolist(), 1) for _ in range(dense)]
    rows += [(ids.pop(), (base * 2).tolist(), 1) for _ in range(20)]
    return rows


def test_equals_every_pair_with_a_dense_group(spark):
    rows = corpus(1, 700)
    want = plain(rows)
    got = {r.vec_id: tuple(r)[1:] for r in near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.keys() == want.keys()
    true, found = sum(n for n, _, _ in want.values()), sum(n for n, _, _ in got.values())
    assert true > 50_000 and 0.99 * true <= found <= true and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] != want[i] for i in want) <= 0.02 * len(want)


def test_links_between_groups_that_fill_each_others_lists(spark):
    n, r = np.random.default_rng(5), random.Random(5)
    ids = r.sample(range(10_000), 2000)
    u, v, w = np.linalg.qr(n.standard_normal((64, 3)))[0].T
    side = np.sqrt(1 - 0.986**2)
    bases = [u, 0.986 * u + side * v, 0.986 * u + side * w, -u]  # the second and third are 0.972 apart
    rows = [(ids.pop(), (b + n.standard_normal(64) * 0.0015).tolist(), 1) for b in bases for _ in range(40)]
    rows += [(ids.pop(), u.tolist(), 1)] * 1 + [(ids.pop(), (u * 3).tolist(), 1)] + [(ids.pop(), (u + n.standard_normal(64) * 0.0015).tolist(), 2) for _ in range(40)]
    rows += [(ids.pop(), n.standard_normal(64).tolist(), r.randint(1, 2)) for _ in range(300)]
    want = plain(rows)
    assert sorted({k for k, _, _ in want.values()}) == [0, 39, 81, 121]
    got = {row.vec_id: tuple(row)[1:] for row in near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_nulls_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [0.0, 0.0], 1), (5, None, 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0, 0.0], 1), (11, [], 1), (12, [0.98, 0.1989], 1), (None, [1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, 5) for r in rows], SCHEMA + ", component_id int")
    got = {r.vec_id: tuple(r)[1:] for r in near_duplicate_vectors(df).collect()}
    want = plain([r for r in rows if r[0] is not None]) | {None: (0, None, True)}
    assert got == want and got[1][0] == 2
    twice = near_duplicate_vectors(df.union(df.where("vec_id = 2"))).where("vec_id = 2").collect()
    assert [tuple(r) for r in twice] == [(2, 3, 1, False)] * 2
    assert near_duplicate_vectors(df.limit(0)).collect() == []
