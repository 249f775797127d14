"""Near-duplicate vectors by NN-descent: a neighbour graph refined through neighbours of neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centwise.llm.components import connected_components
from centwise.storage import cut

COSINE = 0.98
#: First length of a neighbour list, trees of the first graph, vectors of a leaf or of a local comparison at most.
LIST, TREES, LEAF = 16, 4, 256
#: Rounds at most, vectors whose neighbours are looked up one by one to audit recall, and the recall that ends the rounds.
ROUNDS, AUDITED, RECALL = 4, 200, 0.99
BLOCK = 512
#: The graph is built in single precision; pairs that close to the threshold are decided in double.
SLACK = 1e-5
NODE = "label int, node bigint, vector array<float>"
LISTS = "node bigint, near array<bigint>, cosines array<float>"


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of length one, with a key that equal vectors share; null where there is no direction."""
    for batch in batches:
        units, keys = [], []
        for v in batch.column("embedding").to_pylist():
            unit = None
            if v and None not in v:
                x = np.array(v, float)
                if np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                    x /= top
                    unit = x / np.sqrt(x @ x)
            units.append(unit)
            keys.append(None if unit is None else xxhash.xxh3_128_digest((unit + 0.0).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), pa.array(units, pa.list_(pa.float64())), pa.array(keys, pa.binary())], ["vec_id", "label", "vector", "vector_key"])


def _codes(trees: int):
    """Leaf of each vector in each tree: the sides of random planes it lies on."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, planes = batch.column("vector").to_pylist(), {}
            out = []
            for v, bits in zip(vectors, batch.column("bits").to_pylist(), strict=True):
                x = np.array(v)
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng(11).standard_normal((trees, 40, len(x)))
                sides = planes[len(x)][:, :bits] @ x > 0
                out.append((sides @ (1 << np.arange(bits))).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("node"), batch.column("vector"), pa.array(out, pa.list_(pa.int64()))], ["label", "node", "vector", "codes"])

    return code


def _near(lists: int, x: np.ndarray, nodes: np.ndarray, worst: np.ndarray) -> Iterator[tuple]:
    """Of vectors that met, each with those nearest to it that would enter its list."""
    cosines = x @ x.T
    np.fill_diagonal(cosines, -2.0)
    k = min(lists, len(nodes) - 1)
    if k <= 0:
        return
    order = np.argpartition(-cosines, k - 1, axis=1)[:, :k] if k < len(nodes) - 1 else np.argsort(-cosines, axis=1)[:, :k]
    for i, o in enumerate(order):
        o = o[cosines[i, o] > worst[i]]
        if len(o):
            yield nodes[i], nodes[o], cosines[i, o]


def _local(lists: int, keys: list[str]):
    """The groups of a bucket compared one by one; a group's size is bounded by the caller."""

    def compare(bucket: pd.DataFrame) -> pd.DataFrame:
        out = []
        bucket = bucket.assign(length=bucket["vector"].map(len))
        for places in bucket.groupby([*keys, "length"], sort=False).indices.values():
            group = bucket.take(places)
            out.extend(_near(lists, np.stack(group["vector"].to_list()), group["node"].to_numpy(), group["worst"].to_numpy()))
        return pd.DataFrame(out, columns=["node", "near", "cosines"])

    return compare


def _compared(met: DataFrame, keys: list[str], lists: int, rows: int) -> DataFrame:
    """``met`` (keys, node, worst, vector) has about ``rows`` rows, dealt into buckets of some thousands."""
    buckets = max(1, -(-rows // 8_000))
    return met.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).groupBy("bucket").applyInPandas(_local(lists, keys), LISTS)


def _merged(found: DataFrame, lists: int) -> DataFrame:
    """The ``lists`` nearest of each node over all lists found for it."""
    pairs = found.select("node", F.explode(F.arrays_zip("near", "cosines")).alias("pair")).groupBy("node", F.col("pair.near").alias("other")).agg(F.max("pair.cosines").alias("cosine"))
    ranked = pairs.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("cosine", "other")), asc=False), 1, lists).alias("ranked"))
    return ranked.select("node", F.col("ranked.other").alias("near"), F.col("ranked.cosine").alias("cosines"))


def _chunks(df: DataFrame, keys: list[str], rows: int, seed: int) -> DataFrame:
    """Groups dealt by hash into chunks of about ``rows`` rows, so that no task gets a group of any size."""
    sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / rows).alias("chunks"))
    return df.join(sizes, keys).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("chunks"))).drop("chunks")


def _first_graph(nodes: DataFrame, lists: int, count: int) -> DataFrame:
    bits = nodes.groupBy("label").agg(F.greatest(F.lit(0), F.least(F.lit(40), F.ceil(F.log2(F.count("*") / (LEAF / 2))))).cast("int").alias("bits"))
    coded = nodes.join(bits, "label").mapInArrow(_codes(TREES), f"{NODE}, codes array<bigint>")
    leaves = cut(coded.select("label", "node", "vector", F.posexplode("codes").alias("tree", "leaf")), "leaves")
    keys = ["label", "tree", "leaf"]
    met = _chunks(leaves, keys, LEAF, 0).withColumn("worst", F.lit(-2.0))
    return _merged(_compared(met, [*keys, "chunk"], lists, TREES * count), lists)


def _refined(nodes: DataFrame, graph: DataFrame, lists: int, seed: int, count: int) -> DataFrame:
    """One round: a node and its neighbours, both ways, are compared with each other."""
    forward = graph.select(F.col("node").alias("center"), F.explode("near").alias("node"))
    around = forward.union(forward.select("node", "center")).union(graph.select("node", "node")).distinct()
    worst = F.when(F.size("near") >= lists, F.element_at("cosines", -1)).otherwise(-2.0).cast("double")
    state = nodes.select("node", "vector").join(graph.select("node", worst.alias("worst")), "node", "left").fillna(-2.0, "worst")
    met = _chunks(around, ["center"], LEAF // 2, seed).join(state, "node")
    return _merged(graph.union(_compared(met, ["center", "chunk"], lists, 2 * lists * count)), lists)


def _audit(nodes: DataFrame, graph: DataFrame, lists: int, cosine: float) -> float:
    """Share found of the close neighbours of ``AUDITED`` vectors, which are compared with every vector of their label."""
    asked = nodes.orderBy(F.xxhash64("node", F.lit("audit")), "node").limit(AUDITED).collect()
    by_label: dict[int, list] = {}
    for r in asked:
        by_label.setdefault((r["label"], len(r["vector"])), []).append((r["node"], r["vector"]))
    blocks = {k: (np.array([n for n, _ in v]), np.array([x for _, x in v])) for k, v in by_label.items()}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column("label").to_pylist(), batch.column("node").to_pylist(), batch.column("vector").to_pylist(), strict=True))
            out = []
            for key, (ids, x) in blocks.items():
                own = [(n, v) for label, n, v in rows if (label, len(v)) == key]
                if own:
                    i, j = np.nonzero(x @ np.array([v for _, v in own]).T >= cosine)
                    out += [(int(ids[a]), own[b][0]) for a, b in zip(i, j, strict=True) if ids[a] != own[b][0]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["node", "other"])

    # a list that is full of close neighbours is exact by another way, so as many as it can hold are asked for
    true = nodes.mapInArrow(compare, "node bigint, other bigint").groupBy("node").agg(F.least(F.count("*"), F.lit(lists)).alias("true"))
    have = graph.select("node", F.size(F.filter("cosines", lambda c: c >= cosine)).alias("have"))
    got = true.join(have, "node", "left").agg(F.sum(F.least("true", F.coalesce("have", F.lit(0)))), F.sum("true")).first()
    return 1.0 if not got[1] else got[0] / got[1]


def _block_links(cosine: float):
    """For each vector of a block, its links into another block, counted."""

    def count(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            for size in set(a["vector"].map(len)) & set(b["vector"].map(len)):
                x, y = a[a["vector"].map(len) == size], b[b["vector"].map(len) == size]
                close = np.stack(x["vector"].to_list()) @ np.stack(y["vector"].to_list()).T >= cosine
                close &= x["node"].to_numpy()[:, None] != y["node"].to_numpy()[None, :]
                out.append(pd.DataFrame({"node": x["node"], "links": close @ y["copies"].to_numpy()}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "links": []}).astype("int64")

    return count


def _within_reach(cosine: float):
    """Pairs of dense components whose balls (centre, radius) are near enough to hold a link between them, both ways."""

    def pairs(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size in set(a["vector"].map(len)) & set(b["vector"].map(len)):
            x, y = a[a["vector"].map(len) == size], b[b["vector"].map(len) == size]
            apart = np.arccos(np.clip(np.stack(x["vector"].to_list()) @ np.stack(y["vector"].to_list()).T, -1.0, 1.0))
            reach = x["radius"].to_numpy()[:, None] + y["radius"].to_numpy()[None, :] + np.arccos(np.clip(cosine, -1.0, 1.0)) + SLACK
            i, j = np.nonzero((apart <= reach) & (x["component"].to_numpy()[:, None] != y["component"].to_numpy()[None, :]))
            out.append(pd.DataFrame({"label": x["label"].to_numpy()[i], "component": x["component"].to_numpy()[i], "other": y["component"].to_numpy()[j]}))
        return pd.concat(out) if out else pd.DataFrame({"label": [], "component": [], "other": []}).astype("int64")

    return pairs


def _crossing(blocked: DataFrame, cosine: float) -> DataFrame:
    """(node, links, component, other): links from each vector of a dense component into another one, counted.

    Two groups whose lists are all full of nearer vectors have no link in any
    list.  Only components whose balls come within the threshold are compared.
    """
    placed = blocked.withColumn("size", F.size("vector"))
    centres = placed.groupBy("label", "component", "size").agg(F.min_by("vector", "node").alias("centre"))
    dot = F.aggregate(F.zip_with("vector", "centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    balls = placed.join(centres, ["label", "component", "size"]).groupBy("label", "component", "size").agg(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min(dot)))).alias("radius"), F.first("centre").alias("vector"))
    parts = balls.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    balls = cut(balls.join(parts, "label").withColumn("part", F.pmod(F.xxhash64("component", "size"), F.col("parts")).cast("int")), "balls")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    a = balls.select("label", F.col("part").alias("x"), F.explode(every).alias("y"), "component", "radius", "vector")
    b = balls.select("label", F.explode(every).alias("x"), F.col("part").alias("y"), "component", "radius", "vector")
    b = b.toDF(*b.columns)
    keys = ["label", "x", "y"]
    near = cut(a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(_within_reach(cosine), "label int, component bigint, other bigint").distinct(), "pairs")
    sizes = blocked.select("label", "component", "blocks").distinct()
    pairs = near.join(sizes, ["label", "component"]).join(sizes.toDF("label", "other", "other_blocks"), ["label", "other"])
    left = pairs.join(blocked.drop("blocks"), ["label", "component"]).select("label", "component", "other", F.col("block").alias("x"), F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)).alias("y"), "node", "copies", "vector")
    right = pairs.join(blocked.drop("blocks").withColumnRenamed("component", "other"), ["label", "other"]).select("label", "component", "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), F.col("block").alias("y"), "node", "copies", "vector")
    keys = ["label", "component", "other", "x", "y"]
    count = _block_links(cosine)

    def crossing(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = count(key, a, b)
        return found[found["links"] > 0].assign(component=key[1], other=key[2])

    right = right.toDF(*right.columns)  # columns of its own, as both sides come from the same pairs
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(crossing, "node bigint, links bigint, component bigint, other bigint")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Vectors of equal label are linked at a cosine of ``cosine`` or more, in double
    precision.  Equal directions of a label form one node with a number of
    copies.  The neighbour graph starts from random-plane leaves and is refined
    by rounds of comparing neighbours of neighbours, until an audit of a fixed
    number of vectors against all of their label finds enough of the close pairs.
    In the last round lists are twice as long.  Where a list is then still
    full of close neighbours, the links of its vector are counted exactly: its
    component is cut into blocks and blocks are compared with each other, which
    emits counts, not pairs; so are the blocks of two such components whose
    vectors may be near enough, and components that are linked become one.

    Null, zero, ragged or non-finite vectors and null labels link with nothing;
    vectors of different length don't link.  A row with a null vec_id is
    returned with component_id null and kept.  Rows with equal vec_id are vectors
    of their own, but share the component of the smallest.  No rows give no rows.
    """
    given = vectors.select("vec_id", "embedding", "label")
    unit = cut(given.mapInArrow(_unit, "vec_id bigint, label int, vector array<double>, vector_key binary"), "unit")
    usable = unit.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector_key IS NOT NULL")
    classes = usable.groupBy("label", "vector_key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    nodes = cut(classes.select("label", F.xxhash64("label", "vector_key").alias("node"), "rep", "copies", "vector", "vector_key"), "nodes")
    points = nodes.select("label", "node", F.col("vector").cast("array<float>").alias("vector"))
    count = nodes.count()
    lists = LIST
    graph = cut(_first_graph(points, lists, count), "graph")
    for turn in range(1, ROUNDS + 1):
        graph = cut(_refined(points, graph, lists, turn, count), "graph")
        if turn == 1:  # lists full of close neighbours are given room
            lists *= 2
        elif _audit(points, graph, lists, cosine) >= RECALL:
            break
    close = graph.select("node", F.posexplode(F.filter(F.arrays_zip("near", "cosines"), lambda p: p["cosines"] >= cosine - SLACK)).alias("at", "pair")).select("node", F.col("pair.near").alias("other"))
    a, b = nodes.select("node", "rep", F.col("vector").alias("va")), nodes.select(F.col("node").alias("other"), F.col("rep").alias("rep_b"), F.col("copies").alias("copies_b"), F.col("vector").alias("vb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    either = close.union(close.select("other", "node")).distinct()
    links = cut(either.join(a, "node").join(b, "other").where(dot >= cosine).select("node", "rep", "other", "rep_b", "copies_b"), "links")
    groups = cut(connected_components(links.select(F.col("rep").alias("a"), F.col("rep_b").alias("b"))), "groups")
    full = graph.where((F.size("near") >= lists) & (F.element_at("cosines", -1) >= cosine - SLACK)).select("node")
    member = nodes.join(groups.withColumnRenamed("node", "rep"), "rep")
    dense = member.join(full, "node", "left_semi").select("component").distinct()
    dense_points = member.join(dense, "component").select("label", "component", "node", "rep", "copies", "vector")
    sized = dense_points.groupBy("label", "component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocked = cut(dense_points.join(sized, ["label", "component"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")), "blocks")
    keys = ["label", "component", "x", "y"]
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = blocked.select("label", "component", F.col("block").alias("x"), F.explode(every).alias("y"), "node", "rep", "copies", "vector")
    right = blocked.select("label", "component", F.explode(every).alias("x"), F.col("block").alias("y"), "node", "rep", "copies", "vector")
    inside = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_block_links(cosine), "node bigint, links bigint")
    across = cut(_crossing(blocked, cosine), "across")
    exact = inside.union(across.select("node", "links")).groupBy("node").agg(F.sum("links").alias("exact"))
    joined = connected_components(across.select(F.col("component").alias("a"), F.col("other").alias("b")).distinct())
    groups = groups.join(joined.toDF("component", "whole"), "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    counted = links.groupBy("node").agg(F.sum("copies_b").alias("listed"))
    label = cut(nodes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").join(counted, "node", "left").join(exact, "node", "left").select("label", "vector_key", (F.coalesce("exact", "listed", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"), F.coalesce("component", "rep").alias("component")), "labels")
    whole = unit.select("vec_id", "label", "vector_key").join(label, ["label", "vector_key"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return whole.select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
