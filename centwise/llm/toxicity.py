"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centwise.llm.tokens import REMEMBERED, Remembered, rows, without
from centwise.storage import cut

#: Labelled rows the model is fitted on at most, the first by a hash of doc_id; terms of the learned lexicon at most.
SAMPLE_ROWS, TERMS = 20_000, 256
#: Toxic texts that hold a learned term at least.
LEAST_TEXTS = 5
THRESHOLD = 0.3
TREES, DEPTH = 30, 3
NEAR = 5

#: Common insults, and words that address the reader.
INSULTS = set("""idiot idiots moron morons loser losers stupid dumb scum trash worthless pathetic disgusting clown fool garbage imbecile vermin hate
idiota estúpido imbécil basura asqueroso idiote imbécile stupide crétin ordure dumm dummkopf idioten abschaum widerlich trottel""".split())
SECOND = set("you your yours yourself u ur du dich dir dein deine ihr euch tu toi ton ta tes vous votre vos tú te ti usted ustedes vosotros vuestro".split())
LEET = str.maketrans("013457@$!", "oieastasi")
EDGES = ".,;:!?\"'()[]{}<>|&%#"
PUNCTUATION = set(".,;:!?\"'()[]{}<>|*&%#$@-_/")

FEATURES = ["weight_density", "hit_density", "hits", "insult_density", "best_weight", "kinds", "near_second_density", "second_density", "capital_rate", "shouted_rate", "punctuation_rate", "exclamation_rate", "obfuscated_rate", "unmasked_density", "log_words"]
STEMS = range(4, 8)


def units(word: str) -> list[str]:
    """A word as a lexicon sees it: itself, and its beginnings."""
    bare = word.lower().strip(EDGES)
    return [bare, *(f"{bare[:n]}-" for n in STEMS if len(bare) > n)] if bare else []


def held_out(doc_id: Column | str) -> Column:
    """Rows whose label is never learned: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Measure:
    """Dense features of a text; every distinct word is looked at once and remembered."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known = Remembered(self._profile)
        self.profiles: dict[tuple, int] = {}
        self.table: np.ndarray | None = None

    def _profile(self, word: str) -> int:
        bare = word.lower().strip(EDGES)
        weight = max((self.lexicon.get(u, 0.0) for u in units(word)), default=0.0)
        inner = bare.strip("*")
        obfuscated = any(c.isalpha() for c in inner) and any(not c.isalpha() and c not in "-'’" for c in inner) or "*" in bare.strip("*") if inner else False
        unmasked = obfuscated and (plain := inner.translate(LEET)) != inner and (plain in INSULTS or any(u in self.lexicon for u in units(plain)))
        letters = [c for c in word if c.isalpha()]
        upper = sum(c.isupper() for c in letters)
        row = (weight, weight > 0, bare in INSULTS, bare in SECOND, upper, len(letters) > 2 and upper == len(letters), sum(c in PUNCTUATION for c in word), word.count("!"), obfuscated, unmasked, len(word))
        return self.profiles.setdefault(row, len(self.profiles))

    def __call__(self, text: str | None) -> list[float]:
        words = text.split() if text else []
        if not words:
            return [0.0] * len(FEATURES)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if self.table is None or len(self.table) < len(self.profiles):
            self.table = np.array(list(self.profiles), float)
        seen, where, times = np.unique(codes, return_inverse=True, return_counts=True)
        found = self.table[seen]
        total, n = times @ found, len(words)
        hit, second = np.flatnonzero((found[:, 1] > 0)[where]), np.flatnonzero((found[:, 3] > 0)[where])
        near = 0
        if len(hit) and len(second):
            right = np.searchsorted(second, hit)
            gap = np.minimum(np.abs(second[np.minimum(right, len(second) - 1)] - hit), np.abs(second[np.maximum(right - 1, 0)] - hit))
            near = int((gap <= NEAR).sum())
        kinds = len({words[i].lower().strip(EDGES) for i in hit})
        return [total[0] / n, total[1] / n, total[1], total[2] / n, found[:, 0].max(), kinds, near / n, total[3] / n, total[4] / total[10], total[5] / n, total[6] / total[10], total[7] / n, total[8] / n, total[9] / n, math.log1p(n)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units with the number of toxic and of other texts that hold them, summed over a task."""
    toxic, other = Counter(), Counter()
    for batch in rows(batches):
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            (toxic if label else other).update(set(chain.from_iterable(map(units, set((text or "").split())))))
    names = list(toxic | other)
    for at in range(0, len(names), 20_000):
        part = names[at : at + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[u] for u in part], pa.int64()), pa.array([other[u] for u in part], pa.int64())], ["unit", "toxic", "other"])


def learned_lexicon(texts: DataFrame) -> dict[str, float]:
    """The ``TERMS`` units most telling of toxic texts (text, toxic), with their log odds."""
    sizes = texts.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    rate = (F.col("toxic") + 0.5) / (sizes[0] + 1) / ((F.col("other") + 0.5) / (sizes[1] + 1))
    counted = texts.select("text", "toxic").mapInArrow(_counted, "unit string, toxic bigint, other bigint").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    telling = counted.withColumn("odds", F.log(rate)).where(f"odds >= 2 AND toxic >= {LEAST_TEXTS}")
    return {r["unit"]: r["odds"] for r in telling.orderBy((F.col("odds") * F.col("toxic")).desc(), "unit").limit(TERMS).collect()}


def _features(docs: DataFrame, lexicon: dict[str, float], *more: str) -> DataFrame:
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(lexicon)
        for batch in rows(batches):
            found = [measure(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(batch.column(c).cast(pa.int64()) for c in more), pa.array(found, pa.list_(pa.float64()))], ["doc_id", *more, "values"])

    kinds = ", ".join(["doc_id bigint", *(f"{c} bigint" for c in more), "values array<double>"])
    return docs.select("doc_id", *more, "text").mapInArrow(measured, kinds).withColumn("features", array_to_vector("values")).drop("values")


class ToxicityModel:
    """Lexicon, trees and calibration, fitted on labelled rows outside the held-out quarter.

    At most ``sample_rows`` labelled rows are used.  Their ids are dealt by hash
    into rows that build the lexicon, rows that grow the trees and rows that
    calibrate; where a part lacks one of the classes, all rows serve for it.
    Without labelled rows of both classes the score is that of the fixed insults.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS):
        known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("bigint").alias("toxic")).where(~held_out("doc_id"))
        sample = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "sample")
        texts = cut(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)).cast("bigint")), "fit")
        counts = {(r[0], r[1]): r[2] for r in texts.groupBy("part", "toxic").count().collect()}
        self.trees = self.calibration = None
        self.lexicon = {}
        if {t for _, t in counts} != {0, 1}:
            return
        pick = lambda df, *parts: df.where(F.col("part").isin(*parts)) if {t for p, t in counts if p in parts} == {0, 1} else df
        self.lexicon = learned_lexicon(pick(texts, 0, 1))
        measured = cut(_features(texts, self.lexicon, "toxic", "part").withColumn("label", F.col("toxic").cast("double")), "measured")
        self.trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, minInstancesPerNode=2).fit(pick(measured, 2, 3))
        raw = self.trees.transform(pick(measured, 4)).select("label", vector_to_array("probability")[1].alias("raw"))
        self.calibration = IsotonicRegression(featuresCol="raw", predictionCol="calibrated").fit(raw.withColumn("raw", array_to_vector(F.array("raw"))))

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, score for every row of ``docs``."""
        measured = _features(docs, self.lexicon)
        if self.trees is None:
            return measured.select("doc_id", (1 - F.exp(-100 * vector_to_array("features")[FEATURES.index("insult_density")])).alias("score"))
        raw = self.trees.transform(measured).select("doc_id", vector_to_array("probability")[1].alias("raw"))
        calibrated = self.calibration.transform(raw.withColumn("point", array_to_vector(F.array("raw"))).withColumnRenamed("raw", "p").withColumnRenamed("point", "raw"))
        # a thousandth of the trees' own value orders texts inside a step of the calibration
        return calibrated.select("doc_id", ((F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated"))) + F.col("p") / 1000) / 1.001).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text); ``labels`` is (doc_id, toxic).

    Only the text is an input of the score.  Null and empty texts are scored as
    texts without words; a null doc_id is passed through and not held out;
    repeated rows are scored each; labels that are null or of no document are
    not learned, contradicting ones count as toxic; no rows give no rows.
    """
    scored = ToxicityModel(docs, labels, sample_rows).score(docs)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that reach ``threshold``; columns as given."""
    return without(docs, toxicity(docs, labels, threshold).where("predicted = 1"))
