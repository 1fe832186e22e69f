"""Operator 5, toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Words that mark toxic texts are learned from labelled training texts (lexicon),
then each text becomes a short vector: densities of lexicon hits, how near they
stand to second-person words, capitals, punctuation, obfuscated spellings. Trees
are fitted on other training texts and calibrated on yet others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import fold_of, materialize, quoted

#: Training bound: about so many labelled texts of either class, drawn by a hash of the key.
SAMPLE_PER_CLASS = 12_000
#: Training folds (crc32 of the key modulo 5; 0 is held out): words; trees; calibration.
WORD_FOLDS, TREE_FOLDS, CALIBRATION_FOLDS = (1, 2), (3,), (4,)
#: A lexicon entry occurs in so many toxic texts at least, as a number and as a share of them ...
MIN_TOXIC, MIN_SHARE = 3, 0.001
#: ... is so many times likelier in toxic texts, and passes this log-likelihood ratio.
MIN_LIFT, MIN_G2 = 12.0, 22.0
STEMS = (4, 5, 6)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Spellings that stand for letters.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": None, ".": None, "-": None, "_": None})
WORD = re.compile(r"[^\W\d_]+")
UPPER = re.compile("[" + "".join(chr(c) for c in range(0x10000) if chr(c).isupper()) + "]+")
#: A sign that can stand for a letter, before a letter.
HINT = re.compile(r"[\d@$!|*._-][^\W\d_]")
MASKED_CHARS = 24
SLICE_ROWS = 512
FEATURES = (
    "hits", "hit_density", "distinct_hits", "best_weight", "stem_hits", "stem_density", "second_person_density", "nearest_second_person",
    "capital_share", "all_capital_words", "punctuation_share", "exclamation_share", "masked_density", "masked_hits", "log_words", "mean_word",
)


def drawn(labels: DataFrame, per_class: int, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(label_key, label, weight) of labelled training rows, at most about per_class of either label; weight undoes the draw."""
    known = labels.select(F.col(key).alias("label_key"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("label_key").isNotNull()).where(fold_of(F.col("label_key")) != 0)
    known = known.groupBy("label_key").agg(F.max("label").alias("label"))
    n = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, F.lit(min(1.0, per_class / n.get(1, 1)))).otherwise(F.lit(min(1.0, per_class / n.get(0, 1))))
    return known.withColumn("share", share).where(F.pmod(F.xxhash64("label_key"), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("label_key", "label", (1 / F.col("share")).alias("weight"))


def _terms(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}


def lexicon(texts: DataFrame) -> dict[str, float]:
    """Term -> log of its lift, from (text, label); a term is a word or, with a star, a stem.

    Each distinct text counts once. Only terms of a least share of the toxic
    texts are candidates, so what comes to the driver is bounded by the terms a
    text has over that share; the other label is counted for candidates alone.
    """
    texts = texts.select("text", "label").distinct()
    n = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return {}
    least = max(MIN_TOXIC, math.ceil(MIN_SHARE * toxic))

    def counted(label: int, among: frozenset | None) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own: dict[str, int] = {}
                for x in batch.column(0).to_pylist():
                    for t in _terms(x) if among is None else _terms(x) & among:
                        own[t] = own.get(t, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["term", "n"])

        return texts.where(F.col("label") == label).select("text").mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))

    with_it = {r.term: r.n for r in counted(1, None).where(F.col("n") >= least).collect()}
    without = {r.term: r.n for r in counted(0, frozenset(with_it)).collect()}
    out = {}
    for term, a in with_it.items():
        b = without.get(term, 0)
        lift = ((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (clean + 1))
        g2 = 0.0
        for seen, of, other in ((a, toxic, b), (toxic - a, toxic, clean - b)):
            total = seen + other
            for k, size in ((seen, toxic), (other, clean)):
                if k:
                    g2 += 2 * k * math.log(k * (toxic + clean) / (total * size))
        if lift >= MIN_LIFT and g2 >= MIN_G2:
            out[term] = math.log(lift)
    return out


class Kinds(dict):
    """word -> what it is: IS_HIT, IS_STEM, IS_SECOND added up; filled as words come, up to MOST of them."""

    IS_HIT, IS_STEM, IS_SECOND, MOST = 1, 2, 4, 200_000

    def __init__(self, terms: dict[str, float]):
        super().__init__()
        self.words = {t: v for t, v in terms.items() if not t.endswith("*")}
        self.stems = {t[:-1] for t in terms if t.endswith("*")}

    def __missing__(self, w: str) -> int:
        stem = any(w[:k] in self.stems for k in STEMS)
        kind = self.IS_HIT * (w in self.words) + self.IS_STEM * stem + self.IS_SECOND * (w in SECOND_PERSON)
        if len(self) < self.MOST:
            self[w] = kind
        return kind


def masked(text: str) -> list[str]:
    """Words of up to MASKED_CHARS signs in which something stands for a letter."""
    out, end = [], 0
    for m in HINT.finditer(text):
        if m.start() < end:
            continue
        a, end = m.start(), m.end()
        while a and not text[a - 1].isspace() and end - a <= MASKED_CHARS:
            a -= 1
        while end < len(text) and not text[end].isspace() and end - a <= MASKED_CHARS:
            end += 1
        if end - a <= MASKED_CHARS and any(map(str.isalpha, text[a : m.start()])):
            out.append(text[a:end])
    return out


def vector(text: str | None, kinds: Kinds) -> list[float]:
    """The features of one text, in the order of FEATURES; zeros for an empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    low = WORD.findall(text.lower())
    n, letters = max(1, len(low)), len("".join(low))
    marked = [(k, v) for k, v in enumerate(map(kinds.__getitem__, low)) if v]
    hit = [k for k, v in marked if v & kinds.IS_HIT]
    second = [k for k, v in marked if v & kinds.IS_SECOND]
    stem = sum(1 for _, v in marked if v & kinds.IS_STEM)
    near = 0.0
    if hit and second:
        at = np.array(second)
        place = np.searchsorted(at, hit)
        gap = np.minimum(np.abs(at[np.minimum(place, len(at) - 1)] - hit), np.abs(at[np.maximum(place - 1, 0)] - hit))
        near = 1.0 / (1.0 + float(gap.min()))
    hidden = masked(text)
    found = sum("".join(WORD.findall(w.lower().translate(LOOKALIKE))) in kinds.words for w in hidden)
    capitals = UPPER.findall(text)
    marks = max(0, len(text) - letters - text.count(" ") - text.count("\n"))
    return [
        float(len(hit)), 100.0 * len(hit) / n, float(len({low[k] for k in hit})), max((kinds.words[low[k]] for k in hit), default=0.0), float(stem), 100.0 * stem / n,
        100.0 * len(second) / n, near, len("".join(capitals)) / max(1, letters), sum(len(c) > 1 for c in capitals) / n, marks / len(text), text.count("!") / len(text), 100.0 * len(hidden) / n, float(found), math.log1p(len(low)), letters / n,
    ]


def featured(rows: DataFrame, terms: dict[str, float]) -> DataFrame:
    """Adds features array<double> from the column text, dropped; other columns stay."""
    ship(rows.sparkSession)
    kept = [f for f in rows.schema if f.name != "text"]
    names = [f.name for f in kept]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Kinds(terms)
        for whole in batches:
            for a in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(a, SLICE_ROWS)
                found = [vector(x, kinds) for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.list_(pa.float64()))], names=[*names, "features"])

    return rows.mapInArrow(make, T.StructType([*kept, T.StructField("features", T.ArrayType(T.DoubleType()))]))


class Model:
    """A lexicon, boosted trees and a calibration curve; without both labels, a constant."""

    def __init__(self, terms: dict[str, float], trees=None, curve=None, constant: float = 0.0):
        self.terms, self.trees, self.curve, self.constant = terms, trees, curve, constant


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learns from labelled rows of the training folds only, from their text and label.

    The labelled sample has at most about 2 * per_class rows, so it is broadcast
    to pick its texts; text travels for those alone. A text that stands in several
    rows counts once: in the fold of its smallest key, toxic if any of them is.
    Words, trees and calibration each have folds of their own; where a part lacks
    one of the labels, all parts teach it. Without both labels the model is a
    constant. Rows without a key, a text or a label of 0 or 1 teach nothing;
    empty tables give the constant 0; very long texts are read whole.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    ship(docs.sparkSession)
    sample = drawn(labels, per_class)
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    texts = texts.join(F.broadcast(sample), F.col("key") == F.col("label_key")).groupBy("text").agg(F.min("key").alias("key"), F.max("label").alias("label"), F.max("weight").alias("weight"))
    texts = texts.select(fold_of(F.col("key")).alias("fold"), "text", "label", "weight")
    texts = materialize(texts, "toxicity-texts")
    n = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model({}, constant=1.0 if n.get(1) else 0.0)
    terms = lexicon(texts.where(F.col("fold").isin(*WORD_FOLDS)))
    points = materialize(featured(texts, terms).select("fold", "label", "weight", "features"), "toxicity-points")
    points = points.select("fold", F.col("label").cast("double").alias("label"), "weight", array_to_vector("features").alias("features"))
    trees_on = points.where(F.col("fold").isin(*TREE_FOLDS))
    if trees_on.select("label").distinct().count() < 2:
        trees_on = points
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.3, maxBins=64, minInstancesPerNode=5, seed=7, featuresCol="features", labelCol="label").fit(trees_on.coalesce(4))
    scored = trees.transform(points).select("fold", "label", "weight", vector_to_array("probability")[1].alias("raw"))
    on = scored.where(F.col("fold").isin(*CALIBRATION_FOLDS))
    if on.select("label").distinct().count() < 2:
        on = scored
    # one row a score: equal scores are one point of the curve, however many they are
    on = on.groupBy("raw").agg(F.sum("weight").alias("w"), (F.sum(F.col("weight") * F.col("label")) / F.sum("weight")).alias("label")).withColumnRenamed("w", "weight")
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(on)
    return Model(terms, trees, curve)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """(key, held_out, score, predicted) of every row, from its text alone; with keep also row, a struct of all its columns.

    Null texts score as empty ones. Without labels of both classes the score is
    the constant 0 (1 if there are toxic labels alone). Repeated rows and null
    keys are kept; an empty table gives an empty result; other columns are not
    read.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = docs.select(F.col(key).alias("key"), (fold_of(F.col(key)) == 0).alias("held_out"), F.col(text).cast("string").alias("text"), *([F.struct(*quoted(docs)).alias("row")] if keep else []))
    kept = ["row"] if keep else []
    if model.trees is None:
        out = rows.withColumn("score", F.lit(float(model.constant)))
    else:
        out = featured(rows, model.terms).select("key", "held_out", array_to_vector("features").alias("features"), *kept)
        out = model.trees.transform(out).select("key", "held_out", vector_to_array("probability")[1].alias("raw"), *kept)
        out = model.curve.transform(out).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("calibrated"))))
    return out.select(F.col("key").alias(key), "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), *kept)
