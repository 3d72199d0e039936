"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

The lexicon is learned: words and word beginnings that mark toxic rows of a bounded sample of labelled training rows. Training
rows get their features from a lexicon of the other half of the sample, so that its entries don't look better than they are.
Trees and calibration are Spark ML models: three quarters of the sample grow the trees, the last one, which they haven't seen,
calibrates them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import bounded_batches, crc32_mod, materialise, release_memory, shared_dir

#: Labelled training rows that lexicon, trees and calibration are fitted on, at most (chosen by a hash of the id).
SAMPLE_ROWS = 12_000
#: Toxic training rows that an entry of the lexicon is in at least, and how many times as frequent it is there.
MIN_DOCUMENTS, MIN_RATIO = 3, 10.0
PREFIX_LENGTHS = (4, 5, 6)
TREES, DEPTH, STEP = 20, 4, 0.25

# Second-person pronouns, common letter substitutions and a few English insults that any training set may lack.
SECOND_PERSON = frozenset("you your yours yourself u ya ye du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes vosotros ti tuyo".split())
SUBSTITUTES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"})
INSULTS = frozenset("idiot idiots stupid moron morons trash loser losers scum disgusting pathetic worthless clown dumb ugly garbage hate kill freak pig fool jerk".split())

FEATURES = (
    "lexicon_density", "lexicon_hits", "lexicon_weight", "lexicon_weighted_density", "lexicon_distinct", "lexicon_cluster", "insult_density", "second_person_density", "second_person_proximity",
    "capital_rate", "shouted_words", "exclamation_rate", "punctuation_rate", "obfuscation_rate", "obfuscated_hits", "stretched_words", "words",
)

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])(?=\S*[\d@$!|+€*])[^\W_][\w@$!|+€*]*[^\W_](?!\w)")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")


_UPPER: list[np.ndarray] = []


def _upper() -> np.ndarray:
    """For each code point whether it is an upper-case character; made once a worker."""
    if not _UPPER:
        _UPPER.append(np.fromiter((chr(c).isupper() for c in range(0x110000)), bool, 0x110000))
    return _UPPER[0]


def dense_features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """The values of FEATURES. Null and empty texts: zeros. ``lexicon`` holds words, and word beginnings that end in ``-``."""
    if not text:
        return [0.0] * len(FEATURES)
    n = len(text)
    cased = _WORD.findall(text)
    words = [w.lower() for w in cased]
    total = max(1, len(words))
    get, known = lexicon.get, {}
    for w in set(words):
        weight = get(w, 0.0)
        for k in PREFIX_LENGTHS:
            if len(w) >= k:
                weight = max(weight, get(w[:k] + "-", 0.0))
        if weight or w in INSULTS:
            known[w] = weight or 1.0
    at = [i for i, w in enumerate(words) if w in known] if known else []
    weights = [known[words[i]] for i in at]
    cluster = 0
    low = 0
    for high, i in enumerate(at):
        while i - at[low] >= 20:
            low += 1
        cluster = max(cluster, high - low + 1)
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = math.inf
    if you and at:
        right = np.searchsorted(a := np.asarray(at), y := np.asarray(you))
        near = int(min(np.abs(a[np.minimum(right, len(a) - 1)] - y).min(), np.abs(a[np.maximum(right - 1, 0)] - y).min()))
    mixed = _MIXED.findall(text)
    unmasked = 0
    for m in mixed:
        w = m.lower().translate(SUBSTITUTES).replace("*", "")
        unmasked += w in INSULTS or get(w, 0.0) > 0 or any(get(w[:k] + "-", 0.0) > 0 for k in PREFIX_LENGTHS)
    letters = max(1, sum(map(len, cased)))
    capitals = int(_upper()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].sum())
    return [
        len(at) / total, math.log1p(len(at)), max(weights, default=0.0), sum(weights) / total, math.log1p(len(known)), float(cluster), sum(w in INSULTS for w in words) / total, len(you) / total, 1.0 / (1.0 + near),
        capitals / letters, sum(len(w) > 1 and w.isupper() for w in cased) / total, (text.count("!") + text.count("?")) / n, sum(map(text.count, ".,;:!?*#%&$|-")) / n, len(mixed) / total, math.log1p(unmasked), sum(1 for _ in _STRETCHED.finditer(text)) / total, math.log1p(len(words)),
    ]


def feature_column(text: Column, lexicon: dict[str, float]) -> Column:
    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([dense_features(t, lexicon) for t in texts])
        release_memory()

    return features(text)


def learn_lexicons(sample: DataFrame, min_documents: int = MIN_DOCUMENTS) -> list[dict[str, float]]:
    """Words and beginnings of ``sample`` (text, label, half) with their log-odds, for those that are at least MIN_RATIO times as
    frequent in toxic rows: of half 0, of half 1 and of both. In each row a term counts once. One aggregation gives all three;
    their size is bounded by that of the sample."""
    sizes = {r["half"]: (r["a"], r["b"]) for r in sample.groupBy("half").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).collect()}
    toxic, clean = ([sizes.get(h, (0, 0))[k] for h in (0, 1)] for k in (0, 1))
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"))

    def beginnings(k: int) -> Column:
        return F.transform(F.filter("words", lambda w: F.length(w) >= k), lambda w: F.concat(F.substring(w, 1, k), F.lit("-")))

    terms = sample.select("label", "half", words.alias("words")).select("label", "half", F.explode(F.array_distinct(F.concat("words", *map(beginnings, PREFIX_LENGTHS)))).alias("term"))
    counts = terms.groupBy("term").agg(*[F.sum(F.when(F.col("half") == h, F.col("label") if k == "a" else 1 - F.col("label")).otherwise(0)).alias(f"{k}{h}") for h in (0, 1) for k in "ab"])
    counts = counts.filter((F.col("term") != "") & (F.col("a0") + F.col("a1") >= min_documents))

    def weight(a: Column, b: Column, n_a: int, n_b: int) -> Column:
        odds = F.log((a + 0.5) / (n_a + 1.0)) - F.log((b + 0.5) / (n_b + 1.0))
        return F.when((a >= min_documents) & (odds >= math.log(MIN_RATIO)), odds)

    weights = [weight(F.col(f"a{h}"), F.col(f"b{h}"), toxic[h], clean[h]) for h in (0, 1)] + [weight(F.col("a0") + F.col("a1"), F.col("b0") + F.col("b1"), sum(toxic), sum(clean))]
    names = ["w0", "w1", "w2"]
    found = counts.select("term", *[w.alias(n) for w, n in zip(weights, names, strict=True)]).filter("w0 is not null or w1 is not null or w2 is not null")
    lexicons: list[dict[str, float]] = [{}, {}, {}]
    for row in found.toLocalIterator():
        for lexicon, n in zip(lexicons, names, strict=True):
            if row[n] is not None:
                lexicon[row["term"]] = row[n]
    return lexicons


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    base_rate: float

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Adds ``score`` (0 to 1) to ``docs``, in place of a column of that name; without fitted trees every row gets the base rate of the labels."""
        bounded_batches(docs.sparkSession)
        if self.trees is None or self.calibration is None:
            return docs.withColumn("score", F.lit(float(self.base_rate)))
        names = [c for c in docs.columns if c != "score"]
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), array_to_vector(feature_column(F.col(f"`{text_col}`"), self.lexicon)).alias("_features"))
        raw = self.trees.transform(rows).select("_row", vector_to_array("probability")[1].alias("_raw"))
        scored = self.calibration.transform(raw.withColumn("_vector", array_to_vector(F.array("_raw"))))
        # a thousandth of the trees' own probability keeps the order within a step of the calibration
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.999 * F.col("_calibrated") + 0.001 * F.col("_raw")))
        return scored.select("_row.*", score.alias("score"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on rows of ``docs`` that ``labels`` (doc_id, toxic) marks and whose crc32(id as text) mod 5 is not 0.

    Null labels and ids don't count; of several labels the greatest holds; rows of ``docs`` that repeat an id count once each.
    Where the rows that grow the trees or those that calibrate them lack a class: a constant model.
    """
    shared_dir(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    marked = labels.filter(F.col("toxic").isNotNull() & (crc32_mod("doc_id", 5) != 0)).groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("label"))
    marked = materialise(marked, "toxicity-labels")
    total = marked.count()
    order = F.pmod(F.xxhash64("_id"), F.lit(1_000_003))
    chosen = materialise(marked.filter(order < max(1, int(1_000_003 * min(1.0, 0.97 * sample_rows / max(1, total))))).limit(sample_rows), "toxicity-chosen")
    part = F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(4))
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "text", "label")
    sample = materialise(rows, "toxicity-sample")
    sums = sample.agg(F.sum("label"), F.count(F.lit(1))).first()
    rate = (sums[0] or 0) / sums[1] if sums[1] else 0.0
    lexicons = learn_lexicons(sample.select("text", "label", (part % 2).alias("half")))
    halves = [
        sample.filter(part % 2 == h).select(part.alias("part"), F.col("label").cast("double").alias("label"), feature_column(F.col("text"), lexicons[1 - h]).alias("features")) for h in (0, 1)
    ]
    features = materialise(halves[0].union(halves[1]).coalesce(4), "toxicity-features").select("part", "label", array_to_vector("features").alias("_features"))
    grown, held = features.filter("part < 3"), features.filter("part = 3")
    if any(rows.agg(F.countDistinct("label")).first()[0] < 2 for rows in (grown, held)):
        return ToxicityModel(lexicons[2], None, None, rate)
    trees = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=11).fit(grown)
    points = trees.transform(held).select("label", array_to_vector(F.array(vector_to_array("probability")[1])).alias("_vector"))
    calibration = IsotonicRegression(featuresCol="_vector", labelCol="label", predictionCol="_calibrated").fit(points)
    return ToxicityModel(lexicons[2], trees, calibration, rate)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, score, predicted`` of every row, repeated rows too. Null text is scored as empty; a null id is not held
    out; other columns are ignored; an empty table gives no rows."""
    model = fit(docs, labels, id_col, text_col)
    scored = model.score(docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("text")))
    return scored.select(
        F.col("_key").alias(id_col), F.coalesce(crc32_mod("_key", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are predicted toxic; columns stay as they are (a column ``score`` of theirs too)."""
    names = docs.columns
    model = fit(docs, labels, id_col, text_col)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col(text_col).alias("_text"))
    return model.score(packed, "_text").filter(F.col("score") < 0.5).select("_doc.*")
