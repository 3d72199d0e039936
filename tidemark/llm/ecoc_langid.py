"""Language identification by error-correcting output codes over hashed character n-grams.

Each bit of a codeword is predicted by a binary classifier: the mean log-ratio of a text's n-grams between the languages on
either side of the bit, scaled by how far such means scatter in texts of that length. The n-gram counts are one aggregation
over a bounded sample, the scales and the weight of each bit another one over a part of it that the counts leave out.
Loss-weighted decoding chooses the nearest codeword, and a small lead over the second is flagged as ambiguous.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import bounded_batches, broadcast_if_small, crc32_mod, materialise, release_memory, shared_dir

#: Training documents of each language, at most about (chosen by a hash of the id). Every language is learned.
SAMPLE_PER_LANGUAGE = 2000
BUCKETS = 8192
#: N-grams that a training document counts for at most, and what each bucket counts besides.
DOCUMENT_WEIGHT, SMOOTHING = 1000.0, 0.5
#: Lengths of the windows that stand for short texts where scales are measured.
WINDOWS = (160, 60, 24)
#: A lead of the best probability over the second below this is ambiguous.
AMBIGUOUS_LEAD = 0.2
#: A text is mixed if it lies less than this share of the way from the middle between two codewords to the nearer one, and that is so
#: many deviations off where texts of its length lie.
MIXED_LEAD, MIXED_DEVIATIONS = 0.05, 3.0
#: At so many letters a text's place varies by chance as much as it does at any length; and the middle of squared deviations, in variances.
SHORT_LETTERS, HALF_OF_SQUARES = 100.0, 0.455
UNDETERMINED = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; made once a worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngram_shares(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, int] | None:
    """Shares of hashed 1-, 2- and 3-grams of lower-case letters and word ends, and how many letters and word ends there are;
    None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    isletter = _letters()[points]
    if not isletter.any():
        return None
    c = np.where(isletter, points, 32).astype(np.uint32)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = np.concatenate([[32], c[keep], [32]]).astype(np.uint32)
    one = c * np.uint32(2654435761)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(2246822519) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(3266489917) + one[2:]
    out = np.zeros(buckets)
    for order, h in enumerate((one, two, three)):
        h = h ^ (h >> np.uint32(16)) ^ np.uint32(order * 977)
        out += np.bincount(h % np.uint32(buckets), minlength=buckets) / len(h)
    return out / 3, len(c)


def has_letter(texts: pd.Series) -> pd.Series:
    """Whether a text has a letter, as ``ngram_shares`` needs one."""
    return texts.map(lambda t: bool(t) and bool(_letters()[np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)].any())).astype(bool)


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k rows of -1 and 1. Up to six classes: all columns that split them (first row 1); more: of random codes of
    10 log2(k) columns the one whose closest rows lie farthest apart."""
    if k <= 6:
        columns = [(1, *bits) for bits in itertools.product((1, -1), repeat=k - 1)][1:]
        return np.array(columns, np.int8).T.reshape(k, -1)
    rng, best, reach = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (k, math.ceil(10 * math.log2(k))))
        code = code[:, np.abs(code.sum(0, dtype=np.int64)) < k]
        whole = code.astype(np.float32)
        alike = whole @ whole.T
        np.fill_diagonal(alike, -np.inf)
        apart = int(code.shape[1] - alike.max()) // 2
        if apart > reach:
            best, reach = code, apart
    return best


def bit_weights(shares: Callable[[], Iterator[np.ndarray]], code: np.ndarray) -> np.ndarray:
    """Buckets x bits: log-ratio of the mean n-gram shares on either side of each bit. ``shares`` gives those of one language after
    the other, so that sums of bits are held and not all languages."""
    sides = np.zeros((2, code.shape[1], BUCKETS))
    for row, share in zip(code, shares(), strict=True):
        sides[0][row > 0] += share
        sides[1][row < 0] += share
    return np.log(sides[0] / (code > 0).sum(0)[:, None]).T - np.log(sides[1] / (code < 0).sum(0)[:, None]).T


@dataclass
class LanguageModel:
    """``code``: languages x bits; ``weights``: buckets x bits; ``middle``, ``gap``: for each bit the point half-way between the
    means of its sides, and how far these are apart; ``spread``: for each bit the variance of a long text and what 1 / length
    adds to it; ``trust``: weight of each bit for each language, each language's sum 1; ``off``: how far long texts of one language
    lie off its codeword (mean square, of the share that half of them keep within)."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    middle: np.ndarray
    gap: np.ndarray
    spread: np.ndarray
    trust: np.ndarray
    off: float

    def margins(self, x: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of each bit for a text of n letters and word ends."""
        return (x @ self.weights - self.middle) * self.gap / (self.spread[0] + self.spread[1] / n)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each language's codeword."""
        return (self.trust * np.logaddexp(0.0, -self.code * margins)).sum(1) * self.code.shape[1] / 2

    def lead(self, margins: np.ndarray) -> tuple[int, float, float]:
        """Place of the nearest language, its probability, and how far that is above the next one's."""
        loss = self.losses(margins)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best, second = np.argsort(-p, kind="stable")[:2]
        return int(best), float(p[best]), float(p[best] - p[second])

    def decode(self, x: np.ndarray, n: int) -> tuple[str, float, bool, bool]:
        """Language, probability, whether it is ambiguous, and whether the text is mixed: between two codewords, where texts of its
        length don't lie by chance."""
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False, False
        best, p, lead = self.lead(self.margins(x, n))
        return self.languages[best], p, lead < AMBIGUOUS_LEAD, self.mixed(x, n, best)

    def mixed(self, x: np.ndarray, n: int, best: int) -> bool:
        """Whether the text lies in the middle between the codeword of ``best`` and another's, farther from its own than texts of its
        length do by chance."""
        place = float(places(x @ self.weights, best, self.code, self.middle, self.gap, self.trust)[0])
        return place < MIXED_LEAD and 1 - place > MIXED_DEVIATIONS * math.sqrt(self.off * (1 + SHORT_LETTERS / n))


def places(z: np.ndarray, k: int, code: np.ndarray, middle: np.ndarray, gap: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """Where points lie between the codeword of language k (1) and the middle to another's (0), for the nearest other."""
    apart = trust[k] * code[k] * (1 - code[k] * code) / 2  # where the codewords differ
    apart = np.delete(apart / np.maximum(apart @ code[k], 1e-9)[:, None], k, axis=0)
    return (((np.atleast_2d(z) - middle) / (gap / 2)) @ apart.T).min(1)


def views(text: str) -> list[str]:
    """The whole text and some short windows of it."""
    cuts = [text]
    for i, n in enumerate(WINDOWS):
        if len(text) > 2 * n:
            at = (len(text) - n) * (2 * i + 1) // (2 * len(WINDOWS))
            cuts.append(text[at : at + n])
    return cuts


def _count(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for batch in rows:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            if (found := ngram_shares(text)) is not None:
                x, n = found
                sums[lang] = sums.get(lang, 0.0) + x * min(float(n), DOCUMENT_WEIGHT)
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "total": total[at]})
    release_memory()


def scales(held: DataFrame, languages: list[str], shares: Callable[[], Iterator[np.ndarray]], code: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """``middle, gap, spread, trust, off`` of a model, measured on texts (lang, text) that its counts have not seen. A language
    without such a text gets the means that its own n-grams give, and trust 1."""
    place = {c: i for i, c in enumerate(languages)}

    def project(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            out = []
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                if lang in place:
                    out += [(place[lang], found[1], (found[0] @ weights).tolist()) for v in views(text) if (found := ngram_shares(v)) is not None]
            yield pd.DataFrame(out, columns=["k", "n", "z"])
        release_memory()

    k_languages, bits = code.shape
    projected = materialise(held.mapInPandas(project, "k int, n int, z array<double>"), "langid-points")
    points = projected.select("k", "n", F.posexplode("z").alias("b", "z"))
    means = np.stack([share @ weights for share in shares()])
    for r in points.groupBy("k", "b").agg(F.percentile_approx("z", 0.5, 1000).alias("m")).collect():  # languages x bits; the middle, as some labels may be wrong
        means[r["k"], r["b"]] = r["m"]
    high = (means * (code > 0)).sum(0) / (code > 0).sum(0)
    low = (means * (code < 0)).sum(0) / (code < 0).sum(0)
    middle, gap = (high + low) / 2, np.maximum(high - low, 1e-9)
    sides = held.sparkSession.createDataFrame([(k, b, float(means[k, b]), float(middle[b]), bool(code[k, b] > 0)) for k in range(k_languages) for b in range(bits)], "k int, b int, mean double, middle double, positive boolean")
    short, off = 1.0 / F.col("n"), (F.col("z") - F.col("mean")) * (F.col("z") - F.col("mean"))
    sums = points.join(F.broadcast(sides), ["k", "b"]).groupBy("k", "b").agg(
        F.count(F.lit(1)).alias("n"), F.sum(short).alias("u"), F.sum(short * short).alias("uu"), F.sum(off).alias("v"), F.sum(off * short).alias("uv"), F.avg(((F.col("z") > F.col("middle")) == F.col("positive")).cast("double")).alias("hit"),
    )
    trust, total = np.ones(code.shape), np.zeros((bits, 5))
    for r in sums.collect():
        trust[r["k"], r["b"]] = r["hit"]
        total[r["b"]] += (r["n"], r["u"], r["uu"], r["v"], r["uv"])

    def line(n, u, uu, v, uv):
        """Least squares of v on u = 1 / length, neither part below 0."""
        slope = np.maximum((n * uv - u * v) / np.maximum(n * uu - u * u, 1e-12), 0.0)
        return np.maximum((v - slope * u) / np.maximum(n, 1), 0.0), slope

    floor, slope = line(*total.T)
    trust = trust / np.maximum(trust.sum(1, keepdims=True), 1e-9)

    def placed(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for k, own in batch.groupby("k"):
                yield pd.DataFrame({"n": own["n"], "off": (1 - places(np.stack(own["z"].to_list()), int(k), code, middle, gap, trust)) ** 2})

    usual = F.percentile_approx(F.col("off") / (1 + SHORT_LETTERS / F.col("n")), 0.5, 1000)  # half the texts may be anything
    half = projected.mapInPandas(placed, "n int, off double").agg(usual).first()[0]
    off = 0.01 + (1.0 if half is None else half / HALF_OF_SQUARES)
    spread = np.stack([floor + (0.1 * gap) ** 2 + (total[:, 0] == 0) * gap**2, slope])
    return middle, gap, spread, trust, off


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel | None:
    """Fit on rows whose crc32(id as text) mod 3 is not 1 and whose language is known; None if there is no such row with a
    letter. Rows that repeat an id share its fate in the sample and count once each."""
    spark = docs.sparkSession
    shared_dir(spark)
    bounded_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc32_mod("_id", 3) != 1))
    share = (1_000_003 * F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count"))).cast("long") + 1
    known = materialise(rows.groupBy("lang").count().select("lang", share.alias("_share")), "langid-languages")
    place = F.pmod(F.xxhash64("_id"), F.lit(1_000_003))
    part = F.pmod(F.xxhash64(F.lit(2), "_id"), F.lit(4))
    sample = materialise(rows.join(broadcast_if_small(known), "lang").filter(place < F.col("_share")).select("lang", "text", part.alias("part")), "langid-sample")
    counts = sample.filter("part < 3").select("lang", "text").mapInPandas(_count, "lang string, bucket int, total double").groupBy("lang", "bucket").agg(F.sum("total").alias("total"))
    profiles = materialise(counts.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("total").alias("totals")).orderBy("lang"), "langid-profiles")
    languages = sorted(r["lang"] for r in profiles.select("lang").collect())  # names only
    if not languages:
        return None

    def shares() -> Iterator[np.ndarray]:
        """N-gram shares of each language, in order, one at a time."""
        for r in profiles.orderBy("lang").toLocalIterator():
            out = np.full(BUCKETS, SMOOTHING)
            out[np.array(r["buckets"], np.int64)] += np.array(r["totals"])
            yield out / out.sum()

    code = codewords(len(languages)).astype(float)
    if len(languages) == 1:
        none = np.zeros(0)
        return LanguageModel(languages, code, np.zeros((BUCKETS, 0)), none, none, np.zeros((2, 0)), code, 1.0)
    weights = bit_weights(shares, code)
    return LanguageModel(languages, code, weights, *scales(sample.filter("part = 3").select("lang", "text"), languages, shares, code, weights))


def predict(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """Adds ``prediction`` (lang_pred, score, ambiguous, mixed) to ``docs``: `und` with score 0 for null texts and texts without a
    letter, and for all texts if nothing could be learned. ``mixed``: between two languages."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean, mixed boolean")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                found = ngram_shares(text) if model else None
                rows.append((UNDETERMINED, 0.0, False, False) if found is None else model.decode(*found))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "ambiguous", "mixed"]).astype({"lang_pred": object, "score": float, "ambiguous": bool, "mixed": bool})
        release_memory()

    return docs.withColumn("prediction", guess(F.col(f"`{text_col}`")))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id, held_out, lang_pred, score, ambiguous, mixed`` of every row, repeated rows too; a null id is not held out; an
    empty table gives no rows; other columns are ignored."""
    model = fit(docs, id_col, text_col, lang_col)
    rows = predict(docs.select(F.col(f"`{id_col}`").alias("_key"), F.col(f"`{text_col}`").alias("text")), model)
    return rows.select(F.col("_key").alias(id_col), F.coalesce(crc32_mod("_key", 3) == 1, F.lit(False)).alias("held_out"), "prediction.*")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: list[str] | None = None) -> DataFrame:
    """``docs`` without rows whose language is undetermined or, if ``languages`` are named, another; columns stay as they are.

    Undetermined: null texts, texts without a letter, and mixed texts, half-way between two languages and many deviations off where
    texts of their length lie (one rule for every length). Ambiguous texts that chance can put there stay: shortness is no
    reason to lose a clean document. Nor are languages that the model can't tell apart, or a missing model: where nothing could
    be learned, every text with a letter stays.
    """
    model = fit(docs, id_col, text_col, lang_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{text_col}`").alias("_text"))
    if model is None:
        return rows.filter(F.pandas_udf(has_letter, "boolean")("_text")).select("_doc.*")
    p = F.col("prediction")
    known = (p["lang_pred"] != UNDETERMINED) & ~p["mixed"]
    return predict(rows, model, "_text").filter(known & p["lang_pred"].isin(languages) if languages else known).select("_doc.*")
