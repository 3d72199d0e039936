"""Classifiers against plain versions: features recounted, decoding against every codeword, what a prediction decides."""

import random
import zlib

import numpy as np
import pytest

from tidemark.llm import ecoc_langid, toxicity

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["tch", "ent", "ung", "ich"], "cc": ["ción", "ña", "ar", "os"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, k, 60), k) for i in range(300) for k in [list(SYLLABLES)[i % 3]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rng


def test_ngrams_are_counted_plainly():
    text = "Ab,  ba\nÉab 12 c"
    plain = " ab ba éab c "
    hashed = {}
    for n in (1, 2, 3):
        grams = [plain[i : i + n] for i in range(len(plain) - n + 1)]
        for g in set(grams):
            alone = ecoc_langid.ngram_shares(g.strip() or "x", 1 << 16) if n == 1 and g.strip() else None
            if alone is not None:  # a letter's own bucket is that of the text that holds it alone
                top = np.flatnonzero(alone[0] > 1 / 9 - 1e-12)
                hashed[g] = (top, grams.count(g) / len(grams) / 3)
    shares, n = ecoc_langid.ngram_shares(text, 1 << 16)
    assert n == len(plain) and abs(shares.sum() - 1) < 1e-12
    for places, share in hashed.values():
        assert any(abs(shares[p] - share) < 1e-9 for p in places)


def test_decoding_against_every_codeword(spark, languages):
    docs, rng = languages
    model = ecoc_langid.fit(docs)
    for k in [*SYLLABLES] * 20:
        x, n = ecoc_langid.ngram_shares(prose(rng, k, rng.randrange(1, 30)))
        bits = [(sum(x[g] * model.weights[g, b] for g in np.flatnonzero(x)) - model.middle[b]) * model.gap[b] / (model.spread[0, b] + model.spread[1, b] / n) for b in range(model.code.shape[1])]
        loss = [sum(model.trust[c, b] * np.log1p(np.exp(-model.code[c, b] * m)) for b, m in enumerate(bits)) * len(bits) / 2 for c in range(3)]
        p = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        lang, score, ambiguous, _ = model.decode(x, n)
        assert lang == model.languages[int(np.argmin(loss))] and abs(score - p.max()) < 1e-9
        assert ambiguous == (np.sort(p)[-1] - np.sort(p)[-2] < ecoc_langid.AMBIGUOUS_LEAD)


def test_the_prediction_decides(spark, languages):
    docs, rng = languages
    one, two = prose(rng, "aa", 200).split(), prose(rng, "bb", 200).split()
    mixed = [" ".join(a if rng.random() < i / 40 else b for a, b in zip(one, two, strict=True)) for i in range(41)]
    more = spark.createDataFrame([*((1000 + i, t, "aa") for i, t in enumerate(mixed)), *((2000 + i, t[:100], "aa") for i, t in enumerate(mixed))], docs.schema)
    kept = {r["doc_id"] for r in ecoc_langid.keep_identified(docs.union(more)).collect()}
    assert kept >= set(range(300)) | set(range(2000, 2041)) | {*range(1000, 1008), *range(1033, 1041)}
    dropped = set(range(1000, 1041)) - kept  # about half in one language and half in another, and long enough to tell
    assert 0 < len(dropped) < 10
    some = {r["doc_id"] for r in ecoc_langid.keep_identified(docs, languages=["aa"]).collect()}
    assert some == {i for i in range(300) if i % 3 == 0}


def test_every_language_is_learned(spark):
    """230 of them, each of a few syllables of its own and shared letters."""
    rng = random.Random(11)
    syllables = {f"l{k:03d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 4))) for _ in range(12)] for k in range(230)}
    text = lambda k, n: " ".join("".join(rng.choices(syllables[k], k=rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(k, 60), k) for i, k in enumerate(list(syllables) * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = ecoc_langid.fit(docs)
    assert model.languages == sorted(syllables)
    got = [(model.decode(*ecoc_langid.ngram_shares(text(k, 60)))[0], k) for k in syllables]
    assert sum(p == k for p, k in got) == 230


def test_mixed_texts_at_every_length(spark):
    """Planted bilingual texts (half a text in each language) and clean ones of the tables: none of the clean ones is lost, and nearly
    all bilingual ones are found once there are letters enough to tell."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = ecoc_langid.fit(docs)
    rng = random.Random(12)
    held = docs.filter("lang is not null and crc32(cast(doc_id as string)) % 3 = 1 and length(text) > 400").select("lang", "text").collect()
    pools = {}
    for r in held:
        pools.setdefault(r["lang"], []).extend(r["text"].split())

    def words(lang, letters):
        at = rng.randrange(max(1, len(pools[lang]) - letters))
        out = pools[lang][at : at + letters]
        return " ".join(out)[:letters]

    clean, found, planted = 0, {}, 0
    for letters in (20, 60, 120, 250, 500, 1000, 4000, 20_000):
        for _ in range(60):
            one, two = rng.sample(sorted(pools), 2)
            clean += model.decode(*ecoc_langid.ngram_shares(words(one, letters)))[3]
            mixed = model.decode(*ecoc_langid.ngram_shares(words(one, letters // 2) + " " + words(two, letters // 2)))[3]
            found[letters] = found.get(letters, 0) + mixed / 60
            planted += mixed
    print("recall by length", {k: round(v, 2) for k, v in found.items()}, "precision", planted / max(1, planted + clean))
    assert clean <= 0.01 * 480 and planted >= 0.97 * (planted + clean) and found[20_000] > 0.4 and found[250] > 0.2
    assert all(a <= b + 0.35 for a, b in zip(list(found.values()), list(found.values())[1:], strict=False))


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_held_out_rows_of_the_tables(spark, table):
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    got = ecoc_langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    assert got.filter("lang = lang_pred").count() >= 0.99 * got.count()


def test_toxic_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_documents(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out and toxic is not null").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    assert got[got.toxic == 1]["predicted"].mean() >= 0.85 and got[got.toxic == 0]["predicted"].mean() <= 0.01


def test_features_are_recounted():
    lexicon = {"vile": 2.0, "grum-": 3.0, "x": 1.0}
    text = "You vile GRUMBLER!! 1d10t sooo grumbled, you are $c*m x x"
    words = ["you", "vile", "grumbler", "d", "t", "sooo", "grumbled", "you", "are", "c", "m", "x", "x"]
    f = dict(zip(toxicity.FEATURES, toxicity.dense_features(text, lexicon), strict=True))
    hits = [i for i, w in enumerate(words) if w in ("vile", "x") or w.startswith("grum")]
    assert f["lexicon_density"] == len(hits) / len(words) and f["lexicon_weight"] == 3.0 and f["lexicon_weighted_density"] == (2 + 3 + 3 + 1 + 1) / len(words)
    assert f["lexicon_hits"] == np.log1p(5) and f["lexicon_distinct"] == np.log1p(4) and f["lexicon_cluster"] == 5
    assert f["second_person_density"] == 2 / len(words) and f["second_person_proximity"] == 1 / 2 and f["words"] == np.log1p(13)
    assert f["shouted_words"] == 1 / len(words) and f["exclamation_rate"] == 2 / len(text) and f["stretched_words"] == 1 / len(words)
    assert f["obfuscated_hits"] == np.log1p(2) and f["capital_rate"] == sum(map(str.isupper, text)) / sum(map(str.isalpha, text))


def pooled(points):
    """Plain pool-adjacent-violators: value of each point, in order."""
    blocks = []
    for _, y in sorted(points):
        blocks.append([y, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1]])
    return [v for v, n in blocks for _ in range(n)]


def test_calibration_is_isotonic_on_rows_that_the_trees_have_not_seen(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression
    from pyspark.sql import functions as F

    rng = random.Random(3)
    points = [(i / 60, float(rng.random() < i / 60)) for i in range(60)]
    rows = spark.createDataFrame(points, "x double, label double").withColumn("_vector", array_to_vector(F.array("x")))
    got = [r["p"] for r in IsotonicRegression(featuresCol="_vector", labelCol="label", predictionCol="p").fit(rows).transform(rows).orderBy("x").collect()]
    assert np.allclose(got, pooled(points))


def test_lexicons_of_halves_and_of_all(spark):
    rows = [(f"foo{'bad' if y else 'good'} common w{i % 7}", y, i % 2) for i in range(40) for y in [int(i % 4 < 2)]]
    sample = spark.createDataFrame(rows, "text string, label int, half int")
    counts = [[sum(1 for t, y, h in rows if y == k and h in halves) for k in (1, 0)] for halves in ((0,), (1,), (0, 1))]
    for lexicon, (a, b) in zip(toxicity.learn_lexicons(sample), counts, strict=True):
        weight = np.log((a + 0.5) / (a + 1.0)) - np.log(0.5 / (b + 1.0))
        assert lexicon == pytest.approx(dict.fromkeys(["foobad", "foob-", "fooba-", "foobad-"], weight))
