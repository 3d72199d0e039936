"""Brute force, round trips and edge cases of the training-data operators: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns with clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ecoc_langid, exact_dedup, html_extract, order_minhash, packing, quote_threads, sentencepiece_backend, token_sstable, toxicity, vafile_topk
from tidemark.llm.support import byte_level_encoder, scratch_path, tokenizer_file

BPE = tokenizer_file("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, stock=400):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(stock)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every odd value, and columns whose names the operators use themselves."""
    rng = random.Random(7)
    base = words(rng, 300)
    near = base.split()
    near[40] = "changed"
    rows = [(i, words(rng, rng.randrange(1, 200))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \t\n "), (103, "..."), (104, base), (105, base), (106, " ".join(near)), (107, "a b c"), (108, "A  b,\nc"), (109, words(rng, 60_000)), (110, "x" * 50_000), (111, "日本語 テキスト ñandú"), (112, "﻿<|endoftext|> \x00 b"), (None, base), (None, None), (113, "dup row"), (113, "dup row")]
    df = spark.createDataFrame([(i, t, ["en", "de", None][k % 3], "s", 1) for k, (i, t) in enumerate(rows)], DOCS)
    return df.withColumns({c: F.lit("x") for c in ("id", "key", "_id", "score", "features", "component", "size", "prediction", "class_id", "keep_id")})


# --- exact copies


def test_exact_dedup(spark, odd):
    plain = [(r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in odd.collect()]
    groups = {}
    for i, t in plain:
        groups.setdefault(t, []).append(i)
    want = sorted(((i, min([k for k in groups[t] if k is not None], default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in plain), key=str)
    report = exact_dedup.dedup_report(odd).collect()
    assert sorted(((r["doc_id"], r["keep_id"] if r["group_size"] > 1 or r["doc_id"] is not None else None, r["group_size"], r["text_sha256"]) for r in report), key=str) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in report)
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id in (105, 101, 102)").count() == 1
    assert exact_dedup.dedup_report(odd.limit(0)).count() == 0


# --- token ids


def test_encoder_equals_the_library():
    rng = random.Random(3)
    texts = ["", None, " lead", "trail ", "a  b\t c", "<|endoftext|> it's\n\n x", "\x1c a\x85 b", "日本 語　x"] + ["".join(rng.choice("ab1'!.\n \t\x1cé\r") for _ in range(60)) for _ in range(800)]
    e = byte_level_encoder(BPE)
    for _ in range(2):  # the second time from the cache
        for t, ids in zip(texts, e.encode(texts), strict=True):
            assert ids.tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_encoder_with_a_full_cache(monkeypatch):
    from tidemark.llm import support

    monkeypatch.setattr(support, "_CACHE_WORDS", 300)
    monkeypatch.setattr(support, "_SLICE_CHARS", 500)
    rng = random.Random(4)
    e = byte_level_encoder(BPE)
    texts = [words(rng, 60, 40) + " " + words(rng, 40, 10**6) for _ in range(80)]
    for t, ids in zip(texts, e.encode(texts), strict=True):
        assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
    assert 0 < len(e.numbers) < 700


def test_sstable_round_trip(spark, odd):
    e = byte_level_encoder(BPE)
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    n = {}
    for i, t in rows:
        ids = np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        n.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    out = token_sstable.round_trip(odd, BPE).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [i for i, _ in rows]
    at = 0
    for r in out:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in n[r["doc_id"]]
        at += r["n_tokens"]
    assert token_sstable.round_trip(odd.limit(0), BPE).count() == 0


def test_sstable_lookup(spark, tmp_path):
    docs = spark.range(0, 4000, 2).select((F.col("id") - 1000).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    manifest = token_sstable.write_shards(docs, f"file://{tmp_path}/t", BPE, shard_tokens=1500, partitions=3).collect()
    assert len(manifest) > 3
    shards = [token_sstable.Shard(m["path"]) for m in manifest]
    e = byte_level_encoder(BPE)
    for key in (-1000, 0, 998, 2998):
        found = [ids for s in shards for ids in s.lookup(key)]
        assert len(found) == 1 and found[0].tolist() == [*e.tokenizer.encode(f"text {key + 1000}").ids, 0]
    assert not any(s.lookup(k) for s in shards for k in (1, 997, None, 10**12))
    with open(manifest[0]["path"].removeprefix("file://"), "r+b") as f:
        f.seek(-3, 2)
        f.write(b"zz")
    with pytest.raises(ValueError):
        token_sstable.Shard(manifest[0]["path"])


@pytest.mark.parametrize("fill", [True, False])
def test_packing(spark, odd, fill):
    rows = packing.pack(odd.filter("doc_id is not null and doc_id <> 113"), BPE, window=256, fill=fill).collect()
    e = byte_level_encoder(BPE)
    text = {r["doc_id"]: r["text"] for r in odd.collect()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, pieces in by_doc.items():
        ids = np.array([*e.tokenizer.encode(text[i] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= 256 and (not fill or at & (at - 1) == 0)
    assert packing.pack(odd.limit(0), BPE).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 100, 300)
    opened, used = packing.best_fit_decreasing(lengths, 100, fill=False), []
    for n in sorted(lengths.tolist(), reverse=True):
        fit = [i for i, u in enumerate(used) if u + n <= 100]
        if fit:
            used[max(fit, key=lambda i: used[i])] += n
        else:
            used.append(n)
    assert sorted(sum(n for _, _, n in w) for w in opened) == sorted(used)


# --- near copies


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        base = words(rng, rng.randrange(60, 260)).split()
        for _ in range(25):  # a large group of variants, most of them below and some above the threshold
            t = list(base)
            for _ in range(rng.randrange(0, 7)):
                t[rng.randrange(len(t))] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(t))
    texts += [words(rng, 80) + " . " + " ".join(f"common{i}" for i in range(40)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kmers = [order_minhash.labelled_kmers(order_minhash.word_hashes(t)) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if order_minhash.aligned(kmers[i], kmers[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(df).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert order_minhash.drop_near_duplicates(df).count() == len(set(got.values()))


def test_near_duplicate_edges(spark, odd):
    got = {r["doc_id"]: (r["class_id"], r["copy_of"]) for r in order_minhash.near_duplicates(odd).collect()}
    assert got[105] == (104, 104) and got[106] == (104, 106) and got[108] == (107, 107) and got[101] == (100, 100)
    assert got[102] != got[103] and got[None][0] is None and got[109] == (109, 109)
    assert order_minhash.near_duplicates(odd.limit(0)).count() == 0
    assert order_minhash.drop_near_duplicates(odd).columns == odd.columns


def test_alignment_needs_order():
    rng = random.Random(5)
    a = words(rng, 400).split()
    k = lambda w: order_minhash.labelled_kmers(order_minhash.word_hashes(" ".join(w)))
    assert order_minhash.aligned(k(a), k(a[:200] + ["new"] * 3 + a[200:]))
    assert not order_minhash.aligned(k(a), k(a[200:] + a[:200]))  # the same shingles in another order
    assert order_minhash.aligned(k(["x"] * 50), k(["x"] * 48)) and not order_minhash.aligned(k(["x"] * 50), k(["x"] * 10))


# --- pages


def test_html_cases(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies, sorry</div><article><h1>Head &amp; more</h1>"
        "<p>One,  two\n three<br>four<p>Five &lt;six&gt; &#8212; caf&eacute;<form>Name <input></form><script>if (a < b) { x('</p>') }</script><ul><li>seven<li>eight</ul></article>"
        "<div id='comments'><p>I disagree, strongly, with all, of it</p></div><aside>Related, things</aside><footer>Legal</footer></body></html>"
    )
    assert html_extract.main_text(page) == "Head & more\n\nOne, two three four\n\nFive <six> — café\n\nseven\n\neight"
    assert html_extract.main_text("<div class='share-root'><p>All, there is, here</div>") == "All, there is, here"
    rows = [(1, "u", page, "clash"), (2, None, None, "c"), (3, "u", "", "c"), (4, "u", "no tags", "c"), (5, "u", "<p>cut &am", "c"), (5, "u", "<p>cut &am", "c"), (6, "u", "<div>" * 3000 + "deep", "c"), (None, "u", "<b></b>", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    assert len(got) == 8 and [r["text"] for r in got if r["page_id"] in (2, 3)] == ["", ""]
    assert {r["text"] for r in got if r["page_id"] in (4, 5, 6)} == {"no tags", "cut &am", "deep"}
    assert all(r["n_chars"] == len(r["text"]) for r in got) and html_extract.extract(df.limit(0)).count() == 0


def test_pages_of_the_corpus(spark, sf):
    import html as h

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        m = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", r["html"], re.S)
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", m[1])]
        assert html_extract.main_text(r["html"]) == "\n\n".join(b for b in blocks if b)


# --- search


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [rng.normal(size=8).astype(np.float32).tolist() for _ in range(400)] + [[0.5] * 8] * 150
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (1000, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).repartition(4)
    ints = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and i not in (900, 901, 902, 903)}
    for block in (2, 4096):
        got = {}
        for r in vafile_topk.top_k(df, F.col("vec_id") % 100 == 0, query_block=block).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        for q in (0, 100, 200, 300, 400, 500):
            want = sorted(((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q and len(v) == 8))[:10]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
        assert set(got) == {0, 100, 200, 300, 400, 500}
    huge = spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e3, 3.0]), (2, [1e3, 2.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in vafile_topk.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]
    assert vafile_topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# --- classifiers


def test_toxicity(spark, odd):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        t, bad = words(rng, 60).split(), i % 5 == 0
        if bad:
            for _ in range(4):
                t.insert(rng.randrange(len(t)), f"grumbl{rng.choice(['ed', 'ing', 'er', 'o', 'y'])}")
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    scored = toxicity.score_documents(docs, marks).collect()
    held = [r for r in scored if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored) and len(scored) == 900
    assert np.mean([r["predicted"] == (r["doc_id"] % 5 == 0) for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in scored)
    model = toxicity.fit(docs, marks)
    assert any(k.startswith("grumbl") for k in model.lexicon)
    edge = model.score(odd, "text")
    assert edge.count() == odd.count() and edge.filter("score is null").count() == 0
    none = toxicity.score_documents(odd, marks.limit(0))
    assert none.count() == odd.count() and none.filter("predicted = 1").count() == 0
    assert toxicity.drop_toxic(odd, marks.limit(0)).columns == odd.columns
    assert toxicity.score_documents(odd.limit(0), marks).count() == 0


def test_toxicity_never_learns_from_held_out_rows(spark):
    docs = spark.createDataFrame([(i, words(random.Random(i), 30) + (" qqbad" if i % 2 else "")) for i in range(200)], "doc_id long, text string")
    only_held = spark.createDataFrame([(i, i % 2) for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0], "doc_id long, toxic int")
    assert toxicity.fit(docs, only_held).trees is None


def test_language_id(spark, odd):
    rng = random.Random(2)
    alphabets = {"aa": ["ka", "lo", "mi"], "bb": ["tch", "ent", "ung"], "cc": ["ción", "ña", "ar"]}
    rows = [(i, " ".join("".join(rng.choices(alphabets[k], k=rng.randrange(1, 4))) for _ in range(40)), k) for i in range(240) for k in [list(alphabets)[i % 3]]]
    docs = spark.createDataFrame(rows + [(500, "kalo mi", None)], "doc_id long, text string, lang string")
    got = ecoc_langid.identify(docs).collect()
    lang = {i: k for i, _, k in rows} | {500: "aa"}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    model = ecoc_langid.fit(docs)
    edge = {r["doc_id"]: r["prediction"] for r in ecoc_langid.predict(odd, model).collect()}
    assert all(edge[i]["lang_pred"] == "und" and edge[i]["score"] == 0 for i in (100, 101, 102, 103)) and edge[111]["lang_pred"] != "und"
    kept = ecoc_langid.keep_identified(docs.union(spark.createDataFrame([(501, "123 !", "aa"), (502, None, "aa")], docs.schema)))
    assert kept.count() == docs.count() and kept.columns == docs.columns
    assert {r["lang_pred"] for r in ecoc_langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert ecoc_langid.identify(docs.limit(0)).count() == 0


def test_codewords_are_far_apart():
    for k in (2, 3, 4, 6, 9):
        code = ecoc_langid.codewords(k)
        apart = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
        assert len({tuple(c) for c in code.T}) == code.shape[1] if k <= 6 else True
        assert min(apart) >= (1 if k == 2 else 2)


# --- sentencepiece


def test_backend_parity_and_round_trip(spark, odd):
    path = tokenizer_file("piece_bpe_32k.model")
    checked = sentencepiece_backend.verified(odd, path).collect()
    assert len(checked) == odd.count() and all(r["parity"] for r in checked)
    texts = {r["doc_id"]: r["text"] or "" for r in odd.filter("doc_id is not null").collect()}
    back = sentencepiece_backend.decode(sentencepiece_backend.encode(odd.filter("doc_id is not null"), path), path).collect()
    assert all(r["text"] == texts[r["doc_id"]] for r in back if r["doc_id"] != 101)
    assert sentencepiece_backend.verified(odd.limit(0), path).count() == 0
    b = sentencepiece_backend.Backend(path)
    rng = random.Random(6)
    for _ in range(300):
        t = "".join(rng.choice("ab \n▁é日1.") for _ in range(rng.randrange(30)))
        assert next(iter(b.encode([t]))).tolist() == b.own().encode(t)


def test_unigram_models_are_rebuilt():
    model = sentencepiece_backend.ModelFile([("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -1.0, 1), ("▁ab", -0.5, 1)], sentencepiece_backend.UNIGRAM)
    t = sentencepiece_backend.build_tokenizer(model)
    assert t.encode(" ab  ba ").tokens == ["▁ab", "▁", "b", "a"] and t.decode(t.encode("ab ba").ids) == "ab ba"


# --- quotes


def test_quotation_linking(spark):
    rows = [
        ("t", 0, "Hello all\nShall we meet?"), ("t", 1, "> Hello all\n>Shall WE  meet?\nYes, at noon"), ("t", 2, "> > Hello all\n> yes, at noon\n\nGood"), ("t", 3, "> Shall we meet?\nNo"),
        ("t", 4, None), ("t", 5, ""), ("t", 6, "> nobody said this\nHm"), ("u", 0, "Hello all"), ("u", 1, "> Yes, at noon\nother thread"), (None, 1, "> Hello all\nlost"), ("u", None, "x"), ("u", 7, "twice"), ("u", 7, "twice"),
    ]
    df = spark.createDataFrame(rows, "thread string, n long, text string").withColumns({"body": F.lit(1), "root": F.lit(2)})
    got = {(r["thread"], r["n"]): r for r in quote_threads.link_quotations(df, "thread", "n").collect()}
    assert [got["t", k]["parent"] for k in range(7)] == [None, 0, 1, 0, None, None, None]
    assert [got["t", k]["root"] for k in range(7)] == [0, 0, 0, 0, 4, 5, 6] and [got["t", k]["position"] for k in range(4)] == [1, 2, 3, 4]
    assert got["t", 1]["body"] == "Yes, at noon" and got["t", 2]["body"] == "Good" and (got["t", 2]["n_quoted"], got["t", 2]["n_linked"]) == (2, 2)
    assert got["u", 1]["parent"] is None and (got["u", 1]["n_quoted"], got["u", 1]["n_linked"]) == (1, 0) and got[None, 1]["root"] is None
    assert quote_threads.link_quotations(df, "thread", "n").count() == len(rows)
    assert quote_threads.link_quotations(df.limit(0), "thread", "n").count() == 0


def test_scratch_is_below_the_shared_folder(spark):
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
