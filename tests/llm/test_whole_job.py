"""Whole-job cases of round 1's advice."""

import zlib

from tidemark.llm import ecoc_langid, exact_dedup, html_extract, order_minhash, quote_threads, sentencepiece_backend, toxicity
from tidemark.llm.support import tokenizer_file


def test_every_document_is_decoded(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    texts = {1: " two  blanks ", 2: "\x00 \x85 tab\t", 3: "日本語 ñandú 😀", 4: "▁mark", 5: "", 6: None, 7: "<s> <unk> <0x41>", 8: "word " * 30_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    own = sentencepiece_backend.Backend(path).own()
    got = {r["doc_id"]: r for r in sentencepiece_backend.verified(df, path).collect()}
    assert set(got) == set(texts) and all(r["parity"] and r["decode_parity"] for r in got.values())
    assert all(got[i]["text_crc32"] == zlib.crc32(own.decode(own.encode(t or "")).encode()) for i, t in texts.items())
    assert all(got[i]["text_crc32"] == zlib.crc32((t or "").encode()) for i, t in texts.items() if i != 4)


def test_rows_are_dropped_by_row(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    near = a.replace("a30", "z")
    rows = [(3, a, "s"), (5, a, "s"), (5, b, "s"), (6, c, "s"), (6, c, "t"), (None, a, "s"), (None, d, "s"), (None, d, "s"), (7, "e", "s"), (7, "f", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    want = [(3, a), (5, b), (6, c), (7, "e"), (7, "f"), (None, d)]
    for drop in (exact_dedup.drop_exact_duplicates, order_minhash.drop_near_duplicates):
        kept = drop(df)
        assert kept.columns == df.columns and sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)
    more = df.union(spark.createDataFrame([(5, near, "s"), (None, near, "s")], df.schema))
    assert sorted(((r["doc_id"], r["text"]) for r in order_minhash.drop_near_duplicates(more).collect()), key=str) == sorted(want, key=str)


def test_texts_with_letters_stay_without_a_model(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    texts = ["plain words", "é", "日本", "12 34 !", "", None]
    for lang in ("en", None):  # every labelled row held out; no label at all
        df = spark.createDataFrame([(i, t, lang) for i, t in zip(held, texts, strict=False)], "doc_id long, text string, lang string")
        assert ecoc_langid.fit(df) is None
        kept = ecoc_langid.keep_identified(df)
        assert kept.columns == df.columns and {r["text"] for r in kept.collect()} == set(texts[:3])


def test_every_conversation_row_is_a_mail(spark):
    rows = [("c", 0, "first"), ("c", 1, "b"), ("c", 1, "a"), ("c", 1, "a"), ("c", 2, "last"), ("c", None, "no turn"), (None, 1, "no thread"), (None, None, None)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, text string")
    mails = quote_threads.as_mail(df)
    assert sorted(r["text"] for r in mails.collect()) == sorted(["first", *(f"\n> first\n{t}" for t in "baa"), "\n> > first\n\n> a\nlast", "no turn", "no thread", ""])
    got = quote_threads.link_quotations(mails, "conv_id", "turn").collect()
    assert sorted(str((r["conv_id"], r["turn"], r["body"])) for r in got) == sorted(str((c, n, t or "")) for c, n, t in rows)
    assert {r["turn"]: r["parent"] for r in got if r["conv_id"]} == {0: None, 1: 0, 2: 1, None: None}


def test_names_cut_only_what_structure_calls_clutter():
    long = [" ".join(f"{k}{i}," for i in range(60)) for k in "abcdef"]
    p = [f"<p>{t}</p>" for t in long]
    footer = "<div><p>Made by us, here, in town</p></div>"
    cut = "<div class='related'><a href=x>More of this kind that is all in one link</a></div><div class='share'>Tell a friend</div>"
    sections = f"<h2 id='discussion'>Talk</h2>{p[0]}<section id='related-work'><h2 class='header'>Work</h2>{p[1]}</section>{cut}{p[2]}"
    want = ["Talk", long[0], "Work", long[1], long[2]]
    for page in (f"<body><article>{sections}</article>{footer}</body>", f"<body><div id='post'>{sections}</div>{footer}</body>"):
        assert html_extract.main_text(page).split("\n\n") == want
    for name in ("content with-sidebar", "has-comments"):
        assert html_extract.main_text(f"<body><div class='{name}'>{p[0]}{cut}{p[1]}</div>{footer}</body>").split("\n\n") == long[:2]
    comments = f"<div id='comments'>{''.join(p[2:])}</div>"
    assert html_extract.main_text(f"<body><article>{p[0]}{p[1]}</article>{comments}</body>").split("\n\n") == long[:2]


def test_blocks_between_kept_siblings_stay():
    one, two = (" ".join(f"{k}{i}," for i in range(60)) for k in "ab")
    a, b = f"<div><p>{one}</p><p>{one}</p></div>", f"<div>{f'<p>{two}</p>' * 6}</div>"
    between = "<h3>Head</h3><ul><li>one<li>two</ul><table><tr><td>cell</table><pre>code</pre><blockquote>said</blockquote><p>short</p><ul><li><a href=x>link</a></ul>"
    page = f"<body><p>before</p>{a}{between}{b}<p>after</p></body>"
    assert html_extract.main_text(page).split("\n\n") == [one, one, "Head", "one", "two", "cell", "code", "said", "short", *[two] * 6]


def test_capitals_count_alike_at_every_length():
    for word in ("ΑΒΓΔ ", "ДОМ ", "ÉÀÜab ", "Word "):
        short, long = (toxicity.dense_features(word * k, {}) for k in (100, 2000))
        rate = sum(map(str.isupper, word)) / len(word.strip())
        assert short[9] == long[9] == rate
