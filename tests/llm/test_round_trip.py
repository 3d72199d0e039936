"""Texts that are decoded word by word are those that the library decodes from a text's whole ids."""

import random

import pytest

from tidemark.llm import sentencepiece_backend, support
from tidemark.llm.support import tokenizer_file


@pytest.mark.parametrize("known", [40, 300_000])
def test_words_are_decoded_once_and_texts_are_those_of_their_whole_ids(monkeypatch, known):
    monkeypatch.setattr(support, "_CACHE_WORDS", known)
    monkeypatch.setattr(support, "_SLICE_CHARS", 500)
    b = sentencepiece_backend.Backend(tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé日本😀́\t<0x41>.\x00ﬁ") for _ in range(rng.randrange(1, 9))) + "z" for _ in range(60)]
    plain = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(200)] + ["", None, "word", "日本 😀 �"]
    odd = ["two  blanks", " first", "last ", "line \n and line", "a ▁ b", "▁", " ", "\n"]
    want = [b.tokenizer.encode(t or "", add_special_tokens=False).ids for t in plain + odd]
    texts = [b.tokenizer.decode(ids, skip_special_tokens=False) for ids in want]
    asked, decode = [], b.decode
    b.words.spoken = b.decode = lambda lists: asked.extend(lists) or decode(lists)
    have = list(b.round_trip(plain + odd))
    assert [x.tolist() for x, _ in have] == want and [t for _, t in have] == texts == [b.own().decode(ids) for ids in want]
    if known > 40:
        assert len(asked) <= len({w for t in plain + odd for w in (t or "").split(" ")}) + len(odd)
