"""The word caches of the token files."""

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tilequarry.llm import tokenfile


@pytest.mark.parametrize("odd", ["", " 東京 <pad> ǅ don't"])
def test_frequent_words_outlive_a_full_cache(monkeypatch, odd):
    """Rare words fill the cache again and again; a word of every text is learnt once, and all ids stay the library's."""
    monkeypatch.setattr(tokenfile, "CACHE_WORDS", 50)
    t, library = tokenfile.Tokens(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    learnt, learn = [], t.learn
    monkeypatch.setattr(t, "learn", lambda words: (learnt.extend(words), learn(words)))
    for i in range(40):
        texts = [f"always Écrit été, 12 re{i}x{j} q{i * j % 97}ÿ{odd}" for j in range(10)] + ["", " \n"]
        assert [np.frombuffer(b, "<i4").tolist() for b in t.encode(texts)] == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        assert max(len(t.known), len(t.parts)) < 50 + 100
    assert learnt.count(b"always") == 1 and learnt.count("été,".encode()) == 1


def test_letters_of_two_bytes_equal_the_library():
    """Pre-tokens go to the tokenizer's model alone, so the signs of their bytes must be its own."""
    t, library = tokenfile.Tokens(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert t.cuts
    letters = "".join(map(chr, range(0xC0, 0x100)))
    texts = [letters, *(f"a{x}b{x.upper()} {x}" for x in letters), "!#$%&'()*+,-./:;=>?@[]^_`{|}~ \"\\"]
    assert [np.frombuffer(b, "<i4").tolist() for b in t.encode(texts)] == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
