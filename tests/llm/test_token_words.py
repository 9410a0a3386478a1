"""Words of the token files: their numbers, and frames in which repeated words are symbols."""

import random

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tilequarry.llm import tokenfile

SIGNS = "aabbczZÄßéÀ×÷ÿ'’sdtmlvre09½ªµİ<|>.,#$-日́\x00\x1c\x7f   \t\n\r\x0b\x0c"


def random_texts(seed: int, n: int = 1500) -> list[str]:
    r = random.Random(seed)
    out = ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return [*out, "", " ", "\n\n", "x" * 24, "x" * 25, "é" * 12, "é" * 13, "!" * 40 + "a" * 100 + "1" * 30, "<|endoftext|>a", "don't 'sa ''s a'b", "é", "Ab" * 5000]


def frames_of(texts: list[str], w: tokenfile.Words) -> list[tuple[bytes, int]]:
    return list(tokenfile.cut_frames(iter([pd.DataFrame({"doc_id": range(len(texts)), "text": texts})]), w))


@pytest.mark.parametrize("path, most, frame", [("word_bpe_49k.json", 600_000, 4_000_000), ("word_bpe_49k.json", 400, 3000)])
def test_frames_hold_the_ids_of_the_library(monkeypatch, path, most, frame):
    """Words of all kinds, also when numbers are forgotten and frames are short."""
    monkeypatch.setattr(tokenfile.Words, "MOST", most)
    monkeypatch.setattr(tokenfile, "FRAME_WORDS", frame)
    library, w = Tokenizer.from_file(P.path(path)), tokenfile.Words(tokenfile.Tokens(P.path(path)))
    assert w.t.cuts
    for seed in range(3):
        texts = random_texts(seed) + [None]
        want = [[*e.ids, tokenfile.END_ID] for e in library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        got, keys = [], []
        for data, n in frames_of(texts, w):
            k, lengths, ids = tokenfile.read_frame(data)
            assert n == len(ids)
            ends = np.cumsum(lengths)
            got += [ids[e - m : e].tolist() for e, m in zip(ends.tolist(), lengths, strict=True)]
            keys += k
        assert got == want and keys == list(range(len(texts)))
    assert w.n < 30_000


def test_repeated_words_are_one_symbol(monkeypatch):
    """The coder takes a step for a repeated word, not for each of its ids, and every word is spelled that is not repeated."""
    steps, encode = [], tokenfile.encode_blocks
    monkeypatch.setattr(tokenfile, "encode_blocks", lambda symbols, places: (steps.append(len(symbols)), encode(symbols, places))[1])
    w = tokenfile.Words(tokenfile.Tokens(P.path("word_bpe_49k.json")))
    r = random.Random(1)
    rare = ["".join(r.choice("qxzjkw") for _ in range(12)) for _ in range(50)]
    often = [x[::-1] + "q" for x in rare]
    ((data, n),) = frames_of([" ".join([*rare, *often, *often])], w)
    spelled = [len(w.t.tokenizer.encode(x, add_special_tokens=False).ids) for x in rare]
    assert steps == [sum(spelled) + 2 * len(often) + 1] and n > 2 * len(often) * 3
    assert tokenfile.read_frame(data)[2].tolist() == [*w.t.tokenizer.encode(" ".join([*rare, *often, *often]), add_special_tokens=False).ids, 2]


def test_a_word_is_encoded_once(monkeypatch):
    """Over batches, frames and forgetting, words that come again go to the tokenizer once."""
    monkeypatch.setattr(tokenfile.Words, "MOST", 300)
    w = tokenfile.Words(tokenfile.Tokens(P.path("word_bpe_49k.json")))
    asked, joined = [], w.t.joined_ids
    monkeypatch.setattr(w.t, "joined_ids", lambda parts: (asked.extend(parts), joined(parts))[1])
    for i in range(20):
        frames_of([f"Always été, x{'abcdefghij'[i % 10]}{i:b}{'q' * j} always" for j in range(20)], w)
    assert asked.count("always") == 1 and asked.count("été") == 1


@pytest.mark.parametrize("symbols", [np.zeros(5000, int), np.arange(200_000) % 150_000, np.r_[np.arange(1 << 19), np.zeros(3000, int)], np.array([3])])
def test_places_hold_every_symbol(symbols):
    """Order 0 has room for every symbol, whatever the frequencies, and blocks come back."""
    times = np.bincount(symbols)
    ranked = np.argsort(-times, kind="stable")[: np.count_nonzero(times)]
    rank = np.zeros(len(times), np.int32)
    rank[ranked] = np.arange(len(ranked))
    places = tokenfile.Places(tokenfile.Places.widths(times[ranked]))
    ends = places.start.astype(np.int64) + (1 << places.bits.astype(np.int64))
    assert (ends[:-1] <= places.start[1:]).all() and ends[-1] <= tokenfile.ZERO_ONE
    some = rank[symbols][:: max(1, len(symbols) // 50_000)]
    assert (tokenfile.decode_blocks(tokenfile.encode_blocks(some, places), len(some), places) == some).all()


def test_carries_reach_written_digits():
    """A symbol at the top of the range again and again makes carries run through digits of ones."""
    r = np.random.default_rng(5)
    symbols = np.where(r.random(60_000) < 0.97, 1, r.integers(0, 9000, 60_000)).astype(np.int32)
    times = np.bincount(symbols, minlength=9000) + 1
    order = np.argsort(-times, kind="stable")
    rank = np.zeros(9000, np.int32)
    rank[order] = np.arange(9000)
    places = tokenfile.Places(tokenfile.Places.widths(times[order]))
    for s in (rank[symbols], 8999 - rank[symbols], np.full(5000, 8999, np.int32)):
        assert (tokenfile.decode_blocks(tokenfile.encode_blocks(s.astype(np.int32), places), len(s), places) == s).all()


def test_damaged_lists():
    w = tokenfile.Words(tokenfile.Tokens(P.path("word_bpe_49k.json")))
    ((data, _),) = frames_of(["some words and some words", None], w)
    for at in range(4, len(data)):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            tokenfile.read_frame(bytes(bad))
    assert tokenfile.read_frame(tokenfile.write_frame([5], [0], np.zeros(0, np.int32)))[:2] == ([5], [0])


@pytest.mark.parametrize("words, symbols", [(3, 1 << 19), (1 << 18, 49_408 + 2), (1 << 18, 60_000)])
def test_words_beyond_the_most_are_spelled(monkeypatch, words, symbols):
    """A frame has room for few words as symbols, or for few symbols beside the single ids: the rest is spelled, none refused."""
    monkeypatch.setattr(tokenfile, "MOST_WORDS", words)
    monkeypatch.setattr(tokenfile, "MOST_SYMBOLS", symbols)
    w, r = tokenfile.Words(tokenfile.Tokens(P.path("word_bpe_49k.json"))), random.Random(2)
    some = ["".join(r.choice("qxzjkw") for _ in range(12)) for _ in range(200)]
    text = " ".join(x for i, x in enumerate(some) for _ in range(2 + i % 3))
    ((data, _),) = frames_of([text], w)
    assert tokenfile.read_frame(data)[2].tolist() == [*w.t.tokenizer.encode(text, add_special_tokens=False).ids, 2]
