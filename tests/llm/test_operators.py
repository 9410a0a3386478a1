"""The training-data operators against brute force, and on odd rows."""

import collections
import functools
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tilequarry.llm import common, decontaminate, extract, langid, lmscore, pieces, quality, shard, simhash, substrings, tokenfile

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^ \t-\r]+")
#: An id that a double cannot hold.
BIG = 2**60 + 1
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(20_000))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, repeated rows, a null id and language, a long text, and columns with clashing names."""
    same = "the same words in the same order are here again " * 12
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, same, "en"), (5, same, "de"), (5, same, "de"), (None, same, None), (6, LONG, "fr"), (7, "x", "fr"), (8, "1234 !!", "en")]
    rows += [(BIG, "y", "fr"), (BIG + 2, None, None), (None, None, None)]
    return spark.createDataFrame([(a, b, c, "s", 1, 2, 3, 4, 5, 6) for a, b, c in rows], "doc_id long, text string, lang string, source string, n_chars long, id long, key long, seed long, n long, shard long").coalesce(1)


@pytest.fixture(scope="module")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


def operators(spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "the same words in the same order are here again the same"), (2, None), (3, "")], "item_id long, text string")
    return {
        "langid": lambda d: langid.identify_languages(d),
        "shard": lambda d: shard.shard_documents(d),
        "quality": lambda d: quality.quality_rules(d, labels),
        "keep": lambda d: quality.keep_good(d, labels),
        "tokens": lambda d: tokenfile.encode_to_files(d, P.path("word_bpe_49k.json")),
        "lm": lambda d: lmscore.score_documents(d, labels),
        "pieces": lambda d: pieces.encode_decode(d, P.path("piece_bpe_32k.model")),
        "simhash": lambda d: simhash.near_duplicates(d),
        "repeats": lambda d: substrings.remove_repeats(d),
        "decontaminate": lambda d: decontaminate.decontaminate(d, bench),
    }


def test_odd_rows(spark, odd, empty):
    for name, run in operators(spark).items():
        got = run(odd).collect()
        ids = collections.Counter(r["doc_id"] for r in got)
        if name == "keep":
            assert not ids  # all are short or repeat themselves
        else:
            assert ids == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 1, 7: 1, 8: 1, None: 2, BIG: 1, BIG + 2: 1}, name
        assert run(empty).count() == 0, name


def test_odd_values(spark, odd):
    ops = operators(spark)
    assert {r["doc_id"]: r["lang_pred"] for r in ops["langid"](odd).collect()}[8] == "und"
    found = collections.Counter((r["doc_id"], r["contaminated"]) for r in ops["decontaminate"](odd).collect())
    # Rows are judged by their text: of the two without an id, the one with the item is bad and the null text clean.
    bad = {(4, True): 1, (5, True): 2, (None, True): 1}
    assert found == {**bad, **{(d, False): 1 for d in (1, 2, 3, None, 6, 7, 8, BIG, BIG + 2)}}
    groups = {(r["doc_id"], r["fingerprint"] == "0" * 16): r["component_id"] for r in ops["simhash"](odd).collect()}
    assert groups[4, False] == groups[5, False] == groups[None, False] == 4
    assert groups[1, True] == groups[2, True] == groups[3, True] == groups[BIG + 2, True] == groups[None, True] == 1
    held = {r["doc_id"]: r["held_out"] for r in ops["langid"](odd).collect()}
    assert held == {d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2 for d in held}
    gone = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in ops["repeats"](odd).collect()}
    assert gone[1] == (0, 0) and gone[5][0] == gone[5][1] > 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15), (20, 21)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10, 15: 10, 20: 20, 21: 20}


def test_language_accuracy(docs):
    rows = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    for r in rows:
        assert zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and 0 <= r["score"] <= 1


def test_shards_are_even_and_keep_copies_together(docs, texts):
    rows = shard.shard_documents(docs, 16).collect()
    sizes = collections.Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 16
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    where = collections.defaultdict(set)
    for r in rows:
        where[texts[r["doc_id"]]].add(r["shard"])
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
    assert all(len(w) == 1 for w in where.values())


def test_a_group_larger_than_a_shard(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"own {i}") for i in range(600)]
    out = shard.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    sizes = collections.Counter(r["shard"] for r in out)
    assert len(out) == 600 and max(sizes.values()) - min(sizes.values()) <= 1


@pytest.mark.parametrize("light", [1_000, 1])
def test_groups_lie_in_as_few_shards_as_they_can(spark, monkeypatch, light):
    """One text with a third of the rows, and thousands of small groups: only the first is cut, into six shards."""
    monkeypatch.setattr(shard, "LIGHT_ROWS", light)
    rows = [(i, "hot") for i in range(16_000)]
    rows += [(len(rows) + i, f"pair {i // 2}") for i in range(2 * 2250)]
    rows += [(len(rows) + i, f"five {i // 5}") for i in range(5 * 2250)]
    rows += [(i, f"own {i}") for i in range(len(rows), 48_000)]
    out = shard.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 16).select("doc_id", "shard").collect()
    assert len(out) == 48_000 and set(collections.Counter(r["shard"] for r in out).values()) == {3000}
    text, where = dict(rows), collections.defaultdict(set)
    for r in out:
        where[text[r["doc_id"]]].add(r["shard"])
    assert len(where.pop("hot")) == 6
    assert all(len(w) == 1 for w in where.values())


def cut_of(text, out):
    """Pairs of equal texts in different shards, by brute force over the groups."""
    where = collections.defaultdict(collections.Counter)
    for r in out:
        where[text[r["doc_id"]]][r["shard"]] += 1
    return sum((sum(c.values()) ** 2 - sum(n * n for n in c.values())) // 2 for c in where.values()), sum(len(c) > 1 for c in where.values())


def test_full_shards_exchange_groups(spark):
    """No document is alone and every shard is full: at most the groups at the shards' borders are cut."""
    rows = [(i, f"pair {i // 2}") for i in range(4000)] + [(4000 + i, f"seven {i // 7}") for i in range(4200)]
    out = shard.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 16).select("doc_id", "shard").collect()
    sizes = collections.Counter(r["shard"] for r in out)
    assert len(out) == 8200 and max(sizes.values()) - min(sizes.values()) <= 1
    assert cut_of(dict(rows), out)[1] <= 2 * 16


def best_cut(groups, quota):
    """The fewest links that any dealing of the groups' members to the shards cuts, over all of them."""

    @functools.cache
    def least(k, room):
        if k == len(groups):
            return 0
        found = math.inf
        for parts in itertools.product(*[range(min(groups[k], r) + 1) for r in room]):
            if sum(parts) == groups[k]:
                own = (groups[k] ** 2 - sum(p * p for p in parts)) // 2
                found = min(found, own + least(k + 1, tuple(r - p for r, p in zip(room, parts, strict=True))))
        return found

    return least(0, tuple(quota))


def test_cut_against_every_other_dealing(spark):
    """Where half of the documents are alone, few more links are cut than by the best of all dealings."""
    rng = random.Random(9)
    total = best = start = 0
    for _ in range(2):
        groups = [rng.randint(2, 5) for _ in range(5)]
        rows = [f"g{k}" for k, n in enumerate(groups) for _ in range(n)] + [f"own {i}" for i in range(sum(groups))]
        rng.shuffle(rows)
        text, n = dict(enumerate(rows)), len(rows)
        quota = [n // 3 + (s < n % 3) for s in range(3)]
        out = shard.shard_documents(spark.createDataFrame(list(text.items()), "doc_id long, text string"), 3).collect()
        assert sorted(collections.Counter(r["shard"] for r in out).values()) == sorted(quota)
        total, best = total + cut_of(text, out)[0], best + best_cut(tuple(groups), quota)
        start += sum(g * (g - 1) // 2 for g in groups) * 2 // 3
    assert best <= total <= best + start // 10


def test_quality_counts(docs, texts):
    for r in quality.measure_documents(docs).collect():
        t = texts[r["doc_id"]]
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        window = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {i + k for i in range(len(words) - 7) for k in range(8) if window[tuple(words[i : i + 8])] > 1}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(inside))
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))


def test_binomial_tail():
    for n, k, p in ((10, 3, 0.3), (200, 0, 0.05), (50, 50, 0.5), (1000, 12, 0.01)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9)


def test_certified_cutoffs(spark):
    """A rule that would lose good documents is not certified, one that loses none is."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40)) + (" ###" * 60 if i >= 2000 else ""), "en") for i in range(2400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 2000)) for i in range(2400)], "doc_id long, quality int")
    kept = {r["doc_id"]: r for r in quality.quality_rules(d, labels).collect()}
    assert all("symbols" in kept[i]["failed"] for i in range(2000, 2400))
    assert not any(kept[i]["failed"] for i in range(2000))
    same = {r["doc_id"] for r in quality.keep_good(d, labels).collect()}
    assert same == {i for i, r in kept.items() if r["kept"]}
    # 300 copies are one trial, which certifies nothing.
    one = spark.createDataFrame([(i, rows[0][1], "en") for i in range(2000)] + rows[2000:], d.schema)
    assert not any(r["failed"] for r in quality.quality_rules(one, labels).collect())


def brute_cutoffs(rows, good, alpha, delta):
    """The certified cutoffs of each stratum; rows: (doc_id, stratum, text hash, counts by name)."""
    held = collections.defaultdict(dict)
    for d, stratum, text, c in rows:
        if d in good and c["n_words"] >= 20 and 100 * c["n_repeat_words"] <= 30 * c["n_words"]:
            held[stratum][text] = {r: c[top] / c[bottom] if c[bottom] else 0.0 for r, (top, bottom, _) in quality.RULES.items()}
    out = {}
    for stratum, texts in held.items():
        quarter = [x for t, x in texts.items() if t[1]]
        rest = [x for t, x in texts.items() if not t[1]]
        steps = [(sum(x[r] > c for x in quarter), -i, r, c) for r, (_, _, cuts) in quality.RULES.items() for i, c in enumerate(cuts)]
        cut = {}
        for _, _, r, c in sorted(steps):
            lost = sum(any(x[k] > v for k, v in (cut | {r: c}).items()) for x in rest)
            tail = math.fsum(math.comb(len(rest), i) * alpha**i * (1 - alpha) ** (len(rest) - i) for i in range(lost + 1))
            if tail > delta / len(held):
                break
            cut[r] = c
        out[stratum] = cut
    return out


@pytest.mark.parametrize("few", [10_000, 0])
def test_verdicts_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(quality, "BROADCAST_STRATA", few)
    sf = SF.replace("sf0.001", "sf0.01")
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    hashes = d.select("doc_id", F.coalesce("lang", F.lit("und")).alias("s"), F.xxhash64("text").alias("h"))
    hashes = hashes.withColumn("q", F.pmod(F.xxhash64("h", F.lit("ladder")), F.lit(4)) == 0).collect()
    got = {r["doc_id"]: r for r in quality.quality_rules(d, labels, 0.1, 0.2).collect()}
    cuts = brute_cutoffs([(r["doc_id"], r["s"], (r["h"], r["q"]), got[r["doc_id"]]) for r in hashes], good, 0.1, 0.2)
    assert any(cuts.values())
    for r in hashes:
        x = got[r["doc_id"]]
        base = x["n_words"] < 20 or 100 * x["n_repeat_words"] > 30 * x["n_words"]
        broken = [k for k, c in cuts.get(r["s"], {}).items() if (x[quality.RULES[k][0]] / x[quality.RULES[k][1]] if x[quality.RULES[k][1]] else 0.0) > c]
        assert x["base_failed"] == base and x["kept"] == (not base and not broken)


def test_token_frames(spark, docs, texts):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    start = 0
    for r in tokenfile.encode_to_files(docs, P.path("word_bpe_49k.json")).orderBy("doc_id").collect():
        ids = np.array([*t.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_damaged_block():
    ids = np.arange(5000, dtype=np.int32) % 700
    frame = bytearray(tokenfile.write_frame([1], [5000], ids))
    assert (tokenfile.read_frame(bytes(frame))[2] == ids).all()
    frame[-40] ^= 1
    with pytest.raises(ValueError):
        tokenfile.read_frame(bytes(frame))


def test_frames_of_all_kinds_of_ids():
    r = np.random.default_rng(3)
    for ids in (np.zeros(9000, "<i4"), r.integers(0, 200_000, 20_000), np.arange(70_000), r.zipf(1.3, 30_000) % 49_408, np.array([49_407])):
        ids = ids.astype("<i4")
        frame = tokenfile.write_frame([7], [len(ids)], ids)
        assert (tokenfile.read_frame(frame)[2] == ids).all()


def test_frames_are_smaller_than_fixed_width(texts):
    t = tokenfile.tokens(P.path("word_bpe_49k.json"))
    ids = np.frombuffer(b"".join(t.encode([x for x in texts.values() if x])), "<i4")
    assert len(tokenfile.write_frame([1], [len(ids)], ids)) < 1.4 * len(ids)


def test_words_of_any_signs_equal_the_library():
    t = tokenfile.Tokens(P.path("word_bpe_49k.json"))
    assert t.cuts
    r = random.Random(4)
    signs = "abzZÄßé'’sdtmlvre09½²ªµ×÷ÿİ<|>.,#$- \t\n\x00\x1cΣσœ日本\u0301"
    odd = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(5000)]
    odd += ["<|endoftext|>a b<|startoftext|>", "don't we'll I'M'S '' 's'd", "", " ", "Ab" * 5000]
    want = t.tokenizer.encode_batch_fast(odd, add_special_tokens=False)
    assert t.encode(odd) == [np.array(e.ids, "<i4").tobytes() for e in want]


def test_lm_prefers_the_target(spark):
    rows = [(i, "alpha beta gamma delta " * 30 if i % 2 else "one two three four " * 30) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lmscore.score_documents(d, d.where("doc_id % 2 = 1 AND doc_id < 20")).collect()}
    assert max(got[i] for i in range(1, 40, 2)) < 0 < min(got[i] for i in range(0, 40, 2))


def test_losses_equal_brute_force(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(lmscore, "CHUNK_BYTES", 20_000)
    chosen = {d for d in texts if d % 3 == 0}
    words = {d: [w.encode().lower() for w in WORD.findall(t)] for d, t in texts.items()}
    one, two = [[collections.Counter() for _ in range(2)] for _ in range(2)]
    for d, w in words.items():
        for k in range(1 + (d in chosen)):
            one[k].update(w)
            two[k].update(zip(w, w[1:], strict=False))
    all_words = [sum(c.values()) for c in one]

    def loss(k, before, w):
        share = one[0][w] / all_words[0]
        if k:
            share = (1 - lmscore.LEAN) * one[1][w] / all_words[1] + lmscore.LEAN * share
        lead, both = (one[k][before], two[k][before, w]) if before else (0, 0)
        return -math.log(lmscore.PAIR_WEIGHT * both / lead + (1 - lmscore.PAIR_WEIGHT) * share if lead else share)

    got = lmscore.score_documents(docs, docs.where("doc_id % 3 = 0").select("doc_id")).collect()
    assert len(got) == len(texts)
    for r in got:
        w = words[r["doc_id"]]
        means = [math.fsum(loss(k, b, x) for b, x in zip([None, *w], w, strict=False)) / max(len(w), 1) for k in range(2)]
        assert r["n_words"] == len(w)
        assert abs(r["background_loss"] - means[0]) < 1e-9 and abs(r["target_loss"] - means[1]) < 1e-9
        assert abs(r["score"] - (means[1] - means[0])) < 1e-9


def test_pieces_equal_the_library(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    e = pieces.Encoder(P.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(1)
    letters = list("abcdehinorst .,_-²é\n")
    some = [*texts.values(), "", "  a  ﬁ\tb\n", "日本語 🙂", LONG, "x" * 3000, *("a" + " " * n + "Fra" for n in range(1, 60)), " " * 5000]
    some += ["".join(rng.choice(letters, n)) for n in rng.integers(1, 60, 3000)]
    some += ["".join(e.vocabulary.pieces[i].replace("▁", " ") for i in rng.integers(259, 32_000, n)) for n in rng.integers(1, 8, 3000)]
    for t, ids in zip(some, e.encode(some), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == sp.encode(t), t
        assert e.decode(ids) == t


def test_pieces_with_a_small_cache(texts, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_BYTES", 10_000)
    a, b = (pieces.Encoder(P.path("piece_bpe_32k.model")) for _ in range(2))
    some = list(texts.values())
    assert [a.encode([t])[0] for t in some] == b.encode(some)


def test_viterbi_is_the_best_path(monkeypatch):
    """Without the rule for merges the path is the best one over all pieces."""
    v = pieces.Vocabulary(P.path("piece_bpe_32k.model"))
    monkeypatch.setattr(v, "merges", False)
    score = dict(zip(v.ids.tolist(), v.scores.tolist(), strict=True))
    by_text = {v.pieces[i]: score[i] for i in v.ids.tolist()}
    words = ["▁tion", "▁then", "▁abcd", "▁else"]
    for w, ids in pieces.encode_words(v, words).items():
        best = [0.0] + [-math.inf] * len(w)
        for b in range(1, len(w) + 1):
            best[b] = max((best[a] + by_text.get(w[a:b], -1e6 if b - a == 1 else -math.inf)) for a in range(b))
        assert sum(score[i] for i in np.frombuffer(ids, "<i4").tolist()) == pytest.approx(best[-1])


def test_simhash_links(docs, texts):
    def brute(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        w = WORD.findall(w)
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0

    want = {k: brute(t) for k, t in texts.items()}
    group = {k: k for k in want}
    for _ in range(5):
        for a in want:
            for b in want:
                if (want[a] ^ want[b]).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    for r in simhash.near_duplicates(docs).collect():
        assert r["fingerprint"] == f"{want[r['doc_id']]:016x}" and r["component_id"] == group[r["doc_id"]]


def test_repeats_equal_brute_force(spark, docs, texts):
    more = {10**6 + i: t for i, t in enumerate(["a" * 700, "xy" * 150 + "q", "é" * 260])}
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    raw = {k: t.encode() for k, t in (texts | more).items()}
    seen = collections.Counter(b[i : i + 200] for b in raw.values() for i in range(len(b) - 199))
    for r in substrings.remove_repeats(d).collect():
        b = raw[r["doc_id"]]
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (int(gone.sum()), spans, hashlib.sha256(left).hexdigest())


def test_masks_hit_every_fifth_substituted():
    from itertools import combinations

    for n in (10, 12, 14, 15, 17, 19, 20):
        for bad in combinations(range(n), n // 5):
            assert any(not {s + o for o in m} & set(bad) for m in decontaminate.MASKS for s in range(n - m[-1]))


def test_masks_hit_every_pattern_of_short_items():
    from itertools import combinations

    for n in range(1, 21):
        for bad in combinations(range(n), n // 5):
            assert any(not {s + o for o in m} & set(bad) for m in decontaminate.masks_of(n) for s in range(n - m[-1])), (n, bad)


@pytest.mark.parametrize("few", [500_000, 0])
def test_short_items_equal_brute_force(spark, monkeypatch, few):
    """Items of 1 to 20 words with every single substitution, cut at either end of a text, and copied verbatim."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", few)
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(1, 21)}
    texts = [["before", *w, "after"] for w in items.values()] + [w[1:] for w in items.values()] + [w[:-1] for w in items.values()]
    texts += [["a", *w[:k], "other", *w[k + 1 :], "z"] for w in items.values() for k in range(len(w))]
    want = {}
    for d, t in enumerate(texts):
        for n, w in items.items():
            share = max(sum(0 <= i + s < len(t) and t[i + s] == x for i, x in enumerate(w)) for s in range(-n, len(t))) / n
            if share >= 0.8:
                want[d] = (n, share)
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()] + [(99, ""), (98, None)], "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench).collect()
    assert len(got) == len(texts) and {r["doc_id"]: (r["item_id"], r["best"]) for r in got if r["contaminated"]} == want
    one = decontaminate.decontaminate(docs, bench.where("item_id = 6")).collect()
    assert {r["doc_id"] for r in one if r["contaminated"]} == {d for d, (n, _) in want.items() if n == 6}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="c7">
<nav><a href="/x">menu</a></nav><div class="cookie-notice">We use cookies</div><main><article class="post-12"><h1>Head &amp; line</h1><p>First   <b>part<br>of it.<p>Second&nbsp;part with a <a href="/y">link</a>.
<form><p>Your mail</p></form><div class="ad">Buy</div><!-- no --><ul><li>one</li><li>two</li></ul><section id="comments"><p>I disagree at length, as readers do.</p></section></article>
<aside><p>Also read these other stories today, they are long and winding.</p></aside></main><footer>&copy; us</footer></body></html>"""


def test_extraction(spark):
    rows = [(1, "https://h.example/a", PAGE), (2, "https://h.example/b", None), (3, None, "<p>only text"), (4, "https://h.example/c", "<div><p>bare page without an article but words")]
    got = {r["page_id"]: r for r in extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "Head & line\n\nFirst part of it.\n\nSecond part with a link.\n\none\n\ntwo"
    assert (got[2]["text"], got[2]["n_chars"], got[3]["text"]) == ("", 0, "only text")
    assert got[4]["text"] == "bare page without an article but words"
    assert extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


INLINE = [
    ("<p>Text <span hidden>secret</span> goes on.</p>", "Text goes on."),
    ('<p>Text <span style="display:none">secret <span>deep</span> more</span> goes on.</p>', "Text goes on."),
    ('<p>Text <span class="ad">Buy</span> goes on.</p>', "Text goes on."),
    ('<p>Text.</p><site-menu class="nav"><p>Home</p>Away</site-menu><p>End.</p>', "Text.\n\nEnd."),
    ("<p>Text.</p><label>Your mail</label><p>End.</p>", "Text.\n\nEnd."),
    ('<p>Text.</p><div class="article-comment-box"><p>I disagree.</p></div><p>End.</p>', "Text.\n\nEnd."),
    ('<p>Text.</p><div class="post-footer-note"><p>Filed here.</p></div><p>End.</p>', "Text.\n\nEnd."),
    ('<p>Text <a class="share-link" href="/x">Share</a> with <a href="/y">link</a>.</p>', "Text with link."),
    ('<div class="content no-sidebar has-comments"><p>Text.</p></div>', "Text."),
    ('<p>Text <span hidden>open<p>End <b>bold</b>.</p>', "Text"),
    ('<p>Text <img class="ad" src="a"> goes <b class="x">on</b>.</p>', "Text goes on."),
]


@pytest.mark.parametrize(("inner", "text"), INLINE)
def test_inline_parts_and_marked_words(inner, text):
    assert extract.main_text(f"<html><body><article>{inner}</article></body></html>", None) == text


def test_extraction_of_pages_made_with_their_text():
    """Pages put together from parts of which it is known whether they belong to the article."""
    rng = random.Random(21)
    for _ in range(200):
        html, want = [], []
        for k in range(rng.randint(1, 8)):
            words = " ".join(rng.choice(["river", "stone", "a &amp; b", "caf&eacute;", "x<b>y</b>z"]) for _ in range(rng.randint(3, 9)))
            plain = words.replace("&amp;", "&").replace("&eacute;", "é").replace("<b>", "").replace("</b>", "")
            kind = rng.randrange(5)
            noise = rng.choice(['<span hidden>n{}</span>', '<i class="advert">n{}</i>', '<em style="visibility: hidden">n{}<em>m</em></em>', "<script>n{}</script>", "<!-- n{} -->"]).format(k)
            if kind == 0:
                html.append(f"<p>{words} {noise} end{k}</p>")
                want.append(f"{plain} end{k}")
            elif kind == 1:
                html.append(f'<ul class="list"><li>{words}</li><li>{noise}item{k}</li></ul>')
                want += [plain, f"item{k}"]
            elif kind == 2:
                html.append(f"<h2>{words}</h2>")
                want.append(plain)
            else:
                tag, mark = rng.choice([("div", 'class="x-comments-y"'), ("nav", ""), ("aside", ""), ("section", 'id="newsletter-box"'), ("div", "hidden"), ("x-menu", 'class="menu"')])
                html.append(f"<{tag} {mark}><p>{words}</p> loose</{tag}>")
        page = f"<html><head><title>t</title></head><body><header>top</header><main><article>{''.join(html)}</article></main><footer>f</footer></body></html>"
        assert extract.main_text(page, None) == "\n\n".join(want)


def test_extraction_of_odd_pages(spark):
    """Hidden parts, forms, class words, deep and long pages, repeated and null rows, ids above 2^53 and clashing names."""
    hidden = '<body><div hidden>no</div><div style="color: red; DISPLAY:none">no, not this long text either, for it is hidden</div><p>short article'
    form = "<body><form><nav>menu</nav><article><p>Held by a form.</article></form>"
    social = '<body><div class="article social-issues"><p>Kept words.</div><div class="cookie-notice">We use cookies</div><form><p>Your mail</form>'
    long = "<p>" + "many words " * 20_000
    rows = [(BIG, "a", hidden), (BIG, "a", hidden), (2, "http://f.example/", form), (3, "http://s.example/", social), (4, None, "<div>" * 20_000 + "<p>deep"), (5, "", long), (None, "b", None), (None, "b", "<p>x")]
    d = spark.createDataFrame([(*r, "h", ["p"], "t", 3) for r in rows], "page_id long, url string, html string, host string, paths array<string>, text string, n_chars int").coalesce(1)
    got = sorted((str(r["page_id"]), r["text"]) for r in extract.extract_pages(d).collect())
    want = [(BIG, "short article"), (BIG, "short article"), (2, "Held by a form."), (3, "Kept words."), (4, "deep"), (5, long[3:].strip()), (None, ""), (None, "x")]
    assert got == sorted((str(a), b) for a, b in want)
    assert extract.extract_pages(d.limit(0)).count() == 0


@pytest.mark.parametrize("few", [200_000, 0])
def test_votes_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(extract, "BROADCAST_HOSTS", few)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = pages.collect()
    host = lambda r: re.match(r"[A-Za-z+.-]+://([^/?#:]*)", r["url"])[1].lower()
    votes = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in rows:
        if best := extract.best_container(extract.blocks(r["html"])):
            votes[host(r)][best.path].append(math.floor(best.score))
    agreed = {h: [p for p, _ in sorted(v.items(), key=lambda x: (-len(x[1]), -sum(x[1]), x[0]))][: extract.PATHS_PER_HOST] for h, v in votes.items()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract.extract_pages(pages).collect()}
    for r in rows:
        text = extract.main_text(r["html"], agreed.get(host(r)))
        assert got[r["page_id"]] == (text, len(text))


def test_nearest_centroid_equals_brute_force(docs, texts):
    """Predictions against plain cosines with the model's own centroids, from counts of n-grams kept in dictionaries."""
    model = langid.train(docs, langid.fold() != 2)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    for d, t in list(texts.items())[:60]:
        c = langid.ngram_counts(t)
        if c is None:
            assert got[d]["lang_pred"] == "und"
            continue
        v = [math.log1p(n) * w for n, w in zip(c.tolist(), model["idf"].tolist(), strict=True)]
        size = math.sqrt(math.fsum(x * x for x in v))
        near = [math.fsum(a * b for a, b in zip(v, row, strict=True) if a) / size for row in model["matrix"].tolist()]
        assert max(near) == pytest.approx(got[d]["score"], abs=1e-4)
        assert near[model["langs"].index(got[d]["lang_pred"]) :] and max(x for x, k in zip(near, model["langs"], strict=True) if k == got[d]["lang_pred"]) > max(near) - 1e-4


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, SF))
        assert tuple(docs.columns) == C.COLUMNS, name
    out = C.STAGES[-1][1](spark, docs, SF).collect()
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 0 < len(out) == len(left) < 200 and all(r["round_trip"] for r in out)
    words = [WORD.findall(r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for t in left.values():
        have = " " + " ".join(WORD.findall(t.lower())) + " "
        assert not any(f" {' '.join(w)} " in have for w in words)


def shingle_sets(texts, k=5):
    """Sets of word shingles, brute force."""
    out = {}
    for key, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[key] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    return out


def jaccard_groups(sets):
    """The first key of each key's component by links of Jaccard 0.8 or more."""
    group = {k: k for k in sets}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) > 0:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {k: root(k) for k in keys}


def near_copies():
    """Texts at chosen similarities: pairs a little over and under 0.8, and copies that repeat shingles."""
    rng = np.random.default_rng(5)
    out = []
    for k in range(60):
        w = [f"w{x}" for x in rng.integers(0, 5000, 204)]
        # 200 distinct shingles; a new tail of m words leaves 200 - m of them: 178/222 = 0.802, 175/225 = 0.778.
        m = 22 if k % 2 else 25
        out += [" ".join(w), " ".join([*w[:-m], *(f"new{k}x{i}" for i in range(m))])]
    for k in range(10):
        w = [f"r{x}" for x in rng.integers(0, 5000, 200)]
        cycle = w[:24] * 6 + w[:4]
        out += [" ".join([*w[:24], *w[:4], *w[24:]]), " ".join([*cycle, *w[24:]])]
    return out


def test_near_duplicates_have_the_similarity(spark):
    import corpus_pipeline as C

    texts = dict(enumerate(near_copies()))
    want = jaccard_groups(shingle_sets(texts))
    assert len(set(want.values())) == 60 + 30 + 20 - 10
    d = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in C.stage_near_duplicates(spark, d, SF).collect()}
    assert got == set(want.values())


def test_near_duplicates_of_the_corpus(spark, docs, texts):
    import corpus_pipeline as C

    want = jaccard_groups(shingle_sets(dict(sorted(texts.items()))))
    assert {r["doc_id"] for r in C.stage_near_duplicates(spark, docs, SF).collect()} == set(want.values())


def test_similar_sets_meet_at_a_first_shingle():
    rng = np.random.default_rng(5)
    common = np.sort(rng.choice(300, 40, replace=False).astype(np.uint64))
    rank = rng.permutation(40)
    seen = 0
    for _ in range(3000):
        n = int(rng.integers(1, 40))
        x = rng.choice(300, n, replace=False)
        keep = x[: max(1, n - int(rng.integers(0, 4)))]
        y = np.union1d(keep, rng.choice(300, int(rng.integers(0, 3)), replace=False))
        both = len(np.intersect1d(x, y))
        if both * 5 >= (len(x) + len(y) - both) * 4:
            seen += 1
            a, b = (simhash.prefix(np.sort(v).astype(np.uint64), common, rank) for v in (x, y))
            at = [(i, list(b).index(h)) for i, h in enumerate(a) if h in b]
            assert at and min(len(x) - at[0][0], len(y) - at[0][1]) * 9 >= 4 * (len(x) + len(y))
    assert seen > 1000


def test_near_duplicates_never_meet_all_other_texts(spark, docs, monkeypatch):
    import corpus_pipeline as C

    def refuse(*a, **b):
        raise AssertionError("all pairs")

    monkeypatch.setattr(simhash, "tiles", refuse)
    assert C.stage_near_duplicates(spark, docs, SF).count() > 0


def test_near_duplicates_without_or_with_repeated_ids(spark):
    import corpus_pipeline as C

    text = [" ".join(f"t{k}w{i}" for i in range(60)) for k in range(5)]
    rows = [(None, text[0]), (None, text[1]), (7, text[1]), (9, text[2]), (9, text[3]), (9, text[3]), (None, text[4]), (None, text[4])]
    d = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in C.stage_near_duplicates(spark, d, SF).collect()), key=lambda x: x[1])
    assert got == [(None, text[0]), (7, text[1]), (9, text[2]), (9, text[3]), (None, text[4])]


def test_benchmark_stage_judges_each_text(spark):
    """A contaminated text takes no other text with its doc_id along, null or repeated."""
    import corpus_pipeline as C

    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").first()["text"]
    rows = [(None, item), (None, "clean words"), (3, item), (3, "other clean words")]
    d = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r["doc_id"], r["text"]) for r in C.stage_benchmark(spark, d, SF).collect()}
    assert got == {(None, "clean words"), (3, "other clean words")}
