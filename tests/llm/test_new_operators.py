"""Licence scans, periodic runs and importance resampling against SQL and brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib

import pytest
from compare import differences
from pyspark.sql import functions as F

from tilequarry.llm import licenses, periods, queries, resample

SF = "/root/testdata/sf0.001"
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BIG = 2**60 + 1
COLUMNS = "doc_id long, text string, found int, runs int, score int, rank int, n_words int, _row int, _part int"


def frame(spark, rows):
    return spark.createDataFrame([(a, b, *range(7)) for a, b in rows], COLUMNS)


@pytest.fixture(scope="module")
def odd(spark):
    again = "released under the MIT license and again " * 30
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, again), (4, again), (None, again), (None, None), (BIG, "x"), (BIG + 2, "é" * 9), (7, " ".join(f"w{i % 997}" for i in range(30_000)))]
    return frame(spark, rows).coalesce(1)


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_periodic_runs", "op13_importance_resampling"])
def test_same_rows_as_sql(spark, name):
    assert not differences(spark, name, queries.QUERIES[name], queries.ORACLES[name], SF)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def garble(rng, text, edits):
    for _ in range(edits):
        at, kind = rng.randrange(len(text)), rng.randrange(3)
        text = text[:at] + ("" if kind == 0 else rng.choice("abcé 2 ")) + text[at + (kind < 2) :]
    return text


def test_licenses_equal_edit_distance_over_all_stretches():
    rng, (automaton, notices) = random.Random(3), licenses.prepare()
    spans = 0
    for _ in range(400):
        filler = [rng.choice("the a of licence version 2 mit under by nc cc".split()) for _ in range(12)]
        chosen = [garble(rng, rng.choice(notices).words, rng.randrange(5)) for _ in range(2)]
        text = " ".join(w.decode() for w in licenses.words_of(" ".join([*filler[:5], chosen[0], *filler[5:9], chosen[1], *filler[9:]])))
        words = text.split(" ")
        want = {}
        for n, notice in enumerate(notices):
            size = notice.words.count(" ") + 1
            for i in range(len(words)):
                for j in range(i + 1, min(len(words), i + size + notice.edits) + 1):
                    if set(notice.must) <= set(words[i:j]) and (d := distance(notice.words, " ".join(words[i:j]))) <= notice.edits:
                        want[n, i, j] = d
        found = licenses.search(text, automaton, notices)
        for s, e, n, k in found:
            i = text[:s].count(" ")
            assert want[n, i, i + text[s:e].count(" ") + 1] == k
        # Each stretch within the bound shares words with a find of its notice that needs no more edits, and no exact one is lost.
        for (n, i, j), k in want.items():
            near = [f for f in found if f[2] == n and text[: f[0]].count(" ") < j and text[: f[1]].count(" ") >= i]
            assert near and (k or any(f[3] == 0 for f in near))
        spans += len(found)
    assert spans > 300


def test_licenses_report_places(spark):
    text = "Code -- UNDER THE MIT LICENSE. undr the mit licence; Apache License, Version 3; Apache Licence, Version 2.0. CC-BY-NC"
    row = licenses.scan_licenses(frame(spark, [(1, text)])).first()
    assert (row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == (2, 1, row["n_words"] - 3, "cc-by-nc,mit")
    assert row["labels"] == "apache-2,cc-by-nc,mit" and row["score"] == 1.0
    words = LETTERS.findall(text.lower())
    for f in row["found"]:
        part = " ".join(words)[f["first_char"] : f["end_char"]]
        assert part == " ".join(words[f["first_word"] : f["last_word"] + 1]) and distance(part, f["notice"]) == f["edits"]
    assert [f["edits"] for f in row["found"]] == [0, 2, 1, 0]


def brute_runs(words):
    n, out = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i - s + p >= max(6, 4 * p):
                out.setdefault((s, i - s + p), p)
            i += 1
    return sorted(((s, length, p) for (s, length), p in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(7)
    for _ in range(500):
        texts = []
        for _ in range(rng.randint(1, 6)):
            kinds, n = rng.randint(1, 4), rng.randint(0, 70)
            words = [b"%d" % rng.randint(0, kinds) for _ in range(n)]
            for _ in range(rng.randint(0, 2) if n > 3 else 0):
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 3))
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(words)
        assert periods.runs_of(texts) == [brute_runs(t) for t in texts]


def test_runs_of_fibonacci_and_powers():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 400:
        a, b = b, b + a
    for words in (b, [b"x"] * 1000, [b"x", b"y", b"x"] * 200, [b"%d" % i for i in range(500)] * 5):
        assert periods.runs_of([words]) == [brute_runs(words)]


def test_collapse_drops_what_runs_repeat():
    words = b"s a b a b a b a b t u u u u u u v".split()
    runs = periods.runs_of([words])[0]
    assert runs == [(1, 8, 2), (10, 6, 1)] and periods.collapse(words, runs) == b"s a b t u v".split()


def test_resampling_equals_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["Wort", "été", "x2", "the", "Longer" * 20, "a-b", "of"]
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 19, 20, 40])))) for i in range(400)]
    target = [(i, " ".join(rng.choice(vocabulary[:3]) for _ in range(30))) for i in range(9)]
    got = resample.resample(frame(spark, texts).repartition(7), spark.createDataFrame(target, "item_id long, text string")).collect()

    def features(text):
        w = LETTERS.findall(text.translate({c: c + 32 for c in range(65, 91)}))
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)

    s, t = [0] * 10_000, [0] * 10_000
    for into, rows in ((s, texts), (t, target)):
        for _, text in rows:
            for b in features(text)[0]:
                into[b] += 1
    S, T = sum(s), sum(t)
    want = []
    for i, text in texts:
        own, n = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in own)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    able = sorted((r for r in want if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: k for k, r in enumerate(able[: 5 * len(able) // 100], 1)}
    assert sorted(tuple(r) for r in got) == sorted((*r[:4], rank.get(r[0])) for r in want) or {tuple(r) for r in got} == {(*r[:4], rank.get(r[0])) for r in want}
    assert len(rank) >= 5


def test_ranks_over_many_parts_and_ties(spark, monkeypatch):
    monkeypatch.setattr(resample, "hash_parts", lambda n, per: 7)
    rows = spark.range(1000).select((F.col("id") % 10).alias("doc_id"), F.lit(30).alias("n_words"), F.when(F.col("id") < 900, 5).otherwise(F.col("id")).alias("score"), F.col("id").alias("_row"))
    got = resample.rank_highest(rows, 1000, 300).where("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 301))
    assert [(-r["score"], r["doc_id"]) for r in got] == sorted((-r["score"], r["doc_id"]) for r in got) and got[0]["score"] == 999


def test_odd_rows(spark, odd):
    n = odd.count()
    found = licenses.scan_licenses(odd).collect()
    assert len(found) == n and {r["doc_id"] for r in found} == {r["doc_id"] for r in odd.collect()}
    by_words = {r["n_words"]: r for r in found}
    assert by_words[0]["labels"] == "" and by_words[0]["first_word"] is None and by_words[0]["score"] == 0
    assert by_words[210]["n_base"] == 30 and by_words[210]["last_word"] == 29 * 7 + 1
    runs = periods.digest(periods.periodic_runs(queries.with_planted_runs(odd))).collect()
    assert len(runs) == n and {r["doc_id"] for r in runs} == {r["doc_id"] for r in odd.collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert all(r["collapsed_sha256"] == none and r["n_runs"] == 0 and r["period"] is None for r in runs if r["doc_id"] in (1, 2, 3))
    assert [(r["start"], r["length"], r["period"], r["exponent_milli"]) for r in runs if r["doc_id"] is None and r["n_runs"]] == [(0, 210, 7, 30_000)]
    drawn = resample.resample(odd, odd.select("doc_id", "text")).collect()
    assert len(drawn) == n and all(r["n_features"] == 0 and r["weight"] == 0 and r["rank"] is None for r in drawn if r["doc_id"] in (1, 2, 3))


def test_empty_tables(spark, odd):
    none = spark.createDataFrame([], odd.schema)
    assert licenses.scan_licenses(none).count() == 0
    assert periods.digest(periods.periodic_runs(queries.with_planted_runs(none))).count() == 0
    assert resample.resample(none, none).count() == 0
    assert resample.resample(odd, none).count() == odd.count()
