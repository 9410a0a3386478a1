"""Fuzzy search for short licence notices: exact seeds, then bounded-error matching.

A notice is a few words. It stands at words i to j of a text if the edit distance (characters put in,
left out or changed) between it and those words, joined by one space, is at most its bound, and the words
that tell it from other notices (`mit`, a version number) are all there. The bound is one edit for every
EDIT_EVERY characters, MOST_EDITS at most, so that the shortest notices must agree exactly.

A notice with a bound of k is cut into k + 1 pieces. k edits leave one piece whole, so one pass of an
automaton over the text for all pieces of all notices misses nothing. Every piece found proposes the
stretches of whole words that begin and end within k characters of where the notice would; the regex
library matches each with bounded errors and gives the fewest edits. Overlapping finds of one notice
count once: the later one replaces the one before it only with fewer edits.

Words are the runs of letters, digits and characters beyond ASCII in the ASCII-lower-cased text. Texts are
searched whole, by rows, without a shuffle. A null or empty text has no words and no finds. Repeated rows are
searched one by one. Extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_frames

#: Characters of a notice for which one edit is allowed, and the most edits.
EDIT_EVERY, MOST_EDITS = 10, 3

# Labels, words of the notices, and those of them that must agree exactly.
NOTICES = (
    ("mit", "under the mit license", ("mit",)),
    ("apache-2", "apache license version 2", ("apache", "2")),
    ("cc-by-nc", "cc by nc", ("cc", "by", "nc")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("permission", "copy")),
    ("bsd", "redistribution and use in source and binary forms", ("redistribution", "binary")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission", "purpose")),
    ("gpl-2", "gnu general public license version 2", ("gnu", "general", "2")),
    ("gpl-3", "gnu general public license version 3", ("gnu", "general", "3")),
    ("lgpl", "gnu lesser general public license", ("gnu", "lesser")),
    ("agpl-3", "gnu affero general public license version 3", ("gnu", "affero", "3")),
    ("mpl-2", "mozilla public license version 2", ("mozilla", "2")),
    ("epl-2", "eclipse public license version 2", ("eclipse", "2")),
    ("cc-by", "creative commons attribution license", ("creative", "commons", "attribution")),
    ("cc-by-nc", "creative commons attribution noncommercial", ("creative", "commons")),
    ("cc-by-sa", "creative commons attribution sharealike", ("creative", "commons")),
    ("cc-by-sa", "cc by sa", ("cc", "by", "sa")),
    ("cc0", "creative commons zero", ("creative", "zero")),
    ("unlicense", "free and unencumbered software released into the public domain", ("unencumbered", "public")),
    ("boost", "boost software license version 1", ("boost", "1")),
    ("all-rights-reserved", "all rights reserved", ("all", "rights")),
)
#: The notices that the base counts, by their place in NOTICES.
N_BASE = 3

FOUND = "array<struct<label:string,notice:string,base:boolean,first_word:long,last_word:long,first_char:long,end_char:long,edits:int>>"
KEEP = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


class Notice(NamedTuple):
    label: str
    words: str
    must: tuple[str, ...]
    edits: int
    base: bool
    pattern: regex.Pattern


def bound(notice: str) -> int:
    return min(MOST_EDITS, len(notice) // EDIT_EVERY)


def pieces(notice: str) -> list[tuple[int, str]]:
    """The notice cut in one piece more than it may have edits: (place, piece)."""
    n = bound(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def prepare() -> tuple[ahocorasick.Automaton, list[Notice]]:
    notices = [Notice(label, words, must, bound(words), n < N_BASE, regex.compile(f"(?b)(?:{regex.escape(words)}){{e<={bound(words)}}}")) for n, (label, words, must) in enumerate(NOTICES)]
    seeds: dict[str, list[tuple[int, int]]] = {}
    for n, notice in enumerate(notices):
        for at, piece in pieces(notice.words):
            seeds.setdefault(piece, []).append((n, at + len(piece) - 1))
    automaton = ahocorasick.Automaton()
    for piece, where in seeds.items():
        automaton.add_word(piece, where)
    automaton.make_automaton()
    return automaton, notices


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(KEEP).split()


def stretches(text: str, start: int, notice: Notice) -> Iterator[tuple[int, int]]:
    """Stretches of whole words that begin and end within the bound of where the notice would."""
    k, n = notice.edits, len(notice.words)
    around = text[max(0, start - k) : start + n + 2 * k]
    if not all(w in around for w in notice.must):
        return
    for s in range(max(0, start - k), min(start + k, len(text) - 1) + 1):
        if s and text[s - 1] != " " or text[s] == " ":
            continue
        for e in range(max(s + n - k, s + 1), min(s + n + k, len(text)) + 1):
            if e == len(text) or text[e] == " ":
                yield s, e


def search(text: str, automaton: ahocorasick.Automaton, notices: list[Notice]) -> list[tuple[int, int, int, int]]:
    """(start, end, notice, edits) of the finds in words joined by one space, by start."""
    proposed = {(at - back, n) for at, where in automaton.iter(text) for n, back in where}
    edits: dict[tuple[int, int, int], int] = {}
    for start, n in proposed:
        notice = notices[n]
        for s, e in stretches(text, start, notice):
            if (s, e, n) in edits:
                continue
            part = text[s:e]
            if part == notice.words:
                edits[s, e, n] = 0
            elif notice.edits and set(notice.must) <= set(part.split(" ")) and (match := notice.pattern.fullmatch(part)):
                edits[s, e, n] = sum(match.fuzzy_counts)
    kept: list[tuple[int, int, int, int]] = []
    last: dict[int, int] = {}
    for (s, e, n), k in sorted(edits.items()):
        before = last.get(n)
        if before is not None and kept[before][1] > s:
            if k < kept[before][3]:
                kept[before] = (s, e, n, k)
            continue
        last[n] = len(kept)
        kept.append((s, e, n, k))
    return sorted(kept)


def describe(text: str, finds: list[tuple[int, int, int, int]], notices: list[Notice]) -> list[dict]:
    out, word, at = [], 0, 0
    for s, e, n, k in finds:
        word += text.count(" ", at, s)
        at = s
        notice = notices[n]
        out.append({"label": notice.label, "notice": notice.words, "base": notice.base and not k, "first_word": word, "last_word": word + text.count(" ", s, e), "first_char": s, "end_char": e, "edits": k})
    return out


def find_notices(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words and found: the notices with their place in words and in characters of the words joined by one space."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, notices = prepare()
        for f in frames:
            words = [words_of(t) for t in f["text"]]
            joined = [b" ".join(w).decode() for w in words]
            found = [describe(t, search(t, automaton, notices), notices) for t in joined]
            yield pd.DataFrame({"doc_id": f["doc_id"], "n_words": [len(w) for w in words], "found": found})

    return map_frames(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, f"doc_id long, n_words long, found {FOUND}")


def listed(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and found.

    score is the best share of a notice's characters that needed no edit, 0 without a find.
    """
    base = F.filter("found", lambda f: f["base"])
    starts = F.transform(base, lambda f: f["first_word"])
    share = lambda f: F.lit(1.0) - f["edits"] / F.char_length(f["notice"])
    return find_notices(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(F.transform(base, lambda f: f["label"])).alias("base_labels"),
        listed(F.transform("found", lambda f: f["label"])).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", share)), F.lit(0.0)).alias("score"),
        "found",
    )
