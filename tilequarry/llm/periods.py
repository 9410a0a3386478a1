"""Runs of repeated words by partition refinement after Crochemore.

Two positions of a text are in one class at level p if the p words from each of them on are equal. Level 1 is
the words themselves; level p + 1 splits each class by the class of the next position. Only small classes
split others: of the parts of a class all but the largest go on, so a position takes part a number of times
that is logarithmic in the text, and all texts of a batch are refined together in numpy. The members
of a class are linked in order of position. Where a member's next one lies exactly p further at level p, the
p words are repeated at once: a square, whose half is no repetition itself, since that would put another
member between them. Squares that begin at neighbouring words are one run, which is therefore as long as
it can be, and of the smallest period.

Runs count from MIN_WORDS words and MIN_TIMES periods on. Words are the non-space runs of the text. A null or empty text has
no words and no run; repeated rows are treated one by one; extra columns are ignored; an empty table gives
an empty one. Texts are taken whole, rows are independent and nothing is shuffled, so a task holds one
batch of about FRAME_BYTES of text, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_frames

#: Words and periods of the shortest run.
MIN_WORDS, MIN_TIMES = 6, 4
RUNS = "array<struct<start:long,length:long,period:long>>"


def parts(values: np.ndarray) -> np.ndarray:
    """Where each stretch of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


class Classes:
    """Positions in classes of equal words, refined level by level; members linked by position."""

    def __init__(self, names: np.ndarray, longest: np.ndarray):
        """names: class of each position at level 1, from 0 on without gaps; longest: largest period that matters there."""
        n = self.n = len(names)
        self.name, self.longest, self.level = names.astype(np.int64), longest, 1
        self.members = np.argsort(self.name, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.members] = np.arange(n)
        self.count = int(self.name.max()) + 1 if n else 0
        self.size = np.bincount(self.name, minlength=n)
        self.begin = np.cumsum(self.size) - self.size
        # Position n stands for none.
        self.after, self.before = np.full(n + 1, n), np.full(n + 1, n)
        self.moved = np.zeros(n, bool)
        self.link(self.members, self.name[self.members])
        self.small = np.arange(n)
        self.due: dict[int, list[np.ndarray]] = {}
        self.note(self.small)

    def link(self, members: np.ndarray, group: np.ndarray) -> None:
        """Chain the members of each group, which come in order of group and position."""
        same = group[1:] == group[:-1]
        self.after[members] = np.concatenate([np.where(same, members[1:], self.n), [self.n]])[: len(members)]
        self.before[members] = np.concatenate([[self.n], np.where(same, members[:-1], self.n)])[: len(members)]

    def note(self, members: np.ndarray) -> None:
        """Remember the members whose next one may be at distance p when level p comes."""
        gap = self.after[members] - members
        due = (self.after[members] < self.n) & (gap >= self.level) & (gap <= self.longest[members])
        members, gap = members[due], gap[due]
        order = np.argsort(gap, kind="stable")
        members, gap = members[order], gap[order]
        cut = parts(gap)
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(gap)]):
            self.due.setdefault(int(gap[a]), []).append(members[a:b])

    def squares(self) -> np.ndarray:
        """Positions where a square with this level as its period begins."""
        due = self.due.pop(self.level, None)
        if due is None:
            return np.zeros(0, np.int64)
        at = np.unique(np.concatenate(due))
        return at[self.after[at] - at == self.level]

    def refine(self) -> bool:
        """Go one level up; False once nothing splits any more, when all classes have one member."""
        at = self.small - 1
        at = at[at >= 0]
        at = at[self.size[self.name[at]] > 1]
        self.level += 1
        if not len(at):
            return False
        order = np.lexsort((at, self.name[at + 1], self.name[at]))
        at = at[order]
        old, by = self.name[at], self.name[at + 1]
        # Groups of one class that leave for one class each; a class's groups stand together.
        cut = np.flatnonzero(np.concatenate([[True], (old[1:] != old[:-1]) | (by[1:] != by[:-1])]))
        number = np.diff(cut, append=len(at))
        split = parts(old[cut])
        of = np.repeat(np.arange(len(split)), np.diff(split, append=len(cut)))
        owner = old[cut[split]]
        rest = self.size[owner] - np.add.reduceat(number, split)
        most = np.maximum.reduceat(number, split)
        top = np.flatnonzero(number == most[of])
        top = top[parts(of[top])]
        # A class that all members leave keeps its largest group, so that no class is ever empty.
        leaves = np.ones(len(cut), bool)
        leaves[top[rest == 0]] = False
        if not leaves.any():
            return False
        goes_on = leaves.copy()
        goes_on[top[rest < most]] = False
        by_group = np.repeat(np.arange(len(cut)), number)
        stay = leaves[by_group]
        at, old, group = at[stay], old[stay], by_group[stay]
        renamed = np.cumsum(leaves) - 1 + self.count
        self.count += int(leaves.sum())
        self.swap(at, old)
        begins = parts(group)
        fresh = renamed[group[begins]]
        self.begin[fresh], self.size[fresh] = self.place[at[begins]], np.diff(begins, append=len(at))
        self.name[at] = renamed[group]
        left = self.unlink(at, old)
        self.link(at, group)
        few = owner[(rest > 0) & (rest < most)]
        others = [self.members[b : b + s] for b, s in zip(self.begin[few].tolist(), self.size[few].tolist())]
        self.small = np.concatenate([at[goes_on[group]], *others])
        self.note(np.concatenate([left, at]))
        return True

    def swap(self, at: np.ndarray, old: np.ndarray) -> None:
        """Put the leaving members at the end of their class's stretch of `members` and shorten it."""
        begins = parts(old)
        number = np.diff(begins, append=len(at))
        owner = old[begins]
        first = self.begin[owner] + self.size[owner] - number
        slots = np.repeat(first - begins, number) + np.arange(len(at))
        self.moved[at] = True
        there = self.members[slots]
        there = there[~self.moved[there]]
        self.moved[at] = False
        free = self.place[at]
        free = free[free < np.repeat(first, number)]
        self.members[free], self.place[there] = there, free
        self.members[slots], self.place[at] = at, slots
        self.size[owner] -= number

    def unlink(self, at: np.ndarray, old: np.ndarray) -> np.ndarray:
        """Take the leaving members out of their class's chain; the members before the gaps."""
        at = at[np.lexsort((at, old))]
        head = np.concatenate([[True], self.after[at[:-1]] != at[1:]])
        tail = np.concatenate([head[1:], [True]])
        left, right = self.before[at[head]], self.after[at[tail]]
        self.after[left], self.before[right] = right, left
        return left[left < self.n]


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Of each list of words: its runs (start, length, period) by start, then period."""
    names, first, longest, count = [], [0], [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        names.append(np.array([known.setdefault(w, len(known)) for w in words] + [len(known)], np.int64) + count)
        # The last name is the text's end, which no other position shares.
        count += len(known) + 1
        first.append(first[-1] + len(words) + 1)
        longest.append(len(words) // MIN_TIMES)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return out
    begin = np.array(first)
    classes = Classes(np.concatenate(names), np.repeat(longest, np.diff(begin)))
    while True:
        p, at = classes.level, classes.squares()
        if len(at):
            cut = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
            length = np.diff(cut, append=len(at)) + 2 * p - 1
            long = length >= max(MIN_WORDS, MIN_TIMES * p)
            start = at[cut[long]]
            text = np.searchsorted(begin, start, "right") - 1
            for t, s, n in zip(text.tolist(), (start - begin[text]).tolist(), length[long].tolist()):
                out[t].append((s, n, p))
        if p >= max(longest) or not classes.refine():
            break
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(change).tolist()) if not d]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, runs by start and period, and collapsed, the words that no run repeats, joined by one space."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [(t or "").encode().split() for t in f["text"]]
            runs = runs_of(texts)
            left = [b" ".join(collapse(w, r)).decode() for w, r in zip(texts, runs, strict=True)]
            structs = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
            yield pd.DataFrame({"doc_id": f["doc_id"], "runs": structs, "collapsed": left})

    return map_frames(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, f"doc_id long, runs {RUNS}, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """Of the rows of periodic_runs: number of runs, the run of the largest exponent (ties: the first), and digests."""
    more = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), more)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
