"""SentencePiece encoding and decoding by a batched numpy Viterbi pass.

The text's words (cut where no piece of the vocabulary can reach across) are looked up in a bounded
cache; new ones are encoded together with all others of the same length. Substring hashes probe the
sorted keys of the pieces, all words of a length advance together, and at each end position the
vectorised maximum over the pieces that end there is kept with its back pointer.

For a unigram model (`Vocabulary.merges` false) the maximum is over all paths. The public vocabulary
used here is a BPE model. There a piece may follow another only if the encoder itself would leave the
two side by side (`compatible`); every prefix of a word then has exactly one path left, so the maximum
gives the ids of the model's own encoder. `compatible` undoes the merges at the border of the two
pieces, latest first, and looks for a merge across the border that would have come before them.
Characters without a piece become byte pieces and join with nothing. `▁` in a text is read as a
space, as the model itself does.

A null text encodes as an empty one, without ids. Texts of any length are encoded whole; equal rows give
equal results, a null or repeated doc_id is passed on as it is, an empty table gives no rows and extra
columns are ignored; rows are independent.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import map_frames

#: Bytes of words and ids that a worker keeps; longer words than KEPT_CHARS are not kept.
CACHE_BYTES, KEPT_CHARS = 72 << 20, 64
#: Bytes that one cached word takes besides its characters and ids.
ENTRY_BYTES = 200
#: Cells of the word matrix that advance together.
BATCH_CELLS = 250_000
INDEX_BITS = 19
#: Slots for the answers about pairs of pieces.
PAIR_BITS = 21
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
NONE = np.float32(-np.inf)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Vocabulary:
    """Pieces of a SentencePiece model as sorted substring hashes with ids and scores."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.full(256, sp.unk_id(), np.int32)
        self.text = [b""] * n
        plain = []
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.text[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append(i)
                self.text[i] = p.replace("▁", " ").encode()
        self.longest = max((len(self.pieces[i]) for i in plain), default=1)
        self.power = BASE ** np.arange(self.longest + 2, dtype=np.uint64)
        keys = np.array([self.key(self.codes(self.pieces[i])) for i in plain], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(plain, np.int32)[order]
        self.scores = np.array([sp.get_score(int(i)) for i in self.ids], np.float32)
        self.size = np.array([len(self.pieces[i]) for i in self.ids.tolist()], np.int32)
        # Where the sorted keys of each leading INDEX_BITS bits begin, and the most that share them.
        self.index = np.searchsorted(self.keys, np.arange(1 << INDEX_BITS, dtype=np.uint64) << np.uint64(64 - INDEX_BITS))
        self.index = np.append(self.index, len(self.keys)).astype(np.int32)
        self.crowd = int(np.diff(self.index).max())
        inner = [self.pieces[i] for i in plain]
        self.splits_at_space = not any("▁" in p.lstrip("▁") for p in inner)
        self.splits_at_line = not any("\n" in p for p in inner)
        self.cut = self.cutter(inner)
        # A BPE model's scores are the negative order of its merges, whole numbers.
        self.runs: dict[int, int] = {}
        self.merges = bool(len(plain)) and bool((self.scores == np.round(self.scores)).all())
        if self.merges:
            self.learn_borders()

    @staticmethod
    def codes(word: str) -> np.ndarray:
        return np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)

    def key(self, codes: np.ndarray) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in codes:
            h = h * BASE + c
        return scramble(h)[0]

    def cutter(self, pieces: list[str]) -> re.Pattern | None:
        """Finds the pieces of work in a text: spaces, signs, then letters; only signs that follow a letter in some piece join on."""
        if not self.splits_at_space:
            return None
        pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False) if b not in "▁\n"}
        is_sign = lambda c: not c.isalnum()
        odd = {a for a, b in pairs if not is_sign(a) and is_sign(b)}
        joins = {b for a, b in pairs if not is_sign(a) and a not in odd and (is_sign(b) or b in odd)}
        line, more = ("\n" if self.splits_at_line else ""), re.escape("".join(sorted(odd)))
        sign, letter = rf"[\W_{more}](?<![▁{line}])", rf"[^\W_{more}]"
        tail = rf"(?:[{re.escape(''.join(sorted(joins)))}](?:{sign})*{letter}*)*" if joins else ""
        return re.compile(rf"▁*{letter}+{tail}|▁+(?:{sign})*(?:{letter}+{tail})?|(?:{sign})+(?:{letter}+{tail})?" + (r"|\n" if line else ""))

    def words(self, text: str) -> list[str]:
        """The text cut before spaces (and around lines): no vocabulary piece crosses from one word to the next."""
        text = "▁" + text.replace(" ", "▁")
        if self.splits_at_space and self.splits_at_line:
            return re.findall(r"\n|▁+[^▁\n]*|[^▁\n]+", text)
        return re.findall(r"▁+[^▁]*|[^▁]+", text) if self.splits_at_space else [text]

    def parts(self, words: list[str]) -> dict[str, list[str]]:
        """The words cut further, where no piece crosses either; many words share their parts."""
        if not (self.cut and self.splits_at_line):
            return {w: self.cut.findall(w) if self.cut else [w] for w in words}
        # One pass over all words: a line end, which no word but itself holds, parts them.
        found = self.cut.findall("\n".join([w for w in words if w != "\n"]))
        ends = [i for i, p in enumerate(found) if p == "\n"]
        cuts = zip([0, *[e + 1 for e in ends]], [*ends, len(found)], strict=True)
        return dict(zip([w for w in words if w != "\n"], [found[a:b] for a, b in cuts], strict=False)) | {w: [w] for w in words if w == "\n"}

    def learn_borders(self) -> None:
        """What `compatible` needs of each piece: its order, the pieces of its last merge, its hash, and whether it comes up at all.

        The last entry of each array stands for a character without a piece.
        """
        n = len(self.keys)
        # Runs of spaces: pieces of one score below all others are merged last, from the left.
        spaces = np.array([not self.pieces[i].strip("▁") for i in self.ids.tolist()])
        runs, others = self.scores[spaces & (self.size > 1)], self.scores[~spaces & (self.size > 1)]
        if self.splits_at_space and len(runs) and len(others) and runs.max() == runs.min() < others.min():
            self.runs = {int(k): int(i) for k, i in zip(self.size[spaces], self.ids[spaces], strict=True)}
        elif len(np.unique(self.scores[self.size > 1])) < (self.size > 1).sum():
            raise ValueError("merges of equal scores")
        order = np.unique(-self.scores, return_inverse=True)[1].astype(np.int32)
        # Single characters are there before any merge.
        self.order = np.append(np.where(self.size == 1, -1, order), -1).astype(np.int32)
        self.left, self.right = np.full(n + 1, n, np.int32), np.full(n + 1, n, np.int32)
        self.whole = np.append(self.size == 1, True)
        self.hash = np.zeros(n + 1, np.uint64)
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)
        for size in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size == size)
            codes = np.stack([self.codes(self.pieces[i]) for i in self.ids[at].tolist()])
            prefix = prefix_hashes(codes)
            self.hash[at] = prefix[:, -1]
            if size > 1:
                cut = last_merge(self, codes)
                done = cut > 0
                at, cut, prefix = at[done], cut[done], prefix[done]
                self.whole[at] = True
                self.left[at] = self.find(prefix[np.arange(len(at)), cut])
                self.right[at] = self.find(prefix[:, -1] - prefix[np.arange(len(at)), cut] * self.power[size - cut])

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`compatible`, with the answers for the pairs last seen in each slot of a fixed table."""
        pair = a.astype(np.int64) << 32 | b
        slot = (pair.view(np.uint64) * BASE >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        held = self.pairs[slot]
        ok = (held & 1).astype(bool)
        fresh = np.flatnonzero(held >> 1 != pair)
        if len(fresh):
            _, first, place = np.unique(pair[fresh], return_index=True, return_inverse=True)
            at = fresh[first]
            answer = self.compatible(a[at], b[at])
            self.pairs[slot[at]] = pair[at] << 1 | answer
            ok[fresh] = answer[place]
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves piece a (place in keys; len(keys): a character without a piece) side by side with piece b."""
        n = len(self.keys)
        ok = np.ones(len(a), bool)
        rows = np.flatnonzero((a < n) & (b < n))
        a, b = a[rows], b[rows]
        # A merge across the border counts only if its order is below that of what has been undone so far.
        limit = np.full(len(rows), np.iinfo(np.int32).max, np.int32)
        while len(rows):
            size = self.size[b]
            fits = self.size[a] + size <= self.longest
            both = self.find(np.where(fits, self.hash[a] * self.power[size] + self.hash[b], np.uint64(0)))
            across = fits & (both < n) & (self.order[both] < limit)
            ok[rows[across]] = False
            later_a = self.order[a] > self.order[b]
            go = ~across & (later_a | (self.order[b] >= 0))
            rows, a, b, later_a = rows[go], a[go], b[go], later_a[go]
            # Of two merges of one order the left one comes first.
            limit = np.where(later_a, self.order[a], self.order[b] + 1)
            a, b = np.where(later_a, self.right[a], a), np.where(later_a, b, self.left[b])
            known = (a < n) & (b < n)
            rows, a, b, limit = rows[known], a[known], b[known], limit[known]
        return ok

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places in keys of substring hashes; len(keys) where there is no piece."""
        h = scramble(hashes).ravel()
        top = (h >> np.uint64(64 - INDEX_BITS)).astype(np.int32)
        at, stop = self.index[top], self.index[top + 1]
        found = np.full(len(h), len(self.keys), np.int32)
        open_rows = np.flatnonzero(at < stop)
        for k in range(self.crowd):
            open_rows = open_rows[at[open_rows] + k < stop[open_rows]]
            hit = self.keys[at[open_rows] + k] == h[open_rows]
            found[open_rows[hit]] = at[open_rows[hit]] + k
            open_rows = open_rows[~hit]
        return found.reshape(hashes.shape)


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Rolling hashes of all prefixes of equally long words (rows)."""
    n, size = codes.shape
    out = np.zeros((n, size + 1), np.uint64)
    for i in range(size):
        out[:, i + 1] = out[:, i] * BASE + codes[:, i]
    return out


def last_merge(v: Vocabulary, codes: np.ndarray) -> np.ndarray:
    """Where the last merge joins each of equally long words into one piece; 0 for words that merging leaves in several."""
    n, size = codes.shape
    prefix = prefix_hashes(codes)
    scores = np.append(v.scores, NONE)
    end = np.tile(np.arange(1, size + 1), (n, 1))
    before = np.tile(np.arange(-1, size), (n, 1))
    gain = np.full((n, size), NONE, np.float32)
    cut = np.zeros(n, np.int64)

    def value(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return scores[v.find(prefix[rows, b] - prefix[rows, a] * v.power[b - a])]

    r, c = np.divmod(np.arange(n * (size - 1)), size - 1)
    gain[r, c] = value(r, c, c + 2)
    rows = np.arange(n)
    while len(rows):
        at = np.argmax(gain[rows], axis=1)
        live = gain[rows, at] > NONE
        rows, at = rows[live], at[live]
        middle = end[rows, at]
        stop = end[rows, middle]
        whole = (at == 0) & (stop == size)
        cut[rows[whole]] = middle[whole]
        end[rows, at] = stop
        gain[rows, middle] = NONE
        inner = stop < size
        before[rows[inner], stop[inner]] = at[inner]
        gain[rows, at] = NONE
        r, a = rows[inner], at[inner]
        gain[r, a] = value(r, a, end[r, stop[inner]])
        left = before[rows, at]
        has = left >= 0
        gain[rows[has], left[has]] = value(rows[has], left[has], stop[has])
    return cut


def viterbi(v: Vocabulary, codes: np.ndarray, unknown: float = -1e6) -> list[bytes]:
    """Little-endian 32-bit ids of the best path of each of equally long words, which come sorted."""
    n, size = codes.shape
    none = len(v.keys)
    prefix = prefix_hashes(codes)
    scores = np.append(v.scores.astype(np.float64), -np.inf)
    best = np.full((n, size + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, size + 1), np.int32)
    last = np.full((n, size + 1), none, np.int32)
    for stop in range(1, size + 1):
        # Neighbours that begin alike up to here (the words are sorted) have one answer.
        new = np.ones(n, bool)
        np.not_equal(prefix[1:, stop], prefix[:-1, stop], out=new[1:])
        head, group = np.flatnonzero(new), np.cumsum(new) - 1
        lengths = np.arange(1, min(stop, v.longest) + 1)
        piece = v.find(prefix[head, stop, None] - prefix[head[:, None], stop - lengths] * v.power[lengths])
        score = scores[piece]
        score[:, 0] = np.where(piece[:, 0] < none, score[:, 0], unknown)
        before = best[head[:, None], stop - lengths]
        total = before + score
        if v.merges:
            # One path is left to each prefix, so once a row has a piece that fits its others need no look.
            left = np.isfinite(total)
            total[:] = -np.inf
            rows = np.arange(len(head))
            for k in range(len(lengths) - 1, -1, -1):
                at = rows[left[rows, k]]
                own, start = piece[at, k], stop - lengths[k]
                ok = v.whole[own]
                if start:
                    ok = ok & v.fits(last[head[at], start], own)
                at = at[ok]
                total[at, k] = before[at, k] + score[at, k]
                rows = rows[~np.isfinite(total[rows, k])]
        k = np.argmax(total, axis=1)
        every = np.arange(len(head))
        best[:, stop] = total[every, k][group]
        back[:, stop] = (stop - lengths[k])[group]
        last[:, stop] = piece[every, k][group]
    # Back pointers are followed from the end of every word at once.
    used = np.zeros((n, size + 1), bool)
    rows, stop = np.arange(n), np.full(n, size)
    while len(rows):
        used[rows, stop] = True
        stop = back[rows, stop]
        rows, stop = rows[stop > 0], stop[stop > 0]
    r, stop = np.nonzero(used)
    place = last[r, stop]
    ids = np.append(v.ids, -1)[place].astype("<i4")
    cut = np.searchsorted(r, np.arange(n + 1))
    raw, lost = ids.tobytes(), set(r[ids < 0].tolist())
    out = [raw[4 * i : 4 * j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    for w in lost:
        got: list[int] = []
        for k in range(cut[w], cut[w + 1]):
            if ids[k] >= 0:
                got.append(int(ids[k]))
            else:
                char = chr(int(codes[w, stop[k] - 1]) - 1)
                got += v.byte_ids[np.frombuffer(char.encode("utf-8", "replace"), np.uint8)].tolist()
        out[w] = np.array(got, "<i4").tobytes()
    return out


def encode_words(v: Vocabulary, words: list[str]) -> dict[str, bytes]:
    """The ids of distinct words; those of one length are encoded together."""
    spaced = [w for w in words if v.runs and w.startswith("▁▁")]
    if spaced:
        cores = {w: "▁" + w.lstrip("▁") for w in spaced}
        words = list(set(words).difference(spaced).union(cores.values()))
    by_length: dict[int, list[str]] = {}
    for w in sorted(words):
        by_length.setdefault(len(w), []).append(w)
    out: dict[str, bytes] = {}
    for size, same in by_length.items():
        step = max(1, BATCH_CELLS // max(1, size))
        for i in range(0, len(same), step):
            part = same[i : i + step]
            codes = v.codes("".join(part)).reshape(len(part), size)
            out.update(zip(part, viterbi(v, codes), strict=True))
    for w in spaced:
        core, n = out[cores[w]], len(w) - len(cores[w])
        alone = core[:4] == np.array([v.runs[1]], "<i4").tobytes()
        out[w] = space_run(v, n + alone) + core[4 * alone :]
    return out


def space_run(v: Vocabulary, n: int) -> bytes:
    """The ids of n spaces, merged from the left."""
    sizes: list[int] = []
    for _ in range(n):
        sizes.append(1)
        while len(sizes) > 1 and sizes[-2] + sizes[-1] in v.runs:
            sizes[-2:] = [sizes[-2] + sizes[-1]]
    return np.array([v.runs[k] for k in sizes], "<i4").tobytes()


class Encoder:
    """Encodes texts, with a cache of words that is bounded by its bytes."""

    def __init__(self, path: str) -> None:
        self.vocabulary, self.known, self.held = Vocabulary(path), {}, 0

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.vocabulary.words(t) if t else [] for t in texts]
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        known = self.known
        new = self.vocabulary.parts([w for w in set(chain.from_iterable(split)) if w not in known])
        got = encode_words(self.vocabulary, [p for p in set(chain.from_iterable(new.values())) if p not in known])
        got.update([(w, b"".join([got[p] if p in got else known[p] for p in parts])) for w, parts in new.items() if len(parts) > 1])
        rare = {w: got.pop(w) for w in [w for w in got if len(w) > KEPT_CHARS]}
        self.held += sum(map(len, got)) + sum(map(len, got.values())) + ENTRY_BYTES * len(got)
        known.update(got)
        if rare:
            return [b"".join([known[w] if w in known else rare[w] for w in words]) for words in split]
        return [b"".join([known[w] for w in words]) for words in split]

    def decode(self, ids: bytes) -> str:
        table = self.vocabulary.text
        text = b"".join([table[i] for i in np.frombuffer(ids, "<i4").tolist()]).decode("utf-8", "replace")
        return text.removeprefix(" ")


@cache
def encoder(path: str) -> Encoder:
    """One encoder a Python worker, so that its cache lasts over batches and tasks."""
    return Encoder(path)


def encode_decode(docs: DataFrame, model: str, ids: bool = True, decoded: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_crc32, decoded_chars, round_trip; with them on demand ids and the decoded text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(model)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            coded = e.encode(texts)
            back = [e.decode(x) for x in coded]
            out = {
                "doc_id": pdf["doc_id"].array,
                "n_tokens": [len(x) // 4 for x in coded],
                "ids_crc32": [zlib.crc32(x) for x in coded],
                "decoded_chars": [len(t) for t in back],
                "round_trip": [b == t.replace("▁", " ") for b, t in zip(back, texts, strict=True)],
            }
            if ids:
                out["ids"] = [np.frombuffer(x, "<i4") for x in coded]
            if decoded:
                out["decoded"] = back
            yield pd.DataFrame(out)

    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_chars long, round_trip boolean" + ", ids array<int>" * ids + ", decoded string" * decoded
    return map_frames(docs.select("doc_id", "text"), run, schema)
