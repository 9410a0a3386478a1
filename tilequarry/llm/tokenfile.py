"""Token-id files: documents as ids in independently coded, checksummed blocks.

A file is a row of frames; a frame holds whole documents in ascending doc_id order. Its symbols are ids and, for what
comes more than once in the frame, pre-tokens of several ids (words, if they are not cut); what comes once is spelled by its ids.
The symbols are cut into blocks of BLOCK_IDS. Each block starts from a fresh model and has its own checksums, so a damaged
block costs only itself and is noticed.

The coder mixes three predictions of the next symbol: order 2 expects the one that followed the last
two, order 1 the one that followed the last, and order 0 has a chance for every symbol, by how often it comes in the frame.
Orders 2 and 1 and the weights of the three, for each state of confidence of orders 2 and 1, are learnt in the block;
the mixed chances divide the range of a range coder whose carries run into the digits written before. All arithmetic is on
integers.
The blocks of a frame advance together in numpy.

Frame layout (little endian): magic, crc32 of all up to the blocks' bytes, distinct symbols, bytes of their list, documents, symbols, blocks; then doc_id (int64), null flag
(uint8) and length (uint32) of each document; how many symbols have 2 ** 0, 2 ** 1 ... of the places of order 0 (uint32); the list, most
frequent symbol first, by whose ranks the blocks name them: number of ids (uint8) of each, then their ids (uint32), compressed;
then for each block its ids (uint32), bytes (uint32), crc32 of its ids and crc32 of its bytes; then the blocks' bytes.

A null text is an empty document, which has only the end id. Documents without a doc_id come first.
Extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, compress, pairwise

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hash_parts, map_frames, materialize, mix64

MAGIC = b"TQF4"
HEAD = "<4sIIIIQI"
#: Bytes of a frame before what the first checksum is of.
UNCHECKED = 8
#: Symbols of a block.
BLOCK_IDS = 2048
#: Pre-tokens and words after which a frame is closed (at the end of a document).
FRAME_WORDS = 4_000_000
END_ID = 2
SLOT_BITS = 10
#: Words that are symbols of a frame, and all symbols of one.
MOST_WORDS, MOST_SYMBOLS = 1 << 18, 1 << 19
#: Pre-tokens that go to the tokenizer's model as one text.
PARTS = 200
#: Words, and pre-tokens, that one of two caches holds.
CACHE_WORDS = 300_000
#: Stands between the ids of words; no id below 2 ** 16 has these bytes, nor have two of them where they meet.
LINE = b"\xff\xff\xff\xff"

#: Kinds of bytes, and masks of the first bytes of eight.
SPACES, LETTER, FIGURE, SIGN, ODD = range(5)
HEAD_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

U = np.uint64
#: A range is 64 bits wide and never below BOTTOM; digits are 32 bits wide.
DIGIT, BOTTOM = U(32), U(1 << 32)
#: Shares of the range: the three orders' weights, and the places in order 0.
ONE_BITS, ZERO_BITS = 10, 20
ONE, ZERO_ONE = 1 << ONE_BITS, 1 << ZERO_BITS
UNIT_BITS = U(ONE_BITS + ZERO_BITS)
#: Symbols of one width begin and end at multiples of 2 ** GRID_BITS.
GRID_BITS = 8
#: Weights of orders 2 and 1 at the start, by the confidence in each and whether they agree; MOST is the most that both have.
MOST = np.int32(ONE - 32)
START_WEIGHTS = np.array([[40 + 180 * (k >> 3) for k in range(32)], [20 + 60 * (k >> 1 & 3) for k in range(32)]], np.int32)
#: What a slot gains, by its confidence: after a wrong guess, then after a right one.
STEP = np.array([0, -1, -1, -1, 1, 1, 1, 0], np.int32)


class Places:
    """Order 0: where each symbol of a frame lies in 2 ** ZERO_BITS places, by the widths (powers of two) of its symbols, widest first."""

    def __init__(self, by_width: np.ndarray) -> None:
        """by_width: how many symbols have 2 ** 0, 2 ** 1, ... places."""
        bits = np.arange(ZERO_BITS, -1, -1)
        many = np.asarray(by_width, np.int64)[::-1]
        size = -(-(many << bits) >> GRID_BITS) << GRID_BITS
        begin, first = np.cumsum(size) - size, np.cumsum(many) - many
        self.bits = np.repeat(bits, many).astype(np.uint8)
        self.start = (np.repeat(begin - (first << bits), many) + (np.arange(many.sum()) << self.bits.astype(np.int64))).astype(np.int32)
        kind = np.repeat(np.arange(len(bits)), size >> GRID_BITS)
        # By the place's grid cell: the bits of its symbols' widths, and what makes a symbol of a place shifted by them.
        cells = ZERO_ONE >> GRID_BITS
        self.cell_bits, self.cell_first = np.zeros(cells, np.int32), np.zeros(cells, np.int32)
        self.cell_bits[: len(kind)], self.cell_first[: len(kind)] = bits[kind], (first - (begin >> bits))[kind]

    @staticmethod
    def widths(times: np.ndarray) -> np.ndarray:
        """How many symbols get each width, for falling frequencies: as close to them as fits."""
        share = np.log2(times * (ZERO_ONE / times.sum()))
        give = 0.75
        while True:
            bits = np.clip(np.floor(share + give), 0, ZERO_BITS).astype(np.int64)
            many = np.bincount(bits, minlength=ZERO_BITS + 1)
            if (-(-(many << np.arange(ZERO_BITS + 1)) >> GRID_BITS) << GRID_BITS).sum() <= ZERO_ONE:
                return many
            give -= 0.05


class Model:
    """The adaptive state of many blocks that advance together, one lane each. Rows of two: order 2, then order 1."""

    def __init__(self, lanes: int) -> None:
        self.lanes = lanes
        self.pairs = np.zeros(2 * lanes << SLOT_BITS, np.int32)  # symbol << 2 | confidence
        self.base = np.arange(2 * lanes).reshape(2, lanes) << SLOT_BITS
        self.weights = np.repeat(START_WEIGHTS, lanes, axis=1).ravel()
        self.weight_base = np.arange(lanes) + np.array([[0], [START_WEIGHTS.shape[1] * lanes]])
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def predict(self, n: int) -> None:
        """For the first n lanes the symbols that orders 2 and 1 expect, and where the shares of orders 1 and 0 begin."""
        slots = np.empty((2, n), np.int64)
        np.multiply(self.last[:n], 40503, out=slots[1])
        np.multiply(self.before[:n], 2654435, out=slots[0])
        slots[0] += slots[1]
        self.before[:n] = self.last[:n]
        slots ^= slots >> 7
        slots &= (1 << SLOT_BITS) - 1
        slots += self.base[:, :n]
        self.slots = slots
        self.held = held = self.pairs.take(slots)
        self.ids = ids = held >> 2
        self.sure = sure = held & 3
        setting = np.empty((2, n), np.int64)
        setting[0] = (sure[0] << 3) + (sure[1] << 1) + (ids[0] == ids[1])
        setting[0] *= self.lanes
        setting[1] = setting[0]
        setting += self.weight_base[:, :n]
        self.setting = setting
        self.own = own = self.weights.take(setting)
        self.begin1 = own[0] + 1
        self.begin0 = self.begin1 + own[1]
        self.begin0 += 1
        self.own0 = ONE - self.begin0
        self.begin1 <<= ZERO_BITS
        self.begin0 <<= ZERO_BITS

    def learn(self, x: np.ndarray, right: np.ndarray, used: np.ndarray) -> None:
        """Learn the symbols; right: which orders expected them, used: which order coded them."""
        gain = np.multiply(used, MOST)
        gain -= self.own
        gain >>= 5
        gain += self.own
        self.weights[self.setting] = gain
        # A right guess gains confidence (3 at most), a wrong one loses it, and one without any gives way.
        kind = right.view(np.int8) << 2
        kind += self.sure.astype(np.int8)
        new = self.held + STEP.take(kind)
        np.copyto(new, x << 2 | 1, where=kind == 0)
        self.pairs[self.slots] = new
        self.last[: len(x)] = x


def lanes_of(symbols: np.ndarray) -> tuple[np.ndarray, int]:
    """The symbols as a matrix, one row a step and one column a block, and the number of steps; only the last block may be short."""
    blocks = max(1, -(-len(symbols) // BLOCK_IDS))
    full = np.zeros(blocks * BLOCK_IDS, np.int32)
    full[: len(symbols)] = symbols
    return np.ascontiguousarray(full.reshape(blocks, BLOCK_IDS).T), min(BLOCK_IDS, len(symbols))


def active(total: int, blocks: int, step: int) -> int:
    return blocks if (blocks - 1) * BLOCK_IDS + step < total else blocks - 1


def encode_blocks(symbols: np.ndarray, places: Places) -> list[bytes]:
    columns, steps = lanes_of(symbols)
    blocks = columns.shape[1]
    model = Model(blocks)
    low, size = np.zeros(blocks, U), np.full(blocks, U(2**64 - 1), U)
    # One column a block. A symbol takes 30 bits at most; a carry ends in a digit that the block has.
    out = np.zeros((min(BLOCK_IDS, len(symbols)) + 3) * blocks, np.uint32)
    used = np.arange(blocks)
    for step in range(steps):
        n = active(len(symbols), blocks, step)
        x = columns[step, :n]
        model.predict(n)
        right = model.ids == x
        by2, by1 = by = right.copy()
        by1 &= ~by2
        own0, begin1, begin0 = model.own0, model.begin1, model.begin0
        start = places.start.take(x)
        start *= own0
        start += begin0
        share = own0 << places.bits.take(x)
        np.copyto(start, begin1, where=by1)
        np.copyto(start, 0, where=by2)
        begin0 -= begin1
        np.copyto(share, begin0, where=by1)
        np.copyto(share, begin1, where=by2)
        unit = size[:n] >> UNIT_BITS
        ahead = start.astype(U)
        ahead *= unit
        low[:n] += ahead
        if len(at := np.flatnonzero(low[:n] < ahead)):
            place = used[at] - blocks
            while len(place):
                out[place] += np.uint32(1)
                place = place[out[place] == 0] - blocks
        unit *= share.astype(U)
        size[:n] = unit
        if len(at := np.flatnonzero(unit < BOTTOM)):
            own, place = low.take(at), used.take(at)
            out[place] = own >> DIGIT
            used[at] = place + blocks
            low[at] = own << DIGIT
            size[at] = unit.take(at) << DIGIT
        model.learn(x, right, by)
    for _ in range(2):
        out[used] = low >> DIGIT
        used += blocks
        low <<= DIGIT
    digits = np.ascontiguousarray(out.astype("<u4").reshape(-1, blocks).T)
    return [row[:n].tobytes() for row, n in zip(digits, (used // blocks).tolist(), strict=True)]


def decode_blocks(payload: list[bytes], total: int, places: Places) -> np.ndarray:
    blocks = len(payload)
    digits = np.zeros((blocks, max(map(len, payload)) // 4 + 2), "<u4")
    for row, p in zip(digits, payload, strict=True):
        row[: len(p) // 4] = np.frombuffer(p, "<u4")
    data = np.ascontiguousarray(digits.T).astype(U)
    # `code` is the coded number less the low end of the range.
    code = data[0] << DIGIT | data[1]
    data = data.ravel()
    model = Model(blocks)
    size = np.full(blocks, U(2**64 - 1), U)
    used = np.arange(blocks) + 2 * blocks
    result = np.zeros((BLOCK_IDS, blocks), np.int32)
    for step in range(min(BLOCK_IDS, total)):
        n = active(total, blocks, step)
        model.predict(n)
        unit = size[:n] >> UNIT_BITS
        value = (code[:n] // unit).astype(np.int32)
        begin1, begin0, own0 = model.begin1, model.begin0, model.own0
        by = np.empty((2, n), bool)
        by2, by1 = by
        np.less(value, begin1, out=by2)
        np.less(value, begin0, out=by1)
        by1 ^= by2
        # What this makes of lanes that orders 2 or 1 coded is put right below.
        value -= begin0
        value //= own0
        cell = value >> GRID_BITS
        value >>= places.cell_bits.take(cell, mode="clip")
        value += places.cell_first.take(cell, mode="clip")
        x = value
        start = places.start.take(x, mode="clip")
        start *= own0
        start += begin0
        share = own0 << places.bits.take(x, mode="clip")
        np.copyto(x, model.ids[1], where=by1)
        np.copyto(x, model.ids[0], where=by2)
        np.copyto(start, begin1, where=by1)
        np.copyto(start, 0, where=by2)
        begin0 -= begin1
        np.copyto(share, begin0, where=by1)
        np.copyto(share, begin1, where=by2)
        ahead = start.astype(U)
        ahead *= unit
        code[:n] -= ahead
        unit *= share.astype(U)
        size[:n] = unit
        if len(at := np.flatnonzero(unit < BOTTOM)):
            place = used.take(at)
            code[at] = code.take(at) << DIGIT | data.take(place, mode="clip")
            used[at] = place + blocks
            size[at] = unit.take(at) << DIGIT
        result[step, :n] = x
        model.learn(x, model.ids == x, by)
    return result.T.ravel()[:total]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of stretches of an array, one stretch after the other."""
    ends = np.cumsum(lengths)
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(len(out))
    return out


def write_frame(doc_ids: list[int | None], lengths: list[int], words: np.ndarray, ids: np.ndarray | None = None, begin: np.ndarray | None = None) -> bytes:
    """A frame of the ids of `words`: word w stands for ids[begin[w] : begin[w + 1]]; without those for w itself."""
    if ids is None:
        ids = np.arange(words.max() + 1 if len(words) else 0, dtype=np.int32)
        begin = np.arange(len(ids) + 1)
    size = np.diff(begin)
    # A word of several ids that comes again is a symbol of its own, after those of single ids; others are spelled.
    often = np.bincount(words, minlength=len(size))
    own = np.flatnonzero((often > 1) & (size > 1) & (size < 256))
    singles = int(ids.max()) + 1 if len(ids) else 0
    if len(own) > (most := max(0, min(MOST_WORDS, MOST_SYMBOLS - singles))):
        own = np.sort(own[np.argsort(-often[own], kind="stable")[:most]])
    spelling, at, many = np.concatenate([ids, singles + np.arange(len(own), dtype=np.int32)]), begin[:-1].copy(), size.copy()
    at[own], many[own] = len(ids) + np.arange(len(own)), 1
    symbols = spelling[ragged(at[words], many[words])]
    times = np.bincount(symbols, minlength=singles + len(own))
    ranked = np.argsort(-times, kind="stable")[: np.count_nonzero(times)]
    if len(ranked) > MOST_SYMBOLS:
        raise ValueError(f"more than {MOST_SYMBOLS} distinct ids in a frame")
    rank = np.zeros(len(times), np.int32)
    rank[ranked] = np.arange(len(ranked), dtype=np.int32)
    symbols = rank[symbols]
    # What each symbol stands for, in the order of ranks.
    begins, sizes = np.concatenate([np.arange(singles), singles + begin[own]]), np.concatenate([np.ones(singles, np.int64), size[own]])[ranked]
    listed = np.concatenate([np.arange(singles, dtype=np.int32), ids])[ragged(begins[ranked], sizes)]
    widths = Places.widths(times[ranked]) if len(ranked) else np.zeros(ZERO_BITS + 1, np.int64)
    coded = encode_blocks(symbols, Places(widths)) if len(symbols) else []
    raw, first = listed.astype("<u4"), np.cumsum(sizes) - sizes
    table = []
    for i, c in enumerate(coded):
        part = symbols[i * BLOCK_IDS : (i + 1) * BLOCK_IDS]
        told = raw[ragged(first[part], sizes[part])]
        table.append((len(told), len(c), zlib.crc32(told.tobytes()), zlib.crc32(c)))
    names = zlib.compress(sizes.astype(np.uint8).tobytes() + raw.tobytes(), 1)
    lists = b"".join(
        [
            struct.pack(HEAD, MAGIC, 0, len(ranked), len(names), len(doc_ids), len(symbols), len(coded)),
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array(lengths, "<u4").tobytes(),
            widths.astype("<u4").tobytes(),
            names,
            np.array(table, "<u4").tobytes(),
        ]
    )
    lists = lists[UNCHECKED:]
    return b"".join([MAGIC, struct.pack("<I", zlib.crc32(lists)), lists, *coded])


def read_frame(frame: bytes) -> tuple[list[int | None], list[int], np.ndarray]:
    """doc ids, lengths and ids of a frame; ValueError for a block that is not what was written."""
    magic, told, distinct, named, docs, total, blocks = struct.unpack_from(HEAD, frame)
    if magic != MAGIC:
        raise ValueError("not a token frame")
    at = struct.calcsize(HEAD)
    if zlib.crc32(frame[UNCHECKED : at + 13 * docs + 4 * (ZERO_BITS + 1) + named + 16 * blocks]) != told:
        raise ValueError("the lists of the frame are damaged")
    keys, at = np.frombuffer(frame, "<i8", docs, at), at + 8 * docs
    null, at = np.frombuffer(frame, np.uint8, docs, at), at + docs
    lengths, at = np.frombuffer(frame, "<u4", docs, at), at + 4 * docs
    widths, at = np.frombuffer(frame, "<u4", ZERO_BITS + 1, at), at + 4 * (ZERO_BITS + 1)
    names, at = zlib.decompress(frame[at : at + named]), at + named
    table, at = np.frombuffer(frame, "<u4", 4 * blocks, at).reshape(-1, 4), at + 16 * blocks
    payload = []
    for _, size, _, check in table.tolist():
        payload.append(frame[at : at + size])
        at += size
        if zlib.crc32(payload[-1]) != check:
            raise ValueError(f"block {len(payload) - 1} is damaged")
    sizes, listed = np.frombuffer(names, np.uint8, distinct).astype(np.int64), np.frombuffer(names, "<u4", offset=distinct).astype("<i4")
    first = np.cumsum(sizes) - sizes
    symbols = decode_blocks(payload, total, Places(widths)) if total else np.zeros(0, np.int32)
    # Some blocks at a time, as places take more memory than ids.
    step = 256 * BLOCK_IDS
    told = [listed[ragged(first[s], sizes[s])] for s in (symbols[i : i + step] for i in range(0, total, step))]
    ids = np.concatenate(told) if told else np.zeros(0, "<i4")
    raw, begin = ids.view(np.uint8), 0
    for i, (n, _, check, _) in enumerate(table.tolist()):
        if zlib.crc32(raw[4 * begin : 4 * (begin + n)]) != check:
            raise ValueError(f"block {i} decodes to other ids")
        begin += n
    return [None if z else int(k) for k, z in zip(keys, null, strict=True)], lengths.tolist(), ids


def byte_signs() -> list[tuple[str, str]]:
    """The bytes of Latin-1 letters, each as one letter, that byte-level models know by another sign."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    sign = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return [(chr(b), s) for b, s in sign.items() if 0x80 <= b < 0xC0]


BYTE_SIGNS = byte_signs()


class Tokens:
    """Encodes texts word by word with a tokenizer that never joins across ASCII white space.

    Words of ASCII and Latin-1 letters alone, which no normalisation but lower case touches, are cut into the
    tokenizer's own pre-tokens: many words share them, and thousands are encoded as one text. A pre-token's last id,
    and no other, ends a word, so the ids are told apart again. All other words go to the tokenizer one by one.
    """

    #: Words that may be cut; "<" could begin a special token.
    PLAIN = re.compile(r"[!-;=-~À-ÿ]+")
    PLAIN_LINES = re.compile(r"[!-;=-~À-ÿ\n]+")
    PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+|\n")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        ends = [i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[ends] = True
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.cuts = self.splits_alike()
        self.known: dict[bytes, bytes] = {}
        self.old_known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {"\n": LINE}
        self.old_parts: dict[str, bytes] = {}

    def splits_alike(self) -> bool:
        """Whether this tokenizer cuts and ends words as `PRE_TOKEN` does; if not, no word is cut."""
        steps, normalizer = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        sample = "".join(map(chr, [*range(0x21, 0x3C), *range(0x3D, 0x7F), *range(0xC0, 0x100)])) + " don't we'll i'd 3x+1 a'b 'sa ''s"
        low = sample.lower()
        if steps is None or normalizer is None or len(self.ends) > 1 << 16 or normalizer.normalize_str(sample) != low:
            return False
        if [low[a:b] for _, (a, b) in steps.pre_tokenize_str(low)] != self.PRE_TOKEN.findall(low):
            return False
        found = list(dict.fromkeys(self.PRE_TOKEN.findall(low)))
        if self.joined_ids(found).tolist() != self.tokenizer.encode_batch_fast([" ".join(found)], add_special_tokens=False)[0].ids:
            return False
        return all(self.ends[e.ids].tolist() == [False] * (len(e.ids) - 1) + [True] for e in self.tokenizer.encode_batch_fast(found, add_special_tokens=False))

    def ids_of(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(words), 10_000):
            got = self.tokenizer.encode_batch_fast(words[i : i + 10_000], add_special_tokens=False)
            out += [np.array(e.ids, "<i4").tobytes() for e in got]
        return out

    def joined_ids(self, parts: list[str]) -> np.ndarray:
        """The ids of pre-tokens by the tokenizer's model, which takes the bytes of a letter as signs of their own."""
        texts = [b" ".join(part).decode("latin-1") for part in ([p.encode() for p in parts[i : i + PARTS]] for i in range(0, len(parts), PARTS))]
        for byte, sign in BYTE_SIGNS:
            texts = [t.replace(byte, sign) for t in texts]
        return np.array(list(chain.from_iterable(e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False))), "<i4")

    def learn(self, words: list[bytes]) -> None:
        text = b"\n".join(words).decode()
        if not (self.cuts and self.PLAIN_LINES.fullmatch(text)):
            plain = [bool(self.cuts and self.PLAIN.fullmatch(w)) for w in text.split("\n")]
            odd = [w for w, p in zip(words, plain, strict=True) if not p]
            self.known.update(zip(odd, self.ids_of([w.decode() for w in odd]), strict=True))
            words = list(compress(words, plain))
            text = b"\n".join(words).decode()
        if not words:
            return
        found = self.PRE_TOKEN.findall(text.lower())
        new = self.unknown(set(found), self.parts, self.old_parts)
        for i in range(0, len(new), 5_000):
            part = new[i : i + 5_000]
            ids = self.joined_ids(part)
            stops = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            raw = ids.tobytes()
            self.parts.update(zip(part, [raw[a:b] for a, b in pairwise(stops)], strict=True))
        self.known.update(zip(words, b"".join(map(self.parts.__getitem__, found)).split(LINE), strict=True))

    @staticmethod
    def unknown(keys: set, fresh: dict, old: dict) -> list:
        """The keys that neither cache holds; those of the old one are put into the fresh one."""
        out = []
        for k in keys:
            if k not in fresh:
                if (got := old.get(k)) is None:
                    out.append(k)
                else:
                    fresh[k] = got
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.encode().split() for t in texts]
        # What a full cache held is kept until the next one is full, so that frequent words are not learnt again.
        if len(self.known) > CACHE_WORDS:
            self.known, self.old_known = {}, self.known
        if len(self.parts) > CACHE_WORDS:
            self.parts, self.old_parts = {"\n": LINE}, self.parts
        if new := self.unknown(set(chain.from_iterable(split)), self.known, self.old_known):
            self.learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


class Words:
    """Numbers for what stands between white space, and the ids of each number, made once and kept over batches.

    Pre-tokens of at most 24 bytes of plain signs are found in numpy by their bytes, all of a batch at once. Longer ones, and words with
    another sign or an apostrophe, are looked up one by one. New ones go to the tokenizer.
    """

    #: Numbers after which only those of the last frame that came again are kept.
    MOST = 600_000

    def __init__(self, t: Tokens) -> None:
        self.t = t
        kinds = np.full(256, ODD, np.uint8)
        kinds[list(b" \t\n\x0b\x0c\r")] = SPACES
        lower = bytearray(range(256))
        if t.cuts:
            kinds[0x21:0x7F] = SIGN
            kinds[list(b"<'")] = ODD
            kinds[0x30:0x3A] = FIGURE
            kinds[0x41:0x5B] = kinds[0x61:0x7B] = LETTER
            # Both bytes of a Latin-1 letter; 0x97 and 0xB7 after 0xC3 are no letters.
            kinds[0xC3] = kinds[0x80:0xC0] = LETTER
            kinds[[0x97, 0xB7]] = ODD
            for b in (*range(0x41, 0x5B), *range(0x80, 0x97), *range(0x98, 0x9F)):
                lower[b] += 32
        self.kinds, self.lower = kinds, bytes(lower)
        self.clear()

    def clear(self) -> None:
        #: The numbers of pre-tokens, where their keys' hashes or the next free slots are.
        self.table = np.full(1 << 16, -1, np.int32)
        self.keys = np.zeros((3, 1 << 16), np.uint64)
        # Number 0 is the end of a document.
        self.ids, self.sizes = [np.array([END_ID], "<i4")], [np.array([1])]
        self.n = 1
        self.others: dict[bytes, int] = {}

    def listed(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all numbers, and where each number's begin."""
        self.ids, self.sizes = [np.concatenate(self.ids)], [np.concatenate(self.sizes)]
        return self.ids[0], np.concatenate([[0], np.cumsum(self.sizes[0])])

    def add(self, raw: list[bytes]) -> None:
        self.ids.append(np.frombuffer(b"".join(raw), "<i4"))
        self.sizes.append(np.array([len(r) // 4 for r in raw], np.int64))
        self.n += len(raw)

    def add_keys(self, new: np.ndarray) -> None:
        """Give numbers to new pre-tokens, by their keys."""
        while self.n + new.shape[1] > self.keys.shape[1]:
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)], axis=1)
        self.keys[:, self.n : self.n + new.shape[1]] = new

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(mix64(keys[0], keys[1]), keys[2]) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def make_room(self, more: int) -> None:
        """Keep half of the table free when so many numbers are added."""
        if 2 * (self.n + more) <= len(self.table):
            return
        self.table = np.full(2 << (2 * (self.n + more)).bit_length(), -1, np.int32)
        left = np.flatnonzero(self.keys[0, : self.n])
        slot = self.slots(self.keys[:, left])
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            rest = self.table[slot] != left
            left, slot = left[rest], (slot[rest] + 1) & (len(self.table) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of pre-tokens; those not seen before get the next ones and are encoded."""
        slot, before = self.slots(keys), self.n
        got = self.table.take(slot)
        wrong = got < 0
        for own, k in zip(self.keys, keys, strict=True):
            wrong |= own.take(got, mode="clip") != k
        left = np.flatnonzero(wrong)
        wanted = keys[:, left]
        self.make_room(len(left))
        slot = self.slots(wanted)
        while len(left):
            here = self.table[slot]
            if len(free := np.flatnonzero(here < 0)):
                # Of those that want a free slot one gets it.
                self.table[slot[free]] = free
                first = free[self.table[slot[free]] == free]
                self.add_keys(wanted[:, first])
                self.table[slot[first]] = np.arange(self.n, self.n + len(first))
                self.n += len(first)
                here = self.table[slot]
            rest = (self.keys[:, here] != wanted).any(axis=0)
            got[left] = here
            left, wanted, slot = left[rest], wanted[:, rest], (slot[rest] + 1) & (len(self.table) - 1)
        if self.n > before:
            new = np.ascontiguousarray(self.keys[:, before : self.n].T).view("S24").ravel().tolist()
            self.n = before
            for i in range(0, len(new), 5_000):
                part = [w.decode() for w in new[i : i + 5_000]]
                ids = self.t.joined_ids(part)
                stops = np.flatnonzero(self.t.ends[ids]) + 1
                if len(stops) != len(part) or stops[-1] != len(ids):
                    raise ValueError("the tokenizer's model ends pre-tokens elsewhere")
                self.ids.append(ids)
                self.sizes.append(np.diff(stops, prepend=0))
            self.n += len(new)
        return got

    def find_others(self, words: list[bytes]) -> list[int]:
        if new := [w for w in dict.fromkeys(words) if w not in self.others]:
            self.add_keys(np.zeros((3, len(new)), np.uint64))
            self.others.update(zip(new, range(self.n, self.n + len(new)), strict=True))
            self.add(self.t.encode([w.decode() for w in new]))
        return list(map(self.others.__getitem__, words))

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts, each with the end of a document, and how many each text has."""
        raw = [t.encode() for t in texts]
        buffer = b"\n".join([b"", *raw, b" " * 32])
        low = np.frombuffer(buffer.translate(self.lower), np.uint8)
        kind = self.kinds.take(np.frombuffer(buffer, np.uint8))
        if len(odd := np.flatnonzero(kind == ODD)):
            # A word with an odd byte is one piece.
            space = np.flatnonzero(kind == SPACES)
            cut = np.unique(np.searchsorted(space, odd))
            inside = ragged(space[cut - 1] + 1, space[cut] - space[cut - 1] - 1)
            kind[inside] = ODD
        edge = kind[1:] != kind[:-1]
        edge |= kind[1:] == FIGURE
        edges = np.flatnonzero(edge) + 1
        kind = kind[edges]
        chosen = np.flatnonzero(kind)
        start = edges[chosen]
        size = edges[chosen + 1] - start
        by_word = (kind[chosen] == ODD) | (size > 24)
        eight = np.ndarray((len(low) - 7,), "<u8", low.data, strides=(1,))
        keys = np.empty((3, len(start)), np.uint64)
        for j in range(3):
            np.bitwise_and(eight[start + 8 * j if j else start], HEAD_BYTES.take(size - 8 * j, mode="clip"), out=keys[j])
        out = np.empty(len(start), np.int64)
        if by_word.any():
            plain, other = np.flatnonzero(~by_word), np.flatnonzero(by_word)
            out[plain] = self.find(keys[:, plain])
            a = start[other]
            out[other] = self.find_others([buffer[i:j] for i, j in zip(a.tolist(), (a + size[other]).tolist(), strict=True)])
        else:
            out[:] = self.find(keys)
        last = np.searchsorted(start, np.cumsum([len(r) + 1 for r in raw]))
        return np.insert(out, last, 0), np.diff(last, prepend=0) + 1

    def keep(self, often: np.ndarray) -> None:
        """Forget, if there are too many numbers, all but the pre-tokens that came more than once."""
        if self.n <= self.MOST:
            return
        ids, begin = self.listed()
        chosen = np.flatnonzero((often > 1) & (self.keys[0, : self.n] > 0))
        if len(chosen) > self.MOST // 2:
            chosen = chosen[:0]
        keys, size = self.keys[:, chosen], np.diff(begin)[chosen]
        self.clear()
        self.ids.append(ids[ragged(begin[chosen], size)])
        self.sizes.append(size)
        self.add_keys(keys)
        self.n += len(chosen)
        self.table = self.table[:0]
        self.make_room(0)


@cache
def words(path: str) -> Words:
    """One a Python worker, so that what it knows lasts over batches and tasks."""
    return Words(tokens(path))


@cache
def tokens(path: str) -> Tokens:
    """One a Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokens(path)


def write_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode, and write frames to the shared folder; returns the files read back: (part, frame, n_ids, data)."""
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, part, frame = words(tokenizer), TaskContext.get().partitionId(), 0
        for pdf in cut_frames(batches, w):
            yield pd.DataFrame({"part": [part], "frame": [frame], "n_ids": [pdf[1]], "data": [pdf[0]]})
            frame += 1

    parts = hash_parts(docs.count(), 8_000)
    ordered = docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return materialize(map_frames(ordered, run, "part int, frame int, n_ids long, data binary"))


def cut_frames(batches: Iterator[pd.DataFrame], w: Words) -> Iterator[tuple[bytes, int]]:
    """Frames of the documents in their order, and how many ids each holds."""
    keys: list[int | None] = []
    numbers: list[np.ndarray] = []
    many: list[np.ndarray] = []
    held = 0

    def close() -> tuple[bytes, int]:
        ids, begin = w.listed()
        all_numbers = np.concatenate(numbers)
        ends = np.cumsum(np.concatenate(many))
        total = np.concatenate([[0], np.cumsum(np.diff(begin)[all_numbers])])[ends]
        frame = write_frame(keys, np.diff(total, prepend=0).tolist(), all_numbers, ids, begin)
        w.keep(np.bincount(all_numbers, minlength=w.n))
        return frame, int(total[-1])

    for pdf in batches:
        for i in range(0, len(pdf), 400):
            rows = pdf.iloc[i : i + 400]
            got, n = w.numbers([x or "" for x in rows["text"]])
            keys += [None if pd.isna(k) else int(k) for k in rows["doc_id"]]
            numbers.append(got.astype(np.int32))
            many.append(n)
            held += len(got)
            if held >= FRAME_WORDS or w.n > 2 * w.MOST:
                yield close()
                keys, numbers, many, held = [], [], [], 0
    if keys:
        yield close()


def read_documents(files: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    sizes = files.select("part", "frame", "n_ids")
    before = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("frame").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = sizes.select("part", "frame", before.alias("inside"))
    # One row for each file.
    parts = sorted((r["part"], r["n"]) for r in sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts, total = [], 0
    for part, n in parts:
        starts.append((part, total))
        total += n
    first = files.sparkSession.createDataFrame(starts, "part int, first long")
    placed = inside.join(F.broadcast(first), "part").select("part", "frame", (F.col("first") + F.col("inside")).alias("start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start, data in zip(pdf["start"], pdf["data"], strict=True):
                keys, lengths, ids = read_frame(bytes(data))
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths, strict=True)]
                out = pd.DataFrame({"start": start + ends - lengths, "n_tokens": lengths, "ids_crc32": crc})
                out.insert(0, "doc_id", pd.array(keys, dtype="Int64"))
                yield out

    return map_frames(files.join(placed, ["part", "frame"]).select("start", "data"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    return read_documents(write_ids(docs, tokenizer))
