"""An adaptive context-mixing range coder for token ids, many blocks at a time.

A block starts from an empty model, so it can be read alone. The next id is predicted by three orders: the id that last
followed the two ids before it, the one that last followed the id before it, and counts of ids without context. How
far the first two are trusted is mixed by counts per pair of their confidences: an id is coded as "as order 2 says", "as
order 1 says" or "else"; else its groups of four bits follow, by the counts of order 0. All numbers are whole, so
every machine reads what another wrote.

Blocks are independent, so numpy codes the same place of many blocks in one step; a step's cost is that of its array
calls, which some hundred blocks share. Each block carries its length and the CRC-32 of its ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

#: Ids of a block. Counts grow by ``GAIN`` an id, so that they stay below 65,536 within a block.
BLOCK_IDS = 2048
GAIN = 30

#: Blocks coded at once; bounds the memory of a task at some 150 MB.
LANES = 2048

#: Ids take at most so many groups of four bits.
MAX_LEVELS = 6

#: Slots of the tables of orders 1 and 2, and of groups beyond the third in the tree of order 0; both are hashed.
SLOTS = 2048
DEEP = 512
_FLAT = 1 + 16 + 256

#: Confidence of a prediction: 0 (none) to 3.
_SURE = 3

_HEAD = struct.Struct("<BBHII")
_VERSION = 1
_WORD = np.uint64(1 << 32)
_LOW = np.uint64((1 << 32) - 1)
_32 = np.uint64(32)


class Counts:
    """Rows of counts of ``width`` symbols, kept as running sums; a row is one item of ``rows``."""

    def __init__(self, n: int, start: Sequence[int]):
        width = self.width = len(start)
        self.rows = np.tile(np.cumsum(start, dtype=np.uint16), n).view(f"V{2 * width}")
        self.gain = ((np.arange(width) >= np.arange(width)[:, None]) * GAIN).astype(np.uint16)

    def take(self, where: np.ndarray) -> np.ndarray:
        return self.rows.take(where).view(np.uint16).reshape(-1, self.width)

    def learn(self, where: np.ndarray, found: np.ndarray, symbol: np.ndarray) -> None:
        self.rows[where] = (found + self.gain.take(symbol, axis=0)).view(self.rows.dtype).ravel()


class Ranges:
    """The range of each block's coder: 64 bits, of which the upper 32 are final once the range has shrunk to them."""

    def __init__(self, n: int):
        self.low = np.zeros(n, np.uint64)
        self.range = np.full(n, (1 << 64) - 1, np.uint64)
        self.at = np.zeros(n, np.int64)
        self.row = np.arange(n)

    def code(self, lanes, counts: Counts, where: np.ndarray, symbol: np.ndarray | None) -> np.ndarray:
        """Code a symbol of each lane (or find it, when reading) by its row of counts, which learns it."""
        upto = counts.take(where)
        step = self.range[lanes] // upto[:, -1].astype(np.uint64)
        if symbol is None:
            symbol = self.find(lanes, step, upto)
        at = self.row[: len(symbol)] * counts.width + symbol
        flat = upto.ravel()
        below = flat.take(np.maximum(at - 1, 0)) * (symbol > 0)
        self.low[lanes] += step * below
        self.range[lanes] = step * (flat.take(at) - below)
        counts.learn(where, upto, symbol)
        return symbol

    def settle(self, lanes=None) -> None:
        """Move 32 bits where the range has become narrow; a range across the border is cut at it."""
        if lanes is None:
            lanes = np.flatnonzero(self.range < _WORD)
        else:
            lanes = lanes[self.range[lanes] < _WORD]
        if len(lanes):
            low = self.low[lanes]
            narrow = np.minimum(self.range[lanes], _WORD - (low & _LOW))
            self.move(lanes, low)
            self.at[lanes] += 1
            self.low[lanes] = low << _32
            self.range[lanes] = narrow << _32

    def find(self, lanes, step, upto) -> np.ndarray:
        raise NotImplementedError

    def move(self, lanes, low) -> None:
        raise NotImplementedError


class Writer(Ranges):
    def __init__(self, n: int, most_ids: int, levels: int):
        super().__init__(n)
        # At most 16 bits per coded symbol, and two words at the end.
        self.words = np.zeros((n, (most_ids * (levels + 1) + 1) // 2 + 3), np.uint32)

    def move(self, lanes, low) -> None:
        self.words[lanes, self.at[lanes]] = (low >> _32).astype(np.uint32)

    def finish(self) -> list[bytes]:
        row = np.arange(len(self.at))
        for part in (self.low >> _32, self.low & _LOW):
            self.words[row, self.at] = part.astype(np.uint32)
            self.at += 1
        return [w[:n].astype("<u4").tobytes() for w, n in zip(self.words, self.at.tolist())]


class Reader(Ranges):
    def __init__(self, coded: Sequence[bytes]):
        super().__init__(len(coded))
        most = max(len(c) // 4 for c in coded)
        self.words = np.zeros((len(coded), most + 2), np.uint64)
        for row, c in zip(self.words, coded):
            row[: len(c) // 4] = np.frombuffer(c, "<u4")
        self.value = (self.words[:, 0] << _32) | self.words[:, 1]
        self.at += 2

    def find(self, lanes, step, upto) -> np.ndarray:
        value = np.minimum((self.value[lanes] - self.low[lanes]) // step, upto[:, -1] - 1).astype(np.uint16)
        passed = (upto <= value[:, None]).view(np.uint32 if upto.shape[1] == 4 else np.uint64)
        count = np.bitwise_count(passed)  # a row is four or sixteen flags
        return (count[:, 0] if count.shape[1] == 1 else count[:, 0] + count[:, 1]).astype(np.int64)

    def move(self, lanes, low) -> None:
        at = np.minimum(self.at[lanes], self.words.shape[1] - 1)  # a damaged block may ask for more than it has
        self.value[lanes] = (self.value[lanes] << _32) | self.words[lanes, at]


class Model:
    """What each block has seen of its own ids. A prediction is an id times four, plus how sure it is."""

    def __init__(self, n: int, levels: int):
        self.levels = levels
        self.lane = np.arange(n)
        self.slot = self.lane * SLOTS
        self.after_two = np.full(n * SLOTS, -4, np.int32)
        self.after_one = np.full(n * SLOTS, -4, np.int32)
        self.trust = Counts(n * 32, [2, 2, 4, 0])
        self.nodes = _FLAT + (DEEP if levels > 3 else 0)
        self.tree = Counts(n * self.nodes, [1] * 16)
        self.last = np.zeros(n, np.int64)
        self.before = np.zeros(n, np.int64)

    def step(self, ranges: Ranges, n: int, ids: np.ndarray | None) -> np.ndarray:
        """Code the next id of the first ``n`` blocks and learn it; the ids when reading."""
        last = self.last[:n] * 40503
        one = self.slot[:n] + ((last >> 4) & (SLOTS - 1))
        two = self.slot[:n] + (((last + self.before[:n] * 30011) >> 4) & (SLOTS - 1))
        by_two, by_one = self.after_two.take(two), self.after_one.take(one)
        say_two, say_one = by_two >> 2, by_one >> 2
        state = self.lane[:n] * 32 + ((by_two & _SURE) * 8 + (by_one & _SURE) * 2 + (say_two == say_one))
        found = None
        if ids is not None:
            found = np.where(ids == say_two, 0, np.where(ids == say_one, 1, 2))
        ranges.settle()
        found = ranges.code(slice(0, n), self.trust, state, found)
        other = np.flatnonzero(found == 2)
        if ids is None:
            ids = np.where(found == 0, say_two, say_one).astype(np.int64)
            if len(other):
                ids[other] = self.plain(ranges, other, None)
        elif len(other):
            self.plain(ranges, other, ids[other])
        fresh = ids * 4 + 1
        self.after_two[two] = np.where(ids == say_two, by_two + ((by_two & _SURE) < _SURE), fresh)
        self.after_one[one] = np.where(ids == say_one, by_one + ((by_one & _SURE) < _SURE), fresh)
        self.before[:n] = self.last[:n]
        self.last[:n] = ids
        return ids

    def plain(self, ranges: Ranges, lanes: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
        """Ids without context, four bits at a time by the counts below their upper bits."""
        upper = np.zeros(len(lanes), np.int64)
        base = lanes * self.nodes
        for level in range(self.levels):
            if level < 3:
                node = base + (0, 1, 17)[level] + upper
            else:
                node = base + _FLAT + (((upper * 40503 + level) >> 2) & (DEEP - 1))
            bits = None if ids is None else (ids >> 4 * (self.levels - 1 - level)) & 15
            bits = ranges.code(lanes, self.tree, node, bits)
            if level % 2 == 0:  # two symbols at most between settled ranges
                ranges.settle(lanes)
            upper = upper * 16 + bits
        return upper


def levels_for(largest: int) -> int:
    levels = max(1, -(-int(largest).bit_length() // 4))
    if levels > MAX_LEVELS:
        raise ValueError(f"ids of {4 * MAX_LEVELS} bits or less can be coded, not {largest}")
    return levels


def crc_of(ids: np.ndarray) -> int:
    """CRC-32 of the ids as little-endian 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def in_lanes(sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Blocks by falling size, and how many have an id at each place."""
    order = np.argsort(-np.asarray(sizes, np.int64), kind="stable")
    most = int(sizes[order[0]])
    return order, len(order) - np.searchsorted(np.sort(sizes), np.arange(most), "right")


def encode_blocks(blocks: Sequence[np.ndarray]) -> list[bytes]:
    """Each block (at most ``BLOCK_IDS`` ids) as bytes that ``decode_blocks`` reads."""
    out: list[bytes] = []
    for start in range(0, len(blocks), LANES):
        out += _encode(blocks[start : start + LANES])
    return out


def _encode(blocks: Sequence[np.ndarray]) -> list[bytes]:
    sizes = np.array([len(b) for b in blocks])
    if len(sizes) and sizes.max() > BLOCK_IDS:
        raise ValueError(f"a block has more than {BLOCK_IDS} ids")
    levels = levels_for(max((int(b.max()) for b in blocks if len(b)), default=0))
    order, active = in_lanes(sizes) if len(sizes) and sizes.max() else (np.arange(len(blocks)), np.zeros(0, int))
    table = np.zeros((len(active), len(blocks)), np.int64)
    for lane, b in enumerate(order):
        table[: sizes[b], lane] = blocks[b]
    writer, model = Writer(len(blocks), len(active), levels), Model(len(blocks), levels)
    for n, ids in zip(active.tolist(), table):
        model.step(writer, n, ids[:n])
    coded: list[bytes] = [b""] * len(blocks)
    for b, words in zip(order, writer.finish()):
        coded[b] = _HEAD.pack(_VERSION, levels, 0, int(sizes[b]), crc_of(blocks[b])) + words
    return coded


def decode_blocks(coded: Sequence[bytes]) -> list[np.ndarray]:
    """The ids of each block; a block whose checksum differs is an error."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(coded)
    heads = []
    for c in coded:
        if len(c) < _HEAD.size:
            raise ValueError("a block of ids is cut off")
        heads.append(_HEAD.unpack_from(c))
    for version, levels, *_ in heads:
        if version != _VERSION or not 1 <= levels <= MAX_LEVELS:
            raise ValueError("not a block of ids")
    for levels in sorted({h[1] for h in heads}):
        alike = [i for i, h in enumerate(heads) if h[1] == levels]
        for start in range(0, len(alike), LANES):
            part = alike[start : start + LANES]
            for i, ids in zip(part, _decode([coded[i][_HEAD.size :] for i in part], [heads[i][3] for i in part], levels)):
                if crc_of(ids) != heads[i][4]:
                    raise ValueError("a block of ids is damaged: its checksum differs")
                out[i] = ids
    return out


def _decode(coded: list[bytes], sizes: list[int], levels: int) -> list[np.ndarray]:
    if min(len(c) for c in coded) < 8 or max(sizes) > BLOCK_IDS:
        raise ValueError("a block of ids is damaged: its length is impossible")
    if not max(sizes):
        return [np.zeros(0, np.uint32) for _ in coded]
    order, active = in_lanes(np.array(sizes))
    reader, model = Reader([coded[i] for i in order]), Model(len(coded), levels)
    table = np.zeros((len(active), len(coded)), np.uint32)
    for row, n in zip(table, active.tolist()):
        row[:n] = model.step(reader, n, None)
    out = [np.zeros(0, np.uint32)] * len(coded)
    for lane, i in enumerate(order):
        out[i] = table[: sizes[i], lane].copy()
    return out
