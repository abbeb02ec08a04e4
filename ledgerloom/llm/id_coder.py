"""Adaptive context-mixing range coder for blocks of token ids.

Blocks are independent: each starts from the same fresh model, so any one can be read
alone.  Many blocks are coded side by side, one numpy lane each, in lock step; writer
and reader run the same code and use integers only, so they agree on every machine.

The model of a block mixes three predictions of the next id:

- order 2 and order 1: the id that last followed the two ids before, and the one
  before, each with a confidence of 0 to 3 that grows with hits;
- order 0: how often ids came so far, as four adaptive choices among 16.

How much of the probability each gets is learnt per pair of confidences (and whether
both name the same id), from how often that pair was right in this block.
"""

from __future__ import annotations

import zlib

import numpy as np

LANES = 1024  # blocks coded side by side
LONGEST = 4096  # ids of a block, at most
SHORTEST = 256  # aimed at where a frame is too short to fill the lanes

# Fixed by the file format.
_TABLE = 1 << 13  # places for contexts, per order and lane
_STATES = 32  # confidences of both orders, and whether they agree
_WEIGHTS = (8, 4, 20)  # a fresh state's shares of order 2, order 1, order 0
_STEP, _LIMIT = 24, 1 << 12  # what a hit adds to a count; where a row of counts is halved
_NONE = 0xFFFF  # a context that was never met
_SHIFTS = (12, 8, 4, 0)
_LOW = np.uint64(32)
_MASK = np.uint64(0xFFFFFFFF)
_WORD = np.uint64(16)
_HALF = np.array([1, 1, 1, 0], np.uint16)
_UPTO = np.triu(np.ones((16, 16), np.float32))
_ONES = np.ones(16, np.float32)


class CorruptBlock(ValueError):
    """A block whose ids don't have the checksum they were written with."""


def _levels(vocabulary: int) -> tuple[list[tuple[int, int]], int]:
    """Shift and first node of each of the four choices, and the number of nodes."""
    sizes = [(vocabulary - 1 >> shift + 4) + 1 for shift in _SHIFTS]
    firsts = np.cumsum([0, *sizes])
    return [(s, int(f)) for s, f in zip(_SHIFTS, firsts, strict=False)], int(firsts[-1])


def block_length(n_ids: int) -> int:
    return int(min(LONGEST, max(SHORTEST, -(-n_ids // LANES))))


class _Coder:
    """State of one range coder per lane; subclasses write or read 16-bit words.

    ``code`` narrows the lanes' ranges to a symbol's share; ``lane`` names them, as a
    slice from 0 or as an index array.
    """

    def __init__(self, lanes: int):
        self.range = np.full(lanes, 1 << 48, np.uint64)
        self.at = np.zeros(lanes, np.int64)


class _Writer(_Coder):
    def __init__(self, lanes: int, length: int):
        super().__init__(lanes)
        self.low = np.zeros(lanes, np.uint64)
        # A symbol takes a word at most: five choices an id.
        self.words = np.zeros((lanes, length * 5 + 4), np.uint32)

    def code(self, lane, start: np.ndarray, freq: np.ndarray, total: np.ndarray) -> None:
        share = self.range[lane] // total
        low = self.low[lane] + start * share
        wide = freq * share
        short = np.flatnonzero(wide <= _MASK)
        if len(short):
            which = short if isinstance(lane, slice) else lane[short]  # slices start at lane 0
            out = low[short]
            self.words[which, self.at[which]] = out >> _LOW  # may hold a carry in bit 16
            self.at[which] += 1
            low[short] = (out & _MASK) << _WORD
            wide[short] <<= _WORD
        self.low[lane], self.range[lane] = low, wide

    def payloads(self) -> list[bytes]:
        lanes = np.arange(len(self.at))
        for _ in range(3):
            self.words[lanes, self.at] = self.low >> _LOW
            self.low = (self.low & _MASK) << _WORD
            self.at += 1
        most = int(self.at.max(initial=0))
        carry = np.zeros(len(lanes), np.uint32)
        for k in range(most - 1, -1, -1):
            now = self.words[:, k] + carry
            carry = now >> 16
            self.words[:, k] = now & 0xFFFF
        return [self.words[i, : self.at[i]].astype("<u2").tobytes() for i in lanes]


class _Reader(_Coder):
    def __init__(self, payloads: list[bytes]):
        super().__init__(len(payloads))
        found = [np.frombuffer(p, "<u2") for p in payloads]
        self.words = np.zeros((len(found), max((len(f) for f in found), default=0) + 4), np.uint16)
        for row, f in zip(self.words, found, strict=True):
            row[: len(f)] = f
        self.last = self.words.shape[1] - 1
        first = self.words[:, :3].astype(np.uint64)
        self.value = (first[:, 0] << _LOW) | (first[:, 1] << _WORD) | first[:, 2]
        self.at += 3

    def target(self, lane, total: np.ndarray) -> np.ndarray:
        self.share = self.range[lane] // total
        return np.minimum(self.value[lane] // self.share, total - np.uint64(1))

    def code(self, lane, start: np.ndarray, freq: np.ndarray, total: np.ndarray) -> None:
        code = self.value[lane] - start * self.share
        wide = freq * self.share
        short = np.flatnonzero(wide <= _MASK)
        if len(short):
            which = short if isinstance(lane, slice) else lane[short]  # slices start at lane 0
            # Damaged words may ask for more than there are; the checksum tells later.
            word = self.words[which, np.minimum(self.at[which], self.last)]
            self.at[which] += 1
            code[short] = (code[short] << _WORD) | word
            wide[short] <<= _WORD
        self.value[lane], self.range[lane] = code, wide


def _run(coder: _Coder, ids: np.ndarray, lengths: np.ndarray, vocabulary: int, writing: bool) -> None:
    """Codes column after column of ``ids`` (lane, position); fills it when reading.

    ``lengths`` must not increase, so the lanes still running are always the first.
    """
    lanes, (levels, nodes) = len(lengths), _levels(vocabulary)
    base = np.arange(lanes, dtype=np.int64)
    tables = [np.full(lanes * _TABLE, _NONE << 2, np.int32) for _ in range(2)]  # id and confidence by context
    weights = np.tile(np.array([*_WEIGHTS, 0], np.uint16), (lanes * _STATES, 1))
    weight = weights.reshape(-1)
    counts = np.ones((lanes * nodes, 16), np.uint16)
    count = counts.reshape(-1)
    last, mixed = np.zeros((2, lanes), np.int64)  # the id before; the one before it, mixed
    columns = np.ascontiguousarray(ids.T)
    ends = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), side="left")
    for step, n in enumerate(ends):
        run = slice(0, int(n))
        lane = base[run]
        now = last[run] * 40503
        place1 = lane * _TABLE + (now >> 3 & _TABLE - 1)
        place2 = lane * _TABLE + (now + mixed[run] >> 3 & _TABLE - 1)
        mixed[run] = last[run] * 60493
        kept1, kept2 = tables[0].take(place1), tables[1].take(place2)
        sure1, sure2 = kept1 & 3, kept2 & 3
        id1, id2 = kept1 >> 2, kept2 >> 2
        state = lane * _STATES + (sure2 << 3 | sure1 << 1 | (id1 == id2))
        w = weights.take(state, axis=0).astype(np.uint64)
        w2 = w[:, 0]
        both = w2 + w[:, 1]
        total = both + w[:, 2]
        if writing:
            x = columns[step, run]
            order = np.where(x == id2, 0, np.where(x == id1, 1, 2))
        else:
            goal = coder.target(run, total)
            order = (goal >= w2).astype(np.int64) + (goal >= both)
            x = np.where(order == 0, id2, id1).astype(np.int64)
        start = np.where(order == 0, np.uint64(0), np.where(order == 1, w2, both))
        freq = w.reshape(-1).take(lane * 4 + order)
        coder.code(run, start, freq, total)
        chosen = state * 4 + order
        weight[chosen] = freq + np.uint64(_STEP)
        full = state[total > _LIMIT - _STEP]
        if len(full):
            weights[full] = weights[full] + _HALF >> 1

        new = np.flatnonzero(order == 2)
        if len(new):
            value = x[new]
            root = new * nodes
            row = np.arange(0, len(new) * 16, 16)
            prefix = np.zeros(len(new), np.int64)
            for shift, first in levels:
                node = root + (first + prefix)
                # Whole numbers far below 2**24: exact as 32-bit floats, in any order.
                sums = counts.take(node, axis=0).astype(np.float32) @ _UPTO
                whole = sums[:, 15].astype(np.uint64)
                if writing:
                    digit = value >> shift & 15
                else:
                    goal = coder.target(new, whole).astype(np.float32)
                    digit = (sums <= goal[:, None]).astype(np.float32) @ _ONES
                    # Damaged words can name ids beyond the vocabulary; the checksum tells later.
                    digit = np.minimum(digit.astype(np.int64), (vocabulary - 1 >> shift) - (prefix << 4))
                at = node * 16 + digit
                wide = count.take(at).astype(np.uint64)
                coder.code(new, sums.reshape(-1).take(row + digit).astype(np.uint64) - wide, wide, whole)
                count[at] = wide + np.uint64(_STEP)
                much = node[whole > _LIMIT - _STEP]
                if len(much):
                    counts[much] = counts[much] + 1 >> 1
                prefix = prefix << 4 | digit
            if not writing:
                x[new] = prefix
        if not writing:
            columns[step, run] = x
        for table, place, kept, known, sure in ((tables[0], place1, kept1, id1, sure1), (tables[1], place2, kept2, id2, sure2)):
            table[place] = np.where(known == x, kept + (sure < 3), np.where(sure > 1, kept & -4 | 1, x << 2 | 1))
        last[run] = x
    ids[:] = columns.T


def encode(ids: np.ndarray, length: int, vocabulary: int) -> list[tuple[int, int, bytes]]:
    """(number of ids, crc32 of the ids, payload) of each block of ``length`` ids.

    Ids are below ``vocabulary``, which is 65,535 at most.  The checksum is of the ids as little-endian 32-bit integers.
    """
    if not 0 < vocabulary <= _NONE:
        raise ValueError(f"a vocabulary of {vocabulary} ids can't be coded")
    if len(ids) and (ids.min() < 0 or ids.max() >= vocabulary):
        raise ValueError(f"ids must lie in 0 to {vocabulary - 1}")
    out = []
    for at in range(0, len(ids), length * LANES):
        part = ids[at : at + length * LANES]
        lanes = -(-len(part) // length)
        lengths = np.minimum(length, len(part) - length * np.arange(lanes))
        grid = np.zeros(lanes * length, np.int64)
        grid[: len(part)] = part
        coder = _Writer(lanes, length)
        _run(coder, grid.reshape(lanes, length), lengths, vocabulary, writing=True)
        whole = part.astype("<u4")
        for i, payload in enumerate(coder.payloads()):
            block = whole[i * length : i * length + lengths[i]]
            out.append((len(block), zlib.crc32(block.tobytes()), payload))
    return out


def decode(blocks: list[tuple[int, int, bytes]], vocabulary: int) -> np.ndarray:
    """The ids of the blocks one after another, as little-endian unsigned 32-bit integers.

    Blocks may come in any number and order; each is read by itself and checked.
    """
    out = [np.zeros(0, "<u4")] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda i: -blocks[i][0])
    for at in range(0, len(order), LANES):
        group = order[at : at + LANES]
        lengths = np.array([blocks[i][0] for i in group], np.int64)
        ids = np.zeros((len(group), int(lengths.max())), np.int64)
        with np.errstate(all="ignore"):  # damaged words may count beyond a row
            _run(_Reader([blocks[i][2] for i in group]), ids, lengths, vocabulary, writing=False)
        for row, i in zip(ids, group, strict=True):
            out[i] = row[: blocks[i][0]].astype("<u4")
            if zlib.crc32(out[i].tobytes()) != blocks[i][1]:
                raise CorruptBlock(f"block {i}: its ids don't have the checksum written with it")
    return np.concatenate(out) if out else np.zeros(0, "<u4")
