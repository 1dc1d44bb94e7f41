"""Byte-pair merges of many short segments at once, with keyed dropout.

Segments are rows of a matrix of symbols; column 0 and the columns after a segment's end
hold no symbol. In each step every unfinished row takes its best candidate (least rank,
leftmost among equals). The n-th candidate of a row is skipped if the n-th draw of the
row's key is below the dropout rate. A step is a handful of array operations over
all rows, so its cost does not depend on what workers have seen before, and memory is
that of the rows given.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
NONE = np.int32((1 << 31) - 1)
WIDTH = 22  # bits of a symbol
_STEP = U(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def skipped(keys: np.ndarray, n: int | np.ndarray, rate: float) -> np.ndarray:
    """Whether the n-th candidate of each key is skipped: a keyed hash as a number
    from 0 to 1, against the rate."""
    drawn = mixed(keys + np.atleast_1d(n + 1).astype(U) * _STEP) >> U(11)
    return drawn.astype(np.float64) * 2.0**-53 < rate


class Pairs:
    """(left, right) -> rank, in an open table with short probes. Ranks are unique for each
    result; ``score_of_rank`` ascends and is equal for results of equal score."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, result_of_rank: np.ndarray, score_of_rank: np.ndarray):
        self.result = result_of_rank.astype(np.int32)
        equal = np.diff(score_of_rank) == 0
        self.tied = np.concatenate((equal, [False])) | np.concatenate(([False], equal))
        self.first = np.maximum.accumulate(np.where(np.concatenate(([False], equal)), 0, np.arange(len(score_of_rank)))).astype(np.int32)
        keys = (left.astype(np.int64) << WIDTH) + right
        self.bits = max(int(len(keys)).bit_length() + 3, 4)
        self.keys = np.full((1 << self.bits) + 64, -1 << 62, np.int64)
        self.ranks = np.full(len(self.keys), NONE, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[at] == -1 << 62
            put, first = np.unique(at[free], return_index=True)
            mine = todo[free][first]
            self.keys[put], self.ranks[put] = keys[mine], rank[mine]
            left_over = self.keys[at] != keys[todo]
            todo, at = todo[left_over], at[left_over] + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(U) * _STEP) >> U(64 - self.bits)).view(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where a pair does not merge."""
        keys = (left.astype(np.int64) << WIDTH) + right
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.ranks[at], NONE)
        on = np.flatnonzero((there != keys) & (there != -1 << 62))
        while len(on):
            at_on = at[on] + 1
            at[on] = at_on
            there = self.keys[at_on]
            hit = there == keys[on]
            out[on[hit]] = self.ranks[at_on[hit]]
            on = on[~hit & (there != -1 << 62)]
        return out


def matrix(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of the concatenated segments, with a free column before and after."""
    width = int(sizes.max(initial=0)) + 2
    out = np.full((len(sizes), width), -1, np.int32)
    out[:, 1:-1][np.arange(width - 2) < sizes[:, None]] = symbols
    return out


def first_ranks(pairs: Pairs, symbols: np.ndarray) -> np.ndarray:
    out = np.full(symbols.shape, NONE, np.int32)
    rows, cols = np.nonzero(symbols[:, 1:-1] >= 0)
    cols += 1
    found = pairs(symbols[rows, cols], symbols[rows, cols + 1])
    out[rows, cols] = found
    return out


def merge(pairs: Pairs, symbols: np.ndarray, ranks: np.ndarray, keys: np.ndarray | None = None, rate: float = 0.0) -> np.ndarray:
    """``symbols`` after all merges (in place): what was merged away is -1."""
    n, width = symbols.shape
    after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
    before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
    flat, rank, nxt, prv = symbols.reshape(-1), ranks.reshape(-1), after.reshape(-1), before.reshape(-1)
    rows, step = np.arange(n), 0
    while len(rows):
        own = ranks[rows] if len(rows) < n else ranks
        best = own.argmin(1)
        least = own[np.arange(len(rows)), best]
        live = least != NONE
        if not live.all():
            rows, best, least = rows[live], best[live], least[live]
            if not len(rows):
                break
        if (tied := pairs.tied[least]).any():  # the leftmost of equal scores
            mine = rows[tied]
            own = ranks[mine]
            best[tied] = np.where(own == NONE, NONE, pairs.first[np.where(own == NONE, 0, own)]).argmin(1)
            least[tied] = own[np.arange(len(mine)), best[tied]]
        at = rows * width + best
        if rate:
            skip = skipped(keys[rows], step, rate)
            rank[at[skip]] = NONE
            do = ~skip
            at, base, least = at[do], (rows * width)[do], least[do]
        else:
            base = rows * width
        step += 1
        made = pairs.result[least]
        right = base + nxt[at]
        then = nxt[right]
        flat[at] = made
        flat[right] = -1
        rank[right] = NONE
        nxt[at] = then
        far = base + then
        prv[far] = at - base
        near = base + prv[at]
        rank[at] = pairs(made, flat[far])
        rank[near] = pairs(flat[near], made)
    return symbols
