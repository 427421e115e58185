"""Byte-pair merges of many words at once, as rounds over flat numpy arrays."""

from __future__ import annotations

import numpy as np

#: Rank of a pair that no piece joins.
NEVER = np.int32(2**31 - 1)


class MergeTable:
    """Which neighbouring symbols join, in which order, and to what.

    Symbols are integers below `symbols`, or `symbols` + a code point for a character that no piece holds.
    """

    def __init__(self, symbols: int, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        self.symbols = symbols
        self.width = symbols + 0x110000
        key = left.astype(np.int64) * self.width + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], rank[order].astype(np.int32), made[order].astype(np.int32)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[at] == key
        return np.where(hit, self.rank[at], NEVER), self.made[at]

    def merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols and their words. word: the word of each symbol, ascending.

        A round finds the lowest rank in each word and joins all pairs of that rank, the leftmost of overlapping ones
        first. One by one, a join can make a pair that comes before the remaining ones of the round; words in which
        it does join only their leftmost pair. Words without a pair leave the arrays.
        """
        if not len(sym):
            return sym, word
        rank, made = self.pairs(sym, np.append(sym[1:], sym[-1:]))
        rank[np.append(word[1:] != word[:-1], True)] = NEVER
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(sym)))
            best = np.repeat(np.minimum.reduceat(rank, first), size)
            live = best != NEVER
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, made, best = sym[live], word[live], rank[live], made[live], best[live]
                if not len(sym):
                    break
            at = self._picked(sym, word, rank, made, best)
            new = made[at]
            sym[at] = new
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            at = moved[at]
            near = np.concatenate([at, at[at > 0] - 1])
            last = near == len(sym) - 1
            right = np.where(last, near, near + 1)
            r, m = self.pairs(sym[near], sym[right])
            r[last | (word[near] != word[right])] = NEVER
            rank[near], made[near] = r, m
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def _picked(self, sym, word, rank, made, best) -> np.ndarray:
        """Left ends of the pairs that a round joins."""
        at = np.flatnonzero(rank == best)
        step = np.diff(at)
        if (step == 1).any():  # a run of overlapping pairs: every other one
            begins = np.append(True, step != 1)
            begin = at[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]
            at = at[(at - begin) % 2 == 0]
        again = np.append(False, word[at[1:]] == word[at[:-1]])
        if not again.any():
            return at
        many = again | np.append(again[1:], False)
        i = at[many]
        new = made[i]
        end = len(sym) - 1
        right_at = np.minimum(i + 2, end)
        right = np.where((i + 2 <= end) & (word[right_at] == word[i]), self.pairs(new, sym[right_at])[0], NEVER)
        joined = np.zeros(len(sym), bool)
        joined[at] = True
        two = np.maximum(i - 2, 0)
        left_sym = np.where((i >= 2) & joined[two], made[two], sym[np.maximum(i - 1, 0)])
        left = np.where((i > 0) & (word[np.maximum(i - 1, 0)] == word[i]), self.pairs(left_sym, new)[0], NEVER)
        overtaken = np.unique(word[i[np.minimum(left, right) <= best[i]]])
        if not len(overtaken):
            return at
        found = np.minimum(np.searchsorted(overtaken, word[at]), len(overtaken) - 1)
        return at[~((overtaken[found] == word[at]) & again)]
