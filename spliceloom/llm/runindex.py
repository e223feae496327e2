"""A run-length index of many short strings, and matching statistics streamed over it.

The Burrows-Wheeler transform of the strings is kept as runs: first row, symbol, where a run's
first row goes under the last-to-first mapping, and the places of the text sampled at both ends of
the run. The suffix order itself is dropped once the runs are known; the run of a row is found by
search among the first rows. Copies of a string are rows next to each other with one symbol in front,
so they lengthen runs and add none: a string is given once, with the number of its copies, and what
is kept has the size of the runs and a byte for each place of the distinct strings. Strings have
colours: symbols of different colours differ, so one index serves many sets of strings that must not
meet.

Matching statistics read patterns from right to left, all patterns at once: while the symbol
before the current row is the one asked for, the match grows by one step of the mapping; otherwise
it moves to the nearest run of that symbol above or below, whichever keeps the longer match, measured
in the text from the sampled run ends.
"""

from __future__ import annotations

import numpy as np

#: Ends strings; no UTF-8 text holds this byte.
END = 0xFF


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), then those of first[1], ..."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def joined(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the strings one after another, an END behind each; start of each)."""
    n = length + 1
    start = np.cumsum(n) - n
    text = np.full(int(n.sum()) + 8, END, np.uint8)  # room for a word at the last place
    text[ranges(start, length)] = data[ranges(first, length)]
    return text, start


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place, as little-endian numbers; a view."""
    return np.ndarray(len(text) - 7, "<u8", np.ascontiguousarray(text), strides=(1,))


def suffix_order(text: np.ndarray, stop: np.ndarray, tint: np.ndarray, longest: int) -> np.ndarray:
    """Ranks of the suffixes of ``text``, each up to its own end ``stop``, by prefix doubling: ends first, then by ``tint``.

    A rank is the number of suffixes in front; equal suffixes share it. Each round sorts only what is still tied,
    little where a colour has few strings.
    """
    n = len(stop)
    at = np.arange(n)
    left = stop - at  # symbols before the end
    key = np.where(left > 0, text[:n].astype(np.int64) + 1, 0)
    for width, bits in ((1, 9), (2, 18)):
        key = (key << bits) | np.where(left >= width, key[np.minimum(at + width, n - 1)], 0)
    key = np.where(left > 0, ((tint + 1) << 36) | key, 0)
    rank, tied, base, width = np.empty(n, np.int64), at, np.zeros(n, np.int64), 4
    while True:
        order = np.argsort(key)
        key, tied, base = key[order], tied[order], base[order]
        same = np.concatenate([[False], (key[1:] == key[:-1]) & (base[1:] == base[:-1])])
        place = np.arange(len(key))
        lead = np.maximum.accumulate(np.where(np.concatenate([[True], base[1:] != base[:-1]]), place, 0))
        rank[tied] = base + np.maximum.accumulate(np.where(same, 0, place)) - lead
        # a suffix within the width equals all that it is tied with
        open_ = (same | np.concatenate([same[1:], [False]])) & (left[tied] >= width)
        if width > longest or not open_.any():
            return rank
        tied = tied[open_]
        base = rank[tied]
        key = base * (n + 1) + rank[np.minimum(tied + width, n - 1)]
        width *= 2


class RunIndex:
    """Index of the strings data[first : first + length], each of a colour and standing ``copies`` times (once)."""

    def __init__(self, data: np.ndarray, first: np.ndarray, length: np.ndarray, colour: np.ndarray, copies: np.ndarray | None = None):
        self.text, start = joined(data, first, length)
        n = int((length + 1).sum())
        self.start, self.stop = start, start + length
        stop = np.repeat(self.stop, length + 1)
        tint = np.repeat(colour.astype(np.int64), length + 1)
        rank = suffix_order(self.text, stop, tint, int(length.max(initial=0)))
        order = np.argsort(rank * n + np.arange(n))  # equal suffixes in the order of their strings
        symbol = (tint << 8) + self.text[:n] + 1
        before = np.zeros(n, np.int64)
        before[1:] = symbol[:-1]
        before[start] = 0
        bwt = before[order]
        head = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        tail = np.concatenate([head[1:], [n]]) - 1
        rows = np.ones(n, np.int64) if copies is None else np.repeat(copies.astype(np.int64), length + 1)[order]
        end = np.cumsum(rows)
        self.total = int(end[-1]) if n else 0
        self.first, self.last = end[head] - rows[head], end[tail] - 1
        # rows before the runs of a symbol in first-column order, then runs of the same symbol
        self.by_symbol = np.argsort(bwt[head] * len(head) + np.arange(len(head)))
        ordered = bwt[head][self.by_symbol]
        fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        self.symbols, self.symbol = ordered[fresh], np.empty(len(head), np.int64)
        self.symbol[self.by_symbol] = np.cumsum(fresh) - 1
        sizes = (self.last - self.first + 1)[self.by_symbol]
        self.target = np.empty(len(self.first), np.int64)
        self.target[self.by_symbol] = np.cumsum(sizes) - sizes
        self.target_run = np.searchsorted(self.first, self.target, "right") - 1
        # runs by (symbol, place), to find the nearest one of a symbol
        self.place_key = self.symbol[self.by_symbol] * (self.total + 1) + self.first[self.by_symbol]
        self.edge = np.concatenate([np.flatnonzero(fresh), [len(head)]])
        self.first_sample, self.last_sample = order[head], order[tail]

    def _common(self, sample: np.ndarray, words: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common prefix of the text from ``sample`` with the pattern from ``at``, at most ``most``."""
        most = np.minimum(most, self.stop[np.searchsorted(self.start, sample, "right") - 1] - sample)
        out = most.copy()
        own, live, done = _words(self.text), np.flatnonzero(most > 0), 0
        while len(live):
            differ = own[sample[live] + done] ^ words[at[live] + done]
            low = differ & (~differ + np.uint64(1))
            hit = differ != 0
            # the lowest differing bit tells the first differing byte
            out[live[hit]] = np.minimum(out[live[hit]], done + (np.bitwise_count(low[hit] - np.uint64(1)) >> 3))
            done += 8
            live = live[~hit]
            live = live[most[live] > done]
        return out

    def matching_statistics(self, data: np.ndarray, first: np.ndarray, length: np.ndarray, colour: np.ndarray, span: int = 0):
        """Yield (pattern numbers, place, length) from the last place of the patterns to the first.

        ``length`` is that of the longest prefix of the pattern from the place on in any string of its colour.
        With a ``span``, patterns leave as soon as no further place can reach a length of ``span``: a match of
        that length from some place in front of ``place`` < ``span`` ends at ``span`` or behind, so the one from
        ``place`` does too.
        """
        text, start = joined(data, first, length)
        words = _words(text)
        asked = (np.repeat(colour.astype(np.int64), length + 1) << 8) + text[: int((length + 1).sum())] + 1
        known = np.minimum(np.searchsorted(self.symbols, asked), len(self.symbols) - 1)
        asked = np.where(self.symbols[known] == asked, known, -1)
        row, row_run, matched = (np.zeros(len(first), np.int64) for _ in range(3))
        by_length = np.argsort(-length, kind="stable")
        enough = np.cumsum(np.bincount(length[by_length], minlength=int(length.max(initial=0)) + 1)[::-1])[::-1]
        out = np.zeros(len(first), bool)
        for step in range(1, int(length.max(initial=0)) + 1):
            live = by_length[: enough[step]]
            if span and not len(live := live[~out[live]]):
                continue
            place = length[live] - step
            c = asked[start[live] + place]
            r, got = row[live], matched[live]
            run = row_run[live]
            off = np.flatnonzero(self.symbol[run] != c)
            if len(off):
                none = c[off] < 0
                lost = off[none]
                off = off[~none]
                key = c[off] * (self.total + 1) + r[off]
                below = np.searchsorted(self.place_key, key)  # first run of the symbol below the row
                best = np.zeros(len(off), np.int64)
                new_run = np.where(below < self.edge[c[off] + 1], below, below - 1)
                use_last = below >= self.edge[c[off] + 1]
                for ok, idx, sample, is_last in ((below > self.edge[c[off]], below - 1, self.last_sample, True), (below < self.edge[c[off] + 1], below, self.first_sample, False)):
                    some = np.flatnonzero(ok & (got[off] > 0))
                    if len(some):
                        k = self.by_symbol[idx[some]]
                        common = self._common(sample[k], words, start[live[off[some]]] + place[off[some]] + 1, got[off[some]])
                        take = some[common > best[some]]
                        best[take] = common[common > best[some]]
                        new_run[take], use_last[take] = idx[take], is_last
                k = self.by_symbol[new_run]
                run[off], r[off], got[off] = k, np.where(use_last, self.last[k], self.first[k]), best
                if len(lost):
                    got[lost] = -1
                    run[lost] = 0
                    r[lost] = self.first[0]
            r = self.target[run] + r - self.first[run]
            run = self.target_run[run]
            beyond = np.flatnonzero(r > self.last[run])
            run[beyond] = np.searchsorted(self.first, r[beyond], "right") - 1
            got = got + 1
            row[live], row_run[live], matched[live] = r, run, got
            if span:
                out[live[(place < span) & (place + got < span)]] = True
            yield live, place, got
