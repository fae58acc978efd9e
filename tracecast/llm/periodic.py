"""Runs: stretches of words with a smallest period, of three periods and ``least`` words at least, that cannot be extended.

Internal pattern matching. The words of a text are numbered, and blocks of 1, 2, 4, ... words are named by sorting
pairs of names; a place whose block occurs nowhere else in the text leaves, since no run can cover the block. The
names order the suffixes of the places that are left, so that all occurrences of a block are one stretch of the
suffix array. A run of period q holds a dyadic block (one that begins at a multiple of its length L, L <= q < 2 L)
whole together with its copy q words on. For each such block the wavelet tree over the suffix array gives the first,
second and last occurrence in the neighbouring window by range successors. Two occurrences are candidates
themselves. More of them are a progression with the block's own period g as difference: then the copy lies in a
stretch of period g of its own, and the gap between the beginnings, or the ends, of the two stretches is the
candidate. Longest common extensions from the names of blocks turn a candidate into its whole run, which is kept
if it is long enough; of several periods for the same stretch the smallest is its period. All steps compare words,
not hashes.

Words are maximal runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return. A
null text has no words, as an empty one; a text of fewer than ``least`` words has no runs. Every row is handled on
its own, so repeated rows and ids, null ids and ties change nothing; an empty table gives no rows; further columns are
ignored. Memory follows the longest single text (about 200 bytes for each word that stands in a repeated block).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracecast.llm.common import SLICE_BYTES, id_and_text, slices


@dataclass(frozen=True)
class RunSettings:
    #: Fewest words of a run, three at least; a run has three periods at least whatever this is.
    least: int = 24
    periods: int = 3

    @property
    def block(self) -> int:
        """Length of the smallest blocks that are looked for."""
        return 1 << (max(3, self.least) // 3).bit_length() - 1


class WaveletTree:
    """Range successor and predecessor over a permutation, for many ranges at once (a wavelet matrix of packed bits)."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit) & 1 == 1
            packed = np.packbits(np.concatenate([ones, np.zeros(-len(ones) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((bit, packed, before, len(ones) - int(before[-1])))
            values = np.concatenate([values[~ones], values[ones]])

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each range are less than ``x``."""
        count = np.where(x >> self.bits > 0, high - low, 0)
        low, high = low.copy(), high.copy()
        for bit, packed, before, zeros in self.levels:
            a, b = self._ones(packed, before, low), self._ones(packed, before, high)
            up = (x >> bit) & 1 == 1
            count += np.where(up & (x >> self.bits == 0), (high - b) - (low - a), 0)
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + b, high - b)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value with ``k`` smaller ones in each range."""
        low, high, k, out = low.copy(), high.copy(), k.copy(), np.zeros(len(low), np.int64)
        for bit, packed, before, zeros in self.levels:
            a, b = self._ones(packed, before, low), self._ones(packed, before, high)
            small = (high - b) - (low - a)
            up = k >= small
            k -= np.where(up, small, 0)
            out |= up.astype(np.int64) << bit
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + b, high - b)
        return out

    def successor(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Smallest value of each range that is ``x`` at least, -1 without one."""
        k = self.below(low, high, x)
        found = k < high - low
        return np.where(found, self.smallest(low, high, np.where(found, k, 0)), -1)

    def predecessor(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Largest value of each range that is ``x`` at most, -1 without one."""
        k = self.below(low, high, x + 1)
        return np.where(k > 0, self.smallest(low, high, np.maximum(k - 1, 0)), -1)


class _Blocks:
    """Names of repeated blocks of each length from ``block`` on, and the suffix array of their places.

    ``names[L][j]`` is the first place in the suffix array of the blocks of L words that equal the one at
    ``place[j]``; a block that occurs once has a negative name of its own.
    """

    def __init__(self, words: np.ndarray, block: int):
        n = len(words)
        self.words = words
        name = np.where(np.bincount(words)[words] > 1, words, -1)
        length = 1
        while length < block:
            at = np.flatnonzero(name[: max(0, n - length)] >= 0)
            at = at[name[at + length] >= 0]
            key = name[at] * (n + 1) + name[at + length]
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[True], np.diff(key[order]) != 0]) if len(at) else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            name = np.full(n, -1, np.int64)
            name[at[order]] = np.where(np.bincount(group)[group] > 1, group, -1) if len(at) else -1
            length *= 2
        self.place = np.flatnonzero(name >= 0)
        m = len(self.place)
        self.index = np.full(n + 1, m, np.int64)  # of a place among the repeated ones; m: none
        self.index[self.place] = np.arange(m)
        first, size = np.zeros(m, np.int64), np.zeros(m, np.int64)
        own = name[self.place]
        order = np.argsort(own, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(own[order]) != 0])) if m else np.zeros(0, np.int64)
        first[order] = np.repeat(starts, np.diff(np.append(starts, m)))
        size[order] = np.repeat(np.diff(np.append(starts, m)), np.diff(np.append(starts, m)))
        self.names, self.sizes = {}, {}
        alive = np.arange(m)
        while len(alive):
            lone = -2 - np.arange(m + 1)
            lone[alive] = first[alive]
            self.names[length], self.sizes[length] = lone, size.copy()
            follower = self.index[np.minimum(self.place[alive] + length, n)]
            second = np.where(lone[follower] >= 0, lone[follower] + 1, 0)
            order = np.lexsort((second, first[alive]))
            a, b = first[alive][order], second[order]
            group = np.concatenate([[True], np.diff(a) != 0])
            new = group | np.concatenate([[True], np.diff(b) != 0]) | (b == 0)
            at = np.arange(len(order))
            here = np.maximum.accumulate(np.where(new, at, 0))
            group_start = np.maximum.accumulate(np.where(group, at, 0))
            starts = np.flatnonzero(new)
            sizes = np.repeat(np.diff(np.append(starts, len(at))), np.diff(np.append(starts, len(at))))
            first[alive[order]] = a + here - group_start
            size[alive[order]] = sizes
            alive = np.sort(alive[order][sizes > 1])
            length *= 2
        self.suffixes = np.zeros(m, np.int64)
        self.suffixes[first] = np.arange(m)

    def _equal(self, length: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        names, n = self.names[length], len(self.words)
        a, b = (names[self.index[np.where((x < 0) | (x > n), n, x)]] for x in (i, j))
        return (a == b) & (a >= 0)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the text has in common from places ``i`` and ``j`` on."""
        i, j, begin = i.copy(), j.copy(), i
        for length in sorted(self.names, reverse=True):
            same = self._equal(length, i, j)
            i, j = i + length * same, j + length * same
        return self._by_word(i, j, 0, 1) - begin

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the text has in common before places ``i`` and ``j``."""
        i, j, begin = i.copy(), j.copy(), i
        for length in sorted(self.names, reverse=True):
            same = self._equal(length, i - length, j - length)
            i, j = i - length * same, j - length * same
        return begin - self._by_word(i, j, -1, -1)

    def _by_word(self, i: np.ndarray, j: np.ndarray, offset: int, step: int) -> np.ndarray:
        i, open_ = i.copy(), np.arange(len(i))
        j, n = j.copy(), len(self.words)
        while len(open_):
            a, b = i[open_] + offset, j[open_] + offset
            inside = (np.minimum(a, b) >= 0) & (np.maximum(a, b) < n)
            open_ = open_[inside]
            open_ = open_[self.words[a[inside]] == self.words[b[inside]]]
            i[open_] += step
            j[open_] += step
        return i


def find_runs(words: np.ndarray, settings: RunSettings = RunSettings()) -> np.ndarray:
    """``start, end, period`` of all runs by start, then period. Texts may stand one after the other if they share no word numbers."""
    none = np.zeros((0, 3), np.int64)
    blocks = _Blocks(words, settings.block) if len(words) >= settings.least else None
    if blocks is None or not len(blocks.place):
        return none
    tree, place, m = WaveletTree(blocks.suffixes), blocks.place, len(blocks.place)
    at, period = [], []
    for length, names in blocks.names.items():
        own = np.flatnonzero((place % length == 0) & (names[:m] >= 0))
        low, high = names[own], names[own] + blocks.sizes[length][own]
        for near, far in ((1, length), (length, 2 * length)) if length == settings.block else ((length, 2 * length),):
            first = tree.successor(low, high, np.searchsorted(place, place[own] + near))
            end = np.searchsorted(place, place[own] + far)
            met = (first >= 0) & (first < end)
            i, a, lo, hi, end = own[met], first[met], low[met], high[met], end[met]
            second, last = tree.successor(lo, hi, a + 1), tree.predecessor(lo, hi, end - 1)
            second = np.where((second >= 0) & (second < end), second, a)
            i, a, second, last = place[i], place[a], place[second], place[last]
            few = last <= second
            for other in (a, second):
                at.append(i[few])
                period.append((other - i)[few])
            i, a, step, last = i[~few], a[~few], (second - a)[~few], last[~few]
            if length == settings.block:  # short progressions as they are
                for k in range(length):
                    listed = a + k * step <= last
                    at.append(i[listed])
                    period.append((a + k * step - i)[listed])
            elif len(i):
                for side in (blocks.ahead, blocks.behind):
                    gap = (a + side(a, a + step)) - (i + side(i, i + step)) if side == blocks.ahead else (a - side(a, a + step)) - (i - side(i, i + step))
                    fits = (gap >= near) & (gap < far)
                    at.append(i[fits])
                    period.append(gap[fits])
    at, period = np.concatenate(at), np.concatenate(period)
    start, end = at - blocks.behind(at, at + period), at + period + blocks.ahead(at, at + period)
    long = end - start >= np.maximum(settings.least, settings.periods * period)
    if not long.any():
        return none
    found = np.unique(np.stack([start[long], end[long], period[long]], 1), axis=0)
    found = found[np.concatenate([[True], (np.diff(found[:, :2], axis=0) != 0).any(1)])]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


RUNS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _detected(settings: RunSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE_BYTES):
            texts = [(t or "").encode().split() for t in part.column("text").to_pylist()]
            numbers, bounds, known = [], [0], 0
            for words in texts:
                if len(words) >= settings.least:
                    table: dict[bytes, int] = {}
                    numbers += [known + table.setdefault(w, len(table)) for w in words]
                    known += len(table)
                bounds.append(len(numbers))
            found = find_runs(np.array(numbers, np.int64), settings)
            cuts = np.searchsorted(found[:, 0], bounds)
            runs, collapsed = [], []
            for i, words in enumerate(texts):
                own = found[cuts[i] : cuts[i + 1]] - [bounds[i], bounds[i], 0]
                runs.append([{"start": s, "length": e - s, "period": q} for s, e, q in own.tolist()])
                if len(own):
                    kept = np.ones(len(words), bool)
                    for s, e, q in own.tolist():
                        kept[s + q : e] = False
                    words = [words[j] for j in np.flatnonzero(kept).tolist()]
                collapsed.append(b" ".join(words).decode())
            columns = [part.column("doc_id"), pa.array([len(w) for w in texts], pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return run


def runs(docs: DataFrame, settings: RunSettings = RunSettings()) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row: its runs by start and period, and its words without those after a run's first period."""
    return id_and_text(docs).mapInArrow(_detected(settings), f"doc_id {dict(docs.dtypes)['doc_id']}, {RUNS}")


def repeating_tail(text: Column, key: Column) -> Column:
    """The text with its words from ``g % n`` on replaced by repetitions of the first ones of them, where ``key`` ends in 0.

    ``g`` is ``key`` without its last digit, ``n`` the number of words, the repeated words are ``1 + (n - g % n) div (3 + g % 8)``.
    """
    g = F.floor(key / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        period = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, a + (i - a) % period))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), tail), " ")).otherwise("")

    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(key % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(text)


def longest_exponent(runs: Column) -> Column:
    """The run with the greatest length in periods, compared exactly; ties by start, then period. Null without runs."""

    def order(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        by = F.when(left > right, -1).when(left < right, 1)
        return by.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.signum(a["period"] - b["period"]).cast("int"))

    return F.get(F.array_sort(runs, order), F.lit(0))
