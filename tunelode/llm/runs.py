"""Periodic runs of words by the runs theorem.

Every maximal run has a Lyndon root that is the longest Lyndon word at its place under one of the two orders of the
words, so the 2 n longest Lyndon words are all candidates there are.  The longest Lyndon word at i ends before the next
smaller value of the inverse suffix array (ISA) after i.  A root is extended to both sides by longest common extensions:
range minima over the LCP array of the words, and of the words read backwards.

Texts are worked on in chunks of about CHUNK words: a chunk's documents share one suffix array, in which later documents
sort first, so no suffix, Lyndon word or extension ever crosses a document's end.  A longer document is a chunk of its own.

Defined cases: a null or empty text has no words and no runs and collapses to ''; other columns are left out; repeated rows
and null ids are rows like any other; an empty table gives no rows; a text is never cut.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import encoded, give_back

CHUNK = 1 << 17
#: Range minima are looked up over blocks of this many values.
BLOCK = 32


def inverse_suffix_array(first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rank of each suffix among all.  `first` orders single positions, `ends` is the end of each one's document.

    Ranks are doubled in width each round and only where they still tie; a document's end is less than any word.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = first[order][1:] != first[order][:-1]
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = start
    alone = fresh & np.append(fresh[1:], True)
    open_, width = order[~alone], 1
    while len(open_):
        ahead = open_ + width
        second = np.where(ahead < ends[open_], rank[np.minimum(ahead, n - 1)] + 1, 0)
        mine = rank[open_]
        key = mine * (n + 1) + second
        by = np.argsort(key, kind="stable")
        open_, key, mine = open_[by], key[by], mine[by]
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        at = np.arange(len(key))
        group = np.ones(len(key), dtype=bool)
        group[1:] = mine[1:] != mine[:-1]
        head = np.maximum.accumulate(np.where(group, at, 0))
        rank[open_] = mine + np.maximum.accumulate(np.where(fresh, at, 0)) - head
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
        width *= 2
    return rank


def next_smaller(values: np.ndarray, near: int = 16) -> np.ndarray:
    """For each place the first later one with a smaller value, or the length.

    The first `near` places are tried in turn; what is left walks a tower of block minima up and down again.
    """
    n = len(values)
    out = np.full(n, n, dtype=np.int64)
    left = np.arange(n)
    for step in range(1, near + 1):
        left = left[left + step < n]
        hit = values[left + step] < values[left]
        out[left[hit]] = left[hit] + step
        left = left[~hit]
    at, want = left + near + 1, values[left]
    at, want, left = at[at < n], want[at < n], left[at < n]
    tower = [values]
    while len(tower[-1]) > 1:
        low = tower[-1]
        tower.append(np.minimum.reduceat(low, np.arange(0, len(low), 2)))
    level = np.zeros(len(left), dtype=np.int64)
    going_up = np.ones(len(left), dtype=bool)
    while len(left):
        low = np.empty(len(left), dtype=values.dtype)
        for k in np.unique(level):
            some = level == k
            low[some] = np.where(at[some] < len(tower[k]), tower[k][np.minimum(at[some], len(tower[k]) - 1)], np.iinfo(np.int64).max)
        hit = low < want
        done = hit & (level == 0)
        out[left[done]] = at[done]
        # a block with a smaller value is entered at its left half; else on to the next, as wide as alignment allows
        going_up &= ~hit
        down = hit & (level > 0)
        at = np.where(down, at * 2, np.where(hit, at, at + 1))
        level = np.where(down, level - 1, level)
        up = ~hit & (at % 2 == 0) & going_up & (level < len(tower) - 1)
        at, level = np.where(up, at // 2, at), np.where(up, level + 1, level)
        stay = ~done & (at < np.take([len(t) for t in tower], level))
        left, want, at, level, going_up = (x[stay] for x in (left, want, at, level, going_up))
    return out


class Extensions:
    """Longest common extension of any two places: a range minimum over the LCP array."""

    def __init__(self, words: np.ndarray, rank: np.ndarray, ends: np.ndarray) -> None:
        self.rank, self.ends = rank, ends
        self.lcp = self._lcp(words.tolist(), rank, ends.tolist())
        n = len(self.lcp)
        pad = np.concatenate([self.lcp, np.full(-n % BLOCK, np.iinfo(np.int64).max)]).reshape(-1, BLOCK)
        self.upto, self.since = np.minimum.accumulate(pad, axis=1).ravel(), np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [pad.min(axis=1)]
        while 2 << len(self.table) - 1 <= len(self.table[0]):
            half = 1 << len(self.table) - 1
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    @staticmethod
    def _lcp(words: list, rank: np.ndarray, ends: list) -> np.ndarray:
        """At r: common words of the suffixes of ranks r - 1 and r.  From one place to the next at most one word is lost."""
        n = len(words)
        suffix = np.empty(n, dtype=np.int64)
        suffix[rank] = np.arange(n)
        before = np.where(rank > 0, suffix[rank - 1], -1).tolist()
        out, same = [0] * n, 0
        for i, j in enumerate(before):
            if j < 0:
                same = 0
                continue
            room = min(ends[i] - i, ends[j] - j)
            while same < room and words[i + same] == words[j + same]:
                same += 1
            out[i] = same
            if same:
                same -= 1
        found = np.empty(n, dtype=np.int64)
        found[rank] = out
        return found

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words from i on and from j on, for different places i and j; none at a document's end."""
        n = len(self.rank)
        inside = (i < n) & (j < n)
        a, b = self.rank[np.minimum(i, n - 1)], self.rank[np.minimum(j, n - 1)]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)  # the minimum of lcp[low..high]
        first, last = low // BLOCK, high // BLOCK
        out = np.minimum(self.since[np.minimum(low, n - 1)], self.upto[high])
        gap = last - first - 1
        level = np.maximum(np.log2(np.maximum(gap, 1)).astype(np.int64), 0)
        for k in np.unique(level[gap > 0]):
            some = (gap > 0) & (level == k)
            t = self.table[k]
            out[some] = np.minimum(out[some], np.minimum(t[first[some] + 1], t[last[some] - (1 << k)]))
        short = np.flatnonzero(inside & (first == last) & (low <= high))
        if len(short):
            at = low[short, None] + np.arange(BLOCK)
            out[short] = np.where(at <= high[short, None], self.lcp[np.minimum(at, n - 1)], np.iinfo(np.int64).max).min(axis=1)
        return np.where(inside, out, 0)


def _ranks(words: np.ndarray, doc: np.ndarray, ends: np.ndarray, flip: bool = False) -> np.ndarray:
    """The inverse suffix array where later documents sort first, under the words' order or the opposite one."""
    width = int(words.max(initial=0)) + 1
    return inverse_suffix_array((doc[-1] - doc) * width + (width - 1 - words if flip else words), ends)


def runs(words: np.ndarray, sizes: np.ndarray, shortest: int = 2) -> np.ndarray:
    """Rows (document, start, length, period), in this order, of all maximal runs of at least `shortest` words and two periods.

    words: numbers of the words of all documents, one after another; sizes: each document's words.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    n = len(words)
    if not n:
        return np.zeros((0, 4), dtype=np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    stop = np.cumsum(sizes)
    ends, begins = stop[doc], (stop - sizes)[doc]
    roots = []
    for flip in (False, True):
        rank = _ranks(words, doc, ends, flip)
        period = next_smaller(rank) - np.arange(n)
        start = np.flatnonzero(_may_run(words, begins, ends, period, shortest))
        roots.append(np.stack([start, period[start]], axis=1))
        if not flip:
            forward = rank
    start, period = np.unique(np.concatenate(roots), axis=0).T
    if not len(start):
        return np.zeros((0, 4), dtype=np.int64)
    # only documents with a root that may run need extensions
    need = np.zeros(len(sizes), dtype=bool)
    need[doc[start]] = True
    some = need[doc]
    place = np.cumsum(some) - 1
    w, d = words[some], doc[some]
    m = len(w)
    offset = np.arange(n)[some] - np.arange(m)  # how far a place moved, alike within a document
    e, b = ends[some] - offset, begins[some] - offset
    rank = np.empty(m, dtype=np.int64)
    rank[np.argsort(forward[some], kind="stable")] = np.arange(m)
    s, moved = place[start], offset[place[start]]
    right = Extensions(w, rank, e)(s + period, s)
    right = np.where(s + period < e[s], right, 0)
    back = w[::-1]
    back_ends = (m - b)[::-1]
    back_rank = _ranks(back, (d[-1] - d)[::-1], back_ends)
    left = np.where(s > b[s], Extensions(back, back_rank, back_ends)(m - s, m - s - period), 0)
    lo, hi = s - left, s + period + right
    good = hi - lo >= np.maximum(2 * period, shortest)
    found = np.stack([d[s], lo - b[s], hi - lo, period], axis=1)[good]
    return np.unique(found, axis=0)


def _may_run(words: np.ndarray, begins: np.ndarray, ends: np.ndarray, period: np.ndarray, shortest: int) -> np.ndarray:
    """Whether the root at each place can belong to a run.

    In a run of n >= max(shortest, 2 p) words, n - p places around the root's start equal those p later: at least half of `shortest`
    in a row.  So many are looked for to the right of the start and then to the left.
    """
    need = max(1, -(-shortest // 2))
    n = len(words)
    found = np.zeros(n, dtype=bool)
    live = np.flatnonzero(np.arange(n) + period <= ends)
    same = np.zeros(len(live), dtype=np.int64)
    for way in (1, -1):
        on = np.arange(len(live))
        for k in range(need):
            at = live[on] + (k if way > 0 else -1 - k)
            ok = (at + period[live[on]] < ends[live[on]]) & (at >= begins[live[on]])
            ok[ok] = words[at[ok]] == words[at[ok] + period[live[on]][ok]]
            on = on[ok]
            same[on] += 1
            if not len(on):
                break
    found[live[same >= need]] = True
    return found


def kept_words(size: int, found: np.ndarray) -> np.ndarray:
    """Which of a document's words stay when every run is collapsed to its first period."""
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def _of_chunk(ids: list, cut: list[list[bytes]], shortest: int) -> pa.RecordBatch:
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
    words = np.fromiter((number[w] for c in cut for w in c), dtype=np.int64, count=int(sizes.sum()))
    found = runs(words, sizes, shortest)
    at = np.searchsorted(found[:, 0], np.arange(len(cut) + 1))
    texts = []
    for k, c in enumerate(cut):
        if at[k] < at[k + 1]:
            c = [c[i] for i in np.flatnonzero(kept_words(len(c), found[at[k] : at[k + 1], 1:]))]
        texts.append(b" ".join(c))
    rows = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], fields=list(_RUN))
    lists = pa.ListArray.from_arrays(pa.array(at, type=pa.int32()), rows, type=pa.list_(_RUN))
    return pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(sizes), lists, pa.array(texts, type=pa.binary()).cast(pa.string())], schema=_FOUND)


def _finder(shortest: int, chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list = []
            cut: list[list[bytes]] = []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = encoded(text.as_py()).split()
                if cut and held + len(c) > chunk:
                    yield _of_chunk(ids, cut, shortest)
                    ids, cut, held = [], [], 0
                ids.append(doc_id)
                cut.append(c)
                held += len(c)
            if cut:
                yield _of_chunk(ids, cut, shortest)
        give_back()

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 12, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: the maximal runs of at least `shortest` words, by start and then period,
    and the words without all that repeats a run's first period, joined by spaces."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _finder(shortest, chunk), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )
