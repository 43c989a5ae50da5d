"""Periodic runs of words, found on a Re-Pair grammar of the parts of a text that can hold one."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staytide.llm.text import in_slices

#: A run has at least so many words and at least so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4

Run = tuple[int, int, int]  # start, length, period


class Grammar:
    """Re-Pair: the most frequent pair of neighbouring symbols becomes a symbol of its own until no pair is left twice.

    ``ids`` are the words' numbers, a negative one a border that no pair crosses.
    Symbols from ``base`` on are nonterminals, ``rules[s - base]`` their two
    parts. Neighbours are linked by position, a pair's places are kept in sets,
    and the queue's entries are checked when taken, so the work grows with the
    symbols replaced. Of equally frequent pairs the one seen first in the text goes first.
    """

    def __init__(self, ids: list[int]):
        n = len(ids)
        self.base = max(ids, default=0) + 1
        self.rules: list[tuple[int, int]] = []
        symbol, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[tuple[int, int], dict[int, None]] = defaultdict(dict)
        last = (-1, (-1, -1))
        for i in range(n - 1):
            pair = (symbol[i], symbol[i + 1])
            # In a row of one symbol every second place counts, as pairs may not overlap.
            if pair[0] < 0 or pair[1] < 0 or last == (i - 1, pair):
                continue
            places[pair][i] = None
            last = (i, pair) if pair[0] == pair[1] else last
        queue = [(-len(p), next(iter(p)), pair) for pair, p in places.items() if len(p) > 1]
        heapq.heapify(queue)

        def removed(i: int, pair: tuple[int, int]) -> None:
            if (p := places.get(pair)) is not None:
                p.pop(i, None)

        while queue:
            size, _, pair = heapq.heappop(queue)
            found = places.get(pair)
            if found is None or len(found) < 2:
                continue
            if len(found) != -size:
                heapq.heappush(queue, (-len(found), next(iter(found)), pair))
                continue
            del places[pair]
            new, changed = self.base + len(self.rules), {}
            made = 0
            for i in sorted(found):
                j = after[i] if i < n else n
                if symbol[i] != pair[0] or j >= n or symbol[j] != pair[1]:
                    continue  # taken by the replacement before it
                left, right = before[i], after[j]
                if left >= 0 and symbol[left] >= 0:
                    removed(left, (symbol[left], pair[0]))
                if right < n and symbol[right] >= 0:
                    removed(j, (pair[1], symbol[right]))
                    if symbol[right] == pair[1] != pair[0]:
                        # A row of one symbol lost its first: its pairs are counted from the next one on.
                        row, k, second = (pair[1], pair[1]), right, False
                        while (m := after[k]) < n and symbol[m] == pair[1]:
                            removed(k, row) if second else places[row].setdefault(k)
                            k, second = m, not second
                        changed[row] = None
                symbol[i], symbol[j] = new, -2
                after[i] = right
                if right < n:
                    before[right] = i
                made += 1
                if left >= 0 and symbol[left] >= 0:
                    fresh = (symbol[left], new)
                    # Three of the new symbol in a row hold its pair with itself once.
                    if not (fresh[0] == new and before[left] >= 0 and before[left] in places.get(fresh, ())):
                        places[fresh][left] = None
                        changed[fresh] = None
                if right < n and symbol[right] >= 0:
                    fresh = (new, symbol[right])
                    places[fresh][i] = None
                    changed[fresh] = None
            self.rules.append(pair)
            for fresh in changed:
                if len(places[fresh]) > 1:
                    heapq.heappush(queue, (-len(places[fresh]), next(iter(places[fresh])), fresh))
        #: What is left: place and symbol, borders left out.
        self.start = []
        i = 0
        while i < n:
            if symbol[i] >= 0:
                self.start.append((i, symbol[i]))
            i = after[i]
        self.lengths = [1] * self.base
        for a, b in self.rules:
            self.lengths.append(self.lengths[a] + self.lengths[b])

    def occurrences(self) -> dict[int, list[int]]:
        """First words of every nonterminal's places in the derivation of the text, from the last rule to the first."""
        at: dict[int, list[int]] = defaultdict(list)
        for i, s in self.start:
            if s >= self.base:
                at[s].append(i)
        for s in range(self.base + len(self.rules) - 1, self.base - 1, -1):
            a, b = self.rules[s - self.base]
            if a >= self.base:
                at[a] += at[s]
            if b >= self.base:
                shift = self.lengths[a]
                at[b] += [i + shift for i in at[s]]
        return at


def _reach(w: np.ndarray, i: int, j: int, most: int, step: int) -> int:
    """How many words from i and from j on agree, at most ``most``, forwards (``step`` 1) or backwards (-1)."""
    done, block = 0, 32
    while done < most:
        k = min(block, most - done)
        if step > 0:
            same = w[i + done:i + done + k] == w[j + done:j + done + k]
        else:
            same = w[i - done - k + 1:i - done + 1][::-1] == w[j - done - k + 1:j - done + 1][::-1]
        if not same.all():
            return done + int(same.argmin())
        done, block = done + k, block * 4
    return done


def _candidates(w: np.ndarray, q: np.ndarray, cut: int, low: int, high: int) -> list[tuple[int, bool]]:
    """Those of the periods ``q`` that a run across ``cut`` may have, and whether its greater part lies left of it. That
    part has two periods at least, so a whole period beside the boundary repeats; while many are left, up to 16 words of
    it are compared."""
    out = []
    for left in (True, False):
        alive, k = q[2 * q <= (cut - low if left else high - cut)], 0
        while len(alive) and (k < 2 or (len(alive) > 3 and k < 16)):
            beside = cut - np.minimum(k, alive) if left else cut - 1 + np.minimum(k, alive)
            same = w[beside] == w[beside - alive if left else beside + alive]
            alive, k = alive[same], k + 1
        out += [(int(x), left) for x in alive]
    return sorted(out)


def crossing_runs(w: np.ndarray, pairs: dict[tuple[int, int], np.ndarray], low: int, cut: int, high: int) -> list[Run]:
    """Runs within words ``low`` to ``high`` (excluded) that hold both words at the boundary ``cut``.

    Such a run holds the pair of words at the boundary at least three times, one
    period apart, so the periods are distances between the pair's places
    (``pairs``). A multiple of a period is left out where it would give the same interval.
    """
    places = pairs[int(w[cut - 1]), int(w[cut])]
    most = (high - low) // MIN_PERIODS
    here, found, spans = cut - 1, [], []
    near = places[np.searchsorted(places, max(low, here - most)):np.searchsorted(places, min(high - 2, here + most), side="right")]
    if len(near) < 2:
        return found
    distances = np.unique(np.abs(near - here))
    for q, left in _candidates(w, distances[distances > 0], cut, low, high):
        anchor = here - q if left else here
        if any(q % p == 0 and a <= anchor and anchor + 1 + q < b for p, a, b in spans):
            continue
        back = _reach(w, anchor, anchor + q, anchor - low + 1, -1)
        ahead = _reach(w, anchor + 1, anchor + 1 + q, high - q - anchor - 1, 1)
        start, size = anchor - back + 1, back + ahead + q
        if size >= max(MIN_WORDS, MIN_PERIODS * q):
            found.append((start, size, q))
            spans.append((q, start, start + size))
    return found


def maximal(runs: list[Run]) -> list[Run]:
    """Intervals of one period that lie in another go; of equal intervals the smallest period stays."""
    kept: dict[tuple[int, int], Run] = {}
    furthest: dict[int, int] = {}
    for start, size, q in sorted(set(runs), key=lambda r: (r[0], -r[1], r[2])):
        if start + size > furthest.get(q, -1):
            furthest[q] = start + size
            kept.setdefault((start, size), (start, size, q))
    return sorted(kept.values(), key=lambda r: (r[0], r[2]))


def dense_parts(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of words in which every pair of neighbours occurs three times or more in the text. No run crosses any
    other place, as a run holds each of its pairs three times."""
    if len(ids) < MIN_WORDS:
        return []
    keys = ids[:-1].astype(np.int64) * (int(ids.max()) + 1) + ids[1:]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    often = np.concatenate([[False], counts[inverse] >= 3, [False]])
    edges = np.flatnonzero(often[1:] != often[:-1])
    return [(int(a), int(b) + 1) for a, b in zip(edges[::2], edges[1::2]) if b + 1 - a >= MIN_WORDS]


def runs_of(ids: np.ndarray) -> list[Run]:
    """All maximal runs of a sequence of word numbers, by start, then period.

    A grammar is built over the parts that can hold a run. Every run has one
    smallest place in the derivation that holds it whole, and crosses the
    boundary between the two halves there: each nonterminal's boundary is looked
    at once, at its first place, and what is found is carried to all its places;
    the boundaries of the start rule are looked at within their part. A shorter
    view of the same run, from a place that cuts it, is dropped at the end.
    """
    parts = dense_parts(ids)
    if not parts:
        return []
    sequence, at = [], []  # the parts one after the other, with borders between them, and where their words are
    for a, b in parts:
        sequence += ids[a:b].tolist() + [-1]
        at += [*range(a, b), -1]
    w = np.asarray(sequence)
    at_pair: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, pair in enumerate(zip(sequence, sequence[1:])):
        at_pair[pair].append(i)
    pairs = {pair: np.asarray(places) for pair, places in at_pair.items()}
    grammar = Grammar(sequence)
    found: list[Run] = []
    where = grammar.occurrences()
    for number, (a, _) in enumerate(grammar.rules):
        s = grammar.base + number
        size = grammar.lengths[s]
        if size >= MIN_WORDS:
            first = min(where[s])
            for start, length, q in crossing_runs(w, pairs, first, first + grammar.lengths[a], first + size):
                found += [(start - first + i, length, q) for i in where[s]]
    borders = [-1, *(i for i, x in enumerate(sequence) if x < 0)]
    for low, high in zip(borders, borders[1:]):
        symbols = grammar.start[bisect_left(grammar.start, (low + 1, -1)):bisect_left(grammar.start, (high, -1))]
        for cut, _ in symbols[1:]:
            found += crossing_runs(w, pairs, low + 1, cut, high)
    return maximal([(at[start], length, q) for start, length, q in found])


def without_repeats(n: int, runs: list[Run]) -> np.ndarray:
    """True for words that no run holds after its first period."""
    keep = np.ones(n, dtype=bool)
    for start, length, q in runs:
        keep[start + q:start + length] = False
    return keep


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start, length and period of every run of words, by start, then period) and
    ``collapsed``, the text with each run cut to its first period, words joined by one blank, of every row of ``docs``
    (``doc_id``, ``text``).

    Words are what stands between ASCII white space, compared as they are. A run
    is a maximal stretch with smallest period q of at least ``MIN_WORDS`` words
    and ``MIN_PERIODS`` periods. Null, empty and blank texts have no words, no
    runs and an empty ``collapsed``. Repeated rows give equal rows, null ids
    stay null, other columns are not read, and an empty table gives no rows.

    Documents are independent; a task holds a few texts at a time.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in in_slices(b.column("text")):
                n_words, runs, collapsed = [], [], []
                for t in texts:
                    words = t.split()
                    number: dict[bytes, int] = {}
                    ids = np.asarray([number.setdefault(x, len(number)) for x in words], dtype=np.int64)
                    found = runs_of(ids)
                    if found:
                        words = [x for x, k in zip(words, without_repeats(len(words), found).tolist()) if k]
                    n_words.append(len(ids))
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                    collapsed.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(texts)), pa.array(n_words, pa.int64()),
                                                  pa.array(runs, run), pa.array(collapsed, pa.string())],
                                                 ["doc_id", "n_words", "runs", "collapsed"])
                at += len(texts)

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(searched, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, "
                                     "collapsed string")
