"""Best-fit packing of token pieces after dominance reduction, on the histogram of lengths."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staytide.llm.text import in_slices
from staytide.sources.tables import checkpointed

CAPACITY = 2048
END_ID = 0
#: Word cache of a task: emptied when it holds so many words.
_CACHE_WORDS = 600_000


#: ASCII signs that may close a word; an apostrophe may start a pre-token of its own and is left out.
_CLOSING = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)


class Encoder:
    """Token ids of whole texts as little-endian bytes.

    The vocabulary's pre-tokens never span white space and its texts are
    lower-cased, so a text's ids are those of its words one after the other and
    each distinct word is encoded once per task. Signs after a final letter,
    normalised, are a pre-token of their own, so words that differ in them share the work. Texts
    that might name a special token are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.asarray([str(self.tokenizer.id_to_token(i)).endswith("</w>") for i in range(size)])
        self.known: dict[bytes, bytes] = {}

    def _alone(self, words: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.asarray(c.ids, dtype="<u4").tobytes() for c in coded]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words made of letters. They are encoded side by side and told
        apart by their closing tokens; should a word have more than one pre-token,
        the number of closing tokens shows it and all are encoded alone."""
        out, parts = [], [words[at:at + 1000] for at in range(0, len(words), 1000)]
        coded = (c for at in range(0, len(parts), 8)
                 for c in self.tokenizer.encode_batch_fast([" ".join(p) for p in parts[at:at + 8]], add_special_tokens=False))
        for part, code in zip(parts, coded):
            ids = np.asarray(code.ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or stops[-1] != len(ids):
                out += self._alone(part)
                continue
            flat, stops = ids.tobytes(), (4 * stops).tolist()
            out += [flat[i:j] for i, j in zip([0, *stops[:-1]], stops)]
        return out

    def _closes(self, core: bytes) -> bool:
        """Whether a sign after these letters is a pre-token of its own: not so where normalising ends them in a
        combining mark, which joins the sign."""
        text = core.decode()
        return text.isalpha() and (core.isascii() or self.tokenizer.normalizer.normalize_str(text)[-1:].isalpha())

    def _learn(self, new: list[bytes]) -> None:
        known, texts = self.known, b" ".join(new).decode().split(" ")
        plain = [t.isalpha() for t in texts]
        known.update(zip([w for w, p in zip(new, plain) if p], self._letters([t for t, p in zip(texts, plain) if p])))
        rest = [w for w, p in zip(new, plain) if not p]
        cores = [w.rstrip(_CLOSING) for w in rest]
        split = [len(c) < len(w) and self._closes(c) for w, c in zip(rest, cores)]
        alone = list({w for w, s in zip(rest, split) if not s} | {w[len(c):] for w, c, s in zip(rest, cores, split) if s})
        known.update(zip(alone, self._alone([w.decode() for w in alone])))
        todo = list({c for c, s in zip(cores, split) if s and c not in known})
        known.update(zip(todo, self._letters([c.decode() for c in todo])))
        known.update((w, known[c] + known[w[len(c):]]) for w, c, s in zip(rest, cores, split) if s)

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        # Beyond ASCII lower-casing first could let a letter and a mark become one sign that they are not in the text.
        split = [None if b"<|" in t else (t.lower() if t.isascii() else t).split() for t in texts]
        if len(self.known) > _CACHE_WORDS:
            self.known = {}
        seen: set[bytes] = set()
        seen.update(*(ws for ws in split if ws))
        if new := list(seen.difference(self.known)):
            self._learn(new)
        get = self.known.__getitem__
        for t, ws in zip(texts, split):
            yield self._alone([t.decode()])[0] if ws is None else b"".join(map(get, ws))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``,
    ``ids_crc32``, and ``task`` and ``place``, the writing task and the piece's
    number among the task's pieces of that length.

    A document is its ids and the closing id; only a longer one than
    ``capacity`` is cut. ``tokenizer`` is a file path that executors can read.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, task = Encoder(tokenizer), defaultdict(int), TaskContext.get().partitionId()
        for b in batches:
            owner, rest = [], []
            for i, ids in enumerate(x for texts in in_slices(b.column("text"), 512) for x in encode(texts)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    n = len(part) // 4
                    owner.append(i)
                    rest.append((k, at // 4, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            columns = [pa.array(c, t) for c, t in zip(zip(*rest) if rest else [()] * 6,
                                                      (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(owner, pa.int64())), *columns],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])
            del b, columns, owner, rest
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(pieces, f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, "
                                   "ids_crc32 long, task int, place long")


class Plan:
    """Where the pieces of each length go: runs of pieces, counted from 0 within
    their length, that fill ``each`` places of consecutive sequences."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.sequences, self.fixed = capacity, dict(counts), 0, 0
        self.given: dict[int, int] = defaultdict(int)
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first piece, first sequence, each, offset
        self._reduce()
        self._best_fit()

    def _put(self, length: int, first: int, each: int, offset: int, pieces: int) -> None:
        self.runs.append((length, self.given[length], first, each, offset))
        self.given[length] += pieces
        self.left[length] -= pieces
        if not self.left[length]:
            del self.left[length]

    def _fix(self, parts: list[int], times: int) -> None:
        """``times`` sequences that hold ``parts`` and nothing else."""
        offset = 0
        for length in parts:
            self._put(length, self.sequences, 1, offset, times)
            offset += length
        self.sequences += times
        self.fixed += times

    def _dominant(self, length: int) -> list[int] | None:
        """A set with a piece of ``length`` that dominates every other set with
        one: swapping it into any packing never costs a sequence. Sets of up to
        two further pieces are looked at where three never fit."""
        room = self.capacity - length
        sizes = sorted(self.left)
        one = lambda s: self.left[s] - (s == length)  # noqa: E731  pieces of a size beside this one
        sizes = [s for s in sizes if one(s) > 0]
        fit = bisect_right(sizes, room)
        if not fit:
            return [length]
        best = sizes[fit - 1]
        if best == room:
            return [length, best]
        small = [s for s in sizes[:3] for _ in range(min(3, one(s)))][:3]
        if len(small) < 2 or small[0] + small[1] > room:
            return [length, best]
        if len(small) == 3 and sum(small) <= room:
            return None
        pair = 0
        for s in sizes[:fit]:
            k = bisect_right(sizes, room - s) - 1
            while k >= 0 and sizes[k] == s and one(s) < 2:
                k -= 1
            if k >= 0:
                pair = max(pair, s + sizes[k])
        return [length, best] if pair <= best else None

    def _reduce(self) -> None:
        """Martello-Toth reduction: fix dominating sets, largest pieces first, until none is left."""
        changed = True
        while changed:
            changed = False
            for length in sorted(self.left, reverse=True):
                while length in self.left and (parts := self._dominant(length)):
                    need = {p: parts.count(p) for p in parts}
                    times = min(self.left[p] // n for p, n in need.items())
                    # The set stays dominant while its pieces last: what goes only narrows the other sets.
                    self._fix(parts, times)
                    changed = True

    def _best_fit(self) -> None:
        """Best fit, decreasing, for all pieces of a length at once: the fullest
        sequence that takes a piece goes on taking them until it is too full."""
        open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, sequences)
        rooms: list[int] = []

        def add(room: int, first: int, n: int) -> None:
            if n and room:
                if not open_[room]:
                    rooms.insert(bisect_left(rooms, room), room)
                open_[room].append((first, n))

        for length in sorted(self.left, reverse=True):
            while length in self.left:
                n = self.left[length]
                k = bisect_left(rooms, length)
                if k < len(rooms):
                    room = rooms[k]
                    first, bins = open_[room].pop()
                    if not open_[room]:
                        rooms.pop(k)
                else:
                    room, first, bins = self.capacity, self.sequences, -(-n // (self.capacity // length))
                    self.sequences += bins
                each = room // length
                full = min(bins, n // each)
                if full:
                    self._put(length, first, each, self.capacity - room, full * each)
                    add(room - each * length, first, full)
                some = n - full * each if full < bins else 0
                if some:
                    self._put(length, first + full, some, self.capacity - room, some)
                    add(room - some * length, first + full, 1)
                add(room, first + full + bool(some), bins - full - bool(some))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every row of ``docs`` (``doc_id``, ``text``) with its
    ``sequence_id`` and ``offset``.

    Only lengths matter for packing, and there are at most ``capacity`` of them:
    the driver gets their counts, plans runs of equal pieces, and tasks turn a
    piece's number within its length into its place. Numbers come from each
    task's own count plus the counts of earlier tasks, so nothing is sorted and
    no length meets a single task. Null texts are empty documents (one piece of
    the closing id); repeated rows are packed each; an empty table gives no rows.
    """
    placed = checkpointed(token_pieces(docs, tokenizer, capacity))
    counts = checkpointed(placed.groupBy("length", "task").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("length").alias("l"), F.col("task").alias("t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    runs = np.asarray(sorted(Plan(histogram, capacity).runs), dtype=np.int64).reshape(-1, 5)
    numbered = placed.join(starts, (F.col("length") == F.col("l")) & (F.col("task") == F.col("t"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("skip")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts = runs[:, 0], runs[:, 1]
        edges = np.searchsorted(lengths, np.arange(capacity + 2))
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            run = np.empty(len(length), dtype=np.int64)
            for n in np.unique(length):
                own = length == n
                lo, hi = edges[n], edges[n + 1]
                run[own] = lo + np.searchsorted(firsts[lo:hi], number[own], side="right") - 1
            inside, each = number - firsts[run], runs[run, 3]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(runs[run, 2] + inside // each), pa.array(runs[run, 4] + inside % each * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    return numbered.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
