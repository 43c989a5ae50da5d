"""Toxicity scores from a convolutional text classifier over hashed word embeddings."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staytide.llm.text import held_out, in_slices, kept_rows, lookup
from staytide.sources.tables import checkpointed

#: Labelled documents that one task trains on between two averages; there are as many parts as the documents need.
PART_ROWS = 6_000
#: Rows of the embedding at most, a size of the model; all other hash buckets hold zeros.
FIT_BUCKETS = 80_000
#: Averages of the parts' networks at most, and numbers sent together for them.
_TURNS, _PIECE = 8, 10_000
_EPOCHS, _STEPS, _BATCH, _SEED = 6, 900, 48, 3
_THRESHOLDS = np.linspace(0.05, 0.95, 19)
WIDTHS = (1, 2, 3)
_CHUNK = 100_000  # words looked at together when scoring
_WORDS = 200_000  # words a task remembers before it starts anew
_HELD = 2_000_000  # buckets of texts that a task counts at once
_WORD, _ASCII = re.compile(r"[^\W\d_]+"), re.compile("[a-z]+")  # the second finds the same in lower-cased ASCII


def _buckets(word: str) -> tuple[int, int]:
    """Hash buckets of a word and of its beginning."""
    return zlib.crc32(word.encode()), zlib.crc32(b"^" + word[:4].encode()) if len(word) > 4 else 0


def _split(text: str) -> list[str]:
    lower = text.lower()
    return (_ASCII if lower.isascii() else _WORD).findall(lower)


class _Words(dict):
    """The embedding rows of a word's two buckets as one number: the first, and the second above 32 bits. 0 without any."""

    def __init__(self, rows: dict[int, int]):
        self.row = rows.get

    def __missing__(self, word: str) -> int:
        own, beginning = _buckets(word)
        self[word] = pair = self.row(own, 0) | self.row(beginning, 0) << 32
        return pair

    def of(self, text: str) -> np.ndarray:
        if len(self) > _WORDS:
            self.clear()
        found = _split(text)
        return np.fromiter(map(self.__getitem__, found), dtype=np.int64, count=len(found))


def _rows_of(pairs: np.ndarray) -> np.ndarray:
    return np.stack([pairs & 0xFFFFFFFF, pairs >> 32], axis=1)


@dataclass
class TextCNN:
    """Embedding sum of a word's buckets, filters of several widths, maximum over the text, logistic output."""

    rows: dict[int, int]
    table: np.ndarray
    filters: dict[int, np.ndarray]  # width: [width, dimension, filters]
    bias: dict[int, np.ndarray]
    out: dict[int, np.ndarray]
    intercept: float
    def __post_init__(self) -> None:
        self._words = _Words(self.rows)

    def scores(self, texts: list[str]) -> np.ndarray:
        widest = max(WIDTHS)
        # The filters' columns side by side, the widest last, so those that look j words on are the last ones.
        sizes = [self.out[w].shape[0] for w in sorted(WIDTHS)]
        ahead = [np.concatenate([self.filters[w][j] for w in sorted(WIDTHS) if w > j], axis=1) for j in range(widest)]
        pooled = np.full((len(texts), sum(sizes)), -np.inf, dtype=np.float32)
        gap = np.zeros(widest - 1, dtype=np.int64)

        def flush(stream: list[np.ndarray], owner: list[tuple[int, int, int]]) -> None:
            # Every width looks past the end of a text into the zeros between texts, so short texts count too.
            used, at = np.unique(np.concatenate([*stream, gap]), return_inverse=True)
            vectors, n = self.table[_rows_of(used)].sum(axis=1), len(at) - len(gap)
            total = (vectors @ ahead[0]).take(at[:n], axis=0)
            for j in range(1, widest):
                total[:, -ahead[j].shape[1]:] += (vectors @ ahead[j]).take(at[j:n + j], axis=0)
            for d, a, b in owner:
                np.maximum(pooled[d], total[a:b].max(axis=0), out=pooled[d])

        stream, owner, held = [], [], 0
        for d, text in enumerate(texts):
            ids = np.concatenate([self._words.of(text), gap])
            for at in range(0, len(ids), _CHUNK):
                # A long text comes in parts that overlap by the widest filter.
                part = ids[at:at + _CHUNK + len(gap)]
                owner.append((d, held, held + len(part)))
                stream += [part, gap]
                held += len(part) + len(gap)
                if held >= _CHUNK:
                    flush(stream, owner)
                    stream, owner, held = [], [], 0
        if owner:
            flush(stream, owner)
        bias, out = (np.concatenate([of[w] for w in sorted(WIDTHS)]) for of in (self.bias, self.out))
        logit = self.intercept + (np.maximum(pooled + bias, 0) @ out).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


class _Hashes(dict):
    """Both hash buckets of the words met so far, in one number."""

    def __missing__(self, word: str) -> int:
        own, beginning = _buckets(word)
        self[word] = both = own | beginning << 32
        return both

    def of(self, text: str) -> np.ndarray:
        """The distinct buckets of a text."""
        if len(self) > _WORDS:
            self.clear()
        found = set(_split(text))
        both = np.unique(np.fromiter(map(self.__getitem__, found), dtype="<u8", count=len(found)).view("<u4"))
        return both[both > 0]


def _drawn(rows: dict[int, int], dimension: int = 8, filters: int = 8, seed: int = _SEED) -> dict[str, np.ndarray]:
    """The network before any training, for the embedding ``rows`` of hash buckets."""
    draw = np.random.default_rng(seed)
    table = draw.normal(0, 0.1, (len(rows) + 1, dimension)).astype(np.float32)
    table[0] = 0
    params = {"table": table, "c": np.zeros(1, dtype=np.float32)}
    for w in WIDTHS:
        params[f"f{w}"] = draw.normal(0, 0.4, (w, dimension, filters)).astype(np.float32)
        params[f"b{w}"] = np.zeros(filters, dtype=np.float32)
        params[f"o{w}"] = draw.normal(0, 0.3, filters).astype(np.float32)
    return params


def _model(rows: dict[int, int], params: dict[str, np.ndarray]) -> TextCNN:
    return TextCNN(rows, params["table"].astype(np.float32), *({w: params[f"{k}{w}"] for w in WIDTHS} for k in "fbo"), float(params["c"][0]))


def fit(texts: list[str], y: np.ndarray, epochs: int = _EPOCHS, steps: int = _STEPS) -> TextCNN:
    """The network trained on ``texts`` in one place, for ``epochs``, on few texts for ``steps`` batches."""
    hashes = _Hashes()
    seen, n = np.unique(np.concatenate([np.empty(0, dtype=np.uint32), *map(hashes.of, texts)]), return_counts=True)
    common = [h for h in np.lexsort((seen, -n))[:FIT_BUCKETS] if n[h] >= 3]
    rows = {h: i + 1 for i, h in enumerate(seen[common].tolist())}
    words = _Words(rows)
    return _model(rows, _trained(_drawn(rows), [words.of(text) for text in texts], y, _rounds(len(texts), epochs, steps)))


def _rounds(n: int, epochs: int = _EPOCHS, steps: int = _STEPS) -> int:
    return max(epochs, -(-steps * _BATCH // n)) if n else 0


def _trained(start: dict[str, np.ndarray], docs: list[np.ndarray], y: np.ndarray, epochs: int, batch: int = _BATCH, rate: float = 0.01,
             decay: float = 1e-4, seed: int | tuple[int, ...] = _SEED) -> dict[str, np.ndarray]:
    """``start`` after ``epochs`` of Adam on the log loss over texts given as :class:`_Words` has them. The
    gradient of a maximum reaches the words at its place only."""
    draw = np.random.default_rng(seed)
    gap = np.zeros(max(WIDTHS) - 1, dtype=np.int64)
    params = dict(start)
    m = {k: np.zeros_like(v) for k, v in params.items()}
    s = {k: np.zeros_like(v) for k, v in params.items()}
    turn = 0
    for _ in range(epochs):
        order = draw.permutation(len(docs))
        for at in range(0, len(order), batch):
            own = order[at:at + batch]
            # Two gaps, so that no filter that begins in a text or its gap reaches the next text.
            stream = np.concatenate([x for i in own for x in (docs[i], gap, gap)])
            sizes = np.asarray([len(docs[i]) + len(gap) for i in own])
            ends = np.cumsum(sizes + len(gap)) - len(gap)
            starts, n = ends - sizes, int(ends[-1])
            used, place = np.unique(stream, return_inverse=True)
            feats = _rows_of(used)
            vectors = params["table"][feats].sum(axis=1)
            logit, kept = np.full(len(own), params["c"][0]), {}
            for w in WIDTHS:
                f = params[f"f{w}"]
                total = sum((vectors @ f[j]).take(place[j:n + j], axis=0) for j in range(w))
                where = np.stack([a + total[a:b].argmax(axis=0) for a, b in zip(starts, ends)])
                value = np.take_along_axis(total, where, axis=0) + params[f"b{w}"]
                kept[w] = (where, value)
                logit = logit + np.maximum(value, 0) @ params[f"o{w}"]
            off = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[own]) / len(own)).astype(np.float32)
            grad = {k: decay * v for k, v in params.items() if k != "table"}
            grad["c"] = grad["c"] + off.sum()
            by_word = np.zeros_like(vectors)
            for w in WIDTHS:
                where, value = kept[w]
                back = off[:, None] * params[f"o{w}"] * (value > 0)
                grad[f"o{w}"] = grad[f"o{w}"] + off @ np.maximum(value, 0)
                grad[f"b{w}"] = grad[f"b{w}"] + back.sum(axis=0)
                g = np.zeros_like(params[f"f{w}"])
                for j in range(w):
                    at_word = place[where + j]
                    g[j] = np.einsum("nfd,nf->df", vectors[at_word], back)
                    np.add.at(by_word, at_word, back[:, :, None] * params[f"f{w}"][j].T)
                grad[f"f{w}"] = grad[f"f{w}"] + g
            hit = np.flatnonzero(np.abs(by_word).sum(axis=1))
            step = np.zeros_like(params["table"])
            for k in range(feats.shape[1]):
                np.add.at(step, feats[hit, k], by_word[hit])
            step[0] = 0
            grad["table"] = step
            turn += 1
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.001 * (g * g - s[k])
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**turn)) / (np.sqrt(s[k] / (1 - 0.999**turn)) + 1e-8)
    return params


def _vocabulary(sample: DataFrame) -> dict[int, int]:
    """Embedding rows of the hash buckets that at least three texts of ``sample`` have, counted over all of them; of more
    than ``FIT_BUCKETS`` the commonest."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, found, held = _Hashes(), [], 0
        for b in batches:
            for texts in in_slices(b.column("text")):
                found += map(hashes.of, texts)
                held += sum(map(len, found[-len(texts):]))
                if held > _HELD:
                    yield tally(found)
                    found, held = [], 0
        if found:
            yield tally(found)

    def tally(found: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in np.unique(np.concatenate(found), return_counts=True)], ["h", "n"])

    common = (sample.select("text").mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
              .filter("n >= 3").orderBy(F.desc("n"), "h").limit(FIT_BUCKETS))
    return {r["h"]: i + 1 for i, r in enumerate(common.collect())}


def _numbered(sample: DataFrame, rows: dict[int, int]) -> DataFrame:
    """``part``, ``doc_id``, ``y`` and ``words`` (numbers of :class:`_Words` as bytes) of ``sample``, in its order and written once: no
    average cuts a text into words again."""
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = _Words(rows), ["part", "doc_id", "y"]
        for b in batches:
            at = 0
            for texts in in_slices(b.column("text")):
                words = pa.array([known.of(t).tobytes() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, len(texts)) for c in names), words], [*names, "words"])
                at += len(texts)

    return checkpointed(sample.select("part", "doc_id", "y", "text")
                        .mapInArrow(numbered, f"part int, doc_id {dict(sample.dtypes)['doc_id']}, y int, words binary"))


def _averaged(sample: DataFrame, params: dict[str, np.ndarray], n: int, epochs: int, turn: int) -> dict[str, np.ndarray]:
    """The mean, weighted by the ``n`` texts, of what every part of ``sample`` (:func:`_numbered`) makes of ``params`` in
    ``epochs`` over its own texts."""
    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs, y, own = None, [], [], None

        def finished() -> None:
            nonlocal total
            if docs:
                got = _trained(params, docs, np.asarray(y, dtype=np.float64), epochs, seed=(_SEED, turn, own))
                part = {k: v.astype(np.float64) * len(docs) for k, v in got.items()}
                total = part if total is None else {k: total[k] + v for k, v in part.items()}

        # Rows come part by part, one part is held at a time.
        for b in batches:
            at = 0
            for words in in_slices(b.column("words")):
                for part, mark, own_words in zip(*(b.column(c).slice(at, len(words)).to_pylist() for c in ("part", "y")), words):
                    if part != own:
                        finished()
                        docs, y, own = [], [], part
                    docs.append(np.frombuffer(own_words, dtype=np.int64))
                    y.append(mark)
                at += len(words)
        finished()
        for name, values in (total or {}).items():
            flat = values.ravel().astype(np.float32)
            cut = [flat[at:at + _PIECE].tobytes() for at in range(0, len(flat), _PIECE)]
            yield pa.RecordBatch.from_pydict({"name": [name] * len(cut), "piece": pa.array(range(len(cut)), pa.int32()), "sums": cut})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        sums = sum(np.frombuffer(v, dtype=np.float32).astype(np.float64) for v in rows.sort_values("sums")["sums"]) / n
        return rows[:1].assign(sums=[sums.astype(np.float32).tobytes()])

    schema = "name string, piece int, sums binary"
    means = sample.select("part", "words", "y").mapInArrow(learnt, schema).groupBy("name", "piece").applyInPandas(added, schema)
    found: dict[str, list[bytes]] = {k: [] for k in params}
    for r in sorted(means.collect()):
        found[r["name"]].append(r["sums"])
    return {k: np.frombuffer(b"".join(v), dtype=np.float32).reshape(params[k].shape) for k, v in found.items()}


def calibrate(counts: list, least: int = 20) -> dict[str | None, float]:
    """Threshold per language with the best F1 on held-back rows, of equal ones the one next to a half; languages with fewer
    than ``least`` toxic rows share the threshold of all, under the key None. ``counts``: ``lang``, ``y``, ``at`` (the
    thresholds that the score reaches) and ``n``."""
    tallies: dict[str | None, np.ndarray] = {None: np.zeros((2, len(_THRESHOLDS) + 1))}
    for r in counts:
        for lang in {None, r["lang"]}:
            tallies.setdefault(lang, np.zeros((2, len(_THRESHOLDS) + 1)))[r["y"], r["at"]] += r["n"]

    def best(tally: np.ndarray) -> float:
        toxic = tally[1].sum()
        if not toxic:
            return 0.5
        reached = tally[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
        f1 = 2 * reached[1] / np.maximum(1, reached.sum(axis=0) + toxic)
        return float(min(_THRESHOLDS[np.isclose(f1, f1.max())], key=lambda c: abs(c - 0.5)))

    return {lang: best(tally) for lang, tally in tallies.items() if lang is None or tally[1].sum() >= least}


def _labelled(docs: DataFrame, labels: DataFrame, limits: tuple[int | None, int | None]) -> DataFrame:
    """``part``, ``doc_id``, ``text``, ``y``, ``lang`` and ``back`` (only calibrates) of the labelled documents, written part
    by part. Of several labels of one id the largest counts, of several texts the smallest."""
    fold = F.pmod(F.crc32(F.concat(F.lit("fold "), F.col("doc_id").cast("string")).cast("binary")), F.lit(5))
    marks = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y")))
    if any(n is not None for n in limits):
        some = [marks.filter(F.col("y") == kind) for kind in (1, 0)]
        some = [m if n is None else m.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for m, n in zip(some, limits)]
        marks = some[0].unionByName(some[1])
    marks = checkpointed(marks)
    parts = max(1, -(-marks.count() * 4 // (5 * PART_ROWS)))
    text, lang = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang")
    # Both folds are dealt over all parts, so that neither scoring nor training waits for a few of them.
    return checkpointed(docs.join(lookup(marks), "doc_id").select("doc_id", text, "y", lang)
                        .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).repartition(parts, "part")
                        .groupBy("part", "doc_id").agg(F.min(F.struct("text", "y", "lang")).alias("row")).select("part", "doc_id", "row.*")
                        .withColumn("back", fold == 0).sortWithinPartitions("part", "doc_id"))


def train(docs: DataFrame, labels: DataFrame, fit_toxic: int | None = None,
          fit_clean: int | None = None) -> tuple[TextCNN, dict[str | None, float]]:
    """Model and thresholds from all labelled rows whose CRC modulo 3 is not 1,
    whole and of any length; a fifth of them, by hash, only calibrates the
    thresholds. ``fit_toxic`` and ``fit_clean`` bound the rows of each kind for
    a caller who wants that. The language chooses a threshold and never enters
    a score.

    Texts stay on the executors. They are dealt by hash over parts of some
    ``PART_ROWS``; every part trains from the common network, the results
    are averaged, and that is repeated up to ``_TURNS`` times until every part has had the epochs
    of :func:`fit`. One part alone trains without a break. Word counts and the tallies that
    thresholds are chosen by cover all rows.
    """
    seen = labels.filter(~held_out(F.col("doc_id"), 3, 1))
    named = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    sample = _labelled(named, seen, (fit_toxic, fit_clean))
    fitted = sample.filter("not back")
    rows = _vocabulary(fitted)
    params = _drawn(rows)
    sizes = fitted.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.count("n").alias("parts"), F.sum("n").alias("n")).first()
    if sizes["parts"]:
        rounds = _rounds(sizes["n"] // sizes["parts"])
        each = rounds if sizes["parts"] == 1 else -(-rounds // _TURNS)
        words = _numbered(fitted, rows)
        for turn, done in enumerate(range(0, rounds, each)):
            params = _averaged(words, params, sizes["n"], min(each, rounds - done), turn)
    model = _model(rows, params)
    reached = sum((F.col("score") >= float(c)).cast("int") for c in _THRESHOLDS)
    held = score_texts(sample.filter("back").select("text", "y", "lang"), model)
    return model, calibrate(held.groupBy("lang", "y", reached.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect())


def score_texts(rows: DataFrame, model: TextCNN, text: str = "text") -> DataFrame:
    """``rows`` with a column ``score``; null texts count as empty. The texts, a column of their own or a field of one
    (``doc.text``), are looked at and returned in small batches. A column of texts is not returned, one with other fields is."""
    own, _, inside = text.partition(".")
    names = [n for n in rows.columns if inside or n != own]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, at = b.column(own), 0
            for texts in in_slices(column.field(inside) if inside else column):
                scores = pa.array(model.scores([t or "" for t in texts]))
                yield pa.RecordBatch.from_arrays([*(b.column(n).slice(at, len(texts)) for n in names), scores], [*names, "score"])
                at += len(texts)

    kinds = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes if n in names)
    return rows.mapInArrow(scored, f"{kinds}, score double")


def _threshold(thresholds: dict[str | None, float], lang: Column) -> Column:
    at = F.lit(thresholds[None])
    for name, value in thresholds.items():
        if name is not None:
            at = F.when(lang == name, F.lit(value)).otherwise(at)
    return at


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_toxic: int | None = None,
             fit_clean: int | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` (score of at least
    ``threshold``), and ``flagged``: score of at least the threshold calibrated
    for the row's language, for every row of ``docs`` (``doc_id``, ``text``,
    ``lang``), learnt from ``labels`` (``doc_id``, ``toxic``).

    Null and empty texts are scored as texts without words. Without labelled
    rows the model stays as drawn. Repeated rows score alike; a null or unknown
    language takes the common threshold; other columns are not read.
    """
    model, thresholds = train(docs, labels, fit_toxic, fit_clean)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    scored = score_texts(docs.select("doc_id", lang.alias("lang"), F.col("text").cast("string").alias("text")), model)
    at = _threshold(thresholds, F.col("lang"))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), (F.col("score") >= at).alias("flagged"))


def keep_civil(docs: DataFrame, labels: DataFrame, fit_toxic: int | None = None, fit_clean: int | None = None) -> DataFrame:
    """The rows of ``docs`` below their language's threshold, with all their columns; without a column ``lang`` all
    rows have the common threshold."""
    model, thresholds = train(docs, labels, fit_toxic, fit_clean)
    lang = F.col("doc.lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = kept_rows(docs)
    # A whole text goes to Python once, inside its row, unless it is not yet a string.
    plain = dict(docs.dtypes).get("text") == "string"
    scored = (score_texts(rows, model, "doc.text") if plain else
              score_texts(rows.withColumn("text", F.col("doc.text").cast("string")), model))
    return (scored.filter(F.col("score") < _threshold(thresholds, lang))
            .select("doc.*"))
