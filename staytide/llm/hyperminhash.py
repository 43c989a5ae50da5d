"""Near-duplicates by HyperMinHash: banded registers give candidates, their corrected estimate and full sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staytide.llm.components import connected_components, joined_components
from staytide.llm.text import in_slices, lookup, spread_lookup
from staytide.sources.tables import checkpointed

#: Registers of a sketch (2 to the power ``INDEX_BITS``), and mantissa bits kept of a register's smallest hash.
INDEX_BITS, MANTISSA_BITS = 8, 10
#: Registers are folded to half their number for the bands, four to a band.
BAND_REGISTERS = 4
#: Pairs are dropped if their estimate lies so many standard errors below the threshold.
ERRORS = 4.5


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the word shingles (A-Z lower-cased); fewer words are one shingle, none are none."""
    w = text.lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(size)))) if len(w) >= size else [b" ".join(w)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype=np.uint64))


def _bit_length(x: np.ndarray) -> np.ndarray:
    high = (x >> np.uint64(32)).astype(np.float64)
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])


def registers(hashes: np.ndarray) -> np.ndarray:
    """One number per register: 0 for an empty one, else 1 + (leading zeros << mantissa bits | mantissa) of the smallest
    hash there. A hash's first bits name its register, the rest is the value; ``hashes`` are sorted, so the smallest
    of a register is the first."""
    shift = 64 - INDEX_BITS
    starts = np.searchsorted(hashes, np.arange(1 << INDEX_BITS, dtype=np.uint64) << np.uint64(shift))
    full = np.append(starts[1:], len(hashes)) > starts
    value = hashes[starts[full]] & np.uint64((1 << shift) - 1)
    bits = _bit_length(value)
    # The bits after the leading one, moved to a fixed width.
    rest = np.where(bits > 0, value - (np.uint64(1) << np.maximum(bits - 1, 0).astype(np.uint64)), 0)
    at = bits - 1 - MANTISSA_BITS
    mantissa = np.where(at >= 0, rest >> np.maximum(at, 0).astype(np.uint64), rest << np.maximum(-at, 0).astype(np.uint64))
    zeros = np.minimum(shift - bits, 62).astype(np.uint64)
    out = np.zeros(1 << INDEX_BITS, dtype=np.uint16)
    out[full] = (1 + ((zeros << np.uint64(MANTISSA_BITS)) | (mantissa & np.uint64((1 << MANTISSA_BITS) - 1)))).astype(np.uint16)
    return out


def folded(sketch: np.ndarray) -> np.ndarray:
    """The sketch of half as many registers: a register is the first of its two halves if that has a hash (one zero
    more), else the second, whose hashes begin with a one."""
    first, second = sketch[..., 0::2], sketch[..., 1::2]
    # In the second half the index bit becomes the leading one and the mantissa holds the zeros: keep its own code,
    # marked by the place it came from, which is as exact as the register itself.
    return np.where(first > 0, first, np.where(second > 0, second.astype(np.uint32) | (1 << 16), 0)).astype(np.uint32)


def band_keys(sketch: np.ndarray) -> list[int]:
    """A key per band that has a hash: its number and its folded registers as one 64-bit hash."""
    bands = folded(sketch).reshape(-1, BAND_REGISTERS)
    keys = [xxhash.xxh64_intdigest(bands[b].tobytes(), int(b)) for b in np.flatnonzero(bands.any(axis=1))]
    return np.asarray(keys, dtype=np.uint64).view(np.int64).tolist()


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers of two sets of n and m hashes without a common one that are expected to agree by chance.

    Per register the smallest hashes are nearly exponential with rates n and m
    over the number of registers; they collide if they share the leading zeros
    and the mantissa, that is a cell whose width is the power of two below it
    over the number of mantissas. The density product is summed over the powers.
    """
    a, b = n / (1 << INDEX_BITS), m / (1 << INDEX_BITS)
    low = 2.0**-np.arange(1, 64 - INDEX_BITS)
    below = np.exp(-(a + b)[:, None] * low)
    total = (below - below * below) @ low / (1 << MANTISSA_BITS)  # the end of a power's cells is twice their start
    return (1 << INDEX_BITS) * total * a * b / (a + b)


def estimate(one: np.ndarray, many: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``many`` of the sketches that may reach ``percent`` % Jaccard similarity with ``one`` (one sketch, or one
    for each), and their estimates: agreeing registers over used ones, corrected by the collisions of what the sets do
    not share. A pair stays if the threshold lies within ``ERRORS`` standard errors, so few registers leave much room.
    The correction only lowers an estimate and is worked out where the plain one is near enough."""
    t = percent / 100
    used = ((many > 0) | (one > 0)).sum(axis=1)
    raw = ((many == one) & (many > 0)).sum(axis=1) / np.maximum(used, 1)
    least = t - ERRORS * np.sqrt(t * (1 - t) / np.maximum(used, 1))
    at = np.flatnonzero(raw >= least)
    if not len(at):
        return at, raw[at]
    chance = collisions(n[at], m[at]) / np.maximum(used[at], 1)
    similarity = np.clip((raw[at] - chance) / np.maximum(1 - chance, 1e-9), 0, 1)
    ok = similarity >= least[at]
    return at[ok], similarity[ok]


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``digest`` of the text, ``s`` (a hash that names the shingle set; null without words), ``n`` (its size),
    ``sketch`` and band ``keys`` of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.unhex(F.md5(text)).alias("digest"), text.alias("text"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in in_slices(b.column("text")):
                sets = [shingle_hashes(t, size) for t in texts]
                names = [np.uint64(xxhash.xxh64_intdigest(x.tobytes(), 42)).view(np.int64).item() if len(x) else None for x in sets]
                drawn = [registers(x) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, len(texts)), b.column("digest").slice(at, len(texts)), pa.array(names, pa.int64()),
                     pa.array(map(len, sets), pa.int64()), pa.array([r.tobytes() for r in drawn], pa.binary()),
                     pa.array(map(band_keys, drawn), pa.list_(pa.int64()))], ["doc_id", "digest", "s", "n", "sketch", "keys"])
                at += len(texts)

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(sketched, f"doc_id {kind}, digest binary, s long, n long, sketch binary, keys array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``s`` and ``shingles`` of the texts whose ``digest`` is ``wanted`` (``d``, ``s``, one row each); only those texts leave the scan."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = (docs.select(F.unhex(F.md5(text)).alias("digest"), text.alias("text"))
            .join(lookup(wanted), F.col("digest") == F.col("d")).select("s", "text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in in_slices(b.column("text")):
                sets = [shingle_hashes(t, size).view(np.int64) for t in texts]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("s").slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))],
                    ["s", "shingles"])
                at += len(texts)

    return rows.mapInArrow(hashed, "s long, shingles array<long>").dropDuplicates(["s"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose full sets have a similarity of at least ``percent`` %. Other sets stay where they are."""
    pairs = checkpointed(pairs)
    ends = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("end")).distinct())
    sets = sets.join(lookup(ends), F.col("s") == F.col("end"), "left_semi")
    a = sets.select(F.col("s").alias("a"), F.col("shingles").alias("of_a"))
    b = sets.select(F.col("s").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    # |a and b| / |a or b| >= p / 100 is (100 + p) * |a and b| >= p * (|a| + |b|).
    return (pairs.select("a", "b").join(a, "a").join(b, "b")
            .filter((100 + percent) * both >= percent * (F.size("of_a") + F.size("of_b"))).select("a", "b"))


def _sketches_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), -1)


def _sets_of(column: pa.Array) -> np.ndarray:
    """The sorted hash sets of a list column, as an array of arrays."""
    values, ends = column.flatten().to_numpy().view(np.uint64), column.value_lengths().to_numpy().cumsum()
    sets = np.empty(len(column), dtype=object)
    sets[:] = [values[i:j] for i, j in zip([0, *ends[:-1]], ends)]
    return sets


def likely_pairs(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (``a``, ``b``) that :func:`estimate` leaves, with their estimate ``e``; ``known`` has ``s``, ``n``, ``sketch``."""
    a = known.select(F.col("s").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("of_a"))
    b = known.select(F.col("s").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("of_b"))
    joined = pairs.join(a, "a").join(b, "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, e = estimate(_sketches_of(b.column("of_a")), _sketches_of(b.column("of_b")),
                             b.column("n_a").to_numpy(), b.column("n_b").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(at)), b.column("b").take(pa.array(at)), pa.array(e)], ["a", "b", "e"])

    return joined.mapInArrow(judged, "a long, b long, e double")


def _others(rows: dict, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each set's place in a bucket ordered by size, and those of the larger ones that may reach ``percent`` % by size.
    Where parts differ, only pairs across parts count, as every part also meets itself."""
    n, part = rows["n"], rows["part"]
    mixed = (part != part[0]).any()
    ends = np.searchsorted(n, n * 100 // percent, side="right")
    for i in range(len(n) - 1):
        j = np.arange(i + 1, ends[i])
        yield i, j[part[j] != part[i]] if mixed else j


def _bands(sketch: np.ndarray) -> np.ndarray:
    return folded(sketch).reshape(len(sketch), -1, BAND_REGISTERS)


def _band_of(key: np.int64, bands: np.ndarray) -> int:
    """The band of a member's ``bands`` whose bucket is ``key``."""
    return next(b for b in np.flatnonzero(bands.any(axis=1))
                if np.uint64(xxhash.xxh64_intdigest(bands[b].tobytes(), int(b))).view(np.int64) == key)


def likeliest_within(rows: dict, percent: int) -> Iterator[dict[str, np.ndarray]]:
    """Of each set of one bucket the likeliest pair near the threshold with a set of another component, and the sets with
    such a pair that has no earlier band in common: only these need to meet here again (``a`` = ``b``, with ``key`` and ``n``).
    ``rows``: ``key``, ``s``, ``n``, ``c`` (component), ``part``, ``sketch``, ordered by ``n``."""
    s, n, c, sketch = (rows[k] for k in ("s", "n", "c", "sketch"))
    top, partner = np.full(len(s), -1.0), np.zeros(len(s), dtype=np.int64)
    bands, here = None, np.zeros(len(s), dtype=bool)
    for i, j in _others(rows, percent):
        j = j[c[j] != c[i]]
        if not len(j):
            continue
        at, e = estimate(sketch[i], sketch[j], np.full(len(j), n[i]), n[j], percent)
        if not len(at):
            continue
        k = e.argmax()
        if e[k] > top[i]:
            top[i], partner[i] = e[k], j[at[k]]
        better = e > top[j[at]]
        top[j[at[better]]], partner[j[at[better]]] = e[better], i
        if bands is None:
            bands = _bands(sketch)
            own = _band_of(rows["key"][0], bands[0])
        first = j[at[_first_common(bands, i, j[at]) == own]]
        here[first] = True
        here[i] |= len(first) > 0
    found = np.flatnonzero(top >= 0)
    if len(found):
        one, two, none = s[found], s[partner[found]], np.zeros(len(found), dtype=np.int64)
        yield {"a": np.minimum(one, two), "b": np.maximum(one, two), "key": none, "n": none, "e": top[found]}
    if here.any():
        yield {"a": s[here], "b": s[here], "key": rows["key"][here], "n": n[here], "e": np.zeros(here.sum())}


def _first_common(bands: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
    """The first band that the sets ``j`` each share with the set ``i``."""
    return ((bands[j] == bands[i]).all(axis=2) & bands[i].any(axis=1)).argmax(axis=1)


def links_within(rows: dict, percent: int, numbers: int = 1 << 20) -> Iterator[dict[str, np.ndarray]]:
    """Links that join the components of one bucket's sets: pairs near the threshold are compared in full where they
    stand, at most ``numbers`` hashes at a time, so no pair leaves a task unless it joins two components. A pair of
    several common buckets is compared in the first of its bands only. ``rows`` as in :func:`likeliest_within`, and
    ``shingles``."""
    s, n, sketch, sets = (rows[k] for k in ("s", "n", "sketch", "shingles"))
    c = rows["c"].copy()
    bands = _bands(sketch)
    own = _band_of(rows["key"][0], bands[0])
    a, b = [], []
    for i, j in _others(rows, percent):
        j = j[c[j] != c[i]]
        if not len(j):
            continue
        j = j[estimate(sketch[i], sketch[j], np.full(len(j), n[i]), n[j], percent)[0]]
        j = j[_first_common(bands, i, j) == own]
        step = max(1, numbers // int(n[j].max())) if len(j) else 1
        for some in (j[at:at + step] for at in range(0, len(j), step)):
            some = some[c[some] != c[i]]
            if not len(some):
                continue
            hashes = np.concatenate([sets[k] for k in some])
            place = np.minimum(np.searchsorted(sets[i], hashes), n[i] - 1)
            both = np.add.reduceat((sets[i][place] == hashes).astype(np.int64), np.cumsum([0, *n[some][:-1]]))
            # |a and b| / |a or b| >= p / 100 is (100 + p) * |a and b| >= p * (|a| + |b|).
            for k in some[(100 + percent) * both >= percent * (n[i] + n[some])]:
                if c[k] != c[i]:
                    c[c == c[k]] = c[i]
                    a.append(min(s[i], s[k]))
                    b.append(max(s[i], s[k]))
    if a:
        none = np.zeros(len(a), dtype=np.int64)
        yield {"a": np.asarray(a), "b": np.asarray(b), "key": none, "n": none, "e": np.ones(len(a))}


class Members(NamedTuple):
    """Members of buckets (``key``, ``s``, ``n``, ``c``) and, one row per set, what is compared (``s``, ``sketch`` and maybe ``shingles``)."""

    buckets: DataFrame
    sets: DataFrame


def bucket_pairs(members: Members, percent: int, chunk: int = 2048, numbers: int = 1 << 21) -> DataFrame:
    """Pairs ``a``, ``b`` between sets of different components that share a bucket: links (see :func:`links_within`) if the
    members have ``shingles``; without them each set's likeliest pair with its estimate ``e``, and rows with ``a`` = ``b`` for the
    sets that need to meet again in bucket ``key`` (see :func:`likeliest_within`). Buckets whose members are one component go
    nowhere; one of more than ``chunk`` members or ``numbers`` hashes is split by hash, and every two of its parts meet
    in a task of their own. Sketches and shingles join the members once their tasks are known, and travel to these only."""
    full = "shingles" in members.sets.columns
    weight = F.greatest(F.count("*") / chunk, F.sum("n") / numbers if full else F.lit(0.0))
    sizes = (members.buckets.groupBy(F.col("key").alias("k")).agg(weight.alias("w"), F.min("c").alias("low"), F.max("c").alias("high"))
             .filter("low < high").select("k", F.ceil("w").cast("int").alias("parts")))
    mixed = (members.buckets.join(sizes, F.col("key") == F.col("k"))
             .withColumn("part", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int")))
    names = ["key", "p", "q", "s", "n", "c", "part"]
    tasks = mixed.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select(
        "key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "s", "n", "c", "part")
    tasks = tasks.join(members.sets.withColumnRenamed("s", "of"), F.col("s") == F.col("of")).drop("of")
    tasks = tasks.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    look, found_names = links_within if full else likeliest_within, ("a", "b", "key", "n", "e")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[dict]:
            rest = None
            for b in batches:
                rows = {c: b.column(c).to_numpy() for c in names} | {"sketch": _sketches_of(b.column("sketch"))}
                if full:
                    rows["shingles"] = _sets_of(b.column("shingles"))
                if rest is not None:
                    rows = {c: np.concatenate([rest[c], rows[c]]) for c in rows}
                edge = np.flatnonzero(np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in ("key", "p", "q")])) + 1
                bounds = [0, *edge.tolist()]
                for i, j in zip(bounds, bounds[1:]):
                    yield {c: v[i:j] for c, v in rows.items()}
                rest = {c: v[bounds[-1]:] for c, v in rows.items()}
            if rest is not None:
                yield rest

        ready, held = [], 0
        for g in groups():
            order = np.argsort(g["n"], kind="stable")
            for found in look({c: v[order] for c, v in g.items()}, percent):
                ready.append(found)
                held += len(found["a"])
            if held > 50_000:
                yield pa.RecordBatch.from_pydict({c: np.concatenate([x[c] for x in ready]) for c in found_names})
                ready, held = [], 0
        if ready:
            yield pa.RecordBatch.from_pydict({c: np.concatenate([x[c] for x in ready]) for c in found_names})

    found = tasks.mapInArrow(met, "a long, b long, key long, n long, e double")
    return found.groupBy("a", "b", "key", "n").agg(F.max("e").alias("e"))


def _best(pairs: DataFrame) -> DataFrame:
    """Of every set's ``pairs`` (``a``, ``b``, ``e``) the likeliest."""
    ends = pairs.select("a", "b", "e").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "e"))
    top = ends.groupBy("a").agg(F.max(F.struct("e", "b")).alias("top"))
    return top.select(F.least("a", "top.b").alias("a"), F.greatest("a", "top.b").alias("b")).distinct()


def set_classes(docs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """``node``, ``component`` of the distinct sets that verified pairs join; others have no row.

    Sets meet where a band of their registers agrees: pairs at the threshold
    miss all 32 bands with a chance of 5 in 100 million, others less. No bucket
    lists its pairs: first every set meets the first set of each of its
    buckets, the likeliest of these is verified, and components are formed.
    Then only pairs of different components are estimated, and again each set's
    likeliest is verified first. Sets with such a pair are compared in full with
    the other components, inside the tasks of the buckets that are the first a pair shares: only links that
    join components leave these, so near copies just under the threshold cost no
    rows. Pairs far below the threshold by estimate are not looked at. Later links
    join the components there are; earlier links are not contracted again.
    """
    banded = rows.filter("s is not null").select("s", "n", F.explode("keys").alias("key"))
    hubs = checkpointed(banded.groupBy(F.col("key").alias("k")).agg(F.min("s").alias("hub"), F.max("s").alias("high"))
                        .filter("hub < high").select("k", "hub"))
    met = checkpointed(banded.join(lookup(hubs), F.col("key") == F.col("k")).select("key", "s", "n", "hub").distinct())
    ends = checkpointed(met.select(F.col("s").alias("end")).distinct())
    known = checkpointed(rows.join(lookup(ends), F.col("s") == F.col("end"), "left_semi")
                         .groupBy("s").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("digest").alias("d")))
    sets = checkpointed(full_sets(docs, known.select("d", F.col("s")), size))
    pairs = met.filter("s > hub").select(F.col("hub").alias("a"), F.col("s").alias("b")).distinct()
    first = checkpointed(likely_pairs(pairs, known, percent))
    classes = checkpointed(connected_components(verified(_best(first), sets, percent)))

    def apart(buckets: DataFrame) -> DataFrame:
        """Members of the buckets, named by the component that the links so far give them."""
        return (buckets.join(classes, F.col("s") == F.col("node"), "left")
                .select("key", "s", "n", F.coalesce("component", "s").alias("c")))

    rest = checkpointed(bucket_pairs(Members(apart(met), known.select("s", "sketch")), percent))
    if rest.isEmpty():
        return classes
    classes = joined_components(classes, checkpointed(verified(_best(rest.filter("a < b")), sets, percent)))
    again = rest.filter("a = b").select("key", F.col("a").alias("s"), "n")
    near = checkpointed(again.select(F.col("s").alias("near")).distinct())
    some = F.col("s") == F.col("near")
    whole = known.select("s", "sketch").join(lookup(near), some, "left_semi").join(sets.join(lookup(near), some, "left_semi"), "s")
    return joined_components(classes, checkpointed(bucket_pairs(Members(apart(again), whole), percent).select("a", "b")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_shingles``, ``component_id`` (smallest id
    reachable over pairs of at least ``percent`` % Jaccard similarity between sets of ``size``-word shingles) and
    ``kept`` (the row has its component's id).

    A-Z are lower-cased, words stand between ASCII white space; fewer words than
    ``size`` are one shingle; null, empty and blank texts have none and stay
    alone. Null ids are grouped but name no component; alone, such a row is kept
    with a null component. Repeated rows share their component and are kept or
    not alike. Other columns are not read; an empty table gives no rows.

    Texts are read twice: for the sketches, and for the full sets of those that
    share a band with another text.
    """
    rows = checkpointed(sketches(docs, size))
    classes = set_classes(docs, rows, size, percent)
    owned = rows.filter("s is not null").groupBy("s").agg(F.min("doc_id").alias("first"), F.count("*").alias("c"))
    rooted = checkpointed(owned.join(classes, F.col("s") == F.col("node"), "left")
                          .select("s", "first", "c", F.coalesce("component", "s").alias("root")))
    groups = (rooted.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"), F.sum("c").alias("rows"))
              .filter("rows > 1").select("r", "component_id"))
    shared = rooted.join(groups, F.col("root") == F.col("r")).select(F.col("s").alias("t"), "component_id")
    found = spread_lookup(rows.select("doc_id", "s", "n"), checkpointed(shared), "s", "t", "doc_id")
    component = F.when(F.col("t").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.col("doc_id").eqNullSafe(component).alias("kept"))
