"""SimHash near-duplicates: pivot distance tables over candidate buckets, then components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staytide.llm.components import connected_components
from staytide.llm.text import in_slices, kept_rows, lookup, spread_lookup
from staytide.sources.tables import checkpointed

#: Five blocks of the 64 bits: two fingerprints with at most three differing bits agree on two blocks at least.
_BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
MAX_BITS = 3


def references(pivots: int) -> np.ndarray:
    """The reference fingerprints, drawn with a fixed seed."""
    return np.random.default_rng(7).integers(0, 1 << 64, size=pivots, dtype=np.uint64)


def pivot_table(fingerprints: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint to the reference fingerprints."""
    return np.bitwise_count(fingerprints[:, None] ^ marks[None, :]).astype(np.int16)


def fingerprint(text: bytes, size: int = 3) -> int:
    """64 bits of the word shingles' XXH64 hashes, each bit by majority; words are runs between ASCII white space."""
    w = text.lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(size)))) if len(w) >= size else [b" ".join(w)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[i:i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id``, ``digest`` of the text and ``fp`` (as a signed long) of every row; null texts count as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.md5(text.cast("binary")).alias("digest"), text.cast("binary").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, size) for texts in in_slices(b.column("text")) for t in texts), dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(fps.view(np.int64))],
                                             ["doc_id", "digest", "fp"])

    return rows.mapInArrow(hashed, f"doc_id {dict(rows.dtypes)['doc_id']}, digest string, fp long")


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the classes of a[i] and b[i]; labels point at the smallest row of a class."""
    while True:
        ra, rb = label[a], label[b]
        open_ = ra != rb
        if not open_.any():
            return label
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(label, shorter := label[label]):
            label = shorter


def bucket_links(group: np.ndarray, fps: np.ndarray, table: np.ndarray, max_bits: int) -> np.ndarray:
    """Smallest linked row for every row, within rows of one ``group``.

    Rows come sorted by group and first pivot distance. Row i meets i+1, i+2, ...
    until the group ends or the first coordinate differs by more than
    ``max_bits``; a pair is dropped if any coordinate does, as Hamming distances
    obey the triangle inequality, and the survivors are compared bit by bit.
    Only a forest of the links is kept, so nothing grows with the pairs.
    """
    label, alive, shift = np.arange(len(fps)), np.arange(len(fps)), 1
    while True:
        alive = alive[alive + shift < len(fps)]
        near = (group[alive] == group[alive + shift]) & (table[alive + shift, 0] - table[alive, 0] <= max_bits)
        alive = alive[near]
        if not len(alive):
            return label
        a = alive[label[alive] != label[alive + shift]]
        a = a[(np.abs(table[a] - table[a + shift]) <= max_bits).all(axis=1)]
        a = a[np.bitwise_count(fps[a] ^ fps[a + shift]) <= max_bits]
        if len(a):
            label = _merge(label, a, a + shift)
        shift += 1


def fingerprint_links(distinct: DataFrame, pivots: int = 16, chunk: int = 4096) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints (column ``fp``) that
    connect exactly those reachable over pairs of at most three differing bits.

    Ten keys of two blocks each bring every such pair into a common bucket.
    Buckets with one member go nowhere; a bucket of more than ``chunk`` members
    is split by hash, and every two of its parts meet in a task of their own, so
    that no task holds more than two parts.
    """
    marks = references(pivots)
    block = [f"(shiftrightunsigned(fp, {at}) & {(1 << width) - 1}L)" for at, width in _BLOCKS]
    keys = [F.expr(f"{k << 26}L | shiftleft({block[i]}, 13) | {block[j]}")
            for k, (i, j) in enumerate(combinations(range(len(_BLOCKS)), 2))]
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n")).filter("n > 1")
    shared = keyed.join(sizes, F.col("key") == F.col("k")).select("key", "fp", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tasks = (shared.withColumns({"part": part, "other": F.explode(F.expr("sequence(0, parts - 1)"))})
             .select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "fp"))
    tasks = tasks.withColumn("near", F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(marks[:1].view(np.int64)[0])))))
    tasks = tasks.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "near", "fp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
            same = np.ones(len(rows["fp"]), dtype=bool)
            same[1:] = np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in ("key", "p", "q")])
            fps = rows["fp"].view(np.uint64)
            label = bucket_links(np.cumsum(same), fps, pivot_table(fps, marks), MAX_BITS)
            tied = label != np.arange(len(label))
            return pa.RecordBatch.from_arrays([pa.array(rows["fp"][tied]), pa.array(rows["fp"][label[tied]])], ["a", "b"])

        names, rest = ("key", "p", "q", "fp"), None
        for batch in batches:
            rows = {c: batch.column(c).to_numpy() for c in names}
            if rest is not None:
                rows = {c: np.concatenate([rest[c], rows[c]]) for c in names}
            last = np.logical_and.reduce([rows[c] == rows[c][-1] for c in ("key", "p", "q")])
            cut = len(last) - int(last[::-1].argmin()) if not last.all() else 0
            rest = {c: v[cut:] for c, v in rows.items()}
            if cut:
                yield edges({c: np.ascontiguousarray(v[:cut]) for c, v in rows.items()})
        if rest is not None:
            yield edges({c: np.ascontiguousarray(v) for c, v in rest.items()})

    return tasks.mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id``,
    ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable over
    links of at most three differing bits), ``root``, a fingerprint that names
    the component also where no document of it has an id, and the text's digest.

    A-Z are lower-cased; shingles are ``size`` words, repeats included; a
    shorter text is one shingle; null, empty and blank texts have fingerprint
    zero and link like any other. Null ids are grouped but never a component's
    id. Repeated rows share their component. Other columns are not read.
    """
    rows = checkpointed(fingerprints(docs, size))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    classes = checkpointed(connected_components(fingerprint_links(distinct.select("fp"))))
    rooted = (distinct.join(classes, F.col("fp") == F.col("node"), "left")
              .select("fp", "first", F.coalesce("component", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select(F.col("fp").alias("f"), "component_id", "root")
    return (spread_lookup(rows, named, "fp", "f", "doc_id")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "digest"))


def keep_one(docs: DataFrame, size: int = 3) -> DataFrame:
    """One row of ``docs`` per component of :func:`near_duplicates`, with all
    its columns: that with the smallest id (a null id comes last), of equal ids
    that with the smallest digest, of rows equal in both any one."""
    found = checkpointed(near_duplicates(docs, size))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("digest").alias("d"))
    kept = checkpointed(found.groupBy("root").agg(F.min(rank).alias("r")).select("r.id", "r.d"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d"))
    repeated = checkpointed(found.join(kept, same, "left_semi").groupBy("doc_id", "digest").count().filter("count > 1")
                            .select(F.col("doc_id").alias("id"), F.col("digest").alias("d")))
    dropped = checkpointed(found.join(kept, same, "left_anti").select(F.col("doc_id").alias("id"), F.col("digest").alias("d")).distinct())
    rows = kept_rows(docs).withColumns({
        "doc_id": F.col("doc.doc_id"),
        "digest": F.md5(F.coalesce(F.col("doc.text").cast("string"), F.lit("")).cast("binary"))})
    rows = rows.join(lookup(dropped), same, "left_anti")
    if not repeated.isEmpty():
        once = (rows.join(repeated, same, "left_semi").groupBy("doc_id", "digest").agg(F.first("doc").alias("doc")))
        rows = rows.join(repeated, same, "left_anti").select("doc").unionByName(once.select("doc"))
    return rows.select("doc.*")
