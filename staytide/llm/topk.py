"""Exact top-k inner products with block-at-a-time pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staytide.sources.tables import checkpointed

#: Rows of a block, of a shard (the blocks a task works on) and of a query group.
BLOCK, SHARD, GROUP = 256, 32_768, 1_024
#: Rows in the bounded samples: references that order the rows, and seeds of the first thresholds.
REFERENCES, SEEDS = 64, 2_048


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id`` and ``terms``, floor(scale * x) of every component. Rows without an id, null vectors and vectors
    with a null or non-finite component are left out; equal rows are one, and a repeated id keeps all its vectors."""
    x = F.col("embedding")
    whole = ~F.coalesce(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf"))), F.lit(False))
    terms = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("bigint"))
    return (vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & whole)
            .select(F.col("vec_id").cast("bigint").alias("vec_id"), terms.alias("terms")).distinct())


def _matrix(lists: pa.Array | pd.Series, width: int) -> np.ndarray:
    """Rows of integer lists, shorter ones filled with zeros."""
    out = np.zeros((len(lists), width), dtype=np.int64)
    for i, row in enumerate(lists.to_pylist() if isinstance(lists, pa.Array) else lists):
        out[i, :len(row)] = row
    return out


def _blocks(rows: DataFrame, width: int, references: np.ndarray, n_shards: int) -> DataFrame:
    """Forward index: one row per block with its ids, its terms and the greatest
    and smallest value of each term. Rows are put near rows with the same best
    reference, so that the bounds of a block are narrow."""
    def homed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = (_matrix(b.column("terms"), width).astype(float) @ references.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("terms"), pa.array(near.astype(np.int32))],
                                             ["vec_id", "terms", "home"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, terms = b.column("vec_id").to_numpy(), _matrix(b.column("terms"), width)
            out = []
            for i in range(0, len(ids), BLOCK):
                t = terms[i:i + BLOCK]
                out.append((ids[i:i + BLOCK].tobytes(), t.tobytes(), t.max(axis=0).tobytes(), t.min(axis=0).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], ["ids", "terms", "top", "low"])

    homed_rows = rows.mapInArrow(homed, "vec_id long, terms array<long>, home int")
    ranged = homed_rows.repartitionByRange(n_shards, "home", "vec_id").sortWithinPartitions("home", "vec_id")
    return (ranged.mapInArrow(cut, "ids binary, terms binary, top binary, low binary")
            .withColumns({"shard": F.spark_partition_id(), "block": F.monotonically_increasing_id()}))


class _Best:
    """The k best of one query so far, an id once: score descending, id ascending."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor = k, floor
        self.scores, self.ids = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))
        _, first = np.unique(ids[order], return_index=True)
        order = order[np.sort(first)][:self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.floor = max(self.floor, self.scores[-1])


def search_blocks(query_ids: np.ndarray, queries: np.ndarray, blocks: list[tuple[np.ndarray, ...]], floors: np.ndarray,
                  k: int) -> list[_Best]:
    """The k best rows of ``blocks`` (ids, terms, top, low) for every query.

    A query's bound for a block sums, over its terms, the larger product with
    the block's extremes. Each query takes its blocks in falling order of the
    bound and ends at the first below its k-th score; equal bounds still count,
    as an equal score may win by its id.
    """
    tops, lows = np.stack([b[2] for b in blocks]), np.stack([b[3] for b in blocks])
    q = queries.astype(float)
    bounds = _bounds(q, tops, lows)
    order = np.argsort(-bounds, axis=1, kind="stable")
    best = [_Best(k, f) for f in floors]
    live = np.arange(len(query_ids))
    for turn in range(len(blocks)):
        at = order[live, turn]
        live = live[bounds[live, at] >= np.asarray([best[i].floor for i in live])] if len(live) else live
        if not len(live):
            break
        at = order[live, turn]
        for b in np.unique(at):
            asking = live[at == b]
            ids, terms = blocks[b][0], blocks[b][1]
            scores = (q[asking] @ terms.T.astype(float)).astype(np.int64)
            for i, row in zip(asking, scores):
                keep = (row >= best[i].floor) & (ids != query_ids[i])
                if keep.any():
                    best[i].add(row[keep], ids[keep])
    return best


def _bounds(q: np.ndarray, tops: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """For every query and block the sum, over the terms, of the larger product with the block's extremes."""
    return np.maximum(q, 0) @ tops.T.astype(float) + np.minimum(q, 0) @ lows.T.astype(float)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each id of ``vectors``
    (``vec_id``, ``embedding``) under ``is_query``, the k other ids with the
    greatest integer inner product, ties to the smaller id.

    Rows are cut into blocks, written once; a shard is what one writing task
    held, as the written table says. Queries in groups meet the blocks' extremes
    first: a group gets a block only if one of its queries may find a row there
    that beats its threshold, which a bounded sample of rows gives. A group and
    the blocks it gets of a shard are a task of their own, which prunes by block
    bounds as thresholds rise and hands on k rows per query. Vectors shorter
    than the longest count as filled with zeros. Sums are exact below 2**53.
    Rows that :func:`quantised` leaves out are neither query nor candidate; of
    an id with several vectors, asking or asked, the best score counts; fewer
    than k candidates are all returned; an empty table gives no rows.
    """
    rows = checkpointed(quantised(vectors))
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("terms")), F.lit(0))).first()
    schema = "query_id long, vec_id long, score long"
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    drawn = {r[0]: r[1] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "terms").limit(SEEDS).collect()}
    seed_ids = np.asarray(list(drawn), dtype=np.int64)
    seeds = _matrix(pd.Series(list(drawn.values())), width)
    blocks = checkpointed(_blocks(rows, width, seeds[:REFERENCES].astype(float), max(1, -(-n // SHARD))))
    asked = rows.filter(is_query)
    n_groups, n_shards = max(1, -(-asked.count() // GROUP)), 1 + blocks.agg(F.max("shard")).first()[0]
    queries = asked.select("vec_id", "terms", F.pmod(F.xxhash64("vec_id"), F.lit(n_groups)).cast("int").alias("group"),
                           F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
    extremes = blocks.select("shard", "block", "top", "low", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("group"))

    def floors(ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The k-th best score among the sample, for every query."""
        first = q.astype(float) @ seeds.T.astype(float)
        first[ids[:, None] == seed_ids[None, :]] = -np.inf
        return np.partition(first, -k, axis=1)[:, -k] if len(seed_ids) >= k else np.full(len(ids), -np.inf)

    def choose(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.empty(0, dtype=np.int64) for c in ("group", "chosen")})
        ids, q = left["vec_id"].to_numpy(), _matrix(left["terms"], width)
        tops, lows = (np.stack([np.frombuffer(x, np.int64) for x in right[c]]) for c in ("top", "low"))
        wanted = (_bounds(q.astype(float), tops, lows) >= floors(ids, q)[:, None]).any(axis=0)
        return pd.DataFrame({"group": left["group"].iloc[0], "chosen": right["block"].to_numpy()[wanted]})

    chosen = checkpointed(queries.groupBy("group", "shard").cogroup(extremes.groupBy("group", "shard")).applyInPandas(choose, "group int, chosen long"))
    index = blocks.join(chosen, F.col("block") == F.col("chosen")).drop("block", "chosen")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.empty(0, dtype=np.int64) for c in ("query_id", "vec_id", "score")})
        parts = [(np.frombuffer(i, np.int64), np.frombuffer(t, np.int64).reshape(-1, width), np.frombuffer(hi, np.int64),
                  np.frombuffer(lo, np.int64)) for i, t, hi, lo in zip(right["ids"], right["terms"], right["top"], right["low"])]
        ids, q = left["vec_id"].to_numpy(), _matrix(left["terms"], width)
        found = search_blocks(ids, q, parts, floors(ids, q), k)
        return pd.DataFrame({"query_id": np.repeat(ids, [len(f.ids) for f in found]),
                             "vec_id": np.concatenate([f.ids for f in found]), "score": np.concatenate([f.scores for f in found])})

    found = queries.groupBy("group", "shard").cogroup(index.groupBy("group", "shard")).applyInPandas(search, schema)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


#: DuckDB: every pair, ranked.
SQL = """
with v as (select row_number() over (order by vec_id, t) as r, vec_id, t from (select distinct vec_id,
    list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as t from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)),
c as (select r, vec_id, unnest(t) as x, generate_subscripts(t, 1) as d from v),
q as (select * from c where vec_id % 20 = 0),
p as (select q.vec_id as query_id, c.vec_id, sum(q.x * c.x)::bigint as score from q join c on q.d = c.d and q.vec_id <> c.vec_id
  group by q.r, c.r, q.vec_id, c.vec_id),
s as (select query_id, vec_id, max(score) as score from p group by query_id, vec_id)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from s qualify rank <= 20
"""
