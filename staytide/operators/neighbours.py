"""Exact nearest neighbours within groups, and oversampling between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed
from .ordering import with_position

# Rows per block: the largest number of queries or candidates one task call holds.
BLOCK_ROWS = 2048
# Rows handed over at once when a query is sent to many blocks.
_VISIT_ROWS = 10_000
_SLACK = 1e-9
_ROW = "_label string, _key string, _x array<double>"


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _nearest(queries: pd.DataFrame, members: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest members of each query, itself excluded."""
    members = members.sort_values("_key", kind="stable")
    q, m = np.stack(queries["_x"].to_numpy()), np.stack(members["_x"].to_numpy())
    keys = members["_key"].to_numpy()
    rough = _distances(q, m)
    rough[queries["_key"].to_numpy()[:, None] == keys[None, :]] = np.inf
    # The expanded square is fast but loses digits: shortlist with it, then
    # measure the shortlist directly.
    width = min(len(keys), 2 * k + 8)
    short = np.sort(np.argpartition(rough, width - 1, axis=1)[:, :width], axis=1)
    exact = np.sqrt(((q[:, None, :] - m[short]) ** 2).sum(2))
    exact[~np.isfinite(np.take_along_axis(rough, short, 1))] = np.inf
    order = np.argsort(exact, axis=1, kind="stable")[:, :k]
    near, dist = np.take_along_axis(short, order, 1), np.take_along_axis(exact, order, 1)
    out = pd.DataFrame({"_key": np.repeat(queries["_key"].to_numpy(), near.shape[1]),
                        "_near": keys[near.ravel()], "_dist": dist.ravel()})
    return out[np.isfinite(out["_dist"])]


class _Cells:
    """Landmarks per label with the extent and block count of their cells.

    Holds at most ``max_landmarks`` points per label; sent with the task.
    """

    def __init__(self, landmarks: list) -> None:
        self.points: dict[str, np.ndarray] = {}
        for label in sorted({r["_label"] for r in landmarks}):
            self.points[label] = np.array([r["_x"] for r in landmarks if r["_label"] == label])
        self.low = {k: np.full(len(p), np.inf) for k, p in self.points.items()}
        self.high = {k: np.full(len(p), -np.inf) for k, p in self.points.items()}
        self.blocks = {k: np.zeros(len(p), dtype=int) for k, p in self.points.items()}

    def measure(self, stats: list, block_rows: int) -> None:
        for r in stats:
            self.low[r["_label"]][r["_cell"]] = r["low"]
            self.high[r["_label"]][r["_cell"]] = r["high"]
            self.blocks[r["_label"]][r["_cell"]] = -(-r["n"] // block_rows)

    def assign(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Nearest landmark of each row and the distance to it."""
        for batch in batches:
            for label, rows in batch.groupby("_label"):
                d = _distances(np.stack(rows["_x"].to_numpy()), self.points[label])
                cell = d.argmin(1)
                yield rows.assign(_cell=cell, _d=d[np.arange(len(rows)), cell])

    def visits(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells that may hold a row closer than the row's bound ``_bound``.

        A cell is left out only if the triangle inequality, with its nearest
        and farthest member or with the plane between two landmarks, proves
        that it cannot.
        """
        for batch in batches:
            for label, rows in batch.groupby("_label"):
                bounds, rows = rows["_bound"].to_numpy(), rows.drop(columns="_bound")
                # A row goes to every block at most, so few rows are looked at together where there are many blocks.
                step = max(1, _VISIT_ROWS // max(1, int(self.blocks[label].sum())))
                for at in range(0, len(rows), step):
                    yield from self._sent(label, rows.iloc[at:at + step], bounds[at:at + step, None])

    def _sent(self, label: str, rows: pd.DataFrame, bound: np.ndarray) -> Iterator[pd.DataFrame]:
        d = _distances(np.stack(rows["_x"].to_numpy()), self.points[label])
        own = d[np.arange(len(rows)), rows["_cell"].to_numpy()][:, None]
        gap = np.maximum.reduce([d - self.high[label], self.low[label] - d, (d - own) / 2])
        row, cell = np.nonzero((gap <= bound * (1 + _SLACK) + _SLACK) & (self.blocks[label] > 0))
        count = self.blocks[label][cell]
        row, cell = np.repeat(row, count), np.repeat(cell, count)
        block = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        for start in range(0, len(row), _VISIT_ROWS):
            part = slice(start, start + _VISIT_ROWS)
            yield rows.iloc[row[part]].assign(_to_cell=cell[part], _to_block=block[part])


def nearest_neighbours(df: DataFrame, key: str, label: str, vector: str, k: int,
                       max_landmarks: int = 256, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest rows with the same label, exact: ``_key, _near, _dist``.

    Rows are grouped by their nearest landmark and large cells cut into
    blocks of bounded size. The k-th distance inside a row's own block bounds
    its search; only blocks of cells that may beat the bound are searched,
    one block against one block per task call, which keeps k rows per query.
    No list of pairs is built and no group outgrows a task.
    """
    rows = checkpointed(df.select(F.col(label).cast("string").alias("_label"),
                                  F.col(key).cast("string").alias("_key"),
                                  F.col(vector).cast("array<double>").alias("_x")))
    # One landmark per block of rows, up to a fixed number per label.
    sizes = rows.groupBy("_label").agg(
        F.least(F.ceil(F.count(F.lit(1)) / block_rows), F.lit(max_landmarks)).alias("_wanted"))
    ranked = rows.withColumn("_rn", F.row_number().over(
        Window.partitionBy("_label").orderBy(F.md5("_key"), "_key")))
    landmarks = ranked.where(F.col("_rn") <= max_landmarks).join(sizes, "_label")
    cells = _Cells(landmarks.where(F.col("_rn") <= F.col("_wanted")).select("_label", "_x").collect())
    assigned = rows.mapInPandas(cells.assign, _ROW + ", _cell int, _d double")
    stats = assigned.groupBy("_label", "_cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("_d").alias("low"), F.max("_d").alias("high"))
    stats = checkpointed(stats)
    cells.measure(stats.collect(), block_rows)

    block = F.pmod(F.xxhash64("_key"), F.ceil(F.col("n") / block_rows)).cast("int")
    placed = assigned.join(F.broadcast(stats), ["_label", "_cell"]).select(
        "_label", "_key", "_x", "_cell", block.alias("_block"))

    def bound(group: pd.DataFrame) -> pd.DataFrame:
        found = _nearest(group, group, k).groupby("_key")["_dist"].agg(["max", "size"])
        worst = found["max"].where(found["size"] == k, np.inf)
        return group.assign(_bound=group["_key"].map(worst).fillna(np.inf))

    bounded = checkpointed(placed.groupBy("_label", "_cell", "_block").applyInPandas(
        bound, _ROW + ", _cell int, _block int, _bound double"))
    queries = bounded.mapInPandas(
        cells.visits, _ROW + ", _cell int, _block int, _to_cell int, _to_block int")
    pair = ["_label", "_cell", "_block", "_to_cell", "_to_block"]
    pairs = queries.select(*[F.col(c).alias(c) for c in pair]).distinct()
    members = bounded.select("_label", "_key", "_x", F.col("_cell").alias("_to_cell"),
                            F.col("_block").alias("_to_block")).join(
        pairs, ["_label", "_to_cell", "_to_block"])

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _nearest(left, right, k)

    found = queries.groupBy(*pair).cogroup(members.groupBy(*pair)).applyInPandas(
        search, "_key string, _near string, _dist double")
    best = F.row_number().over(Window.partitionBy("_key").orderBy("_dist", "_near"))
    return found.withColumn("_rn", best).where(F.col("_rn") <= k).drop("_rn")


def smote(df: DataFrame, key: str, label: str, columns: list[str], k: int = 5,
          seed: int = 0) -> DataFrame:
    """Grows every class to the size of the largest with points between a row
    and one of its k nearest rows of the class.

    Base rows take turns; neighbour and position on the segment come from the
    first 52 bits of ``md5(seed:use:row:turn)``, so a repeated task gives the
    same points, and any engine can draw them again. The
    row of a class of one has no neighbour and is repeated. Output: ``columns``, label and
    ``is_synthetic``.
    """
    rows = checkpointed(df.select(F.col(key).cast("string").alias("_key"), label, *columns))
    classes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    classes = classes.join(F.broadcast(classes.agg(F.max("_n").alias("_max"))))
    growing = classes.where(F.col("_n") < F.col("_max")).select(
        label, (F.col("_max") - F.col("_n")).alias("_need"))
    small = rows.join(growing, label)
    near = nearest_neighbours(
        small.select("_key", label, F.array(*[F.col(c).cast("double") for c in columns]).alias("_x")),
        "_key", label, "_x", k).groupBy("_key").agg(F.sort_array(F.collect_list("_near")).alias("_nears"))

    # Turns of one base row in parts, so that a tiny class spreads over tasks.
    part = 10_000
    turns = (F.floor(F.col("_need") / F.col("_n"))
             + F.when(F.col("_pos") <= F.col("_need") % F.col("_n"), 1).otherwise(0))
    base = (with_position(small, "_key", seed, [label]).withColumn("_turns", turns)
            .where(F.col("_turns") > 0).join(near, "_key", "left")
            .withColumn("_nears", F.coalesce("_nears", F.array("_key")))
            .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"),
                                                      F.floor((F.col("_turns") - 1) / part))))
            .repartition("_key", "_part")
            .withColumn("_turn", F.explode(F.sequence(
                F.col("_part") * part, F.least((F.col("_part") + 1) * part, F.col("_turns")) - 1))))

    def draw(use: str) -> Column:
        name = F.concat_ws(":", F.lit(f"{seed}:{use}"), "_key", F.col("_turn").cast("string"))
        return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")

    unit = draw("gap") / F.lit(float(1 << 52))
    picked = base.select(
        label, *columns, unit.alias("_gap"),
        F.element_at("_nears", F.pmod(draw("pick"), F.size("_nears")).cast("int") + 1).alias("_near"))
    other = small.select(F.col("_key").alias("_near"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    between = picked.join(other, "_near").select(
        label, *[(F.col(c) + F.col("_gap") * (F.col(f"_o_{c}") - F.col(c))).alias(c) for c in columns],
        F.lit(True).alias("is_synthetic"))
    original = rows.select(label, *[F.col(c).cast("double").alias(c) for c in columns],
                           F.lit(False).alias("is_synthetic"))
    return original.unionByName(between)
