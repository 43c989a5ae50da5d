"""Fitting a fully connected network: gradients in tasks, L-BFGS over their sums on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.tables import checkpoint_folder

# Rows multiplied at once: a task's memory does not grow with its part, and a layer's outputs stay in the cache.
CHUNK_ROWS = 256
# Gradients the driver adds up itself; more parts are added in tasks first.
_SUMS = 32
# Steps remembered, steps whose best loss counts for stopping, trials of a line search, and the two Wolfe constants.
_MEMORY, _LOOK_BACK, _TRIALS, _DECREASE, _CURVATURE = 10, 20, 10, 1e-4, 0.9

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


def layer_views(weights: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix (inputs x outputs) and bias of every layer inside one flat vector."""
    views, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        views.append((weights[at:at + a * b].reshape(a, b), weights[at + a * b:at + a * b + b]))
        at += a * b + b
    return views


def layer_outputs(layers: list, x: np.ndarray) -> list[np.ndarray]:
    """``x`` and the outputs of every layer; hidden units are sigmoid, the last layer's are the inputs of a softmax."""
    outputs = [x]
    for i, (matrix, bias) in enumerate(layers):
        z = outputs[-1] @ matrix
        z += bias
        if i < len(layers) - 1:
            with np.errstate(over="ignore"):
                np.exp(np.negative(z, z), z)
            z += 1
            np.reciprocal(z, z)
        outputs.append(z)
    return outputs


def add_gradient(layers: list, sums: list, x: np.ndarray, y: np.ndarray) -> float:
    """Cross entropy of the rows ``x`` with classes ``y``, summed; their gradient is added to ``sums``."""
    outputs = layer_outputs(layers, x)
    z, rows = outputs.pop(), np.arange(len(y))
    z -= z.max(1, keepdims=True)
    chosen = z[rows, y]
    np.exp(z, z)
    total = z.sum(1)
    z /= total[:, None]
    z[rows, y] -= 1
    delta = z
    for i in reversed(range(len(layers))):
        matrix, bias = sums[i]
        matrix += outputs[i].T @ delta
        bias += delta.sum(0)
        if i:
            h = outputs[i]
            delta = delta @ layers[i][0].T
            delta *= h
            delta *= np.subtract(1, h, h)
    return float((np.log(total) - chosen).sum())


def packed_rows(df: DataFrame, features: str, label: str, classes: int) -> RDD:
    """(inputs, classes) of up to ``CHUNK_ROWS`` rows each, as bytes, in the parts of ``df``."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            if not len(y):
                continue
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            if not (np.isfinite(x).all() and np.isin(y, np.arange(classes)).all()):
                raise ValueError(f"a label outside 0..{classes - 1}, or an input that is no finite number")
            for at in range(0, len(y), CHUNK_ROWS):
                part = slice(at, at + CHUNK_ROWS)
                yield pa.record_batch({"x": pa.array([x[part].tobytes()], pa.binary()),
                                       "y": pa.array([y[part].astype(np.int64).tobytes()], pa.binary())})

    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    return rows.mapInArrow(pack, "x binary, y binary").rdd


def _added(results: RDD) -> tuple[float, int, np.ndarray]:
    """Loss, rows and gradient over all parts, always added in the same order."""
    def add(parts: Iterator) -> tuple[float, int, np.ndarray]:
        loss, n, total = next(parts)
        for more, rows, gradient in parts:
            loss, n = loss + more, n + rows
            total += gradient
        return loss, n, total

    while (parts := results.getNumPartitions()) > _SUMS:
        keyed = results.mapPartitionsWithIndex(lambda i, part: ((i // _SUMS, (i, r)) for r in part))
        results = keyed.groupByKey(-(-parts // _SUMS), lambda k: k).map(
            lambda group: add(r for _, r in sorted(group[1], key=lambda x: x[0])))
    return add(iter(results.collect()))


def mean_loss(rows: RDD, sizes: Sequence[int]) -> Objective:
    """Mean cross entropy over all rows of :func:`packed_rows` and its gradient, one Spark job a call."""
    context = rows.context

    def objective(weights: np.ndarray) -> tuple[float, np.ndarray]:
        sent = context.broadcast(weights)

        def part(chunks: Iterator) -> Iterator[tuple[float, int, np.ndarray]]:
            layers, total, loss, n = layer_views(sent.value, sizes), np.zeros(len(sent.value)), 0.0, 0
            sums = layer_views(total, sizes)
            for x, y in chunks:
                y = np.frombuffer(y, np.int64)
                loss, n = loss + add_gradient(layers, sums, np.frombuffer(x).reshape(len(y), -1), y), n + len(y)
            yield loss, n, total

        try:
            loss, n, total = _added(rows.mapPartitions(part, preservesPartitioning=True))
        finally:
            sent.destroy()
        if not n:
            raise ValueError("no row to fit on")
        total /= n
        return loss / n, total

    return objective


class _NoStep(Exception):
    """No step along the direction lowers the loss enough."""


def _line_search(at: Callable[[float], tuple], first: float, start: tuple) -> tuple:
    """The first point tried that meets the strong Wolfe conditions; a point is (step, loss, slope, ...)."""
    _, loss, slope = start[:3]
    if slope > 0:
        raise _NoStep("the direction ascends")

    def too_high(c: tuple) -> bool:
        return c[1] > loss + _DECREASE * c[0] * slope

    def between(a: tuple, b: tuple) -> float:
        a, b = sorted((a, b), key=lambda c: c[0])
        width = b[0] - a[0]
        d1 = a[2] + b[2] - 3 * (a[1] - b[1]) / (a[0] - b[0])
        with np.errstate(all="ignore"):
            d2 = np.sqrt(np.float64(d1 * d1 - a[2] * b[2]))
            t = b[0] - width * (b[2] + d2 - d1) / (b[2] - a[2] + 2 * d2)
        low, high = a[0] + 0.1 * width, a[0] + 0.9 * width
        return low if t < low else high if t > high else float(t)

    def zoom(low: tuple, high: tuple) -> tuple:
        for _ in range(_TRIALS):
            c = at(between(low, high))
            if too_high(c) or c[1] >= low[1]:
                high = c[:3]
                continue
            if abs(c[2]) <= _CURVATURE * abs(slope):
                return c
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c[:3]
        raise _NoStep("zoom")

    step, low = first, start[:3]
    for i in range(_TRIALS):
        c = at(step)
        if not np.isfinite(c[1]):
            step /= 2
            continue
        if too_high(c) or (c[1] >= low[1] and i > 0):
            return zoom(low, c[:3])
        if abs(c[2]) <= _CURVATURE * abs(slope):
            return c
        if c[2] >= 0:
            return zoom(c[:3], low)
        low, step = c[:3], step * 1.5
    raise _NoStep("line search")


def _direction(gradient: np.ndarray, history: list) -> np.ndarray:
    """Minus the gradient times the inverse Hessian that the last steps suggest."""
    d, used, scaled = gradient.copy(), [], np.empty_like(gradient)
    for s, y in history:
        rho = s @ y
        factor = (s @ d) / rho if rho else np.nan
        if np.isnan(factor):
            raise _NoStep("history")
        used.append((rho, factor))
        d -= np.multiply(y, factor, scaled)
    if history:
        s, y = history[0]
        if s @ y < 0:
            raise _NoStep("history")
        d *= (s @ y) / (y @ y)
    for (s, y), (rho, factor) in zip(reversed(history), reversed(used)):
        d += np.multiply(s, factor - (y @ d) / rho, scaled)
    return np.negative(d, d)


def minimise(objective: Objective, weights: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, list[float]]:
    """L-BFGS by the rules of Spark's own: the weights, and the loss at the start and after each round.

    Ends after ``max_iter`` rounds, when the loss is within ``tol`` times the first loss of the
    worst of the last 20 rounds, when the gradient's norm is below ``tol`` times the loss, or
    when two searches in turn find no step, the second one from a fresh history.
    """
    loss, gradient = objective(weights)
    losses, history, failed = [loss], [], False

    def ended() -> bool:
        recent = losses[-_LOOK_BACK:]
        flat = len(losses) > _LOOK_BACK and abs(loss - max(recent)) <= tol * losses[0]
        return len(losses) > max_iter or flat or np.linalg.norm(gradient) <= max(tol * loss, 1e-8)

    while not ended():
        try:
            direction = _direction(gradient, history)

            def at(step: float) -> tuple:
                x = weights + step * direction
                value, slopes = objective(x)
                return step, value, slopes @ direction, x, slopes

            first = 1.0 if len(losses) > 1 else 1.0 / np.linalg.norm(direction)
            step, value, _, x, slopes = _line_search(at, first, (0.0, loss, gradient @ direction))
            if step * np.linalg.norm(gradient) < 1e-10:
                raise _NoStep("step")
        except _NoStep:
            if failed:
                break
            failed, history = True, []
            continue
        history = [(x - weights, slopes - gradient), *history[:_MEMORY - 1]]
        weights, loss, gradient, failed = x, value, slopes, False
        losses.append(loss)
    return weights, losses


def fit_network(df: DataFrame, features: str, label: str, sizes: Sequence[int], weights: np.ndarray, max_iter: int,
                tol: float) -> tuple[np.ndarray, list[float]]:
    """The weights that :func:`minimise` reaches from ``weights`` for the mean loss over all rows of ``df``.

    ``sizes`` are inputs, hidden units and classes. Rows stay in the executors, packed once; a
    call of the loss sends the weights there and adds up one gradient per part of ``df``.
    """
    checkpoint_folder(df.sparkSession)
    rows = packed_rows(df, features, label, sizes[-1]).persist(StorageLevel.MEMORY_AND_DISK)
    rows.checkpoint()  # every task of every round would else be sent the whole plan that made the rows
    try:
        return minimise(mean_loss(rows, sizes), weights, max_iter, tol)
    finally:
        rows.unpersist()


def predicted_classes(df: DataFrame, features: str, kept: Sequence[str], sizes: Sequence[int], weights: np.ndarray) -> DataFrame:
    """The columns ``kept`` and ``predicted``, the class with the highest output, of every row.

    Rows are multiplied ``CHUNK_ROWS`` at once; one by one, each would read all weights.
    """
    sent = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers = layer_views(sent.value, sizes)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, sizes[0])
            best = np.zeros(len(x), dtype=np.int32)
            for at in range(0, len(x), CHUNK_ROWS):
                part = slice(at, at + CHUNK_ROWS)
                best[part] = layer_outputs(layers, x[part])[-1].argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(best)], [*kept, "predicted"])

    fields = [*df.select(*kept).schema.fields, StructField("predicted", IntegerType())]
    return df.select(vector_to_array(features).alias("_x"), *kept).mapInArrow(run, StructType(fields))
