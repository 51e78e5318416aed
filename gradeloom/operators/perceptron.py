"""Full-batch training of a multilayer perceptron: numpy's matrix products in the tasks, L-BFGS on the driver.

The net is that of Spark's classifier: sigmoid layers, softmax, mean cross-entropy, weights in the same order, so its model can be made from
them. Each evaluation sends the weights to the tasks and sums one gradient a task; rows stay where they are stored. Spark's own trainer
does the same with the JVM's matrix products, which are slower. Products are single precision, sums over rows are double.

Task functions are sent to the executors with their code.
"""

from __future__ import annotations

import math
import sys
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, functions as F

register_pickle_by_value(sys.modules[__name__])

#: Rows that are multiplied at once: their activations stay in a core's cache.
BLOCK = 512
#: Tasks whose gradients the driver sums itself; those of more are summed in groups first.
FEW_TASKS = 64
#: Rows a core from which faster products outweigh what sending weights to Python workers costs; Spark's own trainer takes fewer.
LEAST_ROWS = 4096
#: Errors below this count as none: products of still smaller ones are not normal numbers, which processors multiply many times slower.
LEAST = 1e-18
#: Evaluations along one direction.
MOST_STEPS = 20


def worth(rows: DataFrame) -> bool:
    """Whether there are enough rows to be trained on here."""
    return rows.count() >= LEAST_ROWS * rows.sparkSession.sparkContext.defaultParallelism


def start(layers: list[int], seed: int) -> np.ndarray:
    """Random weights, uniform and smaller the more inputs a layer has, as Spark's classifier draws them."""
    draw = np.random.default_rng(seed)
    return np.concatenate([draw.uniform(-2.4, 2.4, (n + 1) * m) / n for n, m in zip(layers, layers[1:])])


def _views(layers: list[int], flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(inputs x outputs, bias) of every layer, as views."""
    out, at = [], 0
    for n, m in zip(layers, layers[1:]):
        out.append((flat[at : at + n * m].reshape(n, m), flat[at + n * m : at + (n + 1) * m]))
        at += (n + 1) * m
    return out


def _activations(parts: list, x: np.ndarray) -> list[np.ndarray]:
    """The inputs, every hidden layer's output and the last layer's raw one."""
    out = [x]
    for k, (weights, bias) in enumerate(parts):
        z = out[-1] @ weights
        z += bias
        if k < len(parts) - 1:  # the sigmoid, by a function that cannot overflow
            z *= 0.5
            np.tanh(z, out=z)
            z += 1
            z *= 0.5
        out.append(z)
    return out


def add_gradient(layers: list[int], weights: np.ndarray, x: np.ndarray, y: np.ndarray, total: np.ndarray) -> float:
    """Summed cross-entropy of the rows; their summed gradient is added to ``total``."""
    parts, sums = _views(layers, weights.astype(x.dtype)), _views(layers, total)
    out = _activations(parts, x)
    shifted = out[-1].astype(np.float64)
    shifted -= shifted.max(axis=1, keepdims=True)
    share = np.exp(shifted)
    norm = share.sum(axis=1, keepdims=True)
    loss = float(np.log(norm).sum() - shifted[np.arange(len(y)), y].sum())
    share /= norm
    share[np.arange(len(y)), y] -= 1
    share[np.abs(share) < LEAST] = 0
    delta = share.astype(x.dtype)
    for k in range(len(parts) - 1, -1, -1):
        sums[k][0][...] += out[k].T @ delta
        sums[k][1][...] += delta.sum(axis=0, dtype=np.float64)
        if k:
            delta = delta @ parts[k][0].T
            delta *= out[k]
            delta *= 1 - out[k]
        delta[np.abs(delta) < LEAST] = 0
    return loss


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(labels), -1)
        for at in range(0, len(labels), BLOCK):
            yield values[at : at + BLOCK], labels[at : at + BLOCK]


def objective(rows: DataFrame, layers: list[int]) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Mean cross-entropy and its gradient over all rows (an array of floats and a class number)."""
    context = rows.sparkSession.sparkContext
    kind = "loss double, n bigint, gradient binary"

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, n, total = 0.0, 0, 0.0
        for batch in batches:
            for one in batch.to_pylist():
                loss, n, total = loss + one["loss"], n + one["n"], total + np.frombuffer(one["gradient"])
        if n:
            yield pa.RecordBatch.from_pydict({"loss": [loss], "n": [n], "gradient": [total.tobytes()]})

    def evaluate(weights: np.ndarray) -> tuple[float, np.ndarray]:
        sent = context.broadcast(weights)

        def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, loss, n = np.zeros(len(sent.value)), 0.0, 0
            for x, y in _blocks(batches):
                loss += add_gradient(layers, sent.value, x, y, total)
                n += len(y)
            if n:
                yield pa.RecordBatch.from_pydict({"loss": [loss], "n": [n], "gradient": [total.tobytes()]})

        parts = rows.mapInArrow(gradient, kind)
        if context.defaultParallelism > FEW_TASKS:
            parts = parts.repartition(math.isqrt(context.defaultParallelism)).mapInArrow(summed, kind)
        loss, n, total = 0.0, 0, np.zeros(len(weights))
        for one in parts.collect():
            loss, n = loss + one.loss, n + one.n
            total += np.frombuffer(one.gradient)
        sent.destroy()
        return loss / max(n, 1), total / max(n, 1)

    return evaluate


def accuracy(rows: DataFrame, layers: list[int], weights: np.ndarray) -> float:
    """Share of the rows that the net assigns to their class; 0 without rows."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, n = 0, 0
        for x, y in _blocks(batches):
            right += int((_activations(_views(layers, sent.value.astype(x.dtype)), x)[-1].argmax(axis=1) == y).sum())
            n += len(y)
        yield pa.RecordBatch.from_pydict({"hits": [right], "n": [n]})

    found = rows.mapInArrow(hits, "hits bigint, n bigint").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).first()
    sent.destroy()
    return found.hits / found.n if found.n else 0.0


def _step(evaluate: Callable, at: np.ndarray, value: float, slope: float, direction: np.ndarray, step: float):
    """A point along a direction that lowers the value enough and whose slope has risen enough (weak Wolfe conditions), or the last that lowers it."""
    low, high, kept = 0.0, math.inf, None
    for _ in range(MOST_STEPS):
        point = at + step * direction
        new, gradient = evaluate(point)
        if not new <= value + 1e-4 * step * slope:
            high = step
        else:
            kept = point, new, gradient
            if gradient @ direction >= 0.9 * slope:
                break
            low = step
        step = (low + high) / 2 if high < math.inf else 2 * low
    return kept


def minimise(evaluate: Callable, weights: np.ndarray, iterations: int, tolerance: float = 1e-6, memory: int = 10, window: int = 20) -> np.ndarray:
    """Weights after at most so many L-BFGS iterations.

    They end earlier when the gradient is small beside the value, when the value has fallen over ``window`` iterations by less than ``tolerance`` of the
    first value, or when no step lowers it: the rules of Spark's own optimiser.
    """
    value, gradient = evaluate(weights)
    first, values, pairs = value, [value], deque(maxlen=memory)
    for _ in range(iterations):
        if np.linalg.norm(gradient) <= max(tolerance * abs(value), 1e-8):
            break
        direction, coefficients = -gradient, []
        for s, y, r in reversed(pairs):
            coefficients.append(r * (s @ direction))
            direction = direction - coefficients[-1] * y
        if pairs:
            s, y, r = pairs[-1]
            direction = direction / (r * (y @ y))
        for (s, y, r), c in zip(pairs, reversed(coefficients)):
            direction = direction + (c - r * (y @ direction)) * s
        found = _step(evaluate, weights, value, float(gradient @ direction), direction, 1.0 if pairs else 1.0 / np.linalg.norm(gradient))
        if found is None:
            if not pairs:
                break
            pairs.clear()  # once more along the gradient itself
            continue
        point, new, slope = found
        s, y = point - weights, slope - gradient
        if s @ y > 0:
            pairs.append((s, y, 1.0 / (s @ y)))
        weights, value, gradient = point, new, slope
        values = [*values, value][-window:]
        if abs(value - max(values)) <= tolerance * first:
            break
    return weights
