"""A network of sigmoid layers with a softmax on top, fitted to all rows at once by L-BFGS.

Loss, layers and weights are those of Spark's multilayer perceptron. A round is one sum of gradients over Spark's
tasks: matrices of a few hundred rows in single precision, added up in double precision. The driver holds
weights and the last gradients, never rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from cohortlens.operators.blocks import packed, summed

# Gradients remembered, tolerance, and the shares of a sufficient decrease and of a flat enough slope.
MEMORY, TOLERANCE, DECREASE, FLAT = 10, 1e-6, 1e-4, 0.9


def shaped(flat: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, biases) per layer, in the library's order: inputs x outputs column by input, then biases."""
    at, found = 0, []
    for a, b in zip(layers, layers[1:]):
        found.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return found


def gradient(net: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Summed cross-entropy of rows, and its gradient part by part."""
    values = [x]
    for w, b in net[:-1]:
        z = values[-1] @ w
        z += b
        # The sigmoid, without overflow.
        z *= 0.5
        np.tanh(z, out=z)
        z += 1.0
        z *= 0.5
        values.append(z)
    z = values[-1] @ net[-1][0] + net[-1][1]
    z -= z.max(1, keepdims=True)
    e = np.exp(z)
    total = e.sum(1, keepdims=True)
    rows = np.arange(len(y))
    loss = float((np.log(total[:, 0]) - z[rows, y]).sum(dtype=float))
    delta = e / total
    delta[rows, y] -= 1.0
    parts: list[np.ndarray] = []
    for layer in range(len(net) - 1, -1, -1):
        parts = [(values[layer].T @ delta).ravel(), delta.sum(0), *parts]
        if layer:
            v = values[layer]
            delta = delta @ net[layer][0].T
            delta *= v - v * v
    return loss, parts


def descend(
    at: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int
) -> np.ndarray:
    """Least value of a smooth function by L-BFGS with a line search for the strong Wolfe conditions."""
    x = start.copy()
    value, slope = at(x)
    steps: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=MEMORY)
    for _ in range(rounds):
        if np.linalg.norm(slope) <= max(TOLERANCE * abs(value), 1e-8):
            break
        way = slope.copy()
        shares = []
        for s, g in reversed(steps):
            a = (s @ way) / (s @ g)
            way -= a * g
            shares.append(a)
        if steps:
            s, g = steps[-1]
            way *= (s @ g) / (g @ g)
        for (s, g), a in zip(steps, reversed(shares)):
            way += (a - (g @ way) / (s @ g)) * s
        way = -way
        if way @ slope >= 0:
            steps.clear()
            way = -slope
        share = 1.0 if steps else 1.0 / np.linalg.norm(slope)
        low, high, found = 0.0, np.inf, None
        for _ in range(20):
            new, tilt = at(x + share * way)
            if not np.isfinite(new) or new > value + DECREASE * share * (way @ slope):
                high = share
            else:
                found = share, new, tilt
                along = way @ tilt
                if abs(along) <= FLAT * abs(way @ slope):
                    break
                low, high = (low, share) if along > 0 else (share, high)
            share = 2 * share if high == np.inf else (low + high) / 2
        if found is None:
            break
        share, new, tilt = found
        moved, turned = share * way, tilt - slope
        if moved @ turned > 1e-14 * np.linalg.norm(moved) * np.linalg.norm(turned):
            steps.append((moved, turned))
        done = value - new <= 1e-9 * abs(value)
        x, value, slope = x + moved, new, tilt
        if done:
            break
    return x


def fit(data: DataFrame, layers: list[int], start: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weights at the least mean cross-entropy found within ``rounds``; ``data`` holds features and label."""
    blocks = packed(data, "float32")
    size = len(start)

    def at(flat: np.ndarray) -> tuple[float, np.ndarray]:
        net = shaped(flat.astype(np.float32), layers)

        def part(_, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            loss, parts = gradient(net, x, y)
            return np.concatenate([[len(y), loss], *parts])

        total = summed(blocks, size + 2, part, "float32")
        n = max(total[0], 1.0)
        return total[1] / n, total[2:] / n

    return descend(at, start, rounds)
