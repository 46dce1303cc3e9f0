"""Sparse logistic regression by follow-the-regularised-leader with an elastic net, over shards.

Every round each shard starts from the shared state, goes once through its rows in a fixed
order, and returns its state; the states are averaged. Shards are fixed by a hash of the row,
so that a repeated task returns the same state. A row is (indices, values, class or target
probabilities, weight).
"""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Per-coordinate FTRL-Proximal for ``classes`` outputs; one output is the two-class case."""

    def __init__(self, dims: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3,
                 state: tuple[np.ndarray, np.ndarray] | None = None):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = state if state is not None else (np.zeros((dims, classes)), np.zeros((dims, classes)))

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, index: np.ndarray, value: np.ndarray, target: np.ndarray, weight: float = 1.0) -> None:
        """One step; ``target``: the probability of each class."""
        w = self.weights(index)
        p = probabilities(value @ w)
        g = weight * value[:, None] * (p - target)[None, :]
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g


def probabilities(logits: np.ndarray) -> np.ndarray:
    """Softmax over the last axis; one output is a sigmoid."""
    if logits.shape[-1] == 1:
        return 1.0 / (1.0 + np.exp(-np.clip(logits, -50, 50)))
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def average(states: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return sum(z for z, _ in states) / len(states), sum(n for _, n in states) / len(states)


def temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """Temperature of least log loss on held-back rows, by golden-section search of its logarithm."""
    def loss(t: float) -> float:
        p = probabilities(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(label)), label], 1e-12)).mean())

    if not len(label):
        return 1.0
    low, high, ratio = -4.0, 4.0, (5 ** 0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))
