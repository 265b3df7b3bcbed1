"""Small linear models, fitted on bounded samples."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking; ``f`` gives a value and its gradient."""
    value, grad = f(x)
    past: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=memory)
    for _ in range(rounds):
        step, kept = -grad, []
        for s, y, r in reversed(past):
            a = r * s.dot(step)
            kept.append(a)
            step = step - a * y
        if past:
            s, y, _ = past[-1]
            step = step * (s.dot(y) / y.dot(y))
        for (s, y, r), a in zip(past, reversed(kept), strict=True):
            step = step + s * (a - r * y.dot(step))
        slope = grad.dot(step)
        if slope > -1e-12:
            break
        size = 1.0 if past else min(1.0, 1.0 / np.abs(grad).sum())
        while True:
            new = x + size * step
            new_value, new_grad = f(new)
            if new_value <= value + 1e-4 * size * slope or size < 1e-10:
                break
            size *= 0.5
        s, y = new - x, new_grad - grad
        if s.dot(y) > 1e-12:
            past.append((s, y, 1.0 / s.dot(y)))
        done = abs(value - new_value) < 1e-7 * max(1.0, abs(value))
        x, value, grad = new, new_value, new_grad
        if done:
            break
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def platt(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities; targets are smoothed by the counts."""
    pos, neg = int((labels == 1).sum()), int((labels == 0).sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        z = p[0] * scores + p[1]
        g = (sigmoid(z) - target) / len(scores)
        value = float(np.mean(np.logaddexp(0, z) - target * z)) + 1e-6 * float(p.dot(p))
        return value, np.array([g.dot(scores), g.sum()]) + 2e-6 * p

    slope, offset = minimise(loss, np.zeros(2), 200)
    return max(float(slope), 1e-3), float(offset)
