"""Logistic regression on hashed n-gram shares, small enough to fit on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Logistic:
    """Weights of hashed features, an offset, and the two numbers that calibrate the value."""

    weights: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, margin: np.ndarray) -> np.ndarray:
        """Calibrated probability of class 1 for raw values (features @ weights + offset)."""
        return sigmoid(self.slope * margin + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class SparseRows:
    """Rows as runs of (slot, value); ``bounds`` has where each row begins, and the end."""

    slots: np.ndarray
    values: np.ndarray
    bounds: np.ndarray

    def dot(self, weights: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.values * weights[self.slots])])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def back(self, errors: np.ndarray, size: int) -> np.ndarray:
        owner = np.repeat(errors, np.diff(self.bounds))
        return np.bincount(self.slots, weights=self.values * owner, minlength=size)


def stacked(rows: list[tuple[np.ndarray, np.ndarray]]) -> SparseRows:
    sizes = [len(slots) for slots, _ in rows]
    slots = np.concatenate([s for s, _ in rows]) if rows else np.zeros(0, np.int64)
    values = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
    return SparseRows(slots.astype(np.int64), values.astype(np.float64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


def fit(rows: SparseRows, labels: np.ndarray, size: int, ridge: float = 1e-4, steps: int = 300, fold: np.ndarray | None = None) -> Logistic:
    """Accelerated gradient descent on class-balanced log-loss, then Platt calibration.

    ``fold`` marks rows whose values, under a model fitted on the others, calibrate the result."""
    labels = labels.astype(np.float64)
    if fold is not None and 0 < fold.sum() < len(fold) and len(set(labels[fold])) == 2 and len(set(labels[~fold])) == 2:
        first = _descend(rows, labels, size, ridge, steps, ~fold)
        margin = rows.dot(first.weights) + first.offset
        slope, shift = _platt(margin[fold], labels[fold])
    else:
        slope, shift = 1.0, 0.0
    model = _descend(rows, labels, size, ridge, steps, np.ones(len(labels), bool))
    return Logistic(model.weights.astype(np.float32), float(model.offset), slope, shift)


def _descend(rows: SparseRows, labels: np.ndarray, size: int, ridge: float, steps: int, used: np.ndarray) -> Logistic:
    ones, zeros = (used & (labels == 1)).sum(), (used & (labels == 0)).sum()
    if not ones or not zeros:
        return Logistic(np.zeros(size), 20.0 if ones else -20.0 if zeros else 0.0)
    weight = np.where(labels == 1, 0.5 / ones, 0.5 / zeros) * used
    at, moved, offset, offset_moved, speed = np.zeros(size), np.zeros(size), 0.0, 0.0, 1.0
    # The largest squared row norm bounds the curvature.
    squares = np.concatenate([[0.0], np.cumsum(rows.values**2)])
    rate = 4.0 / ((squares[rows.bounds[1:]] - squares[rows.bounds[:-1]]).max() + 1.0 + ridge)
    for _ in range(steps):
        error = (sigmoid(rows.dot(moved) + offset_moved) - labels) * weight
        ahead = moved - rate * (rows.back(error, size) + ridge * moved)
        offset_ahead = offset_moved - rate * error.sum()
        faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        push = (speed - 1) / faster
        moved, offset_moved = ahead + push * (ahead - at), offset_ahead + push * (offset_ahead - offset)
        at, offset, speed = ahead, offset_ahead, faster
    return Logistic(at, offset)


def _platt(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid through held-out values, by Newton steps on smoothed targets."""
    ones, zeros = labels.sum(), (1 - labels).sum()
    goal = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(slope * margin + shift)
        error, curve = p - goal, p * (1 - p) + 1e-9
        g = np.array([(error * margin).sum() + 1e-3 * (slope - 1), error.sum()])
        h = np.array([[(curve * margin * margin).sum() + 1e-3, (curve * margin).sum()], [(curve * margin).sum(), curve.sum()]])
        step = np.linalg.solve(h, g)
        size = max(1.0, np.abs(step).max())
        slope, shift = slope - step[0] / size, shift - step[1] / size
        if np.abs(step).max() < 1e-8:
            break
    return float(max(slope, 1e-3)), float(shift)
