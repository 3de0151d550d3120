"""Ridge solves: dense by eigenvectors, sparse by conjugate gradients for many right sides at once."""

from __future__ import annotations

import numpy as np


def solve_from_gram(gram: np.ndarray, rhs: np.ndarray, lr_lambda: float) -> np.ndarray:
    """(gram + lambda I) \\ rhs for a symmetric matrix, in its eigenbasis; directions without weight stay 0, so a singular system gets its shortest solution."""
    weight, basis = np.linalg.eigh(gram)
    weight = weight + lr_lambda
    there = np.abs(weight) > np.abs(weight).max(initial=0) * len(weight) * np.finfo(float).eps
    return basis[:, there] @ ((basis[:, there].T @ rhs) / weight[there][:, None])


def ridge(x: np.ndarray, y: np.ndarray, lr_lambda: float) -> np.ndarray:
    return solve_from_gram(x.T @ x, x.T @ y, lr_lambda)


def conjugate_gradients(row: np.ndarray, column: np.ndarray, value: np.ndarray, rhs: np.ndarray, tolerance: float = 1e-14, rounds: int = 2000) -> np.ndarray:
    """Solve a symmetric positive (semi)definite sparse system, given by its entries in order of rows, for each column of ``rhs``; scaled by its diagonal."""
    n = len(rhs)
    starts = np.searchsorted(row, np.arange(n))
    full = np.diff(np.append(starts, len(row))) > 0
    diagonal = np.ones(n)
    own = row == column
    diagonal[row[own]] = np.where(value[own] > 0, value[own], 1.0)

    def times(x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        if len(row):
            out[full] = np.add.reduceat(value[:, None] * x[column], starts[full], axis=0)
        return out

    x, left = np.zeros_like(rhs), rhs.copy()
    step = left / diagonal[:, None]
    size = (left * step).sum(axis=0)
    least = tolerance**2 * np.maximum(size, np.finfo(float).tiny)
    for _ in range(rounds):
        if (size <= least).all():
            break
        turned = times(step)
        curve = (step * turned).sum(axis=0)
        go = np.where((curve > 0) & (size > least), size / np.where(curve > 0, curve, 1.0), 0.0)
        x += go * step
        left -= go * turned
        scaled = left / diagonal[:, None]
        was, size = size, np.where(go > 0, (left * scaled).sum(axis=0), 0.0)
        step = scaled + np.where(was > 0, size / np.where(was > 0, was, 1.0), 0.0) * step
    return x
