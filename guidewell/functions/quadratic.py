"""Bounded quadratic programs of a few unknowns: minimise s'Ks / 2 - r's + penalty * sum(s) with 0 <= s <= upper.

With some unknowns held at a bound and the rest free, the minimiser is an affine map of r: the free block's inverse and
zeros elsewhere, plus a constant. A program's answer is the best feasible of these maps' values, so the maps are made once
for each matrix K and then applied to all r together.
"""

from __future__ import annotations

import numpy as np

FEASIBLE = 1e-9
#: Programs of more unknowns are solved by coordinate descent: there are 3 ** k maps.
MOST_MAPPED = 4


def objective(s: np.ndarray, gram: np.ndarray, rhs: np.ndarray, penalty: float) -> np.ndarray:
    """Over the last axis of ``s``."""
    return ((0.5 * s @ gram - rhs + penalty) * s).sum(axis=-1)


def solve(gram: np.ndarray, rhs: np.ndarray, penalty: float, upper: float) -> np.ndarray:
    """Solutions for all rows of ``rhs`` (n x k) with one ``gram`` (k x k)."""
    k = gram.shape[0]
    if k == 1:
        g = gram[0, 0]
        return np.clip((rhs - penalty) / g, 0, upper) if g > 0 else np.zeros_like(rhs)
    return best_of_maps(gram, rhs, penalty, upper) if k <= MOST_MAPPED else descend(gram, rhs, penalty, upper)


def affine_maps(gram: np.ndarray, penalty: float, upper: float) -> tuple[np.ndarray, np.ndarray]:
    """``turn`` (3 ** k, k, k) and ``shift`` (3 ** k, k): turn @ r + shift for each way to free or hold the unknowns.

    The number of a way, written with k digits to the base 3, says of each unknown: 0 free, 1 at 0, 2 at ``upper``; ties go
    to the lowest number. A singular free block gets its pseudo-inverse: the shortest of the minimisers.
    """
    k = gram.shape[0]
    digit = np.arange(3**k)[:, None] // 3 ** np.arange(k - 1, -1, -1) % 3
    free, held = digit == 0, np.where(digit == 2, upper, 0.0)
    inside = free[:, :, None] & free[:, None, :]
    block = np.where(inside, gram, 0.0) + np.einsum("si,ij->sij", ~free, np.eye(k))  # the identity where held
    singular = np.linalg.matrix_rank(block) < k
    turn = np.empty_like(block)
    turn[~singular] = np.linalg.inv(block[~singular])
    turn[singular] = np.linalg.pinv(block[singular])
    turn = np.where(inside, turn, 0.0)
    return turn, held - np.einsum("sij,sj->si", turn, penalty + held @ gram)


def best_of_maps(gram: np.ndarray, rhs: np.ndarray, penalty: float, upper: float) -> np.ndarray:
    """The best map whose value lies within bounds, the first of equals; zeros where none does."""
    turn, shift = affine_maps(gram, penalty, upper)
    s = np.einsum("sij,nj->nsi", turn, rhs) + shift
    inside = ((s >= -FEASIBLE) & (s <= upper + FEASIBLE)).all(axis=-1)
    s = np.clip(s, 0, upper)
    value = np.where(inside, objective(s, gram, rhs[:, None, :], penalty), np.inf)
    chosen = value.argmin(axis=1)
    found = s[np.arange(len(rhs)), chosen]
    return np.where(inside.any(axis=1)[:, None], found, 0.0)


def descend(gram: np.ndarray, rhs: np.ndarray, penalty: float, upper: float, rounds: int = 20_000, tolerance: float = 1e-13) -> np.ndarray:
    """Cyclic coordinate descent from zero, each step clipped; all rows at once."""
    n, k = rhs.shape
    s, diagonal = np.zeros((n, k)), np.diag(gram)
    for _ in range(rounds):
        moved = 0.0
        for j in range(k):
            slope = rhs[:, j] - penalty - s @ gram[:, j] + diagonal[j] * s[:, j]
            new = np.clip(slope / diagonal[j], 0, upper) if diagonal[j] > 0 else np.where(slope > 0, upper, 0.0)
            moved = max(moved, float(np.abs(new - s[:, j]).max(initial=0)))
            s[:, j] = new
        if moved <= tolerance * max(1.0, upper):
            break
    return s
