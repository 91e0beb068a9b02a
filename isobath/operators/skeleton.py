"""Products of many columns by those of few: columns that are sums of others, to the rounding of doubles, need not be multiplied.

What is left out is measured, not estimated: in each call a part of at most TOLERANCE of a column's length. Columns
that are no such sums are kept.
"""

from __future__ import annotations

import numpy as np

#: Part of a column's length that may be left out, directions looked for at once.
TOLERANCE, DRAWN = 1e-14, 32


def _scaled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt(np.einsum("ij,ij->j", rows, rows))
    length[length == 0] = 1.0
    return rows / length, length


def reduced(rows: np.ndarray) -> np.ndarray | None:
    """Fewer rows of which every two columns have the same product; None if they would be half as many or more."""
    if not np.isfinite(rows).all():
        return None
    rest, _ = _scaled(rows)
    found, draw = np.empty((len(rows), 0)), np.random.default_rng(0)
    while np.einsum("ij,ij->j", rest, rest).max(initial=0.0) > TOLERANCE**2:
        if 2 * (found.shape[1] + DRAWN) > min(rows.shape):
            return None
        q = rest @ draw.standard_normal((rows.shape[1], DRAWN))
        for _ in range(2):
            q, _ = np.linalg.qr(q - found @ (found.T @ q))
        rest -= q @ (q.T @ rest)
        found = np.hstack([found, q])
    return found.T @ rows


def skeleton(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, weights): all columns are rows[:, columns] @ weights."""
    rest, length = _scaled(rows)
    unit, at, base = rest.copy(), [], np.empty((len(rows), 0))
    while len(at) < min(rows.shape):
        left = np.einsum("ij,ij->j", rest, rest)
        k = int(left.argmax())
        if left[k] <= TOLERANCE**2:
            break
        v = rest[:, k]
        for _ in range(2):
            v = v - base @ (base.T @ v)
        v /= np.linalg.norm(v)
        rest -= np.outer(v, v @ rest)
        rest[:, k] = 0.0
        base, at = np.hstack([base, v[:, None]]), [*at, k]
    at = np.array(at, np.int64)
    made = base.T @ unit
    weights = np.linalg.solve(np.triu(made[:, at]), made) if len(at) else made
    weights[:, at] = np.eye(len(at))
    return at, weights * length / length[at, None]
