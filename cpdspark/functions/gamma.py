"""Beta draws for whole batches: each value's draw depends on its own state only."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)


def uniforms(state: np.ndarray, counter: int) -> np.ndarray:
    """The ``counter``-th uniform draw in (0, 1) of every state, by mixing state and counter."""
    with np.errstate(over="ignore"):
        z = state.astype(np.uint64) + _STEP * np.uint64(counter + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53 + 2.0**-54


def log_gamma_draws(shape: np.ndarray, state: np.ndarray, stream: int) -> np.ndarray:
    """Logarithms of Gamma(shape, 1) draws: rejection from a cubed normal, all rows at once.

    Shapes below 1 are drawn at shape + 1 and scaled by a power of a uniform, as logarithms, so that
    tiny shapes do not end at 0. Rows that are rejected go on with their next three uniforms.
    """
    shape = np.asarray(shape, float)
    d = np.where(shape < 1, shape + 1, shape) - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out = np.full(len(shape), -np.inf)
    todo = np.flatnonzero(shape > 0)
    counter = stream << 32
    boost = uniforms(state, counter)
    while len(todo):
        u1, u2, u3 = (uniforms(state[todo], counter + k) for k in (1, 2, 3))
        counter += 3
        x = np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * u2)
        v = (1 + c[todo] * x) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            ok = (v > 0) & (np.log(u3) < x * x / 2 + d[todo] * (1 - v + np.log(v)))
            out[todo[ok]] = np.log(d[todo[ok]] * v[ok])
        todo = todo[~ok]
    small = (shape > 0) & (shape < 1)
    out[small] += np.log(boost[small]) / shape[small]
    return out


def beta_draws(a: np.ndarray, b: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Beta(a, b) draws; 1 where b has no mass, 0 where a has none."""
    a, b, state = np.asarray(a, float), np.asarray(b, float), np.asarray(state).astype(np.uint64)
    x, y = log_gamma_draws(a, state, 0), log_gamma_draws(b, state, 1)
    with np.errstate(over="ignore", invalid="ignore"):
        out = 1 / (1 + np.exp(y - x))
    return np.where(b <= 0, 1.0, np.where(a <= 0, 0.0, out))
