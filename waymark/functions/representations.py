"""How codes follow shifts and turns: the matrices of their analytic representations, worked out when a plan is made."""

from __future__ import annotations

import math

import numpy as np

from ..plans import EARTH_M
from .ladders import gpe_frequencies


def block_diagonal(blocks: list[np.ndarray]) -> np.ndarray:
    n = sum(len(b) for b in blocks)
    out, at = np.zeros((n, n)), 0
    for b in blocks:
        out[at : at + len(b), at : at + len(b)] = b
        at += len(b)
    return out


def turns(phases) -> np.ndarray:
    """The matrix that adds a phase to each (sin, cos) pair of an interleaved code."""
    return block_diagonal([np.array([[math.cos(p), math.sin(p)], [-math.sin(p), math.cos(p)]]) for p in phases])


def grouped(m: np.ndarray) -> np.ndarray:
    """The same matrix for a code with all sines before all cosines."""
    order = np.concatenate((np.arange(0, len(m), 2), np.arange(1, len(m), 2)))
    return m[np.ix_(order, order)]


def torus_rho(scales: list[float], vx: float, vy: float) -> np.ndarray:
    """Of a shift in metres on a torus code: x, then y, at all scales."""
    return turns([2 * math.pi * v / s for v in (vx, vy) for s in scales])


def gpe_rho(h: int, vx: float, vy: float, lat: float) -> np.ndarray:
    """Of a shift in metres at a latitude on a code of longitude and latitude; exact along a parallel and a meridian."""
    w = gpe_frequencies(h)
    return turns([f * a for a in (vx / (EARTH_M * math.cos(math.radians(lat))), vy / EARTH_M) for f in w])


def displacement_rho(radial: int, harmonics: tuple[int, ...], theta: float) -> np.ndarray:
    """Of a turn on a displacement code: the radial part stays, harmonic m turns by m * theta."""
    return block_diagonal([np.eye(radial), turns([m * theta for m in harmonics])])


def hours_rho(tau: float, hour: tuple[int, ...] = (1, 2, 3, 4), day: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """Of a shift of the clock by tau hours on a time code (sines, then cosines, of the hour and of the day of the week).

    The day part turns by whole days, so it is exact for shifts of whole days alone.
    """
    return block_diagonal([grouped(turns([2 * math.pi * m * tau / 24 for m in hour])), grouped(turns([2 * math.pi * m * tau / 168 for m in day]))])


def norm(m: np.ndarray) -> float:
    return float(np.linalg.norm(m, 2))


def circulant(kernel) -> np.ndarray:
    k = np.asarray(kernel, float)
    return np.stack([np.roll(k, i) for i in range(len(k))], 1)


def lipschitz(frequencies) -> float:
    """The most that a sin and cos code moves for each unit of its argument."""
    return math.sqrt(sum(f * f for f in frequencies))


def finest_wavelength_m(h: int) -> float:
    """Of a code of latitude in radians, in metres on the ground."""
    return 2 * math.pi * EARTH_M / max(gpe_frequencies(h))


def random_features(dim: int, scale_m: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Frozen weights and offsets of dim random Fourier features of (x, y): sqrt(2 / dim) cos(w p + b)."""
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1 / scale_m, (dim, 2)), rng.uniform(0, 2 * math.pi, dim)
