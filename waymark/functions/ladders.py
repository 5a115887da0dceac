"""Frequency and wavelength ladders: constant arrays worked out when a plan is made."""

from __future__ import annotations

import math
from itertools import count


def geometric(low: float, high: float, n: int) -> list[float]:
    return [low * (high / low) ** (k / (n - 1)) for k in range(n)]


def _is_power(b: int, of: int) -> bool:
    while b % of == 0:
        b //= of
    return b == 1


def gpe_frequencies(h: int, eps: float = 1e-6) -> list[float]:
    """h / 4 frequencies: 1, then the powers of every base that is no power of a lower one, each up to 1 / eps; doubled on where bases up to h don't suffice."""
    out = [1.0]
    bases = (b for b in count(2) if not any(_is_power(b, a) for a in range(2, b)))
    for b in bases:
        if b > max(h, 4) or len(out) >= h // 4:
            break
        top = min(math.ceil(-math.log(eps) / math.log(k)) for k in (2, b))
        out += [float(b) ** i for i in range(1, top + 1)]
    while len(out) < h // 4:
        out.append(2 * out[-1])
    return out[: h // 4]
