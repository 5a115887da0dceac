"""Audits of codes: how well they follow turns and shifts, how fast they move, how they keep similarities."""

from __future__ import annotations

import math

from ..plans import EARTH_M, query, step
from .geo import GATE, HARMONICS, RADIAL, REF, TORUS, disp_code, torus_code
from .trips import UNIFORM

ANGLES = [round(-math.pi + (k + 0.5) * math.pi / 8, 6) for k in range(16)]


def relative(d, pairs):
    """The mean distance of two codes over the root mean square norm of the second."""
    gap = " + ".join(f"power({a} - ({b}), 2)" for a, b in pairs)
    norm = " + ".join(f"power({b}, 2)" for _, b in pairs)
    return f"avg(sqrt({gap}))/(sqrt(avg({norm})) + 1e-12)"


def rotated(sin, cos, angle):
    return f"({sin}*cos({angle}) + {cos}*sin({angle}))", f"({cos}*cos({angle}) - {sin}*sin({angle}))"


@query("points")
def translation_error(d):
    """Torus codes of shifted points against turned codes (the analytic representation): 0; and against the codes as they are."""
    exact, still = [], []
    for axis, v in (("x", "v.v"), ("y", "-0.5e0*v.v")):
        for lam in TORUS:
            s, c = (f"{f}(2e0*pi()*p.{axis}/{lam!r})" for f in ("sin", "cos"))
            s1, c1 = (f"{f}(2e0*pi()*(p.{axis} + {v})/{lam!r})" for f in ("sin", "cos"))
            a, b = rotated(s, c, f"2e0*pi()*({v})/{lam!r}")
            exact += [(s1, a), (c1, b)]
            still += [(s1, s), (c1, c)]
    return f"SELECT v.v_i, {d.r('v.v')} AS shift_m, {d.r(relative(d, exact))} AS analytic, {d.r(relative(d, still))} AS unchanged FROM points AS p CROSS JOIN {d.values('v', [25.0, 100.0, 400.0])} AS v GROUP BY v.v_i, v.v"


@query("steps")
def rotation_audit(d):
    """Displacement codes of turned steps against turned codes over 16 angles: harmonic m turns by m times the angle, the radial part stays."""
    before, after = disp_code(), disp_code("psi + v.v")
    n = 2 * len(RADIAL)
    pairs = [*zip(after[:n], before[:n])]
    for k, m in enumerate(HARMONICS):
        a, b = rotated(before[n + 2 * k], before[n + 2 * k + 1], f"{m}e0*v.v")
        pairs += [(after[n + 2 * k], a), (after[n + 2 * k + 1], b)]
    return f"SELECT v.v_i, {d.r(relative(d, pairs))} AS error, {d.r(relative(d, [*zip(after, before)]), 5)} AS unchanged FROM steps CROSS JOIN {d.values('v', ANGLES)} AS v WHERE r IS NOT NULL GROUP BY v.v_i"


@query("points")
def empirical_lipschitz(d):
    """How far torus codes move for each metre, in a direction by a hash."""
    way = f"2e0*pi()*{UNIFORM('p.seq', 48271)}"
    gap = " + ".join(f"power({a} - {b}, 2)" for a, b in zip(torus_code(f"p.x + v.v*cos({way})", f"p.y + v.v*sin({way})"), torus_code("p.x", "p.y")))
    return f"SELECT v.v_i, {d.r('v.v')} AS delta_m, {d.r(f'avg(sqrt({gap}))/max(v.v)', 6)} AS per_m FROM points AS p CROSS JOIN {d.values('v', [1.0, 5.0, 15.0])} AS v GROUP BY v.v_i, v.v"


@query("trips", "asked")
def gram_distortion(d):
    """How much cosines of codes change when trips move to the equator: torus codes in metres of a frame fitted anew, against codes of degrees. Starts of the query set's trips against all starts."""
    ends = "SELECT uid, seg, min_by(lon, i) AS lon, min_by(lat, i) AS lat FROM trips GROUP BY uid, seg"
    dx, dy = "radians(a.lon - b.lon)", "radians(a.lat - b.lat)"
    cosine = lambda x, y: "(" + " + ".join(f"cos(2e0*pi()*{EARTH_M}*{v}/{lam!r})" for lam in TORUS for v in (x, y)) + f")/{2 * len(TORUS)}e0"
    c = f"cos(radians({REF[1]}e0))"
    here, refit, stale = cosine(f"{dx}*{c}", dy), cosine(f"{dx}*{c}", dy), cosine(dx, dy)
    return f"SELECT {d.r(f'avg(abs({here} - {refit}))')} AS refit, {d.r(f'avg(abs({here} - {stale}))', 5)} AS stale, count(*) AS pairs FROM (SELECT e.* FROM ({ends}) AS e JOIN asked AS q ON e.uid = q.uid AND e.seg = q.seg) AS a CROSS JOIN ({ends}) AS b"


@step("steps")
def gates(d):
    return f"SELECT seq, {GATE} AS gate FROM steps WHERE r IS NOT NULL"


@query("gates")
def gate_histogram(d):
    """How much of the angular channel is let through, in tenths."""
    return f"SELECT {d.floor('least(gate*10e0, 9e0)')} AS tenth, count(*) AS n FROM gates GROUP BY {d.floor('least(gate*10e0, 9e0)')}"


@query("points")
def saturation_curve(d):
    """Mean cosine of torus codes under normal noise of eight deviations; a code's norm is the same everywhere."""
    u = lambda a, b: f"sqrt(-2e0*ln(greatest({UNIFORM('p.seq', a)}, 1e-12)))*cos(2e0*pi()*{UNIFORM('p.seq', b)})"
    parts = " + ".join(f"cos(2e0*pi()*v.v*{n}/{lam!r})" for lam in TORUS for n in (u(48271, 69621), u(16807, 39373)))
    return f"SELECT v.v_i, {d.r('v.v')} AS sigma, {d.r(f'avg(({parts})/{2 * len(TORUS)}e0)', 5)} AS cosine FROM points AS p CROSS JOIN {d.values('v', [0.0, 1.0, 2.0, 5.0, 10.0, 15.0, 25.0, 50.0])} AS v GROUP BY v.v_i, v.v"
