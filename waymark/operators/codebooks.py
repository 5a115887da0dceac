"""Discrete tokens of a torus codebook: decoding, permutations, transfer to held-out points, the lattice's period."""

from __future__ import annotations

from ..plans import query, step
from .trips import UNIFORM

BINS, LAMBDA = 16, 1000.0
CELL = LAMBDA / BINS
#: Shifts (east, north) in metres: a cell, several cells, half a cell, a whole period.
SHIFTS = ((62.5, 0.0), (125.0, 62.5), (31.25, 0.0), (1000.0, 2000.0), (93.75, 31.25))


def token(d, x, y):
    bx, by = (d.mod(d.floor(d.mod(f"({v})/{LAMBDA}", "1e0") + f"*{BINS}"), BINS) for v in (x, y))
    return f"({bx}*{BINS} + {by})"


def shifts(d):
    return "(" + " UNION ALL ".join(f"SELECT {k} AS shift, {x!r} AS vx, {y!r} AS vy" for k, (x, y) in enumerate(((float(a), float(b)) for a, b in SHIFTS))) + ")"


def moved(d, t="token"):
    """The token that a shift's permutation gives."""
    bx, by = d.floor(f"{t}/{BINS}e0"), f"{t} % {BINS}"
    return f"({d.mod(f'{bx} + ' + d.half_even(f'vx/{CELL}e0'), BINS)}*{BINS} + {d.mod(f'{by} + ' + d.half_even(f'vy/{CELL}e0'), BINS)})"


@query("torus")
def decode_tokens(d):
    """The phase of each token's cell centre."""
    return f"SELECT DISTINCT token, {d.r(f'({d.floor(f"token/{BINS}e0")} + 0.5e0)/{BINS}')} AS px, {d.r(f'(token % {BINS} + 0.5e0)/{BINS}')} AS py FROM torus"


@query()
def lattice_shifts(d):
    """Each shift in cells, whether it is on the lattice, and the agreement that is to be expected of it."""
    off = lambda v: f"abs({v}/{CELL}e0 - {d.half_even(f'{v}/{CELL}e0')})"
    return f"SELECT shift, {d.r(f'vx/{CELL}e0')} AS cx, {d.r(f'vy/{CELL}e0')} AS cy, {off('vx')} < 1e-9 AND {off('vy')} < 1e-9 AS on_lattice, {d.r(f'(1e0 - {off("vx")})*(1e0 - {off("vy")})')} AS expected FROM {shifts(d)} AS v"


@query()
def predicted_permutation(d):
    """The permutation of all tokens by each shift."""
    return f"SELECT shift, token, {moved(d)} AS moved FROM (SELECT {d.series(0, BINS * BINS - 1)} AS token) AS t CROSS JOIN {shifts(d)} AS v"


@step("torus")
def shifted(d):
    """Each point's token before and after each shift, and the half it belongs to by a hash."""
    return f"SELECT shift, vx, vy, token, {token(d, 'x + vx', 'y + vy')} AS got, {moved(d)} AS want, {UNIFORM('seq', 48271)} < 0.5e0 AS fit FROM torus CROSS JOIN {shifts(d)} AS v"


@query("shifted")
def lattice_period(d):
    """The share of points that keep their token: all of them under a whole period."""
    return f"SELECT shift, {d.r('avg(CASE WHEN token = got THEN 1e0 ELSE 0e0 END)')} AS kept, {d.r('avg(CASE WHEN want = got THEN 1e0 ELSE 0e0 END)')} AS as_predicted FROM shifted GROUP BY shift"


@step("shifted")
def fitted_map(d):
    """The commonest target of each token in one half of the points; the lowest at ties."""
    return "SELECT shift, token, got AS target FROM (SELECT shift, token, got, row_number() OVER (PARTITION BY shift, token ORDER BY count(*) DESC, got) AS k FROM shifted WHERE fit GROUP BY shift, token, got) AS q WHERE k = 1"


@query("shifted", "fitted_map")
def permutation_transfer(d):
    """Agreement of the fitted map with its own half, with the other half, and of the analytic one there; tokens that the fit lacks stay as they are."""
    hit = lambda half, what: d.r(f"sum(CASE WHEN {half} AND s.got = {what} THEN 1e0 ELSE 0e0 END)/greatest(sum(CASE WHEN {half} THEN 1e0 ELSE 0e0 END), 1e0)")
    mapped = "coalesce(f.target, s.token)"
    return f"SELECT s.shift, {hit('s.fit', mapped)} AS fitted, {hit('NOT s.fit', mapped)} AS heldout, {hit('NOT s.fit', 's.want')} AS analytic FROM shifted AS s LEFT JOIN fitted_map AS f ON s.shift = f.shift AND s.token = f.token GROUP BY s.shift"


@query("shifted", "fitted_map")
def permutation_match(d):
    """The share of known tokens whose fitted target is the analytic one."""
    return f"SELECT f.shift, {d.r('avg(CASE WHEN f.target = p.want THEN 1e0 ELSE 0e0 END)')} AS matches, count(*) AS tokens FROM fitted_map AS f JOIN (SELECT DISTINCT shift, token, want FROM shifted) AS p ON f.shift = p.shift AND f.token = p.token GROUP BY f.shift"


@query("passed", "network_vertices")
def vertex_features(d):
    """Each step of a vertex sequence with what is known of its vertex: centre and number of passes."""
    return "SELECT p.uid, p.seg, p.i, p.id, v.x, v.y, c.n AS passes FROM passed AS p JOIN network_vertices AS v ON p.id = v.id JOIN (SELECT id, count(*) AS n FROM passed GROUP BY id) AS c ON p.id = c.id"
