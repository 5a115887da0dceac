"""Group elements, metric frames, moved cities and trips, augmentation; all by hashes of keys, so a retry gives the same."""

from __future__ import annotations

import math

from ..plans import EARTH_M, query, step
from .geo import REF
from .trips import UNIFORM

TRIP = "uid*1000 + seg"


def normal(key, a=48271, b=69621):
    """A standard normal number from two hashes."""
    return f"sqrt(-2e0*ln(greatest({UNIFORM(key, a)}, 1e-12)))*cos(2e0*pi()*{UNIFORM(key, b)})"


def turned(x, y, angle):
    return f"(cos({angle})*({x}) - sin({angle})*({y}))", f"(sin({angle})*({x}) + cos({angle})*({y}))"


def to_lonlat(x, y, lon=f"{REF[0]}e0", lat=f"{REF[1]}e0"):
    return f"{lon} + degrees(({x})/({EARTH_M}*cos(radians({lat}))))", f"{lat} + degrees(({y})/{EARTH_M})"


@step("trip_rows")
def elements(d):
    """A turn, a shift of up to 500 m in each direction and a shift of the clock of up to 12 hours for each trip."""
    u = lambda m: f"(2e0*{UNIFORM(TRIP, m)} - 1e0)"
    return f"SELECT uid, seg, pi()*{u(48271)} AS theta, 500e0*{u(69621)} AS vx, 500e0*{u(16807)} AS vy, 12e0*{u(39373)} AS tau FROM trip_rows"


@query("elements")
def group_elements(d):
    return f"SELECT uid, seg, {d.r('theta')} AS theta, {d.r('vx')} AS vx, {d.r('vy')} AS vy, {d.r('tau')} AS tau FROM elements"


@step("points", "elements")
def augmented(d):
    """Thinned, jittered by 10 m, turned about the mean, shifted in place and time by the trip's own element; ends are not thinned."""
    x, y = turned(f"p.x + 10e0*{normal('p.seq', 16807, 39373)}", f"p.y + 10e0*{normal('p.seq', 40692, 12211)}", "e.theta")
    return f"SELECT p.uid, p.seg, p.i, p.seq, {x} + e.vx AS x, {y} + e.vy AS y, p.t + e.tau AS t FROM points AS p JOIN elements AS e ON p.uid = e.uid AND p.seg = e.seg WHERE p.i = 0 OR p.i = p.n - 1 OR {UNIFORM('p.seq', 48271)} > 0.1e0"


@query("augmented")
def augment_group(d):
    return f"SELECT seq, {d.r('x', 3)} AS x, {d.r('y', 3)} AS y, {d.r('t')} AS t FROM augmented"


@query("points")
def augment(d):
    """Thinning and jitter alone."""
    return f"SELECT seq, {d.r('x + 10e0*' + normal('seq', 16807, 39373), 3)} AS x, {d.r('y + 10e0*' + normal('seq', 40692, 12211), 3)} AS y FROM points WHERE i = 0 OR i = n - 1 OR {UNIFORM('seq', 48271)} > 0.1e0"


@query("passed")
def vertex_subsample(d):
    """Vertex sequences thinned by 0.15; those that would keep fewer than three vertices stay whole."""
    keep = f"{UNIFORM('uid*100003 + seg*1009 + i', 48271)} > 0.15e0"
    return f"SELECT uid, seg, i, id FROM (SELECT *, CASE WHEN {keep} THEN 1 ELSE 0 END AS kept, sum(CASE WHEN {keep} THEN 1 ELSE 0 END) OVER (PARTITION BY uid, seg) AS m FROM passed) AS q WHERE kept = 1 OR m < 3"


@query("passed")
def long_vertex_sequences(d):
    """Vertex sequences of four vertices or more."""
    return "SELECT uid, seg, i, id FROM (SELECT *, count(*) OVER (PARTITION BY uid, seg) AS m FROM passed) AS q WHERE m >= 4"


@query("passed")
def path_neighbours(d):
    """Each vertex of a sequence with the one before and the one after; -1 where there is none."""
    w = "OVER (PARTITION BY uid, seg ORDER BY i)"
    return f"SELECT uid, seg, i, coalesce(lag(id) {w}, -1) AS before, id, coalesce(lead(id) {w}, -1) AS after FROM passed"


@query("fixes")
def equator_metres(d):
    """Degrees as metres on the equator, whatever the latitude."""
    return f"SELECT seq, {d.r(f'{EARTH_M}*radians(lon)', 3)} AS x, {d.r(f'{EARTH_M}*radians(lat)', 3)} AS y FROM fixes"


@step("centred", "orientation_fit")
def framed(d):
    """The corpus's own frame: metres about the reference point, turned back by its orientation."""
    x, y = turned("c.x", "c.y", "-o.angle")
    return f"SELECT c.seq, c.uid, {x} AS x, {y} AS y FROM centred AS c CROSS JOIN orientation_fit AS o"


@query("framed")
def metric_frame(d):
    return f"SELECT seq, {d.r('x', 3)} AS x, {d.r('y', 3)} AS y FROM framed"


@query("framed")
def pseudo_lonlat(d):
    """The frame laid about (0, 0)."""
    lon, lat = to_lonlat("x", "y", "0e0", "0e0")
    return f"SELECT seq, {d.r(lon, 8)} AS lon, {d.r(lat, 8)} AS lat FROM framed"


@query("centred")
def move_city(d):
    """The whole corpus 5 km to the north-east and turned by 30 degrees."""
    x, y = turned("x", "y", repr(math.pi / 6))
    lon, lat = to_lonlat(f"{x} + 5000e0*sqrt(0.5e0)", f"{y} + 5000e0*sqrt(0.5e0)")
    return f"SELECT seq, {d.r(lon, 8)} AS lon, {d.r(lat, 8)} AS lat FROM centred"


@query("points")
def move_trips(d):
    """Each trip by 2 km in a direction of its own and turned by 20 degrees to a side of its own."""
    side, way = f"CASE WHEN {UNIFORM(TRIP, 69621)} < 0.5e0 THEN -1e0 ELSE 1e0 END", f"2e0*pi()*{UNIFORM(TRIP, 48271)}"
    x, y = turned("x", "y", f"{math.pi / 9!r}*s")
    lon, lat = to_lonlat(f"{x} + 2000e0*cos(w)", f"{y} + 2000e0*sin(w)", "mlon", "mlat")
    return f"SELECT seq, {d.r(lon, 8)} AS lon, {d.r(lat, 8)} AS lat FROM (SELECT *, {side} AS s, {way} AS w FROM points) AS q"


@query("centred")
def sweep_moves(d):
    """The corpus under every move of a sweep (km, degrees) in one pass: where its mean and its northernmost fix come to lie."""
    x, y = turned("c.x", "c.y", "radians(v.a)")
    moves = "(SELECT 0 AS move, 0e0 AS km, 0e0 AS a UNION ALL SELECT 1, 5e0, 0e0 UNION ALL SELECT 2, 0e0, 45e0 UNION ALL SELECT 3, 10e0, 90e0)"
    return f"SELECT v.move, {d.r(f'avg({x} + 1000e0*v.km)', 2)} AS x, {d.r(f'avg({y})', 2)} AS y, {d.r(f'max({y})', 2)} AS top FROM centred AS c CROSS JOIN {moves} AS v GROUP BY v.move"


@query("points", "targets")
def rotate_items(d):
    """Prefix points and target of each task item turned together by 40 degrees about the prefix's end, and the prefix laid back on the map."""
    x, y = turned("p.x - g.ax", "p.y - g.ay", repr(math.radians(40)))
    tx, ty = turned("g.tx - g.ax", "g.ty - g.ay", repr(math.radians(40)))
    lon, lat = to_lonlat(x, y, "p.mlon", "p.mlat")
    return f"SELECT p.seq, {d.r(lon, 8)} AS lon, {d.r(lat, 8)} AS lat, {d.r(tx, 3)} AS target_x, {d.r(ty, 3)} AS target_y FROM points AS p JOIN targets AS g ON p.uid = g.uid AND p.seg = g.seg WHERE p.i < g.k"


@query("targets")
def destination_error(d):
    """Of the prefix's end as a prediction of the destination: root mean square and mean distance."""
    return f"SELECT {d.r('sqrt(avg(power(tx - ax, 2) + power(ty - ay, 2)))', 3)} AS rmse, {d.r('avg(' + d.dist('tx - ax', 'ty - ay') + ')', 3)} AS mean_m, count(*) AS n FROM targets"
