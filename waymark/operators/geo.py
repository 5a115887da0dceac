"""Projection, group actions, frames and codes."""

from __future__ import annotations

import math

from ..functions.ladders import geometric, gpe_frequencies
from ..plans import EARTH_M, query, step
from .trips import UNIFORM

HARMONICS = (1, 2, 3, 4)
REF = (116.3975, 39.9087)


@query("points")
def enu_project(d):
    return f"SELECT seq, uid, seg, {d.r('x', 4)} AS x, {d.r('y', 4)} AS y FROM points"


@query("points")
def enu_inverse(d):
    return f"SELECT seq, {d.r(f'mlon + degrees(x/({EARTH_M}*cos(radians(mlat))))', 8)} AS lon, {d.r(f'mlat + degrees(y/{EARTH_M})', 8)} AS lat FROM points"


@query("points")
def group_action(d):
    """Turn by 0.5 rad about the trip's mean, shift by (100, -50) m, and an hour later."""
    c, s = math.cos(0.5), math.sin(0.5)
    return f"SELECT seq, {d.r(f'{c!r}*x - {s!r}*y + 100e0', 4)} AS x, {d.r(f'{s!r}*x + {c!r}*y - 50e0', 4)} AS y, {d.r('t + 1e0')} AS t FROM points"


@query("points")
def relocate_lat(d):
    return f"SELECT seq, {d.r(f'10e0 + degrees(x/({EARTH_M}*cos(radians(60e0))))', 8)} AS lon, {d.r(f'60e0 + degrees(y/{EARTH_M})', 8)} AS lat, {d.r('cos(radians(60e0))/cos(radians(mlat))', 8)} AS stretch FROM points"


@step("fixes")
def centred(d):
    """The whole corpus in metres about its reference point."""
    return f"SELECT uid, seq, t, lon, lat, {EARTH_M}*radians(lon - {REF[0]}e0)*cos(radians({REF[1]}e0)) AS x, {EARTH_M}*radians(lat - {REF[1]}e0) AS y FROM fixes"


@query("centred")
def relocate_rotate_shift(d):
    """The corpus turned by 30 degrees and moved to 50 degrees north, then 20 km east."""
    c, s = math.cos(math.radians(30)), math.sin(math.radians(30))
    return f"SELECT seq, {d.r(f'{REF[0]}e0 + degrees(({c!r}*x - {s!r}*y + 20000e0)/({EARTH_M}*cos(radians(50e0))))', 8)} AS lon, {d.r(f'50e0 + degrees(({s!r}*x + {c!r}*y)/{EARTH_M})', 8)} AS lat FROM centred"


@query("fixes")
def space_shift(d):
    return f"SELECT f.seq, {d.r('12e0 + (f.lon - b.x0)/greatest(b.x1 - b.x0, 1e-9)*0.3e0', 8)} AS lon, {d.r('41.8e0 + (f.lat - b.y0)/greatest(b.y1 - b.y0, 1e-9)*0.2e0', 8)} AS lat FROM fixes AS f CROSS JOIN (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM fixes) AS b"


@query("points")
def rigid_sweep(d):
    """Mean drift of the torus phase (1 km) over a sweep of eastward shifts."""
    return f"SELECT v.v_i, {d.r('v.v')} AS shift_m, {d.r('avg(sqrt(power(sin(2e0*pi()*(p.x + v.v)/1000e0) - sin(2e0*pi()*p.x/1000e0), 2) + power(cos(2e0*pi()*(p.x + v.v)/1000e0) - cos(2e0*pi()*p.x/1000e0), 2)))')} AS drift FROM points AS p CROSS JOIN {d.values('v', [0.0, 50.0, 125.0, 250.0, 500.0, 1000.0])} AS v GROUP BY v.v_i, v.v"


@query("trips")
def city_anchor(d):
    """The nearest anchor within 75 km by haversine, else the trip's mean."""
    return f"""SELECT uid, seg, CASE WHEN km <= 75e0 THEN city ELSE 'none' END AS city, {d.r('km', 4)} AS km FROM (SELECT uid, seg, min_by(city, km) AS city, min(km) AS km FROM (SELECT m.uid, m.seg, a.city,
      2e0*{EARTH_M}/1000e0*asin(sqrt(power(sin(radians(a.lat - m.lat)/2), 2) + cos(radians(m.lat))*cos(radians(a.lat))*power(sin(radians(a.lon - m.lon)/2), 2))) AS km FROM (SELECT uid, seg, avg(lon) AS lon, avg(lat) AS lat FROM trips GROUP BY uid, seg) AS m
      CROSS JOIN (SELECT 'beijing' AS city, 116.3972e0 AS lon, 39.9075e0 AS lat UNION ALL SELECT 'porto', -8.6109e0, 41.1496e0 UNION ALL SELECT 'rome', 12.4922e0, 41.8902e0) AS a) AS h GROUP BY uid, seg) AS b"""


@query("fixes")
def frame_mean(d):
    return f"SELECT {d.r('avg(lon)')} AS lon, {d.r('avg(lat)')} AS lat, {d.r('min(lon)')} AS lon0, {d.r('max(lon)')} AS lon1, {d.r('min(lat)')} AS lat0, {d.r('max(lat)')} AS lat1, count(DISTINCT uid) AS users, count(*) AS n FROM fixes"


@step("steps")
def grid_fit(d):
    return "SELECT atan2(sum(r*sin(4e0*psi)), sum(r*cos(4e0*psi)))/4e0 AS angle, sqrt(power(sum(r*sin(4e0*psi)), 2) + power(sum(r*cos(4e0*psi)), 2))/sum(r) AS strength FROM steps WHERE r >= 5e0"


@query("grid_fit")
def grid_angle(d):
    return f"SELECT {d.r('angle')} AS angle, {d.r('strength')} AS strength FROM grid_fit"


@step("centred")
def pca_fit(d):
    """The principal axis, its heavy tail forward, and the isotropy of the cloud."""
    return f"""SELECT CASE WHEN avg(power((x - mx)*cos(a) + (y - my)*sin(a), 3)) < 0 THEN a + pi() ELSE a END AS angle, max(iso) AS iso FROM (SELECT c.x, c.y, m.mx, m.my, 0.5e0*atan2(2e0*m.cxy, m.cxx - m.cyy) AS a,
      (m.cxx + m.cyy - sqrt(power(m.cxx - m.cyy, 2) + 4e0*m.cxy*m.cxy))/(m.cxx + m.cyy + sqrt(power(m.cxx - m.cyy, 2) + 4e0*m.cxy*m.cxy)) AS iso
      FROM centred AS c CROSS JOIN (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS cxx, var_pop(y) AS cyy, covar_pop(x, y) AS cxy FROM centred) AS m) AS q GROUP BY a"""


@query("pca_fit")
def pca_angle(d):
    return f"SELECT {d.r('angle')} AS angle, {d.r('iso')} AS isotropy FROM pca_fit"


@step("grid_fit", "pca_fit")
def orientation_fit(d):
    """Of the four grid directions the one nearest the principal axis; the axis itself where the grid is weak."""
    return f"""SELECT CASE WHEN max(strength) < 0.02e0 THEN max(pca) ELSE min_by(a, gap) END AS angle FROM (SELECT g.strength, p.angle AS pca, g.angle + k.k*pi()/2e0 AS a,
      abs(atan2(sin(g.angle + k.k*pi()/2e0 - p.angle), cos(g.angle + k.k*pi()/2e0 - p.angle))) AS gap FROM grid_fit AS g CROSS JOIN pca_fit AS p CROSS JOIN {d.values('k', [0.0, 1.0, 2.0, 3.0])} AS k) AS q"""


@query("orientation_fit")
def orientation_choice(d):
    return f"SELECT {d.r('angle')} AS angle FROM orientation_fit"


@query("centred")
def occupancy_grid(d):
    return f"SELECT {d.floor('x/500e0')} AS cx, {d.floor('y/500e0')} AS cy, count(*) AS n FROM centred GROUP BY {d.floor('x/500e0')}, {d.floor('y/500e0')}"


@query("centred")
def low_density_cell(d):
    return f"""SELECT s.s_i, {d.r('s.s')} AS severity, c.cx, c.cy FROM {d.values('s', [0.0, 0.5, 1.0])} AS s JOIN (SELECT cx, cy, row_number() OVER (ORDER BY n, cx, cy) - 1 AS k, count(*) OVER () AS m FROM (SELECT {d.floor('x/500e0')} AS cx, {d.floor('y/500e0')} AS cy, count(*) AS n
      FROM centred GROUP BY {d.floor('x/500e0')}, {d.floor('y/500e0')}) AS g) AS c ON c.k = {d.trunc(d.clip('(1e0 - s.s)*0.5e0', '0e0', '0.99e0') + '*(c.m - 1)')}"""


def sines(value, scales, by="2e0*pi()/"):
    """sin and cos of a value at each scale, interleaved."""
    return [f"{f}({by}{x!r}*({value}))" for x in scales for f in ("sin", "cos")]


def coded(d, source, key, codes, where="1 = 1"):
    """One row for each row of source: key and the dimensions e0, e1, ... of its code, in one pass without a join."""
    return f"SELECT {key}, {', '.join(f'{d.r(x)} AS e{k}' for k, x in enumerate(codes))} FROM {source} WHERE {where}"


TORUS = geometric(200.0, 5000.0, 4)
RADIAL = geometric(50.0, 5000.0, 4)
GATE = "r/sqrt(r*r + 25e0)"


def torus_code(x="x", y="y"):
    return sines(x, TORUS) + sines(y, TORUS)


def disp_code(psi="psi"):
    """Radial ladder, and angular harmonics gated by r / hypot(r, 5 m)."""
    return sines("r", RADIAL) + [f"{GATE}*{f}({m}e0*({psi}))" for m in HARMONICS for f in ("sin", "cos")]


def speed_code():
    return sines("ln(1e0 + v)", geometric(0.1, 5.0, 4)) + sines("ln(1e0 + dth*3600e0)", geometric(0.1, 5.0, 4))


def time_code(d, t="t"):
    """All sines of the hour, its cosines, then those of the day of the week."""
    hour, dow = d.mod(t, "24e0"), d.mod(f"floor(({t})/24e0)", "7e0")
    return [f"{f}(2e0*pi()*{m}e0*{x}/{n}e0)" for x, n, ms in ((hour, 24, (1, 2, 3, 4)), (dow, 7, (1, 2, 3))) for f in ("sin", "cos") for m in ms]


@query("fixes")
def encode_gpe(d):
    """Longitude, then latitude, at all frequencies."""
    return coded(d, "fixes", "seq", sines("radians(lon)", gpe_frequencies(32), "") + sines("radians(lat)", gpe_frequencies(32), ""))


@query("points")
def encode_torus(d):
    return coded(d, "points", "seq", torus_code())


@query("points")
def encode_space2vec(d):
    """Three directions 120 degrees apart."""
    return coded(d, "points", "seq", [c for a in (0.0, 2 * math.pi / 3, 4 * math.pi / 3) for c in sines(f"{math.cos(a)!r}*x + {math.sin(a)!r}*y", geometric(50.0, 50000.0, 4))])


@query("steps")
def encode_disp(d):
    return coded(d, "steps", "seq", disp_code(), "r IS NOT NULL")


@query("steps")
def encode_radial(d):
    """The invariant part of the displacement code alone."""
    return coded(d, "steps", "seq", disp_code()[: 2 * len(RADIAL)], "r IS NOT NULL")


@query("steps")
def encode_speed(d):
    return coded(d, "steps", "seq", speed_code(), "r IS NOT NULL")


@query("fixes")
def encode_time(d):
    return coded(d, "fixes", "seq", time_code(d))


def token_code(d):
    """Place, displacement, speed and time together; what needs a step before is 0 in a trip's first row."""
    return torus_code() + [f"coalesce({x}, 0e0)" for x in disp_code() + speed_code()] + time_code(d)


@query("steps")
def tokens(d):
    return coded(d, "steps", "uid, seg, i", token_code(d))


@step("steps")
def token_rows(d):
    return f"SELECT uid, seg, i, {', '.join(f'{x} AS e{k}' for k, x in enumerate(token_code(d)))} FROM steps"


@query("token_rows")
def pooled_tokens(d):
    """Mean and deviation of every dimension over each trip."""
    n = len(token_code(d))
    return f"SELECT uid, seg, {', '.join(f'{d.r(f"avg(e{k})")} AS m{k}' for k in range(n))}, {', '.join(f'{d.r(f"sqrt(greatest(avg(e{k}*e{k}) - avg(e{k})*avg(e{k}), 0e0))", 5)} AS s{k}' for k in range(n))} FROM token_rows GROUP BY uid, seg"


@query("token_rows")
def standardised_tokens(d):
    """Every dimension by its mean and deviation over the whole corpus; the moments are one row, joined back."""
    n = len(token_code(d))
    moments = ", ".join(f"avg(e{k}) AS m{k}, sqrt(greatest(avg(e{k}*e{k}) - avg(e{k})*avg(e{k}), 0e0)) + 1e-6 AS s{k}" for k in range(n))
    return f"SELECT t.uid, t.seg, t.i, {', '.join(f'{d.r(f"(t.e{k} - m.m{k})/m.s{k}", 4)} AS z{k}' for k in range(n))} FROM token_rows AS t CROSS JOIN (SELECT {moments} FROM token_rows) AS m"


@query("fixes")
def raw_xy_minmax(d):
    return f"SELECT f.seq, {d.r('(f.lon - b.x0)/greatest(b.x1 - b.x0, 1e-9)')} AS x, {d.r('(f.lat - b.y0)/greatest(b.y1 - b.y0, 1e-9)')} AS y FROM fixes AS f CROSS JOIN (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM fixes) AS b"


@query("centred")
def grid_embed(d):
    return f"SELECT seq, {d.r('floor(x/150e0)*150e0/1000e0')} AS x_km, {d.r('floor(y/150e0)*150e0/1000e0')} AS y_km FROM centred"


@step("centred")
def patchwork_tiles(d):
    return f"SELECT tx, ty, {d.clip('1e0/sqrt(n/4e6 + 1e-12)', '100e0', '5000e0')} AS lam FROM (SELECT {d.floor('x/2000e0')} AS tx, {d.floor('y/2000e0')} AS ty, count(*) AS n FROM centred GROUP BY {d.floor('x/2000e0')}, {d.floor('y/2000e0')}) AS g"


@query("patchwork_tiles")
def patchwork_scales(d):
    """A wavelength for each 2 km tile from its density; the median is the default."""
    return f"SELECT t.tx, t.ty, {d.r('t.lam', 4)} AS lam, {d.r('m.lam', 4)} AS lam_default FROM patchwork_tiles AS t CROSS JOIN (SELECT median(lam) AS lam FROM patchwork_tiles) AS m"


@query("centred", "patchwork_tiles")
def encode_patchwork(d):
    """Tile and two harmonics of the place at its tile's wavelength; where no tile is known, at the default."""
    lam = "coalesce(p.lam, (SELECT median(lam) FROM patchwork_tiles))"
    codes = [f"{f}(2e0*pi()*{m}e0*{v}/q.lam)" for v in "xy" for m in (1, 2) for f in ("sin", "cos")]
    return f"SELECT seq, tx, ty, {', '.join(f'{d.r(x)} AS e{k}' for k, x in enumerate(codes))} FROM (SELECT c.seq, c.x, c.y, c.tx, c.ty, {lam} AS lam FROM (SELECT *, {d.floor('x/2000e0')} AS tx, {d.floor('y/2000e0')} AS ty FROM centred) AS c LEFT JOIN patchwork_tiles AS p ON c.tx = p.tx AND c.ty = p.ty) AS q"


@step("points")
def torus(d):
    """Tokens of 16 by 16 phases of a 1 km torus; places are taken to the micrometre, so that no engine's last bit decides."""
    bx, by = (d.mod(d.floor(d.mod(f"{v}/1000e0", "1e0") + "*16"), "16") for v in "xy")
    return f"SELECT uid, seg, seq, x, y, {bx}*16 + {by} AS token FROM (SELECT uid, seg, seq, round(x, 6) + 0e0 AS x, round(y, 6) + 0e0 AS y FROM points) AS p"


@query("torus")
def torus_tokens(d):
    return "SELECT seq, token FROM torus"


@query("torus")
def token_perplexity(d):
    return f"SELECT {d.r('exp(-sum(p*ln(p)))')} AS perplexity, count(*) AS used FROM (SELECT count(*)/CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM torus GROUP BY token) AS q"


@query("torus")
def permutation_agreement(d):
    """Measured against predicted agreement of shifted tokens, over eastward shifts of the lattice (16 bins of 62.5 m)."""
    moved = d.mod(d.floor(d.mod("(t.x + v.v)/1000e0", "1e0") + "*16"), "16")
    predicted = d.mod(f"{d.floor('t.token/16e0')} + {d.half_even('v.v/62.5e0')}", "16")
    return f"SELECT v.v_i, {d.r('v.v')} AS shift_m, {d.r(f'avg(CASE WHEN {moved} = {predicted} THEN 1e0 ELSE 0e0 END)')} AS measured, {d.r('1e0 - abs(v.v/62.5e0 - ' + d.half_even('v.v/62.5e0') + ')')} AS predicted FROM torus AS t CROSS JOIN {d.values('v', [31.25, 46.875, 62.5, 93.75, 125.0, 250.0])} AS v GROUP BY v.v_i, v.v"


@query("points")
def noise_saturation(d):
    """Mean cosine of 1 km torus codes under hash-seeded normal noise."""
    g = f"sqrt(-2e0*ln(greatest({UNIFORM('p.seq', 48271)}, 1e-12)))*cos(2e0*pi()*{UNIFORM('p.seq', 69621)})"
    return f"SELECT v.v_i, {d.r('v.v')} AS sigma, {d.r(f'avg(cos(2e0*pi()*v.v*{g}/1000e0))')} AS cosine FROM points AS p CROSS JOIN {d.values('v', [1.0, 5.0, 15.0, 50.0, 150.0])} AS v GROUP BY v.v_i, v.v"


@query("fixes")
def time_shift_audit(d):
    """The largest distance of shifted hour codes from turned ones: 0 for an exact representation."""
    h = "2e0*pi()*" + d.mod("t", "24e0") + "/24e0"
    s = "2e0*pi()*" + d.mod("t + v.v", "24e0") + "/24e0"
    return f"SELECT v.v_i, {d.r(f'max(abs(sin({s}) - (sin({h})*cos(2e0*pi()*v.v/24e0) + cos({h})*sin(2e0*pi()*v.v/24e0))))', 6)} AS error FROM fixes CROSS JOIN {d.values('v', [1.0, 5.0, 13.0])} AS v GROUP BY v.v_i"
