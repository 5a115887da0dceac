"""The anomaly protocol: injected trips, their features, nearest-neighbour scores and AUROC by kind.

A trip is replaced with probability RATE by a hash, and its kind follows from another hash, so no trip waits for a
rank over all. Clean reference trips are a bounded sample (of half of them REFERENCE, least by a hash); every other trip is scored
against them. Ranks over all trips are taken in buckets of the score: counts before a bucket come from one row for
each bucket, ranks within it from a window of its own.
"""

from __future__ import annotations

from ..plans import query, step
from .trips import UNIFORM

RATE, REFERENCE, NEAREST = 0.28, 256, 5
KINDS = ("detour", "kinematic", "wrong_time", "off_grid", "off_grid_control", "teleport", "unseen_area")
FEATURES = ("v_mean", "v_p85", "a_mean", "log_dist", "log_minutes", "rog", "cx", "cy", "hour_sin", "hour_cos")
TRIP = "uid*1000 + seg"


@step("placed")
def drawn(d):
    """Points with their trip's kind, ends, centre and clock."""
    kind = "CASE " + " ".join(f"WHEN b < {k + 1} THEN '{name}'" for k, name in enumerate(KINDS)) + " END"
    w = "OVER (PARTITION BY uid, seg)"
    return f"""SELECT uid, seg, i, n, t, x, y, CASE WHEN a < {RATE}e0 THEN {kind} ELSE 'normal' END AS kind, a, CASE WHEN s < 0.5e0 THEN -1e0 ELSE 1e0 END AS sign, mx, my, x0, x1, y0, y1, t0, t1, s
      FROM (SELECT uid, seg, i, n, t, x, y, {UNIFORM(TRIP, 48271)} AS a, {len(KINDS)}e0*{UNIFORM(TRIP, 69621)} AS b, {UNIFORM(TRIP, 16807)} AS s, avg(x) {w} AS mx, avg(y) {w} AS my, min(t) {w} AS t0, max(t) {w} AS t1,
        min_by(x, i) {w} AS x0, max_by(x, i) {w} AS x1, min_by(y, i) {w} AS y0, max_by(y, i) {w} AS y1 FROM placed) AS q"""


@step("centred")
def rare_cell(d):
    """The occupied 500 m cell with the fewest fixes."""
    return f"SELECT cx, cy FROM (SELECT {d.floor('x/500e0')} AS cx, {d.floor('y/500e0')} AS cy, count(*) AS n FROM centred GROUP BY {d.floor('x/500e0')}, {d.floor('y/500e0')}) AS g ORDER BY n, cx, cy LIMIT 1"


@step("drawn", "rare_cell")
def injected(d):
    """Points after the injection of their trip's kind; severity 1."""
    bump, half = "0.35e0*sign*sin(pi()*i/greatest(n - 1e0, 1e0))", "sqrt(0.5e0)"
    x = f"CASE kind WHEN 'detour' THEN CASE WHEN n >= 5 THEN x - {bump}*(y1 - y0) ELSE x END WHEN 'off_grid' THEN mx + ((x - mx) - (y - my))*{half} WHEN 'off_grid_control' THEN mx - (y - my) WHEN 'teleport' THEN CASE WHEN n >= 6 AND i >= n/4e0 + s*n/2e0 THEN x + 5000e0 ELSE x END WHEN 'unseen_area' THEN x - mx + (rx + 0.5e0)*500e0 ELSE x END"
    y = f"CASE kind WHEN 'detour' THEN CASE WHEN n >= 5 THEN y + {bump}*(x1 - x0) ELSE y END WHEN 'off_grid' THEN my + ((x - mx) + (y - my))*{half} WHEN 'off_grid_control' THEN my + (x - mx) WHEN 'teleport' THEN CASE WHEN n >= 6 AND i >= n/4e0 + s*n/2e0 THEN y - 3000e0 ELSE y END WHEN 'unseen_area' THEN y - my + (ry + 0.5e0)*500e0 ELSE y END"
    t = f"CASE kind WHEN 'kinematic' THEN CASE WHEN n >= 4 THEN t0 + (t1 - t0)*power((t - t0)/greatest(t1 - t0, 1e-9), 3) ELSE t END WHEN 'wrong_time' THEN t - {d.mod('t0', '24e0')} + 3e0 + 3e0*(s - 0.5e0) ELSE t END"
    return f"SELECT uid, seg, i, n, kind, a, s, {x} AS x, {y} AS y, {t} AS t FROM (SELECT d.*, c.cx AS rx, c.cy AS ry FROM drawn AS d CROSS JOIN rare_cell AS c) AS q"


@query("injected")
def anomaly_set(d):
    """Every point of the set as it is after injection."""
    return f"SELECT uid, seg, i, kind, {d.r('x', 3)} AS x, {d.r('y', 3)} AS y, {d.r('t')} AS t FROM injected"


@query("drawn")
def anomaly_counts(d):
    return "SELECT kind, count(*) AS n FROM (SELECT DISTINCT uid, seg, kind FROM drawn) AS q GROUP BY kind"


@step("injected")
def trip_shapes(d):
    """What is told apart by: speeds, lengths, place and hour of each trip."""
    w = "OVER (PARTITION BY uid, seg ORDER BY i)"
    hour = f"2e0*pi()*({d.mod('min(t)', '24e0')})/24e0"
    return f"""SELECT uid, seg, kind, a, s, avg(v) AS v_mean, {d.pct('v', 0.85)} AS v_p85, coalesce(avg(abs(v - pv)/greatest(dth*3600e0, 1e-6)), 0e0) AS a_mean, ln(1e0 + sum(r)) AS log_dist, ln(1e0 + (max(t) - min(t))*60e0) AS log_minutes,
      sqrt(var_pop(x) + var_pop(y)) AS rog, avg(x) AS cx, avg(y) AS cy, sin({hour}) AS hour_sin, cos({hour}) AS hour_cos, sum(r) AS path_m, max(t) - min(t) AS hours, (max(x) - min(x))*(max(y) - min(y)) AS area, min(t) AS t0
      FROM (SELECT *, lag(v) {w} AS pv FROM (SELECT *, r/greatest(dth*3600e0, 1e-6) AS v FROM (SELECT *, {d.dist(f'x - lag(x) {w}', f'y - lag(y) {w}')} AS r, t - lag(t) {w} AS dth FROM injected) AS e) AS f) AS g GROUP BY uid, seg, kind, a, s"""


@step("trip_shapes")
def clean(d):
    """The reference trips: a bounded sample of a half of the normal ones."""
    return f"SELECT * FROM trip_shapes WHERE kind = 'normal' AND s < 0.5e0 ORDER BY a, uid, seg LIMIT {REFERENCE}"


@step("trip_shapes", "clean")
def scored(d):
    """The mean distance of each other trip from the nearest reference trips, all features by the references' means and deviations."""
    moments = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) + 1e-9 AS s_{f}" for f in FEATURES)
    gap = " + ".join(f"power((q.{f} - p.{f})/m.s_{f}, 2)" for f in FEATURES)
    return f"""SELECT uid, seg, kind, round(avg(dist), 9) AS score FROM (SELECT q.uid, q.seg, q.kind, sqrt({gap}) AS dist, row_number() OVER (PARTITION BY q.uid, q.seg ORDER BY {gap}, p.uid, p.seg) AS k
      FROM (SELECT * FROM trip_shapes AS o WHERE NOT EXISTS (SELECT 1 FROM clean AS c WHERE c.uid = o.uid AND c.seg = o.seg)) AS q CROSS JOIN clean AS p CROSS JOIN (SELECT {moments} FROM clean) AS m) AS n WHERE k <= {NEAREST} GROUP BY uid, seg, kind"""


@query("scored")
def knn_anomaly_score(d):
    return f"SELECT uid, seg, kind, {d.r('score', 5)} AS score FROM scored"


@step("scored")
def aurocs(d):
    """Of each kind against the normal trips, and of all kinds; a tie counts half."""
    return f"""SELECT type, sum(below)/(count(*)*max(nn)) AS auroc, CAST(count(*) AS DOUBLE) AS np, max(nn) AS nn FROM (SELECT CASE WHEN g.g = 0 THEN s.kind ELSE 'all' END AS type, s.kind, s.before + s.at_most - 0.5e0*s.tied AS below, CAST(s.nn AS DOUBLE) AS nn
      FROM (SELECT b.kind, c.before, c.nn, sum(b.normal) OVER (PARTITION BY b.bucket ORDER BY b.score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_most, sum(b.normal) OVER (PARTITION BY b.bucket, b.score) AS tied
        FROM (SELECT kind, score, CASE WHEN kind = 'normal' THEN 1 ELSE 0 END AS normal, {d.floor('least(score*20e0, 20000e0)')} AS bucket FROM scored) AS b
        JOIN (SELECT bucket, sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before, sum(n) OVER () AS nn FROM (SELECT {d.floor('least(score*20e0, 20000e0)')} AS bucket, sum(CASE WHEN kind = 'normal' THEN 1 ELSE 0 END) AS n FROM scored GROUP BY {d.floor('least(score*20e0, 20000e0)')}) AS h) AS c
        ON b.bucket = c.bucket) AS s CROSS JOIN (SELECT 0 AS g UNION ALL SELECT 1) AS g WHERE s.kind <> 'normal' AND s.nn > 0) AS u GROUP BY type"""


@query("aurocs")
def auroc_by_type(d):
    return f"SELECT type, {d.r('auroc', 5)} AS auroc, CAST(np AS BIGINT) AS positives FROM aurocs"


@query("aurocs")
def hanley_mcneil(d):
    """The standard error, and whether the kind is told apart by more than two of them."""
    a = "auroc"
    se = f"sqrt(greatest({a}*(1 - {a}) + (np - 1)*({a}/(2 - {a}) - {a}*{a}) + (nn - 1)*(2*{a}*{a}/(1 + {a}) - {a}*{a}), 0e0)/(np*nn))"
    return f"SELECT type, {d.r(se, 5)} AS se, CASE WHEN abs({a} - 0.5e0) <= 2*{se} THEN 'inconclusive' WHEN {a} > 0.5e0 THEN 'held' ELSE 'failed' END AS verdict FROM aurocs"


@query("trip_shapes")
def trivial_detectors(d):
    """Robust z of log path length, mean speed, duration and area; circular distance of the start hour. Medians are aggregates joined back."""
    names = ("len", "spd", "dur", "box")
    base = f"SELECT uid, seg, kind, ln(1e0 + path_m) AS len, ln(1e0 + v_mean) AS spd, ln(1e0 + hours) AS dur, ln(1e0 + area) AS box, 2e0*pi()*({d.mod('t0', '24e0')})/24e0 AS h FROM trip_shapes"
    middles = f"SELECT {', '.join(f'median({x}) AS m_{x}' for x in names)}, atan2(avg(sin(h)), avg(cos(h))) AS mh FROM ({base}) AS b"
    spreads = f"SELECT {', '.join(f'median(abs(b.{x} - m.m_{x})) AS d_{x}' for x in names)} FROM ({base}) AS b CROSS JOIN ({middles}) AS m"
    z = lambda x: d.r(f"abs(b.{x} - m.m_{x})/(1.4826e0*s.d_{x} + 1e-9)", 5)
    return f"SELECT b.uid, b.seg, b.kind, {', '.join(f'{z(x)} AS z_{x}' for x in names)}, {d.r('abs(atan2(sin(b.h - m.mh), cos(b.h - m.mh)))', 5)} AS hour_gap FROM ({base}) AS b CROSS JOIN ({middles}) AS m CROSS JOIN ({spreads}) AS s"
