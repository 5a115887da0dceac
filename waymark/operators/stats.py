"""Aggregations and statistics over trips."""

from __future__ import annotations

from ..plans import EARTH_M, query, step
from .geo import REF


@query("steps")
def step_features(d):
    return f"SELECT seq, {d.r('dx', 4)} AS dx, {d.r('dy', 4)} AS dy, {d.r('r', 4)} AS r, {d.r('psi')} AS psi, {d.r('v')} AS speed FROM steps WHERE r IS NOT NULL"


@step("steps")
def turns(d):
    return "SELECT *, abs(atan2(sin(psi - p), cos(psi - p))) AS turn, abs(v - pv)/greatest(dth*3600e0, 1e-6) AS acc FROM (SELECT *, lag(psi) OVER w AS p, lag(v) OVER w AS pv FROM steps WINDOW w AS (PARTITION BY uid, seg ORDER BY i)) AS q"


@query("turns")
def turn_angles(d):
    return f"SELECT seq, {d.r('turn')} AS turn FROM turns WHERE turn IS NOT NULL"


@query("turns")
def kinematic_features(d):
    return f"""SELECT uid, seg, {d.r('avg(v)')} AS v_mean, {d.r('median(v)')} AS v_median, {d.r(d.pct('v', 0.85))} AS v_p85, {d.r(d.pct('v', 0.95))} AS v_p95, {d.r('coalesce(avg(acc), 0)')} AS a_mean, {d.r('coalesce(' + d.pct('acc', 0.85) + ', 0)')} AS a_p85,
      {d.r('coalesce(sum(turn), 0)/greatest(sum(r), 1e0)', 9)} AS turn_per_m, {d.r('avg(CASE WHEN v < 0.5e0 THEN 1e0 ELSE 0e0 END)')} AS slow_share, {d.r('ln(1 + sum(r))')} AS log_dist, {d.r('ln(1 + (max(t) - min(t))*60)')} AS log_minutes FROM turns GROUP BY uid, seg"""


@step("points")
def cells(d):
    return f"SELECT uid, seg, -sum(c/CAST(n AS DOUBLE)*ln(c/CAST(n AS DOUBLE) + 1e-12)) AS entropy FROM (SELECT uid, seg, n, count(*) AS c FROM points GROUP BY uid, seg, n, {d.floor('x/200e0')}, {d.floor('y/200e0')}) AS g GROUP BY uid, seg"


@query("cells")
def cell_entropy(d):
    return f"SELECT uid, seg, {d.r('entropy')} AS entropy FROM cells"


@query("steps", "cells")
def mobility_stats(d):
    """Radius of gyration, visit entropy, distance, mean step, heading and distance of the centre from the corpus's reference point of each trip."""
    centre = d.dist(f"{EARTH_M}*radians(avg(lon) - {REF[0]}e0)*cos(radians({REF[1]}e0))", f"{EARTH_M}*radians(avg(lat) - {REF[1]}e0)")
    return f"""SELECT s.uid, s.seg, {d.r('s.rog', 4)} AS radius_of_gyration, {d.r('c.entropy')} AS entropy, {d.r('s.dist', 4)} AS total_distance, {d.r('s.step', 4)} AS mean_step, {d.r('s.dur')} AS duration_h, {d.r('s.centre', 4)} AS centroid_dist,
      {d.r('s.nx/(' + d.dist('s.nx', 's.ny') + ' + 1e-9)')} AS heading_cos, {d.r('s.ny/(' + d.dist('s.nx', 's.ny') + ' + 1e-9)')} AS heading_sin
      FROM (SELECT uid, seg, sqrt(avg(x*x + y*y)) AS rog, sum(r) AS dist, avg(r) AS step, max(t) - min(t) AS dur, max_by(x, i) - min_by(x, i) AS nx, max_by(y, i) - min_by(y, i) AS ny, {centre} AS centre FROM steps GROUP BY uid, seg) AS s JOIN cells AS c ON s.uid = c.uid AND s.seg = c.seg"""


@query("fixes")
def hour_histogram(d):
    return f"SELECT {d.floor(d.mod('t', '24e0'))} AS hour, count(*) AS n FROM fixes GROUP BY {d.floor(d.mod('t', '24e0'))}"


@query("fixes")
def dow_profile(d):
    """Days of the week from Thursday = 0."""
    day = d.mod(d.floor("t/24e0"), "7")
    return f"SELECT {day} AS dow, label, count(*) AS n FROM fixes GROUP BY {day}, label"


@query("steps")
def corpus_inspect(d):
    return f"SELECT count(*) AS fixes, count(DISTINCT uid) AS users, {d.r('median(r)', 4)} AS step_p50, {d.r(d.pct('r', 0.95), 4)} AS step_p95, {d.r('median(dth)')} AS gap_p50, {d.r(d.pct('dth', 0.95))} AS gap_p95, {d.r('max(x) - min(x)', 4)} AS extent_x, {d.r('max(y) - min(y)', 4)} AS extent_y FROM steps"


@query("steps")
def heading_residual(d):
    """Circular residual of headings against the trip's own, by bins of step length with over 50 steps."""
    return f"""SELECT bin, count(*) AS n, {d.r('median(res)')} AS res_p50, {d.r(d.pct('res', 0.9))} AS res_p90 FROM (SELECT {d.floor(d.clip('r/500e0', '0e0', '5e0'))} AS bin, abs(atan2(sin(psi - h), cos(psi - h))) AS res FROM (SELECT r, psi, atan2(sum(dy) OVER (PARTITION BY uid, seg), sum(dx) OVER (PARTITION BY uid, seg)) AS h FROM steps) AS q WHERE r > 5e0) AS b GROUP BY bin HAVING count(*) > 50"""


@query("cells", "steps")
def eta_linear(d):
    """Least squares of duration on distance."""
    return f"SELECT {d.r('regr_slope(dur, dist)', 9)} AS slope, {d.r('regr_intercept(dur, dist)')} AS intercept, {d.r('regr_r2(dur, dist)', 9)} AS r2 FROM (SELECT sum(r)/1000e0 AS dist, max(t) - min(t) AS dur FROM steps GROUP BY uid, seg) AS q"


@query("steps")
def regression_metrics(d):
    """Of the mean as a prediction of duration: MAE, RMSE, and MAPE where the target is 1 or more."""
    return f"SELECT {d.r('avg(abs(y - m))')} AS mae, {d.r('sqrt(avg((y - m)*(y - m)))')} AS rmse, {d.r('avg(CASE WHEN y >= 1 THEN abs(y - m)/y END)')} AS mape FROM (SELECT y, m FROM (SELECT max(t) - min(t) AS y FROM steps GROUP BY uid, seg) AS q CROSS JOIN (SELECT avg(y) AS m FROM (SELECT max(t) - min(t) AS y FROM steps GROUP BY uid, seg) AS z) AS c) AS p"


@query("steps")
def degenerate_targets(d):
    return f"SELECT label, CASE WHEN stddev_pop(r)/(abs(avg(r)) + 1e-12) < 1e-3 THEN NULL ELSE {d.r('avg(r)', 4)} END AS mean_step FROM steps GROUP BY label"


@query("steps")
def grouping_sets(d):
    return f"SELECT label, count(*) AS n, {d.r('avg(r)', 4)} AS mean_step FROM steps WHERE r IS NOT NULL GROUP BY GROUPING SETS ((label), ())"


@query("points")
def ridge_moments(d):
    """The normal equations of a ridge probe (z-scored x, y to hour of day), ready to be solved."""
    return f"SELECT {d.r('sum(zx*zx) + 1')} AS xx, {d.r('sum(zx*zy)')} AS xy, {d.r('sum(zy*zy) + 1')} AS yy, {d.r('sum(zx*h)', 4)} AS xh, {d.r('sum(zy*h)', 4)} AS yh, count(*) + 1 AS nn FROM (SELECT (x - mx)/(sx + 1e-9) AS zx, (y - my)/(sy + 1e-9) AS zy, {d.mod('t', '24e0')} AS h FROM points CROSS JOIN (SELECT avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM points) AS s) AS q"


# ---- statistics over results: parts of a brand are runs of a method, its types are blocks


@step()
def measures(d):
    return "SELECT p_brand AS method, p_type AS block, avg(p_retailprice) AS value, count(*) AS n, stddev_samp(p_retailprice) AS sd FROM part GROUP BY p_brand, p_type"


@step("measures")
def block_ranks(d):
    return "SELECT *, rank() OVER (PARTITION BY block ORDER BY value DESC) + (count(*) OVER (PARTITION BY block, value) - 1)/2e0 AS rk FROM measures"


@query("block_ranks")
def cd_ranks(d):
    """Average ranks over blocks, wins, and Friedman's chi squared."""
    return f"SELECT method, {d.r('ar')} AS mean_rank, wins, {d.r('12e0*b/(k*(k + 1e0))*(sum(ar*ar) OVER () - k*(k + 1e0)*(k + 1e0)/4e0)', 4)} AS friedman FROM (SELECT method, avg(rk) AS ar, count(CASE WHEN rk = 1 THEN 1 END) AS wins, count(*) AS b, count(*) OVER () AS k FROM block_ranks GROUP BY method) AS q"


@query("measures")
def holm_adjust(d):
    """A running maximum of (m - rank + 1) p over the order of p."""
    return f"SELECT method, block, {d.r('least(1e0, max((m - k + 1)*p) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))')} AS p_adjusted FROM (SELECT *, row_number() OVER (ORDER BY p, method, block) AS k, count(*) OVER () AS m FROM (SELECT method, block, exp(-abs(value - avg(value) OVER (PARTITION BY block))/(stddev_pop(value) OVER (PARTITION BY block) + 1e-9)*3e0) AS p FROM measures) AS a) AS b"


@query("measures")
def spearman_rank(d):
    """Ranks without ties, in the order of method where values are equal."""
    ranks = "(SELECT method, block, CAST(row_number() OVER (PARTITION BY block ORDER BY value, method) AS DOUBLE) AS rk FROM measures)"
    return f"SELECT a.block AS a, b.block AS b, {d.r('corr(a.rk, b.rk)')} AS rho FROM {ranks} AS a JOIN {ranks} AS b ON a.method = b.method AND a.block < b.block GROUP BY a.block, b.block HAVING count(*) > 5"


@query("measures")
def paired_differences(d):
    """Two methods joined by block: mean difference, its t statistic and the wins."""
    return f"SELECT count(*) AS blocks, {d.r('avg(d)', 4)} AS mean_diff, {d.r('avg(d)/(stddev_samp(d)/sqrt(count(*)))')} AS t, count(CASE WHEN d > 0 THEN 1 END) AS wins FROM (SELECT a.value - b.value AS d FROM measures AS a JOIN measures AS b ON a.block = b.block WHERE a.method = 'Brand#11' AND b.method = 'Brand#12') AS q"


@query("measures")
def complete_blocks(d):
    return "SELECT method, block FROM (SELECT method, block, count(*) OVER (PARTITION BY method) AS c FROM measures) AS q WHERE c = (SELECT max(c) FROM (SELECT count(*) AS c FROM measures GROUP BY method) AS m)"


@query("measures")
def seed_means(d):
    return f"SELECT method, {d.r('avg(value)', 4)} AS mean, {d.r('stddev_pop(value)', 4)} AS sd, {d.r('min(value)', 4)} AS worst, min_by(block, value) AS worst_block, {d.r('100e0*(max(value) - min(value))/greatest(abs(min(value)), 1e-9)', 4)} AS change_pct FROM measures GROUP BY method"


@query("measures")
def marginals(d):
    return f"SELECT block, {d.r('avg(value)', 4)} AS mean, {d.r('max(value)', 4)} AS best, CAST(sum(n) AS BIGINT) AS n FROM measures GROUP BY block"


# ---- comparison of few methods: families of brands over types

#: The studentised range over the square root of two at 0.05 for 2 to 10 methods.
Q05 = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164}


@step()
def contest(d):
    return "SELECT substr(p_brand, 1, 7) AS method, p_type AS block, avg(p_retailprice) AS value FROM part GROUP BY substr(p_brand, 1, 7), p_type"


@step("contest")
def full_blocks(d):
    return "SELECT c.* FROM contest AS c JOIN (SELECT block FROM contest GROUP BY block HAVING count(*) = (SELECT count(DISTINCT method) FROM contest)) AS b ON c.block = b.block"


@step("full_blocks")
def mean_ranks(d):
    """Average rank over blocks, the critical difference, wins, blocks and methods."""
    q = "CASE k " + " ".join(f"WHEN {n} THEN {v}e0" for n, v in Q05.items()) + " END"
    return f"SELECT method, rank, wins, n, k, {q}*sqrt(k*(k + 1e0)/(6e0*n)) AS cd FROM (SELECT method, avg(rk) AS rank, count(CASE WHEN rk = 1 THEN 1 END) AS wins, count(*) AS n, count(*) OVER () AS k FROM (SELECT method, rank() OVER (PARTITION BY block ORDER BY value DESC) + (count(*) OVER (PARTITION BY block, value) - 1)/2e0 AS rk FROM full_blocks) AS r GROUP BY method) AS m"


@query("mean_ranks")
def critical_difference(d):
    return f"SELECT method, {d.r('rank')} AS mean_rank, wins, n AS blocks, {d.r('cd')} AS cd FROM mean_ranks"


@query("mean_ranks")
def rank_cliques(d):
    """Maximal runs of two methods or more, in the order of rank, that span no more than the critical difference."""
    spans = "SELECT a.rank AS lo, max(b.rank) AS hi, count(*) AS methods FROM mean_ranks AS a JOIN mean_ranks AS b ON b.rank >= a.rank AND b.rank - a.rank <= a.cd GROUP BY a.rank HAVING count(*) > 1"
    return f"SELECT {d.r('s.lo')} AS lo, {d.r('s.hi')} AS hi, s.methods FROM ({spans}) AS s WHERE NOT EXISTS (SELECT 1 FROM ({spans}) AS o WHERE o.lo < s.lo AND o.hi >= s.hi)"


@query("contest")
def improvements(d):
    """By how much the best method's mean beats each other's: in points, and in per cent where less is better."""
    means = "SELECT method, avg(value) AS v FROM contest GROUP BY method"
    return f"SELECT m.method, {d.r('b.v - m.v', 4)} AS points, {d.r('100e0*(b.v - m.v)/b.v', 4)} AS per_cent FROM ({means}) AS m CROSS JOIN (SELECT max(v) AS v FROM ({means}) AS x) AS b"


@query("measures")
def best_trials(d):
    """The five best runs."""
    return f"SELECT method, block, {d.r('value', 4)} AS value FROM measures ORDER BY value DESC, method, block LIMIT 5"


SPACE = {"h": (32, 64, 128), "lam_min": (60.0, 120.0), "k": (1, 2, 4, 8)}


def _space():
    rows = lambda name, xs: "(" + " UNION ALL ".join(f"SELECT {x!r} AS {name}" for x in xs) + ")"
    return " CROSS JOIN ".join(f"{rows(name, xs)} AS s_{name}" for name, xs in SPACE.items())


@step()
def trials(d):
    """All combinations of the search space, numbered in its order, without those that make no sense."""
    return f"SELECT CAST(row_number() OVER (ORDER BY h, lam_min, k) AS BIGINT) AS trial, h, CAST(lam_min AS DOUBLE) AS lam_min, k FROM {_space()} WHERE NOT (h = 32 AND k > 4)"


@query("trials")
def search_space(d):
    return "SELECT * FROM trials"


@query("trials")
def random_trials(d):
    """Seven of them, by a hash."""
    from .trips import UNIFORM

    return f"SELECT trial, h, lam_min, k FROM trials ORDER BY {UNIFORM('trial', 48271)}, trial LIMIT 7"
