"""Fixes to trips: sessions, windows, projection, steps, labels, filters, splits."""

from __future__ import annotations

from ..plans import EARTH_M, query, step

GAP_H, MIN_LEN, MAX_LEN, OVERLAP = 8.0, 5, 6, 2
STRIDE = max(MAX_LEN - OVERLAP, 1)


@step()
def fixes(d):
    return f"""SELECT user_id AS uid, event_id AS seq, event_type AS label, {d.hours('ts')} AS t,
      116.3975e0 + ((user_id*7919) % 2001 - 1000)*1e-4 + ((event_id*104729) % 2001 - 1000)*1e-5 AS lon,
      39.9087e0 + ((user_id*6287) % 2001 - 1000)*8e-5 + ((event_id*15485863) % 2001 - 1000)*1e-5 AS lat FROM events"""


@step("fixes")
def segmented(d):
    return f"""SELECT *, CAST(sum(CASE WHEN dt > {GAP_H}e0 THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS seg
      FROM (SELECT *, t - lag(t) OVER (PARTITION BY uid ORDER BY t, seq) AS dt FROM fixes) AS g"""


@step("segmented")
def trips(d):
    return f"""SELECT * FROM (SELECT uid, seg, seq, label, t, lon, lat, CAST(row_number() OVER (PARTITION BY uid, seg ORDER BY t, seq) - 1 AS BIGINT) AS i,
      count(*) OVER (PARTITION BY uid, seg) AS n FROM segmented) AS s WHERE n >= {MIN_LEN}"""


@step("trips")
def points(d):
    """Metres east and north of the trip's mean."""
    return f"""SELECT *, {EARTH_M}*radians(lon - mlon)*cos(radians(mlat)) AS x, {EARTH_M}*radians(lat - mlat) AS y
      FROM (SELECT *, avg(lon) OVER (PARTITION BY uid, seg) AS mlon, avg(lat) OVER (PARTITION BY uid, seg) AS mlat FROM trips) AS m"""


@step("points")
def steps(d):
    return f"""SELECT *, {d.dist('dx', 'dy')} AS r, atan2(dy, dx) AS psi, {d.dist('dx', 'dy')}/greatest(dth*3600e0, 1e-6) AS v
      FROM (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, t - lag(t) OVER w AS dth FROM points WINDOW w AS (PARTITION BY uid, seg ORDER BY i)) AS l"""


@step("trips")
def trip_rows(d):
    return "SELECT uid, seg, count(*) AS n, min(t) AS t0, max(t) AS t1, min_by(label, i) AS label FROM trips GROUP BY uid, seg"


@query("trip_rows")
def trip_sessions(d):
    return f"SELECT uid, seg, n, {d.r('t0')} AS t0, {d.r('t1')} AS t1 FROM trip_rows"


@query("trips")
def trip_windows(d):
    """Windows in strides; where the last of them ends before the trip does, one more that ends with it."""
    return f"""SELECT t.uid, t.seg, w.s AS start_i, count(*) AS n, {d.r('min(t.t)')} AS t0, {d.r('max(t.t)')} AS t1 FROM trips AS t
      JOIN (SELECT uid, seg, {d.series(0, f'greatest(n - {MIN_LEN}, 0)', STRIDE)} AS s FROM (SELECT DISTINCT uid, seg, n FROM trips) AS k
        UNION ALL SELECT DISTINCT uid, seg, n - {MAX_LEN} AS s FROM trips WHERE n > {MAX_LEN} AND (n - {MIN_LEN}) % {STRIDE} + {MIN_LEN} > {MAX_LEN}) AS w
      ON t.uid = w.uid AND t.seg = w.seg AND t.i >= w.s AND t.i < w.s + {MAX_LEN} GROUP BY t.uid, t.seg, w.s HAVING count(*) >= {MIN_LEN}"""


@query("fixes")
def dedup_same_instant(d):
    return f"SELECT uid, seq, {d.r('t')} AS t FROM (SELECT *, lag(t) OVER (PARTITION BY uid ORDER BY t, seq) AS p FROM fixes) AS f WHERE p IS NULL OR t > p"


@query("fixes")
def speed_cut_sessions(d):
    """A gap or an impossible speed cuts (here 0.5 km/h, as the fixes are sparse)."""
    return f"""SELECT uid, seg, count(*) AS n FROM (SELECT uid, CAST(sum(CASE WHEN dt > {GAP_H}e0 OR km/greatest(dt, 1e-9) > 0.5e0 THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS seg
      FROM (SELECT uid, seq, t, dt, {d.dist('x - lag(x) OVER w', 'y - lag(y) OVER w')}/1000e0 AS km FROM (SELECT *, t - lag(t) OVER (PARTITION BY uid ORDER BY t, seq) AS dt,
        {EARTH_M}*radians(lon - avg(lon) OVER (PARTITION BY uid))*cos(radians(avg(lat) OVER (PARTITION BY uid))) AS x, {EARTH_M}*radians(lat - avg(lat) OVER (PARTITION BY uid)) AS y FROM fixes) AS p WINDOW w AS (PARTITION BY uid ORDER BY t, seq)) AS k) AS c
      GROUP BY uid, seg HAVING count(*) >= 2"""


@query("fixes", "trip_rows")
def label_overlap_join(d):
    """The span with the largest overlap labels a trip if it covers over half of it; the first span wins ties."""
    return f"""SELECT p.uid, p.seg, b.lab FROM trip_rows AS p LEFT JOIN (SELECT uid, seg, lab FROM (SELECT q.uid, q.seg, s.lab, row_number() OVER (PARTITION BY q.uid, q.seg ORDER BY least(q.t1, s.s1) - greatest(q.t0, s.s0) DESC, s.ord) AS k,
      least(q.t1, s.s1) - greatest(q.t0, s.s0) AS o, q.t1 - q.t0 AS len FROM trip_rows AS q JOIN (SELECT uid, t AS s0, t + 6e0 AS s1, label AS lab, seq AS ord FROM fixes WHERE label IN ('view', 'click')) AS s
      ON q.uid = s.uid AND s.s0 < q.t1 AND s.s1 > q.t0) AS o WHERE k = 1 AND o > 0.5e0*greatest(len, 1e-9)) AS b ON p.uid = b.uid AND p.seg = b.seg"""


@query("trips")
def bbox_filter(d):
    return "SELECT uid, seg, count(*) AS n FROM trips GROUP BY uid, seg HAVING avg(CASE WHEN lon BETWEEN 116.35e0 AND 116.45e0 AND lat BETWEEN 39.85e0 AND 39.95e0 THEN 1e0 ELSE 0e0 END) >= 0.9e0"


@query("points")
def consecutive_cell_dedup(d):
    return f"SELECT uid, seg, i, cx, cy FROM (SELECT uid, seg, i, cx, cy, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM (SELECT uid, seg, i, {d.floor('x/400e0')} AS cx, {d.floor('y/400e0')} AS cy FROM points) AS c WINDOW w AS (PARTITION BY uid, seg ORDER BY i)) AS p WHERE px IS NULL OR px <> cx OR py <> cy"


@query("trip_rows")
def duration_filter(d):
    return f"SELECT uid, seg, {d.r('(t1 - t0)*60')} AS minutes FROM trip_rows WHERE (t1 - t0)*60 BETWEEN 0.5e0 AND 600e0 AND label <> 'other'"


@query("trips")
def odd_even_split(d):
    return f"SELECT uid, seg, i % 2 AS half, count(*) AS n, {d.r('avg(lon)', 9)} AS lon, {d.r('avg(lat)', 9)} AS lat FROM trips GROUP BY uid, seg, i % 2"


@step("points")
def targets(d):
    """The first 70 per cent of each trip: how many points, where they end, and where the trip does."""
    cut = d.trunc("0.7e0*n")
    return f"SELECT * FROM (SELECT uid, seg, max({cut}) AS k, max_by(x, i) AS tx, max_by(y, i) AS ty, max_by(x, CASE WHEN i < {cut} THEN i END) AS ax, max_by(y, CASE WHEN i < {cut} THEN i END) AS ay FROM points GROUP BY uid, seg) AS p WHERE k >= 3"


@query("targets")
def prefix_target(d):
    """The last point as target, in metres from the end of the first 70 per cent."""
    return f"SELECT uid, seg, k, {d.r('tx - ax')} AS target_x, {d.r('ty - ay')} AS target_y FROM targets"


@query("steps")
def resample_by_distance(d):
    """Equal steps of arc length with linear interpolation."""
    return f"""SELECT a.uid, a.seg, g.k, {d.r('a.x + (g.s - a.c)/greatest(a.c1 - a.c, 1e-12)*(a.x1 - a.x)', 4)} AS x, {d.r('a.y + (g.s - a.c)/greatest(a.c1 - a.c, 1e-12)*(a.y1 - a.y)', 4)} AS y
      FROM (SELECT uid, seg, x, y, c, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(c) OVER w AS c1 FROM (SELECT uid, seg, i, x, y, sum(coalesce(r, 0e0)) OVER (PARTITION BY uid, seg ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM steps) AS q WINDOW w AS (PARTITION BY uid, seg ORDER BY i)) AS a
      JOIN (SELECT uid, seg, k, (k + 0.5e0)*500e0 AS s FROM (SELECT uid, seg, {d.series(0, d.floor('len/500e0'))} AS k FROM (SELECT uid, seg, sum(r) AS len FROM steps GROUP BY uid, seg HAVING sum(r) >= 2500e0) AS l) AS e) AS g
      ON a.uid = g.uid AND a.seg = g.seg AND g.s >= a.c AND g.s < a.c1"""


@query("trips")
def index_resample(d):
    return f"SELECT t.uid, t.seg, k.j, t.seq FROM trips AS t JOIN (SELECT uid, seg, n, {d.series(0, 3)} AS j FROM (SELECT DISTINCT uid, seg, n FROM trips) AS u) AS k ON t.uid = k.uid AND t.seg = k.seg AND t.i = {d.trunc('(n - 1)*k.j/3e0'.replace('n -', 'k.n -'))}"


@query("trips")
def drop_points(d):
    """Hash-seeded thinning; ends stay."""
    return f"SELECT uid, seg, seq FROM trips WHERE i = 0 OR i = n - 1 OR {UNIFORM('seq', 48271)} > 0.1e0"


def hash_ranks(d, source, *keys):
    """source with k, the rank by h (a number from 0 to 1) and keys, and m, the number of rows: counted in 1,000 buckets, ranked within each."""
    b = d.floor("least(h*1000e0, 999e0)")
    return f"""SELECT s.*, CAST(c.before + row_number() OVER (PARTITION BY s.b ORDER BY s.h, {', '.join('s.' + x for x in keys)}) AS BIGINT) AS k, CAST(c.m AS BIGINT) AS m FROM (SELECT *, {b} AS b FROM ({source}) AS x) AS s
      JOIN (SELECT b, sum(n) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before, sum(n) OVER () AS m FROM (SELECT {b} AS b, count(*) AS n FROM ({source}) AS y GROUP BY {b}) AS g) AS c ON s.b = c.b"""


def UNIFORM(key, m):  # noqa: N802  a portable pseudo-random number from an integer
    return f"(CAST(((((CAST({key} AS BIGINT) % 2147483648)*1103515245 + 12345) % 2147483648)*{m} + 7) % 2147483647 AS DOUBLE)/2147483647e0)"


@query("trip_rows")
def user_quota(d):
    return "SELECT uid, seg FROM (SELECT uid, seg, row_number() OVER (PARTITION BY uid ORDER BY t0, seg) AS k FROM trip_rows) AS q WHERE k <= 2"


@query("trip_rows")
def per_user_time_split(d):
    return f"""SELECT uid, seg, CASE WHEN k <= least(m - 1, greatest(1, {d.half_even('0.8e0*m')})) THEN 'train' ELSE 'test' END AS part
      FROM (SELECT uid, seg, row_number() OVER (PARTITION BY uid ORDER BY t0, seg) AS k, count(*) OVER (PARTITION BY uid) AS m FROM trip_rows) AS q"""


@query("trip_rows")
def day_split(d):
    return f"SELECT r.uid, r.seg, r.t0 <= c.cut AS train FROM trip_rows AS r CROSS JOIN (SELECT {d.pct('t0', 0.8)} AS cut FROM trip_rows) AS c"


@query("trip_rows")
def user_disjoint_split(d):
    """Users are ranked by a hash; the first 80 per cent train."""
    users = f"SELECT DISTINCT uid, {UNIFORM('uid', 69621)} AS h FROM trip_rows"
    return f"SELECT r.uid, r.seg, u.k <= greatest({d.trunc('0.8e0*u.m')}, 1) AS train FROM trip_rows AS r JOIN ({hash_ranks(d, users, 'uid')}) AS u ON r.uid = u.uid"


@query("trip_rows")
def last_n_split(d):
    """The last 50 trips are the test; the rest by an anti join, so that nothing but those 50 is sorted in one place."""
    return "SELECT r.uid, r.seg, l.uid IS NOT NULL AS test FROM trip_rows AS r LEFT JOIN (SELECT uid, seg FROM trip_rows ORDER BY t0 DESC, uid DESC, seg DESC LIMIT 50) AS l ON r.uid = l.uid AND r.seg = l.seg"


@query("trip_rows")
def min_trips_semijoin(d):
    return "SELECT uid, seg FROM trip_rows AS r WHERE EXISTS (SELECT 1 FROM (SELECT uid FROM trip_rows GROUP BY uid HAVING count(*) >= 3) AS k WHERE k.uid = r.uid)"


@query("trip_rows")
def seen_users_semijoin(d):
    """The trips after the 80th percentile of starts whose user has one before it."""
    cut = f"CROSS JOIN (SELECT {d.pct('t0', 0.8)} AS cut FROM trip_rows) AS c"
    return f"SELECT r.uid, r.seg FROM trip_rows AS r {cut} WHERE r.t0 > c.cut AND EXISTS (SELECT 1 FROM (SELECT s.uid FROM trip_rows AS s {cut} WHERE s.t0 <= c.cut) AS p WHERE p.uid = r.uid)"


@query("trip_rows")
def resume_antijoin(d):
    return "SELECT uid, seg FROM trip_rows AS r WHERE NOT EXISTS (SELECT 1 FROM (SELECT uid, min(seg) AS seg FROM trip_rows GROUP BY uid) AS k WHERE k.uid = r.uid AND k.seg = r.seg)"


@query("trip_rows")
def tul_majority(d):
    return f"SELECT {d.r('CAST(max(c) AS DOUBLE)/sum(c)')} AS majority_share, {d.r('1e0/count(*)')} AS random_share, count(*) AS users FROM (SELECT uid, count(*) AS c FROM trip_rows GROUP BY uid) AS q"


# ---- more splits; every one by a hash of the key that must not be torn apart


@query("trip_rows")
def trip_split(d):
    """Whole trips by a hash: all windows of a trip stay together."""
    return f"SELECT uid, seg, {UNIFORM('uid*1000 + seg', 48271)} < 0.8e0 AS train FROM trip_rows"


@query("trips")
def window_split(d):
    """Windows follow their trip."""
    return f"SELECT seq, {UNIFORM('uid*1000 + seg', 48271)} < 0.8e0 AS train FROM trips"


@query("trip_rows")
def user_or_trip_split(d):
    """By user, and by trip where the user is unknown."""
    key = "CASE WHEN uid IS NULL THEN seg ELSE uid*1000003 END"
    return f"SELECT uid, seg, {UNIFORM(key, 69621)} < 0.8e0 AS train FROM trip_rows"


@query("trip_rows")
def capped_split(d):
    """A user split with at most 100 training and 50 test trips, those least by a hash."""
    half = lambda sign, n: f"(SELECT uid, seg, {sign} AS train FROM trip_rows WHERE ({UNIFORM('uid', 69621)} < 0.8e0) = {sign} ORDER BY {UNIFORM('uid*1000 + seg', 48271)}, uid, seg LIMIT {n})"
    return f"SELECT * FROM {half('true', 100)} AS a UNION ALL SELECT * FROM {half('false', 50)} AS b"


@query("trip_rows")
def index_split(d):
    """Item numbers of (trip, label) pairs, by the hash of the user."""
    return f"SELECT uid, seg, label, CASE WHEN {UNIFORM('uid', 16807)} < 0.7e0 THEN 'train' ELSE 'test' END AS part FROM trip_rows WHERE label IS NOT NULL"


@query("trip_rows")
def holdout_split(d):
    """A tenth of the training users is held out for validation."""
    return f"SELECT uid, seg, CASE WHEN {UNIFORM('uid', 69621)} >= 0.8e0 THEN 'test' WHEN {UNIFORM('uid', 16807)} < 0.1e0 THEN 'valid' ELSE 'train' END AS part FROM trip_rows"


@query("trip_rows")
def similarity_split(d):
    """The last 30 trips are the test, the 20 before them validate."""
    return f"SELECT r.uid, r.seg, CASE WHEN l.k <= 30 THEN 'test' WHEN l.k <= 50 THEN 'valid' ELSE 'train' END AS part FROM trip_rows AS r LEFT JOIN (SELECT uid, seg, row_number() OVER (ORDER BY t0 DESC, uid DESC, seg DESC) AS k FROM (SELECT * FROM trip_rows ORDER BY t0 DESC, uid DESC, seg DESC LIMIT 50) AS a) AS l ON r.uid = l.uid AND r.seg = l.seg"


@query("trip_rows")
def max_trips(d):
    """The first 100 trips of the corpus."""
    return "SELECT uid, seg FROM trip_rows ORDER BY t0, uid, seg LIMIT 100"


@query("trip_rows")
def length_batches(d):
    """Trips of like length in batches of eight."""
    return f"SELECT uid, seg, n, {d.floor('(k - 1)/8e0')} AS batch FROM (SELECT uid, seg, n, row_number() OVER (PARTITION BY n ORDER BY uid, seg) AS k FROM trip_rows) AS q"


@query("trip_rows")
def corpus_union(d):
    """Training and test trips as one corpus, with where each is from."""
    return f"SELECT uid, seg, 'train' AS part FROM trip_rows WHERE {UNIFORM('uid', 69621)} < 0.8e0 UNION ALL SELECT uid, seg, 'test' FROM trip_rows WHERE {UNIFORM('uid', 69621)} >= 0.8e0"
