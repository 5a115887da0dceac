"""Road network and distances between trips, and injected anomalies."""

from __future__ import annotations

from ..plans import EARTH_M, query, step
from .geo import REF
from .trips import UNIFORM


@step("centred")
def occupied(d):
    return f"SELECT {d.floor('x/1000e0')} AS cx, {d.floor('y/1000e0')} AS cy, count(*) AS n FROM centred GROUP BY {d.floor('x/1000e0')}, {d.floor('y/1000e0')} HAVING count(*) >= 2"


@step("occupied")
def vertices(d):
    """Cells with two fixes or more, numbered by cx and cy: those of smaller cx are counted by columns, of which the globe has 40,000."""
    return "SELECT o.cx, o.cy, o.n, CAST(c.before + row_number() OVER (PARTITION BY o.cx ORDER BY o.cy) - 1 AS BIGINT) AS id FROM occupied AS o JOIN (SELECT cx, sum(m) OVER (ORDER BY cx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - m AS before FROM (SELECT cx, count(*) AS m FROM occupied GROUP BY cx) AS k) AS c ON o.cx = c.cx"


@query("vertices")
def network_vertices(d):
    return f"SELECT id, cx, cy, {d.r('(cx + 0.5e0)*1000e0')} AS x, {d.r('(cy + 0.5e0)*1000e0')} AS y FROM vertices"


@step("centred", "vertices")
def walks(d):
    """The vertices a user passes, consecutive repeats as one."""
    return f"SELECT uid, k, id, cx, cy FROM (SELECT uid, k, id, cx, cy, lag(id) OVER (PARTITION BY uid ORDER BY k) AS p FROM (SELECT c.uid, v.id, v.cx, v.cy, row_number() OVER (PARTITION BY c.uid ORDER BY c.t, c.seq) AS k FROM centred AS c JOIN vertices AS v ON {d.floor('c.x/1000e0')} = v.cx AND {d.floor('c.y/1000e0')} = v.cy) AS w) AS q WHERE p IS NULL OR p <> id"


@query("walks")
def induced_edges(d):
    """Edges between consecutive vertices in both directions; the weight is the distance of their centres."""
    return f"SELECT src, dst, {d.r('min(w)', 4)} AS w, count(*) AS passes FROM (SELECT a, b, w, CASE WHEN s = 0 THEN a ELSE b END AS src, CASE WHEN s = 0 THEN b ELSE a END AS dst FROM (SELECT lag(id) OVER o AS a, id AS b, 1000e0*{d.dist('cx - lag(cx) OVER o', 'cy - lag(cy) OVER o')} AS w FROM walks WINDOW o AS (PARTITION BY uid ORDER BY k)) AS e CROSS JOIN (SELECT 0 AS s UNION ALL SELECT 1) AS t WHERE a IS NOT NULL) AS q GROUP BY src, dst"


@step("centred", "vertices")
def missed(d):
    """Fixes in a cell without a vertex."""
    return f"SELECT c.seq, c.x, c.y, {d.floor('c.x/1000e0')} AS fx, {d.floor('c.y/1000e0')} AS fy FROM centred AS c LEFT JOIN vertices AS v ON {d.floor('c.x/1000e0')} = v.cx AND {d.floor('c.y/1000e0')} = v.cy WHERE v.id IS NULL"


DD = "round(power(m.x - (v.cx + 0.5e0)*1000e0, 2) + power(m.y - (v.cy + 0.5e0)*1000e0, 2), 3)"


@step("missed", "vertices")
def ringed(d):
    """The nearest vertex within three cells, if it is nearer than any vertex farther off can be (3.5 cells)."""
    return f"""SELECT seq, id FROM (SELECT seq, id, dd, row_number() OVER (PARTITION BY seq ORDER BY dd, id) AS k FROM (SELECT m.seq, v.id, {DD} AS dd
      FROM (SELECT seq, x, y, fx + ox.o AS jx, fy + oy.o AS jy FROM missed CROSS JOIN (SELECT {d.series(-3, 3)} AS o) AS ox CROSS JOIN (SELECT {d.series(-3, 3)} AS o) AS oy) AS m JOIN vertices AS v ON m.jx = v.cx AND m.jy = v.cy) AS r) AS q WHERE k = 1 AND dd < 12250000e0"""


@step("missed", "ringed", "vertices")
def farther(d):
    """The nearest of all vertices for the fixes that the rings leave over."""
    return f"SELECT seq, id FROM (SELECT seq, id, row_number() OVER (PARTITION BY seq ORDER BY dd, id) AS k FROM (SELECT m.seq, v.id, {DD} AS dd FROM (SELECT * FROM missed AS u WHERE NOT EXISTS (SELECT 1 FROM ringed AS r WHERE r.seq = u.seq)) AS m CROSS JOIN vertices AS v) AS a) AS q WHERE k = 1"


@query("centred", "vertices", "ringed", "farther")
def snap_nodes(d):
    """The vertex of a fix's cell; without one the nearest vertex at any distance, the lowest id at ties."""
    return f"SELECT c.seq, coalesce(v.id, r.id, f.id) AS id FROM centred AS c LEFT JOIN vertices AS v ON {d.floor('c.x/1000e0')} = v.cx AND {d.floor('c.y/1000e0')} = v.cy LEFT JOIN ringed AS r ON c.seq = r.seq LEFT JOIN farther AS f ON c.seq = f.seq"


@step("trip_rows")
def asked(d):
    """The query set: every hundredth trip in the order of user and trip, counted by blocks of 4,096 users and numbered within each."""
    b = d.floor("uid/4096e0")
    return f"""SELECT uid, seg FROM (SELECT t.uid, t.seg, c.before + row_number() OVER (PARTITION BY t.b ORDER BY t.uid, t.seg) - 1 AS k FROM (SELECT uid, seg, {b} AS b FROM trip_rows) AS t
      JOIN (SELECT b, sum(n) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before FROM (SELECT {b} AS b, count(*) AS n FROM trip_rows GROUP BY {b}) AS g) AS c ON t.b = c.b) AS q WHERE k % 100 = 0"""


@step("trips")
def placed(d):
    """The points of trips in one frame, that of the corpus (as in centred)."""
    return f"SELECT uid, seg, i, n, t, {EARTH_M}*radians(lon - {REF[0]}e0)*cos(radians({REF[1]}e0)) AS x, {EARTH_M}*radians(lat - {REF[1]}e0) AS y FROM trips"


@step("placed", "asked")
def pair_costs(d):
    """Point distances between each trip of the query set and every other trip of any user."""
    return f"SELECT /*+ BROADCAST(a) */ a.uid AS u1, a.seg AS s1, b.uid AS u2, b.seg AS s2, a.i AS i, b.i AS j, a.n AS n1, b.n AS n2, a.t AS t1, b.t AS t2, {d.dist('a.x - b.x', 'a.y - b.y')} AS c FROM (SELECT p.* FROM placed AS p JOIN asked AS q ON p.uid = q.uid AND p.seg = q.seg) AS a JOIN placed AS b ON a.uid <> b.uid OR a.seg <> b.seg"


@step("pair_costs")
def aligned(d):
    """The cells of points aligned by index, as many as the shorter trip has points."""
    at = lambda k, n, m: f"CASE WHEN {k} = {n} - 1 THEN {m} - 1 ELSE {d.trunc(f'{k}*(({m} - 1e0)/greatest({n} - 1, 1))')} END"
    return f"SELECT * FROM pair_costs WHERE CASE WHEN n1 <= n2 THEN j = {at('i', 'n1', 'n2')} ELSE i = {at('j', 'n2', 'n1')} END"


@query("pair_costs")
def dita_distance(d):
    """Half the sum of the mean row minimum and the mean column minimum."""
    return f"SELECT r.u1, r.s1, r.u2, r.s2, {d.r('0.5e0*(r.m + c.m)', 4)} AS cost FROM (SELECT u1, s1, u2, s2, avg(m) AS m FROM (SELECT u1, s1, u2, s2, i, min(c) AS m FROM pair_costs GROUP BY u1, s1, u2, s2, i) AS a GROUP BY u1, s1, u2, s2) AS r JOIN (SELECT u1, s1, u2, s2, avg(m) AS m FROM (SELECT u1, s1, u2, s2, j, min(c) AS m FROM pair_costs GROUP BY u1, s1, u2, s2, j) AS b GROUP BY u1, s1, u2, s2) AS c ON r.u1 = c.u1 AND r.s1 = c.s1 AND r.u2 = c.u2 AND r.s2 = c.s2"


@query("aligned")
def tp_distance(d):
    """The mean cost of index-aligned points."""
    return f"SELECT u1, s1, u2, s2, {d.r('avg(c)', 4)} AS cost FROM aligned GROUP BY u1, s1, u2, s2"


@query("aligned")
def cyclic_time_cost(d):
    """Hours apart on the clock, and days apart in the week at 24 hours for 7."""
    hod = f"abs({d.mod('t1 - t2 + 12e0', '24e0')} - 12e0)"
    dow = f"abs({d.mod('floor(t1/24e0) - floor(t2/24e0) + 3.5e0', '7e0')} - 3.5e0)"
    return f"SELECT u1, s1, u2, s2, {d.r(f'avg({hod} + 24e0/7e0*{dow})')} AS cyclic, {d.r('avg(abs(t1 - t2))')} AS absolute FROM aligned GROUP BY u1, s1, u2, s2"


@query("aligned")
def blended_truth(d):
    """Half spatial, half temporal cost, each scaled from its minimum to its 99th percentile over all pairs of the query set and clipped."""
    per_pair = "SELECT u1, s1, u2, s2, avg(c) AS s, avg(abs(t1 - t2)) AS h FROM aligned GROUP BY u1, s1, u2, s2"
    return f"SELECT u1, s1, u2, s2, {d.r('0.5e0*' + d.clip('(s - s0)/greatest(s9 - s0, 1e-9)', '0e0', '1e0') + ' + 0.5e0*' + d.clip('(h - h0)/greatest(h9 - h0, 1e-9)', '0e0', '1e0'))} AS cost FROM ({per_pair}) AS p CROSS JOIN (SELECT min(s) AS s0, {d.pct('s', 0.99)} AS s9, min(h) AS h0, {d.pct('h', 0.99)} AS h9 FROM ({per_pair}) AS q) AS n"


@step("trips", "snap_nodes")
def passed(d):
    """The vertices of each trip in order, consecutive repeats as one."""
    return "SELECT uid, seg, row_number() OVER (PARTITION BY uid, seg ORDER BY i) - 1 AS i, id FROM (SELECT t.uid, t.seg, t.i, s.id, lag(s.id) OVER (PARTITION BY t.uid, t.seg ORDER BY t.i) AS p FROM trips AS t JOIN snap_nodes AS s ON t.seq = s.seq) AS q WHERE p IS NULL OR p <> id"


@query("walks")
def skipgram_pairs(d):
    """Vertices within five places of each other in a walk, met by user and place."""
    return f"SELECT a.id AS centre, b.id AS context, count(*) AS n FROM (SELECT uid, id, k + o AS place FROM walks CROSS JOIN (SELECT o FROM (SELECT {d.series(-5, 5)} AS o) AS s WHERE o <> 0) AS w) AS a JOIN walks AS b ON a.uid = b.uid AND b.k = a.place GROUP BY a.id, b.id"


# ---- injected anomalies


@query("points")
def off_grid_inject(d):
    """A turn by 45 degrees about the trip's own mean, and the 90 degree control."""
    return f"SELECT seq, {d.r('(x - y)*sqrt(0.5e0)', 4)} AS x, {d.r('(x + y)*sqrt(0.5e0)', 4)} AS y, {d.r('-y', 4)} AS control_x, {d.r('x', 4)} AS control_y FROM points"


@query("steps")
def off_grid_gap(d):
    """How far each trip's headings are from the grid, in units of the fourth harmonic."""
    return f"SELECT uid, seg, {d.r('sqrt(power(sum(r*sin(4e0*psi)), 2) + power(sum(r*cos(4e0*psi)), 2))/greatest(sum(r), 1e-9)')} AS strength, {d.r('sqrt(power(sum(r*sin(4e0*(psi + pi()/4e0))), 2) + power(sum(r*cos(4e0*(psi + pi()/4e0))), 2))/greatest(sum(r), 1e-9)')} AS turned FROM steps WHERE r >= 5e0 GROUP BY uid, seg"


@query("points")
def detour_inject(d):
    """A sideways bump of 0.35 of the span; ends stay."""
    return f"SELECT p.seq, {d.r('p.x - 0.35e0*(e.y1 - e.y0)*sin(pi()*p.i/(p.n - 1e0))', 4)} AS x, {d.r('p.y + 0.35e0*(e.x1 - e.x0)*sin(pi()*p.i/(p.n - 1e0))', 4)} AS y FROM points AS p JOIN (SELECT uid, seg, min_by(x, i) AS x0, max_by(x, i) AS x1, min_by(y, i) AS y0, max_by(y, i) AS y1 FROM points GROUP BY uid, seg) AS e ON p.uid = e.uid AND p.seg = e.seg"


@query("trips")
def kinematic_inject(d):
    """Monotone re-timing u^3 of each trip's clock."""
    return f"SELECT seq, {d.r('t0 + (t1 - t0)*power((t - t0)/greatest(t1 - t0, 1e-9), 3)')} AS t FROM (SELECT seq, t, min(t) OVER (PARTITION BY uid, seg) AS t0, max(t) OVER (PARTITION BY uid, seg) AS t1 FROM trips) AS q"


@query("trips")
def wrong_time_inject(d):
    """The start moves to 3 o'clock, give or take 1.5 hours."""
    return f"SELECT seq, {d.r('t - ' + d.mod('t0', '24e0') + ' + 3e0 + 3e0*(' + UNIFORM('uid*1000 + seg', 48271) + ' - 0.5e0)')} AS t FROM (SELECT *, min(t) OVER (PARTITION BY uid, seg) AS t0 FROM trips) AS q"


@query("points")
def teleport_inject(d):
    return f"SELECT seq, {d.r('CASE WHEN i >= n/2e0 THEN x + 5000e0 ELSE x END', 4)} AS x, {d.r('CASE WHEN i >= n/2e0 THEN y - 3000e0 ELSE y END', 4)} AS y FROM points WHERE n >= 6"


@query("aligned", "asked")
def spatial_truth(d):
    """TP distances within the query set, each pair worked out once and mirrored."""
    one = "SELECT p.u1, p.s1, p.u2, p.s2, avg(p.c) AS c, avg(abs(p.t1 - p.t2)) AS h FROM aligned AS p JOIN asked AS q ON p.u2 = q.uid AND p.s2 = q.seg WHERE p.u1 < p.u2 OR (p.u1 = p.u2 AND p.s1 < p.s2) GROUP BY p.u1, p.s1, p.u2, p.s2"
    return f"SELECT u1, s1, u2, s2, {d.r('c', 3)} AS cost, {d.r('h', 5)} AS hours FROM ({one}) AS a UNION ALL SELECT u2, s2, u1, s1, {d.r('c', 3)}, {d.r('h', 5)} FROM ({one}) AS b"


WALK_STEPS, WALK_P, WALK_Q = 4, 0.5, 2.0


def _walk(k):
    def f(d):
        before = f"walk{k - 1}"
        bias = f"CASE WHEN e.dst = w.prev THEN {1 / WALK_P!r} WHEN n.src IS NOT NULL OR w.prev IS NULL THEN 1e0 ELSE {1 / WALK_Q!r} END"
        draw = f"-ln(greatest({UNIFORM(f'w.start*1009 + e.dst*31 + {k}', 48271)}, 1e-12))/({bias})"
        return f"SELECT start, {k} AS k, cur AS prev, nxt AS cur FROM (SELECT w.start, w.cur, e.dst AS nxt, row_number() OVER (PARTITION BY w.start ORDER BY {draw}, e.dst) AS r FROM {before} AS w JOIN induced_edges AS e ON w.cur = e.src LEFT JOIN induced_edges AS n ON n.src = w.prev AND n.dst = e.dst) AS c WHERE r = 1"

    f.__name__ = f"walk{k}"
    step(f"walk{k - 1}", "induced_edges")(f)


@step("vertices")
def walk0(d):
    return "SELECT id AS start, 0 AS k, CAST(NULL AS BIGINT) AS prev, id AS cur FROM vertices"


for _k in range(1, WALK_STEPS + 1):
    _walk(_k)


@query(*(f"walk{k}" for k in range(WALK_STEPS + 1)))
def random_walks(d):
    """A second-order walk from every vertex: back with weight 1/p, to a common neighbour with 1, elsewhere with 1/q; drawn by hashes, one join for each step."""
    return " UNION ALL ".join(f"SELECT start, k, cur FROM walk{k}" for k in range(WALK_STEPS + 1))
