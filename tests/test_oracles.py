"""Queries against NumPy versions of their own, which share nothing with the queries' text."""

import math
from collections import Counter

import numpy as np
import pytest

from waymark import catalogue, plans
from waymark.functions.ladders import geometric, gpe_frequencies

SF = "/root/testdata/sf0.01"


def frame(spark, name):
    return plans.run(name, spark, SF).toPandas()


def query(spark, name):
    return catalogue.queries()[name](spark, SF).toPandas()


@pytest.fixture(scope="module")
def halves(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    e = np.stack(v["embedding"].to_numpy()).astype(float)
    a, b = e[0::2], e[1::2]
    unit = lambda x: x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    asked = np.arange(0, len(a), 50)  # first halves with an id divisible by 100
    return asked, unit(a)[asked] @ unit(b).T, unit(a + b)[asked] @ unit(a + b).T


def test_partner_ranks(spark, halves):
    asked, sim, _ = halves
    rank = np.array([1 + (row > row[i]).sum() for i, row in zip(asked, sim)])
    got = query(spark, "mr_mrr_mp").iloc[0]
    assert np.allclose([got["mr"], got["mrr"], got["mp"]], [rank.mean(), (1 / rank).mean(), (rank == 1).mean()], atol=1e-6)


def test_kp_and_hit_ratio(spark, halves):
    asked, sim, whole = halves
    kp, hits, tied = [], [], []
    for i, s, w in zip(asked, sim, whole):
        w = w.copy()
        w[i] = -np.inf
        kp.append(len({*np.argsort(-w)[:10]} & {*np.argsort(-s)[:10]}) / 10)
        dist = np.round(np.sqrt(np.maximum(2 - 2 * w, 0)), 2)
        dist[i] = np.inf
        kth = np.sort(dist)[9]
        s = s.copy()
        s[i] = -np.inf
        hits.append(min((dist[np.argsort(-s)[:10]] <= kth + 1e-9).sum(), 10) / 10)
        tied.append((np.abs(dist - kth) <= 1e-9).sum() > 1)
    assert math.isclose(query(spark, "kp_at_k")["kp"][0], np.mean(kp), abs_tol=1e-6)
    assert math.isclose(query(spark, "hit_ratio")["hr10"][0], np.mean(hits), abs_tol=1e-6)
    assert math.isclose(query(spark, "tie_fraction")["tied"][0], np.mean(tied), abs_tol=1e-6)


def test_anomaly_protocol(spark):
    """Injection moves what it says and nothing else; scores and AUROC from the features by NumPy."""
    from waymark.operators import anomalies

    before = frame(spark, "placed").set_index(["uid", "seg", "i"]).sort_index()
    after = frame(spark, "injected").set_index(["uid", "seg", "i"]).sort_index()
    assert before.index.equals(after.index)
    kind = after["kind"].to_numpy()
    same = lambda c: np.isclose(before[c].to_numpy(), after[c].to_numpy())
    normal = kind == "normal"
    assert all(same(c)[normal].all() for c in "xyt") and {*kind} == {"normal", *anomalies.KINDS}
    for k in anomalies.KINDS:
        own = kind == k
        timed = k in ("kinematic", "wrong_time")
        assert same("t")[own].all() == (not timed) and (same("x") & same("y"))[own].all() == timed, k
    for (_, _), a in after[kind == "unseen_area"].groupby(level=[0, 1]):
        b = before.loc[a.index]
        assert np.allclose(np.diff(a["x"]), np.diff(b["x"])) and np.allclose(np.diff(a["y"]), np.diff(b["y"]))
    shapes = frame(spark, "trip_shapes")
    ref = shapes[(shapes["kind"] == "normal") & (shapes["s"] < 0.5)].sort_values(["a", "uid", "seg"])[: anomalies.REFERENCE]
    rest = shapes.drop(ref.index)
    f = [*anomalies.FEATURES]
    mu, sd = ref[f].mean(), ref[f].std(ddof=0) + 1e-9
    d = np.linalg.norm(((rest[f] - mu) / sd).to_numpy()[:, None] - ((ref[f] - mu) / sd).to_numpy()[None], axis=2)
    score = np.sort(d, 1)[:, : anomalies.NEAREST].mean(1)
    got = query(spark, "knn_anomaly_score").set_index(["uid", "seg"])["score"]
    assert np.allclose(got.loc[[*zip(rest["uid"], rest["seg"])]], score, atol=1e-4)
    is_normal = rest["kind"].to_numpy() == "normal"
    table = query(spark, "auroc_by_type").set_index("type")["auroc"]
    for k in (*anomalies.KINDS, "all"):
        pos = score[~is_normal if k == "all" else rest["kind"].to_numpy() == k]
        want = np.mean([(p > score[is_normal]).mean() + 0.5 * (p == score[is_normal]).mean() for p in pos])
        assert math.isclose(table[k], want, abs_tol=2e-4), k
    assert table["teleport"] > 0.6 and table["wrong_time"] > 0.5


def test_trivial_detectors(spark):
    x = frame(spark, "trip_shapes")
    got = query(spark, "trivial_detectors").set_index(["uid", "seg"]).loc[[*zip(x["uid"], x["seg"])]]
    for name, v in (("len", x["path_m"]), ("spd", x["v_mean"]), ("dur", x["hours"]), ("box", x["area"])):
        lv = np.log1p(v.to_numpy())
        med = np.median(lv)
        assert np.allclose(got[f"z_{name}"], np.abs(lv - med) / (1.4826 * np.median(np.abs(lv - med)) + 1e-9), atol=1e-3)


def test_codes(spark):
    fixes = frame(spark, "fixes").sort_values("seq")
    got = query(spark, "encode_gpe").sort_values("seq").drop(columns="seq").to_numpy()
    w = np.array(gpe_frequencies(32))
    ang = [np.radians(fixes[c].to_numpy())[:, None] * w for c in ("lon", "lat")]
    assert np.allclose(got, np.hstack([np.stack([np.sin(a), np.cos(a)], 2).reshape(len(a), -1) for a in ang]), atol=1e-5)
    steps = frame(spark, "steps").sort_values(["uid", "seg", "i"])
    lams = np.array(geometric(200.0, 5000.0, 4))
    torus = np.hstack([np.stack([np.sin(2 * np.pi * steps[c].to_numpy()[:, None] / lams), np.cos(2 * np.pi * steps[c].to_numpy()[:, None] / lams)], 2).reshape(len(steps), -1) for c in "xy"])
    token = query(spark, "tokens").sort_values(["uid", "seg", "i"])
    e = token.drop(columns=["uid", "seg", "i"]).to_numpy()
    assert np.allclose(e[:, :16], torus, atol=1e-5)
    assert (e[token["i"].to_numpy() == 0][:, 16:48] == 0).all()
    hour = 2 * np.pi * (steps["t"].to_numpy() % 24) / 24
    assert np.allclose(e[:, 48:56], np.hstack([np.sin(hour[:, None] * [1, 2, 3, 4]), np.cos(hour[:, None] * [1, 2, 3, 4])]), atol=1e-5)
    pooled = query(spark, "pooled_tokens").sort_values(["uid", "seg"])
    n = e.shape[1]
    by_trip = [g.index.to_numpy() for _, g in token.reset_index(drop=True).groupby(["uid", "seg"])]
    assert np.allclose(pooled[[f"m{k}" for k in range(n)]], [e[i].mean(0) for i in by_trip], atol=1e-5)
    assert np.allclose(pooled[[f"s{k}" for k in range(n)]], [e[i].std(0) for i in by_trip], atol=2e-4)


def test_ranks_in_buckets_are_ranks(spark):
    rows = frame(spark, "trip_rows")
    uids = np.sort(rows["uid"].unique())
    h = (((uids * 1103515245 + 12345) % 2**31 * 69621 + 7) % 2147483647) / 2147483647
    train = {*uids[np.lexsort((uids, h))][: max(int(0.8 * len(uids)), 1)]}
    got = query(spark, "user_disjoint_split")
    assert len(got) == len(rows) and all(t == (u in train) for u, t in zip(got["uid"], got["train"]))
    v = query(spark, "network_vertices").sort_values("id")
    assert v["id"].tolist() == [*range(len(v))] and v[["cx", "cy"]].apply(tuple, axis=1).is_monotonic_increasing


def test_walks_and_pairs(spark):
    w = frame(spark, "walks").sort_values(["uid", "k"])
    want = Counter()
    for _, g in w.groupby("uid"):
        k, ids = g["k"].to_numpy(), g["id"].to_numpy()
        for o in (-5, -4, -3, -2, -1, 1, 2, 3, 4, 5):
            at = {a: b for a, b in zip(k, ids)}
            want.update((b, at[a + o]) for a, b in zip(k, ids) if a + o in at)
    got = query(spark, "skipgram_pairs")
    assert {(a, b): n for a, b, n in got.itertuples(index=False)} == want
    edges = {*frame(spark, "induced_edges")[["src", "dst"]].itertuples(index=False, name=None)}
    paths = query(spark, "random_walks").sort_values(["start", "k"]).groupby("start")["cur"].apply(list)
    assert all((a, b) in edges for p in paths for a, b in zip(p, p[1:])) and (paths.apply(len) == 5).mean() > 0.8


def test_tokens_and_transfer(spark):
    t = frame(spark, "shifted")
    got = query(spark, "permutation_transfer").set_index("shift")
    for shift, g in t.groupby("shift"):
        fit, held = g[g["fit"]], g[~g["fit"]]
        best = {c: min(Counter(x["got"]).items(), key=lambda y: (-y[1], y[0]))[0] for c, x in fit.groupby("token")}
        hit = lambda x: np.mean([best.get(a, a) == b for a, b in zip(x["token"], x["got"])])
        assert np.allclose(got.loc[shift, ["fitted", "heldout"]].astype(float), [hit(fit), hit(held)], atol=1e-6)
    exact = query(spark, "lattice_period").set_index("shift")
    assert exact.loc[3, "kept"] == 1 and exact.loc[0, "as_predicted"] == 1 and exact.loc[1, "as_predicted"] == 1


def test_audits(spark):
    assert (query(spark, "translation_error")["analytic"] == 0).all() and (query(spark, "rotation_audit")["error"] == 0).all()
    assert query(spark, "gram_distortion")["refit"][0] == 0 and query(spark, "gram_distortion")["stale"][0] > 0.05
    cos = query(spark, "saturation_curve").sort_values("sigma")["cosine"]
    assert cos.iloc[0] == 1 and cos.is_monotonic_decreasing


def test_critical_difference(spark):
    got = query(spark, "critical_difference").set_index("method")
    t = frame(spark, "full_blocks").pivot(index="block", columns="method", values="value")
    ranks = t.rank(axis=1, ascending=False).mean()
    assert np.allclose(got["mean_rank"], ranks[got.index], atol=1e-6)
    k, n = len(ranks), len(t)
    assert np.allclose(got["cd"], 3.102 * math.sqrt(k * (k + 1) / (6 * n)), atol=1e-5) and k == 9
