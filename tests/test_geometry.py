import numpy as np
import pytest

from sitelens.functions import geometry as g
from sitelens.operators import density, partitions, resampling, stats
from sitelens.operators.spatial import maximum_matching


def test_kabsch_recovers_motions():
    for seed in range(20):
        r = np.random.default_rng(seed)
        x = r.normal(size=(12, 3))
        q, _ = np.linalg.qr(r.normal(size=(3, 3)))
        q *= np.sign(np.linalg.det(q))
        t = r.normal(size=3)
        rot, shift = g.kabsch(x @ q.T + t, x)
        assert np.allclose(rot, q) and np.allclose(shift, t)
        rot, _ = g.kabsch(r.normal(size=(5, 3)), r.normal(size=(5, 3)))
        assert np.isclose(np.linalg.det(rot), 1)


def test_pairing():
    s = g.substitution()
    assert s.shape == (20, 20) and (s == s.T).all() and s[0, 0] == 4
    assert g.paired_positions("", "A") == []
    a = "MKTAYIAKQRQISFVKSHFSRQ"
    assert g.paired_positions(a, a) == [(i, i) for i in range(len(a))]
    assert g.paired_positions(a[3:], a) == [(i, i + 3) for i in range(len(a) - 3)]
    assert g.paired_positions(a[:8] + a[12:], a) == [(i, i) for i in range(8)] + [(i, i + 4) for i in range(8, len(a) - 4)]


def test_symmetry():
    with pytest.raises(ValueError):
        g.symmetry_ops("P 99")
    assert len(g.HALL) == 65 and len(g.symmetry_ops(None)) == 1
    for name in {**g.HALL, **g.SETTINGS}:
        ops = g.symmetry_ops(name)
        keys = {(*r.ravel().tolist(), *(np.round(t * 24) % 24).tolist()) for r, t in ops}
        assert len(keys) == len(ops) and np.array_equal(ops[0][0], np.eye(3)) and not ops[0][1].any()
        for r, t in ops:
            assert np.isclose(np.linalg.det(r), 1)
            # the group is closed
            assert all((*(r @ r2).ravel().tolist(), *(np.round((r @ t2 + t) * 24) % 24).tolist()) in keys for r2, t2 in ops[:12])
    # point group order times lattice points
    for name, n in {"C 2 2 21": 8, "I 41 2 2": 16, "P 43 21 2": 8, "R 3 2": 18, "P 61 2 2": 12, "I 21 3": 24, "F 41 3 2": 96, "P212121": 4, "p 1 21 1": 2}.items():
        assert len(g.symmetry_ops(name)) == n
    place = lambda name, *p: {tuple(np.round((r @ p + t) % 1, 6) % 1) for r, t in g.symmetry_ops(name)}
    x, y, z = 0.1, 0.23, 0.37
    positions = [(x, y, z), (-x, -y, z + 0.5), (-y + 0.5, x + 0.5, z + 0.75), (y + 0.5, -x + 0.5, z + 0.25), (-x + 0.5, y + 0.5, -z + 0.75), (x + 0.5, -y + 0.5, -z + 0.25), (y, x, -z), (-y, -x, -z + 0.5)]
    assert place("P 43 21 2", x, y, z) == {tuple(np.round(np.array(p) % 1, 6) % 1) for p in positions}
    positions = [(x, y, z), (-y, x - y, z + 1 / 3), (y - x, -x, z + 2 / 3), (-y, -x, -z + 2 / 3), (y - x, y, -z + 1 / 3), (x, x - y, -z)]
    assert place("P 31 1 2", x, y, z) == {tuple(np.round(np.array(p) % 1, 6) % 1) for p in positions}
    w, d = g.nearest_images(np.array([[9.0, 0, 0]]), np.zeros((1, 3)), [10, 10, 10, 90, 90, 90], "P 1")
    assert np.allclose(w, [[-1, 0, 0]]) and np.isclose(d[0], 1)
    w, d = g.nearest_images(np.array([[9.0, 0, 0]]), np.zeros((1, 3)), [100, 100, 100, 90, 90, 90], "P 1")
    assert np.allclose(w, [[9, 0, 0]]) and np.isclose(d[0], 9)
    assert np.isclose(g.volume([10, 20, 30, 90, 90, 90]), 6000)


def test_relocation_puts_every_water_where_its_distance_says():
    r = np.random.default_rng(4)
    cell = [20.0, 25.0, 31.0, 90.0, 104.0, 90.0]
    w, p = r.uniform(-30, 30, (30, 3)), r.uniform(0, 20, (12, 3))
    new, d = g.nearest_images(w, p, cell, "P 1 21 1")
    assert np.allclose(np.sqrt(((new[:, None] - p[None]) ** 2).sum(2)).min(1), d)


def test_matching():
    r = np.random.default_rng(1)
    for _ in range(300):
        n = int(r.integers(1, 7))
        edges = [(i, j) for i in range(n) for j in range(n) if r.random() < 0.35]

        def best(left, used):
            if not left:
                return 0
            u, rest = left[0], left[1:]
            return max([best(rest, used)] + [1 + best(rest, used | {v}) for a, v in edges if a == u and v not in used])

        assert maximum_matching(edges) == best(list(range(n)), frozenset())


def test_density_clusters():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(c, 0.2, (40, 3)) for c in (0, 5, 10)] + [r.uniform(-8, 18, (12, 3))])
    labels, v = density.fit(x, 5)
    for k in range(3):
        own = labels[k * 40 : k * 40 + 40]
        assert (np.bincount(own[own >= 0]).max() if (own >= 0).any() else 0) >= 36
    assert len(set(labels) - {-1}) >= 3 and v > 0
    assert (density.fit(x[:3], 5)[0] == -1).all()
    assert set(density.fit(x, 5, method="leaf")[0]) >= {0, 1, 2}
    core = density.core_distances(x, 4)
    brute = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 1)[:, 4]
    assert np.allclose(core, brute, atol=1e-6)
    tree = density.spanning_tree(x, core)
    d = np.maximum(np.maximum(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), core[:, None]), core[None])
    root, total = list(range(len(x))), 0.0
    find = lambda i: i if root[i] == i else find(root[i])
    for w, i, j in sorted((d[i, j], i, j) for i in range(len(x)) for j in range(i)):
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += w
    assert np.isclose(tree[:, 2].sum(), total)
    assert density.candidate_grid(6) == [(3, 2), (3, 3), (5, 2), (5, 3), (5, 5)]


def test_linkage():
    x = np.array([0.0, 1, 5, 6, 20])
    m = partitions.complete_linkage(np.abs(np.subtract.outer(x, x)))
    assert partitions.cut(m, 5, 2) == [1, 1, 2, 2, 3] and partitions.cut(m, 5, 6) == [1, 1, 1, 1, 2]
    assert partitions.cophenetic(m, 5)[0, 3] == 6
    r = np.random.default_rng(2)
    p = r.normal(size=(25, 3))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    groups = {i: [i] for i in range(25)}
    heights = []
    while len(groups) > 1:
        h, a, b = min((max(d[i, j] for i in groups[a] for j in groups[b]), a, b) for a in groups for b in groups if a < b)
        groups[a] += groups.pop(b)
        heights.append(h)
    assert np.allclose(partitions.complete_linkage(d)[:, 2], heights)


def test_linkage_by_rounds(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = []
    for g in "ab":
        p = r.normal(size=(17, 2))
        rows += [(g, i, j, float(np.linalg.norm(p[i] - p[j]))) for i in range(17) for j in range(i) if (i, j) != (5, 2)]
    df = spark.createDataFrame(rows, "g string, i int, j int, d double")
    labels = lambda: {(x["g"], x["member"]): x["label"] for x in partitions.linkage_labels(df, "i", "j", "d", 1.4, ["g"]).collect()}
    sweep = lambda: sorted(map(tuple, partitions.linkage_sweep(df.where("g = 'a'"), "i", "j", "d", [0.5, 1.4]).collect()))
    alone = labels(), sweep()
    monkeypatch.setattr(partitions, "IN_TASK", 0)
    assert (labels(), sweep()) == alone and len(set(alone[0].values())) > 3
    heights = sorted(x["height"] for x in partitions.linkage_merges(df.where("g = 'b'"), "i", "j", "d").collect())
    _, d = partitions._matrix(df.where("g = 'b'").toPandas(), "i", "j", "d")
    assert np.allclose(heights, partitions.complete_linkage(d)[:, 2])


def test_leaf_order_by_plain_means(spark):
    r = np.random.default_rng(4)
    n = 40
    p = r.normal(size=(n, 3))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    held = {k: [k] for k in range(n)}
    while len(held) > 1:
        _, a, b = min((float(np.mean(d[np.ix_(held[x], held[y])])), x, y) for x in held for y in held if x < y)
        held[a] += held.pop(b)
    rows = [(i, j, float(d[i, j])) for i in range(n) for j in range(n) if i != j]
    got = partitions.leaf_order(spark.createDataFrame(rows, "i int, j int, d double"), "i", "j", "d").orderBy("place").collect()
    assert [x["member"] for x in got] == held[0]


def test_statistics():
    assert abs(stats.t_p(2.0, 10) - 0.07338803) < 1e-7
    assert abs(stats.beta_tail(2, 3, 0.5) - 0.6875) < 1e-12
    assert abs(stats.ks_p(0.5, 100, 100)) < 1e-8 and stats.ks_p(0.01, 50, 50) == 1
    assert stats.mann_whitney_p(50, 10, 10, [1] * 20) == 1
    c = resampling.compare_halves([4, 5, 6], [1, 2, 3], n_boot=50)
    assert c["r"] == 1 and resampling.compare_halves([1, 2, 3], [4, 5, 6], n_boot=50)["r"] == -1
    assert np.isnan(resampling.compare_halves([1], [2, 3])["r"])
    units = np.arange(30)
    left, right = units + 1.0, units.astype(float)
    left = np.where(units == 7, np.nan, left + 100)
    one = resampling.compare_halves(left, right, units, units, 300)
    many = resampling.compare_halves(np.tile(left, 16), np.tile(right, 16), np.tile(units, 16), np.tile(units, 16), 300)
    assert np.isclose(one["hi"] - one["lo"], many["hi"] - many["lo"]) and one["p"] == many["p"] == 1 / 300 and one["n_left"] == 29


def test_exact_p_values_are_shares_of_orders(spark):
    from itertools import combinations

    r = np.random.default_rng(5)
    for n1, n2 in ((3, 4), (2, 6), (5, 3), (1, 4)):
        x = r.normal(size=n1 + n2)
        u_of = lambda a, b: float((a[:, None] > b[None]).sum())
        d_of = lambda a, b: max(abs((a <= v).mean() - (b <= v).mean()) for v in x)
        parts = [(x[list(c)], np.delete(x, list(c))) for c in combinations(range(n1 + n2), n1)]
        u, d = u_of(*parts[2]), d_of(*parts[2])
        low = min(u, n1 * n2 - u)
        assert np.isclose(stats.mann_whitney_exact(u, n1, n2), min(1, 2 * np.mean([u_of(*p) <= low for p in parts])))
        assert np.isclose(stats.ks_exact(d, n1, n2), np.mean([d_of(*p) >= d - 1e-9 for p in parts]))
    rows = [("a", True, float(v)) for v in (1, 2, 3, 4, 5.5)] + [("a", False, float(v)) for v in (3.5, 6, 7, 8)] + [("b", True, 1.0), ("c", False, None), ("c", True, float("nan"))]
    got = {x["k"]: x for x in stats.p_values(spark.createDataFrame(rows, "k string, l boolean, v double"), "v", "l", ["k"]).collect()}
    assert got["a"]["u"] == 2.0 and np.isclose(got["a"]["p_mann_whitney"], stats.mann_whitney_exact(2.0, 5, 4)) and got["b"]["p_ks"] is None and "c" not in got
    # Welch's test by a permutation of many draws
    a, b = np.array([1, 2, 3, 4, 5.5]), np.array([3.5, 6, 7, 8])
    assert np.isclose(got["a"]["t"], (a.mean() - b.mean()) / np.sqrt(a.var(ddof=1) / 5 + b.var(ddof=1) / 4)) and 0.01 < got["a"]["p_welch"] < 0.06


def test_spearman_p(spark):
    # t = rho sqrt((n - 2) / (1 - rho^2)) of 2 degrees of freedom has p = 1 - |t| / sqrt(2 + t^2)
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 3.0), ("a", 3.0, 2.0), ("a", 4.0, 4.0), ("b", 1.0, 2.0), ("b", 2.0, 1.0)], "k string, x double, y double")
    got = {r["k"]: r for r in stats.spearman_test(df, "x", "y", ["k"]).collect()}
    t = 0.8 * np.sqrt(2 / (1 - 0.64))
    assert np.isclose(got["a"]["rho"], 0.8) and np.isclose(got["a"]["p"], 1 - t / np.sqrt(2 + t * t)) and got["b"]["p"] is None


def test_quantiles_and_nearest_by_brute_force(spark):
    from sitelens.operators import spatial

    r = np.random.default_rng(6)
    rows = [("a", float(v)) for v in np.round(r.normal(size=700), 2)] + [("b", 3.0)] * 40 + [("c", 1.5)] + [("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    got = {x["k"]: x["q"] for x in stats.quantiles(df, "v", probs, ["k"]).collect()}
    for k in "abc":
        assert np.allclose(got[k], np.quantile([v for n, v in rows if n == k], probs))
    assert "d" not in got and np.allclose(stats.quantiles(df, "v", probs).first()["q"], np.quantile([v for _, v in rows if v is not None], probs))
    p = [(k, i, *map(float, r.uniform(-20, 20, 3))) for i, k in enumerate("ab" * 60)]
    left, right = (spark.createDataFrame(p[a:b], "k string, id int, x double, y double, z double") for a, b in ((0, 50), (50, 120)))
    want = {x[1]: min(np.linalg.norm(np.array(x[2:]) - y[2:]) for y in p[50:] if y[0] == x[0]) for x in p[:50]}
    every = {x[1]: min(np.linalg.norm(np.array(x[2:]) - y[2:]) for y in p[50:]) for x in p[:50]}
    direct = spatial.DIRECT
    for most in (direct, 10):
        spatial.DIRECT = most
        got = {x["id"]: x["distance"] for x in spatial.nearest(left, right, ["k"]).collect()}
        assert got.keys() == want.keys() and all(np.isclose(got[i], want[i]) for i in want)
        c = {x["k"]: x["chamfer"] for x in spatial.chamfer(left, right, ["k"], "id", "id").collect()}
        back = {k: np.mean([min(np.linalg.norm(np.array(x[2:]) - y[2:]) for x in p[:50] if x[0] == k) for y in p[50:]]) for k in "ab"}
        assert all(np.isclose(c[k], np.mean([every[x[1]] for x in p[:50] if x[0] == k]) + back[k]) for k in "ab")
    spatial.DIRECT = direct
    got = {x["id"]: x["distance"] for x in spatial.nearest(left, right).collect()}
    assert all(np.isclose(got[i], every[i]) for i in every)


def test_scattered_points_end_by_a_bound(spark):
    """Points far from all others, on dense spots, and without coordinates; no join of all points."""
    from sitelens.operators import spatial

    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(0, 0.05, (300, 3)), r.uniform(-500, 500, (60, 3)), [[1e5, 0, 0], [0, -3e4, 7]]])
    y = np.concatenate([r.normal(40, 0.05, (400, 3)), r.uniform(-300, 300, (30, 3))])
    frame = lambda p, more=(): spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)] + list(more), "id int, x double, y double, z double")
    got = {a["id"]: a["distance"] for a in spatial.nearest(frame(x, [(-1, None, 0.0, 0.0), (-2, float("nan"), 0.0, 0.0)]), frame(y)).collect()}
    want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)).min(1)
    assert got.keys() == set(range(len(x))) and np.allclose([got[k] for k in range(len(x))], want)
    assert spatial.nearest(frame(x), frame(y).limit(0)).collect() == []


def test_matching_by_components(spark, monkeypatch):
    from sitelens.operators import spatial

    r = np.random.default_rng(9)
    frame = lambda p, i: spark.createDataFrame([("k" + str(n % 2), n, *map(float, v)) for n, v in enumerate(p)], f"k string, {i} int, x double, y double, z double")
    p, c = frame(r.uniform(0, 12, (160, 3)), "id"), frame(r.uniform(0, 12, (90, 3)), "c").drop("k")
    rows = lambda: sorted(map(tuple, spatial.matched_coverage(p, c, 1.6, ["k"], "id", "c").collect()))
    alone = rows()
    monkeypatch.setattr(spatial, "MATCH", 40)
    assert rows() == alone and all(0 < x[1] < 80 for x in alone)
