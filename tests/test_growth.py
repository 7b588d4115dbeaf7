"""What grows with the tables: no table without a bound is broadcast, and crowded places make no work of their own."""

import numpy as np

from tomolake.operators import calibrate, graph, labels, network, resample, stats, stencil
from tomolake.sources import containers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_smooth_map_joins_nothing(spark):
    rng = np.random.default_rng(1)
    value = {(m, x, y): int(rng.integers(0, 9)) for m in (1, 2) for x in range(7) for y in range(6) if rng.random() < 0.7}
    want = value
    for _ in range(2):
        near = {k: [want[k[0], k[1] + i, k[2] + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if (k[0], k[1] + i, k[2] + j) in want] for k in want}
        want = {k: sum(v) // len(v) for k, v in near.items()}
    maps = spark.createDataFrame([(*k, v) for k, v in value.items()], "map_id long, x long, y long, value long")
    got = labels.smooth_map(maps, 2)
    assert sorted(map(tuple, got.collect())) == sorted((*k, v) for k, v in want.items())
    assert "Join" not in plan(got)


def test_row_gaussian_joins_nothing(spark):
    rng = np.random.default_rng(2)
    gray = {(x, y, z): int(rng.integers(0, 256)) for x in range(20) for y in range(3) for z in range(2) if rng.random() < 0.6}
    v = spark.createDataFrame([(1, *k, g) for k, g in gray.items()], "volume_id long, x long, y long, z long, gray long")
    got = stencil.row_gaussian(v, 2.0)
    assert "Join" not in plan(got)
    rows = {tuple(r)[1:4]: r["value"] for r in got.collect()}
    assert rows.keys() == gray.keys() and got.count() == len(gray)
    for (x, y, z), value in rows.items():
        w = {i: np.exp(-i * i / 8) for i in range(-6, 7) if (x + i, y, z) in gray}
        assert abs(value - sum(gray[x + i, y, z] * u for i, u in w.items()) / sum(w.values())) < 1e-9
    assert "Broadcast" not in plan(stencil.joined(v, [((0, 0, 0), 1.0)], lambda v, w: stencil.F.sum(v * w)))


def test_crowded_places_list_only_what_they_need(spark, monkeypatch):
    monkeypatch.setattr(network, "BLOCK", 3)
    rng = np.random.default_rng(3)
    places = [(float(x), float(y), float(z)) for x, y, z in rng.integers(0, 40, (14, 3))]
    crowd = [(i * 7 % 211, *places[min(13, int(rng.exponential(3)))], float(rng.integers(1, 6) * 2)) for i in range(211)]
    pores = spark.createDataFrame(crowd, "id long, x double, y double, z double, radius double")
    mean, near, pairs = np.mean([r[4] for r in crowd]), {}, []
    for a in crowd:
        for b in crowd:
            d = float(np.sqrt(sum((u - v) ** 2 for u, v in zip(a[1:4], b[1:4]))))
            if a[0] != b[0] and d <= 3 * mean and (a[4] + b[4] - d) / min(a[4], b[4]) >= 0.1:
                near.setdefault(a[0], []).append((d, b[0], a[4], b[4]))
                pairs += [(a[0], b[0], a[4], b[4], d)] * (a[0] < b[0])
    got = network.nearest_connectable(pores)
    want = [(i, o, d, r, s, k) for i, found in near.items() for k, (d, o, r, s) in enumerate(sorted(found)[:6], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 600
    assert sorted(map(tuple, network.connectable_pairs(pores).collect())) == sorted(pairs)
    # 3,000 pores of one place have 4.5 million pairs, of which their lists need none.
    one = spark.range(3000).selectExpr("id", "1D AS x", "1D AS y", "1D AS z", "2D AS radius")
    assert network.nearest_connectable(one).count() == 18_000


def test_bracket_takes_any_number_of_knots(spark):
    knots = spark.range(20_001).selectExpr("CAST(id AS double) AS x", "id * 2.0D AS y")
    values = spark.createDataFrame([(i, v) for i, v in enumerate((-5.0, 0.0, 0.25, 7.0, 9999.5, 12_345.75, 20_000.0, 30_000.0, None))], "id long, gray double")
    got = {r["id"]: r["interpolated"] for r in network.bracket(values, knots, "gray").collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 0.5, 3: 14.0, 4: 19_999.0, 5: 24_691.5, 6: 40_000.0, 7: 40_000.0, 8: None}
    assert [r["interpolated"] for r in network.bracket(values.where("id = 3"), knots.limit(0), "gray").collect()] == [None]


def test_vp_vs_of_many_points(spark):
    rng = np.random.default_rng(4)
    points = [(i, float(rng.integers(0, 6)) + 0.5 * (i % 2), float(rng.integers(0, 40)), float(rng.integers(10, 30)) / 10) for i in range(300)]
    wanted = [(i, float(rng.integers(-3, 44)), float(rng.integers(0, 9)) + 0.4) for i in range(80)]
    w, p = spark.createDataFrame(wanted, "id long, density double, pressure_mpa double"), spark.createDataFrame(points, "id long, pressure_mpa double, density double, vp_vs double")
    got = {r["id"]: r["vp_vs"] for r in calibrate.predict_vp_vs(w, p).collect()}
    for i, d, q in wanted:
        near = sorted((abs(x[2] - d), x[0], x[2], x[3]) for x in points if abs(x[1] - q) <= 1)[:2]
        if near:
            (_, _, d1, r1), (_, _, d2, r2) = near
            t = min(1.0, max(0.0, (d - d1) / (d2 - d1))) if d1 != d2 else 0.0
            assert abs(got[i] - (r1 + t * (r2 - r1))) < 1e-9
    # 30,000 points at one pressure and 30,000 places of one density: the pairs would be 9e8.
    many = spark.range(30_000).selectExpr("id", "1.0D AS pressure_mpa", "CAST(id AS double) AS density", "2.0D AS vp_vs")
    same = spark.range(30_000).selectExpr("id", "17.5D AS density", "1.2D AS pressure_mpa")
    assert calibrate.predict_vp_vs(same, many).where("vp_vs = 2.0").count() == 30_000


def test_deep_volumes_have_heads():
    part = containers.Part(1, "f", (2, 2, 14_400), 1e-6, 2, 0)
    assert containers._checked(part, 4 * 14_400) is part


def test_clusters_of_one_place_join_there(spark):
    rng = np.random.default_rng(5)
    places = [tuple(map(float, c)) for c in rng.integers(0, 9, (90, 3))]
    of = [int(min(39, rng.exponential(9))) for _ in range(160)]
    ids = rng.permutation(160).tolist()
    least, size = {c: min(i for i, k in zip(ids, of) if k == c) for c in set(of)}, {c: of.count(c) for c in set(of)}
    rows = [(i, *places[int(min(89, rng.exponential(25)))], float(rng.integers(1, 5)), least[c], size[c]) for i, c in zip(ids, of)]
    want = {}
    for a in rows:
        for b in rows:
            if (-b[6], b[5]) < (-a[6], a[5]):
                d = float(np.sqrt(sum((u - v) ** 2 for u, v in zip(a[1:4], b[1:4]))))
                want[a[5]] = min(want.get(a[5], (9e9,)), (d, b[0], a[0], a[4], b[4]))
    points = spark.createDataFrame(rows, "id long, x double, y double, z double, radius double, cluster long, size long")
    got = {r["cluster"]: (r["distance"], r["id2"], r["id"], r["radius"], r["r2"]) for r in network.nearest_before(points).collect()}
    assert got == want and len(want) > 20 and {d == 0 for d, *_ in want.values()} == {True, False}
    # 100,000 single pores of one place, whose pairs would be 5e9, and one without a place.
    one = spark.range(100_000).selectExpr("id", "1D AS x", "1D AS y", "1D AS z", "2D AS radius", "id AS cluster", "1L AS size")
    joined = network.nearest_before(one.unionByName(one.where("id = 7").selectExpr("id + 200000 AS id", "CAST(NULL AS double) AS x", "y", "z", "radius", "id + 200000 AS cluster", "size")))
    assert joined.where("distance = 0 AND id = cluster AND id2 = 0").count() == joined.count() == 99_999


def test_samples_of_one_place_are_searched_once(spark):
    rng = np.random.default_rng(6)
    samples = [(*map(float, rng.integers(0, 6, 3)), float(rng.integers(1, 99))) for _ in range(150)]
    points = [(i, *(float(c) for c in rng.integers(0, 10, 3))) for i in range(120)]
    s, p = spark.createDataFrame(samples, "x double, y double, z double, density double"), spark.createDataFrame(points, "id long, x double, y double, z double")
    one = {r["id"]: r["density"] for r in network.nearest_sample(p, s, 2.0, -1.0).collect()}
    five = {r["id"]: r["density"] for r in network.interpolated_sample(p, s, 2.0, -1.0).collect()}
    for i, *at in points:
        near = sorted((sum((a - b) ** 2 for a, b in zip(at, q[:3])), *q) for q in samples)
        assert one[i] == next((q[4] for q in near if q[0] < 4), -1.0)
        few = [q for q in near if q[0] <= 4][:5]
        exact = max((q[4] for q in few if q[0] == 0), default=None)
        want = exact if exact is not None else sum(q[4] / q[0] for q in few) / sum(1 / q[0] for q in few) if few else -1.0
        assert abs(five[i] - want) < 1e-9
    # 40,000 points and samples of two places: 1.6e9 pairs.
    many = spark.range(40_000)
    crowd, stand = many.selectExpr("1D AS x", "1D AS y", "1D AS z", "CAST(40000 - id AS double) AS density"), many.selectExpr("id", "1D AS x", "1D AS y", "2D AS z")
    assert [tuple(r) for r in network.interpolated_sample(stand, crowd, 2.0, 0.0).groupBy("density").count().collect()] == [(3.0, 40_000)]


def test_section_counts_need_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(network, "BLOCK", 3)
    monkeypatch.setattr(network, "ORDERED", 40)
    rng = np.random.default_rng(7)
    places = [tuple(map(float, c)) for c in rng.integers(0, 30, (9, 2))]
    rows = [(i, *places[min(8, int(rng.exponential(3)))], float(rng.integers(1, 7)) / 2) for i in rng.permutation(170).tolist()]
    p = spark.createDataFrame([*rows, (900, None, 1.0, 2.0), (901, 99.0, 99.0, 1.0)], "id long, x double, y double, radius double")
    n, area = dict.fromkeys((r[0] for r in rows), 0), 0.0
    for i, x, y, r in rows:
        for j, u, v, s in rows:
            d = float(np.hypot(x - u, y - v))
            if i < j and d < 3 * r and d < 1.5 * (r + s):
                n[i], n[j], area = n[i] + 1, n[j] + 1, area + max(0.1, d - r - s) * 0.8 * min(r, s)
    got = network.throat_counts_2d(p).collect()
    assert {r["id"]: r["connections"] for r in got} == n | {900: 0, 901: 0}
    assert abs(sum(r["area"] for r in got) - area) < 1e-6
    listed = network.throats_2d(p.where("id < 900"))
    assert listed.count() * 2 == sum(n.values()) and abs(listed.groupBy().sum("area").first()[0] - area) < 1e-6
    # 100,000 pores of one place have 5e9 pairs.
    one = spark.range(100_000).selectExpr("id", "1D AS x", "1D AS y", "2D AS radius")
    assert [tuple(r) for r in network.throat_counts_2d(one).groupBy("connections").count().collect()] == [(99_999, 100_000)]


def test_resample_gray_joins_nothing(spark):
    rng = np.random.default_rng(8)
    dims, factor = (9, 5, 7), 1.4
    gray = {(x, y, z): int(rng.integers(0, 256)) for x in range(9) for y in range(5) for z in range(7) if rng.random() < 0.25}
    nothing = next(iter(gray))
    v = spark.createDataFrame([(k, *at, None if at == nothing else g) for k in (1, 2) for at, g in gray.items()], "volume_id long, x long, y long, z long, gray long")
    out, t = [int(n * factor) for n in dims], lambda i, n, m: i * float((n - 1) / (m - 1))
    # The general form, corner by corner.
    places = spark.createDataFrame([(k, x, y, z, *(t(i, n, m) for i, n, m in zip((x, y, z), dims, out))) for k in (1, 2) for x in range(out[0]) for y in range(out[1]) for z in range(out[2])], "volume_id long, x long, y long, z long, sx double, sy double, sz double")
    want = sorted(map(str, resample._trilinear(v, places, dims).collect()))
    for d in (2, 3, 32):
        got = resample.resample_gray(v, factor, dims, d)
        assert sorted(map(str, got.collect())) == want and len(want) > 300
    assert "Join" not in plan(got)


def test_tasks_gather_few_voxels(spark):
    assert stencil.GATHERED * 5 * 8 <= 3 << 20
    n = 5 * stencil.GATHERED // 2
    v = spark.range(n, numPartitions=1).selectExpr("1L AS volume_id", "id % 50 AS x", "id div 50 % 50 AS y", "id div 2500 AS z", "id * 7919 % 251 AS gray")
    gray = np.zeros(-(-n // 2500) * 2500)
    gray[:n] = np.arange(n) * 7919 % 251
    block = np.pad(gray.reshape(-1, 50, 50), [(0, 0), (1, 1), (1, 1)], "edge")
    want = np.floor(sum(block[:, j : j + 50, i : i + 50] for j in range(3) for i in range(3)) / 9 + 1e-9)[: n // 2500]
    got = stencil.box_mean_2d(v, 3, (50, 50, -(-n // 2500)), 16).where(f"z < {n // 2500}").orderBy("z", "y", "x").toPandas()["value"].to_numpy()
    assert (got.reshape(want.shape) == want).all()


def test_yield_sorts_curves_once(spark):
    curve = spark.range(60).selectExpr("id % 2 AS test_id", "id div 2 AS step", "(id div 2) * 0.001D AS axial", "least(id div 2, 9) * 50.0D AS stress", "(id div 2) * 0.0004D AS volumetric")
    got = calibrate.bounded_yield(curve)
    assert "Window" not in plan(got) and plan(calibrate.yield_strength(curve)).count("Window") == 0
    assert got.count() == 2


def test_areas_and_connectivity_send_no_voxel_to_its_neighbours(spark):
    rng = np.random.default_rng(17)
    dims, big = (11, 6, 14), 1 << 40
    label = {(x, y, z): [None, 1, 2, big][rng.integers(0, 4)] for x in range(11) for y in range(6) for z in range(14) if rng.random() < 0.6}
    rows = spark.createDataFrame([(v, *k, c) for v in (1, 7) for k, c in label.items()] + [(7, 0, 0, 0, 9)] * ((0, 0, 0) not in label), "volume_id long, x long, y long, z long, label long")
    area, share = {}, {}
    for volume in (1, 7):
        value = label | ({(0, 0, 0): 9} if volume == 7 and (0, 0, 0) not in label else {})
        for k, own in value.items():
            near = [value[t] for a in range(3) for s in (-1, 1) if (t := tuple(c + s * (a == i) for i, c in enumerate(k))) in value]
            known = [c == own for c in near if None not in (c, own)]
            if near:
                share[(volume, *k, own)] = sum(known) / len(known) if known else None
                area.setdefault((volume, own), []).extend([not all(known)] if known else [])
    area = {k: 1.5 * 4 * sum(v) if v else None for k, v in area.items()}
    got = stats.surface_area(rows, 2.0, dims, "label", d=4)
    assert {tuple(r)[:2]: r["area"] for r in got.collect()} == area and got.count() == len(area)
    shares = stats.local_connectivity(rows, dims, d=4)
    assert {tuple(r)[:5]: r["connectivity"] for r in shares.collect()} == share and shares.count() == len(share)
    assert "Join" not in plan(got) and "Join" not in plan(shares)


def test_transform_joins_only_places_inside_the_source(spark):
    rng = np.random.default_rng(10)
    dims, far = (9, 7, 40), 1 << 40
    # Most chunks of volume 5 are empty; places between are 0.
    value = {(5, 1, 2, 3): (200, 3), (5, 8, 6, 39): (None, None)} | {(6, x, y, z): (int(rng.integers(0, 256)), [None, 1, far][rng.integers(0, 3)]) for x in range(9) for y in range(7) for z in range(40) if rng.random() < 0.8}
    v = spark.createDataFrame([(*k, *c) for k, c in value.items()], "volume_id long, x long, y long, z long, gray long, label long")
    m = resample.matrix((1.0, 1.0, 1.0), (0.1, 0.2, 0.3), (0.5, 0.0, -0.5))
    out, inverse = resample.output_dims(dims, (1, 1, 1), m, True), np.linalg.inv(m)
    got = {tuple(r)[:4]: (r["gray"], r["label"]) for r in resample.transform(v, m, out, dims, d=4).collect()}
    assert len(got) == 2 * np.prod(out) == resample.transform(v, m, out, dims, d=4).count()
    inside = 0
    for volume, x, y, z in got:
        s = np.round(inverse[:3, :3] @ (np.array([x, y, z]) - (np.array(out) - 1) / 2) + inverse[:3, 3] + (np.array(dims) - 1) / 2, 9)
        want = (0, 0)
        if (s >= 0).all() and (s <= np.array(dims) - 1).all():
            inside += 1
            b, total = np.floor(s).astype(int), 0.0
            for o in np.ndindex(2, 2, 2):
                total += np.prod(np.where(np.array(o) == 1, s - b, 1 - s + b)) * (value.get((volume, *map(int, b + o)), (0, 0))[0] or 0)
            want = (int(np.round(np.round(total, 9))), value.get((volume, *map(int, np.rint(s))), (0, 0))[1] or 0)
        assert got[volume, x, y, z] == want
    assert 0 < inside < len(got) / 2
    # The rest is made beside the joins, in a branch without one.
    branches = plan(resample.transform(v, m, out, dims, d=4)).split("Range (")
    assert "Union" in branches[0] and "hashpartitioning(volume_id" not in branches[-1].split("BroadcastExchange")[0] and "Python" not in branches[-1]


def test_transform_shuffles_packed_voxels_alone(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(resample, "LINE", 8)
    monkeypatch.setattr(resample, "WRITTEN", 700)
    rng = np.random.default_rng(12)
    # Turned, square to the axes (coordinates on the very sides), scaled, flat; the longest side is each in turn.
    cases = [((5, 4, 11), (1.0, 1.0, 1.0), (0.1, 0.2, 0.3), True), ((6, 4, 5), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0), True), ((3, 9, 4), (1.0, 1.0, 1.0), (np.pi / 2, 0.0, np.pi), True), ((13, 1, 6), (0.5, 2.0, 1.5), (-0.7, 0.4, 2.5), True), ((12, 5, 4), (2.0, 0.6, 1.0), (0.0, -0.5, 0.0), False)]
    for dims, scale, angles, preserve in cases:
        m = resample.matrix(scale, angles, (0.5, 0.0, -0.5))
        out, inverse = resample.output_dims(dims, scale, m, preserve), np.linalg.inv(m)
        value = {(v, *at): (int(rng.integers(1, 256)), int(rng.integers(1, 9))) for v in (1, 4) for at in np.ndindex(*dims) if rng.random() < 0.7}
        got = resample.transform(spark.createDataFrame([(*k, *c) for k, c in value.items()], "volume_id long, x long, y long, z long, gray long, label long"), m, out, dims, d=3)
        rows = {tuple(r)[:4]: tuple(r)[4:] for r in got.collect()}
        assert len(rows) == 2 * np.prod(out) == got.count()
        for volume, *at in rows:
            s = np.round([inverse[i, 3] + (n - 1) / 2 + sum(c * (inverse[i, j]) for j, c in enumerate(np.array(at) - (np.array(out) - 1) / 2)) for i, n in enumerate(dims)], 9)
            want = (0, 0)
            if (s >= 0).all() and (s <= np.array(dims) - 1).all():
                b = np.floor(s).astype(int)
                gray = sum(np.prod(np.where(np.array(o) == 1, s - b, 1 - s + b)) * value.get((volume, *map(int, b + o)), (0, 0))[0] for o in np.ndindex(2, 2, 2))
                want = (int(np.round(np.round(gray, 9))), value.get((volume, *map(int, np.rint(s))), (0, 0))[1])
            assert rows[volume, *at] == want, (dims, volume, at)
        assert "SortMergeJoin" not in plan(got) and "HashJoin" not in plan(got)
    # The box around a long column is nearly all of the rows, and takes few bytes; whole lines of 571 places took 0.32 a place.
    monkeypatch.undo()
    dims = (4, 4, 1001)
    m = resample.matrix((1.0, 1.0, 1.0), (0.0, 0.6, 0.0), (0.5, 0.0, -0.5))
    out = resample.output_dims(dims, (1.0, 1.0, 1.0), m, True)
    column = spark.range(16 * 1001).selectExpr("1L AS volume_id", "id % 4 AS x", "id div 4 % 4 AS y", "id div 16 AS z", "id * 7919 % 251 AS gray", "id % 3 AS label")
    resample.transform(column, m, out, dims).coalesce(4).write.parquet(f"{tmp_path}/box")
    assert sum(p.stat().st_size for p in (tmp_path / "box").glob("*.parquet")) < 0.24 * np.prod(out)


def plain_distances(n, edges):
    far = np.full((n, n), np.inf)
    np.fill_diagonal(far, 0)
    for a, b, w in edges:
        far[a, b] = far[b, a] = min(far[a, b], w)
    for k in range(n):
        far = np.minimum(far, far[:, k : k + 1] + far[k : k + 1])
    return far


def test_paths_take_no_round_for_each_band(spark, monkeypatch):
    rounds = []
    plain = graph.replaced
    monkeypatch.setattr(graph, "replaced", lambda *a: rounds.append(a[1]) or plain(*a))
    chain = [(i, i + 1, 1.0) for i in range(40)]
    one, ends = spark.createDataFrame([(0,)], "source long"), spark.createDataFrame([(40,), (0,)], "node long")
    assert sorted(map(tuple, graph.paths_within(spark.createDataFrame(chain, "a long, b long, w double"), one, ends, 1e9).collect())) == [(0, 0, 0.0), (0, 40, 40.0)]
    assert len(rounds) < 5
    # Many blocks and chunks, nodes without a place, ways that turn out shorter later.
    monkeypatch.setattr(graph, "NODES", 7)
    monkeypatch.setattr(graph, "SOURCES", 2)
    rng = np.random.default_rng(4)
    edges = [(a, b, float(rng.integers(0, 40)) / 4) for a, b in rng.integers(0, 50, (90, 2)).tolist()]
    far = plain_distances(50, edges)
    sources, places = spark.range(0, 50, 6).toDF("source"), spark.createDataFrame([(i, i % 10) for i in range(45)], "node long, place long")
    for limit in (12.0, 1e9):
        got = graph.paths_within(spark.createDataFrame(edges, "a long, b long, w double"), sources, spark.range(25).toDF("node"), limit, places)
        assert sorted(map(tuple, got.collect())) == sorted((i, j, far[i, j]) for i in range(0, 50, 6) for j in range(25) if far[i, j] < limit)


def test_tortuosity_of_pores_that_share_places(spark, monkeypatch):
    monkeypatch.setattr(network, "RANKED", 4)
    monkeypatch.setattr(network, "SIDE_BINS", 3)
    walked = []
    plain = network.paths_within
    monkeypatch.setattr(network, "paths_within", lambda arcs, sources, *a: walked.append(sources.distinct().count()) or plain(arcs, sources, *a))
    rng = np.random.default_rng(6)
    places = [(10.0 * x + float(rng.random()), 10.0 * y + float(rng.random()), 5.0) for x in range(5) for y in range(4)]
    at = np.array([places[i // 3] for i in range(60)])
    pores = spark.createDataFrame([(i, *map(float, at[i]), 1.0) for i in range(60)], "id long, x double, y double, z double, radius double")
    alike = [(3 * i + j, 3 * i + k) for i in range(20) for j, k in ((0, 1), (0, 2), (1, 2))]
    near = [(3 * i + int(rng.integers(3)), 3 * j + int(rng.integers(3))) for i in range(20) for j in range(i + 1, 20) if np.linalg.norm(at[3 * i] - at[3 * j]) < 16 and rng.random() < 0.5]
    for cut in (False, True):  # cut: nothing leads along x
        edges = [(a, b, float(np.linalg.norm(at[a] - at[b]))) for a, b in alike + near if not cut or (at[a][0] < 15) == (at[b][0] < 15)]
        far, want, top = plain_distances(60, edges), {"z": 1.0}, np.searchsorted([2, 3, 4], 2 * len(edges) / 60, "right")
        for k, axis in enumerate("xy"):
            v = at[:, k]
            straight = v.max() - v.min()
            paths = sorted(d for d in far[np.ix_(v <= v.min() + 2, v >= v.max() - 2)].flat if straight <= d < 15 * straight)
            want[axis] = min(max(paths[len(paths) // 2] / straight, 1.0), (11.0, 8.0, 6.5, 5.0)[top]) if paths else None
        e = spark.createDataFrame(edges, "pore1 long, pore2 long, distance double")
        got = {r["axis"]: r["tortuosity"] for r in network.axis_tortuosity(pores, e).collect()}
        assert (want["x"] is None) == cut and got.keys() == want.keys() and want["y"] > 1
        assert all(got[a] is None if w is None else abs(got[a] - w) < 1e-9 for a, w in want.items())
        assert abs(network.tortuosity(pores, e).first()["tortuosity"] - np.mean([w for w in want.values() if w])) < 1e-9
    assert max(walked) <= 20
