"""Operators against plain versions, on small volumes made by hand."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomolake.functions import physics as fx
from tomolake.operators import calibrate, components, core, labels, network, resample, sections, series, stats, stencil, voxels
from tomolake.operators.graph import connected_components, paths_within, shortest_paths
from tomolake.sources import files
from tomolake.streaming import frames

DIMS = (7, 6, 5)


def volume(spark, cube: np.ndarray, label: np.ndarray | None = None):
    z, y, x = (a.ravel().tolist() for a in np.indices(cube.shape))
    lab = (np.zeros(cube.shape, int) if label is None else label).ravel().tolist()
    return spark.createDataFrame(list(zip([1] * len(x), x, y, z, cube.ravel().tolist(), lab, strict=True)), "volume_id long, x long, y long, z long, gray long, label long")


def cube_of(df, value="value", shape=DIMS[::-1]):
    p = df.toPandas()
    out = np.full(shape, np.nan)
    out[p["z"], p["y"], p["x"]] = p[value]
    return out


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(1).integers(0, 256, DIMS[::-1])


@pytest.fixture(scope="module")
def grays(spark, noise):
    return volume(spark, noise).cache()


def test_halo_equals_join_form(spark, grays, noise):
    offsets = [(o, 1.0) for o in itertools.product((-1, 0, 1), repeat=3)]
    joined = cube_of(stencil.joined(grays, offsets, lambda v, w: F.sum(v) / F.sum(w), dims=DIMS))
    for d in (2, 3, 64):
        halo = cube_of(stencil.halo(grays, lambda b: sum(v for _, v in stencil.shifts(b, 1)) / 27, 1, DIMS, d))
        assert np.allclose(halo, joined)


def test_non_local_means(grays, noise):
    t, s, h = 1, 1, 40.0
    p = np.pad(noise.astype(float), t + s, "edge")
    want = np.zeros(noise.shape)
    cube = lambda at: p[tuple(slice(a - t, a + t + 1) for a in at)]
    for at in np.ndindex(noise.shape):
        c = np.array(at) + t + s
        w = [(np.exp(-((cube(c) - cube(c + o)) ** 2).mean() / h**2), p[tuple(c + o)]) for o in map(np.array, itertools.product((-1, 0, 1), repeat=3))]
        want[at] = np.clip(np.floor(sum(a * b for a, b in w) / sum(a for a, _ in w) + 0.5 + 1e-9), 0, 255)
    assert np.array_equal(cube_of(stencil.non_local_means(grays, t, s, h, DIMS, 3)), want)


def test_white_top_hat(grays, noise):
    disk = [(j, i) for j, i in itertools.product((-1, 0, 1), repeat=2) if i * i + j * j <= 1]

    def part(a, f):
        out = np.zeros(a.shape)
        for z, y, x in np.ndindex(a.shape):
            out[z, y, x] = f([a[z, y + j, x + i] for j, i in disk if 0 <= y + j < a.shape[1] and 0 <= x + i < a.shape[2]])
        return out

    want = noise - part(part(noise, min), max)
    assert np.array_equal(cube_of(stencil.white_top_hat(grays, 1, DIMS, 3)), want)


def test_gaussian_2d_rounds_between_passes(grays, noise):
    w = np.array([np.exp(-0.5), 1, np.exp(-0.5)])
    w /= w.sum()
    p = np.pad(noise, ((0, 0), (0, 0), (1, 1)), "edge")
    a = np.floor(w[0] * p[:, :, :-2] + w[1] * p[:, :, 1:-1] + w[2] * p[:, :, 2:] + 0.5 + 1e-9)
    p = np.pad(a, ((0, 0), (1, 1), (0, 0)), "edge")
    a = np.floor(w[0] * p[:, :-2] + w[1] * p[:, 1:-1] + w[2] * p[:, 2:] + 0.5 + 1e-9)
    assert np.array_equal(cube_of(stencil.gaussian_2d(grays, 3, 1.0, DIMS, 4)), a)


@pytest.mark.parametrize(("name", "cells", "six", "twenty_six"), [("face", [(0, 0, 0), (1, 0, 0)], 1, 1), ("edge", [(0, 0, 0), (1, 1, 0)], 2, 1), ("corner", [(2, 2, 2), (3, 3, 3)], 2, 1), ("chain", [(i, 0, 0) for i in range(7)], 1, 1), ("one", [(6, 5, 4)], 1, 1)])
def test_connectivity(spark, name, cells, six, twenty_six):
    lab = np.zeros(DIMS[::-1], int)
    for x, y, z in cells:
        lab[z, y, x] = 1
    v = volume(spark, lab, lab)
    for offsets, n in ((components.SIX, six), (components.TWENTY_SIX, twenty_six)):
        found = components.label_components(v, DIMS, offsets, chunk=2)
        assert found.count() == len(cells)
        assert found.select("component").distinct().count() == n


def test_components_of_random_labels(spark):
    lab = np.random.default_rng(3).integers(0, 3, DIMS[::-1])
    found = components.label_components(volume(spark, lab, lab), DIMS, components.SIX, chunk=3).toPandas()
    want = np.full(lab.shape, -1)
    for start in zip(*np.nonzero(lab), strict=True):
        if want[start] >= 0:
            continue
        stack, name = [start], (start[0] * DIMS[1] + start[1]) * DIMS[0] + start[2]
        want[start] = name
        while stack:
            at = stack.pop()
            for axis, step in itertools.product(range(3), (-1, 1)):
                p = list(at)
                p[axis] += step
                p = tuple(p)
                if all(0 <= a < n for a, n in zip(p, lab.shape, strict=True)) and lab[p] == lab[start] and want[p] < 0:
                    want[p] = name
                    stack.append(p)
    assert (want[found["z"], found["y"], found["x"]] == found["component"]).all()
    assert len(found) == (lab > 0).sum()


def test_empty_material(spark):
    v = volume(spark, np.zeros(DIMS[::-1], int))
    assert components.label_components(v, DIMS).count() == 0
    assert components.remove_islands(v, DIMS, 5).count() == v.count()


def test_graph(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in connected_components(e).collect()}
    assert roots == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    w = e.withColumn("w", F.lit(1.5))
    paths = shortest_paths(w, spark.createDataFrame([(0,)], "source long"))
    assert {r["node"]: r["distance"] for r in paths.collect()} == {i: 1.5 * i for i in range(41)}


def test_chunks_round_trip(grays):
    back = voxels.from_chunks(voxels.to_chunks(grays, DIMS, 4), DIMS)
    assert back.exceptAll(grays.select(back.columns)).isEmpty() and back.count() == grays.count()


def test_write_back_restores(spark, grays):
    v = labels.relabel(grays, F.col("gray") < 60, 1)
    sub = voxels.sub_volume(v, voxels.material_bounds(v, DIMS), 1)
    assert voxels.write_back(v, sub, "gray").select("x", "y", "z", "gray").exceptAll(v.select("x", "y", "z", "gray")).isEmpty()


def test_transform_against_numpy(grays, noise):
    m = resample.matrix((1.0, 1.0, 1.0), (0.0, 0.0, 0.4), (0.5, 0.0, 0.0))
    out = resample.output_dims(DIMS, (1, 1, 1), m, True)
    inverse, want = np.linalg.inv(m), np.zeros(out[::-1])
    for z, y, x in np.ndindex(want.shape):
        at = np.array([x, y, z]) - (np.array(out) - 1) / 2
        s = np.round(inverse[:3, :3] @ at + inverse[:3, 3] + (np.array(DIMS) - 1) / 2, 9)
        if (s >= 0).all() and (s <= np.array(DIMS) - 1).all():
            b = np.floor(s).astype(int)
            total = 0.0
            for o in itertools.product((0, 1), repeat=3):
                w = np.prod(np.where(np.array(o) == 1, s - b, 1 - s + b))
                i, j, k = np.minimum(b + o, np.array(DIMS) - 1)
                total += w * noise[k, j, i]
            want[z, y, x] = np.round(np.round(total, 9))
    assert np.array_equal(cube_of(resample.transform_gray(grays, m, out, DIMS), "gray", out[::-1]), want)


def test_binning_keeps_the_mean(spark, noise):
    v = volume(spark, np.full((4, 4, 4), 9))
    assert resample.bin_volume(v, 2, (4, 4, 4)).agg(F.avg("gray"), F.count("*")).first()[:] == (9.0, 8)


def test_paths_within_a_limit(spark):
    """Several bands, several sources, against all-pairs relaxation."""
    rng = np.random.default_rng(8)
    n, edges = 60, {}
    for a, b in rng.integers(0, 60, (130, 2)).tolist():
        if a != b:
            edges[min(a, b), max(a, b)] = float(rng.integers(1, 40)) / 4
    far = np.full((n, n), np.inf)
    np.fill_diagonal(far, 0)
    for (a, b), w in edges.items():
        far[a, b] = far[b, a] = min(far[a, b], w)
    for k in range(n):
        far = np.minimum(far, far[:, k : k + 1] + far[k : k + 1])
    e = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()] + [(3, 3, 1.0)], "a long, b long, w double")
    for limit in (14.0, 1e9, 0.0):
        got = paths_within(e, spark.createDataFrame([(i,) for i in (0, 5, 9, 9)], "source long"), spark.createDataFrame([(i,) for i in range(30)] * 2, "node long"), limit)
        assert {tuple(r) for r in got.collect()} == {(i, j, far[i, j]) for i in (0, 5, 9) for j in range(30) if far[i, j] < limit}


def test_capped_edges_against_one_pass(spark):
    rng = np.random.default_rng(9)
    for k, hub in ((1, 12), (3, 12), (6, 40)):
        edges = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, hub, (260, 2)).tolist() if a != b})
        edges = [(a, b, r) for r, (a, b) in zip(rng.permutation(len(edges)).tolist(), edges, strict=True)]
        degree, want = {}, set()
        for a, b, _ in sorted(edges, key=lambda e: (e[0], e[2])):
            if degree.get(a, 0) < k and degree.get(b, 0) < k:
                degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
                want.add((a, b))
        got = network.capped(spark.createDataFrame(edges, "a long, b long, rank long"), k, ["a", "rank"])
        assert {(r["a"], r["b"]) for r in got.collect()} == want and len(want) < len(edges)


def joined_one_by_one(pores, edges):
    """Clusters in order of size and least pore, each by its closest pore to all that went before."""
    root = {i: i for i in pores}
    for _ in pores:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    groups = {}
    for i, r in root.items():
        groups.setdefault(r, []).append(i)
    order = sorted(groups.values(), key=lambda g: (-len(g), min(g)))
    merged, new = list(order[0]), set()
    for g in order[1:]:
        d, i, j = min((float(np.linalg.norm(pores[i][0] - pores[j][0])), i, j) for i in merged for j in g)
        new.add((min(i, j), max(i, j), round(d, 9)))
        merged += g
    return new


def test_flow_path_joins_all_clusters(spark):
    """Far clusters, single pores, equal sizes and pores at one place; at least three joins."""
    rng = np.random.default_rng(12)
    at = [*rng.normal(0, 3, (30, 3)), *rng.normal((100, 0, 5), 3, (30, 3)), *rng.uniform(-300, 300, (25, 3)), (5.0, 5.0, 400.0), (5.0, 5.0, 400.0)]
    at[61], at[75] = at[60] + 1, at[70] + 1  # linked ones lie close, so that no path leads from inlets to outlets
    pores = {i: (np.array(c, float), float(rng.integers(1, 4))) for i, c in enumerate(at)}
    edges = {(i, i + 1) for i in [*range(0, 29), *range(30, 59)]} | {(60, 61), (70, 75)}
    p = spark.createDataFrame([(i, *map(float, c), r, 1.0) for i, (c, r) in pores.items()], "id long, x double, y double, z double, radius double, volume double")
    e = spark.createDataFrame([(a, b, 1.0, 1.0, 1.0, 1.0) for a, b in edges], "pore1 long, pore2 long, distance double, radius double, length double, volume double")
    out = network.enforce_flow_path(p, e).collect()
    new = [r for r in out if (r["pore1"], r["pore2"]) not in edges]
    assert {(r["pore1"], r["pore2"], round(r["distance"], 9)) for r in new} == joined_one_by_one(pores, edges)
    assert len(new) == 26 and len(out) == len(edges) + 26
    for r in new:
        small, both = min(pores[r["pore1"]][1], pores[r["pore2"]][1]), pores[r["pore1"]][1] + pores[r["pore2"]][1]
        assert np.allclose([r["radius"], r["length"]], [0.4 * small, max(0.1, r["distance"] - both)])


def test_suppression_and_throats_against_plain_versions(spark):
    rng = np.random.default_rng(5)
    b = [(i, 0, int(x), int(y), 6, 6, float(s), True) for i, (x, y, s) in enumerate(zip(rng.integers(0, 40, 60), rng.integers(0, 40, 60), rng.random(60), strict=True))]
    kept = []
    for r in sorted(b, key=lambda r: (-r[6], r[0])):
        def iou(q, r=r):
            o = max(0, min(r[2], q[2]) + 6 - max(r[2], q[2])) * max(0, min(r[3], q[3]) + 6 - max(r[3], q[3]))
            return o / (72 - o)
        if all(iou(q) <= 0.5 for q in kept):
            kept.append(r)
    boxes = spark.createDataFrame(b, "det_id long, slice long, x long, y long, w long, h long, score double, selected boolean")
    assert {r["det_id"] for r in labels.suppress_boxes(boxes).collect()} == {r[0] for r in kept}

    p = [(i, *map(float, rng.integers(0, 60, 3)), float(rng.integers(3, 12))) for i in range(80)]
    mean = np.mean([r[4] for r in p])
    near = {}
    for a, c in itertools.permutations(p, 2):
        d = float(np.linalg.norm(np.array(a[1:4]) - np.array(c[1:4])))
        if d <= 3 * mean and (a[4] + c[4] - d) / min(a[4], c[4]) >= 0.1:
            near.setdefault(a[0], []).append((d, c[0]))
    degree, want = dict.fromkeys(range(80), 0), set()
    for i in range(80):
        for _, j in sorted(near.get(i, []))[:6]:
            if i < j and degree[i] < 6 and degree[j] < 6:
                degree[i], degree[j] = degree[i] + 1, degree[j] + 1
                want.add((i, j))
    pores = spark.createDataFrame([(*r, 1.0) for r in p], "id long, x double, y double, z double, radius double, volume double")
    found = network.throats(pores)
    assert {(r["pore1"], r["pore2"]) for r in found.collect()} == want
    at = {r[0]: (np.array(r[1:4]), r[4]) for r in p}
    for r in found.collect():
        (u, ru), (v, rv) = at[r["pore1"]], at[r["pore2"]]
        d = float(np.linalg.norm(u - v))
        radius, length = 0.4 * min(ru, rv), max(0.1, d - ru - rv)
        assert np.allclose([r["radius"], r["length"], r["volume"], r["distance"]], [radius, length, np.pi * radius**2 * length, d])
    joined = network.enforce_flow_path(pores, found).cache()
    edges = {(r["pore1"], r["pore2"]): r["distance"] for r in joined.collect()}
    assert want <= set(edges)
    sides = {}
    for r in network.inlets_outlets(pores).collect():
        sides.setdefault(r["side"], set()).add(r["id"])
    order = sorted(range(80), key=lambda i: (at[i][0][2], i))
    assert sides == {"inlet": set(order[:8]), "outlet": set(order[-8:])}
    root = list(range(80))
    for _ in range(80):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {root[i] for i in sides["inlet"]} & {root[i] for i in sides["outlet"]}
    ratios = []
    for axis in range(3):
        x = np.array([at[i][0][axis] for i in range(80)])
        near = 2 * mean
        inlet, outlet = [i for i in range(80) if x[i] <= x.min() + near], [i for i in range(80) if x[i] >= x.max() - near]
        d = np.full((80, 80), np.inf)
        np.fill_diagonal(d, 0)
        for (a, b), w in edges.items():
            d[a, b] = d[b, a] = min(d[a, b], w)
        for k in range(80):
            d = np.minimum(d, d[:, [k]] + d[[k], :])
        straight = x.max() - x.min()
        paths = sorted(d[a, b] for a in inlet for b in outlet if straight <= d[a, b] < 15 * straight)
        if paths:
            c = 2 * len(edges) / 80
            top = 11.0 if c < 2 else 8.0 if c < 3 else 6.5 if c < 4 else 5.0
            ratios.append(min(max(paths[len(paths) // 2] / straight, 1.0), top))
    got = network.tortuosity(pores, joined).first()["tortuosity"]
    assert abs(got - (np.mean(ratios) if ratios else np.inf)) < 1e-9


def plain_peaks(v, prominence, distance):
    found = {}
    for i in range(1, len(v) - 1):
        if v[i] > v[i - 1] and v[i] > v[i + 1]:
            left = max([j for j in range(i) if v[j] > v[i]], default=0)
            right = min([j for j in range(i + 1, len(v)) if v[j] > v[i]], default=len(v) - 1)
            out = v[i] - max(min(v[left : i + 1]), min(v[i : right + 1]))
            if out >= prominence or (v[i] > 0 and out >= 0.5 * v[i]):
                found[i] = out
    kept = []
    for i in sorted(found, key=lambda i: (-v[i], i)):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)
    return {i: found[i] for i in kept}


def test_peaks_against_plain_version(spark):
    v = np.random.default_rng(2).random(60) * 10
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "k long, i long, v double")
    found = series.peaks(df, ["k"], "i", 2.0, 4)
    assert {r["i"]: r["prominence"] for r in found.collect()} == plain_peaks(v.tolist(), 2.0, 4)
    at = sorted(plain_peaks(v.tolist(), 2.0, 4))
    want = dict(zip(at, [round((b - a) * 0.5, 9) for a, b in zip(at, at[1:], strict=False)] + [0.0], strict=True))
    assert {r["i"]: round(r["spacing_mm"], 9) for r in series.peak_spacing(found, ["k"], "i", 0.5).collect()} == want
    dark = {r["i"] for r in series.dark_peaks(df, ["k"], "i", 2.0, 4).collect()}
    assert dark == set(plain_peaks((-v).tolist(), 2.0, 4))
    mirror = {r["i"] for r in series.dark_peaks(df, ["k"], "i", 2.0, 4, mirrored=True).collect()}
    assert mirror == set(plain_peaks((v.max() - v + v.min()).tolist(), 2.0, 4))


def test_band_pass_against_plain_version(spark):
    v = np.random.default_rng(4).random(30)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "k long, i long, v double")
    y = out = 0.0
    want = [(0.0, 0.0)]
    for a, b in itertools.pairwise(v):
        y = 0.9 * (y + b - a)
        out = out + 0.3 * (y - out)
        want.append((y, out))
    got = [(r["high_pass"], r["band_pass"]) for r in series.band_pass(df, ["k"], "i", 0.9, 0.3).orderBy("i").collect()]
    assert np.allclose(got, want)


CURVE = "test_id string, step long, axial double, lateral double, volumetric double, stress double"


@pytest.fixture(scope="module")
def bilinear(spark):
    rows = [("t", i, i * 1e-3, -0.3 * i * 1e-3, 0.4 * i * 1e-3, min(i, 20) * 50.0 if i < 30 else 700.0) for i in range(40)]
    return spark.createDataFrame(rows, CURVE).cache()


def test_modulus_of_a_curve(bilinear):
    """The fit takes in the first row off the line, whose strain is the proportional limit."""
    assert calibrate.proportional_limit(bilinear).first()["limit"] == 0.021
    want = np.polyfit(np.arange(22) * 1e-3, np.minimum(np.arange(22), 20) * 50.0, 1)[0]
    assert abs(calibrate.youngs_modulus(bilinear).first()["youngs"] - want) < 1e-6


def test_poisson_yield_and_brittleness(spark, bilinear):
    assert abs(calibrate.poisson_ratio(bilinear).first()["poisson"] - 0.3) < 1e-9
    assert abs(calibrate.yield_strength(bilinear).first()["yield_strength"] - 1000) < 1e-6
    assert abs(calibrate.bounded_yield(bilinear).first()["yield_strength"] - 0.01 * calibrate.youngs_modulus(bilinear).first()["youngs"]) < 1e-6
    b = calibrate.brittleness(bilinear).first()
    assert b["softens"] and b["peak_stress"] == 1000
    few = bilinear.where("step < 3").withColumns({"lateral": F.lit(None).cast("double"), "volumetric": F.lit(None).cast("double")})
    tests = spark.createDataFrame([("t", 0.0, None, 0.24, 30.0, 10.0)], "test_id string, confining double, youngs double, poisson double, sigma1 double, sigma3 double")
    assert calibrate.poisson_ratio(few, tests).first()["poisson"] == 0.3  # ductile, at a ratio of 2
    flat = spark.createDataFrame([("f", i, i * 1e-4, None, None, 5.0 * i) for i in range(12)], CURVE)
    assert calibrate.yield_strength(flat).first()["yield_strength"] == 55  # neither crosses, leaves the line nor bends


def test_mohr_coulomb(spark):
    f = spark.createDataFrame([(s + 5 + 0.5 * s, s - 5 - 0.5 * s) for s in (20.0, 30.0, 40.0)], "sigma1 double, sigma3 double")
    m = calibrate.mohr_coulomb(f).first()
    assert abs(m["friction_angle"] - 30) < 1e-6 and abs(m["cohesion"] - 5 / np.cos(np.pi / 6)) < 1e-6
    m = calibrate.mohr_coulomb(f, as_line=True).first()
    assert abs(m["friction_angle"] - np.degrees(np.arctan(0.5))) < 1e-6 and abs(m["cohesion"] - 5) < 1e-6
    one = calibrate.mohr_coulomb(f.limit(1), brittle=0.9).first()
    r, c = 15.0, 20.0
    sine = r / (c + 0.1 * r)
    assert abs(one["friction_angle"] - min(55, np.degrees(np.arcsin(sine)) * 1.1)) < 1e-9 and abs(one["cohesion"] - max(0.1, (r - c * sine) / np.cos(np.arcsin(sine)) * 0.9)) < 1e-9
    assert calibrate.mohr_coulomb(f.limit(0)).count() == 0
    tests = spark.createDataFrame([(1.0,), (2.0,)], "strength double")
    assert calibrate.tension_cutoff(tests, 10.0, 30.0).first()["cutoff"] and not calibrate.tension_cutoff(tests, 0.5, 30.0).first()["cutoff"]


def test_constant_abscissa(spark):
    p = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "gray double, density double")
    r = calibrate.density_line(p).first()
    assert (r["slope"], r["intercept"]) == (0.0, 2.0)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(run, i, 0.0 if i < 3 + run else 1.0, 0.0) for run in range(4) for i in range(10)]
    f = spark.createDataFrame(rows, frames.STEP)
    for part in (0, 1):
        f.where(f"step div 5 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "frames"))
    q = frames.stream_p_arrivals(frames.read_frames(spark, str(tmp_path / "frames"), stream=True)).writeStream.format("memory").queryName("arrivals").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in frames.p_arrivals(f).collect()}
    assert {tuple(r) for r in spark.table("arrivals").collect()} == want


def test_sources(spark, tmp_path, grays, noise):
    for i, n in ((2, "s2.raw"), (10, "s10.raw"), (1, "s1.raw")):
        (tmp_path / n).write_bytes(bytes([i] * 42))
    v = files.read_raw_stack(spark, str(tmp_path), 7, 6)
    assert [r["g"] for r in v.groupBy("z").agg(F.max("gray").alias("g")).orderBy("z").collect()] == [1, 2, 10]
    images = {r["name"]: bytes(r["payload"]) for r in files.slice_images(grays, 7, 6).collect()}
    assert images["slice_0002.raw"] == noise[2].astype(np.uint8).tobytes()
    files.write_volume(grays, str(tmp_path / "v"))
    assert files.read_volumes(spark, str(tmp_path / "v"), 1).count() == noise.size
    (tmp_path / "c.xml").write_text("<C><CalibrationPoint><Density>2500</Density></CalibrationPoint><CalibrationPoint><Density>2600</Density></CalibrationPoint></C>")
    assert files.read_calibration_xml(spark, str(tmp_path / "c.xml"), "Density double").agg(F.sum("Density")).first()[0] == 5100
    (tmp_path / "n.csv").write_text("# a comment\nh,h,h,h,h\n1,2,3,4,ok\nx,2,3,4,bad\n")
    assert files.read_relaxation_csv(spark, str(tmp_path / "n.csv")).count() == 1
    log = spark.createDataFrame([(0, "T2=9 Amp=9"), (1, "[DATA]"), (2, "T2 = 1.5 ms Amplitude: 0.25"), (3, "10 0.5"), (4, "noise"), (5, "(100, 2e-1)")], "n long, line string")
    assert [(r["t2"], r["amplitude"]) for r in files.relaxation_log(log, "[DATA]").orderBy("n").collect()] == [(1.5, 0.25), (10.0, 0.5), (100.0, 0.2)]
    (tmp_path / "m.csv").write_text('id,name,view,slice,x1,y1,x2,y2,distance,unit,text,created\n1,"a, ""b""",XY,2,0,0,3,4,5.0,m,t,2024-05-06 07:08:09\n')
    m = files.read_measurements(spark, str(tmp_path / "m.csv")).first()
    assert m["name"] == 'a, "b"' and m["created"].hour == 7
    bad = spark.createDataFrame([(1, 10, 10, 10, 64, 1e-6), (2, 0, 10, 20000, 8, 2.0)], "volume_id long, width long, height long, depth long, chunk_dim long, pixel_size double")
    assert {tuple(r) for r in files.header_violations(bad).collect()} == {(2, "dimension"), (2, "chunk_dim"), (2, "pixel_size")}
    files.write_csv(stats.particles(components.label_components(volume(spark, noise, (noise > 200).astype(int)), DIMS), 1e-6), str(tmp_path / "p"))
    assert "center_x" in spark.read.csv(str(tmp_path / "p"), header=True).columns


def test_sinks(spark, tmp_path, grays, noise):
    lab = (noise > 200).astype(int)
    found = stats.particles(components.label_components(volume(spark, noise, lab), DIMS), 1e-6)
    files.write_particle_csv(found, str(tmp_path / "p"))
    csv = spark.read.csv(str(tmp_path / "p"), header=True, inferSchema=True)
    assert len(csv.columns) == 16 and csv.agg(F.sum("VoxelCount"), F.min("Width")).first()[:] == (int(lab.sum()), 1)
    m = spark.createDataFrame([(1, "Pore", 0, 0, 63, False, 1000.0, True)], files.MATERIAL)
    files.write_materials(m, str(tmp_path / "m"))
    assert files.read_materials(spark, str(tmp_path / "m")).collect() == m.collect()
    files.write_statistics_csv(stats.material_statistics(grays, m, 1e-6), str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).columns == ["Material", "Voxels", "Volume (µm³)", "Volume (mm³)", "Volume (cm³)", "Percentage"]
    runs = series.run_lengths(volume(spark, noise, lab))
    files.write_particle_result(found, runs, str(tmp_path / "r"))
    back = files.read_particle_result(spark, str(tmp_path / "r"))
    assert back[0].count() == found.count() and series.from_run_lengths(back[1]).count() == noise.size
    pores = spark.createDataFrame([(1, 2.0, 3.0, 1.5, 0.0, 1.0, 2.0, 4)], "id long, volume double, area double, radius double, x double, y double, z double, connections long")
    throats = spark.createDataFrame([(1, 2, 0.5, 2.0, 3.0)], "pore1 long, pore2 long, radius double, length double, volume double")
    props = spark.createDataFrame([(2.0, 3.0, 0.25)], "pore_volume double, throat_volume double, porosity double")
    files.write_network_csv(pores, throats, props, str(tmp_path / "n"))
    assert spark.read.csv(str(tmp_path / "n/pores"), header=True).first()["Connections"] == "4"
    files.write_network(str(tmp_path / "nw"), pores=pores, throats=throats)
    assert [t.count() for t in files.read_network(spark, str(tmp_path / "nw"), "pores", "throats")] == [1, 1]
    files.write_selected(pores, spark.createDataFrame([(1,), (9,)], "id long"), str(tmp_path / "sel"))
    assert spark.read.csv(str(tmp_path / "sel"), header=True).count() == 1
    text = ["# Pores", "ID,Volume,a,b,c,d,e,f", "1,1,1,2.0,0,0,0,3", "2,1,1,4.0,0,0,0,5", "", "# Network Statistics", "Porosity,0.2", "Tortuosity,1.7", "", "9,9,9,9,9,9,9,9"]
    lines = spark.createDataFrame(list(enumerate(text)), "n long, line string")
    assert files.read_network_lines(lines).first()[:] == (0.2, 1.7, 3.0, 4.0)
    files.write_permeability_csv(spark.createDataFrame([("darcy", 1.0, 0.5)], "method string, permeability double, corrected double"), spark.createDataFrame([(1, 2.0)], "pore_id long, pressure double"), str(tmp_path / "k"))
    assert spark.read.csv(str(tmp_path / "k/permeability"), header=True).first()["Method"] == "darcy"
    files.write_band_csv(spark.createDataFrame([("XZ", 1, 0, 0.5, 1, 0)], "view string, slice long, row long, v double, dark long, bright long"), str(tmp_path / "b"))
    assert spark.read.csv(str(tmp_path / "b"), header=True).columns == ["Slice Type", "Row/Col", "Value", "Dark Peak", "Bright Peak"]
    ms = spark.createDataFrame([(1, 'a, "b"', "XY", 2, 0, 0, 3, 4, 5e-6, "2024-05-06 07:08:09")], "id long, name string, view string, slice long, x1 long, y1 long, x2 long, y2 long, distance double, created string").withColumn("created", F.to_timestamp("created"))
    files.write_measurements(ms, str(tmp_path / "ms"))
    assert spark.read.csv(str(tmp_path / "ms"), header=True).first()["Distance(µm)"] == "5.00"
    files.write_calibration_xml(spark.createDataFrame([(2500.0,)], "Density double"), str(tmp_path / "c.xml"))
    assert files.read_calibration_xml(spark, str(tmp_path / "c.xml"), "Density double").first()[0] == 2500
    v = files.acoustic_result(spark.createDataFrame([(10, 25)], "p_step long, s_step long"))
    files.write_parameters(v, {"dead_time": "steps"}, str(tmp_path / "pa"))
    assert spark.read.csv(str(tmp_path / "pa"), header=True).first()[:] == ("dead_time", "15.0", "steps")
    curve = files.velocity_series(spark.createDataFrame([(3, 0.5, None)], "step long, displacement double, intensity double"), 0.0012, 1000.0)
    assert curve.first()[:] == (0.003, 0.5, 0.0)
    files.write_curve(curve, v, str(tmp_path / "cv"))
    assert spark.read.json(str(tmp_path / "cv/curve_json")).count() == 1


def test_chunked_volume(spark, tmp_path):
    w, h, d, side = 5, 4, 3, 2
    cube = np.random.default_rng(6).integers(0, 256, (d, h, w)).astype(np.uint8)
    n = [-(-x // side) for x in (w, h, d)]
    head = np.array([w, h, d, side, 8], "<i4").tobytes() + np.array([1e-6], "<f8").tobytes() + np.array(n, "<i4").tobytes()
    body = b""
    for cz, cy, cx in np.ndindex(n[2], n[1], n[0]):
        block = np.zeros((side,) * 3, np.uint8)
        part = cube[cz * side : cz * side + side, cy * side : cy * side + side, cx * side : cx * side + side]
        block[: part.shape[0], : part.shape[1], : part.shape[2]] = part
        body += block.tobytes()
    (tmp_path / "volume.bin").write_bytes(head + body)
    got = files.read_chunked_volume(spark, str(tmp_path / "volume.bin"))
    assert np.array_equal(cube_of(got, "gray", (d, h, w)), cube)
    (tmp_path / "short.bin").write_bytes(head + body[:-1])
    with pytest.raises(Exception, match="don't fit"):
        files.read_chunked_volume(spark, str(tmp_path / "short.bin")).count()


def test_core_circle_and_interpolation(spark):
    dims = (60, 50, 3)
    z, y, x = np.indices(dims[::-1])
    cube = np.where((x - 31) ** 2 + (y - 24) ** 2 <= 18**2, 200, 10)
    r = core.core_circle(volume(spark, cube), dims, "XY", 1).first()
    assert r["radius"] == 15 and abs(r["a"] - 30) <= 2 and abs(r["b"] - 25) <= 2
    blank = core.core_circle(volume(spark, np.full(dims[::-1], 7)), dims, "XY", 1).first()
    assert (blank["a"], blank["b"], blank["radius"]) == (30, 25, 25)
    marks = spark.createDataFrame([(1, 4, 4, 1), (1, 6, 4, 1), (1, 12, 9, 7)], "volume_id long, x long, y long, z long")
    size = (20, 16, 10)
    mask = np.zeros(size[::-1], bool)

    def line(a, b, radius):
        n = max(abs(p - q) for p, q in zip(a, b, strict=True))
        for i in range(n + 1):
            at = [int(np.round(p + (q - p) * i / n)) for p, q in zip(a, b, strict=True)]
            for o in itertools.product(range(-radius, radius + 1), repeat=3):
                q = [p + c for p, c in zip(at, o, strict=True)]
                if sum(c * c for c in o) <= radius * radius and all(0 <= v < m for v, m in zip(q, size, strict=True)):
                    mask[q[2], q[1], q[0]] = True

    for a, b, radius in (((4, 4, 1), (12, 9, 7), 1), ((6, 4, 1), (12, 9, 7), 1), ((12, 9, 7), (5, 4, 1), 1), ((5, 4, 1), (12, 9, 7), 2)):
        line(a, b, radius)
    wide = np.zeros_like(mask)
    for k, j, i in zip(*np.nonzero(mask), strict=True):
        for o in itertools.product(range(-3, 4), repeat=3):
            q = (k + o[0], j + o[1], i + o[2])
            if sum(c * c for c in o) <= 9 and all(0 <= v < m for v, m in zip(q, mask.shape, strict=True)):
                wide[q] = True
    want = set()
    for k, j, i in np.ndindex(mask.shape):
        hit = total = 0.0
        for o in itertools.product((-1, 0, 1), repeat=3):
            q = (k + o[0], j + o[1], i + o[2])
            if all(0 <= v < m for v, m in zip(q, mask.shape, strict=True)):
                weight = 1 / (1 + sum(c * c for c in o))
                total += weight
                hit += weight * wide[q]
        if hit / total >= 0.4 - 1e-12:
            want.add((i, j, k))
    got = {(r["x"], r["y"], r["z"]) for r in labels.interpolate_selection(marks, size).collect()}
    assert len(got ^ want) <= 0.01 * len(want)  # lines may round a half the other way


def test_tilted_planes(spark):
    rng = np.random.default_rng(8)
    p = [(i, *(float(v) for v in rng.random(3) * 100), float(4 + i % 9), i % 4) for i in range(120)]
    pores = spark.createDataFrame(p, "id long, x double, y double, z double, radius double, connections long")
    planes = sections.candidate_planes(pores, 50.0, 40.0, 2).cache()
    assert planes.count() == 9 * 8
    section = spark.createDataFrame([(1.0, 1), (2.0, 3), (2.5, 0)], "radius double, connections long")
    got = {r["plane_id"]: (r["n"], r["score"]) for r in sections.match_scores(section, pores, planes).collect()}

    def shares(r):
        r = np.array(r)
        at = (r - r.min()) / (r.max() - r.min()) if r.max() > r.min() else np.full(len(r), 0.5)
        return np.bincount(np.minimum(4, (at * 5).astype(int)), minlength=5) / len(r)

    checked = 0
    for q in planes.collect():
        n, u, v, c = (np.array(q[k]) for k in ("n", "u", "v", "c"))
        assert abs(n @ u) < 1e-9 and (len(q["orientation"]) == 2 or abs(n @ v) < 1e-9)
        cut = [r for r in p if abs((np.array(r[1:4]) - c) @ n) <= r[4] and abs((np.array(r[1:4]) - c) @ u) <= 25 and abs((np.array(r[1:4]) - c) @ v) <= 20]
        if not cut:
            assert q["plane_id"] not in got
            continue
        c3, c2 = np.mean([r[5] for r in cut]), 4 / 3
        score = 100 * (0.2 * min(1, len(cut) / 3) + 0.4 * (1 - np.abs(shares([r[4] for r in cut]) - shares([1.0, 2.0, 2.5])).sum() / 5) + 0.4 * (1 - abs(c2 - c3) / max(c2, c3)))
        assert got[q["plane_id"]][0] == len(cut) and abs(got[q["plane_id"]][1] - score) < 1e-6
        checked += 1
    assert checked > 40
    assert sections.candidate_planes(pores, 500.0, 40.0).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("X Axis",), ("0,1,0",), ("",), (None,), ("nonsense",), ("0, 3, 4",)], "t string")
    assert [r[0] for r in df.select(fx.direction(F.col("t"))).collect()] == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 1], None, [0, 0.6, 0.8]]
    assert df.select(fx.number_in_name(F.lit("no digits"))).first()[0] == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())


def test_t2_distribution_takes_ties_low_and_ends_at_the_grid(spark):
    from tomolake.operators import relaxation

    grid = relaxation.log_grid(1, 100, 3)
    rows = [(0.1, 1.0), (500.0, 2.0), ((grid[0] + grid[1]) / 2, 4.0), (9.0, 1.0), (None, 5.0), (3.0, None)]
    df = spark.createDataFrame(rows, "t2 double, amplitude double")
    assert [round(r["share"] * 8, 9) for r in relaxation.t2_distribution(df, 1, 100, 3).orderBy("bin").collect()] == [5, 1, 2]
    assert [r["share"] for r in relaxation.t2_distribution(df.limit(0), 1, 100, 3).collect()] == [0, 0, 0]
    empty = spark.createDataFrame([], "t2 double, amplitude double, tortuosity double, porosity double")
    assert relaxation.summary(empty, empty).first().asDict() == {"total_porosity": 0, "average_tortuosity": 0, "average_t2": 0}
