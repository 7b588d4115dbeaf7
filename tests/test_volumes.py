"""Packed chunks, the distance transform, containers and overlapping boxes against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomolake.operators import components, labels, series, stats, stencil
from tomolake.sources import containers


def rows_of(cube, volume_id=1, holes=0.0, seed=0):
    keep = np.random.default_rng(seed).random(cube.shape) >= holes
    return [(volume_id, int(x), int(y), int(z), int(cube[z, y, x])) for z, y, x in zip(*np.nonzero(keep), strict=True)], keep


@pytest.mark.parametrize("at,values", [([], []), ([7], [255]), (range(5, 900), range(895)), ([0, 3, 90], [-4, 70000, 2]), ([1, 2, 9], [0.5, 1, 2]), ([0, 10**6], [3, 4]), (range(0, 64, 2), [9] * 32)])
def test_pieces_lose_nothing(at, values):
    at, values = np.array(list(at), np.int64), np.array(list(values), float)
    back = stencil.unpacked(stencil.packed(at, values))
    assert (back[0] == at).all() and (back[1] == values).all() and len(back[0]) == len(at)


@pytest.mark.parametrize("d,radius,flat", [(4, 1, False), (3, 2, True), (2, 3, False), (64, 2, False)])
def test_halo_of_volumes_with_holes(spark, d, radius, flat):
    dims, want, data = (9, 7, 5), {}, []
    for v in (1, 2):
        cube = np.random.default_rng(v).integers(0, 300, dims[::-1])
        rows, keep = rows_of(cube, v, 0.3, v)
        data += rows
        wide = np.pad(np.where(keep, cube, 0), [(0 if flat else radius,) * 2, (radius,) * 2, (radius,) * 2], "edge")
        total = sum(x for _, x in stencil.shifts(wide, radius, flat))
        want |= {(v, x, y, z): float(total[z, y, x]) for _, x, y, z, _ in rows}
    voxels = spark.createDataFrame(data, "volume_id long, x long, y long, z long, gray long").repartition(5)
    got = stencil.halo(voxels, lambda b: sum(x for _, x in stencil.shifts(b, radius, flat)), radius, dims, d, flat=flat)
    assert {tuple(r)[:4]: r["value"] for r in got.collect()} == want


def plain_nearest(cube, keep, radius):
    """Squared distance to the nearest place of another label in the cube around each."""
    out = np.full(cube.shape, np.inf)
    for z, y, x in zip(*np.nonzero(keep), strict=True):
        for k, j, i in itertools.product(range(-radius, radius + 1), repeat=3):
            p = (z + k, y + j, x + i)
            if all(0 <= a < n for a, n in zip(p, cube.shape, strict=True)) and keep[p] and cube[p] != cube[z, y, x]:
                out[z, y, x] = min(out[z, y, x], i * i + j * j + k * k)
    return out


@pytest.mark.parametrize("seed,kinds,holes", [(1, 3, 0.0), (2, 2, 0.4), (3, 5, 0.1), (4, 1, 0.0)])
def test_distance_to_other_labels(spark, seed, kinds, holes):
    rng, radius = np.random.default_rng(seed), 5
    cube = np.kron(rng.integers(0, kinds, (3, 2, 4)), np.ones((3, 5, 3), int))  # blocks of a label, so that distances differ
    rows, keep = rows_of(cube, 1, holes, seed)
    want = plain_nearest(cube, keep, radius)
    dims = cube.shape[::-1]
    voxels = spark.createDataFrame(rows, "volume_id long, x long, y long, z long, label long")
    got = {(r["x"], r["y"], r["z"]): r["pore_size"] for r in stats.local_pore_size(voxels, radius, 2.0, dims, 4).collect()}
    size = np.where(np.isinf(want), 0, np.sqrt(want)) * 2
    assert got == {(x, y, z): size[z, y, x] for _, x, y, z, label in rows if label}
    near = {}
    for _, x, y, z, label in rows:
        own = [cube[p] == label for p in ((z + 1, y, x), (z - 1, y, x), (z, y + 1, x), (z, y - 1, x), (z, y, x + 1), (z, y, x - 1)) if all(0 <= a < n for a, n in zip(p, cube.shape, strict=True)) and keep[p]]
        near.setdefault(label, []).append((size[z, y, x], np.mean(own) if own else None))
    found = {r["label"]: r for r in stats.pore_structure(voxels, radius, 2.0, dims, 4).collect()}
    assert set(found) == set(near) - {0}
    for label, r in found.items():
        shares = [s for _, s in near[label] if s is not None]
        assert np.allclose([r["n"], r["porosity"], r["mean_pore_size"], r["mean_connectivity"]], [len(near[label]), len(near[label]) / len(rows), np.mean([s for s, _ in near[label]]), np.mean(shares)])


def test_components_cross_edges_and_corners_of_chunks(spark):
    rng = np.random.default_rng(4)
    cube = (rng.random((9, 8, 10)) < 0.35) * rng.integers(1, 3, (9, 8, 10))
    voxels = spark.createDataFrame(rows_of(cube)[0], "volume_id long, x long, y long, z long, label long")
    for offsets in (components.SIX, components.EIGHT_2D, components.TWENTY_SIX):
        label = np.where(cube > 0, np.arange(cube.size).reshape(cube.shape), cube.size)
        while True:
            before = label.copy()
            for o in offsets:
                (a, b), (u, v) = components._paired(label, o), components._paired(cube, o)
                low = np.where((u == v) & (u > 0), np.minimum(a, b), cube.size)
                np.minimum(a, low, out=a, where=low < cube.size)
                np.minimum(b, low, out=b, where=low < cube.size)
            if (label == before).all():
                break
        got = {(r["x"], r["y"], r["z"]): r["component"] for r in components.label_components(voxels, (10, 8, 9), offsets, 3).collect()}
        assert got == {(x, y, z): label[z, y, x] for z, y, x in zip(*np.nonzero(cube), strict=True)}


def chunk_rows(spark, cube, side):
    n = [-(-m // side) for m in cube.shape]
    wide = np.zeros([m * side for m in n], np.uint8)
    wide[tuple(slice(0, m) for m in cube.shape)] = cube
    part = lambda z, y, x: wide[z * side : (z + 1) * side, y * side : (y + 1) * side, x * side : (x + 1) * side]
    return spark.createDataFrame([(x, y, z, bytearray(part(z, y, x).tobytes())) for z, y, x in np.ndindex(*n) if part(z, y, x).any()], "cx int, cy int, cz int, payload binary")


def cube_of(voxels, shape):
    out = np.zeros(shape, int)
    for r in voxels.toPandas().itertuples():
        out[r.z, r.y, r.x] = r[5]
    return out


def test_containers_round_trip(spark, tmp_path):
    rng = np.random.default_rng(3)
    gray, label = rng.integers(1, 256, (7, 5, 9)), rng.integers(0, 4, (7, 5, 9))
    label[:, :, :4] = 0  # whole chunks without a row
    dims, kinds = (9, 5, 7), [(0, "Exterior", 0, 0, 0, True), (3, "Größe " * 40, -16776961, 7, 250, False)]
    both = chunk_rows(spark, gray, 4), chunk_rows(spark, label, 4)
    containers.write_file(f"{tmp_path}/c/a.bin", "combined", dims, 2e-6, 4, *both, kinds, parts=3)
    containers.write_file(f"{tmp_path}/c/b.bin", "combined", dims, 2e-6, 4, None, both[1])
    head, materials, g, la = containers.read_combined(spark, f"{tmp_path}/c", side=4)
    assert [tuple(r)[2:] for r in head.orderBy("volume_id").collect()] == [(9, 5, 7, 2e-6, True), (9, 5, 7, 2e-6, False)]
    assert sorted(tuple(r) for r in materials.collect()) == [(1, i, n, a, lo, hi, e) for i, n, a, lo, hi, e in kinds]
    assert (cube_of(g, gray.shape) == gray).all() and {r[0] for r in g.select("volume_id").distinct().collect()} == {1}
    for v in (1, 2):
        assert (cube_of(la.where(F.col("volume_id") == v), label.shape) == label).all()
    whole = (tmp_path / "c/a.bin").read_bytes()
    at = len(whole) - 3 * 2 * 2 * 64 - 16  # a file whose labels have no head of their own
    (tmp_path / "bare.bin").write_bytes(whole[:at] + whole[at + 16 :])
    assert (cube_of(containers.read_combined(spark, f"{tmp_path}/bare.bin", side=4)[3], label.shape) == label).all()
    containers.write_file(f"{tmp_path}/l.bin", "labels", dims, 2e-6, 4, labels=both[1])
    out = cube_of(containers.chunk_voxels(containers.read_chunks(spark, f"{tmp_path}/l.bin", "labels")), (8, 8, 12))
    assert (out[:7, :5, :9] == label).all() and out.sum() == label.sum()


def test_boxes_and_conditions_prune_chunks(spark, tmp_path):
    cube = np.random.default_rng(5).integers(1, 256, (12, 12, 12))
    containers.write_file(f"{tmp_path}/v.bin", "volume", (12, 12, 12), 1e-6, 4, chunk_rows(spark, cube, 4))
    got = containers.read_chunks(spark, f"{tmp_path}/v.bin", box=(3, 4, 0, 9, 8, 5), split_bytes=64)
    assert {(r["cx"], r["cy"], r["cz"]) for r in got.collect()} == {(x, 1, z) for x in (0, 1, 2) for z in (0, 1)}
    reader = containers.PrunedReader({"path": f"{tmp_path}/v.bin", "split_bytes": "128"})
    filters = [containers.GreaterThan(("cz",), 0), containers.In(("cx",), (0, 2)), containers.LessThanOrEqual(("cy",), 0), containers.EqualTo(("side",), 4)]
    assert list(reader.pushFilters(filters)) == filters
    chunks = [c for p in reader.partitions() for c in reader.read(p)]
    assert {(c["cx"][0].as_py(), c["cy"][0].as_py(), c["cz"][0].as_py()) for c in chunks} == {(x, 0, z) for x in (0, 1, 2) for z in (1, 2)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        kept = containers.read_chunks(spark, f"{tmp_path}/v.bin").where("cz = 2 AND cx > 0")
        assert {(r["cx"], r["cy"], r["cz"]) for r in kept.collect()} == {(x, y, 2) for x in (1, 2) for y in (0, 1, 2)}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_volume_over_two_gigabytes_is_planned_in_ranges(spark, tmp_path):
    n, side = 1536, 128
    counts = n // side
    with open(tmp_path / "large.bin", "wb") as f:
        f.write(containers.VOLUME_HEAD.pack(n, n, n, side, 8, 1e-6, counts, counts, counts))
        f.truncate(containers.VOLUME_HEAD.size + n**3)  # 3.6 GB of holes
        f.seek(containers.VOLUME_HEAD.size + n**3 - 1)
        f.write(b"\x07")
    assert len(containers.VolumeReader({"path": f"{tmp_path}/large.bin"}).partitions()) == counts**3 * side**3 // (64 << 20)
    last = containers.read_chunks(spark, f"{tmp_path}/large.bin", box=(n - 1, n - 1, n - 1, n, n, n))
    assert containers.chunk_voxels(last).where("gray > 0").first()[:] == (1, n - 1, n - 1, n - 1, 7)


@pytest.mark.parametrize("change", [{"bits": 16}, {"pixel": 5.0}, {"side": 0}, {"w": 20_000}, {"cut": 1}, {"nx": 9}])
def test_heads_that_fit_nothing_are_errors(spark, tmp_path, change):
    h = {"w": 4, "h": 4, "d": 4, "side": 2, "bits": 8, "pixel": 1e-6, "nx": 2} | change
    data = containers.VOLUME_HEAD.pack(h["w"], h["h"], h["d"], h["side"], h["bits"], h["pixel"], h["nx"], 2, 2) + bytes(64)
    (tmp_path / "v.bin").write_bytes(data[: len(data) - change.get("cut", 0)])
    with pytest.raises(ValueError):
        containers.heads(f"{tmp_path}/v.bin", "volume")


def test_suppression_of_many_boxes(spark):
    """Chains of overlaps, equal boxes and equal scores in one slice."""
    rng = np.random.default_rng(6)
    b = [(i, int(i % 2), int(x), int(y), int(w), int(h), float(s)) for i, (x, y, w, h, s) in enumerate(zip(rng.integers(0, 90, 900), rng.integers(0, 60, 900), rng.integers(6, 9, 900), rng.integers(6, 9, 900), rng.integers(0, 40, 900), strict=True))]
    b += [(1000 + r[0], *r[1:]) for r in b[:200]] + [(2000 + k, 0, 200 + 2 * k, 5, 8, 8, float(100 - k)) for k in range(40)]
    kept = []
    for r in sorted(b, key=lambda r: (-r[6], r[0])):
        def over(q, r=r):
            o = max(0, min(r[2] + r[4], q[2] + q[4]) - max(r[2], q[2])) * max(0, min(r[3] + r[5], q[3] + q[5]) - max(r[3], q[3]))
            return o / (r[4] * r[5] + q[4] * q[5] - o)
        if all(q[1] != r[1] or over(q) <= 0.5 for q in kept):
            kept.append(r)
    boxes = spark.createDataFrame(b, "det_id long, slice long, x long, y long, w long, h long, score double")
    assert {r["det_id"] for r in labels.suppress_boxes(boxes).collect()} == {r[0] for r in kept}
    assert labels.suppress_boxes(boxes.limit(0)).count() == 0


def plain_peaks(v, prominence, distance):
    found = []
    for i in range(1, len(v) - 1):
        if v[i] > v[i - 1] and v[i] > v[i + 1]:
            left, right = [j for j in range(i) if v[j] > v[i]], [j for j in range(i + 1, len(v)) if v[j] > v[i]]
            out = v[i] - max(min(v[(left or [0])[-1] : i + 1]), min(v[i : (right or [len(v) - 1])[0] + 1]))
            if out >= prominence or (v[i] > 0 and out >= 0.5 * v[i]):
                found.append((i, out))
    kept = []
    for i, out in sorted(found, key=lambda p: (-v[p[0]], p[0])):
        if all(abs(i - j) >= distance for j, _ in kept):
            kept.append((i, out))
    return kept


@pytest.mark.parametrize("distance", [1, 3, 40])
def test_peaks_and_filters_over_many_blocks(spark, distance):
    """One long series over several blocks beside short ones: rising, falling, toothed, level and single rows."""
    rng = np.random.default_rng(distance)
    long = np.concatenate((np.cumsum(rng.normal(0, 1, 700)), np.tile([0, 9], 60) - np.arange(120) / 9, rng.integers(0, 5, 300), np.arange(200) / 10, [50.0], np.tile([1, 2, 1], 30)))
    all_series = {0: long, 1: rng.normal(0, 1, 40), 2: np.ones(9), 3: np.array([5.0]), 4: np.array([1.0, 3, 1]), 5: -np.abs(rng.normal(3, 1, 60))}
    rows = [(k, "s", 10 * i, float(x)) for k, v in all_series.items() for i, x in enumerate(np.round(v, 3))]
    p = spark.createDataFrame(rows, "series_id long, kind string, step long, v double")
    got = series.peaks(p, ["series_id", "kind"], "step", 2.5, distance)
    want = {(k, 10 * i, round(float(np.round(v, 3)[i]), 9), round(out, 9)) for k, v in all_series.items() for i, out in plain_peaks(np.round(v, 3).tolist(), 2.5, distance)}
    assert {(r["series_id"], r["step"], round(r["v"], 9), round(r["prominence"], 9)) for r in got.collect()} == want and len(want) > 10
    filtered = {(r["series_id"], r["step"]): (r["high_pass"], r["band_pass"]) for r in series.band_pass(p, ["series_id", "kind"], "step", 0.9, 0.3).collect()}
    assert len(filtered) == len(rows)
    for k, v in all_series.items():
        x, y, z = np.round(v, 3), 0.0, 0.0
        for i in range(len(x)):
            if i:
                y = 0.9 * (y + x[i] - x[i - 1])
                z += 0.3 * (y - z)
            assert np.allclose(filtered[k, 10 * i], (y, z), atol=1e-9)
