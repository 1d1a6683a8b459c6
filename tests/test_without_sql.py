"""The queries that have no SQL against brute force in plain Python, over their whole tables."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from terraloom.operators import robust
from terraloom.plans import registry
from terraloom.schema import WEIGHTS
from terraloom.sources import tables

NAMES = (
    "w14_cubic_curves", "f10_calibrated_rows", "f10_k06_calibration_report",
    "f15_point_cloud_statistics", "f10_relative_calibration", "f10_relative_calibration_rows",
)


def rows(spark, sf_dir, name):
    return registry.QUERIES[name](spark, sf_dir).collect()


def steps(x, scale):
    return math.floor(x * scale + 0.37129)


def left_by_grubbs(values, alpha=0.05, ddof=0):
    """The values that stay, one round after the other, with their mean and deviation."""
    kept, critical = sorted(values), robust.grubbs_critical(len(values), alpha)
    while kept:
        mean = sum(kept) / len(kept)
        sd = math.sqrt(sum((x - mean) ** 2 for x in kept) / (len(kept) - ddof)) if len(kept) > ddof else math.nan
        far = max(abs(x - mean) for x in kept)
        if not sd or math.isnan(sd) or far / sd <= critical:
            return kept, mean, sd
        kept = [x for x in kept if abs(x - mean) < far]
    return kept, math.nan, math.nan


def groups(df, *columns):
    out = defaultdict(list)
    for r in df.collect():
        out[r[columns[0]]].append(tuple(r[c] for c in columns[1:]))
    return out


def test_grubbs(spark, sf_dir):
    series = groups(tables.event_series(spark, sf_dir), "px", "t", "v")
    got = defaultdict(list)
    for r in rows(spark, sf_dir, "a17_o05_grubbs"):
        got[r["px"]].append((r["t"], r["v"]))
    bounds = {r["px"]: r for r in rows(spark, sf_dir, "a17b_grubbs_bounds")}
    for px, cells in series.items():
        seen = [v for _, v in cells if v is not None]
        kept = set(left_by_grubbs(seen)[0])
        assert sorted(got[px]) == sorted((t, v) for t, v in cells if v is not None and v in kept)
        kept, mean, sd = left_by_grubbs(seen, 0.003, 1)
        b = bounds[px]
        assert (b["total"], b["low"], b["high"]) == (len(cells), kept[0], kept[-1]) if len(seen) == len(cells) else b["low"] == kept[0]
        assert b["mean"] == steps(mean, 100) and (math.isnan(sd) or b["sd"] == steps(sd, 100))


def line_of(x, y):
    """Orthogonal regression."""
    x, y = np.array(x, float), np.array(y, float)
    sxx, syy, sxy = x.var(), y.var(), ((x - x.mean()) * (y - y.mean())).mean()
    b1 = (syy - sxx + math.sqrt((syy - sxx) ** 2 + 4 * sxy * sxy)) / (2 * sxy)
    return y.mean() - b1 * x.mean(), b1, sxy / math.sqrt(sxx * syy)


def in_range(v):
    return int(min(max(np.rint(v), 0), 10000))


def test_calibration_of_pairs(spark, sf_dir):
    pairs = groups(tables.scene_pairs(spark, sf_dir), "scene", "id", "x", "y")
    got = defaultdict(Counter)
    for r in rows(spark, sf_dir, "f10_calibrated_rows"):
        got[r["scene"]][r["id"], float(r["x"]), r["calibrated"]] += 1
    report = {r["scene"]: r for r in rows(spark, sf_dir, "f10_k06_calibration_report")}
    for scene, cells in pairs.items():
        cells = [(i, 9000.0 if i == 1 else float(x), y) for i, x, y in cells]
        kept = set(left_by_grubbs([x for _, x, _ in cells])[0])
        used = [(x, y) for _, x, y in cells if x in kept]
        b0, b1, r = line_of(*zip(*used, strict=True))
        assert got[scene] == Counter((i, x, in_range(b0 + b1 * x)) for i, x, _ in cells)
        residuals = [np.rint(b0 + b1 * x) - y for x, y in used]
        told = report[scene]
        assert (told["n"], told["odr_b0"], told["odr_b1"], told["r"]) == (len(used), steps(b0, 1000), steps(b1, 1000), steps(r, 1000))
        assert told["mae"] == steps(float(np.abs(residuals).mean()), 1000) and told["res_mean"] == steps(float(np.mean(residuals)), 1000)


def test_distance_statistics(spark, sf_dir):
    pairs = tables.scene_pairs(spark, sf_dir).collect()
    got = {r["axis"]: r for r in rows(spark, sf_dir, "f15_point_cloud_statistics")}
    for axis, name in enumerate("xy"):
        values = [float(r[name]) / 100 for r in pairs]
        kept, mean, sd = left_by_grubbs(values, 0.003, 1)
        r = got[axis]
        assert (r["total"], r["n"], r["low"], r["high"]) == (len(values), len(kept), kept[0], kept[-1])
        assert (r["mean"], r["sd"], r["left"], r["right"]) == tuple(steps(x, 10000) for x in (mean, sd, mean - 3 * sd, mean + 3 * sd))
        assert r["density_mean"] == steps(1 / (sd * math.sqrt(2 * math.pi)), 10000) and r["density_bound"] == steps(math.exp(-4.5) / (sd * math.sqrt(2 * math.pi)), 10000)
        bins = Counter(min(44, math.floor((x - kept[0]) / (kept[-1] - kept[0]) * 45)) for x in kept)
        assert r["bins"] == [bins[b] for b in range(45)]


def interpolated(values):
    at = [i for i, v in enumerate(values) if v is not None]
    return [values[i] if values[i] is not None else float(np.rint(np.interp(i, at, [values[k] for k in at]))) for i in range(len(values))]


@pytest.mark.parametrize("name, harmonics, weights, missing", [("w11_w12_f07_dft", 3, "dft", 0.0), ("w13_f09_fourier7", 7, "fourier7", 0.0001)])
def test_weighted_harmonics(spark, sf_dir, name, harmonics, weights, missing):
    series = groups(tables.supplier_series(spark, sf_dir), "px", "t", "value", "qual")
    got = {(r["px"], r["block"], r["k"]): r["fitted"] for r in rows(spark, sf_dir, name)}
    level, n = dict(enumerate(WEIGHTS[weights])), 0
    for px, cells in series.items():
        cells = sorted(cells)
        for block in range(len(cells) // 46):
            year = cells[46 * block : 46 * block + 46]
            values = [None if v == 32767 else float(v) for _, v, _ in year]
            if all(v is None for v in values):
                assert all(got[px, block, k] == 32767 for k in range(1, 47))
                continue
            v = np.array(interpolated(values))
            w = np.array([level.get(q, missing) if q not in (4, 255) else missing for _, _, q in year])
            a = np.array([[1.0, *(f(2 * math.pi * h * k / 46) for h in range(1, harmonics + 1) for f in (math.cos, math.sin))] for k in range(1, 47)])
            if np.linalg.cond((a.T * w) @ a) < 1e9:
                root = np.sqrt(w)[:, None]
                v = np.rint(a @ np.linalg.lstsq(a * root, v * root[:, 0], rcond=None)[0])
            elif np.linalg.cond((a.T * w) @ a) < 1e15:
                continue  # too close to singular to tell
            n += 1
            assert [got[px, block, k] for k in range(1, 47)] == [int(max(x, 0)) for x in v]
    assert n > 20


def cubic(at, values, where):
    """The spline with no knot next to its ends, by one dense system over the coefficients of all its pieces."""
    n = len(at)
    if n < 4:
        return np.polyval(np.polyfit(at, values, n - 1), where) if n > 1 else np.full(len(where), values[0])
    rows, right, pieces = [], [], n - 1
    power = lambda x, d: np.array([math.perm(p, d) * x ** (p - d) if p >= d else 0.0 for p in range(4)])

    def put(right_value, *terms):
        row = np.zeros(4 * pieces)
        for i, c in terms:
            row[4 * i : 4 * i + 4] += c
        rows.append(row)
        right.append(right_value)

    for i in range(pieces):
        h = float(at[i + 1] - at[i])
        put(values[i], (i, power(0.0, 0)))
        put(values[i + 1], (i, power(h, 0)))
        if i + 1 < pieces:
            for d in (1, 2):
                put(0.0, (i, power(h, d)), (i + 1, -power(0.0, d)))
    for i in (0, pieces - 2):
        put(0.0, (i, power(0.0, 3)), (i + 1, -power(0.0, 3)))
    c = np.linalg.solve(np.array(rows), np.array(right)).reshape(pieces, 4)
    piece = np.clip(np.searchsorted(at, where, side="right") - 1, 0, pieces - 1)
    return np.array([np.polyval(c[i][::-1], x - at[i]) for i, x in zip(piece, where, strict=True)])


def test_cubic_curves(spark, sf_dir):
    series = groups(tables.supplier_series(spark, sf_dir), "px", "t", "value")
    got = {(r["px"], r["block"], r["k"]): r["curve"] for r in rows(spark, sf_dir, "w14_cubic_curves")}
    for px, cells in series.items():
        cells = sorted(cells)
        for block in range(len(cells) // 46):
            year = [None if v == 32767 else float(v) for _, v in cells[46 * block : 46 * block + 46]]
            at = [i for i, v in enumerate(year) if v is not None]
            for k in range(46):
                if not at or not at[0] <= k <= at[-1]:
                    assert got[px, block, k + 1] is None
            if at:
                where = np.arange(at[0], at[-1] + 1)
                want = cubic(np.array(at), [year[i] for i in at], where)
                assert all(abs(got[px, block, k + 1] - (w * 100 + 0.37129)) <= 1.001 for k, w in zip(where, want, strict=True))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9])
def test_splines_of_few_values(n):
    from terraloom.operators.spectral import spline_rows

    rng, m = np.random.default_rng(n), np.full((20, 30), np.nan)
    for row in m:
        row[rng.choice(30, n, replace=False)] = rng.normal(0, 10, n)
    got = spline_rows(np.vstack([m, np.full((1, 30), np.nan)]))
    assert np.isnan(got[-1]).all()
    for row, told in zip(m, got, strict=False):
        at = np.flatnonzero(np.isfinite(row))
        where = np.arange(at[0], at[-1] + 1)
        assert np.allclose(told[where], cubic(at, row[at], where), rtol=1e-7, atol=1e-7) and np.isfinite(told).sum() == len(where)


def to_utm(lon, lat, zone):
    """Easting and northing by the series in powers of the longitude's distance from the meridian."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2, n = e2 / (1 - e2), a / math.sqrt(1 - e2 * math.sin(lat) ** 2)
    t, c = math.tan(lat) ** 2, ep2 * math.cos(lat) ** 2
    d = (lon - math.radians(zone * 6 - 183)) * math.cos(lat)
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * lat - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * lat)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * lat) - 35 * e2**3 / 3072 * math.sin(6 * lat)
    )
    east = 500000 + k0 * n * (d + (1 - t + c) * d**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * d**5 / 120)
    north = k0 * (m + n * math.tan(lat) * (d * d / 2 + (5 - t + 9 * c + 4 * c * c) * d**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * d**6 / 720))
    return east, north


def test_reprojection(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest raster does not reach the target
    scene = {(r["row"], r["col"]): r["value"] for r in tables.part_grid(spark, sf_dir).collect()}
    got = rows(spark, sf_dir, "g01_reproject_nearest")
    assert len(got) == len(scene) and any(r["value"] is not None for r in got)
    for r in got:
        lat = r["y"] / 6371007.18
        east, north = to_utm(r["x"] / (6371007.18 * math.cos(lat)), lat, 32)
        at = (5_316_700.0 - north) / 30, (east - 500_000.0) / 30
        if all(abs(x - round(x)) > 1e-3 for x in at):
            assert r["value"] == scene.get((math.floor(at[0]), math.floor(at[1])))


def test_relative_calibration(spark, sf_dir):
    from terraloom.plans.stats_queries import _scenes_and_reference

    scenes, reference = (df.collect() for df in _scenes_and_reference(spark, sf_dir))
    blocks, cover, days = defaultdict(list), defaultdict(list), {}
    for r in scenes:
        key = r["scene"], r["row"] // 3, r["col"] // 3
        days[r["scene"]] = r["acq_date"]
        cover[key].append(r["mask"])
        blocks[key].append(r["value"] if r["mask"] == 1 and r["value"] != 0 else None)
    epochs, cells = sorted({r["epoch_date"] for r in reference}), {(r["epoch_date"], r["brow"], r["bcol"]): (r["value"], r["weight"]) for r in reference}
    lines = {}
    for scene, day in days.items():
        near = min(epochs, key=lambda e: (abs((e - day).days), -e.toordinal()))
        pairs = []
        for (s, i, j), values in blocks.items():
            here = cells.get((near, i, j))
            seen = [v for v in values if v is not None]
            if s != scene or not here or here[1] is None or here[1] < 1 or not seen or any(m != 1 for m in cover[s, i, j]):
                continue
            about = [cells[near, i + a, j + b][0] for a in (-1, 0, 1) for b in (-1, 0, 1) if (near, i + a, j + b) in cells]
            pairs.append((float(np.rint(sum(seen) / len(seen))), float(np.rint(sum(about) / len(about)))))
        pairs = [p for p in pairs if p[0] > 0 and p[1] > 0]
        if pairs:
            kept = set(left_by_grubbs([x for x, _ in pairs])[0])
            lines[scene] = [p for p in pairs if p[0] in kept]
    got = {r["scene"]: r for r in rows(spark, sf_dir, "f10_relative_calibration")}
    assert got and {s: len(p) for s, p in lines.items()} == {s: r["n"] for s, r in got.items()}
    fits = {s: line_of(*zip(*p, strict=True)) for s, p in lines.items() if len(p) > 2 and got[s]["odr_b1"] is not None}
    assert fits
    for s, (b0, b1, r) in fits.items():
        assert (got[s]["odr_b0"], got[s]["odr_b1"], got[s]["r2"]) == (steps(b0, 1000), steps(b1, 1000), steps(r * r, 1000))
    made = {(r["scene"], r["row"], r["col"]): r["calibrated"] for r in rows(spark, sf_dir, "f10_relative_calibration_rows")}
    checked = 0
    for r in scenes:
        if r["scene"] in fits:
            want = in_range(fits[r["scene"]][0] + fits[r["scene"]][1] * r["value"]) if r["mask"] == 1 and r["value"] != 0 else 0
            assert abs(made[r["scene"], r["row"], r["col"]] - want) <= (1e-9 * abs(want))
            checked += 1
    assert checked
