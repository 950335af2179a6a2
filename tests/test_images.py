"""Regions, transplants, masks, kernels and scoring of images."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from swaplens.operators import arrays, imaging, sampling, scoring

SIDE, ROI = 12, 4
IMAGES = "source_id long, label int, pixels array<double>"


def images(spark, n=4, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, i % 2, rng.integers(0, 256, SIDE * SIDE).astype(float).tolist()) for i in range(n)], IMAGES)


@pytest.mark.parametrize(("buffer", "feather"), [(0, 0), (0, 4), (2, 3), (4, 2)])
def test_transplant(spark, buffer, feather):
    rows = images(spark, 2).orderBy("source_id").collect()
    s, d = (np.array(r.pixels).reshape(SIDE, SIDE) for r in rows)
    lo, hi = (SIDE - ROI) // 2 - buffer, (SIDE + ROI) // 2 + buffer
    a = np.zeros((SIDE, SIDE))
    for y in range(SIDE):
        for x in range(SIDE):
            dist = min(max(abs(y - py), abs(x - px)) for py in range(lo, hi) for px in range(lo, hi))
            a[y, x] = 1 if dist == 0 else 0.5 * (1 + math.cos(math.pi * dist / feather)) if dist < feather else 0
    df = spark.createDataFrame([(rows[0].pixels, rows[1].pixels)], "s array<double>, d array<double>")
    made = df.select(arrays.transplant(F.col("s"), F.col("d"), SIDE, ROI, buffer, feather, whole=True).alias("c"), "s").withColumn("equal", arrays.roi_equal(F.col("s"), F.col("c"), SIDE, ROI)).first()
    assert np.array_equal(np.array(made.c).reshape(SIDE, SIDE), np.rint(a * s + (1 - a) * d)) and made.equal
    with pytest.raises(Exception, match="shapes differ"):
        df.select(arrays.transplant(F.col("s"), F.slice("d", 1, 9), SIDE, ROI)).collect()


def test_regions():
    assert arrays.roi_bounds(8, 4) == (2, 6) and arrays.roi_bounds(8, 4, 9) == (0, 8)
    assert arrays.area_ratio(8, 4, 0) == 1.0 and arrays.area_ratio(8, 4, 1) == pytest.approx(28 / 48)
    for bad in ((8, 9, 0), (8, 0, 0), (8, 4, -1)):
        with pytest.raises(ValueError):
            arrays.roi_bounds(*bad)


def test_checks_notice_a_changed_region(spark):
    df = images(spark, 1).withColumn("c", F.transform("pixels", lambda v, i: F.when(i == 5 * SIDE + 5, v + 3).otherwise(v)))
    r = df.select(*[c.alias(n) for n, c in arrays.roi_metrics(F.col("pixels"), F.col("c"), SIDE, ROI).items()]).first()
    assert (r.max_roi_difference, r.mean_roi_difference, r.roi_equal, r.roi_ssim) == (3.0, 3 / 16, False, None)


def test_cue(spark):
    df = images(spark)
    got = {r.source_id: r for r in sampling.corner_cue(df, 1.0, SIDE, ROI, 2, 1).collect()}
    before = {r.source_id: r.pixels for r in df.collect()}
    for i, r in got.items():
        a, b = np.array(r.pixels).reshape(SIDE, SIDE), np.array(before[i]).reshape(SIDE, SIDE)
        assert (a[:2, :2] == (255 if i % 2 else 0)).all() and np.array_equal(a[4:8, 4:8], b[4:8, 4:8]) and r.planted
    assert not any(r.planted for r in sampling.corner_cue(df, 0.0, SIDE, ROI, 2, 1).collect())
    for bad in ((1.5, 2), (0.5, 5)):
        with pytest.raises(ValueError):
            sampling.corner_cue(df, bad[0], SIDE, ROI, bad[1], 1)


def flood(mask, diagonal):
    near = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if (y or x) and (diagonal or not (y and x))]
    out, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start]:
            continue
        n, todo = n + 1, [start]
        while todo:
            y, x = todo.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                out[y, x] = n
                todo += [(y + a, x + b) for a, b in near]
    return out


MASKS = "source_id long, mask array<boolean>"


def as_masks(spark, masks):
    return spark.createDataFrame([(i, m.ravel().tolist()) for i, m in enumerate(masks)], MASKS)


def noise(n=9, side=SIDE, seed=3):
    """Empty, full, and everything between; the last is a spiral, whose arms meet late."""
    rng = np.random.default_rng(seed)
    spiral, (y, x), (dy, dx), lines = np.zeros((side, side), bool), (0, -1), (0, 1), [side, *[k for k in range(side - 1, 0, -2) for _ in "12"]]
    for steps in lines:
        for _ in range(steps):
            y, x = y + dy, x + dx
            spiral[y, x] = True
        dy, dx = dx, -dy
    return [*[rng.random((side, side)) < k / (n - 1) for k in range(n)], spiral]


@pytest.mark.parametrize("diagonal", [True, False])
def test_components(spark, diagonal):
    masks = noise()
    for r in as_masks(spark, masks).select("source_id", imaging.components(F.col("mask"), SIDE, diagonal).alias("labels")).collect():
        pairs = set(zip(flood(masks[r.source_id], diagonal).ravel().tolist(), r.labels, strict=True))
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and all((a == 0) == (b == 0) for a, b in pairs)


def plain_perimeter(mask):
    p = np.pad(mask, 2)
    rim = {(y, x) for y, x in np.argwhere(p) if not all(p[y + a, x + b] for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))}
    total = 0.0
    for y, x in rim:
        straight = sum((y + a, x + b) in rim for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        across = sum((y + a, x + b) in rim for a in (-1, 1) for b in (-1, 1))
        # two along the axes: straight on; two across: a slope; one of each: between them
        total += {(2, 0): 1, (2, 1): 1, (2, 2): 1, (3, 0): 1, (3, 1): 1, (3, 2): 1, (0, 2): 2**0.5, (1, 3): 2**0.5, (1, 1): (1 + 2**0.5) / 2, (1, 2): (1 + 2**0.5) / 2}.get((straight, across), 0)
    return total


def plain_descriptor(mask):
    labels, n, side = flood(mask, True), mask.size, len(mask)
    parts = [np.argwhere(labels == k + 1) for k in range(labels.max())]
    sizes, area, rim = [len(q) for q in parts], int(mask.sum()), plain_perimeter(mask)
    axes = [np.linalg.eigvalsh(np.cov(q.T.astype(float), bias=True) + np.eye(2) / 12) for q in parts]
    return {
        "component_count": len(parts), "area_mean": np.mean(sizes) / n if parts else 0, "area_std": np.std(sizes) / n if parts else 0, "area_max": max(sizes, default=0) / n,
        "normalized_perimeter": rim / (4 * side), "compactness": 4 * math.pi * area / max(rim * rim, 1), "tissue_fraction": area / n,
        "eccentricity": sum(math.sqrt(max(0, 1 - lo / hi)) * k for (lo, hi), k in zip(axes, sizes, strict=True)) / area if parts else -1,
        "centroid_x": np.argwhere(mask)[:, 1].mean() / side if parts else -1, "centroid_y": np.argwhere(mask)[:, 0].mean() / side if parts else -1,
    }


def test_descriptors_of_noise(spark):
    masks = noise()
    for r in imaging.mask_descriptors(as_masks(spark, masks), SIDE).collect():
        want = plain_descriptor(masks[r.source_id])
        assert {k: r[k] for k in want} == pytest.approx(want, abs=1e-7)


def test_descriptors_of_shapes(spark):
    empty, square, two = (np.zeros((96, 96), bool) for _ in range(3))
    square[24:72, 24:72] = True
    two[:10, :20], two[50:60, 90:] = True, True
    e, s, t = sorted(imaging.mask_descriptors(as_masks(spark, [empty, square, two]), 96).collect())
    assert len(e) == 25 and e.empty_mask == 1 and e.centroid_x == e.eccentricity == -1 and all(map(math.isfinite, e))
    assert s.tissue_fraction == 0.25 and s.component_count == 1 and s.eccentricity == pytest.approx(0, abs=1e-7) and s.quadrant_0 == 0.25
    assert s.normalized_perimeter == 4 * 47 / 384 and s.grid_4 == 1.0
    assert t.component_count == 2 and t.area_max == 200 / 9216 and t.eccentricity > 0.8


def test_odd_masks(spark):
    """Missing, too short, with a missing value: nulls, nulls, and a pixel outside."""
    df = spark.createDataFrame([(1, None), (2, [True]), (3, [True, None, False, None])], MASKS)
    got = {r.source_id: (r.component_count, r.tissue_fraction) for r in imaging.mask_descriptors(df, 2).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (1.0, 0.25)}
    assert [r.peripheral_presence for r in imaging.lesion_features(df, 2, 1).orderBy("source_id").collect()] == [None, None, 0.0]
    px = spark.createDataFrame([(1, None), (2, [1.0]), (3, [0.5, None, 0.1]), (4, [0.9, 0.1, 0.2])], "source_id long, pixels array<double>")
    one = {"min_object_size": 1, "median_size": 1}
    assert [r.mask for r in imaging.tissue_masks(px, 1, one).orderBy("source_id").collect()] == [None, None, None, [True]]
    assert {(r.source_id, r.dice) for r in imaging.mask_stability(px, 1, one, [{}]).collect()} == {(1, None), (2, None), (3, None), (4, 1.0)}
    assert [r.pixels is None for r in imaging.stains_scaled(px).orderBy("source_id").collect()] == [True, True, True, False]
    assert imaging.tissue_masks(px.limit(0), 1).count() == imaging.mask_descriptors(df.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        imaging.tissue_masks(px, 1, {"median_size": 2})


def plain_tissue(image, saturation, value, least):
    side, near = len(image), ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))
    p = np.pad(np.float32(image), ((1, 1), (1, 1), (0, 0)), mode="edge") / np.float32(255 if image.max() > 1 else 1)
    mask = np.zeros((side, side), bool)
    for y in range(side):
        for x in range(side):
            c = np.sort(p[y : y + 3, x : x + 3].reshape(9, 3), axis=0)[4]
            mask[y, x] = c.max() <= np.float32(value) and (c.max() > 0 and (c.max() - c.min()) / c.max() or np.float32(0)) >= np.float32(saturation)
    grown = np.array([[any(0 <= y + a < side and 0 <= x + b < side and mask[y + a, x + b] for a, b in near) for x in range(side)] for y in range(side)])
    mask = np.array([[all(not (0 <= y + a < side and 0 <= x + b < side) or grown[y + a, x + b] for a, b in near) for x in range(side)] for y in range(side)])
    for _ in "things", "holes":
        labels = flood(mask, False)
        mask = ~(mask & (np.bincount(labels.ravel())[labels] >= least))
    return mask


@pytest.mark.parametrize("whole", [True, False])
def test_tissue_masks_of_noise(spark, whole):
    rng = np.random.default_rng(5)
    pictures = [rng.integers(0, 256, (SIDE, SIDE, 3)) if whole else np.clip(rng.random((SIDE, SIDE, 3)) * 0.3 + rng.random((SIDE, SIDE, 1)), 0, 1) for _ in range(5)]
    df = spark.createDataFrame([(i, p.astype(float).ravel().tolist()) for i, p in enumerate(pictures)], "source_id long, pixels array<double>")
    base, changes = {"min_object_size": 3}, [{"saturation_min": 0.4}, {"value_max": 0.7, "min_object_size": 5}]
    want = [[plain_tissue(p, *v) for v in ((0.05, 0.95, 3), (0.4, 0.95, 3), (0.05, 0.7, 5))] for p in pictures]
    assert all(np.array_equal(r.mask, want[r.source_id][0].ravel()) for r in imaging.tissue_masks(df, SIDE, base).collect())
    for r in imaging.mask_stability(df, SIDE, base, changes).collect():
        a, b = want[r.source_id][0], want[r.source_id][r.perturbation + 1]
        assert (r.dice, r.jaccard) == (2 * (a & b).sum() / max(a.sum() + b.sum(), 1), (a & b).sum() / max((a | b).sum(), 1))


def test_tissue_masks(spark):
    image = np.full((16, 16, 3), 255, np.uint8)
    image[4:12, 4:12] = (200, 60, 120)
    df = spark.createDataFrame([(1, image.ravel().astype(float).tolist())], "source_id long, pixels array<double>")
    mask = np.array(imaging.tissue_masks(df, 16).first().mask).reshape(16, 16)
    assert mask[5:11, 5:11].all() and not mask[:3].any()
    rows = imaging.mask_stability(df, 16, {}, [{}, {"value_max": 0.1}]).orderBy("perturbation").collect()
    assert [(r.dice, r.jaccard) for r in rows] == [(1.0, 1.0), (0.0, 0.0)]


def test_stains(spark):
    rng = np.random.default_rng(0)
    values = rng.integers(0, 256, (30, 3)).astype(float)
    df = spark.createDataFrame([(1, values.ravel().tolist())], "source_id long, pixels array<double>")
    dark, stains = np.log(1e-6), np.array(imaging.STAINS)
    hed = np.maximum(np.linalg.solve(stains.T, (np.log(np.maximum(values / 255, 1e-6)) / dark).T).T, 0) * [1.3, 0.8, 1]
    want = np.clip(np.exp(hed @ stains * dark), 0, 1)
    assert np.allclose(imaging.stains_scaled(df, 1.3, 0.8).first().pixels, want.ravel())
    assert np.abs(np.array(imaging.stains_scaled(df, 1.3, 0.8, whole=True).first().pixels) - want.ravel() * 255).max() <= 0.5 + 1e-9


def plain_seam(px, side, roi, buffer, ring):
    """By padded arrays and repeated growth."""
    image, a = np.array(px).reshape(side, side), (side - roi) // 2
    inside = np.zeros((side, side), bool)
    inside[max(0, a - buffer) : a + roi + buffer, max(0, a - buffer) : a + roi + buffer] = True

    def grown(mask):
        p = np.pad(mask, 1)
        return p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]

    wide, beyond = inside, np.pad(~inside, 1, constant_values=True)
    for _ in range(ring):
        wide, beyond = grown(wide), grown(beyond)
    outer, inner = wide & ~inside, inside & beyond[1:-1, 1:-1]
    p = np.pad(image, 1, mode="symmetric")
    g = np.zeros_like(image)
    for y in range(side):
        for x in range(side):
            n = p[y : y + 3, x : x + 3]
            g[y, x] = math.sqrt(((n[:, 2] - n[:, 0]) @ [1, 2, 1] / 8) ** 2 / 2 + ((n[2] - n[0]) @ [1, 2, 1] / 8) ** 2 / 2)
    if not outer.any():
        return 0.0, 0.0, g[inner].mean() if inner.any() else 0.0
    return g[outer].mean(), abs(image[inner].mean() - image[outer].mean()) if inner.any() else 0.0, g[inner | outer].mean()


@pytest.mark.parametrize("buffer,ring", [(0, 1), (1, 1), (1, 2), (2, 1), (9, 1), (0, 3)])
def test_seams_are_those_of_padded_arrays(spark, buffer, ring):
    """Also where the square reaches the edges or is the whole image."""
    df = images(spark, 4)
    names = ["seam_gradient", "cross_boundary_intensity_jump", "edge_magnitude"]
    got = {r.source_id: [r[n] for n in names] for r in arrays.seam_metrics(df, SIDE, ROI, buffer, ring).collect()}
    assert got == {r.source_id: pytest.approx(plain_seam(r.pixels, SIDE, ROI, buffer, ring)) for r in df.collect()}


def test_seams_of_odd_images(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0]), (3, [])], "source_id long, pixels array<double>")
    assert {tuple(r)[1:] for r in arrays.seam_metrics(df, SIDE, ROI).collect()} == {(None, None, None)}
    with pytest.raises(ValueError):
        arrays.seam_metrics(df, SIDE, ROI, ring=0)


def in_polygon(points, x, y):
    """By the winding of the angles; on the border also inside."""
    turn = 0.0
    for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1], strict=True):
        a, b = (x0 - x, y0 - y), (x1 - x, y1 - y)
        cross, dot = a[0] * b[1] - a[1] * b[0], a[0] * b[0] + a[1] * b[1]
        if abs(cross) < 1e-9 and dot <= 0:
            return True
        turn += math.atan2(cross, dot)
    return abs(turn) > 1


def test_rasters_of_polygons(spark):
    """Triangles, also beyond the edges and of no height, several on one slide, at a scale."""
    rng = np.random.default_rng(8)
    shapes = [("s", [tuple(map(float, q)) for q in rng.integers(-10, 30, (3, 2))]) for _ in range(3)] + [("t", [(2.0, 3.0), (9.0, 3.0), (4.0, 3.0)]), ("t", [(5.0, 5.0), (9.0, 5.0), (9.0, 11.0), (5.0, 11.0)])]
    polygons = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in q]) for k, q in shapes], "slide string, polygon array<struct<x:double,y:double>>")
    patches = [(1, "s", 0.0, 0.0), (2, "s", 5.0, -3.0), (3, "t", 1.0, 2.0), (4, None, 0.0, 0.0)]
    df = spark.createDataFrame(patches, "source_id long, slide string, x double, y double")
    for scale in (1.0, 2.0):
        got = {r.source_id: r.mask for r in imaging.lesion_masks(df, polygons, 8, scale).collect()}
        for i, slide, px, py in patches:
            assert got[i] == [any(k == slide and in_polygon(q, px + c * scale, py + r * scale) for k, q in shapes) for r in range(8) for c in range(8)]


def plain_lesion(mask, roi, buffer):
    side, a, b = len(mask), (len(mask) - roi) // 2 - buffer, (len(mask) + roi) // 2 + buffer
    inside = np.zeros_like(mask)
    inside[a:b, a:b] = True
    out = mask & ~inside
    sizes = np.bincount(flood(out, True).ravel())[1:]
    gaps = [min(math.hypot(y - p, x - q) for p in range(a, b) for q in range(a, b)) for y, x in np.argwhere(out)]
    return [float(out.any()), out.sum() / side**2, min(gaps, default=None), float(max(sizes, default=0)), out.sum() / (~inside).sum()]


@pytest.mark.parametrize("buffer", [0, 1])
def test_lesions_of_noise(spark, buffer):
    masks = noise()
    for r in imaging.lesion_features(as_masks(spark, masks), SIDE, 4, buffer).collect():
        assert list(r)[1:] == pytest.approx(plain_lesion(masks[r.source_id], 4, buffer))


def test_lesions(spark):
    square = [{"x": 100.0, "y": 200.0}, {"x": 110.0, "y": 200.0}, {"x": 110.0, "y": 210.0}, {"x": 100.0, "y": 210.0}]
    polygons = spark.createDataFrame([("s", square)], "slide string, polygon array<struct<x:double,y:double>>")
    patches = spark.createDataFrame([(1, "s", 100.0, 200.0), (2, "s", 900.0, 0.0), (3, "t", 100.0, 200.0)], "source_id long, slide string, x double, y double")
    for bad in ({"orientation": "x"}, {"reference": "x"}, {"scale": 0}):
        with pytest.raises(ValueError):
            imaging.lesion_masks(patches, polygons, 8, **bad)
    masks = imaging.lesion_masks(patches, polygons, 32)
    assert {r.source_id: sum(r.mask) for r in masks.collect()} == {1: 121, 2: 0, 3: 0}
    found = {r.source_id: r for r in imaging.lesion_features(masks, 32, 8).collect()}
    assert (found[1].peripheral_presence, found[1].peripheral_largest_component, found[1].peripheral_distance) == (1, 121, pytest.approx(math.hypot(2, 2)))
    assert found[2].peripheral_distance is None and found[3].peripheral_distance is None
    labelled = masks.withColumn("label", F.lit(0))
    assert arrays.alignment(labelled, 32, 8).first().status == "validated"
    assert arrays.alignment(labelled.withColumn("label", F.lit(1)), 32, 8).first().status == "failed"
    assert arrays.alignment(labelled.limit(0), 32, 8).first().status == "unavailable"


TRIPLETS = "triplet_id string, source_id long, within_donor long, cross_donor long, source_split string"


def weigh(batch):
    return batch @ np.linspace(-1, 1, batch.shape[1])


def test_inference(spark):
    df = images(spark, 5)
    t = spark.createDataFrame([("t0", 0, 1, 2, "val"), ("t1", 0, 2, 3, "val"), ("t2", 4, 1, 3, "val")], TRIPLETS)
    got = scoring.infer(t, df, weigh, SIDE, ROI, 1, 3).collect()
    px = {r.source_id: np.array(r.pixels) for r in df.collect()}
    a = np.array(arrays.alpha(SIDE, ROI, 1, 3))
    for r in got:
        mix = lambda d: a * px[r.source_id] + (1 - a) * px[d]  # noqa: B023,E731
        want = [weigh(x[None])[0] for x in (px[r.source_id], mix(r.within_donor), mix(r.cross_donor))]
        assert [r.original_logit, r.within_logit, r.cross_logit] == pytest.approx(want)
    assert len({r.original_logit for r in got if r.source_id == 0}) == 1
    control = scoring.infer(t, df, weigh, SIDE, ROI, 0, 0, roi_only=True).collect()
    assert all([r.within_logit, r.cross_logit] == pytest.approx([r.original_logit] * 2) for r in control)
    qa = scoring.construction_qa(scoring.composites(t, df, SIDE, ROI), SIDE, ROI).collect()
    assert len(qa) == 6 and all(r.roi_equal for r in qa)
    odd = t.union(spark.createDataFrame([("t3", 0, 1, 2, "test")], TRIPLETS))
    with pytest.raises(Exception, match="inconsistent"):
        scoring.infer(odd, df, weigh, SIDE, ROI).collect()


def test_rounding_keeps_the_sign_of_zero(spark):
    from swaplens.functions.columns import signed_round

    xs = [-1e-8, 1e-8, -0.0, 0.0, -0.25, 0.1234565, -5e-7, None]
    got = spark.createDataFrame([(xs,)], "x array<double>").select(F.transform("x", lambda v: signed_round(v)).alias("y")).first().y
    assert got[:7] == [0.0, 0.0, 0.0, 0.0, -0.25, 0.123457, -1e-6] and got[7] is None
    assert [math.copysign(1, v) for v in got[:4]] == [-1, 1, -1, 1]
