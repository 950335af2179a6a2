"""Image operators that look beyond one pixel: tissue masks, components, descriptors, stains, lesions.

All are expressions over one row's array, so Spark spreads images over tasks without a shuffle and no image leaves the JVM.
Masks are row-major arrays of booleans, ``side`` x ``side``; colour images have three values a pixel. Components are found in one pass
over the rows: a pixel takes the least root among its labelled neighbours, and only the list of roots is rewritten where two
meet. An array of another size, or a missing one, has nulls as its result; a missing value in a mask is outside it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays

#: The settings of a tissue mask.
DEFAULTS = {"saturation_min": 0.05, "value_max": 0.95, "min_object_size": 8, "closing_radius": 1, "median_size": 3}
#: Optical densities of hematoxylin, eosin and DAB in red, green, blue.
STAINS = ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78))
#: What a border pixel adds to the perimeter, by 1 + 2 x its neighbours along the axes + 10 x those across.
WEIGHTS = {5: 1.0, 7: 1.0, 15: 1.0, 17: 1.0, 25: 1.0, 27: 1.0, 21: math.sqrt(2), 33: math.sqrt(2), 13: (1 + math.sqrt(2)) / 2, 23: (1 + math.sqrt(2)) / 2}
#: The order of a descriptor's last places.
PLACES = ("centroid_x", "centroid_y", *[f"quadrant_{k}" for k in range(4)], "empty_mask", *[f"grid_{k}" for k in range(9)])
AXES = ((0, -1), (-1, 0), (0, 1), (1, 0))
CORNERS = ((-1, -1), (-1, 1), (1, -1), (1, 1))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often, or in however many lambdas, it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def beside(a: Column, i: Column, dy: int, dx: int, side: int, outside) -> Column:
    """a at pixel number ``i`` moved by (dy, dx); ``outside`` beyond the edges."""
    col, line = i % side + dx, i + dy * side
    inside = ([(col >= 0) & (col < side)] if dx else []) + ([(line >= 0) & (line < side * side)] if dy else [])
    value = F.get(a, line + dx)
    return F.when(reduce(lambda p, q: p & q, inside), value).otherwise(F.lit(outside)) if inside else value


def _disk(radius: int) -> list[tuple[int, int]]:
    r = range(-radius, radius + 1)
    return [(y, x) for y in r for x in r if y * y + x * x <= radius * radius]


def dilated(mask: Column, side: int, offsets: Sequence[tuple[int, int]]) -> Column:
    return let(mask, lambda m: F.transform(m, lambda v, i: reduce(lambda p, q: p | q, [beside(m, i, y, x, side, False) for y, x in offsets])))


def eroded(mask: Column, side: int, offsets: Sequence[tuple[int, int]], border: bool) -> Column:
    """``border``: whether what lies beyond the edges counts as inside."""
    return let(mask, lambda m: F.transform(m, lambda v, i: reduce(lambda p, q: p & q, [beside(m, i, y, x, side, border) for y, x in offsets])))


def components(mask: Column, side: int, diagonal: bool = True) -> Column:
    """0 outside the mask, else the label of the pixel's component (an integer, not numbered without gaps)."""
    none = F.array().cast("array<int>")
    places = F.sequence(F.lit(0), F.lit(side - 1))

    def joined(s: Column, near: Column) -> Column:
        """The pixel takes the least of the roots near it; the others' pixels follow. None near: a new label."""
        new = F.size(s["root"]) + 1
        fresh = F.struct(F.concat(s["row"], F.array(new)).alias("row"), F.concat(s["root"], F.array(new)).alias("root"))
        merged = lambda least: F.when(F.size(near) > 1, F.transform(s["root"], lambda r: F.when(F.array_contains(near, r), least).otherwise(r))).otherwise(s["root"])
        known = let(F.array_min(near), lambda least: F.struct(F.concat(s["row"], F.array(least)).alias("row"), merged(least).alias("root")))
        return F.when(F.size(near) == 0, fresh).otherwise(known)

    def pixel(s: Column, x: Column, m: Column, above: Column, y: Column) -> Column:
        touched = [F.get(s["row"], x - 1), *[F.get(above, x + d) for d in ((-1, 0, 1) if diagonal else (0,))]]
        roots = F.array_distinct(F.transform(F.filter(F.array(*touched), lambda t: t > 0), lambda t: F.get(s["root"], t - 1)))
        outside = F.struct(F.concat(s["row"], F.array(F.lit(0))).alias("row"), s["root"].alias("root"))
        return F.when(F.get(m, y * side + x), let(roots, lambda near: joined(s, near))).otherwise(outside)

    def line(s: Column, y: Column, m: Column) -> Column:
        start = F.struct(none.alias("row"), s["root"].alias("root"))
        made = F.aggregate(places, start, lambda t, x: pixel(t, x, m, s["above"], y))
        return let(made, lambda t: F.struct(F.concat(s["labels"], t["row"]).alias("labels"), t["row"].alias("above"), t["root"].alias("root")))

    def of(m: Column) -> Column:
        swept = F.aggregate(places, F.struct(none.alias("labels"), none.alias("above"), none.alias("root")), lambda s, y: line(s, y, m))
        return F.when(m.isNotNull(), let(swept, lambda t: F.transform(t["labels"], lambda k: F.when(k > 0, F.get(t["root"], k - 1)).otherwise(F.lit(0)))))

    return let(mask, of)


def groups(labels: Column, side: int) -> Column:
    """The pixel numbers of each component, ascending, as an array of arrays: (label, pixel) is sorted as one number and cut where the
    label changes."""
    n = side * side
    coded = F.sort_array(F.filter(F.transform(labels, lambda k, i: F.when(k > 0, k.cast("long") * n + i)), lambda v: v.isNotNull()))
    label = lambda v: v - v % n
    first = lambda c: F.filter(F.transform(c, lambda v, j: F.when((j == 0) | (label(v) != label(F.get(c, j - 1))), j)), lambda j: j.isNotNull())
    part = lambda c, starts, p, k: F.slice(c, p + 1, F.coalesce(F.get(starts, k + 1), F.size(c)) - p)
    return let(coded, lambda c: let(first(c), lambda starts: F.transform(starts, lambda p, k: F.transform(part(c, starts, p, k), lambda v: (v % n).cast("int")))))


def without_small(mask: Column, side: int, least: int) -> Column:
    """The mask without components (along the axes) of fewer than ``least`` pixels."""
    def of(labels: Column) -> Column:
        small = F.transform(F.filter(groups(labels, side), lambda g: F.size(g) < least), lambda g: F.get(labels, F.get(g, F.lit(0))))
        return let(small, lambda few: F.transform(labels, lambda k: (k > 0) & ~F.array_contains(few, k)))

    return let(components(mask, side, False), of) if least > 1 else mask


def inverted(mask: Column) -> Column:
    return F.transform(mask, lambda v: ~v)


def _mask(mask: Column, side: int) -> Column:
    return F.when(F.size(mask) == side * side, F.transform(mask, lambda v: F.coalesce(v, F.lit(False))))


def _unit(pixels: Column, kind: str) -> Column:
    """Values of 0 to 1: those of bytes are divided by 255."""
    top = lambda p: F.when(F.array_max(p) > 1, F.lit(255.0)).otherwise(F.lit(1.0)).cast(kind)
    return let(pixels.cast(f"array<{kind}>"), lambda p: let(top(p), lambda t: F.transform(p, lambda v: (v / t).cast(kind))))


def _clipped(v: Column, kind: str) -> Column:
    return F.least(F.greatest(v, F.lit(0.0).cast(kind)), F.lit(1.0).cast(kind))


def _smoothed(pixels: Column, side: int, size: int) -> Column:
    """The median over ``size`` x ``size`` pixels of each of three channels, edges repeated: the image is widened first, so that a
    window's pixels lie at fixed steps from its first."""
    if size % 2 == 0:
        raise ValueError("a median needs an odd size")
    r, wide = size // 2, side + size - 1
    within = lambda x: F.least(F.greatest(x - r, F.lit(0)), F.lit(side - 1))
    row = lambda j, w: F.floor(j / (3 * w)).cast("int")
    source = lambda j: (within(row(j, wide)) * side + within(F.floor(j / 3).cast("int") % wide)) * 3 + j % 3
    widened = lambda p: F.transform(F.sequence(F.lit(0), F.lit(3 * wide * wide - 1)), lambda j: F.get(p, source(j)))
    window = lambda q, first: F.array(*[F.get(q, first + 3 * (y * wide + x)) for y in range(size) for x in range(size)])
    middle = lambda q, first: F.get(F.sort_array(window(q, first)), F.lit(size * size // 2))
    of = lambda p, q: F.transform(p, lambda v, j: let(j + row(j, side) * (6 * r), lambda first: middle(q, first)))
    return let(pixels, lambda p: F.when(p.isNotNull(), let(widened(p), lambda q: of(p, q))))


def _steps(side: int, settings: Mapping | None) -> list[Callable[[Column], Column]]:
    """MSK-1 as steps from a colour image to its mask, in single precision."""
    s = DEFAULTS | dict(settings or {})
    size, least, same = int(s["median_size"]), int(s["min_object_size"]), lambda c: c
    low, high = F.lit(float(s["saturation_min"])).cast("float"), F.lit(float(s["value_max"])).cast("float")
    offsets = _disk(int(s["closing_radius"]))

    def whole(c: Column) -> Column:
        return _unit(F.when((F.size(c) == 3 * side * side) & ~F.exists(c, lambda v: v.isNull()), c), "float")

    def tissue(c: Column) -> Column:
        value, lowest = F.array_max(c), F.array_min(c)
        return (F.when(value > 0, ((value - lowest) / value).cast("float")).otherwise(F.lit(0.0).cast("float")) >= low) & (value <= high)

    def thresholds(c: Column) -> Column:
        channels = lambda p, i: F.array(*[_clipped(F.get(p, i * 3 + k), "float") for k in range(3)])
        return let(c, lambda p: F.when(p.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: let(channels(p, i), tissue))))

    return [
        whole, (lambda c: _smoothed(c, side, size)) if size > 1 else same, thresholds,
        lambda c: dilated(c, side, offsets), lambda c: eroded(c, side, offsets, True),
        lambda c: without_small(c, side, least), lambda c: without_small(inverted(c), side, least), inverted,
    ]


def with_tissue(images: DataFrame, side: int, settings: Sequence[Mapping | None], column: str = "pixels") -> DataFrame:
    """MSK-1: source_id and a mask for each of the settings, m0, m1, ... A step is one projection for all of them, since the analyzer
    resolves a nest of lambdas one level at a time and up to a bound. An image with a missing value, or without three values a
    pixel, has no mask."""
    names = [f"m{k}" for k in range(len(settings))]
    df = images.select(F.col("source_id").cast("long").alias("source_id"), *[F.col(column).alias(n) for n in names])
    for step in zip(*[_steps(side, s) for s in settings], strict=True):
        df = df.select("source_id", *[f(F.col(n)).alias(n) for n, f in zip(names, step, strict=True)])
    return df


def stain_scaled(pixels: Column, h_scale: float = 1.0, e_scale: float = 1.0, whole: bool = False) -> Column:
    """MSK-4: separate the stains of a colour image by optical density, scale hematoxylin and eosin, and put them back; ``whole``
    images hold bytes, others values of 0 to 1 (or bytes, which come out as such values)."""
    apart, dark = np.linalg.inv(np.array(STAINS)).tolist(), math.log(1e-6)
    product = lambda v, m, k: sum((F.get(v, F.lit(j)) * m[j][k] for j in range(3)), F.lit(0.0))

    def pixel(p: Column, i: Column) -> Column:
        density = F.array(*[F.log(F.greatest(_clipped(F.get(p, i * 3 + k), "double"), F.lit(1e-6))) / dark for k in range(3)])
        stains = lambda d: F.array(*[F.greatest(product(d, apart, k), F.lit(0.0)) * scale for k, scale in enumerate((h_scale, e_scale, 1.0))])
        back = lambda h: F.array(*[_clipped(F.exp(product(h, STAINS, k) * dark), "double") for k in range(3)])
        return let(density, lambda d: let(stains(d), back))

    px = F.when((F.size(pixels) % 3 == 0) & (F.size(pixels) > 0) & ~F.exists(pixels, lambda v: v.isNull()), pixels)
    made = let(_unit(px, "double"), lambda p: F.when(p.isNotNull(), F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / 3).cast("int") - 1), lambda i: pixel(p, i)))))
    return F.transform(made, lambda v: F.rint(v * 255)) if whole else made


def perimeter(mask: Column, side: int) -> Column:
    """Border pixels (those that an erosion along the axes takes) weighted by how their border neighbours lie."""
    rim = let(mask, lambda m: F.transform(m, lambda v, i: (v & ~reduce(lambda p, q: p & q, [beside(m, i, y, x, side, False) for y, x in AXES])).cast("int")))
    weights = F.array(*[F.lit(WEIGHTS.get(k, 0.0)) for k in range(50)])
    code = lambda b, i: 1 + 2 * sum((beside(b, i, y, x, side, 0) for y, x in AXES), F.lit(0)) + 10 * sum((beside(b, i, y, x, side, 0) for y, x in CORNERS), F.lit(0))
    return let(rim, lambda b: F.aggregate(F.transform(b, lambda v, i: F.when(v == 1, F.get(weights, F.least(code(b, i), F.lit(49)))).otherwise(0.0)), F.lit(0.0), lambda s, w: s + w))


def _total(xs: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + of(x))


def eccentricity(group: Column, side: int) -> Column:
    """Of the ellipse with the second moments of the pixels, each a square of size 1."""
    row, col, n = lambda i: F.floor(i / side).cast("double"), lambda i: (i % side).cast("double"), F.size(group)
    means = F.struct((_total(group, row) / n).alias("y"), (_total(group, col) / n).alias("x"))

    def moments(m: Column) -> Column:
        dy, dx = lambda i: row(i) - m["y"], lambda i: col(i) - m["x"]
        return F.struct((_total(group, lambda i: dy(i) * dy(i)) / n + 1 / 12).alias("yy"), (_total(group, lambda i: dx(i) * dx(i)) / n + 1 / 12).alias("xx"), (_total(group, lambda i: dy(i) * dx(i)) / n).alias("xy"))

    def ratio(c: Column) -> Column:
        mean, half = (c["yy"] + c["xx"]) / 2, F.sqrt((c["yy"] - c["xx"]) * (c["yy"] - c["xx"]) + 4 * c["xy"] * c["xy"]) / 2
        return F.sqrt(F.greatest(F.lit(0.0), 1 - (mean - half) / (mean + half)))

    return let(means, lambda m: let(moments(m), ratio))


def descriptor(mask: Column, side: int) -> Column:
    """DSC-1: a struct of the 24 descriptors, finite for an empty mask (-1 where there is no place)."""
    n = float(side * side)

    def of(m: Column, parts: Column, rim: Column) -> Column:
        sizes, count, area = F.transform(parts, F.size), F.size(parts), F.size(F.filter(m, lambda v: v)).cast("double")
        some = lambda v: F.when(count > 0, v / n).otherwise(0.0)
        mean = area / count
        shares = arrays.mask_shares(m, side)
        out = {
            "tissue_fraction": shares["tissue_fraction"], "component_count": count.cast("double"), "area_mean": some(mean),
            "area_std": some(F.sqrt(let(mean, lambda a: _total(sizes, lambda x: (x - a) * (x - a))) / count)), "area_max": some(F.array_max(sizes)),
            "normalized_perimeter": rim / float(4 * side), "compactness": 4 * math.pi * area / F.greatest(rim * rim, F.lit(1.0)),
            "eccentricity": F.when(count > 0, _total(parts, lambda g: eccentricity(g, side) * F.size(g)) / area).otherwise(-1.0),
            **{k: shares[k] for k in PLACES},
        }
        return F.struct(*[v.alias(k) for k, v in out.items()])

    whole = lambda m: let(groups(components(m, side), side), lambda parts: let(perimeter(m, side), lambda rim: of(m, parts, rim)))
    return let(_mask(mask, side), lambda m: F.when(m.isNotNull(), whole(m)))


def edges(polygon: Column, x: Column, y: Column, size: int, scale: float) -> Column:
    """The sides of a polygon in pixels from (x, y), but for those that no pixel's test meets: above, below or left of the patch."""
    px = lambda p: (p["x"] - x) / scale
    py = lambda p: (p["y"] - y) / scale
    pair = lambda p, q: F.struct(px(p).alias("x0"), py(p).alias("y0"), px(q).alias("x1"), py(q).alias("y1"))
    all_ = F.transform(polygon, lambda p, i: pair(p, F.get(polygon, (i + 1) % F.size(polygon))))
    return F.filter(all_, lambda e: (F.greatest(e["y0"], e["y1"]) >= 0) & (F.least(e["y0"], e["y1"]) <= size - 1) & (F.greatest(e["x0"], e["x1"]) >= 0))


def rasterized(polygons: Column, x: Column, y: Column, size: int, scale: float = 1.0) -> Column:
    """LES-1: the pixels whose place lies in a polygon by the even-odd rule, or on its border. Without polygons the mask is empty."""
    def crosses(e: Column, r: Column, c: Column) -> Column:
        return ((e["y0"] > r) != (e["y1"] > r)) & (c < e["x0"] + (r - e["y0"]) * (e["x1"] - e["x0"]) / F.nullif(e["y1"] - e["y0"], F.lit(0.0)))

    def touches(e: Column, r: Column, c: Column) -> Column:
        off = (e["x1"] - e["x0"]) * (r - e["y0"]) - (e["y1"] - e["y0"]) * (c - e["x0"])
        return (F.abs(off) < 1e-9) & r.between(F.least(e["y0"], e["y1"]), F.greatest(e["y0"], e["y1"])) & c.between(F.least(e["x0"], e["x1"]), F.greatest(e["x0"], e["x1"]))

    def inside(es: Column, i: Column) -> Column:
        r, c = F.floor(i / size), i % size
        return F.exists(es, lambda e: touches(e, r, c)) | (F.size(F.filter(es, lambda e: crosses(e, r, c))) % 2 == 1)

    sides = F.transform(polygons, lambda p: edges(p, x, y, size, scale))
    return let(sides, lambda all_: F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.exists(all_, lambda es: inside(es, i))))


def lesion(mask: Column, side: int, roi: int, buffer: int = 0) -> Column:
    """LES-2: a struct of what lies outside the protected square; without a lesion the distance is null."""
    a, b = arrays.roi_bounds(side, roi, buffer)
    n, free = float(side * side), float(max(side * side - (b - a) ** 2, 1))
    gap = lambda x: F.greatest(a - x, x - (b - 1), F.lit(0))
    far = lambda i: F.sqrt(gap(F.floor(i / side)) * gap(F.floor(i / side)) + gap(i % side) * gap(i % side))

    def of(out: Column) -> Column:
        points = F.filter(F.transform(out, lambda v, i: F.when(v, i)), lambda i: i.isNotNull())
        largest = F.array_max(F.transform(groups(components(out, side), side), F.size))
        return let(points, lambda p: F.struct(
            (F.size(p) > 0).cast("double").alias("peripheral_presence"), (F.size(p) / n).alias("peripheral_fraction"), F.array_min(F.transform(p, far)).alias("peripheral_distance"),
            F.coalesce(largest, F.lit(0)).cast("double").alias("peripheral_largest_component"), (F.size(p) / free).alias("transplanted_area_fraction")))

    outside = lambda m: F.transform(m, lambda v, i: v & ~arrays.is_protected(i, side, roi, buffer))
    return let(_mask(mask, side), lambda m: F.when(m.isNotNull(), let(outside(m), of)))


def _spread(images: DataFrame, value: Column) -> DataFrame:
    """source_id and the fields of the struct."""
    return images.select(F.col("source_id").cast("long").alias("source_id"), value.alias("found")).select("source_id", "found.*")


def mask_descriptors(masks: DataFrame, side: int, column: str = "mask") -> DataFrame:
    """DSC-1: source_id and the 24 descriptors of each mask (array of booleans, row-major)."""
    return _spread(masks, descriptor(F.col(column), side))


def tissue_masks(images: DataFrame, side: int, settings: Mapping | None = None, column: str = "pixels") -> DataFrame:
    """MSK-1: source_id, mask; pixels are side x side x 3 values."""
    return with_tissue(images, side, [settings], column).withColumnRenamed("m0", "mask")


def stains_scaled(images: DataFrame, h_scale: float = 1.0, e_scale: float = 1.0, whole: bool = False, column: str = "pixels") -> DataFrame:
    """MSK-4: source_id, pixels."""
    return images.select(F.col("source_id").cast("long").alias("source_id"), stain_scaled(F.col(column), h_scale, e_scale, whole).alias("pixels"))


def mask_stability(images: DataFrame, side: int, base: Mapping, perturbations: Sequence[Mapping], column: str = "pixels") -> DataFrame:
    """MSK-3: Dice and Jaccard of each perturbed mask with the base mask, one row a perturbation; null where an image has no mask."""
    masks = with_tissue(images, side, [base, *[dict(base) | dict(c) for c in perturbations]], column)

    def against(k: int) -> Column:
        both = F.struct(F.col("m0").alias("a"), F.col(f"m{k + 1}").alias("b"))
        fields = lambda p: [F.when(p["a"].isNotNull(), v).alias(n) for n, v in arrays.overlap(p["a"], p["b"]).items()]
        return let(both, lambda p: F.struct(F.lit(k).alias("perturbation"), *fields(p)))

    return masks.select("source_id", F.inline(F.array(*[against(k) for k in range(len(perturbations))])))


def lesion_masks(patches: DataFrame, polygons: DataFrame, size: int, scale: float = 1.0, orientation: str = "identity", reference: str = "top_left") -> DataFrame:
    """LES-1: (source_id, slide, x, y) and (slide, polygon) -> source_id, mask. Only polygons whose
    box meets the patch are joined, so a slide's polygons aren't all sent to each of its patches."""
    if orientation != "identity" or reference != "top_left" or scale <= 0:
        raise ValueError("only an identity orientation, top-left origins and a positive scale are validated")
    # the field of an array of structs is the array of that field
    box = polygons.select("slide", "polygon", *[f(F.col(f"polygon.{c}")).alias(f"{c}_{n}") for c in "xy" for n, f in (("lo", F.array_min), ("hi", F.array_max))])
    reach = float(size * scale)
    p = patches.select("source_id", F.col("slide").alias("of"), F.col("x").alias("px"), F.col("y").alias("py"))
    meets = (F.col("of") == F.col("slide")) & (F.col("x_lo") <= F.col("px") + reach) & (F.col("x_hi") >= F.col("px")) & (F.col("y_lo") <= F.col("py") + reach) & (F.col("y_hi") >= F.col("py"))
    # a row is short, but its mask is dear: the tasks of a stated number aren't merged by their bytes
    tasks = int(patches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = p.join(box, meets, "left").repartition(tasks, "source_id", "px", "py")
    grouped = met.groupBy("source_id", "px", "py").agg(F.collect_list("polygon").alias("polygons"))
    return grouped.select(F.col("source_id").cast("long").alias("source_id"), rasterized(F.col("polygons"), F.col("px"), F.col("py"), size, scale).alias("mask"))


def lesion_features(masks: DataFrame, side: int, roi: int, buffer: int = 0) -> DataFrame:
    """LES-2: source_id and the features of each mask; without a lesion the distance is null."""
    return _spread(masks, lesion(F.col("mask"), side, roi, buffer))
