"""Images as row-major arrays of doubles: regions, masks, transplants, checks, descriptors.

Everything here is an expression over one row: nothing is exploded unless a statistic needs it, and
no row leaves the JVM. Images are ``side`` x ``side`` with one channel; ``imaging`` has what looks
beyond one pixel, and colours.
"""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def roi_bounds(side: int, roi: int, buffer: int = 0) -> tuple[int, int]:
    """ROI-1: first row (and column) of the centered square and the one after its last, with
    ``buffer`` around it, clipped to the image."""
    if not 0 < roi <= side:
        raise ValueError(f"invalid region of {roi} in an image of {side}")
    if buffer < 0:
        raise ValueError("buffer must not be negative")
    first = (side - roi) // 2
    return max(0, first - buffer), min(side, first + roi + buffer)


def is_protected(i: Column, side: int, roi: int, buffer: int = 0) -> Column:
    """ROI-2: whether pixel number ``i`` lies in the protected square."""
    a, b = roi_bounds(side, roi, buffer)
    row, col = F.floor(i / side), i % side
    return (row >= a) & (row < b) & (col >= a) & (col < b)


def roi_only(pixels: Column, side: int, roi: int, fill: float = 0.0) -> Column:
    """ROI-3: the region of interest, ``fill`` elsewhere."""
    return F.transform(pixels, lambda v, i: F.when(is_protected(i, side, roi), v).otherwise(F.lit(float(fill))))


def area_ratio(side: int, roi: int, buffer: int) -> float:
    """ROI-4: the share of the outside of the region that an intervention may change."""
    a, b = roi_bounds(side, roi, buffer)
    a0, b0 = roi_bounds(side, roi)
    return (side * side - (b - a) ** 2) / max(side * side - (b0 - a0) ** 2, 1)


def alpha(side: int, roi: int, buffer: int, feather: int) -> list[float]:
    """CF-1: source weight of each pixel: 1 in the protected square, and a cosine of the distance
    (largest axis gap) to it within ``feather``; 0 beyond. ``side`` squared numbers."""
    a, b = roi_bounds(side, roi, buffer)
    gap = lambda x: max(a - x, 0, x - (b - 1))
    out = []
    for row in range(side):
        for col in range(side):
            d = max(gap(row), gap(col))
            out.append(1.0 if d == 0 else 0.5 * (1 + math.cos(math.pi * d / feather)) if d < feather else 0.0)
    return out


def alpha_column(side: int, roi: int, buffer: int, feather: int) -> Column:
    return F.array(*[F.lit(x) for x in alpha(side, roi, buffer, feather)])


def transplant(source: Column, donor: Column, side: int, roi: int, buffer: int = 0, feather: int = 0, whole: bool = False) -> Column:
    """CF-2: alpha * source + (1 - alpha) * donor; ``whole`` rounds half to even and clips to bytes.
    The region itself stays the source's bit for bit. Shapes that differ raise."""
    n = side * side
    weights = alpha_column(side, roi, buffer, feather)
    mixed = F.transform(F.arrays_zip(source.alias("s"), donor.alias("d"), weights.alias("a")), lambda z: z["a"] * z["s"] + (1 - z["a"]) * z["d"])
    if whole:
        mixed = F.transform(mixed, lambda v: F.greatest(F.least(F.rint(v), F.lit(255.0)), F.lit(0.0)))
    kept = F.transform(F.arrays_zip(mixed.alias("m"), source.alias("s")), lambda z, i: F.when(is_protected(i, side, roi), z["s"]).otherwise(z["m"]))
    return F.when((F.size(source) == n) & (F.size(donor) == n), kept).otherwise(F.raise_error(F.lit("source and donor shapes differ")))


def _region(pixels: Column, side: int, roi: int) -> Column:
    return F.filter(pixels, lambda v, i: is_protected(i, side, roi))


def roi_equal(source: Column, composite: Column, side: int, roi: int) -> Column:
    """CF-3: whether the regions agree exactly."""
    return F.forall(F.arrays_zip(_region(source, side, roi).alias("s"), _region(composite, side, roi).alias("c")), lambda z: z["s"] == z["c"])


def roi_metrics(source: Column, composite: Column, side: int, roi: int) -> dict[str, Column]:
    """QA-1: largest and mean difference, equality, and similarity (1, or null if they differ)."""
    diff = F.transform(F.arrays_zip(_region(source, side, roi).alias("s"), _region(composite, side, roi).alias("c")), lambda z: F.abs(z["s"] - z["c"]))
    equal = roi_equal(source, composite, side, roi)
    return {
        "max_roi_difference": F.coalesce(F.array_max(diff), F.lit(0.0)),
        "mean_roi_difference": F.aggregate(diff, F.lit(0.0), lambda s, x: s + x) / F.lit(float(roi * roi)),
        "roi_equal": equal, "roi_ssim": F.when(equal, 1.0),
    }


def _seam(side: int, roi: int, buffer: int, ring: int) -> tuple[list[int], list[int]]:
    """Pixels up to ``ring`` steps along the axes outside the protected square, and those of the square from which as many steps lead
    out of it (or of the image)."""
    if ring < 1:
        raise ValueError("a seam is at least one pixel wide")
    a, b = roi_bounds(side, roi, buffer)
    steps = lambda x: max(a - x, x - (b - 1), 0)
    outer, inner = [], []
    for i in range(side * side):
        row, col = divmod(i, side)
        if steps(row) == steps(col) == 0:
            if min(row - a, b - 1 - row, col - a, b - 1 - col) < ring:
                inner.append(i)
        elif steps(row) + steps(col) <= ring:
            outer.append(i)
    return outer, inner


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda total, x: total + x) / F.size(xs)


def _pixels(places: Sequence[int], value) -> Column:
    """``value`` of each of the pixel numbers, which are few and known beforehand."""
    return F.transform(F.array(*[F.lit(i) for i in places]).cast("array<int>"), value)


def gradient(pixels: Column, i: Column, side: int) -> Column:
    """QA-2: the gradient's magnitude at pixel number ``i``: differences across the pixel along both axes, smoothed by 1, 2, 1
    along the other, by index arithmetic; beyond the edges the image is reflected."""
    row, col = F.floor(i / side), i % side
    within = lambda x: F.greatest(F.least(x, F.lit(side - 1)), F.lit(0))  # noqa: E731  what lies one step out is the edge itself
    at = lambda dy, dx: F.get(pixels, (within(row + dy) * side + within(col + dx)).cast("int"))
    across = (at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)) / 8
    down = (at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)) / 8
    return F.sqrt((across * across + down * down) / 2)


def boundary_jump(pixels: Column, side: int, roi: int, buffer: int = 0, ring: int = 1) -> Column:
    """QA-2: absolute difference of the means just inside and just outside the protected
    square (the outer ring has no corners: neighbours are those along the axes); 0 where there is no outside."""
    outer, inner = _seam(side, roi, buffer, ring)
    if not outer or not inner:
        return F.lit(0.0)
    value = lambda i: F.get(pixels, i)
    return F.abs(_mean(_pixels(inner, value)) - _mean(_pixels(outer, value)))


def seam_metrics(images: DataFrame, side: int, roi: int, buffer: int = 0, ring: int = 1, column: str = "pixels") -> DataFrame:
    """QA-2 of each one-channel image: source_id, seam_gradient (mean just outside the protected square), the jump across it, and
    edge_magnitude (mean gradient on both sides); 0 where there is no outside. An image of another size, or without
    pixels, has nulls."""
    outer, inner = _seam(side, roi, buffer, ring)
    px = F.when(F.size(column) == side * side, F.col(column))
    mean = lambda places: _mean(_pixels(places, lambda i: gradient(px, i, side))) if places else F.when(px.isNotNull(), 0.0)
    jump = boundary_jump(px, side, roi, buffer, ring)
    return images.select(
        "source_id", mean(outer).alias("seam_gradient"), F.when(px.isNotNull(), jump).alias("cross_boundary_intensity_jump"), mean([*inner, *outer]).alias("edge_magnitude"))


def mask_of(pixels: Column, threshold: float = 0.0) -> Column:
    return F.transform(pixels, lambda v: v > threshold)


def overlap(a: Column, b: Column) -> dict[str, Column]:
    """MSK-2: Dice and Jaccard of two masks; of two empty masks both are 0."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    count = lambda test: F.size(F.filter(both, test))
    inter, union = count(lambda z: z["a"] & z["b"]), count(lambda z: z["a"] | z["b"])
    total = F.size(F.filter(a, lambda x: x)) + F.size(F.filter(b, lambda x: x))
    return {"dice": 2 * inter / F.greatest(total, F.lit(1)), "jaccard": inter / F.greatest(union, F.lit(1))}


def _share(mask: Column, side: int, rows: tuple[int, int], cols: tuple[int, int]) -> Column:
    inside = lambda i: (F.floor(i / side) >= rows[0]) & (F.floor(i / side) < rows[1]) & ((i % side) >= cols[0]) & ((i % side) < cols[1])
    area = max((rows[1] - rows[0]) * (cols[1] - cols[0]), 1)
    return F.size(F.filter(mask, lambda v, i: v & inside(i))) / F.lit(float(area))


def mask_shares(mask: Column, side: int) -> dict[str, Column]:
    """DSC-1 without components and perimeter: fraction, centroid (-1 if empty), quadrants, a grid
    of 3 x 3, and whether the mask is empty."""
    half = side // 2
    cuts = [side * k // 3 for k in range(4)]
    area = F.size(F.filter(mask, lambda v: v))
    index = F.filter(F.transform(mask, lambda v, i: F.when(v, i)), lambda i: i.isNotNull())
    total = lambda f: F.aggregate(index, F.lit(0.0), lambda s, i: s + f(i))
    at = lambda f: F.when(area > 0, total(f) / area / side).otherwise(-1.0)
    out = {
        "tissue_fraction": area / F.lit(float(side * side)), "centroid_x": at(lambda i: (i % side).cast("double")),
        "centroid_y": at(lambda i: F.floor(i / side).cast("double")), "empty_mask": (area == 0).cast("double"),
    }
    spans = [(0, half), (half, side)]
    out |= {f"quadrant_{2 * r + c}": _share(mask, side, spans[r], spans[c]) for r in range(2) for c in range(2)}
    out |= {f"grid_{3 * r + c}": _share(mask, side, (cuts[r], cuts[r + 1]), (cuts[c], cuts[c + 1])) for r in range(3) for c in range(3)}
    return out


def alignment(records: DataFrame, side: int, roi: int, minimum: float = 0.99) -> DataFrame:
    """LES-3: share of masks (mask, label) whose region agrees with the label; no rows: unavailable."""
    hit = F.exists(_region(F.col("mask"), side, roi), lambda v: v).cast("int")
    one = records.select((hit == F.col("label")).cast("double").alias("ok")).agg(F.count("*").alias("n"), F.avg("ok").alias("agreement"))
    status = F.when(F.col("n") == 0, "unavailable").when(F.col("agreement") >= minimum, "validated").otherwise("failed")
    return one.select(status.alias("status"), "agreement", "n", F.lit(float(minimum)).alias("threshold"))
