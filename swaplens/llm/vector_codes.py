"""Product codes of vectors: codebooks learned in rounds of exact integer assignment by Exponion search.

Components become integers floor(``scale`` * x); a vector is cut into ``parts`` equal pieces, each with its own codebook of at most
``entries`` entries. A part starts at its previous entry a, at distance d. An entry as near or nearer lies within 2 d of a, as
|c - a| <= |c - x| + |x - a|, so only the beginning of a's list of neighbours, sorted by distance, is scanned: those whose squared
distance from a is 4 d^2 or less. All distances are exact integers, ties go to the smaller index.

Codebooks are ``entries`` times the vector's length in numbers, whatever the input; they go to every task. Rows never meet: a
task sends one sum and count for each entry that it used, these are added over the cluster, and only the sums reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
#: Largest component after scaling: squares of a part's differences then fit in 64 bits, with those of 4 d^2.
LARGEST = 1 << 28


def finite_vectors(vectors: DataFrame, vector_col: str, *keep) -> DataFrame:
    """The columns ``keep`` and ``x`` (array<double>) of rows whose vector is there and holds only finite numbers."""
    x = F.col(vector_col).cast("array<double>")
    ok = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(*keep, x.alias("x")).where(F.col("x").isNotNull() & F.coalesce(ok, F.lit(False)))


def scaled(values: np.ndarray, scale: float, largest: float) -> np.ndarray:
    """floor(scale * x) as integers; raises beyond ``largest``, where products no longer are exact."""
    out = np.floor(values * scale)
    if len(out) and np.abs(out).max() >= largest:
        raise ValueError("vector components are too large for exact integers")
    return out.astype(np.int64)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths -> rows x ``width``; another length raises."""
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != width).any():
        raise ValueError(f"vectors must all have {width} components")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), width)


class Neighbours:
    """A part's codebook with each entry's list of entries by (distance, index), itself first among equals of distance 0."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, 1)

    def assign(self, x: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of each row of ``x``, searched from its previous entry."""
        distance = ((x - self.entries[previous]) ** 2).sum(1)
        best, least = previous.copy(), distance.copy()
        reach = 4 * distance
        rows = np.arange(len(x))
        for place in range(len(self.entries)):
            rows = rows[self.gaps[previous[rows], place] <= reach[rows]]
            if not len(rows):
                break
            entry = self.order[previous[rows], place]
            d = ((x[rows] - self.entries[entry]) ** 2).sum(1)
            better = (d < least[rows]) | ((d == least[rows]) & (entry < best[rows]))
            best[rows[better]], least[rows[better]] = entry[better], d[better]
        return best, least


def _assigned(x: np.ndarray, code: np.ndarray, books: list[Neighbours]) -> tuple[np.ndarray, np.ndarray]:
    width = x.shape[1] // len(books)
    errors = np.zeros(len(x), np.int64)
    out = np.empty((len(x), len(books)), np.uint8)
    for p, book in enumerate(books):
        out[:, p], d = book.assign(x[:, p * width : (p + 1) * width], code[:, p].astype(np.int64))
        errors += d
    return out, errors


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of bytes as a binary value."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts)


def _sums(batches, books: list[Neighbours]):
    """Rows (x, code) -> part, entry, sums, n: what this task's rows add to each entry."""
    parts, (entries, width) = len(books), books[0].entries.shape
    sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
    for batch in batches:
        x, code = matrix(batch.column(0), parts * width), _codes(batch.column(1), parts)
        for p in range(parts):
            np.add.at(sums[p], code[:, p], x[:, p * width : (p + 1) * width])
            counts[p] += np.bincount(code[:, p], minlength=entries)
    used = np.argwhere(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array([sums[p, e].tolist() for p, e in used], pa.list_(pa.int64())), pa.array(counts[used[:, 0], used[:, 1]], pa.int64())],
        names=["part", "entry", "sums", "n"])


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE,
) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256, one row per kept row.

    Rows whose vector is null or holds null or non-finite components go. Codebooks start with the rows of the ``entries``
    smallest ids (null last, equal ids by their vectors); with fewer rows they have fewer entries. Rows that repeat an id count and are
    returned each. Vectors of unequal lengths, of a length that ``parts`` doesn't divide, or with components of 2^28 or more after
    scaling raise; an empty table gives no row. ``label_error`` is the sum over all rows of an equal label, null labels together."""
    if not 1 <= entries <= 256:
        raise ValueError("codes are one byte a part: entries must lie in 1..256")
    vec_id, label = F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label")
    kept = finite_vectors(vectors, vector_col, vec_id, label)
    first = [r["x"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()]
    width = len(first[0]) if first else 0
    if any(len(x) != width for x in first) or width % parts:
        raise ValueError(f"vectors must have one length that {parts} divides")
    start = scaled(np.array(first, float).reshape(len(first), width), scale, LARGEST)
    step = width // parts
    books = [Neighbours(start[:, p * step : (p + 1) * step]) for p in range(parts)]
    row = "vec_id long, label " + dict(kept.dtypes)["label"]

    def assign(now: list[Neighbours], schema: str, raw: bool):
        def run(batches):
            for batch in batches:
                x = matrix(batch.column("x"), width)
                x = scaled(x, scale, LARGEST) if raw else x.astype(np.int64)
                code = np.zeros((len(x), parts), np.uint8) if raw else _codes(batch.column("code"), parts)
                code, error = _assigned(x, code, now) if len(x) else (code, np.zeros(0, np.int64))
                ints = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * width, pa.array(x.astype(np.int32).ravel()))
                columns = {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "x": ints, "code": _binary(code), "error": pa.array(error)}
                names = [f.split()[0] for f in schema.split(", ") if f]
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

        return run

    current = kept
    for number in range(rounds if first else 0):
        schema = f"{row}, x array<int>, code binary"
        current = materialize(map_arrow(current, assign(books, schema, number == 0), schema), "coded")
        sums = map_arrow(current.select("x", "code"), lambda b, books=books: _sums(b, books), "part int, entry int, sums array<long>, n long")
        totals = sums.groupBy("part", "entry").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(step)], F.sum("n").alias("n")).collect()  # a row for each entry
        learned = np.stack([b.entries for b in books])
        for t in totals:
            learned[t["part"], t["entry"]] = [t[f"s{i}"] // t["n"] for i in range(step)]
        books = [Neighbours(e) for e in learned]
    told = hashlib.sha256(",".join(str(v) for b in books for v in b.entries.ravel().tolist()).encode()).hexdigest()
    schema = f"{row}, code binary, error long"
    done = materialize(map_arrow(current, assign(books, schema, rounds == 0 or not first), schema), "codes")
    by_label = done.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return done.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(told).alias("codebooks_sha256"))
