"""Column expressions: identities, distances, hash numbers, guards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that count as missing values.
MISSING = ("", "nan", "<NA>")


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> None:
    """Raise before any job runs if a column is absent."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise KeyError(f"{what} lacks columns: {missing}")


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of the optional columns that the table has, in order."""
    return [c for c in columns if c in df.columns]


def is_missing(c: Column) -> Column:
    return c.isNull() | F.trim(c.cast("string")).isin(*MISSING)


def physical_cluster(patient: Column, slide: Column) -> Column:
    """``patient:`` or else ``slide:`` identity; raises where both are missing."""
    return (
        F.when(~is_missing(patient), F.concat(F.lit("patient:"), patient.cast("string")))
        .when(~is_missing(slide), F.concat(F.lit("slide:"), slide.cast("string")))
        .otherwise(F.raise_error(F.lit("a row has neither patient nor slide")))
    )


def uniform(*parts: Column | str | int) -> Column:
    """A number in (0, 1) from the md5 of the parts joined by ``|``: the same in every engine."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digits = F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def hash_order(*parts: Column | str | int) -> Column:
    """A sort key from the md5 of the parts joined by ``|``."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def euclidean(a: Sequence[Column], b: Sequence[Column], digits: int | None = 9) -> Column:
    """Distance of two vectors of scalar columns, unrolled so that it stays in generated code.
    Rounded before it is ranked: sums differ in the last bits between engines."""
    total = reduce(lambda s, x: s + x, [(x - y) * (x - y) for x, y in zip(a, b, strict=True)])
    d = F.sqrt(total)
    return d if digits is None else F.round(d, digits)


def signed_round(x: Column, digits: int = 6) -> Column:
    """``x`` rounded, where a negative number that rounds to zero stays a negative zero, as IEEE and SQL engines have it;
    Spark's own rounding goes through decimals, which have one zero. In arrays the two are told apart."""
    r = F.round(x, digits)
    return F.when(r == 0, x * 0.0).otherwise(r)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison across engines; other columns as they are."""
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
