"""Scalar expressions for numbers and names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..config import FREQ_SUFFIX, NA_TOKENS

NUMBER = r"^\s*[+-]?(\d+[.]?\d*|[.]\d+)([eE][+-]?\d+)?\s*$"
INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def num(text: Column) -> Column:
    """Text to double, NULL where it is not a plain number.

    The guard keeps out spellings only Java accepts, such as `1d` or `0x10p3`.
    """
    sign = F.when(F.trim(text).startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return (
        F.when(text.rlike(NUMBER), text.try_cast("double"))
        .when(text.rlike(INFINITE), sign * F.lit(float("inf")))
    )


def measure(col: Column, dtype) -> Column:
    """A measure column of any type as double with NULL for missing (never NaN)."""
    if isinstance(dtype, (DoubleType, FloatType)):
        value = col.cast("double")
        return F.when(~F.isnan(value), value)
    if dtype.typeName() in ("string", "char", "varchar"):
        return num(col)
    return col.cast("double")


def missing(col: Column, dtype) -> Column:
    """Whether a cell is empty; NaN is, too."""
    return col.isNull() | F.isnan(col) if isinstance(dtype, (DoubleType, FloatType)) else col.isNull()


def na_to_null(text: Column) -> Column:
    """NULL for the texts a CSV reader takes as missing."""
    return F.when(~text.isin(*NA_TOKENS), text)


def clean_name(name: Column) -> Column:
    """Lower snake-case form of a column name."""
    joined = F.regexp_replace(F.lower(F.trim(name)), r"[\s()\-./]+", "_")
    return F.regexp_replace(joined, r"^_+|_+$", "")


def prefixed(prefix: Column, name: Column) -> Column:
    """`{prefix}_{name}`: keeps equal column names of two tables apart."""
    return F.concat(prefix, F.lit("_"), name)


def suffixed(name: Column, freq: Column) -> Column:
    """`{name}_{suffix}` for the frequencies that have a suffix, else the name."""
    out = name
    for code, suffix in FREQ_SUFFIX.items():
        out = F.when(freq == code, F.concat(name, F.lit("_" + suffix))).otherwise(out)
    return out


def mean_of(value: Column, exact_scale: int | None = None) -> Column:
    """Aggregate mean of the non-missing values.

    With `exact_scale` the sum is taken in decimals of that many digits, so the result
    does not depend on the order in which partitions are added up. A value that does not fit
    into such a decimal, or loses digits in it, is an error.
    """
    return total_of(value, exact_scale) / F.nullif(F.count(value), F.lit(0))


def total_of(value: Column, exact_scale: int | None = None) -> Column:
    """Aggregate sum, exact with `exact_scale` as in `mean_of`.

    Values below 2**53 units of the last digit are whole numbers of such units. Their high and low words are
    summed apart, so that no sum of up to 2**36 rows overflows; only larger values take the slow way by decimals.
    """
    if exact_scale is None:
        return F.sum(value)
    return exact_total(value, exact_scale).cast("double")


def exact_total(value: Column, exact_scale: int) -> Column:
    """The exact sum of `total_of` as a decimal, so that the sums of parts add up to that of the whole."""
    unit, low = 10.0 ** exact_scale, (1 << 26) - 1
    units = F.rint(value.cast("double") * unit)
    # The quotient of two whole numbers below 2**53 is the double nearest to that decimal.
    fits = (F.abs(units) < 2.0 ** 53) & (units / unit == value) if exact_scale <= 9 else value.isNull() & F.lit(False)
    whole = F.when(fits, units.cast("long"))
    exact = value.try_cast(f"decimal(38,{exact_scale})")
    lost = value.isNotNull() & ~exact.cast("double").eqNullSafe(value.cast("double"))
    message = F.concat(F.lit(f"no exact sum with {exact_scale} digits of "), value.cast("string"))
    rest = F.sum(F.when(~F.coalesce(fits, F.lit(True)), F.when(lost, F.raise_error(message)).otherwise(exact)))
    words = F.sum(F.shiftright(whole, 26)).cast("decimal(20,0)") * (low + 1) + F.sum(whole.bitwiseAND(low))
    small = words.cast("decimal(28,0)") * F.lit(f"1e-{exact_scale}").cast(f"decimal({exact_scale + 1},{exact_scale})")
    return F.coalesce(small.cast(f"decimal(38,{exact_scale})") + rest, small, rest).cast(f"decimal(38,{exact_scale})")
