"""Text, math, decimal and conditional helpers."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# -- text ----------------------------------------------------------------------


def lower_case(text: Column) -> Column:
    return F.lower(text)


def upper_case(text: Column) -> Column:
    return F.upper(text)


def capitalize(text: Column, lower_all: bool = False) -> Column:
    """First letter upper. ``lower_all`` keeps the older behaviour, which ends in lower case."""
    if lower_all:
        return F.lower(text)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def trim(text: Column, lower_all: bool = False) -> Column:
    """Strip every leading and trailing character up to U+0020."""
    stripped = F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return F.lower(stripped) if lower_all else stripped


def to_base64(data: Column) -> Column:
    """Standard alphabet without line breaks, also in a session that breaks lines."""
    text = F.base64(data)
    if SparkSession.active().conf.get("spark.sql.chunkBase64String.enabled", "true") == "false":
        return text
    return F.replace(text, F.lit("\r\n"), F.lit(""))


def from_base64(text: Column) -> Column:
    return F.unbase64(text)


def concat_text(left: Column, right: Column) -> Column:
    return F.concat(left, right)


# -- math and decimals -----------------------------------------------------------


def power(base: Column, exponent: Column) -> Column:
    return F.pow(base, exponent)


def root(value: Column) -> Column:
    return F.sqrt(value)


def pi() -> Column:
    return F.pi()


def euler() -> Column:
    return F.e()


def half_even_quotient(numerator: Column, denominator: Column) -> Column:
    """Whole-number quotient rounded half-even, exact up to 32 digits; both sides hold whole numbers.

    The remainder decides the rounding, so nothing is rounded twice.
    """
    whole = "decimal(38,0)"
    rest = (numerator % denominator).cast(whole)
    base = ((numerator - rest).cast(whole) / denominator).cast(whole)
    twice, size = F.abs(rest) * 2, F.abs(denominator)
    away = F.when((rest < 0) == (denominator < 0), F.lit(1)).otherwise(F.lit(-1))
    up = (twice > size) | ((twice == size) & (base % 2 != 0))
    return F.when(up, base + away).otherwise(base).cast(whole)


def divide_keep_scale(df: DataFrame, left: str, right: str) -> Column:
    """Decimal division rounded half-even to the scale of the left operand.

    Precisions of the operands may add up to 32 digits; a zero divisor raises.
    """
    kinds = [df.schema[c].dataType for c in (left, right)]
    if not all(isinstance(k, DecimalType) for k in kinds):
        raise ValueError(f"{left} and {right} must be decimal columns")
    (lp, ls), (rp, rs) = [(k.precision, k.scale) for k in kinds]
    top = F.col(left).cast(DecimalType(38, ls)) * F.lit(Decimal(10 ** (ls + rs))).cast(DecimalType(ls + rs + 1, 0))
    bottom = F.col(right) * F.lit(Decimal(10**rs)).cast(DecimalType(rs + 1, 0))
    units = half_even_quotient(top.cast("decimal(38,0)"), bottom.cast("decimal(38,0)"))
    width = min(38, lp + rs + 1)
    if ls == 0:
        return units.cast(DecimalType(width, 0))
    unit = F.lit(Decimal(1).scaleb(-ls)).cast(DecimalType(ls, ls))
    return (units.cast(DecimalType(37 - ls, 0)) * unit).cast(DecimalType(width, ls))


def integer_power(base: Column, exponent: int, kind: str) -> Column:
    """Exact decimal power by repeated multiplication; ``kind`` is the result type."""
    if exponent < 0 or exponent != int(exponent):
        raise ValueError("exponent must be a non-negative integer")
    out = F.lit(Decimal(1)).cast(kind)
    for _ in range(exponent):
        out = (out * base).cast(kind)
    return out


def remainder(left: Column, right: Column) -> Column:
    """Sign follows the dividend."""
    return left % right


def smaller(left: Column, right: Column) -> Column:
    return F.least(left, right)


def larger(left: Column, right: Column) -> Column:
    return F.greatest(left, right)


# -- conditions ---------------------------------------------------------------------


def choose(condition: Column, then: Column, otherwise: Column) -> Column:
    return F.when(condition, then).otherwise(otherwise)


def member(value: Column, options) -> Column:
    """Membership in a literal list or in an array column."""
    if isinstance(options, Column):
        return F.array_contains(options, value)
    return value.isin(list(options))


def eval_filter(df: DataFrame, predicate: str) -> DataFrame:
    return df.filter(F.expr(predicate))


# -- counts with a suffix --------------------------------------------------------------

# The suffixes of a row count.
SUFFIXES = {"k": 10**3, "m": 10**6, "g": 10**9}
COUNT_PATTERN = r"^([+-]?[0-9]+)\s*([kKmMgG]?)$"
DECIMAL_PATTERN = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))\s*([kKmMgG]?)$"


def _suffix_factor(suffix: Column) -> Column:
    out = F.lit(1)
    for letter, factor in SUFFIXES.items():
        out = F.when(F.lower(suffix) == letter, factor).otherwise(out)
    return out.cast("bigint")


def _parsed(text: Column, pattern: str, kind: str, digits: int = 0) -> Column:
    plain = F.replace(text, F.lit("_"), F.lit(""))
    number, suffix = F.regexp_extract(plain, pattern, 1), F.regexp_extract(plain, pattern, 2)
    refused = F.raise_error(F.concat(F.lit("not a count: "), text)).cast(kind)
    if kind == "bigint":
        value = (number.cast(kind) * _suffix_factor(suffix)).cast(kind)
    else:
        # the suffix moves the point of the text, so no digit is rounded away
        size = F.length(F.regexp_extract(number, r"\.([0-9]*)", 1))
        factor = _suffix_factor(suffix)
        moved = F.concat(number, F.when(F.contains(number, F.lit(".")), F.lit("0")).otherwise(F.lit("")))
        exact = F.concat(moved, F.when(factor == 10**9, F.lit("E9")).when(factor == 10**6, F.lit("E6")).when(factor == 10**3, F.lit("E3")).otherwise(F.lit("")))
        places = size - F.when(factor == 10**9, 9).when(factor == 10**6, 6).when(factor == 10**3, 3).otherwise(0)
        finer = F.raise_error(F.concat(F.lit("too many digits after the point: "), text)).cast(kind)
        value = F.when(places > digits, finer).otherwise(exact.cast(kind))
    return F.when(text.isNull(), F.lit(None).cast(kind)).when(number == "", refused).otherwise(value)


def parse_count(text: Column) -> Column:
    """``'10k'`` to 10000; underscores are ignored, anything else raises."""
    return _parsed(text, COUNT_PATTERN, "bigint")


def parse_count_decimal(text: Column, digits: int = 6) -> Column:
    """``'15.5K'`` to 15500, as a decimal with so many digits after the point; a count that has more raises."""
    return _parsed(text, DECIMAL_PATTERN, f"decimal({22 + digits},{digits})", digits)


def count_of(text: str | int) -> int:
    """The same rule for a row count given on the driver."""
    import re

    if isinstance(text, int):
        return text
    match = re.match(COUNT_PATTERN, text.replace("_", ""))
    if not match:
        raise ValueError(f"not a count: {text}")
    return int(match.group(1)) * SUFFIXES.get(match.group(2).lower(), 1)
