"""Money: a decimal amount held at its currency's number of digits.

Amounts are ``decimal(38,4)`` columns beside a currency code column; every
operation ends with ``rescale`` so the value is always at currency scale.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions.dictionaries import NO_DIGIT_CURRENCIES, THREE_DIGIT_CURRENCIES
from rowloom.functions.scalar import half_even_quotient

AMOUNT = "decimal(38,4)"
QUOTIENT_DIGITS = 16
DIVISOR_DIGITS = 6
DIVISOR = f"decimal(19,{DIVISOR_DIGITS})"


def currency_digits(currency: Column) -> Column:
    return (
        F.when(currency.isin(NO_DIGIT_CURRENCIES), F.lit(0))
        .when(currency.isin(THREE_DIGIT_CURRENCIES), F.lit(3))
        .otherwise(F.lit(2))
    )


def _by_digits(currency: Column, none: Column, three: Column, two: Column) -> Column:
    return (
        F.when(currency.isin(NO_DIGIT_CURRENCIES), none)
        .when(currency.isin(THREE_DIGIT_CURRENCIES), three)
        .otherwise(two)
    )


def rescale(amount: Column, currency: Column) -> Column:
    """Half-even to the currency's digits; towards zero when it has none."""
    toward_zero = F.when(amount < 0, F.ceil(amount)).otherwise(F.floor(amount))
    return _by_digits(
        currency, toward_zero.cast(AMOUNT), F.bround(amount, 3).cast(AMOUNT), F.bround(amount, 2).cast(AMOUNT)
    )


def money_format(amount: Column, currency: Column) -> Column:
    text = _by_digits(
        currency,
        amount.cast("decimal(34,0)").cast("string"),
        amount.cast("decimal(37,3)").cast("string"),
        amount.cast("decimal(36,2)").cast("string"),
    )
    return F.concat_ws(" ", text, currency)


def money_parse(text: Column) -> Column:
    """``'12.34 USD'`` to struct<amount, currency>; anything but two parts raises."""
    parts = F.split(text, " ")
    checked = F.when(F.size(parts) == 2, parts).otherwise(
        F.raise_error(F.concat(F.lit("not a money text: "), text)).cast("array<string>")
    )
    code = checked.getItem(1)
    return F.struct(rescale(checked.getItem(0).cast(AMOUNT), code).alias("amount"), code.alias("currency"))


def money_zero(currency: Column) -> Column:
    return F.struct(F.lit(0).cast(AMOUNT).alias("amount"), currency.alias("currency"))


def _same_currency(left: Column, right: Column, value: Column, kind: str) -> Column:
    clash = F.raise_error(F.concat(F.lit("currency mismatch: "), left, F.lit(" / "), right)).cast(kind)
    return F.when(left == right, value).otherwise(clash)


def money_plus(amount: Column, currency: Column, *others: tuple[Column, Column]) -> Column:
    total = amount.cast(AMOUNT)
    for other, code in others:
        total = _same_currency(currency, code, (total + other.cast(AMOUNT)).cast(AMOUNT), AMOUNT)
    return total


def money_minus(amount: Column, currency: Column, *others: tuple[Column, Column]) -> Column:
    return money_plus(amount, currency, *[(-other, code) for other, code in others])


def money_multiply(amount: Column, currency: Column, factor: Column) -> Column:
    """Product rounded half-even to currency scale.

    Amounts have up to 14 and factors up to 7 digits before the point, and factors up to 12
    after it, so that the product is exact before it is rounded; more raise.
    """
    return _half_even(amount.cast("decimal(18,4)") * _exact(factor, "decimal(19,12)", "factor"), currency)


def _exact(value: Column, kind: str, name: str) -> Column:
    """``value`` as a decimal of this kind; raises where that would round it away."""
    held = value.cast(kind)
    finer = F.raise_error(F.concat(F.lit(f"{name} has too many digits: "), value.cast("string"))).cast(kind)
    return F.when(held.isNull() | (held.cast("double") == value.cast("double")), held).otherwise(finer)


def _half_even(value: Column, currency: Column) -> Column:
    return _by_digits(
        currency, F.bround(value, 0).cast(AMOUNT), F.bround(value, 3).cast(AMOUNT), F.bround(value, 2).cast(AMOUNT)
    )


def money_divide_round(amount: Column, currency: Column, divisor: Column) -> Column:
    """Division carried to 16 digits half-even, then half-even to currency scale.

    Amounts have up to 14 digits before the point, divisors up to 6 after it; more raise.
    """
    shift = F.lit(Decimal(10**QUOTIENT_DIGITS)).cast("decimal(17,0)")
    units = (amount.cast("decimal(18,4)") * shift).cast("decimal(32,0)")
    scale = F.lit(Decimal(10**DIVISOR_DIGITS)).cast(f"decimal({DIVISOR_DIGITS + 1},0)")
    whole_divisor = (_exact(divisor, DIVISOR, "divisor") * scale).cast("decimal(38,0)")
    carried = half_even_quotient((units * scale).cast("decimal(38,0)"), whole_divisor)

    def at(digits: int) -> Column:
        step = F.lit(Decimal(10 ** (QUOTIENT_DIGITS - digits)))
        whole = half_even_quotient(carried, step).cast("decimal(30,0)")
        return (whole * F.lit(Decimal(1).scaleb(-digits))).cast(AMOUNT)

    return _by_digits(currency, at(0), at(3), at(2))


def money_divide(amount: Column, currency: Column, divisor: Column) -> Column:
    """Division that must come out even at currency scale."""
    share = money_divide_round(amount, currency, divisor)
    even = share.cast("decimal(18,4)") * divisor.cast(DIVISOR) == amount.cast("decimal(18,4)")
    return F.when(even, share).otherwise(F.raise_error(F.lit("division is not exact")).cast(AMOUNT))


def money_remainder(amount: Column, divisor: Column) -> Column:
    return (amount.cast(AMOUNT) % _exact(divisor, "decimal(13,4)", "divisor")).cast(AMOUNT)


def money_compare(amount: Column, currency: Column, other: Column, other_currency: Column) -> Column:
    """-1, 0 or 1 for two amounts of one currency."""
    sign = F.when(amount < other, -1).when(amount > other, 1).otherwise(0)
    return _same_currency(currency, other_currency, sign, "int")


def money_negate(amount: Column) -> Column:
    return (-amount).cast(AMOUNT)


def is_negative(amount: Column) -> Column:
    return amount < 0


def is_positive(amount: Column) -> Column:
    """Zero counts as positive."""
    return amount >= 0


def same_currency(currency: Column, other: Column) -> Column:
    return currency == other


def money_equal(amount: Column, currency: Column, other: Column, other_currency: Column) -> Column:
    return (amount.cast(AMOUNT) == other.cast(AMOUNT)) & (currency == other_currency)


def money_sum(amount: Column) -> Column:
    """Aggregate form; group by currency first."""
    return F.sum(amount.cast(AMOUNT)).cast(AMOUNT)
