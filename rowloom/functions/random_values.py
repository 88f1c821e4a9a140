"""Random value functions: every one maps a cell draw to a value.

All functions take the draw first (see ``rowloom.draws``) and return a Column
built from JVM-side expressions only. Bounds follow the half-open convention
[lo, hi); literal bounds are checked when the plan is built and column bounds
raise at run time.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_CEILING, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.draws import below, bits, digits, element, int_div, slot, unit
from rowloom.functions import dictionaries as words
from rowloom.functions.scalar import to_base64

INT_BOUND = 2**31 - 1
LONG_BOUND = 2**63 - 1
DECIMAL_DEFAULT = (0, 18, 2)
ALPHANUMERIC = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
VOWELS = "aeiou"
CONSONANTS = "bcdfghjklmnpqrstvwxyz"
STRING_BLOCK = 8  # letters taken from one draw
WORD_BLOCK = 12
SHORT_TEXT = 64  # up to here strings are put together letter by letter
DIGEST_LETTERS = 108
UNROLLED_DIGEST_LETTERS = 1024
DECIMAL_CHUNK = 10**15
CHOICE_TREE_LIMIT = 128


def _span(lo, hi) -> Column:
    """hi - lo as bigint, refusing empty ranges."""
    if not isinstance(lo, Column) and not isinstance(hi, Column):
        if lo >= hi:
            raise ValueError(f"empty range [{lo}, {hi})")
        return F.lit(hi - lo).cast("bigint")
    width = _col(hi) - _col(lo)
    return F.when(width > 0, width).otherwise(F.raise_error(F.lit("empty range")).cast("bigint"))


def _col(value, kind: str = "bigint") -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast(kind)


# -- picks -----------------------------------------------------------------


def pick(draw: Column, values: Sequence) -> Column:
    """Uniform choice of one literal."""
    if not values:
        raise ValueError("empty value set")
    return F.element_at(F.array(*[F.lit(v) for v in values]), (below(draw, len(values)) + 1).cast("int"))


def select_random(draw: Column, *options: Column) -> Column:
    """Uniform choice among column arguments."""
    if not options:
        raise ValueError("empty argument list")
    return F.element_at(F.array(*options), (below(draw, len(options)) + 1).cast("int"))


def weighted_pick(draw: Column, values: Sequence, weights: Sequence[float]) -> Column:
    """First value whose cumulative weight reaches ``unit * total``."""
    if not values:
        raise ValueError("empty value set")
    if len(values) != len(weights):
        raise ValueError("values and weights differ in length")
    if any(w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("weights must be non-negative with a positive sum")
    cumulative, total = [], 0.0
    for weight in weights:
        total += float(weight)
        cumulative.append(total)
    target = unit(draw) * F.lit(total)
    if len(values) <= CHOICE_TREE_LIMIT:
        return _choice_tree(target, list(values), cumulative)
    # Long literal lists: find the block first, then the item inside the block.
    block = int(len(values) ** 0.5) + 1
    starts = range(0, len(values), block)
    ends = F.array(*[F.lit(cumulative[min(s + block, len(values)) - 1]) for s in starts])
    first = F.size(F.filter(ends, lambda c: c < target)) * block
    inside = F.slice(F.array(*[F.lit(c) for c in cumulative]), first + 1, F.lit(block))
    at = first + F.size(F.filter(inside, lambda c: c < target))
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def _choice_tree(target: Column, values: list, cumulative: list[float]) -> Column:
    if len(values) == 1:
        return F.lit(values[0])
    mid = len(values) // 2
    return F.when(target <= F.lit(cumulative[mid - 1]), _choice_tree(target, values[:mid], cumulative[:mid])).otherwise(
        _choice_tree(target, values[mid:], cumulative[mid:])
    )


# -- names and places --------------------------------------------------------


def first_name(draw: Column) -> Column:
    return pick(draw, words.FIRST_NAMES)


def last_name(draw: Column) -> Column:
    return pick(draw, words.LAST_NAMES)


def full_name(draw: Column) -> Column:
    return F.concat_ws(" ", first_name(slot(draw, 1)), last_name(slot(draw, 2)))


def city(draw: Column) -> Column:
    name = pick(draw, words.CITIES)
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1000))


def country(draw: Column) -> Column:
    return pick(draw, words.COUNTRIES)


def state(draw: Column) -> Column:
    return pick(draw, words.STATES)


def state_code(draw: Column) -> Column:
    return pick(draw, words.STATE_CODES)


def currency(draw: Column) -> Column:
    return pick(draw, words.CURRENCIES)


def fact(draw: Column) -> Column:
    return pick(draw, words.FACTS)


def email(draw: Column) -> Column:
    local = F.concat(F.lower(first_name(slot(draw, 1))), F.lit("."), F.lower(last_name(slot(draw, 2))))
    return F.replace(F.concat(local, F.lit("@example.com")), F.lit(" "), F.lit("."))


def phone_number(draw: Column) -> Column:
    area, exchange, line = digits(draw, [900, 900, 10000])
    return F.concat(
        F.lit("("), (area + 100).cast("string"), F.lit(") "), (exchange + 100).cast("string"), F.lit("-"),
        F.lpad(line.cast("string"), 4, "0"),
    )


def zip_code(draw: Column) -> Column:
    return F.lpad(below(draw, 100_000).cast("string"), 5, "0")


# -- numbers -----------------------------------------------------------------


def boolean(draw: Column) -> Column:
    return below(draw, 2) == 0


def integer(draw: Column, lo=0, hi=INT_BOUND) -> Column:
    return (_col(lo) + bits(draw) % _span(lo, hi)).cast("int")


def long(draw: Column, lo=0, hi=LONG_BOUND) -> Column:
    return _col(lo) + F.shiftrightunsigned(draw, 1) % _span(lo, hi)


def double(draw: Column, lo: float = 0.0, hi: float = 1.7976931348623157e308) -> Column:
    if not isinstance(lo, Column) and not isinstance(hi, Column) and lo >= hi:
        raise ValueError(f"empty range [{lo}, {hi})")
    return _col(lo, "double") + unit(draw) * (_col(hi, "double") - _col(lo, "double"))


def decimal(draw: Column, lo=DECIMAL_DEFAULT[0], hi=DECIMAL_DEFAULT[1], scale: int = DECIMAL_DEFAULT[2]) -> Column:
    """Uniform decimal at the given scale, drawn as an integer count of units.

    Spans over 10^15 units are put together from up to three draws, so any
    precision Spark can hold (38 digits) works.
    """
    lo, hi = Decimal(str(lo)), Decimal(str(hi))
    if lo >= hi:
        raise ValueError(f"empty range [{lo}, {hi})")
    # the first and the one past the last multiple of the scale's unit that lie in [lo, hi)
    first, past = (int(x.scaleb(scale).to_integral_value(ROUND_CEILING)) for x in (lo, hi))
    span = past - first
    if span <= 0:
        raise ValueError(f"no value with {scale} digits in [{lo}, {hi})")
    width = max(len(str(abs(first + span - 1))), len(str(abs(first))), scale + 1)
    if width > 38:
        raise ValueError("decimal bounds need more than 38 digits")
    whole = "decimal(38,0)"
    if span <= DECIMAL_CHUNK:
        units = (F.lit(first).cast("bigint") + below(draw, span)).cast("decimal(19,0)")
    else:
        units = below(slot(draw, 1), DECIMAL_CHUNK).cast("decimal(15,0)")
        weight, n = DECIMAL_CHUNK, 2
        while weight < span:
            radix = DECIMAL_CHUNK if n == 2 else 10**8
            part = below(slot(draw, n), radix).cast("decimal(15,0)") * F.lit(Decimal(weight))
            units = units.cast(whole) + part.cast(whole)
            weight, n = weight * radix, n + 1
        if span < weight:
            units = (units % F.lit(Decimal(span))).cast(whole)
        units = units + F.lit(Decimal(first)) if first else units
    if scale == 0:
        return units.cast(f"decimal({width},0)")
    if width + scale >= 38:  # the product type would not fit, so shift the point as text
        return F.concat(units.cast("string"), F.lit(f"e-{scale}")).cast(f"decimal({width},{scale})")
    unit_value = F.lit(Decimal(1).scaleb(-scale)).cast(f"decimal({scale},{scale})")
    return (units.cast(f"decimal({width},0)") * unit_value).cast(f"decimal({width},{scale})")


def money_text(draw: Column, currency_code: Column | str | None = None) -> Column:
    """A small amount at the currency's own scale, then the currency code."""
    from rowloom.functions.money import money_format, rescale

    code = currency(slot(draw, 2)) if currency_code is None else currency_code
    code = code if isinstance(code, Column) else F.lit(code)
    return money_format(rescale(decimal(slot(draw, 1)), code), code)


# -- text ----------------------------------------------------------------------


def _letters(draw: Column, alphabets: Sequence[str]) -> list[Column]:
    """One byte per alphabet, all from one draw; bytes are found without scanning the alphabet."""
    places = digits(draw, [len(a) for a in alphabets])
    return [F.substr(F.lit(a.encode()), (p + 1).cast("int"), F.lit(1)) for a, p in zip(alphabets, places)]


def _spelled(draw: Column, alphabets: Sequence[str], block: int) -> Column:
    """Text with one letter per alphabet, ``block`` letters per draw, all in generated code."""
    if not alphabets:
        return F.lit("")
    letters = []
    for i, start in enumerate(range(0, len(alphabets), block), 1):
        letters += _letters(element(draw, 0, F.lit(i)), alphabets[start : start + block])
    return F.concat(*letters).cast("string")


def _digest_text(draw: Column, bound: int | Column, size: Column) -> Column:
    """Longer letters-and-digits text from few expressions.

    SHA-256 digests of the draw are spelled in base 64 and the two symbols are
    dropped, which keeps the letters uniform. Three digests give 128 symbols
    and are counted on for 108 letters, so running short is rare; a short text
    is then filled from another draw.
    """
    stem = F.concat(bits(draw).cast("string"), F.lit("|"))
    if isinstance(bound, int) and bound <= UNROLLED_DIGEST_LETTERS:
        count = 3 * (bound // DIGEST_LETTERS + 1)
        spelled = F.concat(*[F.sha2(F.concat(stem, F.lit(str(i))), 256) for i in range(1, count + 1)])
    else:
        groups = F.lit(bound // DIGEST_LETTERS + 1) if isinstance(bound, int) else int_div(bound, DIGEST_LETTERS) + 1
        indexes = F.sequence(F.lit(1), (groups * 3).cast("int"))
        spelled = F.array_join(F.transform(indexes, lambda i: F.sha2(F.concat(stem, i.cast("string")), 256)), "")
    text = to_base64(F.unhex(spelled))
    for symbol in ("+", "/"):
        text = F.replace(text, F.lit(symbol), F.lit(""))
    return F.rpad(text, size, F.hex(slot(draw, 9)))


def string(draw: Column, length: int | Column, max_length: int | None = None) -> Column:
    """Letters and digits: exact length, or length uniform in [length, max_length)."""
    bound, source, size = length, draw, None
    if max_length is not None:
        bound, source, size = max_length - 1, slot(draw, 1), integer(slot(draw, 2), length, max_length)
    if isinstance(bound, int):
        if bound > SHORT_TEXT:
            return _digest_text(source, bound, F.lit(bound) if size is None else size)
        text = _spelled(source, [ALPHANUMERIC] * bound, STRING_BLOCK)
        return text if size is None else F.substr(text, F.lit(1), size)
    size = bound.cast("int")
    short = _spelled(source, [ALPHANUMERIC] * SHORT_TEXT, STRING_BLOCK)
    return F.when(size <= SHORT_TEXT, F.substr(short, F.lit(1), size)).otherwise(_digest_text(source, size, size))


def word(draw: Column, length: int) -> Column:
    """Alternating vowels and consonants, vowel first."""
    return _spelled(draw, ([VOWELS, CONSONANTS] * length)[:length], WORD_BLOCK)


def _hex64(draw: Column) -> Column:
    return F.lpad(F.hex(draw), 16, "0")


def random_bytes(draw: Column, n: int) -> Column:
    """Exactly ``n`` bytes, eight per draw."""
    if n <= 0:
        return F.lit(b"")
    blocks = (n + 7) // 8
    if blocks <= 8:
        text = F.concat(*[_hex64(element(draw, 0, F.lit(i))) for i in range(1, blocks + 1)])
    else:
        text = F.array_join(
            F.transform(F.sequence(F.lit(1), F.lit(blocks)), lambda i: _hex64(element(draw, 0, i))), ""
        )
    return F.unhex(F.substring(text, 1, 2 * n))


def _words(draw: Column, count: Column, n: int = 0) -> Column:
    pool = F.array(*[F.lit(w) for w in words.LOREM])
    chosen = F.transform(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
        lambda i: F.element_at(pool, (below(element(draw, n, i), len(words.LOREM)) + 1).cast("int")),
    )
    return F.when(count > 0, F.array_join(chosen, " ")).otherwise(F.lit(""))


def _count(draw: Column, lo: int, hi: int) -> Column:
    lo = max(0, lo)
    return F.lit(lo) if hi <= lo else integer(draw, lo, hi)


def _capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def lorem_ipsum(draw: Column, lo: int, hi: int, paragraphs: bool = False) -> Column:
    """``lo`` to ``hi`` (exclusive) words, or paragraphs of 2-6 sentences."""
    if not paragraphs:
        return _capitalized(_words(slot(draw, 1), _count(slot(draw, 2), lo, hi)))

    def sentence(d: Column) -> Column:
        opening = _capitalized(pick(slot(d, 1), words.LOREM))
        return F.concat(opening, F.lit(" "), _words(slot(d, 2), integer(slot(d, 3), 2, 20)), F.lit(". "))

    def paragraph(d: Column) -> Column:
        return F.array_join(
            F.transform(F.sequence(F.lit(1), integer(slot(d, 1), 2, 7)), lambda i: sentence(element(d, 2, i))), ""
        )

    count = _count(slot(draw, 2), lo, hi)
    text = F.array_join(
        F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: paragraph(element(draw, 3, i))), "\n"
    )
    return F.when(count > 0, F.rtrim(text)).otherwise(F.lit(""))


def json_users(draw: Column, items: int, nesting: int) -> Column:
    """JSON document of ``items`` users with ``nesting`` addresses each."""

    def address(d: Column) -> Column:
        return F.struct(
            state(slot(d, 1)).alias("state"),
            state_code(slot(d, 2)).alias("stateCode"),
            city(slot(d, 3)).alias("city"),
            country(slot(d, 4)).alias("country"),
            zip_code(slot(d, 5)).alias("zipCode"),
        )

    def user(d: Column) -> Column:
        return F.struct(
            email(slot(d, 1)).alias("email"),
            first_name(slot(d, 2)).alias("firstName"),
            last_name(slot(d, 3)).alias("lastName"),
            phone_number(slot(d, 4)).alias("telephone"),
            F.lower(first_name(slot(d, 5))).alias("userName"),
            F.transform(F.sequence(F.lit(1), F.lit(nesting)), lambda j: address(element(d, 6, j))).alias("addresses"),
        )

    users = F.transform(F.sequence(F.lit(1), F.lit(items)), lambda i: user(element(draw, 1, i)))
    return F.to_json(F.struct(users.alias("users")))


# -- identifiers and addresses ---------------------------------------------------


def uuid4(draw: Column) -> Column:
    high, low = F.lower(_hex64(slot(draw, 1))), F.lower(_hex64(slot(draw, 2)))
    variant = F.substr(F.lit("89ab"), (F.shiftrightunsigned(slot(draw, 2), 62) + 1).cast("int"), F.lit(1))
    return F.concat(
        F.substring(high, 1, 8), F.lit("-"), F.substring(high, 9, 4), F.lit("-4"), F.substring(high, 14, 3),
        F.lit("-"), variant, F.substring(low, 2, 3), F.lit("-"), F.substring(low, 5, 12),
    )


def ipv4(draw: Column) -> Column:
    return F.concat_ws(".", *[o.cast("string") for o in digits(draw, [255] * 4)])


def ipv6(draw: Column) -> Column:
    text = F.lower(F.concat(_hex64(slot(draw, 1)), _hex64(slot(draw, 2))))
    return F.concat_ws(":", *[F.substring(text, 4 * g + 1, 4) for g in range(8)])


def row_id_unordered(row: Column) -> Column:
    """Unique but scattered ids: a bijection inside blocks of 2^31 - 1 rows."""
    prime = 2**31 - 1
    inside = ((row % F.lit(prime).cast("bigint")) * F.lit(1103515245).cast("bigint")) % F.lit(prime).cast("bigint")
    return int_div(row, prime) * F.lit(2**31).cast("bigint") + inside


def row_id_ordered(row: Column, offset: int = 0) -> Column:
    """Unique ids in row order, starting after ``offset``."""
    return row + F.lit(offset + 1).cast("bigint")
