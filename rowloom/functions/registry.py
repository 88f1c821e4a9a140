"""The function catalogue: names usable in specs and in SQL expressions.

``build_call`` serves specs (a name and literal arguments). ``register_functions``
installs the same functions as SQL functions of the session, each taking the
cell draw first: ``randomInt(draw, 0, 100)``. A second random value in the same
expression takes another slot: ``randomCity(drawSlot(draw, 1))``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import dictionaries as words
from rowloom.functions import random_values as rv
from rowloom.functions import scalar, temporal


@dataclass(frozen=True)
class FunctionEntry:
    name: str
    category: str
    args: str
    returns: str
    doc: str
    build: Callable[..., Column] | None = None
    sql: str | None = None


def _random_bytes_text(draw: Column, n: int) -> Column:
    return scalar.to_base64(rv.random_bytes(draw, n))


def _choice(draw: Column, *values) -> Column:
    return rv.pick(draw, list(values))


def _today(draw: Column, anchor: str | None = None) -> Column:
    return temporal.random_date(draw, F.lit(anchor).cast("date") if anchor else F.current_date())


def _now(draw: Column, anchor: str | None = None) -> Column:
    return temporal.random_datetime(draw, F.lit(anchor).cast("timestamp_ntz") if anchor else F.localtimestamp())


def _clock(draw: Column, anchor: str | None = None) -> Column:
    start = F.lit(temporal.parse_time(anchor)).cast("bigint") if anchor else temporal.current_time()
    return temporal.time_text(temporal.random_time(draw, start))


# SQL bodies see the draw as ``draw``; the helpers below spell out the shared parts.


def _bits(draw: str = "draw") -> str:
    return f"shiftrightunsigned({draw}, 12)"


def _slot(n: int, draw: str = "draw") -> str:
    return f"xxhash64({n}L, {draw})"


def _element(n: int, index: str, draw: str = "draw") -> str:
    return f"xxhash64({n}L, {draw}, CAST({index} AS BIGINT))"


def _pick(values: list[str], draw: str = "draw") -> str:
    listed = ",".join("'" + v.replace("'", "\\'") + "'" for v in values)
    return f"element_at(array({listed}), CAST(1 + {_bits(draw)} % {len(values)} AS INT))"


def _hex(draw: str) -> str:
    return f"lpad(lower(hex({draw})), 16, '0')"


def _upper_first(text: str) -> str:
    return f"concat(upper(substr({text}, 1, 1)), substr({text}, 2))"


def _city(draw: str = "draw") -> str:
    return _upper_first(_pick(words.CITIES, draw))


def _email(draw: str = "draw") -> str:
    first, last = _pick(words.FIRST_NAMES, _slot(1, draw)), _pick(words.LAST_NAMES, _slot(2, draw))
    return f"replace(concat(lower({first}), '.', lower({last}), '@example.com'), ' ', '.')"


def _phone(draw: str = "draw") -> str:
    line = f"lpad(CAST(({_bits(draw)} div 810000) % 10000 AS STRING), 4, '0')"
    return f"concat('(', 100 + {_bits(draw)} % 900, ') ', 100 + ({_bits(draw)} div 900) % 900, '-', {line})"


def _zip(draw: str = "draw") -> str:
    return f"lpad(CAST({_bits(draw)} % 100000 AS STRING), 5, '0')"


def _spelled(alphabets: list[str], block: int, draw: str = "draw") -> str:
    """One letter per alphabet, ``block`` letters per draw."""
    parts = []
    for start in range(0, len(alphabets), block):
        source, used = _bits(_element(0, str(start // block + 1), draw)), 1
        for letters in alphabets[start : start + block]:
            place = f"CAST(1 + ({source} div {used}) % {len(letters)} AS INT)"
            parts.append(f"substring(CAST('{letters}' AS BINARY), {place}, 1)")
            used *= len(letters)
    return f"CAST(concat({', '.join(parts)}) AS STRING)"


def _word() -> str:
    """Blocks of letters, as many as the length takes, each spelled from a draw of its own."""
    alphabets = ([rv.VOWELS, rv.CONSONANTS] * rv.WORD_BLOCK)[: rv.WORD_BLOCK]
    source, used, parts = _bits(_element(0, "b")), 1, []
    for letters in alphabets:
        parts.append(f"substring('{letters}', CAST(1 + ({source} div {used}) % {len(letters)} AS INT), 1)")
        used *= len(letters)
    blocks = f"sequence(1, greatest(1, CAST((length + {rv.WORD_BLOCK - 1}) div {rv.WORD_BLOCK} AS INT)))"
    return f"substr(array_join(transform({blocks}, b -> concat({', '.join(parts)})), ''), 1, length)"


def _string() -> str:
    source = f"(CASE WHEN longest IS NULL THEN draw ELSE {_slot(1)} END)"
    size = f"CAST(CASE WHEN longest IS NULL THEN length ELSE length + {_bits(_slot(2))} % (longest - length) END AS INT)"
    bound = "(CASE WHEN longest IS NULL THEN length ELSE longest - 1 END)"
    short = f"substr({_spelled([rv.ALPHANUMERIC] * rv.SHORT_TEXT, rv.STRING_BLOCK, source)}, 1, {size})"
    digest = f"sha2(concat(CAST({_bits(source)} AS STRING), '|', CAST(i AS STRING)), 256)"
    groups = f"CAST(3 * ({bound} div {rv.DIGEST_LETTERS} + 1) AS INT)"
    text = f"base64(unhex(array_join(transform(sequence(1, {groups}), i -> {digest}), '')))"
    for symbol in ("+", "/", "\\r\\n"):
        text = f"replace({text}, '{symbol}', '')"
    long = f"rpad({text}, {size}, hex({_slot(9, source)}))"
    return f"CASE WHEN {bound} <= {rv.SHORT_TEXT} THEN {short} ELSE {long} END"


def _sentence_words(count: str, draw: str) -> str:
    chosen = _pick(words.LOREM, _element(0, "w", draw))
    return (
        f"CASE WHEN {count} > 0 THEN array_join(transform(sequence(1, CAST(greatest({count}, 1) AS INT)), "
        f"w -> {chosen}), ' ') ELSE '' END"
    )


def _count_between(draw: str) -> str:
    return f"(CASE WHEN hi <= lo THEN lo ELSE lo + {_bits(draw)} % (hi - lo) END)"


def _lorem() -> str:
    plain = _upper_first(f"({_sentence_words(_count_between(_slot(2)), _slot(1))})")
    opening = _upper_first(_pick(words.LOREM, _slot(1, "sd")))
    rest = _sentence_words(f"(2 + {_bits(_slot(3, 'sd'))} % 18)", _slot(2, "sd"))
    sentences = (
        f"array_join(transform(transform(sequence(1, CAST(2 + {_bits(_slot(1, 'pd'))} % 5 AS INT)), "
        f"s -> {_element(2, 's', 'pd')}), sd -> concat({opening}, ' ', {rest}, '. ')), '')"
    )
    count = f"CAST(greatest({_count_between(_slot(2))}, 1) AS INT)"
    body = f"rtrim(array_join(transform(transform(sequence(1, {count}), p -> {_element(3, 'p')}), pd -> {sentences}), '\\n'))"
    paged = f"CASE WHEN {_count_between(_slot(2))} > 0 THEN {body} ELSE '' END"
    return f"CASE WHEN paragraphs THEN {paged} ELSE {plain} END"


def _json() -> str:
    address = (
        f"named_struct('state', {_pick(words.STATES, _slot(1, 'ad'))}, 'stateCode', "
        f"{_pick(words.STATE_CODES, _slot(2, 'ad'))}, 'city', {_city(_slot(3, 'ad'))}, 'country', "
        f"{_pick(words.COUNTRIES, _slot(4, 'ad'))}, 'zipCode', {_zip(_slot(5, 'ad'))})"
    )
    addresses = f"transform(transform(sequence(1, nesting), j -> {_element(6, 'j', 'ud')}), ad -> {address})"
    user = (
        f"named_struct('email', {_email(_slot(1, 'ud'))}, 'firstName', {_pick(words.FIRST_NAMES, _slot(2, 'ud'))}, "
        f"'lastName', {_pick(words.LAST_NAMES, _slot(3, 'ud'))}, 'telephone', {_phone(_slot(4, 'ud'))}, "
        f"'userName', lower({_pick(words.FIRST_NAMES, _slot(5, 'ud'))}), 'addresses', {addresses})"
    )
    users = f"transform(transform(sequence(1, items), i -> {_element(1, 'i')}), ud -> {user})"
    return f"to_json(named_struct('users', {users}))"


def _uuid() -> str:
    high, low = _hex(_slot(1)), _hex(_slot(2))
    variant = f"substr('89ab', CAST(1 + shiftrightunsigned({_slot(2)}, 62) AS INT), 1)"
    return (
        f"concat(substr({high}, 1, 8), '-', substr({high}, 9, 4), '-4', substr({high}, 14, 3), '-', {variant}, "
        f"substr({low}, 2, 3), '-', substr({low}, 5, 12))"
    )


def _signed(n: int, draw: str = "draw") -> str:
    size = f"({_bits(draw)} div 2) % {n}"
    return f"CAST(CASE WHEN {_bits(draw)} % 2 = 0 THEN {size} ELSE -({size}) END AS INT)"


def _quoted(codes: list[str]) -> str:
    return ", ".join(f"'{c}'" for c in codes)


def _money() -> str:
    code = f"coalesce(currency, {_pick(words.CURRENCIES, _slot(2))})"
    cents = f"({_bits(_slot(1))} % 1800)"
    return (
        f"concat(CASE WHEN {code} IN ({_quoted(words.NO_DIGIT_CURRENCIES)}) THEN CAST({cents} div 100 AS STRING) "
        f"WHEN {code} IN ({_quoted(words.THREE_DIGIT_CURRENCIES)}) THEN CAST(CAST({cents} * 0.01BD AS DECIMAL(9,3)) "
        f"AS STRING) ELSE CAST(CAST({cents} * 0.01BD AS DECIMAL(9,2)) AS STRING) END, ' ', {code})"
    )


def _ordered(value: str, kind: str) -> str:
    """``value``, but an error for an empty range, as the column form gives when it is built."""
    refused = f"raise_error(concat('empty range: ', CAST(lo AS STRING), ' to ', CAST(hi AS STRING)))"
    return f"CASE WHEN lo < hi OR lo IS NULL OR hi IS NULL THEN {value} ELSE CAST({refused} AS {kind}) END"


_TIME_OF_DAY = "(hour(anchor) * 3600 + minute(anchor) * 60 + second(anchor))"
_NOW = "TIMESTAMP_NTZ DEFAULT localtimestamp()"

ENTRIES = [
    FunctionEntry("randomFirstName", "random", "", "STRING", "a first name", rv.first_name, _pick(words.FIRST_NAMES)),
    FunctionEntry("randomLastName", "random", "", "STRING", "a last name", rv.last_name, _pick(words.LAST_NAMES)),
    FunctionEntry("randomFullName", "random", "", "STRING", "first and last name", rv.full_name,
                  f"concat_ws(' ', {_pick(words.FIRST_NAMES, _slot(1))}, {_pick(words.LAST_NAMES, _slot(2))})"),
    FunctionEntry("randomCity", "random", "", "STRING", "a city", rv.city, _city()),
    FunctionEntry("randomCountry", "random", "", "STRING", "a country", rv.country, _pick(words.COUNTRIES)),
    FunctionEntry("randomEmail", "random", "", "STRING", "an address at example.com", rv.email, _email()),
    FunctionEntry("randomPhoneNumber", "random", "", "STRING", "(ddd) ddd-dddd", rv.phone_number, _phone()),
    FunctionEntry("randomState", "random", "", "STRING", "a state", rv.state, _pick(words.STATES)),
    FunctionEntry("randomStateCode", "random", "", "STRING", "a state code", rv.state_code, _pick(words.STATE_CODES)),
    FunctionEntry("randomZipCode", "random", "", "STRING", "five digits", rv.zip_code, _zip()),
    FunctionEntry("randomCurrency", "random", "", "STRING", "a currency code", rv.currency, _pick(words.CURRENCIES)),
    FunctionEntry("randomBigDecimal", "random", "lo DECIMAL(17,2) DEFAULT 0, hi DECIMAL(17,2) DEFAULT 18", "DECIMAL(20,2)",
                  "uniform in [lo, hi) at two digits; specs may also give the scale", rv.decimal,
                  _ordered(f"CAST((CAST(lo * 100 AS BIGINT) + {_bits()} % nullif(CAST((hi - lo) * 100 AS BIGINT), 0)) * 0.01BD AS DECIMAL(20,2))", "DECIMAL(20,2)")),
    FunctionEntry("randomMoney", "random", "currency STRING DEFAULT NULL", "STRING", "amount and currency code",
                  rv.money_text, _money()),
    FunctionEntry("randomBoolean", "random", "", "BOOLEAN", "a fair coin", rv.boolean, f"{_bits()} % 2 = 0"),
    FunctionEntry("randomInt", "random", "lo BIGINT DEFAULT 0, hi BIGINT DEFAULT 2147483647", "INT",
                  "uniform in [lo, hi)", rv.integer, _ordered(f"CAST(lo + {_bits()} % nullif(hi - lo, 0) AS INT)", "INT")),
    FunctionEntry("randomLong", "random", "lo BIGINT DEFAULT 0, hi BIGINT DEFAULT 9223372036854775807", "BIGINT",
                  "uniform in [lo, hi)", rv.long, _ordered("lo + shiftrightunsigned(draw, 1) % nullif(hi - lo, 0)", "BIGINT")),
    FunctionEntry("randomDouble", "random", "lo DOUBLE DEFAULT 0, hi DOUBLE DEFAULT 1.7976931348623157E308D", "DOUBLE",
                  "uniform in [lo, hi)", rv.double, _ordered(f"lo + {_bits()} / 4503599627370496.0D * (hi - lo)", "DOUBLE")),
    FunctionEntry("randomString", "random", "length INT, longest INT DEFAULT NULL", "STRING",
                  "letters and digits, of one length or of a length in [length, longest)", rv.string, _string()),
    FunctionEntry("randomWord", "random", "length INT", "STRING", "vowels and consonants in turn", rv.word, _word()),
    FunctionEntry("randomBytes", "random", "n INT", "BINARY", "n bytes", rv.random_bytes,
                  "unhex(substr(array_join(transform(sequence(1, greatest(1, CAST((n + 7) div 8 AS INT))), "
                  f"i -> {_hex(_element(0, 'i'))}), ''), 1, 2 * n))"),
    FunctionEntry("randomBytesBase64", "random", "n INT", "STRING", "n bytes as base64", _random_bytes_text,
                  "regexp_replace(base64(unhex(substr(array_join(transform(sequence(1, greatest(1, CAST((n + 7) div 8 AS INT))), "
                  f"i -> {_hex(_element(0, 'i'))}), ''), 1, 2 * n))), '[\\r\\n]', '')"),
    FunctionEntry("randomLoreIpsum", "random", "lo INT, hi INT, paragraphs BOOLEAN DEFAULT false", "STRING",
                  "filler words or paragraphs", rv.lorem_ipsum, _lorem()),
    FunctionEntry("randomJson", "random", "items INT, nesting INT", "STRING", "a JSON document of users", rv.json_users,
                  _json()),
    FunctionEntry("selectRandom", "random", "options ARRAY<STRING>", "STRING", "one of the options", _choice,
                  f"element_at(options, CAST(1 + {_bits()} % size(options) AS INT))"),
    FunctionEntry("randomOf", "random", "options ARRAY<STRING>", "STRING", "same as selectRandom", _choice,
                  f"element_at(options, CAST(1 + {_bits()} % size(options) AS INT))"),
    FunctionEntry("randomFact", "random", "", "STRING", "a sentence", rv.fact, _pick(words.FACTS)),
    FunctionEntry("randomUUID", "id", "", "STRING", "a version 4 identifier", rv.uuid4, _uuid()),
    FunctionEntry("randomIPv4", "network", "", "STRING", "four octets below 255", rv.ipv4,
                  f"concat_ws('.', {_bits()} % 255, ({_bits()} div 255) % 255, ({_bits()} div 65025) % 255, "
                  f"({_bits()} div 16581375) % 255)"),
    FunctionEntry("randomIPv6", "network", "", "STRING", "eight groups of hex digits", rv.ipv6, "concat_ws(':', " + ", ".join(
        f"substr({_hex(_slot(1 + g // 4))}, {4 * (g % 4) + 1}, 4)" for g in range(8)) + ")"),
    FunctionEntry("randomDate", "temporal", "anchor DATE DEFAULT current_date()", "DATE",
                  "within 90 days of the anchor", _today, f"date_add(anchor, {_signed(90)})"),
    FunctionEntry("randomTime", "temporal", f"anchor {_NOW}", "STRING", "within 24 hours of the anchor", _clock,
                  f"date_format(timestampadd(SECOND, pmod({_TIME_OF_DAY} + {_signed(24)} * 3600, 86400), "
                  "TIMESTAMP_NTZ '2000-01-01 00:00:00'), 'HH:mm:ss')"),
    FunctionEntry("randomDateTime", "temporal", f"anchor {_NOW}", "TIMESTAMP_NTZ", "within 90 days and 24 hours", _now,
                  f"timestampadd(HOUR, {_signed(24, _slot(2))}, timestampadd(DAY, {_signed(90, _slot(1))}, anchor))"),
]
BY_NAME = {e.name.lower(): e for e in ENTRIES}
BY_NAME["random"] = BY_NAME["randomof"]  # the built-in random() keeps its name in SQL


def _cases(table: dict[str, int]) -> str:
    return " ".join(f"WHEN '{name}' THEN {factor}L" for name, factor in table.items())


_MONTHS, _DAYS, _MICROS = _cases(temporal.MONTH_UNITS), _cases(temporal.DAY_UNITS), _cases(temporal.MICRO_UNITS)
_REFUSED = "raise_error(concat('unit does not fit this type: ', unit))"
_DAY_MICROS = temporal.DAY_SECONDS * 10**6

# Functions of plain values; they take no draw.
VALUE_FUNCTIONS = [
    ("currentDate", "temporal", "", "DATE", "current_date()"),
    ("currentTime", "temporal", "", "STRING", "date_format(localtimestamp(), 'HH:mm:ss')"),
    ("currentDateTime", "temporal", "", "TIMESTAMP_NTZ", "localtimestamp()"),
    ("plusDate", "temporal", "day DATE, amount BIGINT, unit STRING", "DATE",
     f"CASE WHEN (CASE upper(unit) {_DAYS} END) IS NOT NULL THEN date_add(day, CAST(amount * (CASE upper(unit) {_DAYS} END) "
     f"AS INT)) WHEN (CASE upper(unit) {_MONTHS} END) IS NOT NULL THEN add_months(day, CAST(amount * (CASE upper(unit) "
     f"{_MONTHS} END) AS INT)) ELSE {_REFUSED} END"),
    ("plusTime", "temporal", "seconds BIGINT, amount BIGINT, unit STRING", "BIGINT",
     f"pmod(seconds * 1000000L + amount * (CASE upper(unit) {_MICROS} ELSE {_REFUSED} END), {_DAY_MICROS}L) div 1000000L"),
    ("plusDateTime", "temporal", "moment TIMESTAMP_NTZ, amount BIGINT, unit STRING", "TIMESTAMP_NTZ",
     f"CASE WHEN (CASE upper(unit) {_DAYS} END) IS NOT NULL THEN timestampadd(DAY, CAST(amount * (CASE upper(unit) {_DAYS} "
     f"END) AS INT), moment) WHEN (CASE upper(unit) {_MONTHS} END) IS NOT NULL THEN timestampadd(MONTH, CAST(amount * "
     f"(CASE upper(unit) {_MONTHS} END) AS INT), moment) WHEN (CASE upper(unit) {_MICROS} END) IS NOT NULL THEN "
     f"timestampadd(MICROSECOND, amount * (CASE upper(unit) {_MICROS} END), moment) ELSE {_REFUSED} END"),
    ("lowerCase", "text", "s STRING", "STRING", "lower(s)"),
    ("upperCase", "text", "s STRING", "STRING", "upper(s)"),
    ("capitalize", "text", "s STRING", "STRING", "concat(upper(substr(s, 1, 1)), substr(s, 2))"),
    ("trimAll", "text", "s STRING", "STRING", r"regexp_replace(s, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '')"),
    ("toBase64", "text", "b BINARY", "STRING", r"regexp_replace(base64(b), '[\\r\\n]', '')"),
    ("fromBase64", "text", "s STRING", "BINARY", "unbase64(s)"),
    ("drawSlot", "random", "draw BIGINT, n BIGINT", "BIGINT", "xxhash64(n, draw)"),
    ("uniqueRowId", "id", "row BIGINT", "BIGINT", "row + 1"),
    ("unorderedUniqueRowId", "id", "row BIGINT", "BIGINT",
     "(row div 2147483647) * 2147483648L + ((row % 2147483647) * 1103515245) % 2147483647"),
]


def build_call(draw: Column, name: str, *args) -> Column:
    entry = BY_NAME.get(name.lower())
    if entry is None:
        raise ValueError(f"unknown function {name}")
    return entry.build(draw, *args)


def register_functions(spark: SparkSession) -> list[str]:
    """Install the catalogue as temporary SQL functions; returns their names."""
    done = []
    for e in ENTRIES:
        if e.sql is not None:
            args = "draw BIGINT" + (f", {e.args}" if e.args else "")
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {e.name}({args}) RETURNS {e.returns} RETURN {e.sql}")
            done.append(e.name)
    for name, _, args, returns, body in VALUE_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
        done.append(name)
    return done


def register_sql_function(spark: SparkSession, names: str, args: str, returns: str, body: str) -> None:
    """A user function under one or more names separated by ``;``."""
    for name in names.split(";"):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name.strip()}({args}) RETURNS {returns} RETURN {body}")


def functions_df(spark: SparkSession) -> DataFrame:
    """The catalogue as rows: name, category, args, returns, doc."""
    listed = [(e.name, e.category, e.args, e.returns, e.doc) for e in ENTRIES]
    listed += [(n, c, a, r, b) for n, c, a, r, b in VALUE_FUNCTIONS]
    return spark.createDataFrame(listed, "name string, category string, args string, returns string, doc string")
