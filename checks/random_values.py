"""Random value functions over customer row ids."""

from pyspark.sql import functions as F

from checks import duck as D
from checks.registry import Tables, check
from rowloom.draws import cell_draw
from rowloom.functions import dictionaries as words
from rowloom.functions import random_values as rv

KEY = "c_custkey"


def value_query(name: str, make, sql: str, column: str = "value"):
    """One value per customer; ``sql`` sees the draw as ``d`` and the key as ``id``."""
    label = f"customer.{name}"

    @check(name, f"SELECT id, {sql} AS {column} FROM {D.rows('customer', KEY, label)}")
    def run(t: Tables):
        d = cell_draw(F.col(KEY), label)
        return t.customer.select(F.col(KEY).alias("id"), make(d).alias(column))


def capital(text: str) -> str:
    return f"list_transform([{text}], lambda w: upper(substr(w,1,1))||substr(w,2))[1]"


def email_sql(d: str) -> str:
    return (
        f"replace(lower({D.pick(D.slot(d, 1), words.FIRST_NAMES)})||'.'||"
        f"lower({D.pick(D.slot(d, 2), words.LAST_NAMES)})||'@example.com',' ','.')"
    )


def phone_sql(d: str) -> str:
    h = D.bits(d)
    return (
        f"'('||(100+{h}%900)||') '||(100+({h}//900)%900)||'-'||lpad((({h}//810000)%10000)::VARCHAR,4,'0')"
    )


def zip_sql(d: str) -> str:
    return f"lpad(({D.bits(d)}%100000)::VARCHAR,5,'0')"


def chars_sql(h: str, alphabets: list[str]) -> str:
    parts, used = [], 1
    for a in alphabets:
        parts.append(f"substr('{a}',(1+({h}//{used})%{len(a)})::INT,1)")
        used *= len(a)
    return "||".join(parts)


value_query("random_first_name", rv.first_name, D.pick("d", words.FIRST_NAMES))
value_query("random_last_name", rv.last_name, D.pick("d", words.LAST_NAMES))
value_query(
    "random_full_name", rv.full_name,
    f"{D.pick(D.slot('d', 1), words.FIRST_NAMES)}||' '||{D.pick(D.slot('d', 2), words.LAST_NAMES)}",
)
value_query("random_city", rv.city, capital(D.pick("d", words.CITIES)))
value_query("random_country", rv.country, D.pick("d", words.COUNTRIES))
value_query("random_email", rv.email, email_sql("d"))
value_query("random_phone_number", rv.phone_number, phone_sql("d"))
value_query("random_state", rv.state, D.pick("d", words.STATES))
value_query("random_state_code", rv.state_code, D.pick("d", words.STATE_CODES))
value_query("random_zip_code", rv.zip_code, zip_sql("d"))
value_query("random_currency", rv.currency, D.pick("d", words.CURRENCIES))
value_query("random_fact", rv.fact, D.pick("d", words.FACTS))
value_query(
    "random_big_decimal", lambda d: rv.decimal(d, 10, 5000, 2),
    f"((1000+{D.bits('d')}%499000)::DECIMAL(6,0)*0.01::DECIMAL(2,2))::DECIMAL(6,2)",
)
value_query(
    "random_big_decimal_default", rv.decimal,
    f"(({D.bits('d')}%1800)::DECIMAL(4,0)*0.01::DECIMAL(2,2))::DECIMAL(4,2)",
)
value_query(
    "random_big_decimal_wide", lambda d: rv.decimal(d, 0, 10**17, 2),
    f"(((({D.bits(D.slot('d', 1))}%1000000000000000)::HUGEINT+"
    f"({D.bits(D.slot('d', 2))}%1000000000000000)::HUGEINT*1000000000000000::HUGEINT)"
    "%10000000000000000000::HUGEINT)::DECIMAL(20,0)*0.01::DECIMAL(2,2))::DECIMAL(19,2)",
)
value_query("random_boolean", rv.boolean, f"{D.bits('d')}%2=0")
value_query("random_int", lambda d: rv.integer(d, 18, 99), f"(18+{D.bits('d')}%81)::INTEGER")
value_query("random_int_default", rv.integer, f"({D.bits('d')}%2147483647)::INTEGER")
value_query("random_long", rv.long, "((d>>1)%9223372036854775807::UHUGEINT)::BIGINT")
value_query("random_long_range", lambda d: rv.long(d, 5, 10**12), "(5+(d>>1)::BIGINT%999999999995)::BIGINT")
value_query("random_double", lambda d: rv.double(d, -1.5, 2.5), f"-1.5::DOUBLE+{D.unit('d')}*4.0::DOUBLE")


def string_sql(draw: str, length: int) -> str:
    blocks = [min(8, length - i) for i in range(0, length, 8)]
    return "||".join(
        chars_sql(D.bits(D.element(draw, 0, str(i))), [rv.ALPHANUMERIC] * n) for i, n in enumerate(blocks, 1)
    )


value_query("random_string", lambda d: rv.string(d, 12), string_sql("d", 12))
value_query(
    "random_string_long", lambda d: rv.string(d, 150),
    "rpad(replace(replace(to_base64(unhex(" + "||".join(f"sha256({D.bits('d')}||'|{i}')" for i in range(1, 7))
    + f")),'+',''),'/',''),150,{D.hex64(D.slot('d', 9))})",
)
value_query(
    "random_string_between", lambda d: rv.string(d, 3, 21),
    "substr(" + string_sql(D.slot("d", 1), 24) + f",1,(3+{D.bits(D.slot('d', 2))}%18)::INT)",
)
value_query("random_word", lambda d: rv.word(d, 9),
            chars_sql(D.bits(D.element("d", 0, "1")), [rv.VOWELS, rv.CONSONANTS] * 4 + [rv.VOWELS]))
value_query("random_bytes", lambda d: F.hex(rv.random_bytes(d, 20)),
            "upper(substr(" + "||".join(D.hex64(D.element("d", 0, str(i))) for i in (1, 2, 3)) + ",1,40))")


def lorem_words(d: str, count: str) -> str:
    return (
        f"array_to_string(list_transform(range(1,1+{count}), lambda w: "
        f"{D.pick(D.element(d, 0, 'w'), words.LOREM)}),' ')"
    )


value_query("random_lorem_words", lambda d: rv.lorem_ipsum(d, 3, 9),
            capital(lorem_words(D.slot("d", 1), f"(3+{D.bits(D.slot('d', 2))}%6)")))

@check(
    "random_lorem_paragraphs",
    f"""WITH doc AS (SELECT id, d, 1+{D.bits(D.slot('d', 2))}%3 AS n
                     FROM {D.rows('customer', KEY, 'customer.random_lorem_paragraphs')}),
        para AS (SELECT id, p, {D.element('d', 3, 'p')} AS pd FROM doc, LATERAL (SELECT unnest(range(1, n+1)) AS p)),
        para_n AS (SELECT *, 2+{D.bits(D.slot('pd', 1))}%5 AS n FROM para),
        sent AS (SELECT id, p, s, {D.element('pd', 2, 's')} AS sd
                 FROM para_n, LATERAL (SELECT unnest(range(1, n+1)) AS s)),
        sent_n AS (SELECT id, p, s, {capital(D.pick(D.slot('sd', 1), words.LOREM))} AS opening,
                          {D.slot('sd', 2)} AS wd, 2+{D.bits(D.slot('sd', 3))}%18 AS n FROM sent),
        word AS (SELECT id, p, s, opening, w, {D.pick(D.element('wd', 0, 'w'), words.LOREM)} AS word
                 FROM sent_n, LATERAL (SELECT unnest(range(1, n+1)) AS w)),
        sentences AS (SELECT id, p, s, opening||' '||string_agg(word, ' ' ORDER BY w)||'. ' AS text
                      FROM word GROUP BY id, p, s, opening),
        paragraphs AS (SELECT id, p, string_agg(text, '' ORDER BY s) AS text FROM sentences GROUP BY id, p)
        SELECT id, rtrim(string_agg(text, chr(10) ORDER BY p), ' ') AS value FROM paragraphs GROUP BY id""",
)
def random_lorem_paragraphs(t: Tables):
    d = cell_draw(F.col(KEY), "customer.random_lorem_paragraphs")
    return t.customer.select(F.col(KEY).alias("id"), rv.lorem_ipsum(d, 1, 4, paragraphs=True).alias("value"))


value_query(
    "random_uuid", rv.uuid4,
    "list_transform([{'a': " + D.hex64(D.slot("d", 1)) + ", 'b': " + D.hex64(D.slot("d", 2)) + ", 'v': "
    + f"substr('89ab',(1+(({D.slot('d', 2)})>>62))::INT,1)" + "}], lambda x: substr(x.a,1,8)||'-'||substr(x.a,9,4)"
    "||'-4'||substr(x.a,14,3)||'-'||x.v||substr(x.b,2,3)||'-'||substr(x.b,5,12))[1]",
)
value_query("random_ipv4", rv.ipv4,
            "||'.'||".join(f"(({D.bits('d')}//{255 ** k})%255)" for k in range(4)))
value_query(
    "random_ipv6", rv.ipv6,
    f"list_transform([{D.hex64(D.slot('d', 1))}||{D.hex64(D.slot('d', 2))}], lambda x: "
    + "||':'||".join(f"substr(x,{4 * g + 1},4)" for g in range(8)) + ")[1]",
)
value_query(
    "random_money", lambda d: rv.money_text(d),
    "list_transform([{'n': " + D.bits(D.slot("d", 1)) + "%1800, 'c': " + D.pick(D.slot("d", 2), words.CURRENCIES)
    + "}], lambda m: CASE WHEN m.c IN (" + ",".join(f"'{c}'" for c in words.NO_DIGIT_CURRENCIES)
    + ") THEN (m.n//100)::VARCHAR WHEN m.c IN (" + ",".join(f"'{c}'" for c in words.THREE_DIGIT_CURRENCIES)
    + ") THEN (m.n*0.01::DECIMAL(2,2))::DECIMAL(9,3)::VARCHAR ELSE (m.n*0.01::DECIMAL(2,2))::DECIMAL(9,2)::VARCHAR END"
    "||' '||m.c)[1]",
)
WEIGHTED = (["gold", "silver", "bronze", "none"], [1.0, 2.5, 4.0, 0.5])
value_query("weighted_choice", lambda d: rv.weighted_pick(d, *WEIGHTED),
            f"CASE WHEN {D.unit('d')}*8.0::DOUBLE<=1.0 THEN 'gold' WHEN {D.unit('d')}*8.0::DOUBLE<=3.5 THEN 'silver' "
            f"WHEN {D.unit('d')}*8.0::DOUBLE<=7.5 THEN 'bronze' ELSE 'none' END")
LONG_LIST = ([f"item {i}" for i in range(150)], [1.0 + i % 7 for i in range(150)])
value_query(
    "weighted_choice_long_list", lambda d: rv.weighted_pick(d, *LONG_LIST),
    "'item '||len(list_filter(list_transform(range(1,151), lambda i: list_sum(list_transform(range(0,i), lambda j: "
    f"1.0::DOUBLE+j%7))), lambda c: c<{D.unit('d')}*{sum(LONG_LIST[1])}::DOUBLE))",
)


@check(
    "select_random",
    "SELECT id, ['low','mid',seg][1+" + D.bits("d") + "%3] AS value FROM "
    + D.rows("customer", KEY, "customer.select_random", "c_mktsegment AS seg"),
)
def select_random(t: Tables):
    d = cell_draw(F.col(KEY), "customer.select_random")
    return t.customer.select(
        F.col(KEY).alias("id"), rv.select_random(d, F.lit("low"), F.lit("mid"), F.col("c_mktsegment")).alias("value")
    )


@check(
    "random_json",
    f"""WITH users AS (
          SELECT id, u AS user_no, {D.element('d', 1, 'u')} AS ud
          FROM {D.rows('customer', KEY, 'customer.random_json')}, range(1,3) AS r(u)),
        addresses AS (SELECT *, a AS address_no, {D.element('ud', 6, 'a')} AS ad FROM users, range(1,3) AS r(a))
        SELECT id, user_no, address_no, {email_sql(D.slot('ud', 1))} AS email,
               {D.pick(D.slot('ud', 2), words.FIRST_NAMES)} AS first_name,
               {D.pick(D.slot('ud', 3), words.LAST_NAMES)} AS last_name,
               {phone_sql(D.slot('ud', 4))} AS telephone,
               lower({D.pick(D.slot('ud', 5), words.FIRST_NAMES)}) AS user_name,
               {D.pick(D.slot('ad', 1), words.STATES)} AS state,
               {D.pick(D.slot('ad', 2), words.STATE_CODES)} AS state_code,
               {capital(D.pick(D.slot('ad', 3), words.CITIES))} AS city,
               {D.pick(D.slot('ad', 4), words.COUNTRIES)} AS country,
               {zip_sql(D.slot('ad', 5))} AS zip_code
        FROM addresses""",
)
def random_json(t: Tables):
    shape = (
        "users array<struct<email:string,firstName:string,lastName:string,telephone:string,userName:string,"
        "addresses:array<struct<state:string,stateCode:string,city:string,country:string,zipCode:string>>>>"
    )
    made = t.customer.select(
        F.col(KEY).alias("id"),
        F.from_json(rv.json_users(cell_draw(F.col(KEY), "customer.random_json"), 2, 2), shape).alias("doc"),
    )
    users = made.select("id", F.posexplode("doc.users").alias("u", "user"))
    flat = users.select("id", "u", "user", F.posexplode("user.addresses").alias("a", "address"))
    return flat.select(
        "id", (F.col("u") + 1).cast("bigint").alias("user_no"), (F.col("a") + 1).cast("bigint").alias("address_no"),
        F.col("user.email").alias("email"), F.col("user.firstName").alias("first_name"),
        F.col("user.lastName").alias("last_name"), F.col("user.telephone").alias("telephone"),
        F.col("user.userName").alias("user_name"), F.col("address.state").alias("state"),
        F.col("address.stateCode").alias("state_code"), F.col("address.city").alias("city"),
        F.col("address.country").alias("country"), F.col("address.zipCode").alias("zip_code"),
    )


@check(
    "row_id_ordered",
    "SELECT l_orderkey AS id, l_linenumber AS line, l_orderkey*8+l_linenumber+1 AS value FROM lineitem",
)
def row_id_ordered(t: Tables):
    position = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return t.lineitem.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), rv.row_id_ordered(position).alias("value")
    )


@check(
    "row_id_unordered",
    "SELECT o_orderkey AS id, (o_orderkey//2147483647)*2147483648+((o_orderkey%2147483647)*1103515245)%2147483647 "
    "AS value FROM orders",
)
def row_id_unordered(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("id"), rv.row_id_unordered(F.col("o_orderkey")).alias("value"))
