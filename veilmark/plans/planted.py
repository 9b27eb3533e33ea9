"""Queries over values that are planted by arithmetic in rows of the tables, so that SQL knows what must be found without any pattern.

Each family of detectors reads two texts a row and pattern: one with a value of its kind, and one with a near miss in which nothing may be found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.rows import each
from veilmark.operators import detect as D
from veilmark.operators import spans as A
from veilmark.plans.catalog import _pattern, query


def num(n: int, a: int = 7919, b: int = 13) -> str:
    """SQL of ``n`` digits that follow from the row's key ``k``."""
    return f"lpad(CAST((k * {a} + {b}) % {10**n} AS STRING), {n}, '0')"


def abc(i: int) -> str:
    return f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST((k + {i}) % 26 AS INT) + 1, 1)"


def one(i: int, letters: str) -> str:
    return f"substr('{letters}', CAST((k + {i}) % {len(letters)} AS INT) + 1, 1)"


def sql(*parts: str) -> str:
    return " || ".join(parts)


_AB = sql(abc(0), abc(3))
_DAY, _MONTH, _YEAR = "lpad(CAST(k % 28 + 1 AS STRING), 2, '0')", "lpad(CAST(k % 12 + 1 AS STRING), 2, '0')", "CAST(1900 + k % 200 AS STRING)"
_BYTE = lambda a: f"CAST((k * {a}) % 256 AS STRING)"
_HEX = "lower(lpad(hex(k % 65536), 4, '0'))"
_LONG = sql(num(9), "'aB'", num(9, 31, 7), "'cD'", num(9, 57, 5), "'eF'", num(5))  # 38 letters and digits

#: By family: pattern, its value, and what must not be found.
FAMILIES: dict[str, list[tuple[str, str, str]]] = {
    "ru_pii": [
        ("ru_phone", sql("'+7 9'", num(2), "' '", num(3), "'-'", num(2, 31), "'-'", num(2, 57)), sql("'+6 9'", num(2), "' '", num(3))),
        ("ru_passport", sql(num(4), "' '", num(6, 31)), sql(num(4), "' '", num(5, 31))),
        ("ru_snils", sql(num(3), "'-'", num(3, 31), "'-'", num(3, 57), "' '", num(2)), sql(num(3), "'-'", num(3, 31), "'-'", num(2))),
        ("ru_inn", num(10), num(11)),
        ("ru_ogrn", num(13), num(14)),
        ("bank_card", sql("'4'", num(3), "' '", num(4, 31), "' '", num(4, 57), "' '", num(4, 97)), num(12)),
        ("email", sql("'user.'", num(4), "'@mail-'", num(2), "'.example.com'"), sql("'user.'", num(4), "'@mail'")),
    ],
    "en_pii": [
        ("us_ssn", sql(num(3), "'-'", num(2), "'-'", num(4, 31)), sql(num(3), "'-'", num(2), "'-'", num(5))),
        ("iban", sql(_AB, num(2), num(18)), sql(_AB, num(2), num(9))),
        ("swift", sql(_AB, abc(5), abc(7), abc(11), abc(13), num(2)), sql(_AB, abc(5), num(5))),
    ],
    "identifiers": [
        ("military_number_hyphen", sql(num(2), "'-'", _AB, "'-'", num(4)), sql(num(2), "'-'", abc(0), "'-'", num(4))),
        ("military_number_space", sql(_AB, "' '", num(6)), sql(_AB, "' '", num(4))),
        ("vehicle_plate_ru_ua", sql(one(0, "ABEKMHOPCTYX"), num(3), one(5, "ABEKMHOPCTYX"), one(7, "ABEKMHOPCTYX")), sql(one(0, "DFGJ"), num(3), one(5, "DFGJ"))),
        ("vehicle_vin", sql(one(0, "HJKLM"), one(2, "ABCD"), num(6), one(1, "PRST"), num(8)), sql(one(0, "HJKLM"), num(15))),
        ("document_series_number", sql(num(2), "' '", num(2, 31), "' № '", num(6)), sql(num(2), "' '", num(2, 31), "' № '", num(3))),
        ("document_code_hyphen", sql(_AB, abc(9), "'-'", num(5)), sql(_AB, "'-'", num(2))),
        ("document_code_slash", sql(abc(0), "'-'", num(3), "'/'", num(4)), sql(abc(0), "'-'", num(1), "'/'", num(4))),
        ("document_numeric_hyphen", sql(num(6), "'-'", num(3), "'-'", num(2)), sql(num(3), "'-'", num(3))),
        ("document_letter_digit_compact", sql(_AB, num(7)), sql(_AB, num(5))),
        ("document_keyword_number", sql("'passport № '", _AB, num(7)), sql("'passport '", num(3))),
        ("inn_tin_keyword_number", sql("'TIN: '", num(10)), sql("'TIN: '", num(8))),
    ],
    "network": [
        ("ipv4_or_cidr", sql(_BYTE(1), "'.'", _BYTE(7), "'.'", _BYTE(31), "'.'", _BYTE(57), "'/'", "CAST(k % 33 AS STRING)"), sql("'256.'", _BYTE(7), "'.'", _BYTE(31), "'.300'")),
        ("ipv6_full", sql("'2001:db8:'", _HEX, "':0:1:2:3:'", _HEX), sql("'zz:'", _HEX)),
        ("ipv6_compressed", sql("'fe80::'", _HEX), sql("'fe80:'", _HEX)),
    ],
    "urls": [
        ("url_http", sql("'https://h'", num(3), "'.example/p?q='", num(4)), sql("'http:/h'", num(3))),
        ("url_www", sql("'www.h'", num(3), "'.example/a_'", num(2)), sql("'ww.h'", num(3))),
        ("url_domain_tld", sql("'shop-'", num(3), "'.store/a/'", num(2)), sql("'shop-'", num(3), "'.shoppe'")),
    ],
    "dates": [
        ("date_iso_ymd", sql(_YEAR, "'-'", _MONTH, "'-'", _DAY), sql(_YEAR, "'-13-'", _DAY)),
        ("date_dmy", sql(_DAY, "'.'", _MONTH, "'.'", _YEAR), sql("'32.'", _MONTH, "'.'", _YEAR)),
        ("date_month_year", sql(_MONTH, "'/'", _YEAR), sql("'13/'", _YEAR)),
        ("date_quarter", sql(_YEAR, "' Q'", "CAST(k % 4 + 1 AS STRING)"), sql(_YEAR, "' Q5'")),
        ("date_year_range", sql(_YEAR, "' - '", "CAST(1800 + k % 300 AS STRING)"), sql(_YEAR, "' - 17'", num(2))),
        ("date_textual_month_ru_uk_en", sql(_DAY, "' марта '", _YEAR), sql(_DAY, "' марте '", _YEAR)),
    ],
    "code_secrets": [
        ("aws_access_key", sql("'AKIA'", num(9), abc(0), num(6, 31)), sql("'AKIA'", num(9))),
        ("github_token", sql("'ghp_'", _LONG), sql("'ghz_'", _LONG)),
        ("slack_token", sql("'xoxb-'", num(9), "'-'", num(9, 31)), sql("'xoxc-'", num(9))),
        ("generic_api_key", sql("'api_key = '", _LONG), sql("'api_key = '", num(9))),
        ("password_assignment", sql("'password: pw'", num(6)), sql("'password '", num(6))),
        ("token_assignment", sql("'auth='", num(9)), sql("'auth='", num(7))),
        ("bearer_token", sql("'Bearer '", _LONG), sql("'Bearer '", num(9))),
        ("private_key_block", sql("'-----BEGIN RSA PRIVATE KEY-----'"), sql("'-----BEGIN PUBLIC KEY-----'")),
        ("jwt", sql("'eyJ'", num(9), "'aQ.'", _LONG, "'.'", _LONG), sql("'eyJ'", num(9), "'aQ.'", _LONG)),
    ],
}


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k"))


def _found(name: str, text: Column, tag: str) -> Column:
    return F.transform(D.find_pattern(text, *_pattern(name)), lambda s: F.struct(F.lit(tag).alias("pattern"), s["start"].alias("start_"), s["end"].alias("end_"), s["label"].alias("label"), s["score"].alias("score")))


def _family(cases: list[tuple[str, str, str]]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        spans = [_found(name, F.expr(f"'Re ' || {v} || ' end'"), tag) for name, hit, miss in cases for v, tag in ((hit, name), (miss, f"not {name}"))]
        return each(_keys(spark, d), F.flatten(F.array(*spans)), "s", "k").select("k", "s.*")

    return run


def _duck(expression: str) -> str:
    return expression.replace("hex(k % 65536)", "printf('%X', k % 65536)")


def _family_sql(cases: list[tuple[str, str, str]]) -> str:
    one = lambda name, hit: f"SELECT k, '{name}' AS pattern, 3 AS start_, (3 + length({hit}))::INT AS end_, '{_pattern(name)[0].label}' AS label, {_pattern(name)[0].score}::DOUBLE AS score FROM c"
    return "WITH c AS (SELECT c_custkey::BIGINT AS k FROM customer)\n" + "\nUNION ALL ".join(one(name, _duck(hit)) for name, hit, _ in cases)


for _name, _cases in FAMILIES.items():
    query(f"planted_{_name}", _family_sql(_cases))(_family(_cases))


# --- detectors that are no patterns ----------------------------------------------------------------------------------

_PHONES = {"+7 (9": sql("'+7 (9'", num(2), "') '", num(3), "'-'", num(4, 31)), "+44": sql("'+44 20 7'", num(3), "' '", num(4, 31)), "+1": sql("'+1-212-'", one(0, "23456789"), num(2), "'-'", num(4, 31)),
    "RU": sql("'8 (9'", num(2), "') '", num(3), "'-'", num(2, 31), "'-'", num(2, 57)), "KZ": sql("'8 7'", num(2), "' '", num(7, 31)), "UA": sql("'04'", num(1), "' '", num(3), "'-'", num(2, 31), "'-'", num(2, 57)), "GB": sql("'020 7'", num(3), "' '", num(4, 31)),
    "DE": sql("'0151 '", num(8, 31)), "US": sql("'('", one(0, "23456789"), "'1'", num(1), "') '", one(3, "23456789"), num(2), "'-'", num(4, 31)), "PL": sql("'512 '", num(3), "' '", num(3, 31)),
}
_NO_PHONES = {"+999": sql("'+999 '", num(9)), "short": sql("'+7 9'", num(4)), "bare": sql("'79'", num(9)), "RU area": sql("'8 (1'", num(2), "') '", num(3), "'-'", num(4, 31)), "US area": sql("'(1'", num(2), "') 555-'", num(4, 31)), "US bare": sql("'212555'", num(4, 31)),
    "PL zero": sql("'012 '", num(3), "' '", num(3, 31)), "UA area": sql("'01'", num(1), "' '", num(5), "' '", num(1, 31)), "date": sql("'03-04-19'", num(2)), "longer": sql("'020 7'", num(3), "' '", num(4, 31), "'-'", num(4))}
_IPS = {"v4": sql("'10.'", _BYTE(7), "'.'", _BYTE(31), "'.'", _BYTE(57)), "cidr": sql("'10.'", _BYTE(7), "'.0.0/16'"), "v6": sql("'2001:db8::'", _HEX), "mapped": sql("'::ffff:10.0.0.'", _BYTE(57))}
_NO_IPS = {"dots": "'1.2.3'", "big": sql("'300.1.1.'", _BYTE(57)), "time": sql("'12:'", num(2)), "twice": sql("'1::2::'", _HEX), "bits": sql("'10.0.0.1/33'")}


def _bounds(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start_"), s["end"].alias("end_")))


def _singles(find, good: dict[str, str], bad: dict[str, str]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        spans = [_bounds(find(F.expr(f"'at ' || {v} || ' ok'")), kind) for kind, v in (good | bad).items()]
        return each(_keys(spark, d), F.flatten(F.array(*spans)), "s", "k").select("k", "s.*")

    return run


def _singles_sql(good: dict[str, str]) -> str:
    rows = [f"SELECT k, '{t}' AS kind, 3 AS start_, (3 + length({_duck(v)}))::INT AS end_ FROM c" for t, v in good.items()]
    return "WITH c AS (SELECT c_custkey::BIGINT AS k FROM customer)\n" + "\nUNION ALL ".join(rows)


query("planted_phones", _singles_sql(_PHONES))(_singles(lambda t: D.find_phones(t, {"score": 0.92, "min_digits": 10}, "phone_number_lib"), _PHONES, _NO_PHONES))
query("planted_ips", _singles_sql(_IPS))(_singles(lambda t: D.find_ips(t, 0.995, "ip_address_lib"), _IPS, _NO_IPS))


@query(
    "planted_cards",
    """WITH c AS (SELECT c_custkey::BIGINT AS k FROM customer),
n AS (SELECT k, k % 4 AS kind, CASE WHEN k % 4 = 3 THEN '1111111111111111' ELSE '4' || lpad(((k * 7919) % 1000000)::VARCHAR, 14, '0') END AS head FROM c),
l AS (SELECT k, kind, CASE WHEN kind = 3 THEN head ELSE head || ((10 - list_sum([CASE WHEN i % 2 = 1 THEN (head[16 - i]::INT * 2) % 10 + (head[16 - i]::INT * 2) // 10 ELSE head[16 - i]::INT END FOR i IN range(1, 16)]) % 10
  + CASE kind WHEN 1 THEN 1 ELSE 0 END + CASE kind WHEN 2 THEN 1 ELSE 0 END) % 10)::VARCHAR END AS number FROM n)
SELECT k, CASE kind WHEN 0 THEN 0.83 WHEN 1 THEN 0.675 WHEN 2 THEN 0.78 END::DOUBLE AS score FROM l WHERE kind < 3""",
)
def planted_cards(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that pass the check (0), fail it (1), fail it but are grouped near a word for cards (2), and of one digit (3): kept and rescored, or dropped."""
    from veilmark.functions.texts import luhn_digit

    kind = F.col("k") % 4
    head = F.concat(F.lit("4"), F.lpad(((F.col("k") * 7919) % 1_000_000).cast("string"), 14, "0"))
    off = lambda x: F.pmod(x.cast("int") + F.when(kind == 0, 0).otherwise(1), F.lit(10)).cast("string")
    number = F.when(kind == 3, "1" * 16).otherwise(F.concat(head, off(luhn_digit(head))))
    grouped = F.concat_ws(" ", *(F.substring("number", 4 * i + 1, 4) for i in range(4)))
    text = F.when(kind == 2, F.concat(F.lit("card "), grouped)).otherwise(F.concat(F.lit("no "), F.col("number")))
    rows = _keys(spark, d).withColumn("number", number).withColumn("text", text)
    spans = D.validated(F.col("text"), D.find_pattern(F.col("text"), *_pattern("bank_card")), 0.4)
    return each(rows, spans, "s", "k").select("k", F.round("s.score", 6).alias("score"))


@query(
    "normalized_spans",
    """WITH c AS (SELECT c_custkey::BIGINT AS k, 'Manzil: O''zbekiston, Toshkent shahri, Chilonzor tumani, ' || c_custkey || '-mavze, 12-uy. Rahmat ' || c_custkey AS a, 'Trip ' || c_custkey || ' to Berlin was great yesterday.' AS b,
  'ID (AB' || c_custkey || ')' AS e, c_custkey || ' Baker street, London house 5' || chr(10) || 'Paris, the city of light' || chr(8232) AS f FROM customer)
SELECT k, 'expanded' AS kind, (strpos(a, 'Toshkent') - 1)::INT AS start_, (strpos(a, '. Rahmat') - 1)::INT AS end_ FROM c
UNION ALL SELECT k, 'stays', (strpos(b, 'Berlin') - 1)::INT, (strpos(b, 'Berlin') + 5)::INT FROM c
UNION ALL SELECT k, 'trimmed', 4, (length(e) - 1)::INT FROM c UNION ALL SELECT k, 'nothing left', 3, 4 FROM c
UNION ALL SELECT k, 'stops at the line', (strpos(f, 'Paris') - 1)::INT, length(f)::INT FROM c
UNION ALL SELECT k, 'keeps odd ends', (strpos(f, 'light') - 1)::INT, length(f)::INT FROM c""",
)
def normalized_spans(spark: SparkSession, d: str) -> DataFrame:
    """Locations grown over an address but not over a line end, spans trimmed, and a span of which nothing is left as it was."""
    key = F.col("k").cast("string")
    a, b, e = F.concat(F.lit("Manzil: O'zbekiston, Toshkent shahri, Chilonzor tumani, "), key, F.lit("-mavze, 12-uy. Rahmat "), key), F.concat(F.lit("Trip "), key, F.lit(" to Berlin was great yesterday.")), F.concat(F.lit("ID (AB"), key, F.lit(")"))
    f = F.concat(key, F.lit(" Baker street, London house 5\nParis, the city of light\u2028"))
    at = lambda t, word: F.instr(t, word) - 1
    span = lambda s, end, label, c: F.array(A.span(s, end, F.lit(label), F.lit(0.9), F.lit("x"), F.lit(c)))
    cases = {
        "expanded": (a, span(at(a, "Toshkent"), at(a, "Toshkent") + 15, "LOCATION", "location")), "stays": (b, span(at(b, "Berlin"), at(b, "Berlin") + 6, "LOCATION", "location")),
        "trimmed": (e, span(F.lit(2), F.length(e), "DOCUMENT_NUMBER", "identifier")), "nothing left": (e, span(F.lit(3), F.lit(4), "DOCUMENT_NUMBER", "identifier")),
        "stops at the line": (f, span(at(f, "Paris"), at(f, "Paris") + 5, "LOCATION", "location")), "keeps odd ends": (f, span(at(f, "light"), F.length(f), "DOCUMENT_NUMBER", "identifier")),
    }
    out = [_bounds(A.normalized(t, s), kind) for kind, (t, s) in cases.items()]
    return each(_keys(spark, d), F.flatten(F.array(*out)), "s", "k").select("k", "s.*")
