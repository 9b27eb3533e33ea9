"""Queries over the driver's tables, one per operator, each with DuckDB SQL that says the same.

Gold spans are not in the tables. Where a query needs spans it derives them from ids and text lengths by arithmetic that SQL can repeat:
five gold spans a document, and predictions that keep, shift, relabel or misplace them in turn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions import labels as L
from veilmark.functions import texts as T
from veilmark.functions.rows import each
from veilmark.operators import detect as D
from veilmark.operators import masking as M
from veilmark.operators import metrics as E
from veilmark.operators import plugins as P
from veilmark.operators import sampling as S
from veilmark.operators import spans as A
from veilmark.operators import synth as N
from veilmark.sources import chats
from veilmark.sources.policy import Pattern, load_policy
from veilmark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", "lang", "source")
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("sample_id"), text.alias("text"), "lang", "source", F.length(text).alias("n"))


LABELS = list(L.CANONICAL)
_SQL_LABELS = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"


def _derived(doc: Column, n: Column, k: Column, salt: int, label_step: int = 0) -> Column:
    start = F.pmod(doc * 37 + k * 53 + salt, F.greatest(n - 12, F.lit(1)))
    end = F.least(start + 3 + F.pmod(doc + k * 5 + salt, F.lit(10)), n)
    canonical = F.get(F.array(*map(F.lit, LABELS)), F.pmod(doc + k + label_step, F.lit(11)).cast("int"))
    score = (F.pmod(doc * 7 + k * 13 + salt, F.lit(50)) + 50).cast("double") / 100
    return A.span(start, end, F.upper(canonical), score, F.concat(F.lit("det"), F.pmod(k, F.lit(3)).cast("string")), canonical)


def _gold(count: int = 5, salt: int = 0) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: _derived(F.col("doc_id"), F.col("n"), k, salt))


def _predicted() -> Column:
    def one(k: Column) -> Column:
        doc, n = F.col("doc_id"), F.col("n")
        mode = F.pmod(doc + k, F.lit(4))
        g = _derived(doc, n, k, 0)
        moved = A.span(F.least(g["start"] + 2, n), F.least(g["end"] + 2, n), g["label"], g["score"], g["detector"], g["canonical"])
        return F.when(mode == 0, g).when(mode == 1, moved).when(mode == 2, _derived(doc, n, k, 0, 1)).otherwise(_derived(doc, n, k, 17))

    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(5)), one), lambda s: s["end"] > s["start"])


def _samples(spark: SparkSession, d: str) -> DataFrame:
    gold = F.filter(_gold(), lambda s: s["end"] > s["start"])
    return _documents(spark, d).withColumn("gold", gold).withColumn("predicted", _predicted())


_DOCS = "docs AS (SELECT doc_id, 'd' || doc_id AS sample_id, coalesce(text, '') AS text, lang, source, length(coalesce(text, ''))::BIGINT AS n FROM documents)"


def _derived_sql(name: str, count: int, salt: int, step: int = 0) -> str:
    return f"""{name} AS (SELECT doc_id, n, k, s AS start_, least(s + 3 + (doc_id + k * 5 + {salt}) % 10, n) AS end_, upper(c) AS label, c AS canonical, score, 'det' || (k % 3) AS detector
  FROM (SELECT doc_id, n, k, (doc_id * 37 + k * 53 + {salt}) % greatest(n - 12, 1) AS s, {_SQL_LABELS}[((doc_id + k + {step}) % 11) + 1] AS c, (((doc_id * 7 + k * 13 + {salt}) % 50) + 50)::DOUBLE / 100 AS score
        FROM docs, (SELECT unnest(range(0, {count})) AS k)))"""


_GOLD = f"WITH RECURSIVE {_DOCS},\n{_derived_sql('g0', 5, 0)},\ngold AS (SELECT * FROM g0 WHERE end_ > start_)"
_PRED = f"""{_derived_sql("p0", 6, 0)},
{_derived_sql("p2", 6, 0, 1)},
{_derived_sql("p3", 6, 17)},
pred AS (SELECT * FROM (
  SELECT doc_id, n, k, start_, end_, label, canonical, score, detector FROM p0 WHERE (doc_id + k) % 4 = 0
  UNION ALL SELECT doc_id, n, k, least(start_ + 2, n), least(end_ + 2, n), label, canonical, score, detector FROM p0 WHERE (doc_id + k) % 4 = 1
  UNION ALL SELECT doc_id, n, k, start_, end_, label, canonical, score, detector FROM p2 WHERE (doc_id + k) % 4 = 2
  UNION ALL SELECT doc_id, n, k, start_, end_, label, canonical, score, detector FROM p3 WHERE (doc_id + k) % 4 = 3) WHERE end_ > start_)"""
_BOTH = f"{_GOLD},\n{_PRED}"


def _merged_sql(source: str, name: str, by: str = "doc_id") -> str:
    """Gaps and islands: overlapping or touching ranges of ``source`` by ``by``."""
    return f"""{name}_f AS (SELECT *, CASE WHEN start_ <= max(end_) OVER (PARTITION BY {by} ORDER BY start_, end_, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new_ FROM {source}),
{name}_g AS (SELECT *, sum(new_) OVER (PARTITION BY {by} ORDER BY start_, end_, k ROWS UNBOUNDED PRECEDING) AS grp FROM {name}_f),
{name} AS (SELECT {by}, grp, min(start_) AS start_, max(end_) AS end_ FROM {name}_g GROUP BY {by}, grp)"""


# --- detectors -------------------------------------------------------------------------------------------------------


def _values(df: DataFrame, spans: Column, id_: str = "doc_id") -> DataFrame:
    found = each(df, spans, "s", id_, "text").select(id_, T.cut(F.col("text"), F.col("s.start"), F.col("s.end")).alias("value"))
    return found.groupBy(id_, "value").agg(F.count(F.lit(1)).alias("n"))


def _pattern(name: str) -> tuple[Pattern, str]:
    for d in load_policy().detectors.values():
        for p in d.patterns():
            if p.name == name:
                return p, d.id
    raise KeyError(name)


def _detect(name: str):
    return lambda spark, d: _values(_documents(spark, d), D.find_pattern(F.col("text"), *_pattern(name)))


def _extracted(regex: str, group: str = "") -> str:
    return f"SELECT doc_id, value, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{regex}', 0{group})) AS value FROM documents) GROUP BY 1, 2"


def _words_like(regex: str) -> str:
    return rf"SELECT doc_id, value, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^\pL\pN_]+')) AS value FROM documents) WHERE regexp_full_match(value, '{regex}') GROUP BY 1, 2"


query("detect_email", _extracted(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", ", 'i'"))(_detect("email"))
query("detect_swift", _words_like("[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?"))(_detect("swift"))
query("detect_iban", _words_like(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}"))(_detect("iban"))
query("detect_vin", _words_like("[A-HJ-NPR-Z0-9]{17}"))(_detect("vehicle_vin"))
query("detect_api_key", _extracted("""(?i)\\b(?:api[_-]?key|secret|token|passwd|password)\\s*[:=]\\s*["'']?[A-Za-z0-9_-]{16,}"""))(_detect("generic_api_key"))
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
query(
    "detect_ipv4",
    rf"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9.]+(?:/[0-9]+[.]?)?')) AS run FROM documents),
v AS (SELECT doc_id, CASE WHEN regexp_full_match(run, '{_OCTET}(\.{_OCTET}){{3}}(/([0-9]|[12][0-9]|3[0-2]))?') THEN run
  WHEN regexp_full_match(split_part(run, '/', 1), '{_OCTET}(\.{_OCTET}){{3}}') THEN split_part(run, '/', 1) END AS value FROM r)
SELECT doc_id, value, count(*)::BIGINT AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2""",
)(_detect("ipv4_or_cidr"))


@query(
    "detect_urls_whole_pages",
    r"""WITH p AS (SELECT page_id, concat_ws(' ', url, html) AS t FROM pages),
h AS (SELECT page_id, unnest(regexp_extract_all(t, '(?i)\bhttps?://[^\s<>()"\x27]+')) AS value FROM p),
w AS (SELECT page_id, unnest(regexp_extract_all(t, '(?i)\bwww\.[^\s<>()"\x27]+')) AS value FROM p),
n AS (SELECT page_id, unnest(regexp_extract_all(t, '(?i)(^|[^@\pL\pN_])((?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:com|net|org|io|ai|ru|ua|by|kz|de|fr|uk|co|edu|gov|info|biz|me|app|dev|site|online|store|tech|cloud|xyz)(?:/[^\s<>()"\x27]*)?)', 2)) AS value FROM p)
SELECT page_id, pattern, value, count(*)::BIGINT AS n FROM (
  SELECT page_id, 'url_http' AS pattern, value FROM h UNION ALL SELECT page_id, 'url_www', value FROM w UNION ALL SELECT page_id, 'url_domain_tld', value FROM n) GROUP BY 1, 2, 3""",
)
def detect_urls_whole_pages(spark: SparkSession, d: str) -> DataFrame:
    """Matches of each URL pattern in the url and the whole html of every page."""
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.concat_ws(" ", "url", "html").alias("text"))

    def named(name: str) -> Column:
        return F.transform(D.find_pattern(F.col("text"), *_pattern(name)), lambda s: F.struct(F.lit(name).alias("pattern"), s["start"].alias("start"), s["end"].alias("end")))

    spans = F.flatten(F.array(*map(named, ("url_http", "url_www", "url_domain_tld"))))
    found = each(pages, spans, "s", "page_id", "text").select("page_id", "s.pattern", T.cut(F.col("text"), F.col("s.start"), F.col("s.end")).alias("value"))
    return found.groupBy("page_id", "pattern", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "detect_entropy_secret",
    r"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z0-9_\-/+=]{20,}\b')) AS value FROM documents),
e AS (SELECT doc_id, value, (SELECT -sum(p * log2(p)) FROM (SELECT count(*)::DOUBLE / length(value) AS p FROM (SELECT unnest(string_split(value, '')) AS ch) WHERE ch <> '' GROUP BY ch)) AS bits FROM (SELECT DISTINCT doc_id, value FROM c WHERE length(value) >= 24))
SELECT e.doc_id, e.value, (SELECT count(*) FROM c WHERE c.doc_id = e.doc_id AND c.value = e.value)::BIGINT AS n FROM e WHERE bits >= 3.7""",
)
def detect_entropy_secret(spark: SparkSession, d: str) -> DataFrame:
    return _values(_documents(spark, d), D.find_entropy(F.col("text"), {"min_length": 24, "entropy_threshold": 3.7, "score": 0.9}, "high_entropy_secret"))


def _bits(value: str) -> str:
    """SQL of the entropy of a text, in bits a character."""
    return f"(SELECT -sum(p * log2(p)) FROM (SELECT count(*)::DOUBLE / length({value}) AS p FROM (SELECT unnest(string_split({value}, '')) AS ch) WHERE ch <> '' GROUP BY ch))"


def _luhn(number: str) -> str:
    odd, even = f"{number}[length({number}) - i]::INT", f"({number}[length({number}) - i]::INT * 2) % 10 + ({number}[length({number}) - i]::INT * 2) // 10"
    return f"list_sum([CASE WHEN i % 2 = 0 THEN {odd} ELSE {even} END FOR i IN range(0, length({number}))]) % 10 = 0"


#: What the tables' texts hold, by plain patterns on texts without the keyed secrets; those are judged by what is in them.
_FOUND = rf"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
k AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '(?i)\b(?:api[_-]?key|secret|token|passwd|password)\s*[:=]\s*["'']?([A-Za-z0-9_-]{{16,}})', 1)) AS v FROM d),
r AS (SELECT doc_id, lang, regexp_replace(text, '(?i)\b(?:api[_-]?key|secret|token|passwd|password)\s*[:=]\s*["'']?[A-Za-z0-9_-]{{16,}}', ' ', 'g') AS text FROM d),
runs AS (SELECT *, regexp_extract_all(v, '[0-9]+') AS n FROM k),
keyed AS (SELECT *, len([x FOR x IN n IF length(x) BETWEEN 13 AND 19 AND len(list_distinct(string_split(x, ''))) > 1]) > 0 AS card, len([x FOR x IN n IF length(x) = 11 AND x[1] = '8']) > 0 AS phone,
  length(v) >= 24 AND {_bits("v")} >= 3.7 AS dense FROM runs),
x AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '[0-9](?:[ -]*[0-9])*')) AS v FROM r),
c AS (SELECT doc_id, lang, unnest(CASE WHEN regexp_matches(v, '[0-9]{{13}}') THEN regexp_extract_all(v, '[0-9]{{13,}}') ELSE [regexp_replace(v, '[ -]', '', 'g')] END) AS n FROM x),
o AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '\+[0-9](?:[ ().-]*[0-9]){{8,14}}')) AS v FROM r),
q AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS n FROM o),
i AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '[0-9.]+(?:/[0-9]+[.]?)?')) AS v FROM r),
found AS (
  SELECT lang, CASE WHEN card THEN 'ru_pii_regex:CREDIT_CARD' WHEN phone THEN 'ru_pii_regex:PHONE_NUMBER' WHEN dense THEN 'high_entropy_secret' ELSE 'code_secret_regex:API_KEY' END AS detector,
    CASE WHEN card THEN 'payment_card' WHEN phone THEN 'phone' ELSE 'secret' END AS canonical, CASE WHEN phone THEN 0.97 WHEN dense THEN 0.9 ELSE 0.84 END::DOUBLE AS score FROM keyed
  UNION ALL SELECT lang, 'en_pii_regex:SWIFT_CODE', 'identifier', 0.78 FROM (SELECT lang, unnest(regexp_split_to_array(text, '[^\pL\pN_]+')) AS v FROM r) WHERE regexp_full_match(v, '[A-Z]{{6}}[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?')
  UNION ALL SELECT lang, 'ru_pii_regex:EMAIL_ADDRESS', 'email', 0.96 FROM (SELECT lang, unnest(regexp_extract_all(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}')) AS v FROM r)
  UNION ALL SELECT lang, 'ip_address_lib', 'ip', 0.995 FROM i WHERE regexp_full_match(v, '{_OCTET}(\.{_OCTET}){{3}}(/([0-9]|[12][0-9]|3[0-2]))?')
  UNION ALL SELECT lang, 'phone_number_lib', 'phone', 0.92 FROM q WHERE regexp_full_match(n, '1[2-9][0-8][0-9][2-9][0-9]{{6}}|7[346789][0-9]{{9}}|380[3-9][0-9]{{8}}|44(1[0-9]{{8,9}}|[2379][0-9]{{9}}|5[56][0-9]{{8}}|8[0-9]{{8,9}})|49(15[0-9]{{9}}|1[67][0-9]{{8,9}}|[2-9][0-9]{{6,10}})|48[1-9][0-9]{{8}}')
  UNION ALL SELECT lang, 'ru_pii_regex:CREDIT_CARD', 'payment_card', CASE WHEN {_luhn("n")} THEN 0.83 ELSE 0.675 END FROM c WHERE length(n) BETWEEN 13 AND 19 AND len(list_distinct(string_split(n, ''))) > 1
  UNION ALL SELECT lang, 'high_entropy_secret', 'secret', 0.9 FROM (SELECT lang, unnest(regexp_extract_all(text, '\b[A-Za-z0-9_\-/+=]{{24,}}\b')) AS v FROM r) WHERE {_bits("v")} >= 3.7)"""


@query("span_counts_by_detector", f"{_FOUND}\nSELECT lang, detector, canonical, count(*)::BIGINT AS n, round(max(score), 6) AS max_score FROM found GROUP BY 1, 2, 3")
def span_counts_by_detector(spark: SparkSession, d: str) -> DataFrame:
    """The whole policy over documents: found spans per language, detector and canonical label."""
    found = each(D.detect(_documents(spark, d), load_policy()), "spans", "s", "lang")
    return found.groupBy("lang", F.col("s.detector").alias("detector"), F.col("s.canonical").alias("canonical")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("s.score"), 6).alias("max_score"))


@query(
    "card_luhn",
    """WITH c AS (SELECT o_orderkey, lpad((o_orderkey * 7919 + 4000000000000000)::VARCHAR, 16, '0') AS number FROM orders),
t AS (SELECT o_orderkey, number, list_sum([CASE WHEN i % 2 = 1 THEN number[17 - i]::INT ELSE (number[17 - i]::INT * 2) % 10 + (number[17 - i]::INT * 2) // 10 END FOR i IN range(1, 17)]) AS total FROM c)
SELECT total % 10 = 0 AS valid, count(*)::BIGINT AS n, min(number) AS first_number FROM t GROUP BY 1""",
)
def card_luhn(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.lpad((F.col("o_orderkey") * 7919 + F.lit(4000000000000000)).cast("string"), 16, "0").alias("number"))
    return orders.groupBy(T.luhn(F.col("number")).alias("valid")).agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("first_number"))


@query(
    "payment_card_signal_documents",
    rf"""WITH {_DOCS},
s AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w, unnest(g[1:len(w)]) AS g FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS w, regexp_split_to_array(text, '[0-9]+') AS g FROM docs)),
a AS (SELECT *, sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS e, CASE WHEN i > 1 AND regexp_full_match(g, '[ -]+') THEN 0 ELSE 1 END AS apart FROM s),
b AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM a),
r AS (SELECT doc_id, run, min(e - length(w)) AS s, max(e) AS e, sum(length(w)) AS n, max(length(w)) AS most FROM b GROUP BY 1, 2),
m AS (SELECT doc_id, s, e FROM r WHERE most < 13 AND n BETWEEN 13 AND 19 UNION ALL SELECT doc_id, b.e - length(w), b.e FROM b JOIN r USING (doc_id, run) WHERE most >= 13 AND length(w) BETWEEN 13 AND 19),
t AS (SELECT doc_id, s, e, substr(text, s::BIGINT + 1, (e - s)::BIGINT) AS v, regexp_replace(substr(text, s::BIGINT + 1, (e - s)::BIGINT), '[ -]', '', 'g') AS n,
  lower(substr(text, greatest(s - 32, 0)::BIGINT + 1, (e + 32 - greatest(s - 32, 0))::BIGINT)) AS near FROM m JOIN docs USING (doc_id)),
u AS (SELECT *, len(list_distinct(string_split(n, ''))) >= 2 AS keep, {_luhn("n")} AS valid, regexp_full_match(v, '([0-9]{{4}}[ -]){{2,4}}[0-9]{{1,4}}') AS grouped, {" OR ".join(f"contains(near, '{w}')" for w in T.CARD_WORDS)} AS context FROM t)
SELECT doc_id, s::INT AS start_, e::INT AS end_, keep, length(n)::INT AS digits_count, valid AS luhn_valid, grouped AS grouped_like_card, context AS has_context,
  CASE WHEN keep AND NOT grouped AND NOT valid AND NOT context THEN 0.9 ELSE 1.0 END::DOUBLE AS score_multiplier, CASE WHEN keep AND valid THEN 0.08 WHEN keep AND grouped AND context THEN 0.03 ELSE 0.0 END::DOUBLE AS score_bonus FROM u""",
)
def payment_card_signal_documents(spark: SparkSession, d: str) -> DataFrame:
    """The card signal of every ``bank_card`` match in documents."""
    found = each(_documents(spark, d), D.find_pattern(F.col("text"), *_pattern("bank_card")), "s", "doc_id", "text")
    signal = T.card_signal(F.col("text"), F.col("s.start"), F.col("s.end"))
    return found.select("doc_id", F.col("s.start").alias("start_"), F.col("s.end").alias("end_"), signal.alias("c")).select("doc_id", "start_", "end_", "c.*")


# --- labels and scalars ----------------------------------------------------------------------------------------------

@query(
    "severity_buckets",
    f"{_GOLD}\nSELECT CASE WHEN score >= 0.95 THEN 'critical' WHEN score >= 0.85 THEN 'high' WHEN score >= 0.65 THEN 'medium' ELSE 'low' END AS severity, count(*)::BIGINT AS n FROM gold GROUP BY 1",
)
def severity_buckets(spark: SparkSession, d: str) -> DataFrame:
    rows = each(_samples(spark, d), "gold", "s")
    return rows.groupBy(L.severity(F.col("s.score")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "script_profile",
    """WITH c AS (SELECT lang, length(regexp_replace(coalesce(text, ''), '[^А-Яа-яЁё]', '', 'g')) AS c, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS l FROM documents)
SELECT lang, CASE WHEN c + l = 0 THEN 'no_letters' WHEN c / (c + l) >= 0.7 THEN 'mostly_cyrillic' WHEN l / (c + l) >= 0.7 THEN 'mostly_latin' ELSE 'mixed' END AS profile, count(*)::BIGINT AS n FROM c GROUP BY 1, 2""",
)
def script_profile(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).groupBy("lang", T.script_profile(F.col("text")).alias("profile")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "text_hashes",
    "SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 12) AS hash FROM documents",
)
def text_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", T.short_hash(F.col("text")).alias("hash"))


@query(
    "usage_counts",
    "SELECT conv_id, count(*)::BIGINT AS items, sum(length(coalesce(text, '')))::BIGINT AS chars FROM conversations GROUP BY 1",
)
def usage_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("items"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


# --- span algebra ----------------------------------------------------------------------------------------------------

_FLAT = f"WITH RECURSIVE {_DOCS},\n{_derived_sql('a', 6, 0)},\n{_derived_sql('b', 6, 3)},\nall_ AS (SELECT *, 0 AS part FROM a UNION ALL SELECT doc_id, n, k + 6, start_, end_, label, canonical, score, detector, 1 FROM b)"


def _many() -> Column:
    return F.concat(_gold(6, 0), _gold(6, 3))


def _rows(df: DataFrame, spans: Column) -> DataFrame:
    s = each(df, spans, "s", "doc_id")
    return s.select("doc_id", F.col("s.start").alias("start_"), F.col("s.end").alias("end_"), F.col("s.canonical").alias("canonical"), F.round("s.score", 6).alias("score"))


@query(
    "dedupe_contained",
    f"""{_FLAT},
u AS (SELECT DISTINCT doc_id, start_, end_, canonical, score FROM all_),
w AS (SELECT * FROM u x WHERE NOT EXISTS (SELECT 1 FROM u y WHERE y.doc_id = x.doc_id AND y.canonical = x.canonical AND y.start_ <= x.start_ AND y.end_ >= x.end_
  AND (y.score > x.score OR y.score = x.score AND (y.start_ < x.start_ OR y.start_ = x.start_ AND y.end_ > x.end_))))
SELECT doc_id, start_::INT AS start_, end_::INT AS end_, canonical, score FROM w""",
)
def dedupe_contained(spark: SparkSession, d: str) -> DataFrame:
    return _rows(_documents(spark, d), A.drop_contained(_many()))


@query(
    "union_merge",
    f"""{_FLAT},
valid AS (SELECT * FROM all_ WHERE end_ > start_),
{_merged_sql("valid", "m")},
ranked AS (SELECT g.*, row_number() OVER (PARTITION BY doc_id, grp ORDER BY coalesce({ {k: v for k, v in A.NORMALIZER_RANK.items()} !r}[canonical], 70) DESC, score DESC, end_ - start_ DESC, start_) AS r FROM m_g g)
SELECT m.doc_id, m.start_::INT AS start_, m.end_::INT AS end_, r.canonical, s.score FROM m JOIN ranked r ON r.doc_id = m.doc_id AND r.grp = m.grp AND r.r = 1
JOIN (SELECT doc_id, grp, max(score) AS score FROM m_g GROUP BY 1, 2) s ON s.doc_id = m.doc_id AND s.grp = m.grp""".replace("{'", "MAP {'"),
)
def union_merge(spark: SparkSession, d: str) -> DataFrame:
    return _rows(_documents(spark, d), A.union_merge(_many(), A.NORMALIZER_RANK, A.NORMALIZER_DEFAULT))


@query(
    "range_intersection",
    f"""{_BOTH},
{_merged_sql("gold", "mg")},
{_merged_sql("pred", "mp")}
SELECT d.doc_id, coalesce(sum(greatest(0, least(a.end_, b.end_) - greatest(a.start_, b.start_))), 0)::BIGINT AS common
FROM docs d LEFT JOIN mg a ON a.doc_id = d.doc_id LEFT JOIN mp b ON b.doc_id = d.doc_id GROUP BY 1""",
)
def range_intersection(spark: SparkSession, d: str) -> DataFrame:
    common = A.intersection_length(A.merge_ranges(F.col("gold")), A.merge_ranges(F.col("predicted")))
    return _samples(spark, d).select("doc_id", common.cast("long").alias("common"))


_TOKENS = r"""toks AS (SELECT doc_id, i, sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS te, length(w) AS l FROM (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w, unnest(g[1:len(w)]) AS g FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w, regexp_split_to_array(text, '\S+') AS g FROM docs)))"""


@query(
    "token_overlap",
    f"""{_GOLD},
{_TOKENS}
SELECT d.doc_id, count(DISTINCT t.i)::BIGINT AS touched FROM docs d LEFT JOIN (SELECT t.doc_id, t.i FROM toks t JOIN gold g ON g.doc_id = t.doc_id AND t.te - t.l < g.end_ AND g.start_ < t.te) t USING (doc_id) GROUP BY 1""",
)
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    hit = A.token_ranges(F.col("text"), A.merge_ranges(F.col("gold")))
    return _samples(spark, d).select("doc_id", A.ranges_length(hit).cast("long").alias("touched"))


@query(
    "chunk_windows",
    f"""WITH {_DOCS},
{_TOKENS},
nt AS (SELECT d.doc_id, d.n, count(t.i) AS m FROM docs d LEFT JOIN toks t USING (doc_id) GROUP BY 1, 2),
w AS (SELECT doc_id, n, m, unnest(range(0, CASE WHEN m <= 128 THEN 1 ELSE ceil((m - 128) / 112)::BIGINT + 1 END)) AS k FROM nt WHERE m > 0),
b AS (SELECT w.doc_id, w.n, k, a.te - a.l AS s, z.te AS e FROM w JOIN toks a ON a.doc_id = w.doc_id AND a.i = k * 112 + 1 JOIN toks z ON z.doc_id = w.doc_id AND z.i = least(k * 112 + 128, m)),
gaps AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY k), 0) AS s, s AS e FROM b),
tail AS (SELECT doc_id, max(e) AS s, any_value(n) AS e FROM b GROUP BY 1)
SELECT doc_id, s::INT AS start_, e::INT AS end_ FROM b UNION ALL SELECT doc_id, s::INT, e::INT FROM gaps WHERE e > s UNION ALL SELECT doc_id, s::INT, e::INT FROM tail WHERE e > s
UNION ALL SELECT doc_id, 0, n::INT FROM nt WHERE m = 0""",
)
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = each(_documents(spark, d), A.chunk_windows(F.col("text"), 128, 16), "w", "doc_id")
    return rows.select("doc_id", F.col("w.start").alias("start_"), F.col("w.end").alias("end_"))


@query(
    "window_merge",
    f"""WITH {_DOCS},
p AS (SELECT doc_id, w * 20 + j * 7 AS s, w * 20 + j * 7 + 5 AS e, 'L' || (j % 2) AS label, (((doc_id + w * 3 + j * 5) % 40) + 60)::DOUBLE / 100 AS score
  FROM docs, (SELECT unnest(range(0, 3)) AS w), (SELECT unnest(range(0, 4)) AS j) WHERE j * 7 + 5 <= 30)
SELECT doc_id, s::INT AS start_, e::INT AS end_, label, max(score) AS score FROM p GROUP BY 1, 2, 3, 4""",
)
def window_merge(spark: SparkSession, d: str) -> DataFrame:
    three, four = F.sequence(F.lit(0), F.lit(2)), F.sequence(F.lit(0), F.lit(3))
    windows = F.transform(three, lambda w: F.struct((w * 20).alias("start"), (w * 20 + 30).alias("end")))

    def of(w: Column) -> Column:
        score = lambda j: (F.pmod(F.col("doc_id") + w * 3 + j * 5, F.lit(40)) + 60).cast("double") / 100
        return F.transform(four, lambda j: F.struct((j * 7).alias("start"), (j * 7 + 5).alias("end"), F.concat(F.lit("L"), (j % 2).cast("string")).alias("label"), score(j).alias("score")))

    rows = each(_documents(spark, d), P.merge_windows(windows, F.transform(three, of)), "p", "doc_id")
    return rows.select("doc_id", F.col("p.start").alias("start_"), F.col("p.end").alias("end_"), F.col("p.label").alias("label"), F.col("p.score").alias("score"))


# --- masking ---------------------------------------------------------------------------------------------------------

_MASKED = f"""{_GOLD},
{_merged_sql("gold", "m")},
o AS (SELECT m.doc_id, m.start_, m.end_, substr(d.text, (m.start_ + 1)::BIGINT, (m.end_ - m.start_)::BIGINT) AS original, coalesce(lag(m.end_) OVER (PARTITION BY m.doc_id ORDER BY m.start_), 0) AS prev
  FROM m JOIN docs d USING (doc_id)),
q AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY last_ DESC) AS number FROM (SELECT *, max(start_) OVER (PARTITION BY doc_id, original) AS last_ FROM o)),
p AS (SELECT *, '<GR00:' || lpad(number::VARCHAR, 4, '0') || '>' AS ph FROM q),
masked AS (SELECT d.doc_id, any_value(d.text) AS text, coalesce(string_agg(substr(d.text, (prev + 1)::BIGINT, (start_ - prev)::BIGINT) || ph, '' ORDER BY start_), '') || substr(any_value(d.text), (coalesce(max(end_), 0) + 1)::BIGINT) AS masked,
  count(DISTINCT ph)::BIGINT AS placeholders FROM docs d LEFT JOIN p USING (doc_id) GROUP BY 1)"""


def _masked(spark: SparkSession, d: str) -> DataFrame:
    df = _samples(spark, d).withColumn("merged", D.mask_groups(F.col("gold")))
    return df.withColumn("m", M.mask(F.col("text"), F.col("merged"), F.lit("GR00")))


@query("mask_documents", f"{_MASKED}\nSELECT doc_id, md5(masked) AS hash, length(masked)::BIGINT AS chars, placeholders FROM masked")
def mask_documents(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("m.text")
    return _masked(spark, d).select("doc_id", F.md5(text.cast("binary")).alias("hash"), F.length(text).cast("long").alias("chars"), F.size("m.placeholders").cast("long").alias("placeholders"))


@query("mask_unmask_roundtrip", f"{_MASKED}\nSELECT doc_id, md5(text) AS hash, (SELECT count(*) FROM p WHERE p.doc_id = masked.doc_id)::BIGINT AS replaced FROM masked")
def mask_unmask_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    back = _masked(spark, d).select("doc_id", M.unmask(F.col("m.text"), F.col("m.placeholders")).alias("u"))
    return back.select("doc_id", F.md5(F.col("u.text").cast("binary")).alias("hash"), F.col("u.replaced").cast("long").alias("replaced"))


@query(
    "policy_actions",
    f"""{_GOLD},
c AS (SELECT d.doc_id, count(g.k) AS f FROM docs d LEFT JOIN gold g USING (doc_id) WHERE d.doc_id % 3 <> 0 OR g.k IS NOT NULL GROUP BY 1)
SELECT mode, CASE WHEN f > 0 THEN 'FLAGGED' ELSE 'NONE' END AS detect_, CASE WHEN mode = 'block' AND f > 0 THEN 'BLOCKED' WHEN mode <> 'passthrough' AND f > 0 THEN 'MASKED' ELSE 'NONE' END AS deidentify, count(*)::BIGINT AS n
FROM c, (VALUES ('mask'), ('block'), ('passthrough')) m(mode) GROUP BY 1, 2, 3""",
)
def policy_actions(spark: SparkSession, d: str) -> DataFrame:
    df = _samples(spark, d).withColumn("mode", F.explode(F.array(F.lit("mask"), F.lit("block"), F.lit("passthrough"))))
    n = F.size("gold")
    kept = F.when(F.col("mode") == "passthrough", 0).otherwise(n)
    return df.groupBy("mode", M.detect_action(n).alias("detect_"), M.deidentify_action(F.col("mode"), kept, kept).alias("deidentify")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "findings",
    f"""{_GOLD}
SELECT detector AS check_id, canonical AS category, CASE WHEN score >= 0.95 THEN 'critical' WHEN score >= 0.85 THEN 'high' WHEN score >= 0.65 THEN 'medium' ELSE 'low' END AS severity,
  count(*)::BIGINT AS n, sum(length(substr(text, (start_ + 1)::BIGINT, (end_ - start_)::BIGINT)))::BIGINT AS chars FROM gold JOIN docs USING (doc_id) GROUP BY 1, 2, 3""",
)
def findings(spark: SparkSession, d: str) -> DataFrame:
    f = each(_samples(spark, d), M.findings(F.col("text"), F.col("gold"), F.col("sample_id"), full=True), "f")
    return f.groupBy("f.check_id", "f.category", "f.severity").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.col("f.spans")[0]["snippet"])).alias("chars"))


@query(
    "session_join",
    """SELECT CASE WHEN conv_id % 3 = 0 THEN 'BLOCKED' WHEN conv_id % 3 = 1 THEN 'MASKED' ELSE 'NONE' END AS action, count(*)::BIGINT AS n,
  sum(CASE WHEN conv_id % 3 = 1 THEN 2 ELSE 0 END)::BIGINT AS replacements, sum(length(coalesce(text, '')) + CASE WHEN conv_id % 3 = 1 THEN 22 ELSE 28 END)::BIGINT AS chars FROM conversations GROUP BY 1""",
)
def session_join(spark: SparkSession, d: str) -> DataFrame:
    items = chats.turns_as_items(spark.read.parquet(f"{d}/conversations.parquet"))
    conv = F.col("session_id").cast("long")
    items = items.withColumn("text", F.concat("text", F.lit("<GR0C:0001><GR0C:0001>"), F.lit("......")))
    one = F.array(F.struct(F.lit("<GR0C:0001>").alias("placeholder"), F.lit("secret!!").alias("original")))
    none = F.array().cast(M.PLACEHOLDERS)
    sessions = items.select("session_id").distinct().where(conv % 3 != 0).withColumn("placeholders", F.when(conv % 3 == 1, one).otherwise(none))
    out = M.unmask_items(items, sessions)
    return out.groupBy(M.reidentify_action(F.col("context_found"), F.col("replacements")).alias("action")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("replacements").alias("replacements"), F.sum(F.length("text")).alias("chars")
    )


# --- quality ---------------------------------------------------------------------------------------------------------


def _family(name: str):
    return lambda spark, d: E.with_ratios(E.evaluate(_samples(spark, d), families=[name], per_label=False)).drop("label")


def _ratios_sql(tp: str, fp: str, fn: str, extra: str = "") -> str:
    p, r = f"(CASE WHEN {tp} + {fp} > 0 THEN {tp}::DOUBLE / ({tp} + {fp}) ELSE 0 END)", f"(CASE WHEN {tp} + {fn} > 0 THEN {tp}::DOUBLE / ({tp} + {fn}) ELSE 0 END)"
    return f"{extra}{tp}::BIGINT AS tp, {fp}::BIGINT AS fp, {fn}::BIGINT AS fn, round({p}, 6) AS precision, round({r}, 6) AS recall, round(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END, 6) AS f1, round(1 - {r}, 6) AS residual_miss_ratio"


_EXACT = f"""{_BOTH},
gc AS (SELECT doc_id, start_, end_, canonical, count(*) AS c FROM gold GROUP BY ALL), pc AS (SELECT doc_id, start_, end_, canonical, count(*) AS c FROM pred GROUP BY ALL),
t AS (SELECT (SELECT coalesce(sum(least(a.c, b.c)), 0) FROM gc a JOIN pc b USING (doc_id, start_, end_, canonical)) AS tp, (SELECT count(*) FROM pred) AS np, (SELECT count(*) FROM gold) AS ng)"""
query("exact_match", f"{_EXACT}\nSELECT {_ratios_sql('tp', '(np - tp)', '(ng - tp)', chr(39) + 'exact_canonical' + chr(39) + ' AS family, ')} FROM t")(_family("exact_canonical"))

_GREEDY = f"""{_BOTH},
go AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS o FROM gold), po AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS o FROM pred),
st AS (SELECT doc_id, 0::BIGINT AS i, []::BIGINT[] AS used FROM docs
  UNION ALL
  SELECT doc_id, i, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END FROM (
    SELECT st.doc_id, po.o AS i, st.used, min(g.o) FILTER (NOT list_contains(st.used, g.o)) AS pick
    FROM st JOIN po ON po.doc_id = st.doc_id AND po.o = st.i + 1
    LEFT JOIN go g ON g.doc_id = st.doc_id AND g.canonical = po.canonical AND po.start_ < g.end_ AND g.start_ < po.end_ GROUP BY 1, 2, 3)),
t AS (SELECT sum(len(used)) AS tp, (SELECT count(*) FROM pred) AS np, (SELECT count(*) FROM gold) AS ng FROM (SELECT doc_id, arg_max(used, i) AS used FROM st GROUP BY 1))"""
query("overlap_match", f"{_GREEDY}\nSELECT {_ratios_sql('tp', '(np - tp)', '(ng - tp)', chr(39) + 'overlap_canonical' + chr(39) + ' AS family, ')} FROM t")(_family("overlap_canonical"))

_CHAR = f"""{_BOTH},
{_merged_sql("gold", "mg")},
{_merged_sql("pred", "mp")},
t AS (SELECT (SELECT coalesce(sum(greatest(0, least(a.end_, b.end_) - greatest(a.start_, b.start_))), 0) FROM mg a JOIN mp b USING (doc_id)) AS tp, (SELECT sum(end_ - start_) FROM mp) AS np, (SELECT sum(end_ - start_) FROM mg) AS ng)"""
query("char_metrics", f"{_CHAR}\nSELECT {_ratios_sql('tp', '(np - tp)', '(ng - tp)', chr(39) + 'char_canonical' + chr(39) + ' AS family, ')} FROM t")(_family("char_canonical"))

_TOKEN = f"""{_BOTH},
{_TOKENS},
tg AS (SELECT DISTINCT t.doc_id, t.i FROM toks t JOIN gold g ON g.doc_id = t.doc_id AND t.te - t.l < g.end_ AND g.start_ < t.te),
tp_ AS (SELECT DISTINCT t.doc_id, t.i FROM toks t JOIN pred g ON g.doc_id = t.doc_id AND t.te - t.l < g.end_ AND g.start_ < t.te),
t AS (SELECT (SELECT count(*) FROM tg JOIN tp_ USING (doc_id, i)) AS tp, (SELECT count(*) FROM tp_) AS np, (SELECT count(*) FROM tg) AS ng)"""
query("token_metrics", f"{_TOKEN}\nSELECT {_ratios_sql('tp', '(np - tp)', '(ng - tp)', chr(39) + 'token_canonical' + chr(39) + ' AS family, ')} FROM t")(_family("token_canonical"))

_PER_LABEL = f"""{_BOTH},
{_merged_sql("gold", "mg", "doc_id, canonical")},
{_merged_sql("pred", "mp", "doc_id, canonical")},
pl AS (SELECT canonical AS label, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp, coalesce(ng, 0) - coalesce(tp, 0) AS fn FROM
  (SELECT canonical, sum(end_ - start_) AS ng FROM mg GROUP BY 1) FULL JOIN (SELECT canonical, sum(end_ - start_) AS np FROM mp GROUP BY 1) USING (canonical)
  LEFT JOIN (SELECT canonical, sum(greatest(0, least(a.end_, b.end_) - greatest(a.start_, b.start_))) AS tp FROM mg a JOIN mp b USING (doc_id, canonical) GROUP BY 1) USING (canonical))"""


def _label_chars(spark: SparkSession, d: str) -> DataFrame:
    return E.evaluate(_samples(spark, d), families=[], per_label=True).where("family = 'label_char'").select("label", "tp", "fp", "fn")


query("label_char_metrics", f"{_PER_LABEL}\nSELECT {_ratios_sql('tp', 'fp', 'fn', 'label, ')} FROM pl")(lambda s, d: E.with_ratios(_label_chars(s, d)))

_MEANS = "SELECT round(coalesce(avg(p), 0), 6) AS precision, round(coalesce(avg(r), 0), 6) AS recall, round(coalesce(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 0), 6) AS f1, count(*)::BIGINT AS labels_included"
query(
    "macro_labels",
    f"{_PER_LABEL}\n{_MEANS} FROM (SELECT CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p, tp::DOUBLE / (tp + fn) AS r FROM pl WHERE tp + fn > 0)",
)(lambda s, d: E.macro(_label_chars(s, d)))
query(
    "risk_weighted_recall",
    f"{_PER_LABEL}\nSELECT round(sum(w * r) / sum(w), 6) AS value, count(*)::BIGINT AS labels_included, sum(w) AS total_weight FROM (SELECT w, tp::DOUBLE / (tp + fn) AS r FROM pl JOIN (VALUES "
    + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in L.RISK_WEIGHTS.items())
    + ") t(label, w) USING (label) WHERE tp + fn > 0)",
)(lambda s, d: E.risk_weighted_recall(_label_chars(s, d)))


@query(
    "policy_confusion",
    """WITH b AS (SELECT toxic = 1 AS g, doc_id % 7 < 2 OR (toxic = 1 AND doc_id % 2 = 0) AS p FROM labels),
c AS (SELECT count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (NOT g AND NOT p) AS tn, count(*) FILTER (g AND NOT p) AS fn FROM b),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS r FROM c)
SELECT tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1,
  round(CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) ELSE 0 END, 6) AS false_positive_rate, round(CASE WHEN fn + tp > 0 THEN fn::DOUBLE / (fn + tp) ELSE 0 END, 6) AS false_negative_rate FROM r""",
)
def policy_confusion(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.read.parquet(f"{d}/labels.parquet")
    gold = F.col("toxic") == 1
    return E.confusion(labels, gold, (F.col("doc_id") % 7 < 2) | (gold & (F.col("doc_id") % 2 == 0)))


_PRED_MASKED = _MASKED.replace(_GOLD, _BOTH).replace(_merged_sql("gold", "m"), _merged_sql("pred", "m"))


@query(
    "mask_leakage",
    f"""{_PRED_MASKED},
x AS (SELECT substr(d.text, (g.start_ + 1)::BIGINT, (g.end_ - g.start_)::BIGINT) AS v, m.masked FROM gold g JOIN docs d USING (doc_id) JOIN masked m USING (doc_id))
SELECT count(*)::BIGINT AS total_gold_spans, count(*) FILTER (v <> '' AND contains(masked, v))::BIGINT AS leaked_gold_spans, round(count(*) FILTER (v <> '' AND contains(masked, v))::DOUBLE / count(*), 6) AS leakage_fraction FROM x""",
)
def mask_leakage(spark: SparkSession, d: str) -> DataFrame:
    df = _samples(spark, d).withColumn("merged", D.mask_groups(F.col("predicted")))
    return E.leakage(df.withColumn("masked", M.mask(F.col("text"), F.col("merged"), F.lit("GR00"))["text"]))


@query(
    "slices",
    f"""{_BOTH},
{_merged_sql("gold", "mg")},
{_merged_sql("pred", "mp")},
x AS (SELECT doc_id, coalesce(sum(greatest(0, least(a.end_, b.end_) - greatest(a.start_, b.start_))), 0) AS tp FROM mg a JOIN mp b USING (doc_id) GROUP BY 1),
z AS (SELECT d.doc_id, CASE WHEN a + b = 0 THEN 'no_letters' WHEN a / (a + b) >= 0.7 THEN 'mostly_cyrillic' WHEN b / (a + b) >= 0.7 THEN 'mostly_latin' ELSE 'mixed' END AS script, CASE doc_id % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'json' END AS format,
  CASE WHEN n < 1000 THEN '1k' WHEN n < 10000 THEN '10k' ELSE '100k' END AS bucket, ['head', 'middle', 'tail', 'spread'][doc_id % 4 + 1] AS placement, CASE WHEN doc_id % 5 > 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END END AS noisy,
  (SELECT count(*) FROM gold g WHERE g.doc_id = d.doc_id) AS entities
  FROM (SELECT *, length(regexp_replace(text, '[^А-Яа-яЁё]', '', 'g')) AS a, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS b FROM docs) d),
y AS (SELECT d.doc_id, d.lang, d.source, coalesce(x.tp, 0) AS tp, coalesce(p.c, 0) AS np, coalesce(g.c, 0) AS ng FROM docs d LEFT JOIN x USING (doc_id)
  LEFT JOIN (SELECT doc_id, sum(end_ - start_) AS c FROM mp GROUP BY 1) p USING (doc_id) LEFT JOIN (SELECT doc_id, sum(end_ - start_) AS c FROM mg GROUP BY 1) g USING (doc_id))
SELECT slice, coalesce(value, 'unknown') AS value, count(*)::BIGINT AS samples, sum(tp)::BIGINT AS tp, sum(np - tp)::BIGINT AS fp, sum(ng - tp)::BIGINT AS fn FROM (
  SELECT unnest(['language', 'script_profile', 'format', 'length_bucket', 'placement_profile', 'noisy', 'source', 'entity_count']) AS slice, unnest([lang, script, format, bucket, placement, noisy, source, entities::VARCHAR]) AS value, tp, np, ng
  FROM y JOIN z USING (doc_id)) GROUP BY 1, 2""",
)
def slices(spark: SparkSession, d: str) -> DataFrame:
    """All eight keys; some are null in some rows."""
    doc, n = F.col("doc_id"), F.col("n")
    rows = _samples(spark, d).withColumns({
        "language": F.col("lang"), "script_profile": T.script_profile(F.col("text")), "format": F.when(doc % 3 == 0, "plain").when(doc % 3 == 1, "json"), "noisy": F.when(doc % 5 > 0, doc % 2 == 0),
        "length_bucket": F.when(n < 1000, "1k").when(n < 10_000, "10k").otherwise("100k"), "placement_profile": F.get(F.array(*map(F.lit, N.PROFILES)), (doc % 4).cast("int")), "entity_count": F.size("gold"),
    })
    keys = ["language", "script_profile", "format", "length_bucket", "placement_profile", "noisy", "source", "entity_count"]
    return E.slices(rows, keys, ["char_canonical"]).select("slice", "value", "samples", "tp", "fp", "fn")


@query(
    "detector_breakdown",
    f"""{_EXACT.split("t AS (SELECT")[0].rstrip().rstrip(",")},
dc AS (SELECT detector, doc_id, start_, end_, canonical, count(*) AS c FROM pred GROUP BY ALL),
n AS (SELECT detector, sum(c) AS np FROM dc GROUP BY 1),
h AS (SELECT detector, sum(least(a.c, b.c)) AS tp FROM gc a JOIN dc b USING (doc_id, start_, end_, canonical) GROUP BY 1)
SELECT detector, coalesce(tp, 0)::BIGINT AS tp, (np - coalesce(tp, 0))::BIGINT AS fp, ((SELECT count(*) FROM gold) - coalesce(tp, 0))::BIGINT AS fn FROM n LEFT JOIN h USING (detector)""",
)
def detector_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return E.detectors(_samples(spark, d), ["exact_canonical"]).select("detector", "tp", "fp", "fn")


@query("unscored", f"{_BOTH}\nSELECT canonical AS label, count(*)::BIGINT AS n FROM pred WHERE canonical NOT IN ('email', 'phone', 'secret') GROUP BY 1")
def unscored(spark: SparkSession, d: str) -> DataFrame:
    return E.unscored(_samples(spark, d), F.array(F.lit("email"), F.lit("phone"), F.lit("secret")))


@query(
    "fp_audit",
    f"""{_BOTH}
SELECT canonical AS label, count(*)::BIGINT AS n, sum(start_)::BIGINT AS starts FROM pred p WHERE NOT EXISTS
(SELECT 1 FROM gold g WHERE g.doc_id = p.doc_id AND g.canonical = p.canonical AND p.start_ < g.end_ AND g.start_ < p.end_) GROUP BY 1""",
)
def fp_audit(spark: SparkSession, d: str) -> DataFrame:
    return E.false_positives(_samples(spark, d)).groupBy(F.col("canonical").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"))


@query("merge_reports", f"{_PER_LABEL}\nSELECT {_ratios_sql('(2 * tp)', '(2 * fp)', '(2 * fn)', 'label, ')} FROM pl")
def merge_reports(spark: SparkSession, d: str) -> DataFrame:
    one = _label_chars(spark, d).withColumn("family", F.lit("label_char"))
    return E.merge_reports([one, one]).drop("family")


# --- samples ---------------------------------------------------------------------------------------------------------


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    labels = F.when(F.pmod("doc_id", F.lit(4)) == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("l"), F.pmod("doc_id", F.lit(5)).cast("string")), F.concat(F.lit("m"), F.pmod("doc_id", F.lit(3)).cast("string"))))
    return _documents(spark, d).withColumn("labels", labels).withColumn("entity_count", F.size("labels")).withColumn("language", F.col("lang"))


_LAB = f"WITH {_DOCS},\nlb AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 2 END AS entity_count, CASE WHEN doc_id % 4 <> 0 THEN 'l' || (doc_id % 5) END AS owner, md5('7:' || sample_id) AS sk FROM docs)"


def _balanced_sql(rows: str, m: int, where: str = "true") -> str:
    """Rows as ``r`` with ``rest``: 0 for those that the labels take, one label after the other."""
    return f"""{_LAB.replace("WITH ", "WITH RECURSIVE ", 1)},
cand AS (SELECT sample_id, sk, unnest(['l' || (doc_id % 5), 'm' || (doc_id % 3)]) AS label FROM lb WHERE entity_count > 0 AND {where}),
names AS (SELECT label, row_number() OVER (ORDER BY label) AS li FROM (SELECT DISTINCT label FROM cand)),
c AS (SELECT cand.*, li FROM cand JOIN names USING (label)),
st AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS used
  UNION ALL
  SELECT i + 1, list_concat(used, list(sample_id)) FROM (SELECT st.i, st.used, c.sample_id, row_number() OVER (ORDER BY c.sk, c.sample_id) AS nth FROM st JOIN c ON c.li = st.i + 1 AND NOT list_contains(st.used, c.sample_id)) WHERE nth <= {m} GROUP BY i, used),
picks AS (SELECT unnest(arg_max(used, i)) AS sample_id FROM st),
r AS (SELECT *, CASE WHEN sample_id IN (SELECT sample_id FROM picks) THEN 0 ELSE 1 END AS rest FROM {rows} WHERE {where})"""




@query(
    "subset_filters",
    f"{_LAB}\nSELECT 'negatives' AS subset, count(*)::BIGINT AS n FROM lb WHERE entity_count = 0 UNION ALL SELECT 'positives', count(*)::BIGINT FROM lb WHERE entity_count > 0 UNION ALL SELECT 'language=fr', count(*)::BIGINT FROM lb WHERE lang = 'fr'",
)
def subset_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d)
    parts = [S.subset(rows, x).agg(F.count(F.lit(1)).alias("n")).select(F.lit(x).alias("subset"), "n") for x in ("negatives", "positives", "language=fr")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("random_sample", f"{_LAB}\nSELECT sample_id FROM lb ORDER BY sk, sample_id LIMIT 50")
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.random_sample(_labelled(spark, d), 50, 7).select("sample_id")


@query("label_balanced", f"{_balanced_sql('lb', 6)}\nSELECT sample_id FROM r ORDER BY rest, sk, sample_id LIMIT 60")
def label_balanced(spark: SparkSession, d: str) -> DataFrame:
    return S.label_balanced(_labelled(spark, d), 60, 7, 6).select("sample_id")


@query(
    "rebalance_quota",
    f"{_balanced_sql('lb', 10, 'entity_count > 0')}\n(SELECT sample_id, 'negative' AS kind FROM lb WHERE entity_count = 0 ORDER BY sk, sample_id LIMIT 20) UNION ALL (SELECT sample_id, 'positive' FROM r ORDER BY rest, sk, sample_id LIMIT 80)",
)
def rebalance_quota(spark: SparkSession, d: str) -> DataFrame:
    out = S.rebalance(_labelled(spark, d), 100, 0.2, 7)
    return out.select("sample_id", F.when(F.col("entity_count") == 0, "negative").otherwise("positive").alias("kind"))


@query(
    "label_counts",
    f"{_LAB}\nSELECT label, count(*)::BIGINT AS n FROM (SELECT NULL AS label FROM lb WHERE entity_count = 0 UNION ALL SELECT owner FROM lb WHERE entity_count > 0 UNION ALL SELECT 'm' || (doc_id % 3) FROM lb WHERE entity_count > 0) GROUP BY 1",
)
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.label_counts(_labelled(spark, d))


# --- generators ------------------------------------------------------------------------------------------------------


@query(
    "pad_offsets",
    f"{_GOLD},\nm AS (SELECT doc_id, greatest(5000 - n, 0) AS missing FROM docs)\nSELECT p AS placement, count(*)::BIGINT AS n, sum(start_ + CASE p WHEN 'head' THEN 0 WHEN 'middle' THEN missing // 2 ELSE missing END)::BIGINT AS starts FROM gold JOIN m USING (doc_id), (VALUES ('head'), ('middle'), ('tail')) t(p) GROUP BY 1",
)
def pad_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = _samples(spark, d)
    parts = []
    for p in ("head", "middle", "tail"):
        s = each(rows, N.padded(F.col("text"), F.col("gold"), p, 5000)["spans"], "s")
        parts.append(s.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s.start").cast("long")).alias("starts")).select(F.lit(p).alias("placement"), "n", "starts"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "concat_offsets",
    f"""{_GOLD},
o AS (SELECT doc_id, doc_id // 10 AS grp, coalesce(sum(n + 2) OVER (PARTITION BY doc_id // 10 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, n FROM docs),
s AS (SELECT grp, count(*) AS n, sum(start_ + before) AS starts FROM gold JOIN o USING (doc_id) GROUP BY 1)
SELECT o.grp, (sum(o.n) + 2 * (count(*) - 1))::BIGINT AS chars, coalesce(any_value(s.n), 0)::BIGINT AS n, coalesce(any_value(s.starts), 0)::BIGINT AS starts FROM o LEFT JOIN s USING (grp) GROUP BY 1""",
)
def concat_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = _samples(spark, d).select("doc_id", F.expr("doc_id div 10").alias("grp"), "text", F.col("gold").alias("spans"))
    out = N.concatenated(rows, "grp", "doc_id")
    starts = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["start"])
    return out.select("grp", F.length("text").cast("long").alias("chars"), F.size("spans").cast("long").alias("n"), starts.alias("starts"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    profile = F.get(F.array(*map(F.lit, N.PROFILES)), F.pmod("doc_id", F.lit(4)).cast("int"))
    return _samples(spark, d).select(profile.alias("placement_profile"), F.col("n").alias("length_chars"), F.col("gold").alias("spans"))


_PLACED = f"{_GOLD},\npl AS (SELECT ['head', 'middle', 'tail', 'spread'][(doc_id % 4) + 1] AS placement_profile, start_::DOUBLE / greatest(n, 1) AS place FROM gold)"


@query(
    "placement_audit",
    f"{_PLACED}\nSELECT placement_profile, count(*)::BIGINT AS spans, count(*) FILTER (CASE placement_profile WHEN 'head' THEN place > 0.25 WHEN 'tail' THEN place < 0.75 WHEN 'middle' THEN abs(place - 0.5) > 0.25 ELSE false END)::BIGINT AS violations FROM pl GROUP BY 1",
)
def placement_audit(spark: SparkSession, d: str) -> DataFrame:
    return N.placement_audit(_placed(spark, d))


@query("placement_deciles", f"{_PLACED}\nSELECT placement_profile, least(floor(place * 10), 9)::INT AS decile, count(*)::BIGINT AS n FROM pl GROUP BY 1, 2")
def placement_deciles(spark: SparkSession, d: str) -> DataFrame:
    return N.placement_deciles(_placed(spark, d))


@query("boundary_effects", f"{_GOLD}\nSELECT CASE WHEN start_ < 100 AND end_ > 100 THEN 'across' WHEN end_ <= 100 THEN 'before' ELSE 'after' END AS side, count(*)::BIGINT AS n, sum(end_ - start_)::BIGINT AS chars FROM gold GROUP BY 1")
def boundary_effects(spark: SparkSession, d: str) -> DataFrame:
    return N.boundary_effects(_samples(spark, d).select(F.col("gold").alias("spans")), 100)


# --- chats -----------------------------------------------------------------------------------------------------------


@query(
    "chat_flatten",
    "SELECT conv_id::VARCHAR AS session_id, count(*)::BIGINT AS messages, md5(string_agg(role || ':' || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text)) AS hash FROM conversations GROUP BY 1",
)
def chat_flatten(spark: SparkSession, d: str) -> DataFrame:
    nested = chats.nest_messages(chats.turns_as_items(spark.read.parquet(f"{d}/conversations.parquet")))
    payloads = nested.select("session_id", F.to_json(F.struct("messages")).alias("payload"))
    items = chats.flatten_messages(payloads)
    back = chats.nest_messages(items)
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"], F.lit("\n"))), "")
    return back.select("session_id", F.size("messages").cast("long").alias("messages"), F.md5(said.cast("binary")).alias("hash"))


@query(
    "mask_sessions",
    "SELECT conv_id::VARCHAR AS session_id, count(*)::BIGINT AS items, count(*)::BIGINT AS placeholders, bool_and(true) AS restored FROM conversations GROUP BY 1",
)
def mask_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each turn with an address of its own appended: masked with its session's prefix, stored, restored."""
    items = chats.turns_as_items(spark.read.parquet(f"{d}/conversations.parquet"))
    mail = F.concat(F.lit("u"), F.col("item_idx").cast("string"), F.lit("@example.com"))
    start = F.length("text") + 1
    span = A.span(start, start + F.length(mail), F.lit("EMAIL_ADDRESS"), F.lit(0.96), F.lit("test"), F.lit("email"))
    items = items.withColumn("original", F.concat("text", F.lit(" "), mail)).withColumn("spans", F.array(span)).withColumn("text", F.col("original"))
    masked, sessions = M.mask_items(items, "mask", "GR", "external", 3600)
    back = M.unmask_items(masked.select("session_id", "text", "original"), sessions)
    out = back.groupBy("session_id").agg(F.count(F.lit(1)).alias("items"), F.sum("replacements").alias("placeholders"), F.bool_and(F.col("text") == F.col("original")).alias("restored"))
    return out


# --- streams ---------------------------------------------------------------------------------------------------------


@query(
    "stream_restore",
    """SELECT conv_id::VARCHAR AS session_id, 'turn-' || turn AS stream_id, md5(coalesce(text, '') || ' v' || conv_id || ' end <w>') AS hash, 2::BIGINT AS replacements FROM conversations""",
)
def stream_restore(spark: SparkSession, d: str) -> DataFrame:
    """Turns with two placeholders appended, cut into chunks of 25 characters, restored by the stream."""
    from veilmark import ship
    from veilmark.sources.shared import shared_dir
    from veilmark.streaming.restore import restore_stream

    ship(spark)
    items = chats.turns_as_items(spark.read.parquet(f"{d}/conversations.parquet"))
    text = F.concat("text", F.lit(" <GR:0001> end <GR:0002>"))
    parts = items.select("session_id", F.col("item_id").alias("stream_id"), text.alias("text"), F.explode(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / 25).cast("int"))).alias("i"))
    chunks = parts.select("session_id", "stream_id", F.col("i").cast("long").alias("seq"), F.substring("text", F.col("i") * 25 + 1, F.lit(25)).alias("chunk"), ((F.col("i") + 1) * 25 >= F.length("text")).alias("final"))
    path = shared_dir(spark, "stream-restore")
    chunks.write.json(f"{path}/in")
    known = F.array(
        F.struct(F.lit("<GR:0001>").alias("placeholder"), F.concat(F.lit("v"), "session_id").alias("original")), F.struct(F.lit("<GR:0002>").alias("placeholder"), F.lit("<w>").alias("original"))
    )
    sessions = items.select("session_id").distinct().select("session_id", known.alias("placeholders"), F.lit(3600).alias("ttl_seconds"))
    stream = spark.readStream.schema(chunks.schema).json(f"{path}/in")
    sink = restore_stream(stream, sessions, expire=False).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "output"))), lambda x: x["output"]), "")
    return out.groupBy("session_id", "stream_id").agg(F.md5(said.cast("binary")).alias("hash"), F.sum("replacements").alias("replacements"))


from veilmark.plans import derived, further, planted, wider  # noqa: E402, F401  they register their queries
