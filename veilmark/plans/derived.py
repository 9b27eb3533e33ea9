"""Queries whose cases come from the rows of the tables: labels, ends of streams, reports and synthetic documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilmark.functions import labels as L
from veilmark.functions.rows import each
from veilmark.operators import detect as D
from veilmark.operators import intervals as I
from veilmark.operators import masking as M
from veilmark.operators import metrics as E
from veilmark.operators import spans as A
from veilmark.operators import synth as N
from veilmark.plans import catalog as C
from veilmark.plans.catalog import _BOTH, _DOCS, _TOKENS, _documents, _merged_sql, _samples, query
from veilmark.sources.shared import shared_dir
from veilmark.sources.tables import table
from veilmark.streaming import store


@query("detect_urls_pages", r"""SELECT page_id, value, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(concat_ws(' ', url, html), '(?i)\bhttps?://[^\s<>()"'']+')) AS value FROM pages) GROUP BY 1, 2""")
def detect_urls_pages(spark: SparkSession, d: str) -> DataFrame:
    """Addresses with a scheme in the url and the whole html of every page."""
    pages = table(spark, d, "pages", "page_id", "url", "html").select("page_id", F.concat_ws(" ", "url", "html").alias("text"))
    return C._values(pages, D.find_pattern(F.col("text"), *C._pattern("url_http")), "page_id")


_SIGNALS = ("keep", "luhn_valid", "grouped_like_card", "has_context", "score_multiplier", "score_bonus")


@query("payment_card_signal", f"SELECT {', '.join(_SIGNALS)}, count(*)::BIGINT AS n, sum(digits_count)::BIGINT AS digits FROM ({C.ORACLES['payment_card_signal_documents']}) GROUP BY ALL")
def payment_card_signal(spark: SparkSession, d: str) -> DataFrame:
    """How often each combination of signs for a payment card occurs."""
    return C.payment_card_signal_documents(spark, d).groupBy(*_SIGNALS).agg(F.count(F.lit(1)).alias("n"), F.sum("digits_count").alias("digits"))


#: Labels with what they collapse to, the canonical label of a detection, of a detection under a mapping of one's own, and of a prediction.
_LABEL_CASES = [
    ("PERSON", "PERSON", "person", "person", "person"), ("full_name", "PERSON", None, None, None), ("first-name", "PERSON", None, None, None),
    ("ADDRESS_CITY", "LOCATION", "location", "location", "location"), ("city", "LOCATION", "location", "location", "location"), ("TIN", "DOCUMENT_NUMBER", "identifier", "identifier", "identifier"),
    ("snils", "DOCUMENT_NUMBER", "identifier", "identifier", "identifier"), ("MILITARY_NUMBER", "DOCUMENT_NUMBER", None, "identifier", "identifier"),
    ("vehicle_number", "DOCUMENT_NUMBER", "identifier", "identifier", "identifier"), ("CREDIT_CARD", "CREDIT_CARD", "payment_card", "payment_card", "payment_card"),
    ("secret_key", "API_KEY", "secret", "secret", "secret"), ("ZIP", "ZIP", "ip", "location", "location"), ("IPV6", "IPV6", "ip", "ip", None), ("BIRTHDATE", "BIRTHDATE", "date", "date", "date"),
    ("WEBSITE", "WEBSITE", "url", "url", None), ("HOMEPAGE_URL", "HOMEPAGE_URL", "url", "url", "url"), ("ORG_UNIT", "ORG_UNIT", "organization", "organization", None),
    ("STREET_LOC", "STREET_LOC", "location", "location", None), ("VISA_CARD", "VISA_CARD", "payment_card", "payment_card", "payment_card"), ("PRIVATE_KEY", "PRIVATE_KEY", "secret", "secret", None),
    ("OTHER", "OTHER", None, None, None),
]
_OWN_LABELS = {"MILITARY_NUMBER": "identifier", "ZIP": "location"}


@query(
    "canonical_labels",
    "WITH c AS (SELECT c_custkey::BIGINT AS k FROM customer), t AS (SELECT * FROM (VALUES "
    + ", ".join("(" + ", ".join([str(i), *(f"'{x}'" if x else "NULL" for x in case)]) + ")" for i, case in enumerate(_LABEL_CASES))
    + f""") v(i, label, collapsed, canonical, own, predicted))
SELECT CASE k // {len(_LABEL_CASES)} % 3 WHEN 0 THEN label WHEN 1 THEN lower(label) || ' ' ELSE ' ' || upper(label) END AS label, collapsed, canonical, own, predicted, count(*)::BIGINT AS n FROM c JOIN t ON k % {len(_LABEL_CASES)} = i GROUP BY ALL""",
)
def canonical_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels in any case and with blanks around, by the row's key: what they are for thresholds, for detections and for predictions."""
    k, n = F.col("c_custkey").cast("long"), len(_LABEL_CASES)
    label = F.get(F.array(*(F.lit(case[0]) for case in _LABEL_CASES)), (k % n).cast("int"))
    way = F.floor(k / n) % 3
    said = F.when(way == 0, label).when(way == 1, F.concat(F.lower(label), F.lit(" "))).otherwise(F.concat(F.lit(" "), F.upper(label)))
    rows = table(spark, d, "customer", "c_custkey").select(said.alias("label"))
    told = (L.collapse_type(F.col("label")).alias("collapsed"), L.detection_label(F.col("label")).alias("canonical"), L.detection_label(F.col("label"), _OWN_LABELS).alias("own"), L.prediction_label(F.col("label")).alias("predicted"))
    return rows.groupBy("label", *told).agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_holdback",
    """WITH t AS (SELECT conv_id, turn, coalesce(text, '') || left('<GR:0002>', (turn % 9)::BIGINT) AS s FROM conversations)
SELECT conv_id, turn, coalesce(list_max([j FOR j IN range(1, 9) IF j <= length(s) AND right(s, j) IN (left('<GR:0001>', j), left('<GR:0002>', j))]), 0)::INT AS held FROM t""",
)
def stream_holdback(spark: SparkSession, d: str) -> DataFrame:
    """Turns that end in the beginning of a placeholder, cut after as many characters as the turn's number tells."""
    rows = table(spark, d, "conversations", "conv_id", "turn", "text")
    listed = F.array(*(F.struct(F.lit(p).alias("placeholder"), F.lit("v").alias("original")) for p in ("<GR:0001>", "<GR:0002>")))
    text = F.concat(F.coalesce("text", F.lit("")), F.substring(F.lit("<GR:0002>"), F.lit(1), (F.col("turn") % 9).cast("int")))
    return rows.select("conv_id", "turn", M.holdback(text, listed).alias("held"))


@query(
    "compare_reports",
    f"""{_BOTH},
{_merged_sql("gold", "mg", "doc_id, canonical")},
{_merged_sql("pred", "mp", "doc_id, canonical")},
h AS (SELECT doc_id, canonical, sum(greatest(0, least(a.end_, b.end_) - greatest(a.start_, b.start_))) AS tp FROM mg a JOIN mp b USING (doc_id, canonical) GROUP BY 1, 2),
g AS (SELECT doc_id, canonical, sum(end_ - start_) AS ng FROM mg GROUP BY 1, 2),
r AS (SELECT lang = 'en' AS en, canonical AS label, round(sum(coalesce(tp, 0))::DOUBLE / sum(ng), 6) AS recall FROM g JOIN docs USING (doc_id) LEFT JOIN h USING (doc_id, canonical) GROUP BY 1, 2),
c AS (SELECT label, coalesce(a.recall, 0) AS base, coalesce(b.recall, 0) AS new, round(coalesce(b.recall, 0) - coalesce(a.recall, 0), 6) AS delta FROM (SELECT * FROM r WHERE en) a FULL JOIN (SELECT * FROM r WHERE NOT en) b USING (label))
(SELECT *, 'worst' AS side FROM c ORDER BY delta, label LIMIT 10) UNION ALL (SELECT *, 'best' AS side FROM c ORDER BY delta DESC, label DESC LIMIT 10)""",
)
def compare_reports(spark: SparkSession, d: str) -> DataFrame:
    """Recall by label of two reports, over the English texts and over the others: where the second is worst and best."""
    rows = _samples(spark, d).withColumn("en", F.col("lang") == "en")
    told = E.with_ratios(E.evaluate(rows, ["en"], families=[], per_label=True).where("family = 'label_char' AND tp + fn > 0"))
    return E.extremes(E.compare_recalls(told.where("en").select("label", "recall"), told.where("NOT en").select("label", "recall")), 10)


@query("synthetic_documents", "SELECT count(*)::BIGINT AS n, 0::BIGINT AS violations, count(*) FILTER (s_suppkey % 10 = 9)::BIGINT AS negatives, true AS long_enough FROM supplier")
def synthetic_documents(spark: SparkSession, d: str) -> DataFrame:
    """A document for each supplier: spans in bounds and apart, every tenth without values, and as long as asked for."""
    from veilmark import ship

    ship(spark)
    rows = N.generate(spark, table(spark, d, "supplier", "s_suppkey").select(F.col("s_suppkey").cast("long").alias("id")), seed=3, buckets={"10k": 1})
    bad = N.violations(F.col("privacy_mask"), F.col("length_chars"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(bad).alias("violations"), F.count_if(F.col("entity_count") == 0).alias("negatives"), F.bool_and(F.col("length_chars") >= 10_000).alias("long_enough"))



_EVENT = "array<struct<at:timestamp,order:int,kind:string,stream_id:string,chunk:string,final:boolean,delete_context:boolean>>"


@query(
    "stream_sessions",
    """WITH t AS (SELECT conv_id, coalesce(text, '') AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
w AS (SELECT *, CASE conv_id % 4 WHEN 0 THEN 'restored' WHEN 1 THEN CASE WHEN k <= 2 THEN 'restored' ELSE 'missing' END WHEN 2 THEN CASE WHEN k <= 1 THEN 'restored' ELSE 'missing' END ELSE 'cut' END AS way FROM t)
SELECT conv_id::VARCHAR AS session_id, 'turn-' || k AS stream_id, md5(CASE way WHEN 'restored' THEN s || ' v' || conv_id || ' end' WHEN 'missing' THEN s || ' <GR:0001> end' ELSE s || ' 01> end' END) AS hash,
  CASE way WHEN 'restored' THEN 1 ELSE 0 END::BIGINT AS replacements, way <> 'missing' AS context_found, (conv_id % 4 = 2 AND k = 1) AS context_deleted FROM w
UNION ALL SELECT conv_id::VARCHAR, NULL, md5(''), 0, conv_id % 4 = 0 OR conv_id % 4 = 2 AND max(n) < 2, conv_id % 4 = 0 OR conv_id % 4 = 2 AND max(n) < 2 FROM w GROUP BY conv_id""",
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as a session of a stream: stored, its turns' chunks with a placeholder cut in two, and finalized after 1000 seconds.

    By the conversation's number it lives on, expires after 25 seconds, is deleted with its second turn, or is stored again and again while
    the texts that its streams hold back expire. Events come in three files, out of order.
    """
    from veilmark import ship

    ship(spark)
    rows = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    k = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1  # a conversation's turns, as a request has them
    turns = rows.select(F.col("conv_id").cast("string").alias("session_id"), (F.col("conv_id") % 4).alias("c"), k.alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    stream, last = F.concat(F.lit("turn-"), F.col("k").cast("string")), F.col("c") == 3
    none = F.lit(None)
    event = lambda seconds, order, kind, stream_id=none, chunk=none, final=F.lit(False), delete=F.lit(False): F.struct(
        at(seconds).alias("at"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), stream_id.cast("string").alias("stream_id"), chunk.cast("string").alias("chunk"), final.alias("final"), delete.alias("delete_context")
    )
    first = F.when(last, 1 + F.col("k") / 1000).otherwise(10 * F.col("k") + 1)
    second = F.when(last, 30 + F.col("k") / 1000).otherwise(10 * F.col("k") + 2)
    chunks = F.array(
        event(first, 1, "chunk", stream, F.concat("text", F.lit(" <GR:00"))), event(second, 2, "chunk", stream, F.lit("01> end"), F.lit(True), (F.col("c") == 2) & (F.col("k") == 1))
    )
    ends = F.concat(F.array(event(F.lit(0.0), 0, "store"), event(F.lit(1000.0), 3, "finalize")), F.when(last, F.array(event(F.lit(20.0), 0, "store"), event(F.lit(40.0), 0, "store"))).otherwise(F.array().cast(_EVENT)))
    events = turns.select("session_id", "c", "k", F.explode(F.when(F.col("k") == 0, F.concat(ends, chunks)).otherwise(chunks)).alias("e")).select("session_id", "c", "k", "e.*")
    seq = (F.row_number().over(W.partitionBy("session_id").orderBy("at", "order", "k")) - 1).cast("long")
    known = F.array(F.struct(F.lit("<GR:0001>").alias("placeholder"), F.concat(F.lit("v"), "session_id").alias("original")))
    stores = F.col("kind") == "store"
    events = events.select(
        "session_id", seq.alias("seq"), "at", "kind", "stream_id", "chunk", "final", "delete_context", F.when(stores, known).alias("placeholders"), F.when(stores, F.when(F.col("c").isin(1, 3), 25).otherwise(3600)).alias("ttl_seconds")
    )
    path = shared_dir(spark, "stream-sessions")
    events.repartition(3, F.pmod(F.col("seq"), F.lit(3))).write.parquet(f"{path}/in")
    stream_in = spark.readStream.schema(store.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    with store.rocksdb(spark):
        sink = store.session_stream(stream_in).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
        sink.trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(store.OUTPUT).parquet(f"{path}/out")
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "output"))), lambda x: x["output"]), "")
    return out.groupBy("session_id", "stream_id").agg(
        F.md5(said.cast("binary")).alias("hash"), F.sum("replacements").alias("replacements"), F.bool_and("context_found").alias("context_found"), F.bool_or("context_deleted").alias("context_deleted")
    )


_MARKER = " test.user@example.com "
_MAIL = "(?i)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"


@query(
    "window_boundaries",
    f"""WITH {_DOCS},
{_TOKENS},
m AS (SELECT doc_id, count(*) AS m FROM toks GROUP BY 1),
f AS (SELECT doc_id, te - l AS first FROM toks WHERE i = 1), s AS (SELECT doc_id, te - l AS second FROM toks WHERE i = 113), e AS (SELECT doc_id, max(te) AS last FROM toks GROUP BY 1),
w AS (SELECT doc_id, text, n, CASE WHEN first > 0 THEN first WHEN m > 128 THEN second ELSE last END AS b FROM docs JOIN m USING (doc_id) JOIN f USING (doc_id) JOIN e USING (doc_id) LEFT JOIN s USING (doc_id) WHERE first > 0 OR m > 128 OR last < n),
c AS (SELECT doc_id, b, text, unnest(['cross_boundary', 'just_before', 'just_after']) AS kind, unnest([greatest(b - 11, 0), greatest(b - 25, 0), least(b + 2, n)]) AS o FROM w),
x AS (SELECT doc_id, kind, b, text[1:o] AS a, text[o + 1:] AS z FROM c),
k AS (SELECT doc_id, kind, b, len(regexp_extract_all(a || '{_MARKER}' || z, '{_MAIL}')) AS n, len(regexp_extract_all(a, '{_MAIL}')) + len(regexp_extract_all(z, '{_MAIL}')) AS others FROM x)
SELECT doc_id, kind AS case, b::INT AS boundary, n::BIGINT AS predicted_count, (n - others)::BIGINT AS overlap_count, (-2 * (n - others))::BIGINT AS span_inflation FROM k""".replace("AS case", 'AS "case"'),
)
def window_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """An address put at the second window's beginning in three ways, detected window by window, and joined with what was found."""
    cases = I.boundary_cases(_documents(spark, d).select("doc_id", "text"), _MARKER, 128, 16)
    windows, find = A.chunk_windows(F.col("text"), 128, 16), lambda t: D.find_pattern(t, *C._pattern("email"))
    found = each(cases, I.in_windows(F.col("text"), windows, find), "s", "doc_id", "case").select("doc_id", "case", "s.start", "s.end")
    return I.boundary_report(cases, found, "doc_id")


class _Words:
    """Whole words of a list, in any case."""

    words: tuple[str, ...] = ()
    label, score = "ORGANIZATION", 0.8

    def eval(self, text: str):
        import re

        for m in re.finditer(r"(?<!\S)\S+(?!\S)", text):
            if m[0].lower() in self.words:
                yield m.start(), m.end(), self.label, self.score


def _word_list(params: dict) -> type:
    return type("Words", (_Words,), {"words": tuple(params["words"]), "label": params.get("label", "ORGANIZATION")})


_WORD_POLICY = """
default_policy: words
policies: {words: {analyzer_profile: all, min_score: 0.5}}
analyzer_profiles: {all: {analysis: {recognizers: [names, mails]}}}
recognizer_definitions:
  names: {type: word_list, params: {words: [the, die, une, los], label: organization}}
  mails: {type: regex, params: {patterns: [{name: mail, label: EMAIL_ADDRESS, score: 0.9, pattern: "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"}]}}
"""


@query(
    "detectors_of_ones_own",
    f"""WITH {_DOCS},
w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM docs),
m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')) AS v FROM docs)
SELECT doc_id, 'names:ORGANIZATION' AS detector, 'organization' AS canonical, count(*)::BIGINT AS n, sum(length(w))::BIGINT AS chars FROM w WHERE lower(w) IN ('the', 'die', 'une', 'los') GROUP BY 1
UNION ALL SELECT doc_id, 'mails:EMAIL_ADDRESS', 'email', count(*), sum(length(v)) FROM m GROUP BY 1""",
)
def detectors_of_ones_own(spark: SparkSession, d: str) -> DataFrame:
    """A policy with a type that is a table function of this module, beside one of patterns."""
    import yaml

    from veilmark import ship
    from veilmark.operators import table_functions
    from veilmark.sources.policy import parse_policy

    ship(spark)
    table_functions.register_kind("word_list", _word_list)
    policy = parse_policy(yaml.safe_load(_WORD_POLICY))
    rows, extra = table_functions.with_function_spans(_documents(spark, d), policy, "doc_id")
    found = each(D.detect(rows, policy, extra=extra), "spans", "s", "doc_id")
    return found.groupBy("doc_id", "s.detector", "s.canonical").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("s.end") - F.col("s.start")).cast("long")).alias("chars"))


@query("observed_detection", f"{C._FOUND}\nSELECT detector, count(*)::BIGINT AS spans, (SELECT count(*) FROM documents)::BIGINT AS rows, (SELECT sum(length(text)) FROM documents)::BIGINT AS characters FROM found GROUP BY 1")
def observed_detection(spark: SparkSession, d: str) -> DataFrame:
    """Spans by detector, as observed while the detected documents are written."""
    from veilmark.operators import runs
    from veilmark.sources.policy import load_policy

    path = shared_dir(spark, "detected")
    report = runs.run_detection(_documents(spark, d), load_policy(), lambda found: found.select("doc_id", "spans").write.parquet(path))
    rows = [(name, n, report["rows"], report["characters"]) for name, n in report["detectors"].items()]
    return spark.createDataFrame(rows, "detector string, spans long, rows long, characters long")


@query("saved_dataset", "SELECT split, lang, count(*)::BIGINT AS rows, sum(length(text))::BIGINT AS chars, bool_and(true) AS equal FROM documents, (VALUES ('train'), ('copy')) t(split) GROUP BY 1, 2")
def saved_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Documents saved as a folder of two splits of Arrow files, of which two columns are read back and held against the table."""
    from veilmark.sources import saved

    docs = table(spark, d, "documents")
    path = shared_dir(spark, "saved")
    saved.write_splits({"train": docs, "copy": docs.coalesce(1)}, path)
    parts = []
    for split in ("train", "copy"):
        back = saved.read_saved(spark, path, split, ["doc_id", "lang", "text"]).withColumn("split", F.lit(split))
        parts.append(back.join(docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")), "doc_id", "left"))
    equal = F.coalesce(F.sha2(F.col("text").cast("binary"), 256) == F.col("h"), F.col("text").isNull() & F.col("h").isNull())
    return parts[0].unionByName(parts[1]).groupBy("split", "lang").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars"), F.bool_and(equal).alias("equal"))
