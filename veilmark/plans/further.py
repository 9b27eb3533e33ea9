"""Queries of policies, data sets, reports, sessions and payloads over the rows of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.rows import each
from veilmark.operators import masking as M
from veilmark.operators import metrics as E
from veilmark.operators import plugins as P
from veilmark.operators import sampling as S
from veilmark.operators import spans as A
from veilmark.plans import catalog as C
from veilmark.plans.catalog import _GOLD, _MASKED, _documents, _ratios_sql, _samples, query
from veilmark.sources import chats, datasets, reports
from veilmark.sources.policy import parse_policy
from veilmark.sources.shared import shared_dir
from veilmark.sources.tables import table

_POLICIES = {
    "default_policy": "usual",
    "policies": {"usual": {"analyzer_profile": "all", "min_score": 0.6}, "strict": {"mode": "block", "analyzer_profile": "all", "min_score": 0.9}, "open": {"mode": "passthrough", "analyzer_profile": "all", "min_score": 0.0}},
    "analyzer_profiles": {"all": {"analysis": {"recognizers": []}}},
}


@query(
    "resolved_policies",
    f"""{_GOLD},
p AS (SELECT doc_id, CASE lang WHEN 'fr' THEN 'strict' WHEN 'de' THEN 'open' ELSE 'usual' END AS policy FROM docs),
m AS (SELECT * FROM (VALUES ('usual', 'mask', 0.6), ('strict', 'block', 0.9), ('open', 'passthrough', 0.0)) v(policy, mode, least_))
SELECT policy, mode, count(DISTINCT p.doc_id)::BIGINT AS documents, count(g.k) FILTER (g.score >= least_)::BIGINT AS spans FROM p JOIN m USING (policy) LEFT JOIN gold g ON g.doc_id = p.doc_id GROUP BY 1, 2""",
)
def resolved_policies(spark: SparkSession, d: str) -> DataFrame:
    """Documents under the policy of their language, which is the default one where none is named."""
    policies = parse_policy(_POLICIES)
    named = {"fr": "strict", "de": "open", "en": None, "es": None}
    told = F.create_map(*(x for lang, name in named.items() for x in (F.lit(lang), F.struct(*(F.lit(getattr(policies.resolve(name), f)).alias(f) for f in ("name", "mode", "min_score"))))))
    rows = _samples(spark, d).withColumn("p", F.coalesce(F.try_element_at(told, F.col("lang")), F.try_element_at(told, F.lit("en"))))
    kept = F.size(F.filter("gold", lambda s: s["score"] >= F.col("p.min_score")))
    return rows.groupBy(F.col("p.name").alias("policy"), F.col("p.mode").alias("mode")).agg(F.count(F.lit(1)).alias("documents"), F.sum(kept.cast("long")).alias("spans"))


_REGISTRY = {
    "version": 1,
    "datasets": {
        "org/Docs": {"label_map": {"MAIL": "email"}, "slice_fields": ["source"]},
        "org/Chats": {"text_field": "text", "spans_field": "found", "label_map": {"NUM": "identifier"}},
        "org/Unused": {},
    },
    "suites": {"nightly": {"datasets": ["org/Docs", "org/Chats"]}},
}


@query(
    "registry_suite",
    """WITH a AS (SELECT 'org/Docs' AS dataset, 'org_docs::fast::' || doc_id AS sample_id, length(coalesce(text, '')) AS n, CASE WHEN length(coalesce(text, '')) >= 4 THEN 1 ELSE 0 END AS spans, 'email' AS label FROM documents),
b AS (SELECT 'org/Chats', 'org_chats::fast::' || (conv_id * 1000 + turn), length(coalesce(text, '')), 1, 'identifier' FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY sample_id) AS nth FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT dataset, label, count(*)::BIGINT AS samples, sum(n)::BIGINT AS chars, sum(spans)::BIGINT AS spans FROM r WHERE nth <= 60 GROUP BY 1, 2""",
)
def registry_suite(spark: SparkSession, d: str) -> DataFrame:
    """The data sets of a suite of the registry, up to 60 samples of each (a report's limit)."""
    registry = datasets.parse_registry(_REGISTRY)
    one = lambda end, label: F.array(F.struct(F.lit(0).alias("start"), end.cast("int").alias("end"), F.lit(label).alias("label")))
    text = F.coalesce("text", F.lit(""))
    tables = {
        "org/Docs": _documents(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("source_text"), one(F.when(F.col("n") >= 4, 4).otherwise(0), "mail").alias("privacy_mask"), "source"),
        "org/Chats": table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), text.alias("text"), one(F.lit(3), "num").alias("found")),
    }
    label = {"org/Docs": "email", "org/Chats": "identifier"}
    parts = []
    for name in registry.suites["nightly"]:
        out = datasets.samples(tables[name], registry.datasets[name], registry.default_split, max_samples=60)
        known = F.size(F.filter("gold", lambda s: s["canonical"] == label[name]))  # noqa: B023
        parts.append(out.groupBy("dataset", F.lit(label[name]).alias("label")).agg(F.count(F.lit(1)).alias("samples"), F.sum(F.length("text").cast("long")).alias("chars"), F.sum(known.cast("long")).alias("spans")))
    return parts[0].unionByName(parts[1])


@query("written_report", f"{C._PER_LABEL}\nSELECT kind, {_ratios_sql('tp', 'fp', 'fn', 'label, ')} FROM pl, (VALUES ('csv'), ('json')) t(kind)")
def written_report(spark: SparkSession, d: str) -> DataFrame:
    """A report by label written as CSV and as JSON, and read back from either."""
    path = shared_dir(spark, "report")
    told = E.with_ratios(C._label_chars(spark, d)).withColumn("family", F.lit("label_char"))
    reports.write_metrics(told, path)
    kind = "label string, tp long, fp long, fn long, precision double, recall double, f1 double, residual_miss_ratio double"
    names = [f.split()[0] for f in kind.split(", ")]
    csv = spark.read.option("header", "true").csv(f"{path}/metrics.csv").select(*(F.col(n).cast(f.split()[1]).alias(n) for n, f in zip(names, kind.split(", "))))
    return csv.withColumn("kind", F.lit("csv")).unionByName(spark.read.schema(kind).json(f"{path}/report.json").withColumn("kind", F.lit("json")))


@query("file_manifest", "SELECT 'lang=' || lang AS folder, sum(length(doc_id::VARCHAR) + 1)::BIGINT AS length, sha256(string_agg(doc_id::VARCHAR || chr(10), '' ORDER BY doc_id)) AS sha256, 0::BIGINT AS wrong FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Ids by language in a file each: length and digest of every file, which still are those of the manifest."""
    path = shared_dir(spark, "manifest")
    ids = table(spark, d, "documents", "doc_id", "lang").where("lang is not null")
    ids.repartition("lang").sortWithinPartitions("lang", "doc_id").select("lang", F.col("doc_id").cast("string").alias("value")).write.partitionBy("lang").text(f"{path}/data")
    files = datasets.checksum_manifest(spark, f"{path}/data").where(~F.col("name").rlike("(^|/)[_.]"))
    files.coalesce(1).write.json(f"{path}/manifest")
    wrong = datasets.verify_manifest(spark, path).count()
    return files.select(F.regexp_extract("name", "^[^/]*", 0).alias("folder"), "length", "sha256", F.lit(wrong).cast("long").alias("wrong"))


@query("run_tags", "SELECT lang, substr(sha1('{\"documents\":' || count(*) || ',\"lang\":\"' || lang || '\",\"split\":\"fast\"}'), 1, 10) AS tag FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def run_tags(spark: SparkSession, d: str) -> DataFrame:
    """The tag of a run over each language, from its configuration."""
    sizes = table(spark, d, "documents", "lang").where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language
    return spark.createDataFrame([(r["lang"], reports.run_tag({"split": "fast", "lang": r["lang"], "documents": r["n"]})) for r in sizes], "lang string, tag string")


@query(
    "apportioned",
    """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT source, 777 * n::DOUBLE / sum(n) OVER () AS x FROM c),
f AS (SELECT *, floor(x)::BIGINT AS w, row_number() OVER (ORDER BY floor(x) - x, source) AS nth FROM e)
SELECT source, w + CASE WHEN nth <= 777 - sum(w) OVER () THEN 1 ELSE 0 END AS n FROM f""",
)
def apportioned(spark: SparkSession, d: str) -> DataFrame:
    """777 places for the sources, by largest remainder."""
    sizes = table(spark, d, "documents", "source").groupBy("source").count().orderBy("source").collect()  # a row a source, of a few
    return spark.createDataFrame(list(S.largest_remainder(777, {r["source"]: r["count"] for r in sizes}).items()), "source string, n long")


@query(
    "context_lengths",
    """WITH m AS (SELECT p_partkey::BIGINT AS k, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE p_size * 16 END AS pos, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 1000000 WHEN 2 THEN 1 ELSE p_size * 10 END AS tok FROM part)
SELECT k, greatest(2, CASE WHEN pos <> 0 THEN pos WHEN tok BETWEEN 2 AND 100000 THEN tok ELSE 512 END - 2)::BIGINT AS length FROM m""",
)
def context_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Windows of models whose sizes follow from the parts: some tell none, or none that makes sense."""
    rows, k = table(spark, d, "part", "p_partkey", "p_size"), F.col("p_partkey")
    positions = F.when(k % 3 == 0, None).when(k % 3 == 1, 0).otherwise(F.col("p_size") * 16)
    longest = F.when(k % 4 == 0, None).when(k % 4 == 1, 1_000_000).when(k % 4 == 2, 1).otherwise(F.col("p_size") * 10)
    return rows.select(k.cast("long").alias("k"), A.context_lengths(positions.cast("long"), longest.cast("long")).alias("length"))


@query(
    "plausible_persons",
    f"""{_GOLD},
w AS (SELECT lang, length(regexp_replace(substr(text, start_::BIGINT + 1, (end_ - start_)::BIGINT), '[^\\pL]', '', 'g')) AS letters FROM gold JOIN docs USING (doc_id))
SELECT 'documents ' || lang AS source, count(*) FILTER (letters >= 3)::BIGINT AS plausible, count(*)::BIGINT AS n FROM w GROUP BY 1
UNION ALL SELECT 'customers', count(*) FILTER (c_custkey % 3 = 0), count(*) FROM customer""",
)
def plausible_persons(spark: SparkSession, d: str) -> DataFrame:
    """Spans that may be names: those of documents by their letters, and planted ones of which some are imperatives or short."""
    rows = each(_samples(spark, d), "gold", "s", "lang", "text").select(F.concat(F.lit("documents "), F.col("lang")).alias("source"), P.plausible_person(F.col("text"), F.col("s.start"), F.col("s.end")).alias("ok"))
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, "Спросите. Ваня Петров знает").when(k == 1, "Спросите. Перескажи это").otherwise("Спросите. Ян знает")
    end = F.when(k == 0, 21).when(k == 1, 19).otherwise(12)
    planted = table(spark, d, "customer", "c_custkey").select(F.lit("customers").alias("source"), P.plausible_person(text, F.lit(10), end).alias("ok"))
    return rows.unionByName(planted).groupBy("source").agg(F.count_if("ok").alias("plausible"), F.count(F.lit(1)).alias("n"))


@query(
    "system_findings",
    """SELECT CASE conv_id % 3 WHEN 0 THEN 'reversible_mask_session' WHEN 1 THEN 'analysis' ELSE 'models' END AS check_id, CASE conv_id % 3 WHEN 0 THEN 'session' ELSE 'system' END AS category, CASE conv_id % 3 WHEN 0 THEN 'high' ELSE 'critical' END AS severity,
  CASE conv_id % 3 WHEN 0 THEN 'missing_or_expired_session' WHEN 1 THEN 'analysis_failed' ELSE 'models_not_ready' END AS reason, CASE conv_id % 3 WHEN 0 THEN conv_id::VARCHAR WHEN 1 THEN 'names: turn ' || max(turn) ELSE 'no model ' || conv_id END AS told FROM conversations GROUP BY conv_id""",
)
def system_findings(spark: SparkSession, d: str) -> DataFrame:
    """A finding of each kind that has no spans, by the conversation's number, with what it tells in full scope."""
    rows = table(spark, d, "conversations", "conv_id", "turn").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    sid, kind = F.col("conv_id").cast("string"), F.col("conv_id") % 3
    fields = lambda f, told: F.struct(*(f[c].alias(c) for c in ("check_id", "category", "severity")), f["evidence"]["reason"].alias("reason"), told(f["evidence"]).alias("told"))
    missing = fields(M.missing_session(sid), lambda e: e["session_id"])
    errors = F.create_map(F.lit("names"), F.concat(F.lit("turn "), F.col("turn").cast("string")))
    failed = fields(M.analysis_failed(errors), lambda e: F.concat(F.lit("names: "), F.try_element_at(e["detector_errors"], F.lit("names"))))
    waiting = fields(M.models_not_ready(F.concat(F.lit("no model "), sid)), lambda e: e["load_error"])
    return rows.select(F.when(kind == 0, missing).when(kind == 1, failed).otherwise(waiting).alias("f")).select("f.*")


@query(
    "payload_kinds",
    """SELECT conv_id::VARCHAR || '-' || turn AS session_id, ['choices', 'prompt', 'input'][turn % 3 + 1] AS kind, CASE turn % 3 WHEN 0 THEN role ELSE 'user' END AS role, md5(coalesce(text, '') || '!') AS hash FROM conversations""",
)
def payload_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Each turn as a payload with ``choices[]``, ``prompt`` or ``input``; its text with a mark appended is written back and read again."""
    rows = table(spark, d, "conversations", "conv_id", "turn", "role", "text").withColumn("text", F.coalesce("text", F.lit("")))
    choice = F.to_json(F.struct(F.array(F.struct(F.struct("role", F.col("text").alias("content")).alias("message"))).alias("choices")))
    one = lambda name: F.to_json(F.struct(F.col("text").alias(name)))
    way = F.col("turn") % 3
    payloads = rows.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("session_id"), F.when(way == 0, choice).when(way == 1, one("prompt")).otherwise(one("input")).alias("payload"))
    marked = chats.flatten_messages(payloads).withColumn("text", F.concat("text", F.lit("!")))
    back = chats.write_back(payloads, marked)
    kinds = back.select("session_id", F.json_object_keys("payload")[0].alias("kind"))
    return chats.flatten_messages(back).join(kinds, "session_id").select("session_id", "kind", "role", F.md5(F.col("text").cast("binary")).alias("hash"))


@query("usage_in_and_out", f"{_MASKED}\nSELECT doc_id::VARCHAR AS session_id, 1::BIGINT AS input_items, length(text)::BIGINT AS input_chars, CASE WHEN placeholders > 4 THEN 0 ELSE 1 END::BIGINT AS output_items, CASE WHEN placeholders > 4 THEN 0 ELSE length(masked) END::BIGINT AS output_chars FROM masked")
def usage_in_and_out(spark: SparkSession, d: str) -> DataFrame:
    """Items and characters in and out of masking, where texts with more than four placeholders are held back."""
    rows = C._masked(spark, d).select(F.col("doc_id").cast("string").alias("session_id"), "text", F.when(F.size("m.placeholders") <= 4, F.col("m.text")).alias("masked"))
    return M.usage(rows)


@query(
    "restored_and_deleted",
    """WITH t AS (SELECT conv_id, count(*) AS n, sum(length(coalesce(text, ''))) AS chars FROM conversations GROUP BY 1)
SELECT conv_id::VARCHAR AS session_id, n::BIGINT AS items, (chars + n * CASE WHEN conv_id % 4 = 0 THEN 10 ELSE 6 END)::BIGINT AS chars, (conv_id % 4 > 0) AS context_found, (conv_id % 4 = 1) AS context_deleted, (conv_id % 4 IN (2, 3)) AS stays FROM t""",
)
def restored_and_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Items restored in a batch; a quarter has no session, and a quarter asks that its session goes."""
    items = chats.turns_as_items(table(spark, d, "conversations"))
    kind = F.col("session_id").cast("long") % 4
    items = items.withColumn("text", F.concat("text", F.lit("<GR0C:001>"))).withColumn("delete_context", kind == 1)
    known = items.select("session_id").distinct().where(kind > 0).select("session_id", F.array(F.struct(F.lit("<GR0C:001>").alias("placeholder"), F.lit("secret").alias("original"))).alias("placeholders"))
    out, left = M.unmask_and_delete(items, known)
    out = out.groupBy("session_id").agg(F.count(F.lit(1)).alias("items"), F.sum(F.length("text").cast("long")).alias("chars"), F.bool_and("context_found").alias("context_found"), F.bool_or("context_deleted").alias("context_deleted"))
    stays = left.select(F.col("session_id").alias("_sid"))
    return out.join(stays, F.col("session_id") == F.col("_sid"), "left").withColumn("stays", F.col("_sid").isNotNull()).drop("_sid")
