"""Reversible masking and restoring as columns, and the decisions that go with them.

Placeholders are a list ``array<struct<placeholder,original>>`` in order of their numbers; numbers count distinct originals from the
right end of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.labels import severity
from veilmark.functions.rows import each
from veilmark.functions.texts import cut, let, request_hint

PLACEHOLDERS = "array<struct<placeholder:string,original:string>>"
COLLISION = "placeholder collision in a session"


def padded(number: Column, width: int) -> Column:
    """Digits with leading zeros up to ``width``; longer numbers stay whole."""
    digits = number.cast("string")
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def placeholder(prefix: Column, number: Column) -> Column:
    return F.concat(F.lit("<"), prefix, F.lit(":"), padded(number, 4), F.lit(">"))


def unambiguous(placeholders: Column) -> Column:
    """The list as it is; an error if a placeholder stands for two originals."""

    def clashes(xs: Column) -> Column:  # in order, those of one placeholder stand together
        before = lambda i: F.get(xs, i - 1)
        return F.exists(F.transform(xs, lambda p, i: (i > 0) & before(i)["placeholder"].eqNullSafe(p["placeholder"]) & ~before(i)["original"].eqNullSafe(p["original"])), lambda x: x)

    return F.when(let(F.sort_array(placeholders), clashes), F.raise_error(F.lit(COLLISION)).cast(PLACEHOLDERS)).otherwise(placeholders)


def mask(text: Column, spans: Column, prefix: Column) -> Column:
    """``struct<text,placeholders>`` for disjoint spans in order."""
    originals = F.transform(spans, lambda s: cut(text, s["start"], s["end"]))

    def masked(distinct: Column) -> Column:
        name = lambda o: let(F.array_position(distinct, o), lambda k: placeholder(prefix, k))
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
        parts = F.transform(spans, lambda s, i: F.concat(cut(text, before(i), s["start"]), name(cut(text, s["start"], s["end"]))))
        rest = F.substring(text, F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0)) + 1, F.length(text))
        listed = F.transform(distinct, lambda o: F.struct(name(o).alias("placeholder"), o.alias("original")))
        return F.struct(F.concat(F.array_join(parts, ""), rest).alias("text"), listed.cast(PLACEHOLDERS).alias("placeholders"))

    return let(F.array_distinct(F.reverse(originals)), masked)


def unmask(text: Column, placeholders: Column) -> Column:
    """``struct<text,replaced>``: placeholders replaced one after the other, longest first; what a restored value holds is replaced too."""
    order = F.transform(
        F.sort_array(F.transform(placeholders, lambda p, i: F.struct((-F.length(p["placeholder"])).alias("l"), i.alias("i"), p.alias("p")))), lambda x: x["p"]
    )

    def step(a: Column, p: Column) -> Column:
        without = F.replace(a["text"], p["placeholder"], F.lit(""))
        n = ((F.length(a["text"]) - F.length(without)) / F.length(p["placeholder"])).cast("int")
        return F.struct(F.replace(a["text"], p["placeholder"], p["original"]).alias("text"), (a["replaced"] + n).alias("replaced"))

    return F.aggregate(order, F.struct(text.alias("text"), F.lit(0).alias("replaced")), step)


def holdback(text: Column, placeholders: Column) -> Column:
    """Length of the longest end of the text that begins a placeholder without being one."""
    longest = F.array_max(F.transform(placeholders, lambda p: F.length(p["placeholder"])))
    most = F.least(F.coalesce(longest, F.lit(0)) - 1, F.length(text))
    ends = F.when(most >= 1, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    fits = F.filter(ends, lambda n: F.exists(placeholders, lambda p: F.startswith(p["placeholder"], F.right(text, n))))
    return F.coalesce(F.array_max(fits), F.lit(0))


def masked_texts(items: DataFrame, prefix: str) -> DataFrame:
    """Items (as ``mask_items`` takes them) with their masked texts and ``placeholders``."""
    own = F.concat(F.lit(prefix), padded(F.col("item_idx"), 2), request_hint(F.col("session_id")))
    return items.withColumn("_m", mask(F.col("text"), F.col("spans"), own)).withColumns({"text": F.col("_m.text"), "placeholders": F.col("_m.placeholders")}).drop("_m")


def session_pairs(masked: DataFrame) -> DataFrame:
    """What restores masked texts as a row ``(session_id, placeholder, original)`` for each placeholder; an error if one stands for two originals.

    For sessions of so many items that their list is too long for a row: no task holds a whole session.
    """
    pairs = each(masked, "placeholders", "_p", "session_id").groupBy("session_id", F.col("_p.placeholder").alias("placeholder")).agg(F.min("_p.original").alias("original"), F.max("_p.original").alias("_last"))
    one = F.when(F.col("original").eqNullSafe(F.col("_last")), F.col("original")).otherwise(F.raise_error(F.lit(COLLISION)).cast("string"))
    return pairs.select("session_id", "placeholder", one.alias("original"))


def mask_items(items: DataFrame, mode: str, prefix: str, policy_name: str, ttl_seconds: int) -> tuple[DataFrame, DataFrame]:
    """Masked items and the sessions to store, for ``items(session_id, item_idx, item_id, text, spans)`` with merged spans.

    ``item_idx`` numbers a session's items and makes their placeholders differ; items that share a number are an error if their placeholders collide.

    ``passthrough`` leaves texts alone and stores empty sessions; under ``block`` a session with findings gives no texts and is not stored.
    """
    if mode == "passthrough":
        out = items.withColumn("spans", F.slice("spans", 1, 0)).withColumn("placeholders", F.array().cast(PLACEHOLDERS))
    else:
        out = masked_texts(items, prefix)
    per_session = out.groupBy("session_id").agg(
        unambiguous(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("item_idx", "placeholders"))), lambda x: x["placeholders"]))).alias("placeholders"),
        F.sum(F.size("spans")).alias("findings"),
    )
    if mode == "block":
        out = out.join(per_session.select("session_id", "findings"), "session_id").withColumn("text", F.when(F.col("findings") == 0, F.col("text"))).drop("findings")
        per_session = per_session.where("findings = 0")
    sessions = per_session.select(
        "session_id",
        F.lit(policy_name).alias("policy_name"),
        "placeholders",
        F.coalesce(F.array_max(F.transform("placeholders", lambda p: F.length(p["placeholder"]))), F.lit(1)).alias("max_placeholder_len"),
        F.lit(ttl_seconds).alias("ttl_seconds"),
    )
    return out, sessions


def unmask_items(items: DataFrame, sessions: DataFrame, allow_missing: bool = True) -> DataFrame:
    """``items(session_id, text, ...)`` restored; without a session the text stays and ``context_found`` is false, or that is an error."""
    known = sessions.select(F.col("session_id").alias("_sid"), F.col("placeholders").alias("_p"))
    df = items.join(known, F.col("session_id") == F.col("_sid"), "left")
    if not allow_missing:
        missing = F.raise_error(F.concat(F.lit("no session "), F.coalesce("session_id", F.lit("null"))))
        df = df.withColumn("text", F.when(F.col("_sid").isNull(), missing.cast("string")).otherwise(F.col("text")))
    df = df.withColumn("_u", unmask(F.col("text"), F.coalesce("_p", F.array().cast(PLACEHOLDERS))))
    return df.withColumns({"text": F.col("_u.text"), "replacements": F.col("_u.replaced"), "context_found": F.col("_sid").isNotNull()}).drop("_u", "_sid", "_p")


def unmask_and_delete(items: DataFrame, sessions: DataFrame, allow_missing: bool = True) -> tuple[DataFrame, DataFrame]:
    """``unmask_items``, and the sessions that stay: those of a request whose items ask for it (``delete_context``) go with it."""
    gone = items.where("delete_context").select("session_id").distinct()
    out = unmask_items(items, sessions, allow_missing).withColumn("context_deleted", F.col("context_found") & F.coalesce("delete_context", F.lit(False)))
    return out, sessions.join(gone, "session_id", "left_anti")


def usage(items: DataFrame, before: str = "text", after: str = "masked") -> DataFrame:
    """Items and characters of a session, in and out; an item without a text out counts in alone."""
    size = lambda c: F.coalesce(F.sum(F.length(c)), F.lit(0))
    return items.groupBy("session_id").agg(F.count(F.lit(1)).alias("input_items"), size(before).alias("input_chars"), F.count(after).alias("output_items"), size(after).alias("output_chars"))


def detect_action(findings: Column) -> Column:
    return F.when(findings > 0, "FLAGGED").otherwise("NONE")


def deidentify_action(mode: Column, findings: Column, placeholders: Column) -> Column:
    return F.when((mode == "block") & (findings > 0), "BLOCKED").when(placeholders > 0, "MASKED").otherwise("NONE")


def reidentify_action(context_found: Column, replacements: Column, allow_missing: bool = False) -> Column:
    return F.when(~context_found, "FLAGGED" if allow_missing else "BLOCKED").when(replacements > 0, "MASKED").otherwise("NONE")


def findings(text: Column, spans: Column, item_id: Column, full: bool = False) -> Column:
    """Findings of an item; evidence only in full scope."""

    def one(s: Column) -> Column:
        evidence = F.struct(item_id.alias("item_id"), s["label"].alias("entity_type"), s["canonical"].alias("canonical_label"), s["detector"].alias("detector"))
        where = F.struct(s["start"].alias("start"), s["end"].alias("end"), cut(text, s["start"], s["end"]).alias("snippet"), s["label"].alias("label"))
        return F.struct(
            F.coalesce(s["detector"], F.lit("unknown")).alias("check_id"),
            F.coalesce(s["canonical"], F.lower(s["label"])).alias("category"),
            severity(s["score"]).alias("severity"),
            s["score"].alias("confidence"),
            F.array(where).alias("spans"),
            (evidence if full else F.lit(None).cast("struct<item_id:string,entity_type:string,canonical_label:string,detector:string>")).alias("evidence"),
        )

    return F.transform(spans, one)


def system_finding(check_id: str, category: str, severity_name: str, reason: str, **evidence: Column) -> Column:
    """A finding without spans: a missing session, a failed analysis, models that are not ready."""
    told = F.struct(F.lit(reason).alias("reason"), *(c.alias(k) for k, c in evidence.items()))
    return F.struct(F.lit(check_id).alias("check_id"), F.lit(category).alias("category"), F.lit(severity_name).alias("severity"), F.lit(1.0).alias("confidence"), told.alias("evidence"))


def analysis_failed(errors: Column | None = None) -> Column:
    """An analysis that failed; ``errors`` (messages by detector) in full scope only."""
    told = F.lit(None).cast("map<string,string>") if errors is None else errors
    return system_finding("analysis", "system", "critical", "analysis_failed", detector_errors=told)


def models_not_ready(error: Column | None = None) -> Column:
    told = F.lit(None).cast("string") if error is None else F.coalesce(error, F.lit(""))
    return system_finding("models", "system", "critical", "models_not_ready", load_error=told)


def missing_session(session_id: Column) -> Column:
    return system_finding("reversible_mask_session", "session", "high", "missing_or_expired_session", session_id=session_id)
