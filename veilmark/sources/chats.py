"""Chat payloads: texts out of requests and responses, and masked texts back into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MESSAGES = "array<struct<role:string,content:string>>"


def flatten_messages(payloads: DataFrame, payload: str = "payload", session: str = "session_id") -> DataFrame:
    """``(session_id, item_idx, item_id, role, text)`` from JSON with ``messages[]``, ``choices[].message``, ``prompt`` or ``input``.

    Content may be a text or a list of typed parts, of which those with a text count.
    """
    part = "array<struct<type:string,text:string>>"
    raw = F.from_json(payload, "messages array<struct<role:string,content:string>>, choices array<struct<message:struct<role:string,content:string>>>, prompt string, input string")
    msgs = F.coalesce(raw["messages"], F.transform(raw["choices"], lambda c: c["message"]), F.array().cast(MESSAGES))
    single = F.filter(F.array(raw["prompt"], raw["input"]), lambda x: x.isNotNull())
    single = F.transform(single, lambda x: F.struct(F.lit("user").alias("role"), x.alias("content")))
    df = payloads.select(session, F.posexplode(F.concat(msgs, single)).alias("msg", "m"))
    parts = F.from_json("m.content", part)
    listed = F.startswith(F.ltrim("m.content"), F.lit("[")) & parts.isNotNull()
    texts = F.when(listed, F.filter(F.transform(parts, lambda p: p["text"]), lambda x: x.isNotNull())).otherwise(F.array("m.content"))
    df = df.where("m.content is not null").select(F.col(session).alias("session_id"), "msg", F.col("m.role").alias("role"), texts.alias("texts"))
    df = df.select("session_id", "msg", "role", F.size("texts").alias("parts"), F.posexplode("texts").alias("part", "text"))
    # a session's parts are numbered in order: those of the messages before, then its own
    before = F.coalesce(F.sum(F.when(F.col("part") == 0, F.col("parts"))).over(W.partitionBy("session_id").orderBy("msg").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("item_idx", (before + F.col("part")).cast("int")).select(
        "session_id", "item_idx", F.concat_ws(".", F.col("msg").cast("string"), F.col("part").cast("string")).alias("item_id"), "role", "text"
    )


def turns_as_items(conversations: DataFrame) -> DataFrame:
    """Rows by turn as items of a session."""
    return conversations.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("item_idx"), F.concat(F.lit("turn-"), F.col("turn").cast("string")).alias("item_id"), "role", F.coalesce("text", F.lit("")).alias("text")
    )


def nest_messages(items: DataFrame) -> DataFrame:
    """``(session_id, messages)`` of masked or restored items, in order."""
    ordered = F.sort_array(F.collect_list(F.struct("item_idx", "role", F.col("text").alias("content"))))
    return items.groupBy("session_id").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def write_back(payloads: DataFrame, items: DataFrame, payload: str = "payload", session: str = "session_id") -> DataFrame:
    """``payloads`` with the texts of ``items(session_id, item_id, text)`` in the places they came from; parts without a text stay as they are."""
    texts = items.groupBy(F.col("session_id").alias("_sid")).agg(F.map_from_entries(F.collect_list(F.struct("item_id", "text"))).alias("_texts"))
    df = payloads.join(texts, F.col(session) == F.col("_sid"), "left").withColumn("_texts", F.coalesce("_texts", F.create_map().cast("map<string,string>")))
    raw = F.from_json(payload, "messages array<struct<role:string,content:string>>, choices array<struct<message:struct<role:string,content:string>>>, prompt string, input string")
    new = lambda msg, part, old: F.coalesce(F.try_element_at("_texts", F.concat_ws(".", msg.cast("string"), F.lit(part) if isinstance(part, str) else part.cast("string"))), old)

    def content(old: Column, i: Column) -> Column:
        raws = F.from_json(old, "array<string>")
        said = lambda p: F.get_json_object(p, "$.text")
        # parts with a text are numbered in order; the number of one is how many stand before it
        number = lambda j: F.size(F.filter(F.slice(raws, F.lit(1), j), lambda p: said(p).isNotNull()))
        part = lambda p, j: F.when(said(p).isNull(), p).otherwise(F.to_json(F.struct(F.get_json_object(p, "$.type").alias("type"), new(i, number(j), said(p)).alias("text"))))
        listed = F.startswith(F.ltrim(old), F.lit("[")) & F.from_json(old, "array<struct<type:string,text:string>>").isNotNull()
        quoted = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
        whole = F.concat(F.lit("["), F.array_join(F.transform(raws, part), ","), F.lit("]"))
        return F.when(old.isNull(), F.lit("null")).when(listed, whole).otherwise(quoted(new(i, "0", old)))

    def message(m: Column, i: Column) -> Column:
        role = F.regexp_extract(F.to_json(F.struct(F.coalesce(m["role"], F.lit("")).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
        return F.concat(F.lit('{"role":'), role, F.lit(',"content":'), content(m["content"], i), F.lit("}"))

    listed = lambda parts: F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    out = (
        F.when(raw["messages"].isNotNull(), F.concat(F.lit('{"messages":'), listed(F.transform(raw["messages"], message)), F.lit("}")))
        .when(raw["choices"].isNotNull(), F.concat(F.lit('{"choices":'), listed(F.transform(raw["choices"], lambda c, i: F.concat(F.lit('{"message":'), message(c["message"], i), F.lit("}")))), F.lit("}")))
        .when(raw["prompt"].isNotNull(), F.to_json(F.struct(new(F.lit(0), "0", raw["prompt"]).alias("prompt"))))
        .when(raw["input"].isNotNull(), F.to_json(F.struct(new(F.lit(0), "0", raw["input"]).alias("input"))))
        .otherwise(F.col(payload))
    )
    return df.withColumn(payload, out).drop("_sid", "_texts")
