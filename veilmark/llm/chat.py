"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A record is a JSON object, or a row of a table. Its nested paths are those of all its fields, at any depth and of all elements of its
lists (as ``messages[].role``); a null field counts as a field. Each layout lists the paths it requires, and the fingerprint of a record for a layout is the hash of
those of its paths that the layout requires; the first layout whose own fingerprint that is reads the record. Fields beyond them (an id, a source, a name
beside a role) are ignored, and an empty list has whatever its elements would need. Records have fingerprints each, tables one for all their rows, so columns need no JSON.
The mapping that a fingerprint selects is SQL over the record: it gives an array of ``(turn, role, text)``. Records of one conversation are then joined in order.

The template is ChatML: ``<|im_start|>role\\ntext<|im_end|>\\n``. A control string inside a text gets a backslash after its
first character, one more if it already has some, so texts hold no control string and are restored
exactly. The loss mask is the list of character ranges of the assistants' texts in the formatted string.

All of it is DataFrame expressions. One conversation is one output row, hence one value of at most 2 GB: its turns must meet
in one place because the digest and the format are sequential; conversations are spread by ``conv_id``.

Defined cases: null text is empty; null role is the empty role; a null ``conv_id`` is one conversation of its own; turns of
equal number are ordered by role and text and all are kept; an element of a list without a field that others have has null there; unknown layouts
give no turns, have ``layout`` null and are counted by ``layouts``; a record that is no JSON, or whose values do not fit its layout, or beyond the 128 MB of a variant, is an error (texts in columns
have no such limit but that of a value); repeated rows are turns of their own; an empty table gives no rows (but the added conversation); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.functions.texts import let
from veilmark.llm.common import read_table

TURNS = "array<struct<turn:bigint,role:string,text:string>>"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of usual templates; none is left as it is inside a text.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_FIRST, _REST = r"([<\[])", "|".join("".join("\\" + c if not c.isalnum() and c != "_" else c for c in s[1:]) for s in CONTROLS)

#: Layouts: required paths, optional ones, the schema, and the SQL that gives the turns of ``r`` (the record parsed by the schema).
LAYOUTS: dict[str, tuple[list[str], list[str], str, str]] = {
    "turn": (
        ["conv_id", "role", "text", "turn"], [],
        "conv_id bigint, turn bigint, role string, text string",
        "array(struct(r.turn AS turn, r.role AS role, r.text AS text))",
    ),
    "messages": (
        ["conv_id", "messages", "messages[].content", "messages[].role"], [],
        "conv_id bigint, messages array<struct<role:string,content:string>>",
        "transform(r.messages, (m, i) -> struct(CAST(i AS bigint) AS turn, m.role AS role, m.content AS text))",
    ),
    "sharegpt": (
        ["conv_id", "conversations", "conversations[].from", "conversations[].value"], ["system"],
        "conv_id bigint, system string, conversations array<struct<`from`:string,value:string>>",
        "concat(IF(r.system IS NULL, array(), array(struct(CAST(-1 AS bigint) AS turn, 'system' AS role, r.system AS text))), "
        "transform(r.conversations, (m, i) -> struct(CAST(i AS bigint) AS turn, "
        "CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END AS role, m.value AS text)))",
    ),
    "prompt": (
        ["conv_id", "prompt", "response"], ["system"],
        "conv_id bigint, system string, prompt string, response string",
        "concat(IF(r.system IS NULL, array(), array(struct(CAST(-1 AS bigint) AS turn, 'system' AS role, r.system AS text))), "
        "array(struct(CAST(0 AS bigint) AS turn, 'user' AS role, r.prompt AS text), struct(CAST(1 AS bigint) AS turn, 'assistant' AS role, r.response AS text)))",
    ),
    "instruction": (
        ["conv_id", "instruction", "output"], ["input", "system"],
        "conv_id bigint, system string, instruction string, input string, output string",
        "concat(IF(r.system IS NULL, array(), array(struct(CAST(-1 AS bigint) AS turn, 'system' AS role, r.system AS text))), "
        "array(struct(CAST(0 AS bigint) AS turn, 'user' AS role, concat_ws('\\n\\n', r.instruction, nullif(r.input, '')) AS text), "
        "struct(CAST(1 AS bigint) AS turn, 'assistant' AS role, r.output AS text)))",
    ),
}
#: Spark's JSON functions without options read no string beyond 20,000,000 characters.
_READ = {"mode": "FAILFAST", "maxStringLen": str(2**31 - 1)}
_SCALARS = r": (?:BIGINT|BOOLEAN|DATE|DECIMAL\(\d+, ?\d+\)|DOUBLE|STRING|VARIANT|VOID)(?=[,>])"


#: A shape's parts: what opens and closes a level, and the fields' names, which are quoted if they are odd.
_PARTS = r"ARRAY<|OBJECT<|>|`(?:[^`]|``)*`|[^<>,:\s`]+"


def paths(record: Column) -> Column:
    """The nested paths of a JSON record, different and in order; ``x[]`` stands for an empty list ``x`` too."""
    shape = F.regexp_replace(F.schema_of_variant(F.from_json(record, "variant", _READ)), _SCALARS, "")
    zero = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("above"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, part: Column) -> Column:
        into = F.when(part == "ARRAY<", F.concat(a["last"], F.lit("[]"))).otherwise(a["last"])
        inner = F.coalesce(F.try_element_at(a["above"], F.lit(-1)), F.lit(""))
        path = F.concat(F.when(inner == "", "").otherwise(F.concat(inner, F.lit("."))), F.regexp_replace(part, "^`|`$", ""))
        opened = F.struct(into.alias("last"), F.concat(a["above"], F.array(into)).alias("above"), F.when(part == "ARRAY<", F.concat(a["out"], F.array(into))).otherwise(a["out"]).alias("out"))
        closed = F.struct(inner.alias("last"), F.slice(a["above"], F.lit(1), F.greatest(F.size(a["above"]) - 1, F.lit(0))).alias("above"), a["out"].alias("out"))
        named = let(path, lambda p: F.struct(p.alias("last"), a["above"].alias("above"), F.concat(a["out"], F.array(p)).alias("out")))
        return F.when(part.isin("ARRAY<", "OBJECT<"), opened).when(part == ">", closed).otherwise(named)

    found = F.aggregate(F.regexp_extract_all(shape, F.lit(_PARTS), F.lit(0)), zero, step)["out"]
    return F.array_sort(F.array_distinct(found))


def _digest(names: list[str]) -> str:
    return hashlib.md5("\n".join(sorted(names)).encode()).hexdigest()


def fingerprint(found: Column, need: list[str]) -> Column:
    """Hash of those of a record's paths that a layout requires; null if a value that it requires is an object or a list.

    What an empty list lacks counts as found.
    """
    lists = {p.split("[]")[0] for p in need if "[]" in p}
    given = found
    for name in sorted(lists):
        inside = F.array(*(F.lit(p) for p in sorted(need) if p.startswith(f"{name}[]")))
        given = F.when(F.array_contains(found, f"{name}[].VOID"), F.array_union(given, inside)).otherwise(given)
    values = [p for p in need if not any(q.startswith((f"{p}.", f"{p}[")) for q in need)]
    plain = ~F.exists(found, lambda p: reduce(or_, (F.startswith(p, F.lit(v + c)) for v in values for c in ".[")))
    return F.when(plain, F.md5(F.array_join(F.array_sort(F.array_intersect(given, F.array(*map(F.lit, sorted(need))))), "\n").cast("binary")))


def _table_paths(kind: T.StructType, above: str = "") -> list[str]:
    """The same paths of a table's or a column's type."""
    out = []
    for f in kind.fields:
        t, path = f.dataType, above + f.name
        out.append(path)
        if isinstance(t, T.ArrayType):
            t, path = t.elementType, path + "[]"
            out.append(path)
        if isinstance(t, T.StructType):
            out += _table_paths(t, path + ".")
    return out


def canonical_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """``(conv_id, layout, turns)`` per record."""
    df = records.select(F.col(record).alias("record")).withColumn("paths", paths(F.col("record")))
    layout = F.lit(None).cast("string")
    for name, (need, *_) in reversed(LAYOUTS.items()):
        layout = F.when(fingerprint(F.col("paths"), need) == _digest(need), name).otherwise(layout)
    df = df.withColumn("layout", layout)
    turns = conv = None
    for name, (_, _, schema, sql) in LAYOUTS.items():
        col = f"r_{name}"
        df = df.withColumn(col, F.when(F.col("layout") == name, F.from_json("record", schema, _READ)))
        own, cid = F.expr(sql.replace("r.", f"{col}.")).cast(TURNS), F.col(f"{col}.conv_id")
        chosen = F.col("layout") == name
        turns, conv = (turns.when(chosen, own), conv.when(chosen, cid)) if turns is not None else (F.when(chosen, own), F.when(chosen, cid))
    return df.select(conv.alias("conv_id"), "layout", F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


def turns_of_table(rows: DataFrame) -> DataFrame:
    """The same for a table whose columns are the fields of a record."""
    found = set(_table_paths(rows.schema))
    values = lambda need: [p for p in need if not any(q.startswith((f"{p}.", f"{p}[")) for q in need)]
    plain = lambda need: not any(q.startswith((f"{v}.", f"{v}[")) for v in values(need) for q in found)
    name = next((layout for layout, (need, *_) in LAYOUTS.items() if plain(need) and _digest([p for p in need if p in found]) == _digest(need)), None)
    if name is None:
        return rows.select(F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("string").alias("layout"), F.array().cast(TURNS).alias("turns"))
    _, _, schema, sql = LAYOUTS[name]
    wanted = T.StructType.fromDDL(schema).fieldNames()
    r = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns if c in wanted)).alias("r"))
    for field in T.StructType.fromDDL(schema).fields:  # what the record leaves out is null
        if field.name not in rows.columns:
            r = r.withColumn("r", F.col("r").withField(f"`{field.name}`", F.lit(None).cast(field.dataType)))
    return r.select(F.col("r.conv_id").cast("long").alias("conv_id"), F.lit(name).alias("layout"), F.coalesce(F.expr(sql).cast(TURNS), F.array().cast(TURNS)).alias("turns"))


def layouts(turns: DataFrame) -> DataFrame:
    """How many records each layout read; ``layout`` null: those that none did."""
    return turns.groupBy("layout").agg(F.count(F.lit(1)).alias("records"), F.sum(F.size("turns")).alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_FIRST}(\\*)(?={_REST})", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_FIRST}(\\*)\\(?={_REST})", "$1$2")


def format_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss)`` of canonical turns; ``loss``: ranges ``(start, length)`` in characters, from 0."""
    own = F.transform("turns", lambda t: F.struct(t["turn"].alias("turn"), F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    convs = turns.select("conv_id", own.alias("turns")).groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list("turns"))).alias("turns"))
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            (t["role"] == "assistant").alias("loss"),
            F.concat(F.lit(OPEN), F.url_encode(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
        ),
    )
    convs = convs.select("conv_id", parts.alias("parts"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def step(acc: Column, p: Column) -> Column:
        head, body = F.length(p["head"]), F.length(p["body"])
        span = F.array(F.struct((acc["at"] + head).alias("start"), body.alias("length")))
        return F.struct((acc["at"] + head + body + len(CLOSE)).alias("at"), F.when(p["loss"], F.concat(acc["loss"], span)).otherwise(acc["loss"]).alias("loss"))

    return convs.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("parts", zero, step)["loss"].alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns ``(role, text)`` that a formatted string holds."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")
    at = lambda p: F.instr(p, "\n")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.url_decode(F.substr(p, F.lit(len(OPEN) + 1), at(p) - len(OPEN) - 1)).alias("role"), unescape(F.substr(p, at(p) + 1)).alias("text")
        ),
    )


def chat_digests(chats: DataFrame) -> DataFrame:
    """Per conversation, from the formatted string and its mask alone."""
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", "formatted", masked.alias("masked"), read_turns(F.col("formatted")).alias("back")).select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    said = "</s>[INST] ok [/INST]"
    turns = turns_of_table(rows.select(*(F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string")))))
    added = spark.range(1, numPartitions=1).select(F.to_json(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(said).alias("prompt"), F.lit(said).alias("response"))).alias("record"))
    return chat_digests(format_turns(turns.unionByName(canonical_turns(added))))


#: DuckDB SQL for the query.
ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *,
        """ + " + ".join(f"(len(string_split(text, '{c}')) - 1)" for c in CONTROLS) + r""" AS escapes FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + length(text) + escapes + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
