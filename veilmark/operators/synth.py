"""Synthetic labelled documents and ablations. Rows are planned by columns; only the text of a row is built in Python, seeded by the row."""

from __future__ import annotations

import csv
import io
import json
import random
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilmark.functions.rows import each
from veilmark.operators.sampling import largest_remainder
from veilmark.operators.spans import overlaps

SPAN_FIELDS = "array<struct<start:int,end:int,label:string,placement:string>>"
SCHEMA = f"id string, source_text string, privacy_mask {SPAN_FIELDS}, language string, format string, length_bucket string, placement_profile string, length_chars int, entity_count int, pii_density_per_10k double, seed long"

# Lengths of the buckets in characters, spans in a row, margins of a placement.
BUCKETS = {"10k": 10_000, "50k": 50_000, "100k": 100_000, "250k": 250_000, "1m": 1_000_000}
FORMATS = ["plain", "jsonl", "python", "javascript", "csv", "json"]
PROFILES = ["head", "middle", "tail", "spread"]
ALWAYS = ["email", "ip", "identifier", "secret"]
OFTEN = [("person", 0.85), ("location", 0.85), ("phone", 0.85), ("payment_card", 0.15)]
FILL = ["person", "email", "phone", "location", "date", "identifier", "ip", "url", "secret"]
COUNTS = {"10k": (15, 40), "50k": (15, 40), "100k": (25, 60), "250k": (40, 80), "1m": (40, 80)}

_FIRST = ["Anna", "Boris", "Clara", "David", "Elena", "Farid", "Greta", "Hugo"]
_LAST = ["Arlen", "Bergov", "Castell", "Dorin", "Elmar", "Fenwick", "Gorsky", "Hale"]
_STREETS = ["Lime Street", "Station Road", "River Lane", "Market Square"]
_FILLER = {
    "en": "the service wrote a record and then checked the queue before the next step was due".split(),
    "ru": "служба записала строку и затем проверила очередь до начала следующего шага".split(),
}


def _luhn(digits: str) -> str:
    total = sum(d if i % 2 else (2 * d) % 10 + 2 * d // 10 for i, d in enumerate(map(int, reversed(digits))))
    return digits + str(-total % 10)


def value(label: str, r: random.Random) -> str:
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    made = {
        "person": lambda: f"{r.choice(_FIRST)} {r.choice(_LAST)}",
        "email": lambda: f"{r.choice(_FIRST).lower()}.{r.choice(_LAST).lower()}{n(3)}@example.com",
        "phone": lambda: f"+7 9{n(2)} {n(3)}-{n(2)}-{n(2)}",
        "location": lambda: f"{r.choice(_STREETS)} {r.randint(1, 99)}",
        "date": lambda: f"20{n(2)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
        "identifier": lambda: f"{n(3)}-{n(3)}-{n(3)} {n(2)}",
        "payment_card": lambda: _luhn("4" + n(14)),
        "ip": lambda: ".".join(str(r.randint(1, 254)) for _ in range(4)),
        "url": lambda: f"https://example.org/{n(6)}",
        "secret": lambda: "ghp_" + "".join(r.choice("ABCDEFabcdef0123456789") for _ in range(36)),
        "organization": lambda: f"{r.choice(_LAST)} Ltd",
    }
    return made[label]()


@dataclass
class _Text:
    """A text under construction that knows where its values are."""

    parts: list[str]
    spans: list[dict]
    size: int = 0

    def say(self, s: str) -> None:
        self.parts.append(s)
        self.size += len(s)

    def name(self, label: str, s: str, placement: str) -> None:
        self.spans.append({"start": self.size, "end": self.size + len(s), "label": label, "placement": placement})
        self.say(s)


def _record(t: _Text, fmt: str, words: list[str], item: tuple[str, str, str] | None, i: int) -> None:
    """One line of filler, with a value in it if there is one; its place is known as it is written."""
    text = " ".join(words)
    quoted = lambda s: json.dumps(s, ensure_ascii=False)[1:-1]
    if fmt == "csv":
        row = io.StringIO()
        csv.writer(row, lineterminator="").writerow([i, text])
        t.say(row.getvalue() + ",")
        t.name(item[0], item[1].replace(",", " "), item[2]) if item else t.say("-")
    else:
        before, after = {
            "plain": (f"[{i}] {text}: ", ""),
            "jsonl": (f'{{"n": {i}, "text": "{quoted(text)}", "value": "', '"}'),
            "json": (f'  {{"n": {i}, "text": "{quoted(text)}", "value": "', '"},'),
            "python": (f"# {text}\nvalue_{i} = '", "'"),
            "javascript": (f"// {text}\nconst value{i} = '", "';"),
        }[fmt]
        t.say(before)
        t.name(*item) if item else t.say("none")
        t.say(after)
    t.say("\n")


def build(seed: int, language: str, fmt: str, bucket: str, profile: str, negative: bool) -> tuple[str, list[dict]]:
    r, size = random.Random(seed), BUCKETS[bucket]
    labels: list[str] = []
    if not negative:
        labels = ALWAYS + [x for x, p in OFTEN if r.random() < p]
        labels += r.choices(FILL, k=max(0, r.randint(*COUNTS[bucket]) - len(labels)))
        r.shuffle(labels)
    low, high = {"head": (0.0, 0.2), "middle": (0.4, 0.6), "tail": (0.8, 0.99), "spread": (0.0, 0.99)}[profile]
    at = sorted(r.uniform(low, high) * size for _ in labels)
    t, i, k = _Text([], []), 0, 0
    if fmt == "json":
        t.say("[\n")
    while t.size < size or k < len(labels):
        item = None
        if k < len(labels) and (t.size >= at[k] or t.size >= size):
            item = (labels[k], value(labels[k], r), profile)
            k += 1
        _record(t, fmt, r.choices(_FILLER[language], k=r.randint(4, 12)), item, i)
        i += 1
    if fmt == "json":
        t.say('  {"n": -1}\n]\n')
    return "".join(t.parts), t.spans


def schedule(spark: SparkSession, rows: int | DataFrame, seed: int, buckets: dict[str, float] | None = None, negative_every: int = 10) -> DataFrame:
    """What each row is to be: languages and formats in turn, buckets by largest remainder, every tenth row without values.

    ``rows`` is how many, or a table of their numbers ``id``; then buckets are met in proportion, by a hash of the number.
    """
    buckets = buckets or {"10k": 4, "50k": 2, "100k": 1, "250k": 0.5, "1m": 0.25}
    counted = isinstance(rows, int)
    counts = largest_remainder(rows if counted else 1_000, buckets)
    place = F.col("id") if counted else F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1_000))
    edge, bucket = 0, F.lit(None).cast("string")
    for name, n in counts.items():
        edge += n
        bucket = F.coalesce(bucket, F.when(place < edge, name))
    turn = lambda xs: F.get(F.array(*map(F.lit, xs)), F.pmod(F.col("id"), F.lit(len(xs))).cast("int"))
    return (spark.range(rows) if counted else rows).select(
        "id", F.xxhash64("id", F.lit(seed)).alias("seed"), turn(["en", "ru"]).alias("language"), turn(FORMATS).alias("format"), bucket.alias("length_bucket"),
        turn(PROFILES).alias("placement_profile"), (F.pmod("id", F.lit(negative_every)) == negative_every - 1).alias("negative"),
    )


def generate(spark: SparkSession, rows: int | DataFrame, seed: int = 1, **options) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                text, spans = build(r.seed, r.language, r.format, r.length_bucket, r.placement_profile, r.negative)
                row = (f"syn-{r.id}", text, spans, r.language, r.format, r.length_bucket, r.placement_profile, len(text), len(spans), round(len(spans) / (len(text) / 10_000), 6), r.seed)
                yield pd.DataFrame([row], columns=[x.split()[0] for x in SCHEMA.replace(SPAN_FIELDS, "spans").split(", ")])

    return schedule(spark, rows, seed, **options).repartition("id").mapInPandas(run, SCHEMA)


def violations(spans: Column, size: Column) -> Column:
    """Spans out of bounds, empty, or overlapping another."""
    return F.size(F.filter(spans, lambda s, i: (s["start"] < 0) | (s["end"] > size) | (s["end"] <= s["start"]) | F.exists(F.slice(spans, F.lit(1), i), lambda o: overlaps(s, o))))


def shifted(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda s: s.withField("start", s["start"] + by).withField("end", s["end"] + by))


def padded(text: Column, spans: Column, placement: str, target: int, filler: str = "lorem ipsum dolor ") -> Column:
    """``struct<text,spans>``: the text at the head, in the middle or at the tail of filler up to ``target`` characters."""
    missing = F.greatest(F.lit(target) - F.length(text), F.lit(0))
    before = {"head": F.lit(0), "middle": (missing / 2).cast("int"), "tail": missing}[placement]
    pad = lambda n: F.substring(F.repeat(F.lit(filler), (n / len(filler)).cast("int") + 1), F.lit(1), n)
    return F.struct(F.concat(pad(before), text, pad(missing - before)).alias("text"), shifted(spans, before).alias("spans"))


def concatenated(rows: DataFrame, group: str, order: str, separator: str = "\n\n") -> DataFrame:
    """Texts of a group joined in order, spans moved along."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("text") + len(separator)).over(w), F.lit(0)).cast("int")
    moved = rows.withColumn("spans", shifted(F.col("spans"), before))
    got = F.sort_array(F.collect_list(F.struct(order, "text", "spans")))
    return moved.groupBy(group).agg(
        F.array_join(F.transform(got, lambda r: r["text"]), separator).alias("text"), F.flatten(F.transform(got, lambda r: r["spans"])).alias("spans")
    )


def placement_audit(rows: DataFrame, margin: float = 0.25) -> DataFrame:
    """Per profile: spans, and those outside the part of the text that the profile stands for."""
    s = each(rows, "spans", "s", "placement_profile", "length_chars").withColumn("at", F.col("s.start") / F.greatest("length_chars", F.lit(1)))
    out = F.when(F.col("placement_profile") == "head", F.col("at") > margin).when(F.col("placement_profile") == "tail", F.col("at") < 1 - margin)
    out = F.coalesce(out.when(F.col("placement_profile") == "middle", F.abs(F.col("at") - 0.5) > margin), F.lit(False))
    return s.groupBy("placement_profile").agg(F.count(F.lit(1)).alias("spans"), F.count_if(out).alias("violations"))


def placement_deciles(rows: DataFrame, profile: str = "placement_profile") -> DataFrame:
    at = F.least(F.floor(F.col("s.start") / F.greatest("length_chars", F.lit(1)) * 10), F.lit(9)).cast("int")
    return each(rows, "spans", "s", profile, "length_chars").groupBy(profile, at.alias("decile")).agg(F.count(F.lit(1)).alias("n"))


def boundary_effects(rows: DataFrame, boundary: int) -> DataFrame:
    """How a window boundary changes what is found around it: spans across, before and after, and their lengths."""
    side = F.when((F.col("s.start") < boundary) & (F.col("s.end") > boundary), "across").when(F.col("s.end") <= boundary, "before").otherwise("after")
    return each(rows, "spans", "s").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s.end") - F.col("s.start")).alias("chars"))
