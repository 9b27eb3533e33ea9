"""Datasets of texts with gold spans: scan, projection to samples, label mapping; and writers of samples."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilmark.functions.labels import CANONICAL, known_label
from veilmark.functions.texts import script_profile

GOLD = "array<struct<start:int,end:int,label:string,canonical:string>>"
#: Fields that identify a row, first that is not null.
ID_FIELDS = ["source_uid", "source_row_idx", "id", "local_idx"]
COMMON_FIELDS = ["language", "script_profile", "format", "length_bucket", "entity_count"]


@dataclass(frozen=True)
class DatasetSpec:
    dataset_id: str
    text_field: str = "source_text"
    spans_field: str = "privacy_mask"
    label_map: dict[str, str] = field(default_factory=dict)
    scored_labels: tuple[str, ...] = CANONICAL
    slice_fields: tuple[str, ...] = ()

    @property
    def slug(self) -> str:
        return re.sub(r"[^a-z0-9]+", "_", self.dataset_id.lower()).strip("_")


@dataclass(frozen=True)
class Registry:
    datasets: dict[str, DatasetSpec]
    suites: dict[str, list[str]]
    default_split: str = "fast"


def parse_registry(raw: dict) -> Registry:
    if raw.get("version", 1) != 1:
        raise ValueError("the registry's version must be 1")
    datasets = {}
    for name, d in (raw.get("datasets") or {}).items():
        known = {k: (tuple(v) if isinstance(v, list) else v) for k, v in d.items() if k in DatasetSpec.__dataclass_fields__}
        datasets[name] = DatasetSpec(**({"dataset_id": name} | known))
    suites = {n: list(s.get("datasets", s) if isinstance(s, dict) else s) for n, s in (raw.get("suites") or {}).items()}
    for name, ids in suites.items():
        if missing := [i for i in ids if i not in datasets]:
            raise ValueError(f"suite {name}: unknown datasets {missing}")
    return Registry(datasets, suites, raw.get("default_split", "fast"))


def load_registry(path: str) -> Registry:
    from pathlib import Path

    import yaml

    return parse_registry(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})


def read_rows(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """Parquet, or JSON lines by the path's ending; a schema avoids a pass to infer one."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path) if re.search(r"\.jsonl?(\.gz)?$", path) else reader.parquet(path)


def gold_label(label: Column, label_map: dict[str, str]) -> Column:
    """By the map as written, then upper-cased, else the label itself if it is canonical."""
    if not label_map:
        return known_label(label)
    m = F.create_map(*(F.lit(x) for kv in label_map.items() for x in kv))
    return F.coalesce(known_label(F.try_element_at(m, label)), known_label(F.try_element_at(m, F.upper(label))), known_label(label))


def gold_spans(spans: Column, label_map: dict[str, str]) -> Column:
    """Spans with both bounds and a length, with their canonical labels."""
    good = F.filter(spans, lambda s: s["start"].isNotNull() & s["end"].isNotNull() & (s["end"] > s["start"]))
    as_gold = lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["label"].alias("label"), gold_label(s["label"], label_map).alias("canonical"))
    return F.coalesce(F.transform(good, as_gold), F.array().cast(GOLD)).cast(GOLD)


def samples(rows: DataFrame, spec: DatasetSpec, split: str, max_samples: int | None = None) -> DataFrame:
    """``(sample_id, text, gold, labels, entity_count, dataset, <slice fields>)``."""
    ids = [F.col(c).cast("string") for c in ID_FIELDS if c in rows.columns]
    uid = F.coalesce(*ids) if ids else F.sha1(F.col(spec.text_field).cast("binary"))
    fields = [c for c in dict.fromkeys([*spec.slice_fields, *COMMON_FIELDS]) if c in rows.columns and c != "entity_count"]
    text = F.coalesce(F.col(spec.text_field), F.lit(""))
    gold = gold_spans(F.col(spec.spans_field), spec.label_map)
    out = rows.select(
        F.concat_ws("::", F.lit(spec.slug), F.lit(split), uid).alias("sample_id"),
        text.alias("text"),
        gold.alias("gold"),
        (F.coalesce(F.col("entity_count"), F.size(gold)) if "entity_count" in rows.columns else F.size(gold)).alias("entity_count"),
        F.lit(spec.dataset_id).alias("dataset"),
        *(F.col(c).cast("string").alias(c) for c in fields),
    ).withColumn("labels", F.array_distinct(F.filter(F.transform("gold", lambda s: s["canonical"]), lambda x: x.isNotNull())))
    if "script_profile" not in out.columns:
        out = out.withColumn("script_profile", script_profile(F.col("text")))
    return out if max_samples is None else out.orderBy("sample_id").limit(max_samples)


def write_samples(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet or JSON lines."""
    (df.write.mode("overwrite").json(path) if kind == "jsonl" else df.write.mode("overwrite").parquet(path))


def write_with_manifest(df: DataFrame, path: str, kind: str, meta: dict) -> None:
    """A data set in ``data``, the names, lengths and digests of its files in ``manifest``, and what made it in ``meta``."""
    spark, root = df.sparkSession, path.rstrip("/")
    write_samples(df, f"{root}/data", kind)
    manifest = checksum_manifest(spark, f"{root}/data").where(~F.col("name").rlike("(^|/)[_.]"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{root}/manifest")  # a row a file
    told = json.dumps(meta | {"columns": df.columns, "kind": kind}, ensure_ascii=False, sort_keys=True)
    spark.range(1, numPartitions=1).select(F.lit(told).alias("value")).write.mode("overwrite").text(f"{root}/meta")


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files that are missing, new, or differ from the manifest, with what is wrong; none if the data set is whole."""
    root = path.rstrip("/")
    now = checksum_manifest(spark, f"{root}/data").where(~F.col("name").rlike("(^|/)[_.]")).select("name", F.col("sha256").alias("now"))
    then = spark.read.schema("name string, length long, sha256 string").json(f"{root}/manifest").select("name", F.col("sha256").alias("then"))
    wrong = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "new").when(F.col("now") != F.col("then"), "changed")
    return now.join(then, "name", "full").select("name", wrong.alias("wrong")).where("wrong is not null")


def checksum_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path below a folder, length and SHA-256 of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = F.regexp_replace(F.lit(path.rstrip("/")), "^[a-z]+:/+", "/")
    own = F.regexp_replace("path", "^[a-z]+:/+", "/")
    return files.select(F.substring(own, F.length(root) + 2, F.length(own)).alias("name"), F.col("length"), F.sha2("content", 256).alias("sha256")).orderBy("name")


def manifest_digest(manifest: DataFrame) -> DataFrame:
    """One digest of a manifest: SHA-256 of its sorted ``name:sha256`` lines, one row a file."""
    lines = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "name", "sha256"))), "\n")
    return manifest.agg(F.count(F.lit(1)).alias("files"), F.sha2(lines.cast("binary"), 256).alias("sha256"))
