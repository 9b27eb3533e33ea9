"""Reports: run tags, metric tables as JSON and CSV, and a short Markdown page."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame

REPORT_VERSION = "3.0"


def run_tag(config: dict) -> str:
    """Ten hex digits that are the same for the same configuration, whatever the order of its keys."""
    return hashlib.sha1(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:10]


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One row per family and label, below ``metrics.csv`` and ``report.json``."""
    one = metrics.coalesce(1)  # a row per family and label
    one.write.mode("overwrite").option("header", "true").csv(f"{path}/metrics.csv")
    one.write.mode("overwrite").json(f"{path}/report.json")


def markdown(header: dict, metrics: DataFrame) -> str:
    """The report as a page; its rows are one per family and label."""
    rows = sorted(metrics.collect(), key=lambda r: (r["family"], r["label"] or ""))
    lines = ["# Detection report", "", *(f"- {k}: `{v}`" for k, v in header.items()), "", "| family | label | tp | fp | fn | precision | recall | f1 |", "|-|-|-|-|-|-|-|-|"]
    lines += [f"| {r['family']} | {r['label'] or ''} | {r['tp']} | {r['fp']} | {r['fn']} | {r['precision']:.4f} | {r['recall']:.4f} | {r['f1']:.4f} |" for r in rows]
    return "\n".join(lines) + "\n"
