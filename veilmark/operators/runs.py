"""Runs of a policy: checked on the driver before any task starts, counted while they write, and timed.

Counts come from an observation of the very plan that writes, so nothing is read twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veilmark.operators.detect import KINDS, detect
from veilmark.operators.table_functions import TABLE_KINDS
from veilmark.sources.policy import PolicyFile

PROBE = "A short text to try a model with."
SINGLE = ("ip", "entropy", "phone")  # kinds whose spans carry the detector's id alone


class NotReady(RuntimeError):
    """Something that a run needs does not work; raised before any task starts."""


def ensure_ready(spark: SparkSession, policy: PolicyFile, name: str | None = None, loaders: dict[str, Callable] | None = None) -> list[str]:
    """The ids of the profile's detectors that will run. Patterns are compiled as the executors' Java will, and models answer a probe."""
    loaders, ready = loaders or {}, []
    for d in policy.detectors_of(policy.resolve(name).analyzer_profile):
        for p in d.patterns():
            try:
                spark._jvm.java.util.regex.Pattern.compile(p.regex)
            except Exception as e:
                raise NotReady(f"detector {d.id}: pattern {p.name} is no expression") from e
        if d.id in loaders:
            _probe(d.id, loaders[d.id])
        elif d.kind not in KINDS and d.kind not in TABLE_KINDS:
            continue  # a model that is not plugged in here
        ready.append(d.id)
    if missing := [i for i in loaders if i not in ready]:
        raise NotReady(f"models without a detector in the profile: {missing}")
    return ready


def _probe(detector: str, load: Callable) -> None:
    try:
        answer = list(load()([PROBE]))
    except Exception as e:
        raise NotReady(f"detector {detector}: the model does not answer") from e
    if len(answer) != 1:
        raise NotReady(f"detector {detector}: {len(answer)} answers to one text")
    for span in answer[0]:
        if len(span) != 4 or not 0 <= span[0] < span[1] <= len(PROBE) or not isinstance(span[2], str) or not 0 <= float(span[3]) <= 1:
            raise NotReady(f"detector {detector}: {span!r} is no (start, end, label, score) within the text")


def detector_names(policy: PolicyFile, name: str | None = None) -> list[str]:
    """What spans of a profile may carry as ``detector``."""
    out = []
    for d in policy.detectors_of(policy.resolve(name).analyzer_profile):
        out += [d.id] if d.kind in SINGLE else [f"{d.id}:{p.label}" for p in d.patterns()]
    return list(dict.fromkeys(out))


def run_detection(df: DataFrame, policy: PolicyFile, write: Callable[[DataFrame], None], name: str | None = None, text: str = "text", extra: Column | None = None, loaders: dict[str, Callable] | None = None) -> dict:
    """Detects, writes by ``write(detected)``, and tells ``rows``, ``characters``, ``spans``, ``detectors`` (spans by detector) and ``elapsed_seconds``."""
    ensure_ready(df.sparkSession, policy, name, loaders)
    found, names, seen = detect(df, policy, name, text, extra), detector_names(policy, name), Observation("detection")
    of = lambda d: F.sum(F.size(F.filter("spans", lambda s: s["detector"] == d)))
    all_of = F.sum(F.size("spans"))
    watched = found.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.length(text)).alias("characters"), all_of.alias("spans"), *(of(d).alias(f"d{i}") for i, d in enumerate(names)))
    begun = time.perf_counter()
    write(watched)
    took, got = time.perf_counter() - begun, seen.get
    counts = {d: got[f"d{i}"] or 0 for i, d in enumerate(names)}
    return {"rows": got["rows"], "characters": got["characters"] or 0, "spans": got["spans"] or 0, "detectors": {d: n for d, n in counts.items() if n}, "elapsed_seconds": round(took, 6)}
