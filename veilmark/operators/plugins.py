"""Detectors that need a model: run by Arrow batches, loaded once per worker, failing closed.

A model gives, for each window text, predictions ``(start, end, label, score)``. Windows are made by ``spans.chunk_windows``; what
comes back is filtered, shifted, deduplicated and mapped by columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.labels import collapse_name, detection_label_name
from veilmark.functions.texts import cut, let
from veilmark.operators.spans import SPANS, chunk_windows, span
from veilmark.sources.policy import Detector

RAW = "array<struct<start:int,end:int,label:string,score:double>>"
#: Loads a model in the worker; the model maps texts to lists of (start, end, label, score).
Loader = Callable[[], Callable[[list[str]], Iterable[list[tuple[int, int, str, float]]]]]

# Imperatives that a name recognizer takes for persons at the start of a Russian sentence.
IMPERATIVES = [
    "перескажи", "расскажи", "напиши", "составь", "придумай", "объясни", "переведи", "отредактируй", "сократи", "продолжи", "перефразируй",
]


@dataclass(frozen=True)
class ClassifierParams:
    threshold: float = 0.4
    labels: tuple[str, ...] = ()
    label_mapping: dict[str, str] = field(default_factory=dict)
    entity_thresholds: dict[str, float] = field(default_factory=dict)
    raw_label_thresholds: dict[str, float] = field(default_factory=dict)
    window: int = 510
    overlap: int | None = None

    @classmethod
    def of(cls, detector: Detector) -> ClassifierParams:
        """The parameters that a policy file gives a token classifier."""
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in detector.params.items() if k in cls.__dataclass_fields__}
        return cls(**known)

    def gate(self) -> tuple[dict[str, str], dict[str, float]]:
        """Entity type and least score by raw label: a type's own threshold, else the raw label's, else the common one."""
        types = {k.lower(): collapse_name(v) for k, v in self.label_mapping.items()}
        by_type: dict[str, float] = {}
        for k, v in self.entity_thresholds.items():
            by_type[collapse_name(k)] = v  # of names that collapse to one type the last counts
        raw = {k.lower(): v for k, v in self.raw_label_thresholds.items()}
        names = set(types) | {x.lower() for x in self.labels}
        return types, {n: by_type.get(types.get(n, collapse_name(n)), raw.get(n, self.threshold)) for n in names}


def raw_label(label: Column) -> Column:
    """A label without the mark for beginning or inside."""
    return F.lower(F.regexp_replace(label, "(?i)^[BI]-", ""))


def merge_windows(windows: Column, predictions: Column) -> Column:
    """Predictions of all windows in the text's offsets; of equal ones the best score; in order."""
    shifted = F.flatten(
        F.zip_with(
            windows,
            predictions,
            lambda w, ps: F.transform(
                F.filter(ps, lambda p: (p["start"] >= 0) & (p["end"] > p["start"]) & (w["start"] + p["end"] <= w["end"])),
                lambda p: F.struct((w["start"] + p["start"]).alias("start"), (w["start"] + p["end"]).alias("end"), p["label"].alias("label"), p["score"].alias("score")),
            ),
        )
    )
    best = F.sort_array(F.transform(shifted, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["label"].alias("label"), (-p["score"]).alias("n"))))
    key = lambda p: F.struct(p["start"], p["end"], p["label"])
    first = let(best, lambda b: F.filter(b, lambda p, i: (i == 0) | (key(p) != key(F.get(b, i - 1)))))
    return F.transform(first, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["label"].alias("label"), (-p["n"]).alias("score")))


def gated(predictions: Column, params: ClassifierParams, detector: str) -> Column:
    """Predictions of allowed labels over their thresholds, as spans."""
    types, least = params.gate()
    labels = list(params.labels) or sorted(types)
    as_map = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    kept = F.filter(
        predictions,
        lambda p: (p["score"] >= params.threshold)
        & (raw_label(p["label"]).isin([x.lower() for x in labels]) if labels else F.lit(True))
        & (p["score"] >= (F.coalesce(F.try_element_at(as_map(least), raw_label(p["label"])), F.lit(params.threshold)) if least else F.lit(params.threshold))),
    )
    kind = lambda p: F.coalesce(F.try_element_at(as_map(types), raw_label(p["label"])), F.upper(raw_label(p["label"]))) if types else F.upper(raw_label(p["label"]))
    canonical = {t: c for t in set(types.values()) if (c := detection_label_name(t))}
    to_label = lambda k: F.try_element_at(as_map(canonical), k) if canonical else F.lit(None).cast("string")
    return F.transform(kept, lambda p: span(p["start"], p["end"], kind(p), p["score"], F.concat(F.lit(detector + ":"), kind(p)), to_label(kind(p))))


def classify_tokens(df: DataFrame, load: Loader, params: ClassifierParams, detector: str, text: str = "text") -> DataFrame:
    """``df`` with ``model_spans``. Any error of the model fails the query: nothing is passed on unseen."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            flat = [t for row in texts for t in row]
            found = list(model(flat)) if flat else []
            if len(found) != len(flat):
                raise RuntimeError("the model gave no answer for some windows")
            it = iter(found)
            yield pd.Series([[[{"start": s, "end": e, "label": x, "score": float(c)} for s, e, x, c in next(it)] for _ in row] for row in texts])

    # not deterministic to the optimizer, so that it is neither copied nor moved into a lambda, where Python cannot be called
    predict = F.pandas_udf(run, f"array<{RAW}>").asNondeterministic()
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_w", chunk_windows(t, params.window, params.overlap))
    df = df.withColumn("_p", predict(F.transform("_w", lambda w: cut(t, w["start"], w["end"]))))
    return df.withColumn("model_spans", gated(merge_windows(F.col("_w"), F.col("_p")), params, detector).cast(SPANS)).drop("_w", "_p")


def sentence_start(text: Column, start: Column) -> Column:
    before = F.regexp_replace(F.substring(text, F.lit(1), start), "\\s+\\z", "")
    return (before == "") | before.rlike("[.!?:;]\\z")


def plausible_person(text: Column, start: Column, end: Column, least: int = 3) -> Column:
    """False for short names and for imperatives at the start of a sentence."""
    words = F.regexp_extract_all(cut(text, start, end), F.lit("\\p{L}+"), F.lit(0))
    imperative = (F.size(words) == 1) & sentence_start(text, start) & F.lower(F.get(words, F.lit(0))).isin(IMPERATIVES)
    return (F.size(words) > 0) & (F.length(F.array_join(words, "")) >= least) & ~imperative
