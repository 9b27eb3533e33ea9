"""Detectors as columns: a policy's patterns, addresses, phones and entropy over a text column, without Python workers.

A text is scanned once for the characters that tell which patterns can match (``operators.gates``); each of those is
run once, and offsets come from the lengths between the marks it leaves.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.labels import detection_label_name
from veilmark.functions.texts import card_signal, cut, digits, entropy, let
from veilmark.operators import phones
from veilmark.operators.gates import may_match, telling
from veilmark.operators.spans import MASKER_DEFAULT, MASKER_RANK, NORMALIZER_DEFAULT, NORMALIZER_RANK, RANGES, SPANS, drop_contained, normalized, running_ranges, span, union_merge
from veilmark.sources.policy import Detector, Pattern, PolicyFile

# Fixed values.
IP_CANDIDATE = r"(?<![A-Za-z0-9_])(?:[0-9A-Fa-f:.]{2,}(?:/[0-9]{1,3})?)(?![A-Za-z0-9_])"
ENTROPY_CANDIDATE = r"\b[A-Za-z0-9_\-/+=]{20,}\b"
MIN_PHONE_DIGITS = 6

#: Characters that no text should have, as Unicode keeps them for uses like this one; where a text has the first, the second stands for it.
MARK, INSTEAD = "\ufdd0", "\ufdd1"

_NEEDS = {"email": "@", "jwt": "eyJ", "private_key_block": "-----BEGIN ", "aws_access_key": "AKIA", "slack_token": "xox", "github_token": "gh", "url_http": "://"}
_octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def marked(text: Column, regex: str, only: Column | None = None) -> Column:
    """The text with a mark before and after each match, in one pass; without a match, or where ``only`` is false, it does not matter what."""
    clean = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, INSTEAD)).otherwise(text)
    out = F.regexp_replace(clean, regex, f"{MARK}$0{MARK}")
    return out if only is None else F.when(only, out).otherwise("")


def between_marks(text: Column) -> Column:
    """Ranges of what stands between pairs of marks, without the marks."""

    def pairs(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), (F.size(parts) / 2).cast("int") - 1), lambda i: F.struct(F.length(F.get(parts, 2 * i)).alias("g"), F.length(F.get(parts, 2 * i + 1)).alias("m")))

    return F.when(F.contains(text, F.lit(MARK)), running_ranges(let(F.split(text, MARK, -1), pairs))).otherwise(F.array().cast(RANGES))


def matches(text: Column, regex: str, only: Column | None = None) -> Column:
    """Ranges of all matches of a pattern that matches nothing empty; none where ``only`` is false."""
    return let(marked(text, regex, only), between_marks)


def _gate(name: str, regex: str, text: Column, told: Column | None = None) -> Column | None:
    """A cheap test that a text passes if the pattern can match: a literal it must have, else its telling characters."""
    if name in _NEEDS:
        return F.contains(text, F.lit(_NEEDS[name]))
    return may_match(telling(text) if told is None else told, regex)


def spans_of(ranges: Column, label: str, score: float, detector: str) -> Column:
    return F.transform(ranges, lambda r: span(r["start"], r["end"], F.lit(label), F.lit(score), F.lit(detector), F.lit(detection_label_name(label))))


def _expression(pattern: Pattern) -> str:
    return ("(?i)" if pattern.ignore_case else "") + pattern.regex


def find_pattern(text: Column, pattern: Pattern, detector: str) -> Column:
    return spans_of(matches(text, _expression(pattern), _gate(pattern.name, pattern.regex, text)), pattern.label, pattern.score, f"{detector}:{pattern.label}")


def find_patterns(text: Column, patterns: list[tuple[Pattern, str]], told: Column) -> Column:
    """Spans of many patterns (with their detectors), in their order. ``told`` are the text's telling characters.

    A pattern by itself is only what marks the text; offsets are told by one expression for all of them, as tasks read whole expressions.
    """
    texts = F.array(*(marked(text, _expression(p), _gate(p.name, p.regex, text, told)) for p, _ in patterns))
    kinds = F.array(*(F.struct(F.lit(p.label).alias("label"), F.lit(p.score).alias("score"), F.lit(f"{d}:{p.label}").alias("detector"), F.lit(detection_label_name(p.label)).cast("string").alias("canonical")) for p, d in patterns))
    one = lambda m, k: F.transform(between_marks(m), lambda r: span(r["start"], r["end"], k["label"], k["score"], k["detector"], k["canonical"]))
    return F.flatten(F.zip_with(texts, kinds, one))


def is_ip(token: Column) -> Column:
    """Whether a token is an IPv4 or IPv6 address or network, with two separators at least."""
    address, prefix = F.regexp_extract(token, "^[^/]*", 0), F.regexp_extract(token, "/([0-9]{1,3})\\z", 1)
    bits = lambda most: (prefix == "") | (F.coalesce(prefix.try_cast("int") <= most, F.lit(False)))
    four = address.rlike(rf"^{_octet}(\.{_octet}){{3}}\z")
    tail = F.regexp_replace(address, rf"(?<=:){_octet}(\.{_octet}){{3}}\z", "0:0")
    groups = F.filter(F.split(tail, ":"), lambda g: g != "")
    shape = tail.rlike("^[0-9A-Fa-f:]+\\z") & ~F.exists(groups, lambda g: F.length(g) > 4) & ~F.contains(tail, F.lit(":::"))
    twice = F.size(F.split(tail, "::", -1)) - 1
    ends = (~tail.rlike("^:[^:]")) & (~tail.rlike("[^:]:\\z"))
    six = shape & ends & (((twice == 0) & (F.size(groups) == 8)) | ((twice == 1) & (F.size(groups) <= 7)))
    separators = F.length(token) - F.length(F.translate(token, ".:", ""))
    return (separators >= 2) & ((four & bits(32)) | (six & bits(128)))


def find_ips(text: Column, score: float, detector: str) -> Column:
    found = F.filter(matches(text, IP_CANDIDATE, text.rlike("[0-9:]")), lambda r: is_ip(cut(text, r["start"], r["end"])))
    return spans_of(found, "IP_ADDRESS", score, detector)


def find_entropy(text: Column, params: dict, detector: str) -> Column:
    least, bits = max(8, int(params.get("min_length", 24))), float(params.get("entropy_threshold", 3.7))
    found = matches(text, params.get("pattern", ENTROPY_CANDIDATE))
    good = F.filter(found, lambda r: (r["end"] - r["start"] >= least) & (entropy(cut(text, r["start"], r["end"])) >= bits))
    return spans_of(good, "API_KEY", float(params.get("score", 0.91)), detector)


def is_phone(number: Column, regions: list[str], national: bool = False) -> Column:
    """Whether digits are a number of one of the regions: with the country code, or national behind a trunk digit."""
    return number.rlike(phones.valid(tuple(regions), national))


def find_phones(text: Column, params: dict, detector: str) -> Column:
    """International numbers, and national ones as the regions write them."""
    least, regions = max(MIN_PHONE_DIGITS, int(params.get("min_digits", 10))), list(params.get("regions", phones.PLANS))
    own = lambda r: cut(text, r["start"], r["end"])
    long = lambda r: F.length(digits(own(r))) >= least
    abroad = F.filter(matches(text, phones.INTERNATIONAL, F.contains(text, F.lit("+"))), lambda r: long(r) & is_phone(digits(own(r)), regions))
    # nine digits are a whole number where none are written before them
    local = lambda r: (long(r) & is_phone(digits(own(r)), regions, national=True)) | own(r).rlike(phones.written(tuple(regions)))
    here = F.filter(matches(text, phones.NATIONAL, text.rlike("\\d")), local)
    return spans_of(F.concat(abroad, here), "PHONE_NUMBER", float(params.get("score", 0.92)), detector)


def _patterns(text: Column, d: Detector) -> list[Column]:
    return [find_pattern(text, p, d.id) for p in d.patterns()]


#: Detectors by kind: ``(text, detector) -> spans``; further kinds may be added, models come in as spans (``operators.plugins``).
KINDS: dict[str, Callable[[Column, Detector], list[Column]]] = {
    "regex": _patterns,
    "secret_regex": _patterns,
    "ip": lambda text, d: [find_ips(text, float(d.params.get("score", 0.99)), d.id)],
    "entropy": lambda text, d: [find_entropy(text, d.params, d.id)],
    "phone": lambda text, d: [find_phones(text, d.params, d.id)],
}


def candidates(text: Column, detectors: list[Detector], labels: set[str] | None = None) -> Column:
    """All spans of the detectors in their order; with ``labels``, detectors that cannot give one are not planned."""

    def all_of(told: Column) -> Column:
        planned = [d for d in detectors if d.kind in KINDS and (labels is None or labels & ({p.label for p in d.patterns()} or {"IP_ADDRESS", "API_KEY", "PHONE_NUMBER"}))]
        found = []
        for many, run in groupby(planned, lambda d: KINDS[d.kind] is _patterns):
            if many:
                found += [find_patterns(text, own, told)] if (own := [(p, d.id) for d in run for p in d.patterns()]) else []
            else:
                found += [c for d in run for c in KINDS[d.kind](text, d)]
        return F.concat(*found) if found else F.array().cast(SPANS)

    return let(telling(text), all_of)


def validated(text: Column, spans: Column, min_score: float) -> Column:
    """Payment cards kept or dropped and rescored by their signal, then the policy's threshold."""

    is_card = lambda s: F.coalesce(s["canonical"], F.lit("")) == "payment_card"
    nothing = "struct<keep:boolean,digits_count:int,luhn_valid:boolean,grouped_like_card:boolean,has_context:boolean,score_multiplier:double,score_bonus:double>"
    signals = F.transform(spans, lambda s: F.struct(s.alias("s"), F.when(is_card(s), card_signal(text, s["start"], s["end"])).otherwise(F.lit(None).cast(nothing)).alias("c")))

    def one(x: Column) -> Column:
        s, c = x["s"], x["c"]
        factor = F.when(F.contains(s["detector"], F.lit(":CREDIT_CARD")), c["score_multiplier"]).otherwise(1.0)
        score = F.when(c.isNotNull(), F.least(F.lit(1.0), s["score"] * factor + c["score_bonus"])).otherwise(s["score"])
        return span(s["start"], s["end"], s["label"], score, s["detector"], s["canonical"])

    kept = F.filter(signals, lambda x: F.coalesce(x["c"]["keep"], F.lit(True)))
    return F.filter(F.transform(kept, one), lambda s: s["score"] >= min_score)


def detect(df: DataFrame, policy: PolicyFile, name: str | None = None, text: str = "text", extra: Column | None = None, stats: bool = False) -> DataFrame:
    """``df`` with ``found`` (candidates) and ``spans`` (validated, normalized, merged); ``extra`` are spans of plugged-in models."""
    p = policy.resolve(name)
    t = F.coalesce(F.col(text), F.lit(""))
    found = candidates(t, policy.detectors_of(p.analyzer_profile))
    df = df.withColumn("found", F.concat(found, extra) if extra is not None else found)
    df = df.withColumn("_v", validated(t, drop_contained(F.col("found")), p.min_score))
    df = df.withColumn("_n", normalized(t, F.col("_v"))).withColumn("spans", union_merge(F.col("_n"), NORMALIZER_RANK, NORMALIZER_DEFAULT))
    if stats:
        from veilmark.operators.spans import normalization_stats

        df = df.withColumn("stats", normalization_stats(F.col("_v"), F.col("_n"), F.col("spans")))
    return df.drop("_v", "_n")


def mask_groups(spans: Column) -> Column:
    """The masker's merge, with its own ranks."""
    return union_merge(spans, MASKER_RANK, MASKER_DEFAULT)


