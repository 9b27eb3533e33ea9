"""Columns over texts: digits, checksums, entropy, script, trimming, hashes. Offsets count code points from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are trimmed off spans, and the words near payment cards.
TRIM = " \t\r\n\"'`.,:;!?()[]{}<>"
CARD_WORDS = ["card", "credit", "debit", "visa", "mastercard", "amex", "payment", "карта", "номер карты", "банковск", "платеж"]
CARD_REACH = 32
_TRIM_CLASS = "[ \\t\\r\\n\"'`.,:;!?()\\[\\]{}<>]"


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once and may be named often."""
    return F.transform(F.array(value), use)[0]


def cut(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` for offsets within the text."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check; false for an empty one."""
    chars = F.filter(F.split(number, ""), lambda c: c != "")
    total = F.aggregate(
        F.transform(F.reverse(chars), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + (c.cast("int") * 2 / 10).cast("int"))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return (F.length(number) > 0) & (total % 10 == 0)


def luhn_digit(number: Column) -> Column:
    """The digit that, appended, makes the number pass."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")), lambda d: luhn(F.concat(number, d)))[0]


def card_signal(text: Column, start: Column, end: Column) -> Column:
    """Struct of what speaks for a payment card at a span."""
    snippet = cut(text, start, end)
    near = F.lower(cut(text, F.greatest(start - CARD_REACH, F.lit(0)), F.least(end + CARD_REACH, F.length(text))))
    seen = F.struct(
        digits(snippet).alias("number"),
        F.regexp_replace(F.trim(snippet), "\\s+", " ").rlike("^(?:\\d{4}[ -]){2,4}\\d{1,4}\\z").alias("grouped"),
        let(near, lambda x: F.exists(F.array(*map(F.lit, CARD_WORDS)), lambda w: F.contains(x, w))).alias("context"),
    )

    def judged(c: Column) -> Column:
        number = c["number"]
        return F.struct(
            (F.length(number).between(13, 19) & (F.size(F.array_distinct(F.split(number, ""))) >= 2)).alias("keep"),
            F.length(number).alias("digits_count"),
            luhn(number).alias("luhn_valid"),
            c["grouped"].alias("grouped_like_card"),
            c["context"].alias("has_context"),
        )

    def scored(c: Column) -> Column:
        keep, valid, grouped, context = (c[k] for k in ("keep", "luhn_valid", "grouped_like_card", "has_context"))
        return F.struct(
            *(c[k].alias(k) for k in ("keep", "digits_count", "luhn_valid", "grouped_like_card", "has_context")),
            F.when(keep & ~grouped & ~valid & ~context, 0.9).otherwise(1.0).alias("score_multiplier"),
            F.when(keep & valid, 0.08).when(keep & grouped & context, 0.03).otherwise(0.0).alias("score_bonus"),
        )

    return let(let(seen, judged), scored)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.transform(F.array_distinct(chars), share), F.lit(0.0), lambda a, p: a - p * F.log2(p))


def script_profile(text: Column) -> Column:
    cyrillic = F.length(F.regexp_replace(text, "[^А-Яа-яЁё]", ""))
    latin = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    n = cyrillic + latin
    return F.when(n == 0, "no_letters").when(cyrillic / n >= 0.7, "mostly_cyrillic").when(latin / n >= 0.7, "mostly_latin").otherwise("mixed")


def trimmed_bounds(text: Column, start: Column, end: Column) -> Column:
    """``(start, end)`` within the text and without trimmed characters at either end; equal if nothing is left."""
    within = F.struct(F.greatest(start, F.lit(0)).alias("low"), F.least(end, F.length(text)).alias("high"))

    def ends(w: Column) -> Column:
        inner = cut(text, w["low"], w["high"])
        head, tail = (F.length(F.regexp_extract(inner, r, 0)) for r in (f"^{_TRIM_CLASS}*", f"{_TRIM_CLASS}*\\z"))
        return F.struct(F.least(w["low"] + head, w["high"]).alias("left"), (w["high"] - tail).alias("right"))

    return let(let(within, ends), lambda e: F.struct(e["left"].alias("start"), F.greatest(e["right"], e["left"]).alias("end")))


def request_hint(request_id: Column) -> Column:
    x = F.upper(F.substring(F.regexp_replace(request_id, "[^\\p{L}\\p{N}]", ""), 1, 8))
    return F.when(x == "", "REQ").otherwise(x)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 12)


def marked_preview(text: Column, start: Column, end: Column, mark: str = "<PRED>", reach: int = 40) -> Column:
    return F.concat(cut(text, F.greatest(start - reach, F.lit(0)), start), F.lit(mark), cut(text, end, F.least(end + reach, F.length(text))))


def density_per_10k(entities: Column, chars: Column) -> Column:
    return F.when(chars > 0, F.round(entities / (chars / 10000.0), 6)).otherwise(0.0)
