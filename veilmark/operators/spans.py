"""Span algebra within a row: a document's spans are one array, so none of this shuffles.

A span is ``struct<start,end,label,score,detector,canonical>``, half-open, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.functions.labels import by_label
from veilmark.functions.texts import cut, let, trimmed_bounds

SPAN = "struct<start:int,end:int,label:string,score:double,detector:string,canonical:string>"
SPANS = f"array<{SPAN}>"
MERGED = "array<struct<start:int,end:int,label:string,score:double,detector:string,canonical:string,detectors:array<string>,canonicals:array<string>,members:int>>"
RANGES = "array<struct<start:int,end:int>>"

# Which label a group of merged spans gets, in the normalizer and in the masker.
NORMALIZER_RANK = {
    "ip": 140, "payment_card": 130, "phone": 125, "email": 120, "secret": 115, "identifier": 100, "date": 95, "person": 90, "organization": 85, "location": 80,
}
NORMALIZER_DEFAULT = 70
MASKER_RANK = {
    "secret": 5, "identifier": 4, "ip": 4, "email": 3, "phone": 3, "payment_card": 3, "date": 2, "person": 1, "location": 1, "organization": 1,
}
MASKER_DEFAULT = 0

# Fixed values of address expansion.
ADDRESS_MARKERS = [
    "address", "street", "адрес", "улиц", "просп", "шоссе", "манзил", "ko'chasi", "mavze", "tumani", "tuman", "shahri", "shahar", "xonadon", "uy",
    "kvartira", "dom", "квартир", "дом", "apartment", "apt", "house",
]
ADDRESS_CONTEXT = [
    "address", "адрес", "location", "район", "область", "город", "улиц", "дом", "квартир", "корпус", "подъезд", "манзил", "tumani", "tuman", "shahri",
    "shahar", "шахр", "туман", "street", "district", "city", "house", "apartment",
]
ADDRESS_TOKEN = r"(?iu)(?<![\pL\pN_])(?:г\.?|город|р-н|район|ул\.?|улица|пр-кт|д\.?|кв\.?|city|st\.?|district)(?![\pL\pN_])"
ADDRESS_REACH = 180
ADDRESS_NEAR = 24


def span(start, end, label, score, detector, canonical) -> Column:
    parts = (("start", start, "int"), ("end", end, "int"), ("label", label, "string"), ("score", score, "double"), ("detector", detector, "string"), ("canonical", canonical, "string"))
    return F.struct(*(c.cast(t).alias(n) for n, c, t in parts))


def ordered(spans: Column) -> Column:
    """By start, then end."""
    return F.sort_array(spans)


def blocks(xs: Column, kind: str) -> Column:
    """An array in blocks of about the root of its length: a fold that appends to a list copies it each time, so folds stay within blocks."""
    width = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(xs))).cast("int"))
    cut_up = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / width).cast("int")), lambda i: F.slice(xs, i * width + 1, width))
    return F.when(F.size(xs) > 0, cut_up).otherwise(F.array().cast(f"array<array<{kind}>>"))


def running_greatest(values: Column) -> Column:
    """For each of the numbers (int) the greatest of those before it; the least number there is for the first."""

    def within(block: Column, at: Column) -> Column:
        zero = F.struct(at.alias("most"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, zero, lambda a, x: F.struct(F.greatest(a["most"], x).alias("most"), F.concat(a["out"], F.array(a["most"])).alias("out")))["out"]

    def placed(bs: Column) -> Column:
        return F.flatten(F.zip_with(bs, within(F.transform(bs, F.array_max), F.lit(-(2**31))), within))

    return let(let(values, lambda v: blocks(v, "int")), placed)


def drop_contained(spans: Column) -> Column:
    """Without spans of score 0, and without any inside a better one of its label: a higher score, then an earlier start, then more length.

    Containment is transitive, so it does not matter whether the better one stays itself. A label's spans are swept by start and descending
    end: whatever holds a span stands before it, and is better exactly if its score is not lower. Of the blocks before, the bounds and
    scores that no other one beats are enough; those of the block itself are looked at one by one.
    """
    kind = f"struct<start:int,less:int,worse:double,s:{SPAN}>"
    beats = lambda s: lambda b: (b["end"] >= s["end"]) & (b["score"] >= s["score"])

    def swept(own: Column) -> Column:
        key = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), (-s["score"]).alias("worse"), s.alias("s"))
        order = F.transform(F.sort_array(F.transform(own, key).cast(f"array<{kind}>")), lambda x: x["s"])
        return let(let(order, lambda xs: blocks(xs, SPAN)), lambda bs: F.when(F.size(bs) == 1, F.filter(bs[0], lambda s, i: ~F.exists(F.slice(bs[0], F.lit(1), i), beats(s)))).otherwise(in_blocks(bs)))

    def in_blocks(bs: Column) -> Column:
        bound = "struct<worse:double,less:int,end:int,score:double>"
        bounds = lambda block: F.transform(block, lambda s: F.struct((-s["score"]).alias("worse"), (-s["end"]).alias("less"), s["end"].alias("end"), s["score"].alias("score")))

        def best(all_of: Column) -> Column:  # by falling score, those that reach further than all before
            return let(F.sort_array(all_of), lambda xs: let(running_greatest(F.transform(xs, lambda x: x["end"])), lambda most: F.filter(xs, lambda x, i: x["end"] > F.get(most, i))))

        zero = F.struct(F.array().cast(f"array<{bound}>").alias("best"), F.array().cast(f"array<array<{bound}>>").alias("out"))
        before = F.aggregate(bs, zero, lambda a, block: F.struct(best(F.concat(a["best"], bounds(block))).alias("best"), F.concat(a["out"], F.array(a["best"])).alias("out")))["out"]
        keep = lambda block, told: F.filter(block, lambda s, i: ~F.exists(told, beats(s)) & ~F.exists(F.slice(block, F.lit(1), i), beats(s)))
        return F.flatten(F.zip_with(bs, before, keep))

    def all_of(xs: Column) -> Column:
        kept = F.flatten(F.transform(F.array_distinct(F.transform(xs, lambda s: s["label"])), lambda label: swept(F.filter(xs, lambda s: s["label"].eqNullSafe(label)))))
        back = lambda s: F.struct((-s["score"]).alias("a"), s["start"].alias("b"), (s["start"] - s["end"]).alias("c"), s.alias("s"))
        return F.transform(F.sort_array(F.transform(kept, back)), lambda x: x["s"])

    some = let(F.filter(spans, lambda s: s["score"] > 0), lambda xs: F.when(F.size(xs) < 2, xs).otherwise(all_of(xs)))
    return some.cast(SPANS)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def union_merge(spans: Column, rank: dict[str, int], default: int) -> Column:
    """Groups of spans that overlap or touch, each as one span over them all.

    The best member (rank of its canonical label, score, length, earliest start) gives label, detector and canonical label; the score is
    the greatest; ``detectors`` and ``canonicals`` list what was merged.
    """
    rank_of = lambda s: by_label(F.lower(F.coalesce(s["canonical"], F.lit(""))), {k: float(v) for k, v in rank.items()}, float(default))
    some = lambda c: F.filter(F.array(c), lambda x: x.isNotNull() & (F.trim(x) != ""))

    def one(members: Column) -> Column:
        quality = lambda s: F.struct(rank_of(s).alias("r"), s["score"].alias("s"), (s["end"] - s["start"]).alias("l"), (-s["start"]).alias("b"))
        rated = F.transform(members, lambda s, i: F.struct(quality(s).alias("q"), (-i).alias("first"), s.alias("s")))
        listed = lambda f: F.sort_array(F.array_distinct(F.flatten(F.transform(members, lambda s: some(f(s))))))
        return let(
            F.array_max(rated)["s"],
            lambda best: F.struct(
                members[0]["start"].alias("start"), F.array_max(F.transform(members, lambda s: s["end"])).alias("end"), best["label"].alias("label"),
                F.array_max(F.transform(members, lambda s: s["score"])).alias("score"), best["detector"].alias("detector"), best["canonical"].alias("canonical"),
                listed(lambda s: s["detector"]).alias("detectors"), listed(lambda s: F.lower(s["canonical"])).alias("canonicals"), F.size(members).alias("members"),
            ),
        )

    valid = ordered(F.filter(spans, lambda s: s["end"] > s["start"]))
    return let(valid, lambda xs: F.transform(let(_first_of_group(xs), lambda firsts: F.transform(firsts, lambda f, i: F.slice(xs, f["at"] + 1, F.coalesce(F.get(firsts, i + 1)["at"], F.size(xs)) - f["at"]))), one)).cast(MERGED)


def _first_of_group(ordered_spans: Column) -> Column:
    """Of spans in order, those that begin a group of overlapping or touching ones: ``(at, start, reached)``, ``reached`` by all before."""
    kind = "array<struct<at:int,start:int,reached:int>>"

    def firsts(xs: Column) -> Column:
        def flagged(most: Column) -> Column:
            rows = F.transform(xs, lambda s, i: F.struct(i.alias("at"), s["start"].alias("start"), F.get(most, i).alias("reached")))
            return F.filter(rows, lambda r: r["start"] > r["reached"])

        return let(running_greatest(F.transform(xs, lambda s: s["end"])), flagged)

    return let(ordered_spans, lambda xs: F.when(F.size(xs) == 0, F.array().cast(kind)).otherwise(firsts(xs).cast(kind)))


def merge_ranges(ranges: Column) -> Column:
    """Ranges that overlap or touch as one, in order; empty ones go."""
    valid = F.filter(ranges, lambda r: r["end"] > r["start"])
    valid = F.sort_array(F.transform(valid, lambda r: F.struct(r["start"].cast("int").alias("start"), r["end"].cast("int").alias("end"))))

    def closed(xs: Column) -> Column:
        last = F.array_max(F.transform(xs, lambda r: r["end"]))
        end = lambda firsts, i: F.coalesce(F.get(firsts, i + 1)["reached"], last)
        return let(_first_of_group(xs), lambda firsts: F.transform(firsts, lambda f, i: F.struct(f["start"].alias("start"), end(firsts, i).alias("end"))))

    return let(valid, lambda xs: F.when(F.size(xs) < 2, xs).otherwise(closed(xs))).cast(RANGES)


def ranges_length(ranges: Column) -> Column:
    return F.aggregate(ranges, F.lit(0), lambda a, r: a + (r["end"] - r["start"]))


def intersection_length(a: Column, b: Column) -> Column:
    """Common length of two lists of merged ranges: what they have together beyond their union."""
    return ranges_length(a) + ranges_length(b) - ranges_length(merge_ranges(F.concat(a.cast(RANGES), b.cast(RANGES))))


def running_ranges(pairs: Column) -> Column:
    """Ranges of lengths ``m`` that follow gaps ``g``, for ``array<struct<g:int,m:int>>``."""
    zero = lambda at: F.struct(at.alias("at"), F.array().cast(RANGES).alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["g"]
        return F.struct((start + x["m"]).alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), (start + x["m"]).alias("end")))).alias("out"))

    def placed(bs: Column) -> Column:
        sums = F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["g"] + x["m"]))
        before = F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(bs, before, lambda b, at: F.aggregate(b, zero(at), step)["out"]))

    return let(let(pairs, lambda xs: blocks(xs, "struct<g:int,m:int>")), placed)


def match_pairs(text: Column, regex: str) -> Column:
    """Lengths of the matches of a pattern and of the gaps before them."""
    found = F.transform(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda m: F.length(m))
    gaps = F.transform(F.split(text, regex, -1), lambda g: F.length(g))
    return let(found, lambda f: F.zip_with(F.slice(gaps, F.lit(1), F.size(f)), f, lambda g, m: F.struct(g.alias("g"), m.alias("m"))))


def tokens(text: Column) -> Column:
    """Ranges of the runs of characters that are no white space."""
    return running_ranges(match_pairs(text, "\\S+"))


def token_ranges(text: Column, ranges: Column) -> Column:
    """Merged ranges of the numbers of the tokens that (merged, ordered) character ranges touch.

    Tokens are counted from one range's bound to the next, so the text is read once and no list of its tokens is made.
    """
    begun = lambda a, b: F.regexp_count(F.when(a == 0, F.concat(F.lit(" "), cut(text, F.lit(0), b))).otherwise(cut(text, a - 1, b)), F.lit("(?<=\\s)\\S"))

    def step(s: Column, r: Column) -> Column:
        within = cut(text, r["start"] - 1, r["start"] + 1).rlike("^\\S\\S\\z") & (r["start"] > 0)
        counted = F.struct((s["n"] + begun(s["at"], r["start"])).alias("before"), begun(r["start"], r["end"]).alias("own"), within.alias("within"))

        def put(c: Column) -> Column:
            first, last = c["before"] - F.when(c["within"], 1).otherwise(0), c["before"] + c["own"]
            return F.struct(r["end"].alias("at"), last.alias("n"), F.when(last > first, F.concat(s["out"], F.array(F.struct(first.alias("start"), last.alias("end"))))).otherwise(s["out"]).alias("out"))

        return let(counted, put)

    return merge_ranges(F.aggregate(ranges, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast(RANGES).alias("out")), step)["out"])


def _count(text: Column, words: list[str]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)))


def _has(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def looks_like_address(text: Column) -> Column:
    return let(_count(F.lower(text), ADDRESS_MARKERS), lambda hits: ((hits >= 1) & text.rlike("[,\\p{Nd}]")) | (hits >= 2))


def is_address_segment(text: Column) -> Column:
    low = F.lower(text)
    return (F.trim(low) != "") & (_has(low, ADDRESS_MARKERS) | low.rlike("\\p{Nd}") | low.rlike(ADDRESS_TOKEN))


def clause_bounds(text: Column, start: Column, end: Column, reach: int = ADDRESS_REACH) -> Column:
    """From the end of the sentence before to the end of this one, at most ``reach`` characters either way."""
    before = cut(text, F.greatest(start - reach, F.lit(0)), start)
    after = cut(text, end, F.least(end + reach, F.length(text)))
    return F.struct((start - F.length(F.regexp_extract(before, "[^\\n\\r.!?;]*\\z", 0))).alias("start"), (end + F.length(F.regexp_extract(after, "^[^\\n\\r.!?;]*", 0))).alias("end"))


def _chain(side: Column, forward: bool, budget: Column) -> Column:
    """Characters by which a location grows over the comma segments of the text at its side, nearest segment first."""

    def grow(parts: Column) -> Column:
        # what the nearest segment has beyond the span is passed over together with the next one
        zero = F.struct(F.lit(0).alias("grown"), F.lit(True).alias("on"), F.length(parts[0]).alias("pending"))

        def step(a: Column, seg: Column) -> Column:
            more = a["grown"] + a["pending"] + 1 + F.length(seg)
            go = a["on"] & (a["grown"] < budget) & (more <= budget) & is_address_segment(seg)
            return let(go, lambda g: F.struct(F.when(g, more).otherwise(a["grown"]).alias("grown"), g.alias("on"), F.when(g, 0).otherwise(a["pending"]).alias("pending")))

        return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), zero, step)["grown"]

    parts = F.split(side, ",", -1)
    return let(parts if forward else F.reverse(parts), grow)


def expanded_location(text: Column, bounds: Column) -> Column:
    """Bounds of a (trimmed) location grown over the neighbouring comma segments that belong to an address."""

    def grown(b: Column) -> Column:
        start, end = b["start"], b["end"]
        clause = lambda c: F.struct(cut(text, c["start"], start).alias("before"), cut(text, end, c["end"]).alias("after"))
        sides = let(clause_bounds(text, start, end), clause)
        right = let(sides, lambda x: F.struct(x["before"].alias("before"), _chain(x["after"], True, F.lit(ADDRESS_REACH)).alias("right")))
        both = let(right, lambda x: F.struct(_chain(x["before"], False, F.lit(ADDRESS_REACH) - x["right"]).alias("left"), x["right"].alias("right")))
        wide = let(both, lambda x: trimmed_bounds(text, start - x["left"], end + x["right"]))
        return let(wide, lambda w: F.when((w["end"] - w["start"] > end - start) & is_address_segment(cut(text, w["start"], w["end"])), w).otherwise(b))

    def asks(b: Column) -> Column:
        near = F.lower(cut(text, F.greatest(b["start"] - ADDRESS_NEAR, F.lit(0)), F.least(b["end"] + ADDRESS_NEAR, F.length(text))))
        return let(near, lambda x: _has(x, ADDRESS_CONTEXT)) | looks_like_address(cut(text, b["start"], b["end"]))

    return let(bounds, lambda b: F.when(asks(b), grown(b)).otherwise(b))


def normalized(text: Column, spans: Column) -> Column:
    """Each span trimmed, locations expanded; a span of which nothing would be left stays as it is."""

    def one(s: Column) -> Column:
        bounds = let(trimmed_bounds(text, s["start"], s["end"]), lambda t: F.when((s["canonical"] == "location") & (t["end"] > t["start"]), expanded_location(text, t)).otherwise(t))
        kept = lambda b: F.when(b["end"] > b["start"], b).otherwise(F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return let(let(bounds, kept), lambda b: span(b["start"], b["end"], s["label"], s["score"], s["detector"], s["canonical"]))

    return F.transform(spans, one)


def normalization_stats(before: Column, after: Column, merged: Column) -> Column:
    """How many spans were trimmed, expanded, dropped as invalid, and merged away."""
    size = lambda s: s["end"] - s["start"]
    pairs = F.filter(F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a"))), lambda p: (size(p["a"]) > 0) & (size(p["b"]) > 0))
    count = lambda f: F.size(F.filter(pairs, f))
    valid = F.size(F.filter(after, lambda s: size(s) > 0))
    return F.struct(
        count(lambda p: size(p["a"]) < size(p["b"])).alias("trimmed_spans"),
        count(lambda p: size(p["a"]) > size(p["b"])).alias("expanded_spans"),
        (F.size(after) - valid).alias("invalid_spans_dropped"),
        (valid - F.size(merged)).alias("overlaps_dropped"),
    )


def chunk_windows(text: Column, size: int, overlap: int | None = None) -> Column:
    """Windows of ``size`` tokens, ``overlap`` of them shared, and windows for what no token covers; empty text has one empty window.

    Windows begin and end at multiples of a number of tokens, so the text is cut into pieces of as many, not into tokens.
    """
    overlap = min(size - 1, max(16, size // 8)) if overlap is None else max(0, min(overlap, size - 1))
    n, step, none = F.length(text), size - overlap, F.array().cast(RANGES)
    per = max(k for k in range(1, 65) if size % k == 0 and step % k == 0)  # an expression goes as deep as a piece has tokens
    pair = lambda a, b: F.array(F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))).cast(RANGES)

    def windows(parts: Column, at: Column) -> Column:
        last = F.size(parts) - 1
        count = F.when(last < size // per, 1).otherwise(F.ceil((last + 1 - size // per) / (step // per)).cast("int") + 1)
        end = lambda k: F.get(at, k)["start"] + F.length(F.rtrim(F.get(parts, k), F.lit(" \t\n\x0b\f\r")))
        return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(F.get(at, k * (step // per))["start"].alias("start"), let(F.least(k * (step // per) + size // per - 1, last), end).alias("end")))

    def covering(w: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(w, i - 1)["end"])
        with_gap = lambda x, i: F.concat(let(before(i), lambda e: F.when(x["start"] > e, pair(e, x["start"])).otherwise(none)), F.array(x).cast(RANGES))
        last = F.try_element_at(w, F.lit(-1))["end"]
        return F.concat(F.flatten(F.transform(w, with_gap)), F.when(last < n, pair(last, n)).otherwise(none))

    def of(parts: Column) -> Column:
        gap = lambda i: F.when(i == 0, F.length(F.regexp_extract(text, "^\\s*", 0))).otherwise(0)
        at = running_ranges(F.transform(parts, lambda p, i: F.struct(gap(i).alias("g"), F.length(p).alias("m"))))
        return F.when(F.size(parts) == 0, pair(F.lit(0), n)).otherwise(let(let(at, lambda a: windows(parts, a)), covering))

    return let(F.regexp_extract_all(text, F.lit(f"(?:\\S+\\s*){{1,{per}}}"), F.lit(0)), of)


def context_lengths(model_positions: Column, tokenizer_max: Column, specials: int = 2) -> Column:
    """``context_length`` of many models."""
    sensible = F.when(tokenizer_max.between(2, 100_000), tokenizer_max)
    usable = F.coalesce(F.when(model_positions != 0, model_positions), sensible, F.lit(512))
    return F.greatest(F.lit(2), usable - specials)


def context_length(model_positions: int | None, tokenizer_max: int | None, specials: int = 2) -> int:
    """Tokens of text in a window of a model: its positions, else a sensible maximum of the tokenizer, without special tokens."""
    usable = model_positions or (tokenizer_max if tokenizer_max and 2 <= tokenizer_max <= 100_000 else None) or 512
    return max(2, usable - specials)

