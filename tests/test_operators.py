"""Single operators on literal cases, and span algebra against a plain model on random spans."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veilmark.functions import labels, texts
from veilmark.operators import detect, masking, metrics, plugins, sampling, spans, synth
from veilmark.sources import chats, datasets, policy, reports, sessions

POLICY = policy.load_policy()


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


def found(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return [(r["canonical"], text[r["start"] : r["end"]]) for r in detect.detect(df, POLICY).first()["spans"]]


def span_row(s, e, canonical="email", score=0.9, detector="d"):
    return (s, e, canonical.upper(), score, detector, canonical)


def merged(spark, rows, rank=spans.NORMALIZER_RANK, default=70):
    df = spark.createDataFrame([(rows,)], f"s {spans.SPANS}")
    return df.select(spans.union_merge(F.col("s"), rank, default).alias("x")).first()["x"]


def test_policy_file():
    assert POLICY.resolve().name == "external" and POLICY.resolve().min_score == 0.4
    assert sum(len(d.patterns()) for d in POLICY.detectors.values() if "regex" in d.kind) == 43
    types, least = plugins.ClassifierParams.of(POLICY.detectors["pii_token_classifier"]).gate()
    assert len(types) == 27 and types["tin"] == "DOCUMENT_NUMBER" and least["tin"] == 0.82 and least["address"] == 0.72
    with pytest.raises(KeyError):
        POLICY.resolve("none")
    with pytest.raises(ValueError):
        policy.parse_policy({})
    with pytest.raises(ValueError):
        policy.parse_policy({"default_policy": "a", "policies": {"a": {"analyzer_profile": "x"}}})
    assert {p.label for p in POLICY.detectors["ru_pii_regex"].patterns()} == {"PHONE_NUMBER", "DOCUMENT_NUMBER", "CREDIT_CARD", "EMAIL_ADDRESS"}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Мой email ivan.petrov@example.com, паспорт 1234 567890", [("email", "ivan.petrov@example.com"), ("identifier", "паспорт 1234 567890"[8:])]),
        ("Use card 4242 4242 4242 4242 for testing", [("payment_card", "4242 4242 4242 4242")]),
        ("Номер карты 1111 1111 1111 1111", []),
        ("Телефон +79991234567 and SSN 123-45-6789", [("phone", "+79991234567"), ("identifier", "123-45-6789")]),
        ("host 10.0.0.12. Next", []),
        ("host 10.0.0.12 next", [("ip", "10.0.0.12")]),
        ("see https://example.org/a?b", [("url", "https://example.org/a?b")]),
        ("token ghp_abcdefghijABCDEFGHIJ0123456789abcdef now", [("secret", "ghp_abcdefghijABCDEFGHIJ0123456789abcdef")]),
        ("", []),
    ],
)
def test_detect(spark, text, expected):
    assert found(spark, text) == expected


def test_offsets_count_code_points(spark):
    text = "😀😀 a@b.co и c@d.org"
    ranges = one(spark, text, lambda t: detect.matches(t, "[a-z]@[a-z.]+"))
    assert [text[r["start"] : r["end"]] for r in ranges] == ["a@b.co", "c@d.org"]


@pytest.mark.parametrize(
    "token, good",
    [("1.2.3.4", True), ("1.2.3.256", False), ("1.2.3.0/24", True), ("1.2.3.4/33", False), ("::1", True), ("fe80::1", True), ("1:2:3:4:5:6:7:8", True), ("1:2:3", False), ("1::2::3", False), ("::ffff:1.2.3.4", True), ("12.34", False), (":1:2", False), ("12345::1", False)],
)
def test_is_ip(spark, token, good):
    assert one(spark, token, detect.is_ip) is good


def test_labels(spark):
    cases = {"TIN": ("DOCUMENT_NUMBER", "identifier"), "address-city": ("LOCATION", "location"), "ZIP": ("ZIP", "ip"), "nothing": ("NOTHING", None)}
    for label, (kind, canonical) in cases.items():
        assert one(spark, label, labels.collapse_type) == kind == labels.collapse_name(label)
        assert one(spark, label, labels.detection_label) == canonical
    for label, canonical in {"zip": "location", "ip_v6": "ip", "Passport": "identifier", "jwt": "secret", "e-mail": "email", "x": None, " Phone ": "phone"}.items():
        assert one(spark, label, labels.prediction_label) == canonical
    assert one(spark, "x", lambda t: labels.severity(F.lit(0.85))) == "high"


def test_texts(spark):
    assert one(spark, "4242424242424242", texts.luhn) and not one(spark, "", texts.luhn)
    assert one(spark, "424242424242424", texts.luhn_digit) == "2"
    assert one(spark, "aabb", texts.entropy) == 1.0
    profiles = {"Привет как дела": "mostly_cyrillic", "hello this is english": "mostly_latin", "Привет hello": "mixed", "12345 !!!": "no_letters"}
    assert all(one(spark, t, texts.script_profile) == p for t, p in profiles.items())
    assert tuple(one(spark, " (a b). ", lambda t: texts.trimmed_bounds(t, F.lit(0), F.length(t)))) == (2, 5)
    assert one(spark, "a-1é b2345678", texts.request_hint) == "A1ÉB2345" and one(spark, "--", texts.request_hint) == "REQ"


def test_location_expands(spark):
    text = "Manzil: O'zbekiston, Toshkent shahri, Chilonzor tumani, 5-mavze, 12-uy."
    at = text.index("Toshkent")
    grown = one(spark, text, lambda t: spans.expanded_location(t, F.struct(F.lit(at).alias("start"), F.lit(at + 15).alias("end"))))
    assert text[grown["start"] : grown["end"]] == "Toshkent shahri, Chilonzor tumani, 5-mavze, 12-uy"
    text = "Trip to Berlin was great yesterday."
    same = one(spark, text, lambda t: spans.expanded_location(t, F.struct(F.lit(8).alias("start"), F.lit(14).alias("end"))))
    assert tuple(same) == (8, 14)


def test_merge_labels_and_adjacency(spark):
    out = merged(spark, [span_row(0, 5, "phone", 0.94), span_row(3, 9, "identifier", 0.97, "e"), span_row(9, 12, "url", 0.5), span_row(20, 21)])
    assert [(m["start"], m["end"], m["canonical"], m["score"], m["members"]) for m in out] == [(0, 12, "phone", 0.97, 3), (20, 21, "email", 0.9, 1)]
    assert out[0]["detectors"] == ["d", "e"]
    assert merged(spark, []) == []


def test_span_algebra_against_model(spark):
    r = random.Random(4)
    rows = []
    for i in range(60):
        made = [span_row(s := r.randint(0, 40), s + r.randint(0, 8), r.choice(["email", "ip", "phone"]), round(r.random(), 2)) for _ in range(r.randint(0, 9))]
        rows.append((i, made))
    df = spark.createDataFrame(rows, f"id int, s {spans.SPANS}")
    got = {x["id"]: x for x in df.select("id", spans.merge_ranges(F.col("s")).alias("m"), spans.drop_contained(F.col("s")).alias("k")).collect()}
    for i, made in rows:
        expected = []
        for s in sorted((x[0], x[1]) for x in made if x[1] > x[0]):
            if expected and s[0] <= expected[-1][1]:
                expected[-1][1] = max(expected[-1][1], s[1])
            else:
                expected.append(list(s))
        assert [[m["start"], m["end"]] for m in got[i]["m"]] == expected
        kept = []
        for s in sorted((x for x in made if x[3] > 0), key=lambda x: (-x[3], x[0], x[0] - x[1])):
            if not any(k[5] == s[5] and k[0] <= s[0] and k[1] >= s[1] for k in kept):
                kept.append(s)
        assert sorted((k["start"], k["end"], k["canonical"]) for k in got[i]["k"]) == sorted((k[0], k[1], k[5]) for k in kept)


def test_mask_numbers_from_the_right(spark):
    rows = [("xx A yy B zz A", [(3, 4), (8, 9), (13, 14)])]
    df = spark.createDataFrame(rows, f"text string, s {spans.RANGES}")
    out = df.select(masking.mask(F.col("text"), F.col("s"), F.lit("GR00")).alias("m")).first()["m"]
    assert out["text"] == "xx <GR00:0001> yy <GR00:0002> zz <GR00:0001>"
    assert [tuple(p) for p in out["placeholders"]] == [("<GR00:0001>", "A"), ("<GR00:0002>", "B")]


def test_unmask_expands_restored_placeholders(spark):
    df = spark.createDataFrame([("a <P:10> b", [("<P:1>", "one"), ("<P:10>", "ten <P:1>")])], f"text string, p {masking.PLACEHOLDERS}")
    out = df.select(masking.unmask(F.col("text"), F.col("p")).alias("u")).first()["u"]
    assert tuple(out) == ("a ten one b", 2)


def test_sessions(spark, tmp_path):
    items = spark.createDataFrame([("s1", 0, "a", "x A"), ("s1", 1, "b", "y"), ("s2", 0, "c", "")], "session_id string, item_idx int, item_id string, text string")
    marked = items.withColumn("spans", F.when(F.col("text") == "x A", F.array(F.struct(F.lit(2).alias("start"), F.lit(3).alias("end")))).otherwise(F.array().cast(spans.RANGES)))
    masked, stored = masking.mask_items(marked, "mask", "GR", "external", 60)
    sessions.save(stored, str(tmp_path / "s"))
    live = sessions.load(spark, str(tmp_path / "s"))
    assert live.count() == 2 and sessions.load(spark, str(tmp_path / "s"), F.current_timestamp() + F.expr("INTERVAL 2 HOURS")).count() == 0
    back = masking.unmask_items(masked.select("session_id", "item_id", "text"), live)
    assert sorted((r["item_id"], r["text"], r["replacements"]) for r in back.collect()) == [("a", "x A", 1), ("b", "y", 0), ("c", "", 0)]
    lost = masking.unmask_items(masked.select("session_id", "text"), live.where("false")).first()
    assert not lost["context_found"]
    blocked, none = masking.mask_items(marked, "block", "GR", "external", 60)
    assert [r["session_id"] for r in none.collect()] == ["s2"] and blocked.where("session_id = 's1' and text is not null").isEmpty()
    passed, empty = masking.mask_items(marked, "passthrough", "GR", "external", 60)
    assert passed.where("text = 'x A'").count() == 1 and empty.where("size(placeholders) = 0").count() == 2


def test_sessions_of_very_many_items(spark):
    """A list of 60,000 placeholders is judged in seconds, and sessions as rows say what the lists say."""
    pair = lambda k: F.array(F.struct(F.concat(F.lit("<P:"), k.cast("string"), F.lit(">")).alias("placeholder"), F.concat(F.lit("v"), k.cast("string")).alias("original")))
    many = spark.range(60_000).groupBy().agg(F.flatten(F.collect_list(pair(F.col("id")))).alias("p"))
    begun = time.perf_counter()
    assert many.select(F.size(masking.unambiguous(F.col("p"))).alias("n")).first()["n"] == 60_000 and time.perf_counter() - begun < 15
    twice = many.withColumn("p", F.concat("p", F.array(F.struct(F.lit("<P:7>").alias("placeholder"), F.lit("another").alias("original")))))
    with pytest.raises(Exception, match="collision"):
        twice.select(masking.unambiguous(F.col("p")).alias("p")).collect()

    items = spark.createDataFrame([("s1", 0, "x A y A"), ("s1", 1, "x B y C"), ("s2", 0, "x C y D"), ("s3", 0, "none")], "session_id string, item_idx int, text string")
    marked = items.withColumn("spans", F.when(F.col("text") != "none", F.expr("array(named_struct('start', 2, 'end', 3), named_struct('start', 6, 'end', 7))")).otherwise(F.array().cast(spans.RANGES)))
    _, stored = masking.mask_items(marked, "mask", "GR", "external", 60)
    listed = sorted((r["session_id"], *p) for r in stored.collect() for p in r["placeholders"])
    assert sorted(map(tuple, masking.session_pairs(masking.masked_texts(marked, "GR")).collect())) == listed and len(listed) == 5
    with pytest.raises(Exception, match="collision"):  # items that share a number
        masking.session_pairs(masking.masked_texts(marked.withColumn("item_idx", F.lit(0)), "GR")).collect()


def test_metrics(spark):
    def counts(gold, predicted, f):
        df = spark.createDataFrame([("text", gold, predicted)], f"text string, gold {spans.SPANS}, predicted {spans.SPANS}")
        return tuple(df.select(f.alias("c")).first()["c"])

    g, p = F.col("gold"), F.col("predicted")
    assert counts([span_row(10, 20)], [span_row(12, 18)], metrics.exact_counts(g, p, True)) == (0, 1, 1)
    assert counts([span_row(10, 20)], [span_row(12, 18)], metrics.overlap_counts(g, p, True)) == (1, 0, 0)
    assert counts([span_row(0, 4)], [span_row(0, 4)], metrics.char_counts(g, p)) == (4, 0, 0)
    assert counts([span_row(0, 4)], [span_row(0, 4)], metrics.token_counts(F.col("text"), g, p)) == (1, 0, 0)
    greedy = [span_row(0, 10), span_row(0, 3)], [span_row(0, 2), span_row(5, 6)]
    assert counts(*greedy, metrics.overlap_counts(g, p, True)) == (1, 1, 1)
    per_label = spark.createDataFrame([("secret", 1, 0, 0), ("date", 9, 0, 1), ("ip", 0, 3, 0)], "label string, tp long, fp long, fn long")
    assert metrics.macro(per_label).first()["labels_included"] == 2
    assert metrics.risk_weighted_recall(per_label).first()["value"] == round((5 * 1 + 0.9) / 6, 6)


def test_model_detector(spark):
    params = plugins.ClassifierParams(0.4, ("b-mail", "mail", "ip"), {"mail": "EMAIL_ADDRESS", "ip": "IP_ADDRESS", "tin": "TIN"}, {"EMAIL_ADDRESS": 0.7, "DOCUMENT_NUMBER": 0.72, "TIN": 0.82}, {"ip": 0.8}, window=16, overlap=4)
    assert params.gate()[1]["tin"] == 0.82

    def load():
        return lambda texts: [[(t.index("@") - 1, t.index("@") + 2, "B-mail", 0.8)] if "@" in t else [] for t in texts]

    text = "w " * 20 + "a@b " + "w " * 20
    df = spark.createDataFrame([(text,), ("",), (None,)], "text string")
    rows = plugins.classify_tokens(df, load, params, "m").collect()
    assert [(s["start"], s["end"], s["canonical"]) for s in rows[0]["model_spans"]] == [(40, 43, "email")]
    assert rows[1]["model_spans"] == [] and rows[2]["model_spans"] == []
    assert not one(spark, "Да. Перескажи Acme", lambda t: plugins.plausible_person(t, F.lit(4), F.lit(13)))
    assert one(spark, "Перескажи Ваня Миллипиздриков", lambda t: plugins.plausible_person(t, F.lit(10), F.lit(29)))


def test_windows(spark):
    for text in ("x" * 101, " " * 10 + "abcdef", "a b c d e f g h i j ", "", "   "):
        w = one(spark, text, lambda t: spans.chunk_windows(t, 4, 1))
        assert w[0]["start"] == 0 and max(x["end"] for x in w) == len(text)
        assert all(a["end"] >= b["start"] for a, b in zip(w, w[1:]))


def test_sampling(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("sample_id"), F.when(F.col("id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("l"), (F.col("id") % 3).cast("string")))).alias("labels"))
    df = df.withColumn("entity_count", F.size("labels"))
    a, b = (sorted(r[0] for r in sampling.random_sample(df.repartition(n), 10, 3).select("sample_id").collect()) for n in (1, 5))
    assert a == b and len(a) == 10
    balanced = sampling.label_balanced(df, 20, 1, 4).collect()
    assert len(balanced) == 20 and all(sum(x in r["labels"] for r in balanced) >= 4 for x in ("l0", "l1", "l2"))
    assert sampling.rebalance_quota(100, 0.2, 5, 500, 3) == {"negatives": 5, "positives": 95, "min_per_label": 15}
    assert sum(sampling.largest_remainder(17, {"a": 1, "b": 1, "c": 1}).values()) == 17
    with pytest.raises(ValueError):
        sampling.subset(df, "language=en")


def test_generator_is_stable_and_sound():
    text, found = synth.build(7, "en", "csv", "10k", "tail", False)
    assert (text, found) == synth.build(7, "en", "csv", "10k", "tail", False)
    assert len(text) >= 10_000 and {"email", "ip", "identifier", "secret"} <= {s["label"] for s in found}
    assert all(a["end"] <= b["start"] for a, b in zip(found, found[1:]))
    assert synth.build(7, "ru", "json", "10k", "head", True)[1] == []


def test_datasets(spark, tmp_path):
    rows = spark.createDataFrame([("1", "hi a@b", [(3, 6, "mail"), (2, 1, "x"), (None, 3, "y")])], "id string, source_text string, privacy_mask array<struct<start:int,end:int,label:string>>")
    spec = datasets.DatasetSpec("Some/Set", label_map={"MAIL": "email"})
    out = datasets.samples(rows, spec, "fast").first()
    assert out["sample_id"] == "some_set::fast::1" and [tuple(s) for s in out["gold"]] == [(3, 6, "mail", "email")] and out["labels"] == ["email"]
    datasets.write_samples(rows, str(tmp_path / "x.jsonl"), "jsonl")
    assert datasets.read_rows(spark, str(tmp_path / "x.jsonl"), "id string, source_text string").first()["source_text"] == "hi a@b"
    with pytest.raises(ValueError):
        datasets.parse_registry({"version": 2})
    assert reports.run_tag({"a": 1, "b": 2}) == reports.run_tag({"b": 2, "a": 1})


def test_chat_payloads(spark):
    payload = '{"messages": [{"role": "user", "content": "a"}, {"role": "user", "content": [{"type": "text", "text": "b"}, {"type": "image"}]}]}'
    df = spark.createDataFrame([("s", payload), ("t", '{"prompt": "p"}'), ("u", '{"choices": [{"message": {"role": "assistant", "content": "c"}}]}')], "session_id string, payload string")
    got = sorted((r["session_id"], r["item_idx"], r["text"]) for r in chats.flatten_messages(df).collect())
    assert got == [("s", 0, "a"), ("s", 1, "b"), ("t", 0, "p"), ("u", 0, "c")]
