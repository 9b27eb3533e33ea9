"""Queries that read whole tables, on tables made here."""

import re
from collections import Counter

from veilmark.plans import catalog


def test_urls_of_whole_pages(spark, tmp_path):
    html = "<p>see http://in.example/a and www.own.example/b" + " word" * 4000 + " or shop.com/c, http://in.example/a</p>"
    spark.createDataFrame([(1, "http://x.example/", html), (2, "http://y.example/", None), (3, None, "at plain.org")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r["page_id"], r["pattern"], r["value"]): r["n"] for r in catalog.QUERIES["detect_urls_whole_pages"](spark, str(tmp_path)).collect()}
    assert got == {
        (1, "url_http", "http://x.example/"): 1, (1, "url_http", "http://in.example/a"): 2, (1, "url_www", "www.own.example/b"): 1,
        (1, "url_domain_tld", "shop.com/c,"): 1, (2, "url_http", "http://y.example/"): 1, (3, "url_domain_tld", "plain.org"): 1,
    }


CARDS = {
    "Use card 4242 4242 4242 4242 for testing": (True, 16, True, True, True, 1.0, 0.08), "Random number 1234567890123456 in text": (True, 16, False, False, False, 0.9, 0.0),
    "Номер карты: 1234 5678 9012 3456": (True, 16, False, True, True, 1.0, 0.03), "Random number 1234 5678 9012 3456 in text": (True, 16, False, True, False, 1.0, 0.0),
    "Номер карты 1111 1111 1111 1111": (False, 16, False, True, True, 1.0, 0.0), "none": None,
}


def test_card_signal_of_documents(spark, tmp_path):
    texts = [*CARDS, "4242 4242 4242 4242 and again 1111 1111 1111 1111", None]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["payment_card_signal_documents"](spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter({k: len(re.findall(r"(?<!\d)(?:\d[ -]*?){13,19}(?!\d)", t or "")) for k, t in enumerate(texts)}) - Counter()
    assert {r["doc_id"]: tuple(r)[3:] for r in got if r["doc_id"] < len(CARDS)} == {k: v for k, v in enumerate(CARDS.values()) if v}
    assert sum(r["n"] for r in catalog.QUERIES["payment_card_signal"](spark, str(tmp_path)).collect()) == len(got)


def test_texts_that_have_the_mark(spark):
    from veilmark.operators import detect

    texts = [f"{detect.MARK} a1 {detect.MARK}{detect.MARK}b22{detect.INSTEAD} c", "b1 a2", "", f"no digit {detect.MARK}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [[t[r["start"] : r["end"]] for r in x["m"]] for t, x in zip(texts, df.select(detect.matches(df["t"], "[ab]\\d+").alias("m")).collect())]
    assert got == [["a1", "b22"], ["b1", "a2"], [], []]


def test_needs_hold_in_every_match(spark):
    """A text that a pattern matches has what the pattern is said to need, for the planted values of all families."""
    from veilmark.operators import gates
    from veilmark.plans import planted

    keys = spark.range(300).withColumnRenamed("id", "k")
    for cases in planted.FAMILIES.values():
        for name, hit, _ in cases:
            pattern, _ = catalog._pattern(name)
            need = gates.needs(pattern.regex)
            for r in keys.selectExpr(f"{hit} AS v").collect():
                assert all(set(r["v"]) & x for x in need), (name, r["v"])
    assert gates.needs("a|1") == frozenset() and gates.needs("(?:1|2)x*") == {frozenset("12")} and gates.needs("[^1]") == frozenset() and gates.needs(r"\p{L}@") in (frozenset(), {frozenset("@")})
