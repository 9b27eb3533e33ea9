"""The operators against plain Python on small tables with nulls, blanks, ties, copies, long texts and clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib
from array import array
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilmark.llm import chat, decontaminate, html_extract, jaccard_join, packing, quality_classifier, quality_rules, sharding, shingles, token_files, tokens, url_filter

VOCABULARY = tokens.default_vocabulary()
WORDS = "the of and thing over Ändern élan naïve river stone 42 x1 yes! end. (so) it's ### | <|endoftext|> İ Å ﬁ".split()


def text(r, n):
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    base = text(r, 120)
    out = [(i, text(r, r.choice([0, 1, 5, 40, 300]))) for i in range(30)]
    out += [(100, None), (101, ""), (102, " \n "), (103, base), (104, base), (105, base.upper().lower()), (106, base + " more words here"), (107, text(r, 9000)), (108, base), (108, base)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("own") for c in ("tokens", "shard", "slot", "n", "node", "p", "kept", "words", "hits", "items", "part", "piece")})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def ids(t):
    return array("I", Tokenizer.from_file(VOCABULARY).encode(t or "", add_special_tokens=False).ids).tobytes()


def crc(b):
    return zlib.crc32(b)


# --- 1 ---------------------------------------------------------------------------------------------------------------


def test_chunks_encode_as_whole_texts(rows):
    odd = ["a\tb\x0bc\x1cd e", "İstanbul, ǅ, 10²³ ＡＢ", "é, ́ É", "foo., ,foo 's don't, ΟΔΟΣ, Å", "x" * 5000 + ", " + "é" * 200, "".join(chr(i) + ", a" + chr(i) + " " for i in range(1, 0x800))]
    texts = [t or "" for _, t in rows] + odd
    assert tokens.encoder(VOCABULARY).ids_of(texts) == [ids(t) for t in texts]


def test_memo_stays_right_when_it_is_renewed(rows):
    texts = [t or "" for _, t in rows][:20]
    assert tokens.Encoder(VOCABULARY, 5).ids_of(texts * 2) == [ids(t) for t in texts] * 2


def test_token_files(spark, docs, rows, none, tmp_path):
    path = f"file://{tmp_path}/orc"
    token_files.write_tokens(docs, path, VOCABULARY)
    got = token_files.digests(spark, path).collect()
    tail = (2).to_bytes(4, "little")
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(ids(t)) // 4 + 1, crc(ids(t) + tail)) for i, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted(i for i, _ in rows)
    one = token_files.read_tokens(spark, path, [103])
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,103)]" in one._jdf.queryExecution().toString().replace("In(doc_id, [103])", "EqualTo(doc_id,103)")
    token_files.write_tokens(none, f"file://{tmp_path}/none", VOCABULARY)
    assert token_files.digests(spark, f"file://{tmp_path}/none").count() == 0


def test_files_have_what_readers_skip_by(spark, tmp_path):
    """Stripe footers with Bloom filters and row indexes on the ids, runs of integers, and strides that a search does not read."""
    df = spark.range(0, 40_000, 2, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("one and two").alias("text"))
    token_files.write_tokens(df, f"file://{tmp_path}/o", VOCABULARY, stripe_mb=1, stride=1_000)
    jvm = spark._jvm
    conf, kinds, strides = spark._jsc.hadoopConfiguration(), set(), set()
    for f in tmp_path.glob("o/*.orc"):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{f}"), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        strides.add(reader.getRowIndexStride())
        rows = reader.rows()
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            kinds |= {(x.getColumn(), x.getKind().toString()) for x in footer.getStreamsList()}
            assert {footer.getColumns(c).getKind().toString() for c in (1, 2)} <= {"DIRECT_V2", "DIRECT"}
        rows.close()
    assert strides == {1_000} and (1, "BLOOM_FILTER_UTF8") in kinds and (1, "ROW_INDEX") in kinds and (2, "BLOOM_FILTER_UTF8") not in kinds

    def scanned(ids):
        q = token_files.read_tokens(spark, f"file://{tmp_path}/o", ids).select("doc_id")
        n = q.count()
        plan = q._jdf.queryExecution().executedPlan()
        list(q.toLocalIterator())
        leaf = plan.collectLeaves().head()
        return n, leaf.metrics().apply("numOutputRows").value()

    found, read = scanned([20_000])
    missing, unread = scanned([20_001])  # within the bounds of a stride, but in no Bloom filter
    assert (found, missing) == (1, 0) and read <= 4_096 and unread < 20_000


# --- 2 ---------------------------------------------------------------------------------------------------------------


def test_quality_rules(docs, rows, none):
    ws = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for r in quality_rules.assess(docs).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect():
        w, t = ws(r["text"]), r["text"] or ""
        count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if ws(x)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r["kept"] and r["base_failed"])
    assert quality_rules.assess(none).count() == 0


def test_line_rules(spark):
    good = "This is a line of ordinary prose that ends as it should."
    cases = {good + "\n" + good.replace("ordinary", "plain"): True, "home | about | news | shop\n" + "BUY!! NOW!! " * 20: False, good + "\n" + "a | b | c | d | e | f | g | h | i | j | k | l": False}
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert [r["kept"] for r in quality_rules.assess(df).orderBy("doc_id").collect()] == list(cases.values())
    lines = [good] + [" ".join(f"w{i}x{j}" for j in range(12)) + "." for i in range(6)]
    cleaned = quality_rules.clean(spark.createDataFrame([(1, "\n".join([*lines[:3], "Accept cookies now please, thank you.", lines[0], "", *lines[3:]]))], "doc_id long, text string"))
    assert cleaned.first()["text"] == "\n".join([*lines[:3], "", *lines[3:]]) and cleaned.columns == ["doc_id", "text"]


def test_line_ends_do_not_matter(spark):
    lines = [f"Er kam {i}." for i in range(10)] + ["So it was said."] * 1
    ends = ["\n", "\r\n", " \t\n", "\x0b\n"]
    got = [r["kept"] for r in quality_rules.assess(spark.createDataFrame([(i, e.join(lines) + e) for i, e in enumerate(ends)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [True] * 4


def test_each_line_rule(spark):
    good = "This is a line of ordinary prose that ends as it should."
    bad = [
        "see http://a.example/x and www.b.example/y http://c.example", "Home » News » Sport » More of it", "© 2020 Somebody and others who own it.", "(C) 2019 A company of some kind.", "Copyright by us, and nobody else at all.",
        "Alle Rechte vorbehalten, wie immer und überall.", "Tous droits réservés par la maison et ses amis.", "Lea la política de privacidad de este sitio.", "short one", "$$ ## a b c d e", "No! No! No! yes",
    ]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([good, *bad])], "i long, line string")
    got = {r["i"]: r["f"] for r in rows.select("i", quality_rules.line_fails(F.col("line"), F.size(quality_rules.words_of(F.col("line")))).alias("f")).collect()}
    assert got == {0: False, **{i + 1: True for i in range(len(bad))}}


# --- 3 ---------------------------------------------------------------------------------------------------------------


def shingle_set(t, k):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(rows, k, percent):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b) or sets[i][0] == sets[j][0] and a:
                up[find(i)] = find(j)
    least = defaultdict(lambda: 10**9)
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least[find(i)], d)
    return Counter((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def near_copies(seed, groups=6, copies=12, words=80):
    """Groups of copies with a few changed words each, around the threshold; some chains."""
    r = random.Random(seed)
    out, n = [], 0
    shared = " ".join(f"p{i}" for i in range(60))
    for g in range(groups):
        w = [f"w{r.randint(0, 4000)}" for _ in range(r.choice([6, words, 3 * words]))]
        for _ in range(copies):
            out.append((n, " ".join(w) + (" " + shared if g % 2 else "")))
            n += 1
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = f"w{r.randint(0, 4000)}"
    return out


@pytest.mark.parametrize("seed, k, percent", [(1, 4, 85), (2, 5, 80)])
def test_jaccard_components(spark, seed, k, percent):
    rows = near_copies(seed)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert Counter(map(tuple, got)) == components(rows, k, percent)


def test_jaccard_edge_cases(spark, docs, rows, none):
    got = jaccard_join.jaccard_components(docs, 4, 85).collect()
    assert Counter(map(tuple, got)) == components(rows, 4, 85)
    assert jaccard_join.jaccard_components(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "A B c d e f"), (None, "solo one two three four five six")], "doc_id long, text string")
    assert Counter(map(tuple, jaccard_join.jaccard_components(odd, 4, 85).collect())) == Counter([(None, 3, 3), (3, 3, 3), (None, 4, None)])
    kept = jaccard_join.one_of_each(docs, 4, 85)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {c for _, _, c in components(rows, 4, 85)}


def test_one_of_each_keeps_rows_by_their_texts(spark):
    w = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*w[:k], f"x{k}", *w[k + 1 :]])
    rows = [
        (None, near(1)), (None, near(30)), (None, "a text of its own with no id"), (None, "another text of its own without id"), (None, "another text of its own without id"),
        (7, "one text that has the number seven"), (7, "quite another one that has this number too"), (8, "text with number eight is here twice"), (8, "text with number eight is here twice"),
        (None, ""), (None, None), (9, " "), (9, " "),
    ]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("own")), 4, 70)
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert kept.columns == ["doc_id", "text", "kept"] and sum(got[r] for r in rows[:2]) == 1
    assert got - Counter(rows[:2]) == Counter(set(rows[2:9]) | set(rows[9:])) + Counter([(9, " ")])
    linked = jaccard_join.jaccard_components(spark.createDataFrame([(None, near(30)), (1, near(10)), (2, near(50))], "doc_id long, text string"), 4, 70)
    assert {r["component_id"] for r in linked.collect()} == {1}


def test_large_blocks_are_chunked(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", 4)
    rows = near_copies(9, groups=3, copies=20)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert Counter(map(tuple, got)) == components(rows, 4, 85)


def test_traversal_finds_all_pairs_that_link():
    r = np.random.default_rng(3)
    base = [np.unique(r.integers(0, 2**63, 60, dtype=np.uint64)) for _ in range(4)]
    sets = [np.unique(np.concatenate([b[r.random(len(b)) > 0.08], r.integers(0, 2**63, 2, dtype=np.uint64)])) for b in base for _ in range(15)]
    rows = [{"node": i, "root": i, "n": len(s), "map": jaccard_join.bitmap(s).tobytes(), "side": 0} for i, s in enumerate(sets)]
    told = jaccard_join.block_pairs(rows, 80, False)
    links = {(j, i) for i in range(len(sets)) for j in range(i) if 180 * len(np.intersect1d(sets[i], sets[j])) >= 80 * (len(sets[i]) + len(sets[j]))}
    assert links and links <= told and len(told) < len(sets) ** 2 / 4
    forest = jaccard_join.block_pairs(rows, 80, True)
    assert forest <= told and len(forest) < len(sets)


def test_shingles_agree_with_words(rows):
    for k in (1, 4, 5):
        mine = [len(s) for s in shingles.shingle_sets([t for _, t in rows], k)]
        assert mine == [len(shingle_set(t, k)) for _, t in rows]
    a, b = shingles.shingle_sets(["One two THREE four five", "zero one TWO three four five"], 4)
    assert set(a.tolist()) < set(b.tolist())


def test_long_texts_and_words_in_pieces(monkeypatch):
    r = random.Random(4)
    long = " ".join(r.choice(["a", "Bc", "d" * 40, "é"]) + str(r.randrange(50)) for _ in range(5000))
    texts = [long, "x" * 3000, "", " \n" * 900, "one two", long[:777], None, "y" * 999 + " z"]
    whole = [s.tolist() for s in shingles.shingle_sets(texts, 4)]
    monkeypatch.setattr(shingles, "CHUNK_BYTES", 512)
    assert [s.tolist() for s in shingles.shingle_sets(texts, 4)] == whole and [len(s) for s in whole] == [len(shingle_set(t, 4)) for t in texts]


def test_long_words_have_no_constructed_twins():
    bits = "0"
    for _ in range(12):  # a sequence and its complement have equal polynomials modulo 2**64 from a length of 2048 on
        bits += bits.translate({48: 49, 49: 48})
    a, b = (next(shingles.shingle_sets([x], 1)) for x in (bits, bits.translate({48: 49, 49: 48})))
    assert a.tolist() != b.tolist()


def test_sketches_are_summed_in_stages(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SKETCHES", 2)
    docs = spark.createDataFrame([(i, f"one two three {i} four") for i in range(30)], "doc_id long, text string").repartition(7)
    total = sum(np.bincount((s >> np.uint64(44)).astype(np.int64), minlength=jaccard_join.BUCKETS) for s in shingles.shingle_sets([r["text"] for r in docs.collect()], 3))
    sketch = jaccard_join._sketch(jaccard_join.written(jaccard_join._sets(docs, 3, 0), "sets"))
    assert (sketch == np.minimum(255, 4 * np.log2(1.0 + total)).astype(np.uint8)).all()


def test_connected(spark):
    r = random.Random(8)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    up = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = dict(jaccard_join.connected(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {n: c for n, c in up.items() if n in got} and all(up[n] == n for n in set(up) - set(got))


# --- 4 ---------------------------------------------------------------------------------------------------------------


def test_quality_classifier(spark):
    r = random.Random(2)
    good = lambda: " ".join(r.choice("the river ran over stones and on to the sea today".split()) for _ in range(60)) + "."
    bad = lambda: " ".join(r.choice(["BUY!!", "NOW***", "$$$", "a | b"]) for _ in range(60))
    rows = [(i, bad() if i % 5 == 0 else good(), "h0" if i % 3 else f"h{i}", "p") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("kept", F.lit("own"))
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 200)] + [(None, 1), (3, None), (9999, 1)], "doc_id long, quality int")
    out = quality_classifier.classify(docs, labels).collect()
    held = [(r["doc_id"] % 5 != 0) == r["kept"] for r in out if r["doc_id"] >= 200]
    assert sum(held) / len(held) >= 0.97
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("kept = 'own'").count() == sum(r["kept"] for r in out)
    odd = spark.createDataFrame([(1, None, None, None), (2, "", "x", None)], "doc_id long, text string, source string, lang string")
    assert quality_classifier.classify(odd, labels).count() == 2 and quality_classifier.classify(odd.where("false"), labels).count() == 0
    assert {r["posterior"] for r in quality_classifier.classify(odd, labels.where("false")).collect()} and quality_classifier.classify(odd, labels.where("quality = 1")).count() == 2


def test_classifier_against_plain_python(spark):
    """The fit, the sites' rates and the verdicts, all worked out again from the labelled and the other documents."""
    r = random.Random(12)
    words = "the river ran over stones BUY!! NOW $$$ a | b and on to the sea today.".split()
    rows = [(i, " ".join(r.choice(words[: r.choice([5, 17])]) for _ in range(r.choice([0, 3, 30, 80]))), r.choice(["a", "b", "b", "b", None]), r.choice(["x", "y", None])) for i in range(150)]
    rows += [rows[3], rows[3], (None, "no id at all", "a", "x"), (151, None, None, None), (152, "word " * 200_000, "solo", "x")]
    marks = [(i, int(i % 3 > 0)) for i in range(0, 60)] + [(5, 0), (7, None), (9999, 1), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({"n": F.lit("own"), "other": F.lit(1)})
    out = quality_classifier.classify(docs, spark.createDataFrame(marks, "doc_id long, quality int")).collect()

    quality = {}
    for i, q in marks:
        if i is not None and q is not None:
            quality[i] = min(q, quality.get(i, q))
    known = {i: t for i, t, _, _ in rows if i in quality}
    x = np.array([quality_classifier.features(known[i]) for i in sorted(known)])
    y = np.array([float(quality[i] > 0) for i in sorted(known)])
    z = np.hstack([np.ones((len(x), 1)), np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), -8, 8)])
    w = np.zeros(z.shape[1])
    for _ in range(40_000):  # plain gradient steps to the same optimum
        slope = z.T @ (y - 1 / (1 + np.exp(-z @ w))) - np.r_[1e-6, np.ones(x.shape[1])] * w
        w += 0.004 * slope
    f = np.array([quality_classifier.features(t) for _, t, _, _ in rows])
    p = 1 / (1 + np.exp(-np.hstack([np.ones((len(f), 1)), np.clip((f - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), -8, 8)]) @ w))
    p = np.clip(p, 1e-6, 1 - 1e-6)
    of_path, of_host = defaultdict(list), defaultdict(list)
    for (_, _, host, path), own in zip(rows, p):
        of_path[host, path].append(own)
        of_host[host].append(own)
    mean = p.mean()

    def strength(groups):
        total = sum(len(v) for v, _ in groups)
        spread = sum(len(v) * (np.mean(v) - m) ** 2 for v, m in groups) / total
        return min(1e6, max(1.0, mean * (1 - mean) / max(spread, 1e-9) - 1))

    k1 = strength([(v, mean) for v in of_host.values()])
    host_rate = {h: (sum(v) + k1 * mean) / (len(v) + k1) for h, v in of_host.items()}
    k2 = strength([(v, host_rate[h]) for (h, _), v in of_path.items()])
    odds = lambda q: np.log(q / (1 - q))
    expected = []
    for (i, _, host, path), own in zip(rows, p):
        group = of_path[host, path]
        rate = min(1 - 1e-6, max(1e-6, (sum(group) - own + k2 * host_rate[host]) / (len(group) - 1 + k2)))
        expected.append((i, host_rate[host], rate, 1 / (1 + np.exp(-(odds(own) - odds(y.mean()) + odds(rate)))), own))
    key = lambda r: (str(r[0]), r[3])
    got = sorted(((r["doc_id"], r["host_rate"], r["path_rate"], r["posterior"], r["p"]) for r in out), key=key)
    assert len(got) == len(rows) and 0 < sum(r["kept"] for r in out) < len(rows) and all(r["kept"] == (r["posterior"] >= 0.5) for r in out)
    for a, b in zip(got, sorted(expected, key=key)):
        assert a[0] == b[0] and np.allclose(a[1:], b[1:], atol=2e-4), (a, b)


def test_sparse_sites_shrink_more(spark):
    rows = [(i, "x", "big", "a") for i in range(200)] + [(300, "x", "small", "a")]
    scored = spark.createDataFrame([(h, p, 0.9 if h == "big" else 0.1) for _, _, h, p in rows], "source string, lang string, p double")
    rates = {r["_host"]: r["host_rate"] for r in quality_classifier.site_rates(scored, "source", "lang").collect()}
    assert abs(rates["big"] - 0.9) < 0.02 and rates["small"] > 0.15


# --- 5 ---------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>no</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/a>menu {n}</a></ul></nav>
<header>Site</header><div class="cookie-notice">We use cookies</div><!-- <p>no</p> --><article><h1>Title &amp; {n}</h1><p><b>First {n}<br>line<p>Second&nbsp;a<i>b</i>c {n}
<p>Constant words on all pages of the host.<aside>side</aside><form><p>mail</p></form><div class="comments"><p>said {n}</p></div></article><footer>&copy; x</footer>"""


def test_html_extract(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.replace("{n}", str(i))) for i in range(8)]
    rows += [(100, "http://h.example/0", rows[0][2]), (101, None, None), (102, "", ""), (103, "x", "plain <b>text</b>"), (104, "http://d.example/", "<div>" * 2000 + "deep"), (105, "http://m.example/", "<main><p>in main</p></main><p>out</p>")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("own"))).collect()}
    assert got[3] == "Title & 3\n\nFirst 3 line\n\nSecond abc 3\n\nConstant words on all pages of the host." and got[100] == got[0]
    assert (got[101], got[102], got[103], got[104], got[105]) == ("", "", "plain text", "deep", "in main")
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tree_matching():
    a, b = html_extract.read_shape("page(body(nav article(h1 p) footer))"), html_extract.read_shape("page(body(div article(h1 ul(li) p) footer))")
    assert html_extract.match_trees(a, b)[0] == 6
    assert html_extract.induce(["page(body(nav article(h1 p)))", "page(body(article(h1 ul p) footer))"]) == "page(body(nav article(h1 ul p) footer))"


def test_a_host_with_hundreds_of_shapes(spark):
    r = random.Random(11)
    rows = []
    for i in range(400):  # 400 orders of blocks; the template text moves with the article above it
        parts = [f"<{t}>own {i} {k}</{t}>" for k, t in enumerate(r.choice(["p", "ul", "h2", "pre", "table", "dl", "address", "figure", "details"]) for _ in range(r.randint(4, 9)))]
        rows.append((i, f"http://hot.example/{i}", "<body><div>" + "".join(parts) + "<blockquote>Read on in our paper</blockquote></div>" + "".join(parts[:2]).replace("own", "more") + "</body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    shapes = {html_extract.parse(h)[0].text() for _, _, h in rows}
    wrapper = html_extract.induce_wrappers(pages.select(F.lit("h").alias("host"), "html")).first()["wrapper"]
    assert len(shapes) > 300 and all(slot >= 0 for _, _, h in rows for _, slot in html_extract.aligned(h, wrapper)[0])
    got = {x["page_id"]: x["text"] for x in html_extract.extract(pages).collect()}
    assert all("paper" not in t and f"own {i} 0" in t for i, t in got.items())


def extracted(spark, pages):
    rows = [(k, url, html) for k, (url, html) in enumerate(pages)]
    return [r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


@pytest.mark.parametrize("own", ['<body class="single right-sidebar"><div>{}</div></body>', '<body><div class="content no-sidebar">{}</div></body>', '<body><article class="post comments-open">{}</article></body>', '<body class="has-header"><main class="no-ads">{}</main></body>'])
def test_words_do_not_drop_an_article(spark, own):
    side = '<div class="sidebar"><ul><li>see {n}</ul></div><div class="newsletter"><p>Join us</p></div><div class="comments"><p>said {n}</p></div>'
    inner = "<h1>Title {n}</h1><p>A long text about number {n} of the series.</p><ul><li>point {n}</ul>"
    pages = [("http://w.example/", own.format(inner + side).replace("{n}", str(k))) for k in range(8)]
    assert extracted(spark, pages) == [f"Title {k}\n\nA long text about number {k} of the series.\n\npoint {k}" for k in range(8)]


def test_constants_of_layouts_and_of_small_hosts(spark):
    a = "<div><h1>Title {n}</h1><p>Text {n}, as it is told</p><blockquote>Printed on paper</blockquote></div>"
    b = "<table><tr><td>Entry {n} of a long list</td></tr></table><pre>All prices in euro</pre>"
    two = [("http://two.example/", (a if k % 2 else b).replace("{n}", str(k))) for k in range(20)]
    few = [("http://few.example/", a.replace("{n}", str(k))) for k in range(2)]
    got = extracted(spark, two + few + [("http://one.example/", a.replace("{n}", "x"))])
    assert got[:20] == [f"Title {k}\n\nText {k}, as it is told" if k % 2 else f"Entry {k} of a long list" for k in range(20)]
    assert got[20:] == ["Title 0\n\nText 0, as it is told", "Title 1\n\nText 1, as it is told", "Title x\n\nText x, as it is told\n\nPrinted on paper"]


def test_editions_of_one_article_stay_whole(spark):
    """Two pages, and seven, that share most of an article, with tags that tell it and without."""
    shared = ["Title of the piece", "The first paragraph, which all of them have and which is long.", "The last one, which all of them have as well, at some length."]
    for tag in ("article", "div", "main"):
        for n in (2, 7):
            own = [f"What edition {k} says about it." for k in range(n)]
            pages = [("http://e.example/%d" % k, f"<body><{tag}><h1>{shared[0]}</h1><p>{shared[1]}</p><p>{own[k]}</p><p>{shared[2]}</p></{tag}></body>") for k in range(n)]
            assert extracted(spark, pages) == ["\n\n".join([*shared[:2], own[k], shared[2]]) for k in range(n)]


def test_all_articles_and_buttons_within_sentences(spark):
    page = "<body><article><p>Press <button>Start</button> to begin.</p></article><article class=second><h2>More</h2><p>The same</p><p>The same</p></article><nav>x</nav></body>"
    assert extracted(spark, [("http://b.example/", page)]) == ["Press Start to begin.\n\nMore\n\nThe same\n\nThe same"]


def test_made_up_class_names_do_not_grow_the_wrapper(spark):
    name = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    html = lambda k: f"<body><div class='x{name(k)}'><p>Own text {k} of a page, long enough to be told.</p></div><div class='foot y{name(k)}'><p>All rights</p></div></body>"
    rows = [(k, f"http://g.example/{k}", html(k)) for k in range(1000, 1400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("g.example"))
    words = html_extract.common_words(pages)
    assert words.first()["common"] == "foot"
    wrapper = html_extract.induce_wrappers(pages.join(words, "host")).first()["wrapper"]
    assert wrapper == "page(body(div(p) div.foot(p)))"
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got == {k: f"Own text {k} of a page, long enough to be told." for k, _, _ in rows}


ODD_PAGES = {
    "alternating": "<p>a</p><h2>b</h2>" * 60_000, "unclosed tags": "<a " * 350_000, "quotes": "<a '<b \"" * 120_000, "balanced quotes": '<a ">" ' * 150_000, "deep": "<div>" * 60_000 + "x",
    "closers": "<div>" * 30_000 + "</p>" * 200_000, "items": "<ul>" + "<li>a" * 200_000, "comments": "<!--" * 200_000, "adverts": '<div class="ad">' * 20_000 + "x", "tables": "<table><tr><td>a<td>b" * 10_000,
}


@pytest.mark.parametrize("name", ODD_PAGES)
def test_odd_pages_take_linear_time(name):
    def seconds(html):
        at = time.process_time()
        root, blocks = html_extract.parse(html)
        html_extract.number(root)
        html_extract.main_text(html, html_extract.induce([root.text()]), frozenset())
        return time.process_time() - at

    html = ODD_PAGES[name]
    assert seconds(html) < 30 and seconds(html) < 10 * seconds(html[: len(html) // 4]) + 2


def test_heaviest_subsequence():
    r = random.Random(9)
    for _ in range(200):
        pairs = sorted({(r.randrange(6), r.randrange(6)) for _ in range(r.randrange(1, 10))}, key=lambda p: (p[0], -p[1]))
        weights = [r.randrange(1, 9) for _ in pairs]
        got = html_extract._heaviest(pairs, weights)
        grows = lambda s: all(pairs[a][0] < pairs[b][0] and pairs[a][1] < pairs[b][1] for a, b in zip(s, s[1:]))
        best = max(sum(weights[i] for i in s) for n in range(len(pairs) + 1) for s in combinations(range(len(pairs)), n) if grows(s))
        assert grows(got) and sum(weights[i] for i in got) == best


def plain_hosts(seed=21, hosts=6, pages=25):
    """Pages whose tags and classes tell nothing: what repeats on a host is template, what differs is content."""
    r = random.Random(seed)
    say = lambda n: " ".join("".join(r.choice("abdeiklmnorstu") for _ in range(r.randint(2, 8))) for _ in range(n))
    out = []
    for h in range(hosts):
        fixed = [f"<div class=k{k}><div>{say(3)}</div><ul><li>{say(2)}</li><li>{say(2)}</li></ul></div>" for k in range(4)]
        inner = f"<div><p>{say(9)}</p></div>"  # within the content, where only its slot tells it
        tail = f"<div class=z><p>{say(12)}</p><p>{say(4)}</p></div>"
        for n in range(pages):
            own = [say(r.randint(4, 60)) for _ in range(r.randint(2, 7))]
            body = "".join(f"<{t}>{x}</{t}>" for t, x in zip(r.choices(["p", "h2", "pre"], k=len(own)), own))
            some = fixed if n % 7 else fixed[:3]
            out.append((f"http://h{h}.example/{n}", f"<body>{''.join(some[:2])}<div class=m>{body}{inner}</div>{''.join(some[2:])}{tail}</body>", own))
    return out


def test_the_wrapper_finds_what_no_tag_or_class_tells(spark):
    pages = plain_hosts()
    got = extracted(spark, [(url, html) for url, html, _ in pages])
    told, right, wanted = 0, 0, 0
    for text, (url, _, own) in zip(got, pages):
        blocks = text.split("\n\n") if text else []
        told, wanted, right = told + len(blocks), wanted + len(own), right + len(set(blocks) & set(own))
    assert right / wanted >= 0.99 and right / told >= 0.99, (told, right, wanted)


def test_extraction_against_a_plain_wrapper(spark):
    """Template found anew: slots are paths, and a text on 60 % of the host's different pages that have the path (or anywhere on them) is constant."""
    pages = plain_hosts(5, hosts=3, pages=15)
    seen, having = defaultdict(set), defaultdict(set)

    def blocks_of(html):
        path, out = [], []
        for closing, tag, text in re.findall(r"<(/?)([a-z0-9]+)[^>]*>([^<]*)", html):
            if closing:
                path.pop()
            else:
                path.append(tag)
            if text:
                out.append(("/".join(path), text))
        return out

    for n, (url, html, _) in enumerate(pages):
        host = url.split("/")[2]
        for path, text in blocks_of(html):
            for slot in (path, "page"):
                seen[host, slot, text].add(n)
                having[host, slot].add(n)
    constant = lambda host, slot, text: len(seen[host, slot, text]) >= max(0.6 * len(having[host, slot]), 3)
    expected = ["\n\n".join(t for p, t in blocks_of(html) if not constant(url.split("/")[2], p, t) and not constant(url.split("/")[2], "page", t)) for url, html, _ in pages]
    assert extracted(spark, [(url, html) for url, html, _ in pages]) == expected


# --- 6 ---------------------------------------------------------------------------------------------------------------


def occurrences(doc, items, window=10):
    hit, found = set(), set()
    for item, t in items:
        w = decontaminate.words(t)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            for j in range(len(doc) - m + 1):
                if doc[j : j + m] == w[i : i + m]:
                    hit |= set(range(j, j + m))
                    found.add(item)
    return hit, found


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontaminate(spark, docs, rows, none, block):
    r = random.Random(3)
    items = [(1, " ".join(rows[7 + k][1].split()[:14])) if len((rows[7 + k][1] or "").split()) > 14 else (1, "river STONE the") for k in range(1)]
    items += [(2, "the-of"), (3, None), (4, "!!"), (5, text(r, 30)), (6, " ".join((rows[33][1]).split()[20:45])), (7, " ".join((rows[33][1]).split()[20:45])), (8, "élan")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_passages(docs, bench, 10, block)
    for x in out.collect():
        w = decontaminate.words(x["text"])
        hit, found = occurrences(w, items)
        mine = {j for a, b in zip(x["hits"][::2], x["hits"][1::2]) for j in range(a, b)}
        assert (x["n_words"], mine, set(x["items"])) == (len(w), hit, found)
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and decontaminate.find_passages(none, bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.where("false")).count() == docs.count()


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_items_without_id_give_hits(spark, block):
    bench = spark.createDataFrame([(None, "a passage that nobody should learn by heart at all, ever"), (4, "the river"), (None, "the river")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so: A passage that nobody should learn by heart at all, ever."), (2, "by the river"), (3, "clean")], "doc_id long, text string")
    got = {r["doc_id"]: (r["hits"], r["items"]) for r in decontaminate.find_passages(docs, bench, 10, block).collect()}
    assert got == {1: ([1, 12], []), 2: ([1, 3], [4]), 3: ([], [])}
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()] == [3]


def test_repeated_windows_and_long_texts(spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (1, item), (2, item + " twelve"), (3, "of the " * 3000)], "item_id long, text string")
    long = "the of " * 400_000 + item
    docs = spark.createDataFrame([(1, item), (1, item), (2, long), (None, None)], "doc_id long, text string")
    for block in (1 << 20, 9_000):
        got = {(r["doc_id"], r["n_words"]): (r["hits"], r["items"]) for r in decontaminate.find_passages(docs, bench, 10, block).collect()}
        assert got == {(1, 11): ([0, 11], [1, 2]), (2, 800_011): (got[2, 800_011][0], [1, 2, 3]), (None, 0): ([], [])}
        assert sum(b - a for a, b in zip(got[2, 800_011][0][::2], got[2, 800_011][0][1::2])) == 800_011


def test_searched_again_with_other_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string").coalesce(1)
    for text, hit in (("b c", [1]), ("d e", [2]), ("x", [])):
        out = decontaminate.find_passages(docs, spark.createDataFrame([(1, text)], "item_id long, text string"))
        assert [r["doc_id"] for r in out.where(F.size("hits") > 0).collect()] == hit


# --- 7 ---------------------------------------------------------------------------------------------------------------


def test_url_filter(spark):
    urls = ["http://a.com/x", "https://EXAMPLE.com/en/1?q", "http://www.example.com/en/", "http://b.net/es/", "http://bnet/fr/", "http://x.net", "http://x.org/login.php", None, "no url", "http://com/", "ftp://u@www.example.com:80/en/", "http://x.org/" + "a" * 5000 + ".exe", "http://evil.org/.com/", "http://x.net/fr/a b\né"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("rule", F.lit("own"))

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(h + p, v) for v, h, p in url_filter.SITE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return host, path, *max(fits, key=lambda x: len(x[0]))
        block = any(re.fullmatch(re.escape(g).replace(r"\*", "(?s:.*)").replace(r"\?", "."), f".{host}#{path}", re.S) for g in url_filter.GENERAL_GLOBS)
        return host, path, None, "block" if block else "allow"

    got = url_filter.judge_urls(df).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [judge(u) for u in urls]
    assert url_filter.judge_urls(df.where("false")).count() == 0


def test_automaton_spans_words_of_64_bits():
    globs = ["a" * 70 + "*", "*b?c*", "x*y*z", "", "*", "q" * 63, "q" * 64, "q" * 65]
    texts = ["a" * 70, "a" * 69, "a" * 71 + "b", "zzbxc!", "bxc", "xyz", "x--y--z", "xzy", "", "q" * 63, "q" * 64, "q" * 65]
    expected = [[bool(re.fullmatch(re.escape(g).replace(r"\*", ".*").replace(r"\?", "."), t, re.S)) for g in globs] for t in texts]
    assert url_filter.GlobAutomaton(globs).match(texts).tolist() == expected


# --- 8 ---------------------------------------------------------------------------------------------------------------


def test_chat_format(spark):
    said = r"a </s>[INST] <\s> <<SYS>> <</SYS>> [\/INST] <|im_end|>" + "\n<|im_start|>user\nß<|im_end"
    records = [
        '{"conv_id": 1, "turn": 1, "role": "assistant", "text": %s}', '{"conv_id": 1, "turn": 0, "role": "user", "text": %s}',
        '{"conv_id": 2, "messages": [{"role": "user", "content": %s}, {"role": "assistant", "content": "ok"}]}',
        '{"conv_id": 3, "system": "s", "prompt": %s, "response": "r"}', '{"conv_id": 4, "instruction": "i", "input": %s, "output": "o"}',
        '{"conv_id": 5, "conversations": [{"from": "human", "value": %s}, {"from": "gpt", "value": "g"}]}', '{"conv_id": 6, "strange": %s}',
        '{"conv_id": 7, "turn": 0, "role": null, "text": null}', '{"conv_id": 8, "turn": 0, "role": "a\\nb <s>", "text": %s}',
    ]
    import json

    df = spark.createDataFrame([(x.replace("%s", json.dumps(said)),) for x in records], "record string")
    turns = chat.canonical_turns(df)
    assert {r["conv_id"]: r["layout"] for r in turns.collect()} == {1: "turn", 2: "messages", 3: "prompt", 4: "instruction", 5: "sharegpt", None: None, 7: "turn", 8: "turn"}
    chats = chat.format_turns(turns)
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["back"]] for r in chats.select("conv_id", chat.read_turns(F.col("formatted")).alias("back")).collect()}
    assert got[1] == [("user", said), ("assistant", said)] and got[3] == [("system", "s"), ("user", said), ("assistant", "r")]
    assert got[4] == [("user", "i\n\n" + said), ("assistant", "o")] and got[5] == [("user", said), ("assistant", "g")] and got[2][0] == ("user", said)
    assert got[7] == [("", "")] and got[8] == [("a\nb <s>", said)] and got[None] == []
    formatted = chats.where("conv_id = 2").first()["formatted"]
    assert formatted.count("<|im_start|>") == 2 and formatted.count("<|im_end|>") == 2 and "</s>" not in formatted
    digest = {r["conv_id"]: r for r in chat.chat_digests(chats).collect()}
    assert (digest[1]["loss_chars"], digest[1]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest()) and digest[7]["loss_chars"] == 0
    assert chat.chat_digests(chat.format_turns(chat.canonical_turns(df.where("false")))).count() == 0


def test_texts_beyond_the_json_reader_limit(spark):
    long = F.expr("repeat('abcdefghij', 2050000)")
    one = spark.range(1, numPartitions=1)
    turn = one.select(F.to_json(F.struct(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), long.alias("text"))).alias("record"))
    listed = one.select(F.to_json(F.struct(F.lit(2).alias("conv_id"), F.array(F.struct(F.lit("user").alias("role"), long.alias("content"))).alias("messages"))).alias("record"))
    got = chat.canonical_turns(turn.unionByName(listed)).select("conv_id", "layout", F.length(F.col("turns")[0]["text"]).alias("n")).collect()
    assert sorted(map(tuple, got)) == [(1, "turn", 20_500_000), (2, "messages", 20_500_000)]


def test_fingerprints_hold_nested_paths(spark):
    records = {
        '{"conv_id": 1, "messages": [{"role": "user", "content": "q"}]}': "messages", '{"messages": [{"content": null, "role": "user"}], "conv_id": 1}': "messages",
        '{"conv_id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "user", "content": "q", "name": "n"}]}': "messages", '{"conv_id": 1, "source": "x", "messages": [{"role": "user", "content": "q", "meta": {"a": [1]}}]}': "messages",
        '{"conv_id": 1, "messages": {"role": "user", "content": "q"}}': None, '{"conv_id": 1, "messages": []}': "messages", '{"messages": [{"role": "user"}], "conv_id": 1}': None, '{"conv_id": 1, "odd key, <x>: `y`": 1, "conversations": []}': "sharegpt",
        '{"conv_id": 1, "messages": [{"role": "user", "content": {"text": "q"}}]}': None, '{"conv_id": 1, "messages": [[]]}': None, '{"conv_id": 1, "prompt": ["a", "b"], "response": "r"}': None,
        '{"conv_id": 1, "prompt": 7.5, "response": true}': "prompt", "[1]": None, '{"conv_id": 1, "instruction": "i", "output": "o", "input": null, "system": null}': "instruction",
    }
    df = spark.createDataFrame([(k, i) for i, k in enumerate(records)] + [(None, 99)], "record string, i int")
    got = chat.canonical_turns(df.coalesce(1)).collect()
    assert [r["layout"] for r in got] == [*records.values(), None]


def test_tables_have_a_fingerprint_too(spark):
    said = [(1, 1, "assistant", "b"), (1, 0, "user", "a <s>"), (1, 0, "user", "a <s>"), (None, 0, None, None), (2, 0, "x", "")]
    turns = chat.turns_of_table(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: [tuple(t) for t in r["back"]] for r in chat.format_turns(turns).select("conv_id", chat.read_turns(F.col("formatted")).alias("back")).collect()}
    assert got == {1: [("user", "a <s>"), ("user", "a <s>"), ("assistant", "b")], None: [("", "")], 2: [("x", "")]}
    listed = spark.createDataFrame([(5, [("user", "q"), ("assistant", "r")]), (6, None)], "conv_id long, messages array<struct<role:string,content:string>>")
    assert [(r["conv_id"], r["layout"], [t["text"] for t in r["turns"]]) for r in chat.turns_of_table(listed).orderBy("conv_id").collect()] == [(5, "messages", ["q", "r"]), (6, "messages", [])]
    asked = chat.turns_of_table(spark.createDataFrame([(7, "p", "r")], "conv_id long, prompt string, response string")).first()
    assert [(t["role"], t["text"]) for t in asked["turns"]] == [("user", "p"), ("assistant", "r")]
    clash = chat.turns_of_table(spark.createDataFrame([(7, "p")], "conv_id long, layout string")).first()
    assert (clash["layout"], clash["turns"]) == (None, [])
    more = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("mine") for c in ("layout", "turns", "r", "source", "a.b")})
    assert sorted(map(repr, chat.turns_of_table(more).collect())) == sorted(map(repr, turns.collect()))
    assert {r["layout"]: (r["records"], r["turns"]) for r in chat.layouts(turns).collect()} == {"turn": (5, 5)}


@pytest.mark.parametrize("record", ['{"conv_id": 1, "turn": 0, "role"', "no JSON", '{"conv_id": "one", "turn": 0, "role": "user", "text": "t"}'])
def test_records_that_are_not_read_are_errors(spark, record):
    with pytest.raises(Exception, match="no JSON|MALFORMED_RECORD"):
        chat.canonical_turns(spark.createDataFrame([(record,)], "record string")).collect()


def test_escape_is_reversible(spark):
    r = random.Random(6)
    parts = [*chat.CONTROLS, "\\", "<", "[", "s>", "/s>", "INST]", "<\\", "|im_end|>", "x", "\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u"))
    for x in df.collect():
        assert x["u"] == x["t"] and not any(c in x["e"] for c in chat.CONTROLS)


# --- 9 ---------------------------------------------------------------------------------------------------------------


def test_packing(docs, rows, none):
    out = packing.pack(docs, VOCABULARY, tokens=256, with_ids=True).collect()
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
        assert r["length"] == len(r["ids"]) // 4 and r["ids_crc32"] == crc(bytes(r["ids"]))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 256
    assert len(seqs) <= sum(r["length"] for r in out) / 256 * 1.05 + 1
    for i, t in rows:
        if sum(d == i for d, _ in rows) == 1:
            own = sorted(pieces[i], key=lambda r: r["piece"])
            assert b"".join(bytes(r["ids"]) for r in own) == ids(t) + bytes(4)
            assert all(r["length"] == 256 and r["start"] == 256 * k for k, r in enumerate(own[:-1]))
    assert packing.pack(none, VOCABULARY).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_constraint(rule):
    r = random.Random(4)
    counts = {n: r.randint(1, 30) for n in r.sample(range(1, 101), 40)}
    capacity = (100, 4, 6000.0) if rule == "norm" else (100, 3, 10_000.0)
    counts = {n: c for n, c in counts.items() if n * n <= capacity[2]}
    seqs, placed = defaultdict(list), Counter()
    for length, a, b, s, k, off in packing.plan(counts, capacity, rule):
        for i in range(a, b):
            seqs[s + (i - a) // k].append((off + (i - a) % k * length, length))
        placed[length] += b - a
    assert placed == Counter(counts)
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= capacity[0] and len(s) <= capacity[1] and sum(n * n for _, n in s) <= capacity[2]


# --- 10 --------------------------------------------------------------------------------------------------------------


def test_sharding(spark, docs, rows, none):
    out = sharding.shard_rows(docs, 7).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and set(slots) == set(range(7))
    assert sharding.shard_rows(none, 7).count() == 0
    assert Counter(r["shard"] for r in sharding.shard_rows(spark.range(3), 7).collect()) == Counter([0, 1, 2])


def test_order_is_uniform(spark):
    """Neither shard nor slot tells where a row was: shares of each input half, and of pairs whose order is turned round."""
    n, shards = 6_000, 5
    rows = sharding.shard_rows(spark.range(n, numPartitions=6), shards, seed=8).collect()
    for k in range(shards):
        own = [r["id"] for r in sorted((r for r in rows if r["shard"] == k), key=lambda r: r["slot"])]
        assert abs(sum(i < n / 2 for i in own) - len(own) / 2) < 5 * math.sqrt(len(own)) / 2
        turned = sum(a > b for a, b in zip(own, own[1:]))
        assert abs(turned - len(own) / 2) < 5 * math.sqrt(len(own) / 12) + 1
        first = own[: len(own) // 2]
        assert abs(sum(i < n / 2 for i in first) - len(first) / 2) < 5 * math.sqrt(len(first)) / 2


def test_packing_against_a_lower_bound_and_first_fit(spark):
    """Sequences are at most those of first fit on falling lengths, and at least the tokens ask for."""
    r = random.Random(6)
    for _ in range(6):
        lengths = [min(256, int(r.paretovariate(1.1) * 20)) for _ in range(400)]
        counts = Counter(lengths)
        got = max(s + (b - a - 1) // k for _, a, b, s, k, _ in packing.plan(counts, (256, 256, 256.0**2))) + 1
        open_: list[int] = []
        for n in sorted(lengths, reverse=True):
            for i, room in enumerate(open_):
                if room >= n:
                    open_[i] -= n
                    break
            else:
                open_.append(256 - n)
        assert -(-sum(lengths) // 256) <= got <= len(open_)


def test_communication_matrix_has_exact_margins_and_mean():
    rows = [5, 0, 40, 17]
    draws = np.stack([sharding.communication_matrix(rows, 6, s) for s in range(400)])
    assert (draws.sum(axis=2) == rows).all() and (draws.sum(axis=1) == [11, 11, 10, 10, 10, 10]).all()
    assert np.abs(draws.mean(axis=0) - np.outer(rows, [11, 11, 10, 10, 10, 10]) / 62).max() < 0.35


@pytest.mark.parametrize("rows, shards", [([10**10, 10**10], 40), ([3 * 10**9, 0, 7, 10**9 + 1], 6), ([10**12] * 3, 5)])
def test_communication_matrix_of_many_rows(rows, shards):
    m = sharding.communication_matrix(rows, shards, 1)
    total = sum(rows)
    sizes = np.array([total // shards + (k < total % shards) for k in range(shards)])
    assert (m.sum(axis=1) == rows).all() and (m.sum(axis=0) == sizes).all() and (m >= 0).all()
    mean = np.outer(np.array(rows, dtype=float), sizes) / total
    assert (np.abs(m - mean) <= 8 * np.sqrt(mean + 1)).all()


@pytest.mark.parametrize("good, bad, n", [(10, 20, 7), (3, 50, 40), (4, 4, 8), (400, 600, 500), (0, 5, 3)])
def test_hypergeometric_law(good, bad, n):
    draw, times = np.random.default_rng(good), 20_000
    got = Counter(sharding.hypergeometric(draw, good, bad, n) for _ in range(times))
    chance = {k: math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(max(0, n - bad), min(n, good) + 1)}
    assert set(got) <= set(chance)
    assert sum((got[k] - times * p) ** 2 / (times * p) for k, p in chance.items() if times * p > 5) < 2 * len(chance) + 30


def test_matrix_is_written_in_slices(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(sharding, "CELLS", 8)
    monkeypatch.setattr(sharding, "BROADCAST_CELLS", 0)
    out = sharding.shard_rows(docs.repartition(5), 3).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(rows)
    assert max(Counter(r["shard"] for r in out).values()) - min(Counter(r["shard"] for r in out).values()) <= 1


def test_connected_starts_from_a_task_s_own_stars(spark, monkeypatch):
    """Links of one task are stars at once, a chain over many tasks needs no more steps than its tasks; a round adds to the last one's stars."""
    names, plain = [], jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: names.append(name) or plain(df, name))
    chain = [(i, i + 1) for i in range(300)]
    got = dict(jaccard_join.connected(spark.createDataFrame(chain, "u long, v long").coalesce(1)).collect())
    assert got == {i: 0 for i in range(301)} and names == ["edges"]
    monkeypatch.setattr(jaccard_join, "TOLD", 8)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 20)
    dealt = spark.createDataFrame(random.Random(5).sample(chain, 300), "u long, v long").repartition(12)
    roots = jaccard_join.connected(dealt)
    assert Counter(map(tuple, roots.collect())) == Counter((i, 0) for i in range(301))
    more = spark.createDataFrame([(300, -4), (900, 901)], "u long, v long").union(roots)
    assert Counter(map(tuple, jaccard_join.connected(more).collect())) == Counter([*((i, -4) for i in [-4, *range(301)]), (900, 900), (901, 900)])


def test_words_in_capitals_are_remembered_once():
    """The ids are the library's for every character below U+0100 and some above, in any case and place."""
    own, library = tokens.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    own.ids_of(["Haus haus HAUS \u00c4ra \u00e4ra"])
    assert set(own._memo) == {"haus", "\u00e4ra"}
    texts = [f"{c} {c}b b{c} A{c}B. {c}. {c}'S" for c in map(chr, [*range(0x21, 0x180), 0x130, 0x3A3, 0x212A, 0x301])]
    texts += ["IT'S Don'T \u00c9T\u00c9, A\u00aaB \u00b5M\u00b2 \u00df\u1e9e", "\u039f\u0394\u039f\u03a3 A", "E\u0301A \u00c9A"]
    assert own.ids_of(texts) == [array("I", library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
