"""Quality rules, lines first: failing lines go, then documents that lost too much text.

Rules for a line (``n`` words, lines without words do not count):

- repeated: an equal line came earlier;
- punctuation: exclamation marks for half of its words or more, or a stub (fewer than ``MIN_LINE_WORDS`` words) that ends in
  no sentence mark, whatever white space (a carriage return, a tab) stands behind it;
- navigation: symbols for a quarter of its words or more, link-like words (``LINK``) for half of them or more, or separators of menus
  (``SEPARATORS``) between words for a quarter of them or more;
- boilerplate: it begins with a copyright sign (``RIGHTS``), or one of ``PHRASES`` is in it, in the languages of the corpus.

A document is rejected if its base figures fail, or if fewer than ``KEEP_SHARE`` per cent of its words stand in passing
lines. All of it is DataFrame expressions within a row: no shuffle, and a row never needs another.

Repeated word windows are found by hashes of all windows; only a document in which two hashes agree sorts its windows
and compares the words themselves, so the count is exact.

``clean`` takes out failing and repeated lines alone: lines without words stay where they are, so paragraphs stay apart.

Defined cases: null text has no words and is rejected; repeated rows each give a row; equal lines are one, of which the first stays; very long texts are read
whole; an empty table gives no rows; other columns pass through ``clean``, whatever their names, and are ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.texts import let
from veilmark.llm.common import read_table, shielded, text_or_empty, words_of

# Fixed values of the base figures.
SYMBOLS = "[#*$%&|<>]"
GAPS = " \t\n\x0b\x0c\r"  # what stands between words
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_SHARE = 30

OWN = ("words", "lines", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_kept_words", "base_failed", "kept", "_t", "_l", "_d", "_h", "_s", "_p")

# Parameters of the line rules.
KEEP_SHARE = 50
MIN_LINE_WORDS = 4
SENTENCE_ENDS = ".!?…:;\"'”’»)]"
LINK = "(?i)(?<![^ \\t-\\r])(?:https?://|www\\.)[^ \\t-\\r]+"
SEPARATORS = "(?<= )[•·»«›‹→/~=-](?= )"
RIGHTS = "(?i)^[ \\t-\\r]*(?:©|\\(c\\) ?(?:19|20)[0-9]{2}|copyright )"
PHRASES = [
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "accept cookies", "subscribe to our",
    "sign up for", "click here", "enable javascript", "lorem ipsum", "share this", "skip to content", "licensed under",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "accepter les cookies", "cliquez ici", "mentions légales",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren", "hier klicken", "zum inhalt springen",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "aceptar cookies", "haga clic aquí", "aviso legal",
]


def _count(text: Column, cls: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, cls, ""))


def _has_word(line: Column) -> Column:
    return line.rlike("[^ \\t-\\r]")


def repeated_words(df: DataFrame, words: str = "words") -> DataFrame:
    """Adds ``n_repeat_words``: words inside windows that are in the text twice or more."""
    w, n, k = F.col(words), F.size(words), REPEAT_WINDOW
    starts = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_h", F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, k))))
    df = df.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), F.slice(w, i + 1, k).alias("k"), i.alias("p")))),
        ),
    )
    s = F.col("_s")
    twin = lambda x, j: F.coalesce(x["k"] == F.get(s, j + 1)["k"], F.lit(False)) | F.coalesce(x["k"] == F.get(s, j - 1)["k"], F.lit(False))
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter(s, twin), lambda x: x["p"])))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("_p", zero, lambda a, p: F.struct((p + k).alias("end"), (a["n"] + k - F.greatest(F.lit(0), a["end"] - p)).alias("n")))
    return df.withColumn("n_repeat_words", F.when(s.isNull(), 0).otherwise(covered["n"]).cast("long")).drop("_h", "_s", "_p")


def line_fails(line: Column, n: Column) -> Column:
    """Whether a line of ``n`` words (not repeated) fails a rule."""
    low = F.lower(line)
    boilerplate = F.lit(False)
    for p in PHRASES:
        boilerplate = boilerplate | F.contains(low, F.lit(p))
    end = F.right(F.rtrim(line, F.lit(GAPS)), F.lit(1))
    stub = (n < MIN_LINE_WORDS) & ~end.isin(*SENTENCE_ENDS)
    # most lines have no sign of a link or a menu at all
    links = F.contains(low, F.lit("://")) | F.contains(low, F.lit("www."))
    menu = (links & (F.regexp_count(line, F.lit(LINK)) * 2 >= n)) | (F.regexp_count(line, F.lit(SEPARATORS)) * 4 >= n)
    return stub | (_count(line, SYMBOLS) * 4 >= n) | (_count(line, "!") * 2 >= n) | menu | boilerplate | low.rlike(RIGHTS)


def assess(docs: DataFrame) -> DataFrame:
    """``docs`` with base figures, ``base_failed``, ``lines`` (the distinct ones with words, and all others: text, words, whether it fails) and ``kept``."""
    df = docs.withColumn("_t", text_or_empty())
    # lines without words are told by their number, so that they are all different and stay
    told = lambda x, i: F.when(_has_word(x), F.concat(F.lit("w"), x)).otherwise(F.concat(i.cast("string"), F.lit("w"), x))
    df = df.withColumn("words", words_of(F.col("_t"))).withColumn("_l", F.transform(F.split("_t", "\n", -1), told))
    df = df.withColumn("_d", F.array_distinct("_l")).withColumn("n_words", F.size("words").cast("long"))
    apart = lambda x: let(F.instr(x, "w"), lambda at: F.struct(F.substr(x, at + 1).alias("text"), (at > 1).alias("blank")))
    df = df.withColumn("lines", F.transform(F.transform("_d", apart), lambda x: F.struct(x["text"].alias("text"), F.when(x["blank"], 0).otherwise(F.size(words_of(x["text"]))).alias("n"))))
    fails = lambda x: F.when(x["n"] > 0, line_fails(x["text"], x["n"])).otherwise(False)
    df = df.withColumn("lines", F.transform("lines", lambda x: F.struct(x["text"].alias("text"), x["n"].alias("n"), fails(x).alias("fails"))))
    df = repeated_words(df)
    df = df.withColumns(
        {
            "word_chars": F.length(F.regexp_replace("_t", "[ \\t-\\r]+", "")).cast("long"),
            "n_symbols": _count(F.col("_t"), SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size("_d")).cast("long"),
            "n_kept_words": F.aggregate("lines", F.lit(0), lambda a, x: a + F.when(x["fails"], 0).otherwise(x["n"])).cast("long"),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words")),
        }
    )
    # Always true, and not deterministic to the optimizer: it keeps a filter on the verdict above these projections, through which
    # it would be pushed with every expression written out where it is used, growing exponentially.
    barrier = F.monotonically_increasing_id() >= 0
    verdict = ~F.col("base_failed") & (100 * F.col("n_kept_words") >= KEEP_SHARE * F.col("n_words")) & barrier
    return df.withColumn("kept", verdict).drop("_t", "_l", "_d", "words")


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents, their text reduced to its passing lines; the columns stay as they are."""
    text = F.array_join(F.transform(F.filter("lines", lambda x: ~x["fails"]), lambda x: x["text"]), "\n")
    safe, back = shielded(docs, OWN)
    return assess(safe).where("kept").select(*(text.alias(c) if c == "text" else own for c, own in zip(docs.columns, back)))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The kept documents as they are."""
    safe, back = shielded(docs, OWN)
    return assess(safe).where("kept").select(*back)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return assess(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle_sql() -> str:
    gap = r"[^\x20\x09-\x0D]+"
    ends = ", ".join("'" + c.replace("'", "''") + "'" for c in SENTENCE_ENDS)
    phrases = " OR ".join(f"contains(lower(t), '{p.replace(chr(39), chr(39) * 2)}')" for p in PHRASES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{gap}') AS w, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 7], chr(10)) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM k) WHERE c > 1) GROUP BY 1),
lines AS (SELECT doc_id, t, len(regexp_extract_all(t, '{gap}')) AS n FROM (SELECT doc_id, unnest(list_distinct(l)) AS t FROM w)),
kept AS (SELECT doc_id, sum(n) AS n FROM lines
  WHERE NOT ((n < {MIN_LINE_WORDS} AND right(regexp_extract(t, '.*[^\x20\x09-\x0D]', 0, 's'), 1) NOT IN ({ends})) OR len(regexp_extract_all(t, '{SYMBOLS}')) * 4 >= n
    OR len([x FOR x IN regexp_extract_all(t, '{gap}') IF regexp_matches(x, '^(?i)(https?://.|www[.].)')]) * 2 >= n
    OR len([i FOR i IN range(2, length(t)) IF t[i] IN ('•', '·', '»', '«', '›', '‹', '→', '/', '~', '=', '-') AND t[i - 1] = ' ' AND t[i + 1] = ' ']) * 4 >= n
    OR regexp_matches(t, '^[\x20\x09-\x0D]*(©|(?i)\(c\) ?(19|20)[0-9]{{2}}|(?i)copyright )')
    OR len(regexp_extract_all(t, '!')) * 2 >= n OR {phrases}) GROUP BY 1),
b AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(kept.n, 0) AS n_kept
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_SHARE} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * n_kept >= {KEEP_SHARE} * n_words AS kept FROM f
"""
