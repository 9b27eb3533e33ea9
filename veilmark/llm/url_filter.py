"""URL filters: glob rules packed into multiword Shift-And masks, simulated over each canonical URL.

A rule is a glob over the canonical URL ``.host#path`` (A-Z of the host lower-cased; ``#`` can be in
neither part, so a pattern cannot match across them): ``*`` stands for any run of characters, ``?`` for one.
Every literal (or ``?``) of every rule is one bit; all rules advance together by ``D = ((D << 1) & B[c]) |
(D & S)``, where ``B[c]`` holds the positions that accept ``c`` and ``S`` those before a ``*``. Bits run over
as many 64-bit words as needed and the shift carries between words. A batch of URLs is simulated column by
column, longest first, so only URLs that still have characters are touched.

Of the site rules (host and path prefix) that fit, the longest decides; with none, the general globs decide:
block if one matches, else allow. Defined cases: null URL or one without ``://`` has empty host and path, fits no site
rule and is allowed; of site rules of equal length the first listed decides; very long URLs are read whole; repeated rows each give a row; other columns
pass through ``judge_urls`` (those of its own results are replaced), whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import free_names, read_table

#: (verdict, host, path prefix): a rule fits the host and its subdomains.
SITE_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Globs that block where no site rule fits: log-in, basket and search pages, and files that are no pages.
GENERAL_GLOBS = ["*#*/login*", "*#*/signin*", "*#*/cart/*", "*#*/checkout/*", "*#*/search/*", "*#*/wp-admin/*", "*#*/cgi-bin/*", "*#*.exe", "*#*.zip", "*#*.apk"]


class GlobAutomaton:
    """Bit-parallel simulation of all globs at once, each anchored at both ends."""

    def __init__(self, globs: list[str]):
        cells: list[tuple[str, bool]] = []  # accepted character (None: any), and whether a * follows
        starts, finals = [], []
        for g in globs:
            starts.append(len(cells))
            cells.append(("", False))  # the start state
            for c in g:
                if c == "*":
                    cells[-1] = (cells[-1][0], True)
                else:
                    cells.append((None if c == "?" else c, False))
            finals.append(len(cells) - 1)
        self.words = len(cells) // 64 + 1
        self.finals = np.array(finals)
        bits = lambda at: self._pack(at)
        self.start = bits(starts)
        self.loops = bits([i for i, (_, loop) in enumerate(cells) if loop])
        anything = [i for i, (c, _) in enumerate(cells) if c is None]
        self.alphabet = sorted({c for c, _ in cells if c})
        self.masks = np.stack([bits(anything), *(bits(anything + [i for i, (x, _) in enumerate(cells) if x == c]) for c in self.alphabet)])
        self.code = {ord(c): k + 1 for k, c in enumerate(self.alphabet)}

    def _pack(self, at: list[int]) -> np.ndarray:
        out = np.zeros(self.words, dtype=np.uint64)
        for i in at:
            out[i // 64] |= np.uint64(1 << (i % 64))
        return out

    def match(self, texts: list[str]) -> np.ndarray:
        """Boolean matrix: text by glob."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        points = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        table = np.zeros(max([0, *self.code]) + 2, dtype=np.int64)
        for point, k in self.code.items():
            table[point] = k
        codes = table[np.minimum(points, len(table) - 1)]
        sizes = lengths[order]
        at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        live = len(texts)
        for j in range(int(sizes[0]) if len(texts) else 0):
            live = int(np.searchsorted(-sizes[:live], -j, side="left"))  # those longer than j
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.masks[codes[at[:live] + j]]) | (now & self.loops)
        hit = np.zeros((len(texts), len(self.finals)), dtype=bool)
        hit[order] = (state[:, self.finals // 64] >> (self.finals % 64).astype(np.uint64)) & one != 0
        return hit


def _site_glob(host: str, path: str) -> str:
    return f"*.{host}#{path}*"


def judge_urls(pages: DataFrame, site_rules=SITE_RULES, general_globs=GENERAL_GLOBS, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if no site rule fits) and ``verdict``."""
    site_rules = sorted(site_rules, key=lambda r: -len(r[1] + r[2]))
    globs = [_site_glob(h, p) for _, h, p in site_rules] + list(general_globs)
    names = [h + p for _, h, p in site_rules]
    verdicts = [v for v, _, _ in site_rules]

    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton = GlobAutomaton(globs)
        for host, path in parts:
            rule, verdict = [], []
            for at in range(0, len(host), 8192):
                texts = [f".{h}#{p}" for h, p in zip(host[at : at + 8192], path[at : at + 8192])]
                hit = automaton.match(texts)
                fits = hit[:, : len(names)]
                first = np.where(fits.any(axis=1), fits.argmax(axis=1), -1) if names else np.full(len(texts), -1)
                blocked = hit[:, len(names) :].any(axis=1)
                rule += [names[k] if k >= 0 else None for k in first]
                verdict += [verdicts[k] if k >= 0 else "block" if b else "allow" for k, b in zip(first, blocked)]
            yield pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": pd.Series(verdict, dtype=object)})

    judged = F.pandas_udf(judge, "rule string, verdict string")
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*keep, F.translate(host, upper, lower).alias("host"), path.alias("path"))
    (told,) = free_names(parts, "_j")
    return parts.withColumn(told, judged("host", "path")).select(*keep, "host", "path", f"{told}.rule", f"{told}.verdict")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def oracle_sql() -> str:
    """DuckDB SQL for the query, from the same rules."""
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rules = sorted(SITE_RULES, key=lambda r: -len(r[1] + r[2]))
    like = lambda g: "('.' || host || '#' || path) GLOB '" + g + "'"
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
b AS (SELECT page_id, CASE WHEN instr(u, '://') > 0 THEN substr(u, instr(u, '://') + 3) ELSE '' END AS r FROM a),
c AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM b),
d AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM c)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules)} END AS rule,
  CASE {" ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in rules)} WHEN {" OR ".join(map(like, GENERAL_GLOBS))} THEN 'block' ELSE 'allow' END AS verdict
FROM d"""
