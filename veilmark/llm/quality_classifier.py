"""Quality classifier: a document's own evidence combined with its site by hierarchical empirical Bayes.

1. A logistic model on figures of the whole text is fitted to a bounded sample of labelled documents (``sample`` rows, those
   of the least hash of their id). It gives each document a probability ``p`` and so its evidence, the log odds
   beyond the sample's own.
2. Over all documents, grouped sums of ``p`` by (host, path) give soft counts. A host's rate has a Beta prior around
   the global rate, a path's rate one around its host's; the strength of each prior is estimated by moments from the
   spread of the group rates. Sparse sites are thus shrunk to their host, and sparse hosts to the whole.
3. A document's posterior log odds are its evidence plus the log odds of its path's posterior, from which its own ``p`` was
   left out. It is kept from ``threshold`` on.

``p`` is computed once for the sums, to which no text comes back, and once more for the documents, which costs less than to write
whole documents with it. The sums are combined before the exchange, so a hot host is one row per
task. Groups come back by a broadcast if they and their names take at most ``BROADCAST_BYTES``, else by a join that Spark may split.

Defined cases: null text is empty; null host or path is a site of its own; labels without quality, or of unknown documents,
are ignored, and of labels for one document the least counts; a sample of one class gives no evidence; repeated rows each
give a row; very long texts are read whole; equal sites have equal rates, so ties need no order; an empty table gives no rows;
other columns are ignored by the query and pass through ``keep_good``; in ``classify``, which adds columns, those of its own names (``OWN``)
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import read_table, release_caches, shielded, written

SAMPLE = 6_000
THRESHOLD = 0.5
BROADCAST_BYTES = 32 << 20
GROUP_BYTES = 64  # of a group beside its names
OWN = ("p", "host_rate", "path_rate", "posterior", "kept", "_host", "_path", "n", "s", "strength")
FEATURES = 16
_SYMBOLS, _UPPER, _LOWER, _DIGITS, _STOPS = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".,;:?"


def features(text: str | None) -> list[float]:
    """Figures of the whole text, each within a small range."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    ws = raw.split()
    n, size = max(1, len(ws)), max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    upper, letters = count(_UPPER), max(1, count(_UPPER + _LOWER))
    kinds = len(set(ws))
    per = lambda x: min(2.0, x / n)
    symbols, bangs, pipes = per(count(_SYMBOLS)), per(raw.count(b"!")), per(raw.count(b"|"))
    near = sum(map(eq, ws, ws[1:])) / n
    rare = kinds / n
    return [
        np.log1p(len(ws)) / 5, upper / letters, float(upper * 2 > letters), symbols, float(symbols > 0.2), bangs, float(bangs > 0.2), pipes,
        near, float(near > 0.2), rare, float(rare < 0.2), 1 - len(set(lines)) / max(1, len(lines)), per(count(_STOPS)), count(_DIGITS) / size, min(3.0, size / n / 10),
    ]


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(-1, FEATURES)


class Model:
    """Logistic regression by penalised Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0):
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
        self.weights, self.prior = np.zeros(FEATURES + 1), float(y.mean()) if len(y) else 0.5
        if not 0 < self.prior < 1:
            self.prior = 0.5
            return
        z = self._design(x)
        ridge = np.diag([1e-6] + [penalty] * FEATURES)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ self.weights))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ self.weights)
            self.weights += step
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -8, 8)])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.clip(1 / (1 + np.exp(-self._design(x) @ self.weights)), 1e-6, 1 - 1e-6)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_q"))
    chosen = written(known.orderBy(F.xxhash64("_id"), "_id").limit(sample), "labelled-sample")  # bounded, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "_id")

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for b in batches:
            x = _matrix(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_q").cast(pa.float64()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", "q", "x"])

    # one row per label: repeated documents do not raise the bound
    got = rows.select("_id", "_q", "text").mapInArrow(figures, "id long, q double, x array<double>").groupBy("id", "q").agg(F.min("x").alias("x")).collect()
    got.sort(key=lambda r: r["id"])
    return Model(np.array([r["x"] for r in got], dtype=np.float64).reshape(-1, FEATURES), np.array([float(r["q"] > 0) for r in got]))


def score(docs: DataFrame, model: Model, only: list[str] | None = None) -> DataFrame:
    """``docs``, or their columns ``only``, with ``p``."""
    keep = docs.columns if only is None else only
    schema = docs.select(*keep).withColumn("p", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for b in batches:
            p = model.probability(_matrix(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(p)], names=[*keep, "p"])

    return docs.mapInArrow(run, schema)


def _strength(mean, var_of_rates):
    """Prior strength of a Beta from the rates' variance, between 1 and 1e6."""
    return F.least(F.lit(1e6), F.greatest(F.lit(1.0), mean * (1 - mean) / F.greatest(var_of_rates, F.lit(1e-9)) - 1))


def site_rates(scored: DataFrame, host: str, path: str) -> DataFrame:
    """``(host, path, n, s, host_rate, prior_rate, strength)``: soft counts of each path and the prior from its host."""
    paths = written(
        scored.groupBy(F.col(host).alias("_host"), F.col(path).alias("_path")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("p").alias("s")), "site-counts"
    )
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = (total["s"] or 0.5) / (total["n"] or 1.0)
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    # weighted variance of the rates around the prior mean
    spread = lambda df, n, s, m: df.agg((F.sum(n * (s / n - m) ** 2) / F.sum(n)).alias("v"))
    k1 = spread(hosts, F.col("hn"), F.col("hs"), F.lit(mean)).select(_strength(F.lit(mean), F.coalesce("v", F.lit(0.0))).alias("k")).first()["k"]
    hosts = hosts.select("_host", ((F.col("hs") + k1 * mean) / (F.col("hn") + k1)).alias("host_rate"))
    both = paths.join(hosts.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    both = written(both, "site-rates")
    k2 = spread(both, F.col("n"), F.col("s"), F.col("host_rate")).select(_strength(F.lit(mean), F.coalesce("v", F.lit(0.0))).alias("k")).first()["k"]
    return both.withColumn("strength", F.lit(float(k2)))


def _log_odds(p):
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``p`` (own), ``host_rate``, ``path_rate`` (own ``p`` left out), ``posterior`` and ``kept``."""
    docs = docs.drop(*(c for c in docs.columns if c in OWN))
    model = fit(docs, labels, sample)
    names = [host, *([path] if path != host else [])]
    sites = site_rates(score(docs.select("text", *names), model, names), host, path)
    names = F.coalesce(F.length(F.col("_host").cast("string")), F.lit(0)) + F.coalesce(F.length(F.col("_path").cast("string")), F.lit(0))
    size = sites.agg(F.sum(4 * names + GROUP_BYTES)).first()[0] or 0  # a character takes at most four bytes
    sites = F.broadcast(sites) if size <= BROADCAST_BYTES else sites
    df = score(docs, model).join(sites, F.col(host).eqNullSafe(F.col("_host")) & F.col(path).eqNullSafe(F.col("_path")))
    rate = (F.col("s") - F.col("p") + F.col("strength") * F.col("host_rate")) / (F.col("n") - 1 + F.col("strength"))
    odds = _log_odds(F.col("p")) - _log_odds(F.lit(model.prior)) + _log_odds(F.col("path_rate"))
    df = df.withColumn("path_rate", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), rate)))
    df = df.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return df.withColumn("kept", F.col("posterior") >= threshold).drop("_host", "_path", "n", "s", "strength")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with the columns they had."""
    safe, back = shielded(docs, OWN)
    return classify(safe, labels, **options).where("kept").select(*back)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang", "source")
    out = classify(docs, read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", *(F.round(c, 6).alias(c) for c in ("p", "host_rate", "path_rate", "posterior")), "kept")
