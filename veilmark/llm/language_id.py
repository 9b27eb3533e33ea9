"""Language identification by unigram pieces whose segmentations are summed out.

A word (a run of letters, lower-cased, behind the mark that begins words) can be cut into pieces of a fixed public
vocabulary in many ways. In language ``l`` a segmentation has the product of its pieces' probabilities, and a word the sum over all its
segmentations, by the forward algorithm; no piece crosses a word, so a text has the product over its words. The language of the greatest
likelihood is told, with its posterior probability among all learned languages at equal priors as ``score``.

Learning: about ``sample`` documents of each language, those whose id's hash is in the first ``sample / n`` of its range, give word counts, summed by
Spark; a language of fewer documents gives all of them. One count by language tells the share, so a hot language is no hot task. Expectation maximisation starts from equal probabilities: each round runs forward and backward over the
distinct words where they lie, sums the expected piece counts by (language, piece), and smooths them by their mean over the languages and by the
uniform law. The driver sees a row per language and piece, and the model is shared: at most ``MOST_LANGUAGES`` columns of the vocabulary's length; more
languages are an error.

Prediction reads whole texts once and moves nothing: a worker keeps the likelihoods of words it has met (``MEMO_WORDS``, then
it starts anew), computes those of a batch's new words together, and sums by document. Products are scaled on the way, so words of any length count.

Defined cases: null text, or one without a letter, gives ``und`` and 0; a letter no piece has counts as the unknown piece; documents without ``lang``
teach nothing and are predicted; with nothing to learn from all are ``und``; ties go to the least language; a null id counts
as an id without digits; repeated rows each give a row; words beyond ``TEACH_CHARS`` letters are scored but do not teach; an empty table gives no rows; other
columns pass through ``predict``, those of its own names (``OWN``) are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import CACHES, read_table, release_caches, written

SAMPLE = 3_000  # documents of a language that teach, about
ROUNDS = 3  # of expectation maximisation
SMOOTHING = 50.0  # pieces' worth of the background law added to each language
MOST_LANGUAGES = 256
MEMO_WORDS = 250_000
MEMO_BYTES = 64 << 20  # of likelihoods that a worker keeps
TEACH_CHARS = 64
UNKNOWN = "und"
OWN = ("lang_pred", "score")
_BEGIN = "▁"  # the mark that begins words in the vocabulary
_BLOCK_WORDS = 4_096  # words whose lattices are run together
_SLICE_WORDS = 100_000  # words of one text that are held at once
_TINY = 1e-100
_LETTERS = re.compile(r"[^\W\d_]+")


def default_vocabulary() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary's lower-case pieces by number; the number after the last is the unknown piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        names = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(kind(i) for kind in kinds))
        self.names = sorted({p for p in names if p == p.lower() and _BEGIN not in p[1:]})
        self.number = {p: i for i, p in enumerate(self.names)}
        self.unknown = len(self.names)
        self.reach = max(map(len, self.names), default=1)
        self.begun = {p[:k] for p in self.names for k in range(1, len(p) + 1)}

    def lattice(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """All pieces in the words, ``(word, start, end, piece)``, by end. Positions count the mark before the word."""
        at, start, end, piece = [], [], [], []
        number, begun, unknown = self.number, self.begun, self.unknown
        for w, word in enumerate(words):
            marked = _BEGIN + word
            n = len(marked)
            for i in range(n):
                for j in range(i + 1, n + 1):
                    part = marked[i:j]
                    if part not in begun:
                        if j > i + 1:
                            break
                        known = unknown
                    elif (known := number.get(part, -1)) < 0:
                        if j > i + 1:
                            continue
                        known = unknown
                    at.append(w)
                    start.append(i)
                    end.append(j)
                    piece.append(known)
        order = np.argsort(end, kind="stable")
        return tuple(np.array(x, dtype=np.int64)[order] for x in (at, start, end, piece))


def forward(words: list[str], pieces: Pieces, law: np.ndarray) -> np.ndarray:
    """Log-likelihoods, word by column of ``law`` (piece by language): sums over all segmentations."""
    out = np.zeros((len(words), law.shape[1]))
    by_length = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(by_length):
        own = by_length[at : at + max(1, min(_BLOCK_WORDS, (1 << 20) // (len(words[by_length[min(at + _BLOCK_WORDS, len(by_length)) - 1]]) + 2)))]
        out[own] = _forward([words[i] for i in own], pieces, law)
        at += len(own)
    return out


def _forward(words: list[str], pieces: Pieces, law: np.ndarray) -> np.ndarray:
    sizes = np.array([len(w) + 1 for w in words])
    at, start, end, piece = pieces.lattice(words)
    ring = pieces.reach + 1
    alpha, scale = np.zeros((ring, len(words), law.shape[1])), np.zeros((len(words), law.shape[1]))
    alpha[0] = 1.0
    out = np.zeros_like(scale)
    edges = np.searchsorted(end, np.arange(1, sizes.max(initial=0) + 2))
    for j in range(1, sizes.max(initial=0) + 1):
        own = slice(edges[j - 1], edges[j])
        now = np.zeros_like(scale)
        np.add.at(now, at[own], alpha[start[own] % ring, at[own]] * law[piece[own]])
        alpha[j % ring] = now
        low = (now > 0) & (now < _TINY)
        if low.any():  # lifted by language and word, with all that later pieces can begin at
            alpha[:, low] /= _TINY
            scale[low] += np.log(_TINY)
        done = sizes == j
        if done.any():
            out[done] = np.log(alpha[j % ring][done]) + scale[done]
    return out


def expected(words: list[str], counts: np.ndarray, pieces: Pieces, law: np.ndarray) -> np.ndarray:
    """Expected counts of pieces in words of one language, over all segmentations of each."""
    out = np.zeros(len(law))
    by_length = sorted(range(len(words)), key=lambda i: len(words[i]))
    for k in range(0, len(by_length), _BLOCK_WORDS):
        own = by_length[k : k + _BLOCK_WORDS]
        block = [words[i] for i in own]
        sizes = np.array([len(w) + 1 for w in block])
        at, start, end, piece = pieces.lattice(block)
        p, longest = law[piece], int(sizes.max())
        alpha, beta = np.zeros((longest + 1, len(block))), np.zeros((longest + 1, len(block)))
        alpha[0], beta[sizes, np.arange(len(block))] = 1.0, 1.0
        bounds = np.searchsorted(end, np.arange(1, longest + 2))
        for j in range(1, longest + 1):
            e = slice(bounds[j - 1], bounds[j])
            np.add.at(alpha[j], at[e], alpha[start[e], at[e]] * p[e])
        for j in range(longest, 0, -1):  # all pieces that end at j or later have been told when j is read
            e = slice(bounds[j - 1], bounds[j])
            np.add.at(beta, (start[e], at[e]), beta[j, at[e]] * p[e])
        whole = alpha[sizes, np.arange(len(block))]
        share = alpha[start, at] * p * beta[end, at] / whole[at] * counts[own][at]
        out += np.bincount(piece, share, len(law))
    return out


def held_out(key: str = "doc_id") -> Column:
    """Whether a document is kept from learning: those whose CRC-32 of the id's digits 5 divides."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Model:
    def __init__(self, languages: list[str], law: np.ndarray, vocabulary: str):
        self.languages, self.law, self.vocabulary = languages, law, vocabulary


_PIECES: dict[str, Pieces] = {}
_MEMOS: dict[str, "_Scores"] = {}
CACHES.extend([_PIECES, _MEMOS])


def _pieces(path: str) -> Pieces:
    if path not in _PIECES:
        release_caches()
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _words(text: str) -> Iterator[list[str]]:
    """The words of a text, in slices. Marks and figures that the pattern takes for letters end words too."""
    low = text.lower()
    found = (m[0] for m in _LETTERS.finditer(low))
    slices = [_LETTERS.findall(low)] if len(low) <= _SLICE_WORDS else iter(lambda: list(islice(found, _SLICE_WORDS)), [])
    for some in slices:
        if all(map(str.isalpha, some)):
            yield some
        else:
            yield [x for w in some for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", vocabulary: str | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """Piece probabilities per language from the documents given."""
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    rank = F.xxhash64(F.col(key).cast("string"))
    known = docs.where(F.col(lang).isNotNull())
    share = F.least(F.lit(1.0), sample / F.col("n"))  # hashes are uniform, so this share of their range holds about ``sample`` of a language
    most = F.when(share >= 1, F.lit(2**63 - 1)).otherwise((share * 2.0**64 - 2.0**63).cast("long"))
    limits = known.groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).select("lang", most.alias("most"))
    limits = written(limits, "language-limits")
    languages = [r["lang"] for r in limits.select("lang").orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages.sort()
    column = {x: i for i, x in enumerate(languages)}
    own = known.select(F.col(lang).cast("string").alias("lang"), rank.alias("rank"), F.col(text).cast("string").alias("text"))
    own = own.join(F.broadcast(limits), "lang").where("rank <= most and text is not null").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for b in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for name, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                for words in _words(t):
                    seen[name].update(w for w in words if len(w) <= TEACH_CHARS)
            rows = [(name, w, n) for name, c in seen.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    words = written(own.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    size = _pieces(vocabulary).unknown + 1
    law = np.full((size, len(languages)), 1 / size)
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast(law)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces, law = _pieces(vocabulary), shared.value
            sums, waiting = np.zeros_like(law), defaultdict(list)

            def add(name: str) -> None:
                rows = waiting.pop(name)
                sums[:, column[name]] += expected([w for w, _ in rows], np.array([n for _, n in rows], dtype=np.float64), pieces, law[:, column[name]])

            for b in batches:
                for name, w, n in zip(*(b.column(c).to_pylist() for c in ("lang", "word", "n"))):
                    waiting[name].append((w, n))
                for name in [x for x, rows in waiting.items() if len(rows) >= 2 * _BLOCK_WORDS]:
                    add(name)
            for name in list(waiting):
                add(name)
            piece, col = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(col), pa.array(piece), pa.array(sums[piece, col])], names=["language", "piece", "n"])

        got = words.mapInArrow(expect, "language long, piece long, n double").groupBy("language", "piece").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros_like(law)
        counts[got["piece"].to_numpy(), got["language"].to_numpy()] = got["n"].to_numpy()
        shares = counts / np.maximum(counts.sum(axis=0), 1e-300)
        background = (shares.mean(axis=1) + 1 / size) / (shares.mean(axis=1).sum() + 1)
        law = (counts + SMOOTHING * background[:, None]) / (counts.sum(axis=0) + SMOOTHING)
        shared.unpersist()
    return Model(languages, law, vocabulary)


class _Scores:
    """Log-likelihoods of words under every language, kept by word and computed for many new words together."""

    def __init__(self, pieces: Pieces, law: np.ndarray):
        self.pieces, self.law = pieces, law
        self.most = max(_SLICE_WORDS, min(MEMO_WORDS, MEMO_BYTES // max(1, 8 * law.shape[1])))
        self.row: dict[str, int] = {}
        self.table = np.zeros((0, law.shape[1]))

    def add(self, totals: np.ndarray, waiting: list[tuple[int, list[str]]]) -> None:
        """Adds the words' likelihoods to the totals of their documents."""
        if len(self.row) > self.most:
            self.row.clear()
        row = self.row
        new = list({w for _, words in waiting for w in words if w not in row})
        if new:
            known = len(row)
            if known + len(new) > len(self.table):
                self.table = np.vstack([self.table[:known], np.zeros((len(new) + known // 2 + 4_096, self.law.shape[1]))])
            self.table[known : known + len(new)] = forward(new, self.pieces, self.law)
            row.update(zip(new, range(known, known + len(new))))
        width = max(1, (1 << 20) // max(1, self.law.shape[1]))
        for doc, words in waiting:
            at = np.fromiter(map(row.__getitem__, words), np.int64, len(words))
            for k in range(0, len(at), width):
                totals[doc] += self.table[at[k : k + width]].sum(axis=0)
        if any(len(w) > TEACH_CHARS for w in new):  # long words would make the memory large
            row.clear()


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only the text is looked at."""
    keep = [c for c in docs.columns if c not in OWN]
    carried = [f"_c{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, carried)), F.col(text).cast("string").alias("whole"))
    languages, vocabulary, shared = model.languages, model.vocabulary, docs.sparkSession.sparkContext.broadcast(model.law)
    stamp = uuid.uuid4().hex  # of this law, for what workers keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if stamp not in _MEMOS:
            release_caches()
            _MEMOS[stamp] = _Scores(_pieces(vocabulary), shared.value)
        scores = _MEMOS[stamp]
        for b in batches:
            totals, lettered = np.zeros((b.num_rows, len(languages))), np.zeros(b.num_rows, bool)
            waiting, size = [], 0
            for i, t in enumerate(b.column("whole")):
                for words in _words(t.as_py() or "") if languages else ():
                    waiting.append((i, words))
                    size += len(words)
                    lettered[i] |= bool(words)
                    if size >= _SLICE_WORDS:
                        scores.add(totals, waiting)
                        waiting, size = [], 0
            scores.add(totals, waiting)
            best = totals.argmax(axis=1) if languages else np.zeros(b.num_rows, int)
            share = 1 / np.exp(np.clip(totals - totals.max(axis=1, keepdims=True), -700, 0)).sum(axis=1) if languages else np.zeros(b.num_rows)
            told = [languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered)]
            own = [pa.array(told, pa.string()), pa.array(np.where(lettered, share, 0.0))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in carried), *own], names=[*carried, *OWN])

    schema = rows.select(*carried).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema).select(*(F.col(k).alias(c) for c, k in zip(keep, carried)), *OWN)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = learn(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", F.round("score", 9).alias("score"))
