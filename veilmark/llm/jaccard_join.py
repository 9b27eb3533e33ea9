"""N-gram Jaccard join by signature trees.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of word shingles. No link between different texts
is lost and no group meets as a whole:

1. Equal sets are one class (a seeded 64-bit digest, checked against a second one), so copies cost a row each.
2. Shingles are ordered by rough frequency, rarest first (counts of 2**20 hash buckets, summed over all documents), and then by hash.
   A set's prefix is its first ``n - ceil(percent * n / 100) + a`` shingles; sets that link share ``a`` of these (``allowance``:
   n / 50, at least 1). One exchange by shingle drops those that only one class has (shingles of crowded buckets are salted by
   class and all stay); then classes with fewer shared shingles than any partner's allowance go.
3. Blocks of classes that share a shingle are joined by signature trees: leaves are a class's token bitmap and size, inner nodes
   hold the OR of the bitmaps, the range of sizes and the most tokens folded into one bit. A dual traversal drops node
   pairs whose size ranges or greatest possible overlap rule a link out, and pairs already connected. Bitmaps have eight
   bits a token or more; a block has a tree for each power of two of the sizes, which those near the limit join too, folded.
   Blocks hold bitmaps alone; pairs that survive are checked with the whole sets, and what links is connected before the next
   round. First every class joins two blocks only (least hashes of its shared shingles). Then, for up to ``ROUNDS`` rounds while
   links are found, the shingles that different components share give all their blocks, each set of members once. In these
   rounds a surviving pair counts as connected within its part (a small block, or some of the large blocks of a pair of chunks), so a part
   tells no more pairs than it has components. The last round tells all surviving pairs between components. Large blocks are cut into chunks of ``CHUNK``
   classes; every pair of chunks meets in a task of its own.
4. Connected components: a task's links become stars first; then, until all are stars, large-star and small-star steps alternate, each
   pair written to the shared folder. A later round starts from the last one's stars and its own links.

A group of copies or near copies is thus one component after the first step and takes no part in the second.

Defined cases: null or blank text has an empty set and links with nothing; a null ``doc_id`` is in its class's component, which links like any (null if no document of it has
an id); repeated rows each give a row; very long texts are hashed in pieces; ties do not matter, as only least ids are told; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import read_table, release_caches, written
from veilmark.llm.shingles import shingle_sets

BUCKETS = 1 << 20  # of the frequency sketch
PARTS = 64  # in which tasks' sketches are summed
SKETCHES = 64  # of a part that one task sums at once (8 MB)
SPREAD = 64  # parts to which the blocks of one pair of chunks are dealt
LAST_SPREAD = 4  # the same in the last round, in which each part may tell the same pairs
CHUNK = 512
FANOUT = 8
PICKS = 2
ROUNDS = 1
TOLD = 200_000  # pairs that a task remembers
SALTS = 64
BROADCAST_ROWS = 500_000  # of two numbers


# --- signature trees -------------------------------------------------------------------------------------------------


def size_class(n: int) -> int:
    return max(n.bit_length() - 1, 6)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(8 << size_class(len(hashes)), dtype=bool)
    bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def by_class(rows: list[dict], percent: int) -> Iterator[tuple[list[dict], np.ndarray]]:
    """The rows of each size class with their bitmaps at one length; rows whose partners may be a class below join that too."""
    own: dict[int, list[tuple[dict, np.ndarray]]] = {}
    for r in rows:
        m, c = np.frombuffer(r["map"], dtype=np.uint64), size_class(r["n"])
        own.setdefault(c, []).append((r, m))
        if c > 6 and percent * r["n"] < 100 << c:
            own.setdefault(c - 1, []).append((r, m[: len(m) // 2] | m[len(m) // 2 :]))
    for members in own.values():
        if len(members) > 1:
            yield [r for r, _ in members], np.stack([m for _, m in members])


def _links(overlap: int, a: int, b: int, percent: int) -> bool:
    return (100 + percent) * overlap >= percent * (a + b)


class Tree:
    """Levels from the leaves up; a node of level ``l + 1`` covers ``FANOUT`` nodes of level ``l``."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, seed: int = 0):
        self.order = np.lexsort((maps[:, seed % maps.shape[1]], sizes))
        maps, sizes = maps[self.order], sizes[self.order]
        folded = sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, folded)]
        while len(self.levels[-1][1]) > 1:
            m, low, high, f = self.levels[-1]
            cut = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(m, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(f, cut)))

    def kids(self, level: int, i: int) -> range:
        return range(i * FANOUT, min((i + 1) * FANOUT, len(self.levels[level - 1][1])))


def traverse(x: Tree, y: Tree | None, percent: int, connected, draw: random.Random | None = None) -> Iterator[tuple[int, int]]:
    """Pairs of leaves (original numbers) that may link; within ``x`` if ``y`` is None. ``connected(i, j)`` prunes leaves; ``draw`` mixes the order."""
    own, y = y is None, y or x
    stack = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while stack:
        lx, i, ly, j = stack.pop()
        if lx == 0 and ly == 0:
            a, b = int(x.order[i]), int(y.order[j])
            if not (own and i == j) and not connected(a, b):
                yield a, b
            continue
        go_x = lx >= ly and lx > 0
        if own and (lx, i) == (ly, j):
            kids = list(x.kids(lx, i))
            pairs = [(p, q) for n, p in enumerate(kids) for q in kids[n:]]
            ps, qs = np.array([p for p, _ in pairs]), np.array([q for _, q in pairs])
            nx = ny = lx - 1
        elif go_x and lx == ly:
            ps, qs = (g.ravel() for g in np.meshgrid(np.array(x.kids(lx, i)), np.array(y.kids(ly, j)), indexing="ij"))
            nx, ny = lx - 1, ly - 1
        elif go_x:
            ps = np.array(x.kids(lx, i))
            qs, nx, ny = np.full(len(ps), j), lx - 1, ly
        else:
            qs = np.array(y.kids(ly, j))
            ps, nx, ny = np.full(len(qs), i), lx, ly - 1
        mx, lowx, highx, fx = (v[ps] for v in x.levels[nx])
        my, lowy, highy, fy = (v[qs] for v in y.levels[ny])
        both = np.bitwise_count(mx & my).sum(axis=1).astype(np.int64)
        most = np.minimum(both + np.minimum(fx, fy), np.minimum(highx, highy))
        fits = ((100 + percent) * most >= percent * (lowx + lowy)) & (100 * highx >= percent * lowy) & (100 * highy >= percent * lowx)
        same = own & (nx == ny) & (ps == qs)
        keep = np.flatnonzero(np.where(same, nx > 0, fits))
        keep = keep.tolist()
        if draw is not None:
            draw.shuffle(keep)
        stack += [(nx, int(ps[k]), ny, int(qs[k])) for k in keep]


class Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, i: int) -> int:
        up = self.up
        while up.setdefault(i, i) != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def block_pairs(rows: list[dict], percent: int, forest: bool, seed: int = 0, union: Union | None = None) -> set[tuple[int, int]]:
    """Pairs of a block with different roots that may link; of a block of two sides (1 and 2) those across.

    As a forest, a pair counts as connected once it is told (in ``union``, which several blocks may share), so there are at most as many as
    components; ``seed`` changes which.
    """
    union, out, draw = union or Union(), set(), random.Random(seed)
    for own, maps in by_class(rows, percent):
        sizes, root = np.array([r["n"] for r in own], dtype=np.int64), [r["root"] for r in own]
        sides = [np.flatnonzero([r["side"] == k for r in own]) for k in (0, 1, 2)]
        if len(sides[0]):
            a = b = sides[0]
        elif len(sides[1]) and len(sides[2]):
            a, b = sides[1], sides[2]
        else:
            continue
        left, right = Tree(maps[a], sizes[a], seed), None if b is a else Tree(maps[b], sizes[b], seed)
        for i, j in traverse(left, right, percent, lambda i, j: union.find(root[a[i]]) == union.find(root[b[j]]), draw if forest else None):
            if forest:
                union.join(root[a[i]], root[b[j]])
            out.add(tuple(sorted((own[a[i]]["node"], own[b[j]]["node"]))))
    return out


def allowance(n: int) -> int:
    """Shared shingles that prefixes of this many more guarantee to sets that link."""
    return max(1, n // 50)


# --- shingles, classes, prefixes -------------------------------------------------------------------------------------


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    release_caches()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _digest(s: np.ndarray, seed: int) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


_SET_SCHEMA = "doc_id long, key long, n int, node long, other long, map binary, part int, counts binary"


def _key(docs: DataFrame) -> Column:
    """One number for the rows of equal id and text."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def _sets(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """A row per document; and a task's bucket counts, in ``PARTS`` rows with ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for b in _slices(batches):
            n, nodes, others, maps = [], [], [], []
            for s in shingle_sets(b.column("text").to_pylist(), k):
                n.append(len(s))
                node, other = _digest(s, seed) if len(s) else (None, None)
                nodes.append(node)
                others.append(other)
                maps.append(bitmap(s).tobytes() if len(s) else None)
                np.add.at(counts, (s >> np.uint64(44)).astype(np.int64), 1)
            none = [None] * len(n)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("key"), pa.array(n, pa.int32()), pa.array(nodes, pa.int64()), pa.array(others, pa.int64()), pa.array(maps, pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.binary())],
                names=["doc_id", "key", "n", "node", "other", "map", "part", "counts"],
            )
        none = [None] * PARTS
        yield pa.RecordBatch.from_arrays(
            [pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array(range(PARTS), pa.int32()), pa.array([c.tobytes() for c in np.split(counts, PARTS)], pa.binary())],
            names=["doc_id", "key", "n", "node", "other", "map", "part", "counts"],
        )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _key(docs).alias("key")).mapInArrow(run, _SET_SCHEMA)


def _sketch(rows: DataFrame) -> np.ndarray:
    """Eighths of powers of two of the bucket counts: a table of ``BUCKETS`` bytes, whatever the input."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, dtype=np.int64) for c in table.column("counts").to_pylist())
        return pa.table({"part": table.column("part")[:1], "of": table.column("of")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    sums = rows.where("part is not null").select("part", F.rand(1).alias("of"), "counts")
    groups = -(-sums.count() // PARTS)
    while groups > 1:  # many tasks are summed in stages, so that none holds more than a few of their sketches
        groups = -(-groups // SKETCHES)
        dealt = sums.withColumn("of", F.floor(F.rand(groups) * groups).cast("int"))
        sums = written(dealt.groupBy("part", "of").applyInArrow(add, "part int, of int, counts binary"), "sketch")
    got = {r["part"]: np.frombuffer(bytes(r["counts"]), dtype=np.int64) for r in sums.select("part", "counts").collect()}
    if not got:
        return np.zeros(BUCKETS, dtype=np.uint8)
    return np.minimum(255, 4 * np.log2(1.0 + np.concatenate([got[p] for p in range(PARTS)]))).astype(np.uint8)


def _prefixes(docs: DataFrame, k: int, percent: int, seed: int, sketch: np.ndarray) -> DataFrame:
    """``(token, node, salt)``; ``salt`` is 0 but for tokens of crowded buckets, which it spreads over ``SALTS``."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    crowded = int(np.median(sketch)) + 8  # four times the median count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for b in _slices(batches):
            tokens, nodes, many = [], [], []
            for s in shingle_sets(b.column("text").to_pylist(), k):
                n = len(s)
                if n:
                    rank = (order[(s >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                    m = min(n, n - -(-percent * n // 100) + allowance(n))
                    tokens.append(s[np.argpartition(rank, m - 1)[:m]] if m < n else s)
                    nodes.append(_digest(s, seed)[0])
                    many.append(m)
            if tokens:
                token, node = np.concatenate(tokens), np.repeat(np.array(nodes, dtype=np.int64), many)
                hot = order[(token >> np.uint64(44)).astype(np.int64)] > crowded
                salt = np.where(hot, 1 + (node & (SALTS - 1)), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(node), pa.array(salt)], names=["token", "node", "salt"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token long, node long, salt int")


def _shared(prefixes: DataFrame) -> DataFrame:
    """``(token, node)``, each once, of tokens that more than one class has or that are salted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, node, salt = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)  # the last row, not told yet
        last = None  # the token that was told last
        for b in batches:
            token, node, salt = (np.concatenate([x, b.column(c).to_numpy()]) for x, c in ((token, "token"), (node, "node"), (salt, "salt")))
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
            token, node, salt = token[new], node[new], salt[new]
            like = token[1:] == token[:-1]
            keep = (salt > 0) | np.concatenate([like, [False]]) | np.concatenate([[False], like]) | (token == last if last is not None else False)
            if keep[:-1].any():
                yield pa.RecordBatch.from_arrays([pa.array(token[:-1][keep[:-1]]), pa.array(node[:-1][keep[:-1]])], names=["token", "node"])
                last = int(token[:-1][keep[:-1]][-1])
            token, node, salt = token[-1:], node[-1:], salt[-1:]
        if len(token) and (salt[0] > 0 or last == int(token[0])):
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(node)], names=["token", "node"])

    return prefixes.repartition("token", "salt").sortWithinPartitions("token", "node").mapInArrow(run, "token long, node long")


def _whole_sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, seed: int) -> DataFrame:
    """``(node, n, set)`` of the classes in ``pairs``, one row each.

    A class's text is found by the key of one of its rows; the digest tells whether it is the class's indeed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in _slices(batches):
            nodes = b.column("node").to_pylist()
            new = [i for i, node in enumerate(nodes) if node not in done]
            texts = b.column("text").take(pa.array(new, pa.int64())).to_pylist()
            out = {nodes[i]: s for i, s in zip(new, shingle_sets(texts, k)) if len(s) and _digest(s, seed)[0] == nodes[i]}
            done |= out.keys()
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(out), pa.int64()), pa.array([len(s) for s in out.values()], pa.int32()), pa.array([s.tobytes() for s in out.values()], pa.binary())], names=["node", "n", "set"]
            )

    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = written(classes.join(nodes, "node", "left_semi").select("node", "key"), "wanted")
    count = wanted.count()
    texts = docs.select(_key(docs).alias("key"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(wanted) if count <= BROADCAST_ROWS else wanted, "key")
    sets = written(rows.select("node", "text").mapInArrow(run, "node long, n int, set binary"), "whole-sets")
    return sets if sets.count() == count else sets.dropDuplicates(["node"])  # rows of equal id and text were in several tasks


# --- blocks ----------------------------------------------------------------------------------------------------------


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Rows of equal keys, which follow each other."""
    own, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            key = tuple(r[k] for k in keys)
            if key != own and rows:
                yield rows
                rows = []
            own = key
            rows.append(r)
    if rows:
        yield rows


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])


def _mixed(shared: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``(token, node, root, c)`` of the shingles that different components share; ``c`` counts a shingle's classes."""
    if roots is None:
        of = shared.withColumn("root", F.col("node"))
    else:
        of = shared.join(roots, "node", "left").select("token", "node", F.coalesce("root", "node").alias("root"))
    counts = of.groupBy("token").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.count(F.lit(1)).alias("c")).where("_a <> _b")
    return of.join(counts.select("token", "c"), "token")


def _some_pairs(mixed: DataFrame, maps: DataFrame, percent: int, round_: int) -> DataFrame:
    """Pairs that may link, from two blocks for each class."""
    seeds = range(round_ * PICKS, (round_ + 1) * PICKS)
    picks = mixed.groupBy("node", "root").agg(*(F.min(F.xxhash64("token", F.lit(k))).alias(f"b{k}") for k in seeds))
    members = picks.select("node", "root", F.explode(F.array(*(F.col(f"b{k}") for k in seeds))).alias("block")).distinct()
    sizes = members.groupBy("block").agg(F.count(F.lit(1)).alias("_c"), F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b")
    members = members.join(sizes.select("block", "_c"), "block").withColumn("chunk", F.pmod(F.xxhash64("node", "block"), F.ceil(F.col("_c") / CHUNK)))
    rows = members.select("node", "root", "block", "chunk", F.lit(0).alias("side")).join(maps, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(_slices(batches, 2048), ["block", "chunk"]):
            if len(group) > 1 and (pairs := block_pairs(group, percent, True, round_)):
                yield _pairs_batch(list(pairs))

    return rows.repartition("block", "chunk").sortWithinPartitions("block", "chunk").mapInArrow(run, "u long, v long").distinct()


def _all_pairs(mixed: DataFrame, maps: DataFrame, percent: int, forest: bool, seed: int = 0) -> DataFrame:
    """Pairs of classes in different components that share a shingle and may link: a forest in each block, or all."""
    small = mixed.where(F.col("c") <= CHUNK).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("node", "root"))).alias("of"))
    small = small.select("of").distinct().select(F.xxhash64("of").alias("block"), F.explode("of").alias("m"))
    small = small.select("block", F.col("block").alias("part"), F.col("m.node").alias("node"), F.col("m.root").alias("root"), F.lit(0).alias("side"))
    # of c chunks each meets every other: a row goes to the blocks (i, j) and (j, i) of its chunk
    # chunks go by class alone and parts by chunks, so that a pair that shares many large shingles is told by few parts
    chunks = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("c") / CHUNK))).cast("int")
    large = mixed.where(F.col("c") > CHUNK).withColumn("_i", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), chunks - 1)))
    pair = (F.least("_i", "_j"), F.greatest("_i", "_j"))
    large = large.select(
        F.xxhash64("token", *pair).alias("block"), F.xxhash64(*pair, F.pmod("token", F.lit(SPREAD if forest else LAST_SPREAD))).alias("part"), "node", "root",
        F.when(F.col("_i") == F.col("_j"), 0).when(F.col("_i") < F.col("_j"), 1).otherwise(2).alias("side"),
    )
    rows = small.unionByName(large).join(maps, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        union, part = None, None
        for group in _groups(_slices(batches, 2048), ["part", "block"]):
            if group[0]["part"] != part:
                told, union, part = set(), Union(), group[0]["part"]
            if len({r["root"] for r in group}) < 2:
                continue
            pairs = block_pairs(group, percent, forest, seed, union) - told
            if len(told) > TOLD:  # forgetting only means telling again
                told.clear()
            told |= pairs
            if pairs:
                yield _pairs_batch(list(pairs))

    return rows.repartition("part").sortWithinPartitions("part", "block").mapInArrow(run, "u long, v long").distinct()


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("node").alias("u"), F.col("n").alias("na"), F.col("set").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("n").alias("nb"), F.col("set").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 256):
            rows = batch.to_pylist()
            good = [
                (r["u"], r["v"])
                for r in rows
                if _links(len(np.intersect1d(np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], np.uint64), assume_unique=True)), r["na"], r["nb"], percent)
            ]
            if good:
                yield _pairs_batch(good)

    return pairs.join(a, "u").join(b, "v").select("u", "v", "na", "nb", "a", "b").mapInArrow(run, "u long, v long")


# --- components ------------------------------------------------------------------------------------------------------


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars: each node with the least one that these edges reach, ``TOLD`` nodes at a time."""

    def told() -> pa.RecordBatch:
        return _pairs_batch([(i, union.find(i)) for i in list(union.up) if union.find(i) != i])

    union = Union()
    for b in _slices(batches, 10_000):
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            union.join(u, v)
        if len(union.up) > TOLD:
            yield told()
            union = Union()
    if union.up:
        yield told()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one least neighbour or is one, but not both."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("to")), F.struct(F.col("v").alias("node"), F.col("v").alias("to")))
    return edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.min("e.to").alias("_a"), F.max("e.to").alias("_b")).where("_a <> _b").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of the nodes in ``edges(u, v)``; ``root`` is the least node that is reachable."""
    schema = "u long, v long"
    edges = written(edges.mapInArrow(_stars, schema).distinct(), "edges")
    while not _are_stars(edges):
        few = F.broadcast if edges.count() <= BROADCAST_ROWS else lambda df: df  # then edges stay where they are
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(few(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(few(least), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").where("u <> v").mapInArrow(_stars, schema).distinct(), "edges")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per document."""
    return _rooted(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def _rooted(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The same with ``key`` and ``root``, a class of the component (null without shingles)."""
    for seed in range(8):
        rows = written(_sets(docs, words, seed), "shingle-sets")
        ids = rows.where("part is null").select("doc_id", "key", "n", "node", "other")
        classes = written(ids.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.min("n").alias("n"), F.min("other").alias("_a"), F.max("other").alias("_b")), "classes")
        if classes.where("_a <> _b").isEmpty():
            break
    else:
        raise RuntimeError("digests of different sets were equal for every seed")
    classes = classes.select("node", "doc_id", "key", "n")
    shared = written(_shared(_prefixes(docs, words, percent, seed, _sketch(rows))), "shared-prefixes")
    least = F.greatest(F.lit(1), F.floor(F.floor(F.col("n") * percent / 100) / 50))
    rich = shared.groupBy("node").agg(F.count(F.lit(1)).alias("c")).join(classes.select("node", "n"), "node").where(F.col("c") >= least).select("node")
    shared = written(shared.join(rich, "node", "left_semi"), "shared-prefixes")
    maps = rows.where("node is not null").select("node", "n", "map").join(shared.select("node").distinct(), "node", "left_semi")
    maps = written(maps.dropDuplicates(["node"]), "bitmaps")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return written(_checked(pairs, _whole_sets(docs, classes, pairs, words, seed), percent).distinct(), "links")

    roots = None
    for round_ in range(ROUNDS + 2):
        mixed, last = _mixed(shared, roots), round_ == ROUNDS + 1
        pairs = _some_pairs(mixed, maps, percent, 0) if round_ == 0 else _all_pairs(mixed, maps, percent, not last, round_)
        new = confirmed(written(pairs, "pairs"))
        if not new.isEmpty():
            roots = written(connected(new if roots is None else new.union(roots)), "roots")
        elif 0 < round_ <= ROUNDS:  # nothing new to connect: go on to the last round
            new = confirmed(written(_all_pairs(mixed, maps, percent, False), "pairs"))
            if not new.isEmpty():
                roots = written(connected(new if roots is None else new.union(roots)), "roots")
            break
    if roots is None:
        roots = classes.select("node", F.col("node").alias("root")).limit(0)

    named = classes.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = written(named.join(least, "root").select("node", "root", "component_id"), "components")
    out = ids.join(named, "node", "left")
    return out.select("doc_id", "key", "root", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, and the documents without shingles; columns stay.

    The row of the least id stays, nulls last; of several texts with that id the one of the least key, and of equal ones any.
    """
    rows = _rooted(docs, words, percent).where("n_shingles > 0").groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("c"))
    rows = written(rows.select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key").alias("at"), "c"), "near-copies")
    best = rows.groupBy("root").agg(F.min("at").alias("best"))
    gone = written(rows.join(best, "root").where("at <> best").select(F.col("at.doc_id").alias("_id"), F.col("at.key").alias("_key")).distinct(), "gone")
    twice = written(rows.join(best, "root").where("at = best and c > 1").select(F.col("at.doc_id").alias("_id"), F.col("at.key").alias("_key")), "twice")

    def among(df: DataFrame, some: DataFrame, how: str) -> DataFrame:
        few = some.count() <= BROADCAST_ROWS  # then texts stay where they are
        return df.join(F.broadcast(some) if few else some, df["doc_id"].cast("long").eqNullSafe(some["_id"]) & (_key(df) == some["_key"]), how)

    kept = among(docs, gone, "left_anti")
    if twice.isEmpty():
        return kept
    return among(kept, twice, "left_anti").unionByName(among(kept, twice, "left_semi").dropDuplicates(["doc_id", "text"]))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)


#: DuckDB SQL for the query: all pairs that share a shingle, then reachability.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS t FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.t)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.t) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY 1, 2
"""
