"""Merkle dataset manifest: a hash tree over every row, merged as a monoid of sparse forests.

Rows become leaves (SHA-256 of their length-prefixed fields, on the JVM, texts being read once), and only ids and digests move
from there on. Each group is a tree of its leaves in key order; every ``ARITY`` neighbours have one parent, up to a subroot. The
subroots, in order of their groups, are the leaves of one more tree, which gives the root.

1. Leaves are range-partitioned by (group, key), so a hot group lies in many parts, and each learns its first leaf's number in its
   tree from the parts' counts alone.
2. A part climbs as far as its own leaves reach. What is left over is its fragment: nodes, keyed by level and index, whose
   siblings lie in other parts, a few for each level and at most two trees. ``treeReduce`` merges fragments, in any grouping and any order: whenever a run
   of siblings is complete (its arity is known from the tree's size) it becomes its parent, up to the root of the tree.
   Runs that closed on the way are the seams. The driver sees these, a few for each part and level and so bounded by the
   number of parts, never by that of rows; trees within one part do not pass through it.
3. Each part climbs again with the seams that touch it, so that every leaf has its siblings on all levels: its proof.

A part has about ``PART_ROWS`` leaves. Stages are written to the shared folder; a part that is computed again gives the same nodes.

Defined cases: a null field is ``-``, a null group is a group of its own and the first one; null keys come first; equal keys are ordered by leaf, and
rows that repeat each get a leaf and a proof; a group of one row has that leaf as its subroot; an empty table gives no rows and a manifest of none; very
long texts are hashed whole; columns that are not among the fields are ignored.
"""

from __future__ import annotations

from binascii import hexlify, unhexlify
from collections.abc import Iterable
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilmark.llm.common import read_table, shared_dir, written

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PART_ROWS = 200_000
SEAM_ROWS = 200_000  # of the seams in one write
_MOST_LEVELS = 40  # 3 ** 40 is beyond 64 bits


def leaf_digest(fields: Iterable[Column]) -> Column:
    """SHA-256 (lower-case hex) of the fields, each ``-`` if null, else its UTF-8 length, a colon and its value."""
    said = []
    for field in fields:
        value = field.cast("string")
        said.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*said).cast("binary"), 256)


def parent(children: list[bytes]) -> bytes:
    """The digest (hex) of a run of siblings."""
    return sha256(b"".join(children)).hexdigest().encode()


def climb(first: int, nodes: list[bytes], size: int) -> tuple[list[tuple[int, list[bytes]]], list[tuple[int, int, bytes]]]:
    """From neighbouring leaves of a tree of ``size`` leaves: the nodes known by level, and those whose run is not complete here."""
    levels, left = [(first, nodes)], []
    while size > 1 and nodes:
        last, above, level = first + len(nodes), -(-size // ARITY), len(levels) - 1
        low, high = -(-first // ARITY), above if last == size else last // ARITY
        high = max(low, high)
        whole = range(low * ARITY, min(high * ARITY, size)) if high > low else range(0)
        left += [(level, first + i, d) for i, d in enumerate(nodes) if first + i not in whole]
        nodes = [parent(nodes[r * ARITY - first : (r + 1) * ARITY - first]) for r in range(low, high)]
        first, size = low, above
        levels.append((first, nodes))
    return levels, left


class Forest:
    """Unresolved nodes by (tree, level, index): a commutative monoid under ``merge``, whose identity is the empty forest."""

    def __init__(self):
        self.sizes: dict[str | None, int] = {}
        self.nodes: dict[tuple[str | None, int, int], bytes] = {}
        self.seams: list[tuple[str | None, int, int, bytes]] = []
        self.roots: dict[str | None, bytes] = {}

    def put(self, tree: str | None, level: int, index: int, digest: bytes) -> None:
        """Adds a node and, while that completes a run of siblings, its parent."""
        while True:
            size = -(-self.sizes[tree] // ARITY**level)
            if size == 1:
                self.roots[tree] = digest
                return
            self.nodes[tree, level, index] = digest
            run = range(index - index % ARITY, min(index - index % ARITY + ARITY, size))
            if any((tree, level, k) not in self.nodes for k in run):
                return
            children = [self.nodes.pop((tree, level, k)) for k in run]
            self.seams += [(tree, level, k, d) for k, d in zip(run, children)]
            level, index, digest = level + 1, index // ARITY, parent(children)

    def merge(self, other: Forest) -> Forest:
        big, small = (self, other) if len(self.nodes) + len(self.seams) >= len(other.nodes) + len(other.seams) else (other, self)
        big.sizes |= small.sizes
        big.roots |= small.roots
        big.seams += small.seams
        for (tree, level, index), digest in small.nodes.items():
            big.put(tree, level, index, digest)
        return big


def _forest(rows: Iterable) -> list[Forest]:
    out = Forest()
    for r in rows:
        out.sizes[r["tree"]] = r["size"]
        out.put(r["tree"], r["level"], r["index"], hexlify(bytes(r["digest"])))
    return [out]


def _number(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves in order by part, and the parts' runs ``(part, tree, first_nth, n, before, size)``: ``before`` leaves of the tree are in earlier parts."""
    order = ("tree", "key", "leaf", "at")
    parts = max(int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")), leaves.count() // PART_ROWS + 1)
    placed = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id())
    part, nth = F.shiftright("mid", 33).cast("int"), F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(placed.select("tree", "key", "leaf", "other", part.alias("part"), nth.alias("nth")), "leaves")
    runs = placed.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first_nth"))
    tree = W.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return placed, written(runs.select("part", "tree", "n", "first_nth", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(tree).alias("size")), "runs")


def _in_order(left: pa.Table) -> pa.Table:
    return left.take(pa.array(np.argsort(left["nth"].to_numpy(), kind="stable")))


def _fragments(left: pa.Table, right: pa.Table) -> pa.Table:
    """The unresolved nodes of one part, and the roots (level -1) of the trees that lie within it."""
    leaves, rows = list(map(hexlify, _in_order(left)["leaf"].to_pylist())), []
    for run in right.to_pylist():
        levels, open_nodes = climb(run["before"], leaves[run["first_nth"] : run["first_nth"] + run["n"]], run["size"])
        if run["n"] == run["size"]:
            open_nodes = [(-1, 0, levels[-1][1][0])]
        rows += [(run["tree"], run["size"], level, index, unhexlify(d)) for level, index, d in open_nodes]
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["tree", "size", "level", "index", "digest"])


def _roots(placed: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(tree, n_leaves, subroot)`` of every tree, and the seams ``(tree, level, index, digest)``."""
    spark = placed.sparkSession
    made = placed.select("part", "nth", "leaf").groupBy("part").cogroup(runs.groupBy("part"))
    made = written(made.applyInArrow(_fragments, "tree string, size long, level int, index long, digest binary"), "fragments")
    left = made.where("level >= 0").rdd.mapPartitions(_forest)
    forest = left.union(spark.sparkContext.parallelize([Forest()], 1)).treeReduce(Forest.merge, depth=3)
    assert not forest.nodes, "a run of siblings is not complete"
    path = shared_dir(spark, "seams")
    seam = "tree string, level int, index long, digest binary"
    for at in range(0, max(1, len(forest.seams)), SEAM_ROWS):
        some = [(t, level, index, bytearray(unhexlify(d))) for t, level, index, d in forest.seams[at : at + SEAM_ROWS]]
        spark.createDataFrame(some, seam).write.mode("append").parquet(path)
    crossing = spark.createDataFrame([(t, forest.sizes[t], bytearray(unhexlify(d))) for t, d in forest.roots.items()], "tree string, n_leaves long, subroot binary")
    whole = made.where("level < 0").select("tree", F.col("size").alias("n_leaves"), F.col("digest").alias("subroot"))
    return written(whole.unionByName(crossing), "subroots"), spark.read.schema(seam).parquet(path)


def _touching(runs: DataFrame, seams: DataFrame) -> DataFrame:
    """The runs with the ``seams`` above their first and last leaf, which are all that a part lacks."""
    ends = runs.where("n < size").select("part", "tree", F.explode(F.array("before", F.col("before") + F.col("n") - 1)).alias("leaf_index"))
    nodes = ends.select("part", "tree", "leaf_index", F.explode(F.sequence(F.lit(0), F.lit(_MOST_LEVELS - 1))).alias("on"))
    nodes = nodes.withColumn("node", F.expr(f"leaf_index div cast(pow({ARITY}, on) as decimal(20, 0))").cast("long"))
    nodes = nodes.select("part", "tree", "on", F.explode(F.expr(f"sequence(node - node % {ARITY}, node - node % {ARITY} + {ARITY - 1})")).alias("node")).distinct()
    seams = seams.select(F.col("tree").alias("seam_tree"), "level", "index", "digest")
    found = nodes.join(seams, F.col("tree").eqNullSafe(F.col("seam_tree")) & (F.col("on") == F.col("level")) & (F.col("node") == F.col("index")))
    found = found.groupBy("part", F.col("tree").alias("seam_tree")).agg(F.collect_list(F.struct("level", "index", "digest")).alias("seams")).withColumnRenamed("part", "seam_part")
    return runs.join(found, (F.col("part") == F.col("seam_part")) & F.col("tree").eqNullSafe(F.col("seam_tree")), "left").drop("seam_part", "seam_tree")


_STEPS = "array<struct<before:binary,after:binary>>"  # siblings on each level, digests end to end


def _proofs(left: pa.Table, right: pa.Table) -> pa.Table:
    """Every leaf's siblings, and what folding it (or the digest given instead) with them comes to."""
    left = _in_order(left)
    own, other = left["leaf"].to_pylist(), left["other"].to_pylist()
    n = len(own)
    group, subroot, root, proof, folded, steps = ([None] * n for _ in range(6))
    for run in right.to_pylist():
        at, size = run["first_nth"], run["size"]
        levels, _ = climb(run["before"], list(map(hexlify, own[at : at + run["n"]])), size)
        known = [dict(enumerate(nodes, first)) for first, nodes in levels[1:]]  # inner levels; leaves are looked up as a list
        known.insert(0, dict(enumerate(levels[0][1], levels[0][0])))
        for seam in run["seams"] or ():
            known.extend({} for _ in range(seam["level"] + 1 - len(known)))
            known[seam["level"]][seam["index"]] = hexlify(seam["digest"])
        top = [(hexlify(s["before"]), hexlify(s["after"])) for s in run["top"] or ()]
        for i in range(run["n"]):
            index, wide, path = run["before"] + i, size, []
            for nodes in known:
                if wide == 1:
                    break
                low = index - index % ARITY
                path.append((b"".join(nodes[k] for k in range(low, index)), b"".join(nodes[k] for k in range(index + 1, min(low + ARITY, wide)))))
                index, wide = index // ARITY, -(-wide // ARITY)
            assert wide == 1, "a level has no nodes"
            path += top
            now = hexlify(other[at + i] if other[at + i] is not None else own[at + i])
            for b, a in path:
                now = sha256(b + now + a).hexdigest().encode()
            group[at + i], subroot[at + i], root[at + i] = run["tree"], run["subroot"], run["root"]
            proof[at + i], folded[at + i] = sha256(b"".join(b + a for b, a in path)).digest(), unhexlify(now)
            steps[at + i] = [{"before": unhexlify(b), "after": unhexlify(a)} for b, a in path] if run["with_steps"] else None
    kind = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))
    made = [pa.array(group, pa.string()), *(pa.array(x, pa.binary()) for x in (subroot, root, proof, folded)), pa.array(steps, kind)]
    return pa.table([left["key"], left["leaf"], *made], names=["key", "leaf", "tree", "subroot", "root", "proof_digest", "folded", "steps"])


def _prove(placed: DataFrame, runs: DataFrame, seams: DataFrame, tops: DataFrame, with_steps: bool) -> DataFrame:
    """A row for each leaf. ``tops``: ``(tree, subroot, root, top)``, the siblings above the subroot."""
    tops = tops.withColumnRenamed("tree", "top_tree")
    runs = _touching(runs, seams).join(tops, F.col("tree").eqNullSafe(F.col("top_tree"))).drop("top_tree").withColumn("with_steps", F.lit(with_steps))
    key = dict(placed.dtypes)["key"]
    schema = f"key {key}, leaf binary, tree string, subroot binary, root binary, proof_digest binary, folded binary, steps {_STEPS}"
    return placed.select("part", "nth", "key", "leaf", "other").groupBy("part").cogroup(runs.groupBy("part")).applyInArrow(_proofs, schema)


def merkle_tree(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: Iterable[str] = FIELDS, instead: Column | None = None, with_steps: bool = False) -> tuple[DataFrame, DataFrame]:
    """The manifest ``(group, n_leaves, subroot, root)`` and the proofs ``(key, group, leaf, subroot, root, proof_sha256, folded, steps)``.

    ``instead``: a leaf digest (hex, or null for the row's own) that is folded with the siblings in the leaf's place. ``steps``, if asked for, are
    the siblings before and after the node on each level, which ``fold`` takes.
    """
    other = F.lit(None).cast("binary") if instead is None else F.unhex(instead)
    leaves = docs.select(F.col(group).cast("string").alias("tree"), F.col(key).alias("key"), F.unhex(leaf_digest(F.col(c) for c in fields)).alias("leaf"), other.alias("other"))
    placed, runs = _number(written(leaves.withColumn("at", F.monotonically_increasing_id()), "digests"))
    subroots, seams = _roots(placed, runs)

    nothing = F.lit(None).cast("string")
    upper = subroots.select(nothing.alias("tree"), F.col("tree").alias("key"), F.col("subroot").alias("leaf"), F.lit(None).cast("binary").alias("other"), F.lit(0).alias("at"))
    upper_placed, upper_runs = _number(upper)
    root, upper_seams = _roots(upper_placed, upper_runs)
    above = root.select("tree", "subroot", F.col("subroot").alias("root"), F.lit(None).cast(_STEPS).alias("top"))
    tops = _prove(upper_placed, upper_runs, upper_seams, above, True).select(F.col("key").alias("tree"), F.col("leaf").alias("subroot"), "root", F.col("steps").alias("top"))
    tops = written(tops, "tops")

    text = lambda c: F.lower(F.hex(c))
    sizes = subroots.select(F.col("tree").alias("size_tree"), "n_leaves")
    manifest = tops.join(sizes, F.col("tree").eqNullSafe(F.col("size_tree"))).select(F.col("tree").alias("group"), "n_leaves", text("subroot").alias("subroot"), text("root").alias("root"))
    proofs = _prove(placed, runs, seams, tops, with_steps).select(
        "key", F.col("tree").alias("group"), *(text(c).alias(c) for c in ("leaf", "subroot", "root")), text("proof_digest").alias("proof_sha256"), text("folded").alias("folded"), "steps"
    )
    return manifest, proofs


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf (hex) and its siblings come to, on the JVM: a holder of one row and its proof needs no tree."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(F.lower(F.hex(s["before"])), h, F.lower(F.hex(s["after"]))).cast("binary"), 256))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    fields = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in FIELDS]
    _, proofs = merkle_tree(docs, instead=F.when(tampered, leaf_digest(fields)))
    return proofs.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified")
    )


#: Levels are climbed by recursion; the subroots' tree is the second recursion, and paths are folded by a third.
ORACLE_SQL = """
WITH RECURSIVE
table_of AS (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT] || list_transform(range(8), lambda k: k::BIGINT),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT doc_id, source, text, lang, n_chars, replace(text, chr(10), '') AS bare,
    list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])) AS inverted FROM documents, table_of),
said AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM d),
leaves AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN inverted % 2 = 1 THEN sha256(head || coalesce(strlen(bare) || ':' || bare, '-')) END AS other FROM said),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
nodes(source, level, i, h, m) AS (
  SELECT source, 0, i, leaf, count(*) OVER (PARTITION BY source) FROM numbered
  UNION ALL
  SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (m + 2) // 3 FROM nodes WHERE m > 1 GROUP BY source, level, i // 3, m),
subroots AS (SELECT source, h AS subroot, level AS top, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k FROM nodes WHERE m = 1),
upper_nodes(level, i, h, m) AS (
  SELECT 0, k, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (m + 2) // 3 FROM upper_nodes WHERE m > 1 GROUP BY level, i // 3, m),
walk(id, source, k, top, level, i, h, folded, siblings) AS (
  SELECT n.doc_id, n.source, s.k, s.top, 0, CASE WHEN s.top = 0 THEN s.k ELSE n.i END, n.leaf, coalesce(n.other, n.leaf), '' FROM numbered n JOIN subroots s ON n.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT w.id, w.source, w.k, w.top, w.level + 1, CASE WHEN w.level + 1 = w.top THEN w.k ELSE w.i // 3 END, w.h,
    sha256(coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < w.i), '') || w.folded || coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > w.i), '')),
    w.siblings || coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i <> w.i), '')
  FROM walk w
  JOIN (SELECT true AS low, source, level, i, h FROM nodes WHERE m > 1 UNION ALL SELECT false, NULL, level, i, h FROM upper_nodes WHERE m > 1) x
    ON CASE WHEN w.level < w.top THEN x.low AND x.source IS NOT DISTINCT FROM w.source AND x.level = w.level ELSE NOT x.low AND x.level = w.level - w.top END
    AND x.i // 3 = w.i // 3
  GROUP BY w.id, w.source, w.k, w.top, w.level, w.i, w.h, w.folded, w.siblings),
ends AS (SELECT id, source, h, arg_max(folded, level) AS folded, arg_max(siblings, level) AS siblings FROM walk GROUP BY id, source, h)
SELECT e.id AS doc_id, e.h AS leaf, s.subroot, r.h AS root, sha256(e.siblings) AS proof_sha256, e.folded AS folded_root, e.folded = r.h AS verified
FROM ends e JOIN subroots s ON e.source IS NOT DISTINCT FROM s.source, (SELECT h FROM upper_nodes WHERE m = 1) r
"""
