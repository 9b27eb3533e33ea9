"""The manifest against a tree built level by level, the monoid's laws, and proofs folded without a tree."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from veilmark.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves):
    """The root, and each leaf's siblings level by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for nodes in levels[:-1]:
            low = i - i % 3
            path.append((nodes[low:i], nodes[i + 1 : low + 3]))
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def plain(rows):
    """``(doc_id, leaf, subroot, root, proof, path)`` of every row."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0], plain_leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: (sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))) for g in order}
    trees = {g: plain_tree([leaf for _, leaf in subs[g]]) for g in order}
    root, above = plain_tree([trees[g][0] for g in order])
    out = []
    for g, up in zip(order, above):
        for (key, leaf), path in zip(subs[g], trees[g][1]):
            steps = path + up
            out.append((key, leaf, trees[g][0], root, sha(*(d for b, a in steps for d in b + a)), steps))
    return out


def made_rows(n, seed=3):
    r = random.Random(seed)
    sources = ["hot"] * 20 + [None] * 3 + [f"s{i}" for i in range(9)] + ["", "É", "z"]
    rows = [(i, r.choice(sources), r.choice(["en", None]), r.choice([None, i]), r.choice([None, "", f"text {i}\nline\n", "\n", "ünï"])) for i in range(n)]
    rows += [(0, "hot", "en", 1, "same id"), (0, "hot", "en", 1, "same id"), (None, "hot", None, None, None), (5, "alone", "en", 3, "x" * 200_000)]
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n, part_rows", [(400, 200_000), (400, 9), (400, 1), (2, 200_000), (30, 3)])
def test_tree_and_proofs(spark, n, part_rows, monkeypatch):
    monkeypatch.setattr(merkle, "PART_ROWS", part_rows)
    rows = made_rows(n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    clash = df.withColumns({c: F.lit("mine") for c in ("tree", "key", "leaf", "other", "at", "part", "nth", "size", "level", "top", "group")})
    if part_rows == 1:  # more parts than leaves: the smallest of tables suffices
        rows, clash = rows[:40], spark.createDataFrame(rows[:40], SCHEMA)
    manifest, proofs = merkle.merkle_tree(clash, with_steps=True)
    got = proofs.withColumn("again", merkle.fold(F.col("leaf"), F.col("steps"))).collect()
    expected = plain(rows)
    assert Counter((x["key"], x["leaf"], x["subroot"], x["root"], x["proof_sha256"]) for x in got) == Counter(e[:5] for e in expected)
    assert all(x["folded"] == x["root"] == x["again"] for x in got)
    by_group = Counter(r[1] for r in rows)
    assert {x["group"]: x["n_leaves"] for x in manifest.collect()} == by_group and {x["root"] for x in manifest.collect()} == {expected[0][3]}


def test_one_leaf_and_none(spark):
    one = spark.createDataFrame([(7, None, None, None, None)], SCHEMA)
    manifest, proofs = merkle.merkle_tree(one)
    leaf = plain_leaf((7, None, None, None, None))
    got = proofs.first()
    assert (got["leaf"], got["subroot"], got["root"], got["folded"], got["proof_sha256"]) == (leaf, leaf, leaf, leaf, sha(""))
    manifest, proofs = merkle.merkle_tree(one.where("false"))
    assert manifest.count() == 0 and proofs.count() == 0


def test_tampered_texts_do_not_verify(spark, tmp_path):
    rows = made_rows(60)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()
    import zlib

    leaves = Counter()
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and "\n" in (r[4] or "")
        leaves[r[0], plain_leaf(r), not changed] += 1
    assert Counter((x["doc_id"], x["leaf"], x["verified"]) for x in got) == leaves and {x["verified"] for x in got} == {True, False}
    paths = {(e[0], e[1]): e[5] for e in plain(rows)}
    for x in got:
        r = next(r for r in rows if r[0] == x["doc_id"] and plain_leaf(r) == x["leaf"])
        now = x["leaf"] if x["verified"] else plain_leaf((*r[:4], r[4].replace("\n", "")))
        if sum(q[:2] == r[:2] for q in rows) == 1:
            for before, after in paths[x["doc_id"], x["leaf"]]:
                now = sha(*before, now, *after)
            assert x["folded_root"] == now


def test_merging_in_any_order_is_the_same(seed=11):
    r = random.Random(seed)
    sizes = {"a": 100, None: 7, "b": 1, "c": 81}
    leaves = {t: [sha(f"{t}{i}").encode() for i in range(n)] for t, n in sizes.items()}
    for _ in range(30):
        forests = []
        for tree, own in leaves.items():
            cuts = sorted({0, len(own), *(r.randrange(len(own)) for _ in range(r.randint(0, 30)))})
            for a, b in zip(cuts, cuts[1:]):
                levels, left = merkle.climb(a, own[a:b], len(own))
                f = merkle.Forest()
                f.sizes[tree] = len(own)
                for level, index, d in left if b - a < len(own) else [(len(levels) - 1, 0, levels[-1][1][0])]:
                    f.put(tree, level, index, d)
                forests.append(f)
        r.shuffle(forests)
        while len(forests) > 1:  # any grouping
            k = r.randrange(len(forests) - 1)
            forests[k : k + 2] = [forests[k].merge(merkle.Forest()).merge(forests[k + 1])]
        assert not forests[0].nodes and {t: d.decode() for t, d in forests[0].roots.items()} == {t: plain_tree([x.decode() for x in own])[0] for t, own in leaves.items()}


@pytest.mark.parametrize("n", [1, 3, 60])
def test_sql_says_the_same(spark, tmp_path, n):
    rows = [(i, *r[1:]) for i, r in enumerate(made_rows(n))][:n]  # the SQL takes ids as keys
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.execute(merkle.ORACLE_SQL)
    cols = [c[0] for c in rel.description]
    got = merkle.op11_merkle_manifest(spark, str(tmp_path)).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())
