"""The Merkle manifest against a direct construction, and what verification tells."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """(root, siblings of each leaf by level, with its place among them)."""
    paths = [[] for _ in leaves]
    at, row = list(range(len(leaves))), list(leaves)
    while len(row) > 1:
        for i, p in enumerate(at):
            first = p // 8 * 8
            paths[i].append((row[first:p], row[p + 1 : first + 8]))
            at[i] = p // 8
        row = [H("".join(row[i : i + 8])) for i in range(0, len(row), 8)]
    return row[0], paths


def brute(rows, lowered):
    """By doc_id and leaf: subroot, root, proof, folded root; rows are (doc_id, source, lang, n_chars, text)."""
    leaf = {}
    for r in rows:
        leaf.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), H("".join(map(field, r))), H("".join(map(field, (*r[:4], r[4] and lowered(r[4])))))))
    names = sorted(leaf, key=lambda x: (x is not None, (x or "").encode()))
    trees = {n: (sorted(leaf[n]), *tree([x[1] for x in sorted(leaf[n])])) for n in names}
    root, tops = tree([trees[n][1] for n in names])
    out = []
    for n, top in zip(names, tops, strict=True):
        found, subroot, paths = trees[n]
        for (key, own, low), path in zip(found, paths, strict=True):
            doc_id = key[1] if key[0] else None
            h = low if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else own
            whole = path + top
            for a, b in whole:
                h = H("".join(a) + h + "".join(b))
            out.append((doc_id, own, subroot, root, H("".join("".join(a + b) for a, b in whole)), h, h == root))
    return sorted(out, key=repr)


def run(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    columns = {c: F.col(c) for c in merkle.COLUMNS}
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf_digest(columns | {"text": lower})).otherwise(merkle.leaf_digest(columns))
    manifest = merkle.build_manifest(docs, keep={"claimed": claimed})
    out = merkle.verify(manifest, manifest.leaves)
    return manifest, sorted((tuple(r) for r in out.collect()), key=repr)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_addresses_are_a_numbering_with_subtrees_together(levels):
    every = [int(a) for k in range(levels) for a in merkle.address(k, np.arange(8**k), levels)]
    assert sorted(every) == list(range(merkle.nodes_of(levels))) and every[0] == 0
    if levels > 1:
        # the upper half first, then the lower subtrees one after another
        top = levels // 2
        assert sorted(every[: merkle.nodes_of(top)]) == list(range(merkle.nodes_of(top)))
        low = [int(merkle.address(k, i, levels)) for k in range(top, levels) for i in range(8 ** (k - top))]
        assert sorted(low) == list(range(merkle.nodes_of(top), merkle.nodes_of(top) + merkle.nodes_of(levels - top)))


def test_equal_to_a_direct_construction(spark):
    rng = random.Random(3)
    rows = [(i, f"s{i % 3}", rng.choice(["en", "de", "ü", "z" * 30]), i, rng.choice(["Ab cÉ", "none", "", "X" * 20_000])) for i in range(200)]
    rows += [(None, None, None, None, None)] * 2 + [(7, "s1", None, 3, None), (7, "s1", "en", 3, "A tie"), (7, "s1", "en", 3, "A tie"), (8, "one", "only", 1, "Z"), (9, "", "", 0, "")]
    rng.shuffle(rows)
    _, got = run(spark, rows)
    assert got == brute(rows, lowered)
    assert {r[6] for r in got} == {True, False}


def test_trees_of_several_tiers(spark):
    rows = [(i, "s", "en" if i % 50 else "fr", i, f"Text {i}") for i in range(merkle.BLOCK * 2 + 200)]
    rows += [(10**9 + i, "s", f"l{i:04d}", 1, "T") for i in range(100)]
    manifest, got = run(spark, rows)
    assert len(manifest.tiers) == 2 and got == brute(rows, lowered)
    assert sum(r["leaves"] for r in manifest.tiers[0].select("leaves").collect()) == len(rows)


def test_nothing_and_one(spark):
    manifest, got = run(spark, spark.createDataFrame([], DOCS).collect())
    assert got == [] and manifest.root is None
    one = [(1, None, "en", None, "A")]
    manifest, got = run(spark, one)
    assert got == brute(one, lowered) and got[0][1] == got[0][2] == got[0][3] == manifest.root


def test_other_columns_and_names(spark):
    docs = spark.createDataFrame([("b", "en", "x", 1, 2), ("a", "en", "y", 3, 4)], "key string, lang string, text string, pos int, tree int")
    manifest = merkle.build_manifest(docs, id_col="key", columns=("key", "text"))
    rows = manifest.leaves.orderBy("pos").collect()
    assert [(r["id"], r["pos"], r["n"], r["leaf"]) for r in rows] == [("a", 0, 2, H("1:a1:y")), ("b", 1, 2, H("1:b1:x"))]
    assert all(r["verified"] for r in merkle.verify(manifest, manifest.leaves.withColumn("claimed", F.col("leaf"))).collect())
