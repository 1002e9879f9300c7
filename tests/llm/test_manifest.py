"""Merkle manifest beside a tree built in plain Python; every proof is folded again."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rotativa.llm import manifest
from rotativa.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, id string, place int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, place):
    """(before, after) on each level."""
    out = []
    for level in levels[:-1]:
        first = place - place % 16
        out.append((level[first:place], level[place + 1:first + 16]))
        place //= 16
    return out


def lowered(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(docs):
    """Sorted rows of (doc_id, leaf, subroot, root, proof, folded, verified)."""
    sources = sorted({d[3] for d in docs}, key=lambda s: (s is not None, (s or "").encode()))
    rows = {s: sorted(
        ((d[0], leaf_of(d[0], s, d[2], d[4], d[1]), leaf_of(d[0], s, d[2], d[4], lowered(d[1]))) for d in docs if d[3] == s),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1]),
    ) for s in sources}
    trees = {s: tree([r[1] for r in rows[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for n, s in enumerate(sources):
        for i, (doc_id, leaf, other) in enumerate(rows[s]):
            steps = path(trees[s], i) + path(top, n)
            changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
            folded = other if changed else leaf
            for before, after in steps:
                folded = digest(*before, folded, *after)
            proof = digest(*[h for before, after in steps for h in before + after])
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def found(spark, docs):
    df = spark.createDataFrame([(*d, "clash", "clash", 1) for d in docs], DOCS).repartition(3)
    changed = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return manifest.manifest(manifest.document_leaves(df, changed))


def docs_of(sizes):
    random.seed(3)
    docs = [
        (i, random.choice([None, "", "Some TEXT É", f"text {i}"]), random.choice([None, "en"]), s, random.choice([None, 3]))
        for s, n in sizes.items() for i in random.sample(range(-10, 10 * n + 20), n)
    ]
    random.shuffle(docs)
    return docs


@pytest.mark.parametrize("sizes", [
    {"one": 1}, {None: 1, "": 2}, {None: 20, "": 1, "-": 3, "=": 16, "a": 17, "z": 300, "é": 257, "Z": 5}, {f"s{i}": 1 + i % 3 for i in range(40)},
])
def test_equals_brute_force(spark, sizes):
    docs = docs_of(sizes)
    names = ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    got = sorted((tuple(r[n] for n in names) for r in found(spark, docs).collect()), key=str)
    assert got == brute(docs)


def test_repeated_rows_and_null_ids(spark):
    docs = docs_of({"a": 40, None: 3})
    docs += docs[:5] + [(None, t, None, s, None) for t in (None, "x", "Y") for s in ("a", None)] + [(docs[0][0], "another", "en", docs[0][3], 1)]
    names = ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    got = sorted((tuple(r[n] for n in names) for r in found(spark, docs).collect()), key=str)
    assert got == brute(docs)


def test_high_trees(spark):
    """More than one leaf partition a source, and a last one of a single leaf."""
    docs = docs_of({"big": 5000, "small": 70, "mid": 4097})
    rows = {(r.id, r.leaf): r for r in found(spark, docs).collect()}
    want = brute(docs)
    assert len(rows) == len(want)
    for doc_id, leaf, subroot, root, proof, folded, verified in want:
        r = rows[doc_id, leaf]
        assert (r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) == (subroot, root, proof, folded, verified)


def test_proofs_fold_to_the_root(spark):
    leaves = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("source"), "id", F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("leaf"),
        F.lit(None).cast("string").alias("other"),
    )
    rows = manifest.manifest(leaves, with_proofs=True).collect()
    assert len(rows) == 5000 and all(r.verified for r in rows)
    for r in rows[::37]:
        assert digest(*[h for level in r.proof for h in level]) == r.proof_sha256
        node, place, width = r.leaf, r.place, 1667 if r.tree == 0 else 3333
        for level in r.proof[:-1]:
            k = place % 16
            node, place, width = digest(*level[:k], node, *level[k:]), place // 16, -(-width // 16)
        assert node == r.subroot and width == 1
        assert digest(*r.proof[-1][:r.tree], node, *r.proof[-1][r.tree:]) == r.root


def test_empty(spark):
    assert found(spark, []).count() == 0


def test_query_catches_every_change(spark):
    rows = QUERIES["op13_manifest"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts) and len({r.root for r in rows}) == 1
    for r in rows:
        changed = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and lowered(texts[r.doc_id]) != texts[r.doc_id]
        assert r.verified == (not changed)
