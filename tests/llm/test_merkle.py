"""The Merkle manifest against plain recursion."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsfoundry.llm import merkle
from tsfoundry.session import scratch_path

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([sha("".join(row[i : i + 2])) for i in range(0, len(row), 2)])
    return levels


def plain(rows):
    """``doc_id, leaf, subroot, root, proof, folded, verified`` of dictionaries."""
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    digest = lambda r, **k: sha("".join(framed((r | k)[c]) for c in FIELDS))
    struck = lambda r: r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, digest(r), digest(r, n_chars=r["n_chars"] + 1) if struck(r) else digest(r)))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: plain_tree([x[2] for x in sorted(groups[k])]) for k in order}
    top = plain_tree([trees[k][-1][0] for k in order])
    out = []
    for g, k in enumerate(order):
        for i, (some, doc, leaf, claim) in enumerate(sorted(groups[k])):
            path, node = [], claim
            for levels, at in ((trees[k], i), (top, g)):
                for row in levels[:-1]:
                    pair = row[at // 2 * 2 : at // 2 * 2 + 2]
                    path += [x for j, x in enumerate(pair) if j != at % 2]
                    pair[at % 2] = node
                    node, at = sha("".join(pair)), at // 2
            out.append((doc if some else None, leaf, trees[k][-1][0], top[-1][0], sha("".join(path)), node, node == top[-1][0]))
    return sorted(out, key=str)


def test_layout_is_recursive():
    def order(levels, root=(0, 0)):
        if levels == 1:
            return [root]
        upper = levels // 2
        depth, index = root
        out = order(upper, root)
        for i in range(1 << upper):
            out += order(levels - upper, (depth + upper, (index << upper) + i))
        return out

    for levels in range(1, 12):
        at = {node: i for i, node in enumerate(order(levels))}
        assert sorted(at.values()) == list(range(2**levels - 1))
        for depth in range(levels):
            assert merkle.address(depth, np.arange(1 << depth), levels).tolist() == [at[depth, i] for i in range(1 << depth)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 11, 16])
def test_subtrees_and_proofs(n):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    levels = merkle.height(n)
    nodes, root = merkle.subtree(leaves, levels)
    assert root.hex() == plain_tree([x.hex() for x in leaves])[-1][0]
    for i, path in enumerate(merkle.siblings(nodes, n, levels)):
        assert merkle.fold(leaves[i], i, n, b"".join(path))[0] == root
        assert merkle.fold(leaves[i - 1], i, n, b"".join(path))[0] != root or n == 1


def rows_of(n, seed, langs):
    r = random.Random(seed)
    return [{"doc_id": i * 3 % n, "source": r.choice([None, "s", "src:1", ""]), "lang": r.choice(langs), "n_chars": r.choice([None, 1, 20]), "text": r.choice([None, "", "é字", "text " * r.randint(1, 9)])} for i in range(n)]


@pytest.mark.parametrize("levels", [1, 2, 10])
@pytest.mark.parametrize("langs", [["en"], [None, "de", "en", "e", "Ω", "字", "", "x"]])
def test_manifest_equals_recursion(spark, tmp_path, levels, langs, monkeypatch):
    rows = rows_of(157, levels, langs)
    if len(langs) > 1:  # repeated rows, repeated and null ids, a group of one
        rows += [rows[0]] * 3 + [dict(rows[1], text="other"), dict(rows[2], doc_id=None), dict(rows[2], doc_id=None, text="z"), dict(rows[3], lang="alone")]
    path = str(tmp_path)
    spark.createDataFrame([tuple(r[c] for c in FIELDS) + ("k", "b") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, key string, path string").repartition(5).write.parquet(f"{path}/documents.parquet")
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    for f in (merkle.build, merkle.prove):
        monkeypatch.setattr(f, "__defaults__", (levels,))
    monkeypatch.setattr(merkle.manifest, "__defaults__", (*merkle.manifest.__defaults__[:-1], levels))
    got = sorted((tuple(x) for x in merkle.query(spark, path).collect()), key=str)
    assert got == plain(rows)


def test_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert merkle.manifest(empty, scratch_path(spark, "m"), ["doc_id", "lang", "text"]).count() == 0
    one = spark.createDataFrame([(1, "x", "long " * 100_000, 5)], "doc_id long, lang string, text string, pos int")
    x = merkle.manifest(one, scratch_path(spark, "m"), ["doc_id", "lang", "text"]).first()
    assert x.leaf == x.subroot == x.root == x.folded and x.path == b""


def test_stored_manifest_can_be_read_later(spark):
    """A proof taken from the written blocks of one group leads to its root."""
    path = scratch_path(spark, "m")
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", f"t{i}") for i in range(40)], "doc_id long, lang string, text string")
    proofs = merkle.manifest(docs, path, ["doc_id", "text"], block_levels=2)
    root = proofs.select("root").distinct().collect()
    assert len(root) == 1 and proofs.where(F.col("folded") != F.col("root")).count() == 0
    for x in merkle.prove(spark, f"{path}/groups", 2).where("key = 'b'").collect():
        want = proofs.where(f"doc_id = {x.id}").first()
        assert merkle.fold(x.leaf, x.pos, x.total, x.path)[0] == want.subroot
        assert merkle.fold(merkle.combine(x.leaf), x.pos, x.total, x.path)[0] != want.subroot
