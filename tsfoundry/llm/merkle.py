"""Merkle manifest of a dataset, its trees stored in van Emde Boas order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsfoundry.llm.common import load
from tsfoundry.session import configure, cut_lineage, scratch_path

NAME = "op13_merkle_manifest"

#: Levels of edges in a stored subtree: it has up to 1,024 leaves and takes 64 KB.
BLOCK_LEVELS = 10
_HASH = 32


# --- Addresses ------------------------------------------------------------------------------------
def address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Places of nodes in the layout of a full binary tree with ``levels`` levels of nodes.

    The tree is cut at half its height; the upper part is stored first, then
    the lower ones from left to right, each of them in the same way. ``depth``
    counts from the root, ``index`` from the left end of that depth.
    """
    at = np.zeros(len(index), np.int64)
    index = np.asarray(index, np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        lower = levels - upper
        depth -= upper
        subtree = index >> depth
        at += (1 << upper) - 1 + subtree * ((1 << lower) - 1)
        index = index & ((1 << depth) - 1)
        levels = lower
    return at


@lru_cache(maxsize=16)
def addresses(levels: int) -> list[np.ndarray]:
    """The places of all nodes, by level from the leaves up."""
    return [address(d, np.arange(1 << d), levels) for d in range(levels - 1, -1, -1)]


# --- Hashes ---------------------------------------------------------------------------------------
def combine(*parts: bytes) -> bytes:
    """Digest of digests, which enter as lower-case hex."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def height(n: int) -> int:
    """Levels of edges over ``n`` leaves."""
    return max(int(n) - 1, 0).bit_length()


def subtree(leaves: list[bytes], levels: int) -> tuple[bytes, bytes]:
    """All nodes of a tree of ``levels`` levels of edges over the leaves, in layout order, and its root.

    Places without a node are zero: those right of the last leaf's ancestors.
    """
    where = addresses(levels + 1)
    out = np.zeros((len(where[0]) * 2 - 1, _HASH), np.uint8)
    row = leaves
    for k in range(levels + 1):
        out[where[k][: len(row)]] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, _HASH)
        if k < levels:
            row = [combine(*row[i : i + 2]) for i in range(0, len(row), 2)]
    return out.tobytes(), row[0]


def siblings(nodes: bytes, n: int, levels: int) -> list[list[bytes]]:
    """For each of the ``n`` leaves of a stored subtree its siblings from the leaf up, b"" where it has none."""
    where, table = addresses(levels + 1), np.frombuffer(nodes, np.uint8).reshape(-1, _HASH)
    columns, index, count = [], np.arange(n), n
    for k in range(levels):
        other = (index >> k) ^ 1
        there = other < count
        found = table[where[k][np.where(there, other, 0)]].tobytes()
        columns.append([found[i * _HASH : i * _HASH + _HASH] if t else b"" for i, t in enumerate(there.tolist())])
        count = (count + 1) // 2
    return [list(x) for x in zip(*columns)] if columns else [[] for _ in range(n)]


def fold(leaf: bytes, pos: int, total: int, path: bytes, at: int = 0) -> tuple[bytes, int]:
    """Root that a leaf and its siblings give, and how far into ``path`` they reached.

    ``path`` holds the siblings end to end; where a node has none follows from
    its position and the number of leaves.
    """
    while total > 1:
        if pos ^ 1 < total:
            other = path[at : at + _HASH]
            at += _HASH
            leaf = combine(other, leaf) if pos & 1 else combine(leaf, other)
        else:
            leaf = combine(leaf)
        pos, total = pos >> 1, (total + 1) >> 1
    return leaf, at


# --- Construction ---------------------------------------------------------------------------------
def positions(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``pos``, counted from 0 in each key by ascending ``order``, and ``total``, the key's rows.

    Sampled splitters deal rows into ranges of (key, order), so one key spreads
    over many tasks; a range numbers its own rows, and the counts of the ranges
    before it are added. A null key is a key; rows equal in everything are
    split by where they were read.
    """
    names = rows.columns
    ordered = rows.withColumn("__at", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(key, *order, "__at").sortWithinPartitions(key, *order, "__at").drop("__at")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).dictionary_encode(null_encoding="encode")
            code = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate(([0], np.flatnonzero(code[1:] != code[:-1]) + 1))
            run = np.searchsorted(starts, np.arange(len(code)), side="right") - 1
            local = np.arange(len(code)) - starts[run]
            value = keys.dictionary[int(code[0])].as_py()
            if last is not None and last[0] == value:
                local[run == 0] += n
            last, n = (keys.dictionary[int(code[-1])].as_py(),), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local)], [*b.schema.names, "__local"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.select(key, *[c for c in names if c != key]).schema)
    local = cut_lineage(ordered.select(key, *[c for c in names if c != key]).mapInArrow(number, f"{schema}, __local long").withColumn("__part", F.spark_partition_id()))
    own = local.groupBy("__part", key).agg(F.count(F.lit(1)).alias("__n"))  # at most the ranges and the keys together
    total = own.groupBy(key).agg(F.sum("__n").alias("total"), F.sort_array(F.collect_list(F.struct("__part", "__n"))).alias("__runs"))
    before = F.expr("aggregate(slice(__runs, 1, i), 0L, (a, x) -> a + x.__n)")
    starts = total.select(key, "total", "__runs", F.posexplode("__runs").alias("i", "r")).select(F.col(key).alias("__key"), F.col("r.__part").alias("__of"), before.alias("__before"), "total")
    joined = local.join(starts, local[key].eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__of")))
    return joined.select(*names, (F.col("__local") + F.col("__before")).alias("pos"), "total")


def build(leaves: DataFrame, path: str, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Writes the trees over ``leaves(key, pos, total, digest, id, claim)`` below ``path``; returns ``key, root, total``.

    The leaves of a key are dealt into aligned blocks; each block's subtree is
    one row, its nodes in van Emde Boas order. The blocks' roots are the leaves
    of the next level, until one block holds all. ``id`` and ``claim`` (a digest
    to be checked against the root later) go along in the rows of the first level.
    """
    spark = leaves.sparkSession
    size = 1 << block_levels

    def block(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("pos")
        pos, total = t["pos"][0].as_py(), t["total"][0].as_py()
        levels = block_levels if total > size else height(total)
        nodes, root = subtree(t["digest"].to_pylist(), levels)
        claims = t["claim"].to_pylist()
        row = {"key": [t["key"][0].as_py()], "block": [pos >> block_levels], "n": [t.num_rows], "levels": [levels], "total": [total], "ids": [t["id"].to_pylist()], "claims": [b"".join(claims) if claims[0] is not None else None], "nodes": [nodes], "root": [root]}
        return pa.table(row, schema=layout)

    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema}
    layout = pa.schema([("key", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("levels", pa.int32()), ("total", pa.int64()), ("ids", pa.list_(pa.int64() if kinds["id"] == "bigint" else pa.string())), ("claims", pa.binary()), ("nodes", pa.binary()), ("root", pa.binary())])
    schema = f"key string, block long, n int, levels int, total long, ids array<{kinds['id']}>, claims binary, nodes binary, root binary"
    level, done = 0, []
    while True:
        out = f"{path}/level={level}"
        leaves.withColumn("block", F.shiftright("pos", block_levels)).groupBy("key", "block").applyInArrow(block, schema).write.parquet(out)
        blocks = spark.read.schema(schema).parquet(out)
        done.append(blocks.where(F.col("total") <= size).select("key", "root"))
        above = blocks.where(F.col("total") > size)
        if not above.limit(1).count():
            break
        leaves = above.select("key", F.col("block").alias("pos"), F.shiftright(F.col("total") + (size - 1), block_levels).alias("total"), F.col("root").alias("digest"), F.lit(None).cast(kinds["id"]).alias("id"), F.lit(None).cast("binary").alias("claim"))
        level += 1
    roots = done[0]
    for more in done[1:]:
        roots = roots.unionAll(more)
    return roots


def prove(spark: SparkSession, path: str, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """``key, id, pos, total, leaf, claim, path`` for every leaf of a built manifest: its siblings from the leaf up, end to end.

    Blocks are read from the top level down. Each is met by what its own root
    needs above, one row, and gives that of its leaves: siblings are found by
    address arithmetic in the stored nodes.
    """
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    level = len(fs.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs)) - 1
    above = None
    while level >= 0:
        blocks = spark.read.parquet(f"{path}/level={level}")
        if above is None:
            met = blocks.withColumn("upper", F.lit(b""))
        else:
            b, a = blocks.alias("b"), above.select("key", "pos", F.col("path").alias("upper")).alias("a")
            met = b.join(a, F.col("b.key").eqNullSafe(F.col("a.key")) & (F.col("b.block") == F.col("a.pos")), "left").select("b.*", F.coalesce("upper", F.lit(b"")).alias("upper"))
        above = _paths(met, block_levels)
        level -= 1
    return above


def _paths(blocks: DataFrame, block_levels: int) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n, levels = r["n"], r["levels"]
                where = addresses(levels + 1)[0][:n]
                table = np.frombuffer(r["nodes"], np.uint8).reshape(-1, _HASH)
                leaf = table[where].tobytes()
                cut = lambda x: [x[i : i + _HASH] for i in range(0, n * _HASH, _HASH)] if x else [None] * n
                paths = [b"".join(s) + r["upper"] for s in siblings(r["nodes"], n, levels)]
                pos = np.arange(n, dtype=np.int64) + (r["block"] << block_levels)
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["key"]] * n, pa.string()), pa.array(r["ids"], id_type), pa.array(pos), pa.array([r["total"]] * n, pa.int64()),
                    pa.array(cut(leaf), pa.binary()), pa.array(cut(r["claims"]), pa.binary()), pa.array(paths, pa.binary()),
                ], ["key", "id", "pos", "total", "leaf", "claim", "path"])

    kind = kinds["ids"].removeprefix("array<").removesuffix(">")
    id_type = pa.int64() if kind == "bigint" else pa.string()
    return blocks.select("key", "block", "n", "levels", "total", "ids", "claims", "nodes", "upper").mapInArrow(run, f"key string, id {kind}, pos long, total long, leaf binary, claim binary, path binary")


# --- The dataset's manifest -----------------------------------------------------------------------
def framed(c) -> F.Column:
    """``-`` for null, else the value's UTF-8 length, a colon and the value."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns) -> F.Column:
    """Digest of a row's columns."""
    return F.unhex(F.sha2(F.concat(*map(framed, columns)).cast("binary"), 256))


def manifest(docs: DataFrame, path: str, fields: list[str], tampered: dict[str, F.Column] | None = None, id_col: str = "doc_id", group_col: str = "lang", block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Builds the tree of each group and the tree over the groups below ``path``; returns every row's proof.

    A row is a leaf: the digest of ``fields``. In a group leaves ascend by id,
    nulls first, then by digest; groups ascend bytewise, null first. ``tampered``
    replaces fields in what is checked against the root, not in what is built.
    Returns ``id_col, leaf, subroot, root, path, claim, folded, pos, total, group_pos, group_total``,
    digests binary; ``path`` has the siblings from leaf to root. Repeated rows
    are leaves of their own; nulls in any field have a digest; an empty table
    gives no rows; other columns are ignored.
    """
    row = docs.select(
        F.col(group_col).cast("string").alias("key"), F.col(id_col).cast("long").alias("id"),
        leaf(*[F.col(c) for c in fields]).alias("digest"), leaf(*[(tampered or {}).get(c, F.col(c)) for c in fields]).alias("claim"),
    )
    groups = build(positions(row, "key", ["id", "digest"]), f"{path}/groups", block_levels)
    tops = groups.select(F.lit("").alias("key"), F.col("key").alias("id"), F.col("root").alias("digest"), F.lit(None).cast("binary").alias("claim"))
    top = build(positions(tops, "key", ["id"]), f"{path}/top", block_levels)
    spark = docs.sparkSession
    above = prove(spark, f"{path}/top", block_levels).select(F.col("id").alias("of"), F.col("pos").alias("group_pos"), F.col("total").alias("group_total"), F.col("leaf").alias("subroot"), F.col("path").alias("rest"))
    above = above.crossJoin(F.broadcast(top.select("root")))  # one row
    proofs = prove(spark, f"{path}/groups", block_levels)
    rows = proofs.join(above, F.col("key").eqNullSafe(F.col("of")))
    names = ["id", "leaf", "claim", "pos", "total", "group_pos", "group_total", "subroot", "root"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {name: b.column(i).to_pylist() for i, name in enumerate(b.schema.names)}
            paths, folded = [], []
            for claim, pos, total, own, g, gs, rest in zip(c["claim"], c["pos"], c["total"], c["path"], c["group_pos"], c["group_total"], c["rest"]):
                low, _ = fold(claim, pos, total, own)
                folded.append(fold(low, g, gs, rest)[0])
                paths.append(own + rest)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(paths, pa.binary()), pa.array(folded, pa.binary())], [*names, "path", "folded"])

    out = rows.select(*names, "path", "rest").mapInArrow(check, "id long, leaf binary, claim binary, pos long, total long, group_pos long, group_total long, subroot binary, root binary, path binary, folded binary")
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(configure(spark), sf_dir, "documents")
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    proofs = manifest(docs, scratch_path(spark, "manifest"), ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": F.when(struck, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    text = lambda c: F.lower(F.hex(c))
    return proofs.select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        F.sha2(text("path").cast("binary"), 256).alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


_FRAME = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
_ROW = " || ".join(_FRAME.format(c) for c in ("doc_id", "source", "lang"))
ORACLE = rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS (SELECT *, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 7 = 0 AS struck FROM documents, crc),
h AS (
  SELECT doc_id, lang, sha256({_ROW} || {_FRAME.format("n_chars")} || {_FRAME.format("text")}) AS leaf,
         sha256({_ROW} || {_FRAME.format("(n_chars + CASE WHEN struck THEN 1 ELSE 0 END)")} || {_FRAME.format("text")}) AS claim FROM d),
p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM h),
tree(g, level, pos, total, node) AS (
  SELECT g, 0, pos, total, leaf FROM p
  UNION ALL
  SELECT g, level + 1, pos // 2, (total + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE total > 1 GROUP BY g, level, pos // 2, total),
sub AS (SELECT g, node, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS total FROM tree WHERE total = 1),
top(level, pos, total, node) AS (
  SELECT 0, pos, total, node FROM sub
  UNION ALL
  SELECT level + 1, pos // 2, (total + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE total > 1 GROUP BY level, pos // 2, total),
nodes AS (SELECT g, level, pos, total, node FROM tree WHERE total > 1 UNION ALL SELECT -1, level, pos, total, node FROM top WHERE total > 1),
path AS (
  SELECT p.g, p.pos, 0 AS part, n.level, n.node FROM p JOIN nodes n ON n.g = p.g AND n.pos = xor(p.pos >> n.level, 1)
  UNION ALL
  SELECT p.g, p.pos, 1, n.level, n.node FROM p JOIN nodes n ON n.g = -1 AND n.pos = xor(p.g >> n.level, 1)),
proof AS (SELECT g, pos, string_agg(node, '' ORDER BY part, level) AS siblings FROM path GROUP BY g, pos),
low(g, pos, level, here, total, node) AS (
  SELECT g, pos, 0, pos, total, claim FROM p
  UNION ALL
  SELECT f.g, f.pos, f.level + 1, f.here // 2, (f.total + 1) // 2,
         sha256(CASE WHEN n.node IS NULL THEN f.node WHEN f.here % 2 = 1 THEN n.node || f.node ELSE f.node || n.node END)
  FROM low f LEFT JOIN nodes n ON n.g = f.g AND n.level = f.level AND n.pos = xor(f.here, 1) WHERE f.total > 1),
high(g, pos, level, here, total, node) AS (
  SELECT l.g, l.pos, 0, l.g, (SELECT count(*) FROM sub), l.node FROM low l WHERE l.total = 1
  UNION ALL
  SELECT f.g, f.pos, f.level + 1, f.here // 2, (f.total + 1) // 2,
         sha256(CASE WHEN n.node IS NULL THEN f.node WHEN f.here % 2 = 1 THEN n.node || f.node ELSE f.node || n.node END)
  FROM high f LEFT JOIN nodes n ON n.g = -1 AND n.level = f.level AND n.pos = xor(f.here, 1) WHERE f.total > 1)
SELECT p.doc_id, p.leaf, s.node AS subroot, r.node AS root, sha256(coalesce(q.siblings, '')) AS proof_sha256, f.node AS folded_root, f.node = r.node AS verified
FROM p JOIN sub s ON s.g = p.g CROSS JOIN (SELECT node FROM top WHERE total = 1) r LEFT JOIN proof q ON q.g = p.g AND q.pos = p.pos JOIN high f ON f.g = p.g AND f.pos = p.pos AND f.total = 1
"""
