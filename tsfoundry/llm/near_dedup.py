"""Near duplicates by MinHash bands, odd sketches and a check on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsfoundry.llm.common import chunks, id_and_text, load, ranges, words
from tsfoundry.session import configure, cut_lineage

NAME = "op5_minhash_near_dedup"

#: Words of a shingle, and the least similarity in hundredths.
SHINGLE = 5
SIMILAR = 75
#: A pair of similarity 0.75 shares no band of ROWS values with a chance of (1 - 0.75**ROWS)**BANDS, about one in a million.
BANDS, ROWS = 36, 4
#: Bits of an odd sketch. A pair whose estimate is under LEAST_ESTIMATE, five standard errors below the limit, is dropped.
BITS = 512
LEAST_ESTIMATE = 0.53
#: Counters that rank shingles by rarity.
COUNTERS = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLY = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row end to end, and the n+1 offsets.

    64-bit hashes of five words each; a shorter text has one, of all its words.
    """
    codes, distinct, off = words(pc.ascii_lower(text.cast(pa.large_string())))
    h = pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = np.diff(off)
    total = np.zeros(max(len(h) - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        total += h[k : k + len(total)] * _PLACE[k]
    total = mix(total)
    sets = []
    for i in range(len(n)):
        if n[i] >= SHINGLE:
            sets.append(np.unique(total[off[i] : off[i + 1] - SHINGLE + 1]))
        elif n[i]:
            own = h[off[i] : off[i + 1]] * _PLACE[: n[i]]
            sets.append(mix(own.sum(keepdims=True) + _PLACE[7:] * n[i : i + 1].astype(np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def minhashes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of each row that has a value; rows without are left out."""
    start = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(start), BANDS * ROWS), np.uint64)
    for i in range(BANDS * ROWS):
        out[:, i] = np.minimum.reduceat(values * _MULTIPLY[i] + _ADD[i], start)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    key = np.zeros((len(minima), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * _PLACE[5] + minima.reshape(-1, BANDS, ROWS)[:, :, r])
    return key


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """Each minimum flips one of BITS bits, so equal ones of two rows cancel in their difference."""
    out = np.empty((len(minima), BITS // 8), np.uint8)
    for start in range(0, len(minima), 1024):  # a counter for each bit of so many rows at a time
        part = minima[start : start + 1024]
        bit = mix(part + _ADD * _PLACE[6]) >> np.uint64(64 - BITS.bit_length() + 1)
        flips = np.bincount((np.arange(len(part))[:, None] * BITS + bit.astype(np.int64)).ravel(), minlength=len(part) * BITS)
        out[start : start + 1024] = np.packbits((flips & 1).astype(np.uint8).reshape(-1, BITS), axis=1)
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from the odd sketches of pairs: the set bits of the difference tell how many minima differ."""
    differ = np.bitwise_count(a ^ b).sum(axis=-1) / BITS
    odd = -BITS / 2 * np.log(np.maximum(1 - 2 * differ, 1e-9))
    return 1 - odd / (2 * BANDS * ROWS)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def signatures(docs: DataFrame) -> DataFrame:
    """``id, tag, n, print, bands, sketch`` of ``docs(id, tag, text)``; ``print`` tells sets apart and is null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, limit=1 << 20):
            values, off = shingle_sets(b.column(2))
            n = np.diff(off)
            has = np.flatnonzero(n > 0)
            minima = minhashes(values, off)
            bands, sketch, mark = [None] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows
            keys, bits = band_keys(minima), odd_sketches(minima)
            start = off[has]
            sums = [np.add.reduceat(mix(values + c), start) if len(has) else np.zeros(0, np.uint64) for c in _PLACE[:2]]
            for k, i in enumerate(has.tolist()):
                bands[i], sketch[i] = keys[k].tobytes(), bits[k].tobytes()
                mark[i] = sums[0][k].tobytes() + sums[1][k].tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(mark, pa.binary()), pa.array(bands, pa.binary()), pa.array(sketch, pa.binary())], ["id", "tag", "n", "print", "bands", "sketch"])

    return docs.mapInArrow(run, "id long, tag long, n long, print binary, bands binary, sketch binary")


def hubs(reps: DataFrame) -> DataFrame:
    """``key, id, hub``: every set that shares a band with others, and the smallest id among those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], ["key", "id"])

    entries = reps.select("rep", "bands").mapInArrow(run, "key long, id long")
    shared = entries.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return entries.join(shared, "key").select("key", "id", "hub")


def likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose set sizes and odd sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_n, b_n = b.column(2).to_numpy(), b.column(4).to_numpy()
            bits = [np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, BITS // 8) for i in (3, 5)]
            keep = (100 * np.minimum(a_n, b_n) >= SIMILAR * np.maximum(a_n, b_n)) & (estimate(*bits) >= LEAST_ESTIMATE)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    side = lambda c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_n", "a_sketch", "b_n", "b_sketch")
    return both.mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(iter([batch]), "b_text"):
                a_text = b.column(2).dictionary_encode()
                of = a_text.indices.to_numpy()
                a_set, a_off = shingle_sets(a_text.dictionary)
                b_set, b_off = shingle_sets(b.column(3))
                keep = np.zeros(b.num_rows, bool)
                for i in range(b.num_rows):
                    x, y = a_set[a_off[of[i]] : a_off[of[i] + 1]], b_set[b_off[i] : b_off[i + 1]]
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    keep[i] = 100 * both >= SIMILAR * (len(x) + len(y) - both)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"{c}_text"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_text", "b_text")
    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``id, comp`` of all ids in the links ``a, b``: the smallest id that can be reached.

    Each round takes the smallest label among neighbours and then the label of
    that label, so a chain's labels travel twice as far every round.
    """
    edges = cut_lineage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "id"))
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("comp").alias("seen"))
        least = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("comp").alias("old"), F.least("comp", "seen").alias("comp"))
        ahead = labels.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        new = cut_lineage(least.join(ahead, "comp").select("id", "old", F.least("comp", "next").alias("comp")))
        labels = new.select("id", "comp")
        if new.where("comp <> old").isEmpty():
            return labels


def rarity(texts: DataFrame) -> np.ndarray:
    """How many texts hold a shingle of each counter; the table's size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in chunks(batches):
            values, _ = shingle_sets(b.column(1))
            total += np.bincount((values % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    sums = texts.select("id", "text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COUNTERS, np.int64)
    out[sums["slot"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out


def prefix_pairs(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """Pairs of ``texts(id, text, comp)`` of different components that can have the similarity, without loss.

    Shingles are ordered by rarity. Two sets of the similarity share one of
    their first n - ceil(0.75 n) + 1, and at the first they share enough must
    follow it in both. Shingles whose counter is one are shared with nobody.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            values, off = shingle_sets(b.column(1))
            n = np.diff(off)
            row = np.repeat(np.arange(len(n)), n)
            count = counts[(values % np.uint64(COUNTERS)).astype(np.int64)]
            order = np.lexsort((values, count, row))
            place = np.arange(len(values)) - off[row]
            length = n - -(-SIMILAR * n // 100) + 1
            keep = (place < length[row]) & (count[order] > 1)
            of = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([pa.array(values[order][keep].view(np.int64)), b.column(0).take(of), b.column(2).take(of), pa.array(n[row[keep]].astype(np.int32)), pa.array(place[keep].astype(np.int32))], ["token", "id", "comp", "n", "place"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros((0, 5), np.int64)]
        for b in batches:
            new = np.stack([c.to_numpy().astype(np.int64) for c in b.columns], axis=1)
            if not len(new):
                continue
            cut = int(np.searchsorted(new[:, 0], new[-1, 0]))
            if cut or held[-1].size and held[-1][-1, 0] != new[-1, 0]:
                yield from group_pairs(np.concatenate([*held, new[:cut]]))
                held = []
            held.append(new[cut:])
        yield from group_pairs(np.concatenate(held))

    rows = texts.select("id", "text", "comp").mapInArrow(prefixes, "token long, id long, comp long, n int, place int")
    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(join, "a long, b long").distinct()


def group_pairs(rows: np.ndarray, block: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Pairs within the runs of equal tokens of ``rows(token, id, comp, n, place)`` that pass size, component and position."""
    if not len(rows):
        return
    start = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
    end = np.append(start[1:], len(rows))
    partners = np.repeat(end, end - start) - np.arange(len(rows)) - 1
    done, total = 0, np.cumsum(partners)
    while done < len(rows):
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + block, side="right")))
        left = np.repeat(np.arange(done, stop), partners[done:stop])
        right = ranges(np.arange(done, stop) + 1, partners[done:stop])
        x, y = rows[left], rows[right]
        need = -(-SIMILAR * (x[:, 3] + y[:, 3]) // (100 + SIMILAR))
        follow = np.minimum(x[:, 3] - x[:, 4], y[:, 3] - y[:, 4])  # this one and all behind it
        keep = (x[:, 2] != y[:, 2]) & (100 * np.minimum(x[:, 3], y[:, 3]) >= SIMILAR * np.maximum(x[:, 3], y[:, 3])) & (follow >= need)
        pair = np.unique(np.sort(np.stack([x[keep, 1], y[keep, 1]], axis=1), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])
        done = stop


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by the similarity of their word shingles.

    Equal sets are one class from the start. Classes that share a band are
    compared with the smallest of them: odd sketches drop what cannot be
    similar, the full sets decide. Where a band still holds several components,
    its classes go through an exact prefix join, so no link hides behind a hub.

    Returns ``id_col, n_shingles, component_id, kept`` per row. Null and empty
    texts have no shingles and are a component of their own. Rows of one id are
    one document: where their texts differ, the text of the smallest hash links
    it, and all its rows get its component and are kept or not together. A row
    with a null id is kept, has no component and links nothing. Other columns
    are ignored; an empty table gives no rows.
    """
    texts = id_and_text(docs, id_col, text_col).select("id", F.xxhash64("text").alias("tag"), "text")
    sig = cut_lineage(signatures(texts))
    chosen = sig.where("id IS NOT NULL").groupBy("id").agg(F.min("tag").alias("least"), F.max("tag").alias("most")).where("least <> most").select("id", "least")
    linking = sig.where("print IS NOT NULL AND id IS NOT NULL").join(chosen, "id", "left").where("least IS NULL OR tag = least")
    reps = cut_lineage(linking.groupBy("print").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    members = cut_lineage(hubs(reps))
    held = members.select("id").distinct()
    own = cut_lineage(texts.join(held, "id", "left_semi").groupBy("id").agg(F.min_by("text", "tag").alias("text")))
    stars = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = cut_lineage(confirm(likely(stars, reps), own))
    first = components(links)

    placed = members.select("key", "id").join(first, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    undecided = placed.join(open_keys, "key", "left_semi").select("id", "comp").distinct()
    rest = cut_lineage(own.join(undecided, "id"))
    more = confirm(likely(prefix_pairs(rest, rarity(rest)), reps), own)
    joined = components(cut_lineage(links.union(more)))

    # From classes to documents: a class is known by its smallest document.
    of_class = reps.select("print", "rep").join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("print", F.coalesce("comp", "rep").alias("comp"))
    of_id = linking.select("id", "print").distinct().join(of_class, "print").select("id", "comp")
    out = sig.select("id", "n").join(of_id, "id", "left")
    comp = F.coalesce("comp", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), (F.col("id").isNull() | (F.col("id") == comp)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stand for their components, one row for each id; rows without an id stay."""
    kept = near_dedup(docs, id_col, text_col).where(F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id")).distinct()
    rows = docs.join(kept, docs[id_col].cast("long") == kept["__id"], "left_semi")
    one = Window.partitionBy(id_col).orderBy(F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    rows = rows.withColumn("__place", F.row_number().over(one)).where("__place = 1").drop("__place")
    return rows.unionByName(docs.where(F.col(id_col).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(load(configure(spark), sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id
), m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept
FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""
