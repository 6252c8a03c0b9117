"""Removal of long repeated byte strings with sharded suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsfoundry.llm.common import give_back, load, partitions, ranges, text_buffer
from tsfoundry.llm.suffixes import permuted_common, suffix_array
from tsfoundry.session import configure

NAME = "op3_suffix_array_dedup"

#: Bytes of a string that counts as repeated.
LENGTH = 100
#: A string's anchor is its GRAM bytes with the smallest hash.
GRAM = 24
#: Window starts that one array operation looks at; their numbers take the low bits of a key.
BLOCK = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
#: An anchor with more fragments is dealt string by string.
HOT_FRAGMENTS = 20_000
#: Bytes of fragments that share one suffix array.
ARRAY_BYTES = 3 << 20
#: Bytes of text of a group of documents, and bytes of text that send their fragments to one shard.
GROUP_BYTES, SHARD_BYTES = 5 << 20, 16 << 20
#: Rows of one id are told apart by this distance between their starts.
ROW_STRIDE = 1 << 36
NO_ID = (1 << 63) - 1

_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, 256, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _spread(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * _ODD[11]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on."""
    h1 = _BYTE[raw]
    h2 = h1[:-1] * _ODD[0] + h1[1:]
    h4 = h2[:-2] * _ODD[1] + h2[2:]
    h8 = h4[:-4] * _ODD[2] + h4[4:]
    h16 = h8[:-8] * _ODD[3] + h8[8:]
    return _spread(h16[:-8] * _ODD[4] + h8[16:])


def anchors(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: first start, number of starts, and the anchor's hash.

    All strings of LENGTH bytes within the rows belong to one run each, and
    equal strings to runs of equal hashes, since the anchor depends on the
    string alone. A run has at most LENGTH - GRAM + 1 starts.
    """
    starts, sizes, hashes = [], [], []
    usable = np.zeros(len(raw) + 1, bool)
    first = off[:-1][np.diff(off) >= LENGTH]
    usable[ranges(first, np.diff(off)[np.diff(off) >= LENGTH] - LENGTH + 1)] = True
    width = LENGTH - GRAM + 1
    for begin in range(0, max(len(raw) - LENGTH + 1, 0), BLOCK):
        ok = usable[begin : min(begin + BLOCK, len(raw) - LENGTH + 1)]
        if not ok.any():
            continue
        h = gram_hashes(raw[begin : begin + len(ok) + LENGTH - 1])
        least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[: len(ok)], least[width - size : width - size + len(ok)])
        at = (least & _LOW).astype(np.int64)
        new = np.flatnonzero(ok & np.concatenate(([True], (at[1:] != at[:-1]) | ~ok[:-1])))
        total = np.cumsum(ok)
        nxt = np.append(new[1:], len(ok))
        starts.append(new + begin)
        sizes.append(total[nxt - 1] - total[new] + 1)
        hashes.append(h[at[new]])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(sizes), np.concatenate(hashes)


def string_hashes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of the LENGTH bytes from each start on."""
    h = gram_hashes(raw)
    out = np.zeros(len(starts), np.uint64)
    for k, step in enumerate((0, GRAM, 2 * GRAM, 3 * GRAM, LENGTH - GRAM)):
        out += h[starts + step] * _ODD[5 + k]
    return _spread(out)


def ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Ids, numbers of the row within its id, texts and places of a group of documents, always in the same order."""
    table = table.combine_chunks()
    by_id = pc.sort_indices(table, sort_keys=[("id", "ascending")])
    ids = pc.fill_null(table["id"], NO_ID).to_numpy()[by_id.to_numpy()]
    if len(np.unique(ids)) < len(ids):
        by_id = pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")])
        ids = pc.fill_null(table["id"], NO_ID).to_numpy()[by_id.to_numpy()]
    number = np.arange(len(ids)) - np.searchsorted(ids, ids)
    text = table["text"].combine_chunks() if isinstance(table["text"], pa.ChunkedArray) else table["text"]
    return ids, number, text.take(by_id), by_id


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _read(col, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in col.to_pylist() if x), kind)


def distinct_strings(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each different slice, and the slices."""
    data = raw[ranges(start, length)]
    offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int64)
    slices = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = slices.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def earliest(code: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The index of the first (doc, start) of each code, in the order of the codes."""
    order = np.lexsort((start, doc, code))
    return order[np.concatenate(([True], code[order][1:] != code[order][:-1]))] if len(order) else order


def first_strings(raw: np.ndarray, off: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Window starts in ``raw`` that hold the first occurrence of their string.

    Fragments lie end to end at ``off``; fragment k has ``size[k]`` windows and
    stands in the corpus at (doc, start). A suffix array of the fragments puts
    equal strings together; the first position of each run of common prefixes
    of LENGTH bytes is the one that stays.
    """
    text = raw.astype(np.int16) + 1
    text[off[1:] - 1] = 0  # the byte after each fragment
    order = suffix_array(text, 257, LENGTH)
    window = np.zeros(len(raw), bool)
    window[ranges(off[:-1], size)] = True
    order = order[window[order]]
    group = np.cumsum(~permuted_common(raw, order, LENGTH))
    fragment = np.searchsorted(off, order, side="right") - 1
    return order[earliest(group, doc[fragment], start[fragment] + order - off[fragment])]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False, rest: tuple[str, ...] = ()) -> DataFrame:
    """Bytes of each text that a string of LENGTH bytes covers which also starts earlier in the corpus.

    1. Every string of LENGTH bytes belongs to the anchor its content selects;
       each group of documents sends its different anchors once. 2. Anchors that
       occur once have no repeated strings. 3. For the others the documents send
       the fragments around them, copies within a group of documents once, to
       the shard of the anchor; an anchor with very many fragments is dealt by
       the hash of each string. 4. A shard sorts its fragments' suffixes by
       induction and tells which position of each repeated string is the first.
       5. The documents drop all candidates but those. The text is shuffled
       once; no other exchange holds more than a share of it, and no group holds
       more than one entry of an anchor for each group of documents.

    Returns ``id_col, n_bytes, spans array<struct<start, stop>>, kept binary``:
    maximal removed runs and the bytes that stay; ``as_text`` reads those as
    UTF-8 and drops parts of a cut character. The columns ``rest`` return in a
    struct of that name. Earlier means a smaller id, or
    the same document and an earlier start; rows of one id follow each other in
    the order of their texts, null ids come last. Null, empty and short texts
    lose nothing. Other columns are ignored; an empty table gives no rows.
    """
    # Groups of documents and shards hold a bounded number of bytes however large the table is; a group sends at most one row to a shard.
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    shards = partitions(docs, size, SHARD_BYTES)
    parts = partitions(docs, size, GROUP_BYTES)
    parts = max(parts, 4 * partitions(docs))
    own = [F.struct(*rest).alias("rest")] if rest else []
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *own)
    texts = texts.select(F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.xxhash64("text"))), F.lit(parts)).cast("int").alias("part"), "id", "text", *(["rest"] if rest else []))

    def send_anchors(table: pa.Table) -> pa.Table:
        give_back()
        part = table["part"][0].as_py()
        _, _, text, _ = ordered(table)
        _, _, h = anchors(*text_buffer(text))
        h, n = np.unique(h, return_counts=True)
        bucket = (h % np.uint64(shards)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(shards + 1))
        rows = [(k, part, _blob(h[order[a:b]]), _blob(n[order[a:b]].astype(np.uint32))) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if b > a]
        return pa.table(dict(zip(("bucket", "part", "hashes", "counts"), zip(*rows)))).cast(_ANCHORS) if rows else _ANCHORS.empty_table()

    def find_repeated(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        number = [np.frombuffer(x, np.uint32) for x in table["counts"].to_pylist()]
        h, at = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(at, np.concatenate(number)).astype(np.int64)[at]
        rows, begin = [], 0
        for part, x in zip(table["part"].to_pylist(), own):
            n = total[begin : begin + len(x)]
            begin += len(x)
            if (n > 1).any():
                rows.append((part, _blob(x[n > 1]), _blob(x[n > HOT_FRAGMENTS])))
        return pa.table(dict(zip(("part", "repeated", "hot"), zip(*rows)))).cast(_REPEATED) if rows else _REPEATED.empty_table()

    def send_fragments(table: pa.Table, replies: pa.Table) -> pa.Table:
        give_back()
        if not table.num_rows or not replies.num_rows:
            return _FRAGMENTS.empty_table()
        part = table["part"][0].as_py()
        ids, number, text, _ = ordered(table)
        raw, off = text_buffer(text)
        start, size, h = anchors(raw, off)
        repeated, hot = np.sort(_read(replies["repeated"], np.uint64)), np.sort(_read(replies["hot"], np.uint64))
        keep = _isin(h, repeated)
        start, size, h = start[keep], size[keep], h[keep]
        flagged = (start, size)
        if len(hot):
            is_hot = _isin(h, hot)
            single = ranges(start[is_hot], size[is_hot])
            start, size = np.concatenate((start[~is_hot], single)), np.concatenate((size[~is_hot], np.ones(len(single), np.int64)))
            h = np.concatenate((h[~is_hot], string_hashes(raw, single)))
        row = np.searchsorted(off, start, side="right") - 1
        doc, place = ids[row], start - off[row] + number[row] * ROW_STRIDE
        code, content = distinct_strings(raw, start, size + LENGTH - 1)
        one = earliest(code, doc, place)  # of copies within this group of documents the first
        shard = (h[one] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        edge = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = []
        for k, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
            if b > a:
                own = one[order[a:b]]
                data, _ = text_buffer(content.take(pa.array(code[own])))
                rows.append((k, part, _blob(h[own]), _blob(doc[own]), _blob(place[own]), _blob(size[own].astype(np.int16)), _blob(data), b""))
        rows.append((part % shards, part, b"", b"", b"", b"", b"", _blob(np.stack(flagged))))  # what this group must look at again
        return pa.table(dict(zip(_FRAGMENTS.names, zip(*rows)))).cast(_FRAGMENTS)

    def sort_shard(table: pa.Table) -> pa.Table:
        give_back()
        source, hs, docs_, places, sizes, datas, rows = [], [], [], [], [], [], []
        for part, h, doc, place, size, data, flagged in zip(*(table[c].to_pylist() for c in _FRAGMENTS.names[1:])):
            if flagged:
                rows.append((part, flagged, b"", b""))
            if h:
                hs.append(np.frombuffer(h, np.uint64))
                source.append(np.full(len(hs[-1]), part))
                docs_.append(np.frombuffer(doc, np.int64))
                places.append(np.frombuffer(place, np.int64))
                sizes.append(np.frombuffer(size, np.int16).astype(np.int64))
                datas.append(np.frombuffer(data, np.uint8))
        if hs:
            source, h, doc, place, size = (np.concatenate(x) for x in (source, hs, docs_, places, sizes))
            raw = np.concatenate(datas)
            length = size + LENGTH - 1
            begin = np.cumsum(length) - length
            code, _ = distinct_strings(raw, begin, length)
            one = earliest(code, doc, place)
            one = one[np.argsort(h[one], kind="stable")]
            alone = np.ones(len(one), bool)
            alone[1:] &= h[one][1:] != h[one][:-1]
            alone[:-1] &= h[one][1:] != h[one][:-1]
            # A fragment whose anchor has no other has only first strings.
            kept = [(one[alone], np.zeros(alone.sum(), np.int64), size[one[alone]])]
            rest = one[~alone]
            edge = np.flatnonzero(np.concatenate(([True], h[rest][1:] != h[rest][:-1]))) if len(rest) else np.zeros(0, np.int64)
            ends = np.cumsum(length[rest] + 1)
            a = 0
            while a < len(rest):  # whole anchors, about ARRAY_BYTES at a time
                b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + ARRAY_BYTES, side="right"))
                after = edge[np.searchsorted(edge, max(b, a + 1))] if len(edge) and edge[-1] >= max(b, a + 1) else len(rest)
                own = rest[a:after]
                off = np.concatenate(([0], np.cumsum(length[own] + 1)))
                fill = np.zeros(off[-1], np.uint8)
                fill[ranges(off[:-1], length[own])] = raw[ranges(begin[own], length[own])]
                first = np.sort(first_strings(fill, off, doc[own], place[own], size[own]))
                new = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1] + 1))) if len(first) else np.zeros(0, np.int64)
                fragment = np.searchsorted(off, first[new], side="right") - 1
                kept.append((own[fragment], first[new] - off[fragment], np.diff(np.append(new, len(first)))))
                a = after
            which, step, n = (np.concatenate(x) for x in zip(*kept))
            for part in np.unique(source[which]).tolist():
                own = source[which] == part
                i = which[own]
                rows.append((part, b"", _blob(doc[i]), _blob(np.stack((place[i] + step[own], n[own])))))
        return pa.table(dict(zip(_FIRSTS.names, zip(*rows)))).cast(_FIRSTS) if rows else _FIRSTS.empty_table()

    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        give_back()
        if not table.num_rows:
            return _KEPT.empty_table()
        ids, number, text, by_id = ordered(table)
        raw, off = text_buffer(text)
        n = len(ids)
        again = np.zeros(len(raw) + 1, np.int32)
        for x in found["flagged"].to_pylist() if found.num_rows else []:
            if x:
                start, size = np.frombuffer(x, np.int64).reshape(2, -1)
                again[start] += 1
                again[start + size] -= 1
        again = np.cumsum(again[:-1], dtype=np.int32) > 0
        for doc, run in zip(found["doc"].to_pylist(), found["run"].to_pylist()) if found.num_rows else []:
            if doc:
                doc = np.frombuffer(doc, np.int64)
                place, size = np.frombuffer(run, np.int64).reshape(2, -1)
                row = np.searchsorted(ids, doc) + place // ROW_STRIDE
                again[ranges(off[row] + place % ROW_STRIDE, size)] = False
        cover = np.zeros(len(raw) + 1, np.int32)
        at = np.flatnonzero(again)
        cover[at] += 1
        cover[at + LENGTH] -= 1
        gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
        row = np.repeat(np.arange(n, dtype=np.int32), np.diff(off))
        edge = np.concatenate(([True], row[1:] != row[:-1])) if len(raw) else np.zeros(0, bool)
        begins = np.flatnonzero(gone & (edge | ~np.concatenate(([False], gone[:-1])))) if len(raw) else np.zeros(0, np.int64)
        stops = np.flatnonzero(gone & (np.append(edge[1:], True) | ~np.append(gone[1:], False))) + 1 if len(raw) else np.zeros(0, np.int64)
        of = row[begins] if len(begins) else np.zeros(0, np.int64)
        spans = pa.StructArray.from_arrays([pa.array(begins - off[of]), pa.array(stops - off[of])], ["start", "stop"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), spans)
        left = np.concatenate(([0], np.cumsum(~gone)))[off]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[~gone]))])
        stays = pa.array([x.decode("utf-8", "ignore") for x in kept.to_pylist()], pa.string()) if as_text else kept.cast(pa.binary())
        out = {"id": pa.array(ids, mask=ids == NO_ID), "n_bytes": pa.array(np.diff(off)), "spans": lists, "kept": stays}
        return pa.table(out | ({"rest": table["rest"].take(by_id)} if rest else {}))

    schema = "id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept " + ("string" if as_text else "binary")
    schema += f", rest {texts.schema['rest'].dataType.simpleString()}" if rest else ""
    sent = texts.groupBy("part").applyInArrow(send_anchors, "bucket int, part int, hashes binary, counts binary")
    replies = sent.groupBy("bucket").applyInArrow(find_repeated, "part int, repeated binary, hot binary")
    fragments = texts.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(send_fragments, "shard int, part int, h binary, doc binary, place binary, size binary, data binary, flagged binary")
    firsts = fragments.groupBy("shard").applyInArrow(sort_shard, "part int, flagged binary, doc binary, run binary")
    out = texts.groupBy("part").cogroup(firsts.groupBy("part")).applyInArrow(cut, schema)
    return out.withColumnRenamed("id", id_col)


def _isin(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


_ANCHORS = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_REPEATED = pa.schema([("part", pa.int32()), ("repeated", pa.binary()), ("hot", pa.binary())])
_FRAGMENTS = pa.schema([("shard", pa.int32()), ("part", pa.int32()), *[(c, pa.binary()) for c in ("h", "doc", "place", "size", "data", "flagged")]])
_FIRSTS = pa.schema([("part", pa.int32()), ("flagged", pa.binary()), ("doc", pa.binary()), ("run", pa.binary())])
_KEPT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(load(configure(spark), sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = None


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, repeated strings cut out of their texts."""
    rest = tuple(c for c in docs.columns if c not in (id_col, text_col))
    cut = repeated_spans(docs, id_col, text_col, as_text=True, rest=rest)
    return cut.select(*[F.col(id_col) if c == id_col else F.col("kept").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns])
