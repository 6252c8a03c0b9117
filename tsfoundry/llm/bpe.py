"""Byte-level BPE encoding and decoding with a pair occurrence index."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsfoundry.llm.common import chunks, id_and_text, load, ranges, text_buffer
from tsfoundry.session import configure

NAME = "op2_bpe_codec"
ORACLE = None

_MARK = "\ue000"
#: Bytes of text whose distinct pieces share one pair index.
INDEX_BYTES = 6 << 20

# White space as the tokenizer's pattern means it, and the pattern. Fixed values.
_SPACE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_SPACE_RE2 = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class Vocabulary:
    """What a byte-level BPE file of the tokenizers library says: ids, merges and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        # Printable Latin-1 stands for itself, the other bytes for the code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        byte = {c: b for b, c in char.items()}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in self.specials else bytes(byte[c] for c in token)
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.array([vocab[char[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left * self.size + right
        self.order = np.argsort(key)
        self.keys = key[self.order]
        self.special_re = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it isn't merged."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_words(words: pa.Array, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words end to end, and the n+1 offsets of the words.

    An index maps each pair that occurs to all its positions. Ranks come off a
    heap in ascending order, so each active pair is merged once, at all its
    positions together; the pairs that a merge makes have higher ranks and are
    appended to the lists of those.
    """
    raw, bounds = text_buffer(words)
    n, ends, lengths = len(raw), bounds[1:], np.diff(bounds)
    sym = voc.byte_id[raw]
    nxt = np.arange(1, n + 1, dtype=np.int64)
    nxt[ends[lengths > 0] - 1] = -1
    prv = np.arange(-1, n - 1, dtype=np.int64)
    prv[(ends - lengths)[lengths > 0]] = -1
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(pos: np.ndarray) -> None:
        rank = voc.ranks(sym[pos], sym[nxt[pos]])
        known = rank >= 0
        if not known.any():
            return
        rank, pos = rank[known], pos[known]
        if len(rank) > 1:
            order = np.argsort(rank, kind="stable")
            rank, pos = rank[order], pos[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            firsts = rank[np.concatenate(([0], cut))].tolist()
            bounds = [0, *cut.tolist(), len(rank)]
        else:
            firsts, bounds = [int(rank[0])], [0, 1]
        for i, r in enumerate(firsts):
            if r in index:
                index[r].append(pos[bounds[i] : bounds[i + 1]])
            else:
                index[r] = [pos[bounds[i] : bounds[i + 1]]]
                heapq.heappush(heap, r)

    add(np.flatnonzero(nxt >= 0))
    while heap:
        r = heapq.heappop(heap)
        found = index.pop(r)
        pos = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        a, b, new = voc.left[r], voc.right[r], voc.merged[r]
        after = nxt[pos]
        live = (sym[pos] == a) & (after >= 0)
        live &= sym[after] == b
        pos, after = pos[live], after[live]
        if not len(pos):
            continue
        if a == b and len(pos) > 1:  # of overlapping pairs every second one, from the left
            pos = np.unique(pos)
            after = nxt[pos]
            start = np.ones(len(pos), bool)
            start[1:] = pos[1:] != after[:-1]
            at = np.arange(len(pos))
            even = (at - np.maximum.accumulate(np.where(start, at, 0))) % 2 == 0
            pos, after = pos[even], after[even]
        beyond = nxt[after]
        sym[pos], sym[after] = new, -1
        nxt[pos] = beyond
        inner = beyond >= 0
        prv[beyond[inner]] = pos[inner]
        before = prv[pos]
        add(np.unique(np.concatenate((pos[inner], before[before >= 0]))))
    alive = sym >= 0
    offsets = np.concatenate(([0], np.cumsum(alive)))[np.concatenate(([0], ends))]
    return sym[alive], offsets


def merge_with_tiktoken(words: pa.Array, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The same by tiktoken's merge loop, which is faster and gives the same ids where an id is its merge's rank."""
    enc = _tiktoken(voc)
    found = [enc._encode_single_piece(w) if w else [] for w in words.to_pylist()]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((i for x in found for i in x), np.int64, int(lengths.sum()))
    return flat, np.concatenate(([0], np.cumsum(lengths)))


_ENCODINGS: dict[int, object] = {}


def _tiktoken(voc: Vocabulary):
    import tiktoken

    if id(voc) not in _ENCODINGS:
        ids = {b: i for i, b in enumerate(voc.bytes_of) if i not in set(voc.specials.values())}
        _ENCODINGS[id(voc)] = tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=ids, special_tokens={})
    return _ENCODINGS[id(voc)]


def id_is_rank(voc: Vocabulary) -> bool:
    return bool((voc.merged == 256 + np.arange(len(voc.merged))).all())


def pieces(col: pa.Array, voc: Vocabulary) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Cut texts where the tokenizer always cuts: codes, distinct pieces, offsets of the rows in the codes.

    A single space with white space on at most one side starts a piece. A text
    with such a space between two others, or with a special token's string, is
    one piece, whatever its length.
    """
    col = col.cast(pa.large_string())
    odd = pc.match_substring_regex(col, f"{_SPACE_RE2} {_SPACE_RE2}")
    for s in voc.specials:
        odd = pc.or_(odd, pc.match_substring(col, s))
    # A private character marks the cuts; a text that holds it is not cut.
    whole = pc.or_(odd, pc.match_substring(col, _MARK))
    marked = pc.if_else(whole, col, pc.replace_substring(col, " ", _MARK + " "))
    if pc.any(whole).as_py():
        lists = pa.chunked_array([pc.split_pattern(marked, _MARK)]).combine_chunks()
        is_whole = whole.to_numpy(zero_copy_only=False)
        flat, counts = [], np.zeros(len(col), np.int64)
        values = lists.flatten()
        offs = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
        for i in range(len(col)):  # slices, not copies
            part = col.slice(i, 1) if is_whole[i] else values.slice(offs[i], offs[i + 1] - offs[i])
            flat.append(part)
            counts[i] = len(part)
        flat = pa.concat_arrays(flat).dictionary_encode()
    else:
        lists = pc.split_pattern(marked, _MARK)
        flat = lists.flatten().dictionary_encode()
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary, np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def encode_texts(col: pa.Array, voc: Vocabulary, merge: Callable = merge_words) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end and the n+1 offsets of the texts."""
    codes, distinct, rows = pieces(col, voc)
    simple = pc.match_substring_regex(distinct, r"^ ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+$")
    found, special = [], voc.special_re
    for text in distinct.filter(pc.invert(simple)).to_pylist():
        if special is not None and special.search(text):
            found.append([w for x in special.split(text) for w in ([x] if x in voc.specials else _PATTERN.findall(x))])
        else:
            found.append(_PATTERN.findall(text))
    simple = simple.to_numpy(zero_copy_only=False)
    counts = np.ones(len(distinct), np.int64)
    counts[~simple] = np.fromiter(map(len, found), np.int64, len(found))
    tokens = pa.concat_arrays([distinct.filter(pa.array(simple)), pa.array([w for x in found for w in x], distinct.type)]).dictionary_encode()
    token, names = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64), tokens.dictionary
    piece_end = np.concatenate(([0], np.cumsum(counts)))
    part = np.zeros(len(token), np.int64)
    part[piece_end[:-1][simple]] = token[: simple.sum()]
    part[ranges(piece_end[:-1][~simple], counts[~simple])] = token[simple.sum() :]
    own = {k: i for s, i in voc.specials.items() if (k := pc.index(names, pa.scalar(s, names.type)).as_py()) >= 0}
    plain = pc.if_else(pc.is_in(names, pa.array(list(voc.specials), names.type)), "", names) if own else names
    flat, offsets = merge(plain.cast(pa.large_binary()), voc)
    if own:  # special tokens have one id, which no merge gives
        at = np.array(sorted(own), np.int64)
        flat = np.insert(flat, offsets[at], [own[int(k)] for k in at])
        extra = np.zeros(len(names) + 1, np.int64)
        extra[at + 1] = 1
        offsets = offsets + np.cumsum(extra)
    lengths = np.diff(offsets)
    per_part = np.concatenate(([0], np.cumsum(lengths[part])))
    piece_ids = flat[ranges(offsets[part], lengths[part])]  # of the distinct pieces, end to end
    start, size = per_part[piece_end[:-1]], np.diff(per_part[piece_end])
    ids = piece_ids[ranges(start[codes], size[codes])]
    total = np.concatenate(([0], np.cumsum(size[codes])))
    return ids, total[rows]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>`` of every text, as the tokenizers library gives them without added tokens.

    A null or empty text has no ids. Rows are independent: repeated rows and
    null ids stay as they are, other columns are ignored, an empty table gives
    no rows. A very long text is encoded in one piece of its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for b in chunks(batches, limit=INDEX_BYTES):
            ids, offsets = encode_texts(b.column(1), voc)
            start = 0  # a part of few texts leaves at a time, so Spark holds few
            while start < b.num_rows:
                stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + 1_000_000, side="right")) - 1)
                stop = min(stop, b.num_rows)
                own = ids[offsets[start] : offsets[stop]].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array((offsets[start : stop + 1] - offsets[start]).astype(np.int32)), pa.array(own))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), lists], ["id", "ids"])
                start = stop

    out = id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``text`` to ``id_col, ids_col`` and the columns ``keep``: the bytes of the ids, special ones included, read as UTF-8.

    Bytes that are no UTF-8 become U+FFFD. Null or no ids give an empty text;
    an id outside the vocabulary is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        table = pa.array(voc.bytes_of, pa.large_binary())
        for b in batches:
            start, ids = 0, b.column(b.schema.get_field_index("__ids"))
            rest = [f for f in b.schema.names if f != "__ids"]
            lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            while start < b.num_rows:
                base = ends[start] - lengths[start]
                stop = min(max(start + 1, int(np.searchsorted(ends, base + 2_000_000, side="right"))), b.num_rows)
                part = pc.fill_null(ids.slice(start, stop - start), [])
                values = table.take(part.flatten())
                lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], ends[start:stop] - base)).astype(np.int64)), values)
                joined = pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))
                text = pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)).slice(start, stop - start) for c in rest], text], [*rest, "__text"])
                start = stop

    own = encoded.select(F.col(id_col).cast("long").alias("__id"), F.col(ids_col).alias("__ids"), *keep)
    schema = ", ".join(["__id long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema], "__text string"])
    return own.mapInArrow(run, schema).withColumnsRenamed({"__id": id_col, "__text": "text"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = encode(load(configure(spark), sf_dir, "documents"), path)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    ids = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids")
    text = decode(ids, path, keep=("n_tokens", "ids_sha256"))
    return text.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
