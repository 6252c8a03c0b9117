"""Language of texts, with spans of mixed ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsfoundry.llm.common import chunks, load, ranges, text_buffer, words
from tsfoundry.session import configure

NAME = "op1_language_id"
ORACLE = None

#: Byte n-grams of a word, its ends marked, are hashed to so many numbers for each n.
NGRAMS = (2, 3, 4)
BINS = 1 << 15
SMOOTHING = 0.5
#: A word may favour a language over the worst by so much, and a switch of language costs so much (natural logarithms).
MOST_PER_WORD = 6.0
SWITCH = 9.0
#: Words of a block that the Viterbi search takes in one go, more where its blocks would hold over so many pairs of states.
BLOCK = 64
BLOCK_CELLS = 1 << 22
#: A language is a candidate for a script that has this share of its letters.
LEAST_SCRIPT_SHARE = 0.01
#: A text with a smaller share of its main language is rejected as a document of one language.
LEAST_SHARE = 0.3

#: First code points of the Unicode ranges that tell scripts apart, with their script. Fixed values.
_SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB10, "other"), (0x20000, "han"), (0x30000, "other"),
]
_STARTS = np.array([s for s, _ in _SCRIPTS])
_NAMES = sorted({n for _, n in _SCRIPTS})
_OF = np.array([_NAMES.index(n) for _, n in _SCRIPTS])
_GRAMS = len(NGRAMS) * BINS


@dataclass
class LanguageModel:
    """``scores``: log share of each n-gram by language; ``scripts``: share of each script by language."""

    langs: list[str]
    scores: np.ndarray
    scripts: np.ndarray


def scripts_of(distinct: pa.Array) -> np.ndarray:
    """The script of each word's first letter, -1 for words without one."""
    first = pc.struct_field(pc.extract_regex(distinct, r"(?P<c>\pL)"), "c")
    raw, off = text_buffer(first)
    out = np.full(len(distinct), -1)
    has = np.diff(off) > 0
    if has.any():
        points = np.frombuffer("".join(first.filter(pa.array(has)).to_pylist()).encode("utf-32-le"), np.uint32)
        out[has] = _OF[np.searchsorted(_STARTS, points, side="right") - 1]
    return out


def ngrams(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word number and bin of every n-gram of the words in lower case, a space before and after each."""
    mark = pa.scalar(" ", pa.large_string())
    raw, off = text_buffer(pc.binary_join_element_wise(mark, pc.utf8_lower(distinct), mark, pa.scalar("", pa.large_string())))
    word = np.repeat(np.arange(len(distinct)), np.diff(off))
    value = raw.astype(np.uint64)
    of, bins, size, h = [], [], 1, value
    for k, n in enumerate(NGRAMS):
        while size < n:
            h = h[:-1] * np.uint64(257) + value[size:] if len(h) else h
            size += 1
        same = word[: len(h)] == word[n - 1 :] if len(h) else np.zeros(0, bool)
        mixed = (h[same] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BINS.bit_length() + 1)
        of.append(word[: len(h)][same])
        bins.append(mixed.astype(np.int64) + k * BINS)
    return np.concatenate(of), np.concatenate(bins)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Count n-grams and scripts of all labelled texts, each task for itself, and sum the counts.

    The result has at most BINS numbers for each n and language, however many
    texts there are. Rows without text or label are ignored; without any the
    model knows no language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in chunks(batches):
            lang = b.column(1).dictionary_encode()
            codes, distinct, off = words(b.column(0))
            script = scripts_of(distinct)
            word, bins = ngrams(distinct)
            row = np.repeat(lang.indices.to_numpy(zero_copy_only=False), np.diff(off))
            for k, name in enumerate(lang.dictionary.to_pylist()):
                n = np.bincount(codes[row == k], minlength=len(distinct)) * (script >= 0)
                own = total.setdefault(name, np.zeros(_GRAMS + len(_NAMES)))
                own[:_GRAMS] += np.bincount(bins, n[word], minlength=_GRAMS)
                own[_GRAMS:] += np.bincount(np.maximum(script, 0), n, minlength=len(_NAMES))
        for name, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at].astype(np.int64))], ["lang", "bin", "n"])

    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sums = known.mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    table = np.zeros((len(langs), _GRAMS + len(_NAMES)))
    for i, name in enumerate(langs):
        own = sums[sums["lang"] == name]
        table[i, own["bin"].to_numpy()] = own["n"].to_numpy()
    grams = table[:, :_GRAMS].reshape(len(langs), len(NGRAMS), BINS)
    logs = np.log((grams + SMOOTHING) / (grams.sum(axis=2, keepdims=True) + SMOOTHING * BINS)) / len(NGRAMS)
    scripts = table[:, _GRAMS:] / np.maximum(table[:, _GRAMS:].sum(axis=1, keepdims=True), 1)
    return LanguageModel(langs, np.ascontiguousarray(logs.reshape(len(langs), _GRAMS).T.astype(np.float32)), scripts)


def word_scores(distinct: pa.Array, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Score of each word by language, 0 for the best, and its script. Words without letters, or of a script no language uses, are neutral."""
    script = scripts_of(distinct)
    word, bins = ngrams(distinct)
    out = np.stack([np.bincount(word, model.scores[bins, k], minlength=len(distinct)) for k in range(len(model.langs))], axis=1)
    allowed = (model.scripts >= LEAST_SCRIPT_SHARE).T[np.maximum(script, 0)]
    used = allowed.any(axis=1)
    out = np.where(allowed, out, -np.inf)
    out[~used | (script < 0)] = 0
    return np.maximum(out - out.max(axis=1, keepdims=True), -MOST_PER_WORD).astype(np.float32), script


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word, rows end to end, when each change of language costs ``switch``.

    Rows are cut into blocks that advance together, so a step is one array
    operation over all blocks and a long row takes as many steps as a block has
    words, and one for each of its blocks: what a block does to every state
    before it is found first, then the states at the borders, then the words.
    """
    n_words, width = scores.shape
    if not n_words:
        return np.zeros(0, np.int64)
    size = max(BLOCK, -(-n_words * width * width // BLOCK_CELLS))
    per_row = -(-np.diff(offsets) // size)
    row_block = np.concatenate(([0], np.cumsum(per_row)))
    first = ranges(np.zeros(len(per_row), np.int64), per_row) * size + np.repeat(offsets[:-1], per_row)
    length = np.minimum(np.repeat(offsets[1:], per_row) - first, size)
    # Longest blocks first: those with a word t are the leading active[t].
    order = np.argsort(-length, kind="stable")
    first, own = first[order], np.arange(width)
    active = np.searchsorted(-length[order], -np.arange(1, length.max() + 1), side="right").tolist()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    rows = np.argsort(-per_row, kind="stable")
    chained = np.searchsorted(-per_row[rows], -np.arange(1, per_row.max() + 1), side="right").tolist()

    start = np.zeros((len(order), width))
    last = np.zeros((len(per_row), width))
    if len(chained) > 1:
        whole = np.where(np.eye(width, dtype=bool), 0.0, -np.inf)[None].repeat(len(order), axis=0)
        for t, n in enumerate(active):
            d = whole[:n]
            whole[:n] = np.maximum(d, d.max(axis=2, keepdims=True) - switch) + scores[first[:n] + t][:, None, :]
        for i, n in enumerate(chained):
            at = rank[row_block[rows[:n]] + i]
            start[at] = last[rows[:n]]
            last[rows[:n]] = (start[at][:, :, None] + whole[at]).max(axis=1)
    back = np.zeros(scores.shape, np.int8 if width < 128 else np.int16)
    d = start.copy()
    before = np.tile(own, (len(order), 1))
    for t, n in enumerate(active):
        top = d[:n].argmax(axis=1)
        rival = d[np.arange(n), top][:, None] - switch
        stay = d[:n] >= rival
        came = np.where(stay, own, top[:, None])
        back[first[:n] + t] = came
        before[:n] = np.take_along_axis(before[:n], came, axis=1)
        d[:n] = np.where(stay, d[:n], rival) + scores[first[:n] + t]

    state = np.zeros(len(order), np.int64)
    for i in range(len(chained) - 1, -1, -1):
        own_rows = rows[: chained[i]]
        at = rank[row_block[own_rows] + i]
        ends = per_row[own_rows] == i + 1
        after = rank[np.minimum(row_block[own_rows] + i + 1, len(order) - 1)]
        state[at] = np.where(ends, d[at].argmax(axis=1), before[after, state[after]])
    path = np.zeros(n_words, np.int64)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        path[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return path


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", rest: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, lang_pred, score, spans`` of every whole text.

    ``spans`` are the runs of words of one language: ``lang``, the first word's
    number and the number of words. The language with most letters' words (by
    their length) is the prediction, its share of them the score; ties go to the
    first name. A null text, or one without letters, is ``und`` with score 0 and
    no spans, and so is every text of a model that knows no language. Rows are
    independent. The columns ``rest`` return in a struct of that name, and then
    the text as ``text``, empty for null; others are ignored.
    """
    span = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, "und"])
        width = len(model.langs)
        for b in chunks(batches, limit=1 << 20):
            n, own = b.num_rows, [b.column(1), *b.columns[2:]] if rest else []
            codes, distinct, off = words(b.column(1))
            if not width or not len(codes):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["und"] * n), pa.array(np.zeros(n)), pa.array([[]] * n, span), *own], names_out)
                continue
            scores, script = word_scores(distinct, model)
            weight = np.where(script >= 0, pc.utf8_length(distinct).to_numpy(zero_copy_only=False), 0)[codes]
            path = viterbi(scores[codes], off, SWITCH)
            row = np.repeat(np.arange(n), np.diff(off))
            share = np.bincount(row * width + path, weight, minlength=n * width).reshape(n, width)
            total = share.sum(axis=1)
            top = np.where(total > 0, share.argmax(axis=1), width)
            score = np.where(total > 0, share.max(axis=1) / np.maximum(total, 1), 0.0)
            edge = np.flatnonzero(np.concatenate(([True], (path[1:] != path[:-1]) | (row[1:] != row[:-1]))))
            edge = edge[total[row[edge]] > 0]
            stop = np.minimum(np.append(edge[1:], len(path)), off[row[edge] + 1])
            bounds = np.searchsorted(row[edge], np.arange(n + 1)).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(names[path[edge]]), pa.array((edge - off[row[edge]]).astype(np.int32)), pa.array((stop - edge).astype(np.int32))], ["lang", "first_word", "n_words"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[top]), pa.array(score), pa.ListArray.from_arrays(pa.array(bounds), values), *own], names_out)

    schema = "id long, lang_pred string, score double, spans array<struct<lang: string, first_word: int, n_words: int>>"
    names_out = ["id", "lang_pred", "score", "spans", *(["text", "rest"] if rest else [])]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text, *([F.struct(*rest).alias("rest")] if rest else []))
    if rest:
        schema += f", text string, rest {rows.schema['rest'].dataType.simpleString()}"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that have a language with at least LEAST_SHARE of their words.

    If the model knows no language, those with letters stay.
    """
    if not model.langs:
        return docs.where(F.col(text_col).rlike(r"\pL"))
    others = tuple(c for c in docs.columns if c != text_col) or (text_col,)
    named = identify(docs, model, id_col, text_col, others)  # the text passes once
    known = named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return known.select(*[F.col("text").cast(docs.schema[c].dataType).alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns])


def remainder(id_col: str, of: int) -> F.Column:
    """crc32 of the id's decimal text, modulo ``of``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of, F.lit(0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(configure(spark), sf_dir, "documents")
    model = fit(docs.where(remainder("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
