"""Packing token sequences by a configuration linear program over the lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsfoundry.llm import bpe
from tsfoundry.llm.common import chunks, id_and_text, load
from tsfoundry.session import configure, cut_lineage

NAME = "op4_best_fit_packing"
ORACLE = None

CAPACITY = 1024
END_ID = 2
#: Rounds of multiplicative weights, and the rate at which the weights of lengths that fall behind rise.
ROUNDS, RATE = 12, 0.5
#: Configurations whose value is so near to the best are taken in one round.
TOLERANCE = 0.002
#: Shares are rounded down while that places this part of the program's value. After that they are rounded up,
#: in solutions of fewer rounds, each until this part of the pieces is longer than what is placed and still waits.
LEAST_WHOLE, MOST_WAITING, LATER_ROUNDS = 0.05, 0.3, 5
#: A configuration may leave so many tokens empty.
SLACK = 1
#: Part of the pieces left to best fit: rounding the last configurations would waste more than they have.
LEFT_OVER = 0.09
#: Bytes of text encoded together; ids and places take several times as much.
CHUNK_BYTES = 2 << 20


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, piece, start, length, ids_crc32``: the tokens of each document and an end, cut where they exceed the capacity.

    All pieces but a document's first have the full length. A null or empty
    text has its end alone. Repeated rows and null ids are packed like others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = bpe.vocabulary(path)
        merge = bpe.merge_with_tiktoken if bpe.id_is_rank(voc) else bpe.merge_words
        for b in chunks(batches, limit=CHUNK_BYTES):
            ids, off = bpe.encode_texts(b.column(1), voc, merge)
            ids = np.insert(ids.astype("<u4"), off[1:], end_id)
            off = off + np.arange(len(off))
            length = np.diff(off)
            count = -(-length // capacity)
            doc = np.repeat(np.arange(b.num_rows), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            first = length - (count - 1) * capacity
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            size = np.where(piece == 0, first[doc], capacity)
            view = memoryview(ids).cast("B")
            at = (off[:-1][doc] + start) * 4
            crc = [zlib.crc32(view[i : i + n]) for i, n in zip(at.tolist(), (size * 4).tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    out = id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


class Knapsack:
    """Best fillings of every room by items of ascending length, each used at most as often as it is there.

    Copies of a length are items of 1, 2, 4, ... pieces. One pass of dynamic
    programming gives, for every item, the best configuration in which it is
    the last, that is the longest: the pieces below fill what it leaves.
    """

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, values: np.ndarray, capacity: int):
        item, copies = [], []
        for i, n in enumerate(lengths.tolist()):
            most, k = min(int(counts[i]), capacity // n), 1
            parts = []
            while most > 0:
                k = min(k, most)
                parts.append(k)
                most, k = most - k, 2 * k
            for k in reversed(parts):
                item.append(i)
                copies.append(k)
        self.item, self.copies, self.capacity = np.array(item, np.int64), np.array(copies, np.int64), capacity
        self.size = lengths[self.item] * self.copies
        gain = values[self.item] * self.copies
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int16)
        self.last = np.empty((len(item) + 1, capacity + 1), np.int16)
        self.last[0] = last
        self.worth = np.empty(len(item))
        for i, (n, v) in enumerate(zip(self.size.tolist(), gain.tolist())):
            with_it = best[: capacity + 1 - n] + v
            self.worth[i] = with_it[-1]
            better = with_it >= best[n:] * (1 - 1e-12)  # of equal fillings the one with longer pieces
            better &= with_it > 0
            best[n:][better] = with_it[better]
            last[n:][better] = i
            self.last[i + 1] = last
        self.value = best[capacity]
        self._of, self._n, self._size = self.item.tolist(), self.copies.tolist(), self.size.tolist()

    def configuration(self, i: int) -> dict[int, int]:
        """Copies by number of length in the best filling with item i as the last one."""
        room, out = self.capacity - self._size[i], {self._of[i]: self._n[i]}
        while (i := int(self.last[i, room])) >= 0:
            out[self._of[i]] = out.get(self._of[i], 0) + self._n[i]
            room -= self._size[i]
        return out


def fractional(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[list[tuple[int, int]], float]], float]:
    """Configurations with their shares, and a lower bound on the number of sequences.

    Multiplicative weights on the covering program: each length should be
    covered as often as it occurs by as few sequences as possible. All lengths
    are covered at one pace, an equal part of their need in each round. In a
    round the knapsack prices the configurations at the present weights; those
    within ``TOLERANCE`` of the best one are taken as far as the pace allows.
    A length that falls behind gains weight; one that is covered leaves. By
    duality the weights of the pieces over the best configuration's bound
    the number of sequences from below.
    """
    lengths = np.flatnonzero(counts)
    need = counts[lengths].astype(float)
    covered, log_weight = np.zeros(len(lengths)), np.zeros(len(lengths))
    shares: dict[tuple, float] = {}
    bound = 0.0
    for step in range(rounds):
        goal = need * min(1.0, (step + 1) / (rounds - 2))
        active = np.flatnonzero(covered < goal * (1 - 1e-9))
        if not len(active):
            continue
        values = lengths[active] * np.exp(log_weight[active] - log_weight[active].max())
        sack = Knapsack(lengths[active], counts[lengths[active]], values, capacity)
        bound = max(bound, float(need[active] @ values) / sack.value)
        room, names = (goal - covered)[active].tolist(), lengths[active].tolist()
        for i in np.flatnonzero(sack.worth >= (1 - TOLERANCE) * sack.value)[::-1].tolist():
            config = sack.configuration(i)
            times = min(room[j] / k for j, k in config.items())
            if times > 1e-6:
                for j, k in config.items():
                    room[j] -= k * times
                key = tuple(sorted(((names[j], k) for j, k in config.items()), reverse=True))
                shares[key] = shares.get(key, 0.0) + times
        covered[active] = goal[active] - room
        log_weight += RATE * (goal - covered) / need
    return [(list(c), x) for c, x in shares.items()], bound


def place_configurations(counts: np.ndarray, capacity: int) -> tuple[list[tuple[list[tuple[int, int]], int]], np.ndarray]:
    """Whole configurations and how often each is used, and the pieces that are left without a place.

    The program's shares are rounded down, and the program is solved again for
    what that leaves. Where that would place few, the configurations are used
    at least once each as far as their pieces are there, those of the longest pieces
    first and until some of these are left waiting: the short pieces then stay
    for them in the next solution. A part of ``LEFT_OVER`` of the pieces is left.
    """
    left = counts.copy()
    used: list[tuple[list[tuple[int, int]], int]] = []
    rounds = ROUNDS
    while left.sum() > LEFT_OVER * counts.sum():
        shares = fractional(left, capacity, rounds)[0]
        whole = [(c, int(x)) for c, x in shares if x >= 1]
        if sum(x for _, x in whole) < LEAST_WHOLE * sum(x for _, x in shares):
            shares.sort(key=lambda s: (-s[0][0][0], -s[1]))
            whole, rounds = [(c, max(1, int(x))) for c, x in shares], LATER_ROUNDS
            waiting = MOST_WAITING * left.sum()
        else:
            waiting = np.inf
        before = left.sum()
        # where nothing could be placed, without waiting, and then with configurations that leave more room
        for least, waiting in ((capacity - SLACK, waiting), (capacity - SLACK, np.inf), (0, np.inf)):
            for config, times in whole if left.sum() == before else []:
                if left[config[0][0] + 1 :].sum() > waiting:
                    break
                times = min([times, *[int(left[n]) // k for n, k in config]])
                if times > 0 and sum(n * k for n, k in config) >= least:
                    used.append((config, times))
                    for n, k in config:
                        left[n] -= k * times
    return used, left


def solve(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Configurations and how often each is used, so that every piece has a place.

    ``counts[n]`` pieces have length n; the histogram has ``capacity`` numbers,
    whatever the table's size. The configuration program places all but a part
    of ``LEFT_OVER``; that is packed largest first by best fit.
    """
    counts = counts.astype(np.int64).copy()
    used: list[tuple[list[tuple[int, int]], int]] = []
    if counts[capacity]:
        used.append(([(capacity, 1)], int(counts[capacity])))
        counts[capacity] = 0
    placed, left = place_configurations(counts, capacity)
    used += placed
    while left.any():
        room, filled = capacity, {}
        while len(fits := np.flatnonzero(left[: room + 1])):
            n = int(fits[-1])
            filled[n] = filled.get(n, 0) + 1
            left[n] -= 1
            room -= n
        times = 1 + min(int(left[m]) // c for m, c in filled.items())
        used.append((sorted(filled.items(), reverse=True), times))
        for m, c in filled.items():
            left[m] -= c * (times - 1)
    return used


def slots(used: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """Runs of places by length: piece number k of a length, counted from ``first``, lies in run of its length with the last ``first`` <= k.

    A run covers ``copies`` pieces in each of ``times`` sequences from ``sequence`` on, from ``offset``.
    """
    rows, next_of, sequence = [], {}, 0
    for config, times in used:
        offset = 0
        for n, copies in config:
            rows.append((n, next_of.get(n, 0), copies, sequence, offset))
            next_of[n] = next_of.get(n, 0) + copies * times
            offset += n * copies
        sequence += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "copies", "sequence", "offset"), a.T))


def pack(tokens: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a length from 1 to the capacity.

    Only the histogram of lengths and each partition's share of it leave the
    tasks; the places of the configurations return as a table of runs, whose
    size depends on the capacity alone. Rows of one length are interchangeable,
    so a row's place is its number among those of its length; columns must be of
    kinds that can be sorted, which makes a repeated task give the same places.
    Sequences have no gaps; an empty table gives no rows; a length outside the range is an error.
    """
    rows = cut_lineage(tokens.withColumn("__part", F.spark_partition_id()))
    own = rows.groupBy("__part", length_col).agg(F.count(F.lit(1)).alias("n"))
    histogram = own.groupBy(length_col).agg(F.sum("n").alias("n")).toPandas()  # at most ``capacity`` rows
    if len(histogram) and not histogram[length_col].between(1, capacity).all():
        raise ValueError(f"lengths must be from 1 to {capacity}")
    counts = np.zeros(capacity + 1, np.int64)
    counts[histogram[length_col].to_numpy(np.int64)] = histogram["n"].to_numpy(np.int64)
    table = slots(solve(counts, capacity))

    # Where the pieces of a partition begin among those of their length: a running sum over partitions, one group per length.
    def before(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__part")
        return group.assign(before=group["n"].cumsum() - group["n"])[["__part", length_col, "before"]]

    starts = own.groupBy(length_col).applyInPandas(before, f"__part int, `{length_col}` long, before long")
    key = table["length"] * (1 << 40) + table["first"]
    names = tokens.columns
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema]

    def place(group: pa.Table, first_of: pa.Table) -> pa.Table:
        group = group.drop_columns("__part").combine_chunks()
        group = group.take(pc.sort_indices(group, sort_keys=[(c, "ascending") for c in names])) if group.num_rows else group
        n = group[length_col].to_numpy().astype(np.int64)
        start = np.zeros(capacity + 1, np.int64)
        start[first_of[length_col].to_numpy().astype(np.int64)] = first_of["before"].to_numpy()
        order = np.argsort(n, kind="stable")
        k = np.zeros(len(n), np.int64)
        k[order] = start[n[order]] + np.arange(len(n)) - np.searchsorted(n[order], n[order])
        run = np.searchsorted(key, n * (1 << 40) + k, side="right") - 1
        inside = k - table["first"][run]
        sequence = table["sequence"][run] + inside // table["copies"][run]
        offset = table["offset"][run] + inside % table["copies"][run] * n
        return pa.table([*group.columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    placed = rows.groupBy("__part").cogroup(starts.groupBy("__part"))
    return placed.applyInArrow(place, ", ".join([*kept, "sequence_id long", "offset long"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(pieces(load(configure(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
