"""Recursive multi-step forecasts and backtests."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsfoundry.functions import time as tm
from tsfoundry.functions.time import HOUR, epoch, week_anchor
from tsfoundry.operators.lookup import attach
from tsfoundry.operators.metrics import to_long
from tsfoundry.operators.models.naive import quantile_column
from tsfoundry.session import cut_lineage

#: Hours from Wednesday 23:00 to Saturday 23:00, both included.
WINDOW_HOURS = 73


def first_anchor(df: DataFrame, keys: Sequence[str], ts: str, day: int = tm.WED, from_hour: int = 18) -> DataFrame:
    """Per key the first row at or after the given hour on the given weekday."""
    match = (tm.weekday(ts) == day) & (tm.hour(ts) >= from_hour)
    return df.filter(match).groupBy(*keys).agg(F.min(ts).alias("anchor"))


def recursive_forecast(
    df: DataFrame, keys: Sequence[str], idx: str, ts: str, value: str, lags: Sequence[int],
    median: Column, window_hours: int = WINDOW_HOURS,
) -> DataFrame:
    """Median forecast of the weekly window, fed back into the lags it hides.

    ``df`` is an hourly grid with observed ``lag_k`` columns; ``median`` is an
    expression over them. A lag reaching past Wednesday 23:00 of its row's week
    must come from a forecast. Rows are taken in blocks of the shortest lag:
    the lags of a block only need earlier blocks, so a window of h hours takes
    ceil(h / lag) passes instead of h steps. Every pass is checkpointed, so no
    forecast is computed twice and the plan stays flat.

    Returns the rows from the anchor on, with filled lags and ``pred`` (the
    observed value outside the window).
    """
    start = first_anchor(df, keys, ts)
    rows = attach(df, start, keys, spread=[idx]).filter(F.col(ts) >= F.col("anchor")).drop("anchor")
    opening = week_anchor(ts, tm.WED, 23)
    offset = ((epoch(ts) - epoch(opening)) / HOUR).cast("int")
    rows = rows.withColumn("__o", offset)
    inside = (F.col("__o") >= 0) & (F.col("__o") < window_hours)
    # a week ends 96 hours after Wednesday 23:00: longer lags are never hidden
    hidden = [k for k in lags if k <= 7 * 24 - tm.WED * 24 - 23 - 1]
    if not hidden:
        return rows.withColumn("pred", F.when(inside, median).otherwise(F.col(value))).drop("__o")
    step = min(hidden)

    # the rows are read once per block: they are written once, in shared storage
    rows = cut_lineage(rows)

    def fill(block: DataFrame, lookup: Callable[[int], DataFrame | None]) -> DataFrame:
        """Replace hidden lags by forecasts, or by observations after the window."""
        for k in hidden:
            known = lookup(k)
            if known is None:
                continue
            past = known.select(*keys, (F.col(idx) + k).alias(idx), F.col("pred").alias("__p"))
            name = f"lag_{k}"
            block = block.join(past, [*keys, idx], "left").withColumn(
                name, F.when(F.col("__o") >= k, F.coalesce("__p", name)).otherwise(F.col(name))
            ).drop("__p")
        return block

    done: list[DataFrame] = []

    def union(parts: Sequence[DataFrame]) -> DataFrame | None:
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    for b in range(math.ceil(window_hours / step)):
        first, last = b * step, min((b + 1) * step, window_hours) - 1
        block = rows.filter(F.col("__o").between(first, last))
        # lag k of this block only meets the blocks k steps before it
        scored = fill(block, lambda k: union(done[max(0, (first - k) // step): max(0, (last - k) // step + 1)]))
        done.append(cut_lineage(scored.select(*keys, idx, median.alias("pred"))))
    known = union(done)
    filled = fill(rows, lambda k: known)
    out = filled.join(known, [*keys, idx], "left")
    return out.withColumn("pred", F.when(inside, F.col("pred")).otherwise(F.col(value))).drop("__o")


def other_quantiles(
    filled: DataFrame, keep: Sequence[str], expressions: dict[float, Column], required: Sequence[str]
) -> DataFrame:
    """Long forecasts: the recursive median and, on its filled lags, the other quantiles.

    A null in a required feature fails the query.
    """
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    checked = filled.withColumn(
        "pred", F.when(missing, F.raise_error(F.lit("null feature at scoring time")).cast("double")).otherwise(F.col("pred"))
    )
    wide = checked.select(*keep, *[
        (F.col("pred") if q == 0.5 else e).alias(quantile_column(q)) for q, e in expressions.items()
    ])
    return to_long(wide, keep, {q: quantile_column(q) for q in expressions})


def calendar_folds(folds: DataFrame) -> list[dict]:
    """The rows of a fold table without keys, for ``rolling_cv``: one per week of the data."""
    return [
        {"fold": r["fold"], "train_end": str(r["fold_train_end"]), "test_start": str(r["test_start"]), "test_end": str(r["test_end"])}
        for r in folds.orderBy("fold").collect()
    ]


def rolling_cv(
    df: DataFrame, folds: Sequence[dict], ts: str, make_model: Callable[[], object], parallelism: int = 4,
    kind: str = "expanding", train_hours: int | None = None,
    score: Callable[[object, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Fit on every fold's training rows, forecast its test rows, union with ``fold``.

    ``folds`` are dicts (fold, train_end, test_start, test_end) on a common
    calendar: a handful of rows. Fits run as concurrent Spark jobs. ``score``
    maps a fitted model and test rows to forecasts, for example recursively;
    the model's ``transform`` sees the observed lags.
    """
    if not folds:
        raise ValueError("no fold: the data end before the first test window does")

    def one(f: dict) -> DataFrame:
        t = F.col(ts)
        train = df.filter(t <= F.lit(f["train_end"]).cast("timestamp_ntz"))
        if kind == "sliding":
            train = train.filter(t > tm.shift_ts(F.lit(f["train_end"]).cast("timestamp_ntz"), -(train_hours or 0) * HOUR))
        test = df.filter(t.between(
            F.lit(f["test_start"]).cast("timestamp_ntz"), F.lit(f["test_end"]).cast("timestamp_ntz")
        ))
        model = make_model().fit(train)
        scored = score(model, test) if score else model.transform(test)
        return scored.withColumn("fold", F.lit(f["fold"]))

    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(one, folds))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
