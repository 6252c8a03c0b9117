"""Train/test splits and rolling-origin folds as columns, not as copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsfoundry.functions.time import DAY, HOUR, WEEK, epoch, from_epoch, shift_ts
from tsfoundry.operators.chunking import row_numbers
from tsfoundry.operators.lookup import attach

#: First fold a row trains in, and the fold it tests in.
TRAINS_FROM, TESTS_IN = "__trains_from", "__tests_in"


def split_fraction(df: DataFrame, keys: Sequence[str], idx: str, fraction: float) -> DataFrame:
    """Add ``part``: the first ``int(n * fraction)`` rows of a key train, the rest test."""
    numbered = row_numbers(df, keys, idx, out="__rn", total="__n")
    train = F.col("__rn") <= F.floor(F.col("__n") * F.lit(float(fraction)))
    return numbered.withColumn("part", F.when(train, "train").otherwise("test")).drop("__rn", "__n")


def split_dates(
    df: DataFrame, ts: str, train_end: Column, test_start: Column, horizon_hours: int
) -> DataFrame:
    """Add ``part``. Both test bounds are inclusive, so a horizon of h hours
    holds h + 1 hourly rows; rows in neither part are dropped."""
    test_end = shift_ts(test_start, horizon_hours * HOUR)
    t = F.col(ts)
    return df.filter((t <= train_end) | t.between(test_start, test_end)).withColumn(
        "part", F.when(t <= train_end, "train").otherwise("test")
    )


def split_history_forecast(df: DataFrame, ts: str, as_of: Column) -> DataFrame:
    return df.withColumn("part", F.when(F.col(ts) < as_of, "history").otherwise("forecast"))


def tail_validation(df: DataFrame, keys: Sequence[str], idx: str, eval_fraction: float) -> DataFrame:
    """Add ``part``: the last share of the training rows validates."""
    return split_fraction(df, keys, idx, 1.0 - eval_fraction).withColumn(
        "part", F.when(F.col("part") == "test", "valid").otherwise("train")
    )


def fold_rows(
    df: DataFrame, keys: Sequence[str], idx: str, n_splits: int, test_size: int, gap: int = 0
) -> DataFrame:
    """Expanding splits without copies: every row once, with the first fold it trains in and the fold it tests in.

    A row trains in its first fold and all later ones; null where it trains,
    or tests, in none. Test parts of ``test_size`` rows follow each other up to
    the key's last row; ``gap`` rows before them do not train.
    """
    numbered = row_numbers(df, keys, idx, out="__rn", total="__n")
    after = F.col("__n") - F.col("__rn")  # rows of the key behind this one
    ahead = F.floor(after / test_size).cast("int")
    tests = F.when(ahead < n_splits, n_splits - 1 - ahead)
    # trains in fold f if at least (n_splits - f) * test_size + gap rows lie behind it
    room = F.floor((after - gap) / test_size).cast("int")
    first = F.greatest(F.lit(0), n_splits - room)
    return numbered.withColumns({TESTS_IN: tests, TRAINS_FROM: F.when((first < n_splits) & (after >= gap), first)}).drop("__rn", "__n")


def time_series_split(
    df: DataFrame, keys: Sequence[str], idx: str, n_splits: int, test_size: int, gap: int = 0
) -> DataFrame:
    """Long (row, fold, part): expanding training rows, ``test_size`` test rows; only folds a row belongs to are listed."""
    rows = fold_rows(df, keys, idx, n_splits, test_size, gap)
    trains = F.when(F.col(TRAINS_FROM).isNotNull(), F.transform(F.sequence(TRAINS_FROM, F.lit(n_splits - 1)), lambda f: F.struct(f.alias("fold"), F.lit("train").alias("part"))))
    tests = F.when(F.col(TESTS_IN).isNotNull(), F.array(F.struct(F.col(TESTS_IN).alias("fold"), F.lit("test").alias("part"))))
    none = F.array().cast("array<struct<fold:int,part:string>>")
    listed = rows.withColumn("__f", F.explode(F.concat(F.coalesce(trains, none), F.coalesce(tests, none))))
    return listed.select(*df.columns, F.col("__f.fold").alias("fold"), F.col("__f.part").alias("part"))


def fold_table(
    spans: DataFrame, keys: Sequence[str], first_day: int = 2, first_hour: int = 22,
    window_hours: int = 168,
) -> DataFrame:
    """Rolling-origin folds from ``spans`` = (keys, train_end, last_ts).

    The first training set ends at the first Wednesday 22:00 at or after
    ``train_end``; each test window follows one hour later and the next fold's
    training ends where it stops. Folds whose test window passes ``last_ts``
    are dropped. Test data no longer than a window sets the window's length.
    """
    e, last = epoch("train_end"), epoch("last_ts")
    hour_floor = F.ceil(e / HOUR).cast("long") * HOUR
    # 1970-01-01 was a Thursday: Monday-based week offset of an epoch second
    since_monday = F.pmod(hour_floor + 3 * DAY, F.lit(WEEK))
    goal = F.lit(first_day * DAY + first_hour * HOUR).cast("long")
    anchor = hour_floor + F.pmod(goal - since_monday, F.lit(WEEK))
    length = F.least(F.lit(window_hours * HOUR).cast("long"), last - e)
    n = F.floor((last - anchor) / length).cast("int")
    base = (
        spans.select(*keys, anchor.alias("__a"), length.alias("__l"), n.alias("__n"))
        .filter((F.col("__l") > 0) & (F.col("__n") > 0))
    )
    folds = base.select("*", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("fold"))
    end = F.col("__a") + F.col("fold") * F.col("__l")
    return folds.select(
        *keys, "fold", from_epoch(end).alias("fold_train_end"),
        from_epoch(end + HOUR).alias("test_start"), from_epoch(end + F.col("__l")).alias("test_end"),
    )


def assign_folds(
    df: DataFrame, folds: DataFrame, keys: Sequence[str], ts: str, kind: str = "expanding",
    train_hours: int | None = None,
) -> DataFrame:
    """Long (row, fold, role). Sliding training keeps the last ``train_hours`` only."""
    joined = attach(df, folds, keys)
    t = F.col(ts)
    train = t <= F.col("fold_train_end")
    if kind == "sliding":
        train = train & (t > shift_ts("fold_train_end", -(train_hours or 0) * HOUR))
    elif kind != "expanding":
        raise ValueError(f"unknown fold kind {kind!r}")
    role = F.when(train, "train").when(t.between(F.col("test_start"), F.col("test_end")), "test")
    return joined.withColumn("role", role).filter(F.col("role").isNotNull())


def test_fold(df: DataFrame, folds: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Only the test rows, each with the one fold it belongs to.

    Test windows of a key follow each other at equal distances, so a row's fold
    is arithmetic on its key's first window; rows never meet other folds.
    """
    length = epoch("test_end") - epoch("fold_train_end")
    axis = folds.groupBy(*keys).agg(F.min("test_start").alias("__a"), F.max(length).alias("__l"), F.min("fold").alias("__f"))
    numbered = attach(df, axis, keys).withColumn(
        "fold", (F.col("__f") + F.floor((epoch(ts) - epoch("__a")) / F.col("__l"))).cast(folds.schema["fold"].dataType)
    )
    placed = attach(numbered.filter(F.col(ts) >= F.col("__a")).drop("__a", "__l", "__f"), folds, [*keys, "fold"])
    joined = placed.select(*[c for c in df.columns], *[c for c in folds.columns if c not in keys])
    return joined.filter(F.col(ts).between(F.col("test_start"), F.col("test_end")))
