"""Attaching a small table to many rows without a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = "__salt"
SALTS = 32
INTEGRAL = ("bigint", "int", "smallint", "timestamp_ntz", "timestamp", "date", "string")


def attach(
    df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", spread: Sequence[str] = ()
) -> DataFrame:
    """Join ``small``, a few rows per key, onto ``df``.

    One key may hold a large share of ``df``. Its rows are spread over a fixed
    number of salts, derived from columns that do not change when a task is
    run again (all columns where none is integral), and ``small`` is repeated for each salt. Where ``small`` turns
    out to be small enough, adaptive execution still broadcasts it. Without
    keys ``small`` must be exactly one row.
    """
    if not keys:
        return df.crossJoin(F.broadcast(small))
    stable = list(spread) or [c for c, t in df.dtypes if c not in keys and t in INTEGRAL][:2]
    stable = stable or [c for c, t in df.dtypes if c not in keys and "map<" not in t and t != "variant"]
    if not stable:
        return df.join(small, list(keys), how)
    salted = small.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(SALT))
    salt = F.pmod(F.xxhash64(*stable), F.lit(SALTS)).cast("int")
    return df.withColumn(SALT, salt).join(salted, [*keys, SALT], how).drop(SALT)
