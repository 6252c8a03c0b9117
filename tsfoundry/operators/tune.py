"""Hyperparameter search, importances and training tables."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsfoundry.operators.chunking import row_numbers
from tsfoundry.operators.metrics import pinball_term, point_errors
from tsfoundry.operators.models.naive import quantile_column
from tsfoundry.operators.split import TESTS_IN, TRAINS_FROM, fold_rows
from tsfoundry.session import cut_lineage


def sample_space(space: dict[str, dict], rng: random.Random) -> dict:
    """One draw per parameter: ``int``, ``float`` (optionally ``log``) or ``categorical``."""
    out = {}
    for name, s in space.items():
        if s["type"] == "categorical":
            out[name] = rng.choice(s["choices"])
        elif s["type"] == "int":
            out[name] = rng.randint(s["low"], s["high"])
        elif s.get("log"):
            out[name] = math.exp(rng.uniform(math.log(s["low"]), math.log(s["high"])))
        else:
            out[name] = rng.uniform(s["low"], s["high"])
    return out


def tune(
    make_model: Callable[[dict], object], space: dict[str, dict], df: DataFrame, keys: Sequence[str], idx: str,
    n_trials: int, n_splits: int, test_size: int, seed: int = 42, target: str = "y",
    scored_rows: Column | None = None, parallelism: int = 4,
) -> DataFrame:
    """Random search: (trial, params, fold, loss), pinball loss of the median.

    Splits are expanding; ``scored_rows`` limits the rows that count. A row
    says in which folds it trains and in which it tests, so it is not copied.
    Models that can be fitted together share their passes over all trials and
    folds, and one more pass scores them all; others are fitted one by one.
    """
    rng = random.Random(seed)
    trials = [sample_space(space, rng) for _ in range(n_trials)]
    rows = cut_lineage(fold_rows(df, keys, idx, n_splits, test_size))
    members = [F.col(TRAINS_FROM) <= f for f in range(n_splits)]
    scored = scored_rows if scored_rows is not None else F.lit(True)
    jobs = [(t, f) for t in range(n_trials) for f in range(n_splits)]
    models = [make_model(trials[t]) for t, _ in jobs]

    def loss_of(model, fold: int) -> Column:
        term = pinball_term(F.lit(0.5), target, quantile_column(0.5))
        return F.avg(F.when((F.col(TESTS_IN) == fold) & scored, term))

    together = getattr(type(models[0]), "fit_together", None) if models else None
    if together is not None:
        together(models, [f for _, f in jobs], members, rows)
        terms = []
        for model, (_, fold) in zip(models, jobs):
            e = F.col(target) - model.expression(0.5)
            terms.append(F.avg(F.when((F.col(TESTS_IN) == fold) & scored, F.greatest(0.5 * e, -0.5 * e))))
        losses = list(rows.agg(*terms).first()) if terms else []
    else:
        def one(i: int) -> float:
            fold = jobs[i][1]
            model = models[i].fit(rows.filter(members[fold]))
            return model.transform(rows.filter(F.col(TESTS_IN) == fold)).agg(loss_of(model, fold)).first()[0]

        with ThreadPoolExecutor(parallelism) as pool:
            losses = list(pool.map(one, range(len(jobs))))
    out = [(t, json.dumps(trials[t], sort_keys=True), f, loss) for (t, f), loss in zip(jobs, losses)]
    return df.sparkSession.createDataFrame(out, "trial int, params string, fold int, loss double")


def trial_summary(trials: DataFrame) -> DataFrame:
    return trials.groupBy("trial", "params").agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("folds"))


def best_params(trials: DataFrame, direction: str = "minimize") -> dict:
    sign = {"minimize": 1, "maximize": -1}[direction]
    row = trial_summary(trials).agg(F.min_by("params", F.struct(sign * F.col("loss"), "trial"))).first()
    return json.loads(row[0])


def gain_importance(
    make_model: Callable[[list[str], int], object], df: DataFrame, features: Sequence[str], num_models: int,
    q: float = 0.5, subset_fraction: float = 1.0, mandatory: Sequence[str] = (), seed: int = 42,
    parallelism: int = 4, valid: DataFrame | None = None,
) -> DataFrame:
    """(model, feature, importance) over seeded models, each optionally on a subset.

    ``mandatory`` features belong to every subset. Models stop early on ``valid``, if given.
    """
    free = [f for f in features if f not in mandatory]

    def one(i: int) -> list[tuple[str, str, float]]:
        rng = random.Random(seed + i)
        size = round(subset_fraction * len(free))
        chosen = [*mandatory, *sorted(rng.sample(free, size))]
        model = make_model(chosen, seed + i)
        model = model.fit(df) if valid is None else model.fit(df, valid)
        return [(f"model_{i}", f, v) for f, v in model.importances(q).items()]

    with ThreadPoolExecutor(parallelism) as pool:
        rows = [r for part in pool.map(one, range(num_models)) for r in part]
    return df.sparkSession.createDataFrame(rows, "model string, feature string, importance double")


def permutation_importance(
    model, df: DataFrame, keys: Sequence[str], idx: str, features: Sequence[str], target: str = "y",
    q: float = 0.5, seed: int = 42,
) -> DataFrame:
    """(feature, loss, base_loss, importance): pinball loss once a feature is shuffled.

    Row p takes the feature value of the row at place p in a hash order; both
    places come from chunked counts, so no task sees all rows.
    """
    name = quantile_column(q)
    term = pinball_term(F.lit(q), target, name)
    rows = df.select(*keys, idx, *features, target)
    buckets = 4096

    def places(f: DataFrame, order: Column, out: str) -> DataFrame:
        # spread the hash range over a fixed number of chunks
        h = F.pmod(order, F.lit(2**31))
        ordered = f.withColumn("__h", h)
        return row_numbers(ordered, [], "__h", [*keys, idx], out=out, chunk=2**31 // buckets).drop("__h")

    here = places(rows, F.xxhash64(*keys, idx, F.lit("place")), "__p")
    base = model.transform(rows).agg(F.avg(term)).first()[0]
    parts = None
    for f in features:
        donors = places(rows.select(*keys, idx, f), F.xxhash64(*keys, idx, F.lit(f), F.lit(seed)), "__p")
        mixed = here.drop(f).join(donors.select("__p", f), "__p")
        loss = model.transform(mixed).agg(F.avg(term).alias("loss")).select(F.lit(f).alias("feature"), "loss")
        parts = loss if parts is None else parts.unionByName(loss)
    return parts.select("feature", "loss", F.lit(base).alias("base_loss"), (F.col("loss") - base).alias("importance"))


def forest_importance(
    df: DataFrame, target: str, features: Sequence[str], trees: int = 100, depth: int = 8, seed: int = 42
) -> DataFrame:
    vector = VectorAssembler(inputCols=list(features), outputCol="__features").transform(
        df.na.drop(subset=[*features, target])
    )
    forest = RandomForestRegressor(
        featuresCol="__features", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed
    ).fit(vector)
    rows = [(f, float(v)) for f, v in zip(features, forest.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def training_info(
    model_name: str, model, train: DataFrame, features: Sequence[str], quantiles: Sequence[float],
    target: str = "y", params: dict | None = None,
) -> DataFrame:
    """One row per quantile: shape, metrics, target summary, importances, parameters."""
    scored = model.transform(train.na.drop(subset=[*features, target]))
    parts = None
    for q in quantiles:
        c = quantile_column(q)
        info = point_errors(scored, [], target, c).crossJoin(  # one row each
            scored.agg(
                F.count(F.lit(1)).alias("rows"), F.avg(pinball_term(F.lit(q), target, c)).alias("pinball"),
                F.avg(target).alias("target_mean"), F.stddev_samp(target).alias("target_std"),
                F.min(target).alias("target_min"), F.max(target).alias("target_max"),
            )
        )
        weights = F.create_map(*[x for f, v in model.importances(q).items() for x in (F.lit(f), F.lit(v))])
        row = info.select(
            F.lit(model_name).alias("model"), F.lit(q).alias("q"), "rows", F.lit(len(features)).alias("features"),
            "pinball", "mae", "rmse", "mape", "target_mean", "target_std", "target_min", "target_max",
            weights.alias("importances"), F.lit(json.dumps(params or {}, sort_keys=True)).alias("params"),
        )
        parts = row if parts is None else parts.unionByName(row)
    return parts


def training_summary(info: DataFrame) -> DataFrame:
    return info.select("model", "q", "rows", "features", "pinball", "mae", "rmse", "mape").orderBy("model", "q")


def loss_curve(spark: SparkSession, model_name: str, curve: Sequence[tuple[float, str, int, float]]) -> DataFrame:
    rows = [(model_name, q, split, step, float(loss)) for q, split, step, loss in curve]
    return spark.createDataFrame(rows, "model string, q double, split string, round int, loss double")
