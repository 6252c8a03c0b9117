"""Quantile regression by boosted trees."""

from __future__ import annotations

import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsfoundry.operators.metrics import pinball_term
from tsfoundry.operators.models.base import register
from tsfoundry.operators.models.naive import DEFAULT_QUANTILES, quantile_column
from tsfoundry.operators.quantiles import exact_quantiles
from tsfoundry.session import cut_lineage

VECTOR, LEAF, SCORE = "__features", "__leaf", "__score"


class Tree:
    """One boosting step: a fitted tree and the refitted value of each leaf."""

    def __init__(self, model: DecisionTreeRegressionModel, columns: list[str], values: list[float]) -> None:
        self.model, self.columns, self.values = model, columns, values

    def add_to(self, df: DataFrame, score: str, rate: float) -> DataFrame:
        leaf = leaves(df, self.model, self.columns)
        step = F.element_at(F.array(*[F.lit(v) for v in self.values]), F.col(LEAF).cast("int") + 1)
        return leaf.withColumn(score, F.col(score) + rate * step).drop(LEAF)


def leaves(df: DataFrame, model: DecisionTreeRegressionModel, columns: list[str]) -> DataFrame:
    """Add the leaf number of each row."""
    vector = VectorAssembler(inputCols=columns, outputCol=VECTOR).transform(df)
    return model.transform(vector).drop(VECTOR, model.getPredictionCol())


@register("quantile_gbt")
class QuantileGBT:
    """Trees on the pinball gradient; leaves take the exact residual quantile.

    A round costs one tree fit and one exact quantile of the residuals per
    leaf. Scores are checkpointed every ``checkpoint_every`` rounds, so the
    plan does not grow with the rounds. With a validation frame, fitting stops
    once its loss has not improved by ``min_delta`` for ``patience`` rounds.
    """

    def __init__(
        self, features: Sequence[str], target: str = "y", quantiles: Sequence[float] = DEFAULT_QUANTILES,
        rounds: int | dict[float, int] = 50, depth: int = 5, rate: float = 0.1, min_rows: int = 20,
        feature_fraction: float = 1.0, bagging_fraction: float = 1.0, patience: int | None = None,
        min_delta: float = 0.0, seed: int = 42, row_key: Sequence[str] = (), checkpoint_every: int = 5,
        parallelism: int = 4,
    ) -> None:
        self.features, self.target, self.quantiles = list(features), target, tuple(quantiles)
        self.rounds, self.depth, self.rate, self.min_rows = rounds, depth, rate, min_rows
        self.feature_fraction, self.bagging_fraction = feature_fraction, bagging_fraction
        self.patience, self.min_delta, self.seed = patience, min_delta, seed
        self.row_key, self.checkpoint_every, self.parallelism = list(row_key), checkpoint_every, parallelism
        self.base: dict[float, float] = {}
        self.trees: dict[float, list[Tree]] = {}
        self.curve: list[tuple[float, str, int, float]] = []

    def fit(self, df: DataFrame, valid: DataFrame | None = None) -> "QuantileGBT":
        keep = list(dict.fromkeys([*self.row_key, *self.features, self.target]))
        train = df.select(*keep).na.drop(subset=[*self.features, self.target])
        train.persist()
        if valid is not None:
            valid = valid.select(*keep).na.drop(subset=[*self.features, self.target]).persist()
        try:
            # quantiles are independent: their jobs run side by side
            with ThreadPoolExecutor(self.parallelism) as pool:
                list(pool.map(lambda q: self._fit_one(train, valid, q), self.quantiles))
            self.curve.sort()
        finally:
            train.unpersist()
            if valid is not None:
                valid.unpersist()
        return self

    def _rounds(self, q: float) -> int:
        return self.rounds[q] if isinstance(self.rounds, dict) else self.rounds

    def _loss(self, df: DataFrame, q: float) -> float:
        return df.agg(F.avg(pinball_term(F.lit(q), self.target, SCORE))).first()[0]

    def _bag(self, df: DataFrame, q: float, step: int) -> DataFrame:
        """The same rows for the same seed, however they are partitioned."""
        if self.bagging_fraction >= 1.0:
            return df
        key = self.row_key or [*self.features, self.target]
        draw = F.pmod(F.xxhash64(*key, F.lit(self.seed), F.lit(q), F.lit(step)), F.lit(1_000_000))
        return df.filter(draw < int(self.bagging_fraction * 1_000_000))

    def _fit_one(self, train: DataFrame, valid: DataFrame | None, q: float) -> None:
        base = exact_quantiles(train, [], self.target, [q], ["b"]).first()["b"]
        self.base[q], self.trees[q] = base, []
        scored = train.withColumn(SCORE, F.lit(float(base)))
        checked = valid.withColumn(SCORE, F.lit(float(base))) if valid is not None else None
        rng = random.Random(f"{self.seed}-{q}")
        best, best_size, stale = float("inf"), 0, 0
        for step in range(self._rounds(q)):
            size = max(1, round(self.feature_fraction * len(self.features)))
            columns = sorted(rng.sample(self.features, size)) if size < len(self.features) else self.features
            residual = F.col(self.target) - F.col(SCORE)
            work = self._bag(scored, q, step).withColumn("__r", residual).withColumn(
                "__g", F.when(residual > 0, F.lit(q)).otherwise(F.lit(q - 1))
            )
            tree = DecisionTreeRegressor(
                featuresCol=VECTOR, labelCol="__g", leafCol=LEAF, maxDepth=self.depth,
                minInstancesPerNode=self.min_rows, seed=self.seed, predictionCol="__p",
            )
            model = tree.fit(VectorAssembler(inputCols=columns, outputCol=VECTOR).transform(work))
            placed = leaves(work, model, columns)
            rows = exact_quantiles(placed, [LEAF], "__r", [q], ["v"]).collect()  # at most 2^depth leaves
            values = [0.0] * (int(max(r[LEAF] for r in rows)) + 1)
            for r in rows:
                values[int(r[LEAF])] = float(r["v"])
            # a leaf empty in the bag keeps the value 0
            values += [0.0] * (2**self.depth - len(values))
            step_tree = Tree(model, columns, values)
            self.trees[q].append(step_tree)
            scored = step_tree.add_to(scored, SCORE, self.rate)
            if checked is not None:
                checked = step_tree.add_to(checked, SCORE, self.rate)
            if (step + 1) % self.checkpoint_every == 0:
                scored = cut_lineage(scored)
                checked = cut_lineage(checked) if checked is not None else None
            self.curve.append((q, "train", step + 1, self._loss(scored, q)))
            if checked is not None:
                loss = self._loss(checked, q)
                self.curve.append((q, "valid", step + 1, loss))
                if loss < best - self.min_delta:
                    best, best_size, stale = loss, step + 1, 0
                else:
                    stale += 1
                if self.patience and stale >= self.patience:
                    break
        if checked is not None and self.patience:
            self.trees[q] = self.trees[q][:best_size]

    def transform(self, df: DataFrame) -> DataFrame:
        for q in self.quantiles:
            name = quantile_column(q)
            df = df.withColumn(name, F.lit(float(self.base[q])))
            for tree in self.trees[q]:
                df = tree.add_to(df, name, self.rate)
        return df

    def importances(self, q: float) -> dict[str, float]:
        """Mean gain share of each feature over the trees."""
        total = dict.fromkeys(self.features, 0.0)
        for tree in self.trees[q]:
            for c, v in zip(tree.columns, tree.model.featureImportances.toArray()):
                total[c] += float(v)
        count = max(1, len(self.trees[q]))
        return {c: v / count for c, v in total.items()}
