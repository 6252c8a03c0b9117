"""Linear quantile regression with an optional L1 penalty."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsfoundry.operators.linalg import lasso
from tsfoundry.operators.models.base import partition_sums, register
from tsfoundry.operators.models.naive import DEFAULT_QUANTILES, quantile_column
from tsfoundry.session import cut_lineage


class _Fit:
    """One quantile of one model while it is fitted on one group of rows, in standardised columns."""

    def __init__(self, model: "LinearQuantile", q: float, group: int) -> None:
        self.model, self.q, self.group = model, q, group
        self.history: list[float] = []
        self.done = False

    def begin(self, g: np.ndarray, n: float, scale: np.ndarray) -> None:
        k = len(g) - 1
        self.beta = np.linalg.pinv(g[:k, :k]) @ g[:k, k]
        self.spread = np.sqrt(max((g[k, k] - g[:k, k] @ self.beta) / n, 1e-12))
        # the penalty counts coefficients of the unscaled columns
        self.weight = np.concatenate([[0.0], scale[-1] / scale[:-1]]) * self.model.alpha / scale[-1]
        self.best = (np.inf, self.beta)
        self.n = n

    def eps(self, step: int) -> float:
        return self.spread * max(1e-5, 0.3 * 0.6**step)

    def advance(self, step: int, a: np.ndarray, c: np.ndarray, loss: float) -> None:
        """The next coefficients from the weighted sums at the present ones."""
        k, n = len(c), self.n
        loss = loss / n + self.weight @ np.abs(self.beta)
        if loss < self.best[0]:
            self.best = (loss, self.beta)
        if self.model.alpha:
            full = np.zeros((k + 1, k + 1))
            full[:k, :k], full[:k, k], full[k, :k], full[k, k] = a, c, c, n
            scaled = np.where(self.weight > 0, self.weight, 1.0)
            t = np.concatenate([1 / scaled, [1.0]])
            self.beta = lasso(full * np.outer(t, t), n, range(k), k, 1.0, free=[0]) / scaled
        else:
            self.beta = np.linalg.lstsq(a, c, rcond=None)[0]
        self.history.append(self.best[0])
        still = len(self.history) > 5 and self.history[-6] - self.history[-1] <= self.model.tol * self.history[-1]
        self.done = bool(self.eps(step) <= self.spread * 1e-3 and step >= 5 and still)


def fit_together(models: Sequence["LinearQuantile"], groups: Sequence[int], members: Sequence[Column], df: DataFrame) -> None:
    """Fit many models of the same columns at once, model i on the rows of group ``groups[i]``.

    ``members[g]`` tells which rows belong to group g; groups may overlap, and
    rows are not copied for them. One pass per step adds up the sums of all
    models that still move, so there are as many passes as the slowest model
    needs alone, and each model takes the steps that it would take alone.
    """
    features, target = models[0].features, models[0].target
    if any((m.features, m.target) != (features, target) for m in models):
        raise ValueError("models fitted together must have the same columns")
    cols, marks = [*features, target], [f"__in_{g}" for g in range(len(members))]
    k, width = len(features) + 1, len(cols)
    known = df.select(*[F.col(c).cast("double").alias(c) for c in cols], *[m.cast("double").alias(n) for m, n in zip(members, marks)]).na.drop(subset=cols)
    known = cut_lineage(known)

    # one row; deviations are added up stably, so values far from zero keep their digits
    inside = lambda m, c: F.when(F.col(m) > 0, F.col(c))
    stats = known.agg(*[x for m in marks for x in (F.count(inside(m, target)), *[F.avg(inside(m, c)) for c in cols], *[F.stddev_pop(inside(m, c)) for c in cols])]).first()
    per = np.array([np.nan if v is None else v for v in stats], dtype=float).reshape(len(marks), 1 + 2 * width)
    count, mean, scale = per[:, 0], per[:, 1:1 + width], per[:, 1 + width:].copy()
    if any(not count[g] for g in groups):
        raise ValueError("no row without nulls to fit on")
    scale[(scale == 0) | np.isnan(scale)] = 1.0

    def standard(x: np.ndarray, g: int) -> np.ndarray:
        own = x[x[:, width + g] > 0, :width]
        z = (own - mean[g]) / scale[g]
        return np.column_stack([np.ones(len(z)), z])

    used = sorted(set(groups))

    def plain(x: np.ndarray) -> np.ndarray:
        return np.concatenate([(z.T @ z).ravel() for z in (standard(x, g) for g in used)])

    grams = partition_sums(known, [*cols, *marks], plain).reshape(len(used), k + 1, k + 1)
    fits = [_Fit(m, q, g) for m, g in zip(models, groups) for q in m.quantiles]
    for f in fits:
        f.begin(grams[used.index(f.group)], count[f.group], scale[f.group])

    step = 0
    while moving := [f for f in fits if not f.done and (f.model.steps is None or step <= f.model.steps)]:
        blocks = []  # models of one group share the pass over its rows
        for g in used:
            own = [f for f in moving if f.group == g]
            if own:
                blocks.append((g, np.array([f.beta for f in own]).T, np.array([f.eps(step) for f in own]), np.array([f.q for f in own])))
        order = [f for g in used for f in moving if f.group == g]

        def work(x: np.ndarray) -> np.ndarray:
            out = []
            for g, beta, eps, q in blocks:
                z = standard(x, g)
                xs, y = z[:, :k], z[:, k, None]
                products = (xs[:, :, None] * xs[:, None, :]).reshape(len(xs), k * k)
                r = y - xs @ beta
                w = 0.5 / (eps + np.abs(r))
                c = (w * y).T @ xs + (q - 0.5)[:, None] * xs.sum(0)
                loss = np.maximum(q * r, (q - 1) * r).sum(0)
                out.append(np.column_stack([w.T @ products, c, loss]).ravel())
            return np.concatenate(out)

        sums = partition_sums(known, [*cols, *marks], work).reshape(len(order), k * k + k + 1)
        for f, s in zip(order, sums):
            f.advance(step, s[: k * k].reshape(k, k), s[k * k: k * k + k], s[-1])
        step += 1
    if any(not f.done for f in fits):
        warnings.warn(f"the losses still fall after {step - 1} steps", stacklevel=3)

    for f in fits:
        loss, b = f.best
        s, m = scale[f.group], mean[f.group]
        slope = b[1:] * s[-1] / s[:-1]
        f.model.coef[f.q] = np.concatenate([[m[-1] + b[0] * s[-1] - slope @ m[:-1]], slope])
        f.model.loss[f.q] = float(loss * s[-1])


@register("quantile_regression")
class LinearQuantile:
    """Minimises mean pinball loss + ``alpha`` * L1 of the coefficients per quantile.

    The absolute value in the loss is majorised by a parabola around the
    current residual, so every step is a weighted least-squares problem. One
    pass over the data gives the weighted Gram matrices of all quantiles; the
    k x k systems are solved on the driver. The smoothing width shrinks with
    the steps, and the best coefficients seen so far are kept. A quantile is
    done when five steps at a small width lower its loss by no more than
    ``tol`` of it. ``steps``, if given, ends the fit before that, with a warning.
    """

    def __init__(
        self, features: Sequence[str], target: str = "y", alpha: float = 0.0,
        quantiles: Sequence[float] = DEFAULT_QUANTILES, steps: int | None = None, tol: float = 1e-4,
    ) -> None:
        self.features, self.target, self.alpha = list(features), target, alpha
        self.quantiles, self.steps, self.tol = tuple(quantiles), steps, tol
        self.coef: dict[float, np.ndarray] = {}
        self.loss: dict[float, float] = {}

    def fit(self, df: DataFrame) -> "LinearQuantile":
        fit_together([self], [0], [F.lit(True)], df)
        return self

    #: Fits many models in shared passes; other models are fitted one by one.
    fit_together = staticmethod(fit_together)

    def state(self) -> dict:
        fitted = [[q, [float(x) for x in self.coef[q]], self.loss[q]] for q in self.coef]
        return {"features": self.features, "target": self.target, "alpha": self.alpha, "quantiles": self.quantiles,
                "steps": self.steps, "tol": self.tol, "fitted": fitted}

    @classmethod
    def from_state(cls, state: dict) -> "LinearQuantile":
        options = {k: v for k, v in state.items() if k != "fitted"}
        model = cls(**options)
        for q, coef, loss in state["fitted"]:
            model.coef[q], model.loss[q] = np.array(coef), loss
        return model

    def expression(self, q: float):
        """The fitted quantile as a column expression."""
        b = self.coef[q]
        out = F.lit(float(b[0]))
        for c, w in zip(self.features, b[1:]):
            out = out + F.col(c) * float(w)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[self.expression(q).alias(quantile_column(q)) for q in self.quantiles])

    def importances(self, q: float) -> dict[str, float]:
        return {c: abs(float(w)) for c, w in zip(self.features, self.coef[q][1:])}
