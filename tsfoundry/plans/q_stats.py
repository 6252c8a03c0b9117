"""Statistical tests and exploratory statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsfoundry.functions import time as tm
from tsfoundry.operators import hypothesis as hy
from tsfoundry.operators import metrics, neighbours, spectral
from tsfoundry.operators.linalg import finish, gram, lasso
from tsfoundry.operators.models.naive import seasonal_quantiles
from tsfoundry.plans.panels import DAILY_EXOG, HOURLY, KEY, daily, daily_exog, hourly, table
from tsfoundry.plans.q_metrics import COLS, FCB, HI, LO, MED, QS, _JOIN, _pit_sql, compared
from tsfoundry.plans.q_windows import _ACF
from tsfoundry.plans.registry import ORACLES, query, rnd

X = ["qty", "disc", "tax"]

#: Position on the time axis and trend residuals of the hourly panel.
TREND = f"""WITH {HOURLY},
tt AS (SELECT series_id, ts, y, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS DOUBLE) AS t,
 count(*) OVER (PARTITION BY series_id) AS n FROM hourly),
ab AS (SELECT series_id, regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM tt GROUP BY 1),
tr AS (SELECT tt.*, a + b * t AS fitted, y - (a + b * t) AS r FROM tt JOIN ab ON ab.series_id = tt.series_id)"""


def det_sql(rows: list[list[str]]) -> str:
    """Determinant of a matrix of SQL expressions, expanded along the first row."""
    if len(rows) == 1:
        return f"({rows[0][0]})"
    parts = [f"{'-' if j % 2 else '+'} ({c}) * {det_sql([[*r[:j], *r[j + 1:]] for r in rows[1:]])}" for j, c in enumerate(rows[0])]
    return "(" + " ".join(parts) + ")"


def _least_squares_sql(source: str, by: str, name: str, xs: list[str]) -> str:
    """CTEs ``{name}``: by, n, means, inverse cross products ``i_ab``, coefficients ``b_a`` and ``ssr`` of y on ``xs`` and a constant."""
    k = len(xs)
    cells = {(a, b): f"s_{min(a, b)}{max(a, b)}" for a in range(k) for b in range(k)}
    products = [f"regr_sxx({xs[a]}, {xs[a]}) AS s_{a}{a}" if a == b else f"covar_pop({xs[a]}, {xs[b]}) * count(*) AS s_{a}{b}" for a in range(k) for b in range(a, k)]
    toward = [f"covar_pop({x}, y) * count(*) AS c_{a}" for a, x in enumerate(xs)]
    whole = det_sql([[cells[a, b] for b in range(k)] for a in range(k)])

    def cofactor(a: int, b: int) -> str:
        minor = [[cells[r, c] for c in range(k) if c != b] for r in range(k) if r != a]
        return f"{'-' if (a + b) % 2 else ''}{det_sql(minor) if minor else '1.0'}"

    inverse = ", ".join(f"{cofactor(a, b)} / {whole} AS i_{a}{b}" for a in range(k) for b in range(k))
    slopes = ", ".join(" + ".join(f"i_{a}{b} * c_{b}" for b in range(k)) + f" AS b_{a}" for a in range(k))
    return f"""
{name}_s AS (SELECT {by}, CAST(count(*) AS DOUBLE) AS n, avg(y) AS m_y, {", ".join(f"avg({x}) AS m_{a}" for a, x in enumerate(xs))},
 var_pop(y) * count(*) AS s_yy, {", ".join(products)}, {", ".join(toward)} FROM {source} GROUP BY {by}),
{name}_i AS (SELECT *, {inverse} FROM {name}_s),
{name}_b AS (SELECT *, {slopes} FROM {name}_i),
{name} AS (SELECT *, s_yy - ({" + ".join(f"b_{a} * c_{a}" for a in range(k))}) AS ssr FROM {name}_b)"""


def _sp(df, digits=6, keep=("series_id",)):
    return df.select(*keep, rnd("statistic", digits).alias("statistic"), rnd("p_value", digits).alias("p_value"))


@query("adf_test")
def adf_test(spark, sf):
    panel = hourly(spark, sf)
    parts = [hy.adf(panel, KEY, "idx", "y", d).select(F.lit(d).alias("diff"), "series_id", "lags", "statistic", "p_value") for d in (0, 1)]
    return parts[0].unionByName(parts[1])


_KPSS = _ACF.replace("generate_series(0, 48)", "generate_series(0, 120)") + """,
n AS (SELECT series_id, count(*) AS n FROM hourly GROUP BY 1),
g AS (SELECT p.series_id, CAST(lag AS INTEGER) AS lag, s, n.n FROM p JOIN n ON n.series_id = p.series_id),
sh AS (SELECT series_id, any_value(n) AS n,
 sum(CASE WHEN lag = 0 THEN s / n WHEN lag <= floor(pow(n, 2 / 9.0)) THEN s / (n / 2.0) ELSE 0 END) AS s0,
 sum(CASE WHEN lag > 0 AND lag <= floor(pow(n, 2 / 9.0)) THEN lag * s / (n / 2.0) ELSE 0 END) AS s1 FROM g GROUP BY 1),
bw AS (SELECT series_id, n, CAST(floor(1.1447 * pow(pow(s1 / s0, 2), 1 / 3.0) * pow(n, 1 / 3.0)) AS INTEGER) AS lags FROM sh),
lv AS (SELECT g.series_id, any_value(bw.lags) AS lags, sum(CASE WHEN lag = 0 THEN s WHEN lag <= bw.lags THEN 2 * s * (1 - lag / CAST(bw.lags + 1 AS DOUBLE)) ELSE 0 END) / any_value(g.n) AS s_hat
 FROM g JOIN bw ON bw.series_id = g.series_id GROUP BY 1),
cs AS (SELECT series_id, sum(x) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c FROM d),
eta AS (SELECT cs.series_id, sum(c * c) / pow(count(*), 2) AS eta FROM cs GROUP BY 1)
SELECT lv.series_id, lags, round(eta / s_hat, 7) + 0.0 AS statistic FROM lv JOIN eta ON eta.series_id = lv.series_id"""


@query("kpss_test", sql=_KPSS)
def kpss_test(spark, sf):
    out = hy.kpss(hourly(spark, sf), KEY, "idx", "y")
    return out.select("series_id", "lags", rnd("statistic", 7).alias("statistic"))


@query("ljung_box", sql=_ACF + """, n AS (SELECT series_id, count(*) AS n FROM hourly GROUP BY 1)
SELECT acf.series_id, CAST(k.lags AS INTEGER) AS lags, round(any_value(n * (n + 2)) * sum(r * r / (n - lag)), 6) + 0.0 AS statistic
FROM acf JOIN n ON n.series_id = acf.series_id JOIN (SELECT unnest([10, 20, 24]) AS lags) k ON lag BETWEEN 1 AND k.lags GROUP BY 1, 2""")
def ljung_box(spark, sf):
    return hy.ljung_box(hourly(spark, sf), KEY, "idx", "y", [10, 20, 24]).select("series_id", "lags", rnd("statistic").alias("statistic"))


#: Upper tail of a chi-squared law with an even number of degrees of freedom.
_CHI2_EVEN = "exp(-s / 2) * list_sum(list_transform(range(0, lags // 2), lambda i: pow(s / 2, i) / gamma(i + 1.0)))"


@query("ljung_box_p_values", sql=_ACF + f""", n AS (SELECT series_id, count(*) AS n FROM hourly GROUP BY 1),
q AS (SELECT acf.series_id, k.lags, any_value(n * (n + 2)) * sum(r * r / (n - lag)) AS s
FROM acf JOIN n ON n.series_id = acf.series_id JOIN (SELECT unnest([10, 20, 24]) AS lags) k ON lag BETWEEN 1 AND k.lags GROUP BY 1, 2)
SELECT series_id, CAST(lags AS INTEGER) AS lags, round({_CHI2_EVEN}, 8) + 0.0 AS p_value FROM q""")
def ljung_box_p_values(spark, sf):
    out = hy.ljung_box(hourly(spark, sf), KEY, "idx", "y", [10, 20, 24])
    return out.select("series_id", "lags", rnd("p_value", 8).alias("p_value"))


@query("pacf", sql=_ACF.replace("WITH ", "WITH RECURSIVE ", 1) + """, n AS (SELECT series_id, count(*) AS n FROM hourly GROUP BY 1),
gg AS (SELECT p.series_id, list(s / (n.n - lag) ORDER BY lag) AS g FROM p JOIN n ON n.series_id = p.series_id GROUP BY 1),
dl(series_id, k, a, phi, v, g) AS (
 SELECT series_id, 0, 1.0::DOUBLE, []::DOUBLE[], g[1], g FROM gg UNION ALL
 SELECT series_id, k + 1, na, list_concat(list_transform(range(1, k + 1), lambda i: phi[i] - na * phi[k + 1 - i]), [na]), v * (1 - na * na), g
 FROM (SELECT *, (g[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * g[k + 2 - i])), 0)) / v AS na FROM dl WHERE k < 48))
SELECT series_id, CAST(k AS INTEGER) AS lag, round(a, 8) + 0.0 AS pacf FROM dl""")
def pacf(spark, sf):
    return hy.pacf(hourly(spark, sf), KEY, "idx", "y", 48).select("series_id", "lag", rnd("pacf", 8).alias("pacf"))


_MOM = f"""WITH {HOURLY}, m AS (SELECT series_id, avg(y) AS m FROM hourly GROUP BY 1),
s AS (SELECT h.series_id, CAST(count(*) AS DOUBLE) AS n, avg(pow(y - m, 2)) AS m2, avg(pow(y - m, 3)) AS m3, avg(pow(y - m, 4)) AS m4 FROM hourly h JOIN m ON m.series_id = h.series_id GROUP BY 1),
k AS (SELECT series_id, n, m3 / pow(m2, 1.5) AS sk, m4 / (m2 * m2) - 3 AS ku FROM s)"""


@query("jarque_bera", sql=_MOM + " SELECT series_id, round(n / 6 * (sk * sk + ku * ku / 4), 6) + 0.0 AS statistic, round(exp(-n / 12 * (sk * sk + ku * ku / 4)), 9) + 0.0 AS p_value FROM k")
def jarque_bera(spark, sf):
    out = hy.jarque_bera(hourly(spark, sf), KEY, "y")
    return out.select("series_id", rnd("statistic").alias("statistic"), rnd("p_value", 9).alias("p_value"))


@query("dagostino_k2", sql=_MOM + """,
a AS (SELECT *, sk * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2,
 (ku + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rt FROM k),
b AS (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, 6 + 8 / rt * (2 / rt + sqrt(1 + 4 / (rt * rt))) AS aa FROM a),
c AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs,
 (1 - 2 / (9 * aa) - cbrt((1 - 2 / aa) / (1 + x * sqrt(2 / (aa - 4))))) / sqrt(2 / (9 * aa)) AS zk FROM b)
SELECT series_id, round(zs, 7) + 0.0 AS z_skew, round(zk, 7) + 0.0 AS z_kurt, round(zs * zs + zk * zk, 6) + 0.0 AS statistic FROM c""")
def dagostino_k2(spark, sf):
    out = hy.dagostino_k2(hourly(spark, sf), KEY, "y")
    return out.select("series_id", rnd("z_skew", 7).alias("z_skew"), rnd("z_kurt", 7).alias("z_kurt"), rnd("statistic").alias("statistic"))


def _tail_sql(a: str) -> str:
    """Normal tail beyond a >= 0: a power series near the middle, a continued fraction further out."""
    bell = f"exp(-({a}) * ({a}) / 2) / sqrt(2 * pi())"
    series = f"list_reduce(range(60, 0, -1)::DOUBLE[], lambda s, j: 1 + s * ({a}) * ({a}) / (2 * j + 1), 1.0::DOUBLE)"
    fraction = f"list_reduce(range(60, 0, -1)::DOUBLE[], lambda s, j: ({a}) + j / s, ({a})::DOUBLE)"
    return f"CASE WHEN ({a}) < 3.5 THEN 0.5 - {bell} * ({a}) * {series} ELSE {bell} / {fraction} END"


def _cdf_sql(z: str) -> str:
    return f"CASE WHEN ({z}) < 0 THEN {_tail_sql(f'-({z})')} ELSE 1 - ({_tail_sql(z)}) END"


def _quantile_sql(p: str) -> str:
    """Normal quantile by halving steps."""
    return f"list_reduce(list_transform(range(1, 50), lambda k: pow(2.0, 4 - k))::DOUBLE[], lambda x, h: CASE WHEN ({_cdf_sql('x + h')}) < ({p}) THEN x + h ELSE x END, -8.0::DOUBLE)"


@query("anderson_darling", sql=f"""WITH {HOURLY},
z AS (SELECT series_id, (y - avg(y) OVER g) / stddev_samp(y) OVER g AS z, row_number() OVER (PARTITION BY series_id ORDER BY y, ts) AS i, CAST(count(*) OVER g AS DOUBLE) AS n
 FROM hourly WINDOW g AS (PARTITION BY series_id)),
t AS (SELECT series_id, i, n, z, {_tail_sql("abs(z)")} AS tail FROM z),
l AS (SELECT *, ln(CASE WHEN z < 0 THEN tail ELSE 1 - tail END) AS low, ln(CASE WHEN z < 0 THEN 1 - tail ELSE tail END) AS high FROM t)
SELECT series_id, round(-n - sum((2 * i - 1) * low + (2 * (n - i) + 1) * high) / n, 6) + 0.0 AS statistic, round(0.787 / (1 + 4 / n - 25 / n / n), 3) + 0.0 AS critical_5 FROM l GROUP BY series_id, n""")
def anderson_darling(spark, sf):
    """The statistic and its critical value at five percent."""
    out = hy.anderson_darling(hourly(spark, sf), KEY, "y")
    return out.select("series_id", rnd("statistic").alias("statistic"), rnd(F.col("critical_values")[2], 3).alias("critical_5"))


def _horner_sql(x: str, coefficients: list[float]) -> str:
    out = str(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out}) * {x} + ({c})"
    return f"({out})"


@query("shapiro_wilk", sql=f"""WITH {HOURLY},
k AS (SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY y, ts) AS i, CAST(count(*) OVER (PARTITION BY series_id) AS DOUBLE) AS n FROM hourly),
m AS (SELECT *, {_quantile_sql("(i - 0.375) / (n + 0.25)")} AS m FROM k),
s AS (SELECT series_id, n, sum(m * m) AS mm, max(m) AS m0, max(CASE WHEN i = n - 1 THEN m END) AS m1, var_samp(y) * (n - 1) AS ss, 1 / sqrt(n) AS u, ln(n) AS ln_n FROM m GROUP BY 1, 2),
a AS (SELECT *, {_horner_sql("u", [*hy._ROYSTON_AN, 0.0])} + m0 / sqrt(mm) AS a0, {_horner_sql("u", [*hy._ROYSTON_AN1, 0.0])} + m1 / sqrt(mm) AS a1 FROM s),
f AS (SELECT *, sqrt((mm - 2 * m0 * m0 - 2 * m1 * m1) / (1 - 2 * a0 * a0 - 2 * a1 * a1)) AS phi FROM a),
w AS (SELECT m.series_id, m.n, any_value(f.ln_n) AS ln_n,
 pow(sum(y * CASE WHEN i = m.n THEN a0 WHEN i = 1 THEN -a0 WHEN i = m.n - 1 THEN a1 WHEN i = 2 THEN -a1 ELSE m.m / phi END), 2) / any_value(ss) AS w
 FROM m JOIN f ON f.series_id = m.series_id GROUP BY 1, 2),
z AS (SELECT series_id, n, w, (ln(1 - w) - {_horner_sql("ln_n", hy._ROYSTON_MU)}) / exp({_horner_sql("ln_n", hy._ROYSTON_SIGMA)}) AS z FROM w)
SELECT series_id, CAST(n AS BIGINT) AS n, round(w, 7) + 0.0 AS statistic, round(1 - ({_cdf_sql("z")}), 9) + 0.0 AS p_value FROM z""")
def shapiro_wilk(spark, sf):
    out = hy.shapiro_wilk(hourly(spark, sf), KEY, "y")
    return out.select("series_id", "n", rnd("statistic", 7).alias("statistic"), rnd("p_value", 9).alias("p_value"))


@query("qq_points", sql=TREND + f""", k AS (SELECT series_id, r, row_number() OVER (PARTITION BY series_id ORDER BY r) AS rank, count(*) OVER (PARTITION BY series_id) AS n FROM tr)
SELECT series_id, rank, round({_quantile_sql("(rank - 0.5) / n")}, 6) + 0.0 AS theoretical, round(r, 6) + 0.0 AS sample FROM k""")
def qq_points(spark, sf):
    d = hy.trend_residuals(hourly(spark, sf), KEY, "idx", "y")
    return hy.qq_points(d, KEY, "r").select("series_id", "rank", rnd("theoretical").alias("theoretical"), rnd("sample").alias("sample"))


@query("breusch_pagan", sql=TREND + " SELECT series_id, round(count(*) * regr_r2(r * r, t), 6) + 0.0 AS statistic FROM tr GROUP BY 1")
def breusch_pagan(spark, sf):
    return hy.breusch_pagan(hourly(spark, sf), KEY, "idx", "y").select("series_id", rnd("statistic").alias("statistic"))


@query("goldfeld_quandt", sql=TREND + """,
h AS (SELECT series_id, t >= n // 2 AS late, count(*) AS k, sum(y * y) AS yy, sum(t * y) AS ty, sum(t * t) AS tt FROM tr GROUP BY 1, 2),
m AS (SELECT series_id, late, (yy - ty * ty / tt) / (k - 1) AS mse FROM h)
SELECT series_id, round(max(mse) FILTER (late) / max(mse) FILTER (NOT late), 8) + 0.0 AS statistic FROM m GROUP BY 1""")
def goldfeld_quandt(spark, sf):
    return hy.goldfeld_quandt(hourly(spark, sf), KEY, "idx", "y").select("series_id", rnd("statistic", 8).alias("statistic"))


@query("arch_lm")
def arch_lm(spark, sf):
    return hy.arch_lm(hourly(spark, sf), KEY, "idx", "y")


@query("squared_residuals", sql=TREND + " SELECT series_id, ts, round(r * r, 5) + 0.0 AS r2 FROM tr")
def squared_residuals(spark, sf):
    d = hy.trend_residuals(hourly(spark, sf), KEY, "idx", "y")
    return d.select("series_id", "ts", rnd(F.col("r") * F.col("r"), 5).alias("r2"))


@query("fitted_residuals", sql=TREND + " SELECT series_id, ts, round(fitted, 7) + 0.0 AS fitted, round(r, 7) + 0.0 AS resid FROM tr")
def fitted_residuals(spark, sf):
    d = hy.trend_residuals(hourly(spark, sf), KEY, "idx", "y")
    return d.select("series_id", "ts", rnd("fitted", 7).alias("fitted"), rnd("r", 7).alias("resid"))


_VIF = ["y", *X]
_VIF_CELLS = [[f"s_{min(a, b)}{max(a, b)}" for b in range(4)] for a in range(4)]


@query("vif", sql=f"""WITH {DAILY_EXOG},
s AS (SELECT series_id, {", ".join(f"sum({_VIF[a]} * {_VIF[b]}) AS s_{a}{b}" for a in range(4) for b in range(a, 4))} FROM daily_exog GROUP BY 1),
d AS (SELECT *, {det_sql(_VIF_CELLS)} AS whole FROM s)
""" + " UNION ALL ".join(
    f"SELECT series_id, '{c}' AS feature, round(ln(s_{a}{a} * {det_sql([[x for j, x in enumerate(r) if j != a] for i, r in enumerate(_VIF_CELLS) if i != a])} / whole), 5) + 0.0 AS log_vif FROM d"
    for a, c in enumerate(_VIF)))
def vif(spark, sf):
    out = hy.vif(daily_exog(spark, sf), KEY, _VIF)
    return out.select("series_id", "feature", rnd(F.log("vif"), 5).alias("log_vif"))


@query("chow_test", sql=f"""WITH {DAILY_EXOG},
h AS (SELECT *, (row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 >= count(*) OVER (PARTITION BY series_id) // 2)::INTEGER AS half FROM daily_exog),
{_least_squares_sql("daily_exog", "series_id", "w", X)},{_least_squares_sql("h", "series_id, half", "p", X)},
t AS (SELECT series_id, sum(ssr) AS free FROM p GROUP BY 1)
SELECT w.series_id, round((ssr - free) / 4 / (free / (n - 8)), 6) + 0.0 AS statistic FROM w JOIN t ON t.series_id = w.series_id""")
def chow_test(spark, sf):
    return hy.chow(daily_exog(spark, sf), KEY, "idx", "y", X).select("series_id", rnd("statistic").alias("statistic"))


@query("granger_causality")
def granger_causality(spark, sf):
    return hy.granger(daily_exog(spark, sf), KEY, "idx", "y", ["qty", "disc"], 24)


@query("johansen")
def johansen(spark, sf):
    return hy.johansen(daily_exog(spark, sf), KEY, "idx", ["y", "qty", "disc"])


@query("ols_summary", sql=f"""WITH {DAILY_EXOG},
s AS (SELECT series_id, CAST(count(*) AS DOUBLE) AS n, regr_slope(y, qty) AS b, regr_intercept(y, qty) AS a, regr_r2(y, qty) AS r2,
 regr_sxx(y, qty) AS sxx, regr_syy(y, qty) AS syy, avg(qty) AS mx FROM daily_exog GROUP BY 1),
v AS (SELECT *, syy * (1 - r2) / (n - 2) AS s2 FROM s)
SELECT series_id, 'qty' AS term, round(b, 7) + 0.0 AS coef, round(sqrt(s2 / sxx), 7) + 0.0 AS se, round(b / sqrt(s2 / sxx), 4) + 0.0 AS t, round(r2, 7) + 0.0 AS r2, CAST(n AS BIGINT) AS n FROM v
UNION ALL SELECT series_id, 'const', round(a, 6) + 0.0, round(sqrt(s2 * (1 / n + mx * mx / sxx)), 6) + 0.0, round(a / sqrt(s2 * (1 / n + mx * mx / sxx)), 4) + 0.0, round(r2, 7) + 0.0, CAST(n AS BIGINT) FROM v""")
def ols_summary(spark, sf):
    out = hy.ols_summary(daily_exog(spark, sf), KEY, "y", ["qty"])
    both = [F.when(F.col("term") == "qty", rnd(c, 7)).otherwise(rnd(c, 6)).alias(c) for c in ("coef", "se")]
    return out.select("series_id", "term", *both, rnd("t", 4).alias("t"), rnd("r2", 7).alias("r2"), "n")


_CONST = " + ".join(f"m_{a} * i_{a}{b} * m_{b}" for a in range(3) for b in range(3))


@query("ols_multiple", sql=f"""WITH {DAILY_EXOG},{_least_squares_sql("daily_exog", "series_id", "w", X)},
r AS (SELECT *, ssr / (n - 4) AS s2, 1 - ssr / s_yy AS r2 FROM w),
l AS ({" UNION ALL ".join(f"SELECT series_id, '{c}' AS term, b_{a} AS coef, sqrt(s2 * i_{a}{a}) AS se, r2, n FROM r" for a, c in enumerate(X))}
 UNION ALL SELECT series_id, 'const', m_y - (b_0 * m_0 + b_1 * m_1 + b_2 * m_2), sqrt(s2 * (1 / n + {_CONST})), r2, n FROM r)
SELECT series_id, term, round(coef, 5) + 0.0 AS coef, round(se, 5) + 0.0 AS se, round(coef / se, 4) + 0.0 AS t, round(r2, 7) + 0.0 AS r2, CAST(n AS BIGINT) AS n FROM l""")
def ols_multiple(spark, sf):
    out = hy.ols_summary(daily_exog(spark, sf), KEY, "y", X)
    return out.select("series_id", "term", rnd("coef", 5).alias("coef"), rnd("se", 5).alias("se"), rnd("t", 4).alias("t"), rnd("r2", 7).alias("r2"), "n")


@query("f_regression", sql=f"WITH {DAILY_EXOG} " + " UNION ALL ".join(
    f"SELECT series_id, '{c}' AS feature, round(pow(corr({c}, y), 2) / (1 - pow(corr({c}, y), 2)) * (count(*) - 2), 4) + 0.0 AS statistic FROM daily_exog GROUP BY 1" for c in X))
def f_regression(spark, sf):
    return hy.f_regression(daily_exog(spark, sf), KEY, "y", X).select("series_id", "feature", rnd("statistic", 4).alias("statistic"))


_MI_BIN = "CAST(floor((rank() OVER (PARTITION BY series_id ORDER BY {c}) - 1) * 10 / CAST(count(*) OVER (PARTITION BY series_id) AS DOUBLE)) AS INTEGER)"


@query("mutual_information", sql=f"""WITH {DAILY_EXOG},
b AS (SELECT series_id, {_MI_BIN.format(c="y")} AS by_, {", ".join(_MI_BIN.format(c=c) + f" AS b_{c}" for c in X)} FROM daily_exog),
l AS ({" UNION ALL ".join(f"SELECT series_id, '{c}' AS feature, b_{c} AS bx, by_ FROM b" for c in X)}),
j AS (SELECT series_id, feature, bx, by_, CAST(count(*) AS DOUBLE) AS w FROM l GROUP BY 1, 2, 3, 4),
m AS (SELECT *, sum(w) OVER (PARTITION BY series_id, feature, bx) AS wx, sum(w) OVER (PARTITION BY series_id, feature, by_) AS wy, sum(w) OVER (PARTITION BY series_id, feature) AS n FROM j)
SELECT series_id, feature, round(sum(w / n * ln(w * n / (wx * wy))), 8) + 0.0 AS mi FROM m GROUP BY 1, 2""")
def mutual_information(spark, sf):
    out = hy.mutual_information(daily_exog(spark, sf), KEY, "y", X)
    return out.select("series_id", "feature", rnd("mi", 8).alias("mi"))


@query("lasso")
def lasso_q(spark, sf):
    """L1 regression of the target on its covariates, alpha 0.1."""
    d = hy.centred(daily_exog(spark, sf), KEY, ["y", *X])
    cols = [F.col(f"__d_{c}") for c in (*X, "y")]

    def result(m, n):
        b = lasso(m, n, range(len(X)), len(X), 0.1)
        return [{"feature": c, "coef": float(v)} for c, v in zip(X, b)]

    return finish(gram(d, KEY, cols), KEY, result, "feature string, coef double")


@query("anova_nested", sql=f"""WITH {DAILY_EXOG},{_least_squares_sql("daily_exog", "series_id", "l", X)},{_least_squares_sql("daily_exog", "series_id", "s", ["qty"])}
SELECT l.series_id, round(s.ssr / s.s_yy, 8) + 0.0 AS small, round(l.ssr / l.s_yy, 8) + 0.0 AS large, round((s.ssr - l.ssr) / 2 / (l.ssr / (l.n - 4)), 5) + 0.0 AS statistic
FROM l JOIN s ON s.series_id = l.series_id""")
def anova_nested(spark, sf):
    """Unexplained shares of the variance of both regressions, and the F statistic of what the larger one adds."""
    panel = daily_exog(spark, sf)
    total = panel.groupBy("series_id").agg((F.var_pop("y") * F.count(F.lit(1))).alias("t"))
    out = hy.anova_nested(panel, KEY, "y", ["qty"], X).join(total, "series_id")
    return out.select("series_id", rnd(F.col("ssr_small") / F.col("t"), 8).alias("small"), rnd(F.col("ssr_large") / F.col("t"), 8).alias("large"), rnd("statistic", 5).alias("statistic"))


@query("diebold_mariano", sql=FCB + f""", d AS (SELECT f.series_id, abs(f.y - f.yhat) - abs(f.y - b.yhat) AS d{_JOIN} WHERE f.q = 0.5)
SELECT series_id, count(*) AS n, round(avg(d) / sqrt(var_samp(d) / count(*)), 7) + 0.0 AS statistic FROM d GROUP BY 1""")
def diebold_mariano(spark, sf):
    median = compared(spark, sf).filter(F.col("q") == 0.5)
    return hy.diebold_mariano(median, KEY, "y", "yhat", "yhat_base").select("series_id", "n", rnd("statistic", 7).alias("statistic"))


@query("diebold_mariano_p_values")
def diebold_mariano_p_values(spark, sf):
    return hy.diebold_mariano(compared(spark, sf), [*KEY, "q"], "y", "yhat", "yhat_base")


@query("lof_outliers", sql=f"""WITH {HOURLY},
v AS (SELECT series_id, ts, y, row_number() OVER (PARTITION BY series_id ORDER BY y, ts) AS r FROM hourly),
nb AS (SELECT a.series_id, a.r, b.r AS o, abs(a.y - b.y) AS d FROM v a JOIN v b ON a.series_id = b.series_id AND a.r <> b.r AND abs(a.r - b.r) <= 20
 QUALIFY row_number() OVER (PARTITION BY a.series_id, a.r ORDER BY abs(a.y - b.y), b.r) <= 20),
kd AS (SELECT series_id, r, max(d) AS reach FROM nb GROUP BY 1, 2),
ld AS (SELECT nb.series_id, nb.r, 1 / (avg(greatest(d, reach)) + 1e-10) AS density FROM nb JOIN kd ON kd.series_id = nb.series_id AND kd.r = nb.o GROUP BY 1, 2),
f AS (SELECT nb.series_id, nb.r, avg(x.density) / any_value(w.density) AS lof FROM nb JOIN ld x ON x.series_id = nb.series_id AND x.r = nb.o
 JOIN ld w ON w.series_id = nb.series_id AND w.r = nb.r GROUP BY 1, 2)
SELECT v.series_id, ts, round(y, 6) + 0.0 AS y, round(log10(lof), 6) + 0.0 AS log10_lof FROM v JOIN f ON f.series_id = v.series_id AND f.r = v.r WHERE lof > 1.5""")
def lof_outliers(spark, sf):
    out = hy.lof(hourly(spark, sf), KEY, "idx", "y", 20).filter(F.col("lof") > 1.5)
    return out.select("series_id", "ts", rnd("y").alias("y"), rnd(F.log10("lof")).alias("log10_lof"))


@query("eda_report")
def eda_report(spark, sf):
    """The battery as one long table (series, test, statistic, p_value)."""
    own = hy.battery(hourly(spark, sf), KEY, "idx", "y")
    return own.unionByName(hy.battery(daily_exog(spark, sf), KEY, "idx", "y", X, tests=["chow", *[f"f_regression_{x}" for x in X]]))


#: Tests of the battery with a SQL twin of their own: the twin, its condition, and its digits.
_STATED = {
    "kpss_d0": ("kpss_test", "true", 7), "jarque_bera": ("jarque_bera", "true", 6), "dagostino_k2": ("dagostino_k2", "true", 6),
    "breusch_pagan": ("breusch_pagan", "true", 6), "goldfeld_quandt": ("goldfeld_quandt", "true", 8), "bds": ("bds_test", "true", 6),
    "ljung_box_10": ("ljung_box", "lags = 10", 6), "ljung_box_20": ("ljung_box", "lags = 20", 6),
}
_STATED_X = {"chow": ("chow_test", "true", 6), **{f"f_regression_{x}": ("f_regression", f"feature = '{x}'", 4) for x in X}}


def _battery_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{test}' AS test, series_id, statistic FROM ({ORACLES[twin]}) WHERE {where}"
        for test, (twin, where, _) in {**_STATED, **_STATED_X}.items())


_BASE = {q: c.replace("pred", "base") for q, c in COLS.items()}


def _report_sql() -> str:
    def window(cols, n, w):
        return ", ".join(f"CASE WHEN count(*) OVER {w} = {n} THEN quantile_cont(y, {q}) OVER {w} END AS {c}" for q, c in cols.items())

    def over(n):
        return f"(PARTITION BY series_id, h ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"

    def pinball(q, c):
        return f"avg(greatest({q} * (y - {c}), ({q} - 1) * (y - {c})))"

    one = {
        "n": "CAST(any_value(n) AS DOUBLE)", "mae": "avg(abs(e))", "rmse": "sqrt(avg(e * e))",
        "log10_mape": "log10(avg(abs(e) / greatest(abs(y), 2.220446049250313e-16)))",
        "coverage": f"avg(CASE WHEN y BETWEEN {LO} AND {HI} THEN 1.0 ELSE 0.0 END)", "sharpness": f"avg({HI} - {LO})",
        "regression_intercept": f"regr_intercept(y, {MED})", "regression_slope": f"regr_slope(y, {MED})", "regression_r2": f"regr_r2(y, {MED})",
        "equal_accuracy": "avg(d) / sqrt(var_samp(d) / count(*))", "residual_mean": "avg(e)", "residual_std": "stddev_samp(e)",
        "residual_skewness": "avg(pow(e - m, 3)) / pow(var_pop(e), 1.5)", "residual_kurtosis": "avg(pow(e - m, 4)) / pow(var_pop(e), 2) - 3",
        "jarque_bera": "count(*) / 6.0 * (pow(avg(pow(e - m, 3)) / pow(var_pop(e), 1.5), 2) + pow(avg(pow(e - m, 4)) / pow(var_pop(e), 2) - 3, 2) / 4)",
        "cusum_peak": "max(abs(cs))",
    }
    parts = [(m, 0.5, x) for m, x in one.items()]
    for q, c in COLS.items():
        parts += [("pinball", q, pinball(q, c)), ("d2", q, f"1 - {pinball(q, c)} / {pinball(q, _BASE[q])}"), ("below", q, f"avg(CASE WHEN y <= {c} THEN 1.0 ELSE 0.0 END)")]
    parts += [("pit_count", b / 10, f"CAST(count(*) FILTER (least(floor(round(pit * 10, 6)), 9) = {b}) AS DOUBLE)") for b in range(10)]
    rows = " UNION ALL ".join(f"SELECT period, series_id, '{m}' AS metric, {q}::DOUBLE AS q, round({x}, 5) + 0.0 AS value FROM r GROUP BY 1, 2" for m, q, x in parts)
    return f"""WITH {HOURLY},
f AS (SELECT series_id, ts, y, {window(COLS, 14, "w")}, {window(_BASE, 7, "v")} FROM (SELECT *, hour(ts) AS h FROM hourly) WINDOW w AS {over(14)}, v AS {over(7)}),
j AS (SELECT *, {MED} - y AS e, abs(y - {MED}) - abs(y - {_BASE[0.5]}) AS d, CAST({_pit_sql()} AS DOUBLE) AS pit FROM f WHERE {MED} IS NOT NULL AND {_BASE[0.5]} IS NOT NULL),
p AS (SELECT 'overall' AS period, * FROM j UNION ALL SELECT 'specific', * FROM j WHERE isodow(ts) IN (5, 6) AND hour(ts) IN (11, 15, 19)),
a AS (SELECT *, avg(e) OVER g AS m, count(*) OVER g AS n, row_number() OVER (PARTITION BY period, series_id ORDER BY ts) AS rn FROM p WINDOW g AS (PARTITION BY period, series_id)),
r AS (SELECT *, sum(e - m) OVER (PARTITION BY period, series_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS cs FROM a),
l AS (SELECT x.period, x.series_id, k, sum((x.e - x.m) * (z.e - z.m)) AS s FROM r x JOIN (SELECT unnest(range(1, 11)) AS k) ON true
 JOIN r z ON z.period = x.period AND z.series_id = x.series_id AND z.rn = x.rn - k GROUP BY 1, 2, 3),
t AS (SELECT period, series_id, CAST(count(*) AS DOUBLE) AS n, var_pop(e) * count(*) AS tot FROM r GROUP BY 1, 2)
{rows} UNION ALL SELECT t.period, t.series_id, 'ljung_box', 0.5::DOUBLE, round(any_value(t.n * (t.n + 2)) * sum(pow(s / tot, 2) / (t.n - k)), 5) + 0.0
FROM l JOIN t ON t.period = l.period AND t.series_id = l.series_id WHERE k < t.n GROUP BY 1, 2"""


@query("evaluation_report", sql=_report_sql())
def evaluation_report(spark, sf):
    """Every figure of the report over all hours and over the target hours: Friday and Saturday, 11, 15 and 19 h."""
    panel = hourly(spark, sf).withColumn("h", F.hour("ts"))
    scored = seasonal_quantiles(panel, KEY, ["h"], "idx", "y", 14, QS)
    base = seasonal_quantiles(panel, KEY, ["h"], "idx", "y", 7, QS).select("series_id", "idx", *[F.col(c).alias(_BASE[q]) for q, c in COLS.items()])
    wide = scored.join(base, ["series_id", "idx"])
    periods = {"overall": F.lit(True), "specific": tm.target_times("ts")}
    out = metrics.period_report(wide, KEY, "idx", periods, COLS, _BASE)
    mape = F.col("metric") == "mape"
    value = F.when(mape, F.log10("value")).otherwise(F.col("value"))
    return out.select("period", "series_id", F.when(mape, "log10_mape").otherwise(F.col("metric")).alias("metric"), "q", rnd(value, 5).alias("value"))


@query("evaluation_losses", sql=FCB + f""", j AS (SELECT f.*, b.yhat AS yb{_JOIN}),
p AS (SELECT 'overall' AS period, * FROM j UNION ALL SELECT 'specific', * FROM j WHERE isodow(ts) IN (5, 6)),
q AS (SELECT period, series_id, q, avg(greatest(q * (y - yhat), (q - 1) * (y - yhat))) AS a, avg(greatest(q * (y - yb), (q - 1) * (y - yb))) AS b FROM p GROUP BY 1, 2, 3)
SELECT period, series_id, q, 'pinball' AS metric, round(a, 6) + 0.0 AS value FROM q UNION ALL SELECT period, series_id, q, 'd2', round(1 - a / b, 6) + 0.0 FROM q
UNION ALL SELECT period, series_id, 0.5::DOUBLE, 'mae', round(avg(abs(yhat - y)), 6) + 0.0 FROM p WHERE q = 0.5 GROUP BY 1, 2
UNION ALL SELECT period, series_id, 0.5::DOUBLE, 'rmse', round(sqrt(avg(pow(yhat - y, 2))), 6) + 0.0 FROM p WHERE q = 0.5 GROUP BY 1, 2
UNION ALL SELECT period, series_id, 0.5::DOUBLE, 'log10_mape', round(log10(avg(abs(yhat - y) / greatest(abs(y), 2.220446049250313e-16))), 6) + 0.0 FROM p WHERE q = 0.5 GROUP BY 1, 2""")
def evaluation_losses(spark, sf):
    """Losses of daily forecasts, over all days and over Fridays and Saturdays."""
    periods = {"overall": F.lit(True), "specific": F.weekday("ts").isin(4, 5)}
    out = metrics.evaluation_table(compared(spark, sf), KEY, periods)
    mape = F.col("metric") == "mape"
    value = F.when(mape, F.log10("value")).otherwise(F.col("value"))
    metric = F.when(mape, "log10_mape").otherwise(F.col("metric"))
    return out.select("period", "series_id", "q", metric.alias("metric"), rnd(value).alias("value"))


@query("bds_test", sql=f"""WITH {HOURLY},
e AS (SELECT series_id, 1.5 * stddev_samp(y) AS eps, CAST(count(*) AS DOUBLE) AS n FROM hourly GROUP BY 1),
t AS (SELECT h.series_id, y AS x, lead(y) OVER w AS z, row_number() OVER w AS i, eps, n FROM hourly h JOIN e ON e.series_id = h.series_id WINDOW w AS (PARTITION BY h.series_id ORDER BY ts)),
p AS (SELECT a.series_id, a.i, a.n, CAST(count(*) AS DOUBLE) AS hits, count(*) FILTER (b.i > 1) AS late, count(*) FILTER (abs(a.z - b.z) < a.eps) AS joint
 FROM t a JOIN t b ON a.series_id = b.series_id AND abs(a.x - b.x) < a.eps GROUP BY 1, 2, 3),
s AS (SELECT series_id, n, sum(hits) AS s, sum(hits * hits) AS s2, sum(joint) AS j, sum(late) FILTER (i > 1) AS l FROM p GROUP BY 1, 2),
c AS (SELECT *, (s - n) / (n * (n - 1)) AS cf, (l - (n - 1)) / ((n - 1) * (n - 2)) AS cl, (j - (n - 1)) / ((n - 1) * (n - 2)) AS cj, (s2 - 3 * s + 2 * n) / (n * (n - 1) * (n - 2)) AS k FROM s)
SELECT series_id, round(sqrt(n - 1) * (cj - cl * cl) / (2 * abs(k - cf * cf)), 6) + 0.0 AS statistic FROM c""")
def bds_test(spark, sf):
    return neighbours.bds(hourly(spark, sf), KEY, "idx", "y").select("series_id", rnd("statistic").alias("statistic"))


@query("stl_decompose")
def stl_decompose(spark, sf):
    return spectral.stl_decompose(hourly(spark, sf), KEY, "idx", "y", 24)


def _holed(spark, sf):
    """Covariates without their values on the 15th of each month."""
    return daily_exog(spark, sf).withColumn("qty", F.when(F.dayofmonth("ts") != 15, F.col("qty")))


_COLS = ["y", "qty", "disc", "tax"]
_KNN = f"""WITH {DAILY_EXOG}, h AS (SELECT series_id, CAST(epoch(ts) AS BIGINT) // 86400 AS idx, ts, y, CASE WHEN day(ts) <> 15 THEN qty END AS qty, disc, tax FROM daily_exog),
d AS (SELECT a.series_id, a.idx, a.ts, b.idx AS donor, b.qty AS value, sqrt((pow(a.y - b.y, 2) + pow(a.disc - b.disc, 2) + pow(a.tax - b.tax, 2)) * 4 / 3) AS distance
 FROM h a JOIN h b ON a.series_id = b.series_id WHERE a.qty IS NULL AND b.qty IS NOT NULL),
k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY series_id, idx ORDER BY round(distance, 9), donor) <= 5)"""


@query("knn_join", sql=_KNN + " SELECT series_id, idx, count(*) AS donors, round(sum(distance), 5) + 0.0 AS distance FROM k GROUP BY 1, 2")
def knn_join(spark, sf):
    out = neighbours.knn_join(_holed(spark, sf), KEY, "idx", _COLS, "qty", 5)
    per_row = out.groupBy("series_id", "idx").agg(F.count(F.lit(1)).alias("donors"), F.sum("distance").alias("distance"))
    return per_row.select("series_id", "idx", "donors", rnd("distance", 5).alias("distance"))


@query("knn_impute", sql=_KNN + """, m AS (SELECT series_id, idx, avg(value) AS v FROM k GROUP BY 1, 2)
SELECT h.series_id, ts, round(coalesce(qty, v), 6) + 0.0 AS qty FROM h LEFT JOIN m ON m.series_id = h.series_id AND m.idx = h.idx""")
def knn_impute(spark, sf):
    out = neighbours.knn_impute(_holed(spark, sf), KEY, "idx", _COLS, 5, ["qty"])
    return out.select("series_id", "ts", rnd("qty").alias("qty"))


@query("eda_statistics", sql=_battery_sql())
def eda_statistics(spark, sf):
    """The battery's statistics that SQL can state."""
    own = hy.battery(hourly(spark, sf), KEY, "idx", "y", tests=list(_STATED))
    out = own.unionByName(hy.battery(daily_exog(spark, sf), KEY, "idx", "y", X, tests=list(_STATED_X)))
    value = F.lit(None).cast("double")
    for test, (_, _, digits) in {**_STATED, **_STATED_X}.items():
        value = F.when(F.col("test") == test, rnd("statistic", digits)).otherwise(value)
    return out.select("test", "series_id", value.alias("statistic"))
