"""The registered queries as standard SQL over the same tables.

Each text is written from the definition of the operator, not from its Spark plan.
"""

from __future__ import annotations

import math

from panelweave.functions.heads import student_quantile
from panelweave.plans.catalogue import AHEAD, CONTEXT, SAMPLES, SEED, STATED, model_settings
from panelweave.plans.fixtures import HORIZON, MEMBERS, NEAR, POST_START


def r(e: str, digits: int = 6, name: str | None = None) -> str:
    return f"round(CAST({e} AS DOUBLE), {digits}) + 0.0 AS {name or e}"


def rs(names: str, digits: int = 6) -> str:
    return ", ".join(r(n, digits) for n in names.split())


def text(e: str = "t") -> str:
    return f"CAST({e} AS VARCHAR) AS {e}"


def steps(*parts: str) -> str:
    """WITH clause from 'name AS (…)' parts; the last part is the SELECT."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def dense(name: str, source: str, columns: str) -> str:
    picked = ", ".join(f"p.{c}" for c in columns.split())
    return f"""{name} AS (SELECT region, t, {picked} FROM (SELECT DISTINCT region FROM {source}) CROSS JOIN
      (SELECT DISTINCT t FROM {source}) LEFT JOIN {source} p USING (region, t))"""


def filled(name: str, source: str, columns: str) -> str:
    return f"{name} AS (SELECT region, t, {', '.join(f'coalesce({c}, 0) AS {c}' for c in columns.split())} FROM {source})"


# --- panels -------------------------------------------------------------------------------

NATION = """np AS (SELECT c_nationkey AS region, CAST(date_trunc('month', o_orderdate) AS DATE) AS t,
      CAST(count(*) AS DOUBLE) AS y, sum(floor(o_totalprice)) / count(*) AS c1,
      avg(CASE WHEN o_orderpriority LIKE '1%' THEN 1e0 ELSE 0e0 END) AS c2
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
SUPPLIER = """sp AS (SELECT l_suppkey AS region, CAST(date_trunc('month', l_shipdate) AS DATE) AS t,
      sum(l_quantity) AS y, avg(l_discount) AS c1, avg(l_tax) AS c2 FROM lineitem GROUP BY 1, 2)"""
USER = """up AS (SELECT user_id AS region, CAST(ts AS DATE) AS t, sum(value) AS y,
      CAST(count(*) AS DOUBLE) AS c1 FROM events GROUP BY 1, 2)"""
TYPE = """tp AS (SELECT event_type AS region, date_trunc('hour', ts) AS t, sum(value) AS y FROM events GROUP BY 1, 2)"""
SEGMENT = """sg AS (SELECT c_mktsegment AS region, CAST(o_orderdate AS DATE) AS t, CAST(count(*) AS DOUBLE) AS y,
      sum(floor(o_totalprice)) / count(*) AS reproduction_rate, count(*) * 2e0 AS stringency_index
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

NATION_DENSE = [NATION, dense("nd0", "np", "y c1 c2"), filled("nd", "nd0", "y c1 c2")]
SUPPLIER_DENSE = [SUPPLIER, dense("sd0", "sp", "y c1 c2"), filled("sd", "sd0", "y c1 c2")]
USER_DENSE = [USER, dense("ud", "up", "y c1")]
TRAIN_DATES = [
    """ds AS (SELECT t, row_number() OVER (ORDER BY t) AS rn, count(*) OVER () - CAST(floor(count(*) OVER () * 0.2e0) AS BIGINT) AS cut
      FROM (SELECT DISTINCT t FROM ud))"""
]
USER_FILLED = [*USER_DENSE, filled("uf", "ud", "y c1")]
TYPE_DENSE = [TYPE, dense("td", "tp", "y")]


def strip(name: str, table: str, key: str) -> str:
    return f"""{name} AS (SELECT {key} AS region, CAST({key} // 100 * 3 + ({key} * 37) % 7 AS DOUBLE) AS x,
      CAST({key} % 100 * 3 + ({key} * 53) % 5 AS DOUBLE) AS y FROM {table})"""


SUPPLIERS, CUSTOMERS = strip("sup", "supplier", "s_suppkey"), strip("cus", "customer", "c_custkey")


def pairs(name: str, points: str) -> str:
    return f"""{name} AS (SELECT a.region AS i, b.region AS j,
      sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d
      FROM {points} a JOIN {points} b ON a.region <> b.region)"""


def normalised(name: str, edges: str) -> str:
    return f"""{name} AS (SELECT i, j, CASE WHEN sum(w) OVER (PARTITION BY i) = 0 THEN w
      ELSE w / sum(w) OVER (PARTITION BY i) END AS w FROM {edges})"""


NATION_EDGES = [
    """ne0 AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j, 1e0 AS w FROM nation a JOIN nation b
      ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)""",
    normalised("ne", "ne0"),
]
SUPPLIER_EDGES = [
    """se0 AS (SELECT DISTINCT a.s_suppkey AS i, b.s_suppkey AS j, 1e0 AS w FROM supplier a JOIN supplier b
      ON b.s_suppkey IN (a.s_suppkey - 1, a.s_suppkey + 1, a.s_suppkey + 10))""",
    normalised("se", "se0"),
]
NEAR_EDGES = [
    CUSTOMERS,
    pairs("cp", "cus"),
    f"be AS (SELECT i, j, 1e0 AS w FROM cp WHERE d <= {NEAR})",
]


def lagged(name: str, panel: str, edges: str, column: str = "y", out: str = "lag") -> str:
    return f"""{name} AS (SELECT p.*, CASE WHEN g.n IS NULL THEN 0 WHEN g.known = g.n THEN g.s END AS {out}
      FROM {panel} p LEFT JOIN (SELECT e.i, q.t, count(*) AS n, count(q.{column}) AS known, sum(e.w * q.{column}) AS s
        FROM {edges} e JOIN {panel} q ON q.region = e.j GROUP BY 1, 2) g ON g.i = p.region AND g.t = p.t)"""


NATION_ROWS = [
    *NATION_DENSE,
    f"""nr AS (SELECT nd.*, CASE WHEN n_regionkey IN (0, 1) THEN 1 ELSE 0 END AS treated,
      CASE WHEN t >= DATE '{POST_START}' THEN 1 ELSE 0 END AS post FROM nd JOIN nation ON n_nationkey = region)""",
]
SUPPLIER_ROWS = [
    *SUPPLIER_DENSE,
    f"""sr AS (SELECT sd.*, CASE WHEN region % 5 <= 1 THEN 1 ELSE 0 END AS treated,
      CASE WHEN t >= DATE '{POST_START}' THEN 1 ELSE 0 END AS post FROM sd)""",
]
NATION_LAG = [*NATION_ROWS, *NATION_EDGES, lagged("nl", "nr", "ne")]
SUPPLIER_LAG = [*SUPPLIER_ROWS, *SUPPLIER_EDGES, lagged("sl", "sr", "se")]


def did(rows: str, lag: str | None = "lag", covariate: str | None = None) -> list[str]:
    """Frisch-Waugh-Lovell: demean inside the four cells, solve for ρ (and γ), then difference the cell means."""
    x, c = lag or "0e0", covariate or "0e0"
    base = f"fw0 AS (SELECT treated, post, y, CAST({x} AS DOUBLE) AS x, CAST({c} AS DOUBLE) AS c FROM {rows})"
    demeaned = """fw AS (SELECT treated, post, y - avg(y) OVER k AS yt, x - avg(x) OVER k AS xt, c - avg(c) OVER k AS ct
      FROM fw0 WINDOW k AS (PARTITION BY treated, post))"""
    sums = "fs AS (SELECT sum(xt*xt) AS xx, sum(xt*ct) AS xc, sum(ct*ct) AS cc, sum(xt*yt) AS xy, sum(ct*yt) AS cy FROM fw)"
    if lag and covariate:
        slopes = "fb AS (SELECT (cc*xy - xc*cy) / (xx*cc - xc*xc) AS rho, (xx*cy - xc*xy) / (xx*cc - xc*xc) AS gamma FROM fs)"
    elif lag:
        slopes = "fb AS (SELECT xy / xx AS rho, 0e0 AS gamma FROM fs)"
    else:
        slopes = "fb AS (SELECT 0e0 AS rho, 0e0 AS gamma)"
    means = """fm AS (SELECT
      avg(y - rho*x - gamma*c) FILTER (WHERE treated = 0 AND post = 0) AS m00,
      avg(y - rho*x - gamma*c) FILTER (WHERE treated = 1 AND post = 0) AS m10,
      avg(y - rho*x - gamma*c) FILTER (WHERE treated = 0 AND post = 1) AS m01,
      avg(y - rho*x - gamma*c) FILTER (WHERE treated = 1 AND post = 1) AS m11 FROM fw0, fb)"""
    out = """pa AS (SELECT 'beta_0' AS param, 0 AS idx, m00 AS value FROM fm UNION ALL SELECT 'beta_1', 0, m10 - m00 FROM fm
      UNION ALL SELECT 'beta_2', 0, m01 - m00 FROM fm UNION ALL SELECT 'delta', 0, m11 - m10 - m01 + m00 FROM fm"""
    out += " UNION ALL SELECT 'rho', 0, rho FROM fb" if lag else ""
    out += " UNION ALL SELECT 'gamma', 0, gamma FROM fb" if covariate else ""
    return [base, demeaned, sums, slopes, means, out + ")"]


def errors(select: str, *also: str) -> str:
    """Every parameter is a weighted sum of the values: the weight ``h`` of each row, its residual ``e``, and errors made of both."""
    return steps(
        *SUPPLIER_LAG,
        *did("sl", "lag", "c1"),
        """fx AS (SELECT *, yt - rho * xt - gamma * ct AS e FROM (SELECT region, t, treated, post, y - avg(y) OVER k AS yt, lag - avg(lag) OVER k AS xt,
      c1 - avg(c1) OVER k AS ct, avg(lag) OVER k AS mx, avg(c1) OVER k AS mc, count(*) OVER k AS nc FROM sl WINDOW k AS (PARTITION BY treated, post)), fb)""",
        """pw AS (SELECT unnest(['beta_0', 'beta_1', 'beta_2', 'delta', 'rho', 'gamma']) AS param, unnest([1, -1, -1, 1, 0, 0]) AS a00,
      unnest([0, 1, 0, -1, 0, 0]) AS a10, unnest([0, 0, 1, -1, 0, 0]) AS a01, unnest([0, 0, 0, 1, 0, 0]) AS a11, unnest([0, 0, 0, 0, 1, 0]) AS r, unnest([0, 0, 0, 0, 0, 1]) AS g)""",
        """ca AS (SELECT param, treated, post, any_value(r) AS r, any_value(g) AS g, any_value(CASE WHEN treated = 1 THEN CASE WHEN post = 1 THEN a11 ELSE a10 END
      WHEN post = 1 THEN a01 ELSE a00 END) AS a, any_value(mx) AS mx, any_value(mc) AS mc FROM fx CROSS JOIN pw GROUP BY ALL)""",
        "cs AS (SELECT param, any_value(r) - sum(a * mx) AS sx, any_value(g) - sum(a * mc) AS sc FROM ca GROUP BY param)",
        """hh AS (SELECT param, region, t, e, a / nc + (sx * (cc * xt - xc * ct) + sc * (xx * ct - xc * xt)) / (xx * cc - xc * xc) AS h
      FROM fx JOIN ca USING (treated, post) JOIN cs USING (param), fs)""",
        *also,
        f"""SELECT param, CAST(0 AS INTEGER) AS idx, {r('e', 6, 'std_error')}, {r('value / e', 4, 't_stat')} FROM ({select}) JOIN pa USING (param)""",
    )


def value_of(name: str) -> str:
    return f"(SELECT value FROM pa WHERE param = '{name}')"


def fitted(rows: str) -> str:
    return f"""ft AS (SELECT region, t, y, {value_of('beta_0')} + {value_of('beta_1')} * treated + {value_of('beta_2')} * post
      + {value_of('delta')} * treated * post + {value_of('rho')} * lag AS fitted FROM {rows})"""


TIDY = f"SELECT param, CAST(idx AS INTEGER) AS idx, {r('value')} FROM pa"


def packed(e: str, name: str) -> str:
    return f"array_to_string(list_transform({e}, lambda v: CAST(round(v * 1000000) AS BIGINT)), ',') AS {name}"


def plain(e: str, name: str) -> str:
    return f"array_to_string({e}, ',') AS {name}"


def uniform(*keys: str) -> str:
    joined = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in (str(SEED), *keys))
    return f"((CAST(('0x' || substr(md5({joined}), 1, 8)) AS BIGINT) + 0.5e0) / 4294967296e0)"


def gauss(u: str, v: str) -> str:
    return f"(sqrt(-2e0 * ln({u})) * cos(2e0 * {math.pi!r} * {v}))"


INTERPOLATE = """k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY t) AS n FROM {source}),
    g AS (SELECT *, {known} FROM k WINDOW
      b AS (PARTITION BY region ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      f AS (PARTITION BY region ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def interpolation(source: str, columns: str, digits: int = 6) -> tuple[str, str]:
    known = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER b AS {c}l, last_value(CASE WHEN {c} IS NOT NULL THEN n END IGNORE NULLS) OVER b AS {c}ln,"
        f" first_value({c} IGNORE NULLS) OVER f AS {c}r, first_value(CASE WHEN {c} IS NOT NULL THEN n END IGNORE NULLS) OVER f AS {c}rn"
        for c in columns.split()
    )
    values = ", ".join(
        r(f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}r IS NOT NULL THEN {c}l + ({c}r - {c}l) * (n - {c}ln) / ({c}rn - {c}ln) ELSE {c}l END", digits, c)
        for c in columns.split()
    )
    return INTERPOLATE.format(source=source, known=known), f"SELECT region, {text()}, {values} FROM g"


def scaled(source: str, groups: list[str], method: str) -> str:
    """SELECT that scales each group of columns by its pooled constants."""
    columns = []
    for group in groups:
        names = group.split()
        pool = " UNION ALL ".join(f"SELECT {c} AS v FROM {source}" for c in names)
        shift, spread = ("min(v)", "max(v) - min(v)") if method == "minmax" else ("avg(v)", "stddev_pop(v)")
        for c in names:
            columns.append(
                r(f"({c} - (SELECT {shift} FROM ({pool}))) / (SELECT CASE WHEN {spread} = 0 THEN 1 ELSE {spread} END FROM ({pool}))", 6, c)
            )
    return f"SELECT region, {text()}, {', '.join(columns)} FROM {source}"


def training(source: str, past: int, ahead: int) -> list[str]:
    return [
        f"ow AS (SELECT region, t, coalesce(y, 0) AS v, CASE WHEN y IS NULL THEN 0 ELSE 1 END AS o FROM {source})",
        f"""tw AS (SELECT region, t,
      list(v) OVER p AS pv, list(o) OVER p AS po, list(v) OVER f AS fv, list(o) OVER f AS fo FROM ow WINDOW
      p AS (PARTITION BY region ORDER BY t ROWS BETWEEN {past} PRECEDING AND 1 PRECEDING),
      f AS (PARTITION BY region ORDER BY t ROWS BETWEEN CURRENT ROW AND {ahead - 1} FOLLOWING))""",
        f"tk AS (SELECT * FROM tw WHERE len(fv) = {ahead} AND len(pv) > 0)",
    ]


def padded(e: str, past: int, filler: str = "0") -> str:
    return f"list_concat(list_transform(range({past} - len({e})), lambda z: {filler}), {e})"


ENSEMBLE = [
    *SUPPLIER_DENSE,
    "en AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY t) AS n, row_number() OVER (PARTITION BY region ORDER BY t DESC) AS back FROM sd)",
    f"""fc AS (SELECT a.region, a.t, k.k AS sample_id, b.y AS value FROM en a CROSS JOIN (SELECT unnest(range(1, {MEMBERS + 1})) AS k) k
      JOIN en b ON b.region = a.region AND b.n = a.n - k.k WHERE a.back <= {HORIZON})""",
    f"tr AS (SELECT region, t, y FROM en WHERE back <= {HORIZON})",
    f"hi AS (SELECT * FROM en WHERE back > {HORIZON})",
]
CELLS = [
    *ENSEMBLE,
    """ce AS (SELECT region, t, any_value(tr.y) AS y, avg(value) AS mean, median(value) AS med, stddev_pop(value) AS std,
      quantile_cont(value, 0.45) AS q45, quantile_cont(value, 0.55) AS q55, quantile_cont(value, 0.05) AS q05,
      quantile_cont(value, 0.95) AS q95, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.9) AS q90,
      quantile_cont(value, 0.025) AS q025, quantile_cont(value, 0.975) AS q975
      FROM fc JOIN tr USING (region, t) GROUP BY region, t)""",
]
SCORES = {
    "mse": "avg((mean - y) * (mean - y))",
    "mae": "avg(abs(mean - y))",
    "rmse": "sqrt(avg((mean - y) * (mean - y)))",
    "mape": "avg(CASE WHEN y <> 0 THEN abs(y - mean) / abs(y) END) * 100",
    "median_mse": "avg((med - y) * (med - y))",
    "median_mae": "avg(abs(med - y))",
    "mean_std": "avg(std)",
    "std_std": "stddev_pop(std)",
    "coverage_10": "avg(CASE WHEN y BETWEEN q45 AND q55 THEN 1e0 ELSE 0e0 END)",
    "coverage_90": "avg(CASE WHEN y BETWEEN q05 AND q95 THEN 1e0 ELSE 0e0 END)",
}


def score_row(names: str, digits: int) -> str:
    return "SELECT " + ", ".join(r(SCORES[n], digits, n) for n in names.split()) + " FROM ce"


def metric(section: str, name: str, value: str, source: str) -> str:
    return f"SELECT '{section}' AS section, '{name}' AS metric, CAST({value} AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS label FROM {source}"


def label(section: str, name: str, value: str, source: str) -> str:
    return f"SELECT '{section}' AS section, '{name}' AS metric, CAST(NULL AS DOUBLE) AS value, {value} AS label FROM {source}"


def rows_out(parts: list[str], digits: int = 5) -> str:
    return f"SELECT section, metric, {r('value', digits)}, label FROM (" + " UNION ALL ".join(parts) + ")"


BUNDLE = [metric("forecast_metrics", n, e, "ce") for n, e in SCORES.items()]
SPATIAL = [
    *CELLS,
    *SUPPLIER_EDGES,
    """lm AS (SELECT c.region, c.t, c.mean, c.y, c.mean - c.y AS e, coalesce(g.lm, 0) AS lm, coalesce(g.ly, 0) AS ly, coalesce(g.le, 0) AS le
      FROM ce c LEFT JOIN (SELECT i, q.t, sum(w * mean) AS lm, sum(w * y) AS ly, sum(w * (mean - y)) AS le
        FROM se JOIN ce q ON q.region = j GROUP BY 1, 2) g ON g.i = c.region AND g.t = c.t)""",
]
SPATIAL_ROWS = [
    metric("spatial_metrics", "spatial_error_correlation", "corr(e, le)", "lm"),
    metric("spatial_metrics", "forecast_spatial_autocorr", "corr(mean, lm)", "lm"),
    metric("spatial_metrics", "true_spatial_autocorr", "corr(y, ly)", "lm"),
]
ITEMS = [
    *CELLS,
    "se12 AS (SELECT region, avg(abs(a.y - b.y)) AS seasonal_error FROM hi a LEFT JOIN (SELECT region, n, y FROM hi) b USING (region) WHERE b.n = a.n - 12 GROUP BY region)",
    """it0 AS (SELECT region, avg((y - mean) * (y - mean)) AS "MSE", sum(abs(y - med)) AS abs_error, sum(abs(y)) AS abs_target_sum,
      avg(abs(y)) AS abs_target_mean, avg(CASE WHEN y <> 0 THEN abs(y - med) / abs(y) END) AS "MAPE",
      avg(CASE WHEN abs(y) + abs(med) <> 0 THEN 2 * abs(y - med) / (abs(y) + abs(med)) END) AS "sMAPE", avg(abs(y - med)) AS me,
      avg(q975 - q025 + 40 * (greatest(q025 - y, 0) + greatest(y - q975, 0))) AS iv,
      2 * sum(abs((y - q10) * ((CASE WHEN y <= q10 THEN 1e0 ELSE 0e0 END) - 0.1))) AS "QuantileLoss_0_1",
      2 * sum(abs((y - med) * ((CASE WHEN y <= med THEN 1e0 ELSE 0e0 END) - 0.5))) AS "QuantileLoss_0_5",
      2 * sum(abs((y - q90) * ((CASE WHEN y <= q90 THEN 1e0 ELSE 0e0 END) - 0.9))) AS "QuantileLoss_0_9",
      avg(CASE WHEN y <= q10 THEN 1e0 ELSE 0e0 END) AS "Coverage_0_1", avg(CASE WHEN y <= med THEN 1e0 ELSE 0e0 END) AS "Coverage_0_5",
      avg(CASE WHEN y <= q90 THEN 1e0 ELSE 0e0 END) AS "Coverage_0_9" FROM ce GROUP BY region)""",
    """it AS (SELECT it0.*, seasonal_error, CASE WHEN seasonal_error <> 0 THEN me / seasonal_error END AS "MASE",
      CASE WHEN seasonal_error <> 0 THEN iv / seasonal_error END AS "MSIS" FROM it0 LEFT JOIN se12 USING (region))""",
]
ITEM_COLUMNS = (
    "MSE abs_error abs_target_sum abs_target_mean seasonal_error MAPE sMAPE MASE MSIS QuantileLoss_0_1 QuantileLoss_0_5 "
    "QuantileLoss_0_9 Coverage_0_1 Coverage_0_5 Coverage_0_9"
)
_AVERAGED = "MSE abs_target_mean seasonal_error MASE MAPE sMAPE MSIS Coverage_0_1 Coverage_0_5 Coverage_0_9".split()
_SUMMED = "abs_error abs_target_sum QuantileLoss_0_1 QuantileLoss_0_5 QuantileLoss_0_9".split()
_LOSSES = ["QuantileLoss_0_1", "QuantileLoss_0_5", "QuantileLoss_0_9"]
AGGREGATE = {
    **{c: f"avg({c})" for c in _AVERAGED},
    **{c: f"sum({c})" for c in _SUMMED},
    "RMSE": "sqrt(avg(MSE))",
    "NRMSE": "sqrt(avg(MSE)) / avg(abs_target_mean)",
    "ND": "sum(abs_error) / sum(abs_target_sum)",
    **{"w" + c: f"sum({c}) / sum(abs_target_sum)" for c in _LOSSES},
    "mean_absolute_QuantileLoss": "(" + " + ".join(f"sum({c})" for c in _LOSSES) + ") / 3",
    "mean_wQuantileLoss": "(" + " + ".join(f"sum({c})" for c in _LOSSES) + ") / 3 / sum(abs_target_sum)",
    "MAE_Coverage": "(abs(avg(Coverage_0_1) - 0.1) + abs(avg(Coverage_0_5) - 0.5) + abs(avg(Coverage_0_9) - 0.9)) / 3",
}
AGGREGATE_ROWS = [metric("aggregate_metrics", n, e, "it") for n, e in AGGREGATE.items()]


def causal_labels(section: str = "causal_evaluation") -> list[str]:
    return [
        label(section, "treatment_significance", f"CASE WHEN abs({value_of('delta')}) > 0.1 THEN 'Significant' ELSE 'Not significant' END", "(SELECT 1)"),
        label(section, "spatial_significance", f"CASE WHEN abs({value_of('rho')}) > 0.3 THEN 'Strong spatial correlation' ELSE 'Weak spatial correlation' END", "(SELECT 1)"),
    ]


def understanding() -> list[str]:
    delta, rho = value_of("delta"), value_of("rho")
    return [
        label("interpretability", "treatment_interpretation", f"CASE WHEN {delta} < -0.1 THEN 'Strong negative effect' WHEN {delta} > 0.1 THEN 'Strong positive effect' ELSE 'Weak effect' END", "(SELECT 1)"),
        label("interpretability", "spatial_interpretation", f"CASE WHEN abs({rho}) > 0.3 THEN 'Strong spatial spillovers' ELSE 'Weak spatial spillovers' END", "(SELECT 1)"),
        label("interpretability", "model_complexity", "'Medium'", "(SELECT 1)"),
    ]


# --- forecaster -----------------------------------------------------------------------------

def scaled_rows(panel: str) -> list[str]:
    return [
        f"ar0 AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY t DESC) AS back FROM {panel})",
        *SCALES,
    ]


SCALES = [
    f"""sc AS (SELECT region, CASE WHEN avg(abs(y)) > 0 THEN avg(abs(y)) ELSE 1 END AS scale FROM ar0
      WHERE back <= {CONTEXT} GROUP BY region)""",
    """ar AS (SELECT region, t, back, scale, y / scale AS x, lag(y / scale, 1) OVER o AS l1, lag(y / scale, 2) OVER o AS l2
      FROM ar0 JOIN sc USING (region) WINDOW o AS (PARTITION BY region ORDER BY t))""",
]
SCALED = [*SUPPLIER_DENSE, *scaled_rows("sd")]
FIRST_ORDER = [
    "a1 AS (SELECT regr_slope(x, l1) AS phi, regr_intercept(x, l1) AS c FROM ar WHERE l1 IS NOT NULL)",
    "m1 AS (SELECT phi, c, (SELECT sqrt(avg((x - c - phi * l1) * (x - c - phi * l1))) FROM ar WHERE l1 IS NOT NULL) AS sigma FROM a1)",
]
AR1 = [*SCALED, *FIRST_ORDER]
# rows with a value and three lags
COMPLETE = ["cn AS (SELECT sum(greatest(n - 3, 0))::BIGINT AS n FROM (SELECT region, count(*) AS n FROM sd GROUP BY region))"]
# the whole model on the dates before the test dates: two-stage fit, adjusted and spilled series, autoregression
MODEL = [
    *SUPPLIER_DENSE,
    "dn AS (SELECT t, row_number() OVER (ORDER BY t) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM sd))",
    f"""sr AS (SELECT sd.*, CASE WHEN region % 5 <= 1 THEN 1 ELSE 0 END AS treated, CASE WHEN t >= DATE '{POST_START}' THEN 1 ELSE 0 END AS post
      FROM sd JOIN dn USING (t) WHERE rn <= n - CAST(floor(n * {AHEAD / 80!r}) AS BIGINT))""",
    *SUPPLIER_EDGES,
    lagged("sl", "sr", "se"),
    "n2 AS (SELECT *, avg(lag) OVER (PARTITION BY region) AS projected FROM sl)",
    *did("n2", "projected"),
    f"ad AS (SELECT region, t, y - {value_of('delta')} * treated * post AS y_adjusted FROM sr)",
    lagged("al", "ad", "se", "y_adjusted", "la"),
    f"zz AS (SELECT region, t, y_adjusted + {value_of('rho')} * la AS y FROM al)",
    *scaled_rows("zz"),
    *FIRST_ORDER,
]


# the dates before the last ones, one lag and one covariate
COVARIATE = [
    *SUPPLIER_DENSE,
    "dn AS (SELECT t, row_number() OVER (ORDER BY t) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM sd))",
    f"tr AS (SELECT sd.* FROM sd JOIN dn USING (t) WHERE rn <= n - CAST(floor(n * {AHEAD / 80!r}) AS BIGINT))",
    *scaled_rows("tr"),
    "ac AS (SELECT ar.*, tr.c1 FROM ar JOIN tr USING (region, t) WHERE l1 IS NOT NULL)",
    """av AS (SELECT avg(x) AS mx, avg(l1) AS m1, avg(c1) AS m2, var_pop(l1) AS v11, var_pop(c1) AS v22, covar_pop(l1, c1) AS v12,
      covar_pop(x, l1) AS g1, covar_pop(x, c1) AS g2 FROM ac)""",
    "ab AS (SELECT *, (v22 * g1 - v12 * g2) / (v11 * v22 - v12 * v12) AS phi, (v11 * g2 - v12 * g1) / (v11 * v22 - v12 * v12) AS gamma FROM av)",
    "am AS (SELECT phi, gamma, mx - phi * m1 - gamma * m2 AS c FROM ab)",
    "m1 AS (SELECT phi, gamma, c, (SELECT sqrt(avg(power(x - c - phi * l1 - gamma * c1, 2))) FROM ac, am) AS sigma FROM am)",
]


def stated(noise: str) -> str:
    """Paths of stated parameters; ``noise`` is a unit draw from the uniforms u and v."""
    parts = [*SCALED, *draws()[:1]]
    for s in range(1, AHEAD + 1):
        u, v = uniform("region", "sample_id", str(s), "'u'"), uniform("region", "sample_id", str(s), "'v'")
        parts.append(f"u{s} AS (SELECT *, {u} AS u, {v} AS v FROM p{s - 1})")
        step = f"{STATED['intercept']!r} + {STATED['phi']!r} * x{s - 1} + {STATED['spread']!r} * ({noise}) AS x{s}"
        parts.append(f"p{s} AS (SELECT * EXCLUDE (u, v), {step} FROM u{s})")
    return steps(*parts, _path_rows(value="greatest(0, x{} * scale)"))


def draws(covariate: str | None = None) -> list[str]:
    parts = [
        f"""p0 AS (SELECT region, sample_id, t AS last, scale, x AS x0 FROM ar
      CROSS JOIN (SELECT unnest(range(1, {SAMPLES + 1})) AS sample_id) WHERE back = 1)"""
    ]
    for s in range(1, AHEAD + 1):
        normal = gauss(uniform("region", "sample_id", str(s), "'u'"), uniform("region", "sample_id", str(s), "'v'"))
        if covariate:
            ahead = f"JOIN sd ON sd.region = p{s - 1}.region AND sd.t = CAST(p{s - 1}.last + INTERVAL {s} MONTH AS DATE)"
            normal = normal.replace("CAST(region ", f"CAST(p{s - 1}.region ")
            parts.append(f"p{s} AS (SELECT p{s - 1}.*, c + phi * x{s - 1} + gamma * sd.{covariate} + sigma * {normal} AS x{s} FROM p{s - 1} {ahead} CROSS JOIN m1)")
        else:
            parts.append(f"p{s} AS (SELECT p{s - 1}.*, c + phi * x{s - 1} + sigma * {normal} AS x{s} FROM p{s - 1}, m1)")
    return parts


def _path_rows(rounded: bool = True, value: str = "x{} * scale") -> str:
    return " UNION ALL ".join(
        f"""SELECT region, CAST({s} AS INTEGER) AS step, CAST(CAST(last + INTERVAL {s} MONTH AS DATE) AS VARCHAR) AS t, CAST(sample_id AS INTEGER) AS sample_id,
      {r(value.format(s), 4, 'value') if rounded else f'{value.format(s)} AS value'} FROM p{AHEAD}"""
        for s in range(1, AHEAD + 1)
    )


# --- synthetic values -------------------------------------------------------------------------


def synthetic() -> str:
    def normal(slot: str) -> str:
        return gauss(uniform("region", "step", f"'{slot}u'"), uniform("region", "step", f"'{slot}v'"))

    return "WITH RECURSIVE " + ",\n".join(
        [
            *USER_DENSE,
            "s0 AS (SELECT region, t, CAST(t - (SELECT min(t) FROM up) AS BIGINT) AS step FROM ud)",
            f"s1 AS (SELECT *, {', '.join(f'{normal(f'c{k}')} AS c{k}' for k in range(1, 5))}, {normal('r')} AS nr, {normal('e')} AS ne FROM s0)",
            f"""s2 AS (SELECT *, 0.1e0 * step + 10e0 * sin({2 * math.pi!r} * step / 7) + 2e0 * nr + 0.1e0 * ne
      + 0.5e0 * c1 - 0.3e0 * c2 + 0.2e0 * c3 + 0.1e0 * c4 AS own FROM s1)""",
            "sb AS (SELECT step, avg(own) AS b FROM s2 GROUP BY step)",
            "sm AS (SELECT step, b AS m FROM sb WHERE step = 0 UNION ALL SELECT sb.step, sb.b + 0.3e0 * sm.m FROM sm JOIN sb ON sb.step = sm.step + 1)",
        ]
    ) + f"""
    SELECT region, CAST(t AS VARCHAR) AS t, {r('greatest(0e0, own + 0.3e0 * coalesce(m, 0))', 5, 'y')}, {rs('c1 c2 c3 c4', 5)}
    FROM s2 LEFT JOIN sm ON sm.step = s2.step - 1"""


def _nll(loss: str) -> str:
    return steps(
        *USER_FILLED,
        "mo AS (SELECT region, avg(y) / 2 * 2 AS l, (stddev_pop(y) + 1) / 2 * 2 AS s FROM uf GROUP BY region)",
        f"SELECT region, {r(f'avg({loss})', 6, 'nll')} FROM uf JOIN mo USING (region) GROUP BY region",
    )


_STUDENT = math.lgamma(2.5) - math.lgamma(3.0) + 0.5 * math.log(5 * math.pi)


def _kernel(shape: str, bandwidth: str) -> str:
    return steps(
        SUPPLIERS,
        pairs("pr", "sup"),
        f"bw AS (SELECT {bandwidth} AS h FROM pr WHERE i < j)",
        f"SELECT i, j, {r('w')} FROM (SELECT i, j, {shape} AS w FROM pr, bw) WHERE w <> 0",
    )


def _quantile_columns() -> str:
    columns = []
    for p, z in ((0.05, -1.6448536269514722), (0.9, 1.2815515655446004)):
        tag = int(p * 100)
        laplace = math.log(2 * p) if p < 0.5 else -math.log(2 * (1 - p))
        columns += [
            r(f"l + s * {z!r}", 5, f"gaussian_{tag}"),
            r(f"l + s * {laplace!r}", 5, f"laplace_{tag}"),
            r(f"l + s * {student_quantile(p, 5.0)!r}", 5, f"student_t_{tag}"),
        ]
    return ", ".join(columns)


UP = "SELECT region, " + text()
_P, _A = 8, 3


def oracle_sql() -> dict[str, str]:
    interpolate_daily, daily_out = interpolation("ud", "y c1")
    interpolate_hours, hourly_out = interpolation("td", "y")
    window_columns = (
        f"{packed(padded('pv', _P, '0e0'), 'past')}, {packed('fv', 'future')}, {plain(padded('po', _P), 'past_observed')}, "
        f"{plain('fo', 'future_observed')}, {plain(f'list_concat(list_transform(range({_P} - len(pv)), lambda z: 1), list_transform(pv, lambda z: 0))', 'is_pad')}"
    )
    last = "(SELECT region, t, y, row_number() OVER (PARTITION BY region ORDER BY t DESC) AS back FROM ud)"
    obs = "CASE WHEN y IS NULL THEN 0 ELSE 1 END"

    def prediction(skip: int) -> list[str]:
        return [
            *USER_DENSE,
            f"""pw AS (SELECT region, max(t) FILTER (WHERE back > {skip}) AS last_known,
      coalesce(list(coalesce(y, 0) ORDER BY t) FILTER (WHERE back > {skip}), []) AS pv, coalesce(list({obs} ORDER BY t) FILTER (WHERE back > {skip}), []) AS po,
      coalesce(list(coalesce(y, 0) ORDER BY t) FILTER (WHERE back <= {skip}), []) AS fv, coalesce(list({obs} ORDER BY t) FILTER (WHERE back <= {skip}), []) AS fo
      FROM {last} WHERE back <= {_P + skip} GROUP BY region)""",
            f"SELECT region, {text('last_known')}, {window_columns} FROM pw WHERE len(pv) > 0",
        ]

    def joined(past: str, ahead: str, first: int) -> str:
        both = f"list_concat({past}, {ahead})"
        return f"list_slice({both}, {first}, {first} + {_P - 1 + _A} - 1)"

    settings = model_settings()
    sql = {
        "panel_long": steps(NATION, f"{UP}, {rs('y c1 c2', 7)} FROM np WHERE t BETWEEN DATE '1995-06-01' AND DATE '2000-12-01'"),
        "panel_wide_unpivot": f"""SELECT s AS region, CAST(t AS VARCHAR) AS t, {r('count(o_orderstatus)', 6, 'y')} FROM
            (SELECT DISTINCT CAST(o_orderdate AS DATE) AS t FROM orders) CROSS JOIN (SELECT unnest(['F', 'O', 'P']) AS s)
            LEFT JOIN orders ON CAST(o_orderdate AS DATE) = t AND o_orderstatus = s GROUP BY 1, 2""",
        "panel_densify": steps(*USER_DENSE, f"{UP}, {rs('y c1')} FROM ud"),
        "panel_densify_hourly": steps(*TYPE_DENSE, f"{UP}, {rs('y')} FROM td"),
        "panel_duplicates": """SELECT user_id AS region, CAST(CAST(ts AS DATE) AS VARCHAR) AS t, count(*) AS copies
            FROM events GROUP BY 1, 2 HAVING count(*) > 1""",
        "panel_regions": "SELECT DISTINCT l_suppkey AS region FROM lineitem WHERE l_suppkey % 5 <= 1",
        "region_attributes": steps(SUPPLIER, f"{UP}, CASE WHEN region IN (0, 1, 2, 3, 5, 8, 13, 21) THEN 1 ELSE 0 END AS treated, {rs('y')} FROM sp"),
        "calendar_post": steps(SUPPLIER, f"{UP}, CASE WHEN t >= DATE '{POST_START}' THEN 1 ELSE 0 END AS post, {rs('y')} FROM sp"),
        "design_rows": steps(
            *NATION_LAG, f"{UP}, {r('1', 6, 'one')}, {r('treated * post', 6, 'treated_post')}, {rs('y treated post c2 lag')} FROM nl"
        ),
        "wide_country_loaded": steps(
            SEGMENT,
            dense("sgd", "sg", "y reproduction_rate stringency_index"),
            "sgw AS (SELECT * FROM sgd WHERE t BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')",
            interpolation("sgw", "y reproduction_rate stringency_index")[0],
            f"iu AS ({interpolation('sgw', 'y reproduction_rate stringency_index', 13)[1]})",
            scaled("iu", ["y", "reproduction_rate stringency_index"], "minmax"),
        ),
        "guard_absent_regions": steps(
            "pa AS (SELECT DISTINCT l_suppkey AS region FROM lineitem)",
            "di AS (SELECT s_suppkey + CASE WHEN s_suppkey % 7 = 0 THEN 1000000 ELSE 0 END AS region FROM supplier WHERE s_suppkey % 3 > 0)",
            """SELECT region, 'region dimension' AS absent_from FROM pa ANTI JOIN di USING (region)
            UNION ALL SELECT region, 'panel' FROM di ANTI JOIN pa USING (region)""",
        ),
        "wide_country_source": steps(
            SEGMENT,
            dense("sgd", "sg", "y reproduction_rate stringency_index"),
            f"{UP}, {rs('y reproduction_rate stringency_index', 7)} FROM sgd WHERE t BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'",
        ),
        "long_country_source": steps(
            SEGMENT,
            "sw AS (SELECT * FROM sg WHERE region IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') AND t BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')",
            dense("sgd", "sw", "y reproduction_rate stringency_index"),
            f"""SELECT region, CAST(t AS VARCHAR) AS t, {r('coalesce(y, 0)', 7, 'y')},
            {r('coalesce(last_value(reproduction_rate IGNORE NULLS) OVER o, 0)', 7, 'reproduction_rate')},
            {r('coalesce(last_value(stringency_index IGNORE NULLS) OVER o, 0)', 7, 'stringency_index')}
            FROM sgd WINDOW o AS (PARTITION BY region ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        ),
        "synthetic_panel": synthetic(),
        "interpolate_linear": steps(*USER_DENSE, interpolate_daily, daily_out),
        "interpolate_hourly": steps(*TYPE_DENSE, interpolate_hours, hourly_out),
        "interpolate_gap_runs": steps(*TYPE_DENSE, interpolate_hours, hourly_out),
        "filled_means_gap_runs": steps(
            *USER_DENSE,
            interpolate_daily,
            f"iu AS ({interpolation('ud', 'y c1', 13)[1]})",
            f"SELECT region, count(y) AS y_n, count(c1) AS c1_n, {r('avg(y)', 6, 'y_mean')}, {r('avg(c1)', 6, 'c1_mean')} FROM iu GROUP BY region",
        ),
        "ffill": steps(
            *USER_DENSE,
            f"""{UP}, {r('last_value(y IGNORE NULLS) OVER o', 6, 'y')}, {r('last_value(c1 IGNORE NULLS) OVER o', 6, 'c1')} FROM ud
            WINDOW o AS (PARTITION BY region ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        ),
        "dropna": steps(*USER_DENSE, f"{UP}, {rs('y c1')} FROM ud WHERE y IS NOT NULL AND c1 IS NOT NULL"),
        "zero_fill": steps(*USER_FILLED, f"{UP}, {rs('y c1')} FROM uf"),
        "ph_fill_rule": steps(
            *USER_DENSE,
            f"""{UP}, {r('coalesce(y, 0)', 6, 'y')}, {r('coalesce(last_value(c1 IGNORE NULLS) OVER o, 0)', 6, 'c1')} FROM ud
            WINDOW o AS (PARTITION BY region ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        ),
        "observed_mask": steps(*USER_DENSE, f"{UP}, CASE WHEN y IS NULL THEN 0 ELSE 1 END AS observed, {r('coalesce(y, 0)', 6, 'y')} FROM ud"),
        "minmax": steps(*USER_FILLED, scaled("(SELECT region, t, y FROM uf)", ["y"], "minmax")),
        "standard": steps(*USER_FILLED, scaled("(SELECT region, t, y FROM uf)", ["y"], "standard")),
        "pooled_covariate_scale": steps(*SUPPLIER_DENSE, scaled("sd", ["y", "c1 c2"], "standard")),
        "separate_covariate_scale": steps(*SUPPLIER_DENSE, scaled("sd", ["y", "c1", "c2"], "minmax")),
        "unscaled": steps(*USER_FILLED, f"{UP}, {rs('y')} FROM uf"),
        "load_pipeline": steps(*USER_DENSE, interpolate_daily, f"iu AS ({interpolation('ud', 'y c1', 13)[1]})", scaled("iu", ["y", "c1"], "minmax")),
        "inverse_roundtrip": steps(*USER_FILLED, f"{UP}, {rs('y c1')} FROM uf"),
        "window_mean_scale": steps(
            *USER_DENSE,
            f"""{UP}, {r('CASE WHEN avg(abs(y)) OVER o > 0 THEN avg(abs(y)) OVER o ELSE 1 END', 6, 'scale')} FROM ud
            WINDOW o AS (PARTITION BY region ORDER BY t ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
        ),
        "window_mean_scale_hourly": steps(
            *TYPE_DENSE,
            f"""{UP}, {r('CASE WHEN avg(abs(y)) OVER o > 0 THEN avg(abs(y)) OVER o ELSE 1 END', 6, 'scale')} FROM td
            WINDOW o AS (PARTITION BY region ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""",
        ),
        "window_scale_gap_runs": steps(
            *TYPE_DENSE,
            f"""{UP}, {r('CASE WHEN avg(abs(y)) OVER o > 0 THEN avg(abs(y)) OVER o ELSE 1 END', 6, 'scale')} FROM td
            WINDOW o AS (PARTITION BY region ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""",
        ),
        "temporal_split": steps(
            *USER_FILLED,
            "ds AS (SELECT t, row_number() OVER (ORDER BY t) AS n, count(*) OVER () AS all_n FROM (SELECT DISTINCT t FROM uf))",
            f"SELECT region, {text('uf.t').replace('AS uf.t', 'AS t')}, CASE WHEN n <= all_n - CAST(floor(all_n * 0.2e0) AS BIGINT) THEN 'train' ELSE 'test' END AS part, {rs('y')} FROM uf JOIN ds USING (t)",
        ),
        "data_info": steps(
            USER,
            """SELECT count(DISTINCT region) AS n_regions, count(DISTINCT t) AS n_timepoints, 'y' AS target_column, 'c1' AS covariate_columns,
            'minmax' AS scaling_method, 'interpolate' AS handle_missing FROM up""",
        ),
        "series_records": steps(
            *USER_FILLED,
            f"""SELECT region, CAST(min(t) AS VARCHAR) AS start, {packed('list(y ORDER BY t)', 'target')},
            CAST(row_number() OVER (ORDER BY region) - 1 AS VARCHAR) AS feat_static_cat,
            array_to_string(list(CAST(c1 AS BIGINT) ORDER BY t), ',') AS feat_dynamic_real FROM uf GROUP BY region""",
        ),
        "series_records_ahead": steps(
            *USER_DENSE,
            *TRAIN_DATES,
            f"""SELECT region, {packed('list(coalesce(y, 0) ORDER BY t) FILTER (WHERE rn <= cut)', 'target')},
            array_to_string(list(CAST(coalesce(c1, 0) AS BIGINT) ORDER BY t), ',') AS feat_dynamic_real FROM ud JOIN ds USING (t) GROUP BY region""",
        ),
        "dist_pairs": steps(SUPPLIERS, pairs("pr", "sup"), f"SELECT i, j, {r('d')} FROM pr"),
        "w_binary": steps(*NEAR_EDGES, f"SELECT i, j, {r('w')} FROM be"),
        "w_distance": steps(*NEAR_EDGES, f"SELECT i, j, {r('1 / d', 6, 'w')} FROM cp WHERE d <= {NEAR} AND d > 0"),
        "w_distance_power": steps(*NEAR_EDGES, f"SELECT i, j, {r('d * d', 6, 'w')} FROM cp WHERE d <= {NEAR} AND d > 0"),
        "default_bandwidths": steps(
            CUSTOMERS,
            pairs("cp", "cus"),
            "bw AS (SELECT median(d) AS h, max(d) AS m FROM cp WHERE i < j)",
            f"""SELECT {r('any_value(h)', 6, 'median')}, {r('any_value(m)', 6, 'largest')}, count(*) FILTER (WHERE d <= h / 100) AS edges,
            {r('sum(exp(-d * d / (2 * h * h))) FILTER (WHERE d <= h / 100)', 4, 'weight')} FROM cp, bw""",
        ),
        "w_distance_full": steps(SUPPLIERS, pairs("pr", "sup"), f"SELECT i, j, {r('1 / d', 6, 'w')} FROM pr WHERE d > 0"),
        "w_knn": steps(
            CUSTOMERS,
            """kn AS (SELECT a.region AS i, b.region AS j, row_number() OVER (PARTITION BY a.region
            ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.region) AS n FROM cus a JOIN cus b ON a.region <> b.region)""",
            f"SELECT i, j, {r('1', 6, 'w')} FROM kn WHERE n <= 4",
        ),
        "w_knn_embedding": steps(
            "em AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
            "kn AS (SELECT a.vec_id AS i, b.vec_id AS j, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS n FROM em a JOIN em b ON a.vec_id <> b.vec_id)",
            f"SELECT i, j, {r('1', 6, 'w')} FROM kn WHERE n <= 5",
        ),
        "w_custom": steps(
            """gv AS (SELECT c_nationkey AS i, s_nationkey AS j, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey
            JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)""",
            normalised("gn", "gv"),
            f"SELECT i, j, {r('w')} FROM gn WHERE w <> 0",
        ),
        "w_contiguity": steps(*SUPPLIER_EDGES, f"SELECT i, j, {r('w')} FROM se0"),
        "w_gaussian": _kernel("exp(-(d * d) / (2 * h * h))", "median(d)"),
        "w_exponential": _kernel("exp(-d / h)", "median(d)"),
        "w_gaussian_near": steps(CUSTOMERS, pairs("cp", "cus"), f"SELECT i, j, {r(f'exp(-(d * d) / {2 * NEAR * NEAR})', 6, 'w')} FROM cp WHERE d <= {2 * NEAR}"),
        "w_exponential_near": steps(CUSTOMERS, pairs("cp", "cus"), f"SELECT i, j, {r(f'exp(-d / {NEAR})', 6, 'w')} FROM cp WHERE d <= {2 * NEAR}"),
        "w_linear": _kernel("greatest(0, 1 - d / h)", "max(d)"),
        "w_linear_near": steps(CUSTOMERS, pairs("cp", "cus"), f"SELECT i, j, {r(f'1 - d / {2 * NEAR}', 6, 'w')} FROM cp WHERE d < {2 * NEAR}"),
        "w_normalised": steps(
            *NEAR_EDGES,
            f"ie AS (SELECT i, j, 1 / d AS w FROM cp WHERE d <= {NEAR} AND d > 0)",
            normalised("ine", "ie"),
            f"SELECT i, j, {r('w')} FROM ine",
        ),
        "w_validate": steps(
            *NEAR_EDGES,
            normalised("bn", "be"),
            """c AS (SELECT CAST(NOT EXISTS (SELECT 1 FROM bn WHERE i NOT IN (SELECT region FROM cus) OR j NOT IN (SELECT region FROM cus)) AS INTEGER) AS square,
            CAST(count(*) FILTER (WHERE w < 0) = 0 AS INTEGER) AS non_negative, CAST(count(*) FILTER (WHERE i = j AND abs(w) > 1e-8) = 0 AS INTEGER) AS zero_diagonal,
            CAST(NOT EXISTS (SELECT 1 FROM bn a FULL JOIN bn b ON a.i = b.j AND a.j = b.i
              WHERE abs(coalesce(a.w, 0) - coalesce(b.w, 0)) > 1e-8 + 1e-5 * abs(coalesce(b.w, 0))) AS INTEGER) AS symmetric FROM bn)""",
            "SELECT *, square * non_negative * zero_diagonal AS valid FROM c",
        ),
        "w_statistics": steps(
            *NEAR_EDGES,
            normalised("bn", "be"),
            f"""SELECT (SELECT count(*) FROM cus) AS n_regions, {r('count(*) FILTER (WHERE w <> 0) / (SELECT CAST(count(*) AS DOUBLE) * count(*) FROM cus)', 8, 'density')},
            {r('coalesce(avg(w), 0)', 8, 'mean_weight')}, {r('coalesce(max(w), 0)', 8, 'max_weight')}, {r('coalesce(min(w), 0)', 8, 'min_weight')},
            CAST(NOT EXISTS (SELECT 1 FROM bn a FULL JOIN bn b ON a.i = b.j AND a.j = b.i
              WHERE abs(coalesce(a.w, 0) - coalesce(b.w, 0)) > 1e-8 + 1e-5 * abs(coalesce(b.w, 0))) AS INTEGER) AS is_symmetric,
            CAST((SELECT count(DISTINCT i) FROM bn) = (SELECT count(*) FROM cus) AS INTEGER) AS is_normalised FROM bn""",
        ),
        "w_row_col_sums": steps(
            *NEAR_EDGES,
            normalised("bn", "be"),
            f"""SELECT region, {r('coalesce((SELECT sum(w) FROM bn WHERE i = region), 0)', 6, 'row_sum')},
            {r('coalesce((SELECT sum(w) FROM bn WHERE j = region), 0)', 6, 'col_sum')} FROM cus""",
        ),
        "lag": steps(*SUPPLIER_LAG, f"{UP}, {rs('y lag')} FROM sl"),
        "lag_full_kernel": steps(
            *SUPPLIER_DENSE, SUPPLIERS, pairs("pr", "sup"),
            "bw AS (SELECT median(d) AS h FROM pr WHERE i < j)",
            "kw AS (SELECT i, j, exp(-d * d / (2 * h * h)) AS w FROM pr, bw)",
            "ks AS (SELECT i, t, sum(w * y) / sum(w) AS lag FROM kw JOIN sd ON region = j GROUP BY i, t)",
            f"SELECT sd.region, CAST(sd.t AS VARCHAR) AS t, {rs('y lag', 4)} FROM sd JOIN ks ON i = region AND ks.t = sd.t",
        ),
        "lag_full_kernel_sums": steps(
            *USER_DENSE,
            "us AS (SELECT DISTINCT region, region % 37 AS x, region % 11 AS y FROM up)",
            pairs("pr", "us"),
            "uk AS (SELECT region, t, CASE WHEN day(t) > 2 THEN coalesce(y, 0) ELSE y END AS y FROM ud)",
            """ks AS (SELECT i, t, CASE WHEN count(y) = count(*) THEN sum(exp(-d * d / 72e0) * y) END AS lag FROM pr JOIN uk ON region = j GROUP BY i, t)""",
            f"SELECT region, CAST(uk.t AS VARCHAR) AS t, {rs('lag', 4)} FROM uk JOIN ks ON i = region AND ks.t = uk.t",
        ),
        "lag_isolated": steps(
            *USER_DENSE,
            """ue AS (SELECT a.region AS i, b.region AS j, 1e0 AS w FROM (SELECT DISTINCT region FROM up) a
            JOIN (SELECT DISTINCT region FROM up) b ON a.region % 2 = 0 AND b.region = a.region + 1)""",
            lagged("ul", "ud", "ue"),
            f"{UP}, {rs('y lag')} FROM ul",
        ),
        "did_plain": steps(*SUPPLIER_ROWS, *did("sr", None), TIDY),
        "did_spatial_ols": steps(*NATION_LAG, *did("nl"), TIDY),
        "did_spatial_ols_supplier": steps(*SUPPLIER_LAG, *did("sl"), TIDY),
        "did_spatial_2sls": steps(*NATION_LAG, "n2 AS (SELECT *, avg(lag) OVER (PARTITION BY region) AS projected FROM nl)", *did("n2", "projected"), TIDY),
        "did_spatial_2sls_supplier": steps(
            *SUPPLIER_LAG, "n2 AS (SELECT *, avg(lag) OVER (PARTITION BY region) AS projected FROM sl)", *did("n2", "projected"), TIDY
        ),
        "did_2sls_lags": steps(
            *SUPPLIER_ROWS, *SUPPLIER_EDGES, lagged("w1", "sr", "se", "c1", "wc"), lagged("w2", "w1", "se", "wc", "wwc"), lagged("w3", "w2", "se"),
            "fw0 AS (SELECT treated, post, y, lag AS x, c1 AS c, wc, wwc FROM w3)",
            """d0 AS (SELECT y - avg(y) OVER k AS y, x - avg(x) OVER k AS l, c - avg(c) OVER k AS c, wc - avg(wc) OVER k AS a, wwc - avg(wwc) OVER k AS b
            FROM fw0 WINDOW k AS (PARTITION BY treated, post))""",
            "s0 AS (SELECT sum(c*c) AS cc, sum(c*a) / sum(c*c) AS ca, sum(c*b) / sum(c*c) AS cb, sum(c*l) / sum(c*c) AS cl, sum(c*y) / sum(c*c) AS cy FROM d0)",
            "d1 AS (SELECT a - ca*c AS a, b - cb*c AS b, l - cl*c AS l, y - cy*c AS y FROM d0, s0)",
            "s1 AS (SELECT sum(a*a) AS aa, sum(a*b) AS ab, sum(b*b) AS bb, sum(a*l) AS al, sum(b*l) AS bl, sum(a*y) AS ay, sum(b*y) AS gy FROM d1)",
            "pq AS (SELECT *, (bb*al - ab*bl) / (aa*bb - ab*ab) AS p, (aa*bl - ab*al) / (aa*bb - ab*ab) AS q FROM s1)",
            "rh AS (SELECT (p*ay + q*gy) / (p*p*aa + 2*p*q*ab + q*q*bb) AS rho FROM pq)",
            "fb AS (SELECT rho, cy - rho * cl AS gamma FROM rh, s0)",
            *did("w3", "lag", "c1")[4:], TIDY,
        ),
        "did_ml_likelihood": steps(
            *NATION_LAG,
            "dm AS (SELECT y - avg(y) OVER k AS y, lag - avg(lag) OVER k AS l FROM nl WINDOW k AS (PARTITION BY treated, post))",
            "rr AS (SELECT unnest([-0.5e0, 0e0, 0.3e0, 0.6e0]) AS rho)",
            "er AS (SELECT rho, sum((y - rho * l) * (y - rho * l)) AS sse, count(*) AS n FROM dm, rr GROUP BY rho)",
            # eigenvalues of a block of m nations that all touch: 1, and m - 1 times -1 / (m - 1)
            """de AS (SELECT rho, sum(CASE WHEN m > 1 THEN ln(1 - rho) + (m - 1) * ln(1 + rho / (m - 1)) ELSE 0 END) AS d
            FROM (SELECT n_regionkey, count(*) AS m FROM nation WHERE n_nationkey IN (SELECT region FROM nd) GROUP BY 1), rr GROUP BY rho)""",
            f"""SELECT rho, {r(f'(SELECT count(DISTINCT t) FROM nl) * d - n / 2e0 * (ln({2 * math.pi!r} * sse / n) + 1)', 4, 'likelihood')}, {r('sse', 4)}
            FROM er JOIN de USING (rho)""",
        ),
        "did_ml_optimum": steps(*NATION_DENSE, "SELECT CAST(unnest([-1, 1]) AS INTEGER) AS side, true AS lower, (SELECT count(*) FROM nd) AS n"),
        "did_spatial_cov1": steps(*NATION_LAG, *did("nl", "lag", "c2"), TIDY),
        "did_fitted": steps(*SUPPLIER_LAG, *did("sl"), fitted("sl"), f"{UP}, {rs('y fitted', 5)}, {r('y - fitted', 5, 'residual')} FROM ft"),
        "did_r_squared": steps(
            *SUPPLIER_LAG, *did("sl"), fitted("sl"), f"SELECT {r('1 - sum((y - fitted) * (y - fitted)) / (var_pop(y) * count(y))', 6, 'r_squared')} FROM ft"
        ),
        "causal_adjust": steps(
            *NATION_LAG, *did("nl"), f"{UP}, {rs('y')}, {r(f'y - {value_of('delta')} * treated * post', 6, 'y_adjusted')} FROM nl"
        ),
        "spatial_adjust": steps(
            *NATION_LAG,
            *did("nl"),
            f"ad AS (SELECT region, t, y - {value_of('delta')} * treated * post AS y_adjusted FROM nl)",
            lagged("al", "ad", "ne", "y_adjusted", "la"),
            f"{UP}, {rs('y_adjusted')}, {r(f'y_adjusted + {value_of('rho')} * la', 6, 'z')} FROM al",
        ),
        "interpretation": steps(
            *NATION_LAG,
            *did("nl", "lag", "c2"),
            """SELECT CASE param WHEN 'delta' THEN 'treatment_effect' WHEN 'rho' THEN 'spatial_spillover' ELSE 'reproduction_rate_effect' END AS insight,
            CASE WHEN param = 'delta' THEN CASE WHEN value < -0.1 THEN 'Strong negative effect - interventions effectively reduce cases'
                WHEN value > 0.1 THEN 'Positive effect - interventions may increase cases' ELSE 'Limited intervention effectiveness' END
              WHEN param = 'rho' THEN CASE WHEN abs(value) > 0.3 THEN 'Strong spatial correlation - neighboring regions significantly influence local outcomes'
                ELSE 'Weak spatial correlation - limited cross-regional influence' END
              WHEN value > 0 THEN 'Positive effect - higher values increase cases' ELSE 'Negative effect - higher values decrease cases' END AS meaning
            FROM pa WHERE param IN ('delta', 'rho', 'gamma')""",
        ),
        "did_standard_errors": errors("SELECT param, sqrt(sum(h * h) * any_value(v)) AS e FROM hh CROSS JOIN (SELECT sum(e * e) / (count(*) - 6) AS v FROM fx) GROUP BY param"),
        "did_clustered_errors": errors(
            """SELECT param, sqrt(sum(s * s) * any_value(f)) AS e FROM (SELECT param, region, sum(h * e) AS s FROM hh GROUP BY ALL)
            CROSS JOIN (SELECT count(DISTINCT region) / (count(DISTINCT region) - 1.0) * (count(*) - 1) / (count(*) - 6) AS f FROM fx) GROUP BY param"""
        ),
        "did_near_errors": errors(
            f"""SELECT param, sqrt(sum(s)) AS e FROM (SELECT param, h * e * h * e AS s FROM hh UNION ALL SELECT a.param, a.h * a.e * b.h * b.e * (1 - d / {2 * NEAR})
            FROM np2 JOIN hh a ON a.region = np2.i JOIN hh b ON b.region = np2.j AND b.t = a.t AND b.param = a.param) GROUP BY param""",
            SUPPLIERS, pairs("pr", "sup"), f"np2 AS (SELECT * FROM pr WHERE d < {2 * NEAR})",
        ),
        "train_windows": steps(*USER_DENSE, *training("ud", _P, _A), f"SELECT region, CAST(t AS VARCHAR) AS forecast_start, {window_columns} FROM tk"),
        "train_windows_sampled": steps(
            *USER_DENSE,
            *training("ud", _P, _A),
            f"""SELECT region, CAST(t AS VARCHAR) AS forecast_start, {packed('fv', 'future')} FROM tk JOIN
            (SELECT region, count(*) AS eligible FROM tk GROUP BY region) USING (region) WHERE {uniform('region', 't')} * eligible < 1""",
        ),
        "train_windows_hourly": steps(
            *TYPE_DENSE,
            *training("td", 5, 2),
            f"SELECT region, CAST(t AS VARCHAR) AS forecast_start, {packed(padded('pv', 5, '0e0'), 'past')}, {packed('fv', 'future')} FROM tk",
        ),
        "train_windows_covariate": steps(
            *USER_DENSE,
            f"""tw AS (SELECT region, t, list(coalesce(c1, 0)) OVER p AS pv, list(coalesce(c1, 0)) OVER f AS fv FROM ud WINDOW
            p AS (PARTITION BY region ORDER BY t ROWS BETWEEN {_P} PRECEDING AND 1 PRECEDING),
            f AS (PARTITION BY region ORDER BY t ROWS BETWEEN CURRENT ROW AND {_A - 1} FOLLOWING))""",
            f"""SELECT region, CAST(t AS VARCHAR) AS forecast_start, {packed(padded('pv', _P, '0e0'), 'past_c1')}, {packed('fv', 'future_c1')}
            FROM tw WHERE len(fv) = {_A} AND len(pv) > 0""",
        ),
        "predict_window_covariate": steps(
            *USER_DENSE,
            *TRAIN_DATES,
            f"""pw AS (SELECT region, max(t) FILTER (WHERE rn <= cut) AS last_known,
            list(coalesce(y, 0) ORDER BY t) FILTER (WHERE rn <= cut) AS pv, list(coalesce(c1, 0) ORDER BY t) FILTER (WHERE rn <= cut) AS cv,
            list(coalesce(c1, 0) ORDER BY t) FILTER (WHERE rn > cut) AS fv FROM ud JOIN ds USING (t) WHERE rn > cut - {_P} AND rn <= cut + {_A} GROUP BY region)""",
            f"SELECT region, {text('last_known')}, {packed('pv', 'past')}, {packed('cv', 'past_c1')}, {packed('fv', 'future_c1')} FROM pw",
        ),
        "predict_window": steps(*prediction(0)),
        "predict_window_holdout": steps(*prediction(_A)),
        "aligned_windows": steps(
            *USER_DENSE,
            *training("ud", _P, _A),
            f"tq AS (SELECT region, t, {padded('pv', _P, '0e0')} AS a, {padded('po', _P)} AS b, fv, fo FROM tk)",
            f"""SELECT region, CAST(t AS VARCHAR) AS forecast_start, {packed(joined('a', 'fv', 1), 'inputs')},
            {plain(joined('b', 'fo', 1), 'inputs_observed')}, {packed(joined('a', 'fv', 2), 'targets')} FROM tq""",
        ),
        "nll_gaussian": _nll(f"{0.5 * math.log(2 * math.pi)!r} + ln(s) + (y - l) * (y - l) / (2 * s * s)"),
        "nll_laplace": _nll("ln(2 * s) + abs(y - l) / s"),
        "nll_student_t": _nll(f"{_STUDENT!r} + ln(s) + 3 * ln(1 + (y - l) * (y - l) / (5 * s * s))"),
        "head_quantiles": steps(
            *USER_FILLED, "mo AS (SELECT region, avg(y) AS l, stddev_pop(y) AS s FROM uf GROUP BY region)", f"SELECT region, {_quantile_columns()} FROM mo"
        ),
        "ar1_fit": steps(
            *AR1,
            f"""SELECT param, CAST(idx AS INTEGER) AS idx, {r('value')} FROM (SELECT 'intercept' AS param, 0 AS idx, c AS value FROM m1
            UNION ALL SELECT 'phi', 1, phi FROM m1 UNION ALL SELECT 'spread', 0, sigma FROM m1)""",
        ),
        "ar2_fit": steps(
            *SCALED,
            "a2 AS (SELECT avg(x) AS mx, avg(l1) AS m1, avg(l2) AS m2, var_pop(l1) AS v11, var_pop(l2) AS v22, covar_pop(l1, l2) AS v12, covar_pop(x, l1) AS g1, covar_pop(x, l2) AS g2 FROM ar WHERE l2 IS NOT NULL)",
            "b2 AS (SELECT *, (v22 * g1 - v12 * g2) / (v11 * v22 - v12 * v12) AS p1, (v11 * g2 - v12 * g1) / (v11 * v22 - v12 * v12) AS p2 FROM a2)",
            "c2 AS (SELECT p1, p2, mx - p1 * m1 - p2 * m2 AS c FROM b2)",
            f"""SELECT param, CAST(idx AS INTEGER) AS idx, {r('value')} FROM (SELECT 'intercept' AS param, 0 AS idx, c AS value FROM c2 UNION ALL SELECT 'phi', 1, p1 FROM c2
            UNION ALL SELECT 'phi', 2, p2 FROM c2 UNION ALL SELECT 'spread', 0, sqrt(avg((x - c - p1 * l1 - p2 * l2) * (x - c - p1 * l1 - p2 * l2))) FROM ar, c2 WHERE l2 IS NOT NULL)""",
        ),
        "ar_laplace_optimality": steps(*SCALED, *COMPLETE, "SELECT unnest(['one', 'lag1', 'lag2', 'lag3', 'spread']) AS term, true AS balanced, n FROM cn"),
        "ar_student_scores": steps(*SCALED, *COMPLETE, "SELECT unnest(['one', 'lag1', 'lag2', 'lag3', 'spread']) AS term, 0e0 AS score, n FROM cn"),
        "stated_paths_laplace": stated("CASE WHEN u < 0.5e0 THEN ln(2e0 * u) ELSE -ln(2e0 * (1e0 - u)) END"),
        "stated_paths_student": stated(f"sqrt({STATED['nu']!r} * (power(u, -2e0 / {STATED['nu']!r}) - 1e0)) * cos(2e0 * {math.pi!r} * v)"),
        "ar_loss": steps(
            *AR1,
            f"""SELECT {r(f'avg({0.5 * math.log(2 * math.pi)!r} + ln(sigma * scale) + (x - c - phi * l1) * (x - c - phi * l1) / (2 * sigma * sigma))', 6, 'nll')},
            count(*) AS n FROM ar, m1 WHERE l1 IS NOT NULL""",
        ),
        "forecast_paths": steps(*AR1, *draws(), _path_rows()),
        "ar_covariate_fit": steps(
            *COVARIATE,
            f"""SELECT param, CAST(idx AS INTEGER) AS idx, {r('value')} FROM (SELECT 'intercept' AS param, 0 AS idx, c AS value FROM m1
            UNION ALL SELECT 'phi', 1, phi FROM m1 UNION ALL SELECT 'gamma', 0, gamma FROM m1 UNION ALL SELECT 'spread', 0, sigma FROM m1)""",
        ),
        "forecast_paths_covariate": steps(*COVARIATE, *draws("c1"), _path_rows()),
        "end_to_end_forecast": steps(
            *MODEL,
            *draws(),
            f"ep AS ({_path_rows(False)})",
            f"""SELECT region, step, CAST(t AS VARCHAR) AS t, CAST(count(*) AS BIGINT) AS num_samples, {r('avg(value)', 3, 'mean')}, {r('median(value)', 3, 'median')},
            {r('stddev_pop(value)', 3, 'std')}, {r('quantile_cont(value, 0.1)', 3, 'quantile_10')}, {r('quantile_cont(value, 0.9)', 3, 'quantile_90')}
            FROM ep GROUP BY region, step, t""",
        ),
        "model_summary": steps(
            *MODEL,
            f"""cf AS (SELECT unnest({[k for k, _ in model_settings()]!r}) AS name, unnest({[v for _, v in model_settings()]!r}) AS setting)""",
            f"""SELECT * FROM cf UNION ALL SELECT 'n_regions', CAST(count(*) AS VARCHAR) FROM supplier
            UNION ALL SELECT param, CAST(CAST(round(value * 1000000) AS BIGINT) AS VARCHAR) FROM pa
            UNION ALL SELECT 'treatment_effect', CASE WHEN value < -0.1 THEN 'Strong negative effect - interventions effectively reduce cases'
              WHEN value > 0.1 THEN 'Positive effect - interventions may increase cases' ELSE 'Limited intervention effectiveness' END FROM pa WHERE param = 'delta'
            UNION ALL SELECT 'spatial_spillover', CASE WHEN abs(value) > 0.3 THEN 'Strong spatial correlation - neighboring regions significantly influence local outcomes'
              ELSE 'Weak spatial correlation - limited cross-regional influence' END FROM pa WHERE param = 'rho'""",
        ),
        "forecaster_info": f"""SELECT unnest({[k for k, _ in settings]!r}) AS name, unnest({[v for _, v in settings]!r}) AS setting""",
        "end_to_end_scores": steps(
            *MODEL,
            *draws(),
            f"ep AS ({_path_rows(False)})",
            "fc AS (SELECT region, CAST(t AS DATE) AS t, sample_id, value FROM ep)",
            f"tr AS (SELECT region, t, y FROM sd JOIN dn USING (t) WHERE rn > n - CAST(floor(n * {AHEAD / 80!r}) AS BIGINT))",
            "hi AS (SELECT region, t, y, row_number() OVER (PARTITION BY region ORDER BY t) AS n FROM sr)",
            CELLS[-1],
            ITEMS[-3].replace("a.n - 12", "a.n - 1"),
            *ITEMS[-2:],
            rows_out(AGGREGATE_ROWS, 4),
        ),
        "model_roundtrip": steps(*MODEL, *draws(), _path_rows()),
        "forecast_summary": steps(            *CELLS,
            f"""{UP}, {rs('mean')}, {r('med', 6, 'median')}, {rs('std')}, {r('q10', 6, 'quantile_10')}, {r('q90', 6, 'quantile_90')},
            CAST({MEMBERS} AS BIGINT) AS num_samples FROM ce""",
        ),
        "fan_table": steps(
            *ENSEMBLE,
            "qs AS (SELECT region, t, quantile_cont(value, [0.5, 0.25, 0.75, 0.05, 0.95]) AS q FROM fc GROUP BY region, t)",
            "nm AS (SELECT unnest(['median', 'lower_50', 'upper_50', 'lower_90', 'upper_90']) AS series, unnest([1, 2, 3, 4, 5]) AS k)",
            f"""SELECT region, CAST(t AS VARCHAR) AS t, series, {r('value')} FROM (SELECT region, t, 'history' AS series, y AS value FROM en WHERE back <= 24
            UNION ALL SELECT region, t, series, q[k] FROM qs CROSS JOIN nm UNION ALL SELECT region, t, 'truth', y FROM tr)""",
        ),
        "point_metrics": steps(*CELLS, score_row("mse mae rmse mape", 5)),
        "median_metrics": steps(*CELLS, score_row("median_mse median_mae", 5)),
        "uncertainty": steps(*CELLS, score_row("mean_std std_std", 6)),
        "coverage": steps(*CELLS, score_row("coverage_10 coverage_90", 6)),
        "metric_bundle": steps(*CELLS, rows_out(BUNDLE)),
        "spatial_metrics": steps(*SPATIAL, rows_out(SPATIAL_ROWS)),
        "item_metrics": steps(*ITEMS, f"SELECT region, {rs(ITEM_COLUMNS, 5)} FROM it"),
        "agg_metrics": steps(*ITEMS, rows_out(AGGREGATE_ROWS)),
        "metric_family": steps(
            *ITEMS,
            f"am AS ({' UNION ALL '.join(AGGREGATE_ROWS)})",
            """al AS (SELECT metric FROM am UNION ALL SELECT unnest(['beta_0', 'beta_1', 'beta_2', 'delta', 'rho']))""",
            """SELECT metric, CASE WHEN lower(metric) LIKE '%mse%' OR lower(metric) LIKE '%mae%' OR lower(metric) LIKE '%mape%' THEN 'forecast'
            WHEN lower(metric) SIMILAR TO '.*(delta|rho|gamma|treatment|spatial).*' THEN 'causal' ELSE 'spatial' END AS family FROM al""",
        ),
        "causal_evaluation": steps(
            *NATION_LAG,
            *did("nl", "lag", "c2"),
            rows_out(
                [
                    *causal_labels(),
                    metric("causal_evaluation", "delta_error", f"abs({value_of('delta')} + 0.15)", "(SELECT 1)"),
                    metric("causal_evaluation", "rho_error", f"abs({value_of('rho')} - 0.4)", "(SELECT 1)"),
                    metric("causal_evaluation", "gamma_mse", f"power({value_of('gamma')} - 0.5, 2)", "(SELECT 1)"),
                    metric("causal_evaluation", "gamma_mae", f"abs({value_of('gamma')} - 0.5)", "(SELECT 1)"),
                ]
            ),
        ),
        "interpretability": steps(*NATION_LAG, *did("nl"), rows_out(understanding())),
        "report": steps(
            *SPATIAL, *SUPPLIER_ROWS[len(SUPPLIER_DENSE):], lagged("sl", "sr", "se"), *did("sl"),
            rows_out([*BUNDLE, *causal_labels(), *SPATIAL_ROWS, *understanding()]),
        ),
    }
    return sql
