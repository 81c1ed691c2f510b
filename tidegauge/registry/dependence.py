"""Correlations between columns and through time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dependence
from ..operators.order import Layout
from ..operators.profiles import daily_means
from .base import query

_POLLUTANTS = ["PM2.5", "PM10", "NO2", "SO2", "CO", "O3"]
_WEATHER = ["temperature", "humidity", "pressure", "wind_speed", "wind_direction"]
_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_POLLUTANTS) for b in _POLLUTANTS[i + 1 :]]

_PAIRWISE = " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, corr("{a}", "{b}") AS r,
        count(*) FILTER (WHERE "{a}" IS NOT NULL AND "{b}" IS NOT NULL) AS n FROM readings"""
    for a, b in _PAIRS
)
_COMPLETE = " AND ".join(f'"{v}" IS NOT NULL' for v in _POLLUTANTS)
_LISTWISE = " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, corr("{a}", "{b}") AS r, count(*) AS n FROM readings
        WHERE {_COMPLETE}"""
    for a, b in _PAIRS
)
_COVARIATES = " UNION ALL ".join(
    f"""SELECT '{v}' AS value, '{w}' AS covariate, corr("{v}", "{w}") AS r,
        count(*) FILTER (WHERE "{v}" IS NOT NULL AND "{w}" IS NOT NULL) AS n FROM readings"""
    for v in _POLLUTANTS
    for w in _WEATHER
)


def _pairs(t, missing="pairwise"):
    return dependence.pair_correlations(t.readings, _POLLUTANTS, missing=missing)


def _covariates(t):
    return dependence.covariate_correlations(t.readings, _POLLUTANTS, _WEATHER)


@query("correlation_pairwise", _PAIRWISE, views="readings", doubles="r")
def _(t):
    return _pairs(t)


@query("correlation_listwise", _LISTWISE, views="readings", doubles="r")
def _(t):
    return _pairs(t, "listwise")


@query("correlation_lineitem", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) AS n FROM lineitem"
    for i, a in enumerate(_LINE) for b in _LINE[i + 1:]
), doubles="r")
def _(t):
    return dependence.pair_correlations(t.lineitem, _LINE)


_DIAGONAL = " UNION ALL ".join(f"SELECT '{v}' AS a, '{v}' AS b, 1.0::DOUBLE AS r" for v in _POLLUTANTS)
_MATRIX = f"""
    WITH p AS ({_PAIRWISE})
    SELECT a, b, r FROM p UNION ALL SELECT b, a, r FROM p UNION ALL {_DIAGONAL}
    """


@query("correlation_matrix", _MATRIX, views="readings", doubles="r")
def _(t):
    return dependence.correlation_matrix(_pairs(t), _POLLUTANTS)


@query(
    "correlation_wide",
    f"WITH m AS ({_MATRIX}) SELECT a, "
    + ", ".join(f"""max(r) FILTER (WHERE b = '{v}') AS "{v}" """ for v in _POLLUTANTS)
    + " FROM m GROUP BY a",
    views="readings",
    doubles=" ".join(_POLLUTANTS),
)
def _(t):
    matrix = dependence.correlation_matrix(_pairs(t), _POLLUTANTS)
    return dependence.to_wide(matrix, _POLLUTANTS)


@query("correlation_long_again", _MATRIX, views="readings", doubles="r")
def _(t):
    matrix = dependence.correlation_matrix(_pairs(t), _POLLUTANTS)
    return dependence.to_long(dependence.to_wide(matrix, _POLLUTANTS), _POLLUTANTS)


def _notable(table: str, keep: float, strong: float) -> str:
    return f"""SELECT *, CASE WHEN abs(r) > {strong} THEN 'strong' ELSE 'moderate' END AS strength,
        CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
        FROM ({table}) p WHERE abs(r) > {keep}"""


@query("notable_pairs", _notable(_PAIRWISE, 0.3, 0.7), views="readings", doubles="r")
def _(t):
    return dependence.notable_pairs(_pairs(t))


_ALL = [*_POLLUTANTS, *_WEATHER]
_ALL_PAIRS = " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, corr("{a}", "{b}") AS r,
        count(*) FILTER (WHERE "{a}" IS NOT NULL AND "{b}" IS NOT NULL) AS n FROM readings"""
    for i, a in enumerate(_ALL)
    for b in _ALL[i + 1 :]
)


@query("notable_pairs_strict", _notable(_ALL_PAIRS, 0.7, 0.8), views="readings", doubles="r")
def _(t):
    return dependence.notable_pairs(dependence.pair_correlations(t.readings, _ALL), 0.7, 0.8)


@query("pair_summary", f"""
    WITH n AS ({_notable(_PAIRWISE, 0.05, 0.3)})
    SELECT count(*) AS total_pairs, count(*) FILTER (WHERE strength = 'strong') AS strong_pairs,
           count(*) FILTER (WHERE r > 0) AS positive_pairs, count(*) FILTER (WHERE r < 0) AS negative_pairs,
           arg_max(a, abs(r)) AS strongest_a, arg_max(b, abs(r)) AS strongest_b, arg_max(r, abs(r)) AS strongest_r
    FROM n
    """, views="readings", doubles="strongest_r")  # fmt: skip
def _(t):
    return dependence.pair_summary(dependence.notable_pairs(_pairs(t), 0.05, 0.3))


@query("covariate_correlations", _COVARIATES, views="readings", doubles="r")
def _(t):
    return _covariates(t)


@query("significant_covariates", _notable(_COVARIATES, 0.2, 0.5), views="readings", doubles="r")
def _(t):
    return dependence.significant_covariates(_covariates(t))


@query("graded_covariates", f"""
    SELECT *, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
           CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
    FROM ({_COVARIATES}) p
    """, views="readings", doubles="r")  # fmt: skip
def _(t):
    return dependence.graded_covariates(_covariates(t))


_IMPACT = f"""
    SELECT covariate, arg_max(value, abs(r)) AS most_affected, arg_max(r, abs(r)) AS most_affected_r,
           count(*) AS pairs, count(*) FILTER (WHERE r > 0) AS positive,
           count(*) FILTER (WHERE r < 0) AS negative
    FROM ({_notable(_COVARIATES, 0.1, 0.5)}) s GROUP BY 1
    """


def _impact(t):
    return dependence.covariate_impact(dependence.significant_covariates(_covariates(t), 0.1))


@query("covariate_impact", _IMPACT, views="readings", doubles="most_affected_r")
def _(t):
    return _impact(t)


@query("most_influential", f"""
    SELECT covariate, pairs FROM ({_IMPACT}) i ORDER BY pairs DESC, abs(most_affected_r) DESC LIMIT 1
    """, views="readings")  # fmt: skip
def _(t):
    return dependence.most_influential(_impact(t))


_ROLLING = " UNION ALL ".join(
    f"""SELECT {n} AS "window", avg(r) AS mean, stddev_samp(r) AS std, max(r) AS max, min(r) AS min FROM (
        SELECT CASE WHEN count(y) OVER w = {n} THEN corr(value, y) OVER w END AS r FROM (
            SELECT event_id, ts, value, lag(value, {n}) OVER (ORDER BY ts, event_id) AS y FROM events)
        WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))"""
    for n in (24, 168)
)


@query("rolling_corr_summary", _ROLLING, doubles="mean std max min")
def _(t):
    return dependence.rolling_corr_summary(
        t.events.select("event_id", "ts", "value"), "value", order=["ts", "event_id"]
    )


_DECOMPOSED = """
    d AS (SELECT date_trunc('day', o_orderdate) AS day, avg(o_totalprice) AS mean FROM orders GROUP BY 1),
    n AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i,
                 CASE WHEN count(mean) OVER w = 7 THEN avg(mean) OVER w END AS trend
          FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    p AS (SELECT i % 7 AS phase, avg(mean - trend) AS m FROM n GROUP BY 1),
    s AS (SELECT phase, m - (SELECT avg(m) FROM p) AS seasonal FROM p),
    parts AS (SELECT day, mean, trend, seasonal, mean - trend - seasonal AS rest
              FROM n JOIN s ON s.phase = n.i % 7)
    """


@query(
    "decomposition",
    f"WITH {_DECOMPOSED} SELECT CAST(day AS TIMESTAMP) AS day, mean, trend, seasonal, rest FROM parts",
    doubles="mean trend seasonal rest",
    digits=3,
)
def _(t):
    return dependence.decompose(daily_means(t.orders, "o_totalprice", "o_orderdate"))


_STRENGTH = f"""
    WITH {_DECOMPOSED}
    SELECT (SELECT count(*) FROM orders) AS points,
           (SELECT datediff('day', min(day), max(day)) + 1 FROM d) AS days,
           stddev_pop(seasonal) / stddev_pop(mean) AS seasonal_strength,
           stddev_pop(trend) / stddev_pop(mean) AS trend_strength,
           stddev_pop(seasonal) / stddev_pop(mean) > 0.3 AS has_strong_seasonality,
           stddev_pop(trend) / stddev_pop(mean) > 0.3 AS has_strong_trend
    FROM parts
    """


@query("seasonal_strength", _STRENGTH, doubles="seasonal_strength trend_strength")
def _(t):
    return dependence.seasonal_strength(t.orders, "o_totalprice", "o_orderdate")


@query("seasonal_strength_sliced", _STRENGTH, doubles="seasonal_strength trend_strength")
def _(t):
    how = Layout("sliced", slice_rows=500)
    return dependence.seasonal_strength(t.orders, "o_totalprice", "o_orderdate", layout=how)


def _auto_long(values) -> str:
    long = " UNION ALL ".join(
        f"""SELECT '{v}' AS variable, datetime, "{v}" AS x FROM readings WHERE "{v}" IS NOT NULL"""
        for v in values
    )
    return f"""long AS ({long}),
    l AS (SELECT variable, x, lag(x, 1) OVER w AS l1, lag(x, 24) OVER w AS l24, lag(x, 168) OVER w AS l168
          FROM long WINDOW w AS (PARTITION BY variable ORDER BY datetime)),
    a AS (SELECT variable, 1 AS lag, count(x) AS points, count(l1) AS n, corr(x, l1) AS r FROM l GROUP BY 1
          UNION ALL SELECT variable, 24, count(x), count(l24), corr(x, l24) FROM l GROUP BY 1
          UNION ALL SELECT variable, 168, count(x), count(l168), corr(x, l168) FROM l GROUP BY 1),
    auto AS (SELECT variable, lag, r FROM a WHERE points >= 48 AND n > 10)"""


@query("persistence", f"""
    WITH {_auto_long(_POLLUTANTS[:3])}
    SELECT variable, max(abs(r)) AS strongest_autocorrelation,
           CASE WHEN max(r) FILTER (WHERE lag = 24) > 0.5 THEN 'high'
                WHEN max(r) FILTER (WHERE lag = 24) > 0.2 THEN 'moderate' ELSE 'low' END AS persistence
    FROM auto GROUP BY 1
    """, views="readings", doubles="strongest_autocorrelation")  # fmt: skip
def _(t):
    return dependence.persistence_of(t.readings, _POLLUTANTS[:3], ["datetime"], Layout())


@query("findings", f"""
    WITH best AS (SELECT * FROM ({_notable(_LISTWISE, 0.3, 0.7)}) p ORDER BY abs(r) DESC LIMIT 1),
    impact AS (SELECT covariate, count(*) AS pairs, max(abs(r)) AS top
               FROM ({_notable(_COVARIATES, 0.2, 0.5)}) s GROUP BY 1),
    most AS (SELECT * FROM impact ORDER BY pairs DESC, top DESC LIMIT 1),
    {_auto_long(_POLLUTANTS[:3])},
    high AS (SELECT string_agg(variable, ', ' ORDER BY variable) AS names FROM auto WHERE lag = 24 AND r > 0.5)
    SELECT 'strongest_pair' AS finding, format('Strongest correlation: {{}} and {{}} ({{:.3f}}, {{}} {{}})',
        a, b, r, strength, direction) AS text FROM best
    UNION ALL
    SELECT 'most_influential', format('Most influential weather factor: {{}} (affects {{}} pollutants)', covariate, pairs)
    FROM most
    UNION ALL
    SELECT 'persistence', 'High persistence pollutants: ' || names FROM high WHERE names IS NOT NULL
    """, views="readings")  # fmt: skip
def _(t):
    return dependence.findings(t.readings, _POLLUTANTS, _WEATHER)


@query("correlation_report", f"""
    WITH pairs AS ({_notable(_LISTWISE, 0.3, 0.7)}),
    cov AS ({_notable(_COVARIATES, 0.2, 0.5)}),
    {_auto_long(_POLLUTANTS[:3])}
    SELECT 'pair' AS section, a, b, r, strength AS label, direction FROM pairs
    UNION ALL SELECT 'covariate', value, covariate, r, strength, direction FROM cov
    UNION ALL SELECT 'autocorrelation', variable, 'lag_' || lag || 'h', r,
        CASE WHEN abs(r) > 0.5 THEN 'high' WHEN abs(r) > 0.2 THEN 'moderate' ELSE 'low' END,
        CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END FROM auto
    """, views="readings", doubles="r")  # fmt: skip
def _(t):
    return dependence.report(t.readings, _POLLUTANTS, _WEATHER)


@query("correlation_with_constant", """
    SELECT 'l_quantity' AS a, 'one' AS b, CAST(NULL AS DOUBLE) AS r, count(*) AS n FROM lineitem
    """, doubles="r")  # fmt: skip
def _(t):
    return dependence.pair_correlations(
        t.lineitem.withColumn("one", F.lit(1.0)), ["l_quantity", "one"]
    )
