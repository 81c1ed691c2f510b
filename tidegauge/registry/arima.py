"""Queries of the seasonal ARIMA models and the normal equations that DuckDB solves for them."""

from __future__ import annotations

from ..operators import arima
from .base import query

_ORDER = ["ts", "event_id"]
_HOW = {"keys": ["event_type"], "order": _ORDER}
_W = "WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)"


def _solved(name: str, source: str, size: str) -> str:
    """Gauss-Jordan steps on the augmented matrix ``m``, until ``k`` reaches its ``size``."""
    pivot = "m[k + 1][k + 1]"
    return f"""{name} AS (
        SELECT *, 0 AS k FROM {source}
        UNION ALL
        SELECT * REPLACE (k + 1 AS k, list_transform(m, lambda line, r : CASE WHEN r = k + 1
            THEN list_transform(line, lambda x : x / {pivot})
            ELSE list_transform(line, lambda x, j : x - line[k + 1] * m[k + 1][j] / {pivot}) END) AS m)
        FROM {name} WHERE k < {size})"""


def _covariances(terms: dict[str, str], whole: str) -> list[str]:
    names = list(terms)
    out = [f"avg({e}) FILTER (WHERE {whole}) AS m_{n}" for n, e in terms.items()]
    return out + [
        f"covar_pop({terms[a]}, {terms[b]}) FILTER (WHERE {whole}) AS c_{a}_{b}" for i, a in enumerate(names) for b in names[i:]
    ]


def _fit_sql(source: str, candidates: list[tuple[int, ...]], period: int | None = None, season: int = 0) -> str:
    """CTEs ``shocked`` (rows with y and e) and ``best`` (a row per series) over ``source``."""
    long = arima.LONG
    steps = [*range(1, long + 1), *([period, period + 1] if period else [])]
    lags = ", ".join(f"lag(y, {k}) OVER w AS l{k}" for k in steps)
    level = ["y", *[f"l{k}" for k in range(1, long + 1)]]
    first = {"before": "l1", **{f"change{k}": f"l{k} - l{k + 1}" for k in range(1, long)}, "change": "y - l1"}
    names = list(first)[:-1]

    def cov(a: str, b: str, of: list[str]) -> str:
        return f"c_{a}_{b}" if of.index(a) <= of.index(b) else f"c_{b}_{a}"

    every = list(first)
    matrix = ", ".join("[" + ", ".join(cov(a, b, every) for b in [*names, "change"]) + "]" for a in names)
    fitted = " + ".join(f"b[{i + 1}] * ({first[n]})" for i, n in enumerate(names))
    zero = "0.0::DOUBLE"
    second = {
        "before": "l1", "change1": "l1 - l2", "change2": "l2 - l3", "shock1": "e1", "shock2": "e2",
        "season": f"l{period}" if period else zero, "season_change": f"l{period} - l{period + 1}" if period else zero,
        "season_shock": "es" if period else zero, "change": "y - l1", "level": "y",
    }
    whole = "e2 IS NOT NULL" + (f" AND es IS NOT NULL AND l{period + 1} IS NOT NULL" if period else "")
    every2, fits = list(second), []
    for order in candidates:
        own = arima._regressors(*order)
        target = "level" if order[0] == order[1] == 0 else "change"
        rows = ", ".join("[" + ", ".join(cov(a, b, every2) for b in [*own, target]) + "]" for a in own)
        right = ", ".join(cov(a, target, every2) for a in own)
        means = ", ".join(f"m_{a}" for a in own)
        p, d, q, sp, sq = order
        fits.append(
            f"SELECT event_type, n, points, {p} AS p, {d} AS d, {q} AS q, {sp} AS sp, {sq} AS sq, "
            f"[{rows}]::DOUBLE[][] AS m, {len(own)} AS size, [{right}]::DOUBLE[] AS rhs, [{means}]::DOUBLE[] AS means, "
            f"{own!r}::VARCHAR[] AS names, m_{target} AS mt, c_{target}_{target} AS vt FROM moments WHERE points >= 100"
        )

    def beta(*terms: str) -> str:
        return f"coalesce({', '.join(f'b[list_position(names, {t!r})]' for t in terms)}, 0.0::DOUBLE)"

    base = f"SELECT event_type, ts, event_id, value AS level, value{f' - lag(value, {season}) OVER w' if season else ''} AS y FROM {source} {_W}"
    return f"""
    series AS (SELECT * FROM ({base}) WHERE y IS NOT NULL),
    lagged AS (SELECT *, {lags} FROM series {_W}),
    long_moments AS (SELECT event_type, {", ".join(_covariances(first, f"{level[-1]} IS NOT NULL"))} FROM lagged GROUP BY 1),
    long_start AS (SELECT event_type, [{matrix}] AS m, m_change AS mt, [{", ".join(f"m_{n}" for n in names)}] AS means FROM long_moments),
    {_solved("long_steps", "long_start", str(long))},
    long_fit AS (SELECT event_type, b, mt - list_inner_product(b, means) AS b0
                 FROM (SELECT *, list_transform(m, lambda line : line[{long + 1}]) AS b FROM long_steps WHERE k = {long})),
    shocks AS (SELECT lagged.*, CASE WHEN l{long} IS NOT NULL THEN y - l1 - b0 - ({fitted}) END AS e FROM lagged JOIN long_fit USING (event_type)),
    shocked AS (SELECT *, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2{f", lag(e, {period}) OVER w AS es" if period else ""} FROM shocks {_W}),
    moments AS (SELECT event_type, count(y) AS points, count(*) FILTER (WHERE {whole}) AS n,
                       {", ".join(_covariances(second, whole))} FROM shocked GROUP BY 1),
    starts AS ({" UNION ALL ".join(fits)}),
    {_solved("steps", "starts", "size")},
    solved AS (SELECT *, CASE WHEN size = 0 THEN []::DOUBLE[] ELSE list_transform(m, lambda line : line[size + 1]) END AS b FROM steps WHERE k = size),
    fits AS (SELECT *, mt - coalesce(list_inner_product(b, means), 0) AS const, vt - coalesce(list_inner_product(b, rhs), 0) AS v FROM solved),
    best AS (SELECT event_type, n, points, n * ln(v) + 2 * (size + 1) AS aic, p, d, q, sp, sq, const,
                    CASE WHEN d = 1 THEN {beta("change1")} WHEN p > 0 THEN 1 + {beta("before")} + {beta("change1")} ELSE 0 END AS ar1,
                    CASE WHEN d = 1 THEN {beta("change2")} ELSE -{beta("change1")} END AS ar2,
                    {beta("shock1")} AS ma1, {beta("shock2")} AS ma2, {beta("season", "season_change")} AS seasonal_ar,
                    {beta("season_shock")} AS seasonal_ma, n * v AS rss
             FROM fits QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY aic, p, d, q, sp, sq) = 1)"""


_FIT_DOUBLES = "aic const ar1 ar2 ma1 ma2 seasonal_ar seasonal_ma"
_RAMP = """ramp AS (SELECT event_type, ts, event_id,
    sum(value - 25) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS value FROM events)"""


def _typed(t):
    return t.events.select("event_id", "ts", "event_type", "value")


def _ramp(t):
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    w = Window.partitionBy("event_type").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", "ts", "event_type", F.sum(F.col("value") - 25).over(w).alias("value"))


@query("arima_fit", f"WITH RECURSIVE {_fit_sql('events', arima.orders())} SELECT * EXCLUDE (rss) FROM best", doubles=_FIT_DOUBLES, digits=4)
def _(t):
    return arima.fit_arima(_typed(t), "value", **_HOW).drop("rss")


_SEASONAL = [(1, 0, 1, 1, 1), (1, 0, 0, 1, 0), (0, 1, 1, 0, 1)]


@query("arima_seasonal_fit", f"WITH RECURSIVE {_RAMP}, {_fit_sql('ramp', _SEASONAL, 24, 24)} SELECT * EXCLUDE (rss) FROM best",
       doubles=_FIT_DOUBLES, digits=4)
def _(t):
    rows = arima.fit_arima(_ramp(t), "value", period=24, seasonal_difference=True, candidates=_SEASONAL, **_HOW)
    return rows.drop("rss")


@query("arima_forecast", f"""
    WITH RECURSIVE {_RAMP}, {_fit_sql('ramp', [(1, 1, 1, 0, 0)])},
    ends AS (SELECT event_type, y AS lvl, y - l1 AS z, e FROM shocked
             QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1),
    r AS (
        SELECT best.*, 0 AS step, lvl, z, e, 1.0::DOUBLE AS psi, 1.0::DOUBLE AS cum, 0.0::DOUBLE AS var FROM best JOIN ends USING (event_type)
        UNION ALL
        SELECT * REPLACE (step + 1 AS step, lvl + const + ar1 * z + ma1 * e AS lvl, const + ar1 * z + ma1 * e AS z, 0.0 AS e,
                          CASE WHEN step = 0 THEN ar1 + ma1 ELSE ar1 * psi END AS psi,
                          cum + CASE WHEN step = 0 THEN ar1 + ma1 ELSE ar1 * psi END AS cum, var + cum * cum AS var)
        FROM r WHERE step < 24)
    SELECT event_type, step, lvl AS forecast, lvl - 1.959963984540054 * sqrt(var * rss / n) AS confidence_lower,
           lvl + 1.959963984540054 * sqrt(var * rss / n) AS confidence_upper
    FROM r WHERE step > 0
    """, doubles="forecast confidence_lower confidence_upper", digits=3)  # fmt: skip
def _(t):
    return arima.arima_forecast(_ramp(t), "value", candidates=[(1, 1, 1, 0, 0)], **_HOW)
