"""DuckDB SQL building blocks: the bars view and the features on it, as chains of CTEs."""

from __future__ import annotations

_TINY = "1e-9"


def rnd(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0)"


def nums(cols: list[str], digits: int = 6) -> str:
    return ", ".join(f'{rnd(_q(c), digits)} AS {_q(c)}' for c in cols)


def _q(c: str) -> str:
    return f'"{c}"'


def clip(x: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest({lo}, least({hi}, {x})) END)"


def trail(n: int, lag: int = 0, part: str = "ticker") -> str:
    return f"OVER (PARTITION BY {part} ORDER BY date ROWS BETWEEN {n - 1 + lag} PRECEDING AND {f'{lag} PRECEDING' if lag else 'CURRENT ROW'})"


W = "OVER (PARTITION BY ticker ORDER BY date)"


def bars_cte(every: str = "week") -> str:
    order = "{'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_partkey, 'e': price}"
    return f"""px AS (
  SELECT n_name AS ticker, r_name AS sector, CAST(date_trunc('{every}', l_shipdate) AS DATE) AS date,
    l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, p_retailprice * (1 - l_discount) AS price
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
), bars AS (
  SELECT ticker, sector, date, arg_min(price, {order}) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, {order}) AS close, sum(l_quantity) AS volume
  FROM px GROUP BY ticker, sector, date
)"""


BARS = bars_cte()

#: Bars with made-up faults, by a number from date and ticker.
RAW = BARS + """, raw0 AS (
  SELECT *, ((date_diff('day', DATE '1990-01-01', date) // 7) + length(ticker)) % 97 AS k FROM bars
), raw AS (
  SELECT ticker, sector, date, open,
    CASE WHEN k = 11 THEN low * 0.9 ELSE high END AS high, CASE WHEN k = 12 THEN high * 1.1 ELSE low END AS low,
    CASE WHEN k = 3 THEN NULL WHEN k = 5 THEN close * 6 WHEN k = 9 THEN close * 0.05 ELSE close END AS close,
    CASE WHEN k = 13 THEN NULL WHEN k = 17 THEN -volume ELSE volume END AS volume, k
  FROM raw0
)"""

_c1 = f"coalesce(close / nullif(lag(close) {W}, 0) - 1, 0)"
_sk = f"(CASE WHEN count(ret) {trail(20, 1)} >= 10 THEN skewness(ret) {trail(20, 1)} END)"
FEATURES = BARS + f""", f1 AS (
  SELECT *, {_c1} AS r0 FROM bars
), f2 AS (
  SELECT *, {clip(f"median(r0) {trail(3)}", -0.5, 0.5)} AS ret FROM f1
), f3 AS (
  SELECT *, lag(ret) {W} AS return_lag1, lag(ret, 5) {W} AS return_lag5, -lag(ret, 5) {W} AS reversal_5,
    {clip(f"CASE WHEN count(ret) {trail(20, 1)} >= 5 THEN avg(ret) {trail(20, 1)} END", -0.2, 0.2)} AS return_mean_20,
    lag(close) {W} / nullif(lag(close, 21) {W}, 0) - 1 AS momentum_20,
    lag(close) {W} / nullif(lag(close, 61) {W}, 0) - 1 AS momentum_60,
    CASE WHEN count(ret) {trail(20, 1)} >= 20 THEN stddev_pop(ret) {trail(20, 1)} END AS volatility_20,
    {clip(f"coalesce({_sk}, 0)", -3, 3)} AS return_skew_20,
    greatest(volume, 1.0) AS vol1,
    {clip(f"close / ((CASE WHEN count(close) {trail(252, 1)} >= 60 THEN max(close) {trail(252, 1)} END) + {_TINY}) - 1", -1, 0)} AS dist_from_52w_high
  FROM f2
), f4 AS (
  SELECT *, {clip("0.6 * momentum_20 + 0.4 * momentum_60", -2, 2)} AS momentum_composite,
    coalesce(greatest(volatility_20, 1e-4), 1e-4) AS volatility,
    CASE WHEN count(vol1) {trail(20, 1)} >= 5 THEN avg(vol1) {trail(20, 1)} END AS volume_mean_20,
    close * vol1 AS dollar_volume, abs(ret) / (close * vol1 + {_TINY}) AS illiquid
  FROM f3
), f5 AS (
  SELECT *, {clip(f"momentum_composite / (volatility + {_TINY})", -5, 5)} AS mom_vol_adj,
    {clip(f"coalesce(CASE WHEN count(volatility) {trail(20, 1)} >= 10 THEN stddev_pop(volatility) {trail(20, 1)} END, 0)", 0, 1)} AS vol_of_vol,
    {clip(f"vol1 / (volume_mean_20 + {_TINY})", 0, 5)} AS volume_momentum,
    {clip(f"ln(1 + 1e6 * coalesce(CASE WHEN count(illiquid) {trail(20, 1)} >= 5 THEN avg(illiquid) {trail(20, 1)} END, 0))", 0, 20)} AS amihud,
    coalesce({clip(f"CASE WHEN count(volatility) {trail(60)} >= 20 THEN (volatility - avg(volatility) {trail(60)}) / (stddev_samp(volatility) {trail(60)} + {_TINY}) END", -3, 3)}, 0) AS regime_feature
  FROM f4
), feat AS (
  SELECT * EXCLUDE (r0, ret, vol1, illiquid), ret AS "return", {clip("momentum_composite * regime_feature", -5, 5)} AS momentum_regime_interaction FROM f5
)"""


def cross_section(cols: list[str], source: str = "feat") -> str:
    """CTEs up to ``xs``: winsorised, standardised and ranked columns of ``source``."""
    wide = "SELECT date, " + ", ".join(f'quantile_cont("{c}", 0.01) AS "lo_{c}", quantile_cont("{c}", 0.99) AS "hi_{c}"' for c in cols) + f" FROM {source} GROUP BY date"
    held = ", ".join(f'CASE WHEN s."{c}" IS NOT NULL THEN greatest(q."lo_{c}", least(q."hi_{c}", s."{c}")) END AS "{c}"' for c in cols)
    z = ", ".join(
        f'CASE WHEN coalesce(abs("{c}" - avg("{c}") OVER d) / (greatest(stddev_samp("{c}") OVER d, 1e-6) + 1e-9), 0) <= 1e-9 THEN 0 ELSE greatest(-5, least(5, ("{c}" - avg("{c}") OVER d) / (greatest(stddev_samp("{c}") OVER d, 1e-6) + 1e-9))) END AS "{c}_z"'
        for c in cols
    )
    rank = ", ".join(
        f'CASE WHEN "{c}" IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY date ORDER BY "{c}" NULLS LAST) + (count(*) OVER (PARTITION BY date, "{c}") - 1) / 2.0) / count("{c}") OVER d END AS "{c}_rank"' for c in cols
    )
    return f"""xq AS ({wide}), xw AS (SELECT s.ticker, s.date, {held} FROM {source} s JOIN xq q ON s.date = q.date),
xs AS (SELECT *, {z}, {rank} FROM xw WINDOW d AS (PARTITION BY date))"""


#: predictions: score = the date's z of 20-bar momentum; fwd: the next bar's return.
PREDICTIONS = FEATURES + f""", fwd AS (
  SELECT * FROM (SELECT ticker, date, {clip(f"lead(close) {W} / nullif(close, 0) - 1", -0.5, 0.5)} AS forward_return FROM bars) WHERE forward_return IS NOT NULL
), """ + cross_section(["momentum_20"]) + """, pred AS (
  SELECT ticker, date, momentum_20_z AS score, 'm20' AS model_version FROM xs WHERE momentum_20 IS NOT NULL
), pairs AS (SELECT p.*, f.forward_return FROM pred p JOIN fwd f ON p.ticker = f.ticker AND p.date = f.date)"""

IC = PREDICTIONS + """, icr AS (
  SELECT date, forward_return,
    (rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS a,
    (rank() OVER (PARTITION BY date ORDER BY forward_return) + (count(*) OVER (PARTITION BY date, forward_return) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS b
  FROM pairs
), ic AS (
  SELECT date, corr(a, b) AS ic, count(*) AS n FROM icr GROUP BY date HAVING count(*) >= 5 AND min(forward_return) < max(forward_return)
)"""


def recursion(name: str, source: str, means: dict[str, tuple[str, float]]) -> str:
    """CTEs up to ``name``: (ticker, i, ...) with an exponential mean of each expression of ``source`` (ticker, date, ...), step by step.

    means: column -> (expression, alpha); a mean begins with its first value. Needs WITH RECURSIVE.
    """
    columns = ", ".join(f"CAST({x} AS DOUBLE) AS x_{c}" for c, (x, _) in means.items())
    step = ", ".join(f"CASE WHEN e.{c} IS NULL THEN n.x_{c} WHEN n.x_{c} IS NULL THEN e.{c} ELSE {a!r} * n.x_{c} + (1 - {a!r}) * e.{c} END" for c, (_, a) in means.items())
    start = ", ".join(f"x_{c} AS {c}" for c in means)
    return f"""{name}_n AS MATERIALIZED (SELECT *, {columns} FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, count(*) OVER (PARTITION BY ticker) AS len FROM {source})),
{name} AS (SELECT ticker, i, {start} FROM {name}_n WHERE i = 1 UNION ALL SELECT n.ticker, n.i, {step} FROM {name} e JOIN {name}_n n ON n.ticker = e.ticker AND n.i = e.i + 1)"""


def _span(n: int) -> float:
    return 2 / (n + 1)


#: ewm: rsi, exponential means and MACD of every bar.
EWM = (
    f"stepped AS (SELECT ticker, date, close, close - lag(close) {W} AS step FROM bars), "
    + recursion("r1", "stepped", {
        "gain": ("CASE WHEN step > 0 THEN step WHEN step <= 0 THEN 0 END", 1 / 14), "loss": ("CASE WHEN step < 0 THEN -step WHEN step >= 0 THEN 0 END", 1 / 14), "e10": ("close", _span(10)), "e12": ("close", _span(12)),
        "e20": ("close", _span(20)), "e26": ("close", _span(26)), "e50": ("close", _span(50)),
    })
    + f""", lined AS (SELECT n.ticker, n.date, n.i AS k, n.len AS n, r1.* EXCLUDE (ticker, i), e12 - e26 AS line FROM r1 JOIN r1_n n ON n.ticker = r1.ticker AND n.i = r1.i), """
    + recursion("r2", "lined", {"sig": ("line", _span(9))})
    + f""", ewm AS (SELECT n.ticker, n.date, CASE WHEN n.len < 14 OR n.i < 15 THEN 50 ELSE greatest(0, least(100, 100 - 100 / (1 + gain / (loss + 1e-9)))) END AS rsi,
  e10 AS ema_10, e50 AS ema_50, greatest(0.5, least(1.5, e10 / (e50 + {_TINY}))) AS ema_ratio, e20 AS ema, greatest(-500, least(500, line)) AS macd, greatest(-500, least(500, sig)) AS macd_signal
  FROM r2 JOIN r2_n n ON n.ticker = r2.ticker AND n.i = r2.i)"""
)


def confirmed(name: str, source: str, days: int) -> str:
    """CTEs up to ``name``: (ticker, i, held) of ``source`` (ticker, date, label), row by row. Needs WITH RECURSIVE."""
    turn = f"n.label <> e.held AND e.streak + 1 >= {days}"
    return f"""{name}_n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM {source}),
{name} AS (SELECT ticker, i, label AS held, 0 AS streak FROM {name}_n WHERE i = 1 UNION ALL
  SELECT n.ticker, n.i, CASE WHEN {turn} THEN n.label ELSE e.held END, CASE WHEN n.label = e.held OR {turn} THEN 0 ELSE e.streak + 1 END FROM {name} e JOIN {name}_n n ON n.ticker = e.ticker AND n.i = e.i + 1)"""


#: The regime of each ticker by its own trend and volatility, confirmed over four bars: asset_n JOIN asset.
ASSET = (
    f"""moved AS (SELECT ticker, date, close, close / nullif(lag(close) {W}, 0) - 1 AS change, CASE WHEN count(close) {trail(150)} >= 150 THEN avg(close) {trail(150)} END AS mean FROM bars),
odd AS (SELECT *, (close - mean) / (mean + 1e-8) AS gap, max(CASE WHEN close IS NULL OR close <= 0 OR abs(change) > 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker) AS unfit FROM moved), """
    + recursion("a1", "odd", {"trend": ("gap", _span(8)), "e5": ("change", _span(5))})
    + f""", spread AS (SELECT n.ticker, n.date, gap, unfit, trend, CASE WHEN count(e5) OVER w >= 40 THEN stddev_samp(e5) OVER w END AS sd FROM a1 JOIN a1_n n ON n.ticker = a1.ticker AND n.i = a1.i WINDOW w AS (PARTITION BY n.ticker ORDER BY n.date ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)), """
    + recursion("a2", "spread", {"vol": ("sd", _span(10))})
    + """, labelled0 AS (SELECT n.*, greatest(vol, 0.005) AS v FROM a2 JOIN a2_n n ON n.ticker = a2.ticker AND n.i = a2.i),
labelled AS (SELECT ticker, date, CASE WHEN unfit = 1 OR gap IS NULL OR v IS NULL THEN 'SIDEWAYS' WHEN v > 0.053 THEN 'CRISIS' WHEN trend > 0.007 AND v < 0.03 THEN 'BULL' WHEN trend < -0.007 AND v > 0.03 THEN 'BEAR' ELSE 'SIDEWAYS' END AS label FROM labelled0), """
    + confirmed("asset", "labelled", 4)
)
