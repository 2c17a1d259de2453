"""Building blocks of the SQL twins: the same bar tables and window columns in plain SQL."""

from __future__ import annotations

from barlab.operators.features import EMA_SPANS, RETURN_HORIZONS, VOLATILITY_UNITS

DAYS = {"suffix": "d", "unit": "DAY", "micros": 86_400_000_000}
MINUTES = {"suffix": "m", "unit": "MINUTE", "micros": 60_000_000}


def rd(expr: str, digits: int = 8) -> str:
    return f"CASE WHEN round({expr}, {digits}) = 0 THEN 0.0 ELSE round({expr}, {digits}) END"


def ln(num: str, den: str) -> str:
    return f"CASE WHEN {num} > 0 AND {den} > 0 THEN ln({num} / {den}) END"


def ratio(num: str, den: str) -> str:
    return f"CASE WHEN abs({den}) > 0 THEN ({num}) / ({den}) END"


def _lineitem(root: str) -> str:
    key = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
    price = "l_extendedprice / l_quantity"
    return f"""bars AS (
  SELECT {root} AS root, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts,
         CAST(1000 + floor((EXTRACT(year FROM l_shipdate) - 1995) / 2) AS BIGINT) AS instrument_id,
         first({price} ORDER BY {key}) AS open, max({price}) AS high, min({price}) AS low,
         last({price} ORDER BY {key}) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume
  FROM lineitem GROUP BY 1, 2, 3)"""


BARS_LI = _lineitem("l_returnflag")
BARS_SU = _lineitem("'S' || CAST(l_suppkey AS VARCHAR)")
BARS_EV = """bars AS (
  SELECT event_type AS root, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS ts,
         CAST(100 + floor((EXTRACT(day FROM ts) - 1) / 15) AS BIGINT) AS instrument_id,
         first(value ORDER BY event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2, 3)"""

SEGMENTS = """seg0 AS (
  SELECT *, coalesce(instrument_id <> lag(instrument_id) OVER (PARTITION BY root ORDER BY ts), false) AS roll_event
  FROM bars),
seg1 AS (
  SELECT *, CAST(1 + sum(CASE WHEN roll_event THEN 1 ELSE 0 END)
                 OVER (PARTITION BY root ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS contract_segment_id
  FROM seg0),
seg AS (
  SELECT *, min(ts) OVER (PARTITION BY root, contract_segment_id) AS segment_start,
         max(ts) OVER (PARTITION BY root, contract_segment_id) AS segment_end,
         row_number() OVER (PARTITION BY root, contract_segment_id ORDER BY ts) - 1 AS segment_row,
         epoch_us(ts) AS t
  FROM seg1)"""

_WIN = "PARTITION BY root, contract_segment_id ORDER BY"


def exact_close(offset: int) -> str:
    if offset < 0:
        frame = f"RANGE BETWEEN {-offset} PRECEDING AND {-offset} PRECEDING"
    else:
        frame = f"RANGE BETWEEN {offset} FOLLOWING AND {offset} FOLLOWING"
    return f"max(close) OVER ({_WIN} t {frame})"


def rows_agg(agg: str, n: int) -> str:
    return f"{agg} OVER ({_WIN} ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def returns(clock: dict, horizons=RETURN_HORIZONS, source: str = "seg", name: str = "ret") -> str:
    s, u = clock["suffix"], clock["micros"]
    looks = ",\n".join(f"{exact_close(-h * u)} AS past_{h}" for h in horizons)
    cols = ",\n".join(f"{ln('close', f'past_{h}')} AS log_return_{h}{s}" for h in horizons)
    drop = ", ".join(f"past_{h}" for h in horizons)
    return (
        f"{name}0 AS (SELECT *, {looks} FROM {source}),\n"
        f"{name} AS (SELECT * EXCLUDE ({drop}), {cols} FROM {name}0)"
    )


def labels(clock: dict, horizons=(1, 5, 15), source: str = "ret", name: str = "lab") -> str:
    s, u = clock["suffix"], clock["micros"]
    looks = ",\n".join(f"{exact_close(h * u)} AS next_{h}" for h in horizons)
    cols = ",\n".join(f"{ln(f'next_{h}', 'close')} AS future_return_{h}{s}" for h in horizons)
    drop = ", ".join(f"next_{h}" for h in horizons)
    extra = ""
    if 5 in horizons:
        five = f"{ln('next_5', 'close')}"
        extra = f", CASE WHEN {five} > 0 THEN 'UP' WHEN {five} < 0 THEN 'DOWN' END AS direction_5{s}"
    return (
        f"{name}0 AS (SELECT *, {looks} FROM {source}),\n"
        f"{name} AS (SELECT * EXCLUDE ({drop}), {cols}{extra} FROM {name}0)"
    )


CANDLES = ", ".join(
    [
        f"{ratio('close - open', 'open')} AS return_open_to_close",
        f"{ratio('high - low', 'close')} AS range_pct",
        f"{ratio('high - greatest(open, close)', 'close')} AS upper_wick_pct",
        f"{ratio('least(open, close) - low', 'close')} AS lower_wick_pct",
        f"{ratio('close - low', 'high - low')} AS close_location_in_bar",
    ]
)


def ema(source: str, name: str = "ema") -> str:
    """The recursion itself, row by row, over the list of closes so far (a recursive CTE)."""
    a = {s: 2.0 / (s + 1) for s in EMA_SPANS}
    first = ", ".join(f"close AS e{s}" for s in EMA_SPANS)
    step = ", ".join(f"{a[s]!r} * n.close + (1 - {a[s]!r}) * p.e{s} AS e{s}" for s in EMA_SPANS)
    out = ", ".join(
        f"CASE WHEN x.segment_row >= {s - 1} THEN e{s} END AS ema_{s}" for s in EMA_SPANS
    )
    return f"""{name}_src AS MATERIALIZED (SELECT root, contract_segment_id, segment_row, close FROM {source}),
{name}_rec AS (
  SELECT root, contract_segment_id, segment_row, {first} FROM {name}_src WHERE segment_row = 0
  UNION ALL
  SELECT n.root, n.contract_segment_id, n.segment_row, {step}
  FROM {name}_rec p JOIN {name}_src n ON n.root = p.root
   AND n.contract_segment_id = p.contract_segment_id AND n.segment_row = p.segment_row + 1),
{name} AS (SELECT x.*, {out} FROM {source} x
  JOIN {name}_rec r USING (root, contract_segment_id, segment_row))"""


def feature_ctes(clock: dict, source: str = "seg", with_ema: bool = True) -> str:
    """CTEs up to ``feat``: every own feature and label over ``source``."""
    s, u = clock["suffix"], clock["micros"]
    parts = [returns(clock, source=source), labels(clock)]
    last = "lab"
    if with_ema:
        parts.append(ema("lab"))
        last = "ema"
    vol = ",\n".join(
        f"stddev_samp(log_return_1{s}) OVER ({_WIN} t RANGE BETWEEN {n * u - 1} PRECEDING AND CURRENT ROW)"
        f" AS realized_vol_{n}{s}"
        for n in VOLATILITY_UNITS
    )
    parts.append(
        f"""f1 AS (SELECT *, {CANDLES}, {vol},
  close - lag(close) OVER ({_WIN} ts) AS chg, lag(close) OVER ({_WIN} ts) AS prev,
  (high + low + close) / 3.0 AS typical_price,
  CASE WHEN segment_row >= 19 THEN {rows_agg('avg(volume)', 20)} END AS rolling_volume_mean_20,
  CASE WHEN segment_row >= 59 THEN {rows_agg('avg(volume)', 60)} END AS rolling_volume_mean_60,
  CASE WHEN segment_row >= 19 THEN {rows_agg('stddev_samp(volume)', 20)} END AS sd_20,
  CASE WHEN segment_row >= 59 THEN {rows_agg('stddev_samp(volume)', 60)} END AS sd_60
  FROM {last})"""
    )
    tr = (
        "CASE WHEN prev IS NULL THEN high - low "
        "ELSE greatest(high - low, abs(high - prev), abs(low - prev)) END"
    )
    parts.append(
        f"""f2 AS (SELECT *, {tr} AS tr, CASE WHEN chg > 0 THEN chg WHEN chg <= 0 THEN 0 END AS gain,
  CASE WHEN chg < 0 THEN -chg WHEN chg >= 0 THEN 0 END AS loss, typical_price * volume AS traded,
  {ratio('volume - rolling_volume_mean_20', 'sd_20')} AS volume_zscore_20,
  {ratio('volume - rolling_volume_mean_60', 'sd_60')} AS volume_zscore_60,
  {ratio('volume', 'rolling_volume_mean_20')} AS relative_volume_20 FROM f1)"""
    )
    vwap = ",\n".join(
        f"CASE WHEN segment_row >= {n - 1} AND abs({rows_agg('sum(volume)', n)}) > 0 THEN "
        f"{rows_agg('sum(traded)', n)} / {rows_agg('sum(volume)', n)} END AS rolling_vwap_{n}{s}"
        for n in (60, 240)
    )
    parts.append(
        f"""f3 AS (SELECT *, {vwap},
  CASE WHEN segment_row >= 13 THEN {rows_agg('avg(tr)', 14)} END AS atr_14,
  CASE WHEN segment_row >= 14 THEN {rows_agg('avg(gain)', 14)} END AS up,
  CASE WHEN segment_row >= 14 THEN {rows_agg('avg(loss)', 14)} END AS down FROM f2)"""
    )
    ema_cols = ""
    if with_ema:
        ema_cols = (
            "".join(f", {ln('close', f'ema_{n}')} AS close_to_ema_{n}" for n in EMA_SPANS)
            + f", {ln('ema_5', 'ema_20')} AS ema5_vs_ema20, {ln('ema_20', 'ema_50')} AS ema20_vs_ema50"
        )
    local = "timezone('America/Chicago', timezone('UTC', ts))"
    parts.append(
        f"""f4 AS (SELECT *, {ratio('atr_14', 'close')} AS atr_14_normalized,
  CASE WHEN down = 0 THEN (CASE WHEN up = 0 THEN 50.0 ELSE 100.0 END)
       WHEN down > 0 THEN 100.0 - 100.0 / (1.0 + up / down) END AS rsi_14,
  {ratio(f'close - rolling_vwap_60{s}', 'close')} AS close_minus_vwap_60{s}_pct,
  {ratio(f'close - rolling_vwap_240{s}', 'close')} AS close_minus_vwap_240{s}_pct{ema_cols},
  CAST(EXTRACT(hour FROM {local}) AS BIGINT) AS chicago_hour,
  CAST(EXTRACT(minute FROM {local}) AS BIGINT) AS chicago_minute,
  CAST(EXTRACT(isodow FROM {local}) - 1 AS BIGINT) AS chicago_day_of_week FROM f3),
feat AS (SELECT *, sin(2 * pi() * (chicago_hour * 60.0 + chicago_minute) / 1440) AS hour_sin,
  cos(2 * pi() * (chicago_hour * 60.0 + chicago_minute) / 1440) AS hour_cos,
  sin(2 * pi() * chicago_day_of_week / 7.0) AS day_of_week_sin,
  cos(2 * pi() * chicago_day_of_week / 7.0) AS day_of_week_cos FROM f4)"""
    )
    return ",\n".join(parts)


def query(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select
