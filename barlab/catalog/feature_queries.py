"""Segments, features, labels and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.catalog import sql as q
from barlab.catalog.bars import (
    LI_TILE,
    bars_li,
    bars_su,
    seg_ev,
    seg_li,
    seg_su,
)
from barlab.catalog.registry import register, report
from barlab.functions.clock import DAY, MINUTE
from barlab.operators import features as feat
from barlab.operators import labels as lab
from barlab.operators import segments as seg

IDENTITY = ("root", "ts")


# Accumulated prices reach 1e5, so four decimals are already near the end of double precision.
PRICE_DIGITS = {
    c: 4 for c in ("ema_5", "ema_20", "ema_50", "atr_14", "rolling_vwap_60d", "rolling_vwap_240d")
} | {"typical_price": 8}


def _sql_cols(names, digits=8) -> str:
    return ", ".join(f"{q.rd(n, PRICE_DIGITS.get(n, digits))} AS {n}" for n in names)


@register(
    "contract_segments",
    q.query(
        q.BARS_SU, q.SEGMENTS,
        select="SELECT root, ts, instrument_id, roll_event, contract_segment_id, segment_start, "
        "segment_end, CAST(segment_row AS BIGINT) AS segment_row FROM seg",
    ),
)
def contract_segments(spark, sf_dir):
    return report(
        seg_su(spark, sf_dir).select(
            "root", "ts", "instrument_id", "roll_event", "contract_segment_id", "segment_start",
            "segment_end", "segment_row",
        )
    )


@register(
    "rollover_table",
    q.query(
        q.BARS_SU, q.SEGMENTS,
        select="SELECT root, contract_segment_id, min(instrument_id) AS instrument_id, "
        "min(ts) AS segment_start, max(ts) AS segment_end, count(*) AS rows, "
        "contract_segment_id > 1 AS roll_event FROM seg GROUP BY root, contract_segment_id",
    ),
)
def rollovers(spark, sf_dir):
    return report(seg.rollover_table(bars_su(spark, sf_dir), DAY, LI_TILE))


@register(
    "root_audit",
    q.query(
        q.BARS_SU, q.SEGMENTS,
        f"""gap AS (SELECT *, (t - lag(t) OVER (PARTITION BY root, contract_segment_id ORDER BY ts))
  // {q.DAYS['micros']} AS g FROM seg),
per AS (SELECT root, count(*) AS n, min(ts) AS a, max(ts) AS b, max(contract_segment_id) AS s,
  count(*) FILTER (WHERE roll_event) AS r, count(*) FILTER (WHERE g <> 1) AS i,
  coalesce(sum(CASE WHEN g > 1 THEN g - 1 END), 0) AS m FROM gap GROUP BY root)""",
        select="SELECT root, CASE WHEN grouping(root) = 1 THEN 'total' ELSE 'root' END AS row_type, "
        "CAST(sum(n) AS BIGINT) AS processed_rows, min(a) AS min_timestamp, max(b) AS max_timestamp, "
        "CAST(sum(s) AS BIGINT) AS contract_segments, CAST(sum(r) AS BIGINT) AS rollovers, "
        "CAST(sum(i) AS BIGINT) AS irregular_intervals, CAST(sum(m) AS BIGINT) AS missing_units "
        "FROM per GROUP BY ROLLUP (root)",
    ),
)
def root_audit(spark, sf_dir):
    return report(seg.root_audit(seg_su(spark, sf_dir), DAY))


@register(
    "bar_gaps",
    q.query(
        q.BARS_EV, q.SEGMENTS,
        select=f"""SELECT root, ts, contract_segment_id,
  CAST((t - lag(t) OVER (PARTITION BY root, contract_segment_id ORDER BY ts))
  // {q.MINUTES['micros']} AS BIGINT) AS units_since_previous FROM seg""",
    ),
)
def bar_gaps(spark, sf_dir):
    return report(
        seg.with_bar_gap(seg_ev(spark, sf_dir), MINUTE).select(
            "root", "ts", "contract_segment_id", "units_since_previous"
        )
    )


_RET_EV = [MINUTE.name("log_return", h) for h in feat.RETURN_HORIZONS]


@register(
    "exact_returns",
    q.query(
        q.BARS_EV, q.SEGMENTS, q.returns(q.MINUTES),
        select=f"SELECT root, ts, {_sql_cols(_RET_EV)} FROM ret",
    ),
)
def exact_returns(spark, sf_dir):
    return report(feat.add_exact_returns(seg_ev(spark, sf_dir), MINUTE).select(*IDENTITY, *_RET_EV))


_LAB_EV = lab.label_names(MINUTE)


@register(
    "future_labels",
    q.query(
        q.BARS_EV, q.SEGMENTS, q.labels(q.MINUTES, source="seg"),
        select=f"SELECT root, ts, {_sql_cols(_LAB_EV)}, direction_5m FROM lab",
    ),
)
def future_labels(spark, sf_dir):
    return report(
        lab.add_future_labels(seg_ev(spark, sf_dir), MINUTE).select(
            *IDENTITY, *_LAB_EV, "direction_5m"
        )
    )


_CANDLE = list(feat.CANDLE_FEATURES)


@register(
    "candle_features",
    q.query(q.BARS_SU, select="SELECT root, ts, " + ", ".join(
        f"{q.rd(c, 8)} AS {c}" for c in _CANDLE) + f" FROM (SELECT *, {q.CANDLES} FROM bars)"),
)
def candle_features(spark, sf_dir):
    return report(feat.add_candles(bars_su(spark, sf_dir)).select(*IDENTITY, *_CANDLE))


_CLOCK = ["chicago_hour", "chicago_minute", "chicago_day_of_week"]
_CYCLE = ["hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos"]


@register(
    "clock_features",
    q.query(
        q.BARS_EV, q.SEGMENTS, q.feature_ctes(q.MINUTES, with_ema=False),
        select=f"SELECT root, ts, {', '.join(_CLOCK)}, {_sql_cols(_CYCLE)} FROM feat",
    ),
)
def clock_features(spark, sf_dir):
    from barlab.catalog.bars import bars_ev

    return report(feat.add_clock_features(bars_ev(spark, sf_dir)).select(*IDENTITY, *_CLOCK, *_CYCLE))


_TREND = ["ema_5", "ema_20", "ema_50", *feat.EMA_RATIOS, "rsi_14"]


@register(
    "trend_features",
    q.query(
        q.BARS_SU, q.SEGMENTS, q.feature_ctes(q.DAYS),
        select=f"SELECT root, ts, {_sql_cols(_TREND, 7)} FROM feat",
    ),
)
def trend_features(spark, sf_dir):
    return report(feat.add_trend(seg_su(spark, sf_dir)).select(*IDENTITY, *_TREND), 7, PRICE_DIGITS)


_VOLA = ["atr_14", "atr_14_normalized", *[DAY.name("realized_vol", u) for u in (5, 15, 60)]]


@register(
    "volatility_features",
    q.query(
        q.BARS_SU, q.SEGMENTS, q.feature_ctes(q.DAYS, with_ema=False),
        select=f"SELECT root, ts, {_sql_cols(_VOLA, 7)} FROM feat",
    ),
)
def volatility_features(spark, sf_dir):
    returns = feat.add_exact_returns(seg_su(spark, sf_dir), DAY, (1,))
    return report(feat.add_volatility(returns, DAY).select(*IDENTITY, *_VOLA), 7, PRICE_DIGITS)


_VOLUME = [
    "rolling_volume_mean_20", "rolling_volume_mean_60", "volume_zscore_20", "volume_zscore_60",
    "relative_volume_20",
]


@register(
    "volume_features",
    q.query(
        q.BARS_SU, q.SEGMENTS, q.feature_ctes(q.DAYS, with_ema=False),
        select=f"SELECT root, ts, {_sql_cols(_VOLUME, 7)} FROM feat",
    ),
)
def volume_features(spark, sf_dir):
    return report(feat.add_volume(seg_su(spark, sf_dir)).select(*IDENTITY, *_VOLUME), 7)


_VWAP = ["typical_price", "rolling_vwap_60d", "rolling_vwap_240d", "close_minus_vwap_60d_pct",
         "close_minus_vwap_240d_pct"]


@register(
    "vwap_features",
    q.query(
        q.BARS_LI, q.SEGMENTS, q.feature_ctes(q.DAYS, with_ema=False),
        select=f"SELECT root, ts, {_sql_cols(_VWAP, 7)} FROM feat",
    ),
)
def vwap_features(spark, sf_dir):
    return report(feat.add_vwap(seg_li(spark, sf_dir), DAY).select(*IDENTITY, *_VWAP), 7, PRICE_DIGITS)


_OWN = feat.own_feature_names(DAY)
_OWN_INT = {"chicago_hour", "chicago_minute", "chicago_day_of_week"}


@register(
    "labelled_features",
    q.query(
        q.BARS_LI, q.SEGMENTS, q.feature_ctes(q.DAYS),
        select="SELECT root, ts, contract_segment_id, "
        + ", ".join(c if c in _OWN_INT else f"{q.rd(c, 7)} AS {c}" for c in _OWN)
        + f", {_sql_cols(lab.label_names(DAY), 7)}, direction_5d FROM feat",
    ),
)
def labelled_features(spark, sf_dir):
    return report(
        lab.build_labelled_features(seg_li(spark, sf_dir), DAY).select(
            *IDENTITY, "contract_segment_id", *_OWN, *lab.label_names(DAY), "direction_5d"
        ),
        7,
    )
