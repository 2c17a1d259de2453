"""Causal own-market features of a bar, computed inside its contract segment.

Every feature family is a list of steps, each a set of columns that may use those of earlier
steps. Families are laid side by side, so one step of all of them is one Window operator: the
whole graph needs one exchange, one sort and as many Window operators as the longest family.
Columns that start with an underscore are dropped at the end.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barlab.functions.clock import Clock, local_clock_columns, micros
from barlab.functions.numeric import log_ratio, safe_ratio
from barlab.operators.tiles import BLOCK_ROWS, SEGMENT_KEYS, in_blocks

# Horizons, spans and window lengths of the feature set.
RETURN_HORIZONS = (1, 5, 15, 30, 60)
EMA_SPANS = (5, 20, 50)
OSCILLATOR_ROWS = 14
VOLATILITY_UNITS = (5, 15, 60)
VOLUME_ROWS = (20, 60)
VWAP_ROWS = (60, 240)
CANDLE_FEATURES = (
    "return_open_to_close",
    "range_pct",
    "upper_wick_pct",
    "lower_wick_pct",
    "close_location_in_bar",
)
EMA_RATIOS = ("close_to_ema_5", "close_to_ema_20", "close_to_ema_50", "ema5_vs_ema20", "ema20_vs_ema50")


def own_feature_names(clock: Clock) -> list[str]:
    """The 35 model features, in matrix order."""
    return [
        *[clock.name("log_return", h) for h in RETURN_HORIZONS],
        *CANDLE_FEATURES,
        *EMA_RATIOS,
        "rsi_14",
        "atr_14_normalized",
        *[clock.name("realized_vol", u) for u in VOLATILITY_UNITS],
        "volume",
        *[f"rolling_volume_mean_{n}" for n in VOLUME_ROWS],
        *[f"volume_zscore_{n}" for n in VOLUME_ROWS],
        "relative_volume_20",
        *[clock.name("close_minus_vwap", n) + "_pct" for n in VWAP_ROWS],
        "chicago_hour",
        "chicago_minute",
        "chicago_day_of_week",
        "hour_sin",
        "hour_cos",
        "day_of_week_sin",
        "day_of_week_cos",
    ]


def close_at(w: WindowSpec, offset_micros: int) -> Column:
    """The close at exactly ``_t + offset``; null when that clock time has no bar."""
    return F.max("close").over(w.rangeBetween(offset_micros, offset_micros))


def last_rows(w: WindowSpec, rows: int) -> WindowSpec:
    return w.rowsBetween(-(rows - 1), 0)


def full(rows: int, value: Column) -> Column:
    """Keep a row-window value only once the segment has that many rows."""
    return F.when(F.col("segment_row") >= rows - 1, value)


Steps = list[dict[str, Column]]
Family = Callable[[WindowSpec], Steps]


def run_steps(rows: DataFrame, w: WindowSpec, families: Sequence[Family]) -> DataFrame:
    """Apply the families step by step and drop their helper columns."""
    kept = set(rows.columns)
    lists = [family(w) for family in families]
    for level in range(max(map(len, lists))):
        columns: dict[str, Column] = {}
        for steps in lists:
            if level < len(steps):
                columns.update(steps[level])
        rows = rows.withColumns(columns)
    return rows.select(*[c for c in rows.columns if c in kept or not c.startswith("_")])


def ema_levels(span: int) -> int:
    """log2 of the rows after which the remaining weight is below 2**-60 (under double precision)."""
    decay = (span - 1) / (span + 1)
    return math.ceil(math.log2(60 * math.log(2) / -math.log(decay)))


def returns(clock: Clock, horizons: Sequence[int] = RETURN_HORIZONS) -> Family:
    """ln(close[t] / close[t - h]) at the exact earlier clock time."""
    def steps(w: WindowSpec) -> Steps:
        past = {f"_past_{h}": close_at(w, -clock.span(h)) for h in horizons}
        return [
            past,
            {
                clock.name("log_return", h): log_ratio(F.col("close"), F.col(f"_past_{h}"))
                for h in horizons
            },
        ]

    return steps


def candle_columns() -> dict[str, Column]:
    o, h, lo, c = (F.col(n) for n in ("open", "high", "low", "close"))
    shapes = (
        safe_ratio(c - o, o),
        safe_ratio(h - lo, c),
        safe_ratio(h - F.greatest(o, c), c),
        safe_ratio(F.least(o, c) - lo, c),
        safe_ratio(c - lo, h - lo),
    )
    return dict(zip(CANDLE_FEATURES, shapes))


def candles(w: WindowSpec) -> Steps:
    return [candle_columns()]


def running_sum(value: Column, base: str, rows: int, w: WindowSpec, decay: float = 1.0) -> Steps:
    """``{base}_last_{rows}``: sum of the last ``rows`` values, the one j rows back times decay**j.

    A sliding SUM frame visits every row of the frame again for every row. Here the sums of 8,
    64, 512... rows are each built from eight lagged sums of the step before, and the requested
    length from a few of those, so the cost grows with the logarithm of the frame. No running
    total is ever subtracted, so nothing cancels. Missing rows before the block count as zero.
    Sums of several lengths over one ``base`` share their partial sums.
    """
    def back(column: str, offset: int) -> Column:
        c = F.col(column) if offset == 0 else F.lag(column, offset, 0.0).over(w)
        return c if decay == 1.0 or offset == 0 else c * decay**offset

    def total(terms: Sequence[Column]) -> Column:
        return reduce(lambda x, y: x + y, terms)

    sizes = [1]
    while sizes[-1] * 8 <= rows:
        sizes.append(sizes[-1] * 8)
    partial = {size: f"{base}_sum_{size}" for size in sizes}
    steps: Steps = [{partial[1]: value}]
    for small, big in zip(sizes, sizes[1:]):
        steps.append({partial[big]: total([back(partial[small], j * small) for j in range(8)])})
    terms, offset = [], 0
    for size in reversed(sizes):
        while rows - offset >= size:
            terms.append(back(partial[size], offset))
            offset += size
    steps.append({f"{base}_last_{rows}": total(terms)})
    return steps


def running_deviation(base: str, rows: int, w: WindowSpec) -> Steps:
    """``{base}_sd_{rows}``: sample deviation of the last ``rows`` values, for full frames only.

    Laid beside the ``running_sum`` of the same base and length, whose partial sums it reads. Squares about the mean
    of a block follow from those of its parts and the distances of the parts' means, so nothing cancels and the cost
    grows with the logarithm of the frame. What is below the rounding of a constant counts as no spread.
    """
    def back(column: str, offset: int) -> Column:
        return F.col(column) if offset == 0 else F.lag(column, offset, 0.0).over(w)

    def merged(parts: Sequence[tuple[int, int]], whole: Column, length: int) -> Column:
        mean = whole / length
        terms = [
            (back(f"{base}_sum_{size}", offset) / size - mean) ** 2 * size
            + (back(f"{base}_about_{size}", offset) if size > 1 else F.lit(0.0))
            for size, offset in parts
        ]
        return reduce(lambda x, y: x + y, terms)

    sizes, steps = [1], [{}, {}]
    while sizes[-1] * 8 <= rows:
        small, big = sizes[-1], sizes[-1] * 8
        steps.append({f"{base}_about_{big}": merged([(small, j * small) for j in range(8)], F.col(f"{base}_sum_{big}"), big)})
        sizes.append(big)
    parts, offset = [], 0
    for size in reversed(sizes):
        while rows - offset >= size:
            parts.append((size, offset))
            offset += size
    total = F.col(f"{base}_last_{rows}")
    about = F.col(f"{base}_about_last_{rows}")
    steps.append({f"{base}_about_last_{rows}": merged(parts, total, rows)})
    spread = F.when(about > 1e-28 * total * total / rows, about).otherwise(F.when(about.isNotNull(), 0.0))
    steps.append({f"{base}_sd_{rows}": F.sqrt(spread / (rows - 1))})
    return steps


def side_by_side(*families: Steps) -> Steps:
    """Merge families that may run in the same steps."""
    out: Steps = [{} for _ in range(max(map(len, families)))]
    for steps in families:
        for level, columns in enumerate(steps):
            out[level].update(columns)
    return out


def trend(w: WindowSpec) -> Steps:
    """Recursive EMAs (first close as seed) and their log ratios.

    An EMA is the decayed sum of ``alpha * close``, where the seed row keeps its full weight. It
    reaches back until the remaining weight is below double precision.
    """
    def seeded(span: int) -> Column:
        alpha = 2.0 / (span + 1)
        return F.when(F.col("segment_row") == 0, F.col("close")).otherwise(F.col("close") * alpha)

    reach = {s: 2 ** ema_levels(s) for s in EMA_SPANS}
    sums = side_by_side(
        *[running_sum(seeded(s), f"_e{s}", reach[s], w, (s - 1) / (s + 1)) for s in EMA_SPANS]
    )
    ratios = (
        *[log_ratio(F.col("close"), F.col(f"ema_{s}")) for s in EMA_SPANS],
        log_ratio(F.col("ema_5"), F.col("ema_20")),
        log_ratio(F.col("ema_20"), F.col("ema_50")),
    )
    return [
        *sums,
        {f"ema_{s}": full(s, F.col(f"_e{s}_last_{reach[s]}")) for s in EMA_SPANS},
        dict(zip(EMA_RATIOS, ratios)),
    ]


def rsi(w: WindowSpec, n: int = OSCILLATOR_ROWS) -> Steps:
    """Simple-mean RSI; needs n price changes, so the first value is at segment row n."""
    change, up, down = F.col("_change"), F.col("_up"), F.col("_down")
    frame = last_rows(w, n)
    return [
        {"_change": F.col("close") - F.lag("close").over(w)},
        {
            "_gain": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))),
            "_loss": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))),
        },
        {"_up": F.avg("_gain").over(frame), "_down": F.avg("_loss").over(frame)},
        {
            "rsi_14": full(
                n + 1,
                F.when(down == 0, F.when(up == 0, 50.0).otherwise(100.0)).otherwise(
                    100.0 - 100.0 / (1.0 + safe_ratio(up, down))
                ),
            )
        },
    ]


def atr(w: WindowSpec, n: int = OSCILLATOR_ROWS) -> Steps:
    """Mean true range; the first bar of a segment has only its own high-low range."""
    h, lo, prev = F.col("high"), F.col("low"), F.col("_prev")
    return [
        {"_prev": F.lag("close").over(w)},
        {"_range": F.greatest(h - lo, F.abs(h - prev), F.abs(lo - prev))},
        {"_atr": F.avg("_range").over(last_rows(w, n))},
        {
            "atr_14": full(n, F.col("_atr")),
            "atr_14_normalized": full(n, safe_ratio(F.col("_atr"), F.col("close"))),
        },
    ]


def realized_volatility(clock: Clock, wait: int = 0) -> Family:
    """Sample deviation of one-unit returns over the clock window (t - u, t].

    ``wait`` counts the steps after which the one-unit return column exists.
    """
    base = clock.name("log_return", 1)

    def steps(w: WindowSpec) -> Steps:
        found = {
            clock.name("realized_vol", u): F.stddev_samp(base).over(w.rangeBetween(1 - clock.span(u), 0))
            for u in VOLATILITY_UNITS
        }
        return [*[{} for _ in range(wait)], found]

    return steps


def volumes(w: WindowSpec) -> Steps:
    volume = F.col("volume").cast("double")
    means = {n: F.col(f"_volume_last_{n}") / n for n in VOLUME_ROWS}
    sums = side_by_side(
        *[running_sum(volume, "_volume", n, w) for n in VOLUME_ROWS],
        *[running_deviation("_volume", n, w) for n in VOLUME_ROWS],
    )
    return [
        *sums,
        {
            **{f"rolling_volume_mean_{n}": full(n, means[n]) for n in VOLUME_ROWS},
            **{
                f"volume_zscore_{n}": full(n, safe_ratio(volume - means[n], F.col(f"_volume_sd_{n}")))
                for n in VOLUME_ROWS
            },
            "relative_volume_20": full(20, safe_ratio(volume, means[20])),
        },
    ]


def vwaps(clock: Clock) -> Family:
    """Typical price weighted by volume over the last bars, and the close's distance from it."""
    def steps(w: WindowSpec) -> Steps:
        typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
        volume = F.col("volume").cast("double")
        names = {n: clock.name("rolling_vwap", n) for n in VWAP_ROWS}
        sums = side_by_side(
            [{"typical_price": typical}],
            *[running_sum(typical * volume, "_traded", n, w) for n in VWAP_ROWS],
            *[running_sum(volume, "_volume", n, w) for n in VWAP_ROWS],
        )
        prices = {
            name: full(n, safe_ratio(F.col(f"_traded_last_{n}"), F.col(f"_volume_last_{n}")))
            for n, name in names.items()
        }
        gaps = {
            clock.name("close_minus_vwap", n) + "_pct": safe_ratio(
                F.col("close") - F.col(name), F.col("close")
            )
            for n, name in names.items()
        }
        return [*sums, prices, gaps]

    return steps


def local_clock(w: WindowSpec) -> Steps:
    return [local_clock_columns(F.col("ts"))]


def own_families(clock: Clock) -> list[Family]:
    """The whole own-market graph."""
    return [
        returns(clock), candles, trend, rsi, atr, realized_volatility(clock, wait=2), volumes,
        vwaps(clock), local_clock,
    ]


def context_rows() -> int:
    """Rows before a bar that any own feature can depend on."""
    return max(
        *VWAP_ROWS, *VOLUME_ROWS, *RETURN_HORIZONS, max(VOLATILITY_UNITS) + 1,
        OSCILLATOR_ROWS + 1, *[2 ** ema_levels(s) for s in EMA_SPANS],
    )


def add_families(
    bars: DataFrame, families: Sequence[Family], back: int, ahead: int = 0, size: int = BLOCK_ROWS
) -> DataFrame:
    """Families over row blocks with their context rows; ``ahead`` is for labels only."""
    return in_blocks(bars, lambda rows, w: run_steps(rows, w, families), back, ahead, size)


def add_short_families(bars: DataFrame, families: Sequence[Family]) -> DataFrame:
    """``add_families`` for segments that a task may hold (see ``segments.add_short_contract_segments``): windows over
    whole segments, so rows need neither a number nor copies."""
    rows = bars.withColumn("_t", micros(F.col("ts")))
    return run_steps(rows, Window.partitionBy(*SEGMENT_KEYS).orderBy("_t"), families).drop("_t")


def add_exact_returns(
    bars: DataFrame, clock: Clock, horizons: Sequence[int] = RETURN_HORIZONS, size: int = BLOCK_ROWS
) -> DataFrame:
    return add_families(bars, [returns(clock, horizons)], max(horizons), 0, size)


def add_candles(bars: DataFrame) -> DataFrame:
    return bars.withColumns(candle_columns())


def add_clock_features(bars: DataFrame) -> DataFrame:
    return bars.withColumns(local_clock_columns(F.col("ts")))


def add_trend(bars: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    """EMAs, their log ratios and RSI."""
    return add_families(bars, [trend, rsi], context_rows(), 0, size)


def add_volatility(bars: DataFrame, clock: Clock, size: int = BLOCK_ROWS) -> DataFrame:
    """ATR and realised volatility; expects the one-unit return column."""
    families = [atr, realized_volatility(clock)]
    return add_families(bars, families, max(VOLATILITY_UNITS) + 1, 0, size)


def add_volume(bars: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    return add_families(bars, [volumes], max(VOLUME_ROWS), 0, size)


def add_vwap(bars: DataFrame, clock: Clock, size: int = BLOCK_ROWS) -> DataFrame:
    return add_families(bars, [vwaps(clock)], max(VWAP_ROWS), 0, size)


def build_own_features(bars: DataFrame, clock: Clock, size: int = BLOCK_ROWS) -> DataFrame:
    """All 35 own-market features with one exchange and one sort."""
    return add_families(bars, own_families(clock), context_rows(), 0, size)
