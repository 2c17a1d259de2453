"""Segments, causal features and labels on small bars, against plain Python."""

import math
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from barlab.functions.clock import MINUTE
from barlab.operators import features as feat
from barlab.operators import labels as lab
from barlab.operators import segments as seg
from barlab.session import materialise
from tests.conftest import START


def by_minute(df, column):
    return {int((r["ts"] - START).total_seconds() // 60): r[column] for r in df.collect()}


def segmented(df, tile=3):
    return seg.add_contract_segments(df, MINUTE, tile)


def test_returning_instrument_opens_a_new_segment(bars):
    df = segmented(bars(range(6), [7, 9, 9, 9, 7, 7]))
    assert by_minute(df, "contract_segment_id") == {0: 1, 1: 2, 2: 2, 3: 2, 4: 3, 5: 3}
    assert by_minute(df, "roll_event") == {0: False, 1: True, 2: False, 3: False, 4: True, 5: False}
    assert by_minute(df, "segment_row") == {0: 0, 1: 0, 2: 1, 3: 2, 4: 0, 5: 1}
    assert by_minute(df, "segment_rows") == {0: 1, 1: 3, 2: 3, 3: 3, 4: 2, 5: 2}


@pytest.mark.parametrize("tile", [1, 2, 7, 1000])
def test_segments_do_not_depend_on_the_tile_size(bars, tile):
    rng = random.Random(tile)
    minutes = sorted(rng.sample(range(200), 80))
    instruments, current = [], 1
    for _ in minutes:
        if rng.random() < 0.15:
            current = rng.choice([1, 2, 3])
        instruments.append(current)
    two = bars(minutes, instruments).unionByName(bars(minutes, instruments[::-1], root="ES"))
    got = {
        (r["root"], r["ts"]): (r["roll_event"], r["contract_segment_id"], r["segment_start"],
                               r["segment_end"], r["segment_row"], r["segment_rows"])
        for r in seg.add_contract_segments(two, MINUTE, tile).collect()
    }
    for root, chain in (("NQ", instruments), ("ES", instruments[::-1])):
        ids, current = [], 1
        for i, instrument in enumerate(chain):
            current += i > 0 and instrument != chain[i - 1]
            ids.append(current)
        for i, m in enumerate(minutes):
            members = [minutes[j] for j in range(len(ids)) if ids[j] == ids[i]]
            at = lambda x: START + timedelta(minutes=x)
            assert got[(root, at(m))] == (
                i > 0 and ids[i] != ids[i - 1], ids[i], at(members[0]), at(members[-1]),
                members.index(m), len(members),
            )


def test_short_roots_have_the_same_segments_in_one_exchange(spark, bars):
    stored = bars([0, 1, 3, 4, 7, 8, 9], [1, 2, 2, 1, 1, 3, 3]).unionByName(bars([2, 5], [4, 4], "ES"))
    found = seg.add_short_contract_segments(stored)
    wanted = seg.add_contract_segments(stored, MINUTE, 4)
    assert found.dtypes == wanted.dtypes and sorted(found.collect()) == sorted(wanted.collect())
    shaped = feat.add_trend(seg.add_short_contract_segments(materialise(stored)))
    assert shaped._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_rollover_table_and_audit(bars):
    df = bars([0, 1, 4, 5, 9], [1, 1, 1, 2, 2])
    table = {r["contract_segment_id"]: r for r in seg.rollover_table(df, MINUTE, 2).collect()}
    assert [table[i]["rows"] for i in (1, 2)] == [3, 2]
    assert [table[i]["roll_event"] for i in (1, 2)] == [False, True]
    audit = {r["row_type"]: r for r in seg.root_audit(segmented(df), MINUTE).collect()}
    assert audit["root"]["irregular_intervals"] == 2
    assert audit["root"]["missing_units"] == 2 + 3
    assert audit["total"]["rollovers"] == 1


def test_gap_does_not_shift_the_horizon(bars):
    df = feat.add_exact_returns(segmented(bars([0, 2, 3, 4, 5, 7, 8, 11])), MINUTE, (1, 5))
    five, one = by_minute(df, "log_return_5m"), by_minute(df, "log_return_1m")
    assert five[11] is None and one[7] is None and one[11] is None
    assert five[8] == pytest.approx(math.log(108 / 103)) and one[8] == pytest.approx(math.log(108 / 107))


def test_nothing_crosses_a_segment(bars):
    df = segmented(bars(range(7), [4, 4, 4, 8, 8, 8, 8]))
    assert by_minute(feat.add_exact_returns(df, MINUTE, (1,)), "log_return_1m")[3] is None
    labels = by_minute(lab.add_future_labels(df, MINUTE, (1,)), "future_return_1m")
    assert labels[2] is None and labels[1] == pytest.approx(math.log(102 / 101))


def test_direction_label(bars):
    df = lab.add_future_labels(segmented(bars(range(8), closes=[5.0, 5.0, 5.0, 5.0, 5.0, 6.0, 5.0, 4.0])), MINUTE)
    got = by_minute(df, "direction_5m")
    assert (got[0], got[1], got[2], got[3]) == ("UP", None, "DOWN", None)


def test_features_do_not_see_later_rows(bars):
    names = feat.own_feature_names(MINUTE)
    long = by_minute(feat.build_own_features(segmented(bars(range(80))), MINUTE).withColumn("f", F.struct(*names)), "f")
    short = by_minute(feat.build_own_features(segmented(bars(range(60))), MINUTE).withColumn("f", F.struct(*names)), "f")
    assert len(names) == 35
    for m in range(60):
        assert tuple(short[m]) == pytest.approx(tuple(long[m]), nan_ok=True) or short[m] == long[m]


def plain_features(minutes, closes, volumes):
    """Row-by-row reference values for one segment."""
    out = []
    at = dict(zip(minutes, closes))
    ema = {}
    r1 = {}
    for i, (m, c) in enumerate(zip(minutes, closes)):
        row = {}
        for s in (5, 20, 50):
            a = 2 / (s + 1)
            ema[s] = c if i == 0 else a * c + (1 - a) * ema[s]
            row[f"ema_{s}"] = ema[s] if i >= s - 1 else None
        r1[m] = math.log(c / at[m - 1]) if m - 1 in at else None
        row["log_return_1m"] = r1[m]
        window = [r1[k] for k in range(m - 14, m + 1) if r1.get(k) is not None]
        if len(window) > 1:
            mean = sum(window) / len(window)
            row["realized_vol_15m"] = math.sqrt(sum((x - mean) ** 2 for x in window) / (len(window) - 1))
        else:
            row["realized_vol_15m"] = None
        if i >= 14:
            changes = [closes[j] - closes[j - 1] for j in range(i - 13, i + 1)]
            up, down = sum(max(x, 0) for x in changes) / 14, sum(max(-x, 0) for x in changes) / 14
            row["rsi_14"] = (50.0 if up == 0 else 100.0) if down == 0 else 100 - 100 / (1 + up / down)
        else:
            row["rsi_14"] = None
        for n in (60, 240):
            if i >= n - 1:
                part = range(i - n + 1, i + 1)
                v = sum(volumes[j] for j in part)
                row[f"rolling_vwap_{n}m"] = sum(closes[j] * volumes[j] for j in part) / v if v else None
            else:
                row[f"rolling_vwap_{n}m"] = None
        row["rolling_volume_mean_20"] = sum(volumes[i - 19 : i + 1]) / 20 if i >= 19 else None
        out.append(row)
    return out


@pytest.mark.parametrize("size", [7, 64, 65_536])
def test_block_cuts_do_not_change_features(bars, size):
    rng = random.Random(5)
    minutes = sorted(rng.sample(range(700), 400))
    closes = [round(100 + rng.gauss(0, 5), 2) for _ in minutes]
    df = segmented(bars(minutes, closes=closes), tile=50)
    volumes = [float(10 + m) for m in minutes]
    back = max(feat.context_rows(), 0)
    families = [feat.returns(MINUTE, (1,)), feat.trend, feat.rsi, feat.realized_volatility(MINUTE, 2),
                feat.volumes, feat.vwaps(MINUTE)]
    # With a tiny block every row is context of many blocks; keep that case to a short history.
    if size == 7:
        df = df.where("segment_row < 90")
        minutes, closes, volumes = minutes[:90], closes[:90], volumes[:90]
    got = sorted(feat.add_families(df, families, back, 0, size).collect(), key=lambda r: r["ts"])
    for row, want in zip(got, plain_features(minutes, closes, volumes), strict=True):
        for name, value in want.items():
            if value is None:
                assert row[name] is None, name
            else:
                assert row[name] == pytest.approx(value, rel=1e-11, abs=1e-13), name


def test_ema_of_a_long_segment_matches_the_recursion(bars):
    rng = random.Random(1)
    closes = [100 + rng.random() * 50 for _ in range(5000)]
    df = segmented(bars(range(5000), closes=closes), tile=512)
    got = by_minute(feat.add_trend(df, size=1024), "ema_50")
    value = closes[0]
    for m in range(1, 5000):
        value = 2 / 51 * closes[m] + 49 / 51 * value
        if m >= 49:
            assert got[m] == pytest.approx(value, rel=1e-13)


def test_running_sum_of_any_length(spark, bars):
    from pyspark.sql import Window

    df = bars(range(200))
    w = Window.partitionBy("root").orderBy("ts")
    for n in (1, 2, 7, 8, 9, 60, 63, 64, 65, 100):
        out = feat.run_steps(df, w, [lambda w, n=n: [*feat.running_sum(F.col("volume"), "_v", n, w), {"s": F.col(f"_v_last_{n}")}]])
        got = by_minute(out, "s")
        assert all(got[m] == sum(10.0 + k for k in range(max(0, m - n + 1), m + 1)) for m in range(200)), n


def test_volume_deviation_is_merged_from_blocks_without_a_sliding_frame(spark, bars):
    rng = random.Random(11)
    values = [1e6 + 0.3] * 70 + [1e6 + rng.gauss(0, 1) for _ in range(130)]
    found = feat.add_volume(segmented(bars(range(200)).withColumn("volume", F.get(F.array(*map(F.lit, values)), F.col("close").cast("int") - 100))))
    assert "stddev" not in found._jdf.queryExecution().optimizedPlan().toString()
    for n in (20, 60):
        got = by_minute(found, f"volume_zscore_{n}")
        assert [got[i] for i in range(70)] == [None] * 70
        for i in range(70, 200):
            frame = values[i - n + 1 : i + 1]
            mean = math.fsum(frame) / n
            deviation = math.sqrt(math.fsum((v - mean) ** 2 for v in frame) / (n - 1))
            assert got[i] == pytest.approx((values[i] - mean) / deviation, rel=1e-6, abs=1e-6)


def test_chicago_clock(spark):
    ts = [START.replace(day=2, hour=h) for h in (6, 12, 18)]
    df = feat.add_clock_features(spark.createDataFrame([(t,) for t in ts], "ts timestamp"))
    rows = sorted(df.collect(), key=lambda r: r["ts"])
    assert [r["chicago_hour"] for r in rows] == [0, 6, 12]
    assert [r["chicago_day_of_week"] for r in rows] == [1, 1, 1]
    assert [r["hour_sin"] for r in rows] == pytest.approx([0, 1, 0], abs=1e-12)
    assert [r["hour_cos"] for r in rows] == pytest.approx([1, 0, -1], abs=1e-12)


def test_candle_ratios_are_null_on_zero_denominators(bars):
    flat = bars([0], closes=[0.0]).withColumns({"high": F.lit(0.0), "low": F.lit(0.0)})
    row = feat.add_candles(flat).first()
    assert all(row[c] is None for c in feat.CANDLE_FEATURES)
