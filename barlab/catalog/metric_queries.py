"""Splits, folds, samples, metrics, deciles, regimes and stability."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from barlab.catalog import sql as q
from barlab.catalog.bars import EV_TILE, LI_TILE, seg_ev, seg_li, seg_su
from barlab.catalog.registry import register, report
from barlab.functions.clock import DAY, MINUTE, weekday_name
from barlab.functions.numeric import finite
from barlab.operators import features as feat
from barlab.operators import labels as lab
from barlab.operators import metrics as met
from barlab.operators import profile as prof
from barlab.operators import quality as qual
from barlab.operators import sampling as samp
from barlab.operators import splits as spl
from barlab.operators import stability as stab
from barlab.session import materialise

TARGET = "future_return_1d"
LAST = "log_return_1d"
VOL = "realized_vol_15d"
PURGE = 75
FOLD_MARKS = [datetime(y, 1, 1) for y in (1997, 1998, 1999, 2000, 2001)]
DATA_START = datetime(1995, 1, 2)

FEAT_LI = (q.BARS_LI, q.SEGMENTS, q.feature_ctes(q.DAYS, with_ema=False))
ELIGIBLE_LI = f"elig AS (SELECT * FROM feat WHERE {TARGET} IS NOT NULL AND rolling_vwap_240d IS NOT NULL)"


def features_li(spark, sf_dir):
    return lab.build_labelled_features(seg_li(spark, sf_dir), DAY)


def eligible_li(spark, sf_dir, *columns):
    """Eligible rows of the dense daily bars, only the named columns."""
    return features_li(spark, sf_dir).where(qual.eligible(DAY, TARGET)).select(*columns)


def folds_li():
    return spl.walk_forward_folds(DATA_START, FOLD_MARKS, timedelta(days=PURGE))


def fold_values(column: str) -> str:
    rows = ", ".join(
        f"('{f.fold}', TIMESTAMP '{f.train_start}', TIMESTAMP '{f.train_end}', "
        f"TIMESTAMP '{f.evaluation_start}', TIMESTAMP '{f.evaluation_end}')"
        for f in folds_li()
    )
    return f"folds(fold, ts0, ts1, es, ee) AS (VALUES {rows})"


FOLDS_SQL = fold_values("fold")


def naive_sql(source: str, keys: str = "root, ts", name: str = "pred") -> str:
    return f"""{name} AS (
  SELECT {keys}, {TARGET} AS a, 'zero' AS model, 0.0 AS p FROM {source} UNION ALL
  SELECT {keys}, {TARGET}, 'persistence', {LAST} FROM {source} UNION ALL
  SELECT {keys}, {TARGET}, 'reversal', -{LAST} FROM {source})"""


def metrics_sql(source: str, keys: str, name: str = "m") -> str:
    """Rank columns over full pairs and the metric row of every key, also of those without a pair."""
    def avg_rank(c: str) -> str:
        return (
            f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + "
            f"(count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0"
        )

    def corr(x: str, y: str) -> str:
        s = f"(stddev_pop({x}) * stddev_pop({y}))"
        return f"CASE WHEN count(*) > 1 AND {s} > 0 THEN covar_pop({x}, {y}) / {s} END"

    return f"""{name}_rk AS (SELECT *, {avg_rank('a')} AS ra, {avg_rank('p')} AS rp FROM {source} WHERE a IS NOT NULL AND p IS NOT NULL),
{name}_g AS (SELECT DISTINCT {keys} FROM {source}),
{name}_f AS (SELECT {keys}, count(*) AS n_pairs, avg(abs(a - p)) AS mae, sqrt(avg((a - p) * (a - p))) AS rmse,
  CASE WHEN count(*) > 1 THEN CASE WHEN var_pop(a) > 0 THEN 1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*))
    WHEN sum((a - p) * (a - p)) = 0 THEN 1.0 ELSE 0.0 END END AS r2,
  {corr('a', 'p')} AS pearson, {corr('ra', 'rp')} AS spearman,
  avg(CASE WHEN sign(a) = sign(p) THEN 1.0 ELSE 0.0 END) AS direction_accuracy
  FROM {name}_rk GROUP BY {keys}),
{name} AS (SELECT *, coalesce(n_pairs, 0) AS observations FROM {name}_g LEFT JOIN {name}_f USING ({keys}))"""


def metric_columns(prefix: str = "") -> str:
    return f"{prefix}observations, " + ", ".join(f"{q.rd(prefix + m)} AS {m}" for m in met.METRIC_NAMES)


SCOPED = "scoped AS (SELECT *, root AS scope FROM pred UNION ALL SELECT *, 'ALL' AS scope FROM pred)"


def naive_li(spark, sf_dir, *extra):
    rows = eligible_li(spark, sf_dir, "root", "ts", TARGET, LAST, *extra)
    return met.naive_predictions(rows, LAST)


LABELLED_SU = (
    q.BARS_SU,
    "span AS (SELECT epoch_us(min(ts)) AS s, epoch_us(max(ts)) AS e FROM bars)",
    """cut AS (SELECT make_timestamp(CAST(floor((s + round((e - s) * 0.7)) / 60000000) * 60000000 AS BIGINT)) AS b1,
  make_timestamp(CAST(floor((s + round((e - s) * 0.85)) / 60000000) * 60000000 AS BIGINT)) AS b2 FROM span)""",
    f"""lab AS (SELECT b.*, b1, b2, CASE WHEN ts < b1 - INTERVAL {PURGE} DAY THEN 'train'
  WHEN ts >= b1 + INTERVAL {PURGE} DAY AND ts < b2 - INTERVAL {PURGE} DAY THEN 'validation'
  WHEN ts >= b2 + INTERVAL {PURGE} DAY THEN 'test' ELSE 'purged' END AS split FROM bars b, cut)""",
)


@register(
    "split_counts",
    q.query(
        *LABELLED_SU,
        select="SELECT root, split, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, "
        "min(b1) AS train_validation_boundary, min(b2) AS validation_test_boundary FROM lab GROUP BY root, split",
    ),
)
def split_counts(spark, sf_dir):
    from barlab.catalog.bars import bars_su

    bars = materialise(bars_su(spark, sf_dir))
    b = spl.boundaries_of(bars, PURGE, DAY)
    return report(
        spl.assign_split(bars, b)
        .groupBy("root", F.coalesce("split", F.lit("purged")).alias("split"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            spl._at(b.first).alias("train_validation_boundary"),
            spl._at(b.second).alias("validation_test_boundary"),
        )
    )


@register(
    "split_integrity",
    q.query(
        *LABELLED_SU,
        "per AS (SELECT ts, min(split) FILTER (WHERE split <> 'purged') AS lo, max(split) FILTER (WHERE split <> 'purged') AS hi, "
        "min(b2) AS b2 FROM lab GROUP BY ts)",
        select="SELECT count(*) FILTER (WHERE lo <> hi OR (hi = 'test' AND ts < b2)) AS violations, count(*) AS timestamps FROM per",
    ),
)
def split_integrity(spark, sf_dir):
    from barlab.catalog.bars import bars_su

    bars = materialise(bars_su(spark, sf_dir))
    b = spl.boundaries_of(bars, PURGE, DAY)
    bad = spl.split_violations(spl.assign_split(bars, b), b)
    return report(
        bars.select("ts").distinct().withColumn("_bad", F.lit(0))
        .unionByName(bad.select("ts", F.lit(1).alias("_bad")))
        .agg(F.sum("_bad").alias("violations"), F.count_if(F.col("_bad") == 0).alias("timestamps"))
    )


@register(
    "fold_declaration",
    q.query(
        *FEAT_LI, ELIGIBLE_LI, FOLDS_SQL,
        """per AS (SELECT fold, root, count(*) FILTER (WHERE ts >= ts0 AND ts < ts1) AS t,
  count(*) FILTER (WHERE ts >= es AND ts < ee) AS e FROM elig, folds GROUP BY fold, root)""",
        select="SELECT fold, CASE WHEN grouping(root) = 1 THEN 'ALL' ELSE root END AS root, "
        "CAST(sum(t) AS BIGINT) AS eligible_training_rows, CAST(sum(least(t, 400)) AS BIGINT) AS selected_training_rows, "
        "CAST(sum(e) AS BIGINT) AS eligible_evaluation_rows FROM per GROUP BY GROUPING SETS ((fold, root), (fold))",
    ),
)
def fold_declaration(spark, sf_dir):
    return report(spl.fold_declaration(eligible_li(spark, sf_dir, "root", "ts"), folds_li(), 400))


@register(
    "fold_reconciliation",
    q.query(
        *FEAT_LI, ELIGIBLE_LI, FOLDS_SQL,
        "decl AS (SELECT fold, root, count(*) FILTER (WHERE ts >= es AND ts < ee) AS e FROM elig, folds GROUP BY fold, root)",
        "got AS (SELECT fold, root, count(*) AS n FROM elig JOIN folds ON ts >= es AND ts < ee GROUP BY fold, root)",
        select="SELECT fold, root, n AS evaluated_rows, CAST(n IS DISTINCT FROM e AS BIGINT) AS mismatch FROM got LEFT JOIN decl USING (fold, root)",
    ),
)
def fold_reconciliation(spark, sf_dir):
    """Declared evaluation counts against the rows actually loaded per fold."""
    rows = materialise(eligible_li(spark, sf_dir, "root", "ts"))
    declared = spl.fold_declaration(rows, folds_li(), 400).where("root <> 'ALL'").select(
        "fold", "root", F.col("eligible_evaluation_rows").alias("rows")
    )
    loaded = spl.with_evaluation_folds(rows, folds_li()).groupBy("fold", "root").agg(
        F.count(F.lit(1)).alias("rows")
    )
    bad = stab.count_mismatches(declared.where("rows > 0"), loaded, ["fold", "root"], ["rows"])
    flags = bad.select("fold", "root", F.lit(1).alias("mismatch"))
    return report(
        loaded.join(flags, ["fold", "root"], "left").select(
            "fold", "root", F.col("rows").alias("evaluated_rows"),
            F.coalesce("mismatch", F.lit(0)).alias("mismatch"),
        )
    )


def even_sql(source: str, cap: int) -> str:
    return f"""pos AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY ts) - 1 AS rn,
  count(*) OVER (PARTITION BY root) AS n FROM {source}),
picks AS (SELECT DISTINCT root, CASE WHEN n <= {cap} THEN i ELSE (i * (n - 1)) // ({cap} - 1) END AS rn
  FROM (SELECT DISTINCT root, n FROM pos) g, range({cap}) r(i) WHERE i < n),
picked AS (SELECT p.* FROM pos p JOIN picks USING (root, rn))"""


@register(
    "even_sample",
    q.query(
        q.BARS_SU, even_sql("bars", 100),
        select=f"SELECT root, ts, {q.rd('close')} AS close, n AS group_rows FROM picked",
    ),
)
def even_sample(spark, sf_dir):
    from barlab.catalog.bars import bars_su

    rows = samp.even_sample(bars_su(spark, sf_dir), 100, DAY, tile_units=LI_TILE)
    return report(rows.select("root", "ts", "close", "group_rows"))


@register(
    "every_nth_row",
    q.query(
        q.BARS_EV,
        select=f"SELECT root, ts, {q.rd('close')} AS close FROM (SELECT *, row_number() OVER "
        "(PARTITION BY root ORDER BY ts) AS rn FROM bars) WHERE (rn - 1) % 20 = 0",
    ),
)
def every_nth_row(spark, sf_dir):
    from barlab.catalog.bars import bars_ev

    rows = samp.every_nth(bars_ev(spark, sf_dir), 20, MINUTE, tile_units=EV_TILE)
    return report(rows.select("root", "ts", "close"))


@register(
    "training_caps",
    q.query(
        *FEAT_LI, ELIGIBLE_LI,
        "caps(cap) AS (VALUES (50), (100), (200), (5000))",
        select="SELECT CAST(cap AS BIGINT) AS cap, root, count(*) AS eligible_rows, "
        "CAST(least(cap, count(*)) AS BIGINT) AS selected_rows FROM elig, caps GROUP BY cap, root",
    ),
)
def training_caps(spark, sf_dir):
    from barlab.operators.models import sample_counts

    rows = eligible_li(spark, sf_dir, "root", "ts")
    return report(sample_counts(rows, (50, 100, 200, 5000), DAY, LI_TILE))


@register(
    "selected_row_digest",
    q.query(
        *FEAT_LI, ELIGIBLE_LI, even_sql("elig", 100),
        """ln AS (SELECT root, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' || chr(31) || root || chr(31) || instrument_id
  || chr(31) || contract_segment_id || chr(10) AS line FROM picked)""",
        select="SELECT root, count(*) AS rows, sha256(string_agg(line, '' ORDER BY ts)) AS digest FROM ln GROUP BY root",
    ),
)
def selected_row_digest(spark, sf_dir):
    """The digest of each root's capped training rows, as one stream in time order."""
    rows = eligible_li(spark, sf_dir, "root", "ts", "instrument_id", "contract_segment_id")
    return report(samp.selected_row_digest(samp.even_sample(rows, 100, DAY, tile_units=LI_TILE)))


@register(
    "sample_fingerprint",
    q.query(
        q.BARS_SU, q.SEGMENTS, even_sql("seg", 100),
        f"""hashed AS (SELECT root, ts, epoch_us(ts) // ({LI_TILE} * {q.DAYS['micros']}) AS tile,
  sha256(CAST(epoch_us(ts) AS VARCHAR) || chr(31) || root || chr(31) || CAST(instrument_id AS VARCHAR) || chr(31) ||
         CAST(contract_segment_id AS VARCHAR)) AS h FROM picked)""",
        "tiles AS (SELECT root, tile, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY ts)) AS th FROM hashed GROUP BY root, tile)",
        select="SELECT root, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(th, chr(10) ORDER BY tile)) AS fingerprint "
        "FROM tiles GROUP BY root",
    ),
)
def sample_fingerprint(spark, sf_dir):
    sample = samp.even_sample(materialise(seg_su(spark, sf_dir)), 100, DAY, tile_units=LI_TILE)
    return report(samp.row_fingerprint(sample, DAY, tile_units=LI_TILE))


@register(
    "roll_context",
    q.query(
        q.BARS_SU, q.SEGMENTS,
        """pos AS MATERIALIZED (SELECT root, ts, roll_event, contract_segment_id,
  row_number() OVER (PARTITION BY root ORDER BY ts) AS rn FROM seg),
near AS MATERIALIZED (SELECT root, contract_segment_id AS roll_segment, rn AS roll_rn, unnest(range(rn - 5, rn + 6)) AS rn
  FROM pos WHERE roll_event)""",
        select="SELECT root, ts, roll_segment, CAST(rn - roll_rn AS BIGINT) AS offset_rows FROM near JOIN pos USING (root, rn)",
    ),
)
def roll_context(spark, sf_dir):
    rows = samp.around_rolls(materialise(seg_su(spark, sf_dir)), 5)
    return report(rows.select("root", "ts", "roll_segment", F.col("offset").alias("offset_rows")))


@register(
    "naive_metrics",
    q.query(
        *FEAT_LI, ELIGIBLE_LI, naive_sql("elig"), SCOPED, metrics_sql("scoped", "model, scope"),
        select=f"SELECT model, scope, {metric_columns()} FROM m",
    ),
)
def naive_metrics(spark, sf_dir):
    return report(met.evaluate(naive_li(spark, sf_dir), ["model"], TARGET, "prediction"))


SU_RETURNS = (q.BARS_SU, q.SEGMENTS, q.returns(q.DAYS, (1, 5)), q.labels(q.DAYS, (1,)))


@register(
    "metrics_by_supplier",
    q.query(
        *SU_RETURNS, naive_sql("lab"), metrics_sql("pred", "model, root"),
        select=f"SELECT model, root, {metric_columns()} FROM m",
    ),
)
def metrics_by_supplier(spark, sf_dir):
    """Suppliers grow in number, not in days: dealt by supplier once, each is a task's work up to its metrics."""
    rows = feat.add_short_families(seg_su(spark, sf_dir), [feat.returns(DAY, (1, 5)), lab.labels(DAY, (1,))])
    # a bar without an outcome is in no pair; a supplier's first bar stands for it, should it have no pair at all
    first = (F.col("contract_segment_id") == 1) & (F.col("segment_row") == 0)
    judged = rows.where(finite(F.col(TARGET)) | first)
    scored = met.naive_predictions(judged.select("root", "ts", TARGET, LAST), LAST)
    return report(
        met.regression_metrics(scored, ["model", "root"], TARGET, "prediction", short=True)
    )


@register(
    "macro_average",
    q.query(
        *FEAT_LI, ELIGIBLE_LI, naive_sql("elig"), metrics_sql("pred", "model, root"),
        select="SELECT model, count(*) AS groups, "
        + ", ".join(f"{q.rd(f'avg({m})')} AS {m}" for m in met.METRIC_NAMES)
        + " FROM m GROUP BY model",
    ),
)
def macro_average(spark, sf_dir):
    per_root = met.regression_metrics(naive_li(spark, sf_dir), ["model", "root"], TARGET, "prediction")
    return report(met.macro_average(per_root, ["model"]))


@register(
    "metrics_by_weekday",
    q.query(
        *FEAT_LI, ELIGIBLE_LI, naive_sql("elig", "root, ts, chicago_day_of_week AS wd"),
        metrics_sql("pred", "model, wd"),
        select="SELECT model, (['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'])[wd + 1] "
        f"AS weekday, {metric_columns()} FROM m",
    ),
)
def metrics_by_weekday(spark, sf_dir):
    rows = naive_li(spark, sf_dir, "chicago_day_of_week").withColumn(
        "weekday", weekday_name(F.col("chicago_day_of_week"))
    )
    return report(met.regression_metrics(rows, ["model", "weekday"], TARGET, "prediction"))


EV_TARGET, EV_LAST = "future_return_5m", "log_return_5m"


@register(
    "metrics_by_hour",
    q.query(
        q.BARS_EV, q.SEGMENTS, q.feature_ctes(q.MINUTES, with_ema=False),
        f"pred AS (SELECT CAST(chicago_hour AS VARCHAR) AS hour, {EV_TARGET} AS a, -{EV_LAST} AS p FROM feat)",
        metrics_sql("pred", "hour"),
        select=f"SELECT hour, {metric_columns()}, hour IN ('11', '12', '21', '22') AS highlighted FROM m",
    ),
)
def metrics_by_hour(spark, sf_dir):
    rows = lab.build_labelled_features(seg_ev(spark, sf_dir), MINUTE).select(
        F.col("chicago_hour").cast("string").alias("hour"), EV_TARGET, (-F.col(EV_LAST)).alias("prediction")
    )
    by_hour = met.regression_metrics(rows, ["hour"], EV_TARGET, "prediction")
    return report(
        by_hour.withColumn("highlighted", F.col("hour").isin("11", "12", "21", "22"))
        .orderBy(F.col("hour").cast("int"))
    )


TERTILES = """vr AS (SELECT root, realized_vol_15d AS v, row_number() OVER (PARTITION BY root ORDER BY realized_vol_15d) - 1 AS rn,
  count(*) OVER (PARTITION BY root) AS n FROM elig WHERE realized_vol_15d IS NOT NULL),
tert AS (SELECT root, max(CASE WHEN rn = round((n - 1) * (1.0::DOUBLE / 3)) THEN v END) AS low_max,
  max(CASE WHEN rn = round((n - 1) * (2.0::DOUBLE / 3)) THEN v END) AS medium_max FROM vr GROUP BY root)"""
REGIME = """CASE WHEN realized_vol_15d IS NULL OR low_max IS NULL THEN 'unavailable'
  WHEN realized_vol_15d <= low_max THEN 'low' WHEN realized_vol_15d <= medium_max THEN 'medium' ELSE 'high' END"""


@register(
    "volatility_tertiles",
    q.query(*FEAT_LI, ELIGIBLE_LI, TERTILES,
            select=f"SELECT root, {q.rd('low_max')} AS low_max, {q.rd('medium_max')} AS medium_max FROM tert"),
)
def volatility_tertiles(spark, sf_dir):
    return report(prof.tertiles(eligible_li(spark, sf_dir, "root", VOL), VOL))


@register(
    "metrics_by_regime",
    q.query(
        *FEAT_LI, ELIGIBLE_LI, TERTILES,
        f"reg AS (SELECT e.*, {REGIME} AS regime FROM elig e LEFT JOIN tert USING (root))",
        naive_sql("reg", "root, ts, regime"), metrics_sql("pred", "model, regime"),
        select=f"SELECT model, regime, {metric_columns()} FROM m",
    ),
)
def metrics_by_regime(spark, sf_dir):
    rows = materialise(eligible_li(spark, sf_dir, "root", "ts", TARGET, LAST, VOL))
    labelled = prof.with_regime(rows, prof.tertiles(rows, VOL), VOL)
    scored = met.naive_predictions(labelled, LAST)
    return report(met.regression_metrics(scored, ["model", "regime"], TARGET, "prediction"))


DECILES = """dec AS (SELECT *, ntile(10) OVER (PARTITION BY {keys} ORDER BY p, root, ts) AS decile FROM {source}),
d AS (SELECT {keys}, CAST(decile AS BIGINT) AS decile, count(*) AS observations, avg(p) AS mean_prediction,
  avg(a) AS mean_actual, median(a) AS median_actual FROM dec GROUP BY {keys}, decile)"""
_DEC_COLS = ", ".join(f"{q.rd(c)} AS {c}" for c in ("mean_prediction", "mean_actual", "median_actual"))


@register(
    "prediction_deciles",
    q.query(
        *FEAT_LI, ELIGIBLE_LI, naive_sql("elig"), DECILES.format(keys="model", source="(SELECT * FROM pred WHERE a IS NOT NULL AND p IS NOT NULL)"),
        select=f"SELECT model, decile, observations, {_DEC_COLS} FROM d",
    ),
)
def prediction_deciles(spark, sf_dir):
    return report(
        met.prediction_deciles(
            naive_li(spark, sf_dir), ["model"], TARGET, "prediction", DAY, tile_units=LI_TILE
        )
    )


SUMMARY = """dr AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY mean_actual) +
   (count(*) OVER (PARTITION BY {keys}, mean_actual) - 1) / 2.0 AS rk,
   mean_actual - lag(mean_actual) OVER (PARTITION BY {keys} ORDER BY decile) AS step FROM d),
ds AS (SELECT {keys}, max(CASE WHEN decile = 10 THEN mean_actual END) AS top,
  max(CASE WHEN decile = 1 THEN mean_actual END) AS bottom,
  CASE WHEN stddev_pop(rk) > 0 THEN covar_pop(decile, rk) / (stddev_pop(decile) * stddev_pop(rk)) END AS ord,
  bool_and(coalesce(step >= 0, true)) AS mono FROM dr GROUP BY {keys})"""


@register(
    "decile_summary",
    q.query(
        *FEAT_LI, ELIGIBLE_LI, naive_sql("elig"), DECILES.format(keys="model", source="(SELECT * FROM pred WHERE a IS NOT NULL AND p IS NOT NULL)"),
        SUMMARY.format(keys="model"),
        select=f"SELECT model, {q.rd('top')} AS top_decile_mean_actual, {q.rd('bottom')} AS bottom_decile_mean_actual, "
        f"{q.rd('top - bottom')} AS top_minus_bottom, {q.rd('ord')} AS decile_order_spearman, "
        "mono AS fully_non_decreasing FROM ds",
    ),
)
def decile_summary(spark, sf_dir):
    deciles = met.prediction_deciles(
        naive_li(spark, sf_dir), ["model"], TARGET, "prediction", DAY, tile_units=LI_TILE
    )
    return report(met.decile_summary(deciles, ["model"]))


# --- walk-forward: naive models scored on every fold -------------------------------------------

FOLD_PRED = "fp AS (SELECT p.*, fold FROM pred p JOIN folds ON ts >= es AND ts < ee)"
FOLD_SCOPED = "fs AS (SELECT *, root AS scope FROM fp UNION ALL SELECT *, 'ALL' AS scope FROM fp)"
WF = (*FEAT_LI, ELIGIBLE_LI, FOLDS_SQL, naive_sql("elig"), FOLD_PRED)


def fold_naive(spark, sf_dir, *extra):
    return spl.with_evaluation_folds(naive_li(spark, sf_dir, *extra), folds_li())


def summary_sql(v: str, suffix: str = "") -> str:
    return (
        f"{q.rd(f'avg({v})')} AS mean{suffix}, {q.rd(f'median({v})')} AS median{suffix}, "
        f"{q.rd(f'stddev_pop({v})')} AS standard_deviation{suffix}, {q.rd(f'min({v})')} AS minimum{suffix}, "
        f"{q.rd(f'max({v})')} AS maximum{suffix}, count(*) FILTER (WHERE {v} > 0) AS positive_folds{suffix}, "
        f"count({v}) AS finite_folds{suffix}"
    )


def unpivot_sql(source: str, keys: str, metrics, name: str = "long") -> str:
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT {keys}, '{m}' AS metric, {m} AS value FROM {source}" for m in metrics
    ) + ")"


@register(
    "fold_metrics",
    q.query(*WF, FOLD_SCOPED, metrics_sql("fs", "fold, model, scope"),
            select=f"SELECT fold, model, scope, {metric_columns()} FROM m"),
)
def fold_metrics(spark, sf_dir):
    return report(met.evaluate(fold_naive(spark, sf_dir), ["fold", "model"], TARGET, "prediction"))


@register(
    "fold_stability",
    q.query(*WF, metrics_sql("fp", "fold, model"), unpivot_sql("m", "model", met.METRIC_NAMES),
            select=f"SELECT model, metric, {summary_sql('value')} FROM long GROUP BY model, metric"),
)
def fold_stability(spark, sf_dir):
    overall = met.regression_metrics(fold_naive(spark, sf_dir), ["fold", "model"], TARGET, "prediction")
    return report(stab.metric_stability(stab.long_metrics(overall, ["model"]), ["model"]))


@register(
    "root_stability",
    q.query(
        *WF, metrics_sql("fp", "fold, model, root"),
        """rk AS (SELECT *, row_number() OVER (PARTITION BY fold, model ORDER BY pearson DESC NULLS LAST, root) AS rnk FROM m)""",
        select=f"SELECT model, root, {summary_sql('pearson', '_pearson')}, {summary_sql('spearman', '_spearman')}, "
        f"string_agg(CAST(rnk AS VARCHAR), ',' ORDER BY fold) AS ranks, {q.rd('avg(rnk)')} AS average_rank, "
        f"{q.rd('stddev_pop(rnk)')} AS rank_standard_deviation, min(rnk) AS best_rank, max(rnk) AS worst_rank "
        "FROM rk GROUP BY model, root",
    ),
)
def root_stability(spark, sf_dir):
    per_root = met.regression_metrics(
        fold_naive(spark, sf_dir), ["fold", "model", "root"], TARGET, "prediction"
    )
    return report(stab.root_stability(per_root))


@register(
    "root_ranking",
    q.query(
        *SU_RETURNS, naive_sql("lab"), metrics_sql("pred", "model, root"),
        select=f"SELECT model, root, {q.rd('pearson')} AS pearson, row_number() OVER "
        "(PARTITION BY model ORDER BY pearson DESC NULLS LAST, root) AS rank FROM m",
    ),
)
def root_ranking(spark, sf_dir):
    rows = lab.add_future_labels(
        feat.add_exact_returns(seg_su(spark, sf_dir), DAY, (1, 5)), DAY, (1,)
    )
    scored = met.naive_predictions(rows.select("root", TARGET, LAST), LAST)
    table = met.regression_metrics(scored, ["model", "root"], TARGET, "prediction", spearman=False)
    return report(stab.root_ranks(table, ["model"]).select("model", "root", "pearson", "rank"))


@register(
    "top_roots",
    q.query(
        *FEAT_LI, ELIGIBLE_LI, naive_sql("elig"), metrics_sql("pred", "model, root"),
        select=f"SELECT model, root, {q.rd('pearson')} AS pearson FROM m WHERE pearson IS NOT NULL "
        "ORDER BY m.pearson DESC, root LIMIT 3",
    ),
)
def top_roots(spark, sf_dir):
    table = met.regression_metrics(
        naive_li(spark, sf_dir), ["model", "root"], TARGET, "prediction", spearman=False
    )
    return report(
        table.where(finite(F.col("pearson"))).orderBy(F.desc("pearson"), "root").limit(3)
        .select("model", "root", "pearson")
    )


@register(
    "best_model",
    q.query(
        *FEAT_LI, ELIGIBLE_LI, naive_sql("elig"), metrics_sql("pred", "model, root"),
        select=f"SELECT root, max_by(model, pearson) AS best_model, {q.rd('max(pearson)')} AS best_pearson "
        "FROM m WHERE pearson IS NOT NULL GROUP BY root",
    ),
)
def best_model(spark, sf_dir):
    table = met.regression_metrics(
        naive_li(spark, sf_dir), ["model", "root"], TARGET, "prediction", spearman=False
    )
    return report(stab.best_by_metric(table, ["root"], "model"))


@register(
    "model_comparison",
    q.query(
        *WF, metrics_sql("fp", "fold, model"),
        """dl AS (SELECT r.fold, r.pearson - p.pearson AS pearson_delta, r.spearman - p.spearman AS spearman_delta,
  r.r2 - p.r2 AS r2_delta FROM m r JOIN m p ON r.fold = p.fold AND r.model = 'reversal' AND p.model = 'persistence')""",
        unpivot_sql("dl", "fold", ("pearson_delta", "spearman_delta", "r2_delta")),
        select=f"SELECT metric, {summary_sql('value')}, count(*) FILTER (WHERE value > 0) AS challenger_wins, "
        "count(*) FILTER (WHERE value < 0) AS incumbent_wins FROM long GROUP BY metric",
    ),
)
def model_comparison(spark, sf_dir):
    overall = met.regression_metrics(fold_naive(spark, sf_dir), ["fold", "model"], TARGET, "prediction")
    deltas = stab.paired_deltas(overall, ["fold"], "model", "reversal", "persistence")
    return report(stab.comparison_summary(deltas))


@register(
    "regime_stability",
    q.query(
        *FEAT_LI, ELIGIBLE_LI, TERTILES,
        f"reg AS (SELECT e.*, {REGIME} AS regime FROM elig e LEFT JOIN tert USING (root))",
        FOLDS_SQL, naive_sql("reg", "root, ts, regime"), FOLD_PRED, metrics_sql("fp", "fold, model, regime"),
        unpivot_sql("m", "model, regime", ("r2", "pearson", "spearman")),
        select=f"SELECT model, regime, metric, {summary_sql('value')} FROM long GROUP BY model, regime, metric",
    ),
)
def regime_stability(spark, sf_dir):
    rows = materialise(eligible_li(spark, sf_dir, "root", "ts", TARGET, LAST, VOL))
    labelled = prof.with_regime(rows, prof.tertiles(rows, VOL), VOL)
    scored = spl.with_evaluation_folds(met.naive_predictions(labelled, LAST), folds_li())
    table = met.regression_metrics(scored, ["fold", "model", "regime"], TARGET, "prediction")
    long = stab.long_metrics(table, ["model", "regime"], ("r2", "pearson", "spearman"))
    return report(stab.metric_stability(long, ["model", "regime"]))


@register(
    "hour_stability",
    q.query(
        *FEAT_LI, ELIGIBLE_LI, FOLDS_SQL, naive_sql("elig", "root, ts, chicago_hour AS hour"), FOLD_PRED,
        metrics_sql("fp", "fold, model, hour"), unpivot_sql("m", "model, hour", ("r2", "pearson", "spearman")),
        select=f"SELECT model, hour, metric, {summary_sql('value')} FROM long GROUP BY model, hour, metric",
    ),
)
def hour_stability(spark, sf_dir):
    """Fold stability per Chicago hour (daily bars fall on two hours, by summer time)."""
    rows = eligible_li(spark, sf_dir, "root", "ts", TARGET, LAST, F.col("chicago_hour").alias("hour"))
    scored = spl.with_evaluation_folds(met.naive_predictions(materialise(rows), LAST), folds_li())
    table = met.regression_metrics(scored, ["fold", "model", "hour"], TARGET, "prediction")
    long = stab.long_metrics(table, ["model", "hour"], ("r2", "pearson", "spearman"))
    return report(stab.metric_stability(long, ["model", "hour"]))


@register(
    "decile_stability",
    q.query(
        *WF, DECILES.format(keys="fold, model", source="(SELECT * FROM fp WHERE a IS NOT NULL AND p IS NOT NULL)"), SUMMARY.format(keys="fold, model"),
        select=f"SELECT model, {summary_sql('ord', '_ordering')}, {summary_sql('(top - bottom)', '_spread')}, "
        "count(*) FILTER (WHERE mono) AS fully_non_decreasing_folds, "
        "count(*) FILTER (WHERE top - bottom > 0) AS positive_spread_folds FROM ds GROUP BY model",
    ),
)
def decile_stability(spark, sf_dir):
    deciles = met.prediction_deciles(
        fold_naive(spark, sf_dir), ["fold", "model"], TARGET, "prediction", DAY, tile_units=LI_TILE
    )
    return report(stab.decile_stability(deciles, ["model"]))
