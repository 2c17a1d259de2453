"""Cross-market context, audits, quality, profiles, drift and histograms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from barlab.catalog import sql as q
from barlab.catalog.bars import (
    EV_ANCHORS,
    LI_ANCHORS,
    LI_TILE,
    seg_ev,
    table,
)
from barlab.catalog.metric_queries import (
    ELIGIBLE_LI,
    FEAT_LI,
    LAST,
    TARGET,
    even_sql,
    features_li,
)
from barlab.catalog.registry import register, report
from barlab.functions.clock import DAY, MINUTE
from barlab.operators import cross
from barlab.operators import features as feat
from barlab.operators import labels as lab
from barlab.operators.lineage import lineage_table
from barlab.operators import profile as prof
from barlab.operators import quality as qual
from barlab.operators import sampling as samp
from barlab.operators import stability as stab
from barlab.operators.tiles import ordered_index
from barlab.session import materialise

CUTOFF = datetime(2000, 1, 1)
EV_ANCHOR_COLS = cross.anchor_columns(MINUTE, EV_ANCHORS)
LI_ANCHOR_COLS = cross.anchor_columns(DAY, LI_ANCHORS)
EV_SPREAD = cross.spread_name(MINUTE, EV_ANCHORS)
LI_SPREAD = cross.spread_name(DAY, LI_ANCHORS)


def cols(names, digits=8) -> str:
    return ", ".join(f"{q.rd(n, digits)} AS {n}" for n in names)


def anchors_sql(source: str, anchors, suffix: str, name: str = "anc") -> str:
    wide = ", ".join(
        f"max(CASE WHEN root = '{a}' THEN log_return_{h}{suffix} END) AS {a}_return_{h}{suffix}"
        for a in anchors for h in (1, 5, 15)
    )
    listed = ", ".join(f"'{a}'" for a in anchors)
    x, y = (f"{a}_return_5{suffix}" for a in anchors[:2])
    spread = f"{anchors[0]}_{anchors[1]}_return_spread_5{suffix}"
    return (
        f"{name}0 AS (SELECT ts, {wide} FROM {source} WHERE root IN ({listed}) GROUP BY ts), "
        f"{name} AS (SELECT *, {x} - {y} AS {spread} FROM {name}0)"
    )


EV_RET = (q.BARS_EV, q.SEGMENTS, q.returns(q.MINUTES, (1, 5, 15)))
LI_B = (*FEAT_LI, anchors_sql("feat", LI_ANCHORS, "d"),
        "b AS (SELECT feat.*, anc.* EXCLUDE (ts) FROM feat LEFT JOIN anc ON feat.ts = anc.ts)")


def returns_ev(spark, sf_dir):
    """Stored once: the anchor table and the table it is attached to are the same rows."""
    return materialise(feat.add_exact_returns(seg_ev(spark, sf_dir), MINUTE, (1, 5, 15)))


def market_li(spark, sf_dir):
    """Own features, labels and anchors of the dense daily bars (own features stored once)."""
    own = materialise(features_li(spark, sf_dir))
    return cross.add_cross_market(own, cross.anchor_table(own, DAY, LI_ANCHORS))


@register(
    "anchor_table",
    q.query(*EV_RET, anchors_sql("ret", EV_ANCHORS, "m"),
            select=f"SELECT ts, {cols([*EV_ANCHOR_COLS, EV_SPREAD])} FROM anc"),
)
def anchor_table(spark, sf_dir):
    return report(
        cross.anchor_table(returns_ev(spark, sf_dir), MINUTE, EV_ANCHORS)
        .select("ts", *EV_ANCHOR_COLS, EV_SPREAD)
    )


@register(
    "cross_market",
    q.query(*EV_RET, anchors_sql("ret", EV_ANCHORS, "m"),
            select=f"SELECT root, ret.ts, {cols([*EV_ANCHOR_COLS, EV_SPREAD])} FROM ret LEFT JOIN anc ON ret.ts = anc.ts"),
)
def cross_market(spark, sf_dir):
    returns = returns_ev(spark, sf_dir)
    anchors = cross.anchor_table(returns, MINUTE, EV_ANCHORS)
    return report(
        cross.add_cross_market(returns.select("root", "ts"), anchors)
        .select("root", "ts", *EV_ANCHOR_COLS, EV_SPREAD)
    )


_REL = cross.relative_columns(DAY, LI_ANCHORS)


@register(
    "relative_returns",
    q.query(*LI_B, select="SELECT root, ts, " + ", ".join(
        f"{q.rd(f'log_return_{h}d - {a}_return_{h}d')} AS relative_to_{a}_return_{h}d"
        for a in LI_ANCHORS for h in (1, 5, 15)) + " FROM b"),
)
def relative_returns(spark, sf_dir):
    rel = cross.add_relative_returns(market_li(spark, sf_dir), DAY, LI_ANCHORS)
    return report(rel.select("root", "ts", *_REL))


@register(
    "experiment_sizes",
    q.query(
        *LI_B, f"e AS (SELECT * FROM b WHERE {TARGET} IS NOT NULL AND rolling_vwap_240d IS NOT NULL)",
        select="SELECT experiment, CAST(features AS BIGINT) AS features, (SELECT count(*) FROM e) AS rows, "
        f"(SELECT {q.rd(f'sum({TARGET})', 6)} FROM e) AS target_sum FROM (VALUES ('A', 35), ('B', 41), ('C', 41)) v(experiment, features)",
    ),
)
def experiment_sizes(spark, sf_dir):
    """Width, eligible rows and target checksum of the three experiment matrices."""
    rows = materialise(market_li(spark, sf_dir).where(qual.eligible(DAY, TARGET)))
    parts = []
    for name in ("A", "B", "C"):
        view = cross.experiment_view(rows, name, DAY, LI_ANCHORS, TARGET)
        features = cross.experiment_features(name, DAY, LI_ANCHORS)
        cross.check_feature_columns(features, DAY)
        parts.append(
            view.agg(
                F.lit(name).alias("experiment"),
                F.lit(len(view.columns) - 3).alias("features"),
                F.count(F.lit(1)).alias("rows"),
                F.sum(TARGET).alias("target_sum"),
            )
        )
    return report(parts[0].unionByName(parts[1]).unionByName(parts[2]), 6)


def _picked_sql(name: str, view: str) -> str:
    """CTEs ``at_<name>`` (root, position, ts): the even sample of one experiment's view, numbered."""
    own = even_sql("v_" + name, 100).replace("pos AS", f"pos_{name} AS").replace("FROM pos ", f"FROM pos_{name} ")
    own = own.replace("FROM pos)", f"FROM pos_{name})").replace("picks AS", f"picks_{name} AS").replace("JOIN picks ", f"JOIN picks_{name} ")
    own = own.replace("picked AS", f"picked_{name} AS")
    return (
        f"v_{name} AS ({view}), {own}, at_{name} AS (SELECT root, ts, row_number() OVER (PARTITION BY root ORDER BY ts) - 1 AS position "
        f"FROM picked_{name})"
    )


@register(
    "experiment_row_identity",
    q.query(
        *LI_B, f"e AS (SELECT * FROM b WHERE {TARGET} IS NOT NULL AND rolling_vwap_240d IS NOT NULL)",
        _picked_sql("a", "SELECT root, ts FROM e"), _picked_sql("b2", f"SELECT root, ts, {LI_ANCHOR_COLS[0]} FROM e"),
        _picked_sql("c", f"SELECT root, ts, log_return_1d - {LI_ANCHOR_COLS[0]} AS d FROM e"),
        "bad AS (SELECT coalesce(x.root, y.root) AS root FROM at_a x FULL JOIN at_b2 y USING (root, position) WHERE x.ts IS DISTINCT FROM y.ts "
        "UNION ALL SELECT coalesce(x.root, y.root) FROM at_a x FULL JOIN at_c y USING (root, position) WHERE x.ts IS DISTINCT FROM y.ts)",
        select="SELECT root, count(*) AS rows, (SELECT count(*) FROM bad WHERE bad.root = at_a.root) AS differences FROM at_a GROUP BY root",
    ),
)
def experiment_row_identity(spark, sf_dir):
    """The B and C samples hold the same (root, ts) rows at the same places as the A sample."""
    rows = materialise(market_li(spark, sf_dir).where(qual.eligible(DAY, TARGET)))

    def numbered(name):
        view = cross.experiment_view(rows, name, DAY, LI_ANCHORS, TARGET).select("root", "ts")
        sample = samp.even_sample(view, 100, DAY, tile_units=LI_TILE).drop("group_rows")
        return ordered_index(sample, ["root"], DAY, tile_units=LI_TILE).withColumnRenamed("row_index", "position")

    sample = {name: materialise(numbered(name)) for name in ("A", "B", "C")}
    base = sample["A"].groupBy("root").agg(F.count(F.lit(1)).alias("rows"))
    bad = (
        samp.ordered_differences(sample["A"], sample["B"])
        .unionByName(samp.ordered_differences(sample["A"], sample["C"]))
        .groupBy("root").agg(F.count(F.lit(1)).alias("differences"))
    )
    return report(
        base.join(bad, "root", "left").select("root", "rows", F.coalesce("differences", F.lit(0)).alias("differences"))
    )


_NEED = [*feat.own_feature_names(DAY), *LI_ANCHOR_COLS]


@register(
    "first_complete_row",
    q.query(
        q.BARS_LI, q.SEGMENTS, q.feature_ctes(q.DAYS), anchors_sql("feat", LI_ANCHORS, "d"),
        "b AS (SELECT feat.*, anc.* EXCLUDE (ts) FROM feat LEFT JOIN anc ON feat.ts = anc.ts)",
        select=f"SELECT root, ts, {cols(['close', 'rsi_14', 'rolling_vwap_240d', TARGET], 7)} FROM b WHERE "
        + " AND ".join(f"{c} IS NOT NULL" for c in [*_NEED, TARGET]) + " ORDER BY ts, root LIMIT 1",
    ),
)
def first_complete_row(spark, sf_dir):
    row = samp.first_complete_row(market_li(spark, sf_dir), [*_NEED, TARGET])
    return report(row.select("root", "ts", "close", "rsi_14", "rolling_vwap_240d", TARGET), 7)


# --- audits ------------------------------------------------------------------------------------

_EXACT = [*[f"log_return_{h}d" for h in (1, 5, 15, 30, 60)], *[f"future_return_{h}d" for h in (1, 5, 15)]]


@register(
    "feature_audit",
    q.query(
        *FEAT_LI,
        select=f"""SELECT root, count(*) AS rows,
  count(*) FILTER (WHERE future_return_5d IS NOT NULL AND rolling_vwap_240d IS NOT NULL) AS eligible_rows,
  count(*) FILTER (WHERE {' OR '.join(f'{c} IS NULL' for c in _EXACT)}) AS rows_missing_exact_timestamp,
  count(*) FILTER (WHERE rolling_vwap_240d IS NULL) AS rows_with_warmup_null,
  count(*) FILTER (WHERE rolling_vwap_240d IS NOT NULL AND future_return_5d IS NULL) AS rows_lost_missing_target,
  count(*) FILTER (WHERE t - epoch_us(segment_start) < 240 * {q.DAYS['micros']}
                      OR epoch_us(segment_end) - t < 15 * {q.DAYS['micros']}) AS rows_in_roll_guard
FROM feat GROUP BY root""",
    ),
)
def feature_audit(spark, sf_dir):
    return report(qual.feature_audit(features_li(spark, sf_dir), DAY, "future_return_5d"))


_AUDITED = [*qual.audited_columns(DAY), *LI_ANCHOR_COLS, LI_SPREAD]


def nulls_sql(source: str, name: str = "nul") -> str:
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT root, '{c}' AS \"column\", count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls "
        f"FROM {source} GROUP BY root" for c in _AUDITED
    ) + ")"


_FULL_B = (q.BARS_LI, q.SEGMENTS, q.feature_ctes(q.DAYS), anchors_sql("feat", LI_ANCHORS, "d"),
           "b AS MATERIALIZED (SELECT feat.*, anc.* EXCLUDE (ts) FROM feat LEFT JOIN anc ON feat.ts = anc.ts)",
           nulls_sql("b"))


@register(
    "null_rates",
    q.query(*_FULL_B, select=f"SELECT root, \"column\", rows, nulls, {q.rd('nulls / rows')} AS null_rate FROM nul"),
)
def null_rates(spark, sf_dir):
    return report(qual.null_counts(market_li(spark, sf_dir), _AUDITED))


@register(
    "top_null_rates",
    q.query(*_FULL_B, select="SELECT \"column\", CAST(sum(nulls) AS BIGINT) AS nulls, CAST(sum(rows) AS BIGINT) AS rows, "
            f"{q.rd('sum(nulls) / sum(rows)')} AS null_rate FROM nul GROUP BY \"column\" "
            "ORDER BY sum(nulls) / sum(rows) DESC, \"column\" LIMIT 20"),
)
def top_null_rates(spark, sf_dir):
    return report(qual.global_null_rates(qual.null_counts(market_li(spark, sf_dir), _AUDITED), top=20))


@register(
    "availability",
    q.query(*_FULL_B, """el AS (SELECT root, count(*) AS n, count(*) FILTER (WHERE future_return_5d IS NOT NULL
  AND rolling_vwap_240d IS NOT NULL) AS e FROM b GROUP BY root)""",
            select=f"SELECT root, {q.rd('1 - s / c')} AS feature_availability, n AS rows, {q.rd('e / n')} AS eligible_share "
            "FROM (SELECT root, sum(nulls) AS s, sum(rows) AS c FROM nul GROUP BY root) JOIN el USING (root)"),
)
def availability(spark, sf_dir):
    rows = materialise(market_li(spark, sf_dir))
    return report(
        qual.availability(qual.null_counts(rows, _AUDITED), qual.feature_audit(rows, DAY, "future_return_5d"))
    )


SOURCES = ("open", "high", "low", "close", "volume", "ts")


def _stated_sources(column: str) -> tuple[str, ...]:
    """What the SQL twin says that a column is made from, by its formula."""
    own = {
        "return_open_to_close": ("open", "close"), "range_pct": ("high", "low", "close"),
        "upper_wick_pct": ("open", "high", "close"), "lower_wick_pct": ("open", "low", "close"),
        "close_location_in_bar": ("high", "low", "close"), "atr_14_normalized": ("high", "low", "close"),
    }
    if column in own:
        return own[column]
    if "vwap" in column:
        return ("high", "low", "close", "volume")
    if "volume" in column:
        return ("volume",)
    return ("ts",) if column.startswith(("chicago", "hour", "day_of")) else ("close",)


_STATED = 'src("column", source_column) AS (VALUES ' + ", ".join(
    f"('{c}', '{x}')" for c in _AUDITED for x in _stated_sources(c)
) + ")"


def derived_market(spark, sf_dir):
    """The market table with its whole plan from the segmented bars on, for its lineage."""
    own = features_li(spark, sf_dir)
    return cross.add_cross_market(own, cross.anchor_table(own, DAY, LI_ANCHORS))


@register(
    "feature_sources",
    q.query(
        q.BARS_LI, _STATED,
        select="SELECT \"column\", string_agg(source_column, ',' ORDER BY source_column) AS sources, "
        "(SELECT count(*) FROM bars) AS bars FROM src GROUP BY \"column\"",
    ),
)
def feature_sources(spark, sf_dir):
    """The data contract: every audited column with the bar columns that its plan takes values from."""
    market = derived_market(spark, sf_dir)
    pairs = lineage_table(market, _AUDITED, SOURCES)
    rows = market.agg(F.count(F.lit(1)).alias("bars"))
    listed = pairs.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("source_column")), ",").alias("sources"))
    return report(listed.withColumn("bars", F.lit(rows.first()["bars"])))


@register(
    "source_column_lineage",
    q.query(
        *_FULL_B, _STATED,
        select="SELECT source_column, count(DISTINCT \"column\") AS derived_columns, CAST(sum(nulls) AS BIGINT) AS nulls, "
        "CAST(sum(rows) AS BIGINT) AS rows FROM nul JOIN src USING (\"column\") GROUP BY source_column",
    ),
)
def source_column_lineage(spark, sf_dir):
    """The lineage joined with the audit: nulls of everything derived from a source column."""
    pairs = lineage_table(derived_market(spark, sf_dir), _AUDITED, SOURCES)
    counts = qual.null_counts(market_li(spark, sf_dir), _AUDITED)
    return report(
        counts.join(F.broadcast(pairs), "column")
        .groupBy("source_column")
        .agg(F.count_distinct("column").alias("derived_columns"), F.sum("nulls").alias("nulls"), F.sum("rows").alias("rows"))
    )


# --- raw-bar quality ----------------------------------------------------------------------------


@register(
    "bar_quality",
    """WITH r AS (SELECT event_type AS root, date_trunc('minute', ts) AS ts, user_id % 2 AS i, event_id,
  value AS o, round(value * 1.01, 2) AS h, round(value * 0.99 - 0.02, 2) AS l, round(value * 0.995, 2) AS c, value - 0.05 AS v FROM events),
n AS (SELECT *, lag(ts) OVER w AS pt, lag(i) OVER w AS pi FROM r WINDOW w AS (PARTITION BY root ORDER BY event_id))
SELECT root, count(*) AS record_count, min(ts) AS min_timestamp, max(ts) AS max_timestamp,
  count(*) FILTER (WHERE h < o OR h < c OR h < l OR l > o OR l > c) AS invalid_ohlc_rows,
  count(*) FILTER (WHERE v < 0) AS negative_volume_rows,
  count(*) FILTER (WHERE ts = pt AND i = pi) AS duplicate_records,
  count(*) FILTER (WHERE epoch_us(ts) - epoch_us(pt) > 4 * 86400000000) AS suspicious_gaps,
  count(*) FILTER (WHERE i <> pi) AS roll_transitions FROM n GROUP BY root""",
)
def bar_quality(spark, sf_dir):
    value = F.col("value")
    records = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("root"),
        F.date_trunc("minute", "ts").alias("ts"),
        (F.col("user_id") % 2).alias("instrument_id"),
        F.col("event_id").alias("record_no"),
        value.alias("open"),
        F.round(value * 1.01, 2).alias("high"),
        F.round(value * 0.99 - 0.02, 2).alias("low"),
        F.round(value * 0.995, 2).alias("close"),
        (value - 0.05).alias("volume"),
    )
    return report(qual.bar_quality(records, tile=4_096))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STATUSES = ("F", "O", "P", "X")


@register(
    "partition_quality",
    f"""WITH e AS (SELECT r AS root, s AS schema FROM (VALUES {', '.join(f"('{p}')" for p in PRIORITIES)}) a(r),
  (VALUES {', '.join(f"('{s}')" for s in STATUSES)}) b(s)),
p AS (SELECT o_orderpriority AS root, o_orderstatus AS schema, count(*) AS n, min(o_orderdate) AS a, max(o_orderdate) AS b,
  count(*) FILTER (WHERE o_totalprice <= 0) AS bad FROM orders GROUP BY 1, 2),
j AS (SELECT root, schema, n, a, b, coalesce(bad, 0) AS bad, n IS NOT NULL AS good FROM e LEFT JOIN p USING (root, schema))
SELECT CASE WHEN grouping(root) = 1 THEN 'ALL' ELSE root END AS scope, count(*) FILTER (WHERE good) AS validated_partitions,
  count(*) AS partitions, CAST(coalesce(sum(n), 0) AS BIGINT) AS record_count,
  min(CASE WHEN schema = 'F' THEN a END) AS min_timestamp, max(CASE WHEN schema = 'F' THEN b END) AS max_timestamp,
  CAST(sum(bad) AS BIGINT) AS invalid_ohlc_rows, CAST(0 AS BIGINT) AS negative_volume_rows, CAST(0 AS BIGINT) AS duplicate_records,
  bool_and(CASE WHEN schema <> 'F' THEN coalesce(n, 0) > 0 END) AS metadata_complete,
  CASE WHEN bool_and(good AND bad = 0) THEN 'PASS' ELSE 'FAIL' END AS status FROM j GROUP BY ROLLUP (root)""",
)
def partition_quality(spark, sf_dir):
    """Order priority as root, order status as record schema; status X has no orders at all."""
    evidence = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("root"), F.col("o_orderstatus").alias("schema"))
        .agg(
            F.lit("validated").alias("status"),
            F.count(F.lit(1)).alias("record_count"),
            F.min("o_orderdate").alias("min_timestamp"),
            F.max("o_orderdate").alias("max_timestamp"),
            F.count_if(F.col("o_totalprice") <= 0).alias("invalid_ohlc_rows"),
            F.lit(0).cast("bigint").alias("negative_volume_rows"),
            F.lit(0).cast("bigint").alias("duplicate_records"),
        )
    )
    return report(qual.partition_quality(evidence, PRIORITIES, STATUSES, "F"))


@register(
    "roll_reconciliation",
    q.query(
        q.BARS_SU, q.SEGMENTS,
        "obs AS (SELECT root, count(*) FILTER (WHERE roll_event) AS n FROM seg GROUP BY root)",
        "decl AS (SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS root, count(DISTINCT (EXTRACT(year FROM l_shipdate) - 1993) // 2) - 1 AS n FROM lineitem GROUP BY 1)",
        select="SELECT count(*) AS roots, CAST(sum(n) AS BIGINT) AS observed_rolls, "
        "(SELECT CAST(count(*) AS BIGINT) FROM decl d FULL JOIN obs o USING (root) WHERE d.n IS DISTINCT FROM o.n) AS mismatching_roots FROM obs",
    ),
)
def roll_reconciliation(spark, sf_dir):
    """Observed rolls per root against an independent count of contract periods."""
    from barlab.catalog.bars import seg_su

    observed = seg_su(spark, sf_dir).groupBy("root").agg(F.count_if("roll_event").alias("rolls"))
    period = F.floor((F.year("l_shipdate") - 1995) / 2)
    declared = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("root"))
        .agg((F.count_distinct(period) - 1).alias("rolls"))
    )
    bad = stab.count_mismatches(declared, observed, ["root"], ["rolls"]).select("root", F.lit(1).alias("bad"))
    return report(
        observed.join(bad, "root", "left").agg(
            F.count(F.lit(1)).alias("roots"),
            F.sum("rolls").alias("observed_rolls"),
            F.count("bad").alias("mismatching_roots"),
        )
    )


# --- profiles ------------------------------------------------------------------------------------

_PROFILED = feat.own_feature_names(DAY)
FEAT_ALL = (q.BARS_LI, q.SEGMENTS, q.feature_ctes(q.DAYS))


def profile_sql(source: str, name: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM {source}" for c in _PROFILED)
    return f"""{name}_l AS MATERIALIZED ({parts}),
{name}_r AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS rn,
  count(*) OVER (PARTITION BY feature) AS n FROM {name}_l WHERE v IS NOT NULL),
{name}_q AS (SELECT feature, max(CASE WHEN rn = round((n - 1) * 0.25::DOUBLE) THEN v END) AS q1, median(v) AS median,
  max(CASE WHEN rn = round((n - 1) * 0.75::DOUBLE) THEN v END) AS q3 FROM {name}_r GROUP BY feature),
{name} AS (SELECT feature, count(*) AS observations, count(v) AS finite_observations, 1 - count(v) / count(*) AS missing_rate,
  any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3, any_value(q3 - q1) AS iqr
  FROM {name}_l LEFT JOIN {name}_q USING (feature) GROUP BY feature)"""


@register(
    "distribution_profile",
    q.query(*FEAT_ALL, profile_sql("feat", "pf"),
            select=f"SELECT feature, observations, finite_observations, {cols(['missing_rate', 'q1', 'median', 'q3', 'iqr'])} FROM pf"),
)
def distribution_profile(spark, sf_dir):
    return report(prof.distribution_profile(features_li(spark, sf_dir), _PROFILED))


_DRIFT = ["historical_median", "historical_iqr", "historical_missing_rate", "prospective_median", "prospective_iqr",
          "prospective_missing_rate", "median_shift_in_historical_iqr"]


@register(
    "drift_profile",
    q.query(
        *FEAT_ALL,
        f"past AS (SELECT * FROM feat WHERE ts < TIMESTAMP '{CUTOFF}' AND {TARGET} IS NOT NULL AND rolling_vwap_240d IS NOT NULL)",
        f"recent AS (SELECT * FROM feat WHERE ts > TIMESTAMP '{CUTOFF}' AND rolling_vwap_240d IS NOT NULL)",
        profile_sql("past", "ph"), profile_sql("recent", "pr"),
        """dr AS (SELECT feature, ph.median AS historical_median, ph.iqr AS historical_iqr, ph.missing_rate AS historical_missing_rate,
  pr.median AS prospective_median, pr.iqr AS prospective_iqr, pr.missing_rate AS prospective_missing_rate,
  CASE WHEN ph.iqr > 0 THEN (pr.median - ph.median) / ph.iqr END AS median_shift_in_historical_iqr
  FROM ph LEFT JOIN pr USING (feature))""",
        select=f"SELECT feature, {cols(_DRIFT)} FROM dr",
    ),
)
def drift_profile(spark, sf_dir):
    rows = materialise(features_li(spark, sf_dir))
    cutoff = F.lit(CUTOFF.isoformat(sep=" ")).cast("timestamp_ntz").cast("timestamp")
    past = rows.where(qual.before_cutoff(DAY, TARGET, cutoff))
    recent = rows.where(qual.after_cutoff(cutoff) & qual.warmed_up(DAY))
    return report(
        prof.drift_profile(prof.distribution_profile(past, _PROFILED), prof.distribution_profile(recent, _PROFILED))
        .select("feature", *_DRIFT)
    )


@register(
    "sampled_ranges",
    q.query(
        *FEAT_ALL,
        "smp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY ts) - 1 AS rn0 FROM feat) WHERE rn0 % 200 = 0)",
        "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM smp" for c in _PROFILED) + ")",
        """r AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS rn,
  count(*) OVER (PARTITION BY feature) AS n FROM l WHERE v IS NOT NULL),
s AS (SELECT feature, count(*) AS finite_rows, min(v) AS minimum, max(CASE WHEN rn = round((n - 1) * 0.01::DOUBLE) THEN v END) AS p01,
  median(v) AS median, max(CASE WHEN rn = round((n - 1) * 0.99::DOUBLE) THEN v END) AS p99, max(v) AS maximum FROM r GROUP BY feature)""",
        select=f"SELECT feature, finite_rows, {cols(['minimum', 'p01', 'median', 'p99', 'maximum'])} FROM s",
    ),
)
def sampled_ranges(spark, sf_dir):
    rows = features_li(spark, sf_dir)
    return report(
        prof.sampled_ranges(rows, _PROFILED, 200, DAY, LI_TILE).select(
            "feature", "finite_rows", "minimum", "p01", "median", "p99", "maximum"
        )
    )


_TRIM = f"""b AS (SELECT quantile_cont({TARGET}, 0.005) AS lo, quantile_cont({TARGET}, 0.995) AS hi FROM elig)"""


@register(
    "target_histogram",
    q.query(
        *FEAT_LI, ELIGIBLE_LI, _TRIM,
        f"kept AS (SELECT {TARGET} AS v FROM elig, b WHERE {TARGET} BETWEEN lo AND hi)",
        "e AS (SELECT min(v) AS mn, max(v) AS mx FROM kept)",
        "c AS (SELECT least(CAST(floor((v - mn) / ((mx - mn) / 100)) AS BIGINT), 99) AS bin, count(*) AS n FROM kept, e GROUP BY 1)",
        select=f"SELECT r.i AS bin, {q.rd('mn + r.i * ((mx - mn) / 100)')} AS lower, "
        f"{q.rd('mn + (r.i + 1) * ((mx - mn) / 100)')} AS upper, coalesce(n, 0) AS rows FROM range(100) r(i), e LEFT JOIN c ON c.bin = r.i",
    ),
)
def target_histogram(spark, sf_dir):
    rows = features_li(spark, sf_dir).where(qual.eligible(DAY, TARGET))
    return report(prof.trimmed_histogram(rows, TARGET))


@register(
    "clipped_scatter",
    q.query(
        *FEAT_LI, ELIGIBLE_LI,
        f"pt AS (SELECT root, ts, {TARGET} AS a, {LAST} AS p FROM elig WHERE {LAST} IS NOT NULL)",
        "lim AS (SELECT quantile_cont(a, 0.005) AS alo, quantile_cont(a, 0.995) AS ahi, quantile_cont(p, 0.005) AS plo, quantile_cont(p, 0.995) AS phi FROM pt)",
        "num AS (SELECT *, row_number() OVER (ORDER BY root, ts) - 1 AS rn, count(*) OVER () AS n FROM pt)",
        "pk AS (SELECT DISTINCT CASE WHEN n <= 300 THEN i ELSE (i * (n - 1)) // 299 END AS rn FROM (SELECT DISTINCT n FROM num) g, range(300) r(i) WHERE i < n)",
        select=f"SELECT root, ts, rn AS position, {q.rd('least(greatest(a, alo), ahi)')} AS {TARGET}, "
        f"{q.rd('least(greatest(p, plo), phi)')} AS {LAST} FROM num JOIN pk USING (rn), lim",
    ),
)
def clipped_scatter(spark, sf_dir):
    rows = features_li(spark, sf_dir).where(qual.eligible(DAY, TARGET))
    return report(prof.clipped_scatter(rows, TARGET, LAST, 300, DAY, tile_units=LI_TILE))


@register(
    "nearest_quantiles",
    q.query(
        """v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rn,
  count(*) OVER (PARTITION BY event_type) AS n FROM events)""",
        select="SELECT event_type, any_value(n) AS finite_rows, "
        + ", ".join(f"max(CASE WHEN rn = round((n - 1) * {p}::DOUBLE) THEN value END) AS near_{i}"
                    for i, p in ((10, 0.1), (50, 0.5), (99, 0.99)))
        + f", {q.rd('quantile_cont(value, 0.25)')} AS cont_25, {q.rd('median(value)')} AS cont_50 FROM v GROUP BY event_type",
    ),
)
def nearest_quantiles(spark, sf_dir):
    from barlab.operators.ranks import quantiles

    return report(
        quantiles(
            table(spark, sf_dir, "events"), ["event_type"], "value",
            nearest={"near_10": 0.1, "near_50": 0.5, "near_99": 0.99},
            linear={"cont_25": 0.25, "cont_50": 0.5},
        )
    )


@register(
    "direction_counts",
    q.query(
        q.BARS_EV, q.SEGMENTS, q.labels(q.MINUTES, source="seg"),
        select="SELECT root, direction_5m, count(*) AS rows FROM lab GROUP BY root, direction_5m",
    ),
)
def direction_counts(spark, sf_dir):
    return report(
        lab.add_future_labels(seg_ev(spark, sf_dir), MINUTE).groupBy("root", "direction_5m").agg(
            F.count(F.lit(1)).alias("rows")
        )
    )

