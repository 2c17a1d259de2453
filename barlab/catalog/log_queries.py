"""Stored datasets, manifests, the event log and prospective confirmation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from barlab.catalog import sql as q
from barlab.catalog.bars import LI_ROOTS, LI_TILE, bars_su, seg_li, seg_su, table
from barlab.catalog.market_queries import CUTOFF
from barlab.catalog.metric_queries import FEAT_LI, LAST, TARGET, VOL, features_li
from barlab.catalog.registry import register, report
from barlab.functions.clock import DAY
from barlab.operators import features as feat
from barlab.operators import prospective as pro
from barlab.operators import segments as seg
from barlab.operators.profile import distribution_profile, tertiles
from barlab.operators.quality import before_cutoff
from barlab.session import materialise, scratch_path
from barlab.sources import dataset, eventlog, manifest, records
from barlab.streaming.log_stream import follow_features

NOW = datetime(2002, 1, 1)


def moment(at: datetime):
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz").cast("timestamp")


@register(
    "canonical_bars",
    "SELECT l_returnflag AS root, l_shipdate AS ts, l_suppkey AS instrument_id, count(*) AS rows, "
    f"{q.rd('sum(floor(l_extendedprice * 100) / 100)', 4)} AS open_sum, {q.rd('max(floor(l_extendedprice * 100) / 100)', 4)} AS high_max, "
    "CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem GROUP BY 1, 2, 3",
)
def canonical_bars(spark, sf_dir):
    """Fixed-point records (ns times, integer prices) decoded to bars, then summed."""
    li = table(spark, sf_dir, "lineitem")
    scaled = F.floor(F.col("l_extendedprice") * 100).cast("bigint")
    raw = li.select(
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("ts_event"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_suppkey").alias("instrument_id"),
        *[scaled.alias(c) for c in ("open", "high", "low", "close")],
        F.col("l_quantity").alias("volume"),
    )
    bars = records.canonical_bars(raw, F.col("flag"), price_scale=100)
    return report(
        bars.groupBy("root", "ts", "instrument_id").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("open").alias("open_sum"),
            F.max("high").alias("high_max"), F.sum("volume").alias("volume"),
        ),
        4,
    )


@register(
    "dataset_root_scan",
    q.query(
        q.BARS_LI, q.SEGMENTS,
        select=f"SELECT root, ts, instrument_id, contract_segment_id, {q.rd('close')} AS close, EXTRACT(year FROM ts) AS year "
        "FROM seg WHERE root = 'N' AND EXTRACT(year FROM ts) BETWEEN 1998 AND 1999",
    ),
)
def dataset_root_scan(spark, sf_dir):
    """Write bars as root/year partitions, then scan one root and two years back."""
    path = scratch_path(spark, "bars")
    dataset.write_dataset(seg_li(spark, sf_dir), path)
    rows = dataset.read_dataset(spark, path, ["N"], (1998, 1999))
    return report(rows.select("root", "ts", "instrument_id", "contract_segment_id", "close", "year"))


@register(
    "dataset_resume",
    q.query(
        q.BARS_SU,
        select="SELECT root, count(*) AS expected_rows, CASE WHEN min(ts) < TIMESTAMP '1995-01-05' THEN count(*) - "
        "count(*) FILTER (WHERE ts < TIMESTAMP '1995-01-05') ELSE count(*) END AS stored_rows, "
        "count(*) FILTER (WHERE ts < TIMESTAMP '1995-01-05') > 0 AS rebuild FROM bars GROUP BY root",
    ),
)
def dataset_resume(spark, sf_dir):
    """Roots whose stored partitions lost the first days are found for rebuilding."""
    bars = bars_su(spark, sf_dir)
    path = scratch_path(spark, "resume")
    first_days = F.col("ts") < moment(datetime(1995, 1, 5))
    (bars.where(~first_days).withColumn("part", F.pmod(F.xxhash64("root"), F.lit(8)))
     .write.partitionBy("part").parquet(path))
    expected = bars.groupBy("root").agg(F.count(F.lit(1)).alias("expected_rows"))
    stored = dataset.stored_counts(spark, path)
    todo = dataset.roots_to_rebuild(expected, stored).select("root", F.lit(True).alias("rebuild"))
    return report(
        expected.join(stored, "root", "left").join(todo, "root", "left").select(
            "root", "expected_rows", "stored_rows", F.coalesce("rebuild", F.lit(False)).alias("rebuild")
        )
    )


@register(
    "dataset_rebuild",
    q.query(
        q.BARS_LI, q.SEGMENTS,
        select="SELECT root, count(*) AS expected_rows, count(*) AS stored_rows, root = 'N' AS rebuilt, "
        "count(*) FILTER (WHERE roll_event) AS rolls FROM seg GROUP BY root",
    ),
)
def dataset_rebuild(spark, sf_dir):
    """A committed dataset whose root N lost its first year gets that root back; readers see all rows again."""
    rows = materialise(seg_li(spark, sf_dir))
    path = scratch_path(spark, "rebuilt")
    expected = materialise(
        rows.groupBy("root").agg(
            F.count(F.lit(1)).alias("expected_rows"), F.count_if("roll_event").alias("expected_rolls")
        )
    )
    dataset.commit_roots(spark, path, rows.where((F.col("root") != "N") | (F.year("ts") > 1995)))
    done = dataset.rebuild_roots(spark, path, rows, expected)
    rolls = dataset.read_committed(spark, path).groupBy("root").agg(F.count_if("roll_event").alias("rolls"))
    return report(done.join(rolls, "root"))


@register(
    "stored_rollovers",
    q.query(
        q.BARS_LI, q.SEGMENTS,
        select="SELECT root, contract_segment_id, min(instrument_id) AS instrument_id, min(ts) AS segment_start, "
        "max(ts) AS segment_end, count(*) AS rows, contract_segment_id > 1 AS roll_event FROM seg GROUP BY 1, 2",
    ),
)
def stored_rollovers(spark, sf_dir):
    from barlab.catalog.bars import bars_li

    path = scratch_path(spark, "rollovers")
    dataset.write_rollovers(seg.rollover_table(bars_li(spark, sf_dir), DAY, LI_TILE), path)
    return report(
        spark.read.parquet(path).select(
            "root", "contract_segment_id", "instrument_id", "segment_start", "segment_end", "rows", "roll_event"
        )
    )


@register(
    "manifest_entries",
    "SELECT o_orderpriority AS root, o_orderstatus AS schema, count(*) AS record_count, "
    f"{q.rd('sum(o_totalprice)', 2)} AS file_size FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2",
)
def manifest_entries(spark, sf_dir):
    """A JSON manifest per root written from the orders, read back and filtered by schema."""
    path = scratch_path(spark, "manifest")
    entries = table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("root"), F.col("o_orderstatus").alias("schema")
    ).agg(F.count(F.lit(1)).alias("record_count"), F.sum("o_totalprice").alias("file_size"))
    manifest.write_manifest(entries, path)
    found = manifest.manifest_entries(spark, path, "F", one_document=False)
    return report(found.select("root", "schema", "record_count", "file_size"), 2)


# --- event log -----------------------------------------------------------------------------------

RECENT = f"""rec AS (SELECT * FROM feat WHERE ts > TIMESTAMP '{CUTOFF}' AND rolling_vwap_240d IS NOT NULL AND {LAST} IS NOT NULL),
ev AS (SELECT root, ts, instrument_id, contract_segment_id, m AS model, root || '-' || m AS model_id,
  CASE WHEN m = 'persistence' THEN {LAST} ELSE -{LAST} END AS p, {TARGET} AS a, realized_vol_15d
  FROM rec, (VALUES ('persistence'), ('reversal')) v(m))"""


def log_schema(spark):
    columns = ", ".join(
        ["ts timestamp", "root string", "instrument_id bigint", "contract_segment_id bigint", "model_id string",
         "event_type string", "prediction double", f"{TARGET} double", "data_version string",
         "recorded_at_utc timestamp"]
    )
    return spark.createDataFrame([], columns).schema


def frozen_predictions(inputs):
    """Two frozen naive models per root as prediction events (labels are not among the inputs)."""
    r = F.col(LAST)
    models = F.array(
        F.struct(F.lit("persistence").alias("m"), r.alias("prediction")),
        F.struct(F.lit("reversal").alias("m"), (-r).alias("prediction")),
    )
    scored = inputs.where(r.isNotNull()).withColumn("_m", F.explode(models)).select("*", "_m.*")
    return pro.prediction_events(
        scored, F.concat_ws("-", "root", "m"), TARGET, "v1", moment(NOW)
    )


def run_log(spark, sf_dir, repeats=1, columns=(LAST, VOL)):
    """Predictions, then outcomes, appended ``repeats`` times; returns (features, log path, schema)."""
    wanted = dict.fromkeys([LAST, VOL, *columns, TARGET, "rolling_vwap_240d"])
    features = materialise(
        features_li(spark, sf_dir).select("ts", "root", "instrument_id", "contract_segment_id", *wanted)
    )
    cutoff, path, schema = moment(CUTOFF), scratch_path(spark, "log"), log_schema(spark)
    inputs = pro.prospective_inputs(features, DAY, cutoff, [LAST, VOL])
    outcomes = pro.prospective_outcomes(features, DAY, cutoff, TARGET)
    for _ in range(repeats):
        eventlog.append_unique_events(frozen_predictions(inputs), path)
        events = eventlog.read_event_log(spark, path, schema).where(F.col("event_type") == pro.PREDICTION)
        eventlog.append_unique_events(pro.attach_outcomes(events, outcomes, TARGET, moment(NOW)), path)
    return features, path, schema


@register(
    "event_log",
    q.query(
        *FEAT_LI, RECENT,
        select=f"""SELECT root, ts, instrument_id, contract_segment_id, model_id, 'prediction' AS event_type,
  {q.rd('p')} AS prediction, CAST(NULL AS DOUBLE) AS {TARGET} FROM ev UNION ALL
SELECT root, ts, instrument_id, contract_segment_id, model_id, 'outcome', {q.rd('p')}, {q.rd('a')} FROM ev WHERE a IS NOT NULL""",
    ),
)
def event_log(spark, sf_dir):
    """The whole log after running the two append steps twice (the second run adds nothing)."""
    _, path, schema = run_log(spark, sf_dir, repeats=2)
    log = eventlog.sorted_event_log(spark, path, schema)
    return report(log.drop("data_version", "recorded_at_utc"))


@register(
    "event_log_summary",
    q.query(
        *FEAT_LI, RECENT,
        """both2 AS (SELECT model_id, 'prediction' AS event_type, ts, root FROM ev UNION ALL
  SELECT model_id, 'outcome', ts, root FROM ev WHERE a IS NOT NULL)""",
        select="SELECT model_id, event_type, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts, "
        "count(DISTINCT root) AS roots FROM both2 GROUP BY model_id, event_type",
    ),
)
def event_log_summary(spark, sf_dir):
    _, path, schema = run_log(spark, sf_dir)
    return report(eventlog.log_summary(eventlog.read_event_log(spark, path, schema)))


@register(
    "incremental_log",
    q.query(
        *FEAT_LI, RECENT,
        """both2 AS (SELECT root, model_id, 'prediction' AS event_type, p, a FROM ev UNION ALL
  SELECT root, model_id, 'outcome', p, a FROM ev WHERE a IS NOT NULL)""",
        select=f"SELECT model_id, event_type, count(*) AS events, {q.rd('sum(p)')} AS prediction_sum FROM both2 GROUP BY 1, 2",
    ),
)
def incremental_log(spark, sf_dir):
    """The same log fed by a stream over stored feature files."""
    features = features_li(spark, sf_dir).select(
        "ts", "root", "instrument_id", "contract_segment_id", LAST, VOL, TARGET, "rolling_vwap_240d"
    )
    source, path = scratch_path(spark, "features"), scratch_path(spark, "log")
    features.repartition(4, "root", "ts").write.parquet(source)
    cutoff = moment(CUTOFF)

    fields = log_schema(spark)

    def to_events(batch, logged):
        yield frozen_predictions(pro.prospective_inputs(batch, DAY, cutoff, [LAST, VOL]))
        outcomes = materialise(pro.prospective_outcomes(batch, DAY, cutoff, TARGET))
        yield pro.attach_outcomes(logged(outcomes, fields), outcomes, TARGET, moment(NOW))

    follow_features(
        spark, source, features.schema, path, scratch_path(spark, "progress"), to_events, max_files=2
    )
    log = eventlog.read_event_log(spark, path, log_schema(spark))
    return report(
        log.groupBy("model_id", "event_type").agg(
            F.count(F.lit(1)).alias("events"), F.sum("prediction").alias("prediction_sum")
        )
    )


DAYS_AFTER = (7, 30, 90, 365, 1000)


@register(
    "checkpoint_windows",
    q.query(
        *FEAT_LI,
        f"""lastts AS (SELECT root, max(ts) AS m FROM feat WHERE ts > TIMESTAMP '{CUTOFF}' AND rolling_vwap_240d IS NOT NULL GROUP BY root),
slow AS (SELECT CASE WHEN count(*) = {len(LI_ROOTS)} THEN min(m) END AS m FROM lastts)""",
        select="SELECT CAST(d AS BIGINT) AS days, "
        f"TIMESTAMP '{CUTOFF}' AS start_exclusive, TIMESTAMP '{CUTOFF}' + d * INTERVAL 1 DAY AS end_exclusive, "
        f"coalesce(m >= TIMESTAMP '{CUTOFF}' + d * INTERVAL 1 DAY, false) AS closed "
        f"FROM (VALUES {', '.join(f'({d})' for d in DAYS_AFTER)}) v(d), slow",
    ),
)
def checkpoint_windows(spark, sf_dir):
    inputs = pro.prospective_inputs(features_li(spark, sf_dir), DAY, moment(CUTOFF), [])
    return report(pro.checkpoint_windows(inputs, CUTOFF, DAYS_AFTER, LI_ROOTS))


@register(
    "prospective_status",
    q.query(
        *FEAT_LI,
        f"""inp AS (SELECT root, ts FROM feat WHERE ts > TIMESTAMP '{CUTOFF}' AND rolling_vwap_240d IS NOT NULL),
mx AS (SELECT CASE WHEN count(*) = {len(LI_ROOTS)} THEN min(m) END AS m FROM (SELECT root, max(ts) AS m FROM inp GROUP BY root)),
cl AS (SELECT count(*) FILTER (WHERE m >= TIMESTAMP '{CUTOFF}' + d * INTERVAL 1 DAY) AS closed,
  coalesce(bool_or(d = 365 AND m >= TIMESTAMP '{CUTOFF}' + d * INTERVAL 1 DAY), false) AS ready
  FROM mx, (VALUES {', '.join(f'({d})' for d in DAYS_AFTER)}) v(d))""",
        select="""SELECT (SELECT count(*) FROM inp) AS available_rows, closed AS closed_windows,
  CASE WHEN ready THEN 'primary_checkpoint_ready_for_review' WHEN (SELECT count(*) FROM inp) = 0 THEN 'awaiting_prospective_data'
  ELSE 'collecting_prospective_data' END AS status FROM cl""",
    ),
)
def prospective_status(spark, sf_dir):
    inputs = materialise(pro.prospective_inputs(features_li(spark, sf_dir), DAY, moment(CUTOFF), []))
    windows = pro.checkpoint_windows(inputs, CUTOFF, DAYS_AFTER, LI_ROOTS)
    return report(pro.run_status(windows, inputs, 365))


@register(
    "window_events",
    q.query(
        *FEAT_LI, RECENT,
        f"w AS (SELECT d, TIMESTAMP '{CUTOFF}' + d * INTERVAL 1 DAY AS e FROM (VALUES (7), (30), (90), (365)) v(d))",
        f"""lastts AS (SELECT min(m) AS m FROM (SELECT root, max(ts) AS m FROM feat
  WHERE ts > TIMESTAMP '{CUTOFF}' AND rolling_vwap_240d IS NOT NULL GROUP BY root))""",
        select=f"SELECT CAST(d AS BIGINT) AS days, model_id, count(*) AS outcomes, {q.rd('avg(a)')} AS mean_actual "
        "FROM ev, w, lastts WHERE a IS NOT NULL AND ts < e AND m >= e GROUP BY d, model_id",
    ),
)
def window_events(spark, sf_dir):
    """Completed outcomes per closed calendar window and model."""
    features, path, schema = run_log(spark, sf_dir)
    inputs = pro.prospective_inputs(features, DAY, moment(CUTOFF), [])
    windows = pro.checkpoint_windows(inputs, CUTOFF, DAYS_AFTER, LI_ROOTS)
    events = pro.events_by_window(eventlog.read_event_log(spark, path, schema), windows)
    return report(
        events.groupBy("days", "model_id").agg(
            F.count(F.lit(1)).alias("outcomes"), F.avg(TARGET).alias("mean_actual")
        )
    )


@register("confirmation_report")
def confirmation_report(spark, sf_dir):
    """Metrics, deciles, regimes and drift of every frozen model, per closed window and over all outcomes so far."""
    own = feat.own_feature_names(DAY)
    features, path, schema = run_log(spark, sf_dir, columns=own)
    cutoff = moment(CUTOFF)
    past = features.where(before_cutoff(DAY, TARGET, cutoff))
    inputs = pro.prospective_inputs(features, DAY, cutoff, own)
    log = eventlog.read_event_log(spark, path, schema)
    return report(
        pro.confirmation_report(
            log.where(F.col("event_type") == pro.OUTCOME), inputs,
            distribution_profile(past, own, ["root"]), tertiles(past, VOL),
            TARGET, VOL, own, DAY, tile_units=LI_TILE,
            windows=pro.checkpoint_windows(inputs, CUTOFF, DAYS_AFTER, LI_ROOTS),
            models=log.select("model_id", "root"),
        )
    )


@register(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_keys(spark, sf_dir):
    """The duplicate-key guard on a table whose two-column key is not unique."""
    return report(pro.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]))


@register(
    "supplier_dataset_counts",
    q.query(q.BARS_SU, select="SELECT root, EXTRACT(year FROM ts) AS year, count(*) AS rows FROM bars GROUP BY 1, 2"),
)
def supplier_dataset_counts(spark, sf_dir):
    """Stored rows per root and year, counted from the segmented bars written by year."""
    path = scratch_path(spark, "by-year")
    (seg_su(spark, sf_dir).withColumn("year", F.year("ts")).hint("rebalance", "year")
     .write.option("compression", "zstd").partitionBy("year").parquet(path))
    return report(spark.read.parquet(path).groupBy("root", "year").agg(F.count(F.lit(1)).alias("rows")))
