"""Request plans over suppliers: expansion, totals, gates, scenarios and add-on subsets."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from barlab.catalog import sql as q
from barlab.catalog.bars import table
from barlab.catalog.registry import register, report
from barlab.plans import requests as plan
from barlab.session import scratch_path
from barlab.sources import manifest

SCHEMAS = [
    plan.SchemaRequest("ohlcv-1s", "OHLCV-1s", 5),
    plan.SchemaRequest("definition", "Definitions", 5, parent=True),
    plan.SchemaRequest("statistics", "Statistics", 5),
    plan.SchemaRequest("status", "Status", 5),
]
CORE = plan.SchemaRequest("mbp-1", "MBP-1", 3)
CORE_NATIONS = ("NATION_7", "NATION_15")
BUDGET = 350_000.0
FREE = 2_000_000_000_000
ADDONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE")
BASE_REGION = "MIDDLE EAST"

# Each supplier is one request: region as category, nation as root, its orders' lines as records.
REQ_SQL = """req AS (SELECT r_name AS category, n_name AS root, s_name AS request_symbol,
  CAST(coalesce(n, 0) AS BIGINT) AS estimated_records, CAST(coalesce(q, 0) * 1000000 AS BIGINT) AS estimated_billable_bytes,
  s_acctbal AS estimated_cost_usd
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)"""
AMOUNT_SQL = (
    "CAST(sum(estimated_records) AS BIGINT) AS estimated_records, "
    "CAST(sum(estimated_billable_bytes) AS BIGINT) AS estimated_billable_bytes, "
    "round(sum(estimated_cost_usd), 4) AS estimated_cost_usd"
)


def requests(spark, sf_dir):
    usage = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")
    )
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, sf_dir, "supplier")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(usage, "s_suppkey", "left")
        .select(
            F.col("r_name").alias("category"),
            F.col("n_name").alias("root"),
            F.col("s_name").alias("request_symbol"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("estimated_records"),
            (F.coalesce("q", F.lit(0.0)) * 1_000_000).cast("bigint").alias("estimated_billable_bytes"),
            F.col("s_acctbal").alias("estimated_cost_usd"),
        )
    )


def with_plan(df):
    return df.withColumn("plan", F.col("category"))


@register(
    "latest_complete_end",
    "SELECT least(min(e), DATE '2001-12-31') AS complete_end FROM (SELECT o_orderstatus, CAST(max(o_orderdate) AS DATE) AS e "
    "FROM orders GROUP BY 1)",
)
def latest_complete_end(spark, sf_dir):
    ends = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("schema")).agg(
        F.max("o_orderdate").alias("end")
    )
    today = F.lit("2001-12-31").cast("date")
    return report(plan.latest_complete_end(ends, ["F", "O", "P"], today))


@register(
    "request_expansion",
    """WITH m AS (SELECT s_name AS root, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
s(schema, category, years, parent) AS (VALUES ('ohlcv-1s', 'OHLCV-1s', 5, false), ('definition', 'Definitions', 5, true),
  ('statistics', 'Statistics', 5, false), ('status', 'Status', 5, false)),
u AS (SELECT category, root, schema, years, parent FROM m, s UNION ALL
  SELECT 'MBP-1', root, 'mbp-1', 3, false FROM m WHERE root IN (SELECT s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
    WHERE n_name IN ('NATION_7', 'NATION_15')))
SELECT category, root, root || CASE WHEN parent THEN '.FUT' ELSE '.v.0' END AS request_symbol, schema,
  CASE WHEN parent THEN 'parent' ELSE 'continuous' END AS stype_in,
  CAST(DATE '2000-02-29' - to_years(CAST(years AS INTEGER)) AS DATE) AS start, DATE '2000-02-29' AS "end" FROM u""",
)
def request_expansion(spark, sf_dir):
    """Every supplier as a market; the suppliers of two nations are the core markets."""
    markets = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(F.col("s_name").alias("root"), "n_name")
    is_core = F.col("n_name").isin(*CORE_NATIONS)
    return report(plan.expand_requests(markets, SCHEMAS, date(2000, 2, 29), CORE, is_core))


@register(
    "month_requests",
    """SELECT 'MBP-1' AS category, s_name AS root, s_name || '.v.0' AS request_symbol, 'mbp-1' AS schema,
  'continuous' AS stype_in, DATE '2024-02-29' AS start, DATE '2024-05-31' AS "end" FROM supplier""",
)
def month_requests(spark, sf_dir):
    markets = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("root"))
    return report(plan.month_requests(markets, "mbp-1", "MBP-1", 3, date(2024, 5, 31)))


@register(
    "cost_totals",
    q.query(
        REQ_SQL,
        f"""tot AS (SELECT CASE WHEN grouping(category) = 1 THEN 'grand_total' ELSE 'schema_total' END AS row_type,
  CASE WHEN grouping(category) = 1 THEN 'GRAND TOTAL' ELSE category END AS category, {AMOUNT_SQL} FROM req GROUP BY ROLLUP (category))""",
        select="""SELECT 'detail' AS row_type, category, root, request_symbol, estimated_records, estimated_billable_bytes,
  round(estimated_cost_usd, 4) AS estimated_cost_usd FROM req UNION ALL
SELECT row_type, category, NULL, NULL, estimated_records, estimated_billable_bytes, estimated_cost_usd FROM tot""",
    ),
)
def cost_totals(spark, sf_dir):
    """Detail, subtotal and grand-total rows, through a CSV report and back."""
    rows = plan.cost_totals(requests(spark, sf_dir))
    path = scratch_path(spark, "costs")
    manifest.write_csv_report(rows, path)
    stored = manifest.read_csv_report(spark, path, ", ".join(f"{n} {t}" for n, t in rows.dtypes))
    return report(stored, 4)


GATES = f"""CAST(floor(estimated_billable_bytes * 3.0) AS BIGINT) AS expected_working_bytes,
  CAST(floor(floor(estimated_billable_bytes * 3.0) * 1.25) AS BIGINT) AS required_free_bytes,
  estimated_cost_usd <= {BUDGET} AS budget_pass,
  {FREE} >= floor(floor(estimated_billable_bytes * 3.0) * 1.25) AS storage_pass"""


@register(
    "plan_gates",
    q.query(
        REQ_SQL, f"t AS (SELECT category AS plan, {AMOUNT_SQL} FROM req GROUP BY category)",
        select=f"SELECT *, budget_pass AND storage_pass AS authorized FROM (SELECT *, {GATES} FROM t)",
    ),
)
def plan_gates(spark, sf_dir):
    totals = plan.plan_totals(with_plan(requests(spark, sf_dir)))
    return report(plan.with_gates(totals, BUDGET, F.lit(FREE).cast("bigint")), 4)


_BASES, _ADDED = ("AFRICA", "AMERICA"), ("ASIA", "EUROPE", "MIDDLE EAST")


@register(
    "scenario_grid",
    q.query(
        REQ_SQL, f"t AS (SELECT category AS plan, {AMOUNT_SQL} FROM req GROUP BY category)",
        select="""SELECT b.plan || '+' || a.plan AS scenario, b.estimated_records + a.estimated_records AS estimated_records,
  b.estimated_billable_bytes + a.estimated_billable_bytes AS estimated_billable_bytes,
  round(b.estimated_cost_usd + a.estimated_cost_usd, 4) AS estimated_cost_usd
FROM t b, t a WHERE b.plan IN ('AFRICA', 'AMERICA') AND a.plan IN ('ASIA', 'EUROPE', 'MIDDLE EAST')""",
    ),
)
def scenario_grid(spark, sf_dir):
    return report(plan.scenario_grid(with_plan(requests(spark, sf_dir)), _BASES, _ADDED), 4)


_MASKS = f"""names(i, a) AS (VALUES {', '.join(f"({i}, '{a}')" for i, a in enumerate(ADDONS))}),
t AS (SELECT category, sum(estimated_records) AS r, sum(estimated_billable_bytes) AS b, sum(estimated_cost_usd) AS c FROM req GROUP BY 1),
bs AS (SELECT r, b, c FROM t WHERE category = '{BASE_REGION}'),
ms AS (SELECT m, count(*) AS addons, string_agg(a, '+' ORDER BY i) AS addon_roots, sum(c) AS ac, sum(r) AS ar, sum(b) AS ab
  FROM range(1, {1 << len(ADDONS)}) x(m) JOIN names ON (m >> i) & 1 = 1 JOIN t ON category = a GROUP BY m),
sub0 AS (SELECT addons, addon_roots, round(ac, 4) AS addon_cost_usd, CAST(ar + r AS BIGINT) AS estimated_records,
  CAST(ab + b AS BIGINT) AS estimated_billable_bytes, ac + c AS cost FROM ms, bs),
sub AS (SELECT *, budget_pass AND storage_pass AS authorized FROM (SELECT addons, addon_roots, addon_cost_usd, estimated_records,
  estimated_billable_bytes, round(cost, 4) AS estimated_cost_usd, round({BUDGET} - cost, 4) AS budget_remaining_usd,
  CAST(floor(estimated_billable_bytes * 3.0) AS BIGINT) AS expected_working_bytes,
  CAST(floor(floor(estimated_billable_bytes * 3.0) * 1.25) AS BIGINT) AS required_free_bytes,
  cost <= {BUDGET} AS budget_pass, {FREE} >= floor(floor(estimated_billable_bytes * 3.0) * 1.25) AS storage_pass FROM sub0))"""


def subsets(spark, sf_dir):
    rows = requests(spark, sf_dir).withColumn(
        "part", F.when(F.col("category") == BASE_REGION, "base").otherwise(F.col("category"))
    )
    return plan.addon_subsets(rows, ADDONS, BUDGET, F.lit(FREE).cast("bigint"))


@register("addon_subsets", q.query(REQ_SQL, _MASKS, select="SELECT * FROM sub"))
def addon_subsets(spark, sf_dir):
    return report(subsets(spark, sf_dir), 4)


@register(
    "largest_fitting_subsets",
    q.query(REQ_SQL, _MASKS, select="SELECT addons, addon_roots, estimated_cost_usd FROM sub WHERE budget_pass AND "
            "addons = (SELECT max(addons) FROM sub WHERE budget_pass)"),
)
def largest_fitting_subsets(spark, sf_dir):
    fitting = plan.largest_fitting(subsets(spark, sf_dir))
    return report(fitting.select("addons", "addon_roots", "estimated_cost_usd"), 4)
