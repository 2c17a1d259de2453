"""Request expansion, cost totals, budget gates, scenario grids and add-on subsets.

Every combination below is an explode of a configured list on already aggregated rows; nothing
is cross-joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.clock import months_before, years_before

# Space multipliers of the storage gate and symbol templates.
WORKING_MULTIPLIER = 3.0
HEADROOM_MULTIPLIER = 1.25
CONTINUOUS_TEMPLATE = "{root}.v.0"
PARENT_TEMPLATE = "{root}.FUT"
MAX_ADDONS = 16

AMOUNTS = ("estimated_records", "estimated_billable_bytes", "estimated_cost_usd")


@dataclass(frozen=True)
class SchemaRequest:
    """One record schema to request: report category, history length, parent symbology."""

    schema: str
    category: str
    years: int
    parent: bool = False


def latest_complete_end(
    availability: DataFrame, required: Sequence[str], today: Column
) -> DataFrame:
    """The last day complete for every required schema; a schema without an end is an error."""
    ends = availability.where(F.col("schema").isin(*required)).agg(
        F.min(F.to_date("end")).alias("earliest"),
        F.count_distinct(F.when(F.col("end").isNotNull(), F.col("schema"))).alias("known"),
    )
    complete = F.when(
        F.col("known") == len(set(required)), F.least(F.col("earliest"), today)
    ).otherwise(F.raise_error(F.lit("a required schema has no availability end")).cast("date"))
    return ends.select(complete.alias("complete_end"))


def expand_requests(
    markets: DataFrame, schemas: Sequence[SchemaRequest], end: date,
    core: SchemaRequest | None = None, is_core: Column | None = None,
) -> DataFrame:
    """One request per market and schema, plus the core schema where ``is_core`` holds."""
    def entry(s: SchemaRequest) -> Column:
        template = PARENT_TEMPLATE if s.parent else CONTINUOUS_TEMPLATE
        return F.struct(
            F.lit(s.category).alias("category"),
            F.replace(F.lit(template), F.lit("{root}"), F.col("root")).alias("request_symbol"),
            F.lit(s.schema).alias("schema"),
            F.lit("parent" if s.parent else "continuous").alias("stype_in"),
            F.lit(s.years).alias("years"),
        )

    listed = [entry(s) for s in schemas]
    if core is not None:
        listed.append(F.when(is_core, entry(core)))
    day = F.lit(end.isoformat()).cast("date")
    return (
        markets.select("root", F.explode(F.array_compact(F.array(*listed))).alias("_r"))
        .select("root", "_r.*")
        .select(
            "category", "root", "request_symbol", "schema", "stype_in",
            years_before(day, F.col("years")).alias("start"), day.alias("end"),
        )
    )


def month_requests(markets: DataFrame, schema: str, category: str, months: int, end: date) -> DataFrame:
    """Requests with a history given in months (day clamped to the month)."""
    return markets.select(
        F.lit(category).alias("category"),
        "root",
        F.replace(F.lit(CONTINUOUS_TEMPLATE), F.lit("{root}"), F.col("root")).alias("request_symbol"),
        F.lit(schema).alias("schema"),
        F.lit("continuous").alias("stype_in"),
        F.lit(months_before(end, months).isoformat()).cast("date").alias("start"),
        F.lit(end.isoformat()).cast("date").alias("end"),
    )


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in AMOUNTS]


def cost_totals(estimates: DataFrame) -> DataFrame:
    """Detail rows, one subtotal per category and the grand total, told apart by ``row_type``."""
    detail = estimates.withColumn("row_type", F.lit("detail"))
    total = (
        estimates.rollup("category")
        .agg(*_sums(), F.grouping("category").alias("_g"))
        .withColumn("row_type", F.when(F.col("_g") == 1, "grand_total").otherwise("schema_total"))
        .withColumn("category", F.when(F.col("_g") == 1, "GRAND TOTAL").otherwise(F.col("category")))
        .drop("_g")
    )
    return detail.unionByName(total, allowMissingColumns=True)


def with_gates(
    totals: DataFrame, budget: float, free_bytes: Column,
    working: float = WORKING_MULTIPLIER, headroom: float = HEADROOM_MULTIPLIER,
) -> DataFrame:
    """Working space, required free space, and whether budget and storage allow the plan."""
    space = F.floor(F.col("estimated_billable_bytes") * F.lit(working)).cast("bigint")
    return (
        totals.withColumn("expected_working_bytes", space)
        .withColumn(
            "required_free_bytes", F.floor(F.col("expected_working_bytes") * F.lit(headroom)).cast("bigint")
        )
        .withColumn("budget_pass", F.col("estimated_cost_usd") <= F.lit(budget))
        .withColumn("storage_pass", free_bytes >= F.col("required_free_bytes"))
        .withColumn("authorized", F.col("budget_pass") & F.col("storage_pass"))
    )


def plan_totals(estimates: DataFrame, keys: Sequence[str] = ("plan",)) -> DataFrame:
    return estimates.groupBy(*keys).agg(*_sums())


def scenario_grid(
    estimates: DataFrame, base_plans: Sequence[str], addon_plans: Sequence[str], plan: str = "plan"
) -> DataFrame:
    """Totals of every base plan combined with every add-on plan.

    Each plan's totals are handed to the scenarios it belongs to and summed there.
    """
    pairs = {b: [f"{b}+{a}" for a in addon_plans] for b in base_plans}
    pairs.update({a: [f"{b}+{a}" for b in base_plans] for a in addon_plans})
    if len(pairs) != len(base_plans) + len(addon_plans):
        raise ValueError("a plan cannot be both base and add-on")
    member = F.create_map(
        *[x for k, v in pairs.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))]
    )
    totals = plan_totals(estimates, [plan])
    return (
        totals.withColumn("scenario", F.explode(F.try_element_at(member, F.col(plan))))
        .groupBy("scenario").agg(*_sums())
    )


def addon_subsets(
    estimates: DataFrame, addons: Sequence[str], budget: float, free_bytes: Column,
    part: str = "part", base: str = "base",
) -> DataFrame:
    """Every non-empty add-on subset on top of the base rows, with totals and gates.

    ``part`` names the add-on of a row, or the base. A subset is a bit mask over the configured
    list, so an add-on's totals go to the masks that hold its bit, and the base's to all.
    """
    names = list(addons)
    if len(names) > MAX_ADDONS:
        raise ValueError(f"{len(names)} add-ons would give 2**{len(names)} subsets")
    last = (1 << len(names)) - 1
    bit = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(part)) - 1
    is_base = F.col(part) == base
    totals = plan_totals(estimates.where(F.col(part).isin(base, *names)), [part])
    masks = totals.withColumn("_bit", F.when(~is_base, bit)).withColumn(
        "mask", F.explode(F.sequence(F.lit(1), F.lit(last)))
    )
    held = masks.where(
        F.col("_bit").isNull() | (F.col("mask").bitwiseAND(F.expr("cast(shiftleft(1, cast(_bit as int)) as int)")) != 0)
    )
    subsets = held.groupBy("mask").agg(
        F.count("_bit").alias("addons"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("_bit").isNotNull(), F.struct("_bit", part)))),
                lambda x: x[part],
            ),
            "+",
        ).alias("addon_roots"),
        F.sum(F.when(F.col("_bit").isNotNull(), F.col("estimated_cost_usd"))).alias("addon_cost_usd"),
        *_sums(),
    )
    gated = with_gates(subsets, budget, free_bytes)
    return gated.withColumn("budget_remaining_usd", F.lit(budget) - F.col("estimated_cost_usd")).drop("mask")


def largest_fitting(subsets: DataFrame) -> DataFrame:
    """The affordable subsets with the most add-ons (at most 2**16 subsets exist)."""
    fitting = subsets.where("budget_pass")
    size = Window.partitionBy("budget_pass").orderBy(F.desc("addons"))
    return fitting.withColumn("_r", F.rank().over(size)).where("_r = 1").drop("_r")
