"""Manager x CUSIP relationships over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions import values as v
from holdfast.plans.common import equals, in_order, institution_name, manager_names, security_names
from holdfast.plans.institutions import held_with_change
from holdfast.plans.warehouse import Warehouse
from holdfast.schemas import ACTIONS

PAIR = ["manager_cik", "cusip"]


def relationship_identity(w: Warehouse, cik: str | None = None, cusip: str | None = None) -> DataFrame:
    span = (
        equals(w.relationships, manager_cik=cik, cusip=cusip)
        .groupBy(*PAIR)
        .agg(
            F.min("first_observed_quarter_id").alias("first_quarter"),
            F.max("latest_observed_quarter_id").alias("latest_quarter_id"),
        )
    )
    return (
        span.join(security_names(w).drop("figi"), "cusip")
        .join(manager_names(w), "manager_cik", "left")
        .select(
            F.col("manager_cik").alias("cik"),
            institution_name().alias("institution_name"),
            "cusip",
            "issuer",
            "title_of_class",
            v.quarter_label("first_quarter").alias("first_purchased"),
            v.quarter_label("latest_quarter_id").alias("latest_quarter"),
        )
    )


def relationship_history(w: Warehouse, cik: str | None = None, cusip: str | None = None) -> DataFrame:
    """Quarter by quarter over all instruments of the CUSIP.

    Amounts only add up if all instruments share one unit.  The action is the
    alphabetically last one, which differs from the holder list on purpose.  Texts are
    aggregated as numbers, which keeps the grouping a hash aggregate without a sort.
    """
    rows = equals(held_with_change(w), manager_cik=cik, cusip=cusip)
    unit, amount = F.col("amount_type"), F.col("reported_amount")
    zero = F.lit(0).cast("bigint")
    units = ("OTHER", "PRN", "SH")
    seen = {u: F.col(f"has_{u.lower()}") for u in units}
    one_unit = seen["OTHER"] + seen["PRN"] + seen["SH"] == 1
    by_name = F.array(*[F.lit(a) for a in sorted(ACTIONS)])
    grouped = rows.groupBy(*PAIR, "quarter_id").agg(
        *[F.max(F.when(unit == u, 1).otherwise(0)).alias(f"has_{u.lower()}") for u in units],
        F.sum("market_value_usd").alias("market_value_usd"),
        F.sum(amount).alias("all_amounts"),
        F.sum(F.when(unit == "SH", amount)).alias("shares"),
        F.sum(F.when(unit == "PRN", amount)).alias("principal_amount"),
        F.max("portfolio_weight").alias("portfolio_weight"),
        F.max(F.array_position(by_name, F.col("action"))).alias("last_action"),
        F.sum(F.coalesce("amount_change", zero)).alias("all_changes"),
        F.max("amount_change_percent").alias("largest_percent"),
        F.sum(F.coalesce("value_change_usd", zero)).alias("value_change_usd"),
    )
    history = grouped.select(
        *PAIR,
        "quarter_id",
        v.quarter_label("quarter_id").alias("quarter_label"),
        "market_value_usd",
        F.when(one_unit, F.col("all_amounts")).alias("reported_amount"),
        "shares",
        "principal_amount",
        F.concat_ws(",", *[F.when(seen[u] == 1, u) for u in units]).alias("amount_type"),
        "portfolio_weight",
        F.coalesce(F.get(by_name, F.col("last_action") - 1), F.lit("UNCHANGED")).alias("action"),
        F.when(one_unit, F.col("all_changes")).alias("amount_change"),
        F.when(one_unit, F.col("largest_percent")).alias("amount_change_percent"),
        "value_change_usd",
    )
    return in_order(history, cik and cusip, "quarter_id")


def with_runs(history: DataFrame, keys: list[str], quarter: str = "quarter_id") -> DataFrame:
    """Mark unbroken runs of quarters: rows of one run share (ordinal - position), later runs have more.

    The windows hold the quarters of one entity, one row each.
    """
    entity = Window.partitionBy(*keys)
    position = F.row_number().over(entity.orderBy(quarter))
    return history.withColumn("run", v.quarter_ordinal(quarter) - position).withColumn(
        "last_run", F.max("run").over(entity)
    )


def trailing_length() -> Column:
    return F.count_if(F.col("run") == F.col("last_run")).alias("consecutive_quarters_held")


def trailing_run(history: DataFrame, keys: list[str], quarter: str = "quarter_id") -> DataFrame:
    """Length of the unbroken run of quarters that ends at the last observed one."""
    return with_runs(history, keys, quarter).groupBy(*keys).agg(trailing_length())


def relationship_statistics(w: Warehouse, cik: str | None = None, cusip: str | None = None) -> DataFrame:
    """Duration, trailing run, last purchases and peaks; one exchange after the history itself."""
    history = with_runs(relationship_history(w, cik, cusip), PAIR)

    def last(*actions: str) -> Column:
        return v.quarter_label(F.max(F.when(F.col("action").isin(*actions), F.col("quarter_id"))))

    return history.groupBy(*PAIR).agg(
        F.count_if(F.col("market_value_usd") > 0).alias("holding_duration_quarters"),
        trailing_length(),
        last("NEW", "ADDED").alias("last_added"),
        last("REDUCED").alias("last_reduced"),
        F.max("market_value_usd").alias("largest_position_value_usd"),
        F.max(F.coalesce("portfolio_weight", F.lit(0.0))).alias("highest_portfolio_weight"),
    )
