"""Position changes between adjacent quarters and the four activity rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import values as v
from holdfast.schemas import RELATIONSHIP_KEY

CHANGE_COLUMNS = [
    *RELATIONSHIP_KEY, "from_quarter_id", "to_quarter_id", "prior_value_usd", "current_value_usd", "value_change_usd",
    "prior_reported_amount", "current_reported_amount", "amount_change", "amount_change_percent", "action",
    "is_comparable", "noncomparable_reason", "value_quality_status",
]
BOUGHT, SOLD = ("NEW", "ADDED"), ("REDUCED", "EXITED")


def manager_pairs(context: DataFrame) -> DataFrame:
    """Managers with portfolios in two adjacent calendar quarters."""
    return context.filter("prior_pair_confidential IS NOT NULL").select(
        "manager_cik",
        v.previous_quarter("quarter_id").alias("from_quarter_id"),
        F.col("quarter_id").alias("to_quarter_id"),
        F.col("prior_pair_confidential").alias("has_confidential_omission"),
    )


def change_columns(pair_confidential: Column) -> list[Column]:
    """Rules for one matched row with prior_/current_ value, amount and quality."""
    prior, current = F.col("prior_reported_amount"), F.col("current_reported_amount")
    zero = F.lit(0).cast("bigint")
    change = F.coalesce(current, zero) - F.coalesce(prior, zero)
    hidden = pair_confidential == 1
    # every position has a quality, so a side without one has no position; its amount alone may be NULL
    action = (
        F.when(hidden, "UNKNOWN")
        .when(F.col("prior_quality").isNull(), "NEW")
        .when(F.col("current_quality").isNull(), "EXITED")
        .when(current > prior, "ADDED")
        .when(current < prior, "REDUCED")
        .otherwise("UNCHANGED")
    )
    worst = F.greatest(v.status_level("prior_quality"), v.status_level("current_quality"))
    return [
        F.col("prior_value_usd"),
        F.col("current_value_usd"),
        (F.coalesce("current_value_usd", zero) - F.coalesce("prior_value_usd", zero)).alias("value_change_usd"),
        prior,
        current,
        change.alias("amount_change"),
        v.ratio(change, prior).alias("amount_change_percent"),
        action.alias("action"),
        F.when(hidden, 0).otherwise(1).alias("is_comparable"),
        F.when(hidden, "CONFIDENTIAL_OMISSION").alias("noncomparable_reason"),
        v.quality_status(worst).alias("value_quality_status"),
    ]


def _side(positions: DataFrame, name: str, quarter: Column, pair: str) -> DataFrame:
    return positions.filter(F.col(pair).isNotNull()).select(
        *RELATIONSHIP_KEY,
        quarter.alias("to_quarter_id"),
        F.col("value_usd").alias(f"{name}_value_usd"),
        F.col("reported_amount").alias(f"{name}_reported_amount"),
        F.col("value_quality_status").alias(f"{name}_quality"),
        F.col("portfolio_weight").alias(f"{name}_portfolio_weight"),
        F.col(pair).alias(f"{name}_pair"),
    )


def quarter_changes(positions: DataFrame) -> DataFrame:
    """Diff of every manager's positions against its previous calendar quarter.

    One full outer join of the positions with themselves, the older side keyed by the
    following quarter.  Rows of managers without both quarters are dropped before the
    join by flags carried on the positions, and the join key is the position key, so
    no manager or CUSIP can fill a partition.
    """
    current = _side(positions, "current", F.col("quarter_id"), "prior_pair_confidential")
    prior = _side(positions, "prior", v.next_quarter("quarter_id"), "next_pair_confidential")
    both = prior.join(current, [*RELATIONSHIP_KEY, "to_quarter_id"], "full_outer")
    return both.select(
        *RELATIONSHIP_KEY,
        v.previous_quarter("to_quarter_id").alias("from_quarter_id"),
        "to_quarter_id",
        *change_columns(F.coalesce("current_pair", "prior_pair")),
        "current_portfolio_weight",
        F.col("current_pair").isNotNull().alias("is_held"),
    )


def period_changes(positions: DataFrame, from_quarter: int, to_quarter: int) -> DataFrame:
    """The same diff for any two quarters, for managers that reported in both."""
    rows = positions.filter(F.col("quarter_id").isin(from_quarter, to_quarter))
    both = (
        rows.groupBy("manager_cik")
        .agg(
            F.count_distinct("quarter_id").alias("quarters"),
            F.max("has_confidential_omission").alias("pair_confidential"),
        )
        .filter("quarters = 2")
        .select("manager_cik", "pair_confidential")
    )

    def side(name: str, quarter: int) -> DataFrame:
        return rows.filter(F.col("quarter_id") == quarter).select(
            *RELATIONSHIP_KEY,
            F.col("value_usd").alias(f"{name}_value_usd"),
            F.col("reported_amount").alias(f"{name}_reported_amount"),
            F.col("value_quality_status").alias(f"{name}_quality"),
        )

    diff = side("prior", from_quarter).join(side("current", to_quarter), RELATIONSHIP_KEY, "full_outer")
    return diff.join(both, "manager_cik").select(
        *RELATIONSHIP_KEY,
        F.lit(from_quarter).alias("from_quarter_id"),
        F.lit(to_quarter).alias("to_quarter_id"),
        *change_columns(F.col("pair_confidential")),
    )


def _in(actions: tuple[str, ...]) -> Column:
    return F.col("action").isin(*actions)


def manager_activity(changes: DataFrame) -> DataFrame:
    """Counts and gross flows per manager-quarter.  Buys keep their sign, sells are absolute."""
    change, comparable = F.col("value_change_usd"), F.col("is_comparable") == 1
    return changes.groupBy("manager_cik", F.col("to_quarter_id").alias("quarter_id")).agg(
        F.count_if(F.col("action") == "NEW").alias("new_count"),
        F.count_if(F.col("action") == "ADDED").alias("added_count"),
        F.count_if(F.col("action") == "REDUCED").alias("reduced_count"),
        F.count_if(F.col("action") == "EXITED").alias("exited_count"),
        v.sum_if(_in(BOUGHT), change).alias("gross_buy_value_usd"),
        v.sum_if(_in(SOLD), F.abs(change)).alias("gross_sell_value_usd"),
        v.sum_if(comparable, F.abs(change)).alias("gross_value_change_usd"),
        v.sum_if(comparable, change).alias("net_value_change_usd"),
    )


def manager_action_activity(changes: DataFrame) -> DataFrame:
    return changes.groupBy("manager_cik", F.col("to_quarter_id").alias("quarter_id"), "action").agg(
        F.count("*").alias("position_count"),
        F.sum(F.coalesce("current_value_usd", "prior_value_usd")).alias("position_value_usd"),
        F.sum("amount_change").alias("amount_change"),
        F.sum("value_change_usd").alias("value_change_usd"),
    )


def security_action_activity(changes: DataFrame) -> DataFrame:
    """Distinct managers per (CUSIP, quarter, action): reduce to one row per manager, then count rows."""
    keys = ["cusip", "quarter_id", "action"]
    per_manager = changes.withColumnRenamed("to_quarter_id", "quarter_id").groupBy(*keys, "manager_cik").agg(
        F.sum("value_change_usd").alias("value_change_usd")
    )
    return per_manager.groupBy(*keys).agg(
        F.count("*").alias("institution_count"), F.sum("value_change_usd").alias("value_change_usd")
    )


def security_activity(action_activity: DataFrame) -> DataFrame:
    """Pivot of the action rollup; rows of hidden pairs (UNKNOWN) do not enter the net change."""

    def managers(action: str) -> Column:
        return v.sum_if(F.col("action") == action, "institution_count")

    return action_activity.groupBy("cusip", "quarter_id").agg(
        managers("NEW").alias("new_investor_count"),
        managers("EXITED").alias("exited_investor_count"),
        managers("ADDED").alias("added_holder_count"),
        managers("REDUCED").alias("reduced_holder_count"),
        v.sum_if(F.col("action") != "UNKNOWN", "value_change_usd").alias("net_value_change_usd"),
    )


def exited_positions(changes: DataFrame) -> DataFrame:
    """Change rows without a position in their closing quarter.

    Changes come out of a full outer join of the positions, so the missing side already
    says so; no anti join with the positions is needed.
    """
    return changes.filter("NOT is_held")
