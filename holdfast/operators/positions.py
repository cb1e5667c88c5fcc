"""Positions of a manager in an instrument, and the summaries built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions import values as v
from holdfast.operators.keys import first_n_per_key
from holdfast.schemas import (
    CALL, COMMON, ETF, INSTRUMENT_KEY, MANAGER_QUARTER, PUT, RELATIONSHIP_KEY, SECURITY_QUARTER, UNCLASSIFIED,
)

POSITION_COLUMNS = [
    *RELATIONSHIP_KEY, "quarter_id", "value_usd", "reported_amount", "portfolio_weight", "source_row_count",
    "effective_accession_count", "has_shared_discretion", "has_confidential_omission", "value_quality_status",
]

TYPE_SUMS = {
    "common_stock_value_usd": COMMON, "etf_value_usd": ETF, "call_value_usd": CALL, "put_value_usd": PUT,
    "unknown_value_usd": UNCLASSIFIED,
}


def type_sums(value: str = "value_usd") -> list[Column]:
    return [v.sum_if(F.col("security_type_id") == t, value).alias(name) for name, t in TYPE_SUMS.items()]


FILING_COLUMNS = [
    "accession_number", *MANAGER_QUARTER, "has_confidential_omission", "value_reconciliation_status", "value_multiplier",
]


def aggregate_positions(lines: DataFrame, classification: DataFrame) -> DataFrame:
    """Sum enriched lines of resolved filings to (manager, instrument, quarter).

    Lines are reduced to (filing, CUSIP, option, unit) still on the map side, where lines of a filing stand together, so a
    filing or CUSIP that owns a large share of the lines shrinks before anything is exchanged.  An instrument's filing count
    is then a plain row count.  The class is looked up on the reduced rows.
    """
    shared = F.col("othermanager").isNotNull() | (
        F.upper(F.coalesce("investmentdiscretion", F.lit(""))) != "SOLE"
    )
    narrow = lines.filter("is_effective = 1 AND is_analytics_ready = 1").select(
        *FILING_COLUMNS,
        "cusip",
        v.option_type("putcall").alias("option_type"),
        v.amount_type("sshprnamttype").alias("amount_type"),
        "value",
        "sshprnamt",
        F.when(shared, 1).otherwise(0).alias("shared"),
        F.when(F.col("putcall").isNotNull(), 1).otherwise(0).alias("putcall_given"),
    )
    per_filing = narrow.groupBy(*FILING_COLUMNS, "cusip", "option_type", "amount_type").agg(
        F.sum("value").alias("raw_value"),
        F.sum("sshprnamt").alias("reported_amount"),
        F.count("*").alias("source_row_count"),
        F.max("shared").alias("shared"),
        F.max("putcall_given").alias("putcall_given"),
    )
    base = classification.select("cusip", F.col("security_type_id").alias("base_type_id"))
    typed = per_filing.join(base, "cusip").withColumn(
        "security_type_id", v.instrument_type("option_type", "amount_type", "base_type_id")
    )
    return typed.groupBy(*RELATIONSHIP_KEY, "quarter_id").agg(
        F.sum(F.col("raw_value") * F.col("value_multiplier")).alias("value_usd"),
        F.sum("reported_amount").alias("reported_amount"),
        F.sum("source_row_count").alias("source_row_count"),
        F.count("*").alias("effective_accession_count"),
        F.max("shared").alias("has_shared_discretion"),
        F.max("has_confidential_omission").alias("has_confidential_omission"),
        F.max(v.quality_level("value_reconciliation_status")).alias("quality_level"),
        F.max("putcall_given").alias("putcall_given"),
    )


def portfolio_totals(base: DataFrame) -> DataFrame:
    """Value and confidentiality of every manager-quarter that has positions."""
    return base.groupBy(*MANAGER_QUARTER).agg(
        F.sum("value_usd").alias("portfolio_value_usd"),
        F.max("has_confidential_omission").alias("confidential"),
    )


def manager_quarter_context(base: DataFrame) -> DataFrame:
    """What every position of a manager-quarter inherits: the portfolio total and its calendar neighbours."""
    return with_neighbours(portfolio_totals(base))


def with_neighbours(totals: DataFrame) -> DataFrame:
    """Totals with ``prior_pair_confidential``: NULL without a portfolio in the previous calendar
    quarter, else 1 if either side left out confidential positions; likewise ``next_``.
    The window runs over the quarters of one manager, a handful per year.
    """
    w = Window.partitionBy("manager_cik").orderBy("quarter_id")
    q = F.col("quarter_id")

    def pair(neighbour: Column, neighbour_flag: Column, expected: Column) -> Column:
        return F.when(neighbour == expected, F.greatest("confidential", neighbour_flag))

    return totals.withColumns(
        {
            "prior_pair_confidential": pair(
                F.lag(q).over(w), F.lag("confidential").over(w), v.previous_quarter("quarter_id")
            ),
            "next_pair_confidential": pair(
                F.lead(q).over(w), F.lead("confidential").over(w), v.next_quarter("quarter_id")
            ),
        }
    ).drop("confidential")


def weigh_positions(base: DataFrame, context: DataFrame) -> DataFrame:
    """Portfolio weight = value / total of the manager-quarter, NULL for an all-zero portfolio.

    A join with the aggregated totals rather than a window: a join partition that is
    too large can be split, a window partition cannot.
    """
    return base.join(context, MANAGER_QUARTER).select(
        *base.columns,
        v.ratio("value_usd", "portfolio_value_usd").alias("portfolio_weight"),
        v.quality_status("quality_level").alias("value_quality_status"),
        "prior_pair_confidential",
        "next_pair_confidential",
    )


def instruments(positions: DataFrame, classification: DataFrame) -> DataFrame:
    """Every (CUSIP, type, option, unit) held, with the strongest reason for its type."""
    seen = positions.groupBy(*INSTRUMENT_KEY).agg(F.max("putcall_given").alias("putcall_given"))
    method = classification.select("cusip", F.col("classification_method").alias("base_method"))
    return seen.join(method, "cusip").select(
        *INSTRUMENT_KEY,
        F.when(F.col("putcall_given") == 1, "PUTCALL")
        .when(F.col("amount_type") == "PRN", "AMOUNT_TYPE")
        .otherwise(F.col("base_method"))
        .alias("classification_method"),
        F.lit(1).alias("is_active"),
    )


def relationships(positions: DataFrame) -> DataFrame:
    """Manager x instrument with first and last quarter of observation."""
    return positions.groupBy(*RELATIONSHIP_KEY).agg(
        F.min("quarter_id").alias("first_observed_quarter_id"),
        F.max("quarter_id").alias("latest_observed_quarter_id"),
        F.lit(1).alias("is_active"),
    )


def manager_cusip_quarters(positions: DataFrame) -> DataFrame:
    """Positions of a manager rolled up from instruments to CUSIPs."""
    return positions.groupBy("manager_cik", "cusip", "quarter_id").agg(
        F.sum("value_usd").alias("value_usd"),
        F.count("*").alias("instrument_count"),
        F.max("has_shared_discretion").alias("has_shared_discretion"),
        F.max("has_confidential_omission").alias("has_confidential_omission"),
        v.quality_status(F.max("quality_level")).alias("value_quality_status"),
    )


def largest_positions(positions: DataFrame, n: int) -> DataFrame:
    """The n largest instruments of every manager-quarter, ties by natural key."""
    order = [F.col("value_usd").desc(), *[F.col(c) for c in INSTRUMENT_KEY]]
    slim = positions.select(*MANAGER_QUARTER, *INSTRUMENT_KEY, "value_usd", "portfolio_weight")
    return first_n_per_key(slim, MANAGER_QUARTER, order, n, rank="value_rank")


def manager_quarter_summary(positions: DataFrame) -> DataFrame:
    """Portfolio totals, type breakdown and concentration of every manager-quarter."""
    per_cusip = positions.groupBy(*MANAGER_QUARTER, "cusip").agg(
        F.sum("value_usd").alias("portfolio_value_usd"),
        F.count("*").alias("instrument_count"),
        *type_sums(),
        F.max("has_shared_discretion").alias("has_shared_discretion"),
        F.max("has_confidential_omission").alias("has_confidential_omission"),
        F.max("quality_level").alias("quality_level"),
    )
    totals = per_cusip.groupBy(*MANAGER_QUARTER).agg(
        F.sum("portfolio_value_usd").alias("portfolio_value_usd"),
        F.sum("instrument_count").alias("instrument_count"),
        F.count("*").alias("cusip_count"),
        *[F.sum(c).alias(c) for c in TYPE_SUMS],
        F.max("has_shared_discretion").alias("has_shared_discretion"),
        F.max("has_confidential_omission").alias("has_confidential_omission"),
        v.quality_status(F.max("quality_level")).alias("value_quality_status"),
    )
    first = F.col("value_rank") == 1
    top = largest_positions(positions, 10).groupBy(*MANAGER_QUARTER).agg(
        *[F.max(F.when(first, F.col(c))).alias(f"largest_{c}") for c in INSTRUMENT_KEY],
        F.max(F.when(first, F.col("value_usd"))).alias("largest_position_value_usd"),
        F.max(F.when(first, F.col("portfolio_weight"))).alias("largest_position_weight"),
        F.sum("portfolio_weight").alias("top_10_weight"),
    )
    return totals.join(top, MANAGER_QUARTER)


def security_quarter_summary(positions: DataFrame) -> DataFrame:
    """Holders, totals, largest holder and holder concentration (HHI) of every CUSIP-quarter.

    HHI = sum of squared holder values / squared total, so one pass of partial
    aggregates is enough even for a CUSIP that everybody holds.
    """
    per_manager = positions.groupBy(*SECURITY_QUARTER, "manager_cik").agg(
        F.sum("value_usd").alias("manager_value"),
        *type_sums(),
        F.max("has_shared_discretion").alias("has_shared_discretion"),
        F.max("has_confidential_omission").alias("has_confidential_omission"),
        F.max("quality_level").alias("quality_level"),
    )
    value = F.col("manager_value").cast("double")
    total = F.col("total_value_usd").cast("double")
    return (
        per_manager.groupBy(*SECURITY_QUARTER)
        .agg(
            F.count("*").alias("manager_count"),
            F.sum("manager_value").alias("total_value_usd"),
            *[F.sum(c).alias(c) for c in TYPE_SUMS],
            F.min(F.struct((-F.col("manager_value")).alias("order"), "manager_cik")).alias("largest"),
            F.sum(value * value).alias("squares"),
            F.max("has_shared_discretion").alias("has_shared_discretion"),
            F.max("has_confidential_omission").alias("has_confidential_omission"),
            v.quality_status(F.max("quality_level")).alias("value_quality_status"),
        )
        .select(
            *SECURITY_QUARTER,
            "manager_count",
            "total_value_usd",
            *TYPE_SUMS,
            F.col("largest.manager_cik").alias("largest_manager_cik"),
            (-F.col("largest.order")).alias("largest_manager_value_usd"),
            F.try_divide("squares", total * total).alias("manager_concentration_hhi"),
            "has_shared_discretion",
            "has_confidential_omission",
            "value_quality_status",
        )
    )
