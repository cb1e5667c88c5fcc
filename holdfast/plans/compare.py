"""Two quarters side by side, and the positions that moved between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import values as v
from holdfast.operators.keys import first_n_per_key, page
from holdfast.plans.common import (
    equals, institution_name, manager_names, security_names, type_codes, valid_action, zero_if_missing,
)
from holdfast.plans.warehouse import Warehouse
from holdfast.schemas import INSTRUMENT_KEY, MANAGER_QUARTER, SECURITY_QUARTER

INSTITUTION_MEASURES = [
    "portfolio_value_usd", "cusip_count", "instrument_count", "top_10_weight", "common_stock_value_usd",
    "etf_value_usd", "call_value_usd", "put_value_usd",
]
SECURITY_MEASURES = [
    "institutional_value_usd", "institution_count", "common_stock_value_usd", "etf_value_usd", "call_value_usd",
    "put_value_usd", "concentration_hhi",
]
MOVE_COLUMNS = [
    "action", "prior_value_usd", "current_value_usd", "value_change_usd", "prior_reported_amount",
    "current_reported_amount", "amount_change",
]


def side_by_side(
    rows: DataFrame, entity: str, measures: list[str], also: list[str], from_quarter: int | None,
    to_quarter: int | None,
) -> DataFrame:
    """prior_/current_ columns and deltas (NULL as 0) for entities that have both quarters.

    With explicit quarters any distance works; without them every quarter is compared
    with the previous calendar quarter.
    """
    target = v.next_quarter("quarter_id") if to_quarter is None else F.lit(to_quarter)

    def side(df: DataFrame, name: str, quarter: Column) -> DataFrame:
        return df.select(
            entity, quarter.alias("to_quarter_id"), F.col("quarter_id").alias(f"{name}_quarter_id"),
            *[F.col(c).alias(f"{name}_{c}") for c in [*measures, *also]],
        )

    prior = side(equals(rows, quarter_id=from_quarter), "prior", target)
    current = side(equals(rows, quarter_id=to_quarter), "current", F.col("quarter_id"))
    joined = prior.join(current, [entity, "to_quarter_id"])

    def delta(c: str) -> Column:
        return F.coalesce(f"current_{c}", F.lit(0)) - F.coalesce(f"prior_{c}", F.lit(0))

    return joined.select(
        entity,
        F.col("prior_quarter_id").alias("from_quarter_id"),
        "to_quarter_id",
        *[F.col(f"{s}_{c}") for s in ("prior", "current") for c in [*measures, *also]],
        *[delta(c).alias(f"delta_{c}") for c in measures],
    )


def compare_institution(
    w: Warehouse, cik: str | None = None, from_quarter: int | None = None, to_quarter: int | None = None
) -> DataFrame:
    also = ["new_count", "exited_count", "net_value_change_usd"]
    rows = (
        equals(w.manager_summary, manager_cik=cik)
        .join(w.manager_activity.select(*MANAGER_QUARTER, *also), MANAGER_QUARTER, "left")
        .withColumns(zero_if_missing(*also))
    )
    return side_by_side(rows, "manager_cik", INSTITUTION_MEASURES, also, from_quarter, to_quarter)


def compare_security(
    w: Warehouse, cusip: str | None = None, from_quarter: int | None = None, to_quarter: int | None = None
) -> DataFrame:
    also = ["new_investor_count", "exited_investor_count", "net_value_change_usd"]
    rows = (
        equals(w.security_summary, cusip=cusip)
        .join(w.security_activity.select(*SECURITY_QUARTER, *also), SECURITY_QUARTER, "left")
        .withColumns(zero_if_missing(*also))
        .withColumnsRenamed(
            {
                "total_value_usd": "institutional_value_usd", "manager_count": "institution_count",
                "manager_concentration_hhi": "concentration_hhi",
            }
        )
    )
    return side_by_side(rows, "cusip", SECURITY_MEASURES, also, from_quarter, to_quarter)


def _moves(w: Warehouse, from_quarter: int | None, to_quarter: int | None, action: str | None) -> DataFrame:
    return equals(
        w.changes, from_quarter_id=from_quarter, to_quarter_id=to_quarter, action=valid_action(action)
    ).withColumn("size", F.abs(F.coalesce("value_change_usd", F.lit(0))))


def institution_movers(
    w: Warehouse, cik: str | None = None, from_quarter: int | None = None, to_quarter: int | None = None,
    action: str | None = None, n: int = 25,
) -> DataFrame:
    """The n largest value changes of every manager and quarter pair (adjacent quarters only)."""
    rows = equals(_moves(w, from_quarter, to_quarter, action), manager_cik=cik)
    order = [F.col("size").desc(), *[F.col(c) for c in INSTRUMENT_KEY]]
    top = first_n_per_key(rows, ["manager_cik", "from_quarter_id", "to_quarter_id"], order, n)
    return (
        top.join(type_codes(w), "security_type_id")
        .join(security_names(w), "cusip")
        .select(
            "manager_cik", "from_quarter_id", "to_quarter_id", "cusip", "issuer", "title_of_class", "security_type",
            "option_type", "amount_type", *MOVE_COLUMNS,
        )
    )


def security_movers(
    w: Warehouse, cusip: str | None = None, from_quarter: int | None = None, to_quarter: int | None = None,
    action: str | None = None, n: int = 25,
) -> DataFrame:
    """The n largest value changes of every CUSIP and quarter pair."""
    rows = equals(_moves(w, from_quarter, to_quarter, action), cusip=cusip)
    order = [F.col("size").desc(), F.col("manager_cik"), *[F.col(c) for c in INSTRUMENT_KEY[1:]]]
    top = first_n_per_key(rows, ["cusip", "from_quarter_id", "to_quarter_id"], order, n)
    return top.join(manager_names(w), "manager_cik", "left").select(
        "cusip", "from_quarter_id", "to_quarter_id", F.col("manager_cik").alias("cik"),
        institution_name().alias("institution_name"), "security_type_id", "option_type", "amount_type",
        *MOVE_COLUMNS,
    )


def activity_explorer(
    w: Warehouse, quarter_id: int | None = None, action: str | None = "NEW", cik: str | None = None,
    cusip: str | None = None, search: str = "", page_number: int | None = None, page_size: int = 25,
) -> DataFrame:
    """All changes of a quarter with names, largest first when paged."""
    rows = equals(_moves(w, None, quarter_id, action), manager_cik=cik, cusip=cusip)
    rows = (
        rows.join(type_codes(w), "security_type_id")
        .join(security_names(w), "cusip")
        .join(manager_names(w), "manager_cik", "left")
    )
    if search:
        rows = rows.filter(
            v.contains_any(search, "manager_cik", "manager_name", "sec_company_name", "cusip", "issuer")
        )
    if page_number is not None:
        order = [F.col("size").desc(), F.col("manager_cik"), *[F.col(c) for c in INSTRUMENT_KEY], F.col("to_quarter_id")]
        rows = page(rows, order, page_number, page_size)
    return rows.select(
        F.col("manager_cik").alias("cik"), institution_name().alias("institution_name"), "cusip", "issuer",
        "title_of_class", "security_type", "option_type", "amount_type", "to_quarter_id", *MOVE_COLUMNS,
    )
