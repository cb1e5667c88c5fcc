"""Security queries: ranking, profile, holders, siblings of the same issuer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import values as v
from holdfast.operators.keys import first_n_per_key, page
from holdfast.plans.common import (
    base_types, equals, in_order, in_range, institution_name, manager_names, security_names, valid_action, zero_if_missing,
)
from holdfast.plans.institutions import RankFilter, _snapshot_rows, held_and_left, order_of
from holdfast.plans.warehouse import Warehouse
from holdfast.schemas import SECURITY_QUARTER

# Sort keys of the security ranking and of the holder list.
SECURITY_ORDERS = {
    "ownership": "institutional_value_usd",
    "bought": "net_value_change_usd",
    "sold": "negative_net_change",
    "new": "new_investor_count",
    "exits": "exited_investor_count",
    "holders": "institution_count",
    "concentrated": "hhi_or_zero",
    "security": "issuer",
    "class": "security_type",
    "institutional_value": "institutional_value_usd",
    "institutions": "institution_count",
    "net_value_change": "net_value_change_usd",
    "new_exited": "new_and_exited",
    "new_count": "new_investor_count",
    "exited_count": "exited_investor_count",
    "concentration": "hhi_or_zero",
}
HOLDER_ORDERS = {
    "value": "market_value_usd",
    "shares": "reported_amount",
    "weight": "weight_or_zero",
    "share_change": "absolute_amount_change",
    "institution": "institution_name",
}
ACTIVITY_COLUMNS = [
    "new_investor_count", "exited_investor_count", "added_holder_count", "reduced_holder_count",
    "net_value_change_usd",
]


def rank_securities(
    w: Warehouse, quarter_id: int | None = None, f: RankFilter = RankFilter(), page_number: int | None = None,
    page_size: int = 25,
) -> DataFrame:
    """Securities of a quarter by any listed key; ``security_type`` is the class of the CUSIP."""
    rows = (
        equals(w.security_summary, quarter_id=quarter_id)
        .join(w.security_activity.select(*SECURITY_QUARTER, *ACTIVITY_COLUMNS), SECURITY_QUARTER, "left")
        .join(security_names(w).drop("figi"), "cusip")
        .join(base_types(w).select("cusip", "security_type"), "cusip", "left")
        .withColumns(zero_if_missing(*ACTIVITY_COLUMNS))
    )
    rows = equals(rows, security_type=f.security_type)
    if f.search:
        rows = rows.filter(v.contains_any(f.search, "cusip", "issuer"))
    rows = in_range(
        rows,
        {
            "total_value_usd": f.dollars(f.value_millions),
            "manager_count": f.institutions,
            "net_value_change_usd": f.dollars(f.net_change_millions),
            "new_investor_count": (f.min_new, None),
            "exited_investor_count": (f.min_exited, None),
        },
    ).withColumns(
        {
            "quarter_label": v.quarter_label("quarter_id"),
            "institution_count": F.col("manager_count"),
            "institutional_value_usd": F.col("total_value_usd"),
            "concentration_hhi": F.col("manager_concentration_hhi"),
            "hhi_or_zero": F.coalesce("manager_concentration_hhi", F.lit(0.0)),
            "negative_net_change": -F.col("net_value_change_usd"),
            "new_and_exited": F.col("new_investor_count") + F.col("exited_investor_count"),
        }
    )
    order = [
        F.col("quarter_id").desc(),
        *order_of(SECURITY_ORDERS, f.sort_by, "ownership", f.descending, ["issuer", "cusip"]),
    ]
    ranked = rows.orderBy(*order) if page_number is None else page(rows, order, page_number, page_size)
    return ranked.select(
        "quarter_id", "cusip", "issuer", "title_of_class", "security_type", "quarter_label", "institution_count",
        "institutional_value_usd", "common_stock_value_usd", "call_value_usd", "put_value_usd", "concentration_hhi",
        *ACTIVITY_COLUMNS,
    )


def security_identity(w: Warehouse, cusip: str | None = None) -> DataFrame:
    span = w.security_summary.groupBy("cusip").agg(
        F.min("quarter_id").alias("first_quarter"), F.max("quarter_id").alias("latest_quarter")
    )
    classes = base_types(w).select("cusip", "security_type", "classification_method", "classification_confidence")
    return (
        equals(security_names(w), cusip=cusip)
        .join(classes, "cusip", "left")
        .join(span, "cusip", "left")
        .select(
            "cusip", "issuer", "title_of_class", "figi", "security_type", "classification_method",
            "classification_confidence",
            v.quarter_label("first_quarter").alias("first_reportable_quarter"),
            v.quarter_label("latest_quarter").alias("latest_reportable_quarter"),
        )
    )


def security_snapshot(w: Warehouse, quarter_id: int | None = None, cusip: str | None = None) -> DataFrame:
    rows = _snapshot_rows(equals(w.security_summary, cusip=cusip), "cusip", quarter_id)
    return rows.join(manager_names(w, "largest_manager_cik"), "largest_manager_cik", "left").select(
        *w.security_summary.columns,
        v.quarter_label("quarter_id").alias("quarter_label"),
        v.ratio("total_value_usd", "manager_count").alias("average_position_value_usd"),
        institution_name("largest_manager_cik").alias("largest_holder_name"),
    )


def security_activity(w: Warehouse, cusip: str | None = None, quarter_id: int | None = None) -> DataFrame:
    rows = equals(w.security_action_activity, cusip=cusip, quarter_id=quarter_id)
    return in_order(rows, cusip, *SECURITY_QUARTER, "action")


def security_history(w: Warehouse, cusip: str | None = None) -> DataFrame:
    counts = ["new_investor_count", "exited_investor_count", "net_value_change_usd"]
    rows = (
        equals(w.security_summary, cusip=cusip)
        .join(w.security_activity.select(*SECURITY_QUARTER, *counts), SECURITY_QUARTER, "left")
        .withColumns(zero_if_missing(*counts))
        .select(
            *SECURITY_QUARTER,
            v.quarter_label("quarter_id").alias("quarter_label"),
            F.col("manager_count").alias("institution_count"),
            F.col("total_value_usd").alias("institutional_value_usd"),
            F.col("manager_concentration_hhi").alias("concentration_hhi"),
            v.ratio("total_value_usd", "manager_count").alias("average_position_value_usd"),
            *counts,
        )
    )
    return in_order(rows, cusip, *SECURITY_QUARTER)


def security_holders(
    w: Warehouse, cusip: str | None = None, quarter_id: int | None = None, action: str | None = None,
    search: str = "", sort_by: str = "value", page_number: int | None = None, page_size: int = 25,
) -> DataFrame:
    """Holders of a CUSIP over all its instruments.

    Shares and principal are added together, the weight is the largest one, and the
    action is the most telling one of the manager's instruments.
    """
    rank = (
        F.when(F.col("action") == "UNKNOWN", 1)
        .when(F.col("action") == "NEW", 2)
        .when(F.col("action") == "ADDED", 3)
        .when(F.col("action") == "REDUCED", 4)
        .when(F.col("action") == "EXITED", 5)
        .otherwise(6)
    )
    zero = F.lit(0).cast("bigint")
    best = F.min(rank)
    names = F.array(*[F.lit(a) for a in ("UNKNOWN", "NEW", "ADDED", "REDUCED", "EXITED", "UNCHANGED")])
    holders = (
        equals(held_and_left(w, quarter_id), cusip=cusip)
        .groupBy("cusip", "quarter_id", "manager_cik")
        .agg(
            F.sum("market_value_usd").alias("market_value_usd"),
            F.sum("reported_amount").alias("reported_amount"),
            F.max("portfolio_weight").alias("portfolio_weight"),
            F.element_at(names, best).alias("action"),
            F.sum(F.coalesce("amount_change", zero)).alias("amount_change"),
            F.sum(F.coalesce("value_change_usd", zero)).alias("value_change_usd"),
        )
    )
    rows = equals(holders, action=valid_action(action)).join(manager_names(w), "manager_cik", "left")
    if search:
        rows = rows.filter(v.contains_any(search, "manager_cik", "manager_name", "sec_company_name"))
    rows = rows.withColumns({"cik": F.col("manager_cik"), "institution_name": institution_name()})
    if page_number is not None:
        rows = rows.withColumns(
            {
                "weight_or_zero": F.coalesce("portfolio_weight", F.lit(0.0)),
                "absolute_amount_change": F.abs("amount_change"),
            }
        )
        order = order_of(HOLDER_ORDERS, sort_by, "value", True, ["cik", "cusip", "quarter_id"])
        rows = page(rows, order, page_number, page_size)
    return rows.select(
        "cusip", "quarter_id", "cik", "institution_name", "market_value_usd", "reported_amount", "portfolio_weight",
        "action", "amount_change", "value_change_usd",
    )


def same_issuer(w: Warehouse, cusip: str | None = None, n: int = 20) -> DataFrame:
    """Up to n other CUSIPs of the same current issuer name, lowest CUSIP first.

    An issuer may own any number of CUSIPs.  The first n of the others are always among
    the first n + 1 of the issuer, so each CUSIP meets at most n + 1 rows instead of all
    its siblings.
    """
    named = security_names(w).select("cusip", "issuer", "title_of_class")
    shortlist = first_n_per_key(named, ["issuer"], [F.col("cusip")], n + 1, rank="place").select(
        "issuer", F.col("cusip").alias("other_cusip"), F.col("title_of_class").alias("other_class"), "place"
    )
    own = shortlist.select(F.col("other_cusip").alias("cusip"), F.col("place").alias("own_place"))
    pairs = (
        equals(named, cusip=cusip).select("cusip", "issuer")
        .join(own, "cusip", "left")
        .join(shortlist, "issuer")
        .filter(F.col("cusip") != F.col("other_cusip"))
    )
    # Without the CUSIP itself everything behind it moves up one place.
    moved_up = F.when(F.col("own_place") < F.col("place"), 1).otherwise(0)
    return pairs.filter(F.col("place") - moved_up <= n).select(
        "cusip", "issuer", "other_cusip", F.col("other_class").alias("title_of_class")
    )
