"""Quarter overview and institution queries.

Filters are optional; without them a query covers every institution and quarter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions import values as v
from holdfast.operators.changes import exited_positions
from holdfast.operators.keys import first_n_per_key, page, page_after
from holdfast.plans.common import (
    equals, in_order, in_range, institution_name, manager_names, millions, percent, security_names, type_codes,
    valid_action, zero_if_missing,
)
from holdfast.plans.warehouse import Warehouse
from holdfast.schemas import MANAGER_QUARTER, RELATIONSHIP_KEY

# ---- overview --------------------------------------------------------------
def quarters(w: Warehouse) -> DataFrame:
    """Quarters with at least one portfolio, newest first."""
    counts = w.manager_summary.groupBy("quarter_id").agg(F.count("*").alias("institution_count"))
    return (
        w.calendar.join(counts, "quarter_id")
        .select("quarter_id", "quarter_label", "quarter_end_date", "institution_count")
        .orderBy(F.col("quarter_id").desc())
    )


def latest_quarter(w: Warehouse) -> DataFrame:
    return w.manager_summary.agg(F.max("quarter_id").alias("quarter_id"))


def security_types(w: Warehouse) -> DataFrame:
    """The type list with the number of instruments held under each."""
    held = w.instruments.groupBy("security_type_id").agg(F.count("*").alias("instrument_count"))
    return (
        F.broadcast(w.security_type).join(held, "security_type_id", "left")
        .select(
            F.col("security_type_code").alias("value"),
            F.col("security_type_name").alias("label"),
            F.coalesce("instrument_count", F.lit(0).cast("bigint")).alias("instrument_count"),
        )
        .orderBy("label")
    )


def overview(w: Warehouse, quarter_id: int | None = None) -> DataFrame:
    sums = ["portfolio_value_usd", "common_stock_value_usd", "etf_value_usd", "call_value_usd", "put_value_usd"]
    return (
        equals(w.manager_summary, quarter_id=quarter_id)
        .groupBy("quarter_id")
        .agg(
            F.count("*").alias("institution_count"),
            F.sum("cusip_count").alias("reported_position_count"),
            *[F.sum(c).alias(c) for c in sums],
        )
        .withColumn("quarter_label", v.quarter_label("quarter_id"))
    )


def top_institutions(w: Warehouse, quarter_id: int | None = None, n: int = 5) -> DataFrame:
    """Largest portfolios of each quarter."""
    named = equals(w.manager_summary, quarter_id=quarter_id).join(manager_names(w), "manager_cik", "left")
    rows = named.select(
        "quarter_id", F.col("manager_cik").alias("cik"), institution_name().alias("institution_name"),
        "portfolio_value_usd", F.col("cusip_count").alias("holding_count"),
    )
    order = [F.col("portfolio_value_usd").desc(), F.col("institution_name"), F.col("cik")]
    return first_n_per_key(rows, ["quarter_id"], order, n)


def top_securities(w: Warehouse, quarter_id: int | None = None, n: int = 5) -> DataFrame:
    """Most widely held value of each quarter."""
    rows = (
        equals(w.security_summary, quarter_id=quarter_id)
        .join(security_names(w), "cusip")
        .select(
            "quarter_id", "cusip", "issuer", F.col("manager_count").alias("institution_count"),
            F.col("total_value_usd").alias("institutional_value_usd"),
        )
    )
    order = [F.col("institutional_value_usd").desc(), F.col("issuer"), F.col("cusip")]
    return first_n_per_key(rows, ["quarter_id"], order, n)


# ---- ranking ---------------------------------------------------------------
@dataclass(frozen=True)
class RankFilter:
    """Search text, ranges and order of a ranking; money in millions, weights in percent."""

    search: str = ""
    security_type: str = ""
    value_millions: tuple[float | None, float | None] = (None, None)
    holdings: tuple[int | None, int | None] = (None, None)
    institutions: tuple[int | None, int | None] = (None, None)
    net_change_millions: tuple[float | None, float | None] = (None, None)
    min_new: int | None = None
    min_exited: int | None = None
    top_10_percent: tuple[float | None, float | None] = (None, None)
    sort_by: str = ""
    descending: bool = True

    def dollars(self, bounds: tuple[float | None, float | None]) -> tuple[int | None, int | None]:
        return millions(bounds[0]), millions(bounds[1])


# The sort keys callers may name, and the columns they stand for.
INSTITUTION_ORDERS = {
    "portfolio": "portfolio_value_usd",
    "buyers": "gross_buy_value_usd",
    "sellers": "gross_sell_value_usd",
    "new": "new_count",
    "exits": "exited_count",
    "growth": "net_value_change_usd",
    "diversified": "holding_count",
    "concentrated": "weight_or_zero",
    "institution": "institution_name",
    "portfolio_value": "portfolio_value_usd",
    "holdings": "holding_count",
    "net_value_change": "net_value_change_usd",
    "new_exited": "new_and_exited",
    "top_10_weight": "weight_or_zero",
    "gross_buy": "gross_buy_value_usd",
    "gross_sell": "gross_sell_value_usd",
    "new_count": "new_count",
    "exited_count": "exited_count",
}
ACTIVITY_COLUMNS = [
    "new_count", "added_count", "reduced_count", "exited_count", "gross_buy_value_usd", "gross_sell_value_usd",
    "net_value_change_usd",
]
INSTITUTION_COLUMNS = [
    "quarter_id", "cik", "institution_name", "quarter_label", "portfolio_value_usd", "holding_count", "top_10_weight",
    "largest_position_weight", *ACTIVITY_COLUMNS,
]


def order_of(names: dict[str, str], sort_by: str, default: str, descending: bool, ties: list[str]) -> list[Column]:
    key = sort_by or default
    if key not in names:
        raise ValueError(f"unknown sort key {key!r}")
    first = F.col(names[key])
    return [first.desc() if descending else first.asc(), *[F.col(t) for t in ties]]


def institution_rows(w: Warehouse, quarter_id: int | None = None, f: RankFilter = RankFilter()) -> DataFrame:
    """One row per institution and quarter with its activity, filtered but not ordered."""
    activity = w.manager_activity.select(*MANAGER_QUARTER, *ACTIVITY_COLUMNS)
    rows = (
        equals(w.manager_summary, quarter_id=quarter_id)
        .join(activity, MANAGER_QUARTER, "left")
        .join(manager_names(w), "manager_cik", "left")
        .withColumns(zero_if_missing(*ACTIVITY_COLUMNS))
    )
    if f.search:
        rows = rows.filter(v.contains_any(f.search, "manager_cik", "manager_name", "sec_company_name"))
    rows = in_range(
        rows,
        {
            "portfolio_value_usd": f.dollars(f.value_millions),
            "cusip_count": f.holdings,
            "net_value_change_usd": f.dollars(f.net_change_millions),
            "new_count": (f.min_new, None),
            "exited_count": (f.min_exited, None),
            "top_10_weight": (percent(f.top_10_percent[0]), percent(f.top_10_percent[1])),
        },
    )
    return rows.withColumns(
        {
            "cik": F.col("manager_cik"),
            "institution_name": institution_name(),
            "quarter_label": v.quarter_label("quarter_id"),
            "holding_count": F.col("cusip_count"),
            "weight_or_zero": F.coalesce("top_10_weight", F.lit(0.0)),
            "new_and_exited": F.col("new_count") + F.col("exited_count"),
        }
    )


def rank_institutions(
    w: Warehouse, quarter_id: int | None = None, f: RankFilter = RankFilter(), page_number: int | None = None,
    page_size: int = 25,
) -> DataFrame:
    """Ranking by any listed key; the whole ranking, or one page of it."""
    rows = institution_rows(w, quarter_id, f)
    order = order_of(INSTITUTION_ORDERS, f.sort_by, "portfolio", f.descending, ["institution_name", "cik"])
    order = [F.col("quarter_id").desc(), *order]
    ranked = rows.orderBy(*order) if page_number is None else page(rows, order, page_number, page_size)
    return ranked.select(*INSTITUTION_COLUMNS)


def institutions_after(
    w: Warehouse, last: dict | None, quarter_id: int | None = None, f: RankFilter = RankFilter(), page_size: int = 25
) -> DataFrame:
    """The page of the ranking that follows the row ``last``, the last one shown (none: the first page)."""
    key = f.sort_by or "portfolio"
    if key not in INSTITUTION_ORDERS:
        raise ValueError(f"unknown sort key {key!r}")
    order = [("quarter_id", True), (INSTITUTION_ORDERS[key], f.descending), ("institution_name", False), ("cik", False)]
    if last is not None:
        weight = last["top_10_weight"]
        last = last | {"weight_or_zero": 0.0 if weight is None else weight, "new_and_exited": last["new_count"] + last["exited_count"]}
    return page_after(institution_rows(w, quarter_id, f), order, last, page_size).select(*INSTITUTION_COLUMNS)


# ---- profile ---------------------------------------------------------------
def institution_identity(w: Warehouse, cik: str | None = None) -> DataFrame:
    span = w.manager_summary.groupBy(F.col("manager_cik").alias("cik")).agg(
        F.min("quarter_id").alias("first_quarter"), F.max("quarter_id").alias("latest_quarter")
    )
    return equals(w.manager_dim, cik=cik).join(span, "cik", "left").select(
        "cik",
        v.display_name("manager_name", "sec_company_name", "cik").alias("institution_name"),
        "sec_company_name",
        F.col("filingmanager_street1").alias("street_1"),
        F.col("filingmanager_street2").alias("street_2"),
        F.col("filingmanager_city").alias("city"),
        F.col("filingmanager_stateorcountry").alias("state_or_country"),
        F.col("filingmanager_zipcode").alias("postal_code"),
        F.col("form13ffilenumber").alias("form_13f_file_number"),
        F.col("crdnumber").alias("crd_number"),
        F.col("latest_related_accession_number").alias("latest_accession_number"),
        "latest_filing_date",
        v.quarter_label("first_quarter").alias("first_reportable_quarter"),
        v.quarter_label("latest_quarter").alias("latest_reportable_quarter"),
    )


def _snapshot_rows(summary: DataFrame, entity: str, quarter_id: int | None) -> DataFrame:
    """Rows of the wanted quarter; entities without it fall back to their own newest quarter.

    A missing quarter means all quarters.
    """
    if quarter_id is None:
        return summary
    pick = summary.groupBy(entity).agg(
        F.coalesce(
            F.max(F.when(F.col("quarter_id") == quarter_id, F.col("quarter_id"))), F.max("quarter_id")
        ).alias("quarter_id")
    )
    return summary.join(pick, [entity, "quarter_id"])


def institution_snapshot(w: Warehouse, quarter_id: int | None = None, cik: str | None = None) -> DataFrame:
    rows = _snapshot_rows(equals(w.manager_summary, manager_cik=cik), "manager_cik", quarter_id)
    names = security_names(w).select(F.col("cusip").alias("largest_cusip"), F.col("issuer").alias("largest_holding_issuer"))
    return rows.join(names, "largest_cusip", "left").select(
        *[c for c in w.manager_summary.columns if not c.startswith("largest_") or c.startswith("largest_position")],
        v.quarter_label("quarter_id").alias("quarter_label"),
        v.ratio("portfolio_value_usd", "instrument_count").alias("average_position_value_usd"),
        F.col("largest_cusip").alias("largest_holding_cusip"),
        "largest_holding_issuer",
    )


def institution_activity(w: Warehouse, cik: str | None = None, quarter_id: int | None = None) -> DataFrame:
    rows = equals(w.manager_action_activity, manager_cik=cik, quarter_id=quarter_id)
    return in_order(rows, cik, *MANAGER_QUARTER, "action")


def institution_allocation(w: Warehouse, cik: str | None = None, quarter_id: int | None = None) -> DataFrame:
    """Value and instrument count per security type; partially aggregated before the type names are joined."""
    per_type = (
        equals(w.positions, manager_cik=cik, quarter_id=quarter_id)
        .groupBy(*MANAGER_QUARTER, "security_type_id")
        .agg(F.sum("value_usd").alias("value_usd"), F.count("*").alias("instrument_count"))
    )
    return per_type.join(type_codes(w), "security_type_id").select(
        *MANAGER_QUARTER, "security_type", "value_usd", "instrument_count"
    )


def allocation_share(w: Warehouse, cik: str | None = None, quarter_id: int | None = None) -> DataFrame:
    """Allocation with each type's share; the window holds one row per security type."""
    total = F.sum("value_usd").over(Window.partitionBy(*MANAGER_QUARTER))
    allocation = institution_allocation(w, cik, quarter_id)
    return allocation.withColumn("share", F.coalesce(v.ratio("value_usd", total), F.lit(0.0)))


def institution_history(w: Warehouse, cik: str | None = None) -> DataFrame:
    activity = w.manager_activity.select(
        *MANAGER_QUARTER, "new_count", "exited_count", "net_value_change_usd", "gross_value_change_usd"
    )
    rows = (
        equals(w.manager_summary, manager_cik=cik)
        .join(activity, MANAGER_QUARTER, "left")
        .withColumns(zero_if_missing("new_count", "exited_count", "net_value_change_usd", "gross_value_change_usd"))
        .select(
            *MANAGER_QUARTER,
            v.quarter_label("quarter_id").alias("quarter_label"),
            "portfolio_value_usd",
            F.col("cusip_count").alias("holding_count"),
            "top_10_weight",
            "largest_position_weight",
            v.ratio("portfolio_value_usd", "instrument_count").alias("average_position_value_usd"),
            "new_count",
            "exited_count",
            "net_value_change_usd",
            v.turnover("gross_value_change_usd", "portfolio_value_usd").alias("turnover_rate"),
        )
    )
    return in_order(rows, cik, *MANAGER_QUARTER)


def behavior_metrics(w: Warehouse, cik: str | None = None) -> DataFrame:
    """Mean turnover and position size, buy/sell ratio, and 1 - top-10 weight of the newest quarter."""
    net = F.col("net_value_change_usd")
    none = F.lit(0).cast("bigint")
    history = institution_history(w, cik)
    totals = history.groupBy("manager_cik").agg(
        F.avg(F.coalesce("turnover_rate", F.lit(0.0))).alias("average_turnover"),
        F.avg(F.coalesce("average_position_value_usd", F.lit(0.0))).alias("average_position"),
        F.sum(F.greatest(net, none)).alias("buys"),
        F.sum(F.abs(F.least(net, none))).alias("sells"),
        F.max_by(F.coalesce("top_10_weight", F.lit(0.0)), "quarter_id").alias("newest_top_10"),
        F.max_by("holding_count", "quarter_id").alias("newest_holdings"),
    )
    return totals.select(
        "manager_cik",
        "average_turnover",
        "average_position",
        v.ratio("buys", "sells").alias("buy_sell_ratio"),
        F.when(F.col("newest_holdings") > 0, 1 - F.col("newest_top_10")).alias("diversification"),
    )


# Sort keys of the holdings list.
HOLDING_ORDERS = {
    "value": "market_value_usd",
    "weight": "weight_or_zero",
    "shares": "reported_amount",
    "share_change": "absolute_amount_change",
    "value_change": "absolute_value_change",
    "issuer": "issuer",
    "action": "action",
}


def held_and_left(w: Warehouse, quarter_id: int | None = None) -> DataFrame:
    """Open positions with their change, plus positions given up in the quarter at their prior size."""
    change = ["action", "amount_change", "amount_change_percent", "value_change_usd", "is_comparable"]
    left = exited_positions(equals(w.changes, to_quarter_id=quarter_id)).select(
        *RELATIONSHIP_KEY,
        F.col("to_quarter_id").alias("quarter_id"),
        F.col("prior_value_usd").alias("market_value_usd"),
        F.col("prior_reported_amount").alias("reported_amount"),
        F.lit(None).cast("double").alias("portfolio_weight"),
        *change,
    )
    held = held_with_change(w, quarter_id).withColumn("action", F.coalesce("action", F.lit("UNCHANGED")))
    return held.select(*left.columns).unionByName(left)


def held_with_change(w: Warehouse, quarter_id: int | None = None) -> DataFrame:
    """Every position with its change columns, NULL where the manager has no previous quarter.

    A position has a change row exactly if its manager reported the quarter before, and
    that row repeats the position's value, amount and weight.  So this is a union of two
    disjoint scans instead of a join of the two largest tables.
    """
    change = {
        "action": "string", "amount_change": "bigint", "amount_change_percent": "double",
        "value_change_usd": "bigint", "is_comparable": "int",
    }
    compared = equals(w.changes, to_quarter_id=quarter_id).filter("current_value_usd IS NOT NULL").select(
        *RELATIONSHIP_KEY,
        F.col("to_quarter_id").alias("quarter_id"),
        F.col("current_value_usd").alias("market_value_usd"),
        F.col("current_reported_amount").alias("reported_amount"),
        F.col("current_portfolio_weight").alias("portfolio_weight"),
        *change,
    )
    first = equals(w.positions, quarter_id=quarter_id).filter("prior_pair_confidential IS NULL").select(
        *RELATIONSHIP_KEY,
        "quarter_id",
        F.col("value_usd").alias("market_value_usd"),
        "reported_amount",
        "portfolio_weight",
        *[F.lit(None).cast(t).alias(c) for c, t in change.items()],
    )
    return compared.unionByName(first)


def institution_holdings(
    w: Warehouse, cik: str | None = None, quarter_id: int | None = None, action: str | None = None,
    security_type: str = "", search: str = "", sort_by: str = "value", descending: bool = True,
    page_number: int | None = None, page_size: int = 25,
) -> DataFrame:
    rows = equals(held_and_left(w, quarter_id), manager_cik=cik, action=valid_action(action))
    rows = rows.join(type_codes(w), "security_type_id").join(security_names(w).drop("figi"), "cusip")
    rows = equals(rows, security_type=security_type)
    if search:
        rows = rows.filter(v.contains_any(search, "cusip", "issuer"))
    if page_number is not None:
        rows = rows.withColumns(
            {
                "weight_or_zero": F.coalesce("portfolio_weight", F.lit(0.0)),
                "absolute_amount_change": F.abs(F.coalesce("amount_change", F.lit(0))),
                "absolute_value_change": F.abs(F.coalesce("value_change_usd", F.lit(0))),
            }
        )
        ties = [*MANAGER_QUARTER, "cusip", "security_type_id", "option_type", "amount_type"]
        rows = page(rows, order_of(HOLDING_ORDERS, sort_by, "value", descending, ties), page_number, page_size)
    return rows.select(
        *MANAGER_QUARTER, "cusip", "issuer", "title_of_class", "security_type", "option_type", "market_value_usd",
        "reported_amount", "amount_type", "portfolio_weight", "action", "amount_change", "amount_change_percent",
        "value_change_usd", "is_comparable",
    )
