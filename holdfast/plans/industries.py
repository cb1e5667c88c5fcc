"""Aggregation by SIC division and industry, and the search over both entity kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import values as v
from holdfast.plans.common import equals, security_names
from holdfast.plans.warehouse import Warehouse
from holdfast.schemas import MANAGER_QUARTER

NO_DIVISION = "Unclassified"
NO_SIC = "----"


def company_industry(w: Warehouse) -> DataFrame:
    """One industry per CIK; the listing table repeats it on every ticker."""

    def pick(column: str, default: str) -> Column:
        return F.coalesce(v.blank_to_null(F.min(column)), F.lit(default))

    return w.listing_dim.groupBy(F.col("cik").alias("manager_cik")).agg(
        pick("sic_major_group_division", NO_DIVISION).alias("listed_division"),
        pick("sic", NO_SIC).alias("listed_sic"),
        pick("sic_description", NO_DIVISION).alias("listed_description"),
    )


def _portfolios(w: Warehouse, quarter_id: int | None) -> DataFrame:
    activity = w.manager_activity.select(*MANAGER_QUARTER, "net_value_change_usd", "new_count", "exited_count")
    return (
        equals(w.manager_summary, quarter_id=quarter_id)
        .join(activity, MANAGER_QUARTER, "left")
        .join(company_industry(w), "manager_cik", "left")
        .withColumns(
            {
                "division": F.coalesce("listed_division", F.lit(NO_DIVISION)),
                "sic": F.coalesce("listed_sic", F.lit(NO_SIC)),
                "sic_description": F.coalesce("listed_description", F.lit(NO_DIVISION)),
            }
        )
    )


def _measures(*sums: str) -> list[Column]:
    zero = F.lit(0).cast("bigint")
    return [
        F.count("*").alias("institution_count"),
        F.sum("portfolio_value_usd").alias("portfolio_value_usd"),
        F.sum("cusip_count").alias("holding_count"),
        *[F.sum(c).alias(c) for c in sums],
        *[F.sum(F.coalesce(c, zero)).alias(c) for c in ("net_value_change_usd", "new_count", "exited_count")],
    ]


def division_totals(w: Warehouse, quarter_id: int | None = None) -> DataFrame:
    return _portfolios(w, quarter_id).groupBy("quarter_id", "division").agg(
        *_measures("common_stock_value_usd", "etf_value_usd", "call_value_usd", "put_value_usd")
    )


def industry_totals(
    w: Warehouse, quarter_id: int | None = None, division: str = "", search: str = "", n: int | None = None
) -> DataFrame:
    """Totals per industry.

    The division filter looks at the listing's own division, so managers without any
    listing never match it, not even for 'Unclassified'.
    """
    rows = _portfolios(w, quarter_id)
    rows = equals(rows, listed_division=division)
    totals = rows.groupBy("quarter_id", "division", "sic", "sic_description").agg(*_measures())
    if search:
        totals = totals.filter(
            F.concat_ws(" ", "division", "sic", "sic_description").ilike(f"%{search.strip()}%")
        )
    if n is not None:
        totals = totals.orderBy(
            F.col("portfolio_value_usd").desc(), "quarter_id", "division", "sic", "sic_description"
        ).limit(n)
    return totals


def sic_totals(w: Warehouse, division: str = "") -> DataFrame:
    """Quarter totals over all divisions or one."""
    return equals(division_totals(w), division=division).groupBy("quarter_id").agg(
        *[
            F.sum(c).alias(c)
            for c in ("institution_count", "portfolio_value_usd", "holding_count", "net_value_change_usd")
        ]
    )


def global_search(w: Warehouse, text: str, n: int | None = 12) -> DataFrame:
    """Institutions and securities whose number or name contains the text."""
    text = text.strip()
    found_managers = w.manager_dim.filter(v.contains_any(text, "cik", "manager_name", "sec_company_name")).select(
        F.lit("institution").alias("result_type"),
        F.col("cik").alias("result_id"),
        v.display_name("manager_name", "sec_company_name", "cik").alias("label"),
        F.concat(F.lit("CIK "), "cik").alias("detail"),
    )
    found_securities = security_names(w).filter(v.contains_any(text, "cusip", "issuer")).select(
        F.lit("security").alias("result_type"),
        F.col("cusip").alias("result_id"),
        F.col("issuer").alias("label"),
        F.concat("cusip", F.lit(" · "), F.coalesce("title_of_class", F.lit(NO_DIVISION))).alias("detail"),
    )
    found = found_managers.unionByName(found_securities)
    return found if n is None else found.orderBy("result_type", "result_id").limit(n)
