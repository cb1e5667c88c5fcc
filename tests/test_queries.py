"""Serving queries with parameters, and their documented quirks."""

import pytest
from pyspark.sql import functions as F

from holdfast.plans import compare, industries, institutions, relationships
from holdfast.plans import securities as sq
from holdfast.plans.institutions import HOLDING_ORDERS, INSTITUTION_ORDERS, RankFilter
from holdfast.plans.securities import HOLDER_ORDERS, SECURITY_ORDERS
from tests.conftest import dicts
from tests.test_positions import facts, sh


class Tables:
    """Just the tables a query under test touches."""

    def __init__(self, **frames):
        self.__dict__.update(frames)


def small_world(spark, filings, lines):
    from holdfast.operators import changes as c

    positions, _, _ = facts(spark, filings, lines)
    names = spark.createDataFrame(
        [(m, f"Name {m}", None) for m in sorted({f[1] for f in filings})],
        "cik string, manager_name string, sec_company_name string",
    )
    variant = positions.select("cusip").distinct().selectExpr(
        "cusip", "concat('Issuer ', cusip) AS current_nameofissuer", "'COM' AS current_titleofclass",
        "CAST(NULL AS STRING) AS current_figi",
    )
    return Tables(positions=positions, changes=c.quarter_changes(positions), manager_dim=names, current_variant=variant)


def test_holder_action_goes_by_meaning_but_history_by_alphabet(spark):
    filings = [("p", "m", 202204, 0), ("q", "m", 202301, 0)]
    lines = [
        sh("p", "A", 10, 5), ("p", "A", 1, 1, "SH", "Call"), sh("q", "A", 10, 5), ("q", "A", 2, 3, "PRN", None),
    ]
    w = small_world(spark, filings, lines)
    holder = sq.security_holders(w, quarter_id=202301).first()
    assert (holder.action, holder.market_value_usd, holder.reported_amount) == ("NEW", 13, 9)  # exited call counts too
    assert holder.portfolio_weight == pytest.approx(10 / 12)  # the largest one, not the sum
    history = {r["quarter_id"]: r for r in dicts(relationships.relationship_history(w))}
    now = history[202301]
    assert (now["action"], now["amount_type"], now["reported_amount"]) == ("UNCHANGED", "PRN,SH", None)
    assert (now["shares"], now["principal_amount"], now["amount_change"]) == (5, 3, None)
    assert history[202204]["action"] == "UNCHANGED" and history[202204]["reported_amount"] == 6


def test_trailing_run_stops_at_a_gap(spark):
    rows = spark.createDataFrame([("m", q) for q in (202204, 202301, 202303, 202304)] + [("n", 202304)], "k string, quarter_id int")
    assert {r["k"]: r["consecutive_quarters_held"] for r in dicts(relationships.trailing_run(rows, ["k"]))} == {"m": 2, "n": 1}


def test_relationship_statistics(spark):
    filings = [(f"f{q}", "m", q, 0) for q in (202203, 202204, 202301, 202303)]
    lines = [sh("f202203", "A", 5, 1), sh("f202204", "A", 9, 3), sh("f202301", "A", 0, 2), sh("f202303", "A", 7, 2)]
    row = relationships.relationship_statistics(small_world(spark, filings, lines)).first()
    assert (row.holding_duration_quarters, row.consecutive_quarters_held) == (3, 1)
    assert (row.last_added, row.last_reduced, row.largest_position_value_usd) == ("2022Q4", "2023Q1", 9)


def ranks(rows, column, descending=True):
    values = [r[column] for r in rows]
    return values == sorted(values, reverse=descending)


def test_institution_order_keys(warehouse):
    quarter = warehouse.latest_quarter()
    rows = {r["cik"]: r for r in dicts(institutions.institution_rows(warehouse, quarter))}
    assert len(INSTITUTION_ORDERS) == 18 and set(INSTITUTION_ORDERS.values()) <= set(next(iter(rows.values())))
    for column, key in {c: k for k, c in INSTITUTION_ORDERS.items()}.items():  # one key per column
        page = dicts(institutions.rank_institutions(warehouse, quarter, RankFilter(sort_by=key), 1, 4))
        best = sorted((r[column] for r in rows.values()), reverse=True)[:4]
        assert [rows[r["cik"]][column] for r in page] == best, key


def test_security_order_keys(warehouse):
    assert len(SECURITY_ORDERS) == 16
    for column, key in {c: k for k, c in SECURITY_ORDERS.items()}.items():
        rows = dicts(sq.rank_securities(warehouse, 202301, RankFilter(sort_by=key, descending=key != "class")))
        if column in rows[0]:
            assert ranks(rows, column, key != "class"), key
    sold = dicts(sq.rank_securities(warehouse, 202301, RankFilter(sort_by="sold")))
    assert ranks(sold, "net_value_change_usd", False)


def test_pages_follow_each_other(warehouse):
    wanted = RankFilter(sort_by="new")
    whole = [r["cusip"] for r in dicts(sq.rank_securities(warehouse, 202301, wanted))]
    pages = [r["cusip"] for n in (1, 2, 3) for r in dicts(sq.rank_securities(warehouse, 202301, wanted, n, 5))]
    assert pages == whole[:15]


def test_holding_and_holder_order_keys(warehouse):
    for key in HOLDING_ORDERS:
        assert institutions.institution_holdings(warehouse, quarter_id=202301, sort_by=key, page_number=1).count() == 25
    for key in HOLDER_ORDERS:
        assert sq.security_holders(warehouse, quarter_id=202301, sort_by=key, page_number=2, page_size=3).count() == 3
    with pytest.raises(ValueError):
        institutions.rank_institutions(warehouse, None, RankFilter(sort_by="nothing"))


def test_filters_and_search(warehouse):
    everything = institutions.institution_rows(warehouse, 202301)
    some = dicts(institutions.rank_institutions(warehouse, 202301, RankFilter(holdings=(3, 9), top_10_percent=(None, 100))))
    wanted = {r["cik"] for r in dicts(everything) if 3 <= r["cusip_count"] <= 9}
    assert {r["cik"] for r in some} == wanted and wanted
    lower = institutions.rank_institutions(warehouse, None, RankFilter(search="mAnAgEr_2")).count()
    assert lower == institutions.rank_institutions(warehouse, None, RankFilter(search="MANAGER 2")).count() > 0
    etf = sq.rank_securities(warehouse, 202301, RankFilter(security_type="ETF"))
    assert {r["security_type"] for r in dicts(etf)} == {"ETF"}
    assert institutions.percent(12.5) == 0.125 and institutions.millions(0.0000025) == 2 and institutions.millions(None) is None


def test_actions_are_validated_and_filtered(warehouse):
    rows = dicts(institutions.institution_holdings(warehouse, action="exited"))
    assert rows and {(r["action"], r["portfolio_weight"]) for r in rows} == {("EXITED", None)}
    for call in (
        lambda: institutions.institution_holdings(warehouse, action="SOLD"),
        lambda: sq.security_holders(warehouse, action="SOLD"),
        lambda: compare.activity_explorer(warehouse, action="SOLD"),
    ):
        with pytest.raises(ValueError):
            call()


def test_holdings_of_one_institution_equal_the_slice_of_all(warehouse):
    cik, quarter = warehouse.changes.groupBy("manager_cik", "to_quarter_id").count().orderBy(F.col("count").desc()).first()[:2]
    one = institutions.institution_holdings(warehouse, cik=cik, quarter_id=quarter)
    all_of_it = institutions.institution_holdings(warehouse).filter((F.col("manager_cik") == cik) & (F.col("quarter_id") == quarter))
    assert one.exceptAll(all_of_it).count() == 0 == all_of_it.exceptAll(one).count() and one.count() > 0


def test_movers_exist_for_adjacent_quarters_only(warehouse):
    assert compare.institution_movers(warehouse, from_quarter=202204, to_quarter=202301, n=3).count() > 0
    assert compare.institution_movers(warehouse, from_quarter=202203, to_quarter=202301).count() == 0
    far = compare.compare_security(warehouse, from_quarter=202103, to_quarter=202303)
    assert far.count() > 0 and {r["from_quarter_id"] for r in dicts(far)} == {202103}


def test_snapshot_falls_back_to_the_newest_own_quarter(warehouse):
    held = {(r[0], r[1]) for r in warehouse.manager_summary.select("manager_cik", "quarter_id").collect()}
    newest = {m: max(q for n, q in held if n == m) for m, _ in held}
    quarters = sorted({q for _, q in held})
    partial = next(q for q in quarters if 0 < sum((m, q) in held for m in newest) < len(newest))
    for wanted in (199901, partial):
        got = {r["manager_cik"]: r["quarter_id"] for r in dicts(institutions.institution_snapshot(warehouse, wanted))}
        assert got == {m: wanted if (m, wanted) in held else newest[m] for m in newest}


def test_unlisted_managers_are_not_in_the_unclassified_division_filter(warehouse):
    def managers(df):
        return df.agg(F.sum("institution_count")).first()[0] or 0

    unfiltered = industries.industry_totals(warehouse).filter("division = 'Unclassified'")
    assert 0 < managers(industries.industry_totals(warehouse, division="Unclassified")) < managers(unfiltered)
    assert industries.industry_totals(warehouse, search="manuf").count() > 0
    assert industries.industry_totals(warehouse, n=2).count() == 2
    one = industries.sic_totals(warehouse, "Manufacturing")
    whole = industries.sic_totals(warehouse)
    assert managers(one) < managers(whole)


def test_search_covers_both_kinds_and_limits(warehouse):
    found = industries.global_search(warehouse, " brd ", None)
    assert {r["result_type"] for r in dicts(found)} == {"security"}
    assert industries.global_search(warehouse, "0", None).count() > 12 == industries.global_search(warehouse, "0").count()


def test_same_issuer_shortlist(spark):
    rows = [(f"C{i:03d}", "BIG", "COM", None) for i in range(60)] + [("X", "SOLO", "COM", None)]
    w = Tables(current_variant=spark.createDataFrame(
        rows, "cusip string, current_nameofissuer string, current_titleofclass string, current_figi string"))
    got = {}
    for r in dicts(sq.same_issuer(w)):
        got.setdefault(r["cusip"], []).append(r["other_cusip"])
    cusips = [f"C{i:03d}" for i in range(60)]
    assert {k: sorted(x) for k, x in got.items()} == {c: [o for o in cusips if o != c][:20] for c in cusips}
